"""The leg schema and the header names of a raw export."""

from __future__ import annotations

from pyspark.sql import types as T

# Export header -> column name, in export order.
EXPORT_COLUMNS = {
    "Sport": "sport",
    "Competition": "competition",
    "MatchId": "match_id",
    "MATCH": "match",
    "Event date (utc)": "event_ts",
    "Market": "market_raw",
    "BetType": "bet_type",
    "Player": "player_raw",
    "Option": "option_raw",
    "Betslip date (utc)": "betslip_ts",
    "Uid": "uid",
    "Management unit": "unit",
    "Price": "price",
    "TURNOVER": "stake",
    "GGR": "ggr",
    "Net Revenue": "net_revenue",
    "Currency Code": "currency_raw",
}
# Two names that tell the header line from the report's preamble.
HEADER_MARKS = ("MatchId", "Uid")
EXPORT_TIME_FORMAT = "dd/MM/yyyy HH:mm:ss"

# The partition column of written slips and legs.
BY_DAY = "betslip_date"

LEG_COLUMNS = list(EXPORT_COLUMNS.values())
NUMBER_COLUMNS = ["price", "stake", "ggr", "net_revenue"]
TIME_COLUMNS = ["event_ts", "betslip_ts"]
TEXT_COLUMNS = [
    c for c in LEG_COLUMNS if c not in (*NUMBER_COLUMNS, *TIME_COLUMNS, "match_id")
]


def _leg_type(name: str) -> T.DataType:
    if name in NUMBER_COLUMNS:
        return T.DoubleType()
    if name in TIME_COLUMNS:
        return T.TimestampType()
    return T.LongType() if name == "match_id" else T.StringType()


# One typed leg: the 17 export columns, the file it came from, its row there.
LEG_SCHEMA = T.StructType(
    [T.StructField(c, _leg_type(c)) for c in LEG_COLUMNS]
    + [
        T.StructField("source", T.StringType()),
        T.StructField("source_row", T.LongType()),
    ]
)

# What makes two rows the same bet. Settlement (ggr, net_revenue) is left out:
# it can move between two pulls.
IDENTITY = [
    "uid",
    "betslip_ts",
    "match_id",
    "market_raw",
    "player_raw",
    "option_raw",
    "bet_type",
    "price",
    "stake",
]

# What makes two COMBINED legs part of one betslip. Native currency money.
SLIP_KEY = ["uid", "betslip_ts", "stake", "ggr", "net_revenue"]
