"""Legs become betslips, so money counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipstream import config
from slipstream.functions import accounts, timing
from slipstream.functions.numbers import money
from slipstream.operators.skew import lookup
from slipstream.schema import BY_DAY, SLIP_KEY

# Attributes a slip takes from its first leg. "first" skips nulls, but of these
# only unit can be null; the others always come from the very first row.
FIRST_ROW = ["unit_country", "currency", "currency_inferred", "source", "competition"]

SLIP_COLUMNS = [
    "slip_id", "uid", "betslip_ts", "bet_type", "unit", "unit_country", "channel",
    "currency", "currency_inferred", "source", "stake", "ggr", "net_revenue",
    "stake_eur", "ggr_eur", "net_revenue_eur", "n_legs", "n_matches",
    "first_event_ts", "last_event_ts", "competitions", "price",
    "first_row", "first_competition", "lead_minutes", "phase",
]

# What a leg carries of its slip, so leg queries need no join back.
SLIP_ON_LEG = [
    "slip_id", "n_legs", "n_matches", "phase", "slip_unit", "slip_currency",
    "slip_stake_eur", "slip_ggr_eur", "stake_attr", "ggr_attr",
]


def _is_combined() -> Column:
    return F.coalesce(F.col("bet_type") == "COMBINED", F.lit(False))


def _slip_id(letter: str, row: Column) -> Column:
    """A slip is named after its first row: unique and the same on every run."""
    return F.concat(F.lit(letter), row.cast("string"))


def _finish(slips: DataFrame) -> DataFrame:
    timed = slips.withColumn(
        "lead_minutes", timing.lead_minutes(F.col("betslip_ts"), F.col("first_event_ts"))
    )
    return timed.withColumn("phase", timing.phase(F.col("lead_minutes"))).select(*SLIP_COLUMNS)


def simple_slips(legs: DataFrame) -> DataFrame:
    """A SIMPLE leg is a slip of its own: a projection, no shuffle."""
    one_if = lambda c: F.when(F.col(c).isNotNull(), F.lit(1)).otherwise(0).cast("long")
    return _finish(
        legs.where(~_is_combined()).withColumns(
            {
                "slip_id": _slip_id("S", F.col("row_id")),
                "n_legs": F.lit(1).cast("long"),
                "n_matches": one_if("match_id"),
                "first_event_ts": F.col("event_ts"),
                "last_event_ts": F.col("event_ts"),
                "competitions": one_if("competition"),
                "price": F.coalesce(F.col("price"), F.lit(1.0)),
                "first_row": F.col("row_id"),
                "first_competition": F.col("competition"),
            }
        )
    )


def combined_slips(legs: DataFrame) -> DataFrame:
    """COMBINED legs with one key are one slip.

    One aggregate: legs are folded by slip where they are read, so a key that fills a third of the data
    arrives as a row per task, with its matches and competitions as sets.
    """
    first_unit = F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("row_id")))
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731 - matches of one slip
    grouped = (
        legs.where(_is_combined())
        .groupBy(*SLIP_KEY)
        .agg(
            F.min_by(F.struct(*FIRST_ROW), F.col("row_id")).alias("__first"),
            first_unit.alias("unit"),
            F.min("row_id").alias("first_row"),
            F.count("*").alias("n_legs"),
            distinct("match_id").alias("n_matches"),
            distinct("competition").alias("competitions"),
            F.min("event_ts").alias("first_event_ts"),
            F.max("event_ts").alias("last_event_ts"),
            F.coalesce(F.product("price"), F.lit(1.0)).alias("price"),
        )
    )
    rate = accounts.eur_rate(F.col("currency"))
    opened = grouped.withColumns(
        {
            **{c: F.col("__first")[c] for c in FIRST_ROW if c != "competition"},
            "first_competition": F.col("__first")["competition"],
            "slip_id": _slip_id("C", F.col("first_row")),
            "bet_type": F.lit("COMBINED"),
            "channel": accounts.channel(F.col("uid")),
        }
    )
    return _finish(
        opened.withColumns({f"{c}_eur": money(F.col(c) * rate) for c in ("stake", "ggr", "net_revenue")})
    )


def build_slips(legs: DataFrame, combined: DataFrame | None = None) -> DataFrame:
    """One row per betslip, with lead time and phase.

    ``combined`` are the ``combined_slips`` of these legs, where they have been written."""
    return simple_slips(legs).unionByName(combined_slips(legs) if combined is None else combined)


def attribute_legs(legs: DataFrame, slips: DataFrame) -> DataFrame:
    """Legs with their slip's id and money, and their even share of that money.

    ``slips`` are those of ``build_slips``. Only COMBINED legs look theirs up.
    """
    return share_out(look_up_slips(legs, slips)).select(*legs.columns, *SLIP_ON_LEG)


def look_up_slips(legs: DataFrame, slips: DataFrame, written: bool = False) -> DataFrame:
    """Legs, COMBINED ones with what they take from their slip; it is null on all others, which are slips
    of their own. Legs need not be normalised. ``written`` says that ``slips`` are a written table."""
    of_slip = slips.where(_is_combined()).select(
        *SLIP_KEY,
        "slip_id",
        "n_legs",
        "n_matches",
        "phase",
        F.col("unit").alias("slip_unit"),
        F.col("currency").alias("slip_currency"),
        F.col("stake_eur").alias("slip_stake_eur"),
        F.col("ggr_eur").alias("slip_ggr_eur"),
    )
    combined = lookup(
        legs.where(_is_combined()), of_slip, SLIP_KEY, "n_legs", F.col("row_id"), written=written
    )
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in of_slip.schema if f.name not in SLIP_KEY]
    return legs.where(~_is_combined()).select("*", *nulls).unionByName(combined)


def share_out(legs: DataFrame) -> DataFrame:
    """Normalised legs of ``look_up_slips`` with all of SLIP_ON_LEG: a projection, no shuffle."""
    lead = timing.lead_minutes(F.col("betslip_ts"), F.col("event_ts"))
    alone = {
        "slip_id": _slip_id("S", F.col("row_id")),
        "n_legs": F.lit(1).cast("long"),
        "n_matches": F.when(F.col("match_id").isNotNull(), F.lit(1)).otherwise(0).cast("long"),
        "phase": timing.phase(lead),
        "slip_unit": F.col("unit"),
        "slip_currency": F.col("currency"),
        "slip_stake_eur": F.col("stake_eur"),
        "slip_ggr_eur": F.col("ggr_eur"),
    }
    # Decimal division: exact, and half-up like every other money value.
    share = lambda c: money(F.col(f"slip_{c}") / F.col("n_legs"))
    shares = {
        f"{c.removesuffix('_eur')}_attr": F.when(_is_combined(), share(c)).otherwise(F.col(c))
        for c in ("stake_eur", "ggr_eur")
    }
    own = {c: F.when(_is_combined(), F.col(c)).otherwise(value).alias(c) for c, value in alone.items()}
    return legs.withColumns(shares).withColumns(own)


def data_window(df: DataFrame, start: str = config.DATA_START) -> DataFrame:
    """Slips, or legs, from ``start`` on. A leg has its slip's betslip time, so
    both are cut by a plain filter that reaches the scan, and prunes written days.
    For a start at midnight the days alone decide."""
    if BY_DAY in df.columns:
        df = df.where(F.col(BY_DAY) >= F.lit(start).cast("date"))
        if len(start) == len("2026-06-01"):
            return df
    return df.where(F.col("betslip_ts") >= F.lit(start).cast("timestamp"))


def window_report(slips: DataFrame, start: str = config.DATA_START) -> DataFrame:
    """One row: what the window leaves out, and slips with no usable time."""
    before = F.col("betslip_ts") < F.lit(start).cast("timestamp")
    left_out = F.coalesce(F.sum(F.when(before, F.col("stake_eur"))), F.lit(0))
    return slips.agg(
        F.count_if(F.col("betslip_ts") >= F.lit(start).cast("timestamp")).alias("kept_slips"),
        F.count_if(before).alias("excluded_slips"),
        F.round(left_out, 2).alias("excluded_stake"),
        F.count_if(F.col("betslip_ts").isNull()).alias("untimed_slips"),
    )
