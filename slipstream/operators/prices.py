"""Price movement inside the book's own flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipstream import config
from slipstream.functions.numbers import total
from slipstream.operators.skew import lookup

SELECTION = ["match", "market_clean", "option_raw"]


def sel_key(match: Column, market: Column, option: Column) -> Column:
    """Readable key. Null with the market, while a missing match or option shows '?'."""
    dot, unknown = F.lit(" · "), F.lit("?")
    return F.concat(F.coalesce(match, unknown), dot, market, dot, F.coalesce(option, unknown))


def price_legs(legs: DataFrame) -> DataFrame:
    """Legs fit for price analytics, with ``pre_ko`` and ``sel_key``."""
    fit = (
        (F.col("price") > config.PRICE_FLOOR)
        & F.col("event_ts").isNotNull()
        & F.col("betslip_ts").isNotNull()
    )
    return legs.where(fit).withColumns(
        {
            "pre_ko": F.col("betslip_ts") < F.col("event_ts"),
            "sel_key": sel_key(*[F.col(c) for c in SELECTION]),
        }
    )


def _pre_kickoff(priced: DataFrame) -> DataFrame:
    return priced.where(F.col("pre_ko") & F.col("market_clean").isNotNull())


def _time_order() -> Column:
    """Bet time, then row: one fixed-width number, so that picking the first or
    last row stays a hash aggregate instead of a sort."""
    micros = F.unix_micros("betslip_ts").cast("decimal(19,0)")
    return (micros * F.lit(10**18).cast("decimal(19,0)") + F.col("row_id")).cast("decimal(38,0)")


def selection_stats(priced: DataFrame) -> DataFrame:
    """One row per selection over its pre-kickoff legs.

    Legs are first folded to (selection, price), which map-side aggregation
    shrinks to a few rows even for a selection with a third of all bets; the
    distinct prices are then counted over these rows. Customers are counted on their own
    so the fold does not have to carry them.
    """
    pre = _pre_kickoff(priced).withColumn("__order", _time_order())
    exposure = F.col("stake_attr") * (F.col("price").cast("decimal(18,6)") - 1)
    by_price = pre.groupBy(*SELECTION, "competition", "price").agg(
        F.count("*").alias("legs"),
        total("stake_attr").alias("stake"),
        total("ggr_attr").alias("ggr"),
        F.sum(exposure).alias("exposure"),
        F.min("betslip_ts").alias("first_ts"),
        F.max("betslip_ts").alias("last_ts"),
        F.min("__order").alias("first_order"),
        F.max("__order").alias("last_order"),
        F.min_by("event_ts", "__order").alias("kickoff"),
    )
    has_competition = F.when(F.col("competition").isNotNull(), F.col("first_order"))
    folded = by_price.groupBy(*SELECTION).agg(
        F.min_by("competition", has_competition).alias("competition"),
        F.sum("legs").alias("n_legs"),
        F.count_distinct("price").alias("n_prices"),
        F.min_by("price", "first_order").alias("first_price"),
        F.max_by("price", "last_order").alias("last_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.sum("stake").alias("stake"),
        F.sum("ggr").alias("ggr"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min_by("kickoff", "first_order").alias("kickoff"),
        F.sum("exposure").alias("exposure"),
    )
    backers = pre.groupBy(*[F.col(c).alias(f"__{c}") for c in SELECTION]).agg(
        F.count_distinct("uid").alias("n_uids")
    )
    same = F.lit(True)
    for c in SELECTION:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    enough = (F.col("n_legs") >= config.SEL_MIN_LEGS) & (F.col("n_prices") >= config.SEL_MIN_PRICES)
    return folded.join(backers, same).select(
        sel_key(*[F.col(c) for c in SELECTION]).alias("sel_key"),
        *folded.columns,
        "n_uids",
        enough.alias("eligible"),
    )


def eligible_selections(stats: DataFrame) -> DataFrame:
    return stats.where("eligible")


def selection_exposure(stats: DataFrame) -> DataFrame:
    """Potential payout per selection: attributed stake at the struck odds."""
    return stats.select("sel_key", "exposure")


def proxy_clv(priced: DataFrame, stats: DataFrame) -> DataFrame:
    """Pre-kickoff legs on eligible selections against the last struck price."""
    last = eligible_selections(stats).select(
        *SELECTION, F.col("last_price").alias("ref_price"), "n_legs"
    ).withColumnRenamed("n_legs", "sel_legs")
    found = lookup(_pre_kickoff(priced), last, SELECTION, "sel_legs", F.col("row_id"))
    return found.where(F.col("ref_price").isNotNull()).withColumn(
        "proxy_clv", F.col("price") / F.col("ref_price") - 1
    )


def price_trace(legs: DataFrame, match: str, market: str, option: str) -> DataFrame:
    """Struck prices of one selection over time, with its kickoff and the last
    price before kickoff as reference."""
    wanted = (
        F.col("match").eqNullSafe(F.lit(match))
        & (F.col("market_clean") == market)
        & F.col("option_raw").eqNullSafe(F.lit(option))
    )
    of_selection = legs.where(wanted)
    kickoff = of_selection.agg(F.max_by("event_ts", "row_id")).scalar()
    struck = of_selection.where(F.col("price") > config.PRICE_FLOOR)
    before = struck.where(kickoff.isNull() | (F.col("betslip_ts") < kickoff))
    reference = before.agg(F.max_by("price", F.struct("betslip_ts", "row_id"))).scalar()
    return struck.select(
        "row_id",
        "betslip_ts",
        "price",
        kickoff.alias("kickoff"),
        reference.alias("ref_price"),
    )
