"""How money concentrates along one dimension, and the legs behind a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slipstream import config
from slipstream.functions.numbers import percent, total
from slipstream.operators.rank import gini as gini_of
from slipstream.operators.rank import ordered_counts, ordered_sums

SLIP_DIMS = ["uid", "unit", "channel", "bet_type"]
LEG_DIMS = ["competition", "market_group", "market", "team", "player", "selection", "line"]

# Upper Gini bounds and how they read.
GINI_BANDS = [(0.35, "money is spread evenly"), (0.6, "moderately concentrated")]
GINI_REST = "a few {dim}s dominate"


def _number_label(c: Column) -> Column:
    """5.0 shows as 5, 2.5 as 2.5."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def leg_key(dim: str) -> Column:
    """The value a leg counts under. Null where it counts under nothing."""
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    if dim == "selection":
        return F.concat(
            F.coalesce("match", F.lit("?")), F.lit(" · "), F.col("market_clean"), F.lit(" · "),
            F.coalesce("option_raw", F.lit("")),
        )
    if dim == "line":
        shown = F.concat(F.col("market_clean"), F.lit(" @ "), _number_label(F.col("line")))
        return F.when(F.col("line") >= 0, shown)
    if dim == "market":
        return F.col("market_clean")
    if dim == "team":
        return named("entity_team")
    if dim == "player":
        return named("entity_player")
    if dim == "unit":
        return F.col("slip_unit")
    return F.col(dim)


def _summed(keyed: DataFrame, stake: str, ggr: str) -> DataFrame:
    return (
        keyed.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            total(stake).alias("stake"),
            total(ggr).alias("ggr"),
            F.count("*").alias("n"),
            F.count_distinct("uid").alias("customers"),
        )
    )


def concentrate_slip(slips: DataFrame, dim: str) -> DataFrame:
    """Customer, unit, channel or bet type: full slip money, ``n`` slips. A missing
    value is the key "", so that the shares add up."""
    return _summed(slips.withColumn("key", F.coalesce(F.col(dim), F.lit(""))), "stake_eur", "ggr_eur")


def concentrate_leg(legs: DataFrame, dim: str) -> DataFrame:
    """A leg dimension: evenly split slip money, ``n`` legs."""
    return _summed(legs.withColumn("key", leg_key(dim)), "stake_attr", "ggr_attr")


def top_n_share(rows: DataFrame, n: int = 25) -> DataFrame:
    """The first ``n`` rows by stake with share and running share of all."""
    everything = rows.agg(F.sum("stake")).scalar()
    shown = rows.orderBy(F.desc("stake"), "key").limit(n)
    # At most n rows.
    order = Window.orderBy(F.desc("stake"), "key")
    so_far = F.sum("stake").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return shown.select(
        F.row_number().over(order).cast("long").alias("place"),
        "key",
        "stake",
        percent(F.col("stake"), everything).alias("share"),
        percent(so_far, everything).alias("running_share"),
    )


def top10_share(rows: DataFrame) -> DataFrame:
    everything = rows.agg(F.sum("stake")).scalar()
    top = rows.orderBy(F.desc("stake"), "key").limit(10).agg(F.sum("stake").alias("stake"))
    return top.select(percent(F.col("stake"), everything).alias("top10_share"))


def lorenz(rows: DataFrame, samples: int = config.LORENZ_SAMPLES) -> DataFrame:
    """Points of the Lorenz curve over positive stakes, about ``samples`` of them.

    Every step-th value in global order is a point, and the last. Points are
    generated from (value, count) rows; at most two per sample come out.
    """
    order = ordered_sums(rows.where(F.col("stake") > 0), "stake")
    size = order.agg(
        F.struct(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.sum((F.col("stake") * F.col("n")).cast("decimal(38,6)")).alias("stake"),
        )
    ).scalar()
    step = F.greatest(F.lit(1), F.floor(size["n"] / F.lit(samples)))
    last_here = F.col("before") + F.col("n") - 1
    first_hit = F.ceil(F.col("before") / step) * step
    on_step = F.when(first_hit <= last_here, F.sequence(first_hit, last_here, step)).otherwise(
        F.array().cast("array<bigint>")
    )
    end = F.when(last_here == size["n"] - 1, F.array(last_here)).otherwise(F.array().cast("array<bigint>"))
    places = order.withColumn("i", F.explode(F.array_union(on_step, end)))
    inside = (F.col("i") - F.col("before") + 1) * F.col("stake")
    curve = places.select(
        (F.col("i") + 1).alias("point"),
        ((F.col("i") + 1) / size["n"]).alias("x"),
        F.try_divide(
            (F.col("sum_before") + inside).cast("double"), size["stake"].cast("double")
        ).alias("y"),
    )
    origin = rows.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")
    )
    return origin.unionByName(curve)


def gini(rows: DataFrame, dim: str) -> DataFrame:
    """One row: Gini over positive stakes, and how it reads."""
    result = gini_of(ordered_counts(rows.where(F.col("stake") > 0), "stake"), "stake")
    reading = F.lit(GINI_REST.format(dim=dim))
    for bound, text in reversed(GINI_BANDS):
        reading = F.when(F.col("gini") < bound, text).otherwise(reading)
    return result.withColumn("reading", reading)


def drill_rows(legs: DataFrame, dim: str, key: str, cap: int = config.DRILL_CAP) -> DataFrame:
    """The legs behind one concentration row, largest slips first, up to ``cap``."""
    return (
        legs.where(leg_key(dim) == key)
        .orderBy(F.desc("slip_stake_eur"), "row_id")
        .limit(cap)
        .select(
            "row_id", "betslip_ts", "uid", F.col("slip_unit").alias("unit"),
            F.coalesce("match", F.lit("·")).alias("match"), F.col("market_clean").alias("market"),
            F.coalesce("option_raw", F.lit("")).alias("option"), "price",
            F.col("slip_stake_eur").alias("slip_stake"), F.col("slip_ggr_eur").alias("slip_ggr"),
            "phase", "bet_type",
        )
    )


def drill_total(legs: DataFrame, dim: str, key: str) -> DataFrame:
    return legs.where(leg_key(dim) == key).agg(F.count("*").alias("total"))
