"""Time series over slips, with quiet buckets as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slipstream import config
from slipstream.functions import timing
from slipstream.functions.numbers import ratio, rounded, total

HOUR, DAY = 3600, 86400

# Closed label sets: the lines a split can have.
SPLITS = {
    "none": ["total"],
    "phase": config.PHASES,
    "channel": config.CHANNELS,
    "bet_type": config.BET_TYPES,
}


def _metric(name: str) -> Column:
    return {
        "turnover": lambda: total("stake_eur").cast("double"),
        "ggr": lambda: total("ggr_eur").cast("double"),
        "slips": lambda: F.count("*").cast("double"),
        "avg_stake": lambda: ratio(total("stake_eur"), F.count("*")),
        "customers": lambda: F.count_distinct("uid").cast("double"),
    }[name]()


def drop_empty(filled: DataFrame, group: str, value: str) -> DataFrame:
    """Leave out groups whose every value is 0. Groups are few and closed."""
    any_value = F.max(F.col(value) != 0).over(Window.partitionBy(group))
    return filled.withColumn("__any", any_value).where("__any").drop("__any")


def _filled(slips: DataFrame, metric: str, split: str, seconds: int) -> DataFrame:
    timed = slips.where(F.col("betslip_ts").isNotNull())
    label = F.lit("total") if split == "none" else F.col(split)
    values = timed.groupBy(
        timing.bucket_start(F.col("betslip_ts"), seconds).alias("bucket"), label.alias("name")
    ).agg(_metric(metric).alias("value"))
    span = timed.agg(F.min("betslip_ts").alias("low"), F.max("betslip_ts").alias("high"))
    steps = F.sequence(
        timing.bucket_start(F.col("low"), seconds),
        timing.bucket_start(F.col("high"), seconds),
        F.expr(f"interval {seconds} seconds"),
    )
    labels = F.array(*[F.lit(x) for x in SPLITS[split]])
    spine = span.select(F.explode(steps).alias("bucket")).select(
        "bucket", F.explode(labels).alias("name")
    )
    return spine.join(values, ["bucket", "name"], "left").select(
        "bucket", "name", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def time_series(slips: DataFrame, metric: str, split: str = "none", seconds: int = DAY) -> DataFrame:
    """``bucket``, ``name``, ``value`` to 2 decimals for every bucket from the
    first bet to the last. Lines that are 0 throughout are left out."""
    rounded_values = _filled(slips, metric, split, seconds).withColumn(
        "value", rounded(F.col("value"), 2)
    )
    return drop_empty(rounded_values, "name", "value")


def series_totals(slips: DataFrame, metric: str, split: str = "none", seconds: int = DAY) -> DataFrame:
    """Per bucket, the sum over its lines. For customers and average stake this
    counts a customer once per line, hence the column name."""
    return (
        _filled(slips, metric, split, seconds)
        .groupBy("bucket")
        .agg(rounded(F.sum(F.col("value").cast("decimal(28,9)")), 2).alias("sum_over_groups"))
    )
