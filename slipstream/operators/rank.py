"""Global order without a one-task sort.

Values are first collapsed to (value, count), which absorbs every tie and every
hot value. They are then range-partitioned and written with their partition
number, so each number names one stretch of the global order. What is left is a
running sum inside each stretch plus the totals of the stretches before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slipstream.operators.skew import lookup
from slipstream.session import cut_lineage


def ordered_counts(df: DataFrame, value: str, within: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-null value, with its place in the global order.

    Columns: ``within``, ``value``, ``n`` (copies), ``before`` (rows with a
    smaller value). With no ``within`` the order is over the whole frame.
    """
    keys = [*within, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    return running_totals(counts, value, within, {"before": F.col("n")})


def ordered_sums(df: DataFrame, value: str, within: Sequence[str] = ()) -> DataFrame:
    """``ordered_counts`` plus ``sum_before``: the sum of all smaller values."""
    keys = [*within, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    weighted = (F.col(value) * F.col("n")).cast("decimal(38,6)")
    return running_totals(counts, value, within, {"before": F.col("n"), "sum_before": weighted})


def running_totals(
    counts: DataFrame, value: str, within: Sequence[str], amounts: dict[str, Column]
) -> DataFrame:
    """Add, for each amount, its sum over all rows with a smaller ``value``.

    ``counts`` holds each value once per group. All its columns are kept.
    """
    in_order = counts.repartitionByRange(*within, value)
    parts = cut_lineage(in_order.withColumn("__part", F.spark_partition_id()))
    for name, amount in amounts.items():
        parts = parts.withColumn(f"__{name}", amount)

    # One row per range partition (and group): bounded by the partition count.
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(*within, "__part").agg(
        *[F.sum(f"__{name}").alias(f"__{name}_all") for name in amounts]
    )
    for name in amounts:
        offsets = offsets.withColumn(f"__{name}_off", F.sum(f"__{name}_all").over(earlier))
    offsets = offsets.select(
        *[F.col(c).alias(f"__o_{c}") for c in within],
        F.col("__part").alias("__o_part"),
        *[f"__{name}_off" for name in amounts],
    )

    here = (
        Window.partitionBy("__part", *within).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    on = F.col("__part") == F.col("__o_part")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    local = parts
    for name in amounts:
        local = local.withColumn(f"__{name}_here", F.sum(f"__{name}").over(here))
    placed = local.join(offsets, on, "left")

    def plus(name: str) -> Column:
        zero = F.lit(0)
        return F.coalesce(F.col(f"__{name}_here"), zero) + F.coalesce(F.col(f"__{name}_off"), zero)

    return placed.select(*counts.columns, *[plus(name).alias(name) for name in amounts])


def percentile_ranks(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Average-rank percentile of every column in ``values``, one row per ``key``.

    Ties share their mean rank, nulls are left out of the count and stay null.
    All columns are ranked in one pass over (column, value) pairs.
    """
    pairs = ", ".join(f"'{v}', cast({v} as double)" for v in values)
    long = df.select(key, F.expr(f"stack({len(values)}, {pairs}) as (measure, value)")).where(
        F.col("value").isNotNull()
    )
    order = ordered_counts(long, "value", ["measure"])
    sizes = order.groupBy("measure").agg(F.sum("n").alias("ranked"))
    # One row per ranked column.
    order = order.join(F.broadcast(sizes), "measure").select(
        "measure",
        "value",
        "n",
        ((F.col("before") + (F.col("n") + 1) / 2) / F.col("ranked")).alias("pctl"),
    )
    ranked = lookup(long, order, ["measure", "value"], "n", F.col(key), null_safe=False)
    return ranked.groupBy(key).agg(
        *[F.max(F.when(F.col("measure") == v, F.col("pctl"))).alias(f"{v}_pctl") for v in values]
    )


def gini(order: DataFrame, value: str) -> DataFrame:
    """Exact Gini from ``ordered_counts``, one row: ``n``, ``gini``."""
    v, n = F.col(value).cast("double"), F.col("n").cast("double")
    amount, count = F.sum(v * n), F.sum(n)
    # sum of (2 i - N - 1) v over all places i, with each value's places summed up
    weighted = F.sum(v * n * (2 * F.col("before") + F.col("n"))) - count * amount
    return order.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.try_divide(weighted, count * amount), F.lit(0.0)).alias("gini"),
    )
