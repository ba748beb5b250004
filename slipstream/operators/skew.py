"""Lookup joins that hold up when one key carries a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slipstream import config
from slipstream.session import cut_lineage


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread: Column,
    null_safe: bool = True,
    written: bool = False,
) -> DataFrame:
    """Left join ``rows`` to a ``table`` with one row per key.

    ``weight`` is a column of ``table`` that says how many of ``rows`` carry the
    key. Keys with more than 1/HOT_KEYS of all the weight are looked up by
    broadcast: there are fewer than HOT_KEYS of them, whatever the data size.
    All keys also go through an ordinary shuffled join, which the engine may turn
    into another kind by the sizes it meets; rows of heavy keys do so under a
    salt made from ``spread``, which nothing matches: they are dealt evenly over
    the tasks instead of piling up in one.

    ``table`` is read three times, so it is written first unless it already is.
    """
    if not written:
        table = cut_lineage(table)
    values = [c for c in table.columns if c not in keys]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *[F.col(k).alias(f"__{tag}_{k}") for k in keys], F.struct(*values).alias(f"__{tag}")
        )

    everything = table.agg(F.coalesce(F.sum(weight), F.lit(0))).scalar()
    heavy = side(table.where(F.col(weight).cast("double") * config.HOT_KEYS > everything), "hot")
    every = side(table, "all").withColumn("__all_salt", F.lit(0))
    salt = F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1
    salted = rows.join(F.broadcast(heavy), _same(keys, "__hot_", null_safe), "left").withColumn(
        "__salt", F.when(F.col("__hot").isNotNull(), salt).otherwise(0)
    )
    light = _same(keys, "__all_", null_safe) & (F.col("__salt") == F.col("__all_salt"))
    joined = salted.join(every, light, "left")
    found = F.coalesce(F.col("__hot"), F.col("__all"))
    return joined.select(*[F.col(c) for c in rows.columns], *[found[v].alias(v) for v in values])


def _same(keys: Sequence[str], prefix: str, null_safe: bool) -> Column:
    on = F.lit(True)
    for k in keys:
        other = F.col(f"{prefix}{k}")
        on = on & (F.col(k).eqNullSafe(other) if null_safe else F.col(k) == other)
    return on
