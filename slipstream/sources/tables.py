"""Written tables: slips and legs as Parquet, small results as JSON."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from slipstream.schema import BY_DAY


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, optionally partitioned. The rebalance hint lets AQE split a
    partition value that holds much of the data and merge tiny ones, so neither
    one huge file nor thousands of small ones come out."""
    writer = df.hint("rebalance", *by).write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_plain(df: DataFrame, path: str) -> None:
    """Parquet in the partitions that the rows have: they are not shuffled for it."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


# Rows of a day lie in this order as far as a table has the columns, so that Parquet's page statistics
# tell a reader which pages hold one fixture or, inside a fixture, one customer.
CLUSTER = ["fixture", "uid"]
PAGE_ROWS = 2000
BLOOM_COLUMNS = ["uid", "fixture"]


def write_by_day(df: DataFrame, path: str, derived: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Slips or legs, partitioned by betslip date and clustered inside a day.

    The rebalance hint splits a heavy day; every piece is then ordered by CLUSTER. Pages are short, and
    row groups carry Bloom filters, so a filter on one customer or fixture skips most of a day.
    ``derived`` adds the columns that follow from a row alone: after the rows are dealt, so that they are
    not shuffled.
    """
    dated = _dealt(df)
    _write_dated(dated if derived is None else derived(dated), path)


def _dealt(df: DataFrame) -> DataFrame:
    return df.withColumn(BY_DAY, F.to_date("betslip_ts")).hint("rebalance", BY_DAY)


def _write_dated(dated: DataFrame, path: str) -> None:
    order = [c for c in CLUSTER if c in dated.columns]
    writer = dated.sortWithinPartitions(BY_DAY, *order).write.mode("errorifexists").partitionBy(BY_DAY)
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in BLOOM_COLUMNS if c in dated.columns}
    blooms["parquet.bloom.filter.adaptive.enabled"] = "true"  # as large as its values need, not 1 MB each
    pages = {"compression": "zstd", "parquet.page.row.count.limit": str(PAGE_ROWS)}
    writer.options(**pages, **blooms).parquet(path)


def read_by_day(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_slips_legs(
    slips: DataFrame,
    legs: DataFrame,
    path: str,
    derived: Callable[[DataFrame], DataFrame] | None = None,
    alone: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Both tables by day, legs with what is ``derived`` from them.

    ``alone``, where given, makes the slips of legs that are slips of their own; ``slips`` are all others then.
    Written legs lie by day, as heavy days were split and tiny ones merged, so what is projected from them is
    not dealt to days again.
    """
    write_by_day(legs, f"{path}/legs", derived)
    if alone is None:
        write_by_day(slips, f"{path}/slips")
    else:
        projected = alone(read_by_day(legs.sparkSession, f"{path}/legs")).withColumn(BY_DAY, F.to_date("betslip_ts"))
        _write_dated(projected.unionByName(_dealt(slips)), f"{path}/slips")


def write_facts(facts: dict[str, DataFrame], path: str) -> None:
    """Each small result as its own JSON folder."""
    for name, df in facts.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")


def read_fact(spark: SparkSession, path: str, name: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(f"{path}/{name}")
