"""Raw billing exports: delimited text with a preamble, or Parquet."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from slipstream import schema
from slipstream.functions.markets import strip
from slipstream.sources.records import below, header_lines, read_lines, records

# Names a report writer or reader gives the export's first, unnamed column.
INDEX_NAMES = ("", "Unnamed: 0", "source_row")
BROKEN = "_broken"

# A plain decimal number and a whole one; casts would also take "10d" and "0x1".
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE = r"^[+-]?\d+(\.0*)?$"


def load_export(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Typed legs of one export, in the leg schema.

    The export's unnamed first column is its row number. It is kept as
    ``source_row``: Spark's read order is no substitute for it.
    """
    raw = _read_parquet(spark, path) if _is_parquet(path) else _read_text(spark, path)
    return typed_legs(_project(raw, path), source)


def _is_parquet(path: str) -> bool:
    return path.rstrip("/").endswith(".parquet")


def _read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _read_text(spark: SparkSession, path: str) -> DataFrame:
    """The records below the header row, split by the header's names.

    The preamble ends, in every file, with the line whose fields are the header;
    what stands above it is dropped by place, not by its text. Quoted fields may hold line
    breaks and doubled quotes. Only headers come to the driver. A record without a row number,
    or with too few or too many fields, is an error rather than a silently dropped or broken bet.
    """
    lines = read_lines(spark, path)
    heads = header_lines(lines, _is_header)
    names = _header(heads, path)
    _check_columns(path, names)
    fields = [n if n in schema.EXPORT_COLUMNS else f"_{i}" for i, n in enumerate(names)]
    index = next((f for f, n in zip(fields, names) if n in INDEX_NAMES), None)
    if index is None:
        raise ValueError(f"{path}: no unnamed row-number column")
    as_text = ", ".join(f"`{f}` string" for f in fields)
    body = records(below(lines, heads))
    options = {
        "mode": "PERMISSIVE", "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n",
        "columnNameOfCorruptRecord": BROKEN,
    }
    row = body.select("value", F.from_csv("value", f"{as_text}, `{BROKEN}` string", options).alias("r"))
    number = F.expr(f"try_cast(r.`{index}` as bigint)")
    refuse = lambda why: F.raise_error(F.concat(F.lit(why), F.col("value"))).cast("long")
    checked = (
        F.when(number.isNull(), refuse("export line without a row number: "))
        .when(F.col(f"r.{BROKEN}").isNotNull(), refuse("export line with other fields than the header: "))
        .otherwise(number)
    )
    return row.select(checked.alias("source_row"), *[F.col(f"r.`{f}`") for f in fields])


def _is_header(value: Column) -> Column:
    """Whether a line names the export's columns; they are spelled without quotes or commas."""
    cells = F.transform(F.split(value, ","), lambda x: F.btrim(x, F.lit('" \r')))
    return F.array_contains(cells, schema.HEADER_MARKS[0]) & F.array_contains(cells, schema.HEADER_MARKS[1])


def _header(heads: DataFrame, path: str) -> list[str]:
    """The one header of all files of ``path``."""
    found = [next(csv.reader([r["value"]])) for r in heads.select("value").distinct().take(2)]
    if not found:
        raise ValueError(f"{path}: no header line")
    if len(found) > 1:
        raise ValueError(f"{path}: files with different headers")
    return found[0]


def _check_columns(path: str, names: list[str]) -> None:
    missing = [c for c in schema.EXPORT_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"{path}: missing expected columns {missing}")


def _project(raw: DataFrame, path: str) -> DataFrame:
    """Keep the 17 columns and the row number, under their short names."""
    _check_columns(path, raw.columns)
    index = next((c for c in raw.columns if c in INDEX_NAMES), None)
    if index is None:
        raise ValueError(f"{path}: no row-number column")
    return raw.select(
        *[F.col(f"`{old}`").alias(new) for old, new in schema.EXPORT_COLUMNS.items()],
        F.col(f"`{index}`").cast("long").alias("source_row"),
    )


def _whole_number(name: str, kind: T.DataType) -> Column:
    """Whole numbers exactly; anything else is null."""
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        number = F.col(name)
        return F.when(number == F.floor(number), number).try_cast("long")
    text = strip(F.col(name).cast("string"))
    return F.regexp_replace(F.when(text.rlike(WHOLE), text), r"\.0*$", "").try_cast("long")


def typed_legs(raw: DataFrame, source: str) -> DataFrame:
    """Strip text, parse dates and numbers (bad ones become null), tag the file."""

    def typed(name: str) -> Column:
        if name in schema.TIME_COLUMNS:
            return F.try_to_timestamp(strip(F.col(name)), F.lit(schema.EXPORT_TIME_FORMAT))
        if name in schema.NUMBER_COLUMNS:
            text = strip(F.col(name).cast("string"))
            return F.when(text.rlike(NUMBER), text).try_cast("double")
        if name == "match_id":
            return _whole_number(name, raw.schema[name].dataType)
        return strip(F.col(name).cast("string"))

    return raw.select(
        *[typed(c).alias(c) for c in schema.LEG_COLUMNS],
        F.lit(source).alias("source"),
        "source_row",
    )
