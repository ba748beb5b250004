"""Records of delimited text whose quoted fields may hold line breaks, cut without one task per file.

Files are read in blocks. Whether a line starts inside a quoted field depends on all quotes before it,
but only on whether their number is odd. So each block's quotes are counted first, and running sums over
the blocks of a file, a row each, say how every block starts. Blocks that start outside quotes and hold
no line with an odd number of them have one record a line; they are not shuffled. In the others the
first and the last line with an odd number tell which lines belong to a record that crosses blocks, any
number of them; only these lines are shuffled, to meet by their record. In all other lines the state runs
along, and records are put together by the task that reads their block, in the order of reading: headers and
states of blocks reach the lines by broadcast, a row per file and block, so that lines stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from slipstream.session import bound_batches, cut_lineage

QUOTE = '"'
BLOCK = ["file", "block"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the block they start in, and an order inside the block."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def header_lines(lines: DataFrame, is_header: Callable[[Column], Column]) -> DataFrame:
    """``file``, ``place`` and ``value`` of the first header line in the first block of each file."""
    found = lines.where((F.col("block") == 0) & is_header(F.col("value")))
    first = F.min(F.struct("place", "value")).alias("first")
    return cut_lineage(found.groupBy("file").agg(first).select("file", "first.place", F.rtrim("first.value", F.lit("\r")).alias("value")))


def below(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines below the header of their file. A file with text but without a header line is an error."""
    named = heads.select(F.col("file").alias("head_file"), F.col("place").alias("head_place"))
    missing = F.raise_error(F.concat(F.lit("export file without a header line: "), F.col("file"))).cast("boolean")
    blank = F.trim(F.rtrim("value", F.lit("\r"))) == ""
    kept = F.when(F.col("head_file").isNull(), F.when(blank, F.lit(False)).otherwise(missing))
    kept = kept.otherwise((F.col("block") > 0) | (F.col("place") > F.col("head_place")))
    on = F.col("file") == F.col("head_file")
    return lines.join(F.broadcast(named), on, "left").where(kept).select(*lines.columns)


def _quotes() -> Column:
    return (F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))).cast("long")


def block_states(lines: DataFrame) -> DataFrame:
    """One row a block: whether it starts and ends inside quotes, and where a record open at its start began.

    ``plain`` blocks have one record a line. A file whose quotes do not close is an error.
    """
    odd = F.when(_quotes() % 2 == 1, F.col("place"))
    blocks = lines.groupBy(*BLOCK).agg(
        F.sum(_quotes()).alias("quotes"), F.min(odd).alias("first_odd"), F.max(odd).alias("last_odd"),
        F.max("place").alias("last"),
    )
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    blocks = blocks.withColumn("open", inside).withColumn("ends_open", (F.col("open") + F.col("quotes")) % 2)
    # a record starts in a block unless it is inside quotes up to its last line
    starts = (F.col("open") == 0) | F.coalesce(F.col("first_odd") < F.col("last"), F.lit(False))
    begun = F.last(F.when(starts, F.col("block")), ignorenulls=True).over(earlier)
    all_quotes = F.sum("quotes").over(Window.partitionBy("file"))
    unclosed = F.raise_error(F.concat(F.lit("quotes do not close in "), F.col("file"))).cast("boolean")
    plain = (F.col("open") == 0) & F.col("first_odd").isNull()
    return blocks.select(
        *BLOCK, "open", "ends_open", "first_odd", "last_odd", begun.alias("begun"),
        F.when(all_quotes % 2 == 1, unclosed).otherwise(plain).alias("plain"),
    )


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of reading, outside quotes before the first and after the last, joined to records."""
    begun, inside, last = [], 0, -1
    for batch in batches:
        lines, places = batch.column("value"), batch.column("place").to_numpy()
        if len(places) and (places[0] <= last or (np.diff(places) <= 0).any()):
            raise ValueError("lines left the order in which they were read")
        last = places[-1] if len(places) else last
        quotes = np.cumsum(pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False))
        ends = np.flatnonzero((inside + quotes) % 2 == 0) + 1
        inside = (inside + quotes[-1]) % 2 if len(quotes) else inside
        if not len(ends):
            begun.append(lines)
            continue
        whole = pa.concat_arrays([*begun, lines.slice(0, ends[-1])])
        offsets = np.concatenate([[0], ends + (len(whole) - ends[-1])]).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), whole), pa.scalar("\n", whole.type))
        yield pa.RecordBatch.from_arrays([texts], ["value"])
        begun = [lines.slice(ends[-1])]
    if any(map(len, begun)):
        raise ValueError("the lines of a block end inside quotes")


def records(lines: DataFrame) -> DataFrame:
    """One row a record, its lines joined by line feeds; blank ones are left out."""
    states = cut_lineage(block_states(lines))
    placed = lines.join(F.broadcast(states), BLOCK)
    single = placed.where("plain").select("value")

    # what is open at a block's start runs up to its first odd line, what is open at its end from its last one on
    head = (F.col("open") == 1) & (F.col("place") <= F.coalesce("first_odd", "place"))
    tail = (F.col("ends_open") == 1) & F.coalesce(F.col("place") >= F.col("last_odd"), F.lit(False))
    mixed = placed.where(~F.col("plain"))

    # all other lines of a block start outside quotes and end there
    bound_batches(lines.sparkSession)
    inner = mixed.where(~(head | tail)).select("place", "value").mapInArrow(_whole_records, "value string")

    # a record that crosses blocks is known by the block it begins in
    begun = F.when(head, F.col("begun")).otherwise(F.col("block"))
    across = mixed.where(head | tail).select("file", begun.alias("block"), F.col("block").alias("at"), "place", "value")
    in_record = Window.partitionBy(*BLOCK).orderBy("at", "place")
    numbered = across.withColumn("nth", F.row_number().over(in_record))
    lines_of = F.array_sort(F.collect_list(F.struct("nth", "value")))
    crossing = numbered.groupBy(*BLOCK).agg(lines_of.alias("lines"))
    crossing = crossing.select(F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))
    whole = single.unionByName(inner).unionByName(crossing)
    return whole.select(F.rtrim("value", F.lit("\r")).alias("value")).where(F.trim("value") != "")
