"""What the operators of this subpackage share: table access, words, hashes, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from slipstream.session import bound_batches, cut_lineage

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CACHED_WORDS = 100_000
SLICE_ROWS = 1000
FILTER_BITS = 24

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Letters A-Z to lower case; ASCII other than letters and digits to blanks.
LETTERS = bytes(b if b >= 0x80 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id``, the UTF-8 bytes of the text, and a hash of it; a null text is empty. Other columns go."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        text_hash().alias("text_hash"),
    )


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def letter_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of any other character beyond ASCII, A-Z lower-cased."""
    return text.translate(LETTERS).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, each computed once while it is in the cache.

    The cache is emptied when full, so memory stays bounded over any text; the
    hashes depend on the words alone and agree between executors.
    """

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column with one array a row."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind, safe=False))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to SLICE_ROWS rows, so that few texts at once are held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def unused_prefix(columns: list[str]) -> str:
    """Underscores that no column starts with, for columns that come and go."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema) -> DataFrame:
    """``df`` mapped batch by batch; ``make`` builds a task's state once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in slices(batches):
            if (out := step(batch)) is not None:
                yield out

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes, nulls as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def append_columns(
    docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list]], fields: list[tuple[str, T.DataType, pa.DataType]]
) -> DataFrame:
    """All columns of ``docs`` and new ones that ``make()`` derives from a batch of texts."""
    if clash := {name for name, *_ in fields} & set(docs.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")

    def build():
        derive = make()

        def step(batch):
            new = derive(text_bytes(batch))
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, (_, _, kind) in zip(new, fields)]
            return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(f[0] for f in fields)])

        return step

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t, _ in fields)])
    return map_batches(docs, build, schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators read, as long and string; all others go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def probably_in(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` and ``likely``: false only where the columns ``on`` are surely not in ``keys``.

    Hashed keys set bits of a filter of 2^FILTER_BITS bits, kept as a table of 64-bit words. That table has at most
    2^(FILTER_BITS - 6) rows, whatever the input, so it is broadcast; more keys than bits make it less telling, never
    wrong. Texts that are surely not asked for then stay where they are.
    """
    at = F.pmod(F.xxhash64(*on), F.lit(1 << FILTER_BITS))
    bits = keys.select(at.alias("__at")).groupBy(F.shiftright("__at", 6).alias("__word"))
    bits = written(bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(__at & 63 as int))")).alias("__bits")))
    found = rows.withColumn("__at", at).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(bits), "__word", "left")
    likely = F.coalesce(F.getbit("__bits", F.col("__at").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return found.withColumn("likely", likely).drop("__at", "__word", "__bits")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share, and read back."""
    return cut_lineage(df)
