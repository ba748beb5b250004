"""Benchmark decontamination with a generalised suffix automaton.

The words of the benchmark items go into an automaton; documents stream through it, and the longest
matching length at each word tells which words lie inside an occurrence of a WINDOW-word piece of an
item (or of a whole item, if it is shorter). Documents are scanned where they are read: nothing is
shuffled. The benchmark is taken in blocks of about BLOCK_BYTES of text, so the driver builds, and
tasks hold, one bounded automaton at a time, however large the benchmark is.

Defined cases: null, empty or wordless texts have no words and are clean; items without words match
nothing; item rows with the same id are one item; an item without an id counts as the id "";
with an empty benchmark all documents are clean; rows that repeat are judged each; other columns are
ignored or carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from slipstream.llm.common import LETTERS, append_columns, id_and_text, letter_words, map_batches, unused_prefix, written
from slipstream.llm.suffix_automaton import ItemAutomaton, merged

WINDOW = 10
BLOCK_BYTES = 512 * 1024
MAX_COVERAGE = 0.5
"""A document with more of its words hit goes whole; otherwise the hit spans are cut out."""

_WORD = re.compile(rb"[^ ]+")
_SPANS = T.ArrayType(T.LongType())


def automata(benchmark: DataFrame):
    """One automaton per block of items, built when asked for."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    for k in range(n_blocks):
        block = sorted((r.item_id, r.text) for r in items.where(F.col("block") == k).toLocalIterator())
        yield ItemAutomaton([(name, letter_words(text.encode())) for name, text in block], WINDOW)


def _scanned(docs: DataFrame, automaton: ItemAutomaton, names: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def make():
        automaton = shared.value

        def derive(texts):
            n_words, spans, items = [], [], []
            for text in texts:
                words = letter_words(text)
                found, which = automaton.scan(words) if words else ([], ())
                n_words.append(len(words))
                spans.append([x for span in found for x in span])
                items.append(sorted({automaton.names[i] for i in which}))
            return [n_words, spans, items]

        return derive

    kinds = [(T.LongType(), pa.int64()), (_SPANS, pa.list_(pa.int64())), (T.ArrayType(T.StringType()), pa.list_(pa.string()))]
    return append_columns(docs, make, [(name, *kind) for name, kind in zip(names, kinds)])


def scan(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with words, spans (flat start, end pairs of words) and items, and the names of these columns."""
    mark = unused_prefix(docs.columns)
    names = [f"{mark}{name}" for name in ("words", "spans", "items")]
    more = [f"{name}_next" for name in names]
    out = None
    for automaton in automata(benchmark):
        if out is None:
            out = _scanned(docs, automaton, names)
            continue
        out = _scanned(written(out), automaton, more).withColumns({
            names[1]: F.concat(names[1], more[1]),
            names[2]: F.array_sort(F.array_union(names[2], more[2])),
        }).drop(*more)
    return out, names


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return merged(list(zip(flat[::2], flat[1::2])))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, (words, spans, items) = scan(id_and_text(docs), benchmark)
    return found.select(
        "doc_id", F.col(words).alias("n_words"), n_hit(spans).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )


def n_hit(spans: str):
    """Words in the union of the spans; they may overlap where several blocks were scanned."""
    pairs = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: F.struct(F.get(spans, i).alias("a"), F.get(spans, i + 1).alias("b"))
    ))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda acc, p: F.struct(
        F.greatest(acc["end"], p["b"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), p["b"] - F.greatest(acc["end"], p["a"]))).alias("n"),
    )
    return F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, start, add, lambda acc: acc["n"]))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(LETTERS))]
    kept, done = [], 0
    for a, b in spans:
        kept.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*kept, text[done:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without hit spans, and without documents hit in more than MAX_COVERAGE of their words.

    Clean documents stay as they are; where a text is cut, ``n_chars``, if there, follows it.
    """
    found, (words, hit, items) = scan(docs, benchmark)
    found = found.where(n_hit(hit) <= F.col(words) * MAX_COVERAGE)

    def make():
        def step(batch):
            at = batch.schema.get_field_index("text")
            spans = batch.column(hit).to_pylist()
            if any(spans):
                texts = batch.column("text").to_pylist()
                new = [without_spans(t.encode(), _pairs(s)).decode() if s else t for t, s in zip(texts, spans)]
                batch = batch.set_column(at, "text", pa.array(new, batch.schema.field(at).type))
            return batch

        return step

    cut = map_batches(found, make, found.schema)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.size(hit) > 0, length).otherwise(F.col("n_chars")))
    return cut.drop(words, hit, items)
