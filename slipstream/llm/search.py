"""Ranked lexical search over a length-stratified index.

The index. A document's normaliser m depends on its length alone, so all documents of equal m form a
stratum. Documents are reduced to term counts once (the forward table), dealt to strata, and inverted
there: a posting list names a stratum, a term, and the documents by falling tf. A large stratum, which
may hold a third of all documents, is cut into pieces of about PIECE_POSTINGS postings, so one piece is
what one task holds. Inside a stratum the impact of a term depends on tf alone and is computed once
per tf, for all documents of the run.

The search. An item's bound on a stratum is the sum of its terms' weights times the impact of the
highest tf there. First, each item visits its strata of the highest bounds, until these hold ``k``
documents; their k-th score is a threshold. Then it visits every other piece whose own bound reaches
the threshold, and only those. No document that can be among the best is left out, so the answer is exact.
Items are taken in blocks of about ITEM_TERMS terms, each broadcast; one item is never cut.

Defined cases: null, empty and termless texts are in no stratum; items without terms, or whose terms
occur nowhere, have no rows. Equal rows of documents each count and are each returned; equal rows of
items are answered once, items that share an id but not a text are answered each under that id.
Documents without an id rank after all others of their score. Empty tables give no rows. Very long
texts are strata of few documents. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from slipstream.llm.common import id_and_text, letter_words, map_batches, ragged, text_bytes, written

TOP = 20
PIECE_POSTINGS = 400_000
ITEM_TERMS = 1_000_000

#: fixed values of the score: 100 - 25, 25, and the scale and slope of an impact
BASE_M, LENGTH_M, SCALE, TF_UNIT, M_UNIT = 75, 25, 1_000_000_000, 1000, 12

_FORWARD = "doc_id long, n long, lot long, terms array<binary>, tfs array<int>"
_POSTINGS = "m long, piece long, term binary, tfs array<int>, ends array<int>, slots array<int>, docs array<long>"
_ARROW = pa.schema(
    [("m", pa.int64()), ("piece", pa.int64()), ("term", pa.binary()), ("tfs", pa.list_(pa.int32())),
     ("ends", pa.list_(pa.int32())), ("slots", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64()))]
)
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass(frozen=True)
class Index:
    """``postings``: a row per stratum piece and term; the row without a term lists the piece's documents."""

    postings: DataFrame
    documents: int
    terms: int


def impact(tf, m: int):
    return (SCALE * tf) // (TF_UNIT * tf + M_UNIT * m)


def forward_table(docs: DataFrame) -> DataFrame:
    """Per document with terms: its distinct terms and their counts. ``lot`` numbers a task's rows."""

    def make():
        seen = 0

        def step(batch):
            nonlocal seen
            ids, sizes, terms, tfs, ends = [], [], [], [], [0]
            for i, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch)):
                counts = Counter(letter_words(text))
                if counts:
                    ids.append(i)
                    sizes.append(counts.total())
                    terms += counts.keys()
                    tfs += counts.values()
                    ends.append(len(terms))
            lots = np.arange(seen, seen + len(ids))
            seen += len(ids)
            at = pa.array(ends, pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lots),
                 pa.ListArray.from_arrays(at, pa.array(terms, pa.binary())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))],
                ["doc_id", "n", "lot", "terms", "tfs"],
            )

        return step

    return map_batches(id_and_text(docs), make, _FORWARD)


def invert(docs: pa.Table) -> pa.Table:
    """The posting lists of one piece, by term and falling tf, and its documents."""
    key = {c: docs.column(c)[0].as_py() for c in ("m", "piece")}
    terms = docs.column("terms").combine_chunks()
    slot = np.repeat(np.arange(len(docs)), pc.list_value_length(terms).to_numpy())
    tf = docs.column("tfs").combine_chunks().flatten().to_numpy()
    coded = terms.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.lexsort((slot, -tf, code))
    code, tf, slot = code[order], tf[order], slot[order]
    runs = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])])
    run_code = code[runs]
    first = np.flatnonzero(np.r_[True, run_code[1:] != run_code[:-1]])  # a term's first run
    start, size = runs[first], len(first)
    ends = np.r_[runs[1:], len(code)] - np.repeat(start, np.diff(np.r_[first, len(runs)]))
    cut = lambda values, at: pa.ListArray.from_arrays(
        pa.array(np.r_[at, len(values)], pa.int32()), pa.array(values, pa.int32())
    )
    same = {c: pa.array(np.full(size, v), pa.int64()) for c, v in key.items()}
    lists = {"tfs": cut(tf[runs], first), "ends": cut(ends, first), "slots": cut(slot, start)}
    postings = {**same, "term": coded.dictionary.take(pa.array(run_code[first])), **lists, "docs": pa.nulls(size, pa.list_(pa.int64()))}
    names = {**{c: [v] for c, v in key.items()}, **{c: [None] for c in ("term", "tfs", "ends", "slots")}, "docs": [docs.column("doc_id").to_pylist()]}
    return pa.concat_tables([pa.table(postings, schema=_ARROW), pa.table(names, schema=_ARROW)])


def build_index(docs: DataFrame) -> Index:
    """The written index of all ``docs``."""
    forward = written(forward_table(docs))
    whole = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    if not whole.n:
        return Index(docs.sparkSession.createDataFrame([], _POSTINGS), 0, 0)
    stratum = F.expr(f"{BASE_M} + ({LENGTH_M}L * n * {whole.n}L) div {whole.l}L")
    placed = forward.withColumn("m", stratum)
    postings = F.sum(F.size("terms").cast("long"))
    strata = placed.groupBy("m").agg(F.ceil(postings / PIECE_POSTINGS).alias("pieces"))
    dealt = placed.join(written(strata), "m").withColumn("piece", F.pmod(F.xxhash64("doc_id", "lot"), "pieces"))
    dealt = dealt.select("m", "piece", "doc_id", "terms", "tfs")
    return Index(written(dealt.groupBy("m", "piece").applyInArrow(invert, _POSTINGS)), whole.n, whole.l)


def item_terms(items: DataFrame) -> DataFrame:
    """Per distinct item row: ``item`` (a key), its id, its terms and their counts."""
    keyed = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    keyed = keyed.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").where(F.col("text").isNotNull())

    def make():
        def step(batch):
            counts = [Counter(letter_words(t)) for t in text_bytes(batch)]
            flat = [w for c in counts for w in c]
            at = pa.array(np.r_[0, np.cumsum([len(c) for c in counts])], pa.int32())
            uses = [np.fromiter(c.values(), np.int64, len(c)) for c in counts]
            lists = [pa.ListArray.from_arrays(at, pa.array(flat, pa.binary())), ragged(uses, pa.int64())]
            return pa.RecordBatch.from_arrays([batch.column("item"), *lists], ["item", "terms", "uses"])

        return step

    lists = map_batches(keyed.select("item", "text"), make, "item long, terms array<binary>, uses array<long>")
    return written(lists.join(keyed.select("item", "item_id"), "item"))


@dataclass(frozen=True)
class Block:
    """A block of items: entry e says that item ``of[e]`` has term ``term[e]``, worth ``worth[e]``."""

    items: np.ndarray
    starts: np.ndarray
    term: np.ndarray
    worth: np.ndarray
    vocabulary: dict[bytes, int]
    least: np.ndarray  # the threshold of each item
    visited: dict[int, np.ndarray]  # stratum: items that visit it first

    def with_least(self, least: dict[int, int]) -> Block:
        values = np.array([least.get(i, 1) for i in self.items.tolist()], np.int64)
        return Block(self.items, self.starts, self.term, self.worth, self.vocabulary, values, self.visited)


def _block(rows: list, weights: dict[bytes, int], visited: dict[int, list[int]]) -> Block:
    vocabulary = {t: i for i, t in enumerate(sorted(weights))}
    term, worth, starts, items = [], [], [], []
    for row in rows:
        own = [(vocabulary[bytes(t)], u * weights[bytes(t)]) for t, u in zip(row.terms, row.uses) if bytes(t) in vocabulary]
        if own:
            items.append(row.item)
            starts.append(len(term))
            term += [t for t, _ in own]
            worth += [w for _, w in own]
    place = {item: i for i, item in enumerate(items)}
    first = {m: np.array([place[i] for i in some if i in place], np.int64) for m, some in visited.items()}
    as_array = lambda x: np.array(x, np.int64)
    return Block(as_array(items), as_array(starts), as_array(term), as_array(worth), vocabulary, np.ones(len(items), np.int64), first)


def best(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, least: int, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores from ``least`` on, equal ones by id, missing ids last."""
    at = np.flatnonzero(scores >= least)
    if len(at) > k:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    return at[np.lexsort((ids[at], missing[at], -scores[at]))][:k]


def visit(piece: pa.Table, block: Block, first: bool, k: int) -> pa.Table:
    """The best documents of one piece for each item that visits it."""
    m = piece.column("m")[0].as_py()
    terms = piece.column("term").to_pylist()
    names = piece.column("docs")[terms.index(None)].values
    ids, missing = names.fill_null(0).to_numpy(zero_copy_only=False), names.is_null().to_numpy(zero_copy_only=False)
    tfs, ends, slots = (piece.column(c).combine_chunks() for c in ("tfs", "ends", "slots"))
    row = {block.vocabulary[t]: i for i, t in enumerate(terms) if t is not None}
    highest = np.zeros(len(block.vocabulary), np.int64)
    known = {}
    for t, i in row.items():
        once = impact(tfs[i].values.to_numpy().astype(np.int64), m)  # once per tf
        highest[t] = once[0]
        known[t] = (i, once)
    bound = np.add.reduceat(block.worth * highest[block.term], block.starts) if len(block.items) else np.empty(0, np.int64)
    early = block.visited.get(m, np.empty(0, np.int64))
    if first:
        visiting = early[bound[early] >= block.least[early]]
    else:
        wanted = bound >= block.least
        wanted[early] = False
        visiting = np.flatnonzero(wanted)
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    stops = np.r_[block.starts[1:], len(block.term)]
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i in visiting.tolist():
        scores = np.zeros(len(ids), np.int64)
        for e in range(block.starts[i], stops[i]):
            t = int(block.term[e])
            if t not in known:
                continue
            if t not in lists:
                at, once = known[t]
                lists[t] = slots[at].values.to_numpy(), np.repeat(once, np.diff(ends[at].values.to_numpy(), prepend=0))
            where, worth = lists[t]
            scores[where] += block.worth[e] * worth
        top = best(scores, ids, missing, int(block.least[i]), k)
        if len(top):
            out.append((int(block.items[i]), top, scores[top]))
    if not out:
        return _FOUND.empty_table()
    top = np.concatenate([t for _, t, _ in out])
    return pa.table(
        {
            "item": pa.array(np.repeat([i for i, _, _ in out], [len(t) for _, t, _ in out]), pa.int64()),
            "doc_id": pa.array(ids[top], pa.int64(), mask=missing[top]),
            "score": pa.array(np.concatenate([s for *_, s in out]), pa.int64()),
        }
    )


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_strata(hits: DataFrame, rows: DataFrame, weights: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(item, m): each item's strata in the order of their bounds, until they hold ``k`` documents."""
    highest = hits.groupBy("term", "m").agg(F.max(F.get("tfs", F.lit(0)).cast("long")).alias("tf"))
    pairs = rows.select("item", F.explode(F.arrays_zip("terms", "uses")).alias("e"))
    pairs = pairs.select("item", F.col("e.terms").alias("term"), F.col("e.uses").alias("uses")).join(weights, "term")
    top = F.expr(f"({SCALE}L * tf) div ({TF_UNIT} * tf + {M_UNIT} * m)")
    bounds = pairs.join(highest, "term").groupBy("item", "m").agg(F.sum(F.col("uses") * F.col("w") * top).alias("bound"))
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("docs").over(order), F.lit(0))
    return bounds.join(sizes, "m").withColumn("before", before).where(F.col("before") < k).select("item", "m")


def _answer(index: Index, names: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score, rank) for one block of items."""
    spark = rows.sparkSession
    wanted = written(rows.select(F.explode("terms").alias("term")).distinct())
    hits = written(index.postings.join(wanted, "term").select(*index.postings.columns))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2) / (2 * F.sum(F.size("slots")) + 1)))
    weights = written(hits.groupBy("term").agg(weight.cast("long").alias("w")))
    sizes = names.groupBy("m").agg(F.sum(F.size("docs")).alias("docs"))
    visited: dict[int, list[int]] = {}
    for r in first_strata(hits, rows, weights, sizes, k).collect():  # k strata an item at most
        visited.setdefault(r.m, []).append(r.item)
    worth = {bytes(r.term): r.w for r in weights.collect()}  # terms of the block
    block = _block(rows.collect(), worth, visited)

    def visits(pieces: DataFrame, block: Block, first: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        step = lambda piece: visit(piece, shared.value, first, k)
        return pieces.groupBy("m", "piece").applyInArrow(step, "item long, doc_id long, score long")

    pieces = names.unionByName(hits)
    some = pieces.join(spark.createDataFrame([(m,) for m in visited], "m long"), "m")
    found = written(_top(visits(some, block, True), k).drop("rank"))
    full = found.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    block = block.with_least({r.item: r.least for r in full.collect()})  # a number an item
    return _top(found.unionByName(visits(pieces, block, False)), k)


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    rows = item_terms(items)
    size = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-size // ITEM_TERMS)
    names = index.postings.where("term is null")
    found = items.sparkSession.createDataFrame([], "item long, doc_id long, score long, rank int")
    for b in range(blocks if index.documents else 0):
        part = rows.where(F.pmod("item", F.lit(blocks)) == b)
        found = found.unionByName(_answer(index, names, part, k))
    return found.join(rows.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    return search(build_index(docs), items, k)
