"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Only documents are labelled; the network
(``attention_mil.py``) learns what a passage says and which passages decide, and scores the weighted
passage representation. It is trained on a bounded sample: at most TRAINING_ROWS labelled documents, those with the
smallest hashes of their ids, out of the ids that are not held out, one text of each id, and at most
TRAINING_PASSAGES evenly spread passages of each. Measures of repetition are those of the whole text, in
training too. Scoring reads every passage of every text.

Labels, language, source and id are never inputs. Defined cases: null, empty and wordless texts score
0.0; without any usable label all scores are 0.0; with labels of one kind only, the score is that kind's
smoothed rate; repeated labels of an id count as their mean, a tie as 1; repeated rows score alike; very
long texts are scored whole, in stretches of passages; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from slipstream.llm.attention_mil import SHAPE_BITS, WORD_BITS, Adam, Bags, Network
from slipstream.llm.common import append_columns, id_and_text, map_batches, mix, ragged, text_bytes

PASSAGE = 64
TRAINING_ROWS, TRAINING_PASSAGES = 4000, 12
EPOCHS, LEAST_STEPS, BATCH = 8, 250, 64
FOLDS, THRESHOLD = 5, 0.3
CACHED_WORDS = 100_000

_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_SHAPES = bytes(65 if b in _UPPER else 97 if b in _LOWER or b >= 0x80 else 48 if b in _DIGITS else b for b in range(256))
_OTHER = bytes(b for b in range(128) if b not in _UPPER + _LOWER + _DIGITS)
_RUN = re.compile(rb"(.)\1+", re.S)
MEASURES = 9


class WordTable(dict):
    """Distinct words of this task: codes and measures of each, emptied between texts when full."""

    def __init__(self):
        self.codes: list[tuple[int, int, float, float, float, float]] = []

    def __missing__(self, word: bytes) -> int:
        n = len(word)
        shape = _RUN.sub(rb"\1", word.translate(_SHAPES))
        without = lambda some: (n - len(word.translate(None, some))) / n
        self.codes.append(
            (xxhash.xxh3_64_intdigest(word) % (1 << WORD_BITS), xxhash.xxh3_64_intdigest(shape) % (1 << SHAPE_BITS),
             min(n, 40) / 10, without(_UPPER), without(_OTHER), without(_DIGITS))
        )
        self[word] = at = len(self.codes) - 1
        return at

    def make_room(self) -> None:
        if len(self) >= CACHED_WORDS:
            self.clear()
            self.codes.clear()


def bags_of(texts: list[list[bytes]], table: WordTable) -> Bags:
    """The passages of documents, each given as its words, of which there is at least one."""
    n = np.array([len(t) for t in texts])
    word = np.fromiter((table[w] for t in texts for w in t), np.int64, n.sum())
    used, word = np.unique(word, return_inverse=True)
    known = np.array([table.codes[i] for i in used.tolist()])
    begin = np.cumsum(n) - n
    passages = -(-n // PASSAGE)
    docs = np.cumsum(passages) - passages
    starts = np.repeat(begin - docs * PASSAGE, passages) + PASSAGE * np.arange(passages.sum())
    sizes = np.diff(np.append(starts, len(word)))
    passage = np.repeat(np.arange(len(starts)), sizes)

    # words in three-word sequences that the same text has twice or more, and words like the one before
    doc = np.repeat(np.arange(len(n)), n)
    key = mix(doc.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64))
    again = np.zeros(len(word))
    if len(word) > 2:
        three = mix(mix(key[:-2]) + key[1:-1]) + key[2:]
        order = np.argsort(three, kind="stable")
        equal = three[order][1:] == three[order][:-1]
        often = np.zeros(len(three), bool)
        often[order] = np.r_[False, equal] | np.r_[equal, False]
        often &= doc[:-2] == doc[2:]
        for k in range(3):
            again[k : k + len(often)] += often
    same = np.r_[False, key[1:] == key[:-1]]
    distinct = np.bincount(np.unique(passage * len(used) + word) // len(used), minlength=len(starts))
    mean = lambda v: np.add.reduceat(v.astype(np.float64), starts) / sizes
    measures = np.stack(
        [*(mean(known[word, k]) for k in range(2, 6)), mean(again > 0), mean(same), distinct / sizes,
         np.log1p(sizes) / 4, np.log1p(np.repeat(n, passages)) / 8], axis=1
    )
    codes = known[:, :2].astype(np.int32)
    return Bags(codes[word, 0], codes[word, 1], starts, measures.astype(np.float32), docs)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _evenly(n: int) -> np.ndarray:
    """At most TRAINING_PASSAGES of ``n`` passages, from the first to the last."""
    return np.unique(np.linspace(0, n - 1, min(n, TRAINING_PASSAGES)).astype(np.int64))


_SAMPLE = "doc_id long, label double, measures array<float>, words array<int>, shapes array<int>"


def training_passages(docs: DataFrame, labels: DataFrame) -> pa.Table:
    """The passages of the training sample, as codes; bounded by the two sample parameters."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    rows = id_and_text(docs).where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    rows = rows.groupBy("doc_id", "label").agg(one.alias("one")).select("doc_id", "label", "one.text")

    def make():
        table = WordTable()

        def step(batch):
            out: dict[str, list] = {c: [] for c in ("doc_id", "label", "measures", "words", "shapes")}
            for i, y, text in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), text_bytes(batch)):
                table.make_room()
                if not (words := text.split()):
                    continue
                bags = bags_of([words], table)
                ends = np.append(bags.starts, len(bags.words))
                for p in _evenly(len(bags.starts)):
                    part = slice(ends[p], ends[p + 1])
                    for c, v in zip(out, (i, y, bags.measures[p], bags.words[part], bags.shapes[part])):
                        out[c].append(v)
            arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["label"], pa.float64()), ragged(out["measures"], pa.float32()),
                      ragged(out["words"], pa.int32()), ragged(out["shapes"], pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, list(out))

        return step

    got = map_batches(rows, make, _SAMPLE).toArrow().combine_chunks()
    place = pa.array(np.arange(len(got)))  # passages of a document stay in their order
    return got.append_column("place", place).sort_by([("doc_id", "ascending"), ("place", "ascending")])


def fit(sample: pa.Table, seed: int = 11) -> Network:
    ids, label = sample["doc_id"].to_numpy(), sample["label"].to_numpy()
    docs = np.flatnonzero(np.r_[True, np.diff(ids) != 0]) if len(ids) else np.empty(0, np.int64)
    y = label[docs] if len(docs) else np.empty(0)
    if len(y) == 0 or y.min() == y.max():
        return Network({}, constant=float((y.sum()) / (len(y) + 1)))
    flat = lambda c: sample[c].combine_chunks().flatten().to_numpy()
    words, shapes, measures = flat("words"), flat("shapes"), flat("measures").reshape(-1, MEASURES)
    sizes = np.array([len(x) for x in sample["words"]])
    starts, per_doc = np.cumsum(sizes) - sizes, np.diff(np.append(docs, len(ids)))

    def batch(pick: np.ndarray) -> Bags:
        n = per_doc[pick]
        passage = np.repeat(docs[pick] - np.cumsum(n) + n, n) + np.arange(n.sum())
        size = sizes[passage]
        at = np.repeat(starts[passage] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Bags(words[at], shapes[at], np.cumsum(size) - size, measures[passage], np.cumsum(n) - n)

    g = np.random.default_rng(seed)
    net = Network.fresh(MEASURES, seed)
    optimiser = Adam(net.weights)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        optimiser.rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = g.permutation(len(y))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            _, grad = net.gradients(batch(pick), y[pick])
            optimiser.step(grad)
    return net


def train(docs: DataFrame, labels: DataFrame) -> Network:
    return fit(training_passages(docs, labels))


def score_texts(net: Network, texts: list[bytes], table: WordTable, words_at_once: int = 200_000) -> np.ndarray:
    out = np.zeros(len(texts))
    if net.constant is not None:
        out[:] = net.constant
        return out
    held: list[list[bytes]] = []
    places: list[int] = []

    def flush():
        if held:
            out[places] = net.scores(bags_of(held, table))
        held.clear(), places.clear()
        table.make_room()

    size = 0
    for i, text in enumerate(texts):
        if words := text.split():
            held.append(words)
            places.append(i)
            size += len(words)
        if size >= words_at_once:
            flush()
            size = 0
    flush()
    return out


def with_quality(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        net, table = shared.value, WordTable()
        return lambda texts: [score_texts(net, texts, table)]

    return append_columns(docs, make, [(name, T.DoubleType(), pa.float64())])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    scored = with_quality(id_and_text(docs), train(docs, labels)).drop("text")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
