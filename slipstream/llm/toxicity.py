"""Toxicity scores by a bidirectional gated recurrent network over all overlapping windows.

The network (``gru.py``) is trained in numpy on a bounded sample: at most TRAINING_ROWS labelled
documents, those with the smallest hashes of their ids, out of the ids that are not held out, one text
of each id, and at most TRAINING_WINDOWS windows of each. Scoring reads whole texts: windows of WINDOW words start every
STRIDE words, and a document scores as its highest window.

Labels, language, source and id are never inputs. Defined cases: null, empty or wordless texts score
0.0; without any usable label all scores are 0.0; with labels of one kind only, the score is that
kind's smoothed rate; repeated labels of an id count as their mean; repeated rows score alike; other
columns are ignored by the scores.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from slipstream.llm.common import append_columns, id_and_text, letter_words, map_batches, text_bytes, unused_prefix
from slipstream.llm.gru import CHAR_DIM, NGRAM_BITS, UNKNOWN, Adam, Network, character_features, top_by_word

TRAINING_ROWS, TRAINING_WINDOWS, MAX_VOCABULARY, MIN_DOCUMENTS = 4000, 32, 30_000, 4
WINDOW, STRIDE = 64, 32
EPOCHS, LEAST_STEPS, BATCH, CHANCE = 5, 250, 128, 15.0
FOLDS, THRESHOLD = 5, 0.5

def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover ``n`` words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.empty(0, np.int64)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_windows(docs: DataFrame, labels: DataFrame) -> list[tuple[int, float, list[bytes]]]:
    """(document, label, window) of the training sample; bounded by the two sample parameters."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    rows = id_and_text(docs).where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    # of the texts of a repeated id the one with the least hash; reduced in each task before it is dealt out
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    rows = rows.groupBy("doc_id", "toxic").agg(one.alias("one")).select("doc_id", "toxic", "one.text")

    def make():
        def step(batch):
            ids, toxic, parts = [], [], []
            for i, y, t in zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), text_bytes(batch)):
                words = letter_words(t)
                starts = window_starts(len(words))
                if len(starts) > TRAINING_WINDOWS:
                    starts = np.sort(np.random.default_rng(i & 0xFFFFFFFF).choice(starts, TRAINING_WINDOWS, replace=False))
                for s in starts:
                    ids.append(i)
                    toxic.append(y)
                    parts.append(b" ".join(words[s : s + WINDOW]))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(toxic, pa.float64()), pa.array(parts, pa.binary())], ["doc_id", "toxic", "window"]
            )

        return step

    got = map_batches(rows, make, "doc_id long, toxic double, window binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("window", "ascending")])
    shared: dict[bytes, bytes] = {}  # one object per distinct word
    words = ([shared.setdefault(x, x) for x in w.as_py().split()] for w in got["window"])
    return list(zip(got["doc_id"].to_pylist(), got["toxic"].to_pylist(), words))


def train(docs: DataFrame, labels: DataFrame) -> Network:
    return fit(training_windows(docs, labels))


def leaning(toxic: np.ndarray, all_: np.ndarray, rate: float) -> np.ndarray:
    """How strongly the documents with a feature lean to a label: the signed log of the likelihood ratio beyond chance."""
    clean = all_ - toxic
    log = lambda x, of: x * np.log(np.maximum(x, 1e-9) / np.maximum(of, 1e-9))
    evidence = 2 * (log(toxic, all_ * rate) + log(clean, all_ * (1 - rate)))
    return (np.sign(toxic - all_ * rate) * np.log1p(np.maximum(evidence - CHANCE, 0)) / 3).astype(np.float32)


def stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0] .. starts[0] + lengths[0] - 1, starts[1] .., in a row."""
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(lengths.sum())


def all_character_features(words: list[bytes], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The character features of many words, made in parts to bound the memory."""
    parts, starts, done = [], [], 0
    for i in range(0, len(words), at_once):
        codes, begin = character_features(words[i : i + at_once])
        parts.append(codes)
        starts.append(begin + done)
        done += len(codes)
    return np.concatenate(parts), np.concatenate(starts)


def fit(windows: list[tuple[int, float, list[bytes]]], seed: int = 7) -> Network:
    """A network for (document, label, words) windows, in the order of the documents."""
    label = {i: y for i, y, _ in windows}
    positive, n = sum(label.values()), len(label)
    if positive in (0, n):
        return Network({}, {}, constant=float(positive / (n + 1)))

    # vocabulary, and how strongly a word's documents lean to either label
    seen: dict[int, set] = {}
    for i, _, words in windows:
        seen.setdefault(i, set()).update(words)
    counts, toxic = Counter(), Counter()
    for i, ws in seen.items():
        counts.update(ws)
        if label[i]:
            toxic.update(ws)
    common = sorted((w for w, c in counts.items() if c >= MIN_DOCUMENTS), key=lambda w: (-counts[w], w))[:MAX_VOCABULARY]
    vocabulary = {w: k for k, w in enumerate(common, 1)}
    word_prior = leaning(np.array([toxic[w] for w in common]), np.array([counts[w] for w in common]), positive / n)
    distinct: dict[bytes, int] = {}
    flat = np.array([distinct.setdefault(x, len(distinct)) for *_, w in windows for x in w], np.int32)
    codes, starts = all_character_features(list(distinct))
    positions = np.diff(np.append(starts, len(codes)))
    with_gram, toxic_with = np.zeros(1 << NGRAM_BITS), np.zeros(1 << NGRAM_BITS)
    for i, ws in seen.items():
        k = np.fromiter(map(distinct.__getitem__, ws), np.int64, len(ws))
        there = np.unique(codes[stretches(starts[k], positions[k])])
        with_gram[there] += 1
        toxic_with[there] += label[i]
    net = Network.fresh(vocabulary, np.r_[0, word_prior], leaning(toxic_with, with_gram, positive / n), seed)

    # fixed arrays of the windows
    width = max(len(w) for *_, w in windows)
    size = np.array([len(w) for *_, w in windows])
    token = np.zeros((len(windows), width), np.int32)
    token[np.arange(width) < size[:, None]] = flat
    word_id = np.fromiter((vocabulary.get(w, UNKNOWN) for w in distinct), np.int64, len(distinct))
    y = np.array([t for _, t, _ in windows], np.float32)
    doc = np.array([i for i, *_ in windows])
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])

    g = np.random.default_rng(seed)
    best = np.where(np.arange(width) < size[:, None], np.r_[0, word_prior][word_id][token], -9).max(axis=1)
    optimiser = Adam(net.weights)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // (2 * n)))
    for epoch in range(epochs):
        optimiser.rate = 0.01 * (1 - epoch / epochs) + 0.001
        if epoch:
            net._inputs.clear()
            net._rows = None
            rows = net.rows_of(list(distinct))[token].reshape(-1)
            best = net.window_scores(rows, np.arange(len(windows)) * width, size)
        # a toxic document learns from its worst window, a clean one from its worst and one more
        top = np.array([lo + best[lo:hi].argmax() for lo, hi in zip(first, [*first[1:], len(doc)])])
        other = np.array([g.integers(lo, hi) for lo, hi in zip(first, [*first[1:], len(doc)]) if y[lo] == 0])
        chosen = np.r_[top, top[y[top] == 1], other]
        g.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            pick = chosen[i : i + BATCH]
            used = token[pick]
            ids = word_id[used]
            ids = np.where(g.random(ids.shape) < 0.05, UNKNOWN, ids)
            few, where = np.unique(used, return_inverse=True)
            lengths = positions[few]
            at = stretches(starts[few], lengths)
            begin = np.cumsum(lengths) - lengths
            top_chars = top_by_word(net.weights["char"], codes[at], begin)
            where = where.reshape(used.shape)
            _, grad, d_char = net.gradients(ids, top_chars[where], size[pick], y[pick])
            per_word = np.zeros((len(few), CHAR_DIM), np.float32)
            np.add.at(per_word, where.reshape(-1), d_char.reshape(-1, CHAR_DIM))
            won = net.weights["char"][codes[at]] == np.repeat(top_chars, lengths, axis=0)
            grad["char"] = np.zeros_like(net.weights["char"])
            np.add.at(grad["char"], codes[at], won * np.repeat(per_word, lengths, axis=0))
            optimiser.step(grad)
    net._inputs, net._rows = {}, None
    return net


def score_texts(net: Network, texts: list[bytes], words_at_once: int = 120_000) -> np.ndarray:
    """The highest window score of each text."""
    out = np.zeros(len(texts))
    if net.constant is not None:
        out[:] = net.constant
        return out
    held: list[bytes] = []
    windows: list[np.ndarray] = []
    owners: list[np.ndarray] = []

    def flush():
        if held:
            starts, owner = np.concatenate(windows), np.concatenate(owners)
            ends = np.array([end for _, end in bounds])
            lengths = np.minimum(starts + WINDOW, ends[np.searchsorted(ends, starts, "right")]) - starts
            scores = net.window_scores(net.rows_of(held), starts, lengths)
            np.maximum.at(out, owner, scores)
        held.clear(), windows.clear(), owners.clear(), bounds.clear()

    bounds: list[tuple[int, int]] = []
    for i, text in enumerate(texts):
        words = letter_words(text)
        starts = window_starts(len(words))
        per = max(1, words_at_once // STRIDE)
        for k in range(0, len(starts), per):  # a very long text is read in stretches of windows
            some = starts[k : k + per]
            lo, hi = some[0], min(some[-1] + WINDOW, len(words))
            windows.append(some - lo + len(held))
            owners.append(np.full(len(some), i))
            held += words[lo:hi]
            bounds.append((len(held) - (hi - lo), len(held)))
            if len(held) >= words_at_once:
                flush()
    flush()
    return out


def with_toxicity(docs: DataFrame, net: Network, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        net = shared.value
        return lambda texts: [score_texts(net, texts)]

    return append_columns(docs, make, [(name, T.DoubleType(), pa.float64())])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose score is at least THRESHOLD; columns stay as they are."""
    name = unused_prefix(docs.columns) + "toxicity"
    scored = with_toxicity(docs, train(docs, labels), name)
    return scored.where(F.col(name) < THRESHOLD).drop(name)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    scored = with_toxicity(id_and_text(docs), train(docs, labels), "score").drop("text")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
