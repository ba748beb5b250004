"""Documents scored by cross-entropy difference of a target and a background model.

Both models are bigram models over the same vocabulary, the ids of a byte-pair tokenizer and a start
mark, with the same smoothing. The target model counts the documents labelled as good, the background
model all documents; background counts are scaled to the size of the target, so that both models have
seen equally much text and differ in content only:

    p(w | v) = (c(v, w) + STRENGTH * p(w)) / (c(v) + STRENGTH)
    p(w)     = (1 - SHARED) * c(w) / N + SHARED * q(w)

with one q, that of all documents, for both. A document's own bigrams are taken out of the counts that score
it. Its score is the mean over its tokens of target loss minus background loss, in bits: below zero,
it is more like the target.

Documents are dealt into chunks of about CHUNK_BYTES. Each chunk sends its distinct bigrams with
their counts, the corpus counts are summed per bigram, and each chunk gets back the counts of its own
bigrams. So the model grows with the corpus and is never whole in one place; only the counts per
single token, bounded by the vocabulary, go through the driver.

Defined cases: null and empty texts have no tokens and null losses and score; without target documents both models
are the shared one and scores are 0; labels of an id count by their mean, from 0.5 up as
target; rows that repeat are counted and scored each; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from slipstream.llm.common import id_and_text, written
from slipstream.llm.packing import stretches
from slipstream.llm.secret_scan import SPLIT, VOCABULARY, read_vocabulary

STRENGTH, SHARED = 5.0, 0.2
CHUNK_BYTES = 8 << 20

_WORD = np.int64(1 << 16)


class Tokens:
    """Texts as ids below 2^16 - 1; the vocabulary is built when first needed."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.start = max(ranks.values()) + 1
        if self.start >= 1 << 16:
            raise ValueError("a vocabulary of at most 65,535 tokens is needed")
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def pairs(self, text: str) -> np.ndarray:
        """Every bigram of a text, its first token after the start mark, as v * 2^16 + w."""
        ids = [self.start]
        for s in stretches(text):
            ids += self.encoding.encode_ordinary(s)
        a = np.array(ids, np.int64)
        return a[:-1] * _WORD + a[1:]


_held: dict[str, Tokens] = {}


def _tokens(shared) -> Tokens:
    """One tokenizer per worker process; groups come one at a time."""
    if shared.id not in _held:
        _held.clear()
        _held[shared.id] = Tokens(shared.value)
    return _held[shared.id]


class _Vocabulary:
    def __init__(self, spark, path: str):
        self.broadcast = spark.sparkContext.broadcast(read_vocabulary(path))
        self.id = path

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _chunked(df: DataFrame, key, chunks: int) -> DataFrame:
    return df.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(chunks)))


def target_ids(labels: DataFrame) -> DataFrame:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    rows = rows.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    return rows.where("quality >= 0.5").select("doc_id")


def bigram_counts(docs: DataFrame, targets: DataFrame, vocabulary) -> DataFrame:
    """(chunk, pair, n, n_target) of the distinct bigrams of every chunk."""

    def count(docs: pa.Table, targets: pa.Table) -> pa.Table:
        wanted = set(targets["doc_id"].to_pylist())
        tokens = _tokens(vocabulary)
        every, good = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
            if text:
                pairs = tokens.pairs(text)
                every.append(pairs)
                if doc_id in wanted:
                    good.append(pairs)
        pair, n = np.unique(np.concatenate(every), return_counts=True)
        good, n_good = np.unique(np.concatenate(good), return_counts=True)
        n_target = np.zeros(len(pair), np.int64)
        n_target[np.searchsorted(pair, good)] = n_good
        chunk = docs["chunk"][0].as_py() if docs.num_rows else 0
        return pa.table({"chunk": np.full(len(pair), chunk), "pair": pair, "n": n, "n_target": n_target})

    return docs.groupBy("chunk").cogroup(targets.groupBy("chunk")).applyInArrow(
        count, "chunk long, pair long, n long, n_target long"
    )


def single_counts(pairs: DataFrame, column, size: int) -> np.ndarray:
    """Counts (all, target) per token, from the counts of its bigrams; at most one row a token."""
    rows = pairs.groupBy(column.alias("t")).agg(F.sum("all").alias("n"), F.sum("target").alias("good"))
    out = np.zeros((2, size))
    for r in rows.collect():
        out[:, r.t] = r.n, r.good
    return out


def score_chunks(docs: DataFrame, facts: DataFrame, model, vocabulary) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss); ``facts``: the chunk's bigrams with corpus counts, and its targets."""

    def score(docs: pa.Table, facts: pa.Table) -> pa.Table:
        history, single, n_all, n_target = model.value
        tokens = _tokens(vocabulary)
        scale = n_target / max(1, n_all)
        wanted = set(facts["doc_id"].drop_null().to_pylist())
        facts = facts.filter(facts["doc_id"].is_null())
        pair = facts["pair"].to_numpy()
        order = np.argsort(pair)
        pair = pair[order]
        counts = np.stack([facts["all"].to_numpy()[order] * scale, facts["target"].to_numpy()[order]])
        ids, texts = docs["doc_id"].to_pylist(), docs["text"].to_pylist()
        n_tokens = np.zeros(len(ids), np.int64)
        loss = np.zeros((2, len(ids)))
        q = (single[0] + 1) / (n_all + single.shape[1])
        for at, text in enumerate(texts):
            if not text:
                continue
            mine, n = np.unique(tokens.pairs(text), return_counts=True)
            n_tokens[at] = n.sum()
            v, w = mine >> 16, mine & 0xFFFF
            turn = np.flatnonzero(np.diff(v, prepend=-1))
            own_history = np.repeat(np.add.reduceat(n, turn), np.diff(np.append(turn, len(v))))
            where = np.searchsorted(pair, mine)
            for k, factor in ((0, scale), (1, float(ids[at] in wanted))):
                part = (single[k, w] / (n_all if k == 0 else n_target)) if n_target else q[w]
                p = (1 - SHARED) * part + SHARED * q[w]
                seen = counts[k, where] - factor * n
                before = history[k, v] * (scale if k == 0 else 1) - factor * own_history
                p = (np.maximum(seen, 0) + STRENGTH * p) / (np.maximum(before, 0) + STRENGTH)
                loss[k, at] = -(n * np.log2(p)).sum()
        some = n_tokens > 0
        mean = np.where(some, loss / np.maximum(n_tokens, 1), np.nan)
        return pa.table({
            "doc_id": docs["doc_id"], "n_tokens": n_tokens,
            "target_loss": pa.array(mean[1], mask=~some), "background_loss": pa.array(mean[0], mask=~some),
        })

    return docs.groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInArrow(
        score, "doc_id long, n_tokens long, target_loss double, background_loss double"
    )


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score (bits per token)."""
    spark = docs.sparkSession
    docs = id_and_text(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    docs = _chunked(docs, F.coalesce("doc_id", F.xxhash64("text")), chunks)
    targets = written(_chunked(target_ids(labels), F.col("doc_id"), chunks))
    shared = _Vocabulary(spark, vocabulary)

    local = written(bigram_counts(docs, targets, shared))
    totals = written(local.groupBy("pair").agg(F.sum("n").alias("all"), F.sum("n_target").alias("target")))
    width = 1 << 16
    history = single_counts(totals, F.shiftright("pair", 16), width)
    single = single_counts(totals, F.col("pair").bitwiseAND(F.lit(0xFFFF)), width)
    model = spark.sparkContext.broadcast((history, single, float(single[0].sum()), float(single[1].sum())))

    facts = local.select("chunk", "pair").join(totals, "pair").withColumn("doc_id", F.lit(None).cast("long"))
    facts = facts.unionByName(targets, allowMissingColumns=True).select("chunk", "pair", "all", "target", "doc_id")
    scored = score_chunks(docs, facts, model, shared)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
