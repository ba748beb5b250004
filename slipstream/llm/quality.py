"""Quality by weak supervision: rules vote or abstain, and EM learns how far to trust each.

Each rule looks at one measure of a whole text and votes good, bad or nothing. The votes of a text
are one of 3^9 patterns, so counting patterns over all documents is a small exact summary of the
corpus; expectation-maximisation runs on those counts. It estimates the share of good documents and,
for each rule, how often its votes on good and on bad documents are right. A document is kept by its
posterior probability of being good, not by passing all rules.

Defined cases: null and empty texts have no words and fail the base rule; if all rules abstain, the
posterior is the share of good documents; rows that repeat are judged each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from slipstream.llm.common import append_columns, id_and_text, written

MIN_WORDS, MAX_REPEATED = 50, 50
KEEP_FROM = 0.5
EM_ROUNDS, PRIOR_VOTES = 100, 10.0
FALSE_ALARMS = 0.001
"""Rules are written to call at most so many good documents bad; EM may find fewer, not more."""
STRETCH = 500

GOOD, BAD, NOTHING = 2, 0, 1
NEVER = -1.0
#: measure, bad above, good up to; a clean sign of junk is no sign of quality where it is missing
RULES = (
    ("symbols", 0.10, NEVER),
    ("capitals", 0.40, NEVER),
    ("bangs", 0.20, NEVER),
    ("repeated", 0.50, NEVER),
    ("duplicate_lines", 0.40, NEVER),
    ("stutter", 0.20, NEVER),
    ("sameness", 0.65, 0.45),
    ("odd_words", 0.30, NEVER),
    ("shortness", 0.02, 0.0125),
)

_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_BLANKS = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))
_PLAIN = bytes(range(33, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))  # ASCII other than letters


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * n_distinct + ids[1:]
    if n_distinct > 2_000_000:  # the triple would not fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    codes = pairs[:-1] * n_distinct + ids[2:]
    _, where, counts = np.unique(codes, return_inverse=True, return_counts=True)
    often = counts[where] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(often)] |= often
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the votes as a number in base 3."""
    words = text.split()
    n = len(words)
    word_chars = len(text.translate(None, _BLANKS + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    repeats = repeated_words(ids, max(1, len(known)))
    if not n:
        return 0, word_chars, symbols, dup_lines, 0, (3 ** len(RULES) - 1) // 2
    upper, lower = (len(text) - len(text.translate(None, s)) for s in (_UPPER, _LOWER))
    odd = sum(c for c in map(_odd, words))
    values = (
        symbols / n, upper / max(1, upper + lower), text.count(b"!!") / n, repeats / n, dup_lines / max(1, len(lines)),
        np.count_nonzero(ids[1:] == ids[:-1]) / n, sameness(ids) if n >= MIN_WORDS else 0.55, odd / n, 1 / n,
    )
    votes = 0
    for v, (_, bad, good) in zip(values, RULES):
        votes = votes * 3 + (BAD if v > bad else GOOD if v <= good else NOTHING)
    return n, word_chars, symbols, dup_lines, repeats, votes


def sameness(ids: np.ndarray) -> float:
    """Share of words that occurred before in the same stretch of STRETCH words; texts of any length compare."""
    stretch = np.arange(len(ids)) // STRETCH
    return 1 - len(np.unique(stretch * (ids.max() + 1) + ids)) / len(ids)


def _odd(word: bytes) -> bool:
    """Whether a word has more other ASCII characters than letters."""
    return 2 * len(word.translate(None, _PLAIN)) < len(word)


def learn(counts: dict[int, int]) -> np.ndarray:
    """Posterior probability of good for every vote pattern, from pattern counts.

    EM over two classes with, per rule and class, the rates of the three answers; it starts from
    "bad if any rule says so". A good vote never counts against a document, a bad vote never for it;
    what an abstention says is learned like the votes.
    """
    patterns = np.arange(3 ** len(RULES))
    votes = np.stack([patterns // 3 ** (len(RULES) - 1 - j) % 3 for j in range(len(RULES))], axis=1)
    answers = np.stack([votes == k for k in (BAD, NOTHING, GOOD)], axis=2).astype(float)
    n = np.zeros(len(patterns))
    n[list(counts)] = list(counts.values())
    seen = n > 0
    x, c = answers[seen], n[seen]
    p = np.where(x[:, :, BAD].any(axis=1), 0.02, 0.98)
    # rates before any document: votes are mostly right, a bad vote is rare on good documents
    start = {1: np.array([0.01, 0.49, 0.50]), 0: np.array([0.20, 0.45, 0.35])}
    for _ in range(EM_ROUNDS):
        share = np.clip((c @ p + 8) / (c.sum() + 10), 0.01, 0.99)
        rate = {}
        for k, w in ((1, c * p), (0, c * (1 - p))):
            rate[k] = np.einsum("i,ijk->jk", w, x) + PRIOR_VOTES * start[k]
            rate[k] /= rate[k].sum(axis=1, keepdims=True)
        rate[1][:, BAD] = np.minimum(rate[1][:, BAD], FALSE_ALARMS)
        weight = np.log(rate[1] / rate[0])
        weight[:, GOOD] = np.maximum(weight[:, GOOD], 0)
        weight[:, BAD] = np.minimum(weight[:, BAD], 0)
        logit = lambda a: np.log(share / (1 - share)) + np.einsum("ijk,jk->i", a, weight)  # noqa: B023,E731
        p = 1 / (1 + np.exp(-logit(x)))
    return 1 / (1 + np.exp(-np.clip(logit(answers), -700, 700)))


def quality(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, kept, and the posterior."""

    def make():
        return lambda texts: list(zip(*map(measure, texts)))

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes")
    rows = append_columns(id_and_text(docs), make, [(n, T.LongType(), pa.int64()) for n in names]).drop("text")
    rows = written(rows)
    counts = {r.votes: r.n for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3^9 rows
    learned = learn(counts)
    table = docs.sparkSession.createDataFrame([(k, float(learned[k])) for k in counts], "votes long, posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = rows.join(F.broadcast(table), "votes").withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM)
    return out.select("doc_id", *names[:5], "base_failed", kept.alias("kept"), F.round("posterior", 6).alias("posterior"))
