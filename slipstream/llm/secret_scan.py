"""Secrets in texts: three base patterns, and random strings by their token efficiency.

A byte-pair vocabulary packs natural strings into few tokens and random ones into many. Long runs of
key characters with at most MAX_CHARS_PER_TOKEN characters a token are spans of the kind ``random``,
unless they overlap a base span or are known digests (of a digest's length, with a word for it before
them), UUIDs, numbers, or paths or identifiers whose words encode efficiently. If a whole run is none,
the stretches of it between words are tested, so that a path before a key does not hide it. Base spans
always stay.

The vocabulary file is a parameter; the driver reads it and sends it to the tasks (its size is
checked). Texts are scanned whole, where they are read; nothing is shuffled. Defined cases: null and
empty texts hold no secrets; rows are judged each on its own; other columns are ignored or carried
along.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from slipstream.llm.common import append_columns, id_and_text, map_batches, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20
MAX_CHARS_PER_TOKEN = 2.0
CANDIDATE_CHARS, MIN_HEX, MIN_ACCESS, MIN_VALUE = 20, 32, 16, 8
PLACEHOLDER = "<secret>"
KINDS = ("assign", "access", "hex", "random")

# The base patterns, and how the vocabulary splits texts.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_STEMS = (b"passw", b"secret", b"token", b"api")
_DIGEST = re.compile(r"(?:sha\d+[-:=]|md5[-:=])?(?:[0-9a-f]+|[0-9A-F]+)")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_DIGEST_CHARS = frozenset((32, 40, 48, 56, 64, 96, 128))
_DIGEST_WORD = re.compile(r"sha|md5|digest|checksum|hash|commit|blake|etag|integrity|fingerprint", re.I)
CONTEXT_CHARS = 32
_PARTS = re.compile(r"[^-_/+=]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=.]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*")
_CAMEL = re.compile(r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)+[0-9]*")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS_HEX = _flags(b"0123456789abcdef")
_IS_KEY = _flags(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def runs(text: np.ndarray, flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` flagged bytes."""
    if len(text) < least:
        return []
    edge = np.flatnonzero(np.diff(flags[text].view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist()))


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, leftmost and non-overlapping within a kind."""
    found = []
    low = raw.lower()
    if any(stem in low for stem in _STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if runs(np.frombuffer(raw, np.uint8), _IS_HEX, MIN_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


def is_known(s: str) -> bool:
    """A digest, a UUID, a number, or an identifier or path made of words."""
    return bool(_DIGEST.fullmatch(s) or _UUID.fullmatch(s) or _WORDS.fullmatch(s) or _CAMEL.fullmatch(s))


class Efficiency:
    """Characters per token; the vocabulary is built when first needed."""

    def __init__(self, vocabulary: bytes):
        self.vocabulary, self.encoding = vocabulary, None

    def tokens(self, s: str) -> int:
        if self.encoding is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.vocabulary.splitlines())}
            self.encoding = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return len(self.encoding.encode_ordinary(s))

    def ratio(self, s: str) -> float:
        return len(s) / self.tokens(s)


def is_natural(s: str, before: str, efficiency: Efficiency) -> bool:
    """Whether a known form is what it looks like: a digest by its length and context, a name by its words."""
    if _UUID.fullmatch(s) or not re.search("[A-Za-z]", s) and is_known(s):
        return True
    if _DIGEST.fullmatch(s) and re.search("[0-9]", s):
        hexed = re.split("[-:=]", s)[-1]
        return len(hexed) in _DIGEST_CHARS and bool(_DIGEST_WORD.search(before + s[: len(s) - len(hexed)]))
    if not (_WORDS.fullmatch(s) or _CAMEL.fullmatch(s)):
        return False
    words = _NAME.findall(s)
    tokens = [efficiency.tokens(w) for w in words]
    return max(tokens) == 1 or sum(map(len, words)) > MAX_CHARS_PER_TOKEN * sum(tokens)


def random_stretches(s: str, before: str, efficiency: Efficiency) -> list[tuple[int, int]]:
    """The whole run if it is a random string, else its random stretches between words."""
    if efficiency.ratio(s) <= MAX_CHARS_PER_TOKEN and not is_natural(s, before, efficiency):
        return [(0, len(s))]
    known = [m.span() for m in _UUID.finditer(s)]
    out, group = [], []
    for m in [*_PARTS.finditer(s), None]:
        if m is not None:
            a, b = m.span()
            small = b - a < 4 or m[0].isdigit()  # joins its neighbours, but is no random string by itself
            odd = not small and not is_natural(m[0], (before + s[:a])[-CONTEXT_CHARS:], efficiency)
            odd = odd and efficiency.ratio(m[0]) <= MAX_CHARS_PER_TOKEN and not any(lo < b and a < hi for lo, hi in known)
            if odd or small and group:
                group.append((a, b, odd))
                continue
        while group and not group[-1][2]:
            group.pop()
        if group and group[-1][1] - group[0][0] >= CANDIDATE_CHARS and efficiency.ratio(s[group[0][0] : group[-1][1]]) <= MAX_CHARS_PER_TOKEN:
            out.append((group[0][0], group[-1][1]))
        group = []
    return out


def secret_spans(raw: bytes, efficiency: Efficiency) -> list[tuple[int, int, int]]:
    """All spans of a text, base and random, by start and kind."""
    text = raw.decode()
    found = base_spans(text, raw)
    base = found[:]
    for a, b in runs(np.frombuffer(raw, np.uint8), _IS_KEY, CANDIDATE_CHARS):
        before = raw[max(0, a - CONTEXT_CHARS) : a].decode(errors="ignore")
        start = a if len(text) == len(raw) else len(raw[:a].decode())
        for lo, hi in random_stretches(raw[a:b].decode(), before, efficiency):
            if not any(x < start + hi and start + lo < y for x, _, y in base):
                found.append((start + lo, 3, start + hi))
    return sorted(found)


def read_vocabulary(path: str) -> bytes:
    if (size := os.path.getsize(path)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is too large to send to every task")
    with open(path, "rb") as f:
        return f.read()


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        efficiency = Efficiency(shared.value)

        def derive(texts):
            counts, digests, spans = [[], [], [], []], [], []
            for raw in texts:
                found = secret_spans(raw, efficiency) if raw else []
                for k, held in enumerate(counts):
                    held.append(sum(kind == k for _, kind, _ in found))
                digests.append(hashlib.sha256(_text_of([x for x in found if x[1] < 3]).encode()).hexdigest())
                spans.append(_text_of(found))
            return [*counts, digests, spans]

        return derive

    counts = [(f"n_{kind}", T.LongType(), pa.int64()) for kind in KINDS]
    texts = [(name, T.StringType(), pa.string()) for name in ("base_sha256", "spans")]
    found = append_columns(id_and_text(docs), make, counts + texts)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def without_secrets(raw: bytes, efficiency: Efficiency) -> str | None:
    """The text with a placeholder for each stretch of secrets, None if it holds none."""
    spans = secret_spans(raw, efficiency)
    if not spans:
        return None
    text, out, done = raw.decode(), [], 0
    for a, _, b in spans:
        if a >= done:
            out += [text[done:a], PLACEHOLDER]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with a placeholder in place of every secret; ``n_chars``, if there, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    sized = "n_chars" in docs.columns

    def make():
        efficiency = Efficiency(shared.value)

        def step(batch):
            new = {i: t for i, raw in enumerate(text_bytes(batch)) if (t := without_secrets(raw, efficiency)) is not None}
            if new:
                for name in ["text", "n_chars"] if sized else ["text"]:
                    at = batch.schema.get_field_index(name)
                    values = batch.column(at).to_pylist()
                    for i, t in new.items():
                        values[i] = t if name == "text" else len(t)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            return batch

        return step

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return map_batches(typed, make, typed.schema)
