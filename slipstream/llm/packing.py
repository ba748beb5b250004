"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Pieces are taken from the longest down. A
piece goes into the open bin with the least room that holds it, whatever the bin's length. If none
does, each permitted length is tried on the pieces that remain: filled with the piece and then, again
and again, with the longest remaining one that fits. The length with the least cost per token so
filled is opened. At the end each bin shrinks to the shortest permitted length that holds its contents.

Lengths are token counts under a byte-pair vocabulary. Documents longer than the longest sequence
are cut into pieces of that length and a rest, so no token is dropped. Pieces are dealt evenly into
shards of about SHARD_TOKENS tokens by doc_id, text, piece and number among equal rows, and each shard is
packed on its own: a task holds one shard's lengths, and the loss is at most a few open bins a shard.
Nothing depends on how the input is partitioned, so two runs give equal rows.

Defined cases: null and empty texts have no tokens and one row with null bin columns; equal lengths
are taken in the order of doc_id (null last), text hash, piece and number; rows that repeat are packed
each; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from slipstream.llm.common import append_columns, id_and_text, text_hash, written
from slipstream.llm.secret_scan import SPLIT, VOCABULARY, read_vocabulary

LENGTHS = (512, 1024, 2048, 4096, 8192)
SEQUENCE_COST = 16
"""A sequence costs its length and this many tokens more, whatever its length."""
SHARD_TOKENS = 4_000_000
STRETCH_CHARS = 20_000

SCHEMA = (
    "doc_id long, piece long, first_token long, n_tokens long, bin_id long, bin_length long, bin_used long, position long"
)


def stretches(text: str) -> list[str]:
    """The text in stretches of bounded length, cut before blanks where there are any."""
    out, at = [], 0
    while len(text) - at > STRETCH_CHARS:
        cut = text.rfind(" ", at + 1, at + STRETCH_CHARS)
        cut = cut if cut > at else at + STRETCH_CHARS
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``tokens`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        count = lambda raw: sum(len(encoding.encode_ordinary(s)) for s in stretches(raw.decode()))
        return lambda texts: [[count(raw) if raw else 0 for raw in texts]]

    rows = id_and_text(docs).withColumn("text_hash", text_hash())
    return append_columns(rows, make, [("tokens", T.LongType(), pa.int64())]).drop("text")


def filled(length: int, first: int, left: Counter, present: int) -> int:
    """Tokens in a bin of ``length`` that holds ``first`` and then always the longest piece of ``left`` that fits."""
    room = length - first
    while room and (fits := present & ((1 << room + 1) - 1)):
        n = fits.bit_length() - 1
        room -= n * min(left[n], room // n)
        present = fits & ~(1 << n)
    return length - room


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = SEQUENCE_COST) -> list[tuple[int, int]]:
    """(bin, final length) of each size; ``sizes`` fall, and none is above the longest length."""
    lengths = tuple(sorted(lengths))
    left = Counter(sizes)
    present = 0  # bit n is set while pieces of n tokens are left
    for n in left:
        present |= 1 << n
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set while a bin with r tokens of room is open
    used: list[int] = []
    chosen: list[int] = []

    def opened(n: int) -> int:
        """The length to open for ``n``; a trial bin costs what it shrinks to."""
        trials = []
        for c in lengths:
            if c >= n:
                held = filled(c, n, left, present)
                trials.append(((min(x for x in lengths if x >= held) + overhead) / held, -held, c))
        return min(trials)[2]

    for n in sizes:
        left[n] -= 1
        if not left[n]:
            present &= ~(1 << n)
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            held = by_room[room]
            k = held.pop()
            if not held:
                rooms &= ~(1 << room)
        else:
            k = len(used)
            used.append(0)
            room = opened(n)
        used[k] += n
        chosen.append(k)
        room -= n
        if room:
            by_room[room].append(k)
            rooms |= 1 << room
    final = [min(c for c in lengths if c >= u) for u in used]
    return [(k, final[k]) for k in chosen]


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bin_id, bin_length, bin_used, position."""
    longest = max(lengths)
    counted = written(token_counts(docs, vocabulary))
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // SHARD_TOKENS))
    rows = counted.groupBy("doc_id", "text_hash", "tokens").agg(F.count("*").alias("copies"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    rows = rows.select("doc_id", "text_hash", "tokens", upto(F.col("copies")).alias("nth"))
    number = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("tokens") / longest))
    pieces = rows.select("*", upto(number).alias("piece"))
    pieces = pieces.select(
        "doc_id", "text_hash", "nth", "piece", (F.col("piece") * longest).alias("first_token"),
        F.least(F.lit(longest).cast("long"), F.col("tokens") - F.col("piece") * longest).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "text_hash", "nth", "piece"), F.lit(shards)).alias("shard"),
    )

    def pack_shard(t: pa.Table) -> pa.Table:
        order = ("doc_id", "text_hash", "piece", "nth")
        t = t.sort_by([("n_tokens", "descending"), *((c, "ascending") for c in order)])
        bins = best_fit(t["n_tokens"].to_pylist(), lengths)
        shard = t["shard"][0].as_py()
        used, at, position = defaultdict(int), defaultdict(int), []
        for (k, _), n in zip(bins, t["n_tokens"].to_pylist()):
            position.append(at[k])
            at[k] += 1
            used[k] += n
        new = {
            "bin_id": [(shard << 32) + k for k, _ in bins], "bin_length": [c for _, c in bins],
            "bin_used": [used[k] for k, _ in bins], "position": position,
        }
        t = t.drop_columns(["shard", "text_hash", "nth"])
        for name, values in new.items():
            t = t.append_column(name, pa.array(values, pa.int64()))
        return t

    packed = pieces.where("n_tokens > 0").groupBy("shard").applyInArrow(pack_shard, SCHEMA)
    nothing = pieces.where("n_tokens = 0").drop("shard", "text_hash", "nth")
    return packed.unionByName(nothing, allowMissingColumns=True)
