"""Removal of long byte strings that occur more than once, anywhere in the corpus.

Every byte covered by a WINDOW-byte string that also starts elsewhere goes. Texts are judged as they
come, as UTF-8 bytes, and strings do not cross documents.

1. Each window of WINDOW bytes picks an anchor, the last of its smallest ANCHOR-byte hashes. Equal
   windows pick the same anchor, so equal strings meet where anchors of equal hash are grouped; about
   one byte in 150 is an anchor.
2. Equal texts are one text. An anchor that occurs once in the distinct texts is done.
3. What surrounds an anchor within reach of a window is its context. Occurrences with equal contexts
   repeat as a whole. The distinct contexts of an anchor go to one task, which sorts them into an
   enhanced suffix array and reads maximal repeat groups off its common-prefix intervals
   (``repeat_groups.py``).
4. An anchor with more than CROWD distinct contexts is not gathered: the windows of its contexts are
   counted by hash over all tasks instead, with the same result.

Defined cases: null and empty texts have no bytes; texts below WINDOW bytes keep all; rows with equal
texts lose all their bytes if the text has a window; rows that repeat a doc_id, or have none, are judged by
their texts; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from slipstream.llm.common import map_batches, mix, probably_in, ragged, text_bytes, written
from slipstream.llm.repeat_groups import maximal_repeats

WINDOW, ANCHOR = 400, 100
REACH = WINDOW - ANCHOR
CROWD = 10_000
STRETCH = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, STRETCH + WINDOW)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), STRETCH + WINDOW)


def _last_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of the last smallest value of each stretch of ``width`` values, each once."""
    n = len(h)
    pad = -n % width
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    blocks = np.concatenate([h, np.full(pad, top)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)[:n]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    least = np.minimum(behind[: n - width + 1], before[width - 1 :])
    # a position is picked if it is the smallest of a window that ends before the next equal value
    change = np.flatnonzero(np.diff(least)) + 1
    start, end = np.r_[0, change], np.r_[change, len(least)]
    picked = []
    for v, a, b in zip(least[start], start.tolist(), end.tolist()):
        at = a + np.flatnonzero(h[a : b + width - 1] == v)
        nxt = np.r_[at[1:], b + width - 1 + width]
        # windows w with w <= at, at < w + width <= nxt, and a <= w < b
        picked.append(at[np.maximum(a, at - width + 1) <= np.minimum.reduce([at, nxt - width, np.full(len(at), b - 1)])])
    return np.unique(np.concatenate(picked))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    positions, hashes = [], []
    for at in range(0, len(raw) - WINDOW + 1, STRETCH):
        part = raw[at : at + STRETCH + WINDOW - 1]
        n = len(part)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * _UP[:n], out=total[1:])
        h = mix((total[ANCHOR:] - total[: n - ANCHOR + 1]) * _DOWN[: n - ANCHOR + 1])
        picked = _last_minimum(h, REACH + 1)
        positions.append(picked + at)
        hashes.append(h[picked])
    if len(positions) == 1:
        return positions[0], hashes[0]
    positions, hashes = np.concatenate(positions), np.concatenate(hashes)
    positions, first = np.unique(positions, return_index=True)
    return positions, hashes[first]


def context(text: bytes, at: int) -> tuple[int, int]:
    """Where the context of an anchor starts and ends."""
    return max(0, at - REACH), min(len(text), at + WINDOW)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, the text and two hashes of it that stand for the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})


def anchored(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, k1, k2, n_bytes, and the anchors of the text: at, hash, context hash."""

    def make():
        def step(batch):
            ats, hashes, contexts, sizes = [], [], [], []
            for text in text_bytes(batch):
                at, h = anchors(text)
                ats.append(at)
                hashes.append(h.view(np.int64))
                ends = [context(text, a) for a in at.tolist()]
                contexts.append(np.array(
                    [xxhash.xxh3_64_intdigest(text[lo:hi], a - lo) for a, (lo, hi) in zip(at.tolist(), ends)], np.uint64
                ).view(np.int64))
                sizes.append(len(text))
            keys = [batch.column(c) for c in ("doc_id", "k1", "k2")]
            lists = [ragged(ats, pa.int64()), ragged(hashes, pa.int64()), ragged(contexts, pa.int64())]
            names = ["doc_id", "k1", "k2", "n_bytes", "at", "hash", "context"]
            return pa.RecordBatch.from_arrays([*keys, pa.array(sizes, pa.int64()), *lists], names)

        return step

    schema = "doc_id long, k1 long, k2 long, n_bytes long, at array<long>, hash array<long>, context array<long>"
    return map_batches(keyed(docs), make, schema)


def with_contexts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``wanted`` (hash, k1, k2, at, alone) with the bytes before (reversed) and after each anchor."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("hash", "at", "alone")).alias("anchors"))
    rows = texts.join(lists, ["k1", "k2"])

    def make():
        def step(batch):
            out = {n: [] for n in ("hash", "k1", "k2", "at", "alone", "before", "after")}
            columns = [batch.column(c).to_pylist() for c in ("k1", "k2", "anchors")]
            for text, k1, k2, held in zip(text_bytes(batch), *columns):
                for a in held:
                    at = a["at"]
                    lo, hi = context(text, at)
                    for name, v in zip(out, (a["hash"], k1, k2, at, a["alone"], text[lo:at][::-1], text[at:hi])):
                        out[name].append(v)
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

        return step

    schema = "hash long, k1 long, k2 long, at long, alone boolean, before binary, after binary"
    return map_batches(rows.select("k1", "k2", "text", "anchors"), make, schema)


def repeat_groups(contexts: DataFrame) -> DataFrame:
    """What the maximal repeats of the anchors cover: k1, k2, start, end, alone, one row per occurrence.

    All repeats of an occurrence hold its anchor, so together they are one stretch of bytes.
    """
    names = ["k1", "k2", "start", "end", "alone"]

    def solve(group: list[tuple]) -> list[tuple]:
        covered: dict[int, tuple[int, int]] = {}
        if len(group) > 1:
            for depth, found in maximal_repeats([g[5] for g in group], [g[6] for g in group], WINDOW):
                for i, left in found:
                    most, deepest = covered.get(i, (0, 0))
                    covered[i] = max(most, left), max(deepest, depth)
        out = []
        for i, (left, depth) in covered.items():
            _, k1, k2, at, alone = group[i][:5]
            out.append((k1, k2, at - left, at + depth, alone))
        return out

    def run(batches):
        group: list[tuple] = []
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    rows += solve(group)
                    group = []
                group.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)
                rows = []
        rows += solve(group)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    sorted_ = contexts.repartition("hash").sortWithinPartitions("hash")
    return sorted_.mapInArrow(run, "k1 long, k2 long, start long, end long, alone boolean")


def crowded_repeats(contexts: DataFrame) -> DataFrame:
    """(k1, k2, start, end) that repeated windows of each anchor cover, for anchors with too many contexts for one task."""

    def make():
        def step(batch):
            hashes, k1s, k2s, ats, starts, windows = [], [], [], [], [], []
            for h, k1, k2, at, _, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                text = before[::-1] + after
                for i in range(len(text) - WINDOW + 1):
                    hashes.append(h)
                    k1s.append(k1)
                    k2s.append(k2)
                    ats.append(at)
                    starts.append(at - len(before) + i)
                    windows.append(xxhash.xxh3_64_intdigest(text[i : i + WINDOW], len(before) - i))
            columns = [hashes, k1s, k2s, ats, starts, np.array(windows, np.uint64).view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["hash", "k1", "k2", "at", "start", "window"])

        return step

    rows = map_batches(contexts, make, "hash long, k1 long, k2 long, at long, start long, window long")
    again = rows.groupBy("hash", "window").count().where("count > 1").drop("count")
    found = rows.join(again, ["hash", "window"]).groupBy("k1", "k2", "at")
    return found.agg(F.min("start").alias("start"), (F.max("start") + WINDOW).alias("end")).drop("at")


def cut(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Per text with spans: k1, k2, the number of removed stretches (spans merged), and the bytes kept."""
    lists = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def make():
        def step(batch):
            counts, left = [], []
            for text, spans in zip(text_bytes(batch), batch.column("spans").to_pylist()):
                kept, done, n = [], 0, 0
                end = -1
                for a, b in sorted((s["start"], s["end"]) for s in spans):
                    if a > end:
                        n += 1
                        kept.append(text[max(done, 0) : a])
                    end = done = max(end, b)
                counts.append(n)
                left.append(b"".join([*kept, text[done:]]))
            arrays = [batch.column("k1"), batch.column("k2"), pa.array(counts, pa.int64()), pa.array(left, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "n_spans", "kept"])

        return step

    rows = texts.join(lists, ["k1", "k2"])
    return map_batches(rows.select("k1", "k2", "text", "spans"), make, "k1 long, k2 long, n_spans long, kept binary")


def what_is_left(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_spans and the bytes kept. ``changed`` has k1, k2, n_spans, kept, once
    for every text that loses bytes; all other texts stay where they are, but for those the filter is mistaken about.
    """
    key = ["k1", "k2"]
    rows = probably_in(keyed(docs), changed, key).withColumn("n_bytes", F.octet_length("text").cast("long"))
    found = written(rows.where("likely").select("doc_id", "n_bytes", *key).join(changed, key, "left"))
    mistaken = written(found.where("kept is null").select(*key).distinct())
    again = probably_in(rows.where("likely").drop("likely"), mistaken, key).where("likely")
    whole = rows.where("not likely").unionByName(again.join(mistaken, key, "left_semi"))
    columns = ["doc_id", "n_bytes", "n_spans", "kept"]
    whole = whole.withColumns({"n_spans": F.lit(0).cast("long"), "kept": F.col("text").cast("binary")})
    return whole.select(*columns).unionByName(found.where("kept is not null").select(*columns))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``text``, what is left of it.

    The digest is of the bytes kept; in ``text`` a character that lost some of its bytes reads U+FFFD.
    """
    rows = written(anchored(docs))
    first = F.struct(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("none"))
    texts = rows.groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.min(first).alias("first"), *(F.first(c).alias(c) for c in ("n_bytes", "at", "hash", "context"))
    )
    zipped = F.inline(F.arrays_zip("hash", "at", "context"))
    all_anchors = written(texts.where(f"n_bytes >= {WINDOW}").select("k1", "k2", "first", "copies", zipped))
    # written sides leave plain exchanges under the joins, which the engine can split at a hot anchor
    often = written(all_anchors.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    found = written(all_anchors.join(often, "hash"))

    classes = found.groupBy("hash", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at", "first", "copies")).alias("one")
    )
    classes = written(classes)
    whole = found.where("copies = 1").join(classes.where("n > 1").select("hash", "context"), ["hash", "context"])
    sizes = rows.select("k1", "k2", "n_bytes").distinct()
    whole = whole.join(sizes, ["k1", "k2"]).select(
        "k1", "k2", F.greatest(F.lit(0).cast("long"), F.col("at") - REACH).alias("start"),
        F.least(F.col("n_bytes"), F.col("at") + WINDOW).alias("end"),
    )
    whole = written(whole)

    # a class with more members only helps to find the repeats of those that stand alone
    alone = (F.col("n") == 1) & (F.col("one.copies") == 1)
    groups = classes.groupBy("hash").agg(F.count("*").alias("contexts"), F.sum(alone.cast("long")).alias("n_alone"))
    groups = written(groups.where("contexts > 1 and n_alone > 0"))
    wanted = classes.join(groups, "hash").select("hash", "contexts", "one.*", alone.alias("alone"))
    wanted = written(wanted)

    changed = wanted.select("k1", "k2", "first").unionByName(
        whole.select("k1", "k2").distinct().join(found.select("k1", "k2", "first").distinct(), ["k1", "k2"])
    )
    changed = changed.select("k1", "k2", F.col("first.id").alias("id"), F.col("first.none").alias("none")).distinct()
    named = keyed(docs).withColumns({"id": F.coalesce("doc_id", F.lit(0).cast("long")), "none": F.col("doc_id").isNull()})
    held = named.drop("doc_id").join(changed, ["k1", "k2", "id", "none"]).select("k1", "k2", "text")
    held = written(held.dropDuplicates(["k1", "k2"]))

    contexts = written(with_contexts(wanted.where(f"contexts <= {CROWD}"), held))
    groups = repeat_groups(contexts).where("alone").select("k1", "k2", "start", "end")
    crowded = crowded_repeats(written(with_contexts(wanted.where(f"contexts > {CROWD}"), held)))
    # equal texts lose all they have
    copied = texts.where(f"copies > 1 and n_bytes >= {WINDOW}").select("k1", "k2")
    spans = whole.unionByName(groups).unionByName(crowded.join(copied, ["k1", "k2"], "left_anti"))
    nothing = copied.select("k1", "k2", F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    left = what_is_left(docs, written(cut(held, spans).unionByName(nothing)))
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
