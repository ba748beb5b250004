"""Near-duplicate groups by SuperMinHash signatures.

A document's set holds its distinct shingles of ``words`` words, two unless said otherwise (A-Z
lower-cased, words split at ASCII white space; a text of fewer words is one shingle). SuperMinHash ranks the signature slots by one permutation per element, so that the m slots
of a signature draw on nearly disjoint ranks: the variance is lower than that of m separate hashes.
The permutations are dealt step by step for all elements at once, and a document stops at the first
step after which all its slots are filled, as later ranks cannot win any more.

Steps: signatures -> exact classes -> bands -> a pivot per band bucket -> exact Jaccard of each
member with its pivot -> union-find. Members that are not grouped with their pivot are then compared, in
blocks, with all members that share the pivot, so no link is lost and no bucket is expanded into
pairs of rows.

Defined cases: null or empty text has an empty set, which links with nothing; a row without a doc_id
stands alone with a null component and is kept; rows that repeat a doc_id are judged by their texts,
each on its own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from slipstream.llm.common import GOLDEN, WordHashes, doc_bytes, map_batches, mix, probably_in, ragged, text_hash, written
from slipstream.llm.components import connected

SLOTS, BAND_ROWS = 252, 6
"""42 bands of 6: a pair at Jaccard 0.8 is missed with probability 3e-6."""
LINK_PER_CENT = 80
BLOCK_MEMBERS = 400
CHUNK_ELEMENTS = 60_000

_RANK_BITS = np.uint32(24)
_EMPTY = np.uint32(0xFFFFFFFF)


def shingles(text: bytes, hashes: WordHashes, words: int = 2) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of so many words; a shorter text is one shingle."""
    h = hashes.of(text.lower().split())
    if len(h) == 0:
        return h
    k = min(words, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = mix(s * GOLDEN + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def super_minhash(sets: list[np.ndarray], m: int = SLOTS) -> np.ndarray:
    """Signatures of non-empty sets, one row each; slot value = step * 2^24 + 24 bits of rank."""
    if m > 256:
        raise ValueError("at most 256 slots: the step has eight bits")
    sizes = np.array([len(s) for s in sets])
    best = np.full((len(sets), m), _EMPTY, np.uint32)
    flat = best.reshape(-1)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for step in range(m):
        draw = mix(element + np.uint64((step + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        at = step + (((draw >> np.uint64(32)) * np.uint64(m - step)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = at
        else:
            row = np.arange(len(at))
            slot = order[row, at].astype(np.int64)
            order[row, at] = order[:, step]
        rank = (draw & np.uint64(0xFFFFFF)).astype(np.uint32) | np.uint32(step) << _RANK_BITS
        np.minimum.at(flat, owner * m + slot, rank)
        open_docs = (best == _EMPTY).any(axis=1)
        keep = open_docs[owner]
        if not keep.any():
            break
        if order is None:
            at = at[keep]
            order = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(at), m)).copy()
            order[np.arange(len(at)), at] = 0
        elif not keep.all():
            order = order[keep]
        element, owner = element[keep], owner[keep]
    return best


def band_keys(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots."""
    n, m = signatures.shape
    bands = signatures.reshape(n, m // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) * GOLDEN, (n, m // rows))
    for i in range(rows):
        key = mix(key * GOLDEN + bands[:, :, i])
    return key.astype(np.int64)


def fingerprint(s: np.ndarray) -> bytes:
    """16 bytes that stand for the whole set."""
    total = np.array([mix(s).sum(dtype=np.uint64), mix(s * GOLDEN + np.uint64(len(s))).sum(dtype=np.uint64)])
    return total.tobytes()


def signatures(docs: DataFrame, words: int = 2) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``fp`` (null for an empty set) and ``bands`` per row of ``docs``."""

    def make():
        hashes = WordHashes()

        def step(batch):
            sets = [shingles(t, hashes, words) for t in batch.column("text").to_pylist()]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            keys = [np.empty(0, np.int64)] * len(sets)
            chunk, held = [], 0
            for i, s in enumerate([*sets, None]):
                if s is None or held + len(s) > CHUNK_ELEMENTS and chunk:
                    if chunk:
                        for j, k in zip(chunk, band_keys(super_minhash([sets[j] for j in chunk]))):
                            keys[j] = k
                    chunk, held = [], 0
                if s is not None and len(s):
                    chunk.append(i)
                    held += len(s)
            fps = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n), fps, ragged(keys, pa.int64())],
                ["doc_id", "text_hash", "n_shingles", "fp", "bands"],
            )

        return step

    schema = "doc_id long, text_hash long, n_shingles long, fp binary, bands array<long>"
    return map_batches(doc_bytes(docs), make, schema)


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """(pivot, fp): the classes that share a band bucket with a pivot, the pivot included.

    A bucket's pivot is the class with the most bucket mates over all its bands: the centre of a
    group of copies rather than an edge of it. Both members of any bucket have its pivot.
    """
    rows = classes.select("fp", F.explode("bands").alias("band"))
    # written sides leave plain exchanges under the joins, which the engine can split at a hot band
    crowded = written(rows.groupBy("band").agg(F.count("*").alias("mates")).where("mates > 1"))
    rows = written(rows.join(crowded, "band"))
    score = rows.groupBy("fp").agg(F.sum("mates").alias("score"))
    pivots = rows.join(score, "fp").groupBy("band").agg(F.max_by("fp", F.struct("score", "fp")).alias("pivot"))
    return rows.join(written(pivots), "band").select("pivot", "fp").distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = 2) -> DataFrame:
    """(fp, words48): the sets of the classes in ``wanted`` (``doc_id``, ``text_hash``, ``fp``), hashes cut to 48 bits.

    A text tells its own fp, so texts are not shuffled to be given one; only sets are, once, by it.
    """
    rows = probably_in(doc_bytes(docs), wanted, ["doc_id", "text_hash"]).where("likely").drop("likely")

    def make():
        hashes = WordHashes()

        def step(batch):
            sets = [s for t in batch.column("text").to_pylist() if len(s := shingles(t, hashes, words))]
            return pa.RecordBatch.from_arrays(
                [pa.array(map(fingerprint, sets), pa.binary()), pa.array(map(pack48, sets), pa.binary())], ["fp", "words48"]
            )

        return step

    sets = map_batches(rows, make, "fp binary, words48 binary")
    return sets.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def pack48(s: np.ndarray) -> bytes:
    return np.sort(s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def pivot_overlap(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, fp, linked, apart): whether each member links with its pivot, and the Jaccard distance."""
    pairs = clusters.where("pivot <> fp").join(sets, "fp")
    pairs = pairs.join(sets.select(F.col("fp").alias("pivot"), F.col("words48").alias("pivot48")), "pivot")

    def make():
        last = [None, None]

        def step(batch):
            linked, apart = [], []
            for mine, theirs in zip(batch.column("words48").to_pylist(), batch.column("pivot48").to_pylist()):
                if last[0] != theirs:
                    last[:] = theirs, unpack48(theirs)
                a, b = unpack48(mine), last[1]
                both = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - both
                linked.append(100 * both >= LINK_PER_CENT * union)
                apart.append(1 - both / union)
            return pa.RecordBatch.from_arrays(
                [batch.column("pivot"), batch.column("fp"), pa.array(linked), pa.array(apart)],
                ["pivot", "fp", "linked", "apart"],
            )

        return step

    return map_batches(
        pairs.select("pivot", "fp", "words48", "pivot48"), make, "pivot binary, fp binary, linked boolean, apart double"
    )


def residual_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of members left outside their pivot's group with members of other groups.

    ``members``: pivot, fp, apart, group, outside. Blocks of outsiders meet blocks of all members;
    a task holds one block of each, and a block pair yields at most one link per (outsider, group).
    Distances to the pivot differ by at most the distance of two members, which rules most pairs out.
    """
    sized = members.groupBy("pivot").agg(F.count("*").alias("n"), F.sum(F.col("outside").cast("long")).alias("n_out"))
    sized = written(sized.where("n_out > 0 and n > 2"))
    n_blocks = lambda c: F.ceil(F.col(c) / BLOCK_MEMBERS).cast("long")
    rows = members.join(sized, "pivot")
    spread = F.xxhash64("fp")
    rows = rows.withColumn("block", F.pmod(spread, n_blocks("n"))).withColumn("out_block", F.pmod(spread, n_blocks("n_out")))
    as_member = rows.select(
        "pivot", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks("n_out") - 1)).alias("i"),
        F.col("block").alias("j"), "fp", "apart", "group", F.lit(False).alias("asks"),
    )
    as_outsider = rows.where("outside").select(
        "pivot", F.col("out_block").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), n_blocks("n") - 1)).alias("j"),
        "fp", "apart", "group", F.lit(True).alias("asks"),
    )
    blocks = as_member.unionByName(as_outsider).join(sets, "fp")

    def compare(block: pa.Table) -> pa.Table:
        rows = block.to_pylist()
        asking, held = [r for r in rows if r["asks"]], [r for r in rows if not r["asks"]]
        found = []
        if asking and held:
            parts = [unpack48(r["words48"]) for r in held]
            sizes = np.array([len(p) for p in parts])
            words = np.concatenate(parts)
            who = np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(words, kind="stable")
            words, who = words[order], who[order]
            apart = np.array([r["apart"] for r in held])
            for r in asking:
                s = unpack48(r["words48"])
                lo, hi = np.searchsorted(words, s, "left"), np.searchsorted(words, s, "right")
                n = hi - lo
                at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
                both = np.bincount(who[at], minlength=len(held))
                close = 100 * both >= LINK_PER_CENT * (sizes + len(s) - both)
                close &= np.abs(apart - r["apart"]) <= 1 - LINK_PER_CENT / 100 + 1e-9
                groups = {}
                for k in np.flatnonzero(close):
                    if held[k]["group"] != r["group"]:
                        groups.setdefault(held[k]["group"], held[k]["fp"])
                found += [(r["fp"], fp) for fp in groups.values()]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return blocks.groupBy("pivot", "i", "j").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash. See the module's text."""
    signed = written(signatures(docs, words))
    classes = written(
        signed.where("fp is not null and doc_id is not null")
        .groupBy("fp")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("bands").alias("bands"), F.count("*").alias("n"))
        .select("fp", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("text_hash"), "bands", "n")
    )
    clusters = written(candidate_clusters(classes))
    wanted = clusters.select("fp").distinct().join(classes, "fp")
    wanted = written(wanted.select(F.col("first_id").alias("doc_id"), "text_hash", "fp"))
    sets = written(shingle_sets(docs, wanted, words))

    stars = written(pivot_overlap(clusters, sets))
    links = stars.where("linked").select(F.col("pivot").alias("a"), F.col("fp").alias("b"))
    groups = written(connected(links))

    def group_of(df: DataFrame, name: str, out: str) -> DataFrame:
        found = groups.select(F.col("node").alias(name), F.col("root").alias(out))
        return df.join(found, name, "left").withColumn(out, F.coalesce(out, name))

    hubs = clusters.where("pivot = fp").select("pivot", "fp", F.lit(False).alias("linked"), F.lit(0.0).alias("apart"))
    members = group_of(group_of(stars.unionByName(hubs), "fp", "group"), "pivot", "hub_group")
    members = members.withColumn("outside", F.col("group") != F.col("hub_group"))
    members = written(members.select("pivot", "fp", "apart", "group", "outside"))
    more = written(residual_links(members, sets))
    final = connected(links.unionByName(more)) if more.take(1) else groups

    # only classes with links or copies need a name; written sides let the engine split a large component or class
    first = classes.select("fp", "first_id", "n")
    linked = written(first.join(final.select(F.col("node").alias("fp"), "root"), "fp"))
    smallest = written(linked.groupBy("root").agg(F.min("first_id").alias("component_id")))
    alone = first.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"))
    component = written(linked.join(smallest, "root").select("fp", "component_id").unionByName(alone))
    out = signed.select("doc_id", "text_hash", "n_shingles", "fp").join(component, "fp", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component_id.alias("component_id"),
        F.coalesce(component_id == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash",
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row per group of near duplicates, the one with the smallest doc_id.

    Rows that repeat both the doc_id and the text are one row after this. Rows without a doc_id stay. Columns may have
    any names. Only rows that may be dropped or repeat are shuffled with their texts.
    """
    key = ["id", "hash"]
    judged = near_duplicates(docs, words).where("doc_id is not null")
    judged = judged.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    judged = judged.agg(F.first("kept").alias("kept"), F.count("*").alias("copies"))
    special = written(judged.where("not kept or copies > 1"))
    # the columns of docs travel as one, so that none can clash with those used here
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"))
    rows = probably_in(rows, special, key)
    asked = rows.where("likely").join(special, key, "left").where("kept is null or kept")
    first = Window.partitionBy(*key).orderBy("id")
    copied = asked.where("copies > 1").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    out = rows.where("not likely").select("row").unionByName(asked.where("copies is null or copies = 1").select("row"))
    return out.unionByName(copied.select("row")).select("row.*")
