"""A Merkle manifest of documents, whose leaves are placed by bitmap rank instead of a sort.

Per language, partial bitmaps of ``doc_id`` are merged with OR; only 64-id words that hold a document
are kept, which is the compression. A popcount directory over 32,768 ids at a time, and running counts
of words inside it, make the rank of an id a lookup and one popcount: its leaf's coordinate. Leaves
then go to slot arrays of SLOTS places, keyed by coordinate; each array is one subtree, reduced in
memory, and its node is a leaf of the next array up, until one node a language is left. The languages'
nodes are reduced the same way. Proofs come back down: an array hands its way to the root to each of
its slots.

No task holds more than SLOTS nodes of a tree, whatever the share of one language.

Defined cases: rows without ``doc_id`` come first in their language, in the order of their leaves, as
do the rows of a repeated id; equal rows are alike and take consecutive places. A null language is a
group of its own, the first one. Null columns are leaves' ``-``. No documents, no rows. Texts of any
length are hashed where they are read and never shuffled. Other columns are ignored, whatever their
names. One leaf alone is its own subroot, one language's subroot its own root.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from slipstream.llm.common import written
from slipstream.operators.rank import running_totals
from slipstream.operators.skew import lookup

SLOT_BITS = 11
SLOTS = 1 << SLOT_BITS
WORD_BITS, CONTAINER_BITS = 6, 15
TAMPER_EVERY = 7
COPIES_AT_ONCE = 4096
HASHED = ["doc_id", "source", "lang", "n_chars", "text"]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(**instead: Column) -> Column:
    """The lowercase hex digest of one row's five values."""
    return F.sha2(F.concat(*[_field(instead.get(c, F.col(c))) for c in HASHED]), 256)


def is_tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and the leaf that tampering makes of it (null where there is none)."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *HASHED[1:])
    return rows.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), _leaf().alias("leaf"),
        F.when(is_tampered(), _leaf(n_chars=more)).alias("tampered"),
    )


def bitmaps(rows: DataFrame) -> DataFrame:
    """The merged bitmaps, a 64-id ``word`` a row, with the directory's counts.

    ``mask`` holds the ids; ``rows`` all rows of the word, ``before`` those of the language's smaller
    words, ``n`` those of the language. ``grp`` is the language's place. Rows without an id are a word
    without a number, ahead of all others.
    """
    word = F.shiftright("doc_id", WORD_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("doc_id").bitwiseAND(63).cast("int"))
    words = written(
        rows.groupBy("lang", word.alias("word")).agg(
            F.coalesce(F.bit_or(bit), F.lit(0)).cast("long").alias("mask"), F.count("*").alias("rows")
        )
    )
    container = F.coalesce(F.shiftright("word", CONTAINER_BITS - WORD_BITS), F.lit(-(2**63)))
    words = words.withColumn("container", container)
    # one row a container: its popcount and, by running totals, that of all before it
    directory = words.groupBy("lang", "container").agg(F.sum("rows").alias("size"))
    directory = written(running_totals(directory, "container", ["lang"], {"before": F.col("size")}))
    groups = directory.groupBy("lang").agg(F.sum("size").alias("n"))
    named = groups.withColumn("name", F.coalesce(F.concat(F.lit("x"), "lang"), F.lit("")))  # null sorts first
    groups = running_totals(named, "name", [], {"grp": F.lit(1).cast("long")}).drop("name")
    of_container = directory.join(
        groups.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))
    ).select(F.col("lang").alias("l"), F.col("container").alias("c"), F.col("before").alias("ahead"), "n", "grp")
    joined = words.join(of_container, F.col("lang").eqNullSafe(F.col("l")) & (F.col("container") == F.col("c")))
    # running counts inside a container run over 512 words at most
    earlier = Window.partitionBy("grp", "container").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    return joined.select("lang", "word", "mask", "rows", (F.col("ahead") + inside).alias("before"), "n", "grp")


def coordinates(rows: DataFrame) -> DataFrame:
    """``grp``, ``n``, ``at`` (the coordinate), ``doc_id``, ``leaf``, ``tampered`` of every leaf."""
    keyed = rows.withColumn("word", F.shiftright("doc_id", WORD_BITS))
    index = written(bitmaps(rows).withColumn("index", F.struct("mask", "rows", "before", "n", "grp")))
    index = index.select("lang", "word", "index", F.col("rows").alias("weight"))
    placed = written(lookup(keyed, index, ["lang", "word"], "weight", F.xxhash64("leaf"), written=True))
    one_each = F.col("word").isNotNull() & (F.bit_count("index.mask") == F.col("index.rows"))
    from_here = F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("doc_id").bitwiseAND(63).cast("int"))
    rank = F.col("index.before") + F.bit_count(F.col("index.mask").bitwiseAND(F.bitwise_not(from_here)))
    columns = ["doc_id", "leaf", "tampered"]
    plain = placed.where(one_each).select("index.grp", "index.n", rank.alias("at"), *columns)
    return plain.unionByName(_repeated(placed.where(~one_each)))


def _repeated(rows: DataFrame) -> DataFrame:
    """Places in words where an id has several rows: by id, then leaf; equal rows are counted, not sorted.

    A range partitioning deals the leaves of one id over tasks, so an id may hold any share of the rows.
    """
    rows = rows.select("index.grp", "index.n", "index.before", "word", "doc_id", "leaf", "tampered")
    key = F.concat_ws("|", F.lpad(F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0)).cast("string"), 2, "0"), "leaf")
    alike = rows.withColumn("key", key).groupBy(*rows.columns, "key").agg(F.count("*").alias("copies"))
    first = running_totals(alike, "key", ["grp", "word"], {"ahead": F.col("copies")})
    step = F.lit(COPIES_AT_ONCE).cast("long")
    dealt = first.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step)))
    dealt = dealt.repartition("grp", "key", "start")
    end = F.least(F.col("start") + step, "copies") - 1
    single = dealt.withColumn("copy", F.explode(F.sequence("start", end)))
    return single.select(
        "grp", "n", (F.col("before") + F.col("ahead") + F.col("copy")).alias("at"), "doc_id", "leaf", "tampered"
    )


def _levels(n: int) -> int:
    """Levels that one slot array reduces: all of a small tree, SLOT_BITS of a larger one."""
    return min(SLOT_BITS, max(0, (n - 1).bit_length()))


def reduce_slots(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """All levels of a subtree from its leaves up."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        pairs = [last[i] + last[i + 1] for i in range(0, len(last) - 1, 2)]
        if len(last) % 2:
            pairs.append(last[-1])
        out.append([sha256(x).hexdigest().encode() for x in pairs])
    return out


def _in_slots(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Where each row goes in its slot array, and the array."""
    at = table.column("at").to_numpy() & (SLOTS - 1)
    given = table.column("hash").cast(pa.binary()).to_pylist()
    slots: list[bytes] = [b""] * len(given)
    for i, h in zip(at.tolist(), given):
        slots[i] = h
    return at, slots


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("at", SLOT_BITS))


def _up(nodes: DataFrame) -> DataFrame:
    """(grp, n, at, hash) one slot array up: ``n`` nodes become ceil(n / SLOTS)."""

    def fold(table: pa.Table) -> pa.Table:
        _, slots = _in_slots(table)
        n = table.column("n")[0].as_py()
        top = reduce_slots(slots, _levels(n))[-1]
        made = {"grp": [table.column("grp")[0].as_py()], "n": [-(-n // SLOTS)], "at": [table.column("block")[0].as_py()]}
        return pa.table({**made, "hash": [top[0].decode()]}, schema=pa_schema)

    pa_schema = pa.schema([("grp", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("hash", pa.string())])
    return _blocks(nodes).groupBy("grp", "block").applyInArrow(fold, "grp long, n long, at long, hash string")


def _ways(table: pa.Table, above: list[tuple[int, bytes]]) -> list[list[tuple[int, bytes]]]:
    """Per row of a slot array its (side, sibling) list from its level to the root."""
    at, slots = _in_slots(table)
    levels = reduce_slots(slots, _levels(table.column("n")[0].as_py()))
    out = []
    for i in at.tolist():
        way = []
        for level in levels[:-1]:
            if (j := i ^ 1) < len(level):
                way.append((i & 1, level[j]))
            else:
                way.append((2, b""))  # alone in its run
            i >>= 1
        out.append(way + above)
    return out


def _unpack(way: str) -> list[tuple[int, bytes]]:
    return [(int(x[0]), x[1:].encode()) for x in way.split(",")] if way else []


def _pack(way: list[tuple[int, bytes]]) -> str:
    return ",".join(str(side) + h.decode() for side, h in way)


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, at, way) of the nodes of one level, from the ways of the slot arrays they are in."""

    def spread(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ways = _ways(left, _unpack(right.column("way")[0].as_py()))
        return pa.table({"grp": left.column("grp"), "at": left.column("at"), "way": pa.array(map(_pack, ways), pa.string())})

    keyed = above.select(F.col("grp"), F.col("at").alias("block"), "way")
    pair = _blocks(nodes).groupBy("grp", "block").cogroup(keyed.groupBy("grp", "block"))
    return pair.applyInArrow(spread, "grp long, at long, way string")


def _tree(nodes: DataFrame) -> list[DataFrame]:
    """Written levels of slot arrays over (grp, n, at, hash), the last with one node a group."""
    levels = [nodes]
    while True:
        top = written(_up(levels[-1]))
        levels.append(top)
        if top.where("n > 1").isEmpty():
            return levels


def fold_way(leaf: bytes, way: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, h in way:
        leaf = sha256(h + leaf if side == 1 else leaf + h).hexdigest().encode()
    return leaf


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    placed = written(coordinates(written(leaves(docs))))
    trees = _tree(placed.select("grp", "n", "at", F.col("leaf").alias("hash")))
    subroots = trees[-1]
    # the languages' nodes are the leaves of one more tree; its group is 0
    groups = F.lit(subroots.count())
    top = subroots.select(F.lit(0).cast("long").alias("grp"), groups.alias("n"), F.col("grp").alias("at"), "hash")
    top_trees = _tree(written(top))
    root = top_trees[-1].first()
    ways = top_trees[-1].select("grp", "at", F.lit("").alias("way"))
    for nodes in reversed(top_trees[:-1]):
        ways = written(_down(nodes, ways))
    # ways of subroots are those of the languages' last arrays
    ways = ways.select(F.col("at").alias("grp"), F.lit(0).cast("long").alias("at"), "way")
    for nodes in reversed(trees[1:-1]):
        ways = written(_down(nodes, ways))
    ways = ways.join(subroots.select("grp", F.col("hash").alias("subroot")), "grp")
    return _proofs(placed, ways, root.hash if root else "")


def _proofs(placed: DataFrame, ways: DataFrame, root: str) -> DataFrame:
    def prove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = _ways(left, _unpack(right.column("way")[0].as_py()))
        own = left.column("hash").cast(pa.binary()).to_pylist()
        other = left.column("tampered").cast(pa.binary()).to_pylist()
        subroot = right.column("subroot")[0].as_py()
        folded = [fold_way(b or a, way).decode() for a, b, way in zip(own, other, found)]
        n = len(own)
        return pa.table(
            {
                "doc_id": left.column("doc_id"), "leaf": left.column("hash"),
                "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                "proof_sha256": pa.array([sha256(b"".join(h for _, h in way)).hexdigest() for way in found], pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([f == root for f in folded], pa.bool_()),
            }
        )

    nodes = _blocks(placed.withColumnRenamed("leaf", "hash"))
    keyed = ways.withColumnRenamed("at", "block")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return nodes.groupBy("grp", "block").cogroup(keyed.groupBy("grp", "block")).applyInArrow(prove, schema)
