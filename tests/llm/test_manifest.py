"""The manifest against a plain Merkle tree."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

from doc_rows import make_docs
from pyspark.sql import functions as F

from slipstream.llm import manifest


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0) -> str:
    n = None if row.n_chars is None else row.n_chars + more
    values = (None if v is None else str(v) for v in (row.doc_id, row.source, row.lang, n, row.text))
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way_of(levels, i):
    for level in levels[:-1]:
        yield i & 1, level[i ^ 1] if i ^ 1 < len(level) else None
        i >>= 1


def plain(rows) -> Counter:
    """The contract read literally, every group sorted in memory."""
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees, ordered = {}, {}
    for lang in langs:
        rows = sorted(groups[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
        ordered[lang], trees[lang] = rows, levels_of([leaf_of(r) for r in rows])
    top = levels_of([trees[x][-1][0] for x in langs])
    out = Counter()
    for g, lang in enumerate(langs):
        for i, r in enumerate(ordered[lang]):
            way = [*way_of(trees[lang], i), *way_of(top, g)]
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            folded = leaf_of(r, int(tampered))
            for side, other in way:
                folded = h(folded) if other is None else h(other, folded) if side else h(folded, other)
            root = top[-1][0]
            proof = h(*(o for _, o in way if o is not None))
            out[(r.doc_id, leaf_of(r), trees[lang][-1][0], root, proof, folded, folded == root)] += 1
    return out


def check(docs):
    got = Counter(map(tuple, manifest.merkle_manifest(docs).collect()))
    assert got == plain(docs.select("doc_id", "source", "lang", "n_chars", "text").collect())
    return got


def test_awkward_rows(odd_docs):
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit("ü")).when(F.col("doc_id") % 3 == 1, F.lit("")))
    docs = docs.withColumns({c: F.lit(1) for c in ("leaf", "grp", "word", "hash", "way", "tampered")})
    check(docs)
    check(docs.withColumn("n_chars", F.lit(None).cast("long")))
    check(docs.withColumn("n_chars", F.lit(2**63 - 1)))


def test_several_slot_arrays_and_sparse_ids(spark):
    rows = [(i * 37 - 20_000 if i % 2 else (i << 40) - 5, f"text {i}") for i in range(2 * manifest.SLOTS + 3)]
    docs = make_docs(spark, rows).withColumn("lang", F.when(F.col("text").endswith("7"), "de").otherwise("en")).repartition(7)
    got = check(docs)
    assert {key[6] for key in got} == {True, False}


def test_exactly_one_full_array(spark):
    check(make_docs(spark, [(i, "x") for i in range(manifest.SLOTS)]))


def test_one_id_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(manifest, "COPIES_AT_ONCE", 50)
    rows = [(63, "same")] * 700 + [(63, f"other {i}") for i in range(500)] + [(None, "none")] * 300 + [(i, "x") for i in range(100)]
    check(make_docs(spark, rows).repartition(5))


def test_one_row_and_none(spark, no_docs):
    got = check(make_docs(spark, [(7, "alone")]))
    (key,) = got
    assert key[1] == key[2] == key[3] and key[4] == h()
    assert manifest.merkle_manifest(no_docs).count() == 0
