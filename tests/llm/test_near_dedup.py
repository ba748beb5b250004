import re

import numpy as np
import pytest

from pyspark.sql import functions as F

import brute
from slipstream.llm import common, near_dedup
from slipstream.llm.components import connected
from slipstream.llm.near_dedup import near_duplicates, super_minhash


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_groups_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute.near_groups(rows)
    assert result(near_duplicates(documents)) == sorted(((i, n, c, i == c) for i, (n, c) in want.items()), key=str)


@pytest.mark.parametrize("words", [2, 5])
def test_a_chain_of_copies_is_one_group_and_edges_of_a_group_are_found(docs_of, words):
    """Copies drift from each other, so most are linked with some of the others but not with one pivot."""
    g = np.random.default_rng(5)
    base = [f"u{k}" for k in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in g.choice(120, int(g.integers(0, 22)), replace=False):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    for i in range(150, 170):
        base[(i - 150) * 5 % 120] = f"z{i}"
        rows.append((i, " ".join(base)))
    want = brute.near_groups(rows, words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(rows), words).collect()}
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_awkward_rows(odd_docs, no_docs):
    got = result(near_duplicates(odd_docs))
    assert len(got) == odd_docs.count()
    by_id = {}
    for i, n, c, kept in got:
        by_id.setdefault(i, []).append((n, c, kept))
    assert by_id[None] == [(0, None, True), (20, None, True)]
    assert by_id[1] == [(0, 1, True)] and by_id[2] == [(0, 2, True)] and by_id[3] == [(0, 3, True)]
    assert by_id[5] == [(20, 5, True)] * 2 and by_id[6] == [(20, 5, False)]
    assert sorted(by_id[7]) == [(5, 7, True), (21, 5, False)] and by_id[13] == [(1, 13, True)]
    assert by_id[9][0][1] == 8
    assert result(near_duplicates(no_docs)) == []


def test_the_stage_keeps_one_row_a_group_and_all_columns(odd_docs):
    kept = near_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 7, 8, 10, 11, 12, 13]
    assert kept.where("doc_id is null").count() == 2


def test_the_stage_takes_columns_of_any_name(docs_of):
    text = "one text that is long enough to have some shingles of five words"
    names = ["__id", "__hash", "__kept", "__text", "row", "id", "hash", "likely", "copies", "nth", "kept", "__at", "a.b"]
    docs = docs_of([(1, text), (2, text), (3, "other"), (3, "other"), (None, text), (4, None)])
    docs = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    rows = {r.doc_id: r for r in kept.collect()}
    assert sorted(rows, key=str) == [1, 3, 4, None] and kept.count() == 4
    assert all(rows[i][n] == f"{n}{i}" for i in (1, 3, 4) for n in names)


@pytest.mark.parametrize("bits", [6, 10])
def test_a_crowded_filter_changes_no_row(documents, monkeypatch, bits):
    """With few bits nearly all rows are taken for likely ones."""
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    got = result(near_duplicates(documents))
    want = brute.near_groups([(r.doc_id, r.text) for r in documents.collect()])
    assert got == sorted(((i, n, c, i == c) for i, (n, c) in want.items()), key=str)


def test_the_filter_never_rules_out_a_key(spark):
    rows = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") * 7).alias("b"))
    keys = rows.where("a % 50 = 0")
    marked = common.probably_in(rows, keys, ["a", "b"])
    assert marked.columns[-1] == "likely" and marked.count() == 5000
    assert marked.where("a % 50 = 0 and not likely").count() == 0
    assert marked.where("a % 50 <> 0 and likely").count() < 50


def test_signatures_estimate_similarity_with_little_variance():
    g = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        words = g.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(words[:200]), np.unique(words[100:])
        s = super_minhash([a, b])
        errors.append((s[0] == s[1]).mean() - 100 / 300)
    plain = np.sqrt(1 / 3 * 2 / 3 / 252)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < plain


def test_small_sets_fill_all_slots_with_distinct_steps():
    s = super_minhash([np.array([7], np.uint64), np.array([7, 8], np.uint64)])
    assert sorted(s[0] >> 24) == list(range(252))
    assert (s[1] <= s[0]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert all(got[i] == 1 for i in range(1, 201)) and all(got[k] == 1000 for k in range(1000, 1100))
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_are_not_shuffled_for_their_sets(spark):
    docs = spark.createDataFrame([(i, f"one two three {i}") for i in range(20)] + [(3, "one two three 3"), (30, None)], "doc_id long, text string")
    signed = near_dedup.signatures(docs)
    wanted = signed.where("doc_id % 2 = 1").select("doc_id", "text_hash", "fp").distinct()
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = near_dedup.shingle_sets(docs, common.written(wanted))
        plan = sets._jdf.queryExecution().executedPlan().toString()
        # sets and wanted classes by fp; texts stay where they are
        assert len(re.findall(r"Exchange hashpartitioning\(fp#\d+, ", plan)) == 2 == plan.count("Exchange hashpartitioning")
        got = sorted((bytes(r["fp"]), bytes(r["words48"])) for r in sets.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    expected = [near_dedup.shingles(f"one two three {i}".encode(), common.WordHashes()) for i in range(1, 20, 2)]
    assert got == sorted((near_dedup.fingerprint(s), near_dedup.pack48(s)) for s in expected)
