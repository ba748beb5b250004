"""Ranked search against scoring every document of every item."""

import math
import re
from collections import Counter

import pytest

from slipstream.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20) -> Counter:
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in set(items):
        scored = []
        for i, c in counted:
            m = 75 + 25 * c.total() * n // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if c[t]
            )
            if s > 0:
                scored.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[(item, rank, i, -s)] += 1
    return out


ITEMS = [(1, "The quick brown FOX"), (1, "lazy lazy dog w7"), (2, None), (3, ""), (4, "zzz nowhere"), (5, "straße 漢字 one"),
         (5, "straße 漢字 one"), (None, "two words"), (6, "w1 w2 w3 w4 w5 " * 40)]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, score string")


@pytest.mark.parametrize("pieces,blocks", [(search.PIECE_POSTINGS, search.ITEM_TERMS), (40, 8)])
def test_awkward_rows(odd_docs, items, monkeypatch, pieces, blocks):
    monkeypatch.setattr(search, "PIECE_POSTINGS", pieces)
    monkeypatch.setattr(search, "ITEM_TERMS", blocks)
    got = Counter(map(tuple, search.ranked_search(odd_docs, items).collect()))
    assert got == plain([(r.doc_id, r.text) for r in odd_docs.collect()], ITEMS)


def test_many_ties_in_one_stratum(docs_of, spark, monkeypatch):
    monkeypatch.setattr(search, "PIECE_POSTINGS", 60)
    rows = [(900 - i, "alpha beta gamma") for i in range(300)] + [(5000 + i, f"alpha alpha w{i % 9} beta beta") for i in range(200)]
    rows += [(7000, "alpha")] * 30 + [(None, "gamma")] * 4
    items = [(1, "alpha"), (2, "gamma beta"), (3, "w3 gamma gamma")]
    got = search.ranked_search(docs_of(rows).repartition(6), spark.createDataFrame(items, "item_id long, text string"), 20)
    assert Counter(map(tuple, got.collect())) == plain(rows, items)


def test_a_stratum_below_the_threshold_is_not_read(docs_of, spark):
    """Thirty short documents hold the term; no long one can reach their scores."""
    import pyarrow as pa

    rows = [(i, "needle") for i in range(30)] + [(100 + i, "needle " + "hay " * 400) for i in range(3)]
    index = search.build_index(docs_of(rows))
    strata = {r.m for r in index.postings.select("m").distinct().collect()}
    low, high = min(strata), max(strata)
    table = index.postings.where(f"m = {high}").where("term is null or term = cast('needle' as binary)").toArrow()
    block = search._block([type("R", (), {"item": 1, "terms": [b"needle"], "uses": [1]})], {b"needle": 10}, {low: [1]})
    assert len(search.visit(pa.table(table), block, False, 20)) == 3
    least = 10 * search.impact(1, low)
    assert len(search.visit(pa.table(table), block.with_least({1: least}), False, 20)) == 0


def test_no_documents_and_no_items(no_docs, odd_docs, items, spark):
    assert search.ranked_search(no_docs, items).count() == 0
    assert search.ranked_search(odd_docs, spark.createDataFrame([], items.schema)).count() == 0
