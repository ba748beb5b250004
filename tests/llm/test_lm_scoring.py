import math
from collections import Counter

import pytest

from slipstream.llm.lm_scoring import SHARED, STRENGTH, Tokens, cross_entropy_difference
from slipstream.llm.secret_scan import VOCABULARY, read_vocabulary

TOKENS = Tokens(read_vocabulary(VOCABULARY))


def brute(rows, good):
    """doc_id -> (tokens, target loss, background loss), with plain counters."""
    pairs = {i: [divmod(int(x), 1 << 16) for x in TOKENS.pairs(t)] if t else [] for i, t in rows}
    models = []
    for ids in ([i for i, _ in rows], [i for i, _ in rows if i in good]):
        both, before, single = Counter(), Counter(), Counter()
        for i in ids:
            both.update(pairs[i])
            before.update(v for v, _ in pairs[i])
            single.update(w for _, w in pairs[i])
        models.append((both, before, single))
    n_all, n_good = (sum(m[2].values()) for m in models)
    scale = n_good / n_all
    out = {}
    for i, ps in pairs.items():
        own, own_before, loss = Counter(ps), Counter(v for v, _ in ps), []
        for k, (both, before, single) in enumerate(models):
            times, factor = (scale, scale) if k == 0 else (1, float(i in good))
            total = 0.0
            for v, w in ps:
                q = (models[0][2][w] + 1) / (n_all + (1 << 16))
                p = (1 - SHARED) * single[w] / (n_all if k == 0 else n_good) + SHARED * q
                seen = max(0, both[v, w] * times - factor * own[v, w])
                p = (seen + STRENGTH * p) / (max(0, before[v] * times - factor * own_before[v]) + STRENGTH)
                total -= math.log2(p)
            loss.append(total / len(ps) if ps else None)
        out[i] = len(ps), loss[1], loss[0]
    return out


def test_scores_equal_plain_counters(documents, labels):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    want = brute(rows, good)
    for r in cross_entropy_difference(documents, labels).collect():
        n, target, background = want[r.doc_id]
        assert r.n_tokens == n
        assert r.target_loss == pytest.approx(target, abs=1e-9) and r.background_loss == pytest.approx(background, abs=1e-9)
        assert r.score == pytest.approx(target - background, abs=1e-9)


def test_chunks_do_not_matter(documents, labels, monkeypatch):
    whole = {r.doc_id: r.score for r in cross_entropy_difference(documents, labels).collect()}
    monkeypatch.setattr("slipstream.llm.lm_scoring.CHUNK_BYTES", 20_000)
    for r in cross_entropy_difference(documents, labels).collect():
        assert r.score == pytest.approx(whole[r.doc_id], abs=1e-12)


def test_good_documents_score_lower(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = cross_entropy_difference(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id")
    means = {r.quality: r.m for r in got.groupBy("quality").agg({"score": "avg"}).withColumnRenamed("avg(score)", "m").collect()}
    assert means[1] + 1 < means[0]


def test_awkward_rows(odd_docs, no_docs, labels):
    odd_labels = labels.selectExpr("doc_id", "quality", "toxic").unionByName(labels.selectExpr("null doc_id", "null quality", "toxic").limit(2))
    got = cross_entropy_difference(odd_docs, odd_labels).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.n_tokens == 0) == (r.score is None)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert all(r.score in (0.0, None) for r in cross_entropy_difference(odd_docs, labels.limit(0)).collect())
    assert cross_entropy_difference(no_docs, labels).count() == 0
