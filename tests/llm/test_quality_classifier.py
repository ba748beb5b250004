"""The attention network's gradients, its held-out accuracy and its defined cases."""

import random

import numpy as np
import pytest
from doc_rows import make_docs

from slipstream.llm import quality_classifier as q
from slipstream.llm.attention_mil import Network

LABELS = "doc_id long, quality int, score string"


def bags(texts):
    return q.bags_of([t.split() for t in texts], q.WordTable())


def test_gradients():
    some = bags([b"one two three " * 40, b"a", b"JUNK!! ### " * 30 + b"plain words follow here"])
    net, y = Network.fresh(q.MEASURES, 3), np.array([1.0, 0.0, 1.0])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    _, grad = net.gradients(some, y)
    g = np.random.default_rng(1)
    for name, w in net.weights.items():
        used = {"word": some.words, "shape": some.shapes}.get(name)
        for _ in range(6):
            at = tuple(g.integers(s) for s in w.shape)
            if used is not None:
                at = (int(g.choice(used)), at[1])
            old, values = w[at], []
            for step in (1e-3, -1e-3):
                w[at] = old + step
                values.append(net.gradients(some, y)[0])
            w[at] = old
            assert grad[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, abs=2e-4)


def test_passages_cover_every_word_and_stay_in_their_text():
    texts = [b" ".join(b"w%d" % i for i in range(n)) for n in (1, 64, 65, 200)]
    some = bags(texts)
    assert some.per_doc.tolist() == [1, 1, 2, 4] and some.sizes.sum() == 330
    assert some.sizes.tolist() == [1, 64, 64, 1, 64, 64, 64, 8]


def test_a_repeat_counts_within_its_own_text_only():
    apart = bags([b"one two three four", b"one two three four"])
    together = bags([b"one two three four one two three four"])
    assert apart.measures[:, 4].tolist() == [0, 0] and together.measures[0, 4] == 1


def test_a_text_scores_alike_alone_and_among_others():
    net, texts = Network.fresh(q.MEASURES, 5), [b"some words of a text " * 50, b"", b"short", b"JUNK!! " * 300]
    alone = [q.score_texts(net, [t], q.WordTable())[0] for t in texts]
    assert q.score_texts(net, texts, q.WordTable()) == pytest.approx(alone, abs=1e-6)
    assert q.score_texts(net, texts, q.WordTable(), words_at_once=1) == pytest.approx(alone, abs=1e-6)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    got = q.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 500
    assert (got.predicted == got.quality).mean() > 0.96
    good = got.quality == 1
    order = got.score.rank()
    auc = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97


def test_labels_and_other_columns_are_no_inputs(spark, odd_docs):
    rng = random.Random(2)
    rows = [(i, ("clean words of prose here " if i % 2 else "@@@ ### !!! ") * rng.randint(5, 30)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(200)] + [(None, 1, "x"), (3, None, "x")], LABELS)
    net = q.train(make_docs(spark, rows), labels)
    both = [q.with_quality(d.select("doc_id", "text"), net).collect() for d in (odd_docs, odd_docs.drop("score"))]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1]))
    scores = {r.text: r.score for r in both[0]}
    assert scores[None] == scores[""] == scores[" \n\t "] == 0
    assert all(0 <= s <= 1 for s in scores.values())
    assert q.with_quality(make_docs(spark, [(1, "clean words of prose " * 9), (2, "@@@ ### " * 9)]), net).orderBy("doc_id").toPandas().score.diff().iloc[1] < -0.5


def test_few_labels_and_no_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in q.quality_scores(odd_docs.drop("score"), none).collect()} == {0.0}
    ids = [5, 6, 8, 10, 11]
    one_kind = spark.createDataFrame([(i, 1, "x") for i in ids], LABELS)
    scores = {r.score for r in q.quality_scores(odd_docs, one_kind).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    assert q.quality_scores(no_docs, one_kind).count() == 0
