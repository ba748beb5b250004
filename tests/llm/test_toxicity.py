import zlib

import numpy as np
import pytest

from slipstream.llm import toxicity
from slipstream.llm.gru import Network, character_features
from slipstream.llm.toxicity import STRIDE, WINDOW, drop_toxic, fit, score_texts, toxicity_scores, window_starts


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.85
    assert np.mean([r.predicted for r in clean]) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_windows_overlap_and_cover_all_words():
    for n in (1, 10, 63, 64, 65, 96, 97, 1000):
        starts = window_starts(n)
        assert set(range(n)) == {k for s in starts for k in range(s, min(n, s + WINDOW))}
        assert all(b - a == STRIDE for a, b in zip(starts, starts[1:]))


def small_network():
    g = np.random.default_rng(2)
    net = Network.fresh({b"bad": 1, b"good": 2}, np.array([0, 2, -1], np.float32), np.zeros(1 << 17, np.float32))
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64) + 0.1 * g.standard_normal(net.weights[k].shape)
    return net


def test_gradients_match_differences():
    net, g = small_network(), np.random.default_rng(0)
    ids, n = g.integers(0, 3, (4, 6)), np.array([6, 3, 5, 1])
    chars, y = g.standard_normal((4, 6, 4)), np.array([1.0, 0, 1, 0])
    _, grad, d_chars = net.gradients(ids, chars, n, y)
    for name in ("word", "att", "out", "Wf", "Ub", "bb", "bias"):
        flat = net.weights[name].reshape(-1)
        for at in g.choice(len(flat), min(4, len(flat)), replace=False):
            keep, h = flat[at], 1e-4
            flat[at] = keep + h
            up = net.gradients(ids, chars, n, y)[0]
            flat[at] = keep - h
            down = net.gradients(ids, chars, n, y)[0]
            flat[at] = keep
            assert grad[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * h), abs=2e-4)
    chars[0, 2, 1] += 1e-4
    up = net.gradients(ids, chars, n, y)[0]
    chars[0, 2, 1] -= 2e-4
    assert d_chars[0, 2, 1] == pytest.approx((up - net.gradients(ids, chars, n, y)[0]) / 2e-4, abs=2e-4)


def test_a_document_scores_as_its_highest_window_however_texts_are_batched():
    net = small_network()
    g = np.random.default_rng(4)
    texts = [" ".join(g.choice(["bad", "good", "other", "wörd"], int(n))).encode() for n in (1, 5, 64, 65, 500, 3000, 0, 90)]
    whole = score_texts(net, texts)
    assert np.allclose(whole, score_texts(net, texts, words_at_once=100), atol=1e-6)
    words = texts[4].split()
    single = [score_texts(net, [b" ".join(words[s : s + WINDOW])])[0] for s in window_starts(len(words))]
    assert whole[4] == pytest.approx(max(single), abs=1e-5) and whole[6] == 0


def test_character_features_belong_to_their_words():
    words = [b"a", b"abc", "é".encode(), b"abcdefghij"]
    codes, starts = character_features(words)
    for k, w in enumerate(words):
        alone, _ = character_features([w])
        assert list(codes[starts[k] : starts[k] + len(alone)]) == list(alone)


def test_labels_of_one_kind_or_none(labels, odd_docs, no_docs):
    assert {r.score for r in toxicity_scores(odd_docs, labels.limit(0)).collect()} == {0.0}
    clean = labels.selectExpr("cast(null as long) doc_id", "quality", "toxic").unionByName(labels.where("toxic = 0"))
    assert {r.score for r in toxicity_scores(odd_docs, clean).collect()} == {0.0}
    assert toxicity_scores(no_docs, labels).count() == 0
    assert fit([(1, 1.0, [b"x"])]).constant == 0.5


def test_the_stage_drops_what_scores_high_and_keeps_columns(spark, odd_docs, labels, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: small_network())
    scores = score_texts(small_network(), [(r.text or "").encode() for r in odd_docs.collect()])
    kept = drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == (scores < 0.5).sum()
    named = odd_docs.selectExpr("*", "7 __toxicity")
    assert drop_toxic(named, labels).columns == named.columns


def test_a_repeated_id_gives_one_text_to_the_sample(spark):
    """However often an id is repeated, its rows do not all go to the driver."""
    kept = next(i for i in range(100) if zlib.crc32(str(i).encode()) % toxicity.FOLDS)
    rows = [(kept, f"text number {'abc'[k % 3]} of one document") for k in range(300)] + [(kept, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(kept, 1)] * 3, "doc_id long, toxic int")
    got = toxicity.training_windows(docs, labels)
    assert len(got) == 1 and got == toxicity.training_windows(docs.orderBy("text").repartition(5), labels)
