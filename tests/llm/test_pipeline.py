import os

import brute
import pytest

import corpus_pipeline
from doc_rows import make_docs
from slipstream.llm import decontaminate, near_dedup, packing, secret_scan, toxicity

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture
def no_training(monkeypatch):
    """One network for all runs of a test."""
    kept = {}
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: kept.setdefault("net", real(docs, labels)))
    return kept


def test_the_result_equals_a_plain_pipeline(spark, no_training):
    got = sorted((r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    scores = toxicity.score_texts(no_training["net"], [t.encode() for _, t in rows])
    rows = [r for r, s in zip(rows, scores) if s < toxicity.THRESHOLD]
    groups = brute.near_groups(rows, words=5)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hits = {r[0]: r for r in brute.contamination(rows, items)}
    automaton = decontaminate.ItemAutomaton([(str(n), decontaminate.letter_words(t.encode())) for n, t in items], decontaminate.WINDOW)
    kept = []
    for i, t in rows:
        _, n, hit, *_ = hits[i]
        if hit and hit > n * decontaminate.MAX_COVERAGE:
            continue
        spans, _ = automaton.scan(decontaminate.letter_words(t.encode())) if hit else ([], ())
        kept.append((i, decontaminate.without_spans(t.encode(), spans).decode() if hit else t))
    efficiency = secret_scan.Efficiency(secret_scan.read_vocabulary(secret_scan.VOCABULARY))
    kept = [(i, secret_scan.without_secrets(t.encode(), efficiency) or t) for i, t in kept]
    tokens = {r.doc_id: r.tokens for r in packing.token_counts(make_docs(spark, kept)).collect()}
    longest = max(packing.LENGTHS)
    want = [
        (i, k, max(0, min(longest, n - k * longest))) for i, n in tokens.items() for k in range(max(1, -(-n // longest)))
    ]
    assert got == sorted(want) and len(tokens) < 200


def test_stages_on_awkward_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            if name != "packing":
                assert out.columns == docs.columns
            out.count()


def test_registered_queries_are_all_there():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert not set(entry.oracle_sql()) - set(entry.queries())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py")) and near_dedup.LINK_PER_CENT == 80
