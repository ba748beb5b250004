import random

import brute
import pytest

from slipstream.llm import decontaminate
from slipstream.llm.decontaminate import contamination, remove_contamination
from slipstream.llm.suffix_automaton import ItemAutomaton


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_equal_brute_force(documents, benchmark_items):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in benchmark_items.collect()]
    assert rows(contamination(documents, benchmark_items)) == sorted(brute.contamination(docs, items), key=str)


@pytest.mark.parametrize("window", [3, 5, 10])
def test_automaton_equals_brute_force_on_random_words(window):
    g = random.Random(window)
    for _ in range(500):
        letters = "abcde"[: g.choice([2, 3, 5])]
        items = [(str(i), [g.choice(letters) for _ in range(g.randint(0, 14))]) for i in range(g.randint(1, 6))]
        words = [g.choice(letters + "z") for _ in range(g.randint(1, 40))]
        automaton = ItemAutomaton([(n, [w.encode() for w in ws]) for n, ws in items], window)
        spans, found = automaton.scan([w.encode() for w in words])
        names = ",".join(sorted({automaton.names[i] for i in found}))
        (want,) = brute.contamination([(0, " ".join(words))], [(n, " ".join(ws)) for n, ws in items], window)
        assert (sum(b - a for a, b in spans), brute.sha(names)) == (want[2], want[4])


def test_benchmark_in_several_blocks(documents, benchmark_items, monkeypatch):
    whole = rows(contamination(documents, benchmark_items))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2500)
    assert rows(contamination(documents, benchmark_items)) == whole


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_awkward_items_and_documents(spark, odd_docs, no_docs, docs_of):
    items = spark.createDataFrame(
        [("a", ITEM), ("a", ITEM), ("b", "Solo"), (None, "two words"), ("c", None), ("d", "..."), ("e", "")], "item_id string, text string"
    )
    docs = docs_of([(1, ITEM.upper()), (2, "x " + ITEM.replace(" ", ", ") + " y solo"), (3, "two\nwords two"), (4, None), (5, " ".join(ITEM.split()[:9]))])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(docs, items).collect()}
    assert got == {1: (12, 12, 1, True), 2: (15, 13, 2, True), 3: (3, 2, 1, True), 4: (0, 0, 0, False), 5: (9, 0, 0, False)}
    assert contamination(odd_docs, items).count() == odd_docs.count()
    assert contamination(no_docs, items).count() == 0
    assert contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_the_stage_cuts_spans_and_drops_covered_documents(spark, docs_of, odd_docs):
    items = spark.createDataFrame([("a", ITEM)], "item_id string, text string")
    clean = "Nothing here, to see; just text."
    mixed = "Intro " * 20 + "[" + ITEM.title() + "] outro " + "more " * 20
    docs = docs_of([(1, clean), (2, ITEM), (3, mixed), (4, None)])
    out = remove_contamination(docs, items)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    cut = "Intro " * 20 + "[", "] outro " + "more " * 20
    assert got[1] == (clean, len(clean)) and 2 not in got and got[4] == (None, None)
    text, n = got[3]
    assert "alpha" not in text.lower() and text.startswith(cut[0]) and text.endswith(cut[1]) and n == len(text)
    assert remove_contamination(odd_docs, items).count() == odd_docs.count()


def test_columns_with_names_of_our_own_stay(spark, docs_of):
    items = spark.createDataFrame([("a", ITEM)], "item_id string, text string")
    docs = docs_of([(1, "Plain text."), (2, "x " * 40 + ITEM)])
    named = docs.selectExpr("*", "1 __spans", "'w' __words", "2 __items", "3 ___spans")
    got = {r.doc_id: r for r in remove_contamination(named, items).collect()}
    assert list(got[1].asDict()) == named.columns and got[1].text == "Plain text."
    assert got[2].text.split() == ["x"] * 40 and (got[2]["__spans"], got[2]["__words"], got[2]["__items"], got[2]["___spans"]) == (1, "w", 2, 3)
