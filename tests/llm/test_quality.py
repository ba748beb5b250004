import brute

from slipstream.llm.quality import BAD, GOOD, NOTHING, RULES, learn, quality


def test_base_counts_equal_brute_force(documents, odd_docs):
    for docs in (documents, odd_docs):
        want = sorted(((r.doc_id, *brute.base_quality(r.text)) for r in docs.collect()), key=str)
        got = quality(docs).collect()
        names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert sorted((tuple(r[n] for n in names) for r in got), key=str) == want
        assert not [r for r in got if r.kept and r.base_failed]


def test_labels_are_recovered(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    wrong = got.where("(quality = 1) <> kept").count()
    assert wrong <= 0.02 * got.count()


def test_nothing_to_learn_from(no_docs):
    assert quality(no_docs).count() == 0


def pattern(votes: dict[int, int]) -> int:
    code = 0
    for j in range(len(RULES)):
        code = code * 3 + votes.get(j, NOTHING)
    return code


def test_em_trusts_rules_that_agree_and_keeps_their_direction():
    clean, junk, torn = pattern({6: GOOD, 8: GOOD}), pattern({0: BAD, 6: BAD}), pattern({0: BAD, 6: GOOD, 8: GOOD})
    p = learn({clean: 900, junk: 80, torn: 5})
    assert p[clean] > 0.9 and p[junk] < 0.1 and p[torn] < p[clean]
    assert p[pattern({6: GOOD, 8: GOOD})] >= p[pattern({6: GOOD})] - 1e-9


def test_a_single_pattern_gives_a_defined_result():
    p = learn({pattern({}): 3})
    assert 0 <= p[pattern({})] <= 1
