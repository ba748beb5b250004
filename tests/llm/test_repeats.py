import random

import brute
import numpy as np
import pytest

from slipstream.llm import repeats
from slipstream.llm.repeat_groups import common_prefix, maximal_repeats, prefix_intervals
from slipstream.llm.repeats import remove_repeats


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    want = brute.repeats([(r.text or "").encode() for r in rows])
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=str)
    got = sorted((tuple(r) for r in remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == want


def test_documents_equal_brute_force(documents):
    check(documents)


def some_texts():
    g = random.Random(11)
    word = lambda: "".join(g.choice("abcdefgh ") for _ in range(g.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(120), text(200), text(90)]
    out = [text(60) + s[g.randint(0, 80) : len(s) - g.randint(0, 80)] + text(40) for s in shared for _ in range(12)]
    out += [text(10) + shared[0][:420] + text(30), shared[0][:399] + text(50), "ab" * 700, "ab" * 500 + text(90), "x" * 3000, "ü" * 500]
    out += [shared[1] + shared[1], shared[2] * 3, out[0], out[0] + " ", None, "", "short"]
    return out


def test_passages_of_many_kinds_equal_brute_force(docs_of):
    check(docs_of(list(enumerate(some_texts()))))


def test_crowded_anchors_give_the_same_result(docs_of, monkeypatch):
    docs = docs_of(list(enumerate(some_texts())))
    monkeypatch.setattr(repeats, "CROWD", 3)
    check(docs)


def cut_by_hand(texts):
    """What is left of texts without every 400 bytes that also start elsewhere."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - 399):
            seen[r[i : i + 400]] = seen.get(r[i : i + 400], 0) + 1
    out = []
    for r in raw:
        gone = {j for i in range(len(r) - 399) if seen[r[i : i + 400]] > 1 for j in range(i, i + 400)}
        out.append(bytes(b for j, b in enumerate(r) if j not in gone).decode(errors="replace"))
    return out


@pytest.mark.parametrize("bits", [24, 7])
def test_what_is_left_of_every_text_is_returned(docs_of, monkeypatch, bits):
    """With few bits the filter takes most texts for changed ones."""
    monkeypatch.setattr("slipstream.llm.common.FILTER_BITS", bits)
    texts = [*some_texts(), *(f"text {i}" for i in range(30))]
    got = {r.doc_id: r for r in remove_repeats(docs_of(list(enumerate(texts)))).collect()}
    assert [got[i].text for i in range(len(texts))] == cut_by_hand(texts)
    assert {r.n_spans for r in got.values() if not r.n_removed} == {0}


def test_a_cut_character_does_not_break_the_text(docs_of):
    """The last byte of ü and ¼ is equal, the first is not."""
    shared = "".join(chr(97 + i * i % 23) for i in range(450))
    texts = ["ü" + shared + " end", "¼" + shared]
    rows = remove_repeats(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.text for r in rows] == cut_by_hand(texts) == ["\ufffd end", "\ufffd"]


def test_awkward_rows(odd_docs, no_docs):
    short = odd_docs.where("doc_id is null or doc_id not in (8, 9)")
    check(short)
    assert remove_repeats(no_docs).count() == 0


def test_equal_windows_pick_equal_anchors_across_stretches(monkeypatch):
    g = np.random.default_rng(3)
    text = bytes(g.integers(97, 101, 6000).astype(np.uint8))
    whole = repeats.anchors(text)
    monkeypatch.setattr(repeats, "STRETCH", 700)
    parts = repeats.anchors(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    inner = repeats.anchors(text[1000:3000])[0] + 1000
    assert set(inner) <= set(whole[0])


@pytest.mark.parametrize("letters", ["ab", "abcd"])
def test_maximal_repeats_cover_all_repeated_windows(letters):
    g = random.Random(len(letters))
    for _ in range(100):
        n, least = g.randint(2, 12), 8
        before = ["".join(g.choice(letters) for _ in range(6)).encode() for _ in range(n)]
        after = ["".join(g.choice(letters) for _ in range(6)).encode() for _ in range(n)]
        if len(set(zip(before, after))) < n:
            continue
        covered = set()
        for depth, found in maximal_repeats(before, after, least):
            for i, left in found:
                covered |= {(i, left_) for left_ in range(least - depth, left + 1)}
        want = set()
        for i in range(n):
            for j in range(n):
                if i != j:
                    r, left = common_prefix(after[i], after[j]), common_prefix(before[i], before[j])
                    want |= {(i, x) for x in range(max(0, least - r), left + 1)} if left + r >= least else set()
        assert want <= covered
        for i, left in covered:
            assert any(common_prefix(before[i], before[j]) >= left for j in range(n) if j != i)


def test_prefix_intervals_form_a_tree():
    strings = sorted([b"banana", b"ban", b"band", b"bank", b"cab", b"cad"])
    got = set(prefix_intervals(strings))
    assert (3, 0, 4) in got and (2, 4, 6) in got and (0, 0, 6) in got
