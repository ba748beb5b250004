import random
from collections import defaultdict

import pytest

from slipstream.llm import packing
from slipstream.llm.packing import LENGTHS, best_fit, pack, stretches


def check(rows, tokens):
    """Every token of every document once, no bin too full, each as short as its contents allow."""
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.first_token, r.n_tokens))
        if r.n_tokens:
            bins[r.bin_id].append(r)
    for i, held in pieces.items():
        held.sort()
        assert sum(n for _, n in held) == tokens[i]
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and held[0][0] == 0
    for held in bins.values():
        used = sum(r.n_tokens for r in held)
        assert {r.bin_used for r in held} == {used}
        assert {r.bin_length for r in held} == {min(c for c in LENGTHS if c >= used)}
        assert sorted(r.position for r in held) == list(range(len(held)))
    return sum(r.bin_length for held in bins.values() for r in held[:1])


def test_documents_are_packed_whole(documents, monkeypatch):
    tokens = {r.doc_id: r.tokens for r in packing.token_counts(documents).collect()}
    room = check(pack(documents).collect(), tokens)
    assert sum(tokens.values()) > 0.97 * room
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)
    assert sum(tokens.values()) > 0.85 * check(pack(documents).collect(), tokens)


def test_best_fit_takes_the_tightest_bin_and_shrinks_it():
    assert best_fit([600, 500, 400], (512, 1024), 0) == [(0, 1024), (1, 512), (0, 1024)]
    assert best_fit([3], (4, 8), 1) == [(0, 4)]
    assert best_fit([], (4, 8)) == []


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_wastes_less_than_first_fit_in_one_length(seed):
    g = random.Random(seed)
    sizes = sorted((g.choice([g.randint(1, 300), g.randint(1, 8192)]) for _ in range(400)), reverse=True)
    found = best_fit(sizes)
    used, length = defaultdict(int), {}
    for n, (k, c) in zip(sizes, found):
        used[k] += n
        length[k] = c
    assert all(u <= length[k] for k, u in used.items())
    rooms = []
    for n in sizes:
        at = next((i for i, r in enumerate(rooms) if r >= n), None)
        if at is None:
            rooms.append(8192)
            at = -1
        rooms[at] -= n
    assert sum(length.values()) <= 8192 * len(rooms)


def test_the_opened_length_is_the_cheapest_when_filled_from_what_remains():
    """Two pieces of 3,000 leave a quarter of 8,192 empty, so the shorter length is opened from the first piece on."""
    assert best_fit([3000] * 10, (3000, 8192)) == [(k, 3000) for k in range(10)]
    assert best_fit([8000, 3000, 3000], (3000, 8192)) == [(0, 8192), (1, 3000), (2, 3000)]
    assert packing.filled(10, 4, packing.Counter([3, 3, 1]), 0b1010) == 10


def least_cost(sizes, lengths, overhead):
    """The least cost over all ways to split the pieces into bins."""
    n = len(sizes)
    sums = [sum(s for i, s in enumerate(sizes) if m >> i & 1) for m in range(1 << n)]
    cost = [min((c + overhead for c in lengths if c >= s), default=1 << 40) for s in sums]
    best = [0] + [1 << 40] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        low = m & -m
        rest = sub = m ^ low
        while True:
            best[m] = min(best[m], cost[sub | low] + best[rest ^ sub])
            if not sub:
                break
            sub = sub - 1 & rest
    return best[-1]


@pytest.mark.parametrize("seed", range(12))
def test_cost_is_near_the_least_possible(seed):
    g = random.Random(seed)
    sizes = sorted((g.randint(1, g.choice([400, 2000, 8192])) for _ in range(8)), reverse=True)
    final = dict(best_fit(sizes))
    assert sum(c + packing.SEQUENCE_COST for c in final.values()) <= 1.15 * least_cost(sizes, LENGTHS, packing.SEQUENCE_COST)


def test_two_runs_are_equal_however_the_rows_lie(documents, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)
    docs = documents.unionByName(documents.where("doc_id < 30"))
    a, b = (sorted(map(tuple, pack(d).collect()), key=str) for d in (docs.repartition(2), docs.repartition(7, "text")))
    assert a == b and len({r[4] >> 32 for r in a if r[4] is not None}) > 3


def test_awkward_rows(odd_docs, no_docs):
    rows = pack(odd_docs).collect()
    assert sorted({r.doc_id for r in rows if r.doc_id is not None}) == list(range(1, 14))
    assert all((r.bin_id is None) == (r.n_tokens == 0) for r in rows)
    assert len([r for r in rows if r.doc_id in (1, 2)]) == 2 and len([r for r in rows if r.doc_id == 5]) == 2
    assert len([r for r in rows if r.doc_id == 8]) > 5
    assert pack(no_docs).count() == 0


def test_stretches_join_to_the_text():
    for text in ("", "a" * 50_000, "word " * 20_000, " " * 45_000):
        assert "".join(stretches(text)) == text and max(map(len, stretches(text))) <= packing.STRETCH_CHARS
