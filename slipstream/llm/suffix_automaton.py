"""A generalised suffix automaton over the words of benchmark items, and its scan of documents."""

from __future__ import annotations

from itertools import repeat

import numpy as np

_TABLE_BITS = 20


class ItemAutomaton:
    """All factors of the items. A window is ``window`` consecutive words, or a shorter item whole."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, words in items if words]
        texts = [words for _, words in items if words]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for words in texts]
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        ends = [self._add(words) for words in coded]
        self._name_windows(coded, ends)
        self._known_pairs(coded)

    def _new(self, longest: int, link: int, follow: dict[int, int]) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the strings that reach ``q`` from ``p`` by ``w``, cut out of ``q`` where needed."""
        if self.longest[q] == self.longest[p] + 1:
            return q
        clone = self._new(self.longest[p] + 1, self.link[q], dict(self.follow[q]))
        self.link[q] = clone
        while p >= 0 and self.follow[p].get(w) == q:
            self.follow[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, words: list[int]) -> int:
        last = 0
        for w in words:
            if w in self.follow[last]:
                last = self._split(last, w, self.follow[last][w])
                continue
            new = self._new(self.longest[last] + 1, 0, {})
            p = last
            while p >= 0 and w not in self.follow[p]:
                self.follow[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w, self.follow[p][w])
            last = new
        return last

    def _name_windows(self, coded: list[list[int]], ends: list[int]) -> None:
        n, k = len(self.link), self.window
        order = sorted(range(1, n), key=self.longest.__getitem__)
        #: the suffix state that holds the last ``window`` words, of states that are as long
        self.windowed = [-1] * n
        for s in order:
            if self.longest[s] >= k:
                up = self.link[s]
                self.windowed[s] = s if self.longest[up] < k else self.windowed[up]
        self.items_at: dict[int, list[int]] = {}
        self.whole_at: dict[int, list[tuple[int, int]]] = {}
        for i, words in enumerate(coded):
            if len(words) < k:
                s = ends[i]
                while self.longest[self.link[s]] >= len(words):
                    s = self.link[s]
                self.whole_at.setdefault(s, []).append((len(words), i))
                continue
            s = 0
            for j, w in enumerate(words):
                s = self.follow[s][w]
                if j + 1 >= k:
                    held = self.items_at.setdefault(self.windowed[s], [])
                    if not held or held[-1] != i:
                        held.append(i)
        #: the nearest state up the suffix links, itself included, that is the end of a short item
        self.short_up = [-1] * n
        if self.whole_at:
            for s in order:
                self.short_up[s] = s if s in self.whole_at else self.short_up[self.link[s]]

    def _known_pairs(self, coded: list[list[int]]) -> None:
        self.pairs = np.zeros(1 << _TABLE_BITS, bool)
        self.alone: dict[int, list[int]] = {}
        need = self.window
        for i, words in enumerate(coded):
            if len(words) == 1:
                self.alone.setdefault(words[0], []).append(i)
            else:
                need = min(need, len(words))
                w = np.array(words, np.uint64)
                self.pairs[self._slot(w)] = True
        self.need = max(2, need)
        self.is_alone = np.zeros(len(self.vocabulary) + 1, bool)
        self.is_alone[list(self.alone)] = True

    @staticmethod
    def _slot(words: np.ndarray) -> np.ndarray:
        code = (words[:-1] << np.uint64(32) | words[1:]) * np.uint64(0x9E3779B97F4A7C15)
        return code >> np.uint64(64 - _TABLE_BITS)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans [start, end) of words inside occurring windows, and the items these are of.

        A match longer than one word only uses adjacent pairs that occur in an item, so the
        automaton reads the stretches of such pairs; elsewhere its matching length is below any window.
        """
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        known = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        if self.alone:
            for i in np.flatnonzero(self.is_alone[known]):
                spans.append((i, i + 1))
                items.update(self.alone[known[i]])
        if len(words) >= self.need:
            fits = self.pairs[self._slot(known.astype(np.uint64))] & (known[:-1] >= 0) & (known[1:] >= 0)
            edge = np.flatnonzero(np.diff(np.r_[False, fits, False].astype(np.int8)))
            starts, ends = edge[::2], edge[1::2] + 1
            long = ends - starts >= self.need
            for a, b in zip(starts[long].tolist(), ends[long].tolist()):
                self._match(known[a:b].tolist(), a, spans, items)
        return merged(spans), items

    def _match(self, words: list[int], offset: int, spans: list, items: set) -> None:
        follow, link, longest, k = self.follow, self.link, self.longest, self.window
        s = length = 0
        for i, w in enumerate(words, offset + 1):
            while s and w not in follow[s]:
                s = link[s]
                length = longest[s]
            if w in follow[s]:
                s = follow[s][w]
                length += 1
            if length >= k:
                items.update(self.items_at[self.windowed[s]])
                if spans and spans[-1][1] >= i - length and spans[-1][0] <= i - length:
                    spans[-1] = spans[-1][0], i
                else:
                    spans.append((i - length, i))
            t = self.short_up[s]
            while t > 0:
                for size, item in self.whole_at[t]:
                    if size <= length:
                        items.add(item)
                        spans.append((i - size, i))
                t = self.short_up[link[t]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out
