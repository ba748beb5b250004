"""Maximal repeats among strings that share an anchor: an enhanced suffix array and its interval tree.

The strings are sorted by what follows the anchor; neighbouring common prefixes give, by one scan
with a stack, the tree of common-prefix intervals. An interval of depth R holds the strings that agree on R bytes from
the anchor on. Members that also agree on enough bytes before the anchor form a maximal repeat
unless one byte to the left extends it for all of them, in which case it is extended.
"""

from __future__ import annotations

from collections.abc import Iterator


def common_prefix(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo if hi - lo == 0 or a[lo] != b[lo] else hi


def prefix_intervals(strings: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last + 1) of every interval of two or more of the sorted strings."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(strings) + 1):
        depth = common_prefix(strings[i - 1], strings[i]) if i < len(strings) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(before: list[bytes], after: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(bytes after the anchor, [(string, bytes before the anchor)]) of the repeats of ``least`` bytes or more.

    ``before`` is read away from the anchor, so it is given in reverse. A string is listed with the
    most bytes that it shares with another one of the same interval.
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    for depth, lo, hi in prefix_intervals([after[i] for i in order]):
        need = max(0, least - depth)
        members = [i for i in order[lo:hi] if len(before[i]) >= need]
        members.sort(key=before.__getitem__)
        shared = [common_prefix(before[a], before[b]) for a, b in zip(members, members[1:])]
        best = [max(x, y) for x, y in zip([-1, *shared], [*shared, -1])]
        found = [(i, left) for i, left in zip(members, best) if left >= need]
        if len(found) > 1:
            yield depth, found
