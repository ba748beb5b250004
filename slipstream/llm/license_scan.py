"""Licence notices found by conditional compression.

Lines with a licence cue are candidate blocks. A block is compressed alone and with every template
as a raw zstandard dictionary: the more of its size a template saves, the more of its wording they
share. Templates are ranked by that saving, and all above MIN_SAVING are confirmed by the exact differences
of wording: the words of the block that differ from the best aligned part of the template, and whether
the words that tell licences apart (numbers and names) agree. A confirmed block grows over
neighbouring lines that its template explains, so that a notice over several lines is one block.

A notice may also share its line with other text, or wrap inside a paragraph. Around every cue that is in
no block yet, the words of the text are aligned with each template, and the unmatched words on both sides
are cut off. What is left is a block if it is most of the template, or LEAST_PART of its words, with the
same numbers and names.

Texts are scanned whole where they are read; nothing is shuffled. Defined cases: null and empty texts
have no notices; equal savings are ranked by name; rows that repeat are judged each; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import difflib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from slipstream.llm.common import append_columns, id_and_text
from slipstream.llm.license_templates import CUES, TEMPLATES

MIN_SAVING = 0.35
MIN_SAME_WORDS = 0.8
LEAST_PART = 12
CACHED_LINES = 50_000

_CUES = tuple(c.encode() for c in CUES)
_CUE = re.compile(b"|".join(re.escape(c) for c in _CUES))
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_WORD_BYTES = re.compile(_WORD.pattern.encode())
_NAMES = frozenset(
    "apache mit bsd isc gnu lesser affero general mozilla mpl eclipse creative commons attribution attribution-sharealike"
    " attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike"
    " attribution-noncommercial-noderivatives cc by by-sa by-nc by-nd by-nc-sa by-nc-nd cc0 unencumbered".split()
)
_FRAME_BYTES = len(zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False).compress(b""))


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        options = dict(level=19, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(**options)
        self.rows = []
        for name in sorted(templates):
            for text in templates[name]:
                raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.rows.append((name, _WORD.findall(text.lower()), zstandard.ZstdCompressor(dict_data=raw, **options)))
        self.matchers = []
        for _, words, _ in self.rows:
            m = difflib.SequenceMatcher(None, autojunk=False)
            m.set_seq2(words)
            self.matchers.append((m, set(words)))
        self.longest = max((len(words) for _, words, _ in self.rows), default=0)
        self.cache: dict[bytes, tuple] = {}

    def savings(self, block: bytes) -> list[tuple[float, int]]:
        """(share of the compressed size saved, template), the best first."""
        size = max(1, len(self.alone.compress(block)) - _FRAME_BYTES)
        saved = [(1 - (len(c.compress(block)) - _FRAME_BYTES) / size, i) for i, (_, _, c) in enumerate(self.rows)]
        return sorted(saved, key=lambda s: (-s[0], s[1]))

    def saving(self, block: bytes, i: int) -> float:
        """The share of the compressed size that one template saves."""
        size = max(1, len(self.alone.compress(block)) - _FRAME_BYTES)
        return 1 - (len(self.rows[i][2].compress(block)) - _FRAME_BYTES) / size

    def match(self, block: bytes) -> tuple[str, float, int, int] | None:
        """(licence, saving, differing words, equal words) of a block, None if no template is confirmed."""
        if block not in self.cache:
            if len(self.cache) >= CACHED_LINES:
                self.cache.clear()
            self.cache[block] = self._match(block)
        return self.cache[block]

    def _match(self, block: bytes) -> tuple[str, float, int, int] | None:
        words = _WORD.findall(block.decode().lower())
        best = None
        for saving, i in self.savings(block):
            name, template, _ = self.rows[i]
            if saving < MIN_SAVING or not words:
                break
            found = differences(words, template)
            if found is not None and (best is None or (found[0], -saving) < (best[2], -best[1])):
                best = name, round(saving, 4), *found
        return best


    def part(self, words: list[str], cue: int) -> tuple[int, int, int, int] | None:
        """(first word, end, template, differing words) of the best aligned block around the word ``cue``."""
        best = None
        for i, (_, template, _) in enumerate(self.rows):
            reach = len(template) + len(template) // 4 + 2
            lo = max(0, cue - reach)
            near = words[lo : cue + reach]
            matcher, known = self.matchers[i]
            if len(known.intersection(near)) < MIN_SAME_WORDS * min(len(known), LEAST_PART):
                continue
            matcher.set_seq1(near)
            found = aligned_part([m for m in matcher.get_matching_blocks() if m.size], near, template)
            if found is None or not lo + found[0] <= cue < lo + found[1]:
                continue
            a, b, different, same = found
            if best is None or (-same, different) < best[0]:
                best = (-same, different), (lo + a, lo + b, i, different)
        return best and best[1]


def aligned_part(parts: list, words: list[str], template: list[str]) -> tuple[int, int, int, int] | None:
    """(first word, end, differing words, equal words) of the part of ``words`` that says the template, None if none does."""
    # the stretch of matching parts with the most equal words less the words between them
    best = score = start = 0
    chosen = None
    for k, m in enumerate(parts):
        if k:
            last = parts[k - 1]
            score -= max(m.a - last.a - last.size, m.b - last.b - last.size)
        if score <= 0:
            score, start = 0, k
        score += m.size
        if score > best:
            best, chosen = score, (start, k)
    if chosen is None:
        return None
    parts = parts[chosen[0] : chosen[1] + 1]
    first, last = parts[0], parts[-1]
    end_a, end_b = last.a + last.size, last.b + last.size
    same = sum(m.size for m in parts)
    inner = max(end_a - first.a, end_b - first.b)
    if same < MIN_SAME_WORDS * inner or same < MIN_SAME_WORDS * len(template) and same < LEAST_PART:
        return None
    # words beside the part that stand where the template has others must not be other numbers or names
    whole = same >= MIN_SAME_WORDS * len(template)
    lead, tail = (min(first.a, first.b), min(len(words) - end_a, len(template) - end_b)) if whole else (0, 0)
    mine = words[first.a - lead : end_a + tail]
    aligned = template if whole else template[first.b : end_b]
    if any(w in _NAMES or any(c.isdigit() for c in w) for w in set(mine) ^ set(aligned)):
        return None
    return first.a, end_a, (end_a - first.a) + len(aligned) - 2 * same, same


def differences(words: list[str], template: list[str]) -> tuple[int, int] | None:
    """(differing words, equal words) of a block and the part of the template that it aligns with.

    None unless most words are the same and none of the differing ones is a number or version.
    """
    parts = [m for m in difflib.SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if m.size]
    if not parts:
        return None
    first, last = parts[0], parts[-1]
    end_a, end_b = last.a + last.size, last.b + last.size
    lead, tail = min(first.a, first.b), min(len(words) - end_a, len(template) - end_b)
    mine, aligned = words[first.a - lead : end_a + tail], template[first.b - lead : end_b + tail]
    same = sum(m.size for m in parts)
    if same < MIN_SAME_WORDS * max(len(words), len(aligned)) or same < min(3, len(template)):
        return None
    odd = [w for w in set(mine) ^ set(aligned) if any(c.isdigit() for c in w)]
    return None if odd else (len(words) + len(aligned) - 2 * same, same)


def notices(text: bytes, templates: Templates) -> list[tuple[int, int, str, float, int]]:
    """(start byte, end byte, licence, saving, differing words) of the blocks of a text."""
    low = text.lower()
    if not any(c in low for c in _CUES):
        return []
    lines, at = [], 0
    for line in text.split(b"\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    out, used = [], -1
    for k, (a, b) in enumerate(lines):
        if k <= used or not any(c in low[a:b] for c in _CUES):
            continue
        found, first, last = templates.match(text[a:b].strip()), k, k
        # a notice may run over several lines: take neighbours that the template explains as well
        for step in (-1, 1) if found else ():
            edge = k + step
            while used < edge < len(lines):
                lo, hi = min(first, edge), max(last, edge)
                added = len(_WORD.findall(low[lines[edge][0] : lines[edge][1]].decode()))
                wider = templates.match(text[lines[lo][0] : lines[hi][1]].replace(b"\n", b" ").strip()) if added else None
                if wider is None or wider[0] != found[0] or wider[3] - found[3] < MIN_SAME_WORDS * added:
                    break
                found, first, last = wider, lo, hi
                edge += step
        if found:
            out.append((lines[first][0], lines[last][1], *found[:3]))
            used = last
    return sorted(out + inner_notices(text, low, templates, out))


def inner_notices(text: bytes, low: bytes, templates: Templates, taken: list[tuple]) -> list[tuple[int, int, str, float, int]]:
    """The notices around cues outside of the blocks ``taken``, which are whole lines."""
    out, done, k = [], 0, 0
    spans = None
    for cue in _CUE.finditer(low):
        while k < len(taken) and taken[k][1] <= cue.start():
            done = max(done, taken[k][1])
            k += 1
        if cue.start() < done or k < len(taken) and taken[k][0] <= cue.start():
            continue
        if spans is None:
            spans = [m.span() for m in _WORD_BYTES.finditer(low)]
            ends = [b for _, b in spans]
        limit = taken[k][0] if k < len(taken) else len(low)
        at = bisect.bisect_right(ends, cue.start())
        if at == len(spans) or spans[at][0] >= limit:
            continue
        # as far as a template can reach, between the blocks before and after
        reach = 2 * templates.longest
        near = [s for s in spans[max(0, at - reach) : at + reach] if s[0] >= done and s[1] <= limit]
        words = [low[a:b].decode() for a, b in near]
        found = templates.part(words, near.index(spans[at])) if spans[at] in near else None
        if found is None:
            continue
        a, b = near[found[0]][0], near[found[1] - 1][1]
        b += text[b : b + 1] in (b".", b";") and b < limit
        saving = templates.saving(text[a:b].replace(b"\n", b" "), found[2])
        if saving >= MIN_SAVING:
            out.append((a, b, templates.rows[found[2]][0], round(saving, 4), found[3]))
            done = b
    return out


def licenses(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_notices, licenses, notices ("licence:start:end", code points), best_saving, n_differences."""

    def make():
        templates = Templates()

        def derive(texts):
            n, names, spans, savings, different = [], [], [], [], []
            for text in texts:
                found = notices(text, templates) if text else []
                n.append(len(found))
                names.append(",".join(sorted({f[2] for f in found})))
                place = lambda at: len(text[:at].decode())  # noqa: B023,E731 - called here only
                spans.append(",".join(f"{f[2]}:{place(f[0])}:{place(f[1])}" for f in found))
                savings.append(max((f[3] for f in found), default=None))
                different.append(sum(f[4] for f in found))
            return [n, names, spans, savings, different]

        return derive

    fields = [
        ("n_notices", T.LongType(), pa.int64()), ("licenses", T.StringType(), pa.string()), ("notices", T.StringType(), pa.string()),
        ("best_saving", T.DoubleType(), pa.float64()), ("n_differences", T.LongType(), pa.int64()),
    ]
    return append_columns(id_and_text(docs), make, fields).select("doc_id", *(F.col(f[0]) for f in fields))
