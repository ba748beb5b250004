import pytest

from slipstream.llm.license_scan import Templates, licenses, notices
from slipstream.llm.license_templates import TEMPLATES

PROSE = "The weather was fine and we walked along the river until it was dark."


@pytest.fixture(scope="module")
def templates():
    return Templates()


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_template_finds_itself(templates, name):
    for text in TEMPLATES[name]:
        assert templates.match(text.encode())[0] == name and templates.match(text.encode())[2] == 0


def test_savings_rank_the_right_template_first(templates):
    block = TEMPLATES["MIT"][0].replace("Software", "Program").encode()
    assert templates.rows[templates.savings(block)[0][1]][0] == "MIT"
    assert templates.match(block)[0] == "MIT" and templates.match(block)[2] > 0


def test_versions_and_prose_are_told_apart(templates):
    assert templates.match(b"This work is licensed under the GNU General Public License, version 2.")[0] == "GPL-2.0"
    assert templates.match(b"Licensed under the Apache License, Version 3.0.") is None
    assert templates.match(b"She got her driving licence and a fishing license in the same week.") is None
    assert templates.match(PROSE.encode()) is None


def test_documents(docs_of, odd_docs, no_docs):
    mit = TEMPLATES["MIT"][0].split(" ")
    broken = "\n".join(" ".join(mit[i : i + 12]) for i in range(0, len(mit), 12))
    note = "Released under the MIT License."
    docs = docs_of([(1, f"{PROSE}\nÉté\n{note}\n{PROSE}"), (2, f"{PROSE}\n\n{broken}\n\n{PROSE}"), (3, PROSE), (4, f"{note}\nLicensed under CC BY-NC 4.0.")])
    got = {r.doc_id: r for r in licenses(docs).collect()}
    start = len(PROSE) + 5
    assert (got[1].licenses, got[1].notices) == ("MIT", f"MIT:{start}:{start + len(note)}")
    assert got[2].n_notices == 1 and got[2].notices == f"MIT:{len(PROSE) + 2}:{len(PROSE) + 2 + len(broken)}"
    assert got[3].n_notices == 0 and got[3].best_saving is None
    assert got[4].licenses == "CC-BY-NC-4.0,MIT"
    assert [r.n_notices for r in licenses(odd_docs).collect()] == [0] * odd_docs.count()
    assert licenses(no_docs).count() == 0


def test_all_notices_of_the_documents_are_found(documents):
    cues = ("Licensed under", "Released under", "is licensed under")
    want = {r.doc_id for r in documents.collect() if any(c in r.text for c in cues)}
    assert {r.doc_id for r in licenses(documents).where("n_notices > 0").collect()} == want


def test_notices_that_share_their_line_with_other_text(templates):
    mit, note = TEMPLATES["MIT"][0], "Released under the MIT License."
    gpl = "This work is licensed under the GNU General Public License, version 2."
    for text, want in (
        (f"{note} See the file COPYING in the source tree for details.", [("MIT", note)]),
        (f"Copyright 2020 Acme Inc. {note}", [("MIT", note)]),
        (f"{PROSE} {note} {PROSE} {gpl} {PROSE}", [("MIT", note), ("GPL-2.0", gpl)]),
        (f"{PROSE} {mit} {PROSE}", [("MIT", mit)]),
        (f"{PROSE} Released under\nthe MIT License. {PROSE}", [("MIT", "Released under\nthe MIT License.")]),
        (f"{gpl}\nÉté {note} {PROSE}", [("GPL-2.0", gpl), ("MIT", note)]),
    ):
        raw = text.encode()
        assert [(f[2], raw[f[0] : f[1]].decode()) for f in notices(raw, templates)] == want


def test_prose_with_cues_and_other_licences_give_no_inner_notice(templates):
    for text in (
        f"{PROSE} Licensed under the Apache License, Version 3.0. {PROSE}",
        f"{PROSE} It was released under the BSD License. {PROSE}",
        f"{PROSE} She was granted permission to use and copy the license, and the copyright notice was lost. {PROSE}",
        f"{PROSE} This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. {PROSE}",
    ):
        assert notices(text.encode(), templates) == []
