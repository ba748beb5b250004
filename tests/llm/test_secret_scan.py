import random
import string

import brute

from slipstream.llm.secret_scan import PLACEHOLDER, Efficiency, is_known, read_vocabulary, redact_secrets, secret_spans, secrets, VOCABULARY

KEY = "xK9vQ2mZr8TbW4nLp7JcYd3HsGf6Au1E"
TEXTS = [
    'api_key: "abcdefgh12345678"', "Password=short", "TOKEN = 'x.y_z-0123'", "secret:\n12345678", "AKIA" + "ABCD1234EFGH5678", "AKIA12345",
    "f" * 31 + " " + "0a" * 16, "ſecret = abcdefghij", "toKen = abcdefghij", f"say {KEY} é {KEY}", "token = token = abcdefghijk",
    "0123456789abcdef" * 3 + "XYZ", "passwd\"  =  \"aaaaaaaaa" * 3, "é" * 10 + "secret=ééé" + " secret=12345678é",
]


def test_base_spans_equal_brute_force(documents, docs_of, odd_docs):
    for docs in (documents, docs_of(list(enumerate(TEXTS))), odd_docs):
        want = sorted(((r.doc_id, *brute.base_secrets(r.text)) for r in docs.collect()), key=str)
        got = secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_random_strings_are_found_and_known_ones_left(docs_of, documents):
    got = {r.doc_id: r for r in secrets(docs_of(list(enumerate(TEXTS)))).collect()}
    assert got[9].n_random == 2 and got[9].spans == f"random:4:{4 + len(KEY)},random:{7 + len(KEY)}:{7 + 2 * len(KEY)}"
    assert sum(r.n_random for r in secrets(documents).collect()) == 0


def test_token_efficiency_tells_words_from_keys():
    e = Efficiency(read_vocabulary(VOCABULARY))
    assert e.ratio(KEY) < 2 < e.ratio("configuration-management-interface")
    for s in ("d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "someVeryLongIdentifierName", "a_long_snake_case_name", "20240101120000000000"):
        assert is_known(s)
    assert not is_known(KEY)


def test_the_stage_replaces_spans_and_keeps_the_rest(docs_of, odd_docs, no_docs):
    docs = docs_of([(1, f"a {KEY} b"), (2, "clean text"), (3, None), (4, 'x token = "abcdefgh1" y')])
    got = {r.doc_id: (r.text, r.n_chars) for r in redact_secrets(docs).collect()}
    assert got[1] == (f"a {PLACEHOLDER} b", 4 + len(PLACEHOLDER)) and got[2] == ("clean text", 10) and got[3] == (None, None)
    assert got[4][0] == f'x {PLACEHOLDER}" y'
    again = redact_secrets(odd_docs)
    assert again.columns == odd_docs.columns
    clean = "doc_id is null or doc_id <> 11"  # thirty thousand times the letter a is a hex run
    assert sorted(map(str, again.where(clean).collect())) == sorted(map(str, odd_docs.where(clean).collect()))
    assert redact_secrets(no_docs).count() == 0 and secrets(no_docs).count() == 0


def test_random_strings_of_one_case_hex_and_behind_paths():
    e = Efficiency(read_vocabulary(VOCABULARY))
    g = random.Random(1)
    found = lambda text: [(a, b) for a, k, b in secret_spans(text.encode(), e) if k == 3]
    for chars in (string.ascii_lowercase, string.ascii_uppercase, "0123456789ABCDEF", "0123456789abcdef"):
        keys = ["".join(g.choices(chars, k=24)) for _ in range(300)]
        assert sum(found(f"see {key} there") == [(4, 28)] for key in keys) >= 285
    for path in ("/account/settings/download/", "/download/2024/archive/documents/customers/"):
        keys = ["".join(g.choices(string.ascii_letters + string.digits, k=24)) for _ in range(300)]
        spans = [found(path + key) for key in keys]
        assert sum(bool(s) and s[-1][1] == len(path) + 24 for s in spans) >= 290
    assert found("key XKQZ-7291-PLMR-8834-TZWQ here") == [(4, 28)]
    upper = "D41D8CD98F00B204E9800998ECF8427E"
    assert found(f"md5 {upper}") == [] and found(f"use {upper}") == [(4, 36)]
    for text in ("configuration-management-interface", "someVeryLongIdentifierName", "a_long_snake_case_name", "20240101120000000000",
                 "/account/settings/download/123e4567-e89b-12d3-a456-426614174000", "-" * 60, "=" * 30 + "_" * 30):
        assert found(text) == [], text
