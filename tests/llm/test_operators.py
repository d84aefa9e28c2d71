"""Small cases of every operator: nulls, empty and repeated rows, ties, empty tables, brute force."""

import hashlib
import random

import pytest

from loomline.llm import decontaminate, licenses, near_dedup, secrets, substring_dedup, suffix_dedup
from loomline.llm._license_texts import KNOWN
from loomline.session import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]
SAME = " ".join(R.choices(WORDS, k=60))
PROSE = [" ".join(R.choices(WORDS, k=80)) for _ in range(6)]
ROWS = [
    (1, PROSE[0] + " " + SAME, "en", "a", 1), (2, SAME + " " + PROSE[1], "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, PROSE[2], "en", "a", 1),
    (6, PROSE[2], "en", "a", 1), (7, "short", "en", "b", 1), (None, PROSE[3], "en", None, 1), (8, PROSE[4] + " " + PROSE[4], "en", "b", 1), (9, "é" * 70 + SAME[:80], "fr", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(ROWS, DOCS)


def test_substring_dedup(spark, docs):
    want, seen = {}, set()
    for i, t in sorted(((r[0] if r[0] is not None else 1 << 62), r[1] or "") for r in ROWS):
        w = t.split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            x = tuple(w[j : j + 20])
            if x in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(x)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(a for a, b in zip(w, gone) if not b).encode()).hexdigest())
    got = {(r.id if r.id is not None else 1 << 62): (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [64, 1])
def test_suffix_dedup(spark, docs, hot):
    rows = sorted(((r[0] if r[0] is not None else 1 << 62), (r[1] or "").encode()) for r in ROWS)
    first, want = {}, {}
    for i, t in rows:
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    for i, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        want[i] = (len(t), sum(gone), hashlib.sha256(bytes(a for a, b in zip(t, gone) if not b)).hexdigest())
    got = {(r.id if r.id is not None else 1 << 62): (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_spans(docs, hot=hot).collect()}
    assert got == want


def test_near_dedup(spark, docs):
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got[6][1] == 5 and got[3] == (0, 3) and got[4] == (0, 4) and got[1][1] == 1 and got[7] == (1, 7)
    assert near_dedup.one_of_each(docs).count() == len(ROWS) - 1
    assert near_dedup.chance_missed(32, 13, 0.85) < 1e-7


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, SAME), (2, "too short"), (3, None), (4, " ".join(WORDS[:40]))], "item_id long, text string")
    got = {(r.id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 1.0}
    assert decontaminate.without_contaminated(docs, items).count() == len(ROWS) - 2


def test_licenses(spark):
    text = "Copyright (c) 2020 Somebody\n\n" + KNOWN["MIT-untitled"].upper().replace(".", " ;")
    rows = spark.createDataFrame([(1, text), (2, None), (3, "prose"), (3, "prose")], "doc_id long, text string")
    got = sorted((r.id, r.license_id) for r in licenses.scan_licenses(rows).collect() if r.license_id)
    assert got == [(1, "MIT-untitled")]


def test_secrets(spark):
    rows = [(i, "é token=abcdefghij x", "en", f"s{i}", 1) for i in range(3)] + [(5, 'API_KEY: "zzzz9999" AKIA' + "B" * 16, "en", "s", 1), (6, None, None, None, None), (7, "token=abc", "en", "s", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r.id: [(x.kind, x.start, x.end, x.status) for x in r.findings] for r in secrets.find_secrets(frame).collect()}
    assert got[0] == [("assign", 2, 18, "example")] and got[6] == [] and got[7] == []
    assert got[5] == [("assign", 0, 18, "live"), ("access", 20, 40, "live")]
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(frame).collect()}
    assert clean[5] == '[SECRET]" [SECRET]' and clean[0] == rows[0][1] and clean[6] is None
