"""Nulls, ties, equal rows, long texts, clashing columns and empty tables for operators that other files do not cover."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import licenses, secrets, substring_dedup, suffix_dedup
from loomline.session import ship_package

CLASHING = ("pack_id", "ids", "sizes", "blob", "bucket", "id", "t", "w", "form", "repo", "owner", "base", "value_sha256", "digest")
R = random.Random(17)


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(1))
    return docs


def test_sort_of_long_common_prefixes():
    """A pair whose first difference is a byte of all ones, and random texts of few letters."""
    a, b = b"0123456789abcdef" + b"a" + "é".encode() * 20, b"0123456789abcdef" + b"<V" * 20
    order, head = suffix_dedup.deep_shallow(np.frombuffer(a + b, np.uint8), np.array([0, len(a)]), np.zeros(2, np.int64), 50)
    assert order.tolist() == [1, 0] and head.all()
    for _ in range(150):
        letters = R.choice([b"ab", b"abc", bytes(range(256)), b"\xff\x00"])
        x = bytes(R.choice(letters) for _ in range(R.randint(60, 300)))
        x += x[: len(x) // 2] + x[len(x) // 3 :]
        length = R.choice([8, 16, 20, 33, 50])
        start = np.array(sorted(R.choices(range(len(x) - length + 1), k=R.randint(2, 150))))
        group = np.array([R.randint(0, 2) for _ in start])
        order, head = suffix_dedup.deep_shallow(np.frombuffer(x, np.uint8), start, group, length)
        keys = [(group[i], x[start[i] : start[i] + length]) for i in order]
        assert keys == sorted(keys)
        assert head.tolist() == [True] + [p != q for p, q in zip(keys, keys[1:])]


def kept_bytes(rows):
    first, out = {}, []
    key = lambda i: 1 << 62 if i is None else i
    texts = [(key(i), (t or "").encode()) for i, t, _ in rows]
    for i, t in texts:
        for j in range(len(t) - 49):
            first[t[j : j + 50]] = min(i, first.get(t[j : j + 50], i))
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [64, 2])
def test_suffix_dedup_spans(spark, hot):
    ship_package(spark)
    line, long = "x" * 30 + "é" * 20 + "y" * 9, "".join(R.choices("abc", k=40000))
    rows = [(5, long, "a"), (9, long[100:30000] + "q" + long[20:900], "a"), (5, long[:200], "a"), (1, "a" * 300, "b"), (2, "a" * 120 + line, "b"), (3, line + "-" + line, None), (3, line, None), (4, None, None), (None, line + "b" * 70, "a"), (None, "b" * 70, "a"), (7, "short", "a"), (8, "", "a"), (10, "a" * 49, "b")]
    docs = table(spark, rows)
    got = sorted((1 << 62 if r.id is None else r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_spans(docs, hot=hot).collect())
    assert got == kept_bytes(rows)
    assert suffix_dedup.remove_spans(docs.limit(0)).count() == 0


def test_substring_dedup_odd_rows(spark):
    ship_package(spark)
    words = [f"w{i}" for i in range(50)]
    long = " ".join(R.choices(words, k=30000))
    rows = [(1, long, "a"), (2, "x " + long, "a"), (3, "z " * 60, "a"), (4, "z\t\n" * 25, "a"), (5, None, None), (6, " \n", "a"), (7, "nb sp " * 19, "a"), (8, "nb sp " * 20, "a")]
    docs = table(spark, rows)
    got = {r.id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[2] == (30001, 30000) and got[3] == (60, 59) and got[4] == (25, 25) and got[5] == (0, 0) == got[6] and got[7] == (19, 0) and got[8] == (20, 0)
    assert got[1][0] == 30000 and got[1][1] == 0
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def base_spans(text):
    kinds = (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(kinds) for m in re.finditer(p, text, re.A) if len(m.group(g)) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def test_secrets_by_brute_force(spark):
    parts = ["password=", "Token: ", "api_key'= \"", "hunter2x", "AKIA" + "Z" * 16, "AKIA", "0123456789abcdef01234567", "dead", " ", "é", "\n", "a/a/", "Q", "=", "ghp_" + "a1" * 12, "x" * 40, "Ab3" * 12]
    rows = [(i, "".join(R.choices(parts, k=R.randint(0, 30))), R.choice(["s", "t", "u", None])) for i in range(120)]
    rows += [(500, None, "s"), (501, "", None), (501, rows[3][1], None), (None, rows[4][1], "s"), (502, "a/" * 50000, "s"), (503, "token=abcdefgh " * 3000, "t")]
    docs = table(spark, rows)
    got = secrets.find_secrets(docs).select("id", secrets.listed("base").alias("x")).collect()
    assert sorted((str(r.id), r.x) for r in got) == sorted((str(i), ",".join(base_spans(t or ""))) for i, t, _ in rows)
    assert secrets.redact_secrets(docs).columns == docs.columns and secrets.redact_secrets(docs).count() == len(rows)
    assert secrets.find_secrets(docs.limit(0)).count() == 0 == secrets.redact_secrets(docs.limit(0)).count()


def test_owners_and_repositories(spark):
    """Two columns: a value in three repositories of one owner is live, one of three owners an example, one without any live."""
    rows = [(i, "token=liveliveliveX", f"r{i}", "o") for i in range(3)] + [(10 + i, "token=examplevalueX", "r", f"o{i}") for i in range(3)] + [(20, "token=nobodysvalueX", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    got = {r.id: r.findings[0] for r in secrets.find_secrets(docs, repo_col="repo", owner_col="owner").collect()}
    assert (got[0].status, got[0].n_repos, got[0].n_owners) == ("live", 3, 1)
    assert (got[11].status, got[11].n_repos, got[11].n_owners) == ("example", 1, 3)
    assert (got[20].status, got[20].n_repos, got[20].n_owners) == ("live", 0, 0)


def test_licenses_odd_rows(spark):
    known = {"L1": "Licence licence favour favour granted", "L2": "license license favor favor granted", "short": "one two"}
    rows = [(1, "LICENCE  licence, favour; favour granted!", "a"), (1, "LICENCE  licence, favour; favour granted!", "a"), (2, None, "a"), (3, " ", None), (4, "x " * 100000 + "licence license favour favor granted", "a"), (5, "one two", "a"), (6, "one two three", "a"), (None, "clean", "a")]
    got = sorted((str(r.id), r.license_id) for r in licenses.scan_licenses(table(spark, rows), known=known).collect())
    assert got == sorted([("1", "L1"), ("1", "L1"), ("2", None), ("3", None), ("4", "L1"), ("5", "short"), ("6", None), ("None", None)])
    assert licenses.scan_licenses(table(spark, rows).limit(0)).count() == 0
