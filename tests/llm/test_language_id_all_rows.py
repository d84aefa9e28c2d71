"""Profiles and thresholds come from all labelled documents, not from a few hundred a language."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from test_language_id import WORDS, R, ranks

from loomline.llm import language_id
from loomline.session import ship_package

SCHEMA = "doc_id long, text string, lang string"


def learned(rows):
    return [(t, x) for i, t, x in rows if x and zlib.crc32(str(i).encode()) % 5]


def told(text, profiles):
    """Language, score and margin by definition."""
    own, far = ranks([text]), {}
    for x, profile in profiles.items():
        place = {g: i for i, g in enumerate(profile)}
        far[x] = sum(abs(place[g] - i) if g in place else language_id.TOP for i, g in enumerate(own))
    best, *others = sorted(far, key=lambda x: (far[x], x))
    most = language_id.TOP * len(own)
    return best, 1 - far[best] / most, (far[others[0]] - far[best]) / most if others else 0.0


def test_profiles_of_all_documents(spark, monkeypatch):
    """Each document has letters of its own, so that any document left out changes the profile's ranks; counts are sent in parts."""
    ship_package(spark)
    monkeypatch.setattr(language_id, "SORTED", 1000, raising=False)
    rows = [(i, chr(0x4E00 + i) * (i + 3), "zh") for i in range(1000)] + [(2000 + i, " ".join(R.choices(WORDS["en"], k=20)), "en") for i in range(800)]
    profiles = {x: ranks([t for t, y in learned(rows) if y == x]) for x in ("zh", "en")}
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, SCHEMA), [F.col("doc_id")]).collect()}
    for i, t, _ in rows[600:1300:7]:
        best, score, _ = told(t, profiles)
        assert got[i].lang_pred == best and abs(got[i].score - score) < 1e-12


def test_thresholds_of_all_documents(spark):
    """One in twenty of the labelled documents is partly noise; what is kept of unlabelled ones shows the threshold."""
    ship_package(spark)

    def mixed(x, noise):
        return " ".join("".join(R.choices("abcdefghijklmnopqrstuvwxyz", k=6)) if R.random() < noise else w for w in R.choices(WORDS[x], k=25))

    rows = [(i, mixed(x, (i // 20 % 50) / 50 if i % 20 == 0 else 0), x) for i, x in enumerate(["en"] * 1600 + ["de"] * 900)]
    rows += [(5000 + i, mixed(["en", "de"][i % 2], 0.7 + i % 300 / 1000), None) for i in range(600)]
    profiles = {x: ranks([t for t, y in learned(rows) if y == x]) for x in ("en", "de")}
    sums = {x: [] for x in profiles}
    for t, x in learned(rows):
        best, score, margin = told(t, profiles)
        if best == x:
            sums[x].append(np.floor((score + margin) * 10_000) / 10_000)
    least = {x: language_id.SLACK * np.quantile(v, language_id.LOW) for x, v in sums.items()}
    want, near = set(), set()
    for i, t, _ in rows:
        best, score, margin = told(t, profiles)
        if abs(score + margin - least[best]) < 2e-4:
            near.add(i)  # a step's edge may fall either way
        elif score + margin >= least[best]:
            want.add(i)
    got = {r.doc_id for r in language_id.known_language(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got - near == want and len(near) < 60 and 0 < len(want & set(range(5000, 5600))) < 600


def test_counts_in_parts(monkeypatch):
    monkeypatch.setattr(language_id, "SORTED", 50)
    monkeypatch.setattr(language_id, "HELD", 300)
    counts, want, got = language_id.GramCounts(), {}, {}
    parts = []
    for i in range(200):
        lang, codes = ["a", "b", "c"][i % 3], np.array(R.choices(range(400), k=R.randint(0, 90)), np.int64)
        for c in codes.tolist():
            want[lang, c] = want.get((lang, c), 0) + 1
        counts.add(lang, codes)
        if counts.full():
            parts += counts.flushed()
    assert len(parts) > 3
    for batch in [*parts, *counts.flushed()]:
        assert batch.num_rows < 1000
        for r in batch.to_pylist():
            got[r["lang"], r["code"]] = got.get((r["lang"], r["code"]), 0) + r["n"]
    assert got == want
