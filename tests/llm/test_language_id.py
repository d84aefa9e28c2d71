"""Language identification against its definition by hand, held-out accuracy, and odd rows."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomline.llm import language_id
from loomline.session import ship_package

R = random.Random(12)
WORDS = {
    "en": "the quick brown foxes jump over lazy dogs while children were playing with their friends near this old house".split(),
    "de": "der schnelle braune fuchs springt über den faulen hund während kinder mit ihren freunden nahe diesem alten haus spielten".split(),
    "fr": "le renard brun rapide saute par dessus les chiens paresseux pendant que des enfants jouaient près de cette vieille maison".split(),
}
ROWS = [(i, " ".join(R.choices(WORDS[x], k=R.randint(3, 60))), x) for i, x in enumerate(["en", "de", "fr"] * 40)]


def ranks(texts):
    """N-grams of one to three letters, words bounded by a blank, most frequent first, ties by code points."""
    count = Counter()
    for t in texts:
        clean = " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
        t = f" {clean} " if clean else ""
        count.update(c for c in t if c != " ")
        count.update(t[i : i + 2] for i in range(len(t) - 1))
        count.update(t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " ")
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(count, key=lambda g: (-count[g], code(g)))[: language_id.TOP]


def test_definition(spark):
    ship_package(spark)
    learned = {x: ranks([t for i, t, y in ROWS if y == x and zlib.crc32(str(i).encode()) % 5]) for x in WORDS}
    more = [(900, "½²Ⅷ ٣", "en"), (901, None, "fr"), (902, "", None), (903, "12 3!", None), (None, "the old house", "de"), (904, "𝔞𝔟 𐐨", None), (1, ROWS[1][1], "de"), (905, "le chien " * 30000, None)]
    docs = spark.createDataFrame([(*x, "s", 1) for x in ROWS + more], "doc_id long, text string, lang string, score string, draw int")
    got = language_id.identify(docs, [F.col("doc_id"), language_id.held_out("doc_id").alias("held_out"), F.col("text")]).collect()
    assert len(got) == len(ROWS) + len(more)
    right = held = 0
    for r in got:
        own = ranks([r.text or ""])
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {}
        for x, profile in learned.items():
            place = {g: i for i, g in enumerate(profile)}
            far[x] = sum(abs(place[g] - i) if g in place else language_id.TOP for i, g in enumerate(own))
        best = min(far, key=lambda x: (far[x], x))
        assert r.lang_pred == best and abs(r.score - (1 - far[best] / language_id.TOP / len(own))) < 1e-12
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id < 200:
            held += 1
            right += best == ROWS[r.doc_id][2]
    assert held > 10 and right / held >= 0.95


def test_only_allowed_rows_are_learned(spark):
    ship_package(spark)
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, t, y in ROWS] + [(None, "aa bb", "zz")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), [F.col("doc_id")]).collect()
    assert {r.lang_pred for r in got} <= {"en", "de", "fr"}


@pytest.mark.parametrize("bound", [5, 30])
def test_bound_of_training(spark, bound):
    docs = spark.createDataFrame([(i, f"text {i}", "en" if i % 7 else "de") for i in range(2000)] + [(1, "same", "en")] * 500, "doc_id long, text string, lang string")
    n = {r.lang: r["count"] for r in language_id.training_rows(docs, F.lit(True), "doc_id", "text", "lang", bound).groupBy("lang").count().collect()}
    assert n["de"] <= bound and n["en"] <= bound and n["de"] > bound / 3


def test_empty_and_clashing(spark):
    ship_package(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("lang_pred", "score", "margin", "t", "c0", "c1", "n", "_id", "draw", "a.b")})
    kept = language_id.known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert language_id.known_language(docs.limit(0)).count() == 0
    assert language_id.identify(docs.limit(0), [F.col("doc_id")]).count() == 0
    untrained = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), [F.col("doc_id")]).collect()
    assert {(r.lang_pred, r.score) for r in untrained} == {("und", 0.0)}
