"""Near-dedup against brute force, with posting lists merged by prefixes."""

import random

import pytest

from loomline.llm import near_dedup
from loomline.session import ship_package


@pytest.mark.parametrize(("short", "words", "percent"), [(2, 3, 85), (32, 3, 85), (2, 5, 80)])
def test_versions_of_one_text(spark, monkeypatch, short, words, percent):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    ship_package(spark)
    r = random.Random(3)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    texts = []
    for i in range(70):
        t = list(base)
        for _ in range(i % 9):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(t))
    sets = [{tuple(t.split()[j : j + words]) for j in range(len(t.split()) - words + 1)} for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=words, percent=percent)
    assert {x.id: x.component_id for x in got.collect()} == dict(enumerate(want))


def test_shared_and_null_ids(spark):
    """Nodes are texts: a document is linked to each text of a shared or missing id."""
    ship_package(spark)
    r = random.Random(4)
    a, b = (" ".join(f"{x}{r.randrange(900)}" for _ in range(100)) for x in "ab")
    rows = [(9, a), (9, b), (20, a + " x"), (21, b + " y"), (30, a), (30, a), (None, "n " * 40), (None, a + " z"), (40, None), (40, ""), (41, "n " * 40)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, k1 int, rep int")
    got = sorted((x.id if x.id is not None else 99, x.component_id) for x in near_dedup.near_duplicates(docs, words=3, percent=85).collect())
    assert got == [(9, 9), (9, 9), (20, 9), (21, 9), (30, 9), (30, 9), (40, 40), (40, 40), (41, 41), (99, 9), (99, 41)]
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id, x.text or "") for x in kept.collect()) == sorted([(9, a), (9, b), (40, ""), (40, ""), (41, "n " * 40)])
    assert near_dedup.one_of_each(spark.createDataFrame([(1, a), (1, a)], "doc_id long, text string")).count() == 1
    empty = docs.limit(0)
    assert near_dedup.near_duplicates(empty).count() == 0 == near_dedup.one_of_each(empty).count()
