"""Windows of documents that are shorter than an item, or changed near an item's ends."""

import random
from collections import Counter

from loomline.llm import decontaminate

R = random.Random(11)


def words(n):
    return ["".join(R.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]


def test_shortened_item(spark):
    item = words(38)
    texts = {1: item[:-1], 2: item[2:], 3: item[:-4], 4: item[:20], 5: item}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.id: (round(r.similarity, 9), r.start, r.n_words) for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (round(33 / 34, 9), 0, 37), 2: (round(32 / 34, 9), 0, 36), 3: (round(30 / 34, 9), 0, 34), 5: (1.0, 0, 38)}


def test_changed_near_the_ends(spark):
    """One of the first or last words changed, or the first words lost, in prose: every text at similarity 0.8 is found."""
    items, docs, want = [], [], set()
    for i in range(120):
        n = R.randint(52, 59)
        item = words(n)
        at = R.choice([0, 1, 2, 3, 4, n - 1, n - 2])
        have = [*item[:at], "changed", *item[at + 1 :]] if i % 2 else item[R.randint(1, 5) :]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([*words(80), *have, *words(80)])))
        want.add((i, i))
    got = {(r.id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
    assert decontaminate.chance_missed(11, 0.8) ** decontaminate.prints_for(0.8) <= decontaminate.MISS


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_force(docs, items):
    """(id, item id) of all pairs of which any window of the item's size is similar."""
    out = set()
    for i, t in docs:
        w = (t or "").split()
        for j, u in items:
            v = (u or "").split()
            b = shingles(v)
            for start in range(max(1, len(w) - len(v) + 1)) if v and w else ():
                a = shingles(w[start : start + len(v)])
                both = sum((a & b).values())
                if both >= 0.8 * (a.total() + b.total() - both) - 1e-12:
                    out.add((i, j))
    return out


def test_recall_against_brute_force(spark):
    """Near the threshold: words replaced at both ends, inside and in runs, repeated words, items of 1 to 100 words."""
    vocabulary = words(300)
    items, docs = [], []
    for i in range(150):
        n = R.choice([1, 2, 4, 5, 6, 14, 25, 50, 100])
        item = R.choices(vocabulary, k=n)
        lost = R.randint(0, max(0, n // 9))
        have = list(item)
        for k in range(lost):
            at = R.choice([k, n - 1 - k, R.randrange(n)])
            have[at] = "x" + have[at]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([*R.choices(words(50), k=R.randint(0, 60)), *have, *words(R.randint(0, 60))])))
    items += [(900, None), (901, ""), (902, "a a a a a a a a a a b"), (3, items[4][1])]
    docs += [(900, None), (901, " "), (902, "z a a a a a a a a a a b z"), (903, "a a a a"), (None, items[7][1])]
    want = brute_force(docs, items)
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.id, r.item_id) for r in found.collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want), (want - got, got - want)
    assert {(902, 902), (3, 3), (4, 3)} <= got and len(want) > 80


def test_rows_and_clashing_columns(spark):
    item = " ".join(words(30))
    rows = [(None, item, 1, 2), (None, "clean text", 3, 4), (1, item, 5, 6), (1, "other clean text", 7, 8), (1, "other clean text", 7, 8), (2, None, 1, 1), (3, "w " * 70000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int, bad_key int")
    items = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    left = decontaminate.without_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r.text != item)
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 == decontaminate.contaminated(docs, items.limit(0)).count()
