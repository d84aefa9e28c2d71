"""Nearest neighbours against brute force, with far more leaves than a query looks at."""

import numpy as np

from loomline.llm import ann
from loomline.session import ship_package


def brute(rows, queries, top):
    out = {}
    for q in queries:
        v = np.array(dict((i, x) for i, x in rows)[q])
        scores = sorted(((-float(np.dot(np.array(x), v)), i) for i, x in rows if i != q and x and len(x) == len(v)))
        out[q] = [(i, -s) for s, i in scores[:top]]
    return out


def found(frame, queries, **options):
    out = {}
    for r in sorted(ann.nearest(frame, queries, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.id, r.score))
    return out


def test_recall_and_share(spark):
    """Clustered vectors of unequal norms: recall of 0.9 and more at a few of many leaves."""
    ship_package(spark)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(80, 16)) * 4
    x = centres[rng.integers(0, 80, 6000)] + rng.normal(size=(6000, 16)) * 0.6
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, leaf int, bucket string")
    asked = list(range(0, 6000, 100))
    got = found(frame, frame.filter("vec_id % 100 = 0"), top=10, sample=3000)
    want = brute(rows, asked, 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in asked)
    assert hits / (10 * len(asked)) >= 0.9
    forest = ann.Forest(x[:3000], 4, 32, 4)
    assert forest.leaf_count > 400 and forest.leaves_for(x[:3000], 10, 0.95) < 0.3 * forest.leaf_count


def test_small_tables_are_exact(spark):
    """All leaves are seen: order, scores, ties, equal vectors, odd rows, dimensions."""
    ship_package(spark)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, size=(60, 3)).astype(float)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x) if r.any()]
    rows += [(100, [1.0, 2.0]), (120, [2.0, 2.0]), (140, [0.5, 0.5])]
    odd = [(200, None), (201, [0.0] * 3), (202, [float("nan"), 1.0, 1.0]), (203, []), (204, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]), (205, [float("inf"), 0.0, 0.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = found(frame, frame.filter("vec_id % 20 = 0 OR vec_id > 150"), top=5, recall=1.0)
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 5)
    assert got == want
    assert ann.nearest(frame.limit(0), frame).count() == 0 == ann.nearest(frame, frame.limit(0)).count()


def test_repeated_ids(spark):
    ship_package(spark)
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(frame, frame.filter("vec_id % 20 = 0"), top=5) == {20: [(2, 3.0), (1, 1.0)]}
    assert found(frame, frame.filter("vec_id = 1"), top=5) == {1: [(2, 6.0), (20, 3.0)]}
