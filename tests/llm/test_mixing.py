"""Mixing against the definition: sizes, targets, caps, overlapping sources, nulls and equal rows."""

import itertools
import random

import pytest

from loomline.llm import mixing
from loomline.session import ship_package

SCHEMA = "doc_id long, text string, source string"


def wanted_targets(sizes, weights=(5, 2, 1), cap=3):
    """The rule by hand: share by weight, stop at cap times the size, share the rest again."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    done, left = {}, sum(sizes.values())
    while True:
        per = left / max(1e-300, sum(weight[s] for s in sizes if s not in done))
        over = [s for s in sizes if s not in done and per * weight[s] > cap * sizes[s]]
        if not over:
            return done | {s: per * weight[s] for s in sizes if s not in done}
        for s in over:
            done[s] = cap * sizes[s]
            left -= done[s]


def test_definition(spark):
    ship_package(spark)
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * min(400, int(r.paretovariate(1) * 8))), r.choice(["a", "a", "a", "b", "c", "d", "é", None])) for i in range(400)]
    rows += [(None, "x y z", "a"), (7, None, "b"), (8, " \t\n ", None), (9, "same row", "c"), (9, "same row", "c"), (10, "nb\u00a0sp one", "d")]
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], SCHEMA + ", n int, size int, members int")
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len([w for w in (t or "").replace("\u00a0", "_").split()])
    want = wanted_targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for x in got:
        s = x.members[0]
        assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 and 0 <= x.taken <= 3 * x["size"]
        taken[s] = taken.get(s, 0) + x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), (s, taken[s], want[s])
    again = mixing.mix(docs.repartition(3, "doc_id")).collect()
    key = lambda x: (x.id is None, x.id, x.row_key, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_overlapping_sources(spark):
    """As many patterns as sources, yet they overlap: the mix takes what there is once."""
    ship_package(spark)
    rows = [(i, "w " * 10, ["a"]) for i in range(10)] + [(i, "w " * 10, ["b", "a", "b"]) for i in range(10, 20)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert abs(sum(x.taken for x in got) - 200) <= 10 and all(x.taken <= 30 for x in got)
    free = mixing.mix(spark.createDataFrame([(1, "w w", []), (2, "w", None)], "doc_id long, text string, source array<string>")).collect()
    assert sum(x.taken for x in free) == 3


@pytest.mark.parametrize("seed", range(30))
def test_flow_is_cheapest(seed):
    """Against all ways to split a few tokens."""
    r = random.Random(seed)
    patterns = [(m, r.randint(0, 3)) for m in (("a",), ("a", "b"), ("b", "c"))]
    quota = {s: r.randint(0, 5) for s in "abc"}
    costs = (0, 1, 3)

    def cost(n, tokens):
        return sum(c * max(0, min(tokens, n - i * tokens)) for i, c in enumerate(costs))

    best = None
    for x in itertools.product(range(6), repeat=5):
        flow = [{"a": x[0]}, {"a": x[1], "b": x[2]}, {"b": x[3], "c": x[4]}]
        if any(sum(f.values()) > 3 * t for f, (_, t) in zip(flow, patterns)) or any(sum(f.get(s, 0) for f in flow) > quota[s] for s in "abc"):
            continue
        worth = (-sum(x), sum(cost(sum(f.values()), t) for f, (_, t) in zip(flow, patterns)))
        best = worth if best is None or worth < best else best
    got = mixing.route(patterns, quota, costs)
    assert all(sum(f.get(s, 0) for f in got) <= quota[s] for s in "abc")
    assert (-sum(sum(f.values()) for f in got), sum(cost(sum(f.values()), t) for f, (_, t) in zip(got, patterns))) == best
