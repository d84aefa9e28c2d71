"""Fingerprints are written as loops: the driver holds, rewrites and prints every plan that has them."""

import pytest
from pyspark.sql import functions as F

from loomline.llm import decontaminate as d

PRINTS = 6


def simhash(hashes):
    counts = [sum(h >> b & 1 for h in hashes) for b in range(64)]
    bits = sum(1 << b for b in range(64) if counts[b] * 2 > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


@pytest.mark.parametrize("most", [100, 1000, 1 << 17])
def test_fingerprints_equal_the_definition(spark, most):
    rows = spark.createDataFrame([([],), ([7],), ([-1, 2**62],), ([3, 3, -(2**63)],), (list(range(-40, 51)),)], "w array<long>")
    seeded = F.array(*(F.expr(f"transform(w, x -> xxhash64(x, {k}))") for k in range(PRINTS)))
    for row in rows.select(seeded.alias("h"), d.fingerprints("w", PRINTS, most).alias("p")).collect():
        assert row.p == [simhash([x & (2**64 - 1) for x in h]) for h in row.h]


def test_the_plan_is_small_whatever_the_number_of_fingerprints(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "c d e f g")], "item_id long, text string")
    size = {n: len(d._matched(docs, items, prints=n)._jdf.queryExecution().analyzed().toString()) for n in (1, PRINTS)}
    assert size[PRINTS] < 60_000
    own = {n: len(docs.select(d.fingerprints("array(doc_id)", n, 100).alias("p"))._jdf.queryExecution().analyzed().toString()) for n in (1, PRINTS)}
    assert own[PRINTS] < own[1] + 200 and own[1] < 4_000
