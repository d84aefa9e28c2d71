"""Many packs: the number of blocks that they exchange, and buckets solved in several parts."""

import random

from test_odd_rows import kept_bytes, table

from loomline.llm import _packs, suffix_dedup
from loomline.session import ship_package

R = random.Random(5)


def test_blocks_of_many_packs(spark, monkeypatch):
    """With a bucket a pack there were nearly as many blocks as the square of the packs."""
    ship_package(spark)
    monkeypatch.setattr(_packs, "PACK", 4000)
    monkeypatch.setattr(suffix_dedup, "PART", 1500, raising=False)
    count, written = {}, suffix_dedup.written

    def counted(df, name):
        out = written(df, name)
        count[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "written", counted)
    line = ["".join(R.choices("abcdefgh é", k=R.randint(60, 400))) for _ in range(300)]
    rows = [(i, "".join(R.choice(line) if R.random() < 0.7 else "".join(R.choices("xyz", k=70)) for _ in range(R.randint(5, 20))), "a") for i in range(150)]
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_spans(table(spark, rows)).collect())
    assert got == kept_bytes(rows)
    packs = count["settled-packs"]
    assert packs >= 80 and packs < count["least-documents"] <= packs * packs / 2


def test_buckets_grow_with_packs_but_are_fewer():
    for n in (400, 5000, 100_000):
        assert n / 8 <= 1 << suffix_dedup.bucket_bits(n) <= n / 4
