"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (``sample`` vectors): a node splits its
vectors at the median of their projection on the difference of two of them.
Every vector is then indexed under one leaf a tree. A query goes down all trees
at once through one priority queue, ordered by how far the query is on the
wrong side of the splits passed, until it has as many leaves as it takes; the
vectors in those leaves are ranked by the exact inner product in double
precision.

How many leaves it takes is measured, not guessed: for queries from the sample,
the leaf rank at which each of their true neighbours in the sample turns up is
known, and the number of leaves is the one that reaches ``recall``. Vectors
with structure need few leaves; isotropic ones need most of them whatever the
trees, and no setting hides that.

For the largest inner product vectors are first given one more component, so
that all have the norm of the largest and order by distance is order by inner
product; longer ones than the sample's are clipped there, which only affects
where they are filed.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component take no part; an inner product needs equal dimensions, so
each dimension has a forest of its own and its vectors are candidates of each
other; of rows that share an id, the least vector is the query, and all are
candidates of others; equal vectors are filed once, with their ids in order, of
which a query can need ``top + 1``; ties go to the smaller id; an empty table
gives an empty table. Only the two named columns are read, so others may have
any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm._scratch import written

#: Vectors that the trees are fitted on, at most (a bound on what is broadcast with them).
SAMPLE = 8192
#: Vectors of the sample that the number of leaves is measured with, at most.
ASKED = 256


class Forest:
    """Random-projection trees: by tree, inner nodes as (normal, split, left, right); a negative child is leaf ``-1 - child``."""

    def __init__(self, x: np.ndarray, trees: int, leaf: int, seed: int) -> None:
        self.norm = float(np.sqrt((x * x).sum(1).max()))
        x = self.lift(x)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.normals, self.splits, self.kids, self.roots, self.leaf_count = [], [], [], [], 0
        for _ in range(trees):
            self.roots.append(self._grow(x, np.arange(len(x)), leaf, rng))
        self.normals = np.array(self.normals).reshape(len(self.splits), x.shape[1])
        self.splits = np.array(self.splits)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm**2 - (x * x).sum(1), 0.0)
        return np.concatenate((x, np.sqrt(rest)[:, None]), 1)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            for _ in range(4):
                a, b = rng.choice(rows, 2, replace=False)
                normal = x[a] - x[b]
                size = np.sqrt((normal * normal).sum())
                if size == 0:
                    continue
                normal = normal / size
                at = x[rows] @ normal
                split = float(np.median(at))
                low, high = rows[at <= split], rows[at > split]
                if len(low) and len(high):
                    node = len(self.splits)
                    self.normals.append(normal)
                    self.splits.append(split)
                    self.kids.append([0, 0])
                    self.kids[node] = [self._grow(x, low, leaf, rng), self._grow(x, high, leaf, rng)]
                    return node
        self.leaf_count += 1
        return -self.leaf_count

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        x = self.lift(x)
        kids = np.array(self.kids, np.int64).reshape(-1, 2)
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, np.int64)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = (np.einsum("ij,ij->i", x[inner], self.normals[at]) > self.splits[at]).astype(np.int64)
                node[inner] = kids[at, side]
            out[:, t] = -1 - node
        return out

    def probe(self, q: np.ndarray, leaves: int) -> list[int]:
        """The leaves nearest to a query, all trees in one queue."""
        q = np.append(q * (self.norm / np.sqrt((q * q).sum())), 0.0)
        off = self.normals @ q - self.splits if len(self.splits) else np.zeros(0)
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < leaves:
            far, node = heapq.heappop(queue)
            while node >= 0:
                d = off[node]
                near, other = (1, 0) if d > 0 else (0, 1)
                heapq.heappush(queue, (max(far, abs(d)), self.kids[node][other]))
                node = self.kids[node][near]
            found.append(-1 - node)
        return found


    def leaves_for(self, x: np.ndarray, top: int, recall: float) -> int:
        """The leaves that a query must see for this share of its ``top`` nearest, measured among the vectors x."""
        ask = x[:: max(1, len(x) // ASKED)][:ASKED]
        score = ask @ x.T
        score[np.arange(len(ask)), np.arange(0, len(x), max(1, len(x) // ASKED))[: len(ask)]] = -np.inf
        k = min(top, len(x) - 1)
        if k < 1:
            return self.leaf_count
        near = np.argpartition(-score, k - 1, 1)[:, :k]
        of, ranks = self.leaf_of(x), []
        for q, own in zip(ask, near, strict=True):
            place = np.empty(self.leaf_count, np.int64)
            order = self.probe(q, self.leaf_count)
            place[order] = np.arange(len(order))
            ranks.append(place[of[own]].min(1))
        return int(np.quantile(np.concatenate(ranks), recall, method="higher")) + 1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of doubles) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return rows.filter("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('inf')) AND exists(v, x -> x <> 0)")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20, trees: int = 4, leaf: int = 32, recall: float = 0.95, sample: int = SAMPLE, seed: int = 4) -> DataFrame:
    """Each query's ``top`` nearest vectors found, other than its own id: query_id, rank, id, score."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    out = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    for (d,) in sorted(rows.select(F.size("v")).distinct().collect()):  # a forest a dimension
        size = F.size("v") == d
        out = out.unionByName(_nearest(rows.filter(size), asked.filter(size), top, trees, leaf, recall, sample, seed))
    return out


def _nearest(rows: DataFrame, asked: DataFrame, top: int, trees: int, leaf: int, recall: float, sample: int, seed: int) -> DataFrame:
    """:func:`nearest` among vectors (id, v) of one dimension."""
    spark = rows.sparkSession
    fit = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").collect()])
    grown = Forest(fit, trees, leaf, seed)
    leaves = grown.leaves_for(fit, top, recall)
    forest = spark.sparkContext.broadcast(grown)

    # equal vectors once, with the ids that a query can need
    order = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top + 1)
    one = kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf_of = forest.value.leaf_of(_matrix(batch.column(0)))
                at = pa.array(np.repeat(np.arange(batch.num_rows), leaf_of.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf_of.ravel()), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "v", "ids"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [forest.value.probe(q, leaves) for q in _matrix(batch.column(1))]
                at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "query_id", "q"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 4
    bucket = (F.col("leaf") % parts).alias("bucket")
    index = one.select("v", "ids").mapInArrow(file, "leaf long, v array<double>, ids array<long>").select(bucket, "*")
    probes = asked.select("id", "v").mapInArrow(search, "leaf long, query_id long, q array<double>").select(bucket, "*")

    def rank(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_leaf = have.groupby("leaf").indices
        for at, own in ask.groupby("leaf").indices.items():
            if at not in by_leaf:
                continue
            x = np.stack(have["v"].iloc[by_leaf[at]].to_list())
            ids = have["ids"].iloc[by_leaf[at]].to_list()
            q = np.stack(ask["q"].iloc[own].to_list())
            rough = q @ x.T
            for query, vec, line in zip(ask["query_id"].iloc[own], q, rough, strict=True):
                line = line if len(line) <= top + 1 else np.where(line >= np.partition(line, -top - 1)[-top - 1] - 1e-9 * max(1.0, np.abs(line).max()), line, -np.inf)
                near = np.flatnonzero(line > -np.inf)
                exact = np.array([float((x[i] * vec).sum()) for i in near])
                for i, s in zip(near, exact, strict=True):
                    out.extend((query, int(v), s) for v in ids[i] if v != query)
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    scored = probes.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(rank, "query_id long, id long, score double")
    scored = scored.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0")).withColumnRenamed("id", "vec_id")
