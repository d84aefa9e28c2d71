"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). Patterns supply tokens in passes: the first use of a document costs
nothing, each repeat costs more than the last (convex), and a document is used
at most ``max_passes`` times. Flow runs from patterns to the sources they
belong to, up to each source's quota, at least cost. Only patterns and sources
reach the driver, never documents. A pattern's flow is then taken as whole
passes over all its documents plus one partial pass over seeded documents, up
to the first that would take too much; what is still missing (or too much) is
then made up by taking or leaving the document whose size is nearest to it, one
after the other (FILLS).

Defined results: a null text has size 0 and is never short of quota; a null
source (or an empty membership) is a source of its own, last in order; documents
of size 0 take 0; ties of the seeded order go by id, then text hash, and rows
alike in both are interchangeable; an empty table gives an empty table. Only the
named columns are read, so others may have any name; a long text is counted
whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm import _text
from loomline.llm._arrow import text_slices
from loomline.llm._scratch import written

#: The most membership patterns that the driver solves for (20,000 took it 4 s); more is an error, not a cut.
MAX_PATTERNS = 20_000
#: Documents that are taken or left at most to bring a pattern's partial pass near its end.
FILLS = 4
#: Parts that a pattern's seeded order is cut into, so that only one part is sorted row by row.
PARTS = 4096


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    out = np.zeros(len(texts), np.int64)
    for a, b, buf, off in text_slices(texts):
        space = _text._SPACE[buf]
        begins = ~space
        begins[1:] &= space[:-1]
        at = off[:-1][np.diff(off) > 0]
        begins[at] = ~space[at]
        total = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
        out[a:b] = total[off[1:]] - total[off[:-1]]
    return out


def sized(docs: DataFrame, text_col: str, keep: Sequence) -> DataFrame:
    """The columns in ``keep`` with each text's number of words, as ``size``."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_t"))
    schema = rows.drop("_t").schema.add("size", "long")
    names = [f.name for f in schema][:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(word_counts(text))], names=[*names, "size"])

    return rows.mapInArrow(count, schema)


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5.0, 2.0, 1.0), cap: float = 3.0) -> dict[str | None, float]:
    """What each source is to give of the sum of all sizes, by weight; a source
    stops at ``cap`` times its size and the rest is shared again. Sources by
    code point, null last, take the weights in turn."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * per > cap * sizes[s]]
        if not over:
            out |= {s: weight[s] * per for s in open_}
            break
        for s in over:
            out[s] = cap * float(sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return {s: out[s] for s in order}


def route(patterns: Sequence[tuple[tuple, int]], quota: dict, costs: Sequence[int] = (0, 1, 3)) -> list[dict]:
    """Min-cost flow of whole tokens from (members, tokens) patterns to source quotas.

    Pass p over a pattern has the pattern's tokens as capacity and ``costs[p]``
    a token, ascending. Only the first edge of an augmenting path costs
    anything, so cheapest paths come pass by pass: for each cost the passes
    open and the flow is augmented to its maximum by blocking flows (Dinic).
    Returns each pattern's flow by source.
    """
    sources = sorted({s for members, _ in patterns for s in members}, key=lambda s: (s is None, s or ""))
    n_p, n_s = len(patterns), len(sources)
    at = {s: n_p + j for j, s in enumerate(sources)}
    start, end, n = n_p + n_s, n_p + n_s + 1, n_p + n_s + 2
    graph: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[int] = []

    def edge(u: int, v: int, c: int) -> int:
        graph[u].append(len(to))
        graph[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((c, 0))
        return len(to) - 2

    supply = [edge(start, i, 0) for i in range(n_p)]
    used = [{s: edge(i, at[s], tokens * len(costs)) for s in dict.fromkeys(members)} for i, (members, tokens) in enumerate(patterns)]
    for s in sources:
        edge(at[s], end, int(round(quota.get(s, 0))))
    for _ in sorted(costs):
        for e, (_, tokens) in zip(supply, patterns, strict=True):
            cap[e] += tokens
        while True:
            level = [-1] * n
            level[start] = 0
            waiting = deque([start])
            while waiting:
                u = waiting.popleft()
                for e in graph[u]:
                    if cap[e] > 0 and level[to[e]] < 0:
                        level[to[e]] = level[u] + 1
                        waiting.append(to[e])
            if level[end] < 0:
                break
            after = [0] * n
            path: list[int] = []
            u = start
            while True:
                if u == end:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    full = next(i for i, e in enumerate(path) if cap[e] == 0)
                    u = to[path[full] ^ 1]
                    del path[full:]
                    continue
                while after[u] < len(graph[u]):
                    e = graph[u][after[u]]
                    if cap[e] > 0 and level[to[e]] == level[u] + 1:
                        break
                    after[u] += 1
                if after[u] < len(graph[u]):
                    path.append(graph[u][after[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    after[u] += 1
                else:
                    break
    return [{s: cap[e ^ 1] for s, e in by.items()} for by in used]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members_col: str = "source", weights: Sequence[float] = (5.0, 2.0, 1.0), cap: float = 3.0, costs: Sequence[int] = (0, 1, 3), seed: int = 17) -> DataFrame:
    """Per document: id, row_key, members, size, taken (words the mix takes, repeats
    counted), source_size and target (sums over its sources).

    ``members_col`` is a source name or an array of them.
    """
    kind = docs.schema[members_col].dataType.typeName()
    members = F.expr(f"array_sort(array_distinct(`{members_col}`))") if kind == "array" else F.array(F.col(members_col).cast("string"))
    members = F.when(F.size(members) > 0, members).otherwise(F.array(F.lit(None).cast("string")))
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = [F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), t).alias("row_key"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("draw"), members.alias("members")]
    spark = docs.sparkSession
    # n tells rows alike in all else apart; it holds once the table is written
    table = written(sized(docs, text_col, keep).withColumn("n", F.monotonically_increasing_id()), "mixture-sizes")
    part = F.expr(f"cast(shiftrightunsigned(draw, {64 - (PARTS - 1).bit_length()}) AS int)")
    # a hot source is combined before it is shuffled; its order is cut into parts
    by_part = table.groupBy("members", part.alias("part")).agg(F.sum("size").alias("tokens"))
    patterns = [(tuple(r.members), int(r.tokens)) for r in by_part.groupBy("members").agg(F.sum("tokens").alias("tokens")).orderBy("members").limit(MAX_PATTERNS + 1).collect()]
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sizes: dict = {}
    for names, tokens in patterns:
        for s in names:
            sizes[s] = sizes.get(s, 0) + tokens
    share = sum(tokens for _, tokens in patterns)
    quota = targets(sizes, weights, cap) if all(len(names) < 2 for names, _ in patterns) else _overlapping(sizes, share, weights, cap)
    flows = route(patterns, quota, costs)
    plan = []
    for (names, tokens), flow in zip(patterns, flows, strict=True):
        want = sum(flow.values())
        passes = min(len(costs), want // tokens) if tokens else 0
        plan.append((list(names), passes, want - passes * tokens, sum(sizes[s] for s in names), float(sum(quota[s] for s in names))))
    plan = spark.createDataFrame(plan, "members array<string>, passes long, rest long, source_size long, target double")

    order = Window.partitionBy("members").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = by_part.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0))).join(F.broadcast(plan), "members").filter("rest > 0 AND before <= rest AND before + tokens > rest")
    cut = cut.groupBy("members").agg(F.max(F.struct("part", "before")).alias("cut")).select(F.col("members").alias("cut_members"), "cut.part", "cut.before")
    rows = table.withColumn("part", part).join(F.broadcast(plan), "members").join(F.broadcast(cut.withColumnRenamed("part", "cut_part")), F.col("members") == F.col("cut_members"), "left").drop("cut_members")
    # only the part in which the quota ends is summed row by row
    inside = Window.partitionBy("members").orderBy("draw", "id", "row_key", "n")
    last = rows.filter("part = cut_part").withColumn("upto", F.col("before") + F.sum("size").over(inside))
    last = last.withColumn("extra", F.expr("CASE WHEN upto <= rest THEN size ELSE 0 END")).drop("upto")
    other = rows.filter("part <> cut_part OR cut_part IS NULL").withColumn("extra", F.expr("CASE WHEN rest > 0 AND (cut_part IS NULL OR part < cut_part) THEN size ELSE 0 END"))
    out = written(last.unionByName(other), "mixture-passes")
    near = F.struct(F.abs(F.col("gap") - F.col("move")).alias("off"), "draw", "id", "row_key", "n")
    chosen = spark.createDataFrame([], "n long, fill long")
    for _ in range(FILLS):
        now = out.join(F.broadcast(chosen), "n", "left").withColumn("extra", F.coalesce("fill", "extra"))
        gaps = now.groupBy("members").agg((F.first("rest") - F.sum("extra")).alias("gap")).filter("gap <> 0")
        free = now.filter("fill IS NULL AND size > 0 AND rest > 0").join(F.broadcast(gaps), "members")
        free = free.withColumn("move", F.expr("CASE WHEN extra = 0 THEN size ELSE -size END")).filter("abs(gap - move) < abs(gap)")
        # a row a pattern: at most MAX_PATTERNS
        more = free.groupBy("members").agg(F.min_by(F.struct("n", F.greatest("move", F.lit(0)).alias("fill")), near).alias("x")).select("x.n", F.col("x.fill").cast("long").alias("fill"))
        chosen = chosen.unionByName(written(more, "mixture-fills"))
    out = out.join(F.broadcast(chosen), "n", "left").withColumn("extra", F.coalesce("fill", "extra"))
    return out.select("id", "row_key", "members", "size", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"), "source_size", "target")


def _overlapping(sizes: dict, share: int, weights: Sequence[float], cap: float) -> dict:
    """Targets of overlapping sources: they share the sum of all documents once."""
    total = sum(sizes.values())
    scaled = targets(sizes, weights, cap)
    return {s: x * share / total if total else 0.0 for s, x in scaled.items()}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: mix() of all documents."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
