"""Search for metric weights: the components of a case do not depend on the
weights, so a grid or a population is one join with a table of components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.config import Weights

#: First and last value of each axis; the step is added up in floating point.
AXES = (("tree_edit", 0.1, 0.5), ("token_similarity", 0.1, 0.5), ("structural", 0.1, 0.4), ("signature", 0.05, 0.3))
STEP, MAX_OFF = 0.05, 0.01
_SCORE = "CASE WHEN exact THEN 1.0D ELSE tree_edit * tree + token_similarity * tok + structural_w * structural + signature_w * sig END"


def axis(first: float, last: float, step: float = STEP) -> list[float]:
    out, x = [], first
    while x <= last:
        out.append(x)
        x += step
    return out


def weight_grid(spark: SparkSession) -> DataFrame:
    """All grid points whose weights sum to 1 within 0.01, with their order."""
    grid = spark.range(1, numPartitions=1)
    for name, first, last in AXES:
        grid = grid.select("*", F.posexplode(F.array(*map(F.lit, axis(first, last)))).alias(f"i_{name}", name))
    total = sum((F.col(n) for n, *_ in AXES), F.lit(0.0))
    order = F.expr("((i_tree_edit * 100 + i_token_similarity) * 100 + i_structural) * 100 + i_signature").cast("long")
    return grid.withColumn("ord", order).filter(F.abs(total - 1) <= MAX_OFF).select("ord", *(n for n, *_ in AXES))


def evaluate(weights: DataFrame, components: DataFrame) -> DataFrame:
    """ord, weights, score (1 - mean absolute error) of every weight vector over
    all cases (tree, tok, structural, sig, exact, expected)."""
    w = weights.withColumnRenamed("structural", "structural_w").withColumnRenamed("signature", "signature_w")
    cases = F.broadcast(components.select("expected", "tree", "tok", "structural", "sig", "exact"))  # the ten labelled cases
    error = F.abs(F.expr(_SCORE) - F.col("expected"))
    out = w.crossJoin(cases).groupBy("ord", "tree_edit", "token_similarity", "structural_w", "signature_w").agg((1 - F.avg(error)).alias("score"))
    return out.withColumnRenamed("structural_w", "structural").withColumnRenamed("signature_w", "signature")


def grid_search(spark: SparkSession, components: DataFrame) -> DataFrame:
    """The best grid point; the first in order wins a tie."""
    return evaluate(weight_grid(spark), components).orderBy(F.desc("score"), "ord").limit(1)


def baseline(spark: SparkSession, components: DataFrame, weights: Weights = Weights()) -> DataFrame:
    row = [(0, weights.tree_edit, weights.token_similarity, weights.structural, weights.signature)]
    return evaluate(spark.createDataFrame(row, "ord long, tree_edit double, token_similarity double, structural double, signature double"), components)


def best_method(runs: dict[str, DataFrame]) -> DataFrame:
    """The row of the greatest score among methods in order; a later method must be strictly better."""
    out = None
    for i, (name, rows) in enumerate(runs.items()):
        rows = rows.select(F.lit(i).alias("priority"), F.lit(name).alias("method"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("score"), "priority").limit(1).drop("priority")


def notable_generations(history: list[dict], every: int = 10) -> list[dict]:
    """Each tenth generation of a search, and the last."""
    return [h for i, h in enumerate(history) if h["generation"] % every == 0 or i == len(history) - 1]


def top_individuals(evaluated: DataFrame, k: int = 5) -> DataFrame:
    """The best weight vectors of :func:`evaluate`; ties in order."""
    return evaluated.orderBy(F.desc("score"), "ord").limit(k)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum()


def genetic_search(spark: SparkSession, components: DataFrame, size: int = 50, generations: int = 100, mutation: float = 0.1, crossover: float = 0.8, elite: int = 5, seed: int = 42) -> tuple[Weights, float, list[dict]]:
    """Best weights, their score and a history row a generation.

    Elites are copied; others come from tournaments of three, convex crossover
    and Gaussian mutation that widens with age. Stops after 20 generations
    without gain; counts as converged after 10. One Spark job a generation.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    low, wide = np.array([0.1, 0.1, 0.1, 0.05]), np.array([0.4, 0.4, 0.3, 0.25])
    people = [_normal(low + wide * rng.random(4)) for _ in range(size)]
    ages, history, best, stale = [0] * size, [], (-1.0, None), 0
    schema = "ord long, tree_edit double, token_similarity double, structural double, signature double"

    def fitness(group: list[np.ndarray]) -> list[float]:
        rows = evaluate(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(group)], schema), components)
        return [r.score for r in rows.orderBy("ord").collect()]  # one row an individual

    fit = fitness(people)
    for generation in range(generations):
        order = sorted(range(size), key=lambda i: -fit[i])
        people, fit, ages = [people[i] for i in order], [fit[i] for i in order], [ages[i] for i in order]
        x = np.array(people)
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        history.append({"generation": generation, "best": fit[0], "mean": float(np.mean(fit)), "worst": fit[-1], "diversity": float(far[np.triu_indices(size, 1)].mean())})
        gained = fit[0] > best[0] + 1e-6
        stale = 0 if gained else stale + 1
        if fit[0] > best[0]:
            best = (fit[0], people[0])
        if stale >= 20 or generation == generations - 1:
            break

        def pick() -> int:
            return min(rng.integers(0, size, 3))  # sorted by fitness

        young = []
        while len(young) < size - elite:
            a, b = pick(), pick()
            child = _normal((mixed := rng.random()) * people[a] + (1 - mixed) * people[b]) if rng.random() < crossover else people[a if rng.random() < 0.5 else b].copy()
            if rng.random() < mutation:
                hit = rng.random(4) < 0.3
                child = _normal(np.maximum(0.01, child + hit * rng.normal(0, 0.05 * (1 + 0.1 * ages[a]), 4)))
            young.append(child)
        people = people[:elite] + young
        ages = [x + 1 for x in ages[:elite]] + [0] * len(young)
        fit = fit[:elite] + fitness(young)
    return Weights(*map(float, best[1])), best[0], history


def converged(history: list[dict], over: int = 10) -> bool:
    return len(history) > over and history[-1]["best"] - history[-1 - over]["best"] <= 1e-6
