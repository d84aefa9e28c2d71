"""Statistics of matches and of scores against labelled cases.

Case tables have idx, expected, actual, category; ``measured`` adds the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import checkpointed

#: Bands by lower edge, first match wins; a metric at or above HIGH counts as positive.
SIZE_BANDS = ((100, "XLarge"), (30, "Large"), (10, "Medium"), (None, "Small"))
COMPLEXITY_BANDS = ((15, "Very High"), (7, "High"), (3, "Medium"), (None, "Low"))
SIMILARITY_BANDS = ((0.9, "Very High (0.9+)"), (0.8, "High (0.8-0.9)"), (0.7, "Medium (0.7-0.8)"), (0.1, "Low (0.6-0.7)"))
HIGH = 0.7


def band(value: Column, bands: tuple) -> Column:
    out = F.lit(bands[-1][1]) if bands[-1][0] is None else F.when(value >= bands[-1][0], bands[-1][1])
    for edge, name in reversed(bands[:-1]):
        out = F.when(value >= edge, name).otherwise(out)
    return out


def histogram(rows: DataFrame, value: str, bands: tuple) -> DataFrame:
    return rows.withColumn("band", band(F.col(value), bands)).filter("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def measured(cases: DataFrame) -> DataFrame:
    e, a = F.col("expected"), F.col("actual")
    return cases.withColumns({
        "error": F.abs(a - e), "squared": (a - e) * (a - e), "relative": F.when(e == 0, F.abs(a)).otherwise(F.abs(a - e) / F.abs(e)),
        "is_high": e >= HIGH, "predicted_high": a >= HIGH,
    })


def error_metrics(cases: DataFrame) -> DataFrame:
    """mae, mse, rmse, r2 (0 without variance), score (1 - mae)."""
    m = measured(cases)
    s = m.agg(F.avg("error").alias("mae"), F.avg("squared").alias("mse"), F.sum("squared").alias("res"), (F.var_pop("expected") * F.count("expected")).alias("tot"))
    return s.select("mae", "mse", F.sqrt("mse").alias("rmse"), F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(0.0).alias("r2"), (1 - F.col("mae")).alias("score"))


def pearson(cases: DataFrame) -> DataFrame:
    """r; 0 unless both columns vary."""
    x, y = F.col("expected"), F.col("actual")
    m = cases.agg(F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    return m.select(F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).otherwise(0.0).alias("pearson_r"))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column], what: Column, name: str) -> DataFrame:
    """Adds the running sum of a number over the rows of each group, in order.

    No task has a whole group: rows are dealt by ranges of (group, order), each
    range is summed by itself, and gets what the ranges before it add up to (a
    row a group and range).
    """
    dealt = checkpointed(rows.withColumn("_what", what).repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_p").agg(F.sum("_what").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    # ranges of one partition's number: as many rows as partitions, or groups if those are more
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = dealt.withColumn("_own", F.sum("_what").over(inside))
    same = F.lit(True)
    for c in (*by, "_p"):
        same = same & here[c].eqNullSafe(sums[c])
    out = here.join(sums, same)
    return out.select(*(here[c] for c in rows.columns), (F.col("_before") + F.col("_own")).alias(name))


def counted(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values of a column by group: k (their number of rows) and upto (rows up to and with the value)."""
    counts = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("k"))
    return running(counts, by, [F.col(column)], F.col("k"), "upto")


def quantiles(rows: DataFrame, column: str, names: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles of the values that are not null, a row a group.
    Values are ordered across tasks, so no buffer holds a column."""
    c = counted(rows.filter(F.col(column).isNotNull()), column, by).withColumnRenamed(column, "_v")
    n = c.groupBy(*by).agg(F.max("upto").alias("_n"))
    c = c.join(F.broadcast(n), list(by)) if by else c.crossJoin(F.broadcast(n))  # a row a group
    ends = {}
    for name, q in names.items():
        at = F.lit(q) * (F.col("_n") - 1)
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends[f"{name}_{end}"] = F.min(F.when(F.col("upto") > place, F.col("_v")))
    got = c.groupBy(*by).agg(F.first("_n").alias("_n"), *(x.alias(k) for k, x in ends.items()))
    at = lambda q: F.lit(q) * (F.col("_n") - 1)
    return got.select(*by, *((F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (at(q) - F.floor(at(q)))).alias(k) for k, q in names.items()))


def ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the 1-based rank of a column, ties averaged. Ranks come from counts
    by value, so equal values are combined before they are ordered."""
    table = counted(rows, column).select(F.col(column).alias("_v"), (F.col("upto") - (F.col("k") - 1) / 2).alias(name))
    return rows.join(table, rows[column].eqNullSafe(table["_v"])).drop("_v")


def spearman(cases: DataFrame) -> DataFrame:
    """1 - 6 sum(d^2) / (n (n^2 - 1)) on average ranks, ties or not; 0 below two rows."""
    r = ranked(ranked(cases, "expected", "rx"), "actual", "ry")
    s = r.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col("rx") - F.col("ry")) ** 2).alias("d2"))
    return s.select(F.when(F.col("n") < 2, 0.0).otherwise(1 - 6 * F.col("d2") / F.nullif(F.col("n") * (F.col("n") * F.col("n") - 1), F.lit(0.0))).alias("spearman_rho"))


def classification(cases: DataFrame) -> DataFrame:
    """tp, fp, fn, tn at 0.7; precision, recall, f1, accuracy, 0 where undefined."""
    m = measured(cases)
    p, t = F.col("predicted_high"), F.col("is_high")
    c = m.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    ratio = lambda x, y: F.coalesce(F.try_divide(F.col(x) if isinstance(x, str) else x, y), F.lit(0.0))
    c = c.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def distribution(cases: DataFrame) -> DataFrame:
    """Moments and quartiles of the error; population moments, 0 without variance."""
    m = measured(cases)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = m.agg(zero(F.avg("error")).alias("mean"), zero(F.stddev_pop("error")).alias("sd"), zero(F.skewness("error")).alias("skewness"), zero(F.kurtosis("error")).alias("kurtosis"))
    q = quantiles(m, "error", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return d.crossJoin(F.broadcast(q)).select("mean", zero(F.col("median")).alias("median"), "sd", "skewness", "kurtosis", zero(F.col("q25")).alias("q25"), zero(F.col("q75")).alias("q75")).withColumn("iqr", F.col("q75") - F.col("q25"))


def category_stats(cases: DataFrame) -> DataFrame:
    m = measured(cases)
    first = -F.col("idx")
    out = m.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("sd_error"), F.avg("expected").alias("mean_expected"), F.avg("actual").alias("mean_actual"),
        F.max_by("idx", F.struct("error", first)).alias("worst_idx"), F.min_by("idx", F.struct("error", "idx")).alias("best_idx"),
    )
    q = quantiles(m.withColumn("_category", F.coalesce(F.col("category"), F.lit("\0"))), "error", {"median_error": 0.5}, ["_category"])
    return out.join(q, F.coalesce(out["category"], F.lit("\0")) == q["_category"]).drop("_category")


def consistency(cases: DataFrame) -> DataFrame:
    """1 / (1 + size-weighted variance of actual values in three closed ranges of
    expected values); a row on a boundary counts in both; 0.5 if no range has two rows."""
    ranges = F.array(*(F.struct(F.lit(x).alias("lo"), F.lit(y).alias("hi")) for x, y in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.0))))
    per = measured(cases).withColumn("r", F.explode(ranges)).filter("expected >= r.lo AND expected <= r.hi").groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.var_pop("actual").alias("v")).filter("n >= 2")
    return per.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).select(F.coalesce(1 / (1 + F.col("v")), F.lit(0.5)).alias("consistency"))


def discrimination(cases: DataFrame) -> DataFrame:
    """Of pairs with different expected values the share that is in the right
    order; a tie of actual values is right if the earlier row expects more.
    0.5 without pairs.

    No pair is made. Rows are numbered by expected value; two numbers differ
    first in one bit, so each pair belongs to one (bit, what is above it), where
    the row with the bit set expects more. In order of the actual value (ties:
    later rows first) a running count of the rows without the bit is the number
    of pairs in the right order of each row with it: n log n rows in all.
    """
    rows = cases.select("idx", "expected", "actual")
    number = counted(rows, "expected").select(F.col("expected").alias("_v"), "k", (F.col("upto") - F.col("k")).alias("e"))
    n = number.agg(F.sum("k").alias("n"), F.sum(F.expr("k * (k - 1.0D) / 2")).alias("same"))
    bits = max(1, int(n.first()["n"] or 0).bit_length())
    each = rows.join(number, rows["expected"].eqNullSafe(number["_v"])).select("idx", "actual", "e", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    each = each.select("idx", "actual", "bit", F.expr("shiftright(e, bit + 1)").alias("above"), F.expr("shiftright(e, bit) & 1").alias("set"))
    got = running(each, ["bit", "above"], [F.col("actual"), F.col("idx").desc()], F.lit(1) - F.col("set"), "below")
    right = got.filter("set = 1").agg(F.sum("below").alias("right"))
    every = n.select(F.expr("n * (n - 1.0D) / 2 - same").alias("every"))
    return every.crossJoin(F.broadcast(right)).select(F.coalesce(F.try_divide(F.coalesce("right", F.lit(0)).cast("double"), F.col("every")), F.lit(0.5)).alias("discrimination"))


def package_stats(units: DataFrame, pairs: DataFrame, package: str = "package") -> DataFrame:
    """Per package: functions, mean complexity, mean pair score, pairs a function; a pair counts once in each package of its sides."""
    n = units.groupBy(package).agg(F.count(F.lit(1)).alias("n_functions"), F.avg("complexity").alias("avg_complexity"))
    side = units.select("ord", F.col(package).alias("p"))
    of = pairs.join(side.select(F.col("ord").alias("ord1"), F.col("p").alias("p1")), "ord1").join(side.select(F.col("ord").alias("ord2"), F.col("p").alias("p2")), "ord2")
    per = of.withColumn(package, F.explode(F.array_distinct(F.array("p1", "p2")))).groupBy(package).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("similarity").alias("avg_similarity"))
    out = n.join(per, package, "left").fillna(0, ["n_pairs"]).fillna(0.0, ["avg_similarity"])
    return out.withColumn("duplication_ratio", F.col("n_pairs") / F.col("n_functions"))


def top_pairs(pairs: DataFrame, by: str, k: int = 5) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("similarity"), "ord1", "ord2")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def duplication_metrics(pairs: DataFrame) -> DataFrame:
    s = F.col("similarity")
    m = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.6) & (s < 0.8)).alias("medium"), F.count_if(F.col("category").isin("near-duplicate", "refactoring-candidate")).alias("candidates"))
    return m.withColumn("duplication_percent", F.coalesce(F.try_divide(F.col("high") * 100.0, F.col("n_pairs")), F.lit(0.0)))


def top_packages(packages: DataFrame, k: int = 5) -> DataFrame:
    """The packages of :func:`package_stats` with the greatest duplication ratio; ties by name."""
    return packages.orderBy(F.desc("duplication_ratio"), "package").limit(k)


def worst_cases(cases: DataFrame, k: int = 5) -> DataFrame:
    """The cases with the greatest error; ties by index."""
    return measured(cases).orderBy(F.desc("error"), "idx").limit(k)


def comparisons(units: DataFrame, seconds: float = 0.0) -> DataFrame:
    """Performance metrics of one scan: comparisons n (n - 1) / 2, mean seconds
    a comparison; memory, hit rate and efficiency are not measured (0, 0, 1)."""
    n = units.agg(F.count(F.lit(1)).alias("n_functions"))
    c = F.expr("n_functions * (n_functions - 1) div 2")
    return n.select("n_functions", c.alias("comparisons"), F.coalesce(F.try_divide(F.lit(seconds), c), F.lit(0.0)).alias("mean_seconds"), F.lit(0).cast("long").alias("memory"), F.lit(0.0).alias("hit_rate"), F.lit(1.0).alias("efficiency"))


def overall_summary(codebases: DataFrame) -> DataFrame:
    """Totals over codebases (name, n_functions, n_pairs); average duplication is pairs a function in percent."""
    t = codebases.agg(F.count(F.lit(1)).alias("codebases"), F.coalesce(F.sum("n_functions"), F.lit(0)).alias("n_functions"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))
    return t.withColumn("average_duplication", F.coalesce(F.try_divide(F.col("n_pairs") * 100.0, F.col("n_functions")), F.lit(0.0)))


def robustness(r: Column, error_variance: Column) -> Column:
    return F.abs(r) / (1 + error_variance)
