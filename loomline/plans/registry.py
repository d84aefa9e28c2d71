"""Named queries over the reference workload, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.config import Options
from loomline.functions import metrics as M
from loomline.operators import graph, search, stats
from loomline.operators.pairs import candidate_counts, component_estimates, score_pairs
from loomline.plans.cases import CASES, case_results
from loomline.plans.units import TURNS_SQL, pairs_sql, turns
from loomline.plans.gofiles import GO_FEATURES_SQL, GO_FILES, GO_FUNCTIONS_SQL
from loomline.sources.scan import codebase_files, ignored, parse_counts, parse_functions, with_lengths

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: A scan's threshold, that of codebase statistics, and their cap on functions: the defaults.
OPTIONS, STATISTICS, MAX_FUNCTIONS = Options(), Options(threshold=0.7), 1000
PAIRS_SQL, STATISTICS_SQL = pairs_sql(0.8), pairs_sql(0.7)
PATTERNS = ("vendor/", "*.html", "index")


def _named(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def _score(name: str = "similarity") -> list:
    """Scores are short decimals, many of them half-way between six digits."""
    return _r(name, digits=12)


def _pairs(spark: SparkSession, sf_dir: str, options: Options = OPTIONS, **more) -> DataFrame:
    return score_pairs(turns(spark, sf_dir), options, **more)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as cases: expected from the labels, actual from the size."""
    docs = _documents(spark, sf_dir).select("doc_id", "n_chars", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("idx"), ((F.col("quality") + 1 - F.col("toxic")) / 2.0).alias("expected"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("actual"), F.col("lang").alias("category"))


CASES_SQL = """cases AS (
  SELECT l.doc_id AS idx, (quality + 1 - toxic) / 2.0::DOUBLE AS expected, least(1.0::DOUBLE, n_chars / 4000.0::DOUBLE) AS actual, lang AS category
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
m AS (SELECT *, abs(actual - expected) AS error, (actual - expected) * (actual - expected) AS squared FROM cases)"""


@_named("""SELECT doc_id, substr(sha256('[' || source || ' ' || coalesce(lang, '') || ' lines:1-' || n || ' count:' || n || ' stmts:' || w || ']'), 1, 16) AS hash
FROM (SELECT *, len(string_split(text, chr(10))) AS n, len(string_split(text, ' ')) AS w FROM documents)""")
def q_hash_identity(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumn("n", F.size(F.split("text", "\n"))).withColumn("w", F.size(F.split("text", " ")))
    return d.select("doc_id", M.identity_hash(F.col("source"), F.coalesce("lang", F.lit("")), F.lit(1), F.col("n"), F.col("n"), F.col("w")).alias("hash"))


@_named(f"WITH {TURNS_SQL} SELECT ord, token_str, CAST(strlen(token_str) AS BIGINT) AS tok_len, CAST(line_count AS BIGINT) AS line_count FROM units")
def q_tokens_norm(spark, sf_dir):
    return turns(spark, sf_dir).select("ord", "token_str", F.col("tok_len").cast("long").alias("tok_len"), F.col("line_count").cast("long").alias("line_count"))


@_named(f"""WITH {TURNS_SQL} SELECT least(a.role, b.role) AS role1, greatest(a.role, b.role) AS role2, CAST(count(*) AS BIGINT) AS n FROM units a JOIN units b ON a.ord < b.ord
WHERE abs(strlen(a.signature) - strlen(b.signature)) <= 50 AND greatest(a.line_count, b.line_count) <= 3 * least(a.line_count, b.line_count) GROUP BY 1, 2""")
def q_pair_candidates(spark, sf_dir):
    return candidate_counts(turns(spark, sf_dir), OPTIONS).select(F.col("least").alias("role1"), F.col("greatest").alias("role2"), F.col("n").cast("long").alias("n"))


@_named(f"WITH {PAIRS_SQL} SELECT ord1, ord2, round(similarity, 12) AS similarity, category FROM pairs")
def q_pair_scores(spark, sf_dir):
    return _pairs(spark, sf_dir).select("ord1", "ord2", *_score(), "category")


@_named(f"WITH {PAIRS_SQL} SELECT ord1, ord2, file1, file2, round(similarity, 12) AS similarity FROM pairs WHERE file1 <> file2")
def q_cross_file_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, cross_file=True).select("ord1", "ord2", "file1", "file2", *_score())


GROUPS_SQL = f"""WITH RECURSIVE {PAIRS_SQL},
e AS (SELECT ord1 AS u, ord2 AS v FROM pairs UNION SELECT ord2, ord1 FROM pairs),
reach AS (SELECT u, u AS v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
label AS (SELECT u, min(v) AS group_key FROM reach GROUP BY u),
groups AS (SELECT group_key, CAST(count(*) AS BIGINT) AS n_members FROM label GROUP BY 1),
matched AS (SELECT group_key, CAST(count(*) AS BIGINT) AS n_matches, max(similarity) AS best FROM pairs JOIN label ON ord1 = u GROUP BY 1)"""


@_named(GROUPS_SQL + " SELECT g.group_key, n_members, n_matches, round(best, 12) AS best FROM groups g JOIN matched m ON g.group_key = m.group_key")
def q_dup_groups(spark, sf_dir):
    return graph.groups(_pairs(spark, sf_dir).cache(), "ord1", "ord2").select("group_key", "n_members", "n_matches", *_score("best"))


@_named(GROUPS_SQL + " SELECT CAST(count(*) AS BIGINT) AS duplications FROM label")
def q_dup_count(spark, sf_dir):
    return graph.components(_pairs(spark, sf_dir), "ord1", "ord2").agg(F.count(F.lit(1)).alias("duplications"))


@_named(GROUPS_SQL + " SELECT (SELECT CAST(count(*) AS BIGINT) FROM units) AS total_functions, (SELECT CAST(count(*) AS BIGINT) FROM groups) AS similar_groups, (SELECT CAST(count(*) AS BIGINT) FROM label) AS total_duplications")
def q_report_summary(spark, sf_dir):
    nodes = graph.components(_pairs(spark, sf_dir), "ord1", "ord2")
    n = turns(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_functions"))
    return n.crossJoin(F.broadcast(nodes.agg(F.countDistinct("group_key").alias("similar_groups"), F.count(F.lit(1)).alias("total_duplications"))))


@_named(f"WITH {TURNS_SQL}, z AS (SELECT strlen(token_str) AS x FROM units) SELECT CASE WHEN x >= 100 THEN 'XLarge' WHEN x >= 30 THEN 'Large' WHEN x >= 10 THEN 'Medium' ELSE 'Small' END AS band, CAST(count(*) AS BIGINT) AS n FROM z GROUP BY 1")
def q_size_hist(spark, sf_dir):
    return stats.histogram(turns(spark, sf_dir), "tok_len", stats.SIZE_BANDS)


@_named(f"WITH {TURNS_SQL} SELECT CASE WHEN x >= 15 THEN 'Very High' WHEN x >= 7 THEN 'High' WHEN x >= 3 THEN 'Medium' ELSE 'Low' END AS band, CAST(count(*) AS BIGINT) AS n FROM (SELECT len(stmt_kinds) AS x FROM units) GROUP BY 1")
def q_complexity_hist(spark, sf_dir):
    return stats.histogram(turns(spark, sf_dir), "complexity", stats.COMPLEXITY_BANDS)


@_named(f"WITH {STATISTICS_SQL} SELECT CASE WHEN similarity >= 0.9 THEN 'Very High (0.9+)' WHEN similarity >= 0.8 THEN 'High (0.8-0.9)' WHEN similarity >= 0.7 THEN 'Medium (0.7-0.8)' ELSE 'Low (0.6-0.7)' END AS band, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY 1")
def q_sim_hist(spark, sf_dir):
    return stats.histogram(_pairs(spark, sf_dir, STATISTICS), "similarity", stats.SIMILARITY_BANDS)


PACKAGE_SQL = f"""WITH {STATISTICS_SQL}, side AS (SELECT role1 AS package, ord1, ord2, similarity FROM pairs UNION ALL SELECT role2, ord1, ord2, similarity FROM pairs WHERE role1 <> role2)"""


@_named(PACKAGE_SQL + """, n AS (SELECT role AS package, CAST(count(*) AS BIGINT) AS n_functions, avg(len(stmt_kinds)) AS c FROM units GROUP BY 1), p AS (SELECT package, CAST(count(*) AS BIGINT) AS n_pairs, avg(similarity) AS s FROM side GROUP BY 1)
SELECT n.package, n_functions, round(c, 6) AS avg_complexity, coalesce(n_pairs, 0) AS n_pairs, round(coalesce(s, 0.0), 6) AS avg_similarity, round(coalesce(n_pairs, 0) / CAST(n_functions AS DOUBLE), 6) AS duplication_ratio FROM n LEFT JOIN p ON n.package = p.package""")
def q_package_stats(spark, sf_dir):
    out = stats.package_stats(turns(spark, sf_dir), _pairs(spark, sf_dir, STATISTICS))
    return out.select("package", "n_functions", *_r("avg_complexity"), "n_pairs", *_r("avg_similarity", "duplication_ratio"))


@_named(PACKAGE_SQL + " SELECT package, rank, ord1, ord2, round(similarity, 12) AS similarity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY package ORDER BY similarity DESC, ord1, ord2) AS BIGINT) AS rank FROM side) WHERE rank <= 5")
def q_package_topk(spark, sf_dir):
    units = turns(spark, sf_dir).select("ord", "role")
    p = _pairs(spark, sf_dir, STATISTICS).join(units.select(F.col("ord").alias("ord1"), F.col("role").alias("r1")), "ord1").join(units.select(F.col("ord").alias("ord2"), F.col("role").alias("r2")), "ord2")
    p = p.withColumn("package", F.explode(F.array_distinct(F.array("r1", "r2"))))
    return stats.top_pairs(p, "package").select("package", F.col("rank").cast("long").alias("rank"), "ord1", "ord2", *_score())


@_named(f"WITH {STATISTICS_SQL} SELECT CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(*) FILTER (similarity >= 0.8) AS BIGINT) AS high, CAST(count(*) FILTER (similarity >= 0.6 AND similarity < 0.8) AS BIGINT) AS medium, CAST(count(*) FILTER (category IN ('near-duplicate', 'refactoring-candidate')) AS BIGINT) AS candidates, coalesce(round(count(*) FILTER (similarity >= 0.8) * 100.0::DOUBLE / nullif(count(*), 0), 6), 0.0) AS duplication_percent FROM pairs")
def q_dup_metrics(spark, sf_dir):
    return stats.duplication_metrics(_pairs(spark, sf_dir, STATISTICS)).select("n_pairs", "high", "medium", "candidates", *_r("duplication_percent"))


@_named(f"WITH {PAIRS_SQL} SELECT ord1, ord2, round(similarity, 12) AS similarity FROM pairs ORDER BY pairs.similarity DESC, ord1, ord2 LIMIT 10")
def q_topk_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).orderBy(F.desc("similarity"), "ord1", "ord2").limit(10).select("ord1", "ord2", *_score())


@_named("WITH " + STATISTICS_SQL.replace("FROM conversations WHERE text IS NOT NULL)", "FROM (SELECT * FROM conversations WHERE text IS NOT NULL ORDER BY conv_id * 1000 + turn LIMIT 1000))") + " SELECT ord1, ord2, round(similarity, 12) AS similarity FROM pairs")
def q_limit_then_pair(spark, sf_dir):
    """The cap on functions of a codebase: the first units, then pairs."""
    return score_pairs(turns(spark, sf_dir).orderBy("ord").limit(MAX_FUNCTIONS), STATISTICS).select("ord1", "ord2", *_score())


@_named("""SELECT page_id, url, (starts_with(regexp_extract(url, '([^/]*)$', 1), '.') OR contains(url, '/vendor/') OR contains(url, '/bin/') OR contains(url, '/build/') OR contains(url, '/dist/') OR contains(url, '/target/') OR contains(url, '/.git/')
OR contains(url, '\\vendor\\') OR contains(url, '\\bin\\') OR contains(url, '\\build\\') OR contains(url, '\\dist\\') OR contains(url, '\\target\\') OR contains(url, '\\.git\\')
OR contains(url, 'vendor/') OR ends_with(url, '.html') OR contains(url, '*.html') OR contains(url, 'index')) AS ignored FROM pages""")
def q_ignore_paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", ignored(F.col("url"), PATTERNS).alias("ignored"))


@_named(f"WITH {CASES_SQL} SELECT round(avg(error), 6) AS mae, round(avg(squared), 6) AS mse, round(sqrt(avg(squared)), 6) AS rmse, round(1 - sum(squared) / (var_pop(expected) * count(*)), 6) AS r2, round(1 - avg(error), 6) AS score FROM m")
def q_error_metrics(spark, sf_dir):
    return stats.error_metrics(_cases(spark, sf_dir)).select(*_r("mae", "mse", "rmse", "r2", "score"))


@_named(f"WITH {CASES_SQL} SELECT round(covar_pop(expected, actual) / sqrt(var_pop(expected) * var_pop(actual)), 6) AS pearson_r FROM m")
def q_pearson(spark, sf_dir):
    return stats.pearson(_cases(spark, sf_dir)).select(*_r("pearson_r"))


@_named(f"WITH {CASES_SQL}, r AS (SELECT rank() OVER (ORDER BY expected) + (count(*) OVER (PARTITION BY expected) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2.0::DOUBLE AS ry FROM m) SELECT round(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*)::DOUBLE - 1)), 6) AS spearman_rho FROM r")
def q_spearman(spark, sf_dir):
    return stats.spearman(_cases(spark, sf_dir)).select(*_r("spearman_rho"))


@_named(f"WITH {CASES_SQL} SELECT idx, rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2.0::DOUBLE AS rank FROM m")
def q_average_rank(spark, sf_dir):
    return stats.ranked(_cases(spark, sf_dir), "actual", "rank").select("idx", "rank")


@_named(f"WITH {CASES_SQL}, c AS (SELECT count(*) FILTER (actual >= 0.7 AND expected >= 0.7)::DOUBLE AS tp, count(*) FILTER (actual >= 0.7 AND expected < 0.7)::DOUBLE AS fp, count(*) FILTER (actual < 0.7 AND expected >= 0.7)::DOUBLE AS fn, count(*) FILTER (actual < 0.7 AND expected < 0.7)::DOUBLE AS tn FROM m) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS \"precision\", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c")
def q_classification(spark, sf_dir):
    return stats.classification(_cases(spark, sf_dir)).select("tp", "fp", "fn", "tn", *_r("precision", "recall", "f1", "accuracy"))


@_named(f"WITH {CASES_SQL}, z AS (SELECT avg(error) AS mu, stddev_pop(error) AS s FROM m) SELECT round(any_value(mu), 6) AS mean, round(quantile_cont(error, 0.5), 6) AS median, round(any_value(s), 6) AS sd, round(avg(((error - mu) / s) ** 3), 6) AS skewness, round(avg(((error - mu) / s) ** 4) - 3, 6) AS kurtosis, round(quantile_cont(error, 0.25), 6) AS q25, round(quantile_cont(error, 0.75), 6) AS q75, round(quantile_cont(error, 0.75) - quantile_cont(error, 0.25), 6) AS iqr FROM m, z")
def q_distribution(spark, sf_dir):
    return stats.distribution(_cases(spark, sf_dir)).select(*_r("mean", "median", "sd", "skewness", "kurtosis", "q25", "q75", "iqr"))


@_named(f"WITH {CASES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY error DESC, idx) AS wr, row_number() OVER (PARTITION BY category ORDER BY error, idx) AS br FROM m) SELECT category, CAST(count(*) AS BIGINT) AS n, round(avg(error), 6) AS mean_error, round(quantile_cont(error, 0.5), 6) AS median_error, round(stddev_pop(error), 6) AS sd_error, round(avg(expected), 6) AS mean_expected, round(avg(actual), 6) AS mean_actual, max(idx) FILTER (wr = 1) AS worst_idx, max(idx) FILTER (br = 1) AS best_idx FROM w GROUP BY category")
def q_category_stats(spark, sf_dir):
    return stats.category_stats(_cases(spark, sf_dir)).select("category", "n", *_r("mean_error", "median_error", "sd_error", "mean_expected", "mean_actual"), "worst_idx", "best_idx")


@_named(f"WITH {CASES_SQL}, r AS (SELECT * FROM (VALUES (0.0, 0.3), (0.3, 0.7), (0.7, 1.0)) t(lo, hi)), p AS (SELECT lo, count(*) AS n, var_pop(actual) AS v FROM m JOIN r ON expected >= lo AND expected <= hi GROUP BY lo HAVING count(*) >= 2) SELECT round(coalesce(1 / (1 + sum(v * n) / sum(n)), 0.5), 6) AS consistency FROM p")
def q_consistency(spark, sf_dir):
    return stats.consistency(_cases(spark, sf_dir)).select(*_r("consistency"))


@_named(f"WITH {CASES_SQL} SELECT round(coalesce(avg(CASE WHEN x.actual > y.actual OR (x.actual = y.actual AND x.idx < y.idx) THEN 1.0 ELSE 0.0 END), 0.5), 6) AS discrimination FROM m x JOIN m y ON x.expected > y.expected")
def q_discrimination(spark, sf_dir):
    return stats.discrimination(_cases(spark, sf_dir)).select(*_r("discrimination"))


@_named(f"WITH {CASES_SQL}, c AS (SELECT abs(covar_pop(expected, actual) / sqrt(var_pop(expected) * var_pop(actual))) / (1 + var_pop(error)) AS x FROM m) SELECT round(x, 6) AS robustness FROM c")
def q_robustness(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    v = stats.measured(cases).agg(F.var_pop("error").alias("v"))
    return stats.pearson(cases).crossJoin(F.broadcast(v)).select(F.round(stats.robustness(F.col("pearson_r"), F.col("v")), 6).alias("robustness"))


#: By hand, for the cases that are not alike but for names and literals: the structural part. Statement kinds agree (3, 4), two of three do
#: (5), or numbers of statements and signatures differ (6).
_STRUCTURAL = {3: "1.0", 4: "1.0", 5: "2 / 3.0", 6: "0.5 * 0.3"}


def _cases_sql() -> str:
    """The cases' scores from their source: tokens by a pattern, signatures by their text, Levenshtein by DuckDB."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(c)}, {e}, {quoted(x)}, {quoted(y)}, {_STRUCTURAL.get(i, 'NULL')}::DOUBLE)" for i, (n, x, y, e, c) in enumerate(CASES))
    token = r"""'"(?:[^"\\]|\\.)*"|[A-Za-z_][A-Za-z0-9_]*|[0-9][0-9.]*|<-|:=|[-+*/]=|==|!=|<=|>=|&&|\|\||\+\+|--|\n|[^\s]'"""
    words = lambda x: "(" + ", ".join(f"'{w}'" for w in x.split()) + ")"
    keywords = words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
    types = words("bool byte complex64 complex128 float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr")
    ends = words("break continue fallthrough return ) ] } ++ --")

    def side(k: int) -> str:
        body = f"regexp_extract(s{k}, '(?s)(?:^|\\n)(func .*)$', 1)"
        t = f"(regexp_extract_all({body}, {token}) || [chr(10)])"
        text = f"""list_transform(list_filter({t}, lambda x, i: x <> chr(10) OR ({t}[i - 1] IN {ends} OR (regexp_matches({t}[i - 1], '^[A-Za-z0-9_"]') AND {t}[i - 1] NOT IN {keywords}))),
          lambda x: CASE WHEN x IN {keywords} OR x IN {types} THEN x WHEN regexp_matches(x, '^[A-Za-z_]') THEN 'IDENT' WHEN regexp_matches(x, '^[0-9]') THEN 'NUMBER' WHEN regexp_matches(x, '^"') THEN 'STRING' ELSE x END)"""
        sig = f"regexp_replace(regexp_extract({body}, '^(func [^\\n]*) \\{{', 1), '^func (\\([^)]*\\) )?[A-Za-z_][A-Za-z0-9_]*', 'func')"
        return f"array_to_string({text}, ' ') AS t{k}, {sig} AS g{k}"

    return f"""raw AS (SELECT * FROM (VALUES {rows}) v(idx, case_name, category, e, s1, s2, st)),
texts AS (SELECT *, {side(1)}, {side(2)} FROM raw),
cases AS (SELECT CAST(idx AS INTEGER) AS idx, case_name, category, CAST(e AS DOUBLE) AS expected, st,
  1 - levenshtein(t1, t2) / CAST(greatest(strlen(t1), strlen(t2)) AS DOUBLE) AS tok,
  CASE WHEN g1 = g2 THEN 1.0 ELSE 1 - abs(strlen(g1) - strlen(g2)) / CAST(greatest(strlen(g1), strlen(g2)) AS DOUBLE) END AS sg FROM texts),
told AS (SELECT *, CASE WHEN st IS NULL THEN 1.0 ELSE 0.3 + 0.3 * tok + 0.25 * st + 0.15 * sg END AS actual FROM cases)"""


_CASES = _cases_sql()


@_named(f"WITH {_CASES} SELECT idx, case_name, category, expected, round(actual, 6) AS actual FROM told")
def q_labelled_cases(spark, sf_dir):
    return case_results(spark).select("idx", "case_name", "category", "expected", *_r("actual"))


def _grid_sql(step: float = search.STEP) -> str:
    axes = ", ".join(f"a{i} AS (SELECT * FROM (VALUES {', '.join(f'({k}, {x!r}::DOUBLE)' for k, x in enumerate(search.axis(lo, hi, step)))}) t(i{i}, w{i}))" for i, (_, lo, hi) in enumerate(search.AXES))
    return f"WITH {axes}, g AS (SELECT * FROM a0, a1, a2, a3 WHERE abs(w0 + w1 + w2 + w3 - 1) <= 0.01)"


@_named(_grid_sql() + " SELECT round(w0, 6) AS tree_edit, round(w1, 6) AS token_similarity, round(w2, 6) AS structural, round(w3, 6) AS signature FROM g")
def q_weight_grid(spark, sf_dir):
    return search.weight_grid(spark).select(*_r("tree_edit", "token_similarity", "structural", "signature"))


_GRID_SCORES = _grid_sql().replace("WITH ", f"WITH {_CASES}, ") + ", s AS (SELECT i0, i1, i2, i3, w0, w1, w2, w3, 1 - avg(abs(CASE WHEN st IS NULL THEN 1.0 ELSE w0 + w1 * tok + w2 * st + w3 * sg END - expected)) AS score FROM g, cases GROUP BY ALL)"
_GRID_BEST = "SELECT round(w0, 6) AS tree_edit, round(w1, 6) AS token_similarity, round(w2, 6) AS structural, round(w3, 6) AS signature, round(score, 6) AS score FROM s ORDER BY s.score DESC, i0, i1, i2, i3 LIMIT 1"


@_named(f"{_GRID_SCORES} {_GRID_BEST}")
def q_grid_search(spark, sf_dir):
    return search.grid_search(spark, case_results(spark)).select(*_r("tree_edit", "token_similarity", "structural", "signature", "score"))


@_named(f"WITH {_CASES} SELECT round(1 - avg(abs(actual - expected)), 6) AS score FROM told")
def q_baseline(spark, sf_dir):
    return search.baseline(spark, case_results(spark)).select(*_r("score"))


@_named()
def q_genetic(spark, sf_dir):
    """The history of a genetic search; SQL has no such loop."""
    components = case_results(spark).cache()
    _, _, history = search.genetic_search(spark, components, size=30, generations=50, elite=3)
    return spark.createDataFrame([(h["generation"], h["best"], h["mean"], h["worst"], h["diversity"]) for h in history], "generation int, best double, mean double, worst double, diversity double")


@_named(f"WITH {TURNS_SQL}, c AS (SELECT count(*) AS n FROM units) SELECT CAST(n AS BIGINT) AS n_functions, CAST(n * (n - 1) / 2 AS BIGINT) AS comparisons, 0.0::DOUBLE AS mean_seconds, 0::BIGINT AS memory, 0.0::DOUBLE AS hit_rate, 1.0::DOUBLE AS efficiency FROM c")
def q_performance(spark, sf_dir):
    return stats.comparisons(turns(spark, sf_dir))


@_named(PACKAGE_SQL + """, n AS (SELECT role AS package, CAST(count(*) AS BIGINT) AS n_functions FROM units GROUP BY 1), p AS (SELECT package, CAST(count(*) AS BIGINT) AS n_pairs FROM side GROUP BY 1), t AS (SELECT n.package, n_functions, coalesce(n_pairs, 0) AS n_pairs FROM n LEFT JOIN p ON n.package = p.package)
SELECT CAST(count(*) AS BIGINT) AS codebases, CAST(sum(n_functions) AS BIGINT) AS n_functions, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, round(coalesce(sum(n_pairs) * 100.0::DOUBLE / nullif(sum(n_functions), 0), 0), 6) AS average_duplication FROM t""")
def q_overall_summary(spark, sf_dir):
    """Each role as a codebase."""
    per = stats.package_stats(turns(spark, sf_dir), _pairs(spark, sf_dir, STATISTICS))
    return stats.overall_summary(per).select("codebases", "n_functions", "n_pairs", *_r("average_duplication"))


@_named(PACKAGE_SQL + """, n AS (SELECT role AS package, CAST(count(*) AS BIGINT) AS n_functions FROM units GROUP BY 1), p AS (SELECT package, CAST(count(*) AS BIGINT) AS n_pairs FROM side GROUP BY 1)
SELECT n.package, round(coalesce(n_pairs, 0) / CAST(n_functions AS DOUBLE), 6) AS duplication_ratio FROM n LEFT JOIN p ON n.package = p.package ORDER BY coalesce(n_pairs, 0) / CAST(n_functions AS DOUBLE) DESC, n.package LIMIT 5""")
def q_top_packages(spark, sf_dir):
    return stats.top_packages(stats.package_stats(turns(spark, sf_dir), _pairs(spark, sf_dir, STATISTICS))).select("package", *_r("duplication_ratio"))


@_named(f"WITH {CASES_SQL} SELECT idx, category, round(expected, 6) AS expected, round(actual, 6) AS actual, round(error, 6) AS error FROM m ORDER BY m.error DESC, idx LIMIT 5")
def q_worst_cases(spark, sf_dir):
    return stats.worst_cases(_cases(spark, sf_dir)).select("idx", "category", *_r("expected", "actual", "error"))


@_named(f"WITH {PAIRS_SQL} SELECT ord1, ord2, round(similarity, 12) AS similarity, round(similarity * 0.3, 12) AS tree_est, round(similarity * 0.3, 12) AS tok_est, round(similarity * 0.25, 12) AS structural_est, round(similarity * 0.15, 12) AS sig_est, 1.0::DOUBLE AS tree, round(CASE WHEN exact THEN 1.0 ELSE tok END, 12) AS tok, round(structural, 12) AS structural, round(sig, 12) AS sig FROM pairs")
def q_component_estimates(spark, sf_dir):
    got = component_estimates(_pairs(spark, sf_dir), OPTIONS)
    return got.select("ord1", "ord2", *_r("similarity", "tree_est", "tok_est", "structural_est", "sig_est", "tree", "tok", "structural", "sig", digits=12))


@_named(f"{_GRID_SCORES}, found AS ({_GRID_BEST}), base AS (SELECT 0.3::DOUBLE AS tree_edit, 0.3::DOUBLE AS token_similarity, 0.25::DOUBLE AS structural, 0.15::DOUBLE AS signature, round(1 - avg(abs(actual - expected)), 6) AS score FROM told), every AS (SELECT 0 AS priority, 'baseline' AS method, * FROM base UNION ALL SELECT 1, 'grid', * FROM found) SELECT method, tree_edit, token_similarity, structural, signature, score FROM every ORDER BY score DESC, priority LIMIT 1")
def q_best_method(spark, sf_dir):
    """The better of default weights and grid search."""
    components = case_results(spark).cache()
    names = ("tree_edit", "token_similarity", "structural", "signature", "score")
    runs = {"baseline": search.baseline(spark, components), "grid": search.grid_search(spark, components)}
    return search.best_method({k: v.select(*names) for k, v in runs.items()}).select("method", *_r(*names))


def _go_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GO_FILES.items()), "path string, content string")


@_named(GO_FUNCTIONS_SQL)
def q_parse_go(spark, sf_dir):
    """Functions of a few Go files: place, size, signature, complexity."""
    return parse_functions(codebase_files(_go_files(spark))).filter("error IS NULL").select("file", "package", "name", "start_line", "end_line", "signature", "complexity", F.array_join("stmt_kinds", " ").alias("stmt_kinds"), "ret_binop")


@_named(GO_FEATURES_SQL)
def q_go_features(spark, sf_dir):
    """The features that pairs of functions are compared by."""
    return with_lengths(parse_functions(codebase_files(_go_files(spark)))).select("file", "name", "token_str", "struct_sig", "shape_sig", "hash", F.col("tok_len").cast("long").alias("tok_len"))


@_named("SELECT 6::BIGINT AS n_files, 5::BIGINT AS n_ok, 1::BIGINT AS n_failed, 7::BIGINT AS n_functions")
def q_parse_counts(spark, sf_dir):
    """Files by the codebase rules, those read and not read, functions."""
    return parse_counts(_go_files(spark))
