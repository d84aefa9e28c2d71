import pytest
from pyspark.sql import functions as F

from loomline import config
from loomline.operators import graph, report, stats
from loomline.operators.pairs import score_pairs
from loomline.plans.cases import case_results
from loomline.sources.scan import ignored, parse_functions, with_lengths

TWO = "package p\nfunc %s(%s string, n int) string {\n\tif %s == \"\" {\n\t\treturn \"x\"\n\t}\n\tif n > 3 {\n\t\treturn \"y\"\n\t}\n\treturn %s\n}\n"


def test_labelled_cases(spark):
    rows = case_results(spark).orderBy("idx").collect()
    want = [1, 1, 1, 0.995385, 0.978957, 0.832397, 0.603186, 1, 1, 1]
    assert [round(r.actual, 6) for r in rows] == want
    assert round(1 - sum(abs(r.actual - r.expected) for r in rows) / 10, 6) == 0.794008
    cases = case_results(spark)
    assert round(stats.spearman(cases).first()[0], 6) == 0.896970
    assert round(stats.discrimination(cases).first()[0], 6) == 0.878049
    assert round(stats.consistency(cases).first()[0], 6) == 0.998635


def test_report_of_two_alike(spark):
    files = [("a.go", TWO % ("One", "s", "s", "s")), ("b.go", TWO % ("Two", "text", "text", "text")), ("c.go", "package p\nfunc {")]
    parsed = parse_functions(spark.createDataFrame(files, "path string, content string"))
    assert parsed.filter("error IS NOT NULL").count() == 1
    got = report.report(with_lengths(parsed))
    assert got["summary"] == {"similar_groups": 1, "total_duplications": 2, "total_functions": 2}
    assert got["similar_groups"][0]["similarity_score"] == 1.0
    assert '"total_functions": 2' in report.render(got) and "total_functions: 2" in report.render(got, "yaml")


def test_blocking_loses_no_pair(spark):
    rows = [(i, f"f{i % 3}", f"h{i}", f"n{i}", "s" * (i % 60), i % 60, "x", "w" * (i * 7 % 50), i * 7 % 50, ["a"] * (i % 3), [0, 1, 3, 243, 729][i % 5], True, False) for i in range(60)]
    units = spark.createDataFrame(rows, "ord long, file string, hash string, norm_hash string, signature string, sig_len int, struct_sig string, token_str string, tok_len int, stmt_kinds array<string>, line_count int, has_body boolean, ret_binop boolean")
    from loomline.plans.cases import scored

    a, b = (units.select(*(F.col(c).alias(p + c) for c in units.columns)) for p in ("a_", "b_"))
    brute = scored(a.join(b, F.col("a_ord") < F.col("b_ord"))).filter("actual >= 0.8")
    want = {(r.a_ord, r.b_ord, round(r.actual, 9)) for r in brute.collect()}
    got = {(r.ord1, r.ord2, round(r.similarity, 9)) for r in score_pairs(units, threshold=0.8).collect()}
    assert got == want and want


def test_components_and_empty(spark):
    edges = spark.createDataFrame([("1", "2"), ("3", "2"), ("8", "9"), ("5", "5")], "src string, dst string")
    assert {(r.node, r.group_key) for r in graph.components(edges).collect()} == {("1", "1"), ("2", "1"), ("3", "1"), ("8", "8"), ("9", "8")}
    assert graph.components(edges.limit(0)).count() == 0


def test_ignore_rules(spark):
    paths = {"some/vendor/x.go": True, "vendor/x.go": True, ".hidden": True, "main.go": False, "a/main_test.go": True, "a/.git/config": True}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", ignored(F.col("p"), ["vendor/", "*_test.go"]).alias("x"))
    assert {r.p: r.x for r in rows.collect()} == paths


def test_config(tmp_path):
    options = config.Options().override(threshold=0, min_lines=7, format="")
    assert (options.threshold, options.min_lines, options.format) == (0.8, 7, "json")
    config.save(options, str(tmp_path / "c.yaml"))
    assert config.load(str(tmp_path / "c.yaml")) == options and config.load(str(tmp_path / "no.yaml")) == config.Options()
    with pytest.raises(ValueError):
        config.Options(threshold=1.5).validate()
