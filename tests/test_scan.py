"""A scan from files to a report; globs; threshold 0; statistics against plain Python."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomline import scan
from loomline.config import Options, Weights
from loomline.operators import report, search, stats
from loomline.operators.pairs import all_classes, candidate_counts, component_estimates, score_pairs
from loomline.plans.gofiles import GO_FILES
from loomline.sources.scan import glob_regex, parse_counts, parse_functions

ALIKE = "package p\n\nfunc %s(%s string) int {\n\tn := 0\n\tfor _, c := range %s {\n\t\tn += int(c)\n\t}\n\treturn n\n}\n"


def test_scan(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    code = tmp_path / "code"
    for name, text in {"a.go": ALIKE % ("A", "s", "s"), "sub/b.go": ALIKE % ("B", "text", "text"), "skip.go": ALIKE % ("C", "x", "x"), "vendor/v.go": ALIKE % ("D", "x", "x"), "bad.go": "package p\nfunc {"}.items():
        (code / name).parent.mkdir(parents=True, exist_ok=True)
        (code / name).write_text(text)
    (tmp_path / ".similarityignore").write_text("# comment\n\nskip.go\n")
    out = tmp_path / "report.json"
    assert scan.main([str(code), str(tmp_path / "missing"), "--output", str(out), "--threshold", "0", "--progress"], spark) == 0
    got = json.loads(out.read_text())
    assert got["summary"] == {"similar_groups": 1, "total_duplications": 2, "total_functions": 2}
    assert [f["function"] for f in got["similar_groups"][0]["functions"]] == ["A", "B"]
    assert scan.main([str(code / "skip.go"), "--format", "yaml"], spark) == 0
    assert "similar_groups: null" in capsys.readouterr().out
    assert scan.main([str(code), "--format", "xml"], spark) == 2
    assert scan.codebase_functions(spark, str(code)).count() == 3


def test_source_text_and_counts(spark):
    files = spark.createDataFrame(list(GO_FILES.items()), "path string, content string")
    rows = parse_functions(files).filter("error IS NULL").collect()
    assert all(r.source in GO_FILES[r.file] and r.source.startswith("func") and r.source.endswith("}") and r.source.count("\n") + 1 == r.line_count for r in rows)
    assert tuple(parse_counts(files).first()) == (6, 5, 1, 7)


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    ("*.go", "a.go", "a.gox"), ("[^a]b", "cb", "ab"), ("[a-c]x", "bx", "dx"), ("\\*a", "*a", "ba"), ("a?c", "abc", "ac"), ("[\\]]", "]", "["), ("a.b", "a.b", "axb"), ("[^\\-x]", "a", "-"),
])
def test_globs(pattern, yes, no):
    regex = glob_regex(pattern).replace("\\x{", "\\U{")
    regex = re.sub(r"\\U\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), regex)
    assert re.fullmatch(regex, yes) and not re.fullmatch(regex, no)


def test_malformed_globs():
    assert [glob_regex(p) for p in ("[", "[]", "a\\", "[b-a]", "[-x]")] == [None] * 5


def units_of(spark, n=40):
    rows = [(i, f"f{i % 3}", f"h{i // 2}", f"n{i % 17}", "s" * (i % 70), i % 70, "x" if i % 3 else "y", "w" * (i * 7 % 50), i * 7 % 50, ["a"] * (i % 8), [0, 1, 3, 243, 729][i % 5], True, False) for i in range(n)]
    return spark.createDataFrame(rows, "ord long, file string, hash string, norm_hash string, signature string, sig_len int, struct_sig string, token_str string, tok_len int, stmt_kinds array<string>, line_count int, has_body boolean, ret_binop boolean")


def test_threshold_zero_and_strategy(spark):
    """At 0 every pair matches, rejected ones with score 0; the strategies agree above."""
    units = units_of(spark)
    every = score_pairs(units, Options(), threshold=0).collect()
    assert len(every) == 40 * 39 // 2 and min(r.similarity for r in every) == 0
    some = {(r.ord1, r.ord2, r.similarity) for r in score_pairs(units, threshold=0.6).collect()}
    assert some == {(r.ord1, r.ord2, r.similarity) for r in every if r.similarity >= 0.6}
    assert some == {(r.ord1, r.ord2, r.similarity) for r in score_pairs(units, threshold=0.6, strategy=all_classes).filter("similarity >= 0.6").collect()}
    assert sum(r.n for r in candidate_counts(units, Options()).collect()) > len(some)
    assert component_estimates(score_pairs(units, threshold=0.6)).filter("abs(tree_est - 0.3 * similarity) > 1e-12").count() == 0
    assert score_pairs(units.limit(0), threshold=0.6).count() == 0


def test_statistics_against_python(spark):
    r = random.Random(6)
    rows = [(i, r.choice([0.0, 0.25, 0.5, 1.0, r.random()]), r.choice([0.0, 0.5, 1.0, r.random()]), r.choice(["a", "b", None])) for i in range(200)]
    cases = spark.createDataFrame(rows, "idx long, expected double, actual double, category string")
    pairs = [(x, y) for x, y in itertools.permutations(rows, 2) if x[1] > y[1]]
    right = sum(x[2] > y[2] or x[2] == y[2] and x[0] < y[0] for x, y in pairs)
    assert abs(stats.discrimination(cases).first()[0] - right / len(pairs)) < 1e-12
    assert stats.discrimination(cases.limit(0)).first()[0] == 0.5 == stats.discrimination(cases.limit(1)).first()[0]
    errors = sorted(abs(a - e) for _, e, a, _ in rows)
    q = stats.quantiles(stats.measured(cases), "error", {"m": 0.5, "q": 0.25, "top": 1.0}).first()
    assert abs(q.m - (errors[99] + errors[100]) / 2) < 1e-12 and abs(q.q - (errors[49] * 0.25 + errors[50] * 0.75)) < 1e-12 and q.top == errors[-1]
    per = {x.category: x.median_error for x in stats.category_stats(cases).collect()}
    for c in ("a", "b", None):
        own = sorted(abs(a - e) for _, e, a, x in rows if x == c)
        assert abs(per[c] - (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2) < 1e-12
    ranks = {x.idx: x["rank"] for x in stats.ranked(cases, "actual", "rank").collect()}
    for i, _, a, _ in rows:
        assert ranks[i] == sum(y[2] < a for y in rows) + (sum(y[2] == a for y in rows) + 1) / 2
    assert [x.idx for x in stats.worst_cases(cases, 3).collect()] == [x[0] for x in sorted(rows, key=lambda x: (-abs(x[1] - x[2]), x[0]))[:3]]
    assert stats.distribution(cases.limit(0)).first()["median"] == 0.0


def test_summaries_and_reports(spark):
    books = spark.createDataFrame([("x", 10, 5), ("y", 30, 15)], "name string, n_functions long, n_pairs long")
    assert tuple(stats.overall_summary(books).first()) == (2, 40, 20, 50.0)
    assert stats.overall_summary(books.limit(0)).first()["average_duplication"] == 0.0
    assert stats.comparisons(books, 3.0).first()["mean_seconds"] == 3.0
    runs = {"baseline": 0.5, "grid": 0.7, "genetic": 0.7}
    best = search.best_method({k: spark.createDataFrame([(v,)], "score double") for k, v in runs.items()}).first()
    assert best.method == "grid"
    history = [{"generation": g, "best": 1.0, "mean": 0.5, "worst": 0.1, "diversity": 0.2} for g in range(25)]
    assert [h["generation"] for h in search.notable_generations(history)] == [0, 10, 20, 24]
    weights = spark.createDataFrame([(i, 0.1 * i, 0.3, 0.2, 0.1, 0.5) for i in range(8)], "ord long, tree_edit double, token_similarity double, structural double, signature double, score double")
    assert [x.ord for x in search.top_individuals(weights).collect()] == [0, 1, 2, 3, 4]
    text = report.codebase_report(stats.overall_summary(books), books, books) + report.history_report(history[:1], Weights(), 0.9) + report.weights_update(Weights(), Weights(tree_edit=0.33))
    assert "average_duplication" in text and "generation 0" in text and "+10.0 %" in text
    assert report.validation_report(books, books, books).count("n_pairs") == 3
