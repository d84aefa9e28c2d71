"""The report document, text tables and the history of weights."""

from __future__ import annotations

import dataclasses
import json
import sys
import time
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.config import Options, Weights
from loomline.operators.graph import groups
from loomline.operators.pairs import score_pairs

ADVICE = "Consider extracting common logic into a shared function"


def report_groups(units: DataFrame, matches: DataFrame) -> DataFrame:
    """A row a group: score (best) and all its functions, by score, then least member."""
    found = groups(matches, "ord1", "ord2")
    each = found.select("group_key", "best", F.explode("members").alias("ord")).join(units.select("ord", "file", "name", "start_line", "end_line", "hash"), "ord")
    member = F.struct("file", F.col("name").alias("function"), "start_line", "end_line", "hash")
    return each.groupBy("group_key", "best").agg(F.array_sort(F.collect_list(member)).alias("functions"))


def report(units: DataFrame, options: Options | None = None) -> dict[str, Any]:
    """The report of one scan: it is one document, so its groups come to the driver."""
    options = options or Options()
    units = units.filter(F.col("line_count") >= options.min_lines).cache()
    matches = score_pairs(units, options).cache()
    rows = report_groups(units, matches).orderBy(F.desc("best"), "group_key").collect()
    listed = [{"id": f"group_{i + 1}", "similarity_score": r.best, "refactor_suggestion": ADVICE, "functions": [x.asDict() for x in r.functions]} for i, r in enumerate(rows)]
    return {"similar_groups": listed or None, "summary": {"similar_groups": len(rows), "total_duplications": sum(len(r.functions) for r in rows), "total_functions": units.count()}}


def render(document: dict[str, Any], form: str = "json") -> str:
    if form == "json":
        return json.dumps(document, indent=2, ensure_ascii=False) + "\n"
    if form == "yaml":
        return yaml.safe_dump(document, sort_keys=True, allow_unicode=True)
    raise ValueError(f"unknown format {form!r}")


def write(document: dict[str, Any], path: str | None = None, form: str = "json") -> None:
    """The rendered document to a file of the driver, or to standard output."""
    text = render(document, form)
    if path is None:
        sys.stdout.write(text)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def record_weights(path: str, weights: Weights, note: str = "") -> None:
    """Append to the history of weights; the last line holds."""
    if not weights.balanced():
        raise ValueError("weights must be positive and sum to 1 within 0.02")
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(dataclasses.asdict(weights) | {"at": time.strftime("%Y%m%d_%H%M%S"), "note": note}) + "\n")


def weights_history(path: str) -> list[dict[str, Any]]:
    with open(path, encoding="utf-8") as f:
        return [json.loads(x) for x in f]


def revert_weights(path: str) -> Weights:
    """Drop the last entry; the one before it holds again."""
    rows = weights_history(path)
    if len(rows) < 2:
        raise ValueError("there is nothing to go back to")
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(x) + "\n" for x in rows[:-1])
    return Weights(**{k: rows[-2][k] for k in (f.name for f in dataclasses.fields(Weights))})


def text_table(rows: DataFrame, title: str, limit: int = 10) -> str:
    """A plain-text table of the first rows of a sorted query (the limit is the report's)."""
    got = rows.limit(limit).collect()
    lines = [title, " | ".join(rows.columns)]
    return "\n".join(lines + [" | ".join(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in got]) + "\n"


def sections(*parts: str) -> str:
    """Several text tables as one report."""
    return "\n".join(parts)


def codebase_report(summary: DataFrame, packages: DataFrame, pairs: DataFrame) -> str:
    """Summary, the five packages with most duplication, the ten most similar pairs."""
    return sections(text_table(summary, "Summary"), text_table(packages, "Packages", 5), text_table(pairs, "Most similar pairs", 10))


def validation_report(metrics: DataFrame, categories: DataFrame, worst: DataFrame) -> str:
    """Error metrics, categories and the three worst cases."""
    return sections(text_table(metrics, "Errors"), text_table(categories, "Categories", 100), text_table(worst, "Worst cases", 3))


def history_report(history: list[dict], weights: Weights, score: float) -> str:
    """Every tenth generation of a search and the last, then what it found."""
    lines = [f"generation {h['generation']}: best {h['best']:.6f}, mean {h['mean']:.6f}, worst {h['worst']:.6f}, diversity {h['diversity']:.6f}" for h in history]
    found = ", ".join(f"{k} {v:.4f}" for k, v in dataclasses.asdict(weights).items())
    return "\n".join([*lines, f"score {score:.6f}: {found}"]) + "\n"


def weights_update(old: Weights, new: Weights) -> str:
    """What changes from one set of weights to another, in percent of the old."""
    rows = [(k, a, getattr(new, k)) for k, a in dataclasses.asdict(old).items()]
    return "".join(f"{k}: {a:.4f} -> {b:.4f} ({(b - a) / a * 100:+.1f} %)\n" for k, a, b in rows)
