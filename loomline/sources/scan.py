"""Files to functions: targets, ignore rules, parsing."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import ship_package

#: Parts of a path that are never scanned, and those that codebase statistics leave out.
BUILT_IN = ("/vendor/", "/bin/", "/build/", "/dist/", "/target/", "/.git/")
CODEBASE_EXCLUDES = ("vendor/", ".git/", "testdata/", "_test.go", ".pb.go", "mock_", "generated")
FUNCTION_SCHEMA = "file string, package string, name string, start_line int, end_line int, line_count int, signature string, struct_sig string, token_str string, stmt_kinds array<string>, stmt_count int, has_body boolean, ret_binop boolean, norm_hash string, complexity int, shape_sig string, hash string, source string, error string"


def built_in_ignored(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    hit = name.startswith(".")
    for part in BUILT_IN:
        hit = hit | path.contains(part) | path.contains(part.replace("/", "\\"))
    return hit


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a file name glob: ``*`` and ``?`` stop at a
    slash, ``[^a-c]`` is a class without, a backslash takes the next sign as it
    is. A malformed pattern matches nothing (None)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out += re.escape(pattern[i])
        elif c == "[":
            i += 1
            negated = pattern[i : i + 1] == "^"
            i += negated
            ranges = ""
            while i < len(pattern) and (pattern[i] != "]" or not ranges):
                ends = []
                while len(ends) < 2:
                    if pattern[i : i + 1] == "\\":
                        i += 1
                    if i >= len(pattern) or not ends and pattern[i] in "-]" and pattern[i - 1] != "\\":
                        return None
                    ends.append(pattern[i])
                    i += 1
                    if len(ends) == 1 and pattern[i : i + 1] != "-":
                        break
                    i += len(ends) == 1
                if len(ends) == 2 and ends[0] > ends[1]:
                    return None
                ranges += "-".join("\\x{%x}" % ord(x) for x in ends)
            if i >= len(pattern):
                return None
            out += f"[{'^' * negated}{ranges}]"
        else:
            out += re.escape(c)
        i += 1
    return out


def pattern_ignored(path: Column, pattern: str) -> Column:
    """A glob against the base name, a part of the path, or for ``dir/`` a folder in it."""
    glob = glob_regex(pattern)
    hit = path.contains(pattern)
    if glob is not None:
        hit = hit | F.regexp_extract(path, r"([^/\\]*)$", 1).rlike(f"(?s)^(?:{glob})$")
    if pattern.endswith("/"):
        hit = hit | path.contains("/" + pattern) | path.startswith(pattern)
    return hit


def read_patterns(path: str) -> list[str]:
    """The patterns of an ignore file; a missing one has none."""
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8") as f:
        lines = [x.strip() for x in f]
    return [x for x in lines if x and not x.startswith("#")]


def ignored(path: Column, patterns: Sequence[str] = ()) -> Column:
    hit = built_in_ignored(path)
    for p in patterns:
        hit = hit | pattern_ignored(path, p)
    return hit


def source_files(spark: SparkSession, targets: Sequence[str], patterns: Sequence[str] = ()) -> DataFrame:
    """(path, content) of the targets: files as they are, folders recursively by the rules; what is missing is skipped."""
    out = None
    for target in targets:
        if not os.path.exists(target) and "://" not in target:
            continue
        reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.go").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
        rows = reader.load(target).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        if not target.endswith(".go"):
            rows = rows.filter(~ignored(F.col("path"), patterns))
        rows = rows.select("path", F.col("content").cast("string").alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "path string, content string")


def parse_functions(files: DataFrame, min_lines: int = 1) -> DataFrame:
    """A row a function, or one with ``error`` for a file that cannot be read."""
    ship_package(files.sparkSession)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from loomline.sources.gosource import GoSyntaxError, functions

        names = [x.split()[0] for x in FUNCTION_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [x | {"file": path, "error": None} for x in functions(content or "") if x["line_count"] >= min_lines]
                except GoSyntaxError as e:
                    rows.append({"file": path, "error": str(e)})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "content").mapInPandas(parse, FUNCTION_SCHEMA)


def parse_counts(files: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """One row: files that the codebase rules leave (``n_files``: counted before
    any is read), those read and those not read, and functions."""
    kept = codebase_files(files, more)
    # one row a file: a file without functions gives no row of its own
    per = parse_functions(kept).groupBy("file").agg(F.count_if(F.col("error").isNull()).alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad"))
    t = kept.select("path").join(per, F.col("path") == F.col("file"), "left")
    ok = F.coalesce(F.col("bad"), F.lit(0)) == 0
    return t.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_functions"))


def with_lengths(functions: DataFrame) -> DataFrame:
    """Adds ord (by file, line and name), sig_len and tok_len in bytes."""
    order = F.sha2(F.concat_ws("\x1f", "file", F.lpad(F.col("start_line").cast("string"), 9, "0"), "name"), 256)
    return functions.filter("error IS NULL").withColumn("ord", F.concat_ws("\x1f", "file", F.lpad(F.col("start_line").cast("string"), 9, "0"), order)).withColumn("sig_len", F.octet_length("signature")).withColumn("tok_len", F.octet_length("token_str"))


def codebase_files(files: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    keep = F.lit(True)
    for part in (*CODEBASE_EXCLUDES, *more):
        keep = keep & ~F.col("path").contains(part)
    return files.filter(keep)
