"""Secret scans by corpus-wide ownership frequency, in built-in column functions only.

Every text is scanned whole by a few patterns. The candidate values are hashed
and counted over the corpus by distinct repositories and owners: a value that
many owners share is an example that was copied from a manual; one that a
single owner has looks live. Repository and owner are columns of their own;
where a table has one column for both, as the documents here, both counts agree.

Defined results: a null text counts as empty; a null repository or owner is
none, and a value that only such rows have counts 0 owners, so it looks live;
rows with a null or repeated id are kept row by row; an empty table gives an
empty table. Offsets are code points, ends exclusive. Columns other than those
named are not read, so extra columns with clashing names do no harm. Patterns
take time in proportion to the text, and matches are placed in blocks, so a
long text with many of them does no harm either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm._scratch import written

#: Kind, pattern, group that holds the value, least length of the value.
BASE_KINDS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that count only if few owners have the value.
OWNED_KINDS = (
    ("issued", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|eyJ)[A-Za-z0-9_.-]{16,}", 0, 20),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}", 0, 32),
    ("opaque", r"[A-Za-z0-9+/_]{32,}={0,2}", 0, 32),
)
KINDS = tuple(k for k, *_ in BASE_KINDS + OWNED_KINDS)
#: What a value of the kind must hold besides.
MUST_HOLD = {"opaque": ("[0-9]", "[a-z]", "[A-Z]")}
#: Matches whose offsets are added up at once.
BLOCK = 128
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _found(text: str, rank: int) -> Column:
    """The kind's spans in leftmost, non-overlapping order; too short ones go
    after matching. What lies between matches gives their offsets, since the
    built-in functions return matched text only."""
    kind, pattern, group, least = (BASE_KINDS + OWNED_KINDS)[rank]
    p = _sql(pattern)
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"
    sized = f"transform(filter({zipped}, x -> x.`1` IS NOT NULL), x -> struct(length(x.`0`) AS gap, length(x.`1`) AS size, x.`2` AS value))"
    blocks = f"transform(array({sized}), z -> transform(sequence(0, (size(z) - 1) div {BLOCK}), b -> slice(z, b * {BLOCK} + 1, {BLOCK})))[0]"
    # offsets: of blocks first, then within each block
    starts = "aggregate(bs, array(0), (a, b) -> concat(a, array(element_at(a, -1) + aggregate(b, 0, (n, x) -> n + x.gap + x.size))))"
    placed = f"""aggregate(b, struct(cast(array() AS {_SPAN}) AS spans, at AS at),
        (a, x) -> struct(concat(a.spans, array(struct(a.at + x.gap AS start, {rank} AS rank, '{kind}' AS kind, a.at + x.gap + x.size AS end, x.value AS value))) AS spans, a.at + x.gap + x.size AS at),
        a -> a.spans)"""
    holds = "".join(f" AND x.value RLIKE '{h}'" for h in MUST_HOLD.get(kind, ()))
    spans = f"filter(flatten(transform(array({blocks}), bs -> flatten(zip_with(bs, slice({starts}, 1, size(bs)), (b, at) -> {placed})))), x -> length(x.value) >= {least}{holds})"
    return F.expr(f"CASE WHEN {text} RLIKE {p} THEN {spans} ELSE cast(array() AS {_SPAN}) END")


def _row_key(id_: Column, text: Column, repo: Column, owner: Column) -> Column:
    """128 bits that tell rows apart; a null is not the same as any value."""
    parts = [x for c in (id_, text, repo, owner) for x in (F.coalesce(c.cast("string"), F.lit("")), c.isNull())]
    return F.struct(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """One row a document: id, row_key (tells rows of one id apart), repo, owner, base and owned spans."""
    key = _row_key(F.col(id_col), F.col(text_col), F.col(repo_col), F.col(owner_col)).alias("row_key")
    own = docs.select(F.col(id_col).alias("id"), key, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    n = len(BASE_KINDS)
    own = own.select("id", "row_key", "repo", "owner", F.array_sort(F.concat(*(_found("t", k) for k in range(n)))).alias("base"), F.concat(*(_found("t", k) for k in range(n, len(KINDS)))).alias("more"))
    apart = "filter(more, m -> NOT exists(base, b -> b.start < m.end AND m.start < b.end))"
    return own.select("id", "row_key", "repo", "owner", "base", F.expr(f"array_sort({apart})").alias("owned"))


def ownership(cands: DataFrame) -> DataFrame:
    """By SHA-256 of a candidate value: distinct repositories and owners. Each
    distinct count is a two-step aggregate, so a value that a third of all
    rows hold is combined before it is shuffled."""
    each = cands.select("repo", "owner", F.explode(F.concat("base", "owned")).alias("x")).select(F.sha2("x.value", 256).alias("value_sha256"), "repo", "owner").distinct()
    repos = each.select("value_sha256", "repo").distinct().groupBy("value_sha256").agg(F.count("repo").alias("n_repos"))
    owners = each.select("value_sha256", "owner").distinct().groupBy("value_sha256").agg(F.count("owner").alias("n_owners"))
    return repos.join(owners, "value_sha256")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", max_owners: int = 2) -> DataFrame:
    """Per document: id, row_key, base spans, findings.

    ``findings`` holds all base spans and those of the owned kinds whose value
    at most ``max_owners`` owners have, by start and kind, each with its
    value's hash, n_repos, n_owners and status ``live`` (at most max_owners
    owners) or ``example``.
    """
    cands = written(candidates(docs, id_col, text_col, repo_col, owner_col), "secret-candidates")
    one = cands.filter((F.size("base") > 0) | (F.size("owned") > 0)).dropDuplicates(["row_key"])
    each = one.select("id", "row_key", F.explode(F.concat("base", "owned")).alias("x")).withColumn("value_sha256", F.sha2("x.value", 256))
    told = each.join(ownership(cands), "value_sha256").withColumn("status", F.when(F.col("n_owners") <= max_owners, "live").otherwise("example"))
    told = told.filter((F.col("x.rank") < len(BASE_KINDS)) | (F.col("status") == "live"))
    found = told.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("x.start", "x.rank", "x.kind", "x.end", "value_sha256", "n_repos", "n_owners", "status"))).alias("findings"))
    none = cands.filter((F.size("base") == 0) & (F.size("owned") == 0)).withColumn("findings", F.lit(None).cast(found.schema["findings"].dataType))
    some = cands.filter((F.size("base") > 0) | (F.size("owned") > 0)).join(found, "row_key", "left")
    out = some.unionByName(none)
    return out.select("id", "row_key", "base", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)).alias("findings"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", max_owners: int = 2, mask: str = "[SECRET]") -> DataFrame:
    """The documents with each live secret replaced by ``mask``; all rows and
    columns stay. Only rows that hold a live secret are shuffled."""
    found = find_secrets(docs, id_col, text_col, repo_col, owner_col, max_owners)
    live = found.select("row_key", F.expr("filter(findings, x -> x.status = 'live')").alias("live_spans")).filter(F.size("live_spans") > 0).dropDuplicates(["row_key"])
    names = docs.columns
    any_pattern = F.lit(False)
    for _, pattern, _, _ in BASE_KINDS + OWNED_KINDS:
        any_pattern = any_pattern | F.expr(f"`{text_col}` RLIKE {_sql(pattern)}")
    any_pattern = F.coalesce(any_pattern, F.lit(False))
    key = _row_key(F.col(id_col), F.col(text_col), F.col(repo_col), F.col(owner_col))
    hit = docs.filter(any_pattern).select(F.struct(*(F.col(c) for c in names)).alias("row"), key.alias("row_key")).join(live, "row_key", "left")
    t = f"row.`{text_col}`"
    masked = F.expr(
        f"""CASE WHEN live_spans IS NULL THEN {t} ELSE aggregate(live_spans, struct('' AS done, 0 AS at),
        (a, x) -> struct(CASE WHEN x.start < a.at THEN a.done ELSE concat(a.done, substring({t}, a.at + 1, x.start - a.at), '{mask}') END AS done,
                         greatest(a.at, x.end) AS at),
        a -> concat(a.done, substring({t}, a.at + 1))) END"""
    )
    hit = hit.select(*(masked.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names))
    return docs.filter(~any_pattern).unionByName(hit)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the digests of find_secrets over all documents."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint)")
    return found.select(F.col("id").alias("doc_id"), *(count(k).alias(f"n_{k}") for k, *_ in BASE_KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("findings").alias("spans"), F.expr("cast(size(filter(findings, x -> x.status = 'live')) AS bigint)").alias("n_live"))
