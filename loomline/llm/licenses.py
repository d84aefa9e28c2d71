"""Licence scans by canonical digest lookup, in built-in column functions only.

A text is brought to a canonical form (case, copyright lines, equivalent
spellings, punctuation and white space), and so are the known licences and
notices. Looked up are the digest of the whole form and that of every segment
that may be a known text: a segment begins where the form has the first three
words of a known text, is as many words long, and ends in its last three.
So a known text is found wherever a document contains it: as the whole, a
header block, a paragraph or a line, however it is wrapped or commented.

Defined results: a null or empty text has no licence and a null digest; every
row is kept; ``licenses`` are all known wordings that the text contains, by
name; ``license_id`` is the longest of them, ties to the smallest name. An empty
table gives an empty table; equal rows and ids count one by one; only the named
columns are read, so others may have any name; a long text is searched whole. Known
texts of one digest go by the smallest licence id. A known text of less than
three words is looked up as a whole document only. The notice "all rights
reserved" is no part of the canonical form (it stands in the middle of other
licences) and is looked for in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm._license_texts import all_known

#: Spellings that mean the same, applied in this order.
SPELLINGS = (
    ("https?", "http"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
)
#: The largest table of known licences that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Words by which the begin and the end of a known text are looked for.
ANCHOR = 3
#: The notice that is looked for in the text itself.
RESERVED, RESERVED_PATTERN = "All-rights-reserved", r"(?i)(?<![\p{L}\p{N}])all[^\p{L}\p{N}]+rights[^\p{L}\p{N}]+reserved(?![\p{L}\p{N}])"


def canonical(text: Column) -> Column:
    """The canonical form of a licence text."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"(?m)^[ \t]*[#*/;%-]*[ \t]*(?:portions )?(?:copyright[ :]*(?:\(c\)|©|\d|by |<|\[|\{)|\(c\)|©)[^\n]*(?:\n|$)", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]*[#*/;%-]*[ \t]*all rights reserved\.?[ \t]*$", " ")
    # two blanks between words, so that neighbours share none
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  ")
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))
    for was, now in SPELLINGS:
        was, now = (f" {x} ".replace(" ", "  ")[1:-1] for x in (was, now))
        t = F.regexp_replace(t, was, now) if "?" in was else F.replace(t, F.lit(was), F.lit(now))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def telling_words(forms: list[str]) -> list[str]:
    """A few words of which each form has one or more, long ones if possible:
    a text without any of them holds none of the forms."""
    left, out = [set(f.split()) for f in forms], []
    while left:
        count: dict[str, int] = {}
        for words in left:
            for w in words:
                count[w] = count.get(w, 0) + 1
        best = min(count, key=lambda w: (len(w) < 7, -count[w], w))
        out.append(best)
        left = [words for words in left if best not in words]
    return out


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """digest, license_id, n_words and the hashes of the first and last words of each known text."""
    rows = list((all_known() if known is None else known).items())
    texts = spark.createDataFrame(rows, "license_id string, license_text string").withColumn("form", canonical(F.col("license_text")))
    one = texts.filter(F.length("form") > 0).groupBy("form").agg(F.min("license_id").alias("license_id")).withColumn("w", F.split("form", " "))
    ends = [F.expr(f"CASE WHEN size(w) >= {ANCHOR} THEN {_anchor(i)} END").alias(name) for name, i in (("first", "0"), ("last", f"size(w) - {ANCHOR}"))]
    return one.select(F.sha2("form", 256).alias("digest"), "license_id", F.size("w").alias("n_words"), "form", *ends)


def _anchor(i: str) -> str:
    return f"xxhash64({', '.join(f'w[{i} + {k}]' for k in range(ANCHOR))})"


def _contained(rows: list) -> Column:
    """For a column w of words: the known texts in it, an array of (-n_words, license_id)."""
    rows = [r for r in rows if r["first"] is not None]
    if not rows:
        return F.expr("cast(array() AS array<struct<n:int,license_id:string>>)")
    firsts = ", ".join(f"{x}L" for x in sorted({r["first"] for r in rows}))
    shapes = ", ".join(f"named_struct('first', {a}L, 'n', {n}, 'last', {b}L)" for a, n, b in sorted({(r["first"], r.n_words, r["last"]) for r in rows}))
    names = "map(" + ", ".join(f"'{r.digest}', named_struct('n', -{r.n_words}, 'license_id', {_quoted(r.license_id)})" for r in rows) + ")"
    begins = f"CASE WHEN size(w) >= {ANCHOR} THEN filter(sequence(0, size(w) - {ANCHOR}), i -> {_anchor('i')} IN ({firsts})) ELSE cast(array() AS array<int>) END"
    fits = f"filter(array({shapes}), s -> s.first = {_anchor('i')} AND i + s.n <= size(w) AND {_anchor(f'(i + greatest(0, least(s.n, size(w) - i) - {ANCHOR}))')} = s.last)"
    digests = f"array_distinct(flatten(transform({begins}, i -> transform({fits}, s -> sha2(array_join(slice(w, i + 1, s.n), ' '), 256)))))"
    found = f"filter(transform({digests}, d -> try_element_at({names}, d)), x -> x IS NOT NULL)"
    telling = " OR ".join(f"array_contains(w, {_quoted(x)})" for x in telling_words([r.form for r in rows]))
    return F.expr(f"CASE WHEN {telling} THEN {found} END")


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None) -> DataFrame:
    """Per document: id, digest of the canonical whole text, license_id or null, licenses (all known texts it contains)."""
    known = all_known() if known is None else known
    table = known_digests(docs.sparkSession, known)
    rows = table.collect()  # as many as the caller passed
    whole = table.select("digest", F.struct((-F.col("n_words")).alias("n"), "license_id").alias("whole"))
    if len(known) <= BROADCAST_ROWS:
        whole = F.broadcast(whole)
    text = F.col(text_col).cast("string")
    reserved = text.rlike(RESERVED_PATTERN) if RESERVED in known else F.lit(False)
    form = docs.select(F.col(id_col).alias("id"), canonical(text).alias("form"), F.coalesce(reserved, F.lit(False)).alias("reserved"))
    words = form.select("id", "reserved", F.when(F.length("form") > 0, F.sha2("form", 256)).alias("digest"), F.split("form", " ").alias("w"))
    found = words.select("id", "digest", "reserved", _contained(rows).alias("parts")).join(whole, "digest", "left")
    notice = F.expr(f"CASE WHEN reserved THEN array(named_struct('n', -3, 'license_id', '{RESERVED}')) END")
    none = "cast(array() AS array<struct<n:int,license_id:string>>)"
    found = found.withColumn("notice", notice).withColumn("found", F.expr(f"array_sort(array_distinct(concat(coalesce(parts, {none}), coalesce(notice, {none}), CASE WHEN whole IS NULL THEN {none} ELSE array(whole) END)))"))
    return found.select("id", "digest", F.expr("get(found, 0).license_id").alias("license_id"), F.expr("array_sort(found.license_id)").alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: scan_licenses over all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "digest", "license_id", "licenses")
