"""Units of the driver's tables: turns of conversations take the place of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a unit: whole text, words
    and numbers as one sign each as names and literals are in code, a signature by role and
    number of lines, the lines' kinds as statements."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "w"), "[0-9]+", "0"), r"[\x00-\x20]+", "")
    lines = F.split("text", "\n")
    kinds = F.transform(lines, lambda x: F.when(x == "", "blank").when(F.substring(x, -1, 1).isin(".", "!", "?"), "sentence").otherwise("line"))
    t = t.filter("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("conv_id").cast("string").alias("file"), "role", plain.alias("token_str"), kinds.alias("stmt_kinds"), F.size(lines).alias("line_count"))
    t = t.withColumn("signature", F.concat(F.lit("func("), "role", F.lit(") "), F.col("line_count").cast("string"))).withColumn("struct_sig", F.col("role"))
    t = t.withColumn("hash", F.substring(F.sha2(F.concat(F.lit("["), "signature", F.lit(" "), "token_str", F.lit("]")), 256), 1, 16)).withColumn("norm_hash", F.sha2("token_str", 256))
    return t.withColumns({"sig_len": F.octet_length("signature"), "tok_len": F.octet_length("token_str"), "has_body": F.lit(True), "ret_binop": F.lit(False), "package": F.col("role"), "complexity": F.size("stmt_kinds")})


#: The same units, in DuckDB SQL.
TURNS_SQL = """units AS (
  SELECT conv_id * 1000 + turn AS ord, CAST(conv_id AS VARCHAR) AS file, role,
         regexp_replace(regexp_replace(regexp_replace(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 'w', 'g'), '[0-9]+', '0', 'g'), '[\\x00-\\x20]+', '', 'g') AS token_str,
         list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN 'blank' WHEN right(x, 1) IN ('.', '!', '?') THEN 'sentence' ELSE 'line' END) AS stmt_kinds,
         len(string_split(text, chr(10))) AS line_count,
         'func(' || role || ') ' || CAST(len(string_split(text, chr(10))) AS VARCHAR) AS signature
  FROM conversations WHERE text IS NOT NULL)"""

#: All pairs by brute force: components, then the score.
_PAIRS_SQL = TURNS_SQL + """,
raw AS (
  SELECT a.ord AS ord1, b.ord AS ord2, a.file AS file1, b.file AS file2, a.role AS role1, b.role AS role2,
         a.signature || ' ' || a.token_str = b.signature || ' ' || b.token_str OR a.token_str = b.token_str AS exact,
         CASE WHEN len(a.stmt_kinds) <> len(b.stmt_kinds) THEN 0.5 ELSE len(list_filter(list_zip(a.stmt_kinds, b.stmt_kinds), lambda z: z[1] = z[2])) / CAST(len(a.stmt_kinds) AS DOUBLE) END AS body,
         CASE WHEN a.signature = b.signature THEN 1.0 ELSE 1.0 - abs(strlen(a.signature) - strlen(b.signature)) / CAST(greatest(strlen(a.signature), strlen(b.signature)) AS DOUBLE) END AS sig,
         a.token_str AS x, b.token_str AS y
  FROM units a JOIN units b ON a.ord < b.ord
  WHERE abs(strlen(a.signature) - strlen(b.signature)) <= 50 AND greatest(a.line_count, b.line_count) <= 3 * least(a.line_count, b.line_count)),
parts AS (
  SELECT *, CASE WHEN role1 = role2 THEN body ELSE body * 0.3 END AS structural FROM raw),
scored AS (
  SELECT *, CASE WHEN exact THEN 1.0 WHEN strlen(x) = 0 AND strlen(y) = 0 THEN 1.0 WHEN strlen(x) = 0 OR strlen(y) = 0 THEN 0.0
                 ELSE 1.0 - levenshtein(x, y) / CAST(greatest(strlen(x), strlen(y)) AS DOUBLE) END AS tok
  FROM parts WHERE exact OR 0.3 + 0.25 * structural + 0.15 * sig + 0.3 * (least(strlen(x), strlen(y)) + 1e-9) / (greatest(strlen(x), strlen(y)) + 1e-9) >= {threshold} - 1e-6),
pairs AS (
  SELECT *, CASE WHEN similarity >= 0.95 THEN 'near-duplicate' WHEN similarity >= 0.85 THEN 'refactoring-candidate' WHEN similarity >= 0.75 THEN 'similar-logic' ELSE 'related-functionality' END AS category
  FROM (SELECT *, CASE WHEN exact THEN 1.0 ELSE 0.3 + 0.3 * tok + 0.25 * structural + 0.15 * sig END AS similarity FROM scored) WHERE similarity >= {threshold})"""


def pairs_sql(threshold: float) -> str:
    return _PAIRS_SQL.replace("{threshold}", repr(threshold))
