"""Benchmark decontamination by SimHash windows, in built-in column functions only.

A document's windows are as long as a benchmark item; a document shorter than
the item, by no more than the similarity allows, is one window. A window has
``prints`` SimHash fingerprints of 64 bits over its words, under different
seeds. A fingerprint is cut into four blocks of 16 bits; an item is posted under
every value within ``radius // 4`` bits of each block, so by the pigeonhole
principle an equi-join on (size, print, block, value) finds every fingerprint
within ``radius`` of a window's. Candidates are verified by the weighted Jaccard
similarity of their five-word shingles, weights being multiplicities: sum of
least over sum of greatest counts.

Windows begin where a document has a shingle of the benchmark (moving a window's
start on to the next shared shingle, or to the document's last window, loses no
shared shingle), and where the item would begin if that shingle stood in its
place (a word changed before it leaves the fingerprints aligned), if enough
shared shingles are within reach for the similarity asked for. Clean text is
read once and never windowed.

At similarity t of texts of mostly distinct words at least 2t / (1 + t) of the
words are common, so each bit of two fingerprints differs with a chance of at
most acos(2t / (1 + t)) / pi, and one fingerprint is missed with a computed
chance (:func:`chance_missed`). A wide radius would post an item under a tenth
of all values; several fingerprints with a narrow one miss no more (MISS) and
post it under a few thousandths.

Defined results: null or empty texts match nothing; an item of fewer than five
words has its whole sequence as its one shingle, so it is matched where a
document has just these words; items without words match nothing; a repeated
item id or document id is matched row by row, then the best match of each (id,
item id) counts; ties go to the earliest window; an empty table on either side
gives an empty table. Only the named columns are read, so others may have any
name. A long text's shingles are rows of their own; its windows are cut from
its words in one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: Shingles of the benchmark up to which they are broadcast (some 24 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bits that fingerprints found may differ in.
RADIUS = 11
#: The chance at most that all fingerprints miss a pair at the threshold.
MISS = 1e-3


def _words(rows: DataFrame) -> DataFrame:
    """Adds w (hash of each word) for a column t."""
    blank = r"[\x20\x09-\x0D]+"
    rows = rows.withColumn("w", F.expr(f"filter(split(coalesce(t, ''), r'{blank}'), x -> x <> '')"))
    return rows.withColumn("w", F.expr("transform(w, x -> xxhash64(x))"))


def _shingles(words: str, n: int) -> str:
    """SQL of the hashes of all n consecutive words."""
    at = ", ".join(f"{words}[i + {k}]" for k in range(n))
    return f"CASE WHEN size({words}) >= {n} THEN transform(sequence(0, size({words}) - {n}), i -> xxhash64({at})) ELSE cast(array() AS array<bigint>) END"


def _own_shingles(words: str) -> Column:
    """A text's shingles; of fewer than SHINGLE words the whole sequence."""
    whole = " ".join(f"WHEN size({words}) = {n} THEN array(xxhash64({', '.join(f'{words}[{k}]' for k in range(n))}))" for n in range(1, SHINGLE))
    return F.expr(f"CASE {whole} ELSE {_shingles(words, SHINGLE)} END")


def fingerprints(words: str, prints: int, most: int) -> Column:
    """The 64-bit SimHashes of an array of word hashes, under the seeds 0 to
    ``prints - 1``. Words are counted for several bits at once, in fields of a
    long that hold up to ``most`` words. Bits, lanes and seeds are looped over,
    not written out: the driver rewrites and prints its plans many times."""
    width = 8 if most < 1 << 8 else 16 if most < 1 << 16 else 32
    field = sum(1 << k for k in range(0, 64, width))
    ones = (1 << width) - 1
    lanes = f"transform(sequence(0, {width - 1}), j -> aggregate(v, 0L, (a, x) -> a + (shiftrightunsigned(x, j) & {field}L)))"
    bits = f"aggregate(sequence(0, 63), 0L, (a, b) -> a + CASE WHEN (shiftrightunsigned(lane[b % {width}], b - b % {width}) & {ones}L) * 2 > size({words}) THEN shiftleft(1L, b) ELSE 0L END)"
    hashed = f"transform(sequence(0, {prints - 1}), k -> transform({words}, x -> xxhash64(x, k)))"
    return F.expr(f"transform(transform({hashed}, v -> {lanes}), lane -> {bits})")


def chance_missed(radius: int, threshold: float) -> float:
    """The chance that fingerprints of a pair at the threshold are more than ``radius`` bits apart."""
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    return sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(radius + 1, 65))


def prints_for(threshold: float, radius: int = RADIUS, miss: float = MISS) -> int:
    """The least number of fingerprints that all miss with no more than this chance."""
    one = chance_missed(radius, threshold)
    return max(1, math.ceil(math.log(miss) / math.log(one))) if 0 < one < 1 else 1


def row_key(id_col: Column, text_col: Column) -> Column:
    """128 bits that tell rows apart by id and text, nulls included."""
    parts = (F.coalesce(id_col.cast("string"), F.lit("")), id_col.isNull(), F.coalesce(text_col.cast("string"), F.lit("")), text_col.isNull())
    return F.struct(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"))


def _windows(by_size: DataFrame, threshold: float) -> DataFrame:
    """row_key, m, start of the windows that may be similar to an item of m words.

    ``at`` are the places in a text of n words where a shingle of such an item
    is, ascending; ``aligned`` those where the item would begin. A window and an
    item with x and y shingles are similar only if they have t / (1 + t) * (x + y)
    in common, so a window needs that many places, and its first one has to be
    that many places before one within its size.
    """
    x = f"CASE WHEN m >= {SHINGLE} THEN least(n, m) - {SHINGLE - 1} ELSE 1 END"
    y = f"CASE WHEN m >= {SHINGLE} THEN m - {SHINGLE - 1} ELSE 1 END"
    rows = by_size.filter(f"n >= {SHINGLE} OR n >= m").withColumn("x", F.expr(x))
    rows = rows.withColumn("need", F.expr(f"cast(ceil({threshold / (1 + threshold)!r}D * (x + {y}) - 1e-9D) AS int)")).filter("size(at) >= need AND x >= need")
    # first places of windows that have enough of them
    rows = rows.withColumn("first", F.expr("filter(at, (p, i) -> i + need <= size(at) AND get(at, i + need - 1) - p <= x - 1)")).filter("size(first) > 0")
    near = "flatten(transform(first, p -> sequence(p - (x - need), p)))"
    begins = f"CASE WHEN n <= m THEN array(0) ELSE array_distinct(transform(array_union(first, array_intersect(aligned, {near})), p -> greatest(0, least(p, n - m)))) END"
    return rows.select("row_key", "m", F.explode(F.expr(begins)).alias("start"))


def matched_windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, threshold: float, radius: int, prints: int) -> DataFrame:
    """Windows that contain an item: id, row_key, item_id, similarity, start, n_words."""
    spark = docs.sparkSession
    own = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("t")).distinct()
    own = _words(own).withColumn("item_s", _own_shingles("w")).filter("size(item_s) > 0").withColumn("m", F.size("w"))
    most = own.agg(F.max("m")).first()[0] or 0
    own = own.select(row_key(F.col("item_id"), F.col("t")).alias("item_key"), "item_id", "m", "item_s", fingerprints("w", prints, most).alias("prints")).cache()
    bounded, *short = own.agg(F.sum(F.size("item_s")), *(F.max(F.expr(f"m = {n}")) for n in range(1, SHINGLE))).first()
    bounded, short = bounded or 0, [n for n, there in zip(range(1, SHINGLE), short, strict=True) if there]

    starts = own.select("m", F.posexplode("item_s").alias("off", "h")).groupBy("h").agg(F.collect_set(F.struct("m", "off")).alias("places"))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"))
    # sizes below SHINGLE are looked up only if an item has one
    lists = ", ".join(_shingles("w", n) for n in (*short, SHINGLE))
    hashed = _words(text).select("row_key", F.size("w").alias("n"), F.explode(F.expr(f"array({lists})")).alias("s")).select("row_key", "n", F.posexplode("s").alias("pos", "h"))
    hits = hashed.join(F.broadcast(starts) if bounded <= BROADCAST_ROWS else starts, "h")
    by_size = hits.select("row_key", "n", "pos", F.explode("places").alias("place")).select("row_key", "n", "pos", "place.m", "place.off")
    by_size = by_size.groupBy("row_key", "n", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"), F.collect_set(F.expr("pos - off")).alias("aligned"))
    by_doc = _windows(by_size, threshold).groupBy("row_key").agg(F.collect_list(F.struct("start", "m")).alias("windows"))

    again = _words(text.join(by_doc, "row_key"))
    win = again.select("id", "row_key", F.explode("windows").alias("x"), "w").select("id", "row_key", "x.start", "x.m", F.expr("slice(w, x.start + 1, x.m)").alias("win_w"))
    win = win.select("id", "row_key", "start", "m", F.size("win_w").alias("n_words"), _own_shingles("win_w").alias("win_s"), fingerprints("win_w", prints, most).alias("prints"))

    near = radius // 4
    masks = spark.range(1 << 16).select(F.col("id").cast("int").alias("mask")).filter(F.bit_count("mask") <= near)
    block = "cast(shiftrightunsigned(print, 16 * block) & 65535 AS int)"
    blocks = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block")
    posted = own.select("item_key", "m", "prints", F.posexplode("prints").alias("k", "print")).select("*", blocks).withColumn("value", F.expr(block))
    posted = posted.drop("print").join(F.broadcast(masks)).withColumn("value", F.expr("value ^ mask")).drop("mask").alias("i")
    probes = win.select("*", F.posexplode("prints").alias("k", "print")).select("*", blocks).withColumn("value", F.expr(block)).drop("print").alias("d")
    far = lambda k: f"bit_count(d.prints[{k}] ^ i.prints[{k}])"
    here = "d.prints[d.k] ^ i.prints[d.k]"
    # each pair once: by the first fingerprint and the first block that find it
    first = [f"NOT (d.k > {k} AND {far(k)} <= {radius})" for k in range(prints - 1)]
    first += [f"NOT (d.block > {b} AND bit_count(shiftrightunsigned({here}, {16 * b}) & 65535) <= {near})" for b in range(3)]
    met = " AND ".join(["d.m = i.m AND d.k = i.k AND d.block = i.block AND d.value = i.value", f"bit_count({here}) <= {radius}", *first])
    pairs = probes.join(posted, F.expr(met)).select("d.id", "d.row_key", "i.item_key", "d.start", "d.n_words", "d.win_s")
    texts = own.select("item_key", "item_id", "item_s").distinct()
    pairs = pairs.join(F.broadcast(texts) if bounded <= BROADCAST_ROWS else texts, "item_key").drop("item_key")
    shared = """CASE WHEN size(array_distinct(win_s)) = size(win_s) AND size(array_distinct(item_s)) = size(item_s)
        THEN size(array_intersect(win_s, item_s))
        ELSE aggregate(array_intersect(win_s, item_s), 0, (a, h) -> a + least(size(filter(win_s, x -> x = h)), size(filter(item_s, x -> x = h)))) END"""
    pairs = pairs.withColumn("both", F.expr(shared)).withColumn("similarity", F.expr("both / (cast(size(win_s) + size(item_s) AS double) - both)"))
    return pairs.filter(F.col("similarity") >= threshold).select("id", "row_key", "item_id", "similarity", "start", "n_words")


def _matched(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, radius: int = RADIUS, prints: int | None = None) -> DataFrame:
    return matched_windows(docs, items, id_col, text_col, item_col, item_text_col, threshold, radius, prints or prints_for(threshold, radius))


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Pairs of a document and an item it contains: id, item_id, similarity,
    start (word offset of the best window), n_words (its size).

    Options: id_col, text_col, item_col, item_text_col, threshold (0.8),
    radius (11), prints (as many as MISS asks for).
    """
    pairs = _matched(docs, items, **options)
    best = F.max_by(F.struct("similarity", "start", "n_words"), F.struct("similarity", -F.col("start"))).alias("best")
    return pairs.groupBy("id", "item_id").agg(best).select("id", "item_id", "best.similarity", F.col("best.start").cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those that contain an item, decided row by row, whatever ids are null or repeated."""
    bad = _matched(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("row_key").alias("bad_key")).distinct()
    return docs.join(bad, row_key(docs[id_col], docs[text_col]) == bad["bad_key"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: contaminated() of all documents with all benchmark items."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).select(F.col("id").alias("doc_id"), "item_id", F.round("similarity", 9).alias("similarity"), "start", "n_words")
