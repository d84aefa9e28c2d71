"""MinHash near-dedup by an inverted join of signature coordinates.

Each distinct shingle set has a signature of ``coordinates`` least hashes and
is posted under every (coordinate, value) pair. Sets of a similarity of
``percent`` or more agree in ``matches`` coordinates or more but for a chance of
about 1e-8 (:func:`chance_missed`), so, with a set's coordinates in order of
posting-list length, they meet in one of the ``coordinates - matches + 1``
shortest lists of each (prefix); the long lists, such as those of a passage
that very many documents share, are skipped and only counted when two
signatures are compared. Retained pairs are confirmed on full sets.

All pairs of a list are never made. First every member is compared with one
member of its list (twice, with different ones); what is confirmed joins
classes, and only pairs of different classes go on. Lists of at most ``SHORT``
members make their remaining pairs. The members of longer lists (a family of
versions of one text that are mostly less similar than ``percent``) are merged
by the prefixes of their full sets instead (:func:`prefix_pairs`), which loses
no similar pair either, and are compared by a finer signature before any text
is sent.

Defined results: without words or text the set is empty and linked with
nothing; equal sets are one class whatever their number; nodes are shingle sets,
not ids, so rows that share an id, or have none, are linked one by one; a null
id comes after all others; an empty table gives an empty table. Only the two
named columns are read, so others may have any name. A long text is worked on
whole, as one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import _text
from loomline.llm._arrow import slice_words, text_slices
from loomline.llm._scratch import written
from loomline.llm.components import components

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = np.random.Generator(np.random.PCG64(6)).integers(1, 2**63, 256, dtype=np.uint64)
#: Stands for an id that is null.
LAST = np.iinfo(np.int64).max
#: Members up to which a posting list makes its pairs: at most SHORT / 2 rows a posting.
SHORT = 32
#: Coordinates of the finer signature, a byte each, after those of the first; a pair is missed with a chance under 1e-8.
FINE = 192


def chance_missed(coordinates: int, matches: int, similarity: float) -> float:
    """The chance that sets of this similarity agree in fewer coordinates than ``matches``."""
    return sum(math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k) for k in range(matches))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, row offsets): the distinct shingles of each
    text, ascending; a text of fewer words has its whole sequence as one."""
    for a, b, buf, off in text_slices(texts):
        low = _LOWER[buf]
        start, end, first = slice_words(low, off)
        n = np.diff(first)
        count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        row = np.repeat(np.arange(b - a), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
        h = _text.spans_hash(_text.word_hashes(low, start, end), at, np.minimum(at + words, np.repeat(first[1:], count))) if len(at) else np.zeros(0, U)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield a, b, h[new], np.searchsorted(row[new], np.arange(b - a + 1))


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, coordinates: int) -> DataFrame:
    """Per row: id, k1 and k2 (digests of the text), n_shingles, s1 and s2 (digests of the set), sig (32 bits a coordinate)."""
    t = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t"), *(k.alias(f"k{i + 1}") for i, k in enumerate(_text_key(t))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, off in shingle_sets(batch.column(1), words):
                n = np.diff(off)
                some = np.flatnonzero(n)
                s1, s2 = np.zeros(b - a, U), np.zeros(b - a, U)
                sig = np.zeros((b - a, coordinates), np.int32)
                if len(some):
                    at = off[:-1][some]
                    s1[some] = np.add.reduceat(_text.mix(h ^ U(0x1234567)), at)
                    s2[some] = np.add.reduceat(_text.mix(h ^ U(0x7654321)), at)
                    for i in range(coordinates):
                        sig[some, i] = (np.minimum.reduceat(_text.mix(h ^ _SEEDS[i]), at) >> U(32)).astype(np.uint32).view(np.int32)
                flat = pa.array(sig.ravel())
                same = (batch.column(c).slice(a, b - a) for c in (0, 2, 3))
                yield pa.RecordBatch.from_arrays([*same, pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * coordinates), flat)], names=["id", "k1", "k2", "n_shingles", "s1", "s2", "sig"])

    return rows.mapInArrow(run, "id long, k1 long, k2 long, n_shingles long, s1 long, s2 long, sig array<int>")


def least_matches(coordinates: int, similarity: float, chance: float = 1e-8) -> int:
    """The most matches that sets of this similarity fall short of with at most this chance."""
    return max(k for k in range(coordinates + 1) if chance_missed(coordinates, k, similarity) <= chance)


def prefix_pairs(members: DataFrame, sets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels among members (rep, label) that may be similar.

    Shingles are ordered by the number of members that have them. Similar sets
    x and y, x not larger, share 2 * percent / (100 + percent) of x and percent
    of y, so their first common shingle is in x's first and y's first
    remaining ones. Shingles of one member come first and are never posted:
    a version with enough text of its own meets nothing. The join's condition
    bounds what two sets can still share from that shingle on. A list is split
    by size class, in which alone similar sets can be.
    """
    known = members.join(sets.select("rep", F.col("n_shingles").alias("n")), "rep")

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, h, off in shingle_sets(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], np.diff(off))), pa.array(h.view(np.int64))], names=["rep", "h"])

    flat = texts.join(members.select("rep"), "rep", "left_semi").select("rep", "t").mapInArrow(flatten, "rep long, h long")
    flat = written(flat, "member-shingles")
    often = flat.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    keys = flat.join(often, "h").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("keys"))
    long = f"n - ceil({percent} * n / 100.0D - 1e-9) + 1"
    short = f"n - ceil({2 * percent} * n / {100 + percent}.0D - 1e-9) + 1"
    post = keys.join(known, "rep").withColumn("own", F.expr("n - size(keys)")).select("rep", "label", "n", "own", F.expr(f"{short} AS short"), F.posexplode(F.expr(f"slice(keys, 1, cast(greatest(0, {long} - own) AS int))")).alias("i", "k"))
    band = math.log(100 / percent) + 1e-3
    post = post.select("rep", "label", "n", F.expr("own + i + 1 AS i"), "short", F.col("k.h").alias("h"), F.floor(F.log("n") / band).alias("band"))
    y = post.select("h", "band", *[F.col(c).alias(f"{c}_y") for c in ("rep", "label", "n", "i")])
    x = post.filter("i <= short").withColumn("band", F.explode(F.expr("array(band, band + 1)"))).drop("short")
    order = "(n < n_y OR (n = n_y AND rep < rep_y)) AND label <> label_y"
    bound = f"100 * n >= {percent} * n_y AND {100 + percent} * (1 + least(n - i, n_y - i_y)) >= {percent} * (n + n_y)"
    met = x.alias("x").join(y.alias("y"), F.expr(f"x.h = y.h AND x.band = y.band AND {order} AND {bound}"))
    return met.select(F.least("rep", "rep_y").alias("a"), F.greatest("rep", "rep_y").alias("b")).distinct()


def finely_alike(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose finer signatures agree enough."""
    least = least_matches(FINE, percent / 100)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, off in shingle_sets(batch.column(1), words):
                some, fine = np.flatnonzero(np.diff(off)), np.zeros((b - a, FINE), np.uint8)
                for i in range(FINE if len(some) else 0):
                    fine[some, i] = np.minimum.reduceat(_text.mix(h ^ _SEEDS[255 - i]), off[:-1][some]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in fine], pa.binary())], names=["rep", "fine"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in (2, 3))
                at = pa.array(np.flatnonzero((x == y).sum(axis=1) >= least))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    met = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    fine = written(texts.join(met, "rep", "left_semi").select("rep", "t").mapInArrow(sign, "rep long, fine binary"), "fine-signatures")
    side = lambda c: fine.select(F.col("rep").alias(c), F.col("fine").alias(f"fine_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fine_a", "fine_b").mapInArrow(compare, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, matches: int, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough and whose full sets are similar."""
    agree = "size(filter(zip_with(sig_a, sig_b, (x, y) -> x = y), x -> x))"
    near = "100L * least(n_a, n_b) >= %dL * greatest(n_a, n_b)" % percent
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    kept = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"{agree} >= {matches} AND {near}").select("a", "b")
    both = kept.join(texts.select(F.col("rep").alias("a"), F.col("t").alias("t_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("t").alias("t_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                (_, _, x, _), = shingle_sets(batch.column(2).slice(i, 1), words)
                (_, _, y, _), = shingle_sets(batch.column(3).slice(i, 1), words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * common >= percent * (len(x) + len(y) - common)
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return both.select("a", "b", "t_a", "t_b").mapInArrow(check, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, coordinates: int, matches: int, stars: int) -> DataFrame:
    """Per row: id (a null as LAST), k1 and k2 (digests of the text), n_shingles,
    first (id, k1 and k2 of the first row of its class; null without words)."""
    last = F.lit(LAST)
    rows = written(signatures(docs, id_col, text_col, words, coordinates).withColumn("id", F.coalesce("id", last)), "signatures")
    own = rows.filter("n_shingles > 0")
    sets = own.groupBy("s1", "s2").agg(F.min(F.struct("id", "k1", "k2")).alias("row"), F.min("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    # numbers are in order of the sets' first rows, so that the least of a list is the text that came first,
    # of which the others are versions; they hold once the table is written
    sets = written(sets.orderBy("row").withColumn("rep", F.monotonically_increasing_id()), "sets")

    post = sets.select("rep", F.posexplode("sig").alias("i", "v")).select("rep", F.expr("shiftleft(cast(i AS bigint), 32) | (cast(v AS bigint) & 4294967295)").alias("key"))
    length = post.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = post.join(length, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"))
    # coordinates with a list of their own come first and meet nothing
    prefix = f"slice(keys, 1, greatest(0, {coordinates - matches + 1} - ({coordinates} - size(keys))))"
    lists = shared.select("rep", F.explode(F.expr(prefix)).alias("x")).select("rep", F.col("x.key").alias("key"))
    lists = written(lists, "postings")
    some = lists.select("rep").distinct().join(sets.select("rep", "row.id", "row.k1", "row.k2"), "rep")
    t = F.col(text_col).cast("string")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), t.alias("t"), *(k.alias(f"k{i + 1}") for i, k in enumerate(_text_key(t))))
    texts = written(texts.join(some, ["id", "k1", "k2"]).select("rep", "t").dropDuplicates(["rep"]), "candidate-texts")

    label = None
    edges = None
    for step in range(stars + 1):
        marked = lists.withColumn("label", F.col("rep")) if label is None else lists.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        open_ = marked.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("rep").alias("first"), F.max("rep").alias("final"), F.count(F.lit(1)).alias("members")).filter("least < most")
        if step < stars:
            centre = "first" if step % 2 == 0 else "final"
            pairs = marked.join(open_.select("key", F.col(centre).alias("centre")), "key").filter("rep <> centre")
            pairs = pairs.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
        else:
            left = marked.join(open_.filter(f"members <= {SHORT}").select("key"), "key", "left_semi")
            right = left.select("key", F.col("rep").alias("rep_b"), F.col("label").alias("label_b"))
            pairs = left.join(right, "key").filter("rep < rep_b AND label <> label_b").select(F.col("rep").alias("a"), F.col("rep_b").alias("b"))
            members = written(marked.join(open_.filter(f"members > {SHORT}").select("key"), "key", "left_semi").select("rep", "label").distinct(), "members")
            met = written(prefix_pairs(members, sets, texts, words, percent), "met")
            pairs = pairs.unionByName(finely_alike(met, texts, words, percent))
        found = written(confirmed(pairs.distinct(), sets, texts, matches, words, percent), "links")
        edges = found if edges is None else edges.unionByName(found)
        label = components(edges)
    rooted = sets.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select("s1", "s2", "row", F.coalesce("label", "rep").alias("root"))
    first = rooted.groupBy("root").agg(F.min("row").alias("first"))
    told = rooted.join(first, "root").select("s1", "s2", "first")
    some = rows.filter("n_shingles > 0").join(told, ["s1", "s2"]).select("id", "k1", "k2", "n_shingles", "first")
    none = rows.filter("n_shingles = 0").select("id", "k1", "k2", "n_shingles", F.lit(None).cast(some.schema["first"].dataType).alias("first"))
    return some.unionByName(none)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, coordinates: int = 32, matches: int = 13, stars: int = 2) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id of its class; null if all its rows have none)."""
    found = _classes(docs, id_col, text_col, words, percent, coordinates, matches, stars)
    null_last = lambda c: F.when(c < LAST, c)
    return found.select(null_last(F.col("id")).alias("id"), "n_shingles", null_last(F.coalesce("first.id", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, coordinates: int = 32, matches: int = 13, stars: int = 2) -> DataFrame:
    """One document of each class, the one of least id (of rows that share the
    least id the one of least text digest); all columns stay. Texts without words all stay."""
    found = written(_classes(docs, id_col, text_col, words, percent, coordinates, matches, stars), "classes").filter("n_shingles > 0")
    same = F.col("first") == F.struct("id", "k1", "k2")
    gone = found.filter(~same).select("id", "k1", "k2").distinct().alias("gone")
    own = [F.coalesce(docs[id_col].cast("long"), F.lit(LAST)), *_text_key(docs[text_col].cast("string"))]
    meets = lambda t: (own[0] == F.col(f"{t}.id")) & (own[1] == F.col(f"{t}.k1")) & (own[2] == F.col(f"{t}.k2"))
    kept = docs.join(gone, meets("gone"), "left_anti")
    again = found.filter(same).groupBy("id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").alias("again")
    if again.isEmpty():
        return kept
    # rows alike in id and text: one of them
    names = [f"c{i}" for i in range(len(docs.columns))]
    many = kept.join(again, meets("again"), "left_semi").toDF(*names)
    one = many.dropDuplicates([names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]]).toDF(*docs.columns)
    return kept.join(again, meets("again"), "left_anti").unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: near_duplicates() of all documents, three words a shingle, similarity 0.85."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
