"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent letter n-grams (one to three code
points, words bounded by a blank), by rank. A document's own ranked n-grams are
compared with each profile: the out-of-place distance adds up how far each
n-gram's rank is from its rank in the profile, or a fixed most if it is not
there. The nearest language wins; ties go to the name smaller by code point.

Profiles are counted over all labelled documents that may be learned from, and
every text is judged whole. The operator takes a bound if asked (``max_train``
documents a language, those of the smallest hash of id and text); no query does.

Defined results: a null text or one without letters is ``und`` with score 0;
letters are what Unicode calls so, numerals and signs are not; an empty training
set makes every text ``und``; null ids and null labels are never learned from;
rows alike in id, text and label are learned from once; repeated rows are judged
one by one; an empty table gives an empty table. Only the named columns are
read, others may have any name; a text of any length is judged whole, in one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm._scratch import small_batches, written

#: N-grams of a profile.
TOP = 400
#: A text is of a known language if its score and margin reach SLACK of the LOW quantile of its language's training documents,
#: which is told from the counts of their sums, each rounded down to a STEPS-th.
LOW, SLACK, STEPS = 0.005, 0.5, 10_000
#: N-grams that are sorted at once, and distinct ones of all languages that a task holds before it sends their counts.
SORTED, HELD = 1 << 18, 1 << 20
#: Bytes of an Arrow batch of texts.
BATCH = "2m"
#: A language's training documents that are asked for at first, as a share of max_train: more than enough but for a chance of 1e-7.
SPARE = 1.25


#: ``\\w`` without decimal digits still has other numerals, which are no letters; few texts have any.
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text's runs of letters in lower case, a blank between two."""
    clean = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if clean.replace(" ", "").isalpha():
        return clean
    return " ".join("".join(c if c.isalpha() else " " for c in clean).split())


def grams(text: str) -> np.ndarray:
    """The codes of all n-grams of a text, n from 1 to 3: 21 bits a code point."""
    clean = letters(text)
    if not clean:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate((c[c != 32], two, three[c[1:-1] != 32]))


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, count = np.unique(codes, return_counts=True)
    if len(found) > top:
        least = np.partition(count, len(count) - top)[len(count) - top]
        keep = count >= least
        found, count = found[keep], count[keep]
    return found[np.lexsort((found, -count))][:top]


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sum of each one's counts."""
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
    return code[first], np.add.reduceat(n[order], first) if len(first) else n


class GramCounts:
    """Counts of n-grams by language, in memory that follows from SORTED and HELD alone, but for one text."""

    def __init__(self) -> None:
        self.raw: dict[str, list[np.ndarray]] = {}
        self.size: dict[str, int] = {}
        self.told: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, lang: str, codes: np.ndarray) -> None:
        self.raw.setdefault(lang, []).append(codes)
        self.size[lang] = self.size.get(lang, 0) + len(codes)
        if self.size[lang] >= SORTED:
            self._sort(lang)

    def _sort(self, lang: str) -> None:
        found, n = np.unique(np.concatenate(self.raw.pop(lang)), return_counts=True)
        self.size[lang] = 0
        had = self.told.get(lang)
        self.told[lang] = (found, n.astype(np.int64)) if had is None else summed([had[0], found], [had[1], n.astype(np.int64)])

    def full(self) -> bool:
        return sum(len(x) for x, _ in self.told.values()) >= HELD or sum(self.size.values()) >= HELD

    def flushed(self) -> Iterator[pa.RecordBatch]:
        for lang in sorted(self.raw):
            self._sort(lang)
        for lang, (found, n) in sorted(self.told.items()):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], names=["lang", "code", "n"])
        self.__init__()


def fit_profiles(labelled: DataFrame, text_col: str, lang_col: str, top: int = TOP) -> dict[str, np.ndarray]:
    """Each language's ranked n-grams, counted over all rows given. Counts are
    summed by task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = GramCounts()
        for batch in batches:
            texts = batch.column(0)
            for i, lang in enumerate(batch.column(1).to_pylist()):
                counts.add(lang, grams(texts[i].as_py()))
                if counts.full():
                    yield from counts.flushed()
        yield from counts.flushed()

    counts = labelled.select(F.col(text_col), F.col(lang_col)).mapInArrow(count, "lang string, code long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    with small_batches(labelled.sparkSession, BATCH):
        for row in best.orderBy("lang", "rank").collect():  # top rows a language
            out.setdefault(row.lang, []).append(row.code)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _learnable(id_col: str, text_col: str, lang_col: str) -> Column:
    return F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()


def _once(rows: DataFrame) -> DataFrame:
    """Rows alike in id, text and lang once. Only those whose hash occurs more than
    once are dealt out to be compared, so that other texts stay where they are."""
    rows = rows.withColumn("key", F.xxhash64("id", "text", "lang"))
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    keys = written(keys, "repeated-rows")
    if keys.isEmpty():
        return rows
    alike = rows.join(keys, "key", "left_semi").dropDuplicates(["id", "text", "lang"])
    return rows.join(keys, "key", "left_anti").unionByName(alike)


def training_rows(docs: DataFrame, may_learn: Column, id_col: str, text_col: str, lang_col: str, max_train: int | None = None) -> DataFrame:
    """The labelled documents to learn from, as text and lang: all, or at most
    ``max_train`` a language. A bound of the hash that follows from a language's
    number of documents leaves little more than these, so that no task ranks
    more rows however large the table or a language is."""
    rows = docs.filter(may_learn & _learnable(id_col, text_col, lang_col))
    if max_train is None:
        return _once(rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))).select("text", "lang")
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    share = F.lit(1.0)
    few = {r.lang: SPARE * max_train / r.n for r in counts if r.n > 2 * max_train}
    lang = F.col(lang_col).cast("string")
    for name, part in few.items():
        share = F.when(lang == name, part).otherwise(share)
    draw = F.xxhash64(F.col(id_col), F.col(text_col))
    some = rows.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang"), draw.alias("draw"), share.alias("share"))
    some = some.filter((F.col("draw").cast("double") / 2.0**64 + 0.5) <= F.col("share")).select("text", "lang", "draw").dropDuplicates(["lang", "draw", "text"])
    order = Window.partitionBy("lang").orderBy("draw", "text")
    return some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_train).select("text", "lang")


def classify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str, keep: list[Column], top: int = TOP, margin: bool = False) -> DataFrame:
    """The columns in ``keep`` with lang_pred and score (1 - mean distance over the most); with ``margin`` also that of the score over the second language's."""
    names = sorted(profiles, key=lambda x: x.encode("utf-8", "surrogatepass"))
    tables = []
    for name in names:
        order = np.argsort(profiles[name], kind="stable")
        tables.append((profiles[name][order], order.astype(np.int64)))

    def judge(text: str | None) -> tuple[str, float, float]:
        own = ranked(grams(text), top) if text else np.zeros(0, np.int64)
        if not len(own) or not tables:
            return "und", 0.0, 0.0
        place, best, second, name = np.arange(len(own)), None, None, "und"
        for lang, (codes, rank) in zip(names, tables, strict=True):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            far = int(np.where(codes[at] == own, np.abs(rank[at] - place), top).sum())
            if best is None or far < best:
                best, second, name = far, best, lang
            elif second is None or far < second:
                second = far
        most = top * len(own)
        return name, 1.0 - best / most, ((best if second is None else second) - best) / most

    kept = docs.select(*keep)
    asked = [*kept.columns, "lang_pred", "score", *(["margin"] if margin else [])]
    # by place, so that no name can clash
    columns = [f"c{i}" for i in range(len(asked))]
    rows = docs.select(*keep, F.col(text_col).cast("string")).toDF(*columns[: len(kept.columns)], "t")
    schema = rows.drop("t").schema.add(columns[len(kept.columns)], "string")
    for name in columns[len(kept.columns) + 1 :]:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            told = [judge(x.as_py()) for x in texts]
            more = [pa.array([x[2] for x in told], pa.float64())] if margin else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64()), *more], names=columns)

    return rows.mapInArrow(run, schema).toDF(*asked)


def held_out(id_col: str, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def _profiles(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_train: int | None, top: int) -> dict[str, np.ndarray]:
    """Of the documents outside the held-out fold."""
    train = training_rows(docs, ~held_out(id_col), id_col, text_col, lang_col, max_train)
    return fit_profiles(train, "text", "lang", top)


def identify(docs: DataFrame, keep: list[Column], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int | None = None, top: int = TOP) -> DataFrame:
    """Fit on the documents outside the held-out fold, then judge all."""
    return classify(docs, _profiles(docs, id_col, text_col, lang_col, max_train, top), text_col, keep, top)


def least_scores(told: DataFrame) -> dict[str, float]:
    """Per language, the score and margin together that a text must reach: SLACK of
    the low quantile of the training documents (those with a ``label``) that are
    told as labelled. Only counts are gathered, STEPS * 2 a language at most."""
    right = told.filter("lang_pred = label").select("label", F.floor((F.col("score") + F.col("margin")) * STEPS).alias("step"))
    counts = right.groupBy("label", "step").agg(F.count(F.lit(1)).alias("n"))
    low = counts.groupBy("label").agg(F.percentile("step", F.lit(LOW), F.col("n")).alias("low"))
    return {r.label: SLACK * r.low / STEPS for r in low.collect()}


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int | None = None) -> DataFrame:
    """The documents whose language can be told; others (no letters, or n-grams unlike any profile's training texts) go.

    Profiles and thresholds come from all documents outside the held-out fold;
    all texts are judged once, and written with what was told of them.
    """
    spark = docs.sparkSession
    profiles = _profiles(docs, id_col, text_col, lang_col, max_train, TOP)
    label = F.when(~held_out(id_col) & _learnable(id_col, text_col, lang_col), F.col(lang_col).cast("string"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    told = classify(docs, profiles, text_col, [*(F.col(f"`{c}`") for c in docs.columns), label], margin=True)
    with small_batches(spark, BATCH):
        told = written(told.toDF(*names, "label", "lang_pred", "score", "margin"), "languages")
    known = F.lit(False)
    for lang, low in least_scores(told).items():
        known = known | ((F.col("lang_pred") == lang) & (F.col("score") + F.col("margin") >= low))
    return told.filter(known).select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: identify() over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, [F.col("doc_id"), held_out("doc_id").alias("held_out")])
