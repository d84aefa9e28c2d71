"""Substring dedup by minimiser anchors, in place of a De Bruijn graph of all words.

A graph with an edge for each token k-mer has as many rows as there are words.
Instead one k-mer of each window (its anchor) stands for a run of consecutive
windows: equal windows have the same one at the same place. A run is a path of
that graph which is compacted before it leaves its document. Anchors that occur
again meet in a Spark join. If all runs of an anchor are equal, they are one
edge, and the least document stands for all their windows; where contexts
differ, single windows are joined. Nodes of k - 1 words, their degrees and joins
of successive edges are not made. 128-bit digests of the words verify that
spans are equal.

Defined results: a null or empty text has no words; texts shorter than a
window lose nothing; rows that share an id, like equal rows, do not remove each
other's words; a null id comes after all others; an empty table gives an empty
table. Only the two named columns are read, so others may have any name. A text
of any length is one row of its pack and is worked on whole, in segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import _packs as P
from loomline.llm import _text
from loomline.llm._scratch import written

U = np.uint64
WINDOW, K = 20, 8


def _digests(symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _text.spans_hash(symbols, first, end), _text.spans_hash(_text.second(symbols), first, end, _text._BASE2)


def _branching_windows(pack: P.Pack, row: dict, window: int, k: int) -> tuple:
    """Windows of the pack's branching anchors: document, start, two digests."""
    symbols, doc, *_ = pack.words()
    h, _, first, count = P.anchors(symbols, doc, window, k)
    at = np.isin(h, np.array(row["branching"] or [], np.int64).view(U))
    _, start = P.expand(first[at], count[at])
    return doc[start], start, *_digests(symbols, start, start + window)


def repeated_windows(packs: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """What each pack must know: compacted paths and branching anchors; repeated windows of the latter."""
    bits = P.bucket_bits(packs)
    hits = P.repeated(packs, lambda row: P.anchors(*P.Pack(row).words()[:2], window, k)[0], bits, 1 << 30)

    def edges(row: dict) -> Iterator[pa.RecordBatch]:
        pack = P.Pack(row)
        symbols, doc, *_ = pack.words()
        h, _, first, count = P.anchors(symbols, doc, window, k)
        own, n = np.unique(h, return_counts=True)
        at = P.marked(P.shortened(h, bits), row["marks"])[0] | np.isin(h, own[n > 1])
        h, first, count = h[at], first[at], count[at]
        r1, r2 = _digests(symbols, first, first + count + window - 1)
        one, lo, hi = P.least_by([h, r1, r2], pack.ids[doc[first]])
        if len(one):
            yield P.table(pack_id=pa.array([row["pack_id"]] * len(one), pa.int64()), edge=P.signed(h[one]), r1=P.signed(r1[one]), r2=P.signed(r2[one]), lo=pa.array(lo), hi=pa.array(hi))

    edge = written(P.each(P.with_notes(packs, hits), "pack_id long, edge long, r1 long, r2 long, lo long, hi long", edges), "edges")
    ends = (f(c).alias(f"{n}_{c}") for c in ("r1", "r2") for n, f in (("min", F.min), ("max", F.max)))
    paths = edge.groupBy("edge").agg(*ends, F.min("lo").alias("source"), F.count(F.lit(1)).alias("n"))
    paths = paths.withColumn("branching", F.expr("min_r1 <> max_r1 OR min_r2 <> max_r2")).select("edge", "source", "branching")
    # an edge that only one row holds, once, repeats nowhere
    told = edge.join(paths, "edge").filter("branching OR hi > source")
    notes = written(
        told.groupBy("pack_id").agg(
            F.expr("collect_set(edge) FILTER (WHERE branching)").alias("branching"),
            F.expr("collect_set(struct(edge, source)) FILTER (WHERE NOT branching)").alias("paths"),
        ),
        "paths",
    )

    def windows(row: dict) -> Iterator[pa.RecordBatch]:
        if not row["branching"]:
            return
        pack = P.Pack(row)
        doc, _, w1, w2 = _branching_windows(pack, row, window, k)
        one, lo, hi = P.least_by([w1, w2], pack.ids[doc])
        if len(one):
            yield P.table(pack_id=pa.array([row["pack_id"]] * len(one), pa.int64()), w1=P.signed(w1[one]), w2=P.signed(w2[one]), lo=pa.array(lo), hi=pa.array(hi))

    split = P.each(P.with_notes(packs, notes), "pack_id long, w1 long, w2 long, lo long, hi long", windows)
    # at most one entry a pack, whatever the number of occurrences
    again = split.groupBy("w1", "w2").agg(F.min("lo").alias("source"), F.max("hi").alias("hi"), F.collect_list("pack_id").alias("packs")).filter("hi > source")
    again = again.select(F.explode("packs").alias("pack_id"), "w1", "w2", "source")
    return notes, again.groupBy("pack_id").agg(F.collect_list(F.struct("w1", "w2", "source")).alias("windows"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, with_text: bool = False) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256, and the kept text (words joined by a blank) if asked for.

    A word is removed if it is in a window of ``window`` words whose word
    sequence also starts earlier: in a document of smaller id, or earlier in
    the same one.
    """
    spark = docs.sparkSession
    packs = P.packed(docs, id_col, text_col)

    def cut(row: dict) -> Iterator[pa.RecordBatch]:
        pack = P.Pack(row)
        symbols, doc, start, end = pack.words()
        h, _, first, count = P.anchors(symbols, doc, window, k)
        gone = []
        if row["paths"]:
            known = np.array([x["edge"] for x in row["paths"]], np.int64).view(U)
            source = np.array([x["source"] for x in row["paths"]], np.int64)
            order = np.argsort(known)
            known, source = known[order], source[order]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = (known[at] == h) & (source[at] < pack.ids[doc[first]])
            gone.append(P.expand(first[hit], count[hit])[1])
        if row["windows"]:
            w_doc, w_start, w1, w2 = _branching_windows(pack, row, window, k)
            known = np.array([(x["w1"], x["w2"]) for x in row["windows"]], np.int64).view(U)
            source = np.array([x["source"] for x in row["windows"]], np.int64)
            order = np.lexsort((known[:, 1], known[:, 0]))
            known, source = known[order], source[order]
            at = np.minimum(np.searchsorted(known[:, 0], w1), len(known) - 1)
            hit = (known[at, 0] == w1) & (known[at, 1] == w2) & (source[at] < pack.ids[w_doc])
            gone.append(w_start[hit])
        # earlier in the same document
        order = np.lexsort((h, doc[first]))
        twin = np.zeros(len(order), bool)
        same = (h[order][1:] == h[order][:-1]) & (doc[first][order][1:] == doc[first][order][:-1])
        twin[1:] |= same
        twin[:-1] |= same
        _, w_start = P.expand(first[order[twin]], count[order[twin]])
        if len(w_start):
            w1, w2 = _digests(symbols, w_start, w_start + window)
            by = np.lexsort((w_start, w2, w1, doc[w_start]))
            w_start, w1, w2 = w_start[by], w1[by], w2[by]
            gone.append(w_start[1:][(w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1]) & (doc[w_start][1:] == doc[w_start][:-1])])
        out = P.covered(np.concatenate(gone), window, len(symbols)) if gone else np.zeros(len(symbols), bool)
        edge = np.searchsorted(doc, np.arange(len(pack.ids) + 1))
        raw, n_words, n_gone, kept = pack.buf.tobytes(), [], [], []
        for i in range(len(pack.ids)):
            a, b = edge[i], edge[i + 1]
            lost = out[a:b]
            n_words.append(b - a)
            n_gone.append(int(lost.sum()))
            if n_gone[-1]:
                kept.append(b" ".join(raw[s:e] for s, e in zip(start[a:b][~lost].tolist(), end[a:b][~lost].tolist(), strict=True)))
            else:
                kept.append(b" ".join(raw[pack.begin[i] : pack.end[i]].split()))
        columns = {"id": pa.array(pack.raw_ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        if with_text:
            columns["text"] = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
        yield P.table(**columns)

    with P.small_batches(spark):
        notes, again = repeated_windows(packs, window, k)
        joined = P.with_notes(P.with_notes(packs, notes), again)
        return written(P.each(joined, "id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text, cut), "kept-words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: remove_repeats() on all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
