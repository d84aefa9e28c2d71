"""LM scoring by cross-entropy difference.

Two interpolated bigram models, one of a target corpus and one of the
background (all documents), share one vocabulary: every word of the corpus and
one unseen word. A document's score is its mean loss a token under the
background less that under the target: the larger, the more like the target.

Nothing is sampled, hashed to a fixed size or collected: each distinct word and
pair of neighbours has its own count (under a hash of 44 bits or more, which
grows with the input); a word also counts what follows it. Documents are packed
once. A pack sends its distinct n-grams with their counts to buckets by hash
(sorted keys as differences, numbers as compressed byte planes), a bucket adds
them up and answers each pack with what the others have, in the pack's own
order, and the pack is scored where its answers meet it. Most pairs are in one
pack only, and their answer, nought, takes next to no space. Buckets grow in
number with the packs, so a bucket's work stays as large as a few packs'; a
pack sends a row a distinct n-gram at most. Only three sums reach the driver.

Defined results: ids are integers; a null text or one without words has no
tokens and null scores; target ids that are null or repeated do no harm; an
empty target leaves a smoothed, uniform model; an empty table gives an empty
table; repeated rows are scored one by one. Only the named columns are read, so
others may have any name. A text of any length is one row of its pack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import _packs, _text
from loomline.llm._packs import Pack, table
from loomline.llm._scratch import tidied, written

U = np.uint64
#: The lowest bit of a word's key is 1, of a pair's 0. A key is KEY bytes beside the bits of its bucket.
_PAIR, _ODD, KEY = U(0xA54FF53A5F1D36F1), U(0x9E3779B97F4A7C15), 5
#: Counts of a key in either model: itself, and how much less often something follows it (0 for pairs, mostly for words).
_COUNTS = ("background", "target", "ends_background", "ends_target")
#: Documents of the target up to which their places are broadcast (some 12 bytes each); more are joined by shuffle.
BROADCAST_PLACES = 1_000_000
#: The word that stands before a document's first one; only what follows it is counted.
_BEGIN = U(0)


def _grams(pack: Pack, bits: int) -> tuple[np.ndarray, ...]:
    """Each word's document; distinct keys of ``bits`` + 8 * KEY bits, ascending; index in them of each word, of the word before it and of each pair."""
    word, doc, *_ = pack.words()
    first = np.ones(len(word), bool)
    first[1:] = doc[1:] != doc[:-1]
    before = np.full(len(word), _BEGIN, U)
    before[1:] = np.where(first[1:], _BEGIN, word[:-1])
    cut = U(64 - bits - 8 * KEY)
    pair = _text.mix(_text.mix(before ^ _PAIR) * _ODD + word)
    keys = np.concatenate((word >> cut | U(1), [_BEGIN >> cut | U(1)], (pair >> cut) & ~U(1)))
    own, at = np.unique(keys, return_inverse=True)
    n = len(word)
    own_word, begin, own_pair = at[:n], at[n], at[n + 1 :]
    context = np.full(n, begin)
    context[1:] = np.where(first[1:], begin, own_word[:-1])
    return doc, own, own_word, context, own_pair


def _short(keys: np.ndarray) -> bytes:
    """The KEY low bytes of ascending keys, as differences."""
    low = keys & U((1 << 8 * KEY) - 1)
    return _packs.planes(np.diff(low, prepend=U(0)), KEY)


def _long(x: bytes) -> np.ndarray:
    return np.cumsum(_packs.unplanes(x), dtype=U)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers of either sign, small ones short."""
    return _packs.planes(((x << 1) ^ (x >> 63)).view(U))


def _wide(x: bytes) -> np.ndarray:
    z = _packs.unplanes(x)
    return (z >> U(1)).astype(np.int64) ^ -(z & U(1)).astype(np.int64)


def bucket_bits(packs: DataFrame) -> int:
    return min(24, max(4, packs.count().bit_length() - 1))


def _own_counts(pack: Pack, hits: list[int] | None, doc: np.ndarray, own: np.ndarray, word: np.ndarray, context: np.ndarray, pair: np.ndarray) -> dict[str, np.ndarray]:
    """The pack's own counts of its keys; ``hits`` are the documents of the target. The sign before a first word ends less than never."""
    wanted = np.zeros(len(pack.ids), bool)
    wanted[np.array(hits or [], np.int64)] = True
    at, hit = np.concatenate((word, pair)), wanted[doc]
    count = lambda x: np.bincount(x, minlength=len(own))
    words = (own & U(1)) == 1
    n = {"background": count(at), "target": count(at[np.tile(hit, 2)])}
    ends = {"ends_background": n["background"] - count(context), "ends_target": n["target"] - count(context[hit])}
    return n | {k: np.where(words, x, 0) for k, x in ends.items()}


def target_places(packs: DataFrame, target: DataFrame) -> DataFrame:
    """Per pack: ``hits``, the places of the target's documents in it."""
    ids = target.select(F.col(target.columns[0]).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    return packs.select("pack_id", F.posexplode("ids").alias("pos", "id")).join(ids, "id").groupBy("pack_id").agg(F.collect_list("pos").alias("hits"))


def _with_places(packs: DataFrame, hits: DataFrame) -> DataFrame:
    """The packs with their target documents; few places are broadcast, so that packs are not shuffled."""
    few = (hits.agg(F.sum(F.size("hits"))).first()[0] or 0) <= BROADCAST_PLACES
    return packs.join(F.broadcast(hits), "pack_id", "left") if few else _packs.with_notes(packs, hits)


def totals(packs: DataFrame, hits: DataFrame) -> DataFrame:
    """Per (pack_id, bucket): what other packs add to the counts of the pack's distinct keys.
    A row of each bucket with a null pack_id has its number of words (kinds, then tokens in both)."""
    bits = bucket_bits(packs)

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        pack = Pack(row)
        doc, own, word, context, pair = _grams(pack, bits)
        if not len(doc):
            return
        n = _own_counts(pack, row["hits"], doc, own, word, context, pair)
        bucket = (own >> U(8 * KEY)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        parts = lambda x, f: pa.array([f(y) for y in np.split(x, cut[1:])], pa.binary())
        yield table(pack_id=pa.array([row["pack_id"]] * len(cut), pa.int64()), bucket=pa.array(bucket[cut]), keys=parts(own, _short), **{k: parts(x, _narrow) for k, x in n.items()})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        own = [_long(k) for k in rows["keys"]]
        ends = np.cumsum([len(k) for k in own])[:-1]
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        total, out = [], {"pack_id": rows["pack_id"].astype("Int64"), "bucket": rows["bucket"]}
        for name in _COUNTS:
            here = np.concatenate([_wide(x) for x in rows[name]])
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, at, here)
            total.append(n)
            out[name] = [_narrow(x) for x in np.split(n[at] - here, ends)]
        words = ((keys & U(1)) == 1) & (total[0] > 0)
        out = pd.DataFrame(out).assign(kinds=0, n_background=0, n_target=0)
        sums = pd.DataFrame({"pack_id": pd.array([None], "Int64"), "bucket": rows["bucket"].iloc[:1].to_numpy(), **{k: [b""] for k in _COUNTS}, "kinds": [int(words.sum())], "n_background": [int(total[0][words].sum())], "n_target": [int(total[1][words].sum())]})
        return pd.concat([out, sums], ignore_index=True)

    kinds = ", ".join(f"{k} binary" for k in _COUNTS)
    sent = _packs.each(_with_places(packs, hits), f"pack_id long, bucket long, keys binary, {kinds}", send)
    return sent.groupBy("bucket").applyInPandas(add, f"pack_id long, bucket long, {kinds}, kinds long, n_background long, n_target long")


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = 0.6) -> DataFrame:
    """Per row: id, n_tokens, loss_target and loss_background (nats a token), score.

    ``target`` has the ids of the target corpus in its first column; ``weight``
    is the share of the pair's probability, the rest being the word's.
    """
    with _packs.small_batches(docs.sparkSession):
        packs = _packs.packed(docs, id_col, text_col)
        bits = bucket_bits(packs)
        hits = written(target_places(packs, target), "target-places")
        counts = written(totals(packs, hits), "ngram-totals")
    tidied(docs.sparkSession)
    kinds, *sizes = (x or 0 for x in counts.filter("pack_id IS NULL").agg(F.sum("kinds"), F.sum("n_background"), F.sum("n_target")).first())
    answers = counts.filter("pack_id IS NOT NULL").groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("bucket", *_COUNTS))).alias("answers"))

    def judge(row: dict) -> Iterator[pa.RecordBatch]:
        pack = Pack(row)
        doc, own, word, context, pair = _grams(pack, bits)
        here = _own_counts(pack, row["hits"], doc, own, word, context, pair)
        n, mean = np.bincount(doc, minlength=len(pack.ids)), []
        told = row["answers"] or []
        for name, size in zip(("background", "target"), sizes, strict=True):
            # a pack has a row of each bucket that it sent to, in the order of its own keys
            count, ends = (here[k] + (np.concatenate([_wide(a[k]) for a in told]) if told else 0) for k in (name, f"ends_{name}"))
            after = count - ends
            p = (count[word] + 0.5) / (size + 0.5 * (kinds + 1))
            seen = after[context]
            loss = -np.log(weight * np.where(seen > 0, np.minimum(count[pair], seen) / np.maximum(seen, 1), p) + (1 - weight) * p)
            mean.append(np.bincount(doc, loss, len(pack.ids)) / np.maximum(n, 1))
        none = n == 0
        real = lambda x: pa.array(x, pa.float64(), mask=none)
        yield table(id=pa.array(pack.raw_ids, pa.int64()), n_tokens=pa.array(n.astype(np.int64)), loss_target=real(mean[1]), loss_background=real(mean[0]), score=real(mean[0] - mean[1]))

    return _packs.each(_with_places(_packs.with_notes(packs, answers), hits), "id long, n_tokens long, loss_target double, loss_background double, score double", judge)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: score() of all documents; the target is what labels call good."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels.filter("quality = 1").select("doc_id")).withColumnRenamed("id", "doc_id")
