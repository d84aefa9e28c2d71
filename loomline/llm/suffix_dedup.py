"""Suffix-array dedup by deep-shallow sorting of the suffixes that may repeat.

Texts are bytes. Three steps narrow down which suffixes are sorted, and none
loses a repeat:

1. A text is cut in chunks where the hash of what follows says so. A chunk
   with the ``window - 1`` bytes after it holds all windows that begin in it.
   If the same bytes are a chunk of a smaller document, these windows are
   settled: their bytes go, and the smaller document has each of them too.
2. An anchor (see :mod:`loomline.llm._packs`) of the other windows that occurs
   in more than one place brings its windows along, as one run of bytes.
3. Runs go to buckets by the hash of their anchor, a bucket for some packs, a
   block of each pack at most; equal runs of a pack are one. A bucket is solved
   in parts of bounded size. Equal windows have their anchor at the
   same offset, so the suffixes that begin in the runs are sorted by anchor,
   offset and their first ``window`` bytes: multikey quicksort, eight bytes a
   key, to a shallow depth; groups that are still tied go on as blind tries.
   Equal suffixes are neighbours then, the least document of each class is
   the one that keeps it, and a block is answered in its own order.

An anchor that very many packs hold would make one task large; its windows
travel one by one instead, as suffixes of their own, and meet by content.

Defined results: null texts are empty; texts shorter than a window lose
nothing; rows that share an id do not remove each other's bytes; a null id
comes after all others; an empty table gives an empty table. Only the two named
columns are read, so others may have any name. A text of any length is one
row of its pack and is worked on whole, in segments. Cuts may split a
character; with_text decodes with U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import _packs as P
from loomline.llm import _text
from loomline.llm._scratch import dropped, tidied, written

U = np.uint64
WINDOW, K = 50, 20
#: A chunk begins where this many bits of the hash of the next CUT bytes are 0: 128 bytes on the average.
CHUNK_BITS, CUT = 7, 16
#: Depth in bytes at which blind tries take over from multikey quicksort.
SHALLOW = 16
#: Packs that hold an anchor from which on its windows travel one by one.
HOT = 64
#: Packs a bucket, at least half as many: with a bucket a pack there are as many blocks as the square of the packs, and
#: what a block costs besides its bytes outgrows the rest from some gigabytes on.
SHARE = 8
#: Bytes of a bucket's runs that are sorted at once (runs of one anchor stay together).
PART = 4 << 20


def eight_bytes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, zeros after the end."""
    wide = np.concatenate((buf, np.zeros(8, np.uint8))).astype(U)
    out = np.zeros(len(buf) + 1, U)
    for j in range(8):
        out |= wide[j : j + len(out)] << U(56 - 8 * j)
    return out


def common_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bytes that the numbers have in common, 0 to 8."""
    z = x ^ y
    out = np.where(z == 0, 1, 0)
    for bits in (32, 16, 8):
        none = (z >> U(64 - bits)) == 0
        out += np.where(none, bits // 8, 0)
        z = np.where(none, z << U(bits), z)
    return out


def multikey_quicksort(eight: np.ndarray, start: np.ndarray, order: np.ndarray, head: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the groups ``order[lo:hi]`` by their first ``depth`` bytes, all groups in step.

    Each group is parted in three by a pivot's eight bytes at the group's depth
    (median of three); the middle part goes on eight bytes deeper. Marks in
    ``head`` where a part begins; returns the groups still tied.
    """
    at = np.zeros(len(lo), np.int64)
    tied = [(lo[:0], hi[:0])]
    while len(lo):
        size = hi - lo
        group, pos = P.expand(lo, size)
        s = order[pos]
        key = eight[start[s] + at[group]]
        first = np.cumsum(size) - size
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        rank, n = [], []
        for part in (less, same, more):
            upto = np.cumsum(part)
            before = upto[first] - part[first]
            rank.append(upto - 1 - before[group])
            n.append(upto[first + size - 1] - before)
        mid, high = lo + n[0], lo + n[0] + n[1]
        order[np.where(less, lo[group] + rank[0], np.where(same, mid[group] + rank[1], high[group] + rank[2]))] = s
        head[mid] = True
        head[high[n[2] > 0]] = True
        deeper = at + 8
        done = (deeper >= depth) & (n[1] > 1)
        tied.append((mid[done], high[done]))
        new_lo, new_hi = np.concatenate((lo, mid, high)), np.concatenate((mid, high, hi))
        new_at = np.concatenate((at, deeper, at))
        go = (new_hi - new_lo > 1) & (new_at < depth)
        lo, hi, at = new_lo[go], new_hi[go], new_at[go]
    return np.concatenate([x for x, _ in tied]), np.concatenate([x for _, x in tied])


def blind_tries(buf: np.ndarray, eight: np.ndarray, start: np.ndarray, order: np.ndarray, head: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, length: int) -> None:
    """Sort the groups ``order[lo:hi]``, tied to ``depth``, by ``length`` bytes.

    A blind trie's node is a range of suffixes with the depth to which all of
    them agree; its edges have only the one byte at that depth as label. All
    groups' tries grow together, from their roots down, a level at a time: what
    is between a node's depth and its parent's is looked at once, and suffixes
    that agree to ``length`` are one leaf. Each level splits every node it
    keeps, so there are at most ``length - depth`` levels.
    """
    steps = [*range(depth, length - 7, 8), *([length - 8] if (length - depth) % 8 else [])]
    while len(lo):
        size = hi - lo
        node, pos = P.expand(lo, size)
        s = start[order[pos]]
        lead = start[order[lo]][node]
        agree = np.full(len(s), length, np.int64)
        for d in reversed(steps):
            same = common_bytes(eight[s + d], eight[lead + d])
            agree = np.where(same < 8, d + same, agree)
        skip = np.minimum.reduceat(agree, np.cumsum(size) - size)
        inner = skip < length
        keep = inner[node]
        node, pos, s = node[keep], pos[keep], s[keep]
        if not len(node):
            return
        label = buf[s + skip[node]]
        by = np.lexsort((label, node))
        order[pos] = order[pos][by]
        new = np.ones(len(by), bool)  # node is in order already
        new[1:] = (label[by][1:] != label[by][:-1]) | (node[1:] != node[:-1])
        child = np.flatnonzero(new)
        head[pos[child]] = True
        count = np.diff(np.append(child, len(pos)))
        lo, hi = pos[child][count > 1], (pos[child] + count)[count > 1]


def deep_shallow(buf: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``start`` by group, then by their first
    ``length`` bytes, and whether each in that order differs from the one before."""
    eight, n = eight_bytes(buf), len(start)
    order = np.argsort(group, kind="stable")
    head = np.ones(n, bool)
    head[1:] = group[order][1:] != group[order][:-1]
    lo = np.flatnonzero(head)
    hi = np.append(lo[1:], n)[: len(lo)]
    many = hi - lo > 1
    shallow = min(SHALLOW, length // 8 * 8)
    lo, hi = multikey_quicksort(eight, start, order, head, lo[many], hi[many], shallow)
    blind_tries(buf, eight, start, order, head, lo, hi, shallow, length)
    return order, head


def least_documents(buf: np.ndarray, begin: np.ndarray, count: np.ndarray, key: np.ndarray, off: np.ndarray, lo: np.ndarray, length: int) -> np.ndarray:
    """The least document of each window of runs, one after the other: a run
    begins at ``begin``, has ``count`` windows, and its anchor is ``off`` bytes
    on. Runs are in order of ``key``, only runs of one key are compared."""
    which, start = P.expand(begin, count)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    # equal windows have their anchor at the same offset, maybe before a run of its own
    group = (np.cumsum(new)[which] * 2 + 1) * length + off[which] - (start - begin[which])
    order, head = deep_shallow(buf, start, group, length)
    least = np.minimum.reduceat(lo[which][order], np.flatnonzero(head)) if len(order) else np.zeros(0, np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = least[np.cumsum(head) - 1]
    return out


def _run_keys(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, off: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and digest of runs of bytes. A window that travels by itself (its
    offset is that of no anchor) has its own digest as anchor."""
    symbols = _text.byte_symbols(buf)
    r1 = _text.spans_hash(symbols, begin, begin + size)
    single = off == window
    h = _text.sliding(symbols, k)[begin + np.where(single, 0, off)] if len(begin) else r1
    return np.where(single, _text.mix(r1 ^ U(0x8CB92BA72F3D8DD7)), h), r1


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return _text.mix(key ^ U(0x2545F4914F6CDD1D)) >> U(64 - bits)


def bucket_bits(packs: int) -> int:
    return min(31, max(5, (packs // SHARE).bit_length()))


def _resolve(window: int, k: int):
    """Of a bucket's runs, block by block: how many least documents are told of
    a run (none, one for all its windows, or one a window), and which."""
    most = PART

    def told_of(buf: np.ndarray, size: np.ndarray, off: np.ndarray, lo: np.ndarray, more: np.ndarray, key: np.ndarray, r1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.cumsum(size) - size
        one, least, _, of = P.classes([key, r1], lo)
        key = key[one]
        alone = np.ones(len(key), bool)  # the only context of its anchor
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        count = np.where(alone, 1, size[one] - window + 1)
        place = np.cumsum(count) - count
        flat = np.repeat(least, count)
        many = np.flatnonzero(~alone)
        if len(many):
            flat[P.expand(place[many], count[many])[1]] = least_documents(buf, begin[one][many], count[many], key[many], off[one][many], least[many], window)
        low, high = np.minimum.reduceat(flat, place), np.maximum.reduceat(flat, place)
        told = np.where(low[of] >= lo + more, 0, np.where(low[of] == high[of], 1, count[of]))
        return told, flat[P.expand(place[of], told)[1]]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        n = [int(x) for x in part["n"]]
        size, off, lo, more = (np.concatenate([P.unplanes(x) for x in part[c]]).astype(np.int64) for c in ("size", "off", "lo", "more"))
        press = zstandard.ZstdDecompressor()
        buf = np.frombuffer(b"".join([press.decompress(x) for x in part["text"]]), np.uint8)
        begin = np.cumsum(size) - size
        key, r1 = np.empty(len(size), U), np.empty(len(size), U)
        slices = np.flatnonzero(np.diff(begin // most, prepend=-1))
        for x, y in zip(slices, np.append(slices[1:], len(size)), strict=True):
            first, end = begin[x], begin[y - 1] + size[y - 1]
            key[x:y], r1[x:y] = _run_keys(buf[first:end], begin[x:y] - first, size[x:y], off[x:y], window, k)
        share = _text.mix(key ^ U(0x6A09E667F3BCC909)) % U(len(buf) // most + 1)
        told, found = np.empty(len(size), np.int64), []
        order = np.argsort(share, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(share[order])) + 1):
            told[at], values = told_of(buf[P.expand(begin[at], size[at])[1]], size[at], off[at], lo[at], more[at], key[at], r1[at])
            found.append((at, values))
        place = np.cumsum(told) - told
        values = np.empty(int(told.sum()), np.int64)
        for at, x in found:
            values[P.expand(place[at], told[at])[1]] = x
        ends = np.cumsum(n)[:-1]
        upto = np.concatenate(([0], np.cumsum(told)))[ends]
        return pd.DataFrame({"pack_id": part["pack_id"], "bucket": part["bucket"], "told": [P.planes(x) for x in np.split(told, ends)], "least": [P.planes(x) for x in np.split(values, upto)]})

    return solve


def _chunks(pack: P.Pack, symbols: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The chunks that windows begin in: document, begin, end of the begins of windows, digests."""
    n = len(symbols)
    cut = np.zeros(n, bool)
    g = _text.sliding(symbols, CUT)
    cut[: len(g)] = (g & U((1 << CHUNK_BITS) - 1)) == 0
    cut[:1] = True
    cut[1:] |= doc[1:] != doc[:-1]
    begin = np.flatnonzero(cut)
    upto = np.append(begin[1:], n)[: len(begin)]
    own = doc[begin] >= 0
    begin, upto = begin[own], upto[own]
    of = doc[begin]
    upto = np.minimum(upto, pack.end[of] - window + 1)
    some = upto > begin
    begin, upto, of = begin[some], upto[some], of[some]
    end = upto + window - 1
    return of, begin, upto, _text.spans_hash(symbols, begin, end), _text.spans_hash(_text.second(symbols), begin, end, _text._BASE2)


def settled(packs: DataFrame, window: int, bits: int) -> DataFrame:
    """The packs with ``settled``: begin and end (bytes of two arrays of longs)
    of the begins of windows in chunks that a smaller document has as well."""

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        pack = P.Pack(row)
        of, _, _, r1, r2 = _chunks(pack, *pack.bytes(), window)
        one, lo, _ = P.least_by([r1, r2], pack.ids[of])
        if len(one):
            r1, r2 = r1[one], r2[one]  # in the order of r1
            bucket = (r1 >> U(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = lambda x: pa.array([y.tobytes() for y in np.split(x, cut[1:])], pa.binary())
            yield P.table(pack_id=pa.array([row["pack_id"]] * len(cut), pa.int64()), bucket=pa.array(bucket[cut], pa.int32()), r1=parts(r1), r2=parts(r2), lo=parts(lo))

    def least(part: pd.DataFrame) -> pd.DataFrame:
        size = [len(x) // 8 for x in part["lo"]]
        r1, r2 = (np.frombuffer(b"".join(part[c]), U) for c in ("r1", "r2"))
        lo = np.frombuffer(b"".join(part["lo"]), np.int64)
        order = np.lexsort((lo, r2, r1))
        new = np.ones(len(order), bool)
        new[1:] = (r1[order][1:] != r1[order][:-1]) | (r2[order][1:] != r2[order][:-1])
        first = np.empty(len(order), np.int64)
        first[order] = lo[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        at = np.cumsum(size)[:-1]
        told = [(x[m < y].tobytes(), m[m < y].tobytes()) for x, y, m in zip(np.split(r1, at), np.split(lo, at), np.split(first, at), strict=True)]
        return pd.DataFrame({"pack_id": part["pack_id"], "r1": [x for x, _ in told], "least": [x for _, x in told]})

    def mark(row: dict) -> Iterator[pa.RecordBatch]:
        pack = P.Pack(row)
        of, begin, upto, r1, r2 = _chunks(pack, *pack.bytes(), window)
        ids = pack.ids[of]
        name, at = np.unique(r1, return_inverse=True)
        least_id = np.full(len(name), P.LAST)
        np.minimum.at(least_id, at, ids)
        if row["told"]:
            known = np.frombuffer(b"".join(x["r1"] for x in row["told"]), U)
            where = np.searchsorted(name, known)
            least_id[where] = np.minimum(least_id[where], np.frombuffer(b"".join(x["least"] for x in row["told"]), np.int64))
        gone = least_id[at] < ids
        yield P.table(pack_id=pa.array([row["pack_id"]], pa.int64()), ids=pa.array([row["ids"]], pa.list_(pa.int64())), sizes=pa.array([row["sizes"]], pa.list_(pa.int64())), blob=pa.array([row["blob"]], pa.binary()), settled=pa.array([np.concatenate((begin[gone], upto[gone])).tobytes()], pa.binary()))

    sent = P.each(packs, "pack_id long, bucket int, r1 binary, r2 binary, lo binary", send)
    told = sent.groupBy("bucket").applyInPandas(least, "pack_id long, r1 binary, least binary").filter(F.length("r1") > 0)
    told = told.groupBy("pack_id").agg(F.collect_list(F.struct("r1", "least")).alias("told"))  # a bucket's row at most
    return written(P.each(P.with_notes(packs, told), "pack_id long, ids array<long>, sizes array<long>, blob binary, settled binary", mark), "settled-packs")


def _live(row: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the settled begins of windows, and which bytes are no such begin."""
    begin, upto = np.frombuffer(row["settled"], np.int64).reshape(2, -1)
    step = np.zeros(n + 1, np.int8)
    step[begin] += 1
    step[upto] -= 1
    return begin, upto, np.cumsum(step[:-1], dtype=np.int8) == 0


def remove_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of
    [start, end) byte offsets removed), and the kept text if asked for.

    A byte is removed if a ``window``-byte string that covers it also starts in
    a document of smaller id.
    """
    spark = docs.sparkSession
    raw_packs = P.packed(docs, id_col, text_col)
    bits = bucket_bits(raw_packs.count())
    with P.small_batches(spark):
        packs = settled(raw_packs, window, bits)
    dropped(raw_packs)
    tidied(spark)

    def anchors_of(row: dict) -> np.ndarray:
        symbols, doc = P.Pack(row).bytes()
        return P.anchors(symbols, doc, window, k, _live(row, len(symbols))[2])[0]

    def runs_of(row: dict) -> tuple:
        """The pack's runs that may repeat: first window, number of windows, anchor's offset, and class of each; one of each class, its least and greatest document, its bucket."""
        pack = P.Pack(row)
        symbols, doc = pack.bytes()
        settled_spans = _live(row, len(symbols))
        h, pos, first, count = P.anchors(symbols, doc, window, k, settled_spans[2])
        own, n = np.unique(h, return_counts=True)
        many, single = P.marked(P.shortened(h, bits), row["marks"])
        at = many | np.isin(h, own[n > 1])
        pos, first, count, single = pos[at], first[at], count[at], single[at]
        one_by_one = P.expand(first[single], count[single])[1]
        off = np.concatenate(((pos - first)[~single], np.full(len(one_by_one), window)))
        first = np.concatenate((first[~single], one_by_one))
        count = np.concatenate((count[~single], np.ones(len(one_by_one), np.int64)))
        key, r1 = _run_keys(pack.buf, first, count + window - 1, off, window, k)
        bucket = _bucket(key, bits)
        one, lo, hi, of = P.classes([bucket, key, r1], pack.ids[doc[first]])
        return pack, doc, settled_spans, first, count, off, of, one, lo, hi, bucket[one]

    def runs(row: dict) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, _, _, first, count, off, _, one, lo, hi, bucket = runs_of(row)
        if not len(one):
            return
        press = zstandard.ZstdCompressor(level=3)
        buckets, cut = P.in_buckets(bucket)
        size = count[one] + window - 1
        parts = lambda x: [P.planes(y) for y in np.split(x, cut[1:])]
        text = [press.compress(pack.buf[P.expand(f, n)[1]].tobytes()) for f, n in zip(np.split(first[one], cut[1:]), np.split(size, cut[1:]), strict=True)]
        columns = {"size": parts(size), "off": parts(off[one]), "lo": parts(lo), "more": parts(hi - lo), "text": text}
        yield P.table(pack_id=pa.array([row["pack_id"]] * len(cut), pa.int64()), bucket=pa.array(buckets, pa.int32()), n=pa.array(np.diff(np.append(cut, len(one)))), **{c: pa.array(x, pa.binary()) for c, x in columns.items()})

    def cut(row: dict) -> Iterator[pa.RecordBatch]:
        pack, doc, (begin, upto, _), first, count, _, of, *_ = runs_of(row)
        gone = np.zeros(0, np.int64)
        if row["answers"]:
            told = np.concatenate([P.unplanes(x["told"]) for x in row["answers"]]).astype(np.int64)
            least = np.concatenate([P.unplanes(x["least"]) for x in row["answers"]]).astype(np.int64)
            place = np.cumsum(told) - told
            at = np.flatnonzero(told[of] > 0)
            which, start = P.expand(first[at], count[at])
            run = of[at][which]
            gone = start[least[place[run] + np.where(told[run] > 1, start - first[at][which], 0)] < pack.ids[doc[start]]]
        out = P.covered(gone, window, len(doc), begin, upto + window - 1)
        raw, edge = pack.buf.tobytes(), np.diff(np.concatenate(([0], out.view(np.int8), [0])))
        ups, downs = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        a, b = np.searchsorted(ups, pack.begin), np.searchsorted(ups, pack.end)
        kept, spans = [], []
        for i in range(len(pack.ids)):
            p, own_spans, left = int(pack.begin[i]), [], []
            for x, y in zip(ups[a[i] : b[i]].tolist(), downs[a[i] : b[i]].tolist(), strict=True):
                left.append(raw[p:x])
                own_spans.append([x - int(pack.begin[i]), y - int(pack.begin[i])])
                p = y
            left.append(raw[p : pack.end[i]])
            kept.append(b"".join(left))
            spans.append(own_spans)
        size = pack.end - pack.begin
        columns = {"id": pa.array(pack.raw_ids, pa.int64()), "n_bytes": pa.array(size), "n_removed": pa.array(size - np.array([len(x) for x in kept], np.int64)), "n_spans": pa.array([len(x) for x in spans], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
        if with_text:
            columns["text"] = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
        yield P.table(**columns)

    with P.small_batches(spark):
        marks = written(P.repeated(packs, anchors_of, bits, hot), "marks")
        tidied(spark)
        met = P.each(P.with_notes(packs, marks), "pack_id long, bucket int, n long, size binary, off binary, lo binary, more binary, text binary", runs)
        answers = written(met.groupBy("bucket").applyInPandas(_resolve(window, k), "pack_id long, bucket int, told binary, least binary"), "least-documents")
        tidied(spark)
        answers = answers.groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "told", "least"))).alias("answers"))
        joined = P.with_notes(P.with_notes(packs, answers), marks)
        schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + ", text string" * with_text
        return written(P.each(joined, schema, cut), "kept-bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: remove_spans() on all documents."""
    got = remove_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.withColumnRenamed("id", "doc_id").drop("spans")
