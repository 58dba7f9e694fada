"""Operator 6: exact removal of repeated passages by merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes covers it that also starts earlier
(in a smaller doc_id, or earlier in the document).

1. Anchors. Of the ``K``-byte strings inside a window of ``length`` bytes the
   one with the smallest hash (the leftmost of equals) is the window's anchor.
   Equal windows have equal anchors at equal places, so windows only need to
   meet others of their anchor; about one byte in 35 starts an anchor. Anchors
   that occur once in the corpus are dropped: their windows are unique.
2. Stretches. Around each remaining anchor lies a stretch, the union of its
   windows. Equal stretches are one from here on, with their earliest place, so
   copies never meet. An anchor with over ``HOT`` different stretches is cut
   into single windows, dealt out by their own hash.
3. Transforms. Stretches are split at the anchor; what follows it, and what
   precedes it read backwards, are two collections of strings over 8-byte
   symbols. Shards of both get Burrows-Wheeler transforms, which are merged by
   interleave refinement (``bwt``), and the common prefixes that the last merge
   leaves cut the sorted strings into repeated intervals. Two windows that
   start j bytes before the anchor are equal if they lie in the same interval
   of depth length-j on the right and of depth j on the left; the earliest of
   them stays, the others start a removal.
4. Each document gathers its stretches and what stays of them, and its bytes
   are cut.

No group is unbounded: a task handles complete anchors in batches, and hot
anchors were cut. All comparisons are of whole bytes, none of hashes.

Defined results. Null or empty text: nothing to remove, the digest of the empty
string. Rows equal in doc_id and text are one document and get the same result
each, and their places are gathered as a set, so copies of a row cost what other rows do; rows that share only the doc_id are ordered by their text's hash. A null
doc_id comes before all others. Empty table: empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bwt
from . import words as W
from .common import Saved, pieces, raw_text, release, small_batches, table

LENGTH, K = 100, 32
HOT, BATCH, SHARD = 20_000, 40_000, 1 << 14
HOT_ANCHORS = 10_000
HASH_BITS = np.uint64(36)  # places of a window's minimum hash lie in the low bits


def minimizers(data: np.ndarray, ends: np.ndarray, length: int):
    """(document, anchor's place in it, its hash, least j, most j) of each run of windows with one anchor."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(W.U), z, z
    spread = length - K + 1
    at = np.arange(n - K + 1)
    h = W.window_hashes(data, K)
    key = (h >> HASH_BITS << HASH_BITS) | at.astype(W.U)
    have = 1
    while have * 2 <= spread:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if spread > have:
        key = np.minimum(key[: len(key) - (spread - have)], key[spread - have :])
    anchor = (key & ((W.U(1) << HASH_BITS) - W.U(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(anchor)]
    start = np.arange(len(anchor))
    inside = start + length <= ends[doc + 1]
    start, anchor, doc = start[inside], anchor[inside], doc[inside]
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(W.U), z, z
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a = anchor[first]
    return doc[first], a - ends[doc[first]], h[a], a - start[last], a - start[first]


def anchors_of(length: int):
    def run(batches):
        for batch in pieces(batches, most=1 << 20):
            doc, pos, h, j0, j1 = minimizers(*raw_text(batch.column("text")), length)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), batch.column("id").take(take), batch.column("th").take(take), pa.array(pos.astype(np.int32)), pa.array(j0.astype(np.int16)), pa.array(j1.astype(np.int16))], ["h", "id", "th", "pos", "j0", "j1"]
            )

    return run


def stretches_of(length: int):
    """The bytes of each stretch of a document."""

    def run(batches):
        for batch in pieces(batches):
            spots = batch.column("spots")
            at = spots.offsets.to_numpy()
            flat = spots.values
            h, pos, j0, j1 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h", "pos", "j0", "j1"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            segs, rows, which = [], [], []
            for i, t in enumerate(texts):
                for s in range(at[i], at[i + 1]):
                    segs.append(t[pos[s] - j1[s] : pos[s] - j0[s] + length])
                    which.append(s)
                    rows.append(i)
            take, which = pa.array(rows, pa.int64()), np.array(which, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[which]), pa.array(j0[which].astype(np.int16)), pa.array(j1[which].astype(np.int16)), pa.array(segs, pa.binary()), batch.column("id").take(take), batch.column("th").take(take), pa.array(pos[which].astype(np.int32))],
                ["key", "j0", "j1", "seg", "id", "th", "pos"],
            )

    return run


def big_words(parts: list[bytes], size: int) -> np.ndarray:
    """Byte strings, padded with zeros, as rows of big-endian 8-byte words."""
    width = -(-size // 8) * 8
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), ">u8").reshape(len(parts), -1).astype(np.uint64)


def earliest(segs: list[bytes], j0: np.ndarray, j1: np.ndarray, length: int) -> np.ndarray:
    """(row, j) of every window that no earlier row holds; rows come in the order of their places."""
    n = len(segs)
    # the anchor itself is one symbol of the strings on the right
    names: dict[bytes, int] = {}
    anchor = np.array([names.setdefault(s[b : b + K], len(names)) for s, b in zip(segs, j1)], np.uint64)
    right = np.column_stack([anchor, big_words([s[b + K :] for s, b in zip(segs, j1)], length - K)])
    left = big_words([s[:b][::-1] for s, b in zip(segs, j1)], length - K)
    place, cuts = [], []
    for words, head in ((right, K), (left, 0)):
        order, shared = bwt.sorted_strings(words, SHARD)
        common = bwt.common_bytes(words, order, shared)
        if head:  # past the anchor its 8 bytes stand for K; before its end nothing counts
            common = np.where(common >= 8, common - 8 + head, 0)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        place.append(back)
        cuts.append(common)
    out = []
    for j in range(int(j0.min()), int(j1.max()) + 1):
        rows = np.flatnonzero((j0 <= j) & (j <= j1))
        if not len(rows):
            continue
        r = np.cumsum(cuts[0] < length - j)[place[0][rows]]
        left_id = np.cumsum(cuts[1] < j)[place[1][rows]] if j else 0
        _, first = np.unique(r * (n + 1) + left_id, return_index=True)
        out.append(np.stack([rows[first], np.full(len(first), j)]))
    return np.concatenate(out, axis=1)


def settle(length: int):
    """(id, th, pos, kept): the windows, as bits by j, that are the first of their kind; input is sorted by key."""
    columns = ["key", "j0", "j1", "seg", "id", "th", "pos"]

    def solve(t: pa.Table):
        t = t.sort_by([("id", "ascending"), ("th", "ascending"), ("pos", "ascending")])
        j0, j1 = (t.column(c).to_numpy().astype(np.int64) for c in ("j0", "j1"))
        row, j = earliest(t.column("seg").to_pylist(), j0, j1, length)
        bits = np.zeros((t.num_rows, length - K + 1), bool)
        bits[row, j] = True
        some = np.flatnonzero(bits.any(axis=1))
        t = t.take(pa.array(some)).combine_chunks()
        packed = np.packbits(bits[some], axis=1)
        return pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("id", "th", "pos")), pa.array([x.tobytes() for x in packed], pa.binary())], ["id", "th", "pos", "kept"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH:
                t = pa.Table.from_batches(held).select(columns).combine_chunks()
                keys = t.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield solve(t.slice(0, cut))
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
        if n:
            yield solve(pa.Table.from_batches(held).select(columns).combine_chunks())

    return run


def cut_texts(length: int, as_text: bool = False):
    """The result of each document: its text, its windows (pos, j0, j1) and those that stay (pos, kept)."""

    def run(batches):
        for batch in pieces(batches):
            spots = batch.column("spots")
            flat = spots.values
            at = spots.offsets.to_numpy()
            pos, j0, j1 = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "j0", "j1"))
            kept = flat.field("kept").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            gone_at = spots.is_null().to_numpy(zero_copy_only=False)
            size, removed, spans, digest, left = [], [], [], [], []
            for i, t in enumerate(texts):
                t = t or b""
                n = len(t)
                size.append(n)
                starts = np.zeros(n + 1, bool)
                if not gone_at[i]:
                    mine = range(at[i], at[i + 1])
                    for s in mine:
                        if kept[s] is None:
                            starts[pos[s] - j1[s] : pos[s] - j0[s] + 1] = True
                    for s in mine:
                        if kept[s] is not None:
                            j = np.flatnonzero(np.unpackbits(np.frombuffer(kept[s], np.uint8)))
                            starts[pos[s] - j] = False
                first = np.flatnonzero(starts)
                if not len(first):
                    removed.append(0)
                    spans.append(0)
                    out = t
                else:
                    new = np.ones(len(first), bool)
                    new[1:] = first[1:] > first[:-1] + length
                    a = first[new]
                    b = np.append(first[np.flatnonzero(new)[1:] - 1], first[-1]) + length
                    removed.append(int((b - a).sum()))
                    spans.append(len(a))
                    edge = [0, *(x for ab in zip(a.tolist(), b.tolist()) for x in ab), n]
                    out = b"".join(t[x:y] for x, y in zip(edge[::2], edge[1::2]))
                digest.append(hashlib.sha256(out).hexdigest())
                left.append(out.decode("utf-8", "ignore") if as_text else out)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c not in ("text", "spots")), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digest, pa.string()), pa.array(left, pa.string() if as_text else pa.binary())],
                [*(c for c in batch.schema.names if c not in ("text", "spots")), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def cut_repeats(documents: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, the columns ``keep``, n_bytes, n_removed, n_spans, kept_sha256, kept for every row of ``documents`` (doc_id, text).

    kept: the bytes left, or the text that they spell, without characters that a cut has split.
    """
    if length < K + 8:
        raise ValueError(f"length is {K + 8} at least")
    spark = documents.sparkSession
    small_batches(spark)
    # kept columns travel under names of our own, which cannot clash
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    docs = documents.select("doc_id", *carried, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    place = "id long, th long, pos int, j0 short, j1 short"
    anchors = Saved(docs.select("id", "th", "text").mapInArrow(anchors_of(length), f"h long, {place}"), "anchors")
    often = Saved(anchors.df.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    # an anchor with a large share of all places would be one task's: there are at most HOT_ANCHORS such, which are broadcast
    hot = F.broadcast(often.df.where(F.col("n") > max(1000, anchors.df.count() // HOT_ANCHORS)).select("h"))
    rest = anchors.df.join(hot, "h", "left_anti").join(often.df.select("h"), "h", "left_semi")
    spots = Saved(anchors.df.join(hot, "h", "left_semi").union(rest), "spots")
    often.drop()
    anchors.drop()
    release(spark)

    by_doc = spots.df.groupBy("id", "th").agg(F.collect_set(F.struct("h", "pos", "j0", "j1")).alias("spots"))
    cut = docs.select("id", "th", "text").join(by_doc, ["id", "th"]).mapInArrow(stretches_of(length), "key long, j0 short, j1 short, seg binary, id long, th long, pos int")
    first = F.min(F.struct("id", "th", "pos")).alias("first")
    same = Saved(cut.groupBy("key", "j0", "j1", "seg").agg(first), "stretches")
    release(spark)

    hot = same.df.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("key").alias("hot"))
    marked = same.df.join(hot, F.col("key") == F.col("hot"), "left")
    window = F.substring("seg", F.col("j1") - F.col("j") + 1, F.lit(length))
    single = marked.where("hot is not null").select("first", "seg", "j1", F.explode(F.sequence("j0", "j1")).alias("j")).select(F.xxhash64(window).alias("key"), F.col("j").cast("short").alias("j0"), F.col("j").cast("short").alias("j1"), window.alias("seg"), "first")
    single = single.groupBy("key", "j0", "j1", "seg").agg(F.min("first").alias("first"))
    all_ = marked.where("hot is null").select("key", "j0", "j1", "seg", "first").union(single).select("key", "j0", "j1", "seg", "first.id", "first.th", "first.pos")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = Saved(all_.repartition(n, "key").sortWithinPartitions("key").mapInArrow(settle(length), "id long, th long, pos int, kept binary"), "kept")
    same.drop()
    release(spark)

    none = F.lit(None)
    parts = spots.df.select("id", "th", "pos", "j0", "j1", none.cast("binary").alias("kept")).union(kept.df.select("id", "th", "pos", none.cast("short"), none.cast("short"), "kept"))
    parts = parts.withColumns({c: F.coalesce(c, F.lit(0).cast("short")) for c in ("j0", "j1")})
    result = parts.groupBy("id", "th").agg(F.collect_set(F.struct("pos", "j0", "j1", "kept")).alias("spots"))
    out = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *(T.StructField(f"k{i}", documents.schema[c].dataType) for i, c in enumerate(keep))])
    for c, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "string" if as_text else "binary")):
        out = out.add(c, kind)
    done = docs.join(result, ["id", "th"], "left").select("doc_id", *(f"k{i}" for i in range(len(keep))), "text", "spots").mapInArrow(cut_texts(length, as_text), out)
    return done.select("doc_id", *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows: list[tuple], length: int = LENGTH) -> dict:
    """The same over (doc_id, text) in plain Python, for tests: doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen: set[bytes] = set()
    out = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for p, q in zip(b"\0" + bytes(gone), bytes(gone)) if q and not p)
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out
