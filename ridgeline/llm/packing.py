"""Operator 2: best-fit packing after Martello-Toth dominance reduction.

Only the number of pieces of each length matters, so the plan is made from the
histogram of lengths: at most ``size`` rows, however large the corpus. The
reduction fixes sequences that some best packing holds: a piece with the
largest companion that fits, if that companion fills the rest exactly, or no
two others fit beside the piece, or no pair that fits beside it is longer than
the companion and no three fit. What cannot be fixed is packed best-fit, longest
first, into the open sequence with the least room that suffices. Both steps
treat all pieces of a length at once.

Pieces of a length are numbered without a global sort: each falls into a small
bucket by hash, bucket counts become offsets, and pieces are numbered within
their buckets; a hot length spreads over all buckets.

Defined results. Null or empty text: one piece of length 1, the end id.
Repeated rows: packed each, and spread over buckets like others. Empty table:
empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LibraryEncoder, encoder, texts, word_bpe
from .common import Saved, pieces, small_batches, table

SIZE = 2048


class Lengths:
    """A multiset of lengths with the neighbour queries of the reduction."""

    def __init__(self, hist: dict[int, int]):
        self.n = {k: v for k, v in hist.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.keys.pop(bisect_left(self.keys, length))

    def put_back(self, length: int) -> None:
        if length not in self.n:
            self.n[length] = 0
            self.keys.insert(bisect_left(self.keys, length), length)
        self.n[length] += 1

    def largest_within(self, room: int) -> int | None:
        at = bisect_left(self.keys, room + 1)
        return self.keys[at - 1] if at else None

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for x in self.keys:
            out += [x] * min(self.n[x], k - len(out))
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int) -> int:
        """The largest sum within ``room`` of two pieces; 0 if no two fit."""
        best, i, j = 0, 0, bisect_left(self.keys, room) - 1
        while i <= j:
            s = self.keys[i] + self.keys[j]
            if s > room:
                j -= 1
            elif i == j and self.n[self.keys[i]] < 2:
                break
            else:
                best = max(best, s)
                i += 1
        return best


def reduce_dominated(lengths: Lengths, size: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed patterns with multiplicities, what is left)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    for j in lengths.keys[::-1]:  # longer pieces that could not be fixed stay in reach as companions
        while lengths.n.get(j):
            lengths.take(j, 1)
            room = size - j
            k = lengths.largest_within(room)
            n = 1 + lengths.n.get(j, 0)
            if k is None:
                fixed.append(((j,), n))
                used = n
            else:
                few = lengths.smallest(3)
                sure = k == room or len(few) < 2 or sum(few[:2]) > room
                if not sure:
                    sure = k >= lengths.best_pair(room) and (len(few) < 3 or sum(few) > room)
                if not sure:
                    used = 0
                elif k == j:  # in twos; a last one is judged anew
                    fixed.append(((j, j), n // 2))
                    used = n // 2 * 2
                else:
                    m = min(n, lengths.n[k])
                    fixed.append(((j, k), m))
                    lengths.take(k, m)
                    used = m
            if used > 1:
                lengths.take(j, used - 1)
            elif not used:
                lengths.put_back(j)
                break
    return fixed, dict(lengths.n)


def best_fit(hist: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: patterns with multiplicities."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # room -> groups of equal sequences
    rooms: list[int] = []

    def put(room, pattern, n):
        if not open_[room]:
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append((pattern, n))

    for length in sorted(hist, reverse=True):
        n = hist[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                # as many new sequences as hold the rest, each filled with this length
                per = size // length
                if n >= per:
                    put(size - per * length, (length,) * per, n // per)
                if n % per:
                    put(size - n % per * length, (length,) * (n % per), 1)
                break
            room = rooms[at]
            pattern, m = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            used = min(n, m)
            if used < m:
                put(room, pattern, m - used)
            put(room - length, (*pattern, length), used)
            n -= used
    return [g for groups in open_.values() for g in groups]


def plan(hist: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): places for all pieces of the histogram."""
    fixed, rest = reduce_dominated(Lengths(hist), size)
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, n in [*fixed, *best_fit(rest, size)]:
        if not n:
            continue
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n - 1, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


def cut(path: str, end: int, size: int):
    def run(batches):
        e = encoder(path, LibraryEncoder)
        tail = np.array([end], "<u4").tobytes()
        for batch in pieces(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(e.documents(texts(batch.column("text")))):
                ids += tail
                for p, s in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[s : s + 4 * size]
                    at.append(i)
                    piece.append(p)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(documents: DataFrame, vocabulary: str | None = None, end: int = 0, size: int = SIZE, buckets: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    small_batches(spark)
    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", "text").mapInArrow(cut(vocabulary or word_bpe(), end, size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    parts = Saved(rows.withColumn("row", F.monotonically_increasing_id()), "pieces").df  # written, so a piece keeps its number
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = parts.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    places = plan(hist, size)
    # a plan has a row for each length in each pattern: bounded by the lengths, not by the corpus
    placed = spark.createDataFrame(places or [], "p_length long, low long, high long, sequence long, offset long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket"), F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = parts.withColumn("own", own).join(before, (F.col("length") == F.col("b_length")) & (F.col("bucket") == F.col("b_bucket"))).withColumn("rank", F.col("own") + F.col("before"))
    out = ranked.join(F.broadcast(placed) if len(places) < 100_000 else placed, (F.col("length") == F.col("p_length")) & F.col("rank").between(F.col("low"), F.col("high")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
