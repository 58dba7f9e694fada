"""Operator 5: token-id files, coded by the adaptive context-mixing range coder.

Documents are dealt out by ranges of doc_id and sorted, so shards and the
documents within them ascend. A shard is a run of segments; a segment holds the
ids of whole documents, about ``segment`` of them (one long document may be
more), as one binary file of ``rangecoder``: a head with the documents' ids and
lengths, a directory of blocks with their checksums, and independently coded
blocks. Segments are stored as rows of a Parquet table (shard, segment, n_ids,
data): Spark's committer
then publishes the files whole on any store, also when executors are lost, and
readers get at any segment alone.

Defined results. Null or empty text: the end id alone. Repeated rows: written
and returned each. A null doc_id sorts first. Empty table: no segments, empty
result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangecoder
from .bpe import LibraryEncoder, encoder, texts, word_bpe
from .common import Saved, pieces, small_batches, table

END = 2
SEGMENT = rangecoder.BLOCK * rangecoder.LANES
SIDE_BY_SIDE = 4  # files that a reader decodes in step


def note_of(docs: list, lengths: list[int]) -> bytes:
    """The documents of a file: how many, how many of them (the first) have no id, their ids and lengths."""
    n_null = sum(d is None for d in docs)
    return struct.pack("<II", len(docs), n_null) + np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(lengths, "<i8").tobytes()


def documents_of(note: bytes) -> tuple[list, np.ndarray]:
    n, n_null = struct.unpack_from("<II", note)
    docs = np.frombuffer(note, "<i8", n, 8).tolist()
    return [None] * n_null + docs[n_null:], np.frombuffer(note, "<i8", n, 8 + 8 * n)


def writer(path: str, end: int, segment: int):
    def run(batches):
        e = encoder(path, LibraryEncoder)
        tail = np.array([end], "<u4").tobytes()
        shard, n = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        docs: list = []
        held = 0

        def out():
            lengths = [len(x) // 4 for x in ids]
            data = rangecoder.encode(np.frombuffer(b"".join(ids), "<u4"), note_of(docs, lengths))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["shard", "segment", "n_ids", "data"])

        for batch in pieces(batches):
            for doc, got in zip(batch.column("doc_id").to_pylist(), e.documents(texts(batch.column("text")))):
                if ids and held + len(got) // 4 + 1 > segment:
                    yield out()
                    ids, docs, held, n = [], [], 0, n + 1
                ids.append(got + tail)
                docs.append(doc)
                held += len(got) // 4 + 1
        if ids:
            yield out()

    return run


def reader(batches):
    """(shard, segment, doc_id, before, n_tokens, ids_crc32) of every document of the files, all from the coded bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, SIDE_BY_SIDE):
            part = batch.slice(at, SIDE_BY_SIDE)
            for i, (ids, note) in enumerate(rangecoder.decode_all(part.column("data").to_pylist())):
                docs, lengths = documents_of(note)
                ends = np.cumsum(lengths)
                if (ends[-1] if len(ends) else 0) != len(ids):
                    raise ValueError("the lengths of a segment differ from its ids")
                n = len(lengths)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                same = lambda c, kind: pa.array([part.column(c)[i].as_py()] * n, kind)
                yield pa.RecordBatch.from_arrays(
                    [same("shard", pa.int32()), same("segment", pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["shard", "segment", "doc_id", "before", "n_tokens", "ids_crc32"],
                )


def write_tokens(documents: DataFrame, vocabulary: str | None = None, end: int = END, segment: int = SEGMENT) -> Saved:
    """The token files of ``documents`` (doc_id, text), in ascending order of doc_id; of equal ids the hash of the text decides."""
    small_batches(documents.sparkSession)
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").orderBy("doc_id", F.xxhash64("text"))
    return Saved(ordered.mapInArrow(writer(vocabulary or word_bpe(), end, segment), "shard int, segment int, n_ids long, data binary"), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of token files."""
    heads = files.select("shard", "segment", "n_ids")
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row a write task
    total, starts = 0, []
    for r in shards:
        starts.append((r["shard"], total))
        total += r["n"]
    spark = files.sparkSession
    own = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    base = heads.withColumn("own", F.coalesce(own, F.lit(0))).join(spark.createDataFrame(starts, "s_shard int, first long"), F.col("shard") == F.col("s_shard"))
    base = base.select(F.col("shard").alias("b_shard"), F.col("segment").alias("b_segment"), (F.col("own") + F.col("first")).alias("base"))
    docs = files.select("shard", "segment", "data").mapInArrow(reader, "shard int, segment int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return docs.join(base, (F.col("shard") == F.col("b_shard")) & (F.col("segment") == F.col("b_segment"))).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")).df)
