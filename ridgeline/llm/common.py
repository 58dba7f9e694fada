"""What the operators of this subpackage share: scratch tables, batches of text, components.

Nothing here keeps a copy on one executor only: intermediate results are
Parquet tables below ``spark.checkpoint.dir``, which every executor reads, so
a lost executor costs a re-read and not a lost lineage.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where it names none, and only on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ridgeline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from here on in this session: texts are long, and a batch is held whole on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: Tables that were written and not dropped, in order.
_held: list[Saved] = []


class Saved:
    """A table that was written to the shared folder; ``drop()`` frees its disk."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/ridgeline/{tag}-{uuid.uuid4().hex}"
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")  # the shuffle files of this write are of no use once it is done
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            conf.set(key, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _held.append(self)

    def drop(self) -> None:
        if self in _held:
            _held.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read again: cuts the lineage without localCheckpoint."""
    return Saved(df, tag).df


def alone(make, tag: str) -> Saved:
    """The table that ``make()`` gives, written; what an operator wrote on the way to it is dropped."""
    before = set(map(id, _held))
    out = Saved(make(), tag)
    for other in [s for s in _held if id(s) not in before and s is not out]:
        other.drop()
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Give memory that is free inside this worker back to the system: idle workers stay around."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches, column: str = "text", most: int = 4 << 20):
    """Slices of Arrow batches that hold about ``most`` bytes of text each (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        at, n = 0, batch.num_rows
        if not n:
            continue
        ends = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4).astype(np.int64)
        while at < n:
            stop = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
            stop = min(n, max(at + 1, stop))
            yield batch.slice(at, stop - at)
            at = stop
    tidy()


def raw_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; nulls are empty texts."""
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int32, n + 1, col.offset * 4).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it reaches.

    In each round a node joins its smallest neighbour, and that one's choice in
    turn; the links are then drawn between what is left, each once, so they
    shrink from round to round. The smallest node of a component never joins
    another, so it is the one that stays. Self-links count as nodes; nulls are
    ignored. An empty input gives an empty result.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    links = Saved(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-links")
    label = Saved(links.df.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), tag)
    while not (left := links.df.where("a < b")).isEmpty():
        near = left.union(left.select("b", "a")).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p"))
        top = near.select(F.col("v").alias("p"), F.col("p").alias("q"))
        step = Saved(near.join(top, "p").select("v", "q"), f"{tag}-step")
        ends = [step.df.select(F.col("v").alias(c), F.col("q").alias(f"q_{c}")) for c in ("a", "b")]
        drawn = left.join(ends[0], "a").join(ends[1], "b").where("q_a <> q_b")
        new_links = Saved(drawn.select(F.least("q_a", "q_b").alias("a"), F.greatest("q_a", "q_b").alias("b")).distinct(), f"{tag}-links")
        new_label = Saved(label.df.join(step.df, F.col("component") == F.col("v"), "left").select("node", F.coalesce("q", "component").alias("component")), tag)
        for old in (links, label, step):
            old.drop()
        links, label = new_links, new_label
    links.drop()
    return label.df
