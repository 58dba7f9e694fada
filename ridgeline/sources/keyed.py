"""A table of the latest row of each key, in Parquet: a write rewrites the buckets that it touches and publishes by a manifest.

    root/data/<write>/bucket=<n>/...      files of one write, never changed
    root/manifest/<version>.json          which write holds each bucket

A reader takes the newest manifest and sees that version whole. A writer that
dies before its manifest leaves files that no manifest names; one that comes
second finds its version taken and tries again on what the first one made. The
manifest has one entry a bucket, whatever the rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer published the version first, again and again."""


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 32):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema: T.StructType = T.StructType.fromDDL(schema)
        state = self.manifest()
        self.buckets = state["buckets"] if state else buckets

    # --- files

    def _path(self, inside: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{inside}")

    def _fs(self):
        path = self._path("")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        system, folder = self._fs(), self._path("manifest")
        if not system.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in system.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """{version, buckets, holds: {bucket: write}} of a version, the newest by default; None if nothing was ever written."""
        known = self.versions()
        if not known:
            return None
        lines = self.spark.read.text(f"{self.root}/manifest/{known[-1] if version is None else version:012}.json", wholetext=True)
        return json.loads(lines.first()[0])

    def _publish(self, state: dict) -> bool:
        """Writes a manifest under its version if nobody did: a file that is moved into place only where none is."""
        system, jvm = self._fs(), self.spark.sparkContext._jvm
        target, temp = self._path(f"manifest/{state['version']:012}.json"), self._path(f"manifest/.{uuid.uuid4().hex}")
        system.mkdirs(self._path("manifest"))
        out = system.create(temp, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if system.exists(target):
                return False
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:  # noqa: BLE001 - the other writer's file is there now
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            system.delete(temp, False)

    # --- reading

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict | None, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/data/{write}/bucket={b}" for b, write in (state["holds"].items() if state else ()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._rows(self.manifest(version))

    def get(self, **key) -> DataFrame:
        """The row of one key: one bucket is read."""
        state = self.manifest()
        one = self.spark.createDataFrame([tuple(key[k] for k in self.keys)], T.StructType([f for n in self.keys for f in self.schema if f.name == n]))
        bucket = one.select(self._bucket()).first()[0]
        rows = self._rows(state, [bucket])
        for k, v in key.items():
            rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
        return rows

    # --- writing

    def upsert(self, new: DataFrame, tries: int = 5) -> int:
        """Takes the rows of ``new`` (one of each key) in the place of those of the same keys; returns the version."""
        return self._change(new.select(*self.schema.names), lambda old, mine: self._merged(old, mine), tries)

    def delete(self, keys: DataFrame, tries: int = 5) -> int:
        """Takes the rows of these keys out."""
        return self._change(keys.select(*self.keys).distinct(), lambda old, mine: old.join(mine, [old[k].eqNullSafe(mine[k]) for k in self.keys], "left_anti"), tries)

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(0)).union(new.withColumn("_new", F.lit(1)))
        return both.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), "_new").alias("v")).select("v.*")

    def _change(self, mine: DataFrame, make, tries: int) -> int:
        write = uuid.uuid4().hex
        staged = f"{self.root}/data/{write}-in"
        put = mine.withColumn("_bucket", self._bucket())
        put.write.parquet(staged)  # once, whatever the tries
        inside = self.spark.read.schema(put.schema).parquet(staged)
        touched = [r[0] for r in inside.select("_bucket").distinct().collect()]  # at most a number a bucket
        for attempt in range(tries):
            state = self.manifest()
            version = (state["version"] if state else 0) + 1
            if not touched:
                self._drop(f"{write}-in")
                return version - 1
            place = f"{write}-{attempt}"
            rows = make(self._rows(state, touched), inside.select(*mine.columns))
            rows.withColumn("bucket", self._bucket()).repartition(min(self.buckets, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{place}")
            made = {str(b) for b in touched if self._fs().exists(self._path(f"data/{place}/bucket={b}"))}
            holds = {b: w for b, w in (state["holds"] if state else {}).items() if int(b) not in touched} | dict.fromkeys(made, place)
            if self._publish({"version": version, "buckets": self.buckets, "keys": self.keys, "holds": holds}):
                self._drop(f"{write}-in")
                return version
            self._drop(place)
        self._drop(f"{write}-in")
        raise Conflict(f"{self.root}: {tries} versions were taken by others")

    def _drop(self, write: str) -> None:
        self._fs().delete(self._path(f"data/{write}"), True)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the last ``keep``, and the files that none of those names; returns how many writes went. No writer may be at work."""
        known, system = self.versions(), self._fs()
        used = {w for v in known[-keep:] for w in self.manifest(v)["holds"].values()}
        for v in known[:-keep]:
            system.delete(self._path(f"manifest/{v:012}.json"), False)
        gone = [f.getPath().getName() for f in system.listStatus(self._path("data")) if f.getPath().getName() not in used] if system.exists(self._path("data")) else []
        for w in gone:
            self._drop(w)
        return len(gone)
