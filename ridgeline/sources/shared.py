"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from fnmatch import fnmatchcase
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; one of this machine only where it is the whole cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/ridgeline/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what is used twice is made once, and survives a lost executor."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession) -> int:
    """How many tasks share out what is small in bytes and long in work, which Spark would put into few."""
    return 4 * spark.sparkContext.defaultParallelism


def located(path: str):
    """(file system, place in it) on any that Arrow knows (a local path, file:, hdfs:, s3:, gs:)."""
    plain = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)


def open_input(path: str):
    """A file for random reads."""
    system, inside = located(path)
    return system.open_input_file(inside)


def hidden(name: str) -> bool:
    """Names that Spark's own sources pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def children(folder: str) -> list[tuple[str, int, bool]]:
    """path, length and whether it is a folder, of what lies in a folder (of a file: itself)."""
    system, inside = located(folder)
    here = system.get_file_info(inside)
    found = [here] if here.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside))
    base = folder.rstrip("/")
    return [(base if i is here else f"{base}/{i.base_name}", i.size or 0, i.type == fs.FileType.Directory) for i in found if i is here or not hidden(i.base_name)]


def paths_below(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, length of every file below ``root`` that has a byte; no content is read.

    Tasks list the folders, a level of them at a time, so the driver holds no
    names however many files there are.
    """

    def run(batches):
        for pdf in batches:
            for folder in pdf["path"]:
                rows = [r for r in children(folder) if r[2] or (r[1] and (glob is None or fnmatchcase(r[0].rsplit("/", 1)[-1], glob)))]
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=["path", "length", "folder"])

    folders, levels = spark.createDataFrame([(root,)], "path string"), []
    while not levels or not folders.isEmpty():
        level = saved(folders.mapInPandas(run, "path string, length long, folder boolean"), "listing")
        levels.append(level.where("NOT folder").select("path", "length"))
        folders = level.where("folder").select("path").repartition(tasks_of(spark), "path")
    return reduce(DataFrame.union, levels)
