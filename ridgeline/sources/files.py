"""Bars from files of 32-byte day and minute records.

Files are read whole by Spark's binaryFile source, one task a file or more, so
a directory of thousands spreads over the cluster. A bad file becomes a row
with an error.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.sources.bars import VALUES

DAY = np.dtype([("date", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<u4"), ("rest", "<u4")])
MINUTE = np.dtype([("date", "<u2"), ("minute", "<u2"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("amount", "<f4"), ("volume", "<u4"), ("rest", "<u4")])
#: Days and years that a record may name.
DAYS, YEARS = (19900101, 29991231), (1990, 2100)
#: The period of a file's suffix.
SUFFIX = {".day": "day", ".lc5": "5", ".lc1": "1"}
NAME = r"(?i)(sh|sz|bj)(\d{6})\.(day|lc5|lc1)$"
SCHEMA = "path string, code string, period string, ts string, " + ", ".join(f"{c} double" for c in VALUES) + ", error string"


class FormatError(ValueError):
    """A file that is not of the format it claims."""


def records(data: bytes, kind: np.dtype) -> np.ndarray:
    if len(data) % kind.itemsize:
        raise FormatError(f"{len(data)} bytes are no whole number of {kind.itemsize}-byte records")
    return np.frombuffer(data, kind)


def day_columns(data: bytes) -> dict:
    """ts and values of day records; prices are cents, dates yyyymmdd within ``DAYS``."""
    r = records(data, DAY)
    d = r["date"].astype(np.int64)
    if ((d < DAYS[0]) | (d > DAYS[1])).any():
        raise FormatError("a date out of range")
    ts = [f"{x // 10000:04d}-{x // 100 % 100:02d}-{x % 100:02d}" for x in d.tolist()]
    return {"ts": ts, **{c: r[c] / 100.0 for c in ("open", "high", "low", "close")}, "volume": r["volume"].astype(float), "amount": r["amount"].astype(float)}


def parse_day(data: bytes) -> pd.DataFrame:
    """Bars of day records."""
    return pd.DataFrame(day_columns(data))


def minute_ts(date: np.ndarray, minute: np.ndarray) -> list[str]:
    """A date is (year - 2004) * 2048 + month * 100 + day; a minute counts from midnight."""
    d, m = date.astype(np.int64), minute.astype(np.int64)
    year, rest = d // 2048 + 2004, d % 2048
    if ((year > YEARS[1]) | (m >= 1440) | (rest // 100 < 1) | (rest // 100 > 12) | (rest % 100 < 1) | (rest % 100 > 31)).any():
        raise FormatError("a time out of range")
    return [f"{y:04d}-{x // 100:02d}-{x % 100:02d} {t // 60:02d}:{t % 60:02d}" for y, x, t in zip(year.tolist(), rest.tolist(), m.tolist())]


def minute_columns(data: bytes) -> dict:
    """ts and values of minute records, which must ascend and hold positive prices in order."""
    r = records(data, MINUTE)
    ts = minute_ts(r["date"], r["minute"])
    if any(b <= a for a, b in zip(ts, ts[1:])):
        raise FormatError("records do not ascend")
    p = {c: r[c].astype(float) for c in ("open", "high", "low", "close")}
    if not (np.stack(list(p.values())) > 0).all():
        raise FormatError("a price that is not above zero")
    if ((p["high"] < np.maximum(p["open"], p["close"])) | (p["low"] > np.minimum(p["open"], p["close"]))).any():
        raise FormatError("a price outside its bar")
    return {"ts": ts, **p, "volume": r["volume"].astype(float), "amount": r["amount"].astype(float)}


def parse_minute(data: bytes) -> pd.DataFrame:
    """Bars of minute records."""
    return pd.DataFrame(minute_columns(data))


def read_packages(spark: SparkSession, root: str, markets: list[str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Bars of every day and minute file below ``root``; a file that cannot be read gives one row with ``error``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    files = files.where(F.col("path").rlike(NAME))
    if markets:
        files = files.where(F.lower(F.regexp_extract("path", NAME, 1)).isin(*markets))
    aliases = aliases or {}

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                _, digits, suffix = re.search(NAME, path).groups()
                base = {"path": path, "code": aliases.get(digits, digits), "period": SUFFIX["." + suffix.lower()]}
                try:
                    df = (parse_day if suffix.lower() == "day" else parse_minute)(bytes(data)).assign(**base, error=None)
                except FormatError as e:
                    df = pd.DataFrame([base | {"ts": None, **dict.fromkeys(VALUES), "error": str(e)}])
                yield df[["path", "code", "period", "ts", *VALUES, "error"]].astype({c: "float64" for c in VALUES})

    return files.mapInPandas(run, SCHEMA)
