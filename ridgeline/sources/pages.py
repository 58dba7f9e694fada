"""Recorded vendor pages as a Spark data source: ``spark.read.format("vendor_pages")`` and ``spark.readStream``.

A recording is a folder for each symbol with a file for each answer, named by the
day that was asked for (``hk00700/2024-06-28.json``): pages of arrays or objects as
JSON, or one JSONP call. A vendor bounds a page by its end only, so a history is
walked from the newest page to the oldest, and pages overlap: of a time the newest
page counts, which needs the first time of the page before and nothing else. A
symbol whose pages hold fewer than ``min_rows`` rows in all is refused, before it is
clipped: a short span is right, a short answer is not.

Options: ``path``; ``symbols`` (comma-separated, all by default); ``start`` and
``end`` (days, both included); ``period`` (day by default); ``min_rows`` (30).
A symbol or page that cannot be read is a row with ``error``. The batch reader has a
partition for each symbol, the stream reader one for each page: its offset is how many
pages of every symbol are behind, so a batch takes the next ``pages`` (1) older ones.
A recording does not change while it is read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ridgeline.sources.bars import PRICES, VALUES

SCHEMA = "code string, period string, ts string, " + ", ".join(f"{c} double" for c in VALUES) + ", page string, error string"
# How many rows of ten thousand an array's amount counts, the letters of an object's fields, the call of a JSONP answer.
AMOUNT_SCALE = 10_000.0
LETTERS = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "amount": "a"}
CALL = re.compile(r"^(?:/\*.*?\*/\s*)?var\s+[^=]+=\s*\((.*)\)\s*;?\s*$", re.S)
PAGE = re.compile(r"(\d{4}-\d{2}-\d{2})\.(json|jsonp)$")


class PageError(ValueError):
    """An answer that is not what it should be."""


def payload(text: str, kind: str):
    """The rows of an answer; ``null`` is a symbol without rows."""
    try:
        if kind == "jsonp":
            call = CALL.match(text.strip())
            if not call:
                raise PageError(f"no call in {text[:60]!r}")
            text = call.group(1)
        rows = json.loads(text)
    except json.JSONDecodeError as e:
        raise PageError(f"no JSON: {e}") from None
    rows = rows.get("rows") if isinstance(rows, dict) else rows
    if rows is None:
        return []
    if not isinstance(rows, list):
        raise PageError(f"rows are {type(rows).__name__}, not a list")
    return rows


def bar_of(row) -> tuple | None:
    """(ts, values) of an array (day, open, close, high, low, volume, ..., amount at 8) or an object; None if it is no bar."""
    try:
        if isinstance(row, dict):
            ts = str(row["d"])
            v = {c: float(row.get(k) or 0) if c not in PRICES else float(row[k]) for c, k in LETTERS.items()}
        else:
            ts = str(row[0])
            v = dict(zip(("open", "close", "high", "low", "volume"), map(float, row[1:6])))
            v["amount"] = float(row[8]) * AMOUNT_SCALE if len(row) > 8 and row[8] not in (None, "") else 0.0
    except (KeyError, IndexError, TypeError, ValueError):
        return None
    if len(v) < len(VALUES) or min(v[p] for p in PRICES) <= 0:
        return None
    return ts[:16], tuple(v[c] for c in VALUES)


@dataclass
class Page(InputPartition):
    """A page of a symbol, and the newer one that it may overlap."""

    symbol: str
    file: str
    newer: str | None


@dataclass
class Symbol(InputPartition):
    symbol: str
    files: list[str]


class Recording:
    """The files of a recording."""

    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("vendor_pages needs a path")
        self.path = options["path"]
        self.symbols = [s.strip() for s in options["symbols"].split(",")] if options.get("symbols") else None
        self.start, self.end = options.get("start", ""), options.get("end", "9999-12-31")
        self.period, self.least, self.step = options.get("period", "day"), int(options.get("min_rows", 30)), int(options.get("pages", 1))

    def open(self):
        plain = re.sub(r"^file:/*", "/", self.path)
        return (fs.LocalFileSystem(), plain) if "://" not in plain else fs.FileSystem.from_uri(plain)

    def pages(self) -> dict[str, list[str]]:
        """Each symbol's pages that were asked for by ``end``, newest first: names only, nothing is read."""
        system, root = self.open()
        found: dict[str, list[str]] = {s: [] for s in self.symbols or ()}
        for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
            symbol = f.path.rstrip("/").split("/")[-2]
            m = PAGE.search(f.path)
            if f.is_file and m and (self.symbols is None or symbol in self.symbols):
                found.setdefault(symbol, [])
                if m.group(1) <= self.end:
                    found[symbol].append(f.path)
        return {s: sorted(p, reverse=True) for s, p in found.items()}

    def bars(self, file: str) -> list[tuple]:
        """The bars of a page in order of time."""
        system, _ = self.open()
        with system.open_input_stream(file) as f:
            text = f.read().decode("utf-8")
        return sorted({b[0]: b for b in map(bar_of, payload(text, file.rsplit(".", 1)[1])) if b}.values())

    def row(self, symbol, ts, v, file, error=None):
        return (symbol, self.period, ts, *(v or (None,) * len(VALUES)), file and file.rsplit("/", 1)[1], error)

    def inside(self, ts: str) -> bool:
        return self.start <= ts[:10] <= self.end


class PageReader(DataSourceReader, Recording):
    def partitions(self):
        return [Symbol(s, files) for s, files in sorted(self.pages().items())]

    def read(self, partition: Symbol):
        """Walks a symbol's pages back from its newest; stops at the first one that begins before ``start`` or brings nothing new."""
        limit, got, page = None, [], None
        try:
            for page in partition.files:
                bars = self.bars(page)
                fresh = [b for b in bars if limit is None or b[0] < limit]
                if not fresh:
                    break
                got += [(page, *b) for b in fresh]
                limit = fresh[0][0]
                if limit[:10] <= self.start:
                    break
        except (PageError, OSError, UnicodeDecodeError) as e:
            yield self.row(partition.symbol, None, None, page, str(e))
            return
        if len(got) < self.least:
            yield self.row(partition.symbol, None, None, page, f"{len(got)} rows, fewer than {self.least}")
            return
        for page, ts, v in got:
            if self.inside(ts):
                yield self.row(partition.symbol, ts, v, page)


class PageStream(DataSourceStreamReader, Recording):
    def __init__(self, options):
        Recording.__init__(self, options)
        self.behind = 0

    def initialOffset(self) -> dict:
        return {"behind": 0}

    def latestOffset(self) -> dict:
        deepest = max(map(len, self.pages().values()), default=0)
        self.behind = min(self.behind + self.step, deepest)
        return {"behind": self.behind}

    def partitions(self, start: dict, end: dict):
        self.behind = max(self.behind, end["behind"])
        return [Page(s, files[k], files[k - 1] if k else None) for s, files in sorted(self.pages().items()) for k in range(start["behind"], min(end["behind"], len(files)))]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Page):
        """The bars of a page that the newer one has not."""
        try:
            newer = self.bars(partition.newer) if partition.newer else []
            for ts, v in self.bars(partition.file):
                if (not newer or ts < newer[0][0]) and self.inside(ts):
                    yield self.row(partition.symbol, ts, v, partition.file)
        except (PageError, OSError, UnicodeDecodeError) as e:
            yield self.row(partition.symbol, None, None, partition.file, str(e))


class VendorPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Makes ``vendor_pages`` known to a session."""
    spark.dataSource.register(VendorPages)
    return spark
