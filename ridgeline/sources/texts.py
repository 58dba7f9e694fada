"""Bars from delimited text in many dialects.

A file's dialect (encoding, separator, header line, which column is what) is read
from its head, a step of its own; the body is then read in splits of some
megabytes, so one large file spreads over tasks. Columns go by name, never by
place; a date column without a name is found by its values. Every line of a body
comes out: as a bar, or with the reason why it is none. A file with a line that
looks like data and is not (no date, no number, prices out of order) is not let in.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.sources.bars import PRICES, VALUES
from ridgeline.sources.files import FormatError
from ridgeline.sources.shared import open_input, paths_below, saved, tasks_of

# Names of columns (a heading may go on after one), separators (blanks come last), encodings, what stands for no number.
HEADINGS = {
    "date": ("日期", "date", "trade_date", "datetime", "时间"), "time": ("时间", "time"),
    "open": ("开盘价", "开盘", "open"), "high": ("最高价", "最高", "high"), "low": ("最低价", "最低", "low"), "close": ("收盘价", "收盘", "close"),
    "volume": ("成交量", "volume", "vol"), "amount": ("成交额", "成交金额", "amount", "turnover"),
}
SEPARATORS = (",", "\t", ";", "|")
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")
NOTHING = ("", "-", "--", "None", "null")
HEAD_LINES, PROBE, HEAD_BYTES, SPLIT = 30, 5, 1 << 18, 8 << 20
DATE = re.compile(r"(\d{4})-?(\d{2})-?(\d{2})")
SCHEMA = "path string, code string, period string, at long, ts string, " + ", ".join(f"{c} double" for c in VALUES) + ", error string, fatal boolean, line string"


class Dialect(NamedTuple):
    encoding: str
    separator: str  # "" for blanks
    header: int  # the header's line
    columns: dict[str, int]


class BadLine(ValueError):
    """A line that is no bar; ``fatal`` if it looks like one."""

    def __init__(self, why: str, fatal: bool):
        super().__init__(why)
        self.fatal = fatal


def cut(line: str, separator: str) -> list[str]:
    return [c.strip() for c in line.split(separator)] if separator else line.split()


def heading(cell: str) -> str:
    """A heading without blanks, colons and units in brackets, in lower case."""
    return re.sub(r"[\s:：*﻿]+", "", re.sub(r"[（(【\[].*?[)）】\]]", "", cell.lower()))


def named(cells: list[str]) -> dict[str, int]:
    """Which column is what; each column is one thing, each thing the first column that claims it."""
    out: dict[str, int] = {}
    for i, cell in enumerate(map(heading, cells)):
        claim = next((f for f, names in HEADINGS.items() if f not in out and cell and cell.startswith(names)), None)
        if claim:
            out[claim] = i
    return out


def day_of(cell: str) -> str | None:
    m = DATE.fullmatch(cell.strip().replace("/", "-"))
    return "-".join(m.groups()) if m else None


def unnamed_date(rows: list[list[str]], header: list[str], columns: dict[str, int]) -> tuple[dict[str, int], int]:
    """(columns, the date's) where no heading names it: the first free column whose values are dates.

    Rows one cell wider than the header have a column in front that the header
    lacks. A single row is evidence only where the header leaves that cell empty
    or is such a narrow one.
    """
    widths = Counter(map(len, rows))
    fronted = bool(rows) and widths.most_common(1)[0][0] == len(header) + 1 and len(rows) > 1 and all(day_of(r[0]) for r in rows)
    if fronted:
        columns = {f: i + 1 for f, i in columns.items()}
    for i in range(max([len(header), *widths])):
        values = [r[i] for r in rows if i < len(r) and r[i]]
        enough = fronted or len(values) > 1 or (i < len(header) and not header[i])
        if i not in columns.values() and values and enough and all(map(day_of, values)):
            return columns, i
    raise FormatError("no column of dates: none is named, and none has dates only (2026-10-13, 20261013, 2026/10/13) in two rows or more")


def infer(lines: list[str], encoding: str) -> Dialect:
    """The dialect of a text by its first lines."""
    for i, line in enumerate(lines[:HEAD_LINES]):
        separator = next((s for s in SEPARATORS if s in line), "")
        cells = cut(line, separator)
        columns = named(cells) if len(cells) >= 4 else {}
        if all(p in columns for p in PRICES):
            if "date" not in columns:
                rows = [cut(x, separator) for x in lines[i + 1 : i + 1 + PROBE] if x.strip()]
                columns, at = unnamed_date(rows, cells, columns)
                columns = columns | {"date": at}
            return Dialect(encoding, separator, i, columns)
    raise FormatError(f"no header with the four prices in the first {HEAD_LINES} lines")


def number(cell: str, what: str) -> float:
    s = cell.strip().replace(",", "").replace("%", "")
    try:
        return 0.0 if s in NOTHING else float(s)
    except ValueError:
        raise BadLine(f"{what} {cell!r} is not a number", True) from None


def bar_of(line: str, d: Dialect) -> dict:
    """The bar of a line."""
    cells, col = cut(line, d.separator), d.columns
    if len(cells) <= max(col.values()):
        raise BadLine(f"{len(cells)} cells of {max(col.values()) + 1}", False)
    day, clock = day_of(cells[col["date"]]), cells[col["time"]].replace(":", "") if "time" in col else ""
    if day is None or (clock and not re.fullmatch(r"\d{3,6}", clock)):
        looks = re.fullmatch(r"[-+]?[\d,]*\.?\d+", cells[col["open"]]) is not None  # a total or a note has no price there
        raise BadLine(f"no time in {cells[col['date']]!r}" + (f" {cells[col['time']]!r}" if clock else ""), looks)
    clock = clock.zfill(4)[:4]
    v = {c: number(cells[col[c]], c) if c in col else 0.0 for c in VALUES}
    if min(v[p] for p in PRICES) <= 0:
        raise BadLine("a price that is not above zero", False)
    if v["low"] > min(v["open"], v["close"]) or v["high"] < max(v["open"], v["close"]):
        raise BadLine("prices out of order", True)
    return {"ts": f"{day} {clock[:2]}:{clock[2:]}" if "time" in col and cells[col["time"]] else day, **v}


def parse_text(text: str) -> pd.DataFrame:
    """Bars of a whole text, the last one of a time; the first line that must not be passed over raises."""
    lines = text.splitlines()
    d = infer(lines, "")
    out = []
    for i, line in enumerate(lines[d.header + 1 :], d.header + 2):
        try:
            out += [bar_of(line, d)] if line.strip() else []
        except BadLine as e:
            if e.fatal:
                raise FormatError(f"line {i}: {e}") from None
    if not out:
        raise FormatError("no line is a bar")
    return pd.DataFrame(out).drop_duplicates("ts", keep="last").sort_values("ts").reset_index(drop=True)


def head_of(path: str) -> tuple[Dialect, int]:
    """(dialect, where the body begins) of a file."""
    with open_input(path) as f:
        data = f.read(HEAD_BYTES)
        whole = len(data) < HEAD_BYTES
    if not whole:
        data = data[: data.rfind(b"\n") + 1]
    why: Exception = FormatError("the text is in no known encoding")
    for encoding in ENCODINGS:
        try:
            d = infer(data.decode(encoding).splitlines(), encoding)
        except UnicodeDecodeError:
            continue
        except FormatError as e:
            why = e
            continue
        body = 0
        for _ in range(d.header + 1):
            body = data.find(b"\n", body) + 1 or len(data)
        return d, body
    raise why if isinstance(why, FormatError) else FormatError(str(why))


def dialects(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, length, dialect, body: how each file below ``root`` is written; ``error`` where that cannot be told."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, length in zip(pdf["path"], pdf["length"]):
                try:
                    d, body = head_of(path)
                    rows.append((path, length, d.encoding, d.separator, d.columns, body, None))
                except (FormatError, OSError) as e:
                    rows.append((path, length, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "length", "encoding", "separator", "columns", "body", "error"]).astype({"body": "Int64"})

    return paths_below(spark, root, glob).repartition(tasks_of(spark), "path").mapInPandas(run, "path string, length long, encoding string, separator string, columns map<string,int>, body long, error string")


def lines_of(f, start: int, stop: int, body: int):
    """(offset, bytes) of the lines that begin in start..stop-1."""
    at = start
    f.seek(start if start == body else start - 1)
    if start > body:
        at += len(until_newline(f)) - 1
    while at < stop:
        block = f.read(min(1 << 20, stop - at))
        if not block:
            return
        if not block.endswith(b"\n"):
            block += until_newline(f)
        for line in re.findall(rb"[^\n]*\n|[^\n]+$", block):
            yield at, line
            at += len(line)


def until_newline(f) -> bytes:
    """What is left of a line, its end included; leaves the file behind it."""
    out = b""
    while True:
        part = f.read(4096)
        cut_ = part.find(b"\n")
        if cut_ >= 0:
            f.seek(f.tell() - len(part) + cut_ + 1)
            return out + part[: cut_ + 1]
        out += part
        if not part:
            return out


def read_texts(spark: SparkSession, root: str, glob: str | None = None, split: int = SPLIT) -> DataFrame:
    """A row for every line of the bodies of all files below ``root`` (``SCHEMA``), and for each file that cannot be read; the code is the file's name."""
    known = saved(dialects(spark, root, glob), "dialects")
    code = F.regexp_replace(F.regexp_extract("path", "[^/]+$", 0), r"\.\w+$", "")
    known = known.withColumn("code", code)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("length") - F.col("body")) / split) - 1, F.lit(0))))
    splits = known.where("error IS NULL").select("path", "code", "encoding", "separator", "columns", "body", "length", starts.alias("n"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        rows: list[tuple] = []  # of many splits: a table for each small file would cost more than its lines
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                d = Dialect(r.encoding, r.separator, 0, {k: int(v) for k, v in dict(r.columns).items()})
                start = int(r.body) + int(r.n) * split
                with open_input(r.path) as f:
                    for at, raw in lines_of(f, start, min(start + split, int(r.length)), int(r.body)):
                        line, bad, v = "", None, {}
                        try:
                            line = raw.decode(d.encoding).rstrip("\r\n")
                            v = bar_of(line, d) if line.strip() else {}
                        except UnicodeDecodeError:
                            bad = BadLine(f"not in {d.encoding}", True)
                        except BadLine as e:
                            bad = e
                        if v or bad:
                            period = ("minute" if len(v["ts"]) > 10 else "day") if v else None
                            rows.append((r.path, r.code, period, at, v.get("ts"), *map(v.get, VALUES), str(bad) if bad else None, bool(bad and bad.fatal), line[:200] if bad else None))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    body = splits.repartition(tasks_of(spark), "path", "n").mapInPandas(run, SCHEMA)
    failed = known.where("error IS NOT NULL").select(*(F.col(n) if n in ("path", "code", "error") else (F.lit(True) if n == "fatal" else F.lit(0 if n == "at" else None).cast("long" if n == "at" else "double" if n in VALUES else "string")).alias(n) for n in names))
    return body.union(failed)


def import_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars of files without a fatal line, a ledger row for each file) of ``read_texts``, which are made once; of one time the last line counts."""
    rows = saved(rows.drop("line"), "lines")
    first = F.min_by(F.concat(F.lit("at byte "), F.col("at").cast("string"), F.lit(": "), F.col("error")), F.when(F.col("fatal"), F.col("at")))
    files = rows.groupBy("path", "code").agg(F.max("period").alias("period"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.countDistinct("ts").alias("rows"), F.count_if(F.col("error").isNotNull()).alias("dropped"), F.coalesce(F.max("fatal"), F.lit(False)).alias("fatal"), first.alias("why"))
    error = F.when(F.col("fatal"), F.col("why")).when(F.col("rows") == 0, "no line is a bar")
    ledger = saved(files.select("path", "code", "period", "start_ts", "end_ts", "rows", "dropped", F.when(error.isNull(), "imported").otherwise("failed").alias("status"), error.alias("error")), "ledger")
    last = rows.where("error IS NULL").groupBy("path", "code", "period", "ts").agg(F.max_by(F.struct(*VALUES), "at").alias("v"))
    bars = last.join(ledger.where("status = 'imported'").select("path"), "path", "left_semi").select("code", "period", "ts", *(F.col(f"v.{c}").alias(c) for c in VALUES))
    return bars, ledger
