"""Zip packages of day and minute files: members are listed as rows, read as units of work, gated and entered in a ledger.

The central directory of each package is read by a task (a few hundred bytes a
member, by random reads), so the driver reads none. Each member's place in its
package is a column: any task reads any member by one seek. Minute bars are let in
only if they make the day's bars: their dates are an encoding that a file alone
cannot prove. Every member has a row in the ledger, whatever became of it.
"""

from __future__ import annotations

import re
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.codes import store_key
from ridgeline.sources.bars import PRICES, VALUES
from ridgeline.sources.files import SUFFIX, FormatError, day_columns, minute_columns
from ridgeline.sources.shared import open_input, paths_below, saved, tasks_of

MEMBERS = "path string, member string, market string, digits string, period string, size long, method int, crc long, at long, packed long, reason string"
PARSED = "path string, member string, code string, period string, ts string, " + ", ".join(f"{c} double" for c in VALUES) + ", error string"
#: What the first two digits stand for in each market.
KINDS = {
    "index": {"sh": ["00"], "sz": ["39"]}, "board": {"sh": ["88"], "bj": ["81", "82"]},
    "stock": {"sh": ["60", "68"], "sz": ["00", "30"], "bj": ["43", "83", "87", "89", "92"]},
    "fund": {"sh": ["11", "50", "51", "56", "58"], "sz": ["12", "15", "16", "18", "20"]},
}
TOLERANCE = 1e-6  # fixed value: how near minutes must come to their day
DIGITS = "[0-9]{6}"  # fixed value: what the exchanges' numbers look like
ROWS = 20_000  # about so many bars leave a task at a time


def kind_of(market, digits) -> F.Column:
    """index, board, stock, fund or other; an index goes before a stock of the same digits."""
    two, out = F.substring(digits, 1, 2), F.lit("other")
    for kind, rules in reversed(KINDS.items()):
        hit = F.lit(False)
        for m, heads in rules.items():
            hit |= (market == m) & two.isin(*heads)
        out = F.when(hit, kind).otherwise(out)
    return out


def place_of(name: str, form: str = DIGITS) -> tuple[str | None, str | None, str | None, str | None]:
    r"""market, digits (of a form), period of a member such as sh\lday\sh600000.day, and why it is none."""
    parts = [p for p in re.split(r"[\\/]", name) if p]
    if len(parts) != 3:
        return None, None, None, "not market/folder/file"
    stem, _, suffix = parts[2].rpartition(".")
    period = SUFFIX.get("." + suffix.lower())
    if period is None:
        return None, None, None, f"unknown suffix .{suffix}"
    digits = stem.removeprefix(parts[0])
    if digits == stem or not re.fullmatch(form, digits):
        return None, None, None, "the name is not its market and " + ("six digits" if form == DIGITS else form)
    return parts[0], digits, period, None


def list_members(spark: SparkSession, root: str, form: str = DIGITS) -> DataFrame:
    """A row for each member of each package below ``root`` (``MEMBERS`` and kind); a package that cannot be read is a row with a reason."""

    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                try:
                    with open_input(path) as f, zipfile.ZipFile(f) as z:
                        placed = ((i, place_of(i.orig_filename, form)) for i in z.infolist() if not i.is_dir() and not i.orig_filename.endswith("\\"))
                        rows = [(path, i.filename, *p[:3], i.file_size, i.compress_type, i.CRC, i.header_offset, i.compress_size, p[3]) for i, p in placed]
                except (zipfile.BadZipFile, OSError, ValueError) as e:  # Arrow tells of a bad seek by ValueError
                    rows = [(path, None, None, None, None, None, None, None, None, None, f"no package: {e}")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")]).astype({"size": "Int64", "method": "Int32", "crc": "Int64", "at": "Int64", "packed": "Int64"})

    found = paths_below(spark, root, "*.zip").select("path").repartition(tasks_of(spark), "path").mapInPandas(run, MEMBERS)
    return found.withColumn("kind", F.when(F.col("reason").isNull(), kind_of(F.col("market"), F.col("digits"))))


def content(f, at: int, packed: int, method: int, crc: int, size: int) -> bytes:
    """A member's bytes, by one seek to its local header."""
    f.seek(at)
    head = f.read(30)
    if head[:4] != b"PK\3\4":
        raise FormatError("no member begins there")
    f.seek(at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    raw = f.read(packed)
    if method not in (0, 8):
        raise FormatError(f"compression {method} is not known")
    try:
        data = zlib.decompress(raw, -15) if method else raw
    except zlib.error as e:
        raise FormatError(f"broken: {e}") from None
    if len(data) != size or zlib.crc32(data) != crc:
        raise FormatError("the checksum differs")
    return data


def read_members(members: DataFrame, tasks: int | None = None) -> DataFrame:
    """Bars of the listed members, dealt to tasks one by one; a member that cannot be read is a row with an error."""

    def frame(held):
        """One table of many members' bars: a table for each would cost more than its bars."""
        sizes = [len(got["ts"]) for *_, got in held]
        names = {c: np.repeat(np.array([h[i] for h in held], object), sizes) for i, c in enumerate(("path", "member", "code", "period", "error"))}
        values = {c: np.concatenate([got[c] for *_, got in held]) for c in VALUES}
        df = pd.DataFrame(names | {"ts": [t for *_, got in held for t in got["ts"]]} | values)
        return df[["path", "member", "code", "period", "ts", *VALUES, "error"]]

    def run(batches):
        nothing = {"ts": [None], **{c: np.full(1, np.nan) for c in VALUES}}
        for pdf in batches:
            held, n = [], 0
            for path, own in pdf.groupby("path"):
                with open_input(path) as f:
                    for r in own.itertuples(index=False):
                        try:
                            data = content(f, int(r.at), int(r.packed), int(r.method), int(r.crc), int(r.size))
                            got, error = (day_columns if r.period == "day" else minute_columns)(data), None
                        except FormatError as e:
                            got, error = nothing, str(e)
                        held.append((path, r.member, r.code, r.period, error, got))
                        n += len(got["ts"])
                        if n >= ROWS:
                            yield frame(held)
                            held, n = [], 0
            if n:
                yield frame(held)

    tasks = tasks or tasks_of(members.sparkSession)
    code = store_key(F.concat("market", F.lit("."), "digits"))
    return members.where("reason IS NULL").select("path", "member", code.alias("code"), "period", "at", "packed", "method", "crc", "size").repartition(tasks, "path", "member").mapInPandas(run, PARSED)


def minute_gate(minutes: DataFrame, days: DataFrame) -> DataFrame:
    """code, period and why its minutes are not proven: null where each day that both have is made by its minutes."""
    made = minutes.groupBy("code", "period", F.substring("ts", 1, 10).alias("day")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
    ref = days.select(F.col("code").alias("r_code"), F.substring("ts", 1, 10).alias("r_day"), *(F.col(c).alias(f"r_{c}") for c in PRICES), F.lit(True).alias("has_day"))
    both = made.join(ref, (F.col("code") == F.col("r_code")) & (F.col("day") == F.col("r_day")), "left")
    wrong = [F.when(F.abs(F.col(c) - F.col(f"r_{c}")) > TOLERANCE, F.concat(F.col("day"), F.lit(f" {c}: minutes make "), F.col(c).cast("string"), F.lit(", the day has "), F.col(f"r_{c}").cast("string"))) for c in PRICES]
    judged = both.groupBy("code", "period").agg(F.count("has_day").alias("common"), F.min_by(F.coalesce(*wrong), F.when(F.coalesce(*wrong).isNotNull(), F.col("day"))).alias("problem"))
    known = days.select("code").distinct().withColumn("any_day", F.lit(True))
    why = F.when(F.col("any_day").isNull(), "no day bars to compare with").when(F.col("common") == 0, "no day in common").otherwise(F.col("problem"))
    return judged.join(known, "code", "left").select("code", "period", why.alias("problem"))


def import_packages(spark: SparkSession, root: str, periods=("day", "5", "1"), markets=("sh", "sz", "bj"), kinds=("stock", "index"), codes=None, days: DataFrame | None = None, allow_unverified: bool = False, form: str = DIGITS) -> tuple[DataFrame, DataFrame]:
    """(bars to store, a ledger row for each member): every member of the packages below ``root``.

    ``days``: stored day bars (code, ts, prices) of unadjusted prices, for minutes
    whose package holds no day file. Status: imported, unverified (kept out, or let in by ``allow_unverified``),
    alias (an old code of the Beijing exchange that goes on under another), empty, failed, skipped.
    ``form``: what a member's digits look like, where packages number more than an exchange does.
    """
    from ridgeline.operators.quality import alias_pairs

    members = saved(list_members(spark, root, form), "members")
    key = store_key(F.concat("market", F.lit("."), "digits"))
    asked = F.col("reason").isNull() & F.col("market").isin(*markets) & F.col("kind").isin(*kinds)
    if codes:
        asked &= F.col("digits").isin(*codes) | key.isin(*codes)
    wanted = asked & F.col("period").isin(*periods)
    rows = saved(read_members(members.where(asked & (F.col("period").isin(*periods) | (F.col("period") == "day")))), "parsed")
    good = rows.where("error IS NULL")
    own_days = good.where("period = 'day'")
    reference = own_days.select("code", "ts", *PRICES)
    if days is not None:
        reference = reference.union(days.join(reference.select("code").distinct(), "code", "left_anti").select("code", "ts", *PRICES))
    gate = minute_gate(good.where("period <> 'day'"), reference)
    pairs = alias_pairs(own_days).select(F.col("old_code").alias("code"), F.col("new_code").alias("target"))
    spans = rows.groupBy("path", "member").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("ts").alias("rows"), F.max("error").alias("broken"))
    told = members.withColumn("wanted", F.coalesce(wanted, F.lit(False))).withColumn("code", F.when(F.col("digits").isNotNull(), key)).select("path", "member", "code", "market", "kind", "period", "reason", "wanted")
    told = told.join(spans, ["path", "member"], "left").join(gate, ["code", "period"], "left").join(pairs, "code", "left")
    status = (
        F.when(F.col("member").isNull(), "failed").when(~F.col("wanted"), "skipped").when(F.col("target").isNotNull(), "alias").when(F.col("broken").isNotNull(), "failed")
        .when(F.coalesce("rows", F.lit(0)) == 0, "empty").when(F.col("problem").isNotNull(), "unverified").otherwise("imported")
    )
    error = F.when(~F.col("wanted") & F.col("member").isNotNull(), F.coalesce("reason", F.lit("not asked for"))).when(F.col("target").isNotNull(), F.concat(F.lit("goes on as "), "target")).otherwise(F.coalesce("reason", "broken", "problem"))
    ledger = saved(told.select("path", "member", "code", "market", "kind", "period", "start_ts", "end_ts", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"), error.alias("error")), "ledger")
    let_in = ledger.where(F.col("status").isin("imported", *(["unverified"] if allow_unverified else []))).select("path", "member")
    return good.join(let_in, ["path", "member"]).select("code", "period", "ts", *VALUES), ledger
