"""Checks between tables of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.numbers import round_half_up
from ridgeline.operators.adjust import minute_to_day


def alias_pairs(bars: DataFrame, least: int = 20, most_diff: float = 0.005) -> DataFrame:
    """old_code, new_code where 920 and the last three digits trade alike over ``least`` common days."""
    old = bars.where("code NOT LIKE '920%'").select(F.col("code").alias("old_code"), F.concat(F.lit("920"), F.right("code", F.lit(3))).alias("new_code"), "ts", F.col("close").alias("old_close"))
    new = bars.where("code LIKE '920%'").select(F.col("code").alias("new_code"), "ts", "close")
    both = old.join(new, ["new_code", "ts"]).groupBy("old_code", "new_code").agg(F.count("*").alias("n"), F.max(F.abs(F.col("old_close") - F.col("close"))).alias("worst"))
    return both.where((F.col("n") >= least) & (F.col("worst") < most_diff)).select("old_code", "new_code", "n")


def minute_against_day(minutes: DataFrame, days: DataFrame, tolerance: float = 1e-6, limit: int | None = 10) -> DataFrame:
    """The first days whose minutes add up to other prices: code, day and the two closes."""
    own = minute_to_day(minutes)
    d = days.select("code", F.col("ts").alias("day"), *(F.col(c).alias(f"d_{c}") for c in ("open", "high", "low", "close")))
    off = F.lit(False)
    for c in ("open", "high", "low", "close"):
        off |= F.abs(F.col(c) - F.col(f"d_{c}")) > tolerance
    bad = own.join(d, ["code", "day"]).where(off).select("code", "day", "close", "d_close")
    return bad.orderBy("code", "day").limit(limit) if limit is not None else bad


def cross_source(a: DataFrame, b: DataFrame) -> DataFrame:
    """code, n, worst_day, worst: the largest relative difference of closes on common days (the first of equal ones)."""
    diff = F.abs(F.col("close") - F.col("b_close")) / F.col("b_close")
    both = a.select("code", "ts", "close").join(b.select("code", "ts", F.col("close").alias("b_close")).where("b_close > 0"), ["code", "ts"]).withColumn("diff", round_half_up(diff, 8))
    key = F.struct("diff", F.expr("-unix_date(try_to_date(substr(ts, 1, 10)))").alias("d"))
    return both.groupBy("code").agg(F.count("*").alias("n"), F.max_by("ts", key).alias("worst_day"), F.max("diff").alias("worst"))


def latest_equals_actual(qfq: DataFrame, raw: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """code, ts, ok: is the adjusted close of the last common day the actual one?"""
    both = qfq.select("code", "ts", F.col("close").alias("q")).join(raw.where("close > 0").select("code", "ts", "close"), ["code", "ts"])
    last = both.groupBy("code").agg(F.max_by(F.struct("ts", "q", "close"), "ts").alias("v"))
    err = F.abs(F.col("v.q") - F.col("v.close")) / F.col("v.close")
    return last.select("code", F.col("v.ts").alias("ts"), round_half_up(err, 8).alias("error"), (err <= tolerance).alias("ok"))


def kind_breakdown(flags: DataFrame) -> DataFrame:
    """kind, total, failing of quality flags."""
    return flags.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("ok") == 0).alias("failing"))


def adjust_mix(sync: DataFrame) -> DataFrame:
    """Periods whose series are stored in more than one basis."""
    return sync.where("adjust IS NOT NULL").groupBy("period").agg(F.countDistinct("adjust").alias("bases"), F.count("*").alias("n")).where("bases > 1")


LATEST_DAYS, CROSS_MOST = 45, 0.005  # fixed values: the days in which the last close must be the actual one; how far sources may differ


def bottom_k(codes: DataFrame, n: int, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """``n`` codes (of each stratum) with the smallest seeded hashes: the same under any partitioning, and those of two tables merge to those of their union. A sampling operator, so it has a limit."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("code")))
    by = [stratum] if stratum else []
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy("_hash", "code")
    return codes.select("code", *by).distinct().withColumn("_hash", h).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n", "_hash")


def quality_run(codes: DataFrame, qfq: DataFrame, raw: DataFrame, other: DataFrame, n: int = 20, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """code, kind, ok, detail, max_rel_err: two checks of a sample of ``codes``; a code without rows to compare fails the check.

    latest_equals_actual: on the last common day of the last weeks the adjusted
    close is the actual one. cross_source: another source's adjusted closes stay near. Only
    the sample's bars go into the checks.
    """
    picked = bottom_k(codes, n, seed, stratum).select("code")
    a, b, c = (df.join(picked, "code", "left_semi") for df in (qfq, raw, other))
    last = a.groupBy("code").agg(F.max("ts").alias("_last"))
    recent = lambda df: df.join(last, "code").where(F.to_date(F.substring("ts", 1, 10)) >= F.date_sub(F.to_date(F.substring("_last", 1, 10)), LATEST_DAYS)).drop("_last")
    latest = latest_equals_actual(recent(a), recent(b)).select("code", "ok", F.col("error").alias("max_rel_err"), F.concat(F.lit("last common day "), "ts").alias("detail"))
    cross = cross_source(a, c).select("code", (F.col("worst") < CROSS_MOST).alias("ok"), F.col("worst").alias("max_rel_err"), F.concat(F.col("n").cast("string"), F.lit(" common days, worst "), "worst_day").alias("detail"))
    out = None
    for kind, got in (("latest_equals_actual", latest), ("cross_source", cross)):
        one = picked.join(got, "code", "left").select("code", F.lit(kind).alias("kind"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("detail", F.lit("nothing to compare")).alias("detail"), "max_rel_err")
        out = one if out is None else out.union(one)
    return out


def save_quality(spark, root: str, results: DataFrame, ts: str, period: str = "day") -> DataFrame:
    """Enters the results in the ledger of flags, and returns the report: kind, total, failing."""
    from ridgeline.operators.persist import opened
    from ridgeline.sources.shared import saved

    rows = saved(results, "quality")
    opened(spark, root, "quality_flag").upsert(rows.select("code", F.lit(period).alias("period"), "kind", "ok", "detail", F.lit(ts).alias("ts")))
    return kind_breakdown(rows.withColumn("ok", F.col("ok").cast("int")))
