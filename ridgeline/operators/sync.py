"""Incremental ingest: where each series goes on, what its open tail is, and what a run leaves in the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.adjust import period_end
from ridgeline.operators.clean import new_keys, upsert


def next_start(series: DataFrame, calendar: DataFrame, since: str, end: str) -> DataFrame:
    """code, period, start: the trading day after the last bar; ``since`` for an empty series; null if nothing is left.

    series: (code, period, last_ts); calendar: (day). The calendar is a few
    thousand days: the next day of each is looked up by an equi-join.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("day")
    days = calendar.select(F.date_format("day", "yyyy-MM-dd").alias("day")).distinct().withColumn("after", F.lead("day").over(w))
    last = F.substring("last_ts", 1, 10)
    held = series.withColumn("d", last).join(days, F.col("d") == F.col("day"), "left")
    plain = F.date_format(F.date_add(F.to_date("d"), 1), "yyyy-MM-dd")  # a last day that the calendar lacks
    start = F.when(F.col("last_ts").isNull(), F.lit(since)).otherwise(F.coalesce("after", F.when(F.col("day").isNull(), plain)))
    return held.select("code", "period", F.when(start <= end, start).alias("start"))


def drop_open_tail(bars: DataFrame, to: str, today: str) -> DataFrame:
    """Derived bars without those whose week or month has not ended: they are made again from the days."""
    return bars.where(period_end(F.col("ts"), to) < F.to_date(F.lit(today)))


def ingest(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the store after an upsert, how many bars are new by code)."""
    added = new_keys(old, new, keys).groupBy("code").agg(F.count("*").alias("added"))
    return upsert(old, new, keys), added


def ledger(before: DataFrame, run: DataFrame) -> DataFrame:
    """sync_state after a run: (code, period, start_ts, end_ts, rows, error).

    A run without rows or with an error keeps the watermark of before; only its
    error is noted.
    """
    cols = ["start_ts", "end_ts", "rows", "error"]
    both = run.select("code", "period", *(F.col(c).alias(f"r_{c}") for c in cols), F.lit(True).alias("ran")).join(before.select("code", "period", *cols), ["code", "period"], "full_outer")
    fresh = F.col("ran").isNotNull() & F.col("r_error").isNull() & (F.coalesce("r_rows", F.lit(0)) > 0)
    pick = lambda c: F.when(fresh, F.col(f"r_{c}")).otherwise(F.col(c))
    first = F.when(fresh, F.least("start_ts", "r_start_ts")).otherwise(F.col("start_ts"))
    return both.select("code", "period", first.alias("start_ts"), pick("end_ts").alias("end_ts"), pick("rows").alias("rows"), F.when(F.col("ran").isNotNull(), F.col("r_error")).otherwise(F.col("error")).alias("error"))


def too_many_failures(results: DataFrame, most: int = 20) -> DataFrame:
    """period, at: where a period's run meets ``most`` failures one after another, in the order ``seq``; gaps and islands."""
    w = Window.partitionBy("period").orderBy("seq")
    run = results.withColumn("block", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w)).where(~F.col("ok"))
    place = F.row_number().over(Window.partitionBy("period", "block").orderBy("seq"))
    return run.withColumn("n", place).where(F.col("n") == most).groupBy("period").agg(F.min("seq").alias("at"))


def sample(codes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` codes in the order of a seeded hash: the same everywhere. A sampling operator, so it has a limit."""
    return codes.orderBy(F.xxhash64("code", F.lit(seed)), "code").limit(n)
