"""Price adjustment by factor ladders, and resampling to longer periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.numbers import round_half_up
from ridgeline.sources.bars import PRICES, only_days, series_keys


def with_factor(bars: DataFrame, ladder: DataFrame) -> DataFrame:
    """Bars with ``k``, the last factor at or before each bar, and ``k0``, the code's first.

    An as-of join by one sort: ladder rows and bars are put in order together
    and the last factor is carried along. Bars before the first step get k0.
    """
    cols = bars.columns
    steps = ladder.select("code", "ts", F.col("k").alias("_k"), F.lit(0).alias("_bar"))
    rows = bars.withColumn("_bar", F.lit(1)).unionByName(steps, allowMissingColumns=True)
    at = Window.partitionBy("code").orderBy("ts", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("code").orderBy("ts", "_bar").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k0 = F.first("_k", ignorenulls=True).over(whole)
    return rows.withColumn("k0", k0).withColumn("k", F.coalesce(F.last("_k", ignorenulls=True).over(at), "k0")).where("_bar = 1").select(*cols, "k", "k0")


def adjust(bars: DataFrame, ladder: DataFrame, mode: str, stored: str = "raw", digits: int = 4) -> DataFrame:
    """OHLC in another basis: raw to qfq (x k) or hfq (x k/k0), stored qfq to raw (/ k) or hfq (/ k0)."""
    if mode not in ("raw", "qfq", "hfq"):
        raise ValueError(f"unknown adjustment {mode!r}")
    if mode == stored:
        return bars
    by = {("raw", "qfq"): F.col("k"), ("raw", "hfq"): F.col("k") / F.col("k0"), ("qfq", "raw"): 1 / F.col("k"), ("qfq", "hfq"): 1 / F.col("k0")}[stored, mode]
    if stored == "qfq":
        divide = F.col("k") if mode == "raw" else F.col("k0")
        scaled = {c: F.col(c) / divide for c in PRICES}
    else:
        scaled = {c: F.col(c) * by for c in PRICES}
    rows = with_factor(bars, ladder)
    one = F.coalesce("k", F.lit(None))
    return rows.select(*(F.when(one.isNull(), F.col(c)).otherwise(round_half_up(scaled[c], digits)).alias(c) if c in PRICES else F.col(c) for c in bars.columns))


def infer_factors(raw: DataFrame, qfq: DataFrame) -> DataFrame:
    """code, ts, k where the ratio of adjusted to raw close changes; the first bar always counts. Days only."""
    raw, qfq = only_days(raw), only_days(qfq)
    k = round_half_up(F.col("q") / F.col("close"), 8)
    both = raw.where("close > 0").select("code", "ts", "close").join(qfq.select("code", "ts", F.col("close").alias("q")), ["code", "ts"]).select("code", "ts", k.alias("k"))
    prev = F.lag("k").over(Window.partitionBy("code").orderBy("ts"))
    return both.withColumn("prev", prev).where("prev IS NULL OR k <> prev").select("code", "ts", "k")


def factor_status(raw: DataFrame, qfq: DataFrame, codes: DataFrame, least: int = 20) -> DataFrame:
    """code, status, steps of a factor build: no_raw, no_qfq, thin_overlap, no_change or written. Days only."""
    raw, qfq = only_days(raw), only_days(qfq)
    n = lambda df, name: df.groupBy("code").agg(F.count("*").alias(name))
    both = n(raw.select("code", "ts").join(qfq.select("code", "ts"), ["code", "ts"]), "n_both")
    steps = n(infer_factors(raw, qfq), "steps")
    df = codes.select("code").join(n(raw, "n_raw"), "code", "left").join(n(qfq, "n_qfq"), "code", "left").join(both, "code", "left").join(steps, "code", "left")
    status = F.when(F.col("n_raw").isNull(), "no_raw").when(F.col("n_qfq").isNull(), "no_qfq").when(F.coalesce("n_both", F.lit(0)) < least, "thin_overlap").when(F.col("steps") <= 1, "no_change").otherwise("written")
    return df.select("code", status.alias("status"), F.coalesce("steps", F.lit(0)).alias("steps"))


def resample(bars: DataFrame, to: str) -> DataFrame:
    """Day bars as weeks (from Monday) or months, dated by their last trading day; aggregated before the shuffle."""
    if to not in ("week", "month"):
        raise ValueError("to is week or month")
    bucket = F.date_trunc(to, F.to_date(F.substring("ts", 1, 10)))
    return only_days(bars).groupBy("code", bucket.alias("_bucket")).agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    ).drop("_bucket")


def minute_to_day(bars: DataFrame) -> DataFrame:
    """Intraday bars as days, those of each period for themselves."""
    return bars.groupBy(*series_keys(bars), F.substring("ts", 1, 10).alias("day")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))


def period_end(ts, to: str) -> F.Column:
    d = F.to_date(F.substring(ts, 1, 10))
    return F.date_add(F.trunc(d, "week"), 6) if to == "week" else F.last_day(d)


def period_complete(bars: DataFrame, to: str, calendar: DataFrame) -> DataFrame:
    """code, ts, complete: is the last trading day of the period among the bars? calendar: (day)."""
    last = calendar.select(period_end(F.col("day").cast("string"), to).alias("_end"), "day").groupBy("_end").agg(F.date_format(F.max("day"), "yyyy-MM-dd").alias("_last"))
    return bars.withColumn("_end", period_end(F.col("ts"), to)).join(last, "_end", "left").select("code", "ts", F.coalesce(F.col("_last") == F.col("ts"), F.lit(False)).alias("complete"))
