"""Cleaning, ranges, upserts: what a bar table goes through before anything else."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.sources.bars import PRICES, VALUES

KEYS = ["code", "period", "ts"]


def normalize(rows: DataFrame, keys: list[str] | None = None, arrival: str = "arrival") -> DataFrame:
    """Typed, valid, unique bars.

    Missing columns become 0 or ''; text is trimmed and numbers are coerced
    (what is no number is 0); rows without ts, with a price of 0 or less, or
    with high below low go; an open or close outside its range stays. Of rows
    with equal keys the last to arrive stays.
    """
    keys = keys or [k for k in KEYS if k in rows.columns or k == "ts"]
    have = set(rows.columns)
    number = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(0.0)) if c in have else F.lit(0.0)
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in have else F.lit("")
    order = F.col(arrival) if arrival in have else F.monotonically_increasing_id()
    df = rows.select(*(text(k).alias(k) for k in keys), *(number(c).alias(c) for c in VALUES), order.alias("_arrival"))
    good = (F.col("ts") != "") & (F.col("high") >= F.col("low"))
    for c in PRICES:
        good &= F.col(c) > 0
    last = F.max_by(F.struct(*VALUES), "_arrival").alias("v")
    return df.where(good).groupBy(*keys).agg(last).select(*keys, "v.*")


def truncate(bars: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """start <= ts <= end as text (a date alone ends before its minutes), then the last ``limit`` bars of each series."""
    if start is not None:
        bars = bars.where(F.col("ts") >= start)
    if end is not None:
        bars = bars.where(F.col("ts") <= end)
    if limit is not None:
        by = [k for k in (*keys, "period") if k in bars.columns]
        w = Window.partitionBy(*by).orderBy(F.desc("ts"))
        bars = bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    return bars


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows; of equal keys the new one. One shuffle: rows are ranked by where they come from."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("v")).select(*keys, "v.*")


def new_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``new`` that ``old`` lacks: what an upsert adds."""
    return new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")
