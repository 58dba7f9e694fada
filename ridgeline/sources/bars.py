"""Bars: the one table contract of the engine, and where bars come from.

A bar is (code, period, ts, open, high, low, close, volume, amount); (code,
period, ts) is unique. Prices of the fixtures are whole cents, so structure
never turns on a rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ["open", "high", "low", "close"]
VALUES = [*PRICES, "volume", "amount"]
SCHEMA = T.StructType([T.StructField("code", T.StringType()), T.StructField("period", T.StringType()), T.StructField("ts", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in VALUES)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_keys(*tables: DataFrame) -> list[str]:
    """What tells series apart: code, and period where all tables have it."""
    return ["code", *(["period"] if all("period" in t.columns for t in tables) else [])]


def same_series(a: DataFrame, b: DataFrame, prefix: str) -> F.Column:
    """The join of two tables by series; the second one's keys are called by a prefix. Series without a period meet."""
    on = F.lit(True)
    for k in series_keys(a):
        if f"{prefix}{k}" in b.columns:
            on &= F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) if k == "period" else F.col(k) == F.col(f"{prefix}{k}")
    return on


def only_days(bars: DataFrame) -> DataFrame:
    """Day bars of a table that may hold other periods."""
    return bars.where("period = 'day' OR period IS NULL") if "period" in bars.columns else bars


def empty_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def to_bars(rows: DataFrame, order: list[str]) -> DataFrame:
    """OHLCV from rows (code, bucket, price, quantity): first and last by ``order``, which is made total by the price."""
    key = F.struct(*order, "price")
    return rows.groupBy("code", F.col("bucket").alias("ts")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("quantity").alias("volume"), F.sum("price").alias("amount")
    )


def day(ts) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd")


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by return flag; the price is a line's unit price in cents."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("long")
    rows = li.select(F.col("l_returnflag").alias("code"), day("l_shipdate").alias("bucket"), price.alias("price"), F.col("l_quantity").cast("long").alias("quantity"), "l_orderkey", "l_linenumber")
    return to_bars(rows, ["l_orderkey", "l_linenumber"])


def order_walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by order priority over a walk of whole cents: dense in strokes and segments."""
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code"), day("o_orderdate").alias("bucket"), "o_orderdate", "o_orderkey", cents.alias("cents"))
    w = Window.partitionBy("code").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("price", F.lit(10_000_000_000) + F.sum(F.col("cents") - 25_025_000).over(w)).withColumn("quantity", F.lit(1).cast("long"))
    return to_bars(rows, ["o_orderkey"])


def event_bars(spark: SparkSession, sf_dir: str, bucket: str = "hour") -> DataFrame:
    """Hourly bars by event type over a walk of whole cents."""
    ev = table(spark, sf_dir, "events")
    rows = ev.select(F.col("event_type").alias("code"), F.date_format(F.date_trunc(bucket, "ts"), "yyyy-MM-dd HH:mm").alias("bucket"), "ts", "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    w = Window.partitionBy("code").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mean = Window.partitionBy("code")
    rows = rows.withColumn("step", F.col("cents") - F.floor(F.sum("cents").over(mean) / F.count("*").over(mean)).cast("long"))
    rows = rows.withColumn("price", F.lit(100_000_000) + F.sum("step").over(w)).withColumn("quantity", F.lit(1).cast("long"))
    return to_bars(rows, ["ts", "event_id"])


# --- the store: data/{period}/{market}, one row a bar -------------------------------------------------------------


def write_bars(bars: DataFrame, root: str) -> None:
    """Bars by period and market; a rewrite replaces only the partitions that it holds."""
    from ridgeline.functions.codes import market_of

    bars.withColumn("market", market_of(F.col("code"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "market").parquet(root)


def read_bars(spark: SparkSession, root: str, code: str | None = None, period: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Bars of a range; period is pruned to partitions, code and ts are pushed to the scan. ``limit``: the last so many of a series."""
    from ridgeline.operators.clean import truncate

    df = spark.read.parquet(root)
    if period is not None:
        df = df.where(F.col("period") == period)
    if code is not None:
        df = df.where(F.col("code") == code)
    return truncate(df, start, end, limit)


def last_ts(bars: DataFrame) -> DataFrame:
    """code, period, last_ts, rows: the watermarks of a store."""
    return bars.groupBy("code", "period").agg(F.max("ts").alias("last_ts"), F.count("*").alias("rows"))
