"""Moving averages natively; EMA and MACD once for each series, because each value needs the last."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.numbers import round_half_up
from ridgeline.operators import kernel
from ridgeline.sources.bars import series_keys

DEFAULT_MA = (5, 10, 20, 60, 120, 250)


def parse_ma(text: str) -> tuple[int, ...]:
    """'5,10' as (5, 10): at most 12 lines of 1 to 1000 bars, each once."""
    out = tuple(dict.fromkeys(int(x) for x in text.split(",") if x.strip()))
    if len(out) > 12 or any(not 1 <= n <= 1000 for n in out):
        raise ValueError("at most 12 averages of 1 to 1000 bars")
    return out


def moving_averages(bars: DataFrame, lines=DEFAULT_MA, digits: int = 4) -> DataFrame:
    """code, [period,] ts, close and ma{n} for each n; null until n bars are there. One sort serves all lines."""
    keys, cols = series_keys(bars), []
    for n in lines:
        w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-(n - 1), 0)
        cols.append(F.when(F.count("close").over(w) == n, round_half_up(F.sum("close").over(w) / n, digits)).alias(f"ma{n}"))
    return bars.select(*keys, "ts", "close", *cols)


def ema_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """code, [period,] ts, close, dif, dea, hist of every series."""
    keys = series_keys(bars)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        dif, dea, hist = kernel.macd(pdf["close"].to_numpy(float), fast, slow, signal)
        return pdf.assign(dif=dif, dea=dea, hist=hist)

    return bars.select(*keys, "ts", F.col("close").cast("double").alias("close")).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", ts string, close double, dif double, dea double, hist double")


def price_change(bars: DataFrame) -> DataFrame:
    """code, ts, close, prev_close, change_pct of the last bar of each series."""
    keys = series_keys(bars)
    w = Window.partitionBy(*keys).orderBy("ts")
    df = bars.withColumn("prev_close", F.lag("close").over(w)).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))).where("n = 1")
    return df.select(*keys, "ts", "close", "prev_close", round_half_up((F.col("close") - F.col("prev_close")) / F.col("prev_close") * 100, 4).alias("change_pct"))


def max_drawdown(equity: DataFrame) -> DataFrame:
    """key, drawdown, drawdown_pct: the worst absolute fall from the running peak, and its share of that peak."""
    w = Window.partitionBy("key").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = equity.withColumn("peak", F.max("equity").over(w)).withColumn("fall", F.col("peak") - F.col("equity"))
    worst = F.max_by(F.struct("fall", "peak"), F.struct("fall", F.expr("-unix_date(try_to_date(substr(ts, 1, 10)))"))).alias("w")
    return df.groupBy("key").agg(worst).select("key", F.col("w.fall").alias("drawdown"), F.when(F.col("w.peak") > 0, round_half_up(F.col("w.fall") / F.col("w.peak"), 6)).alias("drawdown_pct"))
