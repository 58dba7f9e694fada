"""Point-in-time rules over tables of structure: what was known, and what became of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.bars import series_keys

TENTATIVE, CONFIRMED, INVALIDATED = "tentative", "confirmed", "invalidated"


def backtestable(items: DataFrame, as_of) -> DataFrame:
    """Confirmed, and known by ``as_of`` (text or a column)."""
    return items.where((F.col("status") == CONFIRMED) & F.col("confirmed_at").isNotNull() & (F.col("confirmed_at") <= as_of))


def confirmed_fractals(fractals: DataFrame, merged: DataFrame, as_of) -> DataFrame:
    """Fractals whose time of knowledge (their own, else the next merged bar's) has come."""
    nxt = merged.select(F.col("code").alias("m_code"), (F.col("idx") - 1).alias("m_idx"), F.col("ts").alias("m_ts"))
    known = fractals.join(nxt, (F.col("code") == F.col("m_code")) & (F.col("start_idx") == F.col("m_idx")), "left").withColumn("known_at", F.coalesce("confirmed_at", "m_ts"))
    return known.where(F.col("known_at") <= as_of).drop("m_code", "m_idx", "m_ts")


def reconcile(prev: DataFrame, new: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """The new snapshot's objects with the fate of the old ones.

    An object that was confirmed keeps its status and time on the new geometry;
    a newly confirmed one gets its own time, else ``as_of``; objects that are
    gone stay as invalidated. The key includes a signal's kind, so that two
    kinds on one segment do not meet.
    """
    old = prev.select(*(F.col(k).alias(f"o_{k}") for k in keys), F.col("status").alias("o_status"), F.col("confirmed_at").alias("o_confirmed"), F.lit(True).alias("was"))
    cur = new.select(*keys, "status", "confirmed_at", F.lit(True).alias("is_new"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"o_{k}"))
        on = same if on is None else on & same
    both = cur.join(old, on, "full_outer")
    gone, held = F.col("is_new").isNull(), F.col("o_status") == CONFIRMED
    status = F.when(gone, INVALIDATED).when(held, CONFIRMED).otherwise(F.col("status"))
    known = F.when(gone, F.col("o_confirmed")).when(held, F.col("o_confirmed")).when(F.col("status") == CONFIRMED, F.coalesce("confirmed_at", F.lit(as_of))).otherwise(F.col("confirmed_at"))
    return both.select(*(F.when(gone, F.col(f"o_{k}")).otherwise(F.col(k)).alias(k) for k in keys), status.alias("status"), known.alias("confirmed_at"))


def first_visible(seen: DataFrame, bars: DataFrame, keys: list[str], time: str = "checkpoint") -> DataFrame:
    """When each object first shows, without those that the first bar of its series shows already."""
    own = [k for k in ("code", "period") if k in keys]
    start = bars.groupBy(*(F.col(k).alias(f"s_{k}") for k in own)).agg(F.min("ts").alias("start"))
    first = seen.groupBy(*keys).agg(F.min(time).alias("first_visible"))
    on = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in own]
    return first.join(start, on).where(F.col("first_visible") > F.col("start")).select(*keys, "first_visible")


def snapshot_counts(table: DataFrame) -> DataFrame:
    """Objects of each layer by status."""
    s = F.coalesce("status", F.lit(CONFIRMED))
    return table.groupBy(*series_keys(table), "layer").agg(F.count("*").alias("n"), F.count_if(s == CONFIRMED).alias("n_confirmed"), F.count_if(s == TENTATIVE).alias("n_tentative"))


def snapshot_json(table: DataFrame) -> DataFrame:
    """code, [period,] payload: a series' objects as one JSON text, by layer, depth and index."""
    item = F.struct("layer", "depth", "idx", "kind", "direction", "ts", "end_ts", "price", "high", "low", "zg", "zd", "start_idx", "end_idx", "src_start", "src_end", "status", "confirmed_at", "area_now", "area_prev", "flag", "level")
    return table.groupBy(*series_keys(table)).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("payload"))
