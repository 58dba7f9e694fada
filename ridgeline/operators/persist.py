"""What is kept from run to run: snapshots, trails, hits, fingerprints and how far each series is, each a ``KeyedTable``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import pit, scan, watch
from ridgeline.sources.keyed import KeyedTable

#: name: (schema, keys)
TABLES = {
    "structure_snapshot": ("code string, period string, as_of string, version int, payload string", ["code", "period"]),
    "signal_trail": ("code string, period string, adjust string, as_of string, step int, payload string", ["code", "period", "adjust"]),
    "scan_result": ("run_date string, code string, period string, kind string, ts string, level string, price double, status string, strength double, detail string", ["run_date", "code", "period", "kind", "ts"]),
    "fingerprint": ("code string, period string, as_of string, items array<struct<part: string, item: string>>", ["code", "period"]),
    "sync_state": ("code string, period string, start_ts string, end_ts string, rows long, adjust string, error string", ["code", "period"]),
    "quality_flag": ("code string, period string, kind string, ok boolean, detail string, ts string", ["code", "period", "kind"]),
    "alias": ("old_code string, new_code string, market string, evidence string", ["old_code"]),
    "universe": ("code string, name string, list_date string", ["code"]),
    "watchlist": ("code string, name string, sort_order int, added_at string", ["code"]),
}


def opened(spark: SparkSession, root: str, name: str, buckets: int = 32) -> KeyedTable:
    schema, keys = TABLES[name]
    return KeyedTable(spark, f"{root.rstrip('/')}/{name}", schema, keys, buckets)


def with_period(df: DataFrame, period: str = "day") -> DataFrame:
    return df.withColumn("period", F.coalesce("period", F.lit(period)) if "period" in df.columns else F.lit(period))


def save_snapshots(spark: SparkSession, root: str, table: DataFrame, as_of: DataFrame) -> int:
    """The latest snapshot of each series of a long table; its version is one more than the last one's. as_of: (code, period, as_of)."""
    to = opened(spark, root, "structure_snapshot")
    new = pit.snapshot_json(with_period(table)).join(with_period(as_of), ["code", "period"])
    old = to.read().select(F.col("code").alias("o_code"), F.col("period").alias("o_period"), F.col("version").alias("o_version"))
    rows = new.join(old, (F.col("code") == F.col("o_code")) & (F.col("period") == F.col("o_period")), "left")
    return to.upsert(rows.select("code", "period", "as_of", (F.coalesce("o_version", F.lit(0)) + 1).cast("int").alias("version"), "payload"))


def save_trails(spark: SparkSession, root: str, trail: DataFrame, step: int, adjust: str) -> int:
    """Each series' trail as JSON; written again it takes the place of the old one."""
    item = F.struct(*(c for c in trail.columns if c not in ("code", "period")))
    rows = with_period(trail).groupBy("code", "period").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("payload"), F.max("last_seen").alias("as_of"))
    return opened(spark, root, "signal_trail").upsert(rows.select("code", "period", F.lit(adjust).alias("adjust"), "as_of", F.lit(step).alias("step"), "payload"))


def save_hits(spark: SparkSession, root: str, hits: DataFrame, run_date: str) -> int:
    """The hits of a run's day; a run that comes twice writes the same rows."""
    have = set(hits.columns)
    text = F.concat_ws(" ", "kind", "ts", F.format_string("%.4f", "price"), "status")
    columns = {"run_date": F.lit(run_date), "level": F.col("level") if "level" in have else F.col("period"), "detail": F.col("detail") if "detail" in have else text}
    names = opened(spark, root, "scan_result").schema.names
    one = hits.select(*(columns.get(n, F.col(n)).alias(n) for n in names)).groupBy("run_date", "code", "period", "kind", "ts").agg(F.max_by(F.struct(*names), F.struct("strength", "price")).alias("v")).select("v.*")
    return opened(spark, root, "scan_result").upsert(one)


def saved_hits(spark: SparkSession, root: str, run_date: str | None = None, limit: int = 500) -> DataFrame:
    """A day's hits by strength; without a day the latest ``limit``."""
    rows = opened(spark, root, "scan_result").read()
    if run_date is not None:
        return rows.where(F.col("run_date") == run_date).orderBy(F.desc("strength"), "code", "period", "kind", "ts")
    return rows.orderBy(F.desc("run_date"), F.desc("strength"), "code", "period", "kind", "ts").limit(limit)


def track(bars: DataFrame, sync: DataFrame, before: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(rows, fingerprints): what changed in each series of ``bars`` since ``before``, and what to keep for the next time.

    bars: (code, period, ts, high, low, close); sync: (code, period, sync_start,
    sync_end); before: (code, period, as_of, items). rows: code, period, status
    (ok, insufficient or error), as_of, prev_as_of, change, item, reason. A
    series that does not suffice, or fails, has one row, and its old fingerprint stays.
    """
    keys = ["code", "period"]
    series = bars.groupBy(*keys).agg(F.count("*").alias("n_bars"), F.min("ts").alias("file_start")).join(sync.select(*keys, "sync_start", "sync_end"), keys, "left")
    judged = scan.sufficiency(series)
    looked = watch.looked(bars.join(judged.where("ok").select(*keys), keys, "left_semi"), mode)
    now = looked.where("error IS NULL").select(*keys, "as_of", "items")
    prev = before.select(*keys, F.col("as_of").alias("prev_as_of"), F.col("items").alias("old"))
    flat = lambda df, is_new: df.select(*keys, F.lit(is_new).alias("is_new"), F.explode("items").alias("x")).select(*keys, "is_new", "x.part", "x.item")
    changes = scan.fingerprint_changes(flat(before.join(now.select(*keys), keys, "left_semi"), False).union(flat(now, True)))
    ok = changes.join(now.select(*keys, "as_of"), keys).join(prev.select(*keys, "prev_as_of"), keys, "left").select(*keys, F.lit("ok").alias("status"), "as_of", "prev_as_of", "change", "item", F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast("string").alias(c) for c in ("as_of", "prev_as_of", "change", "item")]
    short = judged.where("NOT ok").select(*keys, F.lit("insufficient").alias("status"), *none, "reason")
    failed = looked.where("error IS NOT NULL").select(*keys, F.lit("error").alias("status"), *none, F.col("error").alias("reason"))
    return ok.union(short).union(failed), now


def run_track(spark: SparkSession, root: str, bars: DataFrame, sync: DataFrame, mode: str = "strict", keep: bool = True) -> DataFrame:
    """``track`` against the fingerprints that the last run kept, which this run's take the place of."""
    from ridgeline.sources.shared import saved

    to = opened(spark, root, "fingerprint")
    rows, now = track(bars, sync, to.read(), mode)
    rows, now = saved(rows, "track"), saved(now, "fingerprints")  # both before anything is replaced
    if keep:
        to.upsert(now)
    return rows
