"""Metadata tables: merges by key, lookups, ordered lists, search. Tables are Parquet; a merge is one shuffle by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.clean import upsert


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by key; see ``clean.upsert``."""
    return upsert(old, new, keys)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new rows whose key is new."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row a key: the one with the largest ``by``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("v")).select(*keys, "v.*")


def name_of(codes: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """code, name: the first source that has a name that is not empty."""
    df, names = codes, []
    for i, s in enumerate(sources):
        df = df.join(s.select(F.col("code").alias(f"c{i}"), F.col("name").alias(f"n{i}")), F.col("code") == F.col(f"c{i}"), "left")
        names.append(F.nullif(F.col(f"n{i}"), F.lit("")))
    return df.select("code", F.coalesce(*names, F.lit("")).alias("name"))


def universe_union(listings: DataFrame) -> DataFrame:
    """code, name, days over all listings (code, name, day): the last name that is not empty wins."""
    named = F.when(F.trim("name") != "", F.col("day"))
    return listings.groupBy("code").agg(F.coalesce(F.max_by("name", named), F.lit("")).alias("name"), F.min("day").alias("first_day"), F.count("*").alias("days"))


def ordered_watchlist(rows: DataFrame) -> DataFrame:
    """code, place: by sort_order (nulls last), then added_at, then code."""
    w = Window.orderBy(F.col("sort_order").asc_nulls_last(), "added_at", "code")  # a user's list: small by nature
    return rows.select("code", F.row_number().over(w).alias("place"))


def move_watch(rows: DataFrame, code: str, by: int) -> DataFrame:
    """The list with ``code`` swapped with its neighbour (by -1 or 1), renumbered."""
    places = ordered_watchlist(rows)
    here = places.where(F.col("code") == code).select(F.col("place").alias("here"), F.lit(1).alias("one"))
    span = places.agg(F.max("place").alias("last"), F.lit(1).alias("one"))
    there = F.least(F.greatest(F.col("here") + by, F.lit(1)), F.col("last"))
    p = F.col("place")
    return places.withColumn("one", F.lit(1)).join(span.drop("one").withColumn("one", F.lit(1)), "one").join(here, "one", "left").select("code", F.when(p == F.col("here"), there).when(p == there, F.col("here")).otherwise(p).alias("place"))


def search(names: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """code, name, rank: codes that start with the text before names that hold it."""
    t = text.strip().lower()
    rank = F.when(F.col("code").startswith(t), 0).when(F.instr(F.lower("name"), t) > 0, 1)
    return names.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "code").limit(limit).select("code", "name", "rank")


def list_diff(listed: DataFrame, live: DataFrame) -> DataFrame:
    """code, change: what a live list adds to, or misses of, a static one."""
    return live.select("code").join(listed.select("code"), "code", "left_anti").select("code", F.lit("added").alias("change")).union(listed.select("code").join(live.select("code"), "code", "left_anti").select("code", F.lit("removed").alias("change")))


def scope_union(parts: list[DataFrame]) -> DataFrame:
    """code, pos of several lists one after another, each code once, where it comes first. parts: (code, pos)."""
    df = None
    for i, p in enumerate(parts):
        one = p.select("code", (F.lit(i * 10**9) + F.col("pos")).alias("pos"))
        df = one if df is None else df.union(one)
    return df.groupBy("code").agg(F.min("pos").alias("pos"))


def factor_fingerprint(ladder: DataFrame) -> DataFrame:
    """code, n, last_ts, last_k: changes exactly when a ladder does."""
    return ladder.groupBy("code").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.max_by("k", "ts").alias("last_k"))
