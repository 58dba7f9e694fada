"""Small lookups of a market: extremes of DIF, freshness, fallbacks, routes, calendars and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import codes

# Where a market's bars come from; the markets and periods that one vendor alone has minutes for.
SOURCES = {"sh": "baostock", "sz": "baostock", "bj": "baostock", "hk": "tencent", "us": "sina", "sw": "sw"}
MINUTE_VENDOR, MINUTES = "pytdx", ("1", "5", "15", "30", "60")


def dif_extremes(spans: DataFrame, lines: DataFrame, size: int = 64) -> DataFrame:
    """code, idx, dif_high, high_at, dif_low, low_at, dif_extreme: DIF's highest and lowest of each span, first places first.

    spans: (code, idx, direction, src_start, src_end); lines: (code, i, dif).
    The extreme is the high of a rising span and the low of a falling one.
    Bars meet spans by buckets, so the range join is an equi-join.
    """
    s = spans.select("code", "idx", "direction", "src_start", "src_end", F.explode(F.sequence(F.floor(F.col("src_start") / size), F.floor(F.col("src_end") / size))).alias("bucket"))
    b = lines.select(F.col("code").alias("l_code"), "i", "dif", F.floor(F.col("i") / size).alias("l_bucket"))
    met = s.join(b, (F.col("code") == F.col("l_code")) & (F.col("bucket") == F.col("l_bucket")) & F.col("i").between(F.col("src_start"), F.col("src_end")))
    top, low = F.max(F.struct("dif", -F.col("i"))), F.min(F.struct("dif", "i"))
    out = met.groupBy("code", "idx", "direction").agg(top.alias("t"), low.alias("l"))
    return out.select("code", "idx", F.col("t.dif").alias("dif_high"), (-F.col("t.col2")).alias("high_at"), F.col("l.dif").alias("dif_low"), F.col("l.i").alias("low_at"), F.when(F.col("direction") == 1, F.col("t.dif")).otherwise(F.col("l.dif")).alias("dif_extreme"))


def newest_per_market(last: DataFrame) -> DataFrame:
    """market, newest, n: how fresh the stored series (code, last_ts) of each market are."""
    return last.groupBy(codes.market_of(F.col("code")).alias("market")).agg(F.max("last_ts").alias("newest"), F.count("*").alias("n"))


def first_hit(wanted: DataFrame, stored: DataFrame, prefixes: tuple[str, ...] = ("", "sh.", "sz.")) -> DataFrame:
    """code, found: the first of code, sh.code, sz.code that ``stored`` (code) holds, or null."""
    tries = F.array(*(F.struct(F.lit(i).alias("rank"), F.concat(F.lit(p), F.col("code")).alias("key")) for i, p in enumerate(prefixes)))
    each = wanted.select("code", F.explode(tries).alias("t")).select("code", "t.rank", "t.key")
    there = stored.select(F.col("code").alias("s_code")).distinct()
    return each.join(there, F.col("key") == F.col("s_code"), "left").groupBy("code").agg(F.min_by("s_code", F.when(F.col("s_code").isNotNull(), F.col("rank"))).alias("found"))


def with_dims(tasks: DataFrame, universe: DataFrame, sync: DataFrame) -> DataFrame:
    """tasks (code, period) with name, sync_start and sync_end where they are known; a code's name is unique."""
    u = universe.select(F.col("code").alias("u_code"), "name")
    s = sync.select(F.col("code").alias("s_code"), F.col("period").alias("s_period"), "sync_start", "sync_end")
    on = (F.col("code") == F.col("s_code")) & (F.col("period") == F.col("s_period"))
    return tasks.join(u, F.col("code") == F.col("u_code"), "left").join(s, on, "left").select("code", "period", F.coalesce("name", F.lit("")).alias("name"), "sync_start", "sync_end")


def scan_results(saved: DataFrame, date: str | None = None, limit: int = 500) -> DataFrame:
    """Saved hits (id, scan_date, code, strength): those of a date, strongest first; without one the latest."""
    if date is not None:
        return saved.where(F.col("scan_date") == date).orderBy(F.desc("strength"), "id")
    return saved.orderBy(F.desc("id")).limit(limit)


def source_route(code, period) -> F.Column:
    """The source of a key's bars: one vendor has one-minute bars of sh and sz, and minutes of their indexes."""
    market = codes.market_of(code)
    mainland = market.isin("sh", "sz")
    alone = mainland & ((period == "1") | (period.isin(*MINUTES) & codes.is_index(code)))
    return F.when(alone, F.lit(MINUTE_VENDOR)).otherwise(codes.lookup(market, SOURCES))


# What stands before a vendor's symbol; which periods each source has; how many bars a source gives at most.
BOARD_PREFIX = "pt01"
DAYS_AND_MORE, SHORT = ("day", "week", "month"), ("60", "30", "15", "5")
NASDAQ_CAP = 1023


def vendor_symbol(code) -> F.Column:
    """A key as its source writes it: sh.600000, hkHSI, .DJI, AAPL, pt01801120."""
    market, digits = codes.market_of(code), codes.bare(code)
    us = F.when(codes.is_index(code), F.concat(F.lit("."), F.upper(digits))).otherwise(F.upper(digits))
    return F.when(market == "hk", F.concat(F.lit("hk"), F.upper(digits))).when(market == "us", us).when(market == "sw", F.concat(F.lit(BOARD_PREFIX), digits)).otherwise(F.concat(market, F.lit("."), digits))


def fallback_source(code, period) -> F.Column:
    """Where to ask when the first source has no row: only minutes of mainland indexes have a second one, and not those of one minute."""
    return F.when(codes.market_of(code).isin("sh", "sz") & codes.is_index(code) & period.isin(*SHORT), F.lit("eastmoney"))


def capability(code, period) -> F.Column:
    """(source, supported, reason, depth_cap): can this period of this key be had, why not, and how many bars at most."""
    market, source = codes.market_of(code), source_route(code, period)
    minutes = period.isin(*SHORT)
    why = (
        F.when(period.isin(*DAYS_AND_MORE) | (source == MINUTE_VENDOR), None)
        .when(market == "sw", "industry boards have no source of minutes: weeks and months come from days")
        .when(market == "hk", "no source has minutes of this market with a history")
        .when((market == "us") & ~minutes, F.concat(F.lit("this market has no period "), period))
        .when((market == "us") | minutes, None)
        .when(period == "1", "the source has 60, 30, 15 and 5 minutes, not one")
        .otherwise(F.concat(F.lit("no source has the period "), period))
    )
    return F.struct(source.alias("source"), why.isNull().alias("supported"), why.alias("reason"), F.when((market == "us") & minutes, NASDAQ_CAP).alias("depth_cap"))


def weekday_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """day, source: every Monday to Friday, for markets without a calendar of their own."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.where(F.weekday("day") < 5).select("day", F.lit("weekday").alias("source"))


def trading_calendar(stored: DataFrame, start: str, end: str) -> DataFrame:
    """The stored days (day) of a span with source ``cache``; weekdays if the span has none. No job runs before the result is asked for."""
    own = stored.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("day").distinct().select("day", F.lit("cache").alias("source"))
    none = own.agg(F.count("*").alias("n")).where("n = 0")
    return own.union(weekday_calendar(stored.sparkSession, start, end).join(none, F.col("n") == 0).select("day", "source"))


def covered_calendar(stored: DataFrame, start: str, end: str) -> DataFrame:
    """The stored days of a span, gaps and all, from the first to the last stored day; weekdays outside, where the store says nothing."""
    days = stored.select("day").distinct()
    edges = days.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    outside = weekday_calendar(stored.sparkSession, start, end).join(edges, F.col("a").isNull() | (F.col("day") < F.col("a")) | (F.col("day") > F.col("z"))).select("day", "source")
    return days.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("day", F.lit("cache").alias("source")).union(outside)


def remove_watch(rows: DataFrame, code: str) -> DataFrame:
    return rows.where(F.col("code") != code)


def add_watch(rows: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """rows (code, name, sort_order, added_at) with those of ``new`` (code, name, pos, added_at) that it lacks behind all others.

    Rows that are there keep their place; ``replace`` starts from nothing.
    """
    old = rows.limit(0) if replace else rows
    last = old.agg(F.coalesce(F.max("sort_order"), F.lit(-1)).alias("last"))
    fresh = new.join(old.select("code"), "code", "left_anti").dropDuplicates(["code"])
    n = F.row_number().over(Window.orderBy("pos", "code"))  # a user's list: small by nature
    return old.select("code", "name", "sort_order", "added_at").union(fresh.withColumn("one", F.lit(1)).join(last.withColumn("one", F.lit(1)), "one").select("code", "name", (F.col("last") + n).cast("int"), "added_at"))
