"""Scanning a market: which series suffice, how strong their signals are, and what changed since last time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.numbers import round_half_up
from ridgeline.sources.bars import same_series, series_keys

# Least bars and least days of history of a period; weights of kinds, levels, states and nesting; the
# rank of a level where strengths are equal.
LEAST_BARS = {"day": 250, "60": 480, "30": 480, "5": 480, "1": 480}
LEAST_DAYS = {"day": 365, "60": 240, "30": 84, "5": 14, "1": 3}
KIND_WEIGHT = {"b1": 3.0, "s1": 3.0, "b2": 2.0, "s2": 2.0, "b3": 1.5, "s3": 1.5}
LEVEL_WEIGHT = {"day": 2.0, "60": 1.5, "30": 1.5, "15": 1.0, "5": 1.0, "1": 0.8}
STATUS_WEIGHT = {"confirmed": 1.0, "tentative": 0.6, "invalidated": 0.0}
LEVEL_RANK = {"day": 0, "60": 1, "30": 2, "15": 3, "5": 4, "1": 5}


def weight(col, table: dict, other) -> F.Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[col], F.lit(other))


def sufficiency(series: DataFrame) -> DataFrame:
    """series (code, period, n_bars, file_start, sync_start, sync_end) with ok and reason.

    A series needs a sync row, enough bars and enough days; periods without a
    requirement never suffice.
    """
    bars, days = weight(F.col("period"), LEAST_BARS, None), weight(F.col("period"), LEAST_DAYS, None)
    span = F.datediff(F.try_to_date(F.substring("sync_end", 1, 10)), F.try_to_date(F.substring(F.greatest("sync_start", "file_start"), 1, 10)))
    reason = (
        F.when(bars.isNull(), "no requirement for this period").when(F.col("sync_end").isNull(), "never synchronised").when(F.col("n_bars") < bars, "too few bars").when(F.coalesce(span, F.lit(-1)) < days, "history too short")
    )
    return series.select("*", reason.isNull().alias("ok"), reason.alias("reason"))


def segment_strength(segments: DataFrame) -> DataFrame:
    """Each segment against the last one before it that runs the same way: prev area, and how much weaker it is, 0 to 1.

    segments: (code, idx, direction, high, low, src_start, src_end, status, area).
    """
    alive, keys = segments.where("status <> 'invalidated'"), series_keys(segments)
    w = Window.partitionBy(*keys, "direction").orderBy("src_end", "idx")
    prev = lambda c: F.lag(c).over(w)
    df = alive.select("*", prev("area").alias("prev_area"), prev("high").alias("prev_high"), prev("low").alias("prev_low"))
    further = F.when(F.col("direction") == 1, F.col("high") > F.col("prev_high")).otherwise(F.col("low") < F.col("prev_low"))
    share = F.try_divide(F.col("prev_area") - F.col("area"), F.col("prev_area"))
    strength = F.when(F.coalesce(further & (F.col("area") < F.col("prev_area")), F.lit(False)), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return df.select(*keys, "idx", "direction", "src_start", "src_end", "prev_area", strength.alias("divergence"))


def hit_strength(kind, level, status, nested, divergence) -> F.Column:
    nesting = F.when(nested, 1.0).when(~nested, 0.7).otherwise(1.0)
    return weight(kind, KIND_WEIGHT, 1.0) * weight(level, LEVEL_WEIGHT, 1.0) * weight(status, STATUS_WEIGHT, 0.0) * nesting * (1 + F.coalesce(divergence, F.lit(0.0)))


def rank_hits(signals: DataFrame, strengths: DataFrame, limit: int | None = None) -> DataFrame:
    """Signals with their strength, strongest first: -strength, level, ts, code, kind."""
    keys = series_keys(signals, strengths)
    s = strengths.select(*(F.col(k).alias(f"s_{k}") for k in keys), F.col("src_start").alias("s_start"), F.col("src_end").alias("s_end"), "divergence")
    hits = signals.join(s, same_series(signals, s, "s_") & (F.col("src_start") == F.col("s_start")) & (F.col("src_end") == F.col("s_end")), "left")
    hits = hits.withColumn("strength", round_half_up(hit_strength(F.col("kind"), F.col("level"), F.col("status"), F.col("flag"), F.col("divergence")), 6))
    out = in_order(hits.select(*series_keys(signals), "kind", "level", "ts", "price", "status", "strength"))
    return out.limit(limit) if limit is not None else out


def with_strength(table: DataFrame) -> DataFrame:
    """The signals of a long table with their strength: each meets its segment's divergence inside its series, so the table is read once."""
    keys = series_keys(table)
    own = Window.partitionBy(*keys, "layer", "direction").orderBy("src_end", "idx")
    prev = lambda c: F.lag(c).over(own)
    further = F.when(F.col("direction") == 1, F.col("high") > prev("high")).otherwise(F.col("low") < prev("low"))
    share = F.least(F.greatest(F.try_divide(prev("area_now") - F.col("area_now"), prev("area_now")), F.lit(0.0)), F.lit(1.0))
    weaker = F.when(F.coalesce(further & (F.col("area_now") < prev("area_now")), F.lit(False)), share).otherwise(0.0)
    marked = table.where("layer <> 'segment' OR status <> 'invalidated'").withColumn("divergence", F.when(F.col("layer") == "segment", weaker))
    both = marked.withColumn("divergence", F.max("divergence").over(Window.partitionBy(*keys, "src_start", "src_end"))).where("layer = 'signal'")
    strength = round_half_up(hit_strength(F.col("kind"), F.col("level"), F.col("status"), F.col("flag"), F.col("divergence")), 6)
    return both.select(*keys, "kind", "level", "ts", "price", "status", strength.alias("strength"))


def in_order(hits: DataFrame) -> DataFrame:
    """Strongest first: -strength, level, ts, code, period, kind."""
    return hits.orderBy(F.desc("strength"), weight(F.col("level"), LEVEL_RANK, 9), "ts", *series_keys(hits), "kind")


def tasks_of(codes: DataFrame, periods: list[str], by_period: dict[str, list[str]] | None = None) -> DataFrame:
    """code, name, period: every code (code, name) on every period; a period may have codes of its own."""
    by_period = by_period or {}
    every = codes.select("code", F.coalesce("name", F.lit("")).alias("name"), F.explode(F.array(*map(F.lit, periods))).alias("period")).where(~F.col("period").isin(*(by_period or [""])))
    own = codes.sparkSession.createDataFrame([(c.strip(), p) for p, cs in by_period.items() if p in periods for c in cs if c.strip()], "code string, period string").distinct()
    return every.union(own.join(codes.select("code", "name"), "code", "left").select("code", F.coalesce("name", F.lit("")), "period"))


def market_scan(bars: DataFrame, sync: DataFrame, mode: str = "loose", level: str | None = None, tasks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, hits) of every series of ``bars`` (code, period, ts, high, low, close), or of every task (code, name, period).

    sync: (code, period, sync_start, sync_end). Only series with enough history
    are analysed, each on the level of its period. outcomes: code, period, name, outcome (hit, none, insufficient or
    error), reason, n_hits, best strength; hits: code, period, kind, level, ts, price,
    status, strength. The kernel runs once: what it finds is written to the shared folder and read for both.
    """
    from ridgeline.operators.structure import structure
    from ridgeline.sources.shared import saved

    keys = ["code", "period"]
    if tasks is not None:
        bars = bars.join(tasks.select(*keys), keys, "left_semi")
    series = bars.groupBy(*keys).agg(F.count("*").alias("n_bars"), F.min("ts").alias("file_start"))
    wanted = series.withColumn("name", F.lit("")) if tasks is None else tasks.join(series, keys, "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))
    judged = saved(sufficiency(wanted.join(sync.select(*keys, "sync_start", "sync_end"), keys, "left")), "judged")
    table = structure(bars.join(judged.where("ok").select(*keys), keys, "left_semi"), level=level, mode=mode, layers=("signal", "segment"))
    table = saved(table, "scan")
    hits = with_strength(table)
    failed = table.where("layer = 'error'").select(*keys, F.col("text").alias("error"))
    found = hits.groupBy(*keys).agg(F.count("*").alias("n_hits"), F.max("strength").alias("best"))
    out = judged.join(found, keys, "left").join(failed, keys, "left")
    outcome = F.when(~F.col("ok"), "insufficient").when(F.col("error").isNotNull(), "error").when(F.col("n_hits") > 0, "hit").otherwise("none")
    return out.select(*keys, "name", outcome.alias("outcome"), F.coalesce("reason", "error").alias("reason"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "best"), hits


def level_context(signals: DataFrame, trends: DataFrame, pivots: DataFrame) -> DataFrame:
    """The higher trend (the first that holds the signal's bar), else the higher zone.

    Bars are bucketed, so the range join is an equi-join: a span goes to each bucket that it meets.
    """
    size, keys = 64, series_keys(signals, trends, pivots)

    def held(spans: DataFrame, name: str) -> DataFrame:
        spans = spans.select(*(F.col(k).alias(f"h_{k}") for k in keys), F.col("idx").alias("h_idx"), F.col("src_start").alias("h_start"), F.col("src_end").alias("h_end"))
        spans = spans.withColumn("h_bucket", F.explode(F.sequence(F.floor(F.col("h_start") / size), F.floor(F.col("h_end") / size))))
        s = signals.select(*keys, "kind", "src_end").distinct().withColumn("bucket", F.floor(F.col("src_end") / size))
        found = s.join(spans, same_series(s, spans, "h_") & (F.col("bucket") == F.col("h_bucket")) & F.col("src_end").between(F.col("h_start"), F.col("h_end"))).groupBy(*keys, "kind", "src_end").agg(F.min("h_idx").alias(name))
        return found.select(*(F.col(k).alias(f"f_{k}") for k in keys), F.col("kind").alias("f_kind"), F.col("src_end").alias("f_end"), name)

    out = signals
    for spans, name in ((trends, "trend_idx"), (pivots, "pivot_ctx")):
        f = held(spans, name)
        out = out.join(f, same_series(signals, f, "f_") & (F.col("kind") == F.col("f_kind")) & (F.col("src_end") == F.col("f_end")), "left").drop(*(c for c in f.columns if c != name))
    return out.select(*keys, "kind", "src_end", "trend_idx", F.when(F.col("trend_idx").isNull(), F.col("pivot_ctx")).alias("zone_idx"))


def breakout_state(pivots: DataFrame, closes: DataFrame) -> DataFrame:
    """code, state of the last close against the latest zone: up, down, inside or none."""
    keys = series_keys(pivots, closes)
    last = pivots.where("status <> 'invalidated'").groupBy(*keys).agg(F.max_by(F.struct("zg", "zd"), F.struct("src_end", "src_start")).alias("p"))
    state = F.when(F.col("p").isNull(), "none").when(F.col("close") > F.col("p.zg"), "up").when(F.col("close") < F.col("p.zd"), "down").otherwise("inside")
    return closes.join(last, keys, "left").select(*keys, state.alias("state"))


def diff_fingerprints(prev: DataFrame, new: DataFrame) -> DataFrame:
    """``fingerprint_changes`` of two tables (code, part, item)."""
    keys = series_keys(prev, new)
    return fingerprint_changes(prev.select(*keys, F.lit(False).alias("is_new"), "part", "item").union(new.select(*keys, F.lit(True), "part", "item")))


def fingerprint_changes(items: DataFrame) -> DataFrame:
    """What is new in each series: changes (code, change, item), NO_CHANGE and FIRST_SNAPSHOT included.

    items: (code, is_new, part, item) of the earlier and the later fingerprint,
    with part pivot, signal, breakout or divergence. A breakout is any change
    of state. One aggregation by item, one by series; nothing is read twice.
    """
    name = F.when(F.col("part") == "pivot", "NEW_PIVOT").when(F.col("part") == "breakout", "PIVOT_BREAKOUT").when(F.col("part") == "signal", "SIGNAL").otherwise("DIVERGENCE")
    keys = series_keys(items)
    each = items.groupBy(*keys, "part", "item").agg(F.bool_or("is_new").alias("now"), F.bool_or(~F.col("is_new")).alias("before"))
    fresh = F.when(F.col("now") & ~F.col("before"), F.struct(name.alias("change"), "item"))
    by_code = each.groupBy(*keys).agg(F.collect_list(fresh).alias("fresh"), F.bool_or("before").alias("known"), F.bool_or("now").alias("now")).where("now")
    only = lambda what: F.array(F.struct(F.lit(what).alias("change"), F.lit("").alias("item")))
    changes = F.when(~F.col("known"), only("FIRST_SNAPSHOT")).when(F.size("fresh") == 0, only("NO_CHANGE")).otherwise(F.col("fresh"))
    return by_code.select(*keys, F.explode(changes).alias("c")).select(*keys, "c.change", "c.item")


def usable_periods(sync: DataFrame) -> DataFrame:
    """period, median_end, usable: a minute period whose (upper) median end lags the day's is left out."""
    w = Window.partitionBy("period").orderBy("end_ts", "code")
    n = F.count("*").over(Window.partitionBy("period"))
    mid = sync.where("end_ts IS NOT NULL").withColumn("n", F.row_number().over(w) - 1).withColumn("all", n).where("n = floor(all / 2)").select("period", F.substring("end_ts", 1, 10).alias("median_end"))
    day = mid.where("period = 'day'").select(F.col("median_end").alias("day_end"), F.lit(1).alias("one"))
    return mid.withColumn("one", F.lit(1)).join(day, "one", "left").select("period", "median_end", (F.col("period").isin("day", "week", "month") | F.coalesce(F.col("median_end") >= F.col("day_end"), F.lit(True))).alias("usable"))


def scan_notes(notes: DataFrame) -> DataFrame:
    """text, n, first: each note once with its count, in the order of first sight."""
    return notes.groupBy("text").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
