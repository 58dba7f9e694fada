"""Structure of series: folds, segments and zones, divergences and signals, and their life in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions.numbers import round_half_up as r
from ridgeline.operators import pit, scan, structure, watch
from ridgeline.operators.structure import layer
from ridgeline.plans import structure_sql as sq
from ridgeline.plans.sql import F as FR, M, S, fold, rnd
from ridgeline.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def walk(spark, d):
    return src.order_walk_bars(spark, d)


def table(spark, d, *layers, mode="strict"):
    return structure.structure(walk(spark, d), mode=mode, layers=layers or None)


def longs(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query(fold("wb", M) + " SELECT m.code, idx, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, src_start, src_end, b.ts FROM m JOIN b ON b.code = m.code AND b.i = m.src_end")
def include_merge(spark, d):
    return longs(table(spark, d, "merged").select("code", "idx", "high", "low", "src_start", "src_end", "ts"), "idx", "src_start", "src_end")


@query(fold("wb", M, FR) + " SELECT f.code, f.idx, if(top, 'top', 'bottom') AS kind, CAST(price AS DOUBLE) AS price, midx, f.src AS src, b.ts, k.ts AS confirmed_at FROM f JOIN b ON b.code = f.code AND b.i = f.src JOIN b AS k ON k.code = f.code AND k.i = f.known")
def fractals(spark, d):
    t = table(spark, d, "fractal").select("code", "idx", "kind", "price", F.col("start_idx").alias("midx"), F.col("src_start").alias("src"), "ts", "confirmed_at")
    return longs(t, "idx", "midx", "src")


@query(fold("eb", M) + " SELECT code, count(*) AS n, CAST(max(high) AS DOUBLE) AS top, CAST(min(low) AS DOUBLE) AS bottom FROM m GROUP BY code")
def include_merge_hourly(spark, d):
    t = structure.structure(src.event_bars(spark, d), level="60", layers=("merged",))
    return t.groupBy("code").agg(F.count("*").alias("n"), F.max("high").alias("top"), F.min("low").alias("bottom"))


STROKES = fold("wb", M, FR, S) + """, k AS (SELECT code, k AS idx, if(top, -1, 1) AS direction, price, midx, src, lead(price) OVER w AS price2, lead(midx) OVER w AS midx2, lead(src) OVER w AS src2, lead(known, 2) OVER w AS known FROM pt WINDOW w AS (PARTITION BY code ORDER BY k))"""


@query(STROKES + """ SELECT k.code, k.idx, direction, CAST(greatest(price, price2) AS DOUBLE) AS high, CAST(least(price, price2) AS DOUBLE) AS low, midx AS start_idx, midx2 AS end_idx, src AS src_start, src2 AS src_end,
  if(known IS NULL, 'tentative', 'confirmed') AS status, b.ts AS confirmed_at FROM k LEFT JOIN b ON b.code = k.code AND b.i = k.known WHERE price2 IS NOT NULL""")
def strokes(spark, d):
    t = table(spark, d, "stroke").select("code", "idx", "direction", "high", "low", "start_idx", "end_idx", "src_start", "src_end", "status", "confirmed_at")
    return longs(t, "idx", "start_idx", "end_idx", "src_start", "src_end")


@query(sq.base() + f""" SELECT code, idx, d AS direction, CAST(h AS DOUBLE) AS high, CAST(l AS DOUBLE) AS low, a AS start_idx, z AS end_idx, src_start, src_end, {sq.at('sg', 'src_start')} AS ts, {sq.at('sg', 'src_end')} AS end_ts, status, {sq.at('sg', 'known')} AS confirmed_at FROM sg""")
def segments(spark, d):
    t = table(spark, d, "segment").select("code", "idx", "direction", "high", "low", "start_idx", "end_idx", "src_start", "src_end", "ts", "end_ts", "status", "confirmed_at")
    return longs(t, "idx", "direction", "start_idx", "end_idx", "src_start", "src_end")


@query(sq.base(sq.pivots("p0", "sg")) + f""" SELECT code, idx, CAST(zg AS DOUBLE) AS zg, CAST(zd AS DOUBLE) AS zd, CAST(gg AS DOUBLE) AS gg, CAST(dd AS DOUBLE) AS dd, start_idx, end_idx, src_start, src_end, status, {sq.at('p0', 'known')} AS confirmed_at, capped FROM p0""")
def pivots(spark, d):
    t = layer(table(spark, d, "pivot"), "pivot").where("depth = 0").select("code", "idx", "zg", "zd", F.col("high").alias("gg"), F.col("low").alias("dd"), "start_idx", "end_idx", "src_start", "src_end", "status", "confirmed_at", F.col("flag").alias("capped"))
    return longs(t, "idx", "start_idx", "end_idx", "src_start", "src_end")


@query(sq.base(sq.LEVEL0) + f""" SELECT code, idx, CASE d WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'consolidation' END AS kind, d AS direction, CAST(h AS DOUBLE) AS high, CAST(l AS DOUBLE) AS low, start_idx, end_idx, src_start, src_end, status, {sq.at('t0', 'known')} AS confirmed_at FROM t0""")
def trends(spark, d):
    t = table(spark, d, "trend").where("depth = 0").select("code", "idx", "kind", "direction", "high", "low", "start_idx", "end_idx", "src_start", "src_end", "status", "confirmed_at")
    return longs(t, "idx", "direction", "start_idx", "end_idx", "src_start", "src_end")


@query(sq.base(sq.LEVEL0, sq.LEVEL1, sq.LEVEL2) + """ SELECT code, depth, level, CAST(sum(p) AS BIGINT) AS n_pivots, CAST(sum(t) AS BIGINT) AS n_trends FROM (
  SELECT code, 0 AS depth, 'day' AS level, 1 AS p, 0 AS t FROM p0 UNION ALL SELECT code, 0, 'day', 0, 1 FROM t0 UNION ALL SELECT code, 1, 'week', 1, 0 FROM p1 UNION ALL SELECT code, 1, 'week', 0, 1 FROM t1
  UNION ALL SELECT code, 2, 'month', 1, 0 FROM p2 UNION ALL SELECT code, 2, 'month', 0, 1 FROM t2) GROUP BY code, depth, level""")
def levels(spark, d):
    t = table(spark, d, "pivot", "trend")
    return longs(t, "depth").groupBy("code", "depth", "level").agg(F.count_if(F.col("layer") == "pivot").alias("n_pivots"), F.count_if(F.col("layer") == "trend").alias("n_trends"))


@query(sq.base(sq.MACD) + f""" SELECT sg.code, sg.idx, {rnd('sum(greatest(hist * d, 0))', 2)} AS area FROM sg JOIN hist ON hist.code = sg.code AND hist.i BETWEEN src_start AND src_end GROUP BY sg.code, sg.idx""")
def hist_area(spark, d):
    """MACD area of every segment in its own colour: a range join by buckets of bars."""
    from ridgeline.operators.indicators import ema_macd
    from pyspark.sql import Window

    seg = table(spark, d, "segment")
    hist = ema_macd(walk(spark, d)).withColumn("i", F.row_number().over(Window.partitionBy("code").orderBy("ts")) - 1)
    size = 64
    s = seg.select("code", "idx", "direction", "src_start", "src_end", F.explode(F.sequence(F.floor(F.col("src_start") / size), F.floor(F.col("src_end") / size))).alias("bucket"))
    h = hist.select(F.col("code").alias("h_code"), "i", "hist", F.floor(F.col("i") / size).alias("h_bucket"))
    j = s.join(h, (F.col("code") == F.col("h_code")) & (F.col("bucket") == F.col("h_bucket")) & F.col("i").between(F.col("src_start"), F.col("src_end")))
    return longs(j, "idx").groupBy("code", "idx").agg(r(F.sum(F.greatest(F.col("hist") * F.col("direction"), F.lit(0.0))), 2).alias("area"))


@query(sq.base(sq.MACD, "df AS (SELECT code, i, f - s AS dif FROM e1)") + f""" SELECT code, idx, {rnd('hi.dif', 2)} AS dif_high, hi.i AS high_at, {rnd('lo.dif', 2)} AS dif_low, lo.i AS low_at, {rnd('if(d = 1, hi.dif, lo.dif)', 2)} AS dif_extreme
  FROM (SELECT sg.code, sg.idx, any_value(d) AS d, arg_max({{'dif': dif, 'i': i}}, {{'a': dif, 'b': -i}}) AS hi, arg_min({{'dif': dif, 'i': i}}, {{'a': dif, 'b': i}}) AS lo FROM sg JOIN df ON df.code = sg.code AND df.i BETWEEN src_start AND src_end GROUP BY sg.code, sg.idx)""")
def dif_extremes(spark, d):
    """DIF's highest and lowest in every segment, and where."""
    from ridgeline.operators import lookups
    from ridgeline.operators.indicators import ema_macd
    from pyspark.sql import Window

    lines = ema_macd(walk(spark, d)).withColumn("i", F.row_number().over(Window.partitionBy("code").orderBy("ts")) - 1)
    got = lookups.dif_extremes(table(spark, d, "segment"), lines)
    return longs(got, "idx", "high_at", "low_at").withColumns({c: r(F.col(c), 2) for c in ("dif_high", "dif_low", "dif_extreme")})


@query(sq.base(sq.LEVEL0, sq.DIVERGE) + f""" SELECT code, idx, d AS direction, {sq.at('d0', 'src')} AS ts, CAST(price AS DOUBLE) AS price, ref AS start_idx, seg AS end_idx, {rnd('now', 2)} AS area_now, {rnd('prev', 2)} AS area_prev, further AS new_extreme, status, {sq.at('d0', 'known')} AS confirmed_at FROM d0 WHERE kind = 'consolidation'""")
def divergence_consolidation(spark, d):
    return longs(table(spark, d, "divergence"), "idx", "direction", "start_idx", "end_idx").where("kind = 'consolidation'").select("code", "idx", "direction", "ts", "price", "start_idx", "end_idx", r(F.col("area_now"), 2).alias("area_now"), r(F.col("area_prev"), 2).alias("area_prev"), F.col("flag").alias("new_extreme"), "status", "confirmed_at")


@query(sq.base(sq.LEVEL0, sq.DIVERGE) + f""" SELECT code, idx, d AS direction, {sq.at('d0', 'src')} AS ts, CAST(price AS DOUBLE) AS price, ref AS start_idx, seg AS end_idx, status, {sq.at('d0', 'known')} AS confirmed_at FROM d0 WHERE kind = 'trend'""")
def divergence_trend(spark, d):
    return longs(table(spark, d, "divergence"), "idx", "direction", "start_idx", "end_idx").where("kind = 'trend'").select("code", "idx", "direction", "ts", "price", "start_idx", "end_idx", "status", "confirmed_at")



SIGNALS = {loose: sq.base(sq.LEVEL0, sq.LEVEL1, sq.DIVERGE, sq.DIVERGE1, sq.signals("sig", loose)) for loose in (False, True)}
SIGNAL_ROWS = f""" SELECT code, idx, kind, {sq.at('sig', 'src')} AS ts, CAST(price AS DOUBLE) AS price, zone AS pivot_idx, src_start, src_end, status, {sq.at('sig', 'known')} AS confirmed_at, nested AS quantao FROM sig"""


@query(SIGNALS[False] + SIGNAL_ROWS)
def signals_strict(spark, d):
    return longs(table(spark, d, "signal"), "idx", "start_idx", "src_start", "src_end").select("code", "idx", "kind", "ts", "price", F.col("start_idx").alias("pivot_idx"), "src_start", "src_end", "status", "confirmed_at", F.col("flag").alias("quantao"))


@query(SIGNALS[True] + SIGNAL_ROWS)
def signals_loose(spark, d):
    return longs(table(spark, d, "signal", mode="loose"), "idx", "start_idx", "src_start", "src_end").select("code", "idx", "kind", "ts", "price", F.col("start_idx").alias("pivot_idx"), "src_start", "src_end", "status", "confirmed_at", F.col("flag").alias("quantao"))


@query(SIGNALS[False] + f" SELECT code, kind, {sq.at('sig', 'src')} AS ts, nested AS quantao FROM sig WHERE kind IN ('b1', 's1')")
def quantao(spark, d):
    return table(spark, d, "signal").where("kind IN ('b1', 's1')").select("code", "kind", "ts", F.col("flag").alias("quantao"))


K = "strokes_k AS (SELECT k.code, CAST(src AS VARCHAR) || '-' || CAST(src2 AS VARCHAR) AS id, if(known IS NULL, 'tentative', 'confirmed') AS status, b.ts AS confirmed_at, src, src2 FROM k LEFT JOIN b ON b.code = k.code AND b.i = k.known WHERE price2 IS NOT NULL)"


@query(STROKES + ", " + K + """, prev AS (SELECT code, id, if(src % 3 = 0, 'confirmed', status) AS status, if(src % 3 = 0, '1990-01-01', confirmed_at) AS confirmed_at FROM strokes_k WHERE src % 5 > 0
   UNION ALL SELECT code, 'x' || id, 'confirmed', '1990-01-02' FROM strokes_k WHERE src % 7 = 0),
  new AS (SELECT * FROM strokes_k)
  SELECT coalesce(n.code, p.code) AS code, coalesce(n.id, p.id) AS id, CASE WHEN n.id IS NULL THEN 'invalidated' WHEN p.status = 'confirmed' THEN 'confirmed' ELSE n.status END AS status,
    CASE WHEN n.id IS NULL OR p.status = 'confirmed' THEN p.confirmed_at WHEN n.status = 'confirmed' THEN coalesce(n.confirmed_at, '2000-01-01') ELSE n.confirmed_at END AS confirmed_at
  FROM new n FULL JOIN prev p ON p.code = n.code AND p.id = n.id""")
def reconcile(spark, d):
    new = table(spark, d, "stroke").select("code", F.concat_ws("-", "src_start", "src_end").alias("id"), "status", "confirmed_at", F.col("src_start").alias("s"))
    third = F.col("s") % 3 == 0
    prev = new.where("s % 5 > 0").select("code", "id", F.when(third, "confirmed").otherwise(F.col("status")).alias("status"), F.when(third, "1990-01-01").otherwise(F.col("confirmed_at")).alias("confirmed_at"))
    prev = prev.union(new.where("s % 7 = 0").select("code", F.concat(F.lit("x"), "id"), F.lit("confirmed"), F.lit("1990-01-02")))
    return pit.reconcile(prev, new, ["code", "id"], "2000-01-01")


def _prefixes(step: int) -> str:
    """Signals of every prefix of ``step`` bars, and of the whole: each prefix is a series of its own."""
    cut = f"""wn AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts) AS i, count(*) OVER (PARTITION BY code) AS n FROM wb),
wc AS (SELECT x.code || '@' || y.ts AS code, x.ts, x.high, x.low, x.close FROM wn AS x JOIN wn AS y ON y.code = x.code AND y.i >= x.i AND (y.i % {step} = 0 OR y.i = y.n)),
"""
    return SIGNALS[True].replace("b AS (SELECT code, ts", cut + "b AS (SELECT code, ts", 1).replace("FROM wb),\nm0", "FROM wc),\nm0", 1)


@query(_prefixes(100) + """, sn AS (SELECT DISTINCT split_part(code, '@', 1) AS code, split_part(code, '@', 2) AS checkpoint, kind, src_start, src_end, idx FROM sig),
  mk AS (SELECT code, checkpoint, lead(checkpoint) OVER (PARTITION BY code ORDER BY checkpoint) AS after FROM (SELECT DISTINCT split_part(code, '@', 1) AS code, split_part(code, '@', 2) AS checkpoint FROM wc)),
  lf AS (SELECT code, kind, src_start, src_end, min(checkpoint) AS first_seen, max(checkpoint) AS last_seen, count(*) AS times FROM sn GROUP BY 1, 2, 3, 4)
  SELECT lf.code, kind, src_start, src_end, first_seen, last_seen, times, after IS NULL AS alive, after AS falsified_at FROM lf JOIN mk ON mk.code = lf.code AND mk.checkpoint = last_seen""")
def signal_trail(spark, d):
    b = walk(spark, d)
    seen = structure.checkpoints(b, 100, mode="loose")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("code").orderBy("ts"))
    last = F.count("*").over(Window.partitionBy("code"))
    marks = b.select("code", "ts", n.alias("n"), last.alias("last")).where("n % 100 = 0 OR n = last").select("code", F.col("ts").alias("checkpoint"))
    return structure.trail(longs(seen, "src_start", "src_end"), marks)


@query()
def first_visible_signals(spark, d):
    """The bar that first shows each signal, confirmed or not; what a series' first bar shows is old."""
    b = walk(spark, d)
    return pit.first_visible(structure.showings(b, mode="loose"), b, ["code", "kind", "ts", "price"])


@query(STROKES + """ SELECT k.code, k.idx, b.ts AS confirmed_at FROM k JOIN b ON b.code = k.code AND b.i = k.known WHERE price2 IS NOT NULL AND b.ts <= '1995-06-30'""")
def pit_filter(spark, d):
    return longs(pit.backtestable(table(spark, d, "stroke"), "1995-06-30").select("code", "idx", "confirmed_at"), "idx")


@query(fold("wb", M, FR) + " SELECT f.code, f.idx, k.ts AS known_at FROM f JOIN b AS k ON k.code = f.code AND k.i = f.known WHERE k.ts <= '1995-06-30'")
def confirmed_fractals(spark, d):
    t = table(spark, d, "merged", "fractal")
    known = pit.confirmed_fractals(layer(t, "fractal").withColumn("confirmed_at", F.lit(None).cast("string")), layer(t, "merged"), "1995-06-30")
    return longs(known.select("code", "idx", "known_at"), "idx")


@query(STROKES + ", " + """o AS (SELECT 'stroke' AS layer, k.code, k.idx, x.ts AS a, y.ts AS z FROM k JOIN b x ON x.code = k.code AND x.i = k.src JOIN b y ON y.code = k.code AND y.i = k.src2 WHERE price2 IS NOT NULL
   UNION ALL SELECT 'fractal', f.code, f.idx, b.ts, b.ts FROM f JOIN b ON b.code = f.code AND b.i = f.src)
  SELECT code, layer, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM o WHERE (layer = 'stroke' AND z >= '1995-01-01' AND a <= '1995-12-31') OR (layer = 'fractal' AND a BETWEEN '1995-01-01' AND '1995-12-31') GROUP BY code, layer""")
def window_clip(spark, d):
    t = structure.clip(table(spark, d, "stroke", "fractal"), "1995-01-01", "1995-12-31")
    return longs(t.groupBy("code", "layer").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")), "first_idx", "last_idx")


@query(STROKES + """, o AS (SELECT code, 'fractal' AS layer, 'confirmed' AS status FROM f UNION ALL SELECT code, 'stroke', if(known IS NULL, 'tentative', 'confirmed') FROM k WHERE price2 IS NOT NULL)
  SELECT code, layer, count(*) AS n, count(*) FILTER (status = 'confirmed') AS n_confirmed, count(*) FILTER (status = 'tentative') AS n_tentative FROM o GROUP BY code, layer""")
def snapshot_counts(spark, d):
    return pit.snapshot_counts(table(spark, d, "fractal", "stroke")).drop("period")


@query()
def snapshot_json(spark, d):
    return pit.snapshot_json(table(spark, d)).drop("period")


STRENGTH = f""", gs AS (SELECT code, src_start, src_end, CASE WHEN if(d = 1, h > ph, l < pl) AND area < pa THEN least(greatest((pa - area) / pa, 0), 1) ELSE 0 END AS div FROM (
    SELECT *, lag(area) OVER w AS pa, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM d0a WINDOW w AS (PARTITION BY code, d ORDER BY src_end, idx))),
  gh AS (SELECT sig.code, kind, 'day' AS level, {sq.at('sig', 'src')} AS ts, CAST(price AS DOUBLE) AS price, status, CASE WHEN kind IN ('b1', 's1') THEN 3e0 WHEN kind IN ('b2', 's2') THEN 2e0 WHEN kind IN ('b3', 's3') THEN 1.5e0 ELSE 1e0 END * 2e0
    * CASE status WHEN 'confirmed' THEN 1e0 ELSE 0.6e0 END * CASE WHEN nested = false THEN 0.7e0 ELSE 1e0 END * (1 + coalesce(gs.div, 0)) AS raw FROM sig LEFT JOIN gs ON gs.code = sig.code AND gs.src_start = sig.src_start AND gs.src_end = sig.src_end)"""


@query(SIGNALS[True] + STRENGTH + f""" SELECT code, kind, level, ts, price, status, {rnd('raw', 6)} AS strength FROM gh ORDER BY strength DESC, level, ts, code, kind LIMIT 50""")
def scan_strength_topk(spark, d):
    """One kernel pass: segments carry their areas, so signals and strengths come from one table."""
    t = structure.structure(walk(spark, d), mode="loose", layers=("signal", "segment"))
    return scan.in_order(scan.with_strength(t)).limit(50).drop("period")


@query(SIGNALS[True] + STRENGTH + f""", sn AS (SELECT code, count(*) AS n, min(ts) AS a, max(ts) AS z FROM b GROUP BY code)
  SELECT sn.code, 'day' AS period, CASE WHEN sn.code[1] IN ('1', '2', '3') THEN 'insufficient' WHEN count(gh.code) > 0 THEN 'hit' ELSE 'none' END AS outcome,
    CASE sn.code[1] WHEN '1' THEN 'never synchronised' WHEN '2' THEN 'history too short' WHEN '3' THEN 'history too short' END AS reason, count(gh.code) FILTER (sn.code[1] > '3') AS n_hits, {rnd('max(raw) FILTER (sn.code[1] > chr(51))', 6)} AS best
  FROM sn LEFT JOIN gh ON gh.code = sn.code GROUP BY sn.code""")
def market_scan(spark, d):
    """The scan as a job: one series was never synchronised, one has a malformed date, one is too short; the others are analysed."""
    b = walk(spark, d).withColumn("period", F.lit("day"))
    first = F.substring("code", 1, 1)
    sync = b.groupBy("code", "period").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).where(first != "1").select("code", "period", F.when(first == "2", F.lit("19x")).when(first == "3", F.date_sub(F.to_date("z"), 100).cast("string")).otherwise(F.col("a")).alias("sync_start"), F.col("z").alias("sync_end"))
    return scan.market_scan(b, sync)[0].drop("name")


@query(SIGNALS[True] + STRENGTH + f""", sn AS (SELECT code, count(*) AS n FROM b GROUP BY code), tk AS (SELECT code, unnest(['day', '30']) AS period FROM (SELECT code FROM sn UNION ALL SELECT 'none'))
  SELECT tk.code, tk.period, CASE WHEN NOT coalesce(enough, false) THEN 'insufficient' WHEN count(gh.code) > 0 THEN 'hit' ELSE 'none' END AS outcome, CASE WHEN enough THEN count(gh.code) ELSE 0 END AS n_hits
  FROM (SELECT tk.*, if(tk.period = '30', tk.code[1] = '1' AND n >= 480, tk.code[1] > '1' AND n >= 250) AS enough FROM tk LEFT JOIN sn ON sn.code = tk.code) AS tk LEFT JOIN gh ON gh.code = tk.code GROUP BY tk.code, tk.period, enough""")
def scan_tasks(spark, d):
    """The scan by periods and codes: each code of a list on two periods, one of which has the bars; a code without bars is a row too. Hits are kept and read back."""
    from ridgeline.operators import persist
    from ridgeline.sources.shared import shared_folder

    root = shared_folder(spark, "hits")
    own = F.substring("code", 1, 1) == "1"
    b = walk(spark, d).withColumn("period", F.when(own, "30").otherwise("day"))
    codes = b.select("code").distinct().union(spark.createDataFrame([("none",)], "code string")).withColumn("name", F.lit(""))
    sync = b.groupBy("code", "period").agg(F.min("ts").alias("sync_start"), F.max("ts").alias("sync_end"))
    outcomes, hits = scan.market_scan(b, sync, tasks=scan.tasks_of(codes, ["day", "30"]))
    persist.save_hits(spark, root, hits, "2026-01-01")
    kept = persist.saved_hits(spark, root, "2026-01-01").groupBy("code", "period").agg(F.count("*").alias("kept"))
    told = outcomes.join(kept, ["code", "period"], "left")
    return told.select("code", "period", F.when((F.col("outcome") == "hit") & F.col("kept").isNull(), "lost").otherwise(F.col("outcome")).alias("outcome"), "n_hits")


@query(SIGNALS[True] + """, se AS (SELECT code, kind, src_end FROM sig) SELECT se.code, se.kind, se.src_end, x.t AS trend_idx, CASE WHEN x.t IS NULL THEN y.p END AS zone_idx FROM se
  LEFT JOIN (SELECT s.code, s.src_end, min(t1.idx) AS t FROM (SELECT DISTINCT code, src_end FROM se) AS s JOIN t1 ON t1.code = s.code AND s.src_end BETWEEN t1.src_start AND t1.src_end GROUP BY 1, 2) AS x ON x.code = se.code AND x.src_end = se.src_end
  LEFT JOIN (SELECT s.code, s.src_end, min(p0.idx) AS p FROM (SELECT DISTINCT code, src_end FROM se) AS s JOIN p0 ON p0.code = s.code AND s.src_end BETWEEN p0.src_start AND p0.src_end GROUP BY 1, 2) AS y ON y.code = se.code AND y.src_end = se.src_end""")
def level_context(spark, d):
    from ridgeline.sources.shared import saved

    t = saved(structure.structure(walk(spark, d), mode="loose", layers=("signal", "trend", "pivot")), "layers")  # one kernel pass for three readers
    return scan.level_context(longs(layer(t, "signal"), "src_end"), longs(layer(t, "trend"), "idx").where("depth = 1"), longs(layer(t, "pivot"), "idx").where("depth = 0")).drop("period")


def _items(when: str) -> str:
    """The fingerprint of each series over the bars of the walk up to a time, as SQL."""
    head = SIGNALS[False].replace("FROM wb)", f"FROM wb WHERE ts <= '{when}')")
    return f"""({head}, ls AS (SELECT code, CASE WHEN if(d = 1, h > ph, l < pl) AND area < pa THEN {sq.at('q', 'src_end')} || ':' || CAST(d AS VARCHAR) END AS item, row_number() OVER (PARTITION BY code ORDER BY src_end DESC, src_start DESC) AS n FROM (
    SELECT *, lag(area) OVER w AS pa, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM d0a WINDOW w AS (PARTITION BY code, d ORDER BY src_end, idx)) AS q)
  SELECT code, 'pivot' AS part, CAST(src_start AS VARCHAR) || ':' || CAST(src_end AS VARCHAR) || ':' || CAST(CAST(zd AS DOUBLE) AS VARCHAR) || ':' || CAST(CAST(zg AS DOUBLE) AS VARCHAR) AS item FROM p0
  UNION ALL SELECT code, 'signal', {sq.at('sig', 'src')} || ':' || kind FROM sig
  UNION ALL SELECT code, 'divergence', item FROM ls WHERE n = 1 AND item IS NOT NULL
  UNION ALL SELECT x.code, 'breakout', CASE WHEN y.zg IS NULL THEN 'none' WHEN x.c > y.zg THEN 'up' WHEN x.c < y.zd THEN 'down' ELSE 'inside' END FROM (SELECT code, arg_max(c, i) AS c FROM b GROUP BY code) AS x
    LEFT JOIN (SELECT code, zg, zd, row_number() OVER (PARTITION BY code ORDER BY src_end DESC, src_start DESC) AS n FROM p0) AS y ON y.code = x.code AND y.n = 1)"""


@query(f"""WITH prev AS {_items('1997-01-01')}, cur AS {_items('9999')}, fresh AS (SELECT DISTINCT c.code, c.part, c.item FROM cur AS c WHERE c.code IN (SELECT code FROM prev) AND NOT EXISTS (SELECT 1 FROM prev AS p WHERE p.code = c.code AND p.part = c.part AND p.item = c.item))
  SELECT code, CASE part WHEN 'pivot' THEN 'NEW_PIVOT' WHEN 'signal' THEN 'SIGNAL' WHEN 'breakout' THEN 'PIVOT_BREAKOUT' ELSE 'DIVERGENCE' END AS change, item FROM fresh
  UNION ALL SELECT DISTINCT code, CASE WHEN code IN (SELECT code FROM prev) THEN 'NO_CHANGE' ELSE 'FIRST_SNAPSHOT' END, '' FROM cur WHERE code NOT IN (SELECT code FROM fresh)""")
def fingerprint_diff(spark, d):
    """What is new in each series between two points in time: one kernel pass, one aggregation."""
    return scan.fingerprint_changes(watch.fingerprints(walk(spark, d), ["1997-01-01", "9999"])).drop("period")


@query(sq.base(sq.pivots("p0", "sg")) + """ SELECT x.code, CASE WHEN y.zg IS NULL THEN 'none' WHEN x.c > y.zg THEN 'up' WHEN x.c < y.zd THEN 'down' ELSE 'inside' END AS state FROM (SELECT code, arg_max(c, i) AS c FROM b GROUP BY code) AS x
  LEFT JOIN (SELECT code, zg, zd, row_number() OVER (PARTITION BY code ORDER BY src_end DESC, src_start DESC) AS n FROM p0) AS y ON y.code = x.code AND y.n = 1""")
def breakout_state(spark, d):
    b = walk(spark, d)
    return scan.breakout_state(table(spark, d, "pivot").where("depth = 0"), b.groupBy("code").agg(F.max_by("close", "ts").alias("close")))


@query(sq.base() + """ SELECT code, idx, a AS start_idx, z AS end_idx FROM (SELECT *, lag(z) OVER w AS pz, lag(status) OVER w AS ps, lag(d) OVER w AS pd FROM sg WINDOW w AS (PARTITION BY code ORDER BY idx))
  WHERE pz + 1 <> a OR (status = 'confirmed' AND ((z - a) % 2 <> 0 OR (ps = 'confirmed' AND pd = d)))""")
def segment_problems(spark, d):
    """Invariants of segments, checked natively: contiguous strokes, alternating and odd when confirmed. No rows is right."""
    from pyspark.sql import Window

    s = table(spark, d, "segment")
    w = Window.partitionBy("code").orderBy("idx")
    prev = lambda c: F.lag(c).over(w)
    bad = (prev("end_idx") + 1 != F.col("start_idx")) | ((F.col("status") == "confirmed") & ((F.col("end_idx") - F.col("start_idx")) % 2 != 0)) | ((F.col("status") == "confirmed") & (prev("status") == "confirmed") & (prev("direction") == F.col("direction")))
    return s.withColumn("bad", bad).where("bad").select("code", *(F.col(c).cast("long").alias(c) for c in ("idx", "start_idx", "end_idx")))


def _enough(when: str) -> str:
    """Series with a year and 250 bars up to a time, as SQL."""
    return f"(SELECT code, count(*) >= 250 AND datediff('day', min(ts)::DATE, max(ts)::DATE) >= 365 AS ok, count(*) >= 250 AS long FROM wb WHERE ts <= '{when}' GROUP BY code)"


@query(f"""WITH pv AS {_items('1999-01-01')}, cr AS {_items('9999')}, wb AS (SELECT code, ts FROM ({sq.base()} SELECT code, ts FROM b)), pe AS {_enough('1999-01-01')}, ce AS {_enough('9999')},
  prev AS (SELECT * FROM pv WHERE code IN (SELECT code FROM pe WHERE ok)), cur AS (SELECT * FROM cr WHERE code IN (SELECT code FROM ce WHERE ok)),
  fresh AS (SELECT DISTINCT c.code, c.part, c.item FROM cur AS c WHERE c.code IN (SELECT code FROM prev) AND NOT EXISTS (SELECT 1 FROM prev AS p WHERE p.code = c.code AND p.part = c.part AND p.item = c.item))
  SELECT code, 'ok' AS status, CASE part WHEN 'pivot' THEN 'NEW_PIVOT' WHEN 'signal' THEN 'SIGNAL' WHEN 'breakout' THEN 'PIVOT_BREAKOUT' ELSE 'DIVERGENCE' END AS change, item, CAST(NULL AS VARCHAR) AS reason FROM fresh
  UNION ALL SELECT DISTINCT code, 'ok', CASE WHEN code IN (SELECT code FROM prev) THEN 'NO_CHANGE' ELSE 'FIRST_SNAPSHOT' END, '', NULL FROM cur WHERE code NOT IN (SELECT code FROM fresh)
  UNION ALL SELECT code, 'insufficient', NULL, NULL, if(long, 'history too short', 'too few bars') FROM ce WHERE NOT ok""")
def track_runs(spark, d):
    """Two runs of the tracker over a kept table: the bars up to 1999, then all; what the second run tells."""
    from ridgeline.operators import persist
    from ridgeline.sources.shared import shared_folder

    root = shared_folder(spark, "track")
    b = walk(spark, d).withColumn("period", F.lit("day"))
    for bars in (b.where("ts <= '1999-01-01'"), b):
        told = persist.run_track(spark, root, bars, bars.groupBy("code", "period").agg(F.min("ts").alias("sync_start"), F.max("ts").alias("sync_end")))
    return told.select("code", "status", "change", "item", "reason")


# --- ledgers and streams


def _runs(spark, d):
    b = walk(spark, d)
    scaled = b.select(F.lit("all").alias("run"), "code", "ts", (F.col("open") / 1e9).alias("open"), (F.col("close") / 1e9).alias("close"))
    f = table(spark, d, "fractal")
    causes = f.select(F.lit("all").alias("run"), "code", F.col("confirmed_at").alias("ts"), "kind", F.col("idx").alias("seq"))
    return scaled, causes


def _ledger(spark, d):
    from ridgeline.operators import backtest

    bars, causes = _runs(spark, d)
    return backtest.backtest(bars, causes, "fractal", share=0.3)


METRICS = " SELECT {}, " + f"""n, wins, losses, {rnd('CAST(wins AS DOUBLE) / n')} AS win_rate, {rnd('w')} AS avg_win, {rnd('l')} AS avg_loss, {rnd('w / nullif(abs(l), 0)')} AS payoff_ratio, {rnd('sw / nullif(abs(sl), 0)')} AS profit_factor,
  {rnd('total / n')} AS expectancy, {rnd('total')} AS total_pnl, {rnd('bars')} AS avg_holding_bars FROM (SELECT """ + "{}" + """, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses, avg(pnl) FILTER (pnl > 0) AS w, avg(pnl) FILTER (pnl <= 0) AS l,
  sum(pnl) AS total, sum(pnl) FILTER (pnl > 0) AS sw, sum(pnl) FILTER (pnl <= 0) AS sl, avg(holding_bars) AS bars FROM tp GROUP BY {})"""


@query(sq.LEDGER + f""" SELECT 'all' AS run, seq, ts, code, side, price, qty, {rnd('amount')} AS amount, {rnd('fee + tax')} AS fees, {rnd('cash')} AS cash, if(side = 'buy', 'fractal_bottom', 'fractal_top') AS signal_kind FROM fl""")
def backtest_fills(spark, d):
    return longs(layer(_ledger(spark, d), "fill"), "seq").select("run", "seq", "ts", "code", "side", "price", "qty", r(F.col("amount"), 4).alias("amount"), r(F.col("fees"), 4).alias("fees"), r(F.col("cash"), 4).alias("cash"), "signal_kind")


@query(sq.LEDGER + f" SELECT run, seq, code, signal_kind, entry_ts, exit_ts, qty, {rnd('pnl')} AS pnl, holding_bars FROM tp")
def backtest_round_trips(spark, d):
    return longs(layer(_ledger(spark, d), "trip"), "seq", "holding_bars").select("run", "seq", "code", "signal_kind", "entry_ts", F.col("ts").alias("exit_ts"), "qty", r(F.col("pnl"), 4).alias("pnl"), "holding_bars")


@query(sq.LEDGER + METRICS.format(*["run"] * 3))
def backtest_metrics(spark, d):
    from ridgeline.operators import backtest

    return backtest.trip_metrics(layer(_ledger(spark, d), "trip"), ["run"])


@query(sq.LEDGER + METRICS.format(*["run, signal_kind"] * 3))
def backtest_metrics_by_signal(spark, d):
    from ridgeline.operators import backtest

    return backtest.trip_metrics(layer(_ledger(spark, d), "trip"), ["run", "signal_kind"])


@query()
def backtest_signals(spark, d):
    """The signal strategy over what each bar shows for the first time."""
    from ridgeline.operators import backtest

    b = walk(spark, d)
    causes = backtest.visible_signals(b, mode="loose").select(F.lit("all").alias("run"), "code", "ts", "kind", "seq")
    bars = b.select(F.lit("all").alias("run"), "code", "ts", (F.col("open") / 1e9).alias("open"), (F.col("close") / 1e9).alias("close"))
    return layer(backtest.backtest(bars, causes, "signals"), "equity").select("run", "ts", r(F.col("equity"), 4).alias("equity"))


@query(sq.LEDGER + f""", dn AS (SELECT ts, peak, peak - equity AS fall, row_number() OVER (ORDER BY peak - equity DESC, ts) AS n FROM (SELECT ts, equity, max(equity) OVER (ORDER BY ts) AS peak FROM eq))
  SELECT 'all' AS key, {rnd('fall')} AS drawdown, {rnd('fall / peak', 6)} AS drawdown_pct FROM dn WHERE n = 1""")
def equity_drawdown(spark, d):
    from ridgeline.operators.indicators import max_drawdown

    worst = max_drawdown(layer(_ledger(spark, d), "equity").select(F.col("run").alias("key"), "ts", "equity"))
    return worst.withColumn("drawdown", r(F.col("drawdown")))


def _streamed(spark, d, parts):
    """Bars of the walk fed to the stream in parts (conditions on ts and code), each a start of the query from its checkpoint."""
    from ridgeline.sources.shared import shared_folder
    from ridgeline.streaming.steps import stream_structure

    root = shared_folder(spark, "stream")
    b = walk(spark, d).select("code", "ts", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close")))
    for i, part in enumerate(parts):
        b.where(part).write.parquet(f"{root}/in/{i}")
        q = stream_structure(spark.readStream.schema("code string, ts string, high double, low double, close double").option("recursiveFileLookup", "true").parquet(f"{root}/in"))
        q.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(sq.base() + " SELECT sg.code, x.as_of, src_start, src_end, status FROM sg JOIN (SELECT code, max(ts) AS as_of FROM b GROUP BY code) AS x ON x.code = sg.code")
def stream_step_equiv(spark, d):
    """Bars fed in three batches through the stateful stream; the segments that are there at last, which must equal the batch's."""
    from ridgeline.streaming import steps

    out = _streamed(spark, d, ["ts < '1994'", "ts >= '1994' AND ts < '1996'", "ts >= '1996'"])
    now = longs(steps.current(out).where("layer = 'segment'"), "src_start", "src_end")
    return now.join(steps.heads(out).select("code", "as_of"), "code").select("code", "as_of", "src_start", "src_end", "status")


ON_TIME = "(ts < '1994' OR ts >= '1996' OR code[1] > '2')"


@query(sq.base().replace("FROM wb)", f"FROM wb WHERE {ON_TIME})") + f""" SELECT code, 'late' AS what, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM wb WHERE NOT {ON_TIME} GROUP BY code
  UNION ALL SELECT code, 'segment', n, {sq.at('u', 'a')}, {sq.at('u', 'z')} FROM (SELECT code, count(*) AS n, min(src_start) AS a, max(src_end) AS z FROM sg GROUP BY code) AS u""")
def stream_late_rows(spark, d):
    """Two series get the years 1994 and 1995 after 1996: those bars are error rows, and every series goes on."""
    from ridgeline.streaming import steps

    first, middle, last = "ts < '1994'", "ts >= '1994' AND ts < '1996'", "ts >= '1996'"
    late = "substring(code, 1, 1) <= '2'"
    out = _streamed(spark, d, [f"{first} OR ({middle} AND NOT {late})", last, f"{middle} AND {late}"])
    errors = out.where("layer = 'error'").groupBy("code").agg(F.count("*").alias("n"), F.min(F.substring_index("text", " ", 1)).alias("first_ts"), F.max(F.substring_index("text", " ", 1)).alias("last_ts")).withColumn("what", F.lit("late"))
    seg = steps.current(out).where("layer = 'segment'").groupBy("code").agg(F.count("*").alias("n"), F.min("src_start").alias("a"), F.max("src_end").alias("z"))
    from pyspark.sql import Window

    kept = walk(spark, d).where(f"({first} OR {last} OR NOT {late})").select("code", "ts", (F.row_number().over(Window.partitionBy("code").orderBy("ts")) - 1).alias("i"))
    at = lambda c, name: kept.select(F.col("code"), F.col("i").alias(c), F.col("ts").alias(name))
    spans = seg.join(at("a", "first_ts"), ["code", "a"]).join(at("z", "last_ts"), ["code", "z"]).withColumn("what", F.lit("segment"))
    return errors.select("code", "what", "n", "first_ts", "last_ts").union(spans.select("code", "what", "n", "first_ts", "last_ts"))
