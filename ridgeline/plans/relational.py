"""Bars, cleaning, adjustment, resampling, averages, and checks between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.operators import adjust, clean, indicators, quality
from ridgeline.plans.sql import EB, LB, WB, rnd
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


OHLC = "code, ts, open, high, low, close, volume, amount"


@query(f"WITH {LB} SELECT {OHLC} FROM lb")
def bars_daily(spark, d):
    return src.lineitem_bars(spark, d)


@query(f"WITH {WB} SELECT {OHLC} FROM wb")
def bars_order_walk(spark, d):
    return src.order_walk_bars(spark, d)


@query(f"WITH {EB} SELECT {OHLC} FROM eb")
def bars_hourly(spark, d):
    return src.event_bars(spark, d)


def _resample_sql(to: str) -> str:
    return f"""WITH {LB} SELECT code, max(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
      CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(amount) AS BIGINT) AS amount FROM lb GROUP BY code, date_trunc('{to}', CAST(ts AS DATE))"""


@query(_resample_sql("week"))
def bars_week_resample(spark, d):
    return adjust.resample(src.lineitem_bars(spark, d), "week")


@query(_resample_sql("month"))
def bars_month_resample(spark, d):
    return adjust.resample(src.lineitem_bars(spark, d), "month")


@query(f"WITH {EB} SELECT code, substr(ts, 1, 10) AS day, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM eb GROUP BY 1, 2")
def bars_minute_to_day(spark, d):
    return adjust.minute_to_day(src.event_bars(spark, d))


def _calendar(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct().where("dayofweek(day) BETWEEN 2 AND 6")


@query(f"""WITH {WB}, cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE isodow(CAST(o_orderdate AS DATE)) <= 5),
  last AS (SELECT date_trunc('month', day) AS mon, strftime(max(day), '%Y-%m-%d') AS last_day FROM cal GROUP BY 1),
  mb AS (SELECT code, max(ts) AS ts FROM wb GROUP BY code, date_trunc('month', CAST(ts AS DATE)))
  SELECT code, ts, coalesce(last_day = ts, false) AS complete FROM mb LEFT JOIN last ON mon = date_trunc('month', CAST(ts AS DATE))""")
def period_complete(spark, d):
    return adjust.period_complete(adjust.resample(src.order_walk_bars(spark, d), "month").select("code", "ts"), "month", _calendar(spark, d))


def _dirty(spark, d):
    """Events as untyped rows with all the faults that cleaning removes: text numbers, blanks, zeros, ranges upside down, repeats."""
    e = spark.read.parquet(f"{d}/events.parquet")
    v = F.col("value")
    return e.select(
        F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("code"),
        F.when(F.col("event_id") % 17 == 0, "  ").otherwise(F.date_format("ts", "yyyy-MM-dd HH:00")).alias("ts"),
        v.cast("string").alias("open"), (v + 1).alias("high"), F.when(F.col("event_id") % 23 == 0, v + 2).otherwise(v).alias("low"),
        F.when(F.col("event_id") % 29 == 0, F.lit("n/a")).otherwise(v.cast("string")).alias("close"), F.lit(1).alias("volume"), F.col("event_id").alias("arrival"),
    )


@query("""SELECT code, ts, v.open AS open, v.high AS high, v.low AS low, v.close AS close, CAST(1 AS DOUBLE) AS volume, CAST(0 AS DOUBLE) AS amount FROM (
  SELECT code, ts, arg_max({'open': value, 'high': value + 1, 'low': low, 'close': value}, event_id) AS v FROM (
    SELECT event_type AS code, CASE WHEN event_id % 17 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:00') END AS ts, value, event_id, CASE WHEN event_id % 23 = 0 THEN value + 2 ELSE value END AS low,
           CASE WHEN event_id % 29 = 0 THEN 0 ELSE value END AS cl FROM events)
  WHERE ts <> '' AND value + 1 >= low AND value > 0 AND cl > 0 AND low > 0 GROUP BY code, ts)""")
def bars_clean_dedup(spark, d):
    return clean.normalize(_dirty(spark, d), ["code", "ts"])


@query(f"""WITH {LB} SELECT {OHLC} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS n FROM lb WHERE ts >= '1994-01-01' AND ts <= '1996-12-31') WHERE n <= 30""")
def bars_range_tail(spark, d):
    return clean.truncate(src.lineitem_bars(spark, d), "1994-01-01", "1996-12-31", 30)


@query(f"""WITH {LB} SELECT {OHLC} FROM lb WHERE ts < '1995-01-01' UNION ALL SELECT code, ts, open, high, low, close + 1, volume, amount FROM lb WHERE ts >= '1995-01-01'""")
def bars_upsert(spark, d):
    b = src.lineitem_bars(spark, d)
    return clean.upsert(b.where("ts < '1996-01-01'"), b.where("ts >= '1995-01-01'").withColumn("close", F.col("close") + 1), ["code", "ts"]).select(*OHLC.split(", "))


@query(f"WITH {LB} SELECT code, ts FROM lb WHERE ts >= '1996-01-01'")
def bars_new_keys(spark, d):
    b = src.lineitem_bars(spark, d)
    return clean.new_keys(b.where("ts < '1996-01-01'"), b.where("ts >= '1995-01-01'"), ["code", "ts"])


@query(f"WITH {LB} SELECT code, 'day' AS period, max(ts) AS last_ts, count(*) AS rows FROM lb GROUP BY code")
def bars_watermarks(spark, d):
    return src.last_ts(src.lineitem_bars(spark, d).withColumn("period", F.lit("day")))


def _ma(n: int) -> str:
    w = f"OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {w} = {n} THEN {rnd(f'CAST(sum(close) {w} AS DOUBLE) / {n}')} END AS ma{n}"


@query(f"WITH {LB} SELECT code, ts, close, {', '.join(map(_ma, indicators.DEFAULT_MA))} FROM lb")
def bars_ma(spark, d):
    return indicators.moving_averages(src.lineitem_bars(spark, d))


@query(f"""WITH RECURSIVE {LB}, b AS (SELECT code, ts, CAST(close AS DOUBLE) AS c, row_number() OVER (PARTITION BY code ORDER BY ts) AS i FROM lb),
  e AS (SELECT code, ts, i, c, c AS e1, c AS e2, CAST(0 AS DOUBLE) AS dea FROM b WHERE i = 1
    UNION ALL
    SELECT code, ts, i, c, e1, e2, (2.0e0 / 10) * (e1 - e2) + (1 - 2.0e0 / 10) * dea FROM (
      SELECT b.code, b.ts, b.i, b.c, (2.0e0 / 13) * b.c + (1 - 2.0e0 / 13) * e.e1 AS e1, (2.0e0 / 27) * b.c + (1 - 2.0e0 / 27) * e.e2 AS e2, e.dea FROM e JOIN b ON b.code = e.code AND b.i = e.i + 1))
  SELECT code, ts, {rnd('e1 - e2')} AS dif, {rnd('dea')} AS dea, {rnd('2 * ((e1 - e2) - dea)')} AS hist FROM e""")
def bars_ema_macd(spark, d):
    from ridgeline.functions.numbers import round_half_up as r

    return indicators.ema_macd(src.lineitem_bars(spark, d)).select("code", "ts", *(r(F.col(c)).alias(c) for c in ("dif", "dea", "hist")))


@query(f"""WITH {LB} SELECT code, ts, close, prev_close, {rnd('CAST(close - prev_close AS DOUBLE) / prev_close * 100')} AS change_pct FROM (
  SELECT *, lag(close) OVER (PARTITION BY code ORDER BY ts) AS prev_close, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS n FROM lb) WHERE n = 1""")
def bars_prev_close_change(spark, d):
    return indicators.price_change(src.lineitem_bars(spark, d))


def _ladder(spark, d):
    """A factor step a month: k grows from 0.5 towards 1."""
    m = src.lineitem_bars(spark, d).where("ts >= '1993-01-01'").groupBy("code", F.substring("ts", 1, 7).alias("mon")).agg(F.max("ts").alias("ts"))
    n = F.months_between(F.to_date(F.concat("mon", F.lit("-01"))), F.lit("1992-01-01").cast("date")).cast("int")
    return m.select("code", "ts", ((F.lit(500) + n) / 1000.0).cast("double").alias("k"))


LADDER = """lad AS (SELECT code, ts, CAST(500 + mon AS DOUBLE) / 1000 AS k FROM (SELECT code, max(ts) AS ts, date_diff('month', DATE '1992-01-01', CAST(substr(ts, 1, 7) || '-01' AS DATE)) AS mon FROM lb WHERE ts >= '1993-01-01' GROUP BY code, substr(ts, 1, 7)))"""
ASOF = f"""WITH {LB}, {LADDER}, k0 AS (SELECT code, arg_min(k, ts) AS k0 FROM lad GROUP BY code),
  j AS (SELECT lb.*, coalesce(lad.k, k0.k0) AS k, k0.k0 FROM lb LEFT JOIN k0 ON k0.code = lb.code ASOF LEFT JOIN lad ON lad.code = lb.code AND lb.ts >= lad.ts)"""


def _scaled(op: str) -> str:
    cols = ", ".join(f"{rnd(f'{c} {op}')} AS {c}" for c in ("open", "high", "low", "close"))
    return f"{ASOF} SELECT code, ts, {cols}, volume, amount FROM j"


@query(_scaled("* k"))
def factor_asof_qfq(spark, d):
    return adjust.adjust(src.lineitem_bars(spark, d), _ladder(spark, d), "qfq")


@query(_scaled("* (k / k0)"))
def factor_asof_hfq(spark, d):
    return adjust.adjust(src.lineitem_bars(spark, d), _ladder(spark, d), "hfq")


@query(_scaled("/ k"))
def factor_unapply_raw(spark, d):
    return adjust.adjust(src.lineitem_bars(spark, d), _ladder(spark, d), "raw", stored="qfq")


INFER = f"""{ASOF}, q AS (SELECT code, ts, {rnd(f"{rnd('close * k')} / close", 8)} AS k FROM j WHERE close > 0),
  st AS (SELECT code, ts, k FROM (SELECT *, lag(k) OVER (PARTITION BY code ORDER BY ts) AS p FROM q) WHERE p IS NULL OR k <> p)"""


@query(f"{INFER} SELECT code, ts, k FROM st")
def factor_infer_steps(spark, d):
    b = src.lineitem_bars(spark, d)
    return adjust.infer_factors(b, adjust.adjust(b, _ladder(spark, d), "qfq"))


@query(f"""{INFER} SELECT code, 'written' AS status, count(*) AS steps FROM st GROUP BY code UNION ALL SELECT 'none', 'no_raw', 0""")
def factor_status(spark, d):
    b = src.lineitem_bars(spark, d)
    codes = b.select("code").distinct().union(spark.createDataFrame([("none",)], "code string"))
    return adjust.factor_status(b, adjust.adjust(b, _ladder(spark, d), "qfq"), codes)


@query(f"""WITH {LB}, x AS (SELECT code, ts, CAST(close AS DOUBLE) / 100 AS close, unnest(['600000', '300750', '301001', '688981', '689009', '430047', '830799', '920001']) AS digits FROM lb),
  y AS (SELECT *, CASE WHEN digits[1:3] IN ('300', '301', '688', '689') THEN 0.2e0 WHEN digits[1] IN ('4', '8') THEN 0.3e0 ELSE 0.1e0 END AS p FROM x)
  SELECT code, ts, digits, {rnd('close * (1 + p)', 2)} AS up, {rnd('close * (1 - p)', 2)} AS down FROM y""")
def limit_prices(spark, d):
    """Each close's next limits under codes of all three rates."""
    from ridgeline.functions.numbers import limit_pct, round_half_up

    b = src.lineitem_bars(spark, d).select("code", "ts", (F.col("close") / 100).alias("close"), F.explode(F.array(*map(F.lit, ("600000", "300750", "301001", "688981", "689009", "430047", "830799", "920001")))).alias("digits"))
    b = b.withColumn("p", limit_pct(F.col("digits")))
    return b.select("code", "ts", "digits", round_half_up(F.col("close") * (1 + F.col("p")), 2).alias("up"), round_half_up(F.col("close") * (1 - F.col("p")), 2).alias("down"))


# --- checks between tables


@query(f"""WITH {LB}, a AS (SELECT '430' || lpad(CAST(ascii(code) AS VARCHAR), 3, '0') AS code, ts, CAST(close AS DOUBLE) AS close FROM lb), n AS (SELECT '920' || right(code, 3) AS code, ts, close + 0.001 AS close FROM a)
  SELECT a.code AS old_code, n.code AS new_code, count(*) AS n FROM a JOIN n ON n.code = '920' || right(a.code, 3) AND n.ts = a.ts GROUP BY 1, 2 HAVING count(*) >= 20 AND max(abs(a.close - n.close)) < 0.005""")
def alias_detect(spark, d):
    b = src.lineitem_bars(spark, d)
    old = b.select(F.concat(F.lit("430"), F.lpad(F.ascii("code").cast("string"), 3, "0")).alias("code"), "ts", F.col("close").cast("double").alias("close"))
    new = old.select(F.concat(F.lit("920"), F.right("code", F.lit(3))).alias("code"), "ts", (F.col("close") + 0.001).alias("close"))
    return quality.alias_pairs(old.union(new))


@query(f"""WITH {EB}, dd AS (SELECT code, substr(ts, 1, 10) AS day, arg_max(close, ts) AS close FROM eb GROUP BY 1, 2)
  SELECT code, day, close, close + 1 AS d_close FROM dd WHERE CAST(substr(day, 9, 2) AS INT) % 5 = 0 ORDER BY code, day LIMIT 10""")
def minute_vs_day_check(spark, d):
    e = src.event_bars(spark, d)
    days = adjust.minute_to_day(e).withColumnRenamed("day", "ts").withColumn("close", F.when(F.substring("ts", 9, 2).cast("int") % 5 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return quality.minute_against_day(e, days)


@query(f"""WITH {LB}, x AS (SELECT code, ts, {rnd('abs(CAST(close AS DOUBLE) - (close + CAST(substr(ts, 9, 2) AS INT))) / (close + CAST(substr(ts, 9, 2) AS INT))', 8)} AS diff FROM lb)
  SELECT code, count(*) AS n, first(ts ORDER BY diff DESC, ts) AS worst_day, max(diff) AS worst FROM x GROUP BY code""")
def cross_source_check(spark, d):
    b = src.lineitem_bars(spark, d)
    return quality.cross_source(b, b.withColumn("close", F.col("close") + F.substring("ts", 9, 2).cast("int")))


@query(f"""{ASOF}, l AS (SELECT code, max(ts) AS ts, arg_max({rnd('close * k')}, ts) AS q, arg_max(CAST(close AS DOUBLE), ts) AS c FROM j GROUP BY code)
  SELECT code, ts, {rnd('abs(q - c) / c', 8)} AS error, abs(q - c) / c <= 0.005 AS ok FROM l""")
def latest_equals_actual(spark, d):
    b = src.lineitem_bars(spark, d)
    return quality.latest_equals_actual(adjust.adjust(b, _ladder(spark, d), "qfq"), b)


@query(f"""WITH {LB}, eq AS (SELECT code AS key, ts, CAST(close AS DOUBLE) AS equity FROM lb), w AS (SELECT *, max(equity) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM eq)
  SELECT key, first(peak - equity ORDER BY peak - equity DESC, ts) AS drawdown, {rnd('first((peak - equity) / peak ORDER BY peak - equity DESC, ts)', 6)} AS drawdown_pct FROM w GROUP BY key""")
def max_drawdown(spark, d):
    return indicators.max_drawdown(src.lineitem_bars(spark, d).select(F.col("code").alias("key"), "ts", F.col("close").cast("double").alias("equity")))


@query(f"""WITH {WB} SELECT code, min(ts) AS first_ts, max(ts) AS last_ts, {rnd('CAST(arg_max(close, ts) AS DOUBLE) / arg_min(close, ts) - 1', 8)} AS ret FROM wb GROUP BY code""")
def benchmark_return(spark, d):
    from ridgeline.operators.backtest import benchmark_return as op

    return op(src.order_walk_bars(spark, d))
