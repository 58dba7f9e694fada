"""What users plug in (signals, divergences, strategies), seeded quality runs, and equity from fills."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import tables
from ridgeline.operators import backtest, kernel, persist, quality, structure
from tests.test_fold import walk


def market(spark, n=500, seeds=(("a", 1), ("b", 2), ("c", 4))):
    rows = []
    for code, seed in seeds:
        for i, (h, low, c) in enumerate(zip(*walk(n, seed, 0.1))):
            if (i + seed) % 9:  # no code has all days
                rows.append((code, f"{i:05}", (h + low) / 2, h, low, c))
    return spark.createDataFrame(rows, "code string, ts string, open double, high double, low double, close double")


def test_own_functions_through_sql(spark):
    b = market(spark)
    b.createOrReplaceTempView("own_bars")
    tables.register(spark)
    ask = lambda f: [tuple(r) for r in spark.sql(f"SELECT * FROM analyze(TABLE(own_bars), 'tests.plugins:{f}') ORDER BY code, ts").collect()]
    from tests import plugins

    for name in ("stroke_ends", "weaker_strokes", "stroke_strategy"):
        want = []
        for code in "abc":
            rows = b.where(F.col("code") == code).orderBy("ts").collect()
            s = kernel.analyse(*([r[c] for r in rows] for c in ("high", "low", "close")))
            want += sorted((code, *x) for x in getattr(plugins, name)(rows, s))
        assert len(want) > 3 and ask(name) == want
    assert spark.sql("SELECT * FROM analyze(TABLE(own_bars), 'tests.plugins:stroke_ends', 'loose')").columns == ["code", "ts", "kind", "price"]
    for bad in ("tests.plugins:no_columns", "tests.plugins:nothing", "nowhere"):
        with pytest.raises(Exception, match="names no function|No module"):
            spark.sql(f"SELECT * FROM analyze(TABLE(own_bars), '{bad}')").collect()
    with pytest.raises(Exception, match="no high"):
        spark.sql("SELECT * FROM analyze(TABLE(SELECT code, ts, low, close FROM own_bars), 'tests.plugins:stroke_ends')").collect()


def test_own_signals_in_the_operator(spark):
    def every_segment(view):
        return [view.signal("b3" if s.direction == -1 else "s3", i, None) for i, s in enumerate(view.segs)]

    b = market(spark)
    t = structure.structure(b, signal_fn=every_segment, divergence_fn=lambda view: [])
    assert structure.layer(t, "signal").count() == structure.layer(t, "segment").count() > 0 and structure.layer(t, "divergence").count() == 0


# --- equity from fills


def causes_of(spark, b):
    f = structure.structure(b, layers=("fractal",)).where("layer = 'fractal'")
    return f.select(F.lit("r").alias("run"), "code", F.col("confirmed_at").alias("ts"), "kind", F.col("idx").alias("seq"))


@pytest.mark.parametrize("start,end", [(None, None), ("00100", "00400")])
def test_equity_from_fills_is_the_plain_ledgers(spark, start, end):
    b, causes = market(spark), causes_of(spark, market(spark))
    got = backtest.backtest(b.withColumn("run", F.lit("r")), causes, "fractal", 50_000.0, start, end, share=0.4)
    inside = b.where((F.col("ts") >= (start or "")) & (F.col("ts") <= (end or "9"))).toPandas()
    own = causes.where((F.col("ts") >= (start or "")) & (F.col("ts") <= (end or "9"))).toPandas()
    want = backtest.run_ledger(inside, own, backtest.fractal_strategy(share=0.4), 50_000.0)
    for layer, cols in (("fill", ["ts", "code", "side", "qty"]), ("trip", ["code", "qty", "holding_bars"])):
        rows = got.where(F.col("layer") == layer).orderBy("seq").toPandas()
        assert rows[cols].values.tolist() == pd.DataFrame(want[layer])[cols].values.tolist() and len(rows) > 10
    eq = got.where("layer = 'equity'").orderBy("ts").toPandas()
    assert eq["ts"].tolist() == [e["ts"] for e in want["equity"]]
    assert eq["equity"].tolist() == pytest.approx([e["equity"] for e in want["equity"]]) and eq["cash"].tolist() == pytest.approx([e["cash"] for e in want["equity"]])


def test_a_task_sees_only_bars_with_orders(spark):
    b, causes = market(spark).withColumn("run", F.lit("r")), causes_of(spark, market(spark))
    few = causes.where("seq % 10 = 0")
    assert backtest.eventful(b, few).count() <= 2 * few.count() < b.count()
    assert backtest.eventful(b, few, every=True).count() == b.count()


def test_codes_go_in_the_order_that_is_given(spark):
    """Cash is enough for one: the first in place gets it."""
    rows = [("r", c, d, 10.0, 10.0, p) for c, p in (("a", 2), ("b", 1)) for d in ("d1", "d2", "d3")]
    b = spark.createDataFrame(rows, "run string, code string, ts string, open double, close double, place int")
    causes = spark.createDataFrame([("r", c, "d1", "bottom", 0) for c in "ab"], "run string, code string, ts string, kind string, seq int")
    first = lambda df: df.where("layer = 'fill'").orderBy("seq").first()["code"]
    assert first(backtest.backtest(b, causes, "fractal", 1100.0)) == "b" and first(backtest.backtest(b.drop("place"), causes, "fractal", 1100.0)) == "a"


def test_own_strategy(spark):
    def buy_and_hold():
        def act(ledger, code, kinds):
            if code not in ledger.held and not ledger.fills:
                ledger.order(code, "buy", share=0.5, kind="own")

        return act

    buy_and_hold.every_bar = True
    b = market(spark).withColumn("run", F.lit("r"))
    none = spark.createDataFrame([], "run string, code string, ts string, kind string, seq int")
    fills = backtest.backtest(b, none, buy_and_hold).where("layer = 'fill'").collect()
    assert fills and {f["signal_kind"] for f in fills} == {"own"}
    assert backtest.backtest(b, none, "signals").where("layer = 'fill'").count() == 0


# --- quality runs


def test_samples_do_not_depend_on_partitions_and_merge(spark):
    codes = spark.createDataFrame([(f"{i:06}", "ab"[i % 2]) for i in range(500)], "code string, market string")
    pick = lambda df, **k: sorted(tuple(r) for r in quality.bottom_k(df, 20, 7, **k).collect())
    assert pick(codes.repartition(1)) == pick(codes.repartition(64)) and len(pick(codes)) == 20
    assert len(pick(codes, stratum="market")) == 40
    halves = quality.bottom_k(codes.where("code < '000250'"), 20, 7).union(quality.bottom_k(codes.where("code >= '000250'"), 20, 7))
    assert pick(halves) == pick(codes)
    assert sorted(tuple(r) for r in quality.bottom_k(codes, 20, 8).collect()) != pick(codes)


def test_quality_run_and_ledger(spark, tmp_path):
    rows = [(c, f"2026-01-{d:02}", 10.0 + d) for c in ("a", "b", "c", "d") for d in range(1, 31)]
    raw = spark.createDataFrame(rows, "code string, ts string, close double")
    qfq = raw.where("code <> 'd'").withColumn("close", F.when((F.col("code") == "b") & (F.col("ts") == "2026-01-30"), 50.0).otherwise(F.col("close")))
    other = qfq.withColumn("close", F.when(F.col("code") == "c", F.col("close") * 1.01).otherwise(F.col("close")))
    got = quality.quality_run(raw.select("code"), qfq, raw, other, n=4)
    assert {(r["code"], r["kind"]): r["ok"] for r in got.collect()} == {(c, k): c == "a" or (c, k) in (("b", "cross_source"), ("c", "latest_equals_actual")) for c in "abcd" for k in ("latest_equals_actual", "cross_source")}
    root = f"file://{tmp_path}"
    report = {r["kind"]: (r["total"], r["failing"]) for r in quality.save_quality(spark, root, got, "2026-02-01").collect()}
    assert report == {"latest_equals_actual": (4, 2), "cross_source": (4, 2)}
    quality.save_quality(spark, root, got, "2026-02-02")
    kept = persist.opened(spark, root, "quality_flag").read()
    assert kept.count() == 8 and kept.where("ts = '2026-02-02' AND NOT ok").count() == 4 and "nothing to compare" in {r["detail"] for r in kept.where("code = 'd'").collect()}
