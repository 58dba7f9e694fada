import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import codes
from ridgeline.operators import adjust, backtest, clean, kernel, meta, pit, quality, scan, structure
from ridgeline.plans import market, structural
from ridgeline.sources import bars, files, sinks


def frame(spark, rows, schema="code string, ts string, open double, high double, low double, close double, volume double, amount double"):
    return spark.createDataFrame(rows, schema)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_split_and_dividend_adjustment(spark):
    b = frame(spark, [("a", f"2026-01-0{i}", c, c, c, c, 1.0, 2.0) for i, c in ((1, 10.0), (2, 5.0))])
    k = spark.createDataFrame([("a", "2026-01-01", 0.5), ("a", "2026-01-02", 1.0)], "code string, ts string, k double")
    assert [r[0] for r in rows(adjust.adjust(b, k, "qfq"), "close")] == [5.0, 5.0]
    assert [r[0] for r in rows(adjust.adjust(b, k, "hfq"), "close")] == [10.0, 10.0]
    assert rows(adjust.adjust(b, k, "qfq"), "volume", "amount") == [(1.0, 2.0)] * 2
    q = adjust.adjust(b, k, "qfq")
    assert rows(adjust.adjust(q, k, "raw", "qfq"), "ts", "close") == rows(b, "ts", "close")
    with pytest.raises(ValueError):
        adjust.adjust(b, k, "other")
    # a code without a ladder stays as it is; bars before the first step get the first factor
    assert rows(adjust.adjust(b, k.where("k > 1"), "qfq"), "close") == rows(b, "close")
    late = k.where("ts > '2026-01-01'").withColumn("k", F.lit(0.8))
    assert rows(adjust.adjust(b, late, "qfq"), "close") == [(4.0,), (8.0,)]


def test_week_across_a_holiday(spark):
    data = [("a", d, o, h, l, c, v, 1.0) for d, o, h, l, c, v in (("2026-09-28", 10, 11, 9.5, 10.5, 100), ("2026-09-29", 10.5, 12, 10, 11, 200), ("2026-09-30", 11, 11.5, 9, 11.2, 300), ("2026-10-08", 11, 13, 11, 12, 1), ("2026-10-09", 12, 14, 11, 13, 1))]
    w = adjust.resample(frame(spark, [tuple(map(lambda x: float(x) if not isinstance(x, str) else x, r)) for r in data]), "week")
    got = {r["ts"]: r for r in w.collect()}
    assert set(got) == {"2026-09-30", "2026-10-09"}
    r = got["2026-09-30"]
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (10, 12, 9, 11.2, 600)


def test_normalize_edge_cases(spark):
    raw = spark.createDataFrame(
        [("a", " 2026-01-02 ", "1", "2", "0.5", "1.5", 1), ("a", "2026-01-02", "1", "2", "0.5", "1.7", 2), ("a", "", "1", "2", "1", "1", 3), ("a", "2026-01-03", "0", "2", "1", "1", 4), ("a", "2026-01-04", "1", "1", "2", "1", 5), ("a", "2026-01-05", "9", "2", "1", "1", 6), (None, None, None, None, None, None, 7)],
        "code string, ts string, open string, high string, low string, close string, arrival int",
    )
    out = clean.normalize(raw, ["code", "ts"])
    assert rows(out, "ts", "close") == [("2026-01-02", 1.7), ("2026-01-05", 1.0)]
    assert rows(clean.normalize(raw.limit(0), ["code", "ts"])) == []
    assert bars.empty_frame(spark).columns[:3] == ["code", "period", "ts"]


def test_store_round_trip(spark, tmp_path):
    b = frame(spark, [("600000", f"2026-01-{i:02d}", 1.0, 2.0, 0.5, 1.0, 1.0, 1.0) for i in range(1, 10)] + [("sz.000300", "2026-01-01", 1.0, 2.0, 0.5, 1.0, 1.0, 1.0)]).withColumn("period", F.lit("day"))
    root = f"file://{tmp_path}/store"
    bars.write_bars(b, root)
    got = bars.read_bars(spark, root, code="600000", period="day", start="2026-01-03", limit=2)
    assert rows(got, "ts") == [("2026-01-08",), ("2026-01-09",)]
    assert rows(bars.last_ts(spark.read.parquet(root)), "code", "last_ts", "rows")[0] == ("600000", "2026-01-09", 9)
    plan = spark.read.parquet(root).where("period = 'day' AND code = '600000'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "EqualTo(code,600000)" in plan


def test_codes(spark):
    df = spark.createDataFrame([(x,) for x in ("600000", "sh600000", "SZ.000001", "sh.000001", "000300.SH", "sh.600000.sz", "92abc", "920123", "881001", "hk.hsi", None, "700000", "HK00700", "us.brk.b", "sw.801120", "801120", "hk.0070", "sw.802120")], "t string")
    got = [r[0] for r in df.select(codes.normalize_code(F.col("t"))).collect()]
    assert got == ["600000", "600000", "000001", "sh.000001", "sh.000300", None, None, "920123", "881001", "hk.hsi", None, None, "hk.00700", "us.brk.b", "sw.801120", "801120", None, None]
    m = dict(df.where("t IS NOT NULL").select("t", codes.market_of(F.col("t"))).collect())
    assert m["920123"] == "bj" and m["881001"] == "sh" and m["hk.hsi"] == "hk" and m["sh.000001"] == "sh"
    i = dict(df.where("t IS NOT NULL").select("t", codes.is_index(F.col("t"))).collect())
    assert i["sh.000001"] and i["hk.hsi"] and not i["600000"]


def test_day_and_minute_records(spark, tmp_path):
    data = struct.pack("<IIIIIfII", 20260930, 1234, 1300, 1200, 1250, 1e6, 1000, 0)
    r = files.parse_day(data).iloc[0]
    assert (r["ts"], r["open"], r["high"], r["low"], r["close"]) == ("2026-09-30", 12.34, 13, 12, 12.5)
    with pytest.raises(files.FormatError):
        files.parse_day(data[:-1])
    with pytest.raises(files.FormatError):
        files.parse_day(struct.pack("<IIIIIfII", 1, 1, 1, 1, 1, 1, 1, 0))
    date = (2026 - 2004) * 2048 + 930
    two = b"".join(struct.pack("<HHfffffII", date, m, 10, 11, 9, 10, 1e3, 5, 0) for m in (571, 572))
    assert files.parse_minute(two)["ts"].tolist() == ["2026-09-30 09:31", "2026-09-30 09:32"]
    with pytest.raises(files.FormatError):
        files.parse_minute(two[32:] + two[:32])
    folder = tmp_path / "vip" / "sh" / "lday"
    folder.mkdir(parents=True)
    (folder / "sh600000.day").write_bytes(data)
    (folder / "sh600001.day").write_bytes(data[:5])
    (folder / "sh600000.lc1").write_bytes(two)
    got = files.read_packages(spark, f"file://{tmp_path}/vip")
    assert got.where("error IS NOT NULL").count() == 1
    assert rows(got.where("error IS NULL"), "code", "period", "ts") == [("600000", "1", "2026-09-30 09:31"), ("600000", "1", "2026-09-30 09:32"), ("600000", "day", "2026-09-30")]


def test_ledger_t_plus_one():
    lg = backtest.Ledger(100_000)
    lg.order("600000", "buy", qty=100)
    lg.open("600000", "d1", 10.0, None, 0)
    assert [(f["price"], f["qty"], f["fees"]) for f in lg.fills] == [(10.0, 100, 5.0)]
    lg.order("600000", "sell")
    lg.open("600000", "d1", 10.5, None, 0)
    assert lg.rejections[0]["reason"] == "T+1"
    lg.order("600000", "sell")
    lg.open("600000", "d2", 11.0, None, 1)
    t = lg.trips[0]
    assert t["qty"] == 100 and t["holding_bars"] == 1
    assert t["pnl"] == pytest.approx(100 - 5 - 5 - 1.1) and lg.cash == pytest.approx(100_000 + t["pnl"])


def test_ledger_limits_and_lots():
    lg = backtest.Ledger(10_000)
    lg.order("600000", "buy")
    lg.open("600000", "d1", 11.0, 10.0, 0)
    assert lg.rejections[-1]["reason"] == "limit up"
    lg.order("600000", "buy", share=0.5)
    lg.open("600000", "d2", 10.0, 10.0, 1)
    assert lg.fills[-1]["qty"] == 400  # 500 and the fee are over half the cash
    lg.order("600000", "buy", qty=250)
    lg.open("600000", "d3", 10.0, 10.0, 2)
    assert lg.fills[-1]["qty"] == 200
    lg.order("600000", "sell", qty=500)
    lg.open("600000", "d4", 12.0, 12.0, 3)
    assert [t["qty"] for t in lg.trips] == [400, 100] and lg.held["600000"].qty == 100
    lg.order("600000", "sell")
    lg.open("600000", "d5", 9.0, 10.0, 4)
    assert lg.rejections[-1]["reason"] == "limit down"
    assert backtest.limit_prices(10, "300001") == (12.0, 8.0) and backtest.limit_prices(10, "430001") == (13.0, 7.0) and backtest.limit_prices(10, "920001") == (11.0, 9.0)
    with pytest.raises(ValueError):
        backtest.Ledger(1000, slippage=0.1)
    with pytest.raises(ValueError):
        backtest.Ledger(0)
    with pytest.raises(ValueError):
        lg.order("600000", "hold")


def test_metrics_undefined_is_null(spark):
    t = spark.createDataFrame([("r", 5.0, 1)], "run string, pnl double, holding_bars int")
    m = backtest.trip_metrics(t, ["run"]).first()
    assert m["win_rate"] == 1.0 and m["payoff_ratio"] is None and m["avg_loss"] is None
    assert backtest.trip_metrics(t.limit(0), ["run"]).count() == 0


def test_reconcile(spark):
    s = "code string, id string, status string, confirmed_at string"
    prev = spark.createDataFrame([("a", "1", "confirmed", "t1"), ("a", "2", "tentative", None), ("a", "3", "confirmed", "t0")], s)
    new = spark.createDataFrame([("a", "1", "confirmed", "t9"), ("a", "2", "confirmed", None), ("a", "4", "tentative", None)], s)
    got = {r["id"]: (r["status"], r["confirmed_at"]) for r in pit.reconcile(prev, new, ["code", "id"], "now").collect()}
    assert got == {"1": ("confirmed", "t1"), "2": ("confirmed", "now"), "3": ("invalidated", "t0"), "4": ("tentative", None)}


def test_bad_series_is_a_row(spark):
    b = spark.createDataFrame([("a", "1", 2.0, 1.0, 1.5), ("b", "1", None, 1.0, 1.0)], "code string, ts string, high double, low double, close double")
    got = {r["code"]: r["layer"] for r in structure.structure(b).collect()}
    assert got["a"] == "merged" and "b" in got
    with pytest.raises(ValueError):
        structure.structure(b, mode="other")


def test_window_is_cut_after_the_kernel(spark, tiny):
    t = structure.structure(bars.order_walk_bars(spark, tiny), layers=("stroke",))
    plan = structure.clip(t, "1995", "1996")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("FlatMapGroupsInPandas")


def test_hit_strength(spark):
    df = spark.createDataFrame([("b1", "day", "confirmed", True, 0.5), ("pb", "15", "tentative", None, None), ("s2", "1", "confirmed", False, 0.0)], "kind string, level string, status string, flag boolean, d double")
    got = [round(r[0], 6) for r in df.select(scan.hit_strength(F.col("kind"), F.col("level"), F.col("status"), F.col("flag"), F.col("d"))).collect()]
    assert got == [9.0, 0.6, round(2 * 0.8 * 0.7, 6)]


def test_fingerprint_changes(spark):
    s = "code string, part string, item string"
    prev = spark.createDataFrame([("a", "pivot", "p1"), ("b", "pivot", "p1"), ("b", "breakout", "inside")], s)
    new = spark.createDataFrame([("a", "pivot", "p1"), ("b", "pivot", "p1"), ("b", "pivot", "p2"), ("b", "breakout", "up"), ("c", "signal", "x")], s)
    assert rows(scan.diff_fingerprints(prev, new)) == [("a", "NO_CHANGE", ""), ("b", "NEW_PIVOT", "p2"), ("b", "PIVOT_BREAKOUT", "up"), ("c", "FIRST_SNAPSHOT", "")]


def test_no_change_of_empty(spark):
    e = spark.createDataFrame([], "code string, part string, item string")
    assert scan.diff_fingerprints(e, e).count() == 0
    assert meta.universe_union(spark.createDataFrame([], "code string, name string, day string")).count() == 0
    assert quality.adjust_mix(spark.createDataFrame([], "period string, adjust string")).count() == 0


def test_notifiers(tmp_path, capsys):
    class Broken(sinks.Notifier):
        def send(self, title, text):
            raise OSError("down")

    n = sinks.MultiNotifier(Broken(), sinks.FileNotifier(str(tmp_path / "n.txt")), sinks.ConsoleNotifier())
    n.send("t", "body")
    assert "body" in (tmp_path / "n.txt").read_text() and "body" in capsys.readouterr().out and n.failed[0][0] == "Broken"
    with pytest.raises(ValueError):
        sinks.build_notifier("pigeon")


def test_visible_signals_see_no_future(spark, tiny):
    b = structure.as_of(bars.order_walk_bars(spark, tiny), "1996-12-31")
    got = backtest.visible_signals(b, mode="loose")
    # poison after a date changes nothing before it
    cut = "1996-06-30"
    poison = b.withColumn("high", F.when(F.col("ts") > cut, F.col("high") * 3).otherwise(F.col("high")))
    assert rows(got.where(F.col("ts") <= cut)) == rows(backtest.visible_signals(poison, mode="loose").where(F.col("ts") <= cut))


def test_visible_signals_of_a_span_know_what_came_before(spark):
    """Bars before the span are seen, their signals are old; so are those that the span's first bar shows."""
    from tests.test_fold import walk

    data = [(code, f"{i:05}", h, l, c) for code, seed in (("a", 1), ("b", 2), ("c", 3)) for i, (h, l, c) in enumerate(zip(*walk(1500, seed)))]
    b = spark.createDataFrame(data, "code string, ts string, high double, low double, close double")
    whole = rows(backtest.visible_signals(b, mode="loose"), "code", "ts", "kind")
    times = sorted(r[1] for r in whole)
    start, end = times[len(times) // 4], times[-2]
    want = [r for r in whole if start < r[1] <= end]
    assert 0 < len(want) < len(whole) and rows(backtest.visible_signals(b, mode="loose", start=start, end=end), "code", "ts", "kind") == want


def walks(spark, tiny):
    """code, and its bars in order of ts, of the order walk."""
    b = bars.order_walk_bars(spark, tiny).toPandas().sort_values(["code", "ts"])
    return [(code, g["ts"].tolist(), *(g[c].astype(float).tolist() for c in ("open", "high", "low", "close"))) for code, g in b.groupby("code")]


def test_backtest_signals_replays_every_bar(spark, tiny):
    """Against a replay that analyses every prefix of every series, to the last bar."""
    opened, causes = [], []
    for code, ts, open_, high, low, close in walks(spark, tiny):
        seen = set()
        for n in range(1, len(ts) + 1):
            found = [g for g in kernel.analyse(high[:n], low[:n], close[:n], "day", "loose").signals if g.status == kernel.CONFIRMED]
            fresh = {(g.kind, ts[g.src], round(g.price, 4)): g.kind for g in found if (g.kind, ts[g.src], round(g.price, 4)) not in seen}
            seen |= set(fresh)
            causes += [(code, ts[n - 1], k, i) for i, k in enumerate(fresh.values()) if n > 1]
        opened += [(code, t, o / 1e9, c / 1e9) for t, o, c in zip(ts, open_, close)]
    opened, causes = pd.DataFrame(opened, columns=["code", "ts", "open", "close"]), pd.DataFrame(causes, columns=["code", "ts", "kind", "seq"])
    want = backtest.run_ledger(opened, causes, backtest.signal_strategy(), 100_000.0)["equity"]
    got = structural.QUERIES["backtest_signals"](spark, tiny).toPandas().sort_values("ts")
    assert got["ts"].tolist() == sorted(opened["ts"].unique()) and got["ts"].max() > "2001"
    assert got["equity"].tolist() == pytest.approx([x["equity"] for x in want], abs=1e-3)


def test_first_visible_signals_look_at_every_bar(spark, tiny):
    """Against an analysis of every prefix; only what the first bar shows is left out."""
    want = set()
    for code, ts, _, high, low, close in walks(spark, tiny):
        seen = {}
        for n in range(1, len(ts) + 1):
            for g in kernel.analyse(high[:n], low[:n], close[:n], "day", "loose").signals:
                seen.setdefault((code, g.kind, ts[g.src], round(g.price, 4)), ts[n - 1])
        want |= {(*k, t) for k, t in seen.items() if t > ts[0]}
    got = structural.QUERIES["first_visible_signals"](spark, tiny)
    assert want and rows(got) == sorted(want)


def test_first_visible_primes_with_the_first_bar(spark):
    """What the first checkpoint with a signal shows is new, unless it is the series' first bar."""
    seen = spark.createDataFrame([("a", "x", "2"), ("a", "y", "3"), ("a", "x", "3"), ("b", "x", "1")], "code string, kind string, checkpoint string")
    b = spark.createDataFrame([(c, t) for c in "ab" for t in "123"], "code string, ts string")
    assert rows(pit.first_visible(seen, b, ["code", "kind"])) == [("a", "x", "2"), ("a", "y", "3")]


def test_day_binary_import_holds_every_code(spark, tiny):
    """Every line-item bar comes back: prices in units, codes by their file's digits."""
    want = [(f"60000{ord(x['code']) % 10}", x["ts"], *(int(x[c]) / 100 for c in ("open", "high", "low", "close")), float(x["volume"])) for x in bars.lineitem_bars(spark, tiny).collect()]
    got = market.QUERIES["day_binary_import"](spark, tiny)
    assert got.where("error is not null").count() == 0
    assert len({x[0] for x in want}) == 3 and rows(got, "code", "ts", "open", "high", "low", "close", "volume") == sorted(want)


def test_market_predicates_take_every_row(spark, tiny, monkeypatch):
    """Rows go by their spelling, not by their part key's residue."""
    given = spark.createDataFrame([(4, "sh600000"), (5, " 000001.SZ"), (10, "sh.600000.sz"), (11, "x600000"), (0, "600000")], "p_partkey long, text string")
    monkeypatch.setattr(market, "_codes", lambda spark, d: given)
    assert rows(market.QUERIES["market_predicates"](spark, tiny), "p_partkey", "market") == [(0, "sh"), (4, "sh"), (5, "sz")]


def test_lookups(spark):
    from ridgeline.operators import lookups

    saved = spark.createDataFrame([(1, "2026-01-02", "a", 1.0), (2, "2026-01-02", "b", 3.0), (3, "2026-01-03", "c", 2.0)], "id long, scan_date string, code string, strength double")
    assert [r["id"] for r in lookups.scan_results(saved, "2026-01-02").collect()] == [2, 1]
    assert [r["id"] for r in lookups.scan_results(saved, limit=2).collect()] == [3, 2]
    days = spark.createDataFrame([("2026-01-05",), ("2026-01-07",)], "day string").select(F.to_date("day").alias("day"))
    assert [(str(r["day"]), r["source"]) for r in lookups.trading_calendar(days, "2026-01-01", "2026-01-31").orderBy("day").collect()] == [("2026-01-05", "cache"), ("2026-01-07", "cache")]
    assert lookups.trading_calendar(days, "2026-02-02", "2026-02-08").count() == 5
    routes = spark.createDataFrame([("sh.000001", "5"), ("sh.000001", "day"), ("600000", "1"), ("600000", "5"), ("hk.hsi", "day"), ("us.dji", "day"), ("sw.801120", "day")], "code string, period string")
    assert [r[0] for r in routes.select(lookups.source_route(F.col("code"), F.col("period"))).collect()] == ["pytdx", "baostock", "pytdx", "baostock", "tencent", "sina", "sw"]
    spans = spark.createDataFrame([("a", 0, 1, 1, 3), ("a", 1, -1, 3, 5)], "code string, idx int, direction int, src_start int, src_end int")
    lines = spark.createDataFrame([("a", i, v) for i, v in enumerate((9.0, 2.0, 5.0, 5.0, 1.0, 1.0, 0.0))], "code string, i int, dif double")
    assert rows(lookups.dif_extremes(spans, lines)) == [("a", 0, 5.0, 2, 2.0, 1, 5.0), ("a", 1, 5.0, 3, 1.0, 4, 1.0)]
    mine = spark.createDataFrame([("a", "A", 3, "x"), ("b", "B", None, "y")], "code string, name string, sort_order int, added_at string")
    new = spark.createDataFrame([("b", "B", 0, "z"), ("c", "C", 1, "z")], "code string, name string, pos int, added_at string")
    assert rows(lookups.add_watch(mine, new), "code", "sort_order") == [("a", 3), ("b", None), ("c", 4)]
    assert rows(lookups.add_watch(mine, new, replace=True), "code", "sort_order") == [("b", 0), ("c", 1)]
    assert rows(lookups.remove_watch(mine, "a"), "code") == [("b",)]


def test_market_scan_outcomes(spark):
    """One series lacks history, one a sync row, one fails; the rest go on."""
    import math

    b = [(c, "day", f"{2000 + i // 360:04d}-{i % 360 // 30 + 1:02d}-{i % 30 + 1:02d}", 10 + 2 * math.sin(i / 4), 9 + 2 * math.sin(i / 4), 9.5) for c in ("a", "b", "c") for i in range(400)]
    bars_ = spark.createDataFrame(b, "code string, period string, ts string, high double, low double, close double")
    sync = spark.createDataFrame([("a", "day", "2000-01-01", "2001-02-10"), ("b", "day", "x", "2001-02-10")], "code string, period string, sync_start string, sync_end string")
    got = {r["code"]: (r["outcome"], r["reason"]) for r in scan.market_scan(bars_, sync)[0].collect()}
    assert got["b"] == ("insufficient", "history too short") and got["c"] == ("insufficient", "never synchronised") and got["a"][0] in ("none", "hit")
