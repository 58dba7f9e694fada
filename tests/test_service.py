import pytest
from pyspark.sql import functions as F

from ridgeline.__main__ import run
from ridgeline.operators import sync
from ridgeline.service import NotFound, Service
from ridgeline.sources import bars


@pytest.fixture(scope="module")
def root(spark, tiny, tmp_path_factory):
    base = tmp_path_factory.mktemp("store")
    b = bars.order_walk_bars(spark, tiny).where("code IN ('1-URGENT', '2-HIGH')")
    code = F.when(F.col("code") == "2-HIGH", "600000").otherwise("sh.000001")
    prices = {c: F.col(c) / 1e9 for c in bars.PRICES}
    b = b.withColumns(prices).withColumns({"code": code, "period": F.lit("day"), "volume": F.col("volume").cast("double"), "amount": F.col("amount").cast("double")})
    bars.write_bars(b, f"file://{base}/bars")
    spark.createDataFrame([("600000", "first bank"), ("600001", "second")], "code string, name string").write.parquet(f"file://{base}/universe")
    spark.createDataFrame([("600000", "1995-06-01", 0.5), ("600000", "1997-01-01", 1.0)], "code string, ts string, k double").write.parquet(f"file://{base}/factors")
    return f"file://{base}"


def test_service(spark, root):
    s = Service(spark, root)
    got = s.bars("sh600000", limit=10)
    assert len(got["bars"]) == 10 and got["bars"][-1]["ma5"] is not None
    raw = s.bars("600000", mode="raw", limit=10_000)["bars"]
    qfq = {r["ts"]: r["close"] for r in s.bars("600000", limit=10_000)["bars"]}
    assert all(abs(qfq[r["ts"]] - r["close"] * (1 if r["ts"] >= "1997" else 0.5)) < 1e-3 for r in raw)
    week = s.structure("600000", "week")
    assert week["merged"] and week["period"] == "week"
    whole, part = s.structure("600000"), s.structure("600000", limit=60)
    known = {(r["idx"], r["src_start"]) for r in whole["stroke"]}
    assert {(r["idx"], r["src_start"]) for r in part.get("stroke", [])} < known
    assert s.search("600")[0]["name"] == "first bank"
    assert isinstance(s.trail("600000", step=100, mode="loose"), list)
    got = s.scan(["day", "30"], mode="loose", run_date="2026-01-01")
    assert all(h["strength"] >= 0 and h["period"] == "day" for h in got["hits"]) and sum(got["outcomes"].values()) == 6  # three codes, two periods
    assert got["outcomes"]["30 insufficient"] == 3 and got["reasons"]["never synchronised"] == 4
    assert len(s.scan_results("2026-01-01")) == len({(h["code"], h["kind"], h["ts"]) for h in got["hits"]})
    told = s.track(["600000", "600001"])
    assert {(r["code"], r["change"] or r["reason"]) for r in told} == {("600000", "FIRST_SNAPSHOT"), ("600001", "no bars")}
    assert {r["change"] for r in s.track(["600000"])} == {"NO_CHANGE"}
    assert s.freeze() == 2 and s.snapshot("600000")["version"] == 1
    span = s.backtest(["sh.000001", "600000"], strategy="fractal", start="1996-01-01", end="1997-12-31")
    assert span["final_equity"] > 0
    assert s.backtest(["600000", "sh.000001"], strategy="fractal")["metrics"][0]["n"] > 0
    assert len(s.freshness()) == 2 and s.watchlist() == []
    for bad in (lambda: s.bars("zz"), lambda: s.bars("600000", "3")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotFound):
        s.bars("600009")


def test_commands(spark, root, tmp_path):
    assert run(spark, [root, "bars", "600000", "--limit", "3"])["bars"]
    assert "pivot" in run(spark, [root, "levels", "600000"])
    text = run(spark, [root, "backtest", "600000", "--strategy", "fractal", "--form", "text", "--start", "1996-01-01"])
    assert "strategy fractal, codes 600000, span 1996-01-01 to open" in text and "fractal_bottom:" in text and "largest fall" in text
    (tmp_path / "600010.csv").write_text("date,open,high,low,close\n2026-01-05,1,2,0.5,1.5\n")
    (tmp_path / "x.csv").write_text("nothing")
    got = run(spark, [f"file://{tmp_path}/new", "import-text", f"file://{tmp_path}"])
    assert len(got["errors"]) == 1
    assert run(spark, [f"file://{tmp_path}/new", "freshness"])[0]["last_ts"] == "2026-01-05"


def test_sync(spark):
    cal = spark.sql("SELECT explode(sequence(DATE'2026-01-01', DATE'2026-01-31')) AS day").where("weekday(day) < 5")
    s = spark.createDataFrame([("a", "day", "2026-01-02"), ("b", "day", None), ("c", "day", "2026-01-30"), ("d", "day", "2026-01-03")], "code string, period string, last_ts string")
    got = dict(sync.next_start(s, cal, "2020-01-01", "2026-01-31").select("code", "start").collect())
    assert got == {"a": "2026-01-05", "b": "2020-01-01", "c": None, "d": "2026-01-04"}
    st = "code string, period string, start_ts string, end_ts string, rows long, error string"
    before = spark.createDataFrame([("a", "day", "1", "5", 5, None), ("b", "day", "1", "5", 5, "old")], st)
    ran = spark.createDataFrame([("a", "day", "6", "9", 4, None), ("b", "day", None, None, 0, None), ("c", "day", None, None, None, "boom")], st)
    got = {r["code"]: tuple(r)[2:] for r in sync.ledger(before, ran).collect()}
    assert got == {"a": ("1", "9", 4, None), "b": ("1", "5", 5, None), "c": (None, None, None, "boom")}
    results = spark.createDataFrame([("day", i, i < 3 or i == 10) for i in range(40)], "period string, seq int, ok boolean")
    assert sync.too_many_failures(results, 5).collect()[0]["at"] == 7
    assert sync.too_many_failures(results, 30).count() == 0
    assert sync.sample(s, 2).collect() == sync.sample(s, 2).collect()
    w = spark.createDataFrame([("a", "2026-01-02"), ("a", "2026-01-09")], "code string, ts string")
    assert sync.drop_open_tail(w, "week", "2026-01-10").count() == 1
    old = spark.createDataFrame([("a", "1", 1.0)], "code string, ts string, close double")
    store, added = sync.ingest(old, spark.createDataFrame([("a", "1", 2.0), ("a", "2", 3.0)], "code string, ts string, close double"), ["code", "ts"])
    assert sorted(map(tuple, store.collect())) == [("a", "1", 2.0), ("a", "2", 3.0)] and added.collect()[0]["added"] == 1
