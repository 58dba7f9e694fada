"""Text in many dialects, and zip packages: every line and every member comes out, as bars or with a reason."""

import struct
import zipfile

import duckdb
import pytest

from ridgeline.sources import packages, texts
from ridgeline.sources.files import FormatError, parse_minute
from ridgeline.sources.shared import paths_below
from ridgeline.sources.texts import parse_text
from tests.oracle import same

DAILY = "日期,开盘价(元),最高价,最低价,收盘价,成交量(手)\n2026-09-30,10,11,9,10.5,100\n2026-10-08,10.5,12,10,11,200\n"


def written(text):
    return parse_text(text)[["ts", "open", "high", "low", "close"]].values.tolist()


def test_titles_units_and_blank_lines():
    got = parse_text("600000 浦发银行 日线 前复权\n\n" + DAILY.replace("\n", "\n\n") + "数据来源:某客户端\n")
    assert got["ts"].tolist() == ["2026-09-30", "2026-10-08"] and got["volume"].tolist() == [100, 200]


@pytest.mark.parametrize("sep", [",", "\t", ";", "|", "  "])
def test_separators_and_names(sep):
    text = "\n".join(sep.join(x) for x in (("Close", "trade_date", "Open", "High", "Low", "vol"), ("1.5", "2026/09/30", "1", "2", "0.5", "10"), ("1.2", "20261008", "1", "2", "0.5", "--")))
    got = parse_text(text)
    assert got["ts"].tolist() == ["2026-09-30", "2026-10-08"] and got["close"].tolist() == [1.5, 1.2] and got["volume"].tolist() == [10, 0]


@pytest.mark.parametrize("clock,want", [("0935", "09:35"), ("935", "09:35"), ("09:35", "09:35"), ("09:35:00", "09:35")])
def test_times(clock, want):
    assert written(f"日期,时间,开盘,最高,最低,收盘\n2026-09-30,{clock},1,2,0.5,1.5\n")[0][0] == f"2026-09-30 {want}"


def test_date_columns_without_a_name():
    assert written(",开盘,最高,最低,收盘\n2026-09-30,1,2,0.5,1.5\n") == [["2026-09-30", 1, 2, 0.5, 1.5]]
    assert written(" 开盘 最高 最低 收盘\n2026-09-30 1 2 0.5 1.5\n2026-10-08 2 3 1 2\n")[1] == ["2026-10-08", 2, 3, 1, 2]  # one cell wider than its header
    assert written("when,open,high,low,close\n2026-09-30,1,2,0.5,1.5\n2026-10-08,1,2,0.5,1.5\n")[0][0] == "2026-09-30"
    for bad in ("when,open,high,low,close\n2026-09-30,1,2,0.5,1.5\n", "开盘 最高 最低 收盘\nx 1 2 0.5 1.5\ny 1 2 0.5 1.5\n"):
        with pytest.raises(FormatError, match="no column of dates"):
            parse_text(bad)


@pytest.mark.parametrize("text,why", [
    ("", "no header"), ("a,b\n1,2", "no header"), (DAILY.replace("收盘价", "x"), "no header"), (DAILY.splitlines()[0], "no line is a bar"), (DAILY.replace("10.5,100", "abc,100"), "close 'abc' is not a number"),
    (DAILY.replace("10,11,9", "10,9.5,9"), "out of order"), (DAILY.replace("2026-10-08", "soon"), "no time in 'soon'"), (DAILY.replace("2026-09-30,10,11,9,10.5", "2026-09-30,0,0,0,0").replace("2026-10-08,10.5,12,10,11", "2026-10-08,0,0,0,0"), "no line is a bar"),
])
def test_what_must_not_be_passed_over(text, why):
    with pytest.raises(FormatError, match=why):
        parse_text(text)


def test_the_last_line_of_a_time_counts_and_zero_prices_go():
    assert written(DAILY + "2026-10-08,10.5,12,10,11.5,1\n2026-10-09,0,0,0,0,0\n合计,,,,,300\n") == [["2026-09-30", 10, 11, 9, 10.5], ["2026-10-08", 10.5, 12, 10, 11.5]]


@pytest.mark.parametrize("split", [texts.SPLIT, 999])
def test_files_in_splits(spark, tmp_path, split):
    long = "".join(f"{2000 + i // 300}-{i // 28 % 10 + 1:02}-{i % 28 + 1:02},{i + 2},{i + 3},{i + 1},{i + 2},1\r\n" for i in range(280))
    (tmp_path / "600000.csv").write_bytes(("title\n" + DAILY + long).encode("gb18030"))
    (tmp_path / "600001.txt").write_bytes(("﻿" + DAILY + "2026-10-09,0,0,0,0,0\nend\n").encode())
    (tmp_path / "bad.csv").write_text("nothing")
    (tmp_path / "torn.csv").write_bytes(DAILY.encode() + b"2026-10-09,1,2,\xff\xfe,1,1\n2026-10-10,1,2,0.5,1,1\n")
    many = "".join(f"{1900 + i // 300}-{i // 25 % 12 + 1:02}-{i % 25 + 1:02},1,2,0.5,1,1\n" for i in range(20_000)).encode()
    (tmp_path / "late.csv").write_bytes(DAILY.encode() + many + b"2026-10-09,1,2,\xff\xfe,1,1\n2026-10-10,1,2,0.5,1,1\n")
    rows = texts.read_texts(spark, f"file://{tmp_path}", split=split).cache()
    bars, ledger = texts.import_texts(rows)
    got = {r["code"]: r for r in ledger.collect()}
    assert {c: (r["status"], r["rows"], r["dropped"]) for c, r in got.items()} == {"600000": ("imported", 282, 0), "600001": ("imported", 2, 2), "bad": ("failed", 0, 1), "torn": ("failed", 0, 1), "late": ("failed", 20_003, 1)}
    assert "known encoding" in got["torn"]["error"] and "at byte" in got["late"]["error"] and "not in utf-8" in got["late"]["error"] and "no header" in got["bad"]["error"]
    want = parse_text("title\n" + DAILY + long)
    mine = bars.where("code = '600000'").orderBy("ts").toPandas()
    assert mine["ts"].tolist() == want["ts"].tolist() and mine["close"].tolist() == want["close"].tolist()
    assert {r["code"] for r in bars.select("code").distinct().collect()} == {"600000", "600001"}
    assert {(r["error"], r["fatal"], r["line"]) for r in rows.where("code = '600001' AND error IS NOT NULL").collect()} == {("a price that is not above zero", False, "2026-10-09,0,0,0,0,0"), ("1 cells of 6", False, "end")}


def test_lines_are_read_once(spark, tmp_path):
    """Many small files: their lines are made once, for the bars and the ledger, by tasks whose number does not grow with the files."""
    for i in range(300):
        (tmp_path / f"{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 7}" / f"{600000 + i}.csv").write_text(DAILY if i % 3 else DAILY + "2026-10-09,x,1,1,1,1\n")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = texts.read_texts(spark, f"file://{tmp_path}", "*.csv")
    assert rows.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    bars, ledger = texts.import_texts(rows.mapInPandas(count, texts.SCHEMA))
    assert (bars.count(), ledger.where("status = 'failed'").count(), ledger.count()) == (400, 100, 300)
    assert made.value == 700


# --- packages


def day_file(days, close=10.0):
    return b"".join(struct.pack("<IIIIIfII", d, 1000, 1200, 900, round(close * 100), 1e6, 5, 0) for d in days)


def minute_file(days, close=10.0):
    out = b""
    for d in days:
        date = (d // 10000 - 2004) * 2048 + d % 10000
        out += struct.pack("<HHfffffII", date, 575, 10, 12, 9.5, 11, 1e3, 5, 0) + struct.pack("<HHfffffII", date, 580, 11, 11, 9, close, 1e3, 5, 0)
    return out


DAYS = [20260901 + i for i in range(25)]


@pytest.fixture
def package(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("sh\\lday\\sh600000.day", day_file(DAYS))
        z.writestr("sh/lday/sh000001.day", day_file(DAYS[:3]))
        z.writestr("sh/lday/sh600001.day", day_file(DAYS)[:-5])
        z.writestr("sh/lday/sh600002.day", b"")
        z.writestr("sh/lday/sh510300.day", day_file(DAYS))
        z.writestr("bj/lday/bj430047.day", day_file(DAYS))
        z.writestr("bj/lday/bj920047.day", day_file(DAYS))
        z.writestr("readme.txt", "x")
        z.writestr("sh/lday/sz600003.day", day_file(DAYS))
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("sh/fzline/sh600000.lc5", minute_file(DAYS[:2]))
        z.writestr("sh/fzline/sh000001.lc5", minute_file(DAYS[:2], close=10.5))
        z.writestr("sh/fzline/sh600009.lc5", minute_file(DAYS[:2]))
        z.writestr("sh/fzline/sh600010.lc1", struct.pack("<HHfffffII", 22 * 2048 + 901, 575, 0, 0, 0, 0, 0, 0, 0))
    (tmp_path / "broken.zip").write_bytes(b"PK no")
    return f"file://{tmp_path}"


def test_packages(spark, package):
    bars, ledger = packages.import_packages(spark, package)
    got = {(r["member"] or "").replace("\\", "/").split("/")[-1]: r for r in ledger.collect()}
    assert {m: (r["code"], r["kind"], r["status"], r["rows"]) for m, r in got.items()} == {
        "sh600000.day": ("600000", "stock", "imported", 25), "sh000001.day": ("sh.000001", "index", "imported", 3), "sh600001.day": ("600001", "stock", "failed", 0), "sh600002.day": ("600002", "stock", "empty", 0),
        "sh510300.day": ("510300", "fund", "skipped", 0), "bj430047.day": ("430047", "stock", "alias", 25), "bj920047.day": ("920047", "stock", "imported", 25), "readme.txt": (None, None, "skipped", 0), "sz600003.day": (None, None, "skipped", 0),
        "sh600000.lc5": ("600000", "stock", "imported", 4), "sh000001.lc5": ("sh.000001", "index", "unverified", 4), "sh600009.lc5": ("600009", "stock", "unverified", 4), "sh600010.lc1": ("600010", "stock", "failed", 0), "": (None, None, "failed", 0),
    }
    assert got["sh000001.lc5"]["error"] == "2026-09-01 close: minutes make 10.5, the day has 10.0" and "no day bars" in got["sh600009.lc5"]["error"] and "above zero" in got["sh600010.lc1"]["error"]
    assert got["bj430047.day"]["error"] == "goes on as 920047" and "whole number" in got["sh600001.day"]["error"]
    assert {(r["code"], r["period"]): r["n"] for r in bars.groupBy("code", "period").count().withColumnRenamed("count", "n").collect()} == {("600000", "day"): 25, ("sh.000001", "day"): 3, ("920047", "day"): 25, ("600000", "5"): 4}


def test_packages_by_choice(spark, package):
    bars, ledger = packages.import_packages(spark, package, periods=("5",), allow_unverified=True)
    assert {(r["code"], r["period"]) for r in bars.select("code", "period").distinct().collect()} == {("600000", "5"), ("sh.000001", "5"), ("600009", "5")}
    stored = spark.createDataFrame([("600009", f"2026-09-0{d}", 10.0, 12.0, 9.0, 10.0) for d in (1, 2)], "code string, ts string, open double, high double, low double, close double")
    _, ledger = packages.import_packages(spark, package, periods=("5",), codes=("600009",), days=stored)
    assert [(r["code"], r["status"]) for r in ledger.where("status <> 'skipped' AND member IS NOT NULL").collect()] == [("600009", "imported")]


def test_minutes_need_prices():
    with pytest.raises(FormatError, match="above zero"):
        parse_minute(struct.pack("<HHfffffII", 22 * 2048 + 901, 575, 0, 0, 0, 0, 0, 0, 0))


def test_more_customers_than_an_exchange_has_numbers(spark, tiny, tmp_path):
    """Customers whose numbers belong to another market's digits, or have seven of them, are imported all the same."""
    from ridgeline.plans import market

    shifts = "[0, 100000, 200000, 320000, 400000, 5400000]"
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"COPY (SELECT o.* REPLACE (o_orderkey + 10 * s AS o_orderkey, o_custkey + s AS o_custkey) FROM '{tiny}/orders.parquet' o, (SELECT unnest({shifts}) AS s)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    same(market.QUERIES["package_import"](spark, str(tmp_path)), con, market.SQL["package_import"])


def test_files_are_listed_by_level(spark, tmp_path):
    for name in ("a.zip", "x/b.zip", "x/y/c.zip", "x/y/d.csv", "x/_skipped/e.zip", "x/.f.zip", "k=1/_g=2/h.zip"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    (tmp_path / "empty.zip").touch()
    got = {(r["path"].removeprefix(f"file://{tmp_path}/"), r["length"]) for r in paths_below(spark, f"file://{tmp_path}", "*.zip").collect()}
    assert got == {(n, 2) for n in ("a.zip", "x/b.zip", "x/y/c.zip", "k=1/_g=2/h.zip")}
    assert [r["length"] for r in paths_below(spark, f"{tmp_path}/x/b.zip").collect()] == [2]
