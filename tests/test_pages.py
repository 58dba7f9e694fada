"""Recorded vendor pages: walked from the newest to the oldest, of a time the newest page counts."""

import json

import pytest
from pyspark.sql import functions as F

from ridgeline.sources import pages
from ridgeline.sources.pages import PageError, bar_of, payload

DAYS = [f"2024-{m:02}-{d:02}" for m in range(1, 7) for d in range(1, 29)]


def array(i, close=None):
    return [DAYS[i], "10", str(close or 11 + i), str(12 + i), "9", "100", {}, "0.1", "2.5"]


@pytest.fixture
def recording(tmp_path):
    """a: pages of 60 rows that overlap by 10, the newer with other closes; b: one JSONP page; c: too short; d: torn."""
    a = tmp_path / "a"
    a.mkdir()
    for k, stop in enumerate(range(len(DAYS), 0, -50)):
        part = range(max(0, stop - 60), stop)
        (a / f"{DAYS[stop - 1]}.json").write_text(json.dumps({"rows": [array(i, 500 if k == 0 else None) for i in part]}))
    (tmp_path / "b").mkdir()
    rows = [{"d": f"{d} 10:00:00", "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "7"} for d in DAYS] + [{"d": DAYS[0], "o": "x"}, {"d": "2025-01-01", "o": "0", "h": "0", "l": "0", "c": "0"}]
    (tmp_path / "b" / "2024-12-31.jsonp").write_text(f"/*<script>*/\nvar _b_=({json.dumps(rows)});")
    for name, text in (("c", json.dumps([array(0)])), ("d", "{torn")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "2024-12-31.json").write_text(text)
    return f"file://{tmp_path}"


def test_batch(spark, recording):
    df = pages.register(spark).read.format("vendor_pages").load(recording)
    got = {r["code"]: r["n"] for r in df.where("error IS NULL").groupBy("code").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": len(DAYS), "b": len(DAYS)}
    assert {(r["code"], r["error"]) for r in df.where("error IS NOT NULL").collect()} == {("c", "1 rows, fewer than 30"), ("d", df.where("code = 'd'").first()["error"])}
    a = {r["ts"]: r for r in df.where("code = 'a'").collect()}
    assert a[DAYS[-60]]["close"] == 500 and a[DAYS[-61]]["close"] == 11 + len(DAYS) - 61  # the newer page counts
    assert a[DAYS[0]]["amount"] == 25_000 and a[DAYS[0]]["high"] == 12
    assert df.where("code = 'b'").orderBy("ts").first()["ts"] == "2024-01-01 10:00"


def test_spans_and_symbols(spark, recording):
    df = pages.register(spark).read.format("vendor_pages").option("symbols", "a,none").option("start", DAYS[-5]).option("end", DAYS[-2]).load(recording)
    assert [r["ts"] for r in df.where("code = 'a'").orderBy("ts").collect()] == []  # its pages were asked for by a later day, or are older
    df = pages.register(spark).read.format("vendor_pages").option("symbols", "a,none").option("start", DAYS[-5]).option("end", DAYS[-1]).load(recording)
    assert [r["ts"] for r in df.where("code = 'a'").orderBy("ts").collect()] == DAYS[-5:]  # four rows are right: sixty were answered
    assert df.where("code = 'none'").first()["error"] == "0 rows, fewer than 30"


def test_stream_goes_back_a_page_a_batch(spark, recording, tmp_path):
    out = f"file://{tmp_path}/out"
    q = pages.register(spark).readStream.format("vendor_pages").option("symbols", "a,b,d").load(recording).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").start()
    try:
        q.processAllAvailable()
        n = len(q.recentProgress)
    finally:
        q.stop()
    df = spark.read.parquet(out)
    want = pages.register(spark).read.format("vendor_pages").option("symbols", "a,b").load(recording)
    keep = ["code", "ts", "close", "page"]
    assert sorted(map(tuple, df.where("error IS NULL").select(keep).collect())) == sorted(map(tuple, want.select(keep).collect()))
    assert df.where("error IS NOT NULL").count() == 1 and n >= 4


def test_answers():
    assert payload("var x=(null);", "jsonp") == [] and payload('{"rows": [1]}', "json") == [1]
    for text, kind in (("callback([])", "jsonp"), ("{", "json"), ("3", "json")):
        with pytest.raises(PageError):
            payload(text, kind)
    assert bar_of(["2024-01-02", "1", "2", "3"]) is None and bar_of(None) is None and bar_of(["2024-01-02", "1", "1", "1", "1", "5"])[1] == (1, 1, 1, 1, 5, 0)
