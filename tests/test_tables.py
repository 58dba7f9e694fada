from ridgeline.functions import tables
from ridgeline.operators import structure
from ridgeline.sources import bars


def test_table_function_is_the_operator(spark, tiny):
    b = bars.order_walk_bars(spark, tiny).where("code = '2-HIGH'").selectExpr("code", "ts", "high", "low", "close")
    b.createOrReplaceTempView("some_bars")
    tables.register(spark)
    pick = "layer, depth, idx, kind, ts, src_start, src_end, status, confirmed_at"
    got = spark.sql(f"SELECT {pick} FROM structure(TABLE(some_bars) PARTITION BY code ORDER BY ts)")
    want = structure.structure(b).selectExpr(*pick.split(", "))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
