import pytest

from ridgeline.plans import registry
from tests.oracle import connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tiny, duck, name):
    same(QUERIES[name](spark, tiny), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert df.columns
    df.collect()


def test_no_segment_problem(spark, tiny):
    assert QUERIES["segment_problems"](spark, tiny).count() == 0


def test_stream_equals_batch(spark, tiny):
    pick = ["code", "src_start", "src_end", "status"]
    stream = {tuple(r) for r in QUERIES["stream_step_equiv"](spark, tiny).select(*pick).collect()}
    # a segment that was confirmed once stays so: the spans must agree, and what the batch confirms is confirmed
    batch = {tuple(r) for r in QUERIES["segments"](spark, tiny).select(*pick).collect()}
    assert {r[:3] for r in stream} == {r[:3] for r in batch}
    assert {r for r in batch if r[3] == "confirmed"} <= stream


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scan_pushdown(spark, tiny):
    """Only the columns that bars need are read, and the filter reaches the scan."""
    from ridgeline.sources import bars

    plan = bars.lineitem_bars(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,0.0)" in plan
