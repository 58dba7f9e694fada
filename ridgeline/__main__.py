"""python -m ridgeline ROOT COMMAND ...: the service on a command line; results are JSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ridgeline.service import PERIODS, NotFound, Service, backtest_report, to_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ridgeline")
    p.add_argument("root", help="the store")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *codes, **options):
        s = sub.add_parser(name)
        for c in codes:
            s.add_argument(c, **({"nargs": "+"} if c == "codes" else {}))
        for k, v in options.items():
            choices = {"period": PERIODS, "mode": ("strict", "loose"), "basis": ("raw", "qfq", "hfq"), "strategy": ("signals", "fractal")}.get(k)
            s.add_argument(f"--{k}", default=v, type=int if isinstance(v, int) else str, choices=choices)

    add("bars", "code", period="day", basis="qfq", limit=500, ma="5,10,20")
    add("structure", "code", period="day", basis="qfq", mode="strict", limit=250)
    add("levels", "code", period="day", basis="qfq")
    add("signal-trail", "code", period="day", step=20, mode="strict")
    add("scan", periods="day", codes="", mode="strict", limit=100, **{"run-date": None})
    add("scan-results", **{"run-date": None})
    add("track", periods="day", codes="", mode="strict")
    add("freeze", period="day", mode="strict")
    add("snapshot", "code", period="day")
    add("backtest", "codes", period="day", strategy="signals", mode="strict", start=None, end=None, form="json")
    add("search", "text", limit=20)
    add("watchlist")
    add("freshness")
    add("import-packages", "folder", periods="day,5,1", markets="sh,sz,bj", kinds="stock,index", **{"allow-unverified": "no"}, errors=100)
    add("import-text", "folder", errors=100)
    return p


def run(spark: SparkSession, argv: list[str]):
    a = parser().parse_args(argv)
    s = Service(spark, a.root)
    if a.command == "bars":
        return s.bars(a.code, a.period, a.basis, a.limit, a.ma)
    if a.command == "structure":
        return s.structure(a.code, a.period, a.mode, a.basis, a.limit)
    if a.command == "levels":
        t = s.structure(a.code, a.period, "strict", a.basis)
        return {k: [{x: r.get(x) for x in ("level", "depth", "kind", "ts", "end_ts")} for r in t.get(k, [])] for k in ("pivot", "trend")}
    if a.command == "signal-trail":
        return s.trail(a.code, a.period, a.step, a.mode)
    several = lambda text: [x for x in text.split(",") if x]
    if a.command == "scan":
        return s.scan(several(a.periods), a.mode, a.limit, several(a.codes), a.run_date)
    if a.command == "scan-results":
        return s.scan_results(a.run_date)
    if a.command == "track":
        return s.track(several(a.codes), several(a.periods), a.mode)
    if a.command == "freeze":
        return {"kept": s.freeze(a.period, a.mode)}
    if a.command == "snapshot":
        return s.snapshot(a.code, a.period)
    if a.command == "backtest":
        got = s.backtest(a.codes, a.period, a.strategy, a.mode, start=a.start, end=a.end)
        return backtest_report(got, a.codes, a.strategy, a.start, a.end) if a.form == "text" else got
    if a.command == "search":
        return s.search(a.text, a.limit)
    if a.command in ("watchlist", "freshness"):
        return getattr(s, a.command)()
    from ridgeline.sources import bars, packages, texts

    if a.command == "import-text":
        got, ledger = texts.import_texts(texts.read_texts(spark, a.folder))
    else:
        got, ledger = packages.import_packages(spark, a.folder, tuple(a.periods.split(",")), tuple(a.markets.split(",")), tuple(a.kinds.split(",")), allow_unverified=a.allow_unverified == "yes")
    bars.write_bars(got, f"{a.root}/bars")
    counts = {r["status"]: r["n"] for r in ledger.groupBy("status").agg(F.count("*").alias("n")).collect()}
    worst = ledger.where("status IN ('failed', 'unverified')").orderBy("path").limit(a.errors).collect()
    return {"files": counts, "rows": ledger.agg(F.sum("rows")).first()[0], "errors": [r.asDict() for r in worst]}


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("ridgeline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        got = run(spark, sys.argv[1:] if argv is None else argv)
        print(got if isinstance(got, str) else to_json(got))
    except (NotFound, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
