"""What a caller asks of one store: bars, structure, trails, scans, lists. Results are plain dicts and lists.

The store is ``root/bars`` (see ``sources.bars``) and the tables
``root/{factors,universe,watchlist,sync_state}``, each optional.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import codes
from ridgeline.operators import adjust, backtest, indicators, meta, persist, scan, structure
from ridgeline.operators.structure import layer
from ridgeline.sources import bars as store

PERIODS = ("1", "5", "15", "30", "60", "day", "week", "month")


class NotFound(LookupError):
    """Nothing is stored for what was asked."""


class Service:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def code(self, text: str) -> str:
        key = self.spark.range(1).select(codes.normalize_code(F.lit(text)).alias("k")).first()["k"]
        if key is None:
            raise ValueError(f"no code: {text!r}")
        return key

    def frame(self, code: str, period: str, mode: str = "qfq") -> DataFrame:
        """The whole series in a basis; weeks and months are made from adjusted days."""
        if period not in PERIODS:
            raise ValueError(f"no period: {period!r}")
        base = "day" if period in ("week", "month") else period
        b = store.read_bars(self.spark, f"{self.root}/bars", self.code(code), base).drop("market", "period")
        b = adjust.adjust(b, self.table("factors", "code string, ts string, k double").select("code", "ts", "k"), mode)
        return adjust.resample(b, period) if base != period else b

    def bars(self, code: str, period: str = "day", mode: str = "qfq", limit: int = 500, ma: str = "5,10,20") -> dict:
        b = self.frame(code, period, mode)
        lines = indicators.moving_averages(b, indicators.parse_ma(ma)).drop("close")
        rows = [r.asDict() for r in b.join(lines, ["code", "ts"]).orderBy(F.desc("ts")).limit(limit).collect()][::-1]
        if not rows:
            raise NotFound(code)
        return {"code": self.code(code), "period": period, "adjust": mode, "bars": rows, "change": [r.asDict() for r in indicators.price_change(b).collect()]}

    def structure(self, code: str, period: str = "day", mode: str = "strict", basis: str = "qfq", limit: int | None = None) -> dict:
        """The structure of the whole series, shown for the last ``limit`` bars."""
        b = self.frame(code, period, basis)
        t = structure.structure(b, level=period, mode=mode)
        if limit is not None:
            edge = b.agg(F.min_by("ts", "ts")).first() and [r["ts"] for r in b.select("ts").orderBy(F.desc("ts")).limit(limit).collect()]
            if edge:
                t = structure.clip(t, edge[-1], edge[0])
        out: dict = {}
        for r in t.orderBy("depth", "layer", "idx").collect():
            row = {k: v for k, v in r.asDict().items() if v is not None and k not in ("code", "layer")}
            out.setdefault(r["layer"], []).append(row)
        if not out:
            raise NotFound(code)
        return {"code": self.code(code), "period": period, "mode": mode} | out

    def trail(self, code: str, period: str = "day", step: int = 20, mode: str = "strict") -> list[dict]:
        from pyspark.sql import Window

        b = self.frame(code, period)
        n, last = F.row_number().over(Window.partitionBy("code").orderBy("ts")), F.count("*").over(Window.partitionBy("code"))
        marks = b.select("code", "ts", n.alias("n"), last.alias("last")).where((F.col("n") % step == 0) | (F.col("n") == F.col("last"))).select("code", F.col("ts").alias("checkpoint"))
        return [r.asDict() for r in structure.trail(structure.checkpoints(b, step, period, mode), marks).orderBy("first_seen", "kind").collect()]

    def search(self, text: str, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in meta.search(self.table("universe", "code string, name string"), text, limit).collect()]

    def synced(self) -> DataFrame:
        """How far each series is: what a sync noted, else what the store holds."""
        noted = persist.opened(self.spark, self.root, "sync_state").read().select("code", "period", F.col("start_ts").alias("n_start"), F.col("end_ts").alias("n_end"))
        held = self.spark.read.parquet(f"{self.root}/bars").groupBy("code", "period").agg(F.min("ts").alias("h_start"), F.max("ts").alias("h_end"))
        return held.join(noted, ["code", "period"], "full_outer").select("code", "period", F.coalesce("n_start", "h_start").alias("sync_start"), F.coalesce("n_end", "h_end").alias("sync_end"))

    def listed(self, wanted: list[str] | None) -> DataFrame:
        """code, name: the codes that are asked for, or the universe, or what the store holds if there is none."""
        names = self.table("universe", "code string, name string").select("code", "name")
        if wanted:
            return self.spark.createDataFrame([(self.code(c),) for c in wanted], "code string").join(names, "code", "left")
        held = self.spark.read.parquet(f"{self.root}/bars").select("code").distinct()
        return names.union(held.join(names, "code", "left_anti").select("code", F.lit("")))

    def scan(self, periods=("day",), mode: str = "strict", limit: int = 100, wanted: list[str] | None = None, run_date: str | None = None) -> dict:
        """Every listed code on every period: outcomes, and the strongest hits; ``run_date`` keeps the hits."""
        periods = [periods] if isinstance(periods, str) else list(periods)
        if any(p not in PERIODS for p in periods):
            raise ValueError(f"no such periods: {periods!r}")
        b = self.spark.read.parquet(f"{self.root}/bars").where(F.col("period").isin(*periods)).select("code", "period", "ts", "high", "low", "close")
        outcomes, hits = scan.market_scan(b, self.synced(), mode, tasks=scan.tasks_of(self.listed(wanted), periods))
        if run_date:
            persist.save_hits(self.spark, self.root, hits, run_date)
        counts = {f"{r['period']} {r['outcome']}": r["n"] for r in outcomes.groupBy("period", "outcome").agg(F.count("*").alias("n")).collect()}
        reasons = {r["reason"]: r["n"] for r in outcomes.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).collect()}
        return {"outcomes": counts, "reasons": reasons, "hits": [r.asDict() for r in scan.in_order(hits).limit(limit).collect()]}

    def scan_results(self, run_date: str | None = None) -> list[dict]:
        return [r.asDict() for r in persist.saved_hits(self.spark, self.root, run_date).collect()]

    def track(self, wanted: list[str] | None = None, periods=("day",), mode: str = "strict", keep: bool = True) -> list[dict]:
        """What changed since the last run in each series of the watchlist (or of the codes that are asked for)."""
        names = self.table("watchlist", "code string, name string, sort_order int, added_at string").select("code", "name") if not wanted else self.listed(wanted)
        tasks = scan.tasks_of(names, list(periods))
        b = self.spark.read.parquet(f"{self.root}/bars").select("code", "period", "ts", "high", "low", "close").join(tasks.select("code", "period"), ["code", "period"], "left_semi")
        rows = persist.run_track(self.spark, self.root, b, self.synced(), mode, keep)
        missing = tasks.join(rows.select("code", "period").distinct(), ["code", "period"], "left_anti").select("code", "period", F.lit("insufficient").alias("status"), *(F.lit(None).cast("string").alias(c) for c in ("as_of", "prev_as_of", "change", "item")), F.lit("no bars").alias("reason"))
        return [r.asDict() for r in rows.union(missing).join(tasks, ["code", "period"], "left").orderBy("code", "period", "change", "item").collect()]

    def freeze(self, period: str = "day", mode: str = "strict") -> int:
        """Keeps the snapshot of every stored series of a period; returns how many are kept."""
        b = store.read_bars(self.spark, f"{self.root}/bars", period=period)
        persist.save_snapshots(self.spark, self.root, structure.structure(b, level=period, mode=mode), b.groupBy("code", "period").agg(F.max("ts").alias("as_of")))
        return persist.opened(self.spark, self.root, "structure_snapshot").read().where(F.col("period") == period).count()

    def snapshot(self, code: str, period: str = "day") -> dict:
        got = persist.opened(self.spark, self.root, "structure_snapshot").get(code=self.code(code), period=period).first()
        if got is None:
            raise NotFound(code)
        return got.asDict() | {"payload": json.loads(got["payload"])}

    def watchlist(self) -> list[dict]:
        w = self.table("watchlist", "code string, name string, sort_order int, added_at string")
        return [r.asDict() for r in meta.ordered_watchlist(w).orderBy("place").collect()]

    def backtest(self, wanted: list[str], period: str = "day", strategy: str = "signals", mode: str = "strict", cash: float = 100_000.0, start: str | None = None, end: str | None = None) -> dict:
        """A replay of a span over codes in the order in which they are given."""
        b = None
        for place, c in enumerate(wanted):
            one = self.frame(c, period).withColumn("place", F.lit(place))
            b = one if b is None else b.union(one)
        if strategy == "signals":
            causes = backtest.visible_signals(b, period, mode, start, end).select(F.lit("run").alias("run"), "code", "ts", "kind", "seq")
        else:
            f = structure.structure(b, level=period, layers=("fractal",)).where("layer = 'fractal'")
            causes = f.select(F.lit("run").alias("run"), "code", F.col("confirmed_at").alias("ts"), "kind", F.col("idx").alias("seq"))
        led = backtest.backtest(b.select(F.lit("run").alias("run"), "code", "ts", "open", "close", "place"), causes, strategy, cash, start, end).persist()
        trips = layer(led, "trip")
        out = {"metrics": [r.asDict() for r in backtest.trip_metrics(trips, ["run"]).collect()], "by_signal": [r.asDict() for r in backtest.trip_metrics(trips, ["signal_kind"]).collect()]}
        eq = layer(led, "equity").select(F.col("run").alias("key"), "ts", "equity")
        out["drawdown"] = [r.asDict() for r in indicators.max_drawdown(eq).collect()]
        out["final_equity"] = eq.agg(F.max_by("equity", "ts")).first()[0]
        out["benchmark"] = [r.asDict() for r in backtest.benchmark_return(b).collect()]
        led.unpersist()
        return out

    def freshness(self) -> list[dict]:
        return [r.asDict() for r in store.last_ts(self.spark.read.parquet(f"{self.root}/bars")).orderBy("code", "period").collect()]


def backtest_report(got: dict, wanted: list[str], strategy: str, start: str | None = None, end: str | None = None, cash: float = 100_000.0) -> str:
    """A backtest's result as text: span, money, risk, round trips by signal, benchmark."""
    show = lambda v, form="{:,.2f}": "-" if v is None else form.format(v)
    m = (got["metrics"] or [{}])[0]
    fall = (got["drawdown"] or [{}])[0]
    final = got["final_equity"]
    lines = [
        f"strategy {strategy}, codes {', '.join(wanted)}, span {start or 'open'} to {end or 'open'}",
        f"cash {show(cash)}, at the end {show(final)}, return {show(None if final is None else final / cash - 1, '{:+.2%}')}",
        f"largest fall {show(fall.get('drawdown'))} ({show(fall.get('drawdown_pct'), '{:.2%}')})",
        f"round trips {m.get('n', 0)}: won {show(m.get('win_rate'), '{:.2%}')} ({m.get('wins', 0)} of {m.get('n', 0)}), payoff {show(m.get('payoff_ratio'))}, expectancy {show(m.get('expectancy'), '{:+,.2f}')}, profit factor {show(m.get('profit_factor'))}, {show(m.get('avg_holding_bars'))} bars held",
    ]
    by = sorted(got["by_signal"], key=lambda r: (-r["n"], r["signal_kind"]))
    lines += [f"  {r['signal_kind']}: {r['n']}, won {show(r['win_rate'], '{:.2%}')}, payoff {show(r['payoff_ratio'])}, expectancy {show(r['expectancy'], '{:+,.2f}')}" for r in by] or ["  no round trip was closed"]
    lines += [f"held {r['code']} from {r['first_ts']} to {r['last_ts']}: {show(r['ret'], '{:+.2%}')}" for r in got["benchmark"]]
    return "\n".join(lines)


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str, indent=2)
