"""Structure in SQL: table functions over bars.

``register(spark)``, then

    SELECT * FROM structure(TABLE(bars) PARTITION BY code ORDER BY ts)
    SELECT * FROM analyze(TABLE(bars), 'package.module:function')

``analyze`` runs any importable function on each series: what it returns is its
own affair, told by its attribute ``returns`` (columns as DDL). It is called with the
series' bars in order of ts (a list of rows) and its structure, and gives tuples.
``series_function`` makes one.
"""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ridgeline.operators import kernel
from ridgeline.operators.structure import COLUMNS, SCHEMA, rows_of

NEEDED = ("code", "ts", "high", "low", "close")


class Structure:
    """Takes the bars of one series (code, ts, high, low, close by name) in order, and gives the long table's rows."""

    def __init__(self):
        self.code, self.bars = None, []

    def eval(self, row: Row):
        self.code = row["code"]
        self.bars.append((row["ts"], float(row["high"]), float(row["low"]), float(row["close"])))

    def terminate(self):
        if self.bars:
            ts, high, low, close = (list(x) for x in zip(*self.bars))
            for r in rows_of(self.code, ts, kernel.analyse(high, low, close), "day"):
                yield tuple(r.get(c) for c in COLUMNS)


#: Types that a function's columns may have; the worker that analyses a call has no Spark to parse them.
TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def columns(ddl: str) -> list[T.StructField]:
    """The fields of columns such as ``ts string, price double``."""
    out = []
    for part in ddl.split(","):
        name, _, kind = part.strip().partition(" ")
        if kind.strip().lower() not in TYPES:
            raise ValueError(f"column {part.strip()!r}: a name and one of {', '.join(TYPES)}")
        out.append(T.StructField(name, TYPES[kind.strip().lower()]))
    return out


def series_function(returns: str):
    """Marks a function of (bars, structure) for ``analyze``, with the columns that it returns."""

    def mark(f):
        f.returns = returns
        return f

    return mark


def named(path: str):
    """The function at ``package.module:function``."""
    module, _, name = path.partition(":")
    f = getattr(import_module(module), name, None) if name else None
    if not callable(f) or not hasattr(f, "returns"):
        raise ValueError(f"{path!r} names no function with columns to return: package.module:function")
    return f


class Analyze:
    """A named function over each series of a table."""

    def __init__(self):
        self.bars: list[Row] = []
        self.options: tuple[str, str, str] | None = None

    @staticmethod
    def analyze(bars: AnalyzeArgument, function: AnalyzeArgument, mode: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not bars.isTable:
            raise ValueError("analyze takes a table of bars")
        if not function.isConstantExpression or not isinstance(function.value, str):
            raise ValueError("the function is a constant text, package.module:function")
        have = [f.name for f in bars.dataType]
        lacking = [c for c in NEEDED if c not in have]
        if lacking:
            raise ValueError(f"bars have no {', '.join(lacking)}")
        keys = [c for c in ("code", "period") if c in have]
        schema = T.StructType([f for f in bars.dataType if f.name in keys] + columns(named(function.value).returns))
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(k) for k in keys], orderBy=[OrderingColumn("ts")])

    def eval(self, bars: Row, function: str, mode: str = "strict"):
        self.bars.append(bars)
        self.options = function, mode, bars["period"] if "period" in bars else "day"

    def terminate(self):
        if self.bars:
            path, mode, level = self.options
            high, low, close = ([float(b[c]) for b in self.bars] for c in ("high", "low", "close"))
            keys = tuple(self.bars[0][c] for c in ("code", "period") if c in self.bars[0])
            for row in named(path)(self.bars, kernel.analyse(high, low, close, level or "day", mode)):
                yield (*keys, *row)


def register(spark: SparkSession, name: str = "structure") -> None:
    spark.udtf.register(name, udtf(Structure, returnType=SCHEMA))
    spark.udtf.register("analyze", udtf(Analyze))
