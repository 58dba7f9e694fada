"""Pieces of oracle SQL (DuckDB): the fixture bars and the structure folds as common table expressions."""

from __future__ import annotations


def _bars(name: str, rows: str, order: str) -> str:
    return f"""{name} AS (
  SELECT code, ts, first(p ORDER BY {order}, p) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {order}, p) AS close,
         CAST(sum(q) AS BIGINT) AS volume, CAST(sum(p) AS BIGINT) AS amount
  FROM ({rows}) GROUP BY code, ts)"""


#: Daily bars of line items, daily bars of the order walk, hourly bars of the event walk.
LB = _bars("lb", """SELECT l_returnflag AS code, strftime(l_shipdate, '%Y-%m-%d') AS ts, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS p,
  CAST(floor(l_quantity) AS BIGINT) AS q, l_orderkey AS k1, l_linenumber AS k2 FROM lineitem WHERE l_quantity > 0""", "k1, k2")
WB = _bars("wb", """SELECT o_orderpriority AS code, strftime(o_orderdate, '%Y-%m-%d') AS ts, o_orderkey AS k1, CAST(1 AS BIGINT) AS q,
  CAST(10000000000 + sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) - 25025000) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p FROM orders""", "k1")
EB = _bars("eb", """SELECT code, ts, t, k1, q, CAST(100000000 + sum(c - m) OVER (PARTITION BY code ORDER BY t, k1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p FROM (
  SELECT *, CAST(floor(CAST(sum(c) OVER (PARTITION BY code) AS DOUBLE) / count(*) OVER (PARTITION BY code)) AS BIGINT) AS m FROM (
    SELECT event_type AS code, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS ts, ts AS t, event_id AS k1, CAST(1 AS BIGINT) AS q, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events))""", "t, k1")

#: Numbered bars of {src}; merged bars; fractals; accepted fractals.
B = "b AS (SELECT code, ts, high AS h, low AS l, close AS c, row_number() OVER (PARTITION BY code ORDER BY ts) - 1 AS i FROM {src})"
M = """m0 AS (
  SELECT code, i, CAST(0 AS BIGINT) AS n, h, l, CAST(NULL AS BIGINT) AS ph, 1 AS d, i AS s FROM b WHERE i = 0
  UNION ALL
  SELECT code, i, if(inc, n, n + 1), if(inc, if(up, greatest(mh, bh), least(mh, bh)), bh), if(inc, if(up, greatest(ml, bl), least(ml, bl)), bl),
         if(inc, ph, mh), if(inc, if(up, 1, -1), if(bh > mh, 1, -1)), if(inc, s, i)
  FROM (SELECT b.code, b.i, m0.n, m0.h AS mh, m0.l AS ml, b.h AS bh, b.l AS bl, m0.ph, m0.s, (b.h <= m0.h AND b.l >= m0.l) OR (b.h >= m0.h AND b.l <= m0.l) AS inc,
               CASE WHEN m0.ph IS NOT NULL THEN m0.h >= m0.ph WHEN b.h <> m0.h THEN b.h > m0.h ELSE b.l > m0.l END AS up
        FROM m0 JOIN b ON b.code = m0.code AND b.i = m0.i + 1)),
m AS (SELECT code, n AS idx, arg_max(h, i) AS high, arg_max(l, i) AS low, min(s) AS src_start, max(i) AS src_end FROM m0 GROUP BY code, n)"""
F = """f1 AS (
  SELECT *, high > greatest(ah, ch) AND low > greatest(al, cl) AS top, high < least(ah, ch) AND low < least(al, cl) AS bottom FROM (
    SELECT *, lag(high) OVER w AS ah, lag(low) OVER w AS al, lead(high) OVER w AS ch, lead(low) OVER w AS cl, lead(src_end) OVER w AS known FROM m WINDOW w AS (PARTITION BY code ORDER BY idx))),
f AS (SELECT f1.code, row_number() OVER (PARTITION BY f1.code ORDER BY f1.idx) - 1 AS idx, f1.idx AS midx, f1.top, if(f1.top, f1.high, f1.low) AS price, f1.high, f1.low, f1.known,
        arg_max(b.i, if(f1.top, b.h, -b.l) * 100000 + b.i) AS src
      FROM f1 JOIN b ON b.code = f1.code AND b.i BETWEEN f1.src_start AND f1.src_end WHERE (f1.top OR f1.bottom) AND f1.ah IS NOT NULL AND f1.ch IS NOT NULL
      GROUP BY f1.code, f1.idx, f1.top, f1.high, f1.low, f1.known)"""
S = """s0 AS (
  SELECT code, idx, CAST(0 AS BIGINT) AS k, idx AS fi, top, midx, price FROM f WHERE idx = 0
  UNION ALL
  SELECT code, idx, if(act = 2, k + 1, k), if(act > 0, idx, fi), if(act > 0, ftop, top), if(act > 0, fmidx, midx), if(act > 0, fprice, price)
  FROM (SELECT f.code, f.idx, s0.k, s0.fi, s0.top, s0.midx, s0.price, f.top AS ftop, f.midx AS fmidx, f.price AS fprice,
               CASE WHEN f.top = s0.top THEN if(if(f.top, f.price > s0.price, f.price < s0.price), 1, 0) WHEN abs(f.midx - s0.midx) >= 4 THEN 2 ELSE 0 END AS act
        FROM s0 JOIN f ON f.code = s0.code AND f.idx = s0.idx + 1)),
p AS (SELECT code, k, arg_max(fi, idx) AS fi FROM s0 GROUP BY code, k),
pt AS (SELECT p.code, p.k, f.top, f.price, f.midx, f.src, f.known FROM p JOIN f ON f.code = p.code AND f.idx = p.fi)"""


def fold(src: str, *parts: str) -> str:
    """A WITH RECURSIVE list: the bars of ``src`` and the folds over them."""
    base = {"lb": LB, "wb": WB, "eb": EB}[src]
    return "WITH RECURSIVE " + ",\n".join([base, B.format(src=src), *parts])


def rnd(x: str, digits: int = 4) -> str:
    """The rounding of ``functions.numbers``."""
    scale = float(10**digits)
    return f"floor(({x}) * {scale} + 0.5) / {scale}"
