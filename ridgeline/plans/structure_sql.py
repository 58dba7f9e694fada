"""Oracle SQL (DuckDB) for the structure above strokes: segments, zones, trends, levels, divergences and signals.

Written from the rules, apart from the kernel: a recursive query joins
pull-backs, a backward one chooses breaks, and the rest are joins over whole
tables. Each function returns common table expressions; members, zones and
trends of any level go through the same ones.
"""

from __future__ import annotations

from ridgeline.plans.sql import B, F, M, S, _bars, fold  # noqa: F401

INSIDE = "((a.t >= x.t AND a.b <= x.b) OR (a.t <= x.t AND a.b >= x.b))"

STROKE = """k AS (SELECT code, k AS idx, if(top, -1, 1) AS direction, price, midx, src, lead(price) OVER w AS price2, lead(midx) OVER w AS midx2, lead(src) OVER w AS src2, lead(known, 2) OVER w AS known FROM pt WINDOW w AS (PARTITION BY code ORDER BY k)),
st AS (SELECT code, idx AS i, direction AS d, greatest(price, price2) AS h, least(price, price2) AS l, src, src2, known FROM k WHERE price2 IS NOT NULL),
nn AS (SELECT code, count(*) AS n FROM st GROUP BY code),
ol AS (SELECT code, i FROM (SELECT code, i, least(h, lead(h) OVER w, lead(h, 2) OVER w) AS h, greatest(l, lead(l) OVER w, lead(l, 2) OVER w) AS l, lead(h, 2) OVER w AS third FROM st WINDOW w AS (PARTITION BY code ORDER BY i)) WHERE third IS NOT NULL AND h > l)"""

SEGMENT = """fc AS (SELECT a.code, a.i AS s, x.i, if(a.d = 1, x.h, -x.l) AS t, if(a.d = 1, x.l, -x.h) AS b FROM st AS a JOIN st AS x ON x.code = a.code AND x.i >= a.i),
ft AS (
  SELECT code, s, i, CAST([] AS STRUCT(t BIGINT, b BIGINT, p BIGINT)[]) AS items, CAST(t AS BIGINT) AS t, CAST(b AS BIGINT) AS b, CAST(i AS BIGINT) AS p, false AS done FROM fc WHERE i = s + 1
  UNION ALL
  SELECT code, s, if(done, ni, i), CASE WHEN done THEN items WHEN nests THEN items[:-2] ELSE list_append(items, {'t': t, 'b': b, 'p': p}) END, CASE WHEN done THEN nt WHEN nests THEN greatest(t, items[-1].t) ELSE t END,
    CASE WHEN done THEN nb WHEN nests THEN greatest(b, items[-1].b) ELSE b END, CASE WHEN done THEN ni WHEN nests AND items[-1].t > t THEN items[-1].p ELSE p END, NOT done AND NOT nests
  FROM (SELECT ft.*, x.i AS ni, CAST(x.t AS BIGINT) AS nt, CAST(x.b AS BIGINT) AS nb, coalesce(len(items) > 0 AND ((items[-1].t >= ft.t AND items[-1].b <= ft.b) OR (items[-1].t <= ft.t AND items[-1].b >= ft.b)), false) AS nests
        FROM ft LEFT JOIN fc AS x ON ft.done AND x.code = ft.code AND x.s = ft.s AND x.i = ft.i + 2 WHERE NOT ft.done OR x.i IS NOT NULL)),
sd AS MATERIALIZED (SELECT code, s, i, items FROM ft WHERE done),
fp AS (SELECT code, s AS q, min(i) AS at, arg_min(items[-1].p, i) AS known FROM sd WHERE len(items) > 2 AND items[-2].t > greatest(items[-3].t, items[-1].t) AND items[-2].b > greatest(items[-3].b, items[-1].b) GROUP BY code, s),
hl AS (SELECT code, s, e, max(hr) OVER w AS high_at, max(lr) OVER w AS low_at FROM (
  SELECT code, s, i AS e, if(t > coalesce(max(t) OVER v, t - 1), i, NULL) AS hr, if(b < coalesce(min(b) OVER v, b + 1), i, NULL) AS lr FROM fc WINDOW v AS (PARTITION BY code, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WINDOW w AS (PARTITION BY code, s ORDER BY e)),
it AS (SELECT code, s, i, j, items[j] AS x, items[j - 1] AS a, items[j + 1] AS z, max(items[j].t) OVER (PARTITION BY code, s, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM (SELECT sd.*, unnest(range(1, len(items))) AS j FROM sd JOIN ol ON ol.code = sd.code AND ol.i = sd.s WHERE sd.i >= s + 5)),
pk AS (SELECT code, s, i, x.p AS p, z.p AS zp, j > 1 AND (x.t < a.b OR x.b > a.t) AS gap FROM it WHERE (j = 1 AND x.t > z.t) OR (j > 1 AND x.t > best AND x.t > greatest(a.t, z.t) AND x.b > greatest(a.b, z.b))),
cd AS (SELECT pk.code, pk.s, pk.i, p - 1 AS e, if(gap, fp.known, zp) AS known, if(gap, fp.at, pk.i) AS seen
  FROM pk JOIN hl ON hl.code = pk.code AND hl.s = pk.s AND hl.e = p - 1 LEFT JOIN fp ON fp.code = pk.code AND fp.q = p WHERE p - pk.s >= 3 AND low_at <= high_at AND (NOT gap OR fp.at IS NOT NULL)),
fs AS (SELECT code, s FROM (SELECT code, s, row_number() OVER (PARTITION BY code ORDER BY greatest(i, seen), s) AS n FROM cd WHERE seen <= i + 1) WHERE n = 1),
cl AS (SELECT cd.code, cd.s, list(e ORDER BY e) AS es, list(known ORDER BY e) AS ks FROM cd JOIN (SELECT code, s, max(i) AS i FROM sd GROUP BY code, s) AS y ON y.code = cd.code AND y.s = cd.s AND y.i = cd.i GROUP BY cd.code, cd.s),
bs AS (
  SELECT code, n AS s, CAST([0] AS BIGINT[]) AS vals, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS known FROM nn
  UNION ALL
  SELECT code, s, list_prepend(coalesce(list_max(gains) + 1, 0), vals), es[list_position(gains, list_max(gains))], ks[list_position(gains, list_max(gains))]
  FROM (SELECT bs.code, bs.s - 1 AS s, bs.vals, cl.es, cl.ks, list_transform(cl.es, lambda y: bs.vals[y - bs.s + 2]) AS gains FROM bs LEFT JOIN cl ON cl.code = bs.code AND cl.s = bs.s - 1 WHERE bs.s > 0)),
pa AS (SELECT bs.code, bs.s, bs.e, bs.known FROM bs JOIN fs ON fs.code = bs.code AND fs.s = bs.s WHERE bs.e IS NOT NULL UNION ALL SELECT bs.code, bs.s, bs.e, bs.known FROM pa JOIN bs ON bs.code = pa.code AND bs.s = pa.e + 1 WHERE bs.e IS NOT NULL),
ss AS (SELECT nn.code, coalesce(fs.s, 0) AS a FROM nn LEFT JOIN fs ON fs.code = nn.code UNION ALL
  SELECT pa.code, pa.e + 1 FROM pa JOIN nn ON nn.code = pa.code LEFT JOIN ol ON ol.code = pa.code AND ol.i = pa.e + 1 WHERE pa.e + 1 < n AND (pa.e + 3 >= n OR ol.i IS NOT NULL)),
sb AS (SELECT ss.code, a, lead(a) OVER (PARTITION BY ss.code ORDER BY a) - 1 AS z FROM ss UNION ALL SELECT code, 0, min(a) - 1 FROM ss GROUP BY code HAVING min(a) > 0),
sc AS (SELECT sb.code, sb.a, coalesce(sb.z, n - 1) AS z, sb.z IS NOT NULL AND sb.a >= (SELECT min(a) FROM ss WHERE ss.code = sb.code) AS sure, greatest(sb.z, least(coalesce(pa.known, sb.z), n - 1)) AS c
  FROM sb JOIN nn ON nn.code = sb.code LEFT JOIN pa ON pa.code = sb.code AND pa.e = sb.z),
sg AS MATERIALIZED (SELECT code, row_number() OVER (PARTITION BY code ORDER BY a) - 1 AS idx, d, h, l, a, z, src_start, src_end, src_end AS end_src, if(sure, 'confirmed', 'tentative') AS status,
    CASE WHEN sure THEN max(if(sure, own, NULL)) OVER (PARTITION BY code ORDER BY a) END AS known
  FROM (SELECT sc.code, sc.a, sc.z, sc.sure, arg_min(x.d, x.i) AS d, max(x.h) AS h, min(x.l) AS l, arg_min(x.src, x.i) AS src_start, arg_max(x.src2, x.i) AS src_end, any_value(coalesce(y.known, y.src2)) AS own
        FROM sc JOIN st AS x ON x.code = sc.code AND x.i BETWEEN sc.a AND sc.z LEFT JOIN st AS y ON y.code = sc.code AND y.i = sc.c GROUP BY sc.code, sc.a, sc.z, sc.sure))"""


def pivots(name: str, members: str) -> str:
    """Zones ``name`` over ``members`` (code, idx, d, h, l, src_start, src_end, end_src, status, known)."""
    m = name
    return f"""{m}r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY idx) - 1 AS r FROM {members} WHERE status = 'confirmed'),
{m}q AS (SELECT a.code, a.r, min(x.h) AS zg, max(x.l) AS zd, coalesce(arg_min(x.d, x.r) FILTER (x.d <> 0), 0) AS way FROM {m}r AS a JOIN {m}r AS x ON x.code = a.code AND x.r BETWEEN a.r AND a.r + 2 GROUP BY a.code, a.r HAVING count(*) = 3),
{m}j AS (SELECT code, r, zg, zd, way, coalesce(miss, least(r + 8, n)) AS j, miss IS NULL AND more AS capped FROM (
  SELECT q.code, q.r, zg, zd, way, min(x.r) FILTER (x.r < q.r + 8 AND NOT (x.l <= zg AND x.h >= zd)) AS miss, coalesce(bool_or(x.l <= zg AND x.h >= zd) FILTER (x.r = q.r + 8), false) AS more, any_value(y.n) AS n
  FROM {m}q AS q JOIN (SELECT code, count(*) AS n FROM {m}r GROUP BY code) AS y ON y.code = q.code LEFT JOIN {m}r AS x ON x.code = q.code AND x.r BETWEEN q.r + 3 AND q.r + 8 GROUP BY q.code, q.r, zg, zd, way)),
{m}w AS (SELECT code, r, zg > zd AS hit, j FROM {m}j WHERE r = 0 UNION ALL SELECT y.code, y.r, y.zg > y.zd, y.j FROM {m}w AS w JOIN {m}j AS y ON y.code = w.code AND y.r = if(w.hit, w.j, w.r + 1)),
{m} AS MATERIALIZED (SELECT code, row_number() OVER (PARTITION BY code ORDER BY r) - 1 AS idx, zg, zd, gg, dd, start_idx, end_idx, src_start, src_end, capped, if(later, 'confirmed', 'tentative') AS status, known FROM (
  SELECT j.code, j.r, zg, zd, capped, coalesce(max(x.h) FILTER (along AND stays), max(x.h) FILTER (along)) AS gg, coalesce(min(x.l) FILTER (along AND stays), min(x.l) FILTER (along)) AS dd,
    arg_min(x.idx, x.r) AS start_idx, arg_max(x.idx, x.r) AS end_idx, arg_min(x.src_start, x.r) AS src_start, arg_max(x.src_end, x.r) AS src_end, any_value(z.code) IS NOT NULL AS later, any_value(coalesce(z.known, z.end_src)) AS known
  FROM (SELECT j.*, x.r AS xr, way = 0 OR x.d = way AS along, capped OR x.r <> j.j - 1 AS stays FROM {m}j AS j JOIN {m}w AS w ON w.code = j.code AND w.r = j.r AND w.hit JOIN {m}r AS x ON x.code = j.code AND x.r BETWEEN j.r AND j.j - 1) AS j
  JOIN {m}r AS x ON x.code = j.code AND x.r = j.xr LEFT JOIN {m}r AS z ON z.code = j.code AND z.r = j.j GROUP BY j.code, j.r, zg, zd, capped))"""


def trends(name: str, zones: str) -> str:
    """Trends ``name`` over ``zones``, as members of the next level."""
    m = name
    return f"""{m}p AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY idx) - 1 AS r, coalesce(CASE WHEN lead(dd) OVER w > gg THEN 1 WHEN lead(gg) OVER w < dd THEN -1 ELSE 0 END, 0) AS rel FROM {zones} WHERE status = 'confirmed' WINDOW w AS (PARTITION BY code ORDER BY idx)),
{m}e AS (SELECT a.code, a.r, a.rel, if(a.rel = 0, a.r, min(x.r)) AS z FROM {m}p AS a JOIN {m}p AS x ON x.code = a.code AND x.r >= a.r AND x.rel <> a.rel OR (x.code = a.code AND x.r = a.r AND a.rel = 0) GROUP BY a.code, a.r, a.rel),
{m}w AS (SELECT code, r, rel, z FROM {m}e WHERE r = 0 UNION ALL SELECT y.code, y.r, y.rel, y.z FROM {m}w AS w JOIN {m}e AS y ON y.code = w.code AND y.r = w.z + 1),
{m}x AS (SELECT w.code, w.r, w.rel AS d, f.idx AS start_idx, g.idx AS end_idx, f.src_start, g.src_end AS end_src, least(greatest(g.src_end, coalesce(nx.src_start - 1, g.src_end)), nb.n - 1) AS src_end,
    (SELECT max(y.known) FROM {m}p AS y WHERE y.code = w.code AND y.r BETWEEN w.r AND w.z) AS known
  FROM {m}w AS w JOIN {m}p AS f ON f.code = w.code AND f.r = w.r JOIN {m}p AS g ON g.code = w.code AND g.r = w.z LEFT JOIN {m}p AS nx ON nx.code = w.code AND nx.r = w.z + 1 JOIN (SELECT code, count(*) AS n FROM b GROUP BY code) AS nb ON nb.code = w.code),
{m} AS MATERIALIZED (SELECT x.code, row_number() OVER (PARTITION BY x.code ORDER BY x.r) - 1 AS idx, any_value(x.d) AS d, max(b.h) AS h, min(b.l) AS l, any_value(x.src_start) AS src_start, any_value(x.src_end) AS src_end, any_value(x.end_src) AS end_src, 'confirmed' AS status, any_value(x.known) AS known,
    any_value(x.start_idx) AS start_idx, any_value(x.end_idx) AS end_idx FROM {m}x AS x JOIN b ON b.code = x.code AND b.i BETWEEN x.src_start AND x.src_end GROUP BY x.code, x.r)"""


MACD = """e1 AS (SELECT code, i, CAST(c AS DOUBLE) AS f, CAST(c AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS g FROM b WHERE i = 0
  UNION ALL SELECT code, i, f, s, 0.2e0 * (f - s) + (1 - 0.2e0) * g FROM (SELECT b.code, b.i, (2e0 / 13) * b.c + (1 - 2e0 / 13) * e1.f AS f, (2e0 / 27) * b.c + (1 - 2e0 / 27) * e1.s AS s, e1.g FROM e1 JOIN b ON b.code = e1.code AND b.i = e1.i + 1)),
hist AS MATERIALIZED (SELECT code, i, 2 * ((f - s) - g) AS hist FROM e1)"""


def views(name: str, members: str, zones: str, runs: str) -> str:
    """``name``: divergences of a level, with ``order`` 0 and a rank for a trend's; {name}a: areas and extremes; {name}v: leaving moves."""
    m = name
    return f"""{m}a AS MATERIALIZED (SELECT s.code, s.idx, any_value(s.d) AS d, any_value(s.h) AS h, any_value(s.l) AS l, any_value(s.src_start) AS src_start, any_value(s.src_end) AS src_end, any_value(s.status) AS status, any_value(s.known) AS known,
    sum(greatest(hist.hist * s.d, 0)) AS area, coalesce(min(b.i) FILTER (b.h = s.h), any_value(s.end_src)) AS top_at, coalesce(min(b.i) FILTER (b.l = s.l), any_value(s.end_src)) AS low_at
  FROM {members} AS s JOIN b ON b.code = s.code AND b.i BETWEEN s.src_start AND s.src_end JOIN hist ON hist.code = b.code AND hist.i = b.i GROUP BY s.code, s.idx),
{m}g AS (SELECT p.code, t.d AS want, p.idx, p.end_idx, p.capped, lag(p.end_idx) OVER (PARTITION BY p.code, t.d ORDER BY p.idx) AS before FROM {zones} AS p JOIN {runs} AS t ON t.code = p.code AND p.idx BETWEEN t.start_idx AND t.end_idx WHERE t.d <> 0),
{m}v AS (SELECT g.code, g.idx AS zone, g.end_idx AS seg, g.before AS ref, x.d, x.area AS now, y.area AS prev FROM {m}g AS g JOIN {m}a AS x ON x.code = g.code AND x.idx = g.end_idx JOIN {m}a AS y ON y.code = g.code AND y.idx = g.before
  WHERE NOT g.capped AND x.d = want AND y.d = want AND if(want = 1, x.h > y.h, x.l < y.l) AND x.area < y.area),
{m} AS MATERIALIZED (SELECT o.*, x.src_start, x.src_end, x.status, CASE WHEN x.status = 'confirmed' THEN x.known END AS known, if(o.d = -1, x.low_at, x.top_at) AS src, if(o.d = -1, x.l, x.h) AS price,
    row_number() OVER (PARTITION BY o.code ORDER BY if(o.d = -1, x.low_at, x.top_at), o.kind, o.seq) - 1 AS idx,
    (SELECT min(p.idx) FROM {zones} AS p WHERE p.code = o.code AND o.seg BETWEEN p.start_idx AND p.end_idx) AS home
  FROM (SELECT code, 'trend' AS kind, seg, ref, d, now, prev, true AS further, d * 100000 + zone AS seq FROM {m}v UNION ALL
        SELECT x.code, 'consolidation', x.idx, y.idx, x.d, x.area, y.area, if(x.d = -1, x.l < y.l, x.h > y.h), x.idx FROM {m}a AS x JOIN {m}a AS y ON y.code = x.code AND y.idx = x.idx - 2 AND y.d = x.d WHERE x.area < y.area) AS o JOIN {m}a AS x ON x.code = o.code AND x.idx = o.seg)"""


def signals(name: str, loose: bool) -> str:
    """Signals ``name`` over segments sg, zones p0, trends t0, zones p1 and divergences d0, d1."""
    back = "SELECT code, seg, d, if(d = -1, l, h) AS price, zone, if(d = -1, 0, 1) AS o1, zone AS o2 FROM (SELECT v.*, a.h, a.l FROM d0v AS v JOIN d0a AS a ON a.code = v.code AND a.idx = v.seg)"
    weak = "SELECT code, seg, d, price, home, 2, idx FROM d0 WHERE kind = 'consolidation'"
    return f"""g2 AS ({back}{" UNION ALL " + weak if loose else ""}),
g1 AS (SELECT p.code, if(x.d = 1, 'b3', 's3') AS kind, p.end_idx + 1 AS seg, p.idx AS zone, CAST(NULL AS BOOLEAN) AS nested, 0 AS o1, p.idx AS o2 FROM p0 AS p JOIN sg AS x ON x.code = p.code AND x.idx = p.end_idx JOIN sg AS y ON y.code = p.code AND y.idx = p.end_idx + 1
    WHERE NOT p.capped AND ((x.d = 1 AND y.d = -1 AND least(x.h, y.l) > zg) OR (x.d = -1 AND y.d = 1 AND greatest(x.l, y.h) < zd))
  UNION ALL SELECT v.code, if(v.d = -1, 'b1', 's1'), v.seg, v.zone, CASE WHEN EXISTS (SELECT 1 FROM p1 WHERE p1.code = v.code) THEN EXISTS (SELECT 1 FROM d1 JOIN sg AS s ON s.code = v.code AND s.idx = v.seg WHERE d1.code = v.code AND d1.d = v.d AND d1.src_start <= s.src_start AND s.src_end <= d1.src_end) END, 1, v.d * 100000 + v.zone FROM d0v AS v
  {"UNION ALL SELECT code, if(d = -1, 'pb', 'ps'), seg, home, NULL, 2, idx FROM d0 WHERE kind = 'consolidation'" if loose else ""}
  UNION ALL SELECT g2.code, if(g2.d = -1, 'b2', 's2'), g2.seg + 2, g2.zone, NULL, 3 + g2.o1, g2.o2 FROM g2 JOIN sg AS x ON x.code = g2.code AND x.idx = g2.seg + 1 AND x.d = -g2.d JOIN sg AS y ON y.code = g2.code AND y.idx = g2.seg + 2 AND y.d = g2.d WHERE if(g2.d = -1, y.l > g2.price, y.h < g2.price)),
{name} AS MATERIALIZED (SELECT g1.code, row_number() OVER (PARTITION BY g1.code ORDER BY if(buy, a.low_at, a.top_at), kind, o1, o2) - 1 AS idx, kind, if(buy, a.low_at, a.top_at) AS src, if(buy, a.l, a.h) AS price, zone, a.src_start, a.src_end, a.status, CASE WHEN a.status = 'confirmed' THEN a.known END AS known, nested
  FROM (SELECT *, kind IN ('b1', 'b2', 'b3', 'pb') AS buy FROM g1) AS g1 JOIN d0a AS a ON a.code = g1.code AND a.idx = g1.seg)"""


LEVEL0 = ", ".join([pivots("p0", "sg"), trends("t0", "p0")])
LEVEL1 = ", ".join([pivots("p1", "t0"), trends("t1", "p1")])
LEVEL2 = ", ".join([pivots("p2", "t1"), trends("t2", "p2")])
DIVERGE = ", ".join([MACD, views("d0", "sg", "p0", "t0")])
DIVERGE1 = views("d1", "t0", "p1", "t1")


def base(*parts: str, bars: str = "wb") -> str:
    """A WITH list down to segments and what ``parts`` add."""
    return ",\n".join([fold(bars, M, F, S), STROKE, SEGMENT, *parts])


def at(alias: str, column: str) -> str:
    """The time of a bar as a subquery."""
    return f"(SELECT ts FROM b WHERE b.code = {alias}.code AND b.i = {alias}.{column})"


#: One account that buys what has a bottom and sells what has a top: events are the bars that show a fractal, and the bars after them.
LEDGER = ",\n".join([fold("wb", M, F), """cn AS (SELECT code, row_number() OVER (ORDER BY code) AS ci FROM (SELECT DISTINCT code FROM b)),
bo AS (SELECT b.code, b.ts, b.i, CAST(wb.open AS DOUBLE) / 1e9 AS o, CAST(b.c AS DOUBLE) / 1e9 AS c, lag(CAST(b.c AS DOUBLE) / 1e9) OVER w AS pc, CASE f.top WHEN true THEN 'top' WHEN false THEN 'bottom' END AS kind, lag(f.idx) OVER w IS NOT NULL AS after
  FROM b JOIN wb ON wb.code = b.code AND wb.ts = b.ts LEFT JOIN f ON f.code = b.code AND f.known = b.i WINDOW w AS (PARTITION BY b.code ORDER BY b.i)),
ev AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, bo.code) AS e, bo.*, ci, if(bo.code[1] IN ('4', '8'), 0.3e0, 0.1e0) AS lim FROM bo JOIN cn ON cn.code = bo.code WHERE kind IS NOT NULL OR after),
ld AS (
  SELECT CAST(0 AS BIGINT) AS e, CAST(100000 AS DOUBLE) AS cash, (SELECT list({'qty': CAST(0 AS BIGINT), 'price': CAST(0 AS DOUBLE), 'fee': CAST(0 AS DOUBLE), 'ts': '', 'bar': CAST(0 AS BIGINT), 'pend': ''}) FROM cn) AS h,
    '' AS ts, '' AS code, '' AS side, CAST(0 AS DOUBLE) AS price, CAST(0 AS BIGINT) AS qty, CAST(0 AS DOUBLE) AS amount, CAST(0 AS DOUBLE) AS fee, CAST(0 AS DOUBLE) AS tax, {'qty': CAST(0 AS BIGINT), 'price': CAST(0 AS DOUBLE), 'fee': CAST(0 AS DOUBLE), 'ts': '', 'bar': CAST(0 AS BIGINT), 'pend': ''} AS lot, CAST(0 AS BIGINT) AS bar
  UNION ALL
  SELECT e, CASE side WHEN 'buy' THEN cash - (amount + fee) WHEN 'sell' THEN cash + (amount - fee - tax) ELSE cash END,
    list_transform(h, lambda x, j: if(j = ci, {'qty': CASE side WHEN 'buy' THEN qty WHEN 'sell' THEN 0 ELSE x.qty END, 'price': if(side = 'buy', o, x.price), 'fee': if(side = 'buy', fee, x.fee), 'ts': if(side = 'buy', ets, x.ts), 'bar': if(side = 'buy', i, x.bar),
      'pend': CASE WHEN kind = 'bottom' AND CASE side WHEN 'buy' THEN 0 WHEN 'sell' THEN 1 ELSE if(x.qty = 0, 1, 0) END = 1 THEN 'buy' WHEN kind = 'top' AND CASE side WHEN 'buy' THEN 1 WHEN 'sell' THEN 0 ELSE if(x.qty = 0, 0, 1) END = 1 THEN 'sell' ELSE '' END}, x)),
    ets, ecode, side, o, qty, amount, fee, tax, cur, i
  FROM (SELECT *, if(side = '', 0, amount0) AS amount, if(side = '', 0, greatest(5e0, amount0 * 0.00025e0)) AS fee, if(side = 'sell', amount0 * 0.001e0, 0) AS tax FROM (
    SELECT *, qty * o AS amount0, CASE WHEN cur.pend = 'buy' AND qty > 0 AND NOT coalesce(o >= round(pc * (1 + lim) + 1e-9, 2) - 1e-9, false) THEN 'buy' WHEN cur.pend = 'sell' AND NOT coalesce(o <= round(pc * (1 - lim) + 1e-9, 2) + 1e-9, false) THEN 'sell' ELSE '' END AS side FROM (
      SELECT *, CASE cur.pend WHEN 'buy' THEN CAST(CASE WHEN q0 * o + greatest(5e0, q0 * o * 0.00025e0) <= cash * 0.3e0 THEN q0 WHEN (q0 - 100) * o + greatest(5e0, (q0 - 100) * o * 0.00025e0) <= cash * 0.3e0 THEN q0 - 100 ELSE q0 - 200 END AS BIGINT) WHEN 'sell' THEN cur.qty ELSE 0 END AS qty FROM (
        SELECT ev.e, ld.cash, ld.h, ev.ts AS ets, ev.code AS ecode, ev.i, ev.o, ev.pc, ev.lim, ev.kind, ev.ci, ld.h[ev.ci] AS cur, floor(ld.cash * 0.3e0 / (ev.o * 100)) * 100 AS q0 FROM ld JOIN ev ON ev.e = ld.e + 1))))),
fl AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY e) - 1 AS seq FROM ld WHERE side <> ''),
tp AS (SELECT 'all' AS run, row_number() OVER (ORDER BY seq) - 1 AS seq, code, 'fractal_bottom' AS signal_kind, lot.ts AS entry_ts, ts AS exit_ts, qty, qty * (price - lot.price) - lot.fee - (fee + tax) AS pnl, greatest(1, bar - lot.bar) AS holding_bars FROM fl WHERE side = 'sell'),
eq AS (SELECT d.ts, any_value(s.cash) + coalesce(sum(s.h[x.ci].qty * x.c), 0) AS equity FROM (SELECT ts, (SELECT max(e) FROM ev WHERE ev.ts <= y.ts) AS e FROM (SELECT DISTINCT ts FROM b) AS y) AS d JOIN ld AS s ON s.e = coalesce(d.e, 0)
  JOIN cn ON true LEFT JOIN (SELECT t.ts, cn.ci, arg_max(bo.c, bo.ts) AS c FROM (SELECT DISTINCT ts FROM b) AS t JOIN bo ON bo.ts <= t.ts JOIN cn ON cn.code = bo.code GROUP BY 1, 2) AS x ON x.ts = d.ts AND x.ci = cn.ci GROUP BY d.ts)"""])
