"""DuckDB SQL for the operators that SQL can express: brute force over whole tables."""

from __future__ import annotations

import math

from .quality import GROWTH, HIGHEST, LOWEST, RATIOS
from .url_filter import LINKS, LOWER, PARTS, RULES, UPPER

SQL: dict[str, str] = {}

SQL["op1_minhash_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""

def _quality_sql(low: float = 0.1, high: float = 0.9, reach: float = 3.0, least: int = 100) -> str:
    """The counts, the sketches of each group, language and the corpus, and the fences."""
    ratio = ", ".join(f"{c} / greatest(n_words, 1) AS r{i}" for i, c in enumerate(("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
    log = f"CAST(ceil(greatest(least(ln(v), {HIGHEST}), {LOWEST}) / {math.log(GROWTH)!r}) AS INTEGER)"
    sketch, fence = [], []
    for tag, keys in (("g", "lang, source"), ("l", "lang"), ("c", "")):
        by = keys + ", " if keys else ""
        sketch.append(f"""q{tag} AS (SELECT {by}r, max(n) AS n, min(v) FILTER (s >= {low!r} * n) AS a, min(v) FILTER (s >= {high!r} * n) AS b FROM (SELECT {by}r, sum(n) OVER (PARTITION BY {by}r ORDER BY cell NULLS FIRST ROWS UNBOUNDED PRECEDING) AS s,
    sum(n) OVER (PARTITION BY {by}r) AS n, CASE WHEN cell IS NULL THEN 0 ELSE pow({GROWTH!r}, cell) * {2 / (1 + GROWTH)!r} END AS v FROM (SELECT {by}r, cell, sum(n) AS n FROM sk GROUP BY {by}r, cell)) GROUP BY {by}r)""")
    for i, (_, both, spread) in enumerate(RATIOS):
        lower = f"a - {reach!r} * greatest(b - a, {spread!r})" if both else "CAST('-inf' AS DOUBLE)"
        upper = f"b + {reach!r} * greatest(b - a, {spread!r})"
        sides = ["coalesce(" + ", ".join(f"(SELECT {side} FROM q{t} WHERE r = {i} AND n >= {least if t != 'c' else 1}{on})" for t, on in (("g", " AND qg.lang IS NOT DISTINCT FROM z.lang AND qg.source IS NOT DISTINCT FROM z.source"), ("l", " AND ql.lang IS NOT DISTINCT FROM z.lang"), ("c", ""))) + ")" for side in (lower, upper)]
        fence.append(f"r{i} BETWEEN {sides[0]} AND {sides[1]}")
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS g FROM d WHERE len(ws) > 2),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) FILTER (k > 1) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) GROUP BY doc_id),
x AS (SELECT d.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(b.n, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words
  FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratio} FROM x),
sk AS (SELECT lang, source, r, CASE WHEN v > {math.exp(LOWEST)!r} THEN {log} END AS cell, count(*) AS n FROM (SELECT lang, source, unnest([0, 1, 2, 3]) AS r, unnest([r0, r1, r2, r3]) AS v FROM y WHERE NOT base_failed) GROUP BY ALL),
{', '.join(sketch)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(fence)} AS kept FROM y AS z
"""


SQL["op4_quality_rules"] = _quality_sql()

SQL["op6_suffix_dedup"] = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM t)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
isl AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM dup)),
sp AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM isl GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM sp),
cut AS (SELECT gap.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last FROM gap JOIN t ON t.doc_id = gap.doc_id GROUP BY gap.doc_id)
SELECT t.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM t LEFT JOIN cut ON cut.doc_id = t.doc_id
"""

SQL["op8_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g AS a JOIN g AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

SQL["op11_collocations"] = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 100),
i AS (SELECT DISTINCT c.lang, c.g FROM c JOIN (SELECT lang, k, a, g, unnest(range(1, k)) AS at FROM c) AS x ON x.lang = c.lang AND x.k > c.k AND x.at + c.k - 1 <= x.k AND x.g[x.at:x.at + c.k - 1] = c.g AND 100 * x.a >= 100 * c.a),
s AS (SELECT c.lang, c.g, c.a, cut, l.f AS l, r.f AS r, n.n, CAST((1000 * CAST(c.a AS HUGEINT) * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c JOIN n ON n.lang = c.lang JOIN f AS l ON l.lang = c.lang AND l.g = c.g[1:cut] JOIN f AS r ON r.lang = c.lang AND r.g = c.g[cut + 1:c.k] ANTI JOIN i ON i.lang = c.lang AND i.g = c.g),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""

SQL["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
SELECT * FROM n WHERE rank <= 5
"""


def _url_sql(damping: float = 0.85, rounds: int = 12) -> str:
    """The rules, and the two rankings with each round a common table expression."""
    fits = []
    for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {{'rule': '{host}{path}', 'verdict': '{verdict}'}}")
    links = LINKS.replace("'", "''")
    low = f"'{UPPER}', '{LOWER}'"
    rounds_sql, last = [], "r0"
    for k in range(1, rounds + 1):
        part = lambda s, x: f"{1 - damping!r}e0 * {s} + {damping!r}e0 * coalesce({x}, 0)"
        rounds_sql.append(f"""s{k} AS (SELECT dst AS host, sum(n / outs * t) AS t, 0.0 AS d FROM ed JOIN {last} ON host = src GROUP BY dst UNION ALL SELECT src, 0.0, sum(n / ins * d) FROM ed JOIN {last} ON host = dst GROUP BY src),
r{k} AS (SELECT {last}.host, st, sd, {part('st', 'x.t')} AS t, {part('sd', 'x.d')} AS d FROM {last} LEFT JOIN (SELECT host, sum(t) AS t, sum(d) AS d FROM s{k} GROUP BY host) AS x ON x.host = {last}.host)""")
        last = f"r{k}"
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), {low}) AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path, html FROM pages),
j AS (SELECT page_id, host, path, html, CASE {' '.join(fits)} END AS hit FROM p),
e0 AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{links}', 1)), {low}) AS dst FROM p),
e1 AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM e0 WHERE src <> dst GROUP BY src, dst),
ed AS (SELECT *, sum(n) OVER (PARTITION BY src) AS outs, sum(n) OVER (PARTITION BY dst) AS ins FROM e1),
h AS (SELECT host, count(*) AS n, count(*) FILTER (hit.verdict = 'allow') AS a, count(*) FILTER (hit.verdict = 'block') AS b FROM j GROUP BY host UNION ALL SELECT x, 0, 0, 0 FROM (SELECT src AS x FROM e1 UNION SELECT dst FROM e1)),
r0 AS (SELECT host, coalesce(sum(a) / nullif(sum(n), 0), 0) AS st, coalesce(sum(b) / nullif(sum(n), 0), 0) AS sd, st AS t, sd AS d FROM h GROUP BY host),
{', '.join(rounds_sql)}
SELECT page_id, j.host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN d > t THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN {last} ON {last}.host = j.host
"""


SQL["op9_url_filters"] = _url_sql()
