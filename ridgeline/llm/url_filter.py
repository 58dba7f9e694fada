"""Operator 9: URL rules, and a verdict by link-graph propagation where no rule fits.

Native: every step is a DataFrame expression. A page's host follows from its
URL; rules (host suffix and path prefix) decide first, the longest that fits.
For the rest, two rankings run over the edges between hosts that the pages'
HTML names (absolute links and mail addresses):

* trust: personalised PageRank along the links, restarting at hosts in
  proportion to the share of their pages that an allow rule takes;
* distrust: the same against the links (a host that links to blocked hosts is
  suspect), restarting in proportion to the share that a block rule takes.

A host is blocked if its distrust exceeds ``ratio`` times its trust.

Defined results. Null URL or one without ``://``: host and path are empty, no
rule, verdict by the (unlinked) host ''. Null html: no edges. Repeated rows:
one result for each. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, table

#: Fixed values: (verdict, host, path) of the contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"
#: Hosts named by absolute or protocol-relative links and by mail addresses.
LINKS = r"""(?:(?:href|src)\s*=\s*["']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//|[A-Za-z0-9._%+-]@)((?:[A-Za-z0-9-]+\.)+[A-Za-z]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how often pages of one host name another; counted before the shuffle."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINKS), F.lit(1))).alias("dst"))
    return found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float, rounds: int, cut: int = 3) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` steps; lineage is cut every ``cut`` steps.

    hosts: (host, trust_seed, distrust_seed). Edges are already summed over
    pages, so a step moves one row for each pair of hosts.
    """
    out_n = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("out_n"))
    in_n = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("in_n"))
    # one arc list for both rankings: trust runs along a link, distrust against it
    arcs = Saved(
        edges.join(out_n.withColumnRenamed("host", "src"), "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out_n")).alias("w"), F.lit(True).alias("along"))
        .union(edges.join(in_n.withColumnRenamed("host", "dst"), "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("in_n")).alias("w"), F.lit(False).alias("along"))),
        "arcs",
    )
    now = hosts.select("*", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    if arcs.df.isEmpty():
        return now.select("host", "trust", "distrust")
    kept = None
    for k in range(rounds):
        sent = arcs.df.join(now, "host").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.when(F.col("along"), F.col("w") * F.col("trust")).otherwise(0.0)).alias("t"),
            F.sum(F.when(~F.col("along"), F.col("w") * F.col("distrust")).otherwise(0.0)).alias("d"),
        )
        part = lambda seed, got: (1 - damping) * F.col(seed) + damping * F.coalesce(F.col(got), F.lit(0.0))
        now = now.select("host", "trust_seed", "distrust_seed").join(sent, "host", "left").select("host", "trust_seed", "distrust_seed", part("trust_seed", "t").alias("trust"), part("distrust_seed", "d").alias("distrust"))
        if k % cut == cut - 1 or k == rounds - 1:
            new = Saved(now, "rank")
            if kept:
                kept.drop()
            kept, now = new, new.df
    arcs.drop()
    return now.select("host", "trust", "distrust")


def url_filter(pages: DataFrame, rules=RULES, damping: float = 0.85, rounds: int = 12, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages`` (page_id, url, html)."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = seen.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("hit"))
    # hosts that are only linked to take part with no seed of their own
    edges = Saved(host_edges(pages), "edges")
    own = judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("hit.verdict") == "allow").alias("a"), F.count_if(F.col("hit.verdict") == "block").alias("b"))
    linked = edges.df.select(F.explode(F.array("src", "dst")).alias("host")).distinct().select("host", F.lit(0).alias("n"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    share = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("n")), F.lit(0.0))
    hosts = Saved(own.union(linked).groupBy("host").agg(share("a").alias("trust_seed"), share("b").alias("distrust_seed")), "hosts")
    rank = propagate(hosts.df, edges.df, damping, rounds)
    by_host = rank.select("host", "trust", "distrust", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow").alias("by_host"))
    return judged.join(by_host, "host", "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "by_host", F.lit("allow")).alias("verdict"), "trust", "distrust"
    )


def brute(rows: list[tuple], rules=RULES, damping: float = 0.85, rounds: int = 12, ratio: float = 1.0) -> dict:
    """The same by plain Python over (page_id, url, html), for tests: page_id -> (host, path, rule, verdict)."""
    import re
    from collections import Counter

    low = str.maketrans(UPPER, LOWER)
    out, edges, seen = {}, Counter(), {}
    for pid, url, html in rows:
        m = re.search(PARTS, url or "")
        host, path = (m[1].translate(low), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        out[pid] = [host, path, best and best[1] + best[2], best and best[0]]
        n = seen.setdefault(host, [0, 0, 0])
        n[0] += 1
        n[1] += best is not None and best[0] == "allow"
        n[2] += best is not None and best[0] == "block"
        for x in re.findall(LINKS, html or ""):
            if x.translate(low) != host:
                edges[host, x.translate(low)] += 1
    names = {*seen, *(h for e in edges for h in e)}
    seed = {h: (seen[h][1] / seen[h][0], seen[h][2] / seen[h][0]) if h in seen else (0.0, 0.0) for h in names}
    outs, ins = Counter(), Counter()
    for (a, b), n in edges.items():
        outs[a] += n
        ins[b] += n
    t, d = {h: seed[h][0] for h in names}, {h: seed[h][1] for h in names}
    for _ in range(rounds if edges else 0):
        nt, nd = Counter(), Counter()
        for (a, b), n in edges.items():
            nt[b] += n / outs[a] * t[a]
            nd[a] += n / ins[b] * d[b]
        t = {h: (1 - damping) * seed[h][0] + damping * nt[h] for h in names}
        d = {h: (1 - damping) * seed[h][1] + damping * nd[h] for h in names}
    for v in out.values():
        v[3] = v[3] or ("block" if d[v[0]] > ratio * t[v[0]] else "allow")
    return {k: tuple(v) for k, v in out.items()}


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


