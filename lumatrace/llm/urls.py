"""URL filter: rules first, then trust and distrust that links carry between hosts.

Trust starts at hosts whose pages rules allow and follows links (personalised PageRank); distrust
starts at hosts whose pages rules block and goes against links, to those who link there. Both are
DataFrame joins over host edges; a host is blocked if its distrust passes a threshold and its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, discard, materialize, read

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, ROUNDS = 0.85, 10
#: Distrust of a host of which half the pages are blocked and to which no link carries more.
BLOCK_FROM = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.translate(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): how many links lead from pages of one host to another host; relative links stay on their host.

    Links are ``href`` values as they are written: those in comments and scripts count, and character references,
    which no host needs, aren't decoded.
    """
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(HREF), 1)).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    hosts = links.select("src", host_of(target).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst")
    return hosts.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def host_scores(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of (host, trust, distrust) seeds in [0, 1] over (src, dst, weight) edges.

    Scores are linear in the seeds and not normalised to sum 1, so that thresholds hold at any size
    of the graph. Each round is a join on the source of the edges and a map-side combined sum, for
    both directions in one; it is written to the shared folder.
    """
    seeds = materialize(seeds.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0")))
    start = seeds.select("host", (F.col("t0") * (1 - damping)).alias("trust"), (F.col("d0") * (1 - damping)).alias("distrust"))
    edges = materialize(edges)
    if edges.isEmpty():
        return start  # the fixed point of seeds that nothing leaves
    out = edges.groupBy(F.col("src").alias("o")).agg(F.sum("weight").alias("all_out"))
    into = edges.groupBy(F.col("dst").alias("i")).agg(F.sum("weight").alias("all_in"))
    shares = materialize(edges.join(materialize(out), F.col("src") == F.col("o")).join(materialize(into), F.col("dst") == F.col("i")).select("src", "dst", (F.col("weight") / F.col("all_out")).alias("forward"), (F.col("weight") / F.col("all_in")).alias("back")))
    ways = materialize(shares.select(F.col("src").alias("from"), F.col("dst").alias("to"), "forward", F.lit(0.0).alias("back")).union(shares.select("dst", "src", F.lit(0.0), "back")))
    state = materialize(start)
    for _ in range(rounds):
        moved = ways.join(state, ways["from"] == state["host"]).select(F.col("to").alias("host"), (F.col("trust") * F.col("forward") * damping).alias("trust"), (F.col("distrust") * F.col("back") * damping).alias("distrust"))
        state = materialize(start.union(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    return state


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", block_from: float = BLOCK_FROM, damping: float = DAMPING) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to each row.

    The longest rule that fits decides. Otherwise the host does: its seeds are the shares of its pages
    that rules allow and block, and it is blocked if its distrust, as a multiple of what a seed of 1
    keeps, reaches ``block_from`` and is above its trust; a host that nothing is known of is allowed, as is
    a url that is null or has no ``://`` (host and path empty). Null pages have no links. Repeated rows
    are judged each and count each. Columns of the added names are replaced.
    """
    first = len(WRITTEN)
    named = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.coalesce(url, F.lit(""))), "path": path_of(F.coalesce(url, F.lit("")))})
    ruled = named.withColumn("__found", longest_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("__found.verdict") == v, 1.0).otherwise(0.0))
    seeds = ruled.filter("host <> ''").select("host", "__found").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = host_scores(seeds.filter("trust > 0 OR distrust > 0"), host_edges(pages, url, html), damping)
    distrust, trust = (F.round(F.col(c) / (1 - damping), 9) for c in ("distrust", "trust"))
    blocked = materialize(scores.filter((distrust >= block_from) & (distrust > trust)).select(F.col("host").alias("__blocked")))
    discard(pages.sparkSession, WRITTEN[first:-1])  # only the blocked hosts are read again
    joined = ruled.join(blocked, ruled["host"] == F.col("__blocked"), "left")
    verdict = F.coalesce(F.col("__found.verdict"), F.when(F.col("__blocked").isNotNull(), "block").otherwise("allow"))
    return joined.withColumns({"rule": F.col("__found.rule"), "verdict": verdict}).drop("__found", "__blocked")


def op3_urls(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    host = lambda u: f"(CASE WHEN instr({u}, '://') > 0 THEN translate(regexp_extract(substring({u}, instr({u}, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END)"
    path = "(CASE WHEN instr(u, '://') > 0 THEN regexp_extract(substring(u, instr(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END)"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    keep = 1 - DAMPING
    rounds = "".join(f"""
s{i + 1} AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (SELECT * FROM s0
  UNION ALL SELECT dst, trust * w / ao * {DAMPING}, 0.0 FROM sh JOIN s{i} ON src = host
  UNION ALL SELECT src, 0.0, distrust * w / ai * {DAMPING} FROM sh JOIN s{i} ON dst = host) GROUP BY host),""" for i in range(ROUNDS))
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, html FROM pages),
h AS (SELECT page_id, html, {host('u')} AS host, {path} AS path FROM p),
r AS (SELECT *, {rule} AS rule, {verdict} AS v FROM h),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS k FROM h),
e AS (SELECT src, {host("(CASE WHEN starts_with(k, '//') THEN 'http:' || k ELSE k END)")} AS dst FROM l),
g AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM e WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
sh AS (SELECT src, dst, w, sum(w) OVER (PARTITION BY src) AS ao, sum(w) OVER (PARTITION BY dst) AS ai FROM g),
seeds AS (SELECT host, avg(CASE WHEN v = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN v = 'block' THEN 1.0 ELSE 0.0 END) AS d FROM r WHERE host <> '' GROUP BY host),
s0 AS (SELECT host, CAST(t AS DOUBLE) * {keep} AS trust, CAST(d AS DOUBLE) * {keep} AS distrust FROM seeds WHERE t > 0 OR d > 0),{rounds}
b AS (SELECT host FROM s{ROUNDS} WHERE round(distrust / {keep}, 9) >= {BLOCK_FROM} AND round(distrust / {keep}, 9) > round(trust / {keep}, 9))
SELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN b ON r.host = b.host
"""


OP3_SQL = _sql()
