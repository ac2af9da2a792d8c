"""URL filters: rules on hosts and paths, and trust that hosts pass on by links.

A rule names a host with all its subdomains and the start of a path; the longest
that fits a url decides. Urls that no rule fits are judged by their host:

- Hosts whose pages the rules allow are trusted seeds, those whose pages they
  block distrusted ones, by the share of such pages among the host's, in
  millionths.
- Trust is a personalised PageRank: a host passes 85 % of what it gets in equal
  parts to the hosts that its pages link to. Distrust runs over the same edges
  in reverse, from a blocked host to those that link to it. Both are summed
  round by round in whole numbers, so the order of sums doesn't matter, and end
  after a fixed number of rounds or when nothing is left to pass on.
- A host's other pages are blocked where distrust is at least half a seed above
  trust, else allowed.

Only DataFrame functions are used. Counts of pages and edges have partial sums
before they are shuffled; hosts are joined as equal keys that adaptive execution
can split, pages only where no rule fits. Each round is a table in the shared
folder.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule, no links and is allowed; a url of an empty path fits no rule. A null
html has no links. Links are ``href`` values that name a host (absolute, or
after ``//``); repeated links count once, those to the own host not at all. Of rules of equal length that fit, the
blocking one wins. Repeated rows are answered each and count as pages each; a
null id is kept; an empty table gives an empty result; other columns aren't
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored, table

#: (verdict, host, path) of the production rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: What a seed of all its pages weighs; the share that is passed on, in hundredths; rounds; the excess of distrust that blocks.
SEED, DAMPING, ROUNDS, EXCESS = 1_000_000, 85, 20, 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts of links that name one.
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s]+)"""


def _lowered(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(_lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits, else null."""
    found = F.lit(None)
    for verdict, of_host, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(of_host + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): distinct links between different hosts."""
    links = F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))
    each = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("dst")).withColumn("dst", _lowered(F.col("dst")))
    return each.filter((F.col("src") != "") & (F.col("src") != F.col("dst"))).distinct()


def passed_on(seeds: DataFrame, edges: DataFrame, value: str, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """(host, value): seeds (host, value) and all that reaches a host along (src, dst)."""
    name = f"url-{value}"
    ways = edges.groupBy("src").agg(F.count("*").alias("ways"))
    edges = stored(edges.join(ways, "src"), "url-ways")
    total = now = stored(seeds.filter(F.col(value) > 0).select("host", value), name)
    if edges.isEmpty():
        return total
    for _ in range(rounds):
        share = F.expr(f"{value} * {int(damping)} div (100 * ways)")
        sent = now.join(edges, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg(F.sum(share).alias(value))
        now = stored(sent.filter(F.col(value) > 0), name)
        if now.isEmpty():
            break
        total = stored(total.unionByName(now).groupBy("host").agg(F.sum(value).alias(value)), name)
    return total


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS, excess: int = EXCESS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row, with the host's trust and distrust where the method judged."""
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("_by", by_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.expr(f"{SEED} * count_if(_by.verdict = '{verdict}') div count(*)")
    seeds = own.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = stored(seeds.filter((F.col("trust") > 0) | (F.col("distrust") > 0)), "url-seeds")
    edges = stored(host_edges(pages, url_col, html_col), "url-edges")
    trust = passed_on(seeds, edges, "trust", rounds)
    distrust = passed_on(seeds, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "distrust", rounds)
    hosts = trust.join(distrust, "host", "full")
    ruled, open_ = own.filter(F.col("_by").isNotNull()), own.filter(F.col("_by").isNull())
    none = F.lit(None).cast("long")
    first = ruled.select("page_id", "host", "path", F.col("_by.rule").alias("rule"), F.col("_by.verdict").alias("verdict"), none.alias("trust"), none.alias("distrust"))
    score = F.coalesce("distrust", F.lit(0)) - F.coalesce("trust", F.lit(0))
    rest = open_.join(hosts, "host", "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(score >= excess, "block").otherwise("allow").alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    return first.unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all pages by the production rules."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle(rules: list[tuple[str, str, str]] = RULES, rounds: int = ROUNDS, excess: int = EXCESS) -> str:
    """The same in DuckDB's SQL."""
    whens = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")))
    # A recursive step over the hosts that something has reached; every round sends whole numbers.
    walk = lambda value, a, b: f"""
{value}_ways AS (SELECT {a} AS src, {b} AS dst, count(*) OVER (PARTITION BY {a}) AS ways FROM edges),
{value}_sent AS (
  SELECT host, {value} AS value, 0 AS k FROM seeds WHERE {value} > 0
  UNION ALL
  SELECT dst, CAST(sum(value * {DAMPING} // (100 * ways)) AS BIGINT), k + 1 FROM {value}_sent JOIN {value}_ways ON src = host WHERE k < {rounds} GROUP BY dst, k HAVING sum(value * {DAMPING} // (100 * ways)) > 0),
{value}_all AS (SELECT host, sum(value) AS value FROM {value}_sent GROUP BY host)"""  # noqa: E731
    link = LINK.replace("'", "''")
    return f"""WITH RECURSIVE p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {whens} END AS by_rule FROM p),
seeds AS (
  SELECT host, {SEED} * count(*) FILTER (WHERE prefix(by_rule, 'allow')) // count(*) AS trust, {SEED} * count(*) FILTER (WHERE prefix(by_rule, 'block')) // count(*) AS distrust
  FROM r GROUP BY host),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM r WHERE host <> ''),
edges AS (SELECT DISTINCT src, dst FROM links WHERE src <> dst),{walk("trust", "src", "dst")},{walk("distrust", "dst", "src")}
SELECT page_id, r.host, path, substr(by_rule, 7) AS rule,
  CASE WHEN by_rule IS NOT NULL THEN substr(by_rule, 1, 5) WHEN coalesce(d.value, 0) - coalesce(t.value, 0) >= {excess} THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN trust_all t ON t.host = r.host LEFT JOIN distrust_all d ON d.host = r.host"""


ORACLE = oracle()
