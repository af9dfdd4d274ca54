"""URL filters: rules by host and path, and for the rest trust that flows along links between hosts.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
fitting rule decides. Pages without one get the verdict of their host:

- seeds: hosts at least half of whose pages rules allow (trust) or block (distrust), with that share;
- edges: links with a host in the pages' HTML, counted per pair of hosts, links inside a host left out;
- trust is personalised PageRank over the edges: a host keeps ``RESTART`` of its seed and gets the rest of
  what the hosts linking to it have, each divided by its links; distrust runs over reversed edges, so who
  links to distrusted hosts is distrusted;
- a host is blocked if its distrust is above its trust and reaches ``THRESHOLD``, a hundredth of what a wholly
  blocked host has by itself. A host with some blocked pages and no such links keeps its other pages.

Scores are whole numbers (``UNIT`` is a seed of 1), rounded down at every edge, so results don't depend on
the order of addition, nor on tasks that run twice. Each of at most ``TURNS`` turns is an aggregation over
the edges, written to the shared folder; it ends before if nothing changes. Hosts that link nowhere keep
nothing back for the seeds: that would scale all scores of a propagation alike.

Pages are read as (page_id, url) and, once, for their links; pages meet host verdicts in a salted join, so a
host may hold a third of all pages. Null url or one without `://`: host and path are empty, such pages
belong to the host ''. Null HTML has no links. Repeated rows count as pages. Empty input gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SALTS, salted_left_join
from docloom.session import through_table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UNIT = 1_000_000_000_000
RESTART_PERCENT = 15
THRESHOLD = UNIT * RESTART_PERCENT // 100 // 100
TURNS = 30
# Absolute links and those without a scheme; the host ends where a url's does, or where the attribute ends.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]*)"""


def host_of(url: Column) -> Column:
    """From behind the first `://` to the next `/`, `?` or `#`, A-Z lower-cased; '' without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the end of the host to the next `?` or `#`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equally long ones the first listed."""
    chosen = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        row = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, row) if chosen is None else chosen.when(fits, row)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if chosen is None else chosen


def ruled_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (null without a rule)."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict")
    )


def host_seeds(ruled: DataFrame) -> DataFrame:
    """host, trust, distrust: the share of UNIT of its pages with that verdict by rule, below half nothing."""

    def share(verdict: str) -> Column:
        own, pages = F.count_if(F.col("verdict") == verdict), F.count(F.lit(1))
        part = F.call_function("div", own.cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(13,0)"), pages)
        return F.when(2 * own >= pages, part).otherwise(F.lit(0).cast("bigint"))

    return ruled.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: links between different hosts."""
    found = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(found).alias("dst"))
    dst = F.translate("dst", string.ascii_uppercase, string.ascii_lowercase)
    counted = links.select("src", dst.alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))
    return counted.filter("src != dst AND src != '' AND dst != ''")


def propagated(seeds: DataFrame, edges: DataFrame, turns: int = TURNS) -> DataFrame:
    """host, score: ``seeds`` (host, score) flowing along ``edges`` (src, dst, links).

    A source's edges are dealt to SALTS parts by their destination and meet its score in each, so a host that
    links to very many doesn't land in one task.
    """
    salt = F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")
    out = edges.groupBy("src").agg(F.sum("links").alias("out"))
    edges = through_table(
        salted_left_join(edges, out, ["src"]).withColumn("salt", salt).select("src", "salt", "dst", "links", "out"), "trust-edges"
    )
    decimal = "decimal(20,0)"
    given = F.call_function(
        "div",
        F.col("score").cast(decimal) * F.col("links").cast("decimal(15,0)") * F.lit(100 - RESTART_PERCENT).cast("decimal(3,0)"),
        F.col("out").cast("decimal(15,0)") * F.lit(100).cast("decimal(3,0)"),
    )
    base = seeds.filter("score > 0").select("host", F.expr(f"score * {RESTART_PERCENT} div 100").alias("score"))
    base = through_table(base, "trust-base")
    scores, before = base, None
    for _ in range(turns):
        parts = scores.select(
            F.col("host").alias("src"), "score", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        )
        flow = edges.join(parts, ["src", "salt"]).select(F.col("dst").alias("host"), given.alias("score"))
        scores = base.unionByName(flow).groupBy("host").agg(F.sum("score").alias("score")).filter("score > 0")
        scores = through_table(scores, "trust-scores")
        state = scores.agg(
            F.count(F.lit(1)), F.sum(F.col("score").cast("decimal(38,0)")), F.sum(F.xxhash64("host", "score").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    return scores


def host_verdicts(pages: DataFrame, ruled: DataFrame) -> DataFrame:
    """host, trust, distrust, blocked for every host that has a score."""
    seeds = through_table(host_seeds(ruled), "trust-seeds")
    edges = through_table(host_edges(pages), "trust-links")
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = propagated(seeds.select("host", F.col("trust").alias("score")), edges)
    distrust = propagated(seeds.select("host", F.col("distrust").alias("score")), backward)
    zero = F.lit(0).cast("bigint")
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    scores = both.select("host", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= THRESHOLD)
    return scores.withColumn("blocked", blocked)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    ruled = through_table(ruled_pages(pages, rules), "trust-pages")
    blocked = host_verdicts(pages, ruled).filter("blocked").select("host", "blocked")
    decided = ruled.filter("verdict IS NOT NULL")
    rest = salted_left_join(ruled.filter("verdict IS NULL").drop("verdict"), blocked, ["host"])
    verdict = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return decided.unionByName(rest.select("page_id", "host", "path", "rule", verdict.alias("verdict")))


def judge_sql(rules: Sequence[tuple[str, str]] = RULES, turns: int = TURNS) -> str:
    """The same in DuckDB SQL, one table per turn."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    whens = ""
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        whens += f" WHEN (host = '{own}' OR suffix(host, '.{own}')) AND prefix(path, '{slash}{rest}') THEN '{verdict} {rule}'"
    link = LINK.replace("'", "''")
    steps = [
        rf"""
        u AS (
            SELECT page_id, html,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), r AS MATERIALIZED (
            SELECT *, CASE {whens} END AS found FROM u
        ), c AS (
            SELECT host, count(*) AS n, CAST(count(*) FILTER (starts_with(found, 'allow')) AS HUGEINT) AS a,
                   CAST(count(*) FILTER (starts_with(found, 'block')) AS HUGEINT) AS b
            FROM r GROUP BY host
        ), s AS MATERIALIZED (
            SELECT host, CASE WHEN 2 * a >= n THEN a * {UNIT} // n ELSE 0 END AS trust,
                   CASE WHEN 2 * b >= n THEN b * {UNIT} // n ELSE 0 END AS distrust
            FROM c
        ), l AS (
            SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{upper}', '{lower}') AS dst
            FROM u
        ), trust_e AS MATERIALIZED (
            SELECT src, dst, count(*) AS links FROM l WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
        ), distrust_e AS MATERIALIZED (
            SELECT dst AS src, src AS dst, links FROM trust_e
        )"""
    ]
    for kind in ("trust", "distrust"):
        steps.append(f"{kind}_o AS MATERIALIZED (SELECT src, sum(links) AS out FROM {kind}_e GROUP BY src)")
        steps.append(f"{kind}_0 AS MATERIALIZED (SELECT host, {kind} * {RESTART_PERCENT} // 100 AS score FROM s WHERE {kind} > 0)")
        for i in range(turns):
            steps.append(
                f"""{kind}_{i + 1} AS MATERIALIZED (
                    SELECT host, sum(score) AS score FROM (
                        SELECT host, score FROM {kind}_0 UNION ALL
                        SELECT e.dst, (t.score * e.links * {100 - RESTART_PERCENT}) // (o.out * 100)
                        FROM {kind}_{i} t JOIN {kind}_e e ON e.src = t.host JOIN {kind}_o o ON o.src = t.host
                    ) GROUP BY host HAVING sum(score) > 0)"""
            )
    return f"""
        WITH {", ".join(steps)}
        SELECT r.page_id, r.host, r.path, split_part(r.found, ' ', 2) AS rule,
               CASE WHEN r.found IS NOT NULL THEN split_part(r.found, ' ', 1)
                    WHEN d.score > coalesce(t.score, 0) AND d.score >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
        FROM r LEFT JOIN trust_{turns} t ON t.host = r.host LEFT JOIN distrust_{turns} d ON d.host = r.host
    """
