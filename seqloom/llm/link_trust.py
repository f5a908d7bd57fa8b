"""URL verdicts from rules, and from trust and distrust spread over host links.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they
block are distrusted seeds, each by the share of its pages. Trust runs along
links (who is linked from trusted hosts is trusted), distrust against them (who
links to distrusted hosts is distrusted), both as a personalised PageRank. A
page without a rule is blocked if the distrust of its host is above its trust
and above a threshold. As distrust is split over all hosts that link to the same
place, a page is also blocked if most of what its host could get over links, were
every host a seed, is distrust, and this share is above that of its trust. Both
shares are free of the number of hosts that link to the same place.

Scores are whole numbers of billionths, so the result doesn't depend on the
order of additions. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch

UNIT = 1_000_000_000


@dataclass(frozen=True)
class TrustConfig:
    """``damping``: percent of a score that comes over links; ``threshold``: least
    distrust that blocks, in units; ``linked_share``: least percent of distrust in what links bring
that blocks; ``write_every``: iterations between written tables."""

    damping: int = 85
    iterations: int = 20
    threshold: int = UNIT // 10
    linked_share: int = 50
    write_every: int = 5


#: The rules of the query, ``(verdict, host, path)``: host and subdomains, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits as ``host/path``, and its verdict; null if none fits."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links between different hosts. Links within a host say nothing about it."""
    targets = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"), F.lit(1))
    to = F.transform(
        targets,
        lambda t: F.when(t.rlike("(?i)^[a-z][a-z0-9+.-]*://"), host_of(t))
        .when(t.startswith("//"), ascii_lower(F.regexp_extract(t, "^//([^/?#]*)", 1)))
    )
    return (
        pages.where("host <> ''").select("host", F.explode(to).alias("dst"))
        .where("dst <> '' and dst <> host").groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def spread(seeds: DataFrame, links: DataFrame, scratch: Scratch, cfg: TrustConfig) -> DataFrame:
    """``(kind, host, score, linked)``: personalised PageRanks of several kinds side by side.

    ``seeds`` has ``(kind, host, seed)`` of all hosts, ``links`` ``(kind, src, dst, n, out)``. An
    iteration is one join and one aggregation. What a host without links would
    pass on is lost. ``linked`` is what came over links into the last score.
    """
    score, last = seeds.withColumn("score", F.col("seed")), None
    start = seeds.withColumn("got", F.lit(0).cast("long"))
    for k in range(1, cfg.iterations + 1):
        moved = links.join(score.select("kind", F.col("host").alias("src"), "score"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), F.lit(0).cast("long").alias("seed"), F.expr("cast(score as decimal(19,0)) * cast(n as decimal(19,0)) div cast(out as decimal(19,0))").alias("got")
        )
        score = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("seed").alias("seed"), F.sum("got").alias("got"))
        score = score.select(
            "kind", "host", F.expr(f"((100 - {cfg.damping}) * seed + {cfg.damping} * got) div 100").alias("score"),
            F.expr(f"{cfg.damping} * got div 100").alias("linked"),
        )
        if k % cfg.write_every == 0 or k == cfg.iterations:
            score, path = scratch.write(score, f"scores{k}")
            if last:
                scratch.drop(last)
            last = path
    return score


def judge(pages: DataFrame, rules=RULES, cfg: TrustConfig = TrustConfig()) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of every page.

    A null url, or one without ``://``, has an empty host and path, no rule and is
    allowed. Null html has no links. Repeated rows count as often as they
    occur; further columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "trust")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    found = found.withColumn("rule", name).withColumn("_verdict", verdict)
    per_host = found.where("host <> ''").groupBy("host").agg(
        F.expr(f"count_if(_verdict = 'allow') * {UNIT}L div count(1)").alias("good"),
        F.expr(f"count_if(_verdict = 'block') * {UNIT}L div count(1)").alias("bad"),
    )
    per_host, _ = scratch.write(per_host, "seeds")
    links, _ = scratch.write(host_links(found), "links")
    hosts = links.select(F.col("dst").alias("host")).unionByName(per_host.select("host")).distinct()
    seeds = hosts.join(per_host, "host", "left").select("host", F.explode(F.create_map(
        F.lit("good"), F.coalesce("good", F.lit(0)), F.lit("bad"), F.coalesce("bad", F.lit(0)),
        F.lit("most_good"), F.lit(UNIT).cast("long"), F.lit("most_bad"), F.lit(UNIT).cast("long"))).alias("kind", "seed"))
    seeds, _ = scratch.write(seeds, "hosts")
    both = links.select(F.explode(F.array(F.lit("good"), F.lit("most_good"))).alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.explode(F.array(F.lit("bad"), F.lit("most_bad"))).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    weighted, _ = scratch.write(both.join(out, ["kind", "src"]), "weighted")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    scores = spread(seeds, weighted, scratch, cfg).groupBy("host").agg(
        of("good", "score").alias("trust"), of("bad", "score").alias("distrust"), of("most_good", "score").alias("_most_trust"),
        of("bad", "linked").alias("_linked"), of("most_bad", "linked").alias("_most_linked"),
    )
    t, d = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    share = F.when(F.col("_most_linked") > 0, F.col("_linked") / F.col("_most_linked"))
    linked = (100 * share >= cfg.linked_share) & (share > t / F.col("_most_trust"))
    guess = F.when(((d > t) & (d >= cfg.threshold)) | linked, "block").otherwise("allow")
    return found.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_verdict", guess).alias("verdict"),
        t.alias("trust"), d.alias("distrust"),
    )


def oracle_sql(rules=RULES, cfg: TrustConfig = TrustConfig()) -> str:
    """The same in DuckDB's SQL, one step of a ranking per common table expression; the rankings
    from all hosts (``m``) tell what links could bring at most."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    name = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{h + p}'" for _, h, p in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{k}'" for k, h, p in order) + " END"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda x: low(f"regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1)")
    steps = []
    for kind, seed, links in (("t", "good", "forward"), ("d", "bad", "back"), ("mt", "most", "forward"), ("md", "most", "back")):
        steps.append(f"{kind}0 AS (SELECT host, {seed} AS seed, {seed} AS score, 0 AS linked FROM hosts)")
        for k in range(1, cfg.iterations + 1):
            was = f"{kind}{k - 1}"
            steps.append(f"""{kind}{k} AS MATERIALIZED (
                SELECT h.host, h.{seed} AS seed,
                  ((100 - {cfg.damping}) * h.{seed} + {cfg.damping} * coalesce(g.got, 0)) // 100 AS score,
                  {cfg.damping} * coalesce(g.got, 0) // 100 AS linked
                FROM hosts h LEFT JOIN (SELECT host, sum(got)::BIGINT AS got FROM (
                    SELECT l.dst AS host, s.score::HUGEINT * l.n // l.total AS got FROM {links} l JOIN {was} s ON l.src = s.host
                ) GROUP BY host) g ON h.host = g.host)""")
    n = cfg.iterations
    return f"""WITH parts AS (
        SELECT page_id, html, coalesce({host('url')}, '') AS host,
          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    found AS (SELECT *, {name} AS rule, {verdict} AS ruled FROM parts),
    per_host AS (SELECT host, count(*) FILTER (ruled = 'allow') * {UNIT} // count(*) AS good,
        count(*) FILTER (ruled = 'block') * {UNIT} // count(*) AS bad FROM found WHERE host <> '' GROUP BY host),
    targets AS (SELECT host, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)) AS t
        FROM found WHERE host <> ''),
    links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, CASE
          WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN {host('t')}
          WHEN starts_with(t, '//') THEN {low("regexp_extract(t, '^//([^/?#]*)', 1)")}
          END AS dst FROM targets) WHERE dst <> '' AND dst <> src GROUP BY src, dst),
    hosts AS MATERIALIZED (SELECT h.host, coalesce(p.good, 0) AS good, coalesce(p.bad, 0) AS bad, {UNIT}::BIGINT AS most
        FROM (SELECT dst AS host FROM links UNION SELECT host FROM per_host) h LEFT JOIN per_host p ON h.host = p.host),
    forward AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY src)::BIGINT AS total FROM links),
    back AS MATERIALIZED (SELECT dst AS src, src AS dst, n, sum(n) OVER (PARTITION BY dst)::BIGINT AS total FROM links),
    {", ".join(steps)}
    SELECT f.page_id, f.host, f.path, f.rule,
      coalesce(f.ruled, CASE WHEN d.score > t.score AND d.score >= {cfg.threshold}
          OR (md.linked > 0 AND 100 * d.linked / md.linked >= {cfg.linked_share} AND d.linked / md.linked > t.score / mt.score)
          THEN 'block' ELSE 'allow' END) AS verdict,
      coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust
    FROM found f LEFT JOIN t{n} t ON f.host = t.host LEFT JOIN d{n} d ON f.host = d.host
      LEFT JOIN mt{n} mt ON f.host = mt.host LEFT JOIN md{n} md ON f.host = md.host"""
