"""URL verdicts: rules where one fits, else trust and distrust carried over the link graph of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.common import table
from docket.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
# (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
KEEP = 0.85  # part of a host's score that follows its links; the rest returns to the seeds
ROUNDS = 20  # of the SQL check; the given pages, without links between hosts, are settled long before
TOLERANCE = 0.01  # mass that may still move when the propagation ends, as part of one page's share
STRIDE = 5  # rounds between two tests of convergence
LIFT = 2.0  # a host is blocked when it holds this many times the distrust its share of pages would give it, and less trust


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def parsed(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, ruled) of every page."""
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("*", rule.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts. A link without a host stays on its own; one that starts with // names a host."""
    link = F.explode(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.select(host_of(F.col("url").cast("string")).alias("src"), link.alias("link")).filter("src <> ''")
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    target = host_of(whole)
    links = links.select("src", F.when(target == "", F.col("src")).otherwise(target).alias("dst"))
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def host_scores(pages: DataFrame, rules: Sequence[tuple[str, str, str]], tolerance: float = TOLERANCE, keep: float = KEEP) -> DataFrame:
    """(host, share, trust, distrust): part of all pages, and the two scores, each summing to one over all hosts where it has
    seeds and to nothing where it has none.

    Personalised PageRank runs from the hosts of allowed pages along links, and from the hosts of blocked pages against them,
    both in one table of steps (kind, host, to, part). Seeds weigh by their pages. What a host without a link
    that way holds goes back to the seeds: the sums let it go and are brought to one at the end, which is the same. Sums are partial before each shuffle, so a host with a third of all links is no hot task; every ``STRIDE``
    rounds the scores are written to the shared folder, which keeps plans short, and compared with the ones before. A round leaves
    at most ``keep`` of the distance to the end, so that change bounds what is left; rounds go on until this is less than ``tolerance`` of
    one page's share of each kind's scores, or the accuracy of the sums."""
    known = parsed(pages, rules).filter("host <> ''")
    counts = stored(
        known.groupBy("host").agg(
            F.count(F.lit(1)).alias("pages"),
            F.count(F.when(F.col("ruled") == "allow", 1)).alias("allow"),
            F.count(F.when(F.col("ruled") == "block", 1)).alias("block"),
        )
    )
    edges = stored(host_edges(pages))
    total = counts.agg(F.sum("pages"), F.sum("allow"), F.sum("block")).first()
    n_pages, n_allow, n_block = (x or 0 for x in total)
    ways = edges.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").union(
        edges.select(F.lit(1), "dst", "src", "weight")
    )
    sums = ways.groupBy("kind", "host").agg(F.sum("weight").alias("out"))
    steps = stored(ways.join(sums, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("out")).alias("part")))
    seeds = counts.select(F.lit(0).alias("kind"), "host", (F.col("allow") / max(n_allow, 1)).alias("score")).union(
        counts.select(F.lit(1), "host", F.col("block") / max(n_block, 1))
    )
    seeds = stored(seeds.filter("score > 0"))
    state = seeds
    back = seeds.select("kind", "host", (F.col("score") * (1 - keep)).alias("score"))
    left = keep**STRIDE / (1 - keep**STRIDE)
    while True:
        before = state
        for _ in range(STRIDE):
            moved = steps.join(state, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("part") * keep).alias("score"))
            state = moved.union(back).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        state = stored(state)
        both = state.select("kind", "host", "score", F.col("score").alias("change")).union(before.select("kind", "host", F.lit(0.0), -F.col("score")))
        both = both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.abs(F.sum("change")).alias("change"))
        sums = both.groupBy("kind").agg(F.sum("score"), F.sum("change")).collect()  # two numbers of each kind
        if all(change * left <= total * max(tolerance / max(n_pages, 1), 1e-13) for _, total, change in sums):
            break
    totals = {kind: total for kind, total, _ in sums}
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)) / totals.get(kind, 1.0)
    flat = state.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))
    return counts.select("host", (F.col("pages") / max(n_pages, 1)).alias("share")).join(flat, "host", "left").na.fill(0.0)


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, lift: float = LIFT) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page; repeated and null ids give a row each.

    The longest rule that fits decides. Elsewhere the host decides: blocked when its distrust is at least ``lift`` times its
    share of pages and above its trust, else allowed. A null url, or one without ://, has empty host and path and is allowed.
    Null html has no links; other columns are ignored; an empty table gives no rows."""
    scores = host_scores(pages, rules)
    blocked = scores.filter((F.col("distrust") >= F.col("share") * lift) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("judged"))
    out = parsed(pages, rules).join(blocked, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    return url_verdicts(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in RULES]
    by_length = sorted(range(len(RULES)), key=lambda i: -len(RULES[i][0] + RULES[i][1]))
    rule = " ".join(f"WHEN {fits[i]} THEN '{RULES[i][0]}{RULES[i][1]}'" for i in by_length)
    says = " ".join(f"WHEN {fits[i]} THEN '{RULES[i][2]}'" for i in by_length)
    host = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    rounds = "".join(
        f""",
s{i + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
  SELECT kind, to_host AS host, score * part * {KEEP} AS score FROM steps JOIN s{i} USING (kind, host)
  UNION ALL SELECT kind, host, score * (1 - {KEEP}) FROM s0) GROUP BY ALL)"""
        for i in range(ROUNDS)
    )
    return f"""
WITH parts AS (SELECT page_id, {host('url')} AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
judged AS (SELECT *, CASE {rule} END AS rule, CASE {says} END AS ruled FROM parts),
counts AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block
           FROM judged WHERE host <> '' GROUP BY host),
links AS (SELECT {host('url')} AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM pages),
targets AS (SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links WHERE src <> ''),
edges AS (SELECT src, CASE WHEN dst = '' THEN src ELSE dst END AS dst, count(*) AS weight FROM targets GROUP BY ALL),
ways AS (SELECT 0 AS kind, src AS host, dst AS to_host, weight FROM edges UNION ALL SELECT 1, dst, src, weight FROM edges),
steps AS MATERIALIZED (SELECT kind, host, to_host, weight / sum(weight) OVER (PARTITION BY kind, host) AS part FROM ways),
s0 AS MATERIALIZED (SELECT * FROM (
  SELECT 0 AS kind, host, allow / greatest(sum(allow) OVER (), 1) AS score FROM counts
  UNION ALL SELECT 1, host, block / greatest(sum(block) OVER (), 1) FROM counts) WHERE score > 0){rounds},
final AS (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM s{ROUNDS}),
blocked AS (SELECT host FROM counts LEFT JOIN final USING (host) GROUP BY host, n
  HAVING coalesce(sum(score) FILTER (kind = 1), 0) >= n / (SELECT sum(n) FROM counts) * {LIFT}
     AND coalesce(sum(score) FILTER (kind = 1), 0) > coalesce(sum(score) FILTER (kind = 0), 0))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""


CHECKS = {"op8_url_filter": _sql()}
