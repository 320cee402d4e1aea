"""URL filters: host and path rules, and link-graph propagation where no rule speaks. DataFrame functions only.

Host edges are the links of pages from host to host, loops left out. Trust is personalised PageRank from trusted
seeds; distrust is the same on reversed edges from blocked seeds, so a host that links to blocked hosts is
distrusted. Seeds are hosts most of whose pages a rule allows, or blocks. A host is blocked when its
distrust is more than ``threshold`` of its trust and distrust together; a host that neither reaches is allowed.

    rank = (1 - DAMPING) * seed + DAMPING * sum over edges in of rank(source) / links out of source

Rounds go on until every host that a seed reaches has been reached, however far, and no rank changes by more than
CHANGE of itself; a rank is then short of its limit by about CHANGE times the number of links from the seeds. (The SQL
has a fixed number of rounds.)

Edges are one row for each pair of hosts, summed before the shuffle, so the pages of a huge host meet as
partial counts. Each few rounds the ranks are written to the shared folder. What a host without links passes
on is lost, alike for trust and distrust.

A null url, or one without "://", has an empty host and path; no rule fits it, and it is allowed. Null html has no
links. Repeated pages each get a row, and their links count each time. Rules: the longest that fits wins, of equally long
ones the first by host and path; hosts fit with all their subdomains. A host whose shares of trust and distrust are equal
is allowed. An empty table gives no rows. Pages and urls of any length are read whole. Only the three columns named are
read, whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path): the rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
ROUNDS = 12
#: Change of a rank, as a share of it, below which it counts as settled.
CHANGE = 1e-12
#: Rounds between writes to the shared folder.
WRITE_EACH = 4
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. For rule lists of a few hundred; they become one expression."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, from absolute links in pages."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""), F.lit(1))
    edges = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return edges.where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def flow_of(edges: DataFrame, damping: float) -> DataFrame:
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    return common.materialize(edges.join(out, "src").select("src", "dst", (damping * F.col("links") / F.col("all")).alias("share")), "flow")


def moved(flow: DataFrame, rank: DataFrame) -> DataFrame:
    return flow.join(rank, flow["src"] == rank["host"]).select(F.col("dst").alias("host"), (F.col("share") * F.col("rank")).alias("rank"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, seed) over edges (src, dst, links), after so many rounds."""
    flow = flow_of(edges, damping)
    base = seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank"))
    rank = base
    if not flow.limit(1).count():
        return rank
    for k in range(1, rounds + 1):
        rank = base.union(moved(flow, rank)).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % WRITE_EACH == 0:
            rank = common.materialize(rank, "rank")
    return rank


def converged(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, change: float = CHANGE) -> DataFrame:
    """(host, rank): the same, with as many rounds as it takes."""
    flow = flow_of(edges, damping)
    base = seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank"))
    rank = base
    if not flow.limit(1).count():
        return rank
    while True:
        for _ in range(WRITE_EACH - 1):
            rank = base.union(moved(flow, rank)).groupBy("host").agg(F.sum("rank").alias("rank"))
        new = base.union(moved(flow, rank)).withColumn("before", F.lit(0.0))
        both = new.union(rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("before")))
        at = common.materialize(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")), "rank")
        rank = at.select("host", "rank")
        if not at.where(F.abs(F.col("rank") - F.col("before")) > change * F.col("rank")).limit(1).count():
            return rank


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each page."""
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    count = lambda v: F.sum(F.when(F.col("fit.verdict") == v, 1).otherwise(0))
    hosts = parts.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), count("allow").alias("good"), count("block").alias("bad"))
    hosts = common.materialize(hosts, "hosts")
    edges = common.materialize(host_edges(pages, url_col, html_col), "host-edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    good = hosts.where("2 * good > n").select("host", F.lit(1.0).alias("seed"))
    bad = hosts.where("2 * bad > n").select("host", F.lit(1.0).alias("seed"))
    trust = converged(edges, good).select("host", F.col("rank").alias("trust"))
    distrust = converged(back, bad).select("host", F.col("rank").alias("distrust"))
    scores = common.materialize(hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0), "host-scores")
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    blocked = F.coalesce((F.col("trust") + F.col("distrust") > 0) & (F.round(share, 9) > threshold), F.lit(False))
    own = F.when(blocked, "block").otherwise("allow")
    return parts.join(scores, "host", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_sql(rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same in SQL, the rounds written out one by one."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits.append((f"((host = '{h}' or host like '%.{h}') and starts_with(path, '{p}'))", h + p, verdict))
    case = lambda k: "case " + " ".join(f"when {f[0]} then '{f[k]}'" for f in fits) + " end"
    low = f"'{UPPER}', '{LOWER}'"
    ctes = [
        f"p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {low}) as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, html from pages)",
        f"j as (select *, {case(1)} as rule, {case(2)} as ruled from p)",
        "hosts as (select host, count(*) as n, count(*) filter (ruled = 'allow') as good, count(*) filter (ruled = 'block') as bad from j where host <> '' group by host)",
        f"""l as (select host as src, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s<>]+)', 1)), {low}) as dst from j)""",
        "e as (select src, dst, count(*) as links from l where src <> dst and src <> '' and dst <> '' group by src, dst)",
    ]
    for name, a, b, seed in (("t", "src", "dst", "good"), ("d", "dst", "src", "bad")):
        ctes.append(f"{name}f as (select {a} as src, {b} as dst, {damping} * links / sum(links) over (partition by {a}) as share from e)")
        ctes.append(f"{name}0 as (select host, {1 - damping} as rank from hosts where 2 * {seed} > n)")
        for k in range(1, rounds + 1):
            ctes.append(f"{name}{k} as (select host, sum(rank) as rank from (select host, rank from {name}0 union all select dst, share * rank from {name}f join {name}{k - 1} on src = host) group by host)")
    return "with " + ",\n".join(ctes) + f"""
select page_id, j.host, path, rule, coalesce(ruled, case when coalesce(t.rank, 0) + coalesce(d.rank, 0) > 0
  and round(coalesce(d.rank, 0) / (coalesce(t.rank, 0) + coalesce(d.rank, 0)), 9) > {threshold} then 'block' else 'allow' end) as verdict
from j left join t{rounds} t on t.host = j.host left join d{rounds} d on d.host = j.host and exists (select 1 from hosts h where h.host = j.host)
"""
