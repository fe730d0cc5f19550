"""URL rules, and trust and distrust propagated over the host graph.

Rules are (verdict, host, path). A rule fits its host and all its subdomains if the url's path
starts with the rule's path; the longest rule (host and path together) wins, equally long ones by
text. Urls no rule fits get their host's verdict from the graph:

* Nodes are hosts. An edge is a link found in a page (absolute or ``//`` urls in href and src),
  weighted by the number of such links; links to the own host say nothing. Without ``labels``
  every domain and its parent, up to the last label, also point at each other, weighted by the
  domain's pages; so hosts are joined over all parent domains. With ``labels`` only a host of
  more labels and its site (the last labels) do, weighted by the host's pages.
* A host is a trusted seed with the number of its allowed pages and a blocked seed with the
  number of its blocked pages; with ``majority`` only if that is most of its pages.
* Trust is personalised PageRank from the trusted seeds along the edges; distrust is the same
  from the blocked seeds against the edges, so a host that links to blocked hosts gets some.
  Hosts without edges in the direction keep nothing to pass on; sending their share back to the
  seeds would only scale all scores, and both are normalised to a sum of one in the end.
* A host is blocked if distrust / (trust + distrust) is above ``MOST_DISTRUST``. A host neither
  reaches is allowed.

``op2_url_filter`` uses all parent domains and all ruled hosts; ``judge`` alone defaults to
``SITE_LABELS`` and majorities.

Contract: one row per input row. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end; both are empty for a null url or
one without ``://``, which no rule and no score applies to. Null pages have no links. Repeated
rows count as often as they come. An empty table gives no rows. Extra columns are ignored.

Scale. Pages are read twice and never shuffled with their html; everything iterated is one row
per host or host pair. Scores are written each round, so both sides of the join are plain tables
and a hub's edges can be split over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnsift.operators.durable import written

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
ROUNDS = 20
SITE_LABELS = 3
MOST_DISTRUST = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def host_rules(hosts: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """host, rules: what may apply to a host, the longest rule first."""
    if not isinstance(rules, DataFrame):
        rules = hosts.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    listed = rules.select(
        F.col("host").alias("domain"),
        F.struct(
            (-F.length(F.concat("host", "path"))).alias("order"),
            F.concat("host", "path").alias("rule"), "path", "verdict",
        ).alias("one"),
    )
    return (
        hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("domain"))
        .join(listed, "domain")
        .groupBy("host")
        .agg(F.sort_array(F.collect_set("one")).alias("rules"))
    )


def _first_fit(path: Column, rules: Column) -> Column:
    return F.try_element_at(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(1))


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight between different hosts."""
    link = F.col("link")
    absolute = F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link)).otherwise(link)
    return (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
        .select("src", host_of(absolute).alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def site_edges(hosts: DataFrame, labels: int = SITE_LABELS) -> DataFrame:
    """Edges both ways between deep hosts and their site."""
    parts = F.split("host", r"\.")
    deep = hosts.filter(F.size(parts) > labels).select(
        F.col("host").alias("src"),
        F.array_join(F.slice(parts, -labels, labels), ".").alias("dst"),
        F.col("n_pages").cast("double").alias("weight"),
    )
    return deep.unionByName(deep.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """Edges both ways between every domain of the hosts and its parent."""
    domains = (
        hosts.select(F.explode(_suffixes(F.col("host"))).alias("src"), "n_pages")
        .groupBy("src").agg(F.sum("n_pages").cast("double").alias("weight"))
    )
    up = domains.select("src", F.regexp_extract("src", r"(?s)^[^.]*\.(.*)$", 1).alias("dst"), "weight").filter("src <> '' AND dst <> ''")
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _steps(edges: DataFrame) -> DataFrame:
    """kind, src, dst, share: trust goes along the edges, distrust against them."""
    along = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    against = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = along.unionByName(against).groupBy("kind", "src", "dst").agg(F.sum("weight").alias("weight"))
    both = written(both, "url-steps")
    out = written(both.groupBy("kind", "src").agg(F.sum("weight").alias("total")), "url-totals")
    return written(
        both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")),
        "url-steps",
    )


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust from seeds (kind, host, weight) and edges (src, dst, weight)."""
    steps = _steps(edges)
    totals = {r.kind: r.total for r in seeds.groupBy("kind").agg(F.sum("weight").alias("total")).collect()}
    whole = F.when(F.col("kind") == "trust", F.lit(totals.get("trust", 1.0))).otherwise(F.lit(totals.get("distrust", 1.0)))
    start = written(seeds.select("kind", "host", (F.col("weight") / whole).alias("score")), "url-seeds")
    stay = start.withColumn("score", F.col("score") * (1 - damping))
    scores = start
    for _ in range(rounds if not steps.isEmpty() else 0):
        moved = scores.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")
        )
        scores = written(
            moved.unionByName(stay).groupBy("kind", "host").agg(F.sum("score").alias("score")), "url-scores"
        )
    sums = {r.kind: r.total for r in scores.groupBy("kind").agg(F.sum("score").alias("total")).collect()}

    def share(kind: str) -> Column:
        own = F.sum(F.when(F.col("kind") == kind, F.col("score")))
        return F.round(F.coalesce(own, F.lit(0.0)) / (sums.get(kind) or 1.0), 12).alias(kind)

    return scores.groupBy("host").agg(share("trust"), share("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES,
          most_distrust: float = MOST_DISTRUST, damping: float = DAMPING, rounds: int = ROUNDS,
          labels: int | None = SITE_LABELS, majority: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    urls = written(
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "url-pages"
    )
    hosts = written(urls.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")), "url-hosts")
    ruled = written(host_rules(hosts, rules), "url-rules")
    found = written(
        urls.join(ruled, "host", "left").withColumn("fit", _first_fit(F.col("path"), F.col("rules")))
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule")),
        "url-ruled",
    )
    by_host = found.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.col("by_rule") == "allow").alias("trust"),
        F.count_if(F.col("by_rule") == "block").alias("distrust"),
    )
    seeds = by_host.select(
        "host", "n_pages", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "weight")
    ).filter(2 * F.col("weight") > F.col("n_pages") if majority else F.col("weight") > 0).select("kind", "host", "weight")
    edges = link_edges(pages).unionByName(domain_edges(hosts) if labels is None else site_edges(hosts, labels))
    scores = written(propagate(seeds, edges, damping, rounds), "url-shares")
    bad = F.col("distrust") > most_distrust * (F.col("trust") + F.col("distrust"))
    by_graph = F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")
    return found.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels=None, majority=False)
