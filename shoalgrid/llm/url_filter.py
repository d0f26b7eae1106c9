"""URL filters: host-suffix and path-prefix expressions, joined on short digests, then confirmed.

Every URL is expanded into the expressions ``suffix-of-host`` + ``prefix-of-path`` that a rule
could be written as. Rules and expressions meet in an equi-join on the first four bytes of their
SHA-256 digest; pairs that meet are confirmed by the whole digest, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.shared import LOWER, UPPER, skewed_left_join, staged, table

#: (host, path, verdict), as the contract gives them.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", rules_bound: int = 50_000) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``; columns of these names are replaced.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the path of the
    URL starts with the rule's; the longest ``host + path`` wins, and of rules that are equal
    the verdict that sorts first. Null hosts, paths or verdicts make no rule. URLs that are null
    or have no ``://`` have an empty host and path, which no rule fits: ``rule`` is null and
    ``verdict`` is ``default``. Rows, also repeated ones, are all kept. Expansion is per distinct
    (host, path), so a host that fills a third of the table is expanded once per path.

    Only expressions with a label count and a path length that some rule has are made; both
    sets are read from the rules (their sizes are bounded by the longest host and path). The
    rules are broadcast only if counted within ``rules_bound``, the URLs that a rule hits only if
    they, written, take no more bytes than ``skewed_left_join`` allows; beyond it the same equi-joins
    shuffle.
    """
    known = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .select(
            F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"),
            F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"),
            F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"), F.length(F.concat("host", "path")).alias("size"),
        ).withColumn("short", F.substring("digest", 1, 8))
    )
    shape = known.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("chars")).alias("chars"), F.count("*").alias("n")).first()
    judged = pages.drop("host", "path", "rule", "verdict").withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    if not shape["n"]:
        return judged.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    known = F.broadcast(known) if shape["n"] <= rules_bound else known
    parts = F.split("host", r"\.")
    hosts = F.transform(F.filter(F.array(*map(F.lit, shape["labels"])), lambda k: k <= F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    paths = F.transform(F.filter(F.array(*map(F.lit, shape["chars"])), lambda k: k <= F.length("path")), lambda k: F.substring("path", F.lit(1), k))
    seen = judged.select("host", "path").where("host != ''").distinct()
    expressions = seen.select("host", "path", F.explode(hosts).alias("h"), paths.alias("paths")).select("host", "path", "h", F.explode("paths").alias("p"))
    digests = expressions.select("host", "path", F.sha2(F.concat_ws("\n", "h", "p"), 256).alias("full")).withColumn("short", F.substring("full", 1, 8))
    hits = (
        digests.join(known, "short").where("full = digest")
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct("size", "rule")).alias("hit"))
    )
    found = skewed_left_join(judged, staged(hits, "hits"), ["host", "path"])
    names = [c for c in judged.columns if c not in ("host", "path")]
    return found.select(*names, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.rule_verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page by ``RULES``."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, position('://' IN url) AS i, url FROM pages),
q AS (
  SELECT page_id, CASE WHEN i > 0 THEN substr(url, i + 3) ELSE '' END AS rest FROM p),
h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM q),
j AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (
  SELECT *,
    (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS a,
    (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS b,
    (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS c,
    (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS d FROM j)
SELECT page_id, host, path,
  CASE WHEN a THEN 'example.net/en/' WHEN b THEN 'example.com/de/' WHEN c THEN 'org/fr/' WHEN d THEN 'net/' END AS rule,
  CASE WHEN a THEN 'allow' WHEN b THEN 'block' WHEN c THEN 'allow' WHEN d THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""
