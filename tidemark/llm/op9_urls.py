"""Operator 9: URL filters by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Rules up to so many are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Leading hex digits of a digest that the join is on.
SHORT = 8
#: Most pairs of a path length and a number of host labels among the rules: what one url is expanded into.
SHAPES = 4096
#: The verdict where no rule fits.
DEFAULT = "allow"
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """Judge each url by the longest rule that fits it.

    rules has verdict and rule, a rule being a host, a slash and the rest of a path
    (``example.net/en/``). It fits its host and all subdomains if the url's path starts with
    the rule's. Each distinct host and path is expanded into the suffixes of the host at dots, of as many labels as
    some rule's host, joined with those prefixes of the path that are as long as some rule's path; so no host, however
    many dots it has, makes more expressions than the rules have shapes. The SHORT first digits of
    their SHA-256 digests are joined with the rules', full digests confirm, and the longest
    expression wins (of two equal ones: block before allow, then the rule that sorts last).

    Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: what follows up
    to ?, # or the end. A null url, or one without ://, has both empty; no rule then fits.
    Rows repeat as they come, and a null key stays null. Other columns play no part. Empty
    rules give every url the default; an empty table gives no rows. Rules with a null or without a slash are left out.
    Returns key, host, path, rule (or null) and verdict.
    """
    spark = pages.sparkSession
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    given = rules.select(F.col("verdict"), F.col("rule"))
    given = given.filter("verdict IS NOT NULL AND instr(rule, '/') > 0").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    given = given.withColumn("digest", F.sha2(F.concat(F.translate(F.substring_index("rule", "/", 1), up, low), F.lit("/"), F.expr("substring(rule, instr(rule, '/') + 1)")), 256))
    given = given.select("rule", "verdict", F.col("digest").alias("rule_digest"), F.substring("digest", 1, SHORT).alias("short"), F.expr("length(rule) - instr(rule, '/') + 1").alias("path_length"))
    given = given.withColumn("labels", F.size(F.split(F.substring_index("rule", "/", 1), r"\.")))
    n, lengths, labels = given.agg(F.count("*"), F.collect_set("path_length"), F.collect_set("labels")).first()
    given = given.drop("path_length", "labels")
    if len(lengths) * len(labels) > SHAPES:
        raise ValueError(f"rules have more than {SHAPES} pairs of path length and host labels")

    url_text = F.coalesce(F.col(url), F.lit(""))
    out = pages.select(F.col(key).alias("_key"), url_text.alias("_url"))
    out = out.withColumn("_rest", F.when(F.instr("_url", "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit("")))
    out = out.withColumn("_raw", F.regexp_extract("_rest", r"^([^/?#]*)", 1))
    out = out.select("_key", F.translate("_raw", up, low).alias("host"), F.regexp_extract(F.expr("substring(_rest, length(_raw) + 1)"), r"^([^?#]*)", 1).alias("path"))
    # hosts' suffixes at dots; prefixes of the path
    parts = F.split("host", r"\.")
    counts = F.filter(F.array(*[F.lit(int(x)) for x in sorted(labels)]).cast("array<int>"), lambda x: x <= F.size(parts))
    hosts = F.transform(counts, lambda x: F.array_join(F.slice(parts, F.size(parts) - x + 1, x), "."))
    sizes = F.filter(F.array(*[F.lit(int(x)) for x in sorted(lengths)]).cast("array<int>"), lambda x: x <= F.length("path"))
    texts = F.flatten(F.transform(hosts, lambda h: F.transform(sizes, lambda x: F.concat(h, F.substring("path", F.lit(1), x)))))
    found = out.filter("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(texts)).alias("text"))
    found = found.select("host", "path", F.sha2("text", 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    side = F.broadcast(given) if n <= BROADCAST_RULES else given
    hit = found.join(side, "short").filter("digest = rule_digest")
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "verdict", "rule")).alias("best"))
    return out.join(best, ["host", "path"], "left").select(F.col("_key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    return url_filter(C.table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rests
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM parts
), rules(verdict, rule, h, p) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (page_id)
"""
