"""URL filter by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

A url is expanded into every suffix of its host's labels joined with every prefix of its path
that ends with a slash.  Expressions meet rules by an equi-join on the first ``PREFIX`` hex
digits of their SHA-256; the whole digest then confirms.  Of the rules that fit, the longest
wins; block wins over allow between equal ones.  Suffixes with more labels, or prefixes with
more slashes, than any rule has can't fit and aren't made.

Edges: a null url, or one without ``://``, has an empty host and path and fits no rule; a
path without a slash (an empty one) fits none either; a url that no rule fits gets
``default``; rows that repeat are judged each by itself; other columns are ignored.  Rules
must have a path that starts and ends with a slash.  A rule list of at most ``BROADCAST_BYTES``
is broadcast; a longer one is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, BROADCAST_BYTES = 8, 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a DataFrame."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict)."""
    bounds = rules.agg(
        F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 150), F.lit(0)).alias("bytes"),
        F.count_if(~F.col("path").rlike("^/(.*/)?$")).alias("bad"),
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("path", "/")) - 1), F.lit(1)).alias("slashes"),
    ).first()
    if bounds.bad:
        raise ValueError("a rule's path must start and end with a slash")
    rule = F.concat("host", "path")
    coded = rules.select(
        F.substring(F.sha2(rule, 256), 1, PREFIX).alias("rule_prefix"), F.sha2(rule, 256).alias("rule_digest"),
        F.struct(F.length(rule).alias("size"), "verdict", rule.alias("rule")).alias("fit"),
    )
    if bounds.bytes <= BROADCAST_BYTES:
        coded = F.broadcast(coded)
    host, path = split_url(F.col(url).cast("string"))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"labels": F.split("host", r"\."), "steps": F.split("path", "/")})
    rows = rows.select("key", "host", "path", F.posexplode_outer(F.expr(f"""if(host = '' or size(steps) < 2, array(), flatten(transform(
        sequence(greatest(1, size(labels) - {bounds.labels} + 1), size(labels)), i -> transform(
            sequence(1, least(size(steps) - 1, {bounds.slashes})), j ->
                concat(array_join(slice(labels, i, size(labels)), '.'), array_join(slice(steps, 1, j), '/'), '/')))))""")).alias("at", "expression"))  # fmt: skip
    rows = rows.withColumns({"digest": F.sha2("expression", 256), "first": F.coalesce(F.col("at") == 0, F.lit(True)).cast("int")})
    met = rows.join(coded, (F.substring("digest", 1, PREFIX) == F.col("rule_prefix")) & (F.col("digest") == F.col("rule_digest")), "left")
    best = met.groupBy("key", "host", "path").agg(F.sum("first").cast("int").alias("copies"), F.max("fit").alias("fit"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return best.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
