"""URL rules by host-suffix and path-prefix expressions.

A rule is a string ``host/path`` and a verdict; it fits its host and all subdomains
when the url's path starts with the rule's.  Each url is expanded into the suffixes of
its host (at dots) with as many labels as some rule's host has, and the prefixes of its
path whose length some rule has; each expression is joined on the first 8 hex digits of
its SHA-256 and confirmed on the full digest.  The longest fitting rule wins (by characters of the rule; block before
allow, then the rule's text, in ties); without one the verdict is DEFAULT, allow.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: then up to ``?``, ``#`` or the end.  A null url, or one without ``://``, has
neither, fits nothing and gets DEFAULT.

Scale: DataFrame functions only.  Expressions of a url are bounded by the rules, not by
its labels.  Few rules are a table of known size, which the planner broadcasts; many
are shuffled on the prefix, and then AQE splits a hot prefix.  Urls are reduced by row,
before the shuffle where rules were broadcast.  Repeated rows each get a row (they are
told apart by their place in the scan); extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DEFAULT = "allow"
PREFIX = 8
MOST_LITERAL = 2000


def ascii_lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url):
    """Host and path of a url column."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """rule, rule_verdict, rank (the order in which fitting rules win), digest and short of each rule.

    Up to MOST_LITERAL rules are a table of literals, whose size the planner knows; more
    are an ordinary one.
    """
    order = sorted(set(rules), key=lambda r: (len(r[0]), r[1] == "block", r[0]))
    schema = "rule string, rule_verdict string, rank bigint"
    if len(order) > MOST_LITERAL:
        held = spark.createDataFrame([(r, v, i) for i, (r, v) in enumerate(order)], schema)
    else:
        rows = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("rule_verdict"), F.lit(i).cast("bigint").alias("rank")) for i, (r, v) in enumerate(order)]
        held = spark.range(1).select(F.inline(F.array(*rows) if rows else F.array().cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))
    return held.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX))


def expressions(host, path, rules: Sequence[tuple[str, str]]):
    """Every host suffix of as many labels as some rule's host has, with every path prefix of some rule's length."""
    labels = sorted({r[: r.index("/")].count(".") + 1 for r, _ in rules})
    lengths = sorted({len(r) - r.index("/") for r, _ in rules})
    suffixes = [F.substring_index(host, ".", -n) for n in labels]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    held = F.array(*(F.when(host != "", F.concat(s, p)) for s in suffixes for p in prefixes)) if rules else F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(held))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("__row", F.monotonically_increasing_id())
    spread = urls.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), rules)).alias("expression"))
    nothing = F.pmod("__row", F.lit(1000))  # what can't match is dealt out, not sent to one task as a null key
    short = F.coalesce(F.substring("own_digest", 1, PREFIX), F.concat(F.lit("-"), nothing.cast("string")))
    spread = spread.withColumn("own_digest", F.sha2("expression", 256)).withColumn("short", short)
    table = rule_table(spark, rules)
    joined = spread.join(table, "short", "left")
    best = F.max(F.when(F.col("digest") == F.col("own_digest"), F.col("rank")))
    out = joined.groupBy("__row", "page_id", "host", "path").agg(best.alias("rank")).withColumn("rank", F.coalesce("rank", -1 - nothing))
    named = table.select("rank", "rule", F.col("rule_verdict").alias("verdict"))
    return out.join(named, "rank", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
