"""Queries of the profiler, the relationship miner and the query source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import privacy
from sparkloom.operators import profile, relationships
from sparkloom.sources import query_source
from sparkloom.streaming import profile_stream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numeric_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null,
        CASE WHEN count(*) = 0 THEN 0.0 ELSE round(1 - count({c}) / count(*), 6) END::DOUBLE AS null_ratio, count(DISTINCT {c}) AS distinct_count,
        min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, quantile_cont({c}::DOUBLE, 0.05) AS p05, quantile_cont({c}::DOUBLE, 0.95) AS p95 FROM {name}"""
        for c in columns
    )


def _shape_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, max(CASE WHEN {c} <> 0 THEN floor(log10(abs({c}::DOUBLE))) END)::INTEGER AS max_abs_magnitude,
        coalesce(bool_or({c} < 0), false) AS has_negative, coalesce(bool_or({c} > 0), false) AS has_positive FROM {name}"""
        for c in columns
    )


def _distinct_sql(pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count,
        CASE WHEN count({c}) = 0 THEN 0.0 ELSE round(least(1.0, count(DISTINCT {c}) / count({c})), 6) END::DOUBLE AS unique_ratio FROM {t}"""
        for t, c in pairs
    )


LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = [("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("documents", "doc_id"), ("events", "event_id"), ("labels", "doc_id"), ("orders", "o_custkey")]


def pk_candidates(spark, d):
    from functools import reduce

    parts = [profile.distinct_summary(table(spark, d, t), [c], exact=True).withColumn("table_name", F.lit(t)) for t, c in KEYS]
    return reduce(DataFrame.unionByName, parts).withColumn("is_candidate", F.col("unique_ratio") >= profile.IDENTIFIER_UNIQUE)


def _pk_sql() -> str:
    parts = [f"SELECT *, '{t}' AS table_name, unique_ratio >= 0.98 AS is_candidate FROM ({_distinct_sql([(t, c)])})" for t, c in KEYS]
    return " UNION ALL ".join(parts)


def text_types(spark, d):
    """Every word of the documents by what it looks like."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "[ \n]")).alias("word")).where("word <> ''")
    kinds = words.withColumn("kind", privacy.value_type(F.col("word"))).where("kind IS NOT NULL")
    return kinds.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


TEXT_TYPES = r"""
WITH words AS (
  SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \n]')) AS w FROM documents) WHERE w <> ''
), parts AS (
  SELECT doc_id, trim(w, chr(32)||chr(9)||chr(13)||chr(12)||chr(11)) AS t FROM words
), shaped AS (
  SELECT doc_id, t, string_split(reverse(regexp_replace(t, '[^0-9]', '', 'g')), '') AS ds, list_filter(string_split(t, ''), lambda x: x <> '') AS chars FROM parts WHERE t <> ''
), tested AS (
  SELECT doc_id, t,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
    list_sum(list_transform(list_filter(ds, lambda x: x <> ''), lambda x, i: CASE WHEN i % 2 = 0 THEN CASE WHEN x::INT * 2 > 9 THEN x::INT * 2 - 9 ELSE x::INT * 2 END ELSE x::INT END)) % 10 = 0 AS luhn,
    CASE WHEN length(t) BETWEEN 24 AND 4096 AND regexp_matches(t, '^[A-Za-z0-9_+/=-]+$')
      AND regexp_matches(t, '[a-z]')::INT + regexp_matches(t, '[A-Z]')::INT + regexp_matches(t, '[0-9]')::INT + regexp_matches(t, '[_+/=-]')::INT >= 2
      THEN list_sum(list_transform(list_distinct(chars), lambda x: -(len(list_filter(chars, lambda y: y = x)) / len(chars)) * log2(len(list_filter(chars, lambda y: y = x)) / len(chars)))) >= 3.5
      ELSE false END AS random_
  FROM shaped
), kinds AS (
  SELECT doc_id, CASE
    WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}$') AND try_cast(t AS DATE) IS NOT NULL THEN NULL
    WHEN regexp_matches(t, '-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----') OR regexp_matches(t, '(?i)^Bearer\s+\S+$')
      OR regexp_matches(t, '^(?:(?:sk|pk)_(?:live|test)_[A-Za-z0-9_-]{8,}|(?:gh[opurs]|github_pat)_[A-Za-z0-9_]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}|xox[baprs]-[A-Za-z0-9-]{10,})$')
      OR regexp_matches(t, '(?i)(?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|secret)\s*[:=]\s*\S+') THEN 'secret'
    WHEN regexp_matches(t, '^[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$') OR random_ THEN 'secret'
    WHEN regexp_matches(t, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email'
    WHEN regexp_matches(t, '^\d{3}-?\d{2}-?\d{4}$') THEN 'ssn'
    WHEN regexp_matches(t, '^(?:\d[ -]*?){13,19}$') AND luhn THEN 'secret'
    WHEN regexp_matches(t, '^\+?[\d\s().-]{7,}$') AND n_digits BETWEEN 7 AND 15 THEN 'phone' END AS kind FROM tested
)
SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM kinds WHERE kind IS NOT NULL GROUP BY kind
"""


def fk_discovery(spark, d):
    return relationships.discover({n: table(spark, d, n) for n in ("documents", "labels", "events", "pages", "benchmark")})


FK_DISCOVERY = """
WITH cells AS (
  SELECT 'documents' AS e, 'doc_id' AS f, doc_id::VARCHAR AS v FROM documents UNION ALL SELECT 'labels', 'doc_id', doc_id::VARCHAR FROM labels
  UNION ALL SELECT 'events', 'event_id', event_id::VARCHAR FROM events UNION ALL SELECT 'events', 'user_id', user_id::VARCHAR FROM events
  UNION ALL SELECT 'pages', 'page_id', page_id::VARCHAR FROM pages UNION ALL SELECT 'benchmark', 'item_id', item_id::VARCHAR FROM benchmark
), held AS (SELECT e, f, v, count(*) AS n FROM cells WHERE v IS NOT NULL AND v <> '' GROUP BY e, f, v),
total AS (SELECT e, f, sum(n) AS total, max(n) AS most FROM held GROUP BY e, f),
pairs AS (
  SELECT c.e AS child, c.f AS child_field, p.e AS parent, p.f AS parent_field, sum(c.n) AS met
  FROM held c JOIN held p ON c.v = p.v AND c.e <> p.e JOIN total t ON t.e = p.e AND t.f = p.f AND t.most = 1 GROUP BY ALL
), scored AS (
  SELECT child, child_field, parent, parent_field, round(met / total, 6)::DOUBLE AS confidence FROM pairs JOIN total t ON t.e = child AND t.f = child_field
), kept AS (SELECT * FROM scored WHERE confidence >= 0.8)
SELECT *, row_number() OVER (PARTITION BY child, child_field ORDER BY confidence DESC,
  list_position(['documents', 'labels', 'events', 'pages', 'benchmark'], parent), parent_field DESC) = 1 AS best FROM kept
"""


def _coverage_sql(child: str, ck: str, parent: str, pk: str) -> str:
    return f"""SELECT count(*) AS child_rows, count({ck}) AS checked, count(k) AS matched, count({ck}) - count(k) AS orphans
    FROM {child} LEFT JOIN (SELECT DISTINCT {pk} AS k FROM {parent} WHERE {pk} IS NOT NULL) ON {ck} = k"""


def nation_source(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("sparkloom_nation")
    sql = "SELECT n_nationkey, upper(n_name) AS label, n_regionkey * 2 AS twice FROM sparkloom_nation WHERE n_regionkey >= 1"
    _, df = query_source.query_source(spark, sql, {"sparkloom_nation": {"n_nationkey", "n_name", "n_regionkey"}})
    return query_source.query_summary(df)


NATION = " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) AS row_count, count({n}) AS non_null, count(DISTINCT {n}) AS distinct_count FROM "
    "(SELECT n_nationkey, upper(n_name) AS label, n_regionkey * 2 AS twice FROM nation WHERE n_regionkey >= 1)"
    for n in ("n_nationkey", "label", "twice")
)


def safe_rows(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("sparkloom_nations")
    return query_source.safe_select(spark, "SELECT n_nationkey, n_regionkey FROM sparkloom_nations LIMIT 1000", {"sparkloom_nations": {"n_nationkey", "n_regionkey"}})


def masked_customers(spark, d):
    return query_source.mask_rows(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


def event_windows(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = profile_stream.windowed(events, "ts", "value", ["event_type"], "1 day")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def parsed_types(spark, d):
    """Text columns of orders, events and labels read back as types."""
    o = table(spark, d, "orders")
    text = o.select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("moment"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("even"), "o_orderpriority",
    )
    return profile.parse_flags(text, text.columns)


PARSED = " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) AS non_blank, {i} AS integer, {f} AS float, {b} AS boolean, {m} AS datetime, {y} AS date FROM orders"
    for n, i, f, b, m, y in (
        ("key", "true", "true", "false", "false", "false"), ("price", "false", "true", "false", "false", "false"), ("day", "false", "false", "false", "false", "true"),
        ("moment", "false", "false", "false", "true", "true"), ("even", "false", "false", "true", "false", "false"), ("o_orderpriority", "false", "false", "false", "false", "false"),
    )
)


def category_labels(spark, d):
    """Order statuses under rank labels."""
    held = profile.top_values(table(spark, d, "orders"), "o_orderstatus")
    rows = held.collect()  # at most 20
    labels = privacy.rank_labels([r["n"] for r in rows], [r["value"] for r in rows])
    return spark.createDataFrame([(x["value"], x["weight"]) for x in labels], "label string, n bigint")


PROFILING = [
    ("column_profile_lineitem", lambda s, d: profile.numeric_summary(table(s, d, "lineitem"), LINEITEM, exact=True, fused=True), _numeric_sql("lineitem", LINEITEM)),
    ("column_profile_orders", lambda s, d: profile.numeric_summary(table(s, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], exact=True, fused=True), _numeric_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"])),
    ("row_count_events", lambda s, d: profile.row_count(table(s, d, "events")), "SELECT count(*) AS row_count FROM events"),
    ("numeric_shape_lineitem", lambda s, d: profile.numeric_shape(table(s, d, "lineitem"), LINEITEM), _shape_sql("lineitem", LINEITEM)),
    ("numeric_shape_balances", lambda s, d: profile.numeric_shape(table(s, d, "customer"), ["c_acctbal"]), _shape_sql("customer", ["c_acctbal"])),
    ("topk_returnflag", lambda s, d: profile.top_values(table(s, d, "lineitem"), "l_returnflag", 3), "SELECT l_returnflag AS value, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 3"),
    ("topk_priority", lambda s, d: profile.top_values(table(s, d, "orders"), "o_orderpriority", 5), "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5"),
    ("category_labels_orders", category_labels, "SELECT 'category_' || row_number() OVER (ORDER BY n DESC, v) AS label, n FROM (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1)"),
    ("date_range_orders", lambda s, d: profile.time_range(table(s, d, "orders"), ["o_orderdate"]).select("column_name", F.date_format("min_time", "yyyy-MM-dd HH:mm:ss").alias("min_time"), F.date_format("max_time", "yyyy-MM-dd HH:mm:ss").alias("max_time")),
     "SELECT 'o_orderdate' AS column_name, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_time, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_time FROM orders"),
    ("boolean_ratio_labels", lambda s, d: profile.true_ratio(table(s, d, "labels").select(F.col("quality").cast("boolean").alias("quality"), F.col("toxic").cast("boolean").alias("toxic")), ["quality", "toxic"]),
     "SELECT 'quality' AS column_name, round(avg(quality), 6)::DOUBLE AS true_ratio FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 6)::DOUBLE FROM labels"),
    ("text_lengths_part", lambda s, d: profile.text_lengths(table(s, d, "part"), ["p_name", "p_brand", "p_type"]),
     " UNION ALL ".join(f"SELECT '{c}' AS column_name, min(length({c})) AS min_length, max(length({c})) AS max_length FROM part" for c in ("p_name", "p_brand", "p_type"))),
    ("pk_candidates", pk_candidates, _pk_sql()),
    ("mask_patterns_customer", lambda s, d: profile.pattern_histogram(table(s, d, "customer"), "c_name"), "SELECT 'text_len_' || length(c_name) AS pattern, count(*) AS n FROM customer WHERE trim(c_name) <> '' GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10"),
    ("pii_types_documents", text_types, TEXT_TYPES),
    ("parse_flags_orders", parsed_types, PARSED),
    ("fk_coverage_orders_customer", lambda s, d: relationships.coverage(table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey"), _coverage_sql("orders", "o_custkey", "customer", "c_custkey")),
    ("fk_coverage_lineitem_orders", lambda s, d: relationships.coverage(table(s, d, "lineitem"), "l_orderkey", table(s, d, "orders"), "o_orderkey"), _coverage_sql("lineitem", "l_orderkey", "orders", "o_orderkey")),
    ("fk_coverage_labels_documents", lambda s, d: relationships.coverage(table(s, d, "labels"), "doc_id", table(s, d, "documents"), "doc_id"), _coverage_sql("labels", "doc_id", "documents", "doc_id")),
    ("fk_discovery", fk_discovery, FK_DISCOVERY),
    ("query_source_nation", nation_source, NATION),
    ("safe_select_nation", safe_rows, "SELECT n_nationkey, n_regionkey FROM nation"),
    ("mask_rows_customer", masked_customers, "SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '[MASKED]' END AS c_name, c_mktsegment FROM customer"),
    ("event_windows", event_windows, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS row_count, count(value) AS non_null, min(value) AS min_value, max(value) AS max_value, coalesce(bool_or(value < 0), false) AS has_negative FROM events GROUP BY 1, 2"),
]


def declared_keys(spark, d):
    """Foreign keys as a catalog would declare them, measured."""
    from sparkloom.sources.catalog import Keys

    held = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem", "nation", "region")}
    keys = Keys(foreign=[("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_nationkey", "region", "r_regionkey")])
    found = keys.relationships(held)
    return spark.createDataFrame([(r.child_entity, r.child_field, r.parent_entity, r.parent_field, r.kind, r.status, r.confidence) for r in found], "child string, child_field string, parent string, parent_field string, kind string, status string, confidence double")


def _declared_sql() -> str:
    keys = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_nationkey", "region", "r_regionkey"))
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS child, '{ck}' AS child_field, '{p}' AS parent, '{pk}' AS parent_field, CASE WHEN count({ck}) = count(DISTINCT {ck}) THEN 'one_to_one' ELSE 'many_to_one' END AS kind,
        'declared' AS status, round(count(k) / count({ck}), 6)::DOUBLE AS confidence FROM {c} LEFT JOIN (SELECT DISTINCT {pk} AS k FROM {p}) ON {ck} = k"""
        for c, ck, p, pk in keys
    )


def metadata(spark, d):
    """Schema and row count of a Parquet table, no value read."""
    from sparkloom.sources.readers import parquet_metadata

    held = parquet_metadata(spark, f"{d}/orders.parquet")
    return spark.createDataFrame([(f.name, f.data_type, held.row_count) for f in held.fields], "column_name string, logical_type string, row_count bigint")


METADATA = """
SELECT column_name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'string' END AS logical_type,
       (SELECT count(*) FROM orders) AS row_count FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name,
       unnest(['BIGINT', 'BIGINT', 'VARCHAR', 'DOUBLE', 'TIMESTAMP', 'VARCHAR']) AS data_type)
"""


def allowed(spark, d):
    from sparkloom.sources.catalog import project

    return project(table(spark, d, "part"), "part", {"part.p_size", "part.p_brand"}).groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))


PROFILING += [
    ("declared_keys", declared_keys, _declared_sql()),
    ("parquet_metadata_orders", metadata, METADATA),
    ("allowlist_projection", allowed, "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2"),
]
