"""Queries of whole profiles, privacy functions, mining from metadata, generation, rules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import privacy
from sparkloom.functions.draws import ROW
from sparkloom.model import Constraint, Dataset, Entity, Field, Relationship
from sparkloom.operators import constraints, generate, profile, relationships, rules, validate
from sparkloom.plans.generation import _SPOILED, N_CUSTOMERS, N_ORDERS, SPOILED, _u
from sparkloom.plans.generation import spec as shop_spec
from sparkloom.plans.profiling import LINEITEM, _numeric_sql, table
from sparkloom.plans.rules import COMMENTED, PRICED, commented, priced, shipped
from sparkloom.plans.scans import refusals, refused, values
from sparkloom.shared import fresh_path
from sparkloom.streaming import profile_stream

# whole profiles


def sketches(s, d):
    """The sketched profile: counts and bounds exact, distinct counts within 10 %, percentiles within half a percent of the ranks."""
    lines = table(s, d, "lineitem")
    held = profile.numeric_summary(lines, LINEITEM)
    got = {r["column_name"]: r for r in held.collect()}
    ranks = lines.agg(*(F.avg((F.col(c) <= got[c][p]).cast("int")).alias(f"{c} {p}") for c in LINEITEM for p in ("p05", "p95")), *(F.avg((F.col(c) < got[c][p]).cast("int")).alias(f"{c} {p} below") for c in LINEITEM for p in ("p05", "p95"))).first().asDict()
    close = lambda c, p, want: bool(ranks[f"{c} {p} below"] - 0.005 <= want <= ranks[f"{c} {p}"] + 0.005)
    exact = profile.distinct_summary(lines, LINEITEM, exact=True).select("column_name", F.col("distinct_count").alias("true_count"))
    marks = s.createDataFrame([(c, close(c, "p05", 0.05) and close(c, "p95", 0.95)) for c in LINEITEM], "column_name string, percentiles_close boolean")
    near = (F.abs(F.col("distinct_count") - F.col("true_count")) <= 0.1 * F.col("true_count")).alias("distinct_close")
    return held.join(exact, "column_name").join(marks, "column_name").select("column_name", "row_count", "non_null", "null_ratio", "min_value", "max_value", near, "percentiles_close")


SKETCHES = f"SELECT column_name, row_count, non_null, null_ratio, min_value, max_value, true AS distinct_close, true AS percentiles_close FROM ({_numeric_sql('lineitem', LINEITEM)})"


def profiled(s, d):
    """The safe profile of orders, a field a row."""
    held = profile.profile(table(s, d, "orders"), "orders", exact=True)
    rows = []
    for f in held.fields:
        x = f.distribution
        numbers = [float(x[k]) if x["kind"] == "numeric" else None for k in ("min", "max", "p05", "p95")]
        ends = [x[k] if x["kind"] == "datetime_range" else None for k in ("min", "max")]
        rows.append((f.name, f.data_type, x["kind"], held.row_count, f.nullable, f.null_ratio, f.unique_ratio, f.sensitive, f.is_identifier, *numbers, *ends, len(x["values"]) if x["kind"] == "categorical" else None))
    return s.createDataFrame(rows, "field string, data_type string, kind string, n_rows bigint, nullable boolean, null_ratio double, unique_ratio double, sensitive boolean, identifier boolean, low double, high double, p05 double, p95 double, first string, last string, n_values bigint")


def _profiled_sql() -> str:
    head = "SELECT '{c}' AS field, '{t}' AS data_type, '{k}' AS kind, count(*) AS n_rows, count({c}) < count(*) AS nullable, round(1 - count({c}) / count(*), 6)::DOUBLE AS null_ratio, round(count(DISTINCT {c}) / count({c}), 6)::DOUBLE AS unique_ratio, false AS sensitive, false AS identifier, "
    number = "{r0}min({c}){r1} AS low, {r0}max({c}){r1} AS high, {r0}quantile_cont({c}::DOUBLE, 0.05){r1} AS p05, {r0}quantile_cont({c}::DOUBLE, 0.95){r1} AS p95, NULL::VARCHAR AS first, NULL::VARCHAR AS last, NULL::BIGINT AS n_values FROM orders"
    none = "NULL, NULL, NULL, NULL, "
    parts = [(head + number).format(c=c, t="integer", k="numeric", r0="round_even(", r1="::DOUBLE, 0)::DOUBLE") for c in ("o_orderkey", "o_custkey")]
    parts.append((head + number).format(c="o_totalprice", t="float", k="numeric", r0="", r1="::DOUBLE"))
    parts.append((head + none + "strftime(min({c}), '%Y-%m-%d %H:%M:%S'), strftime(max({c}), '%Y-%m-%d %H:%M:%S'), NULL FROM orders").format(c="o_orderdate", t="datetime", k="datetime_range"))
    parts += [(head + none + "NULL, NULL, count(DISTINCT {c}) FROM orders").format(c=c, t="string", k="categorical") for c in ("o_orderstatus", "o_orderpriority")]
    return " UNION ALL ".join(parts)


def sensitive_profile(s, d):
    """What a profile says of the sensitive fields of customers: masked patterns and a shape."""
    held = profile.profile(table(s, d, "customer"), "customer")
    x, shape = held["c_name"].distribution, held["c_acctbal"].distribution
    validate.assert_profile_safe(Dataset([held]))
    rows = [("c_name", p["pattern"], p["count"]) for p in x["patterns"]] + [("c_acctbal", f"{shape['max_abs_magnitude']} {shape['has_negative']} {shape['has_positive']}".lower(), None)]
    return s.createDataFrame(rows, "field string, pattern string, n bigint")


SENSITIVE_PROFILE = """
(SELECT 'c_name' AS field, 'text_len_' || length(c_name) AS pattern, count(*) AS n FROM customer GROUP BY 2 ORDER BY n DESC, pattern LIMIT 10)
UNION ALL SELECT 'c_acctbal', max(CASE WHEN c_acctbal <> 0 THEN floor(log10(abs(c_acctbal))) END)::INTEGER || ' ' || bool_or(c_acctbal < 0) || ' ' || bool_or(c_acctbal > 0), NULL FROM customer
"""


def semantics(s, d):
    """Types of text columns, by name or by what their first values look like."""
    k = F.col("c_custkey")
    made = table(s, d, "customer").select(
        k, F.concat(F.lit("u"), k, F.lit("@example.com")).alias("contact"), F.concat(F.lit("+1-202-555-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("line"),
        F.concat(F.lit("000-00-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("number"), F.col("c_mktsegment").alias("email_kind"), F.col("c_mktsegment").alias("segment"),
        F.when(k % 50 == 7, F.lit("password=hunter22")).otherwise(F.lit("plain")).alias("note"),
    )
    found = profile.semantic_types(made, ["contact", "line", "number", "email_kind", "segment", "note"], F.col("c_custkey"))
    counts = {r["column_name"]: r for r in profile.value_types(made, list(found)).collect()}
    rows = [(n, kind, *(counts[n][k] for k in ("secret", "email", "ssn", "phone"))) for n, kind in found.items()]
    folded = made.agg(privacy.column_type(privacy.value_type(F.col("note")), F.col("c_custkey")).alias("t")).first()["t"]
    return s.createDataFrame([*rows, ("note, folded", folded, None, None, None, None)], "field string, kind string, secret bigint, email bigint, ssn bigint, phone bigint")


SEMANTICS = """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 50 = 7) AS secrets FROM customer)
SELECT 'contact' AS field, 'email' AS kind, 0::BIGINT AS secret, n AS email, 0::BIGINT AS ssn, 0::BIGINT AS phone FROM c UNION ALL SELECT 'line', 'phone', 0, 0, 0, n FROM c
UNION ALL SELECT 'number', 'ssn', 0, 0, n, 0 FROM c UNION ALL SELECT 'email_kind', 'email', 0, 0, 0, 0 UNION ALL SELECT 'segment', NULL, 0, 0, 0, 0
UNION ALL SELECT 'note', 'secret', secrets, 0, 0, 0 FROM c UNION ALL SELECT 'note, folded', 'secret', NULL, NULL, NULL, NULL
"""

NAMES = ["c_acctbal", "c_custkey", "c_mktsegment", "Customer Name", "e-mail", "user_id", "id", "order_id", "l_tax", "tax-id", "Phone", "identity", "token_count", "birthday", "zip"]


def names(s, d):
    return s.createDataFrame([(n, privacy.field_name(n), privacy.sensitive_name(n), profile.identifier_name(n)) for n in NAMES], "name string, normal string, sensitive boolean, identifier boolean")


NAMES_SQL = f"""
SELECT name, replace(replace(lower(name), '-', '_'), ' ', '_') AS normal, regexp_matches(replace(replace(lower(name), '-', '_'), ' ', '_'), '{"|".join(privacy.SENSITIVE_FRAGMENTS)}') AS sensitive,
       regexp_matches(replace(replace(lower(name), '-', '_'), ' ', '_'), '^id$|_id$') AS identifier FROM (SELECT unnest({NAMES}) AS name)
"""


def checksums(s, d):
    """Luhn checks of numbers made of order keys, and the entropy of part names."""
    numbers = table(s, d, "orders").select(F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 7919 + 12345).cast("string"), 15, "0")).alias("t"))
    luhn = numbers.agg(F.count_if(privacy.luhn(F.col("t"))).alias("luhn"))
    entropy = table(s, d, "part").agg(F.round(F.sum(privacy.entropy(F.col("p_name"))), 3).alias("entropy"), F.count_if(privacy.high_entropy(F.col("p_name"))).alias("random"))
    return luhn.join(entropy)  # one row each


CHECKSUMS = """
WITH n AS (SELECT '4' || lpad((o_orderkey * 7919 + 12345)::VARCHAR, 15, '0') AS t FROM orders),
l AS (SELECT count(*) FILTER (list_sum(list_transform(string_split(reverse(t), ''), lambda x, i: CASE WHEN i % 2 = 0 THEN CASE WHEN x::INT * 2 > 9 THEN x::INT * 2 - 9 ELSE x::INT * 2 END ELSE x::INT END)) % 10 = 0) AS luhn FROM n),
e AS (SELECT p_name AS t, string_split(p_name, '') AS cs, list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda x: -(len(list_filter(string_split(p_name, ''), lambda y: y = x)) / length(p_name)) * log2(len(list_filter(string_split(p_name, ''), lambda y: y = x)) / length(p_name)))) AS h FROM part),
r AS (SELECT round(sum(h), 3)::DOUBLE AS entropy, count(*) FILTER (length(t) BETWEEN 24 AND 4096 AND regexp_matches(t, '^[A-Za-z0-9_+/=-]+$') AND regexp_matches(t, '[a-z]')::INT + regexp_matches(t, '[A-Z]')::INT + regexp_matches(t, '[0-9]')::INT + regexp_matches(t, '[_+/=-]')::INT >= 2 AND h >= 3.5) AS random FROM e)
SELECT luhn, entropy, random FROM l, r
"""


def nested(s, d):
    """Sensitive leaves masked through structs, arrays and maps."""
    n = table(s, d, "nation").select(
        "n_nationkey", F.struct(F.col("n_name").alias("user_name"), F.col("n_regionkey").alias("region")).alias("inner"),
        F.array(F.struct(F.col("n_name").alias("token"))).alias("list"), F.create_map(F.lit("k"), F.struct(F.col("n_name").alias("label"), F.col("n_name").alias("email"))).alias("map"),
    )
    from sparkloom.sources.query_source import mask_rows

    return mask_rows(n).select("n_nationkey", F.to_json(F.struct("inner", "list", "map")).alias("masked"))


NESTED = """SELECT n_nationkey, '{"inner":{"user_name":"[MASKED]","region":' || n_regionkey || '},"list":[{"token":"[MASKED]"}],"map":{"k":{"label":"' || n_name || '","email":"[MASKED]"}}}' AS masked FROM nation"""

POLICY = [
    ("status", ["O", "F", "P"], False), ("zip", ["90210", "10001"], True), ("ip", ["10.0.0.1"], True), ("age", [31, 44], True), ("part_key", ["a", "b"], True), ("order_id", ["a", "b"], True),
    ("row_uuid", ["a"], True), ("contact", ["a@example.com", "b@example.com"], True), ("grade", ["a", "a"], True), ("grade", ["a", "b"], False), ("grade", [1, 2, 3], False), ("grade", [1.5], True), ("grade", [], True),
    ("grade", ["x" * 65], True), ("grade", ["one two three four five"], True), ("grade", ["a: b"], True), ("grade", [f"v{i}" for i in range(21)], True), ("user_kind", ["a"], True), ("secret_kind", ["a"], True),
    ("call", ["+1 202 555 0101", "+1 202 555 0102"], True), ("postal_region", ["a"], True), ("latitude", [1], True),
]


def category_policy(s, d):
    """Which values may be kept as they are."""
    tries = [(f"{i} {n}", lambda n=n, v=v: profile.check_local_categories(s, v, n)) for i, (n, v, _) in enumerate(POLICY)]
    top = [r["value"] for r in profile.top_values(table(s, d, "customer"), "c_mktsegment").collect()]
    return refused(s, [*tries, ("segments", lambda: profile.check_local_categories(s, top, "c_mktsegment"))])


def running(s, d):
    """The running profile of the events as a stream, kept by batch and merged."""
    at, events = fresh_path(s, "running"), table(s, d, "events")
    stream = s.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("value", F.col("value").cast("decimal(18,4)"))
    profile_stream.running_profile(stream, stream.columns, f"{at}/store", f"{at}/checkpoint").awaitTermination()
    exact = profile.distinct_summary(events.withColumn("ts", F.col("ts").cast("string")), events.columns, exact=True).select("column_name", F.col("distinct_count").alias("true_count"))
    got = profile_stream.merged(s.read.parquet(f"{at}/store")).join(exact, "column_name")
    close = F.abs(F.col("approx_distinct") - F.col("true_count")) <= 0.1 * F.col("true_count")
    return got.select("column_name", "unit", "row_count", "non_null", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), close.alias("distinct_close"))


RUNNING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{u}' AS unit, count(*) AS row_count, count({c}) AS non_null, round(min({x}), 4)::DOUBLE AS low, round(max({x}), 4)::DOUBLE AS high, true AS distinct_close FROM events"
    for c, u, x in (("event_id", "number", "event_id"), ("user_id", "number", "user_id"), ("value", "number", "value::DECIMAL(18,4)"), ("ts", "seconds", "epoch(ts)"), ("event_type", "length", "length(event_type)"), ("props", "length", "length(props)"))
)

# mining from metadata


def hypotheses(s, d):
    """Keys and time orders guessed from profiles alone, ranked."""
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("created_on"), (F.col("o_orderdate").cast("date") + F.expr("INTERVAL 10 DAY")).cast("date").alias("closed_on"))
    held = [profile.profile(table(s, d, n), n, exact=True) for n in ("documents", "labels")] + [profile.profile(orders, "orders", exact=True)]
    found = relationships.ranked(relationships.candidates(Dataset(held)))
    again = relationships.ranked(found, lambda proposals: [c["candidate_id"] for c in reversed(proposals)])
    assert again == found[::-1] and all(len(c["candidate_id"]) == 64 for c in found)
    meddling = refusals(s, [("advisor", lambda: relationships.ranked(found, lambda proposals: []))])
    name = lambda c, i: f"{c['fields'][i]['entity']}.{c['fields'][i]['field']}"
    return s.createDataFrame([(c["kind"], name(c, 0), name(c, 1), c["confidence"], meddling[0][1]) for c in found], "kind string, a string, b string, confidence double, meddling_refused boolean")


HYPOTHESES = """
WITH u AS (SELECT 'documents' AS e, count(DISTINCT doc_id) / count(doc_id) AS u, count(doc_id) = count(*) AS whole FROM documents UNION ALL SELECT 'labels', count(DISTINCT doc_id) / count(doc_id), count(doc_id) = count(*) FROM labels)
SELECT 'foreign_key' AS kind, p.e || '.doc_id' AS a, c.e || '.doc_id' AS b, round((2 + round(p.u, 6)) / 3, 6)::DOUBLE AS confidence, true AS meddling_refused FROM u p JOIN u c ON p.e <> c.e WHERE p.u >= 0.98 AND p.whole
UNION ALL SELECT 'temporal', 'orders.created_on', 'orders.closed_on', (1 + CASE WHEN max(o_orderdate)::DATE <= min(o_orderdate)::DATE + 10 THEN 1.0 ELSE 0.5 END)::DOUBLE / 2, true FROM orders
"""


def mined(s, d):
    """Constraints mined from tables of which some hold by construction, condition values under rank labels."""
    lines, orders = priced(s, d), commented(s, d)
    totals = lines.groupBy("l_orderkey").agg(F.sum("line_total").alias("lines_line_total_total"))
    found = constraints.mine({"lines": lines, "orders": orders, "totals": totals})
    top = profile.top_values(orders, "o_orderstatus").collect()
    labels = privacy.rank_labels([r["n"] for r in top], [r["value"] for r in top])
    held = constraints.anonymise_conditions(found, {("orders", "o_orderstatus"): {r["value"]: x["value"] for r, x in zip(top, labels, strict=True)}})
    rows = [(c.kind, c.entity, c.target or c.required_field, c.expression or c.condition_value or f"{c.aggregate} of {c.child_entity}.{c.child_field}", float(c.confidence)) for c in held]
    return s.createDataFrame(rows, "kind string, entity string, target string, how string, confidence double")


MINED = f"""
SELECT 'formula' AS kind, 'lines' AS entity, 'line_total' AS target, 'l_quantity * l_discount' AS how, round(count(*) FILTER (abs(line_total - l_quantity * l_discount) <= 1e-6) / count(*), 6)::DOUBLE AS confidence FROM {PRICED}
UNION ALL SELECT 'conditional_required', 'orders', 'note', 'category_' || rank, share FROM (SELECT o_orderstatus, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS rank, round(count(note) / count(*), 6)::DOUBLE AS share FROM {COMMENTED} GROUP BY 1) WHERE o_orderstatus = 'F'
UNION ALL SELECT 'aggregate_mapping', 'totals', 'lines_line_total_total', 'sum of lines.line_total', 0.8
"""

# generation


def planned(s, d):
    """A specification out of a profile: counts, keys and kinds."""
    held = Dataset([profile.profile(table(s, d, "documents").drop("text"), "documents", exact=True), profile.profile(table(s, d, "labels"), "labels", exact=True)], [Relationship("documents", "doc_id", "labels", "doc_id")])
    rows = []
    for count in (None, 12):
        sp = generate.plan(held, count, seed=3)
        made = generate.generate(s, sp)
        rows += [(e.name, e.row_count, e.primary_key, len(e.fields), made[e.name].count()) for e in sp.entities]
    return s.createDataFrame(rows, "entity string, row_count bigint, primary_key string, n_fields bigint, made bigint")


_KEY = "CASE WHEN count(DISTINCT doc_id) / count(doc_id) >= 0.98 AND count(doc_id) = count(*) THEN 'doc_id' END"
PLANNED = " UNION ALL ".join(f"SELECT '{t}' AS entity, {n} AS row_count, {_KEY} AS primary_key, {f}::BIGINT AS n_fields, {n} AS made FROM {t}" for t, f in (("documents", 4), ("labels", 3)) for n in ("count(*)", "12::BIGINT"))

N_ROWS = 1000
EXTRA = Dataset(
    [
        Entity(
            "people", N_ROWS,
            [
                Field("person_id", "integer", is_identifier=True), Field("phone", sensitive=True, semantic_type="phone"), Field("ssn", sensitive=True, semantic_type="ssn"), Field("full_name", sensitive=True),
                Field("balance", "float", distribution={"kind": "numeric_shape", "max_abs_magnitude": 3, "has_negative": True, "has_positive": True}),
                Field("seen_at", "datetime", distribution={"kind": "datetime_range", "min": "2024-01-01T00:00:00", "max": "2024-01-31T12:00:00"}),
                Field("word", distribution={"kind": "string_pattern", "min_length": 3, "max_length": 8}), Field("grade", nullable=True, null_ratio=0.5, distribution={"kind": "string_pattern", "min_length": 2, "max_length": 2}),
                Field("kind", distribution={"kind": "categorical", "values": [{"value": "a", "weight": 1}, {"value": "b", "weight": 1}]}),
            ], "person_id",
        )
    ],
    constraints=[Constraint("conditional_required", "people", condition_field="kind", condition_value="a", required_field="grade")], seed=21,
)


def people(s, d):
    """Every kind of text, shape, moment and word that a specification may ask for."""
    out = generate.rows(s, EXTRA, EXTRA["people"])
    return out.select("person_id", "phone", "ssn", "full_name", F.floor("balance").alias("balance"), F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "word", F.col("grade").isNull().alias("no_grade"), "kind")


def _v(field: str, draw: str = "value") -> str:
    return _u("people", field, draw, 21)


PEOPLE = f"""
SELECT (21000001 + i)::BIGINT AS person_id, '+1-202-555-01' || lpad(floor({_v('phone', 'digits')} * 100)::BIGINT::VARCHAR, 2, '0') AS phone, '000-00-' || lpad(floor({_v('ssn', 'digits')} * 10000)::BIGINT::VARCHAR, 4, '0') AS ssn,
       'synthetic_' || substr(md5('21|people|full_name|text|' || i), 1, 12) AS full_name, floor(round_even(-9000.0 + {_v('balance')} * 18000.0, 6))::BIGINT AS balance,
       strftime(make_timestamp((1704067200 + floor({_v('seen_at')} * (1706702400 - 1704067200 + 1)))::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS seen_at,
       'syn_' || array_to_string(list_transform(range(1, (3 + floor({_v('word')} * 6))::BIGINT + 1), lambda j: chr((97 + ('0x' || substr(md5('21|people|word|letter|' || i || '|' || j), 1, 8))::BIGINT % 26)::INTEGER)), '') AS word,
       {_v('grade', 'null')} < 0.5 AS no_grade, CASE WHEN {_v('kind')} * 2 <= 1 THEN 'a' ELSE 'b' END AS kind
FROM (SELECT unnest(range({N_ROWS})) AS i)
"""


def filled(s, d):
    """What the condition requires is filled, and every sensitive text is synthetic after solving."""
    made = generate.generate(s, EXTRA)
    unsafe = validate.unsafe_values(EXTRA, made).agg(F.sum("n")).first()[0]
    return made["people"].groupBy("kind", (F.col("grade") == "required").alias("filled"), F.col("grade").isNull().alias("empty")).agg(F.count("*").alias("n")).withColumn("unsafe", F.lit(unsafe).cast("bigint"))


FILLED = f"""
SELECT kind, CASE WHEN no_grade THEN CASE WHEN kind = 'a' THEN true END ELSE false END AS filled, no_grade AND kind = 'b' AS empty, count(*) AS n, 0::BIGINT AS unsafe
FROM (SELECT CASE WHEN {_v('kind')} * 2 <= 1 THEN 'a' ELSE 'b' END AS kind, {_v('grade', 'null')} < 0.5 AS no_grade FROM (SELECT unnest(range({N_ROWS})) AS i)) GROUP BY 1, 2, 3
"""


def modes(s, d):
    """Rows and spoiled cells of the orders of each mode."""
    rows = []
    for mode in ("valid", "edge", "load_test", "mixed", "negative"):
        made = generate.generate(s, shop_spec(mode))["orders"]
        spoiled = made.agg(F.sum(F.size("__invalid"))).first()[0] if "__invalid" in made.columns else 0
        rows.append((mode, made.count(), spoiled))
    return s.createDataFrame(rows, "mode string, n bigint, spoiled bigint")


MODES = f"SELECT mode, {N_ORDERS}::BIGINT AS n, CASE mode WHEN 'negative' THEN {N_ORDERS * len(_SPOILED)} WHEN 'mixed' THEN (SELECT sum(n) FROM ({SPOILED})) ELSE 0 END::BIGINT AS spoiled FROM (VALUES ('valid'), ('edge'), ('load_test'), ('mixed'), ('negative')) t(mode)"


def one_to_one(s, d):
    """Each customer takes the order of its own place."""
    low = table(s, d, "customer").agg(F.min("c_custkey")).first()[0]
    child = table(s, d, "customer").select((F.col("c_custkey") - low).alias(ROW), F.lit(None).cast("bigint").alias("order_key"))
    first = table(s, d, "orders").agg(F.min("o_orderkey")).first()[0]
    parents = table(s, d, "orders").withColumn(ROW, F.col("o_orderkey") - first)
    return generate.assign_keys(child, "order_key", parents, "o_orderkey", 0, one_to_one=True).select(F.col(ROW).alias("place"), "order_key")


ONE_TO_ONE = "SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS place, o_orderkey AS order_key FROM customer LEFT JOIN orders ON c_custkey - (SELECT min(c_custkey) FROM customer) = o_orderkey - (SELECT min(o_orderkey) FROM orders)"


def provided(s, d):
    """Values of a caller's own provider; one that changes its mind or takes too long is refused."""
    steady = lambda row: F.concat(F.lit("v"), (row * 7).cast("string"))
    made = generate.generate(s, EXTRA, providers={("people", "word"): steady})["people"].select("person_id", "word")
    restless = lambda row: F.concat(F.uuid(), row.cast("string"))
    slow = lambda row: F.sha2(F.repeat(row.cast("string"), 2_000_000), 512)
    tried = refusals(s, [("restless", lambda: generate.generate(s, EXTRA, providers={("people", "word"): restless})), ("slow", lambda: generate.generate(s, EXTRA, providers={("people", "word"): slow}, provider_seconds=0.3))])
    return made.withColumns({n: F.lit(r) for n, r in tried})


PROVIDED = f"SELECT (21000001 + i)::BIGINT AS person_id, 'synthetic_v' || i * 7 AS word, true AS restless, true AS slow FROM (SELECT unnest(range({N_ROWS})) AS i)"


def budgets(s, d):
    """Specifications and folders beyond the limits are refused."""
    small, large = shop_spec(), shop_spec()
    large["orders"].row_count = 200_000
    wide = Dataset([Entity("e", 1, [Field(f"f{i}") for i in range(1001)])])
    at = fresh_path(s, "budget")
    table(s, d, "nation").write.option("header", True).csv(f"{at}/nation.csv")
    held = {"nation": table(s, d, "nation")}
    tries = [
        ("small", lambda: validate.assert_budget(small)), ("rows", lambda: validate.assert_budget(large)), ("rows, no limits", lambda: validate.assert_budget(large, {})), ("columns", lambda: validate.assert_budget(wide)),
        ("output bytes", lambda: validate.assert_budget(small, {"output_bytes": 1000})), ("input", lambda: validate.assert_input_budget(s, at, held)), ("input rows", lambda: validate.assert_input_budget(s, at, held, {"input_rows": 3})),
        ("input cells", lambda: validate.assert_input_budget(s, at, held, {"input_cells": 30})), ("files", lambda: validate.assert_input_budget(s, at, held, {"files": 0})), ("input bytes", lambda: validate.assert_input_budget(s, at, held, {"input_bytes": 10})),
    ]
    sizes = refused(s, tries)
    return sizes.withColumn("bytes", F.lit(validate.estimated_bytes(small)).cast("bigint"))


_BYTES = N_CUSTOMERS * (21 + 65 + 25) + N_ORDERS * (65 + 21 + 21 + 25 + 25 + 6 + 11 + 11 + 65)
BUDGETS = values("tried, refused, bytes", [(n, r, _BYTES) for n, r in (("small", False), ("rows", True), ("rows, no limits", False), ("columns", True), ("output bytes", True), ("input", False), ("input rows", True), ("input cells", True), ("files", True), ("input bytes", True))])

def work(s, d):
    """What an invocation may ask for: each dimension at its limit and beyond."""
    from sparkloom.sources.budget import INVOCATION, WorkBudget
    from sparkloom.sources.query_source import profile_query

    rows = []
    for k, most in sorted(INVOCATION.items()):
        if k != "seconds":
            tried = refusals(s, [(k, lambda k=k, n=n: WorkBudget().charge(**{k: n})) for n in (most, most + 1)])
            rows.append((k, tried[0][1], tried[1][1]))
    lines = table(s, d, "lineitem")
    lines.createOrReplaceTempView("sparkloom_work")
    sql = "SELECT l_quantity, l_tax FROM sparkloom_work WHERE l_tax >= 0"
    one = WorkBudget({"statements": 1})
    now = iter([0.0, 0.0, 5.0, 5.0, 5.0])
    late = WorkBudget({"seconds": 3.0}, clock=lambda: next(now))
    slow = lines.select(F.sum(F.length(F.sha2(F.repeat(F.col("l_linenumber").cast("string"), 200_000), 512))).alias("x"))

    def scanned_twice():
        one.charge_scan(lines)
        one.charge_scan(lines)

    def cancelled():
        held = WorkBudget({"seconds": 0.5})
        with held.running(s):
            slow.collect()

    tries = [
        ("profile", lambda: profile_query(s, sql, budget=WorkBudget())), ("profiled columns", lambda: profile_query(s, sql, budget=WorkBudget({"profiled_columns": 1}))),
        ("scan bytes", lambda: profile_query(s, sql, budget=WorkBudget({"scan_bytes": 10}))), ("two statements", scanned_twice), ("late", lambda: (late.check_time(), late.check_time())), ("cancelled", cancelled),
        ("rows", lambda: WorkBudget({"rows": 10}).rows(lines)), ("cells", lambda: WorkBudget({"cells": 10}).rows(lines)), ("result bytes", lambda: WorkBudget({"result_bytes": 10}).rows(table(s, d, "nation"))),
        ("few rows", lambda: WorkBudget({"rows": 25, "cells": 1000, "result_bytes": 100_000}).rows(table(s, d, "nation"))),
    ]
    return s.createDataFrame([*rows, *((n, None, r) for n, r in refusals(s, tries))], "dimension string, at_limit boolean, beyond boolean")


_DIMENSIONS = ("argument_bytes", "depth", "nodes", "payload_bytes", "profiled_columns", "projected_columns", "response_bytes", "result_bytes", "sql_chars", "statements")
WORK = values("dimension, at_limit, beyond", [(k, False, True) for k in _DIMENSIONS] + [(n, None, r) for n, r in (("profile", False), ("profiled columns", True), ("scan bytes", True), ("two statements", True), ("late", True), ("cancelled", True), ("rows", True), ("cells", True), ("result bytes", True), ("few rows", False))])

# rules

TIMES = {"row_rules": [{"kind": "temporal_ordering", "table": "shipped", "start_field": "o_orderdate", "end_field": "l_shipdate", "allow_equal": a} for a in (True, False)]}


def times(s, d):
    """Time order of lines: a missing end fails.  Then what the repair leaves."""
    held = rules.rules_from_dict(TIMES)
    lines = shipped(s, d).withColumn("l_shipdate", F.when(F.col("l_linenumber") != 3, F.col("l_shipdate")))
    before = rules.validate({"shipped": lines}, held).withColumn("state", F.lit("before"))
    return before.unionByName(rules.validate(rules.apply_valid({"shipped": lines}, held), held).withColumn("state", F.lit("repaired")))


_LINES = "(SELECT o_orderdate AS a, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_FIXED = f"(SELECT a, CASE WHEN b IS NULL OR a > b THEN a ELSE b END AS b FROM {_LINES})"
TIMES_SQL = " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS rule, 'temporal_ordering' AS kind, count(*) AS checked, count(*) FILTER (NOT coalesce(a {op} b, false)) AS failed, '{state}' AS state FROM {rows}"
    for state, rows in (("before", _LINES), ("repaired", _FIXED)) for i, op in enumerate(("<=", "<"))
)

BOUNDS = rules.rules_from_dict({"field_rules": [{"table": "orders", "field": "o_totalprice", "min_value": 10.5, "max_value": 99.25}, {"table": "orders", "field": "o_custkey", "max_value": 7}]})


def edges(s, d):
    first = table(s, d, "orders").agg(F.min("o_orderkey")).first()[0]
    o = table(s, d, "orders").select(F.col("o_orderkey") - first, "o_custkey", "o_totalprice").toDF(ROW, "o_custkey", "o_totalprice")
    return rules.apply({"orders": o}, BOUNDS, mode="edge")["orders"].withColumnRenamed(ROW, "place")


EDGES = "SELECT i AS place, CASE WHEN i = 1 THEN 7 ELSE o_custkey END AS o_custkey, CASE i WHEN 0 THEN 10.5 WHEN 1 THEN 99.25 ELSE o_totalprice END::DOUBLE AS o_totalprice FROM (SELECT o_orderkey - min(o_orderkey) OVER () AS i, * FROM orders)"

CONTRACTS = [
    ("sound", {"field_rules": [{"table": "orders", "field": "quantity", "min_value": 1}]}, False), ("unknown field", {"field_rules": [{"table": "orders", "field": "zz", "required": True}]}, True),
    ("unknown table", {"field_rules": [{"table": "zz", "field": "quantity", "required": True}]}, True), ("bounds of a date", {"field_rules": [{"table": "orders", "field": "created_on", "min_value": 1}]}, True),
    ("bounds crossed", {"field_rules": [{"table": "orders", "field": "quantity", "min_value": 2, "max_value": 1}]}, True), ("sensitive literal", {"field_rules": [{"table": "orders", "field": "contact_email", "allowed_values": ["a"]}]}, True),
    ("unknown kind", {"row_rules": [{"kind": "other", "table": "orders"}]}, True), ("empty condition", {"row_rules": [{"kind": "conditional_required", "table": "orders", "when": {"field": "paid"}, "required_fields": ["amount"]}]}, True),
    ("code in a formula", {"row_rules": [{"kind": "formula", "table": "orders", "field": "amount", "expression": "__import__('os')"}]}, True),
    ("unknown parent", {"cross_table_rules": [{"kind": "foreign_key", "child_table": "orders", "child_field": "customer_id", "parent_table": "customers", "parent_field": "zz"}]}, True),
    ("too many", {"field_rules": [{"table": "orders", "field": "quantity", "min_value": 1}] * 1001}, True), ("too much work", {"field_rules": [{"table": "orders", "field": "quantity", "min_value": 1}] * 1000}, False),
    ("sensitive scenario", {"scenarios": [{"name": "x", "weight": 1, "field_values": {"orders": {"contact_email": "a"}}}]}, True),
]


def contracts(s, d):
    return refused(s, [(n, lambda body=body: rules.check_contract(rules.rules_from_dict(body), shop_spec())) for n, body, _ in CONTRACTS])


def bounded_report(s, d):
    """Failing rows listed: at most 100 a rule."""
    held = rules.rules_from_dict({"field_rules": [{"table": "orders", "field": "o_totalprice", "max_value": m} for m in (1000.0, 200000.0, 1e9)]})
    got = rules.report({"orders": table(s, d, "orders").withColumn(ROW, F.col("o_orderkey"))}, held)
    return s.createDataFrame([(r["rule"], r["failed"], len(r["rows"]), sum(r["rows"])) for r in got["results"]], "rule bigint, failed bigint, listed bigint, places bigint")


REPORTED = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS rule, (SELECT count(*) FROM orders WHERE o_totalprice > {m}) AS failed, count(*) AS listed, coalesce(sum(o_orderkey), 0)::BIGINT AS places FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > {m} ORDER BY o_orderkey LIMIT 100)"
    for i, m in enumerate((1000.0, 200000.0, 1000000000.0))
)

# validation

LOOSE = Dataset(
    [
        Entity("lines", 100, [Field("l_orderkey", "integer"), Field("l_linenumber", "integer"), Field("l_quantity", "float"), Field("l_discount", "float"), Field("l_tax", "float"), Field("line_total", "float")]),
        Entity("orders", 50, [Field("o_orderkey", "integer", is_identifier=True), Field("o_custkey", "integer"), Field("o_orderstatus"), Field("o_orderpriority", "integer"), Field("o_totalprice", "float"), Field("note")], "o_orderkey"),
    ],
    [Relationship("orders", "o_orderkey", "lines", "l_orderkey")],
    [
        Constraint("formula", "lines", target="line_total", expression="l_quantity * l_discount"), Constraint("conditional_required", "orders", condition_field="o_orderstatus", condition_value="F", required_field="note"),
        Constraint("formula", "lines", target="l_tax", expression="l_discount + 0"), Constraint("aggregate_mapping", "orders", target="o_totalprice", child_entity="lines", child_field="line_total", aggregate="sum"),
        Constraint("conditional_required", "orders", condition_field="o_orderstatus", condition_value="O", required_field="note"),
    ],
)


def _loose(s, d):
    return {"lines": priced(s, d), "orders": commented(s, d)}


def constraint_check(s, d):
    return validate.constraint_errors(LOOSE, _loose(s, d))


CONSTRAINT_CHECK = f"""
SELECT 0::INTEGER AS "constraint", 'formula' AS kind, count(*) FILTER (NOT coalesce(abs(line_total - l_quantity * l_discount) <= 1e-6, false)) AS n FROM {PRICED}
UNION ALL SELECT 1, 'conditional_required', count(*) FILTER (o_orderstatus = 'F' AND coalesce(note, '') = '') FROM {COMMENTED}
UNION ALL SELECT 2, 'formula', count(*) FILTER (NOT coalesce(abs(l_tax - l_discount) <= 1e-6, false)) FROM {PRICED}
UNION ALL SELECT 3, 'aggregate_mapping', count(*) FILTER (NOT abs(o_totalprice - coalesce(v, 0)) <= 1e-6) FROM {COMMENTED} LEFT JOIN (SELECT l_orderkey, sum(line_total) AS v FROM {PRICED} GROUP BY 1) ON l_orderkey = o_orderkey
UNION ALL SELECT 4, 'conditional_required', count(*) FILTER (o_orderstatus = 'O' AND coalesce(note, '') = '') FROM {COMMENTED}
"""


def schema_check(s, d):
    """Row counts, required cells, cells that don't read as their type, repeated keys."""
    return validate.schema_errors(LOOSE, {"lines": priced(s, d), "orders": commented(s, d).withColumn("o_orderkey", F.col("o_orderkey") % 1000)})


SCHEMA_CHECK = f"""
SELECT 'lines' AS entity, '' AS field, 'row_count' AS "check", abs(count(*) - 100)::BIGINT AS n FROM {PRICED} UNION ALL SELECT 'orders', '', 'row_count', abs(count(*) - 50) FROM {COMMENTED}
{' '.join(f"UNION ALL SELECT 'lines', '{c}', 'required', count(*) - count({c}) FROM {PRICED}" for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "line_total"))}
{' '.join(f"UNION ALL SELECT 'orders', '{c}', 'required', count(*) FILTER (coalesce({c}::VARCHAR, '') = '') FROM {COMMENTED}" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "note"))}
UNION ALL SELECT 'orders', 'o_orderpriority', 'type', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^(0|-?[1-9][0-9]*)$')) FROM {COMMENTED}
UNION ALL SELECT 'orders', 'o_orderkey', 'unique', count(*) - count(DISTINCT o_orderkey % 1000) FROM {COMMENTED}
"""


def reported(s, d):
    """Sections of a report: all, some, and only up to the first that fails."""
    tables = _loose(s, d) | {"extra": table(s, d, "region")}
    rows = []
    for name, kw in (("all", {}), ("two", {"sections": ("relationships", "privacy")}), ("fast", {"fail_fast": True})):
        got = validate.validate(LOOSE, tables, **kw)
        rows += [(name, k, x["passed"], any("unexpected entity" in e for e in x["errors"])) for k, x in got["sections"].items()]
    return s.createDataFrame(rows, "run string, section string, passed boolean, unexpected boolean")


REPORTS = values(
    "run, section, passed, unexpected",
    [("all", "schema", False, True), ("all", "relationships", True, False), ("all", "constraints", False, False), ("all", "privacy", True, False), ("two", "relationships", True, False), ("two", "privacy", True, False), ("fast", "schema", False, True)],
)


def _spec(field: Field, *held: Constraint) -> Dataset:
    return Dataset([Entity("e", 1, [Field("id", "integer", is_identifier=True), field, Field("kind")], "id")], constraints=list(held))


def spec_safety(s, d):
    """Specifications and profiles that carry source values of sensitive fields are refused."""
    values_ = {"kind": "categorical", "values": [{"value": "a", "weight": 1}]}
    tries = [
        ("plain", lambda: validate.assert_spec_safe(_spec(Field("status", distribution=values_)))), ("unmarked", lambda: validate.assert_spec_safe(_spec(Field("email", distribution=values_)))),
        ("categories", lambda: validate.assert_spec_safe(_spec(Field("email", sensitive=True, distribution=values_)))),
        ("exact bounds", lambda: validate.assert_spec_safe(_spec(Field("acct", "float", sensitive=True, distribution={"kind": "numeric", "min": 1, "max": 2})))),
        ("scaled bounds", lambda: validate.assert_spec_safe(_spec(Field("acct", "float", sensitive=True, distribution={"kind": "numeric", "min": 1, "max": 2, "scale_factor": 2.0})))),
        ("bare pattern", lambda: validate.assert_spec_safe(_spec(Field("email", sensitive=True, distribution={"kind": "masked_patterns", "patterns": [{"pattern": "a@b.c", "count": 1}]})))),
        ("masked pattern", lambda: validate.assert_spec_safe(_spec(Field("email", sensitive=True, distribution={"kind": "masked_patterns", "patterns": [{"pattern": "text_len_5", "count": 1}]})))),
        ("condition", lambda: validate.assert_spec_safe(_spec(Field("email", sensitive=True), Constraint("conditional_required", "e", condition_field="email", condition_value="x", required_field="kind")))),
        ("profile lengths", lambda: validate.assert_profile_safe(_spec(Field("email", sensitive=True, distribution={"kind": "string_pattern", "min_length": 1, "max_length": 2})))),
        ("profile of customers", lambda: validate.assert_profile_safe(Dataset([profile.profile(table(s, d, "customer"), "customer")]))),
    ]
    return refused(s, tries)


SPEC_SAFETY = values("tried, refused", [("plain", False), ("unmarked", True), ("categories", True), ("exact bounds", True), ("scaled bounds", False), ("bare pattern", True), ("masked pattern", False), ("condition", True), ("profile lengths", True), ("profile of customers", False)])


def command_line(s, d):
    """The whole path: profile, plan, generate, validate, verify, export; exit codes and rows."""
    import contextlib
    import io
    import tempfile
    from pathlib import Path

    from sparkloom.__main__ import main
    from sparkloom.sources import writers

    at = fresh_path(s, "command").removeprefix("file://")
    for n in ("customer", "nation"):
        writers.write_csv(table(s, d, n), f"{at}/in/{n}.csv")
    codes = []
    with tempfile.TemporaryDirectory() as own, contextlib.redirect_stdout(io.StringIO()):  # the driver's own documents
        p, q = str(Path(own) / "p.json"), str(Path(own) / "q.yaml")
        for argv in (
            ["profile", f"{at}/in", "-o", p], ["plan", p, "-o", q, "--rows", "30", "--seed", "5"], ["generate", q, "-o", f"{at}/out", "--format", "csv"], ["validate", q, f"{at}/out"], ["verify", f"{at}/out"],
            ["export-postgres", q, f"{at}/out", "-o", f"{at}/sql"],
        ):
            codes.append((argv[0], main(argv)))
    lines = s.read.text(f"{at}/sql").where("value LIKE 'INSERT%'").count()
    return s.createDataFrame([*codes, ("rows exported", lines)], "step string, code bigint")


COMMANDS = values("step, code", [("profile", 0), ("plan", 0), ("generate", 0), ("validate", 0), ("verify", 0), ("export-postgres", 0), ("rows exported", 60)])


SAFETY = [
    ("sketched_profile_lineitem", sketches, SKETCHES),
    ("profile_orders", profiled, _profiled_sql()),
    ("profile_sensitive_customer", sensitive_profile, SENSITIVE_PROFILE),
    ("semantic_types", semantics, SEMANTICS),
    ("field_names", names, NAMES_SQL),
    ("checksums", checksums, CHECKSUMS),
    ("mask_nested", nested, NESTED),
    ("category_policy", category_policy, values("tried, refused", [(f"{i} {n}", r) for i, (n, _, r) in enumerate(POLICY)] + [("segments", False)])),
    ("running_profile", running, RUNNING),
    ("relationship_candidates", hypotheses, HYPOTHESES),
    ("mined_constraints", mined, MINED),
    ("plan_from_profile", planned, PLANNED),
    ("generate_people", people, PEOPLE),
    ("conditional_fill", filled, FILLED),
    ("generation_modes", modes, MODES),
    ("fk_assign_one_to_one", one_to_one, ONE_TO_ONE),
    ("value_provider", provided, PROVIDED),
    ("budgets", budgets, BUDGETS),
    ("work_budgets", work, WORK),
    ("rule_times", times, TIMES_SQL),
    ("rule_edges", edges, EDGES),
    ("rule_contracts", contracts, values("tried, refused", [(n, r) for n, _, r in CONTRACTS])),
    ("rule_report", bounded_report, REPORTED),
    ("validate_constraints", constraint_check, CONSTRAINT_CHECK),
    ("validate_schema", schema_check, SCHEMA_CHECK),
    ("validation_report", reported, REPORTS),
    ("spec_safety", spec_safety, SPEC_SAFETY),
    ("command_line", command_line, COMMANDS),
]
