"""Queries of the generator, the solver, scenarios and the text sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.draws import ROW
from sparkloom.model import Constraint, Dataset, Entity, Field, Relationship
from sparkloom.operators import generate, rule_profiles, rules, validate
from sparkloom.operators.profile import q
from sparkloom.plans.profiling import table
from sparkloom.sources import writers

N_CUSTOMERS, N_ORDERS = 500, 5000


def spec(mode: str = "valid") -> Dataset:
    customers = Entity(
        "customers", N_CUSTOMERS,
        [
            Field("customer_id", "integer", is_identifier=True),
            Field("segment", "string", distribution={"kind": "categorical", "values": [{"value": "category_1", "weight": 5}, {"value": "category_2", "weight": 3}, {"value": "category_3", "weight": 2}]}),
            Field("orders_amount_total", "float"),
        ],
        "customer_id",
    )
    orders = Entity(
        "orders", N_ORDERS,
        [
            Field("order_id", "string", is_identifier=True),
            Field("customer_id", "integer"),
            Field("quantity", "integer", distribution={"kind": "numeric", "min": 1, "max": 50, "p05": 1, "p95": 20}),
            Field("unit_price", "float", distribution={"kind": "numeric", "min": 0.5, "max": 900.0, "p05": 1.0, "p95": 100.0, "scale_factor": 0.5}),
            Field("amount", "float"),
            Field("paid", "boolean", distribution={"kind": "boolean", "true_ratio": 0.75}),
            Field("created_on", "date", distribution={"kind": "date_range", "min": "2024-01-01", "max": "2024-12-31"}),
            Field("closed_on", "date", nullable=True, null_ratio=0.25, distribution={"kind": "date_range", "min": "2024-01-01", "max": "2024-12-31"}),
            Field("contact_email", "string", sensitive=True, semantic_type="email"),
        ],
        "order_id",
    )
    return Dataset(
        [customers, orders],
        [Relationship("customers", "customer_id", "orders", "customer_id")],
        [
            Constraint("formula", "orders", target="amount", expression="quantity * unit_price"),
            Constraint("temporal", "orders", start="created_on", end="closed_on"),
            Constraint("aggregate_mapping", "customers", target="orders_amount_total", child_entity="orders", child_field="amount", aggregate="sum"),
        ],
        seed=73, mode=mode, invalid_ratio=0.25 if mode == "mixed" else 0.0,
    )


def _u(entity: str, field: str, draw: str, seed: int, row: str = "i") -> str:
    return f"(('0x' || substr(md5('{seed}|{entity}|{field}|{draw}|' || {row}), 1, 8))::BIGINT / 4294967296.0)"


def raw_orders(s, d):
    sp = spec()
    out = generate.rows(s, sp, sp["orders"])
    return out.select(F.col(ROW).alias("row"), "order_id", "quantity", F.floor(F.col("unit_price") * 1000).alias("unit_price"), "paid", F.date_format("created_on", "yyyy-MM-dd").alias("created_on"), F.col("closed_on").isNull().alias("open"), "contact_email")


_DAY = "strftime(make_timestamp((1704067200 + floor({u} * (1735603200 - 1704067200 + 1)))::BIGINT * 1000000), '%Y-%m-%d')"
RAW = f"""
SELECT i AS row, printf('syn_orders_%08d', i + 1) AS order_id, greatest(1, least(20, round_even(1.0 + {_u('orders', 'quantity', 'value', 74)} * 19.0, 0)))::BIGINT AS quantity,
       floor(round_even(0.5 + {_u('orders', 'unit_price', 'value', 74)} * 49.5, 6) * 1000)::BIGINT AS unit_price, {_u('orders', 'paid', 'value', 74)} < 0.75 AS paid,
       {_DAY.format(u=_u('orders', 'created_on', 'value', 74))} AS created_on, {_u('orders', 'closed_on', 'null', 74)} < 0.25 AS "open",
       'user_' || substr(md5('74|orders|contact_email|text|' || i), 1, 12) || '@example.test' AS contact_email
FROM (SELECT unnest(range({N_ORDERS})) AS i)
"""


def segments(s, d):
    return generate.generate(s, spec())["customers"].groupBy("segment").agg(F.count("*").alias("n"))


SEGMENTS = f"""
SELECT CASE WHEN u * 10 <= 5 THEN 'category_1' WHEN u * 10 <= 8 THEN 'category_2' ELSE 'category_3' END AS segment, count(*) AS n
FROM (SELECT {_u('customers', 'segment', 'value', 73)} AS u FROM (SELECT unnest(range({N_CUSTOMERS})) AS i)) GROUP BY 1
"""


def solved(s, d):
    """What the solver must make hold in generated tables: every count of failures is 0."""
    sp = spec()
    made = generate.generate(s, sp)
    return validate.constraint_errors(sp, made).unionByName(validate.relationship_errors(sp, made).select(F.lit(9).alias("constraint"), F.col("check").alias("kind"), "n"))


SOLVED = "SELECT * FROM (VALUES (0::INTEGER, 'formula', 0::BIGINT), (1, 'temporal', 0), (2, 'aggregate_mapping', 0), (9, 'orphans', 0)) t(\"constraint\", kind, n)"


def assigned(s, d):
    """Orders dealt to customers in turn, by position."""
    low = table(s, d, "customer").agg(F.min("c_custkey"), F.count("*")).first()
    parents = table(s, d, "customer").withColumn(ROW, F.col("c_custkey") - low[0])
    child = table(s, d, "orders").select(F.col("o_orderkey").alias(ROW), F.lit(None).cast("bigint").alias("customer"))
    out = generate.assign_keys(child, "customer", parents, "c_custkey", low[1])
    return out.groupBy("customer").agg(F.count("*").alias("n"), F.min(ROW).alias("first_row"))


ASSIGNED = """
WITH p AS (SELECT min(c_custkey) AS lo, count(*) AS n FROM customer)
SELECT c_custkey AS customer, count(*) AS n, min(o_orderkey) AS first_row FROM orders, p LEFT JOIN customer ON c_custkey - lo = o_orderkey % p.n GROUP BY 1
"""


def totals(s, d):
    held = rule_profiles.aggregated(table(s, d, "orders"), "o_custkey", "o_totalprice", "sum")
    joined = table(s, d, "customer").join(held, F.col("c_custkey") == F.col("__key"), "left")
    return joined.select("c_custkey", F.round(F.coalesce("__value", F.lit(0.0)), 2).alias("total"))


def spoiled(s, d):
    sp = spec("mixed")
    made = generate.generate(s, sp)["orders"]
    return made.select(F.explode("__invalid").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


_SPOILED = ("customer_id", "quantity", "unit_price", "amount", "paid", "created_on", "closed_on", "contact_email")
SPOILED = " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER ({_u('orders', f, 'invalid', 74)} < 0.25) AS n FROM (SELECT unnest(range({N_ORDERS})) AS i)" for f in _SPOILED)


def scenarios(s, d):
    held = [rules.Scenario("rush", 1, {"orders": {"o_orderpriority": "1-URGENT"}}), rules.Scenario("calm", 3, {"orders": {"o_orderpriority": "5-LOW"}})]
    o = table(s, d, "orders").withColumn(ROW, F.col("o_orderkey"))
    return rules.apply_scenarios({"orders": o}, held, 5)["orders"].groupBy("o_orderpriority").agg(F.count("*").alias("n"))


SCENARIOS = f"SELECT CASE WHEN {_u('orders', '', 'scenario', 5, 'o_orderkey')} * 4 <= 1 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1"


def csv_cells(s, d):
    """Words that a spreadsheet would run, as they are written."""
    words = table(s, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word")).where(F.col("word").rlike(writers.FORMULA))
    return words.select("doc_id", writers.neutral(q("word")).alias("cell")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("cell")).alias("chars"))


CSV_CELLS = r"""
SELECT doc_id, count(*) AS n, sum(length(w) + 1)::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)
WHERE regexp_matches(w, '^[ \t\r\n]*[=+\-@]|^[\t\r\n]') GROUP BY doc_id
"""

GENERATION = [
    ("generate_rows", raw_orders, RAW),
    ("generate_categories", segments, SEGMENTS),
    ("generate_invalid", spoiled, SPOILED),
    ("solve_constraints", solved, SOLVED),
    ("fk_assign_roundrobin", assigned, ASSIGNED),
    ("aggregate_solve", totals, "SELECT c_custkey, round(coalesce(v, 0.0), 2)::DOUBLE AS total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey"),
    ("scenarios_orders", scenarios, SCENARIOS),
    ("csv_neutralise", csv_cells, CSV_CELLS),
    ("insert_sql_orders", lambda s, d: writers.insert_statements(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "orders"), "SELECT 'INSERT INTO \"orders\" (\"o_orderkey\", \"o_custkey\", \"o_orderpriority\") VALUES (' || o_orderkey || ', ' || o_custkey || ', ''' || replace(o_orderpriority, '''', '''''') || ''');' AS value FROM orders"),
]
