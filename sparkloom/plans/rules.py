"""Queries of the rule profiler, the constraint miner, the business rules and the validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.draws import ROW
from sparkloom.model import Dataset, Entity, Field, Relationship
from sparkloom.operators import constraints, relationships, rule_profiles, rules, validate
from sparkloom.plans.profiling import table

_REPORT = "checked, passed, checked - passed AS failed, {extra} CASE WHEN checked = 0 THEN 0.0 ELSE round(passed / checked, 6) END::DOUBLE AS confidence, CASE WHEN checked > 0 AND round(passed / checked, 6) >= 0.9 THEN 'inferred' ELSE 'rejected' END AS status"


def _report(counts: str, extra: str = "") -> str:
    return f"SELECT {_REPORT.format(extra=extra)} FROM ({counts})"


def shipped(s, d):
    return table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def priced(s, d):
    """Lines with a total that holds by construction, but for one in 50."""
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return l.withColumn("line_total", F.when(F.col("l_orderkey") % 50 == 0, F.lit(0.0)).otherwise(F.col("l_quantity") * F.col("l_discount")))


PRICED = "(SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, CASE WHEN l_orderkey % 50 = 0 THEN 0.0 ELSE l_quantity * l_discount END AS line_total FROM lineitem)"


def commented(s, d):
    """Orders with a note where the status asks for one, mostly."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return o.withColumn("note", F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 20 != 0), F.lit("done")))


COMMENTED = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 20 <> 0 THEN 'done' END AS note FROM orders)"

MINED_COLUMNS = ["l_quantity", "l_discount", "l_tax", "line_total"]


def _formula_mining_sql() -> str:
    from itertools import combinations

    parts, rank = [], 0
    for t in MINED_COLUMNS:
        for a, b in combinations([c for c in MINED_COLUMNS if c != t], 2):
            for op in ("*", "+"):
                parts.append(
                    f"SELECT {rank}::INTEGER AS rank, '{t}' AS target, '{a} {op} {b}' AS expression, count(*) FILTER ({t} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL) AS checked, count(*) FILTER (abs({t} - ({a} {op} {b})) <= 1e-6) AS passed FROM {PRICED}"
                )
                rank += 1
    return f"SELECT *, CASE WHEN checked = 0 THEN 0.0 ELSE round(passed / checked, 6) END::DOUBLE AS confidence FROM ({' UNION ALL '.join(parts)})"


def temporal_mining(s, d):
    return constraints.temporal_candidates(shipped(s, d).select("o_orderdate", "l_shipdate"))


TEMPORAL_MINING = " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS rank, '{a}' AS start_field, '{b}' AS end_field, count(*) AS checked, count(*) FILTER ({a} <= {b}) AS passed, round(count(*) FILTER ({a} <= {b}) / count(*), 6)::DOUBLE AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    for i, (a, b) in enumerate((("o_orderdate", "l_shipdate"), ("l_shipdate", "o_orderdate")))
)


def conditional_mining(s, d):
    return constraints.conditional_candidates(commented(s, d), ["o_orderstatus", "o_orderpriority"], ["note"])


CONDITIONAL_MINING = f"""
WITH c AS (SELECT 'o_orderstatus' AS f, o_orderstatus AS v, note FROM {COMMENTED} UNION ALL SELECT 'o_orderpriority', o_orderpriority, note FROM {COMMENTED}),
base AS (SELECT f, count(note) / count(*) AS base FROM c GROUP BY f)
SELECT f AS condition_field, v AS condition_value, 'note' AS required_field, count(*) AS n, round(count(note) / count(*), 6)::DOUBLE AS confidence,
       round(count(note) / count(*) - any_value(base), 6)::DOUBLE AS lift FROM c JOIN base USING (f) WHERE v IS NOT NULL AND v <> '' GROUP BY f, v
"""


def agg_mapping(s, d):
    """Order totals against the sum of their lines: rejected on this data."""
    return _rounded(rule_profiles.aggregate_mapping(table(s, d, "orders"), "o_orderkey", "o_totalprice", table(s, d, "lineitem"), "l_orderkey", "l_extendedprice"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in ("avg_error", "max_error")})


def agg_holds(s, d):
    """A count of lines that holds by construction."""
    lines = table(s, d, "lineitem")
    n = lines.groupBy("l_orderkey").agg(F.count("*").cast("double").alias("n_lines"))
    return _rounded(rule_profiles.aggregate_mapping(n, "l_orderkey", "n_lines", lines, "l_orderkey", None, "count"))


AGG = "SELECT count(w) AS checked, count(*) FILTER (w IS NOT NULL AND abs(w - coalesce(v, 0.0)) <= 1e-6) AS passed, round(avg(abs(w - coalesce(v, 0.0))), 4)::DOUBLE AS avg_error, round(max(abs(w - coalesce(v, 0.0))), 4)::DOUBLE AS max_error FROM {p}"
ERRORS = "avg_error, max_error,"

ORDER_RULES = {
    "field_rules": [
        {"table": "orders", "field": "o_orderstatus", "required": True, "allowed_values": ["F", "O"]},
        {"table": "orders", "field": "o_totalprice", "min_value": 5000.0, "max_value": 300000.0},
    ],
    "row_rules": [
        {"kind": "conditional_required", "table": "orders", "when": {"field": "o_orderstatus", "equals": "F"}, "required_fields": ["note"]},
        {"kind": "conditional_allowed_values", "table": "orders", "when": {"field": "o_orderstatus", "in_values": ["O", "P"]}, "field": "o_orderpriority", "allowed_values": ["1-URGENT", "2-HIGH"]},
        {"kind": "formula", "table": "lines", "field": "line_total", "expression": "l_quantity * l_discount"},
    ],
    "cross_table_rules": [
        {"kind": "foreign_key", "child_table": "orders", "child_field": "o_custkey", "parent_table": "customer", "parent_field": "c_custkey"},
        {"kind": "aggregate_formula", "table": "customer", "field": "*", "expression": "count()"},
        {"kind": "aggregate_formula", "table": "lines", "field": "line_total", "expression": "sum('l_tax')"},
    ],
}


def _tables(s, d):
    return {"orders": commented(s, d), "lines": priced(s, d), "customer": table(s, d, "customer")}


def rule_counts(s, d):
    return rules.validate(_tables(s, d), rules.rules_from_dict(ORDER_RULES))


RULE_COUNTS = f"""
SELECT 0::INTEGER AS rule, 'field' AS kind, count(*) AS checked, count(*) FILTER (coalesce(o_orderstatus, '') NOT IN ('F', 'O')) AS failed FROM {COMMENTED}
UNION ALL SELECT 1, 'field', count(*), count(*) FILTER (o_totalprice < 5000 OR o_totalprice > 300000) FROM {COMMENTED}
UNION ALL SELECT 2, 'conditional_required', count(*), count(*) FILTER (coalesce(note, '') = '') FROM {COMMENTED} WHERE o_orderstatus = 'F'
UNION ALL SELECT 3, 'conditional_allowed_values', count(*), count(*) FILTER (coalesce(o_orderpriority, '') NOT IN ('1-URGENT', '2-HIGH')) FROM {COMMENTED} WHERE o_orderstatus IN ('O', 'P')
UNION ALL SELECT 4, 'formula', count(*), count(*) FILTER (NOT coalesce(abs(line_total - l_quantity * l_discount) <= 1e-6, false)) FROM {PRICED}
UNION ALL SELECT 5, 'foreign_key', count(*), count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders
UNION ALL SELECT 6, 'aggregate_formula', 1, 0
UNION ALL SELECT 7, 'aggregate_formula', 1, CASE WHEN abs(sum(line_total) - sum(l_tax)) <= 1e-6 THEN 0 ELSE 1 END FROM {PRICED}
"""


def rules_applied(s, d):
    """Orders after the repairs of the rules."""
    out = rules.apply_valid(_tables(s, d), rules.rules_from_dict(ORDER_RULES))["orders"]
    return out.groupBy("o_orderstatus", "o_orderpriority", "note").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


RULES_APPLIED = f"""
SELECT st AS o_orderstatus, CASE WHEN st IN ('O', 'P') AND coalesce(o_orderpriority, '') NOT IN ('1-URGENT', '2-HIGH') THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN st = 'F' AND coalesce(note, '') = '' THEN 'required' ELSE note END AS note, count(*) AS n, round(sum(o_totalprice), 2)::DOUBLE AS total
FROM (SELECT *, CASE WHEN coalesce(o_orderstatus, '') NOT IN ('F', 'O') THEN 'F' ELSE o_orderstatus END AS st FROM {COMMENTED}) GROUP BY 1, 2, 3
"""


def rules_broken(s, d):
    """Each case of the order rules broken in turn, counted by case and by what then fails."""
    held = rules.rules_from_dict(ORDER_RULES)
    tables = {n: df for n, df in _tables(s, d).items()}
    tables["orders"] = rules.apply_valid(tables, held)["orders"].withColumn(ROW, F.col("o_orderkey"))
    tables["lines"] = tables["lines"].withColumn(ROW, F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    tables["customer"] = tables["customer"].withColumn(ROW, F.col("c_custkey"))
    return rules.break_rules(tables, held, seed=11, ratio=0.5)["orders"].groupBy("__broken").agg(F.count("*").alias("n")).select(F.col("__broken").alias("broken"), "n")


#: which rows are hit follows from md5 draws; the cases are dealt in turn, from an offset of the seed
RULES_BROKEN = """
WITH hit AS (
  SELECT o_orderkey, ('0x' || substr(md5('11|orders||break|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 <= 0.5 AS h FROM orders
), dealt AS (
  SELECT CASE WHEN h THEN ((row_number() OVER (PARTITION BY h ORDER BY o_orderkey) - 1 + ('0x' || substr(sha256('11|orders'), 1, 8))::BIGINT % 7) % 7)::INTEGER END AS broken FROM hit
)
SELECT broken, count(*) AS n FROM dealt GROUP BY broken
"""


def orphan_orders(s, d):
    few = table(s, d, "customer").where("c_custkey % 3 <> 0")
    return relationships.orphans(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", few, "c_custkey")


SPEC = Dataset(
    [
        Entity("customer", 1, [Field("c_custkey", "integer", is_identifier=True), Field("c_name", "string", sensitive=True)], "c_custkey"),
        Entity("orders", 1, [Field("o_orderkey", "integer", is_identifier=True), Field("o_custkey", "integer"), Field("o_orderstatus", "string")], "o_orderkey"),
    ],
    [Relationship("customer", "c_custkey", "orders", "o_custkey"), Relationship("customer", "c_custkey", "orders", "o_orderkey", "one_to_one")],
)


def relationship_check(s, d):
    few = table(s, d, "customer").where("c_custkey % 3 <> 0")
    return validate.relationship_errors(SPEC, {"customer": few, "orders": table(s, d, "orders")})


RELATIONSHIP_CHECK = """
SELECT 'customer.c_custkey' AS parent, 'orders.o_custkey' AS child, 'orphans' AS "check", count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
UNION ALL SELECT 'customer.c_custkey', 'orders.o_orderkey', 'orphans', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
UNION ALL SELECT 'customer.c_custkey', 'orders.o_orderkey', 'repeated', (count(o_orderkey) - count(DISTINCT o_orderkey)) FROM orders
"""


def reuse(s, d):
    """Customers of a made table that repeat the source's."""
    source = table(s, d, "customer")
    made = source.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.lit("made up")).otherwise(F.col("c_mktsegment")))
    return validate.reused_rows(made, source).select("c_custkey", "c_mktsegment")


RULES = [
    ("rule_foreign_key", lambda s, d: rule_profiles.foreign_key(table(s, d, "customer").where("c_custkey % 3 <> 0"), "c_custkey", table(s, d, "orders"), "o_custkey"),
     _report("SELECT count(o_custkey) AS checked, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)) AS passed FROM orders")),
    ("rule_temporal", lambda s, d: rule_profiles.temporal_ordering(shipped(s, d), "o_orderdate", "l_shipdate"),
     _report("SELECT count(*) AS checked, count(*) FILTER (o_orderdate <= l_shipdate) AS passed FROM lineitem JOIN orders ON l_orderkey = o_orderkey")),
    ("rule_formula", lambda s, d: _rounded(rule_profiles.formula_rule(priced(s, d), "line_total", "l_quantity * l_discount")),
     _report(f"SELECT count(*) AS checked, count(*) FILTER (abs(line_total - l_quantity * l_discount) <= 1e-6) AS passed, round(avg(abs(line_total - l_quantity * l_discount)), 4)::DOUBLE AS avg_error, round(max(abs(line_total - l_quantity * l_discount)), 4)::DOUBLE AS max_error FROM {PRICED}", ERRORS)),
    ("rule_formula_division", lambda s, d: _rounded(rule_profiles.formula_rule(priced(s, d), "l_quantity", "line_total / l_discount", 1e-3)),
     _report(f"SELECT count(*) FILTER (l_discount <> 0) AS checked, count(*) FILTER (l_discount <> 0 AND abs(l_quantity - line_total / l_discount) <= 1e-3) AS passed, round(avg(CASE WHEN l_discount <> 0 THEN abs(l_quantity - line_total / l_discount) END), 4)::DOUBLE AS avg_error, round(max(CASE WHEN l_discount <> 0 THEN abs(l_quantity - line_total / l_discount) END), 4)::DOUBLE AS max_error FROM {PRICED}", ERRORS)),
    ("rule_conditional_required", lambda s, d: rule_profiles.conditional_required(commented(s, d), "o_orderstatus", "F", "note"),
     _report(f"SELECT count(*) AS checked, count(*) FILTER (coalesce(note, '') <> '') AS passed FROM {COMMENTED} WHERE o_orderstatus = 'F'")),
    ("rule_conditional_allowed", lambda s, d: rule_profiles.conditional_allowed_values(table(s, d, "orders"), "o_orderstatus", "O", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]),
     _report("SELECT count(*) AS checked, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS passed FROM orders WHERE o_orderstatus = 'O'")),
    ("rule_aggregate_mapping", agg_mapping, _report(AGG.format(p="(SELECT o_totalprice AS w, v FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"), ERRORS)),
    ("rule_aggregate_count", agg_holds, _report(AGG.format(p="(SELECT n::DOUBLE AS w, n::DOUBLE AS v FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1))"), ERRORS)),
    ("formula_mining", lambda s, d: constraints.formula_candidates(priced(s, d), MINED_COLUMNS), _formula_mining_sql()),
    ("temporal_mining", temporal_mining, TEMPORAL_MINING),
    ("conditional_mining", conditional_mining, CONDITIONAL_MINING),
    ("business_rules_validate", rule_counts, RULE_COUNTS),
    ("business_rules_apply", rules_applied, RULES_APPLIED),
    ("business_rules_break", rules_broken, RULES_BROKEN),
    ("validate_orphans", orphan_orders, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)"),
    ("validate_relationships", relationship_check, RELATIONSHIP_CHECK),
    ("validate_pk_unique", lambda s, d: validate.duplicate_keys(table(s, d, "lineitem"), "l_orderkey"), "SELECT count(*) - count(DISTINCT l_orderkey) AS n FROM lineitem"),
    ("source_row_reuse", reuse, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 OR c_mktsegment = 'made up'"),
]
