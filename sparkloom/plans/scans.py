"""Queries of sources, sinks, policies and catalogs."""

from __future__ import annotations

import json
import tempfile
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from sparkloom.functions.draws import ROW
from sparkloom.model import Dataset, Entity, Field, Relationship, SpecError
from sparkloom.operators import profile
from sparkloom.plans.profiling import table
from sparkloom.shared import SETTING, file_system, fresh_path
from sparkloom.sources import catalog, query_source, readers, writers


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of constant rows."""
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else str(v) if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def refusals(spark, tries) -> list[tuple[str, bool]]:
    """(name, whether it was refused) for (name, call) pairs."""
    out = []
    for name, call in tries:
        try:
            call()
            out.append((name, False))
        except (ValueError, TypeError):
            out.append((name, True))
    return out


def refused(spark, tries):
    return spark.createDataFrame(refusals(spark, tries), "tried string, refused boolean")


# CSV


def csv_orders(s, d):
    """Orders through a semicolon-separated Latin-1 file, types found anew."""
    path = fresh_path(s, "csv-orders")
    o = table(s, d, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("état"), "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.concat(F.lit("prio; "), "o_orderpriority").alias("priorité"),
    )
    o.write.options(header=True, sep=";", encoding="ISO-8859-1", escape='"').csv(path)
    df = readers.csv_file(s, path)
    typed = profile.typed_frame(df, profile.infer_types(df))
    return typed.groupBy(F.col("état").alias("status"), F.col("priorité").alias("priority")).agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day")
    )


CSV_ORDERS = """
SELECT o_orderstatus AS status, 'prio; ' || o_orderpriority AS priority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2)::DOUBLE AS total,
       strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY 1, 2
"""


def csv_wide(s, d):
    """A file of 1,000 columns, whose header is longer than what the dialect is guessed from."""
    path = fresh_path(s, "csv-wide")
    table(s, d, "nation").select(*((F.col("n_nationkey") + i).alias(f"measure_column_{i:04d}") for i in range(1000))).write.option("header", True).csv(path)
    df = readers.csv_file(s, path)
    return df.agg(F.lit(len(df.columns)).cast("bigint").alias("n_columns"), F.count("*").alias("n_rows"), F.sum(F.col(df.columns[-1]).cast("bigint")).alias("last_column"))


def csv_line_breaks(s, d):
    """Texts with line breaks and quotes through a CSV file."""
    path = fresh_path(s, "csv-texts")
    writers.write_csv(table(s, d, "documents").select("doc_id", "text"), path)
    df = readers.csv_file(s, path)
    return df.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.split("text", "\n")) - 1).alias("line_breaks"))


CSV_TEXTS = r"""
SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum(length(t))::BIGINT AS chars, sum(length(t) - length(replace(t, chr(10), '')))::BIGINT AS line_breaks
FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '^[ \t\r\n]*[=+\-@]|^[\t\r\n]') THEN '''' || text ELSE text END AS t FROM documents)
"""


def folder(s, d):
    """A folder of one CSV, one JSON and one Parquet table."""
    path = fresh_path(s, "folder")
    writers.write_csv(table(s, d, "customer"), f"{path}/customer.csv")
    writers.write_json(table(s, d, "nation"), f"{path}/nation.json")
    writers.write_parquet(table(s, d, "orders"), f"{path}/orders.parquet")
    held = readers.dataset_folder(s, path)
    return s.createDataFrame([(n, len(df.columns), df.count()) for n, df in held.items()], "entity string, n_columns bigint, n_rows bigint")


FOLDER = "SELECT 'customer' AS entity, (SELECT count(*) FROM (DESCRIBE customer)) AS n_columns, (SELECT count(*) FROM customer) AS n_rows UNION ALL SELECT 'nation', (SELECT count(*) FROM (DESCRIBE nation)), (SELECT count(*) FROM nation) UNION ALL SELECT 'orders', (SELECT count(*) FROM (DESCRIBE orders)), (SELECT count(*) FROM orders)"


def csv_folder(s, d):
    path = fresh_path(s, "csv-folder")
    for n in ("region", "nation", "supplier"):
        writers.write_csv(table(s, d, n), f"{path}/{n}.csv")
    writers.write_json(table(s, d, "region"), f"{path}/ignored.json")
    held = readers.csv_folder(s, path)
    return s.createDataFrame([(n, df.count()) for n, df in held.items()], "entity string, n_rows bigint")


def row_sample(s, d):
    """The first 100 orders by place in the file (the sampling reader's limit is its feature)."""
    return readers.first_rows(readers.numbered(table(s, d, "orders").select("o_orderkey")), 100).select("o_orderkey", F.col(ROW).alias("place"))


def sinks(s, d):
    """Events through the JSON and the Parquet sink."""
    at = fresh_path(s, "sinks")
    events = table(s, d, "events").withColumn("ts", F.col("ts").cast("string"))
    writers.write_json(events, f"{at}/json")
    writers.write_parquet(events, f"{at}/parquet")
    back = s.read.schema(events.schema).json(f"{at}/json").withColumn("sink", F.lit("json")).unionByName(s.read.parquet(f"{at}/parquet").withColumn("sink", F.lit("parquet")))
    return back.groupBy("sink", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("user_id").alias("users"))


SINKS = "SELECT sink, event_type, count(*) AS n, round(sum(value), 2)::DOUBLE AS total, count(DISTINCT user_id) AS users FROM events, (VALUES ('json'), ('parquet')) t(sink) GROUP BY 1, 2"


GEO = Dataset(
    [
        Entity("region", 5, [Field("r_regionkey", "integer", is_identifier=True), Field("r_name")], "r_regionkey"),
        Entity("nation", 25, [Field("n_nationkey", "integer", is_identifier=True), Field("n_name"), Field("n_regionkey", "integer")], "n_nationkey"),
    ],
    [Relationship("region", "r_regionkey", "nation", "n_regionkey")],
)


def postgres(s, d):
    """The script of two related tables, line by line."""
    tables = {"nation": table(s, d, "nation").withColumn(ROW, F.col("n_nationkey")), "region": table(s, d, "region").withColumn(ROW, F.col("r_regionkey"))}
    return writers.postgres_script(GEO, tables).select("part", "row", "value")


_INT = "CASE WHEN (SELECT data_type FROM information_schema.columns WHERE table_name = '{t}' AND column_name = '{c}') IN ('BIGINT', 'INTEGER') THEN 'BIGINT' ELSE 'TEXT' END"


def _postgres_sql() -> str:
    create = lambda t, cols: f"'CREATE TABLE \"{t}\" (' || chr(10) || " + " || ',' || chr(10) || ".join(f"'  \"{c}\" ' || {_INT.format(t=t, c=c)}" for c in cols) + f" || ',' || chr(10) || '  PRIMARY KEY (\"{cols[0]}\")' || chr(10) || ');'"
    region, nation = ["r_regionkey", "r_name"], ["n_nationkey", "n_name", "n_regionkey"]
    return f"""
SELECT 0::INTEGER AS part, 0::BIGINT AS row, 'BEGIN;' AS value UNION ALL SELECT 0, 1, {create("region", region)} UNION ALL SELECT 0, 2, {create("nation", nation)}
UNION ALL SELECT 1, r_regionkey, 'INSERT INTO "region" ("r_regionkey", "r_name") VALUES (' || r_regionkey || ', ''' || r_name || ''');' FROM region
UNION ALL SELECT 2, n_nationkey, 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ');' FROM nation
UNION ALL SELECT 3, 0, 'ALTER TABLE "nation" ADD FOREIGN KEY ("n_regionkey") REFERENCES "region" ("r_regionkey");' UNION ALL SELECT 3, 1, 'COMMIT;'
"""


def bundle(s, d):
    """Tables published with their manifest, checked, then held against a file added later."""
    at = fresh_path(s, "bundle")
    tables = {"nation": table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "region": table(s, d, "region").select("r_regionkey", "r_name")}
    manifest = writers.write_bundle(s, GEO, tables, at, "csv", profile=GEO)
    clean = len(writers.verify_bundle(s, at))
    writers.put_text(s, f"{at}/added.csv", "x\n1\n")
    spoiled = len(writers.verify_bundle(s, at))
    listed = [p for p in manifest["files"] if "/" not in p]
    rows = [(n, k) for n, k in sorted(manifest["row_counts"].items())] + [("differing files", clean), ("differing after a file was added", spoiled), ("documents", len(listed))]
    again = refusals(s, [("published twice", lambda: writers.write_bundle(s, GEO, tables, at))])
    return s.createDataFrame(rows + [(n, int(r)) for n, r in again], "what string, n bigint")


BUNDLE = "SELECT 'nation' AS what, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL " + values("what, n", [("differing files", 0), ("differing after a file was added", 1), ("documents", 3), ("published twice", 1)])


# documents


DOCUMENT = {"entities": [{"name": "e", "row_count": 3, "fields": [{"name": "id", "data_type": "integer", "is_identifier": True}, {"name": "v", "data_type": "float"}], "primary_key": "id"}], "seed": 4}
FLAT = {"table": "people", "row_count": 10, "columns": [{"name": "id", "data_type": "bigint", "distinct_count": 10}, {"name": "email", "data_type": "email"}, {"name": "born", "data_type": "timestamp", "min": "2000-01-01", "max": "2001-01-01"}, {"name": "size", "data_type": "numeric(10,2)", "min": 1, "max": 9}]}


def loaders(s, d):
    """Specifications, profiles of both shapes and rules, read from files; what must be refused is."""
    import yaml

    with tempfile.TemporaryDirectory() as at:  # the driver's own documents
        put = lambda name, text: (Path(at) / name, (Path(at) / name).write_text(text))[0]
        spec = readers.load_spec(put("spec.yaml", yaml.safe_dump(DOCUMENT)))
        flat = readers.load_profile(put("flat.json", json.dumps(FLAT)))
        rules = readers.load_rules(put("rules.yaml", "field_rules:\n- {table: e, field: v, min_value: 1}\n"))
        rows = [("spec seed", str(spec.seed)), ("spec key", spec["e"].primary_key), ("rules", str(len(rules.all())))]
        rows += [(f"profile {f.name}", f"{f.data_type} {f.distribution['kind']} {str(f.sensitive).lower()}") for f in flat.entities[0].fields]
        deep = put("deep.json", "[" * 60 + "]" * 60)
        tries = [
            ("profile as specification", lambda: readers.load_spec(put("p.json", json.dumps(FLAT)))), ("too deep", lambda: readers.load_document(deep)),
            ("aliases", lambda: readers.load_document(put("a.yaml", "a: &x 1\nb: *x\n"))), ("unknown rule section", lambda: readers.load_rules(put("r.yaml", "other: []\n"))),
            ("unknown key", lambda: readers.load_spec(put("u.yaml", yaml.safe_dump(DOCUMENT | {"more": 1})))), ("interval", lambda: readers.logical_name("interval year")),
        ]
        rows += [(n, "refused" if r else "taken") for n, r in refusals(s, tries)]
    return s.createDataFrame(rows, "what string, found string")


LOADERS = values(
    "what, found",
    [
        ("spec seed", "4"), ("spec key", "id"), ("rules", "1"), ("profile id", "integer synthetic_identifier false"), ("profile email", "string masked_patterns true"),
        ("profile born", "datetime datetime_range false"), ("profile size", "float numeric false"), ("profile as specification", "refused"), ("too deep", "refused"), ("aliases", "refused"),
        ("unknown rule section", "refused"), ("unknown key", "refused"), ("interval", "refused"),
    ],
)

TYPE_NAMES = [
    ("bigint", "integer"), ("serial", "integer"), ("smallint", "integer"), ("double precision", "float"), ("numeric(10,2)", "float"), ("real", "float"), ("boolean", "boolean"), ("timestamp(3)", "datetime"),
    ("date", "date"), ("varchar(20)", "string"), ("uuid", "string"), ("email", "string"),
]


def type_names(s, d):
    return s.createDataFrame([(n, readers.logical_name(n)[0]) for n, _ in TYPE_NAMES], "name string, logical string")


def cache(s, d):
    """A profile made once and then taken from the cache; a changed setting makes it anew."""
    with tempfile.TemporaryDirectory() as at:  # profiles are small documents of the driver
        made = []

        def make():
            made.append(1)
            return Dataset([profile.profile(table(s, d, "nation"), "nation")])

        keys = [readers.folder_fingerprint(s, d, setting) for setting in ("a", "a", "b")]
        held = [readers.cached_profile(at, k, make) for k in keys]
    return s.createDataFrame([(len(set(keys)), len(made), held[1].entities[0].row_count)], "keys bigint, made bigint, n_rows bigint")


# databases and catalogs


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def shipped(s, df, name: str) -> str:
    """URL of a Derby database of one table that the driver and every executor can open.

    A database in memory, or in a folder, belongs to the one process that opened it.  This one is
    filled by the driver, from files that the executors wrote, and then packed: any number of
    processes may read a database in an archive.  Pages are stored as they are, to be found by place.
    """
    jvm, packed = s.sparkContext._jvm, fresh_path(s, f"{name}-database") + ".jar"
    jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    at, fs = file_system(s, packed)
    if fs.getScheme() != "file":
        raise RuntimeError(f"{SETTING} must be a folder of files for an embedded database")
    rows = fresh_path(s, f"{name}-rows")
    df.write.option("escape", '"').csv(rows)
    with tempfile.TemporaryDirectory() as own:  # the driver's own, while the database is filled
        own = Path(own).resolve()
        url = f"jdbc:derby:{own}/db"
        s.createDataFrame([], df.schema).write.format("jdbc").options(url=f"{url};create=true", dbtable=name, **DERBY).save()  # no rows, no task
        session = jvm.java.sql.DriverManager.getConnection(url)
        load = session.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
        load.setString(1, name.upper())
        for f in sorted(x.getPath().toUri().getPath() for x in fs.listStatus(file_system(s, rows)[0]) if x.getPath().getName().startswith("part-")):
            load.setString(2, f)
            load.execute()
        session.close()
        try:
            jvm.java.sql.DriverManager.getConnection(f"{url};shutdown=true")
        except Py4JJavaError as e:
            if e.java_exception.getSQLState() != "08006":  # what a shutdown that went well says
                raise
        with zipfile.ZipFile(own / "db.jar", "w", zipfile.ZIP_STORED) as out:
            for f in sorted((own / "db").rglob("*")):
                out.write(f, f.relative_to(own))
        fs.copyFromLocalFile(file_system(s, f"file://{own}/db.jar")[0], at)
    fs.delete(file_system(s, rows)[0], True)
    return f"jdbc:derby:jar:({at.toUri().getPath()})db"


def jdbc(s, d):
    """Customers out of a database, read in four ranges of the key."""
    held = table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    url, ends = shipped(s, held, "customers"), held.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    ranges = None if ends[0] is None else {"column": "c_custkey", "low": ends[0], "high": ends[1], "n": 4}
    back = readers.jdbc(s, url, 'SELECT "c_custkey", "c_nationkey", "c_acctbal" FROM customers WHERE "c_acctbal" >= 0', DERBY, ranges)
    return back.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def database(s, d):
    """A read-only database source under a budget: its rows, what it refuses, and how it opens its sessions."""
    from sparkloom.sources.budget import WorkBudget
    from sparkloom.sources.databases import Database, keys_of

    url = shipped(s, table(s, d, "nation").select("n_nationkey", "n_regionkey"), "nations")
    sql = 'SELECT "n_regionkey", count(*) AS "n" FROM nations GROUP BY "n_regionkey"'
    held = Database(s, url, DERBY, WorkBudget({"statements": 2, "rows": 100, "cells": 1000}))
    rows = [(f"region {r[0]}", int(r[1])) for r in held.rows(sql)]
    tries = [
        ("write", lambda: held.query("DELETE FROM nations")), ("second", lambda: held.query(sql)), ("third", lambda: held.query(sql)),
        ("rows", lambda: Database(s, url, DERBY, WorkBudget({"rows": 3})).rows(sql)), ("two statements", lambda: held.query("SELECT 1; SELECT 2")),
    ]
    opened = Database(s, "jdbc:postgresql://host/db", budget=WorkBudget({"seconds": 9.0}, clock=lambda: 0.0)).session()
    rows += [(n, int(r)) for n, r in refusals(s, tries)] + [("read only", int("READ ONLY" in opened["sessionInitStatement"])), ("timeout", int(opened["queryTimeout"]))]
    keys = keys_of([("a", "id", 1), ("b", "x", 1), ("b", "y", 2)], [("b", "a_id", "a", "id", "f", 1), ("c", "p", "b", "x", "g", 1), ("c", "q", "b", "y", "g", 2)])
    return s.createDataFrame([*rows, ("primary keys", len(keys.primary)), ("foreign keys", len(keys.foreign))], "what string, n bigint")


DATABASE = "SELECT 'region ' || n_regionkey AS what, count(*) AS n FROM nation GROUP BY 1 UNION ALL " + values(
    "what, n", [("write", 1), ("second", 0), ("third", 1), ("rows", 1), ("two statements", 1), ("read only", 1), ("timeout", 9), ("primary keys", 1), ("foreign keys", 1)]
)


def listing(s, d):
    """Columns of a table as the catalog shows them, and what an allowlist leaves of the tables."""
    for n in ("orders", "nation"):
        table(s, d, n).createOrReplaceTempView(f"sparkloom_listed_{n}")
    found = catalog.describe(s, "sparkloom_listed_orders")
    names = catalog.tables(s, allowed={"sparkloom_listed_orders", "sparkloom_listed_nation", "sparkloom_absent"})
    rows = [(i, c["column"], c["logical_type"]) for i, c in enumerate(found, 1)] + [(0, n, "table") for n in names]
    rows += [(-1, "default", "schema") for x in catalog.schemas(s, {"default"})] + [(-2, x, "catalog") for x in catalog.catalogs(s, {"spark_catalog"})]
    return s.createDataFrame(rows, "place bigint, name string, kind string")


LISTING = """
SELECT ordinal_position::BIGINT AS place, column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime'
       WHEN data_type = 'DATE' THEN 'date' ELSE 'string' END AS kind FROM information_schema.columns WHERE table_name = 'orders'
UNION ALL SELECT * FROM (VALUES (0, 'sparkloom_listed_orders', 'table'), (0, 'sparkloom_listed_nation', 'table'), (-1, 'default', 'schema'), (-2, 'spark_catalog', 'catalog')) t
"""

# policies

SCOPE = {"sparkloom_scoped": {"n_nationkey", "n_regionkey", "n_name"}}
#: statement, refused as a query source, refused as a safe select
STATEMENTS = [
    ("SELECT n_nationkey, n_regionkey + 1 AS r FROM sparkloom_scoped WHERE n_regionkey IN (1, 2)", False, True),
    ("SELECT n_nationkey FROM sparkloom_scoped WHERE n_regionkey BETWEEN 1 AND 3 LIMIT 10", True, False),
    ("SELECT n_nationkey FROM sparkloom_scoped LIMIT 1001", True, True),
    ("SELECT n_name FROM sparkloom_scoped LIMIT 5", True, True),
    ("SELECT n_nationkey AS a, n_regionkey AS a FROM sparkloom_scoped", True, True),
    ("SELECT n_nationkey + 1 FROM sparkloom_scoped", True, True),
    ("SELECT n_comment FROM sparkloom_scoped", True, True),
    ("SELECT a.n_nationkey FROM sparkloom_scoped a JOIN sparkloom_scoped b ON a.n_nationkey = b.n_nationkey", True, True),
    ("SELECT n_nationkey FROM sparkloom_scoped ORDER BY 1 LIMIT 5", True, True),
    ("SELECT count(*) AS n FROM sparkloom_scoped", True, True),
    ("SELECT n_nationkey FROM sparkloom_scoped WHERE n_regionkey = (SELECT max(n_regionkey) FROM sparkloom_scoped) LIMIT 5", True, True),
    ("SELECT n_nationkey /* x */ FROM sparkloom_scoped LIMIT 5", True, True),
    ("SELECT n_nationkey FROM elsewhere LIMIT 5", True, True),
    ("DROP TABLE sparkloom_scoped", True, True),
    ("SELECT lower(n_name) AS low, CAST(n_nationkey AS STRING) AS k, abs(n_regionkey) AS r FROM sparkloom_scoped WHERE n_name LIKE 'A%' AND NOT n_regionkey IS NULL", False, True),
]


def policies(s, d):
    table(s, d, "nation").createOrReplaceTempView("sparkloom_scoped")
    source = refusals(s, [(q, lambda q=q: query_source.query_source(s, q, SCOPE)) for q, _, _ in STATEMENTS])
    safe = refusals(s, [(q, lambda q=q: query_source.safe_select(s, q, SCOPE)) for q, _, _ in STATEMENTS])
    return s.createDataFrame([(q, a, b) for (q, a), (_, b) in zip(source, safe, strict=True)], "statement string, source_refused boolean, safe_refused boolean")


def star(s, d):
    """A lone star becomes the sorted columns; the schema is known without reading a row."""
    table(s, d, "region").select("r_regionkey", "r_name").createOrReplaceTempView("sparkloom_star")
    checked, df = query_source.query_source(s, "SELECT * FROM sparkloom_star WHERE r_regionkey >= 0", {"sparkloom_star": {"*"}})
    return df.select(F.lit(",".join(checked.outputs)).alias("outputs"), F.lit(",".join(t for _, t in df.limit(0).dtypes)).alias("types"), F.concat_ws("|", *df.columns).alias("cells"))


FINGERPRINTED = "SELECT n_nationkey, n_regionkey FROM sparkloom_printed WHERE n_regionkey <= 3"


def fingerprint(s, d):
    table(s, d, "nation").createOrReplaceTempView("sparkloom_printed")
    spaced = FINGERPRINTED.replace(" FROM", "\n  FROM") + " ;"
    checked, df = query_source.query_source(s, spaced, {"sparkloom_printed": {"n_nationkey", "n_regionkey"}})
    return df.agg(F.count("*").alias("n")).select(F.lit(checked.fingerprint()).alias("fingerprint"), F.lit(GEO.fingerprint()).alias("spec_fingerprint"), "n")


FINGERPRINT = f"""SELECT sha256('["1", "spark", "{FINGERPRINTED}"]') AS fingerprint, sha256('{json.dumps(GEO.as_dict(), sort_keys=True, separators=(",", ":"))}') AS spec_fingerprint, count(*) AS n FROM nation WHERE n_regionkey <= 3"""


def allowlist(s, d):
    held = table(s, d, "customer")
    tries = [
        ("columns", lambda: catalog.project(held, "customer", {"customer.c_custkey"})), ("whole table", lambda: catalog.project(held, "customer", {"customer.*"})),
        ("unknown column", lambda: catalog.project(held, "customer", {"customer.zz"})), ("other table", lambda: catalog.project(held, "customer", {"orders.o_orderkey"})),
        ("nested column", lambda: profile.distinct_summary(table(s, d, "embeddings"), ["embedding"])), ("file name", lambda: writers.safe_name("../x")),
    ]
    odd = held.select(F.col("c_custkey").alias("odd`name. of"))
    assert profile.distinct_summary(odd, odd.columns, exact=True).first()["column_name"] == "odd`name. of"
    return refused(s, tries)


SCANS = [
    ("csv_scan_orders", csv_orders, CSV_ORDERS),
    ("csv_scan_wide", csv_wide, "SELECT 1000::BIGINT AS n_columns, count(*) AS n_rows, sum(n_nationkey + 999)::BIGINT AS last_column FROM nation"),
    ("csv_scan_line_breaks", csv_line_breaks, CSV_TEXTS),
    ("csv_folder_scan", csv_folder, "SELECT 'region' AS entity, count(*) AS n_rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier"),
    ("dataset_folder_scan", folder, FOLDER),
    ("row_sample_orders", row_sample, "SELECT o_orderkey, row_number() OVER () - 1 AS place FROM orders LIMIT 100"),
    ("sink_round_trip", sinks, SINKS),
    ("postgres_script", postgres, _postgres_sql()),
    ("bundle_verified", bundle, BUNDLE),
    ("document_loaders", loaders, LOADERS),
    ("type_names", type_names, values("name, logical", TYPE_NAMES)),
    ("profile_cache", cache, "SELECT 2::BIGINT AS keys, 2::BIGINT AS made, count(*) AS n_rows FROM nation"),
    ("jdbc_customers", jdbc, "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2)::DOUBLE AS balance FROM customer WHERE c_acctbal >= 0 GROUP BY 1"),
    ("database_source", database, DATABASE),
    ("catalog_listing", listing, LISTING),
    ("query_policies", policies, values("statement, source_refused, safe_refused", STATEMENTS)),
    ("query_source_star", star, "SELECT 'r_name,r_regionkey' AS outputs, 'string,' || CASE data_type WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END AS types, r_name || '|' || r_regionkey AS cells FROM region, (SELECT data_type FROM information_schema.columns WHERE table_name = 'region' AND column_name = 'r_regionkey')"),
    ("source_fingerprint", fingerprint, FINGERPRINT),
    ("allowlist_checks", allowlist, values("tried, refused", [("columns", False), ("whole table", False), ("unknown column", True), ("other table", True), ("nested column", True), ("file name", True)])),
    ("limit_clamp", lambda s, d: catalog.limited(table(s, d, "lineitem"), 5000).agg(F.count("*").alias("n")), "SELECT least(1000, count(*)) AS n FROM lineitem"),
]
