"""Command line: profile, profile-query, plan, generate, validate, verify, export-postgres.

    python -m sparkloom profile FOLDER -o profile.json
    python -m sparkloom plan profile.json -o spec.yaml --rows 1000 --seed 7
    python -m sparkloom generate spec.yaml -o OUT --format parquet --rules rules.yaml
    python -m sparkloom validate spec.yaml OUT
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from sparkloom.model import Dataset, SpecError


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sparkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def profile(a) -> int:
    from sparkloom.operators import constraints, profile, relationships
    from sparkloom.operators.validate import assert_input_budget, assert_profile_safe
    from sparkloom.sources import readers, writers

    held = readers.dataset_folder(session(), a.folder)
    if not a.no_limits:
        assert_input_budget(session(), a.folder, held)
    typed = {n: profile.typed_frame(df, profile.infer_types(df)) if all(k == "string" for _, k in df.dtypes) else df for n, df in held.items()}
    out = Dataset([profile.profile(df, n, tuple(a.keep)) for n, df in typed.items()], relationships.relationships(typed), constraints.mine(typed))
    # condition values are source values: without labels of their own they stay out
    out.constraints = constraints.anonymise_conditions(out.constraints, {})
    assert_profile_safe(out)
    writers.write_document(a.out, out.as_dict())
    return 0


def profile_query(a) -> int:
    from sparkloom.sources import query_source, writers

    spark = session()
    spark.read.parquet(a.table).createOrReplaceTempView(a.name)
    writers.write_document(a.out, query_source.profile_query(spark, Path(a.sql).read_text(), {a.name: {"*"}}).as_dict())
    return 0


def plan(a) -> int:
    from sparkloom.operators import generate
    from sparkloom.sources import readers, writers

    writers.write_document(a.out, generate.plan(readers.load_profile(a.profile), a.rows, a.seed).as_dict())
    return 0


def generate(a) -> int:
    from sparkloom.operators import generate, rules, validate
    from sparkloom.sources import readers, writers

    spark, spec = session(), readers.load_spec(a.spec)
    validate.assert_spec_safe(spec)
    if not a.no_limits:
        validate.assert_budget(spec)
    made = generate.generate(spark, spec, keep_row=True)
    held = readers.load_rules(a.rules) if a.rules else None
    if held:
        rules.check_contract(held, spec)
        made = {n: df.drop("__broken") for n, df in rules.apply(made, held, spec.seed, spec.mode, spec.invalid_ratio).items()}
    if spec.mode not in ("mixed", "negative"):
        validate.assert_solved_safe(spec, made)
    report = validate.validate(spec, made)
    writers.write_bundle(spark, spec, made, a.out, a.format, held, report)
    print(json.dumps(report))
    return 0 if report["passed"] or spec.mode in ("mixed", "negative") else 1


def check(a) -> int:
    from sparkloom.operators import profile, rules, validate
    from sparkloom.sources import readers

    spark, spec = session(), readers.load_spec(a.spec)
    made = readers.dataset_folder(spark, a.folder)
    made = {n: profile.typed_frame(df, {f.name: f.data_type for f in spec[n].fields}) if all(k == "string" for _, k in df.dtypes) else df for n, df in made.items()}
    report = validate.validate(spec, made)
    if a.rules:
        report["rules"] = rules.report(made, readers.load_rules(a.rules))
        report["passed"] &= report["rules"]["passed"]
    print(json.dumps(report))
    return 0 if report["passed"] else 1


def verify(a) -> int:
    from sparkloom.sources import writers

    bad = writers.verify_bundle(session(), a.folder)
    print(json.dumps({"passed": not bad, "differ": bad}))
    return 1 if bad else 0


def postgres(a) -> int:
    from sparkloom.sources import readers, writers

    spark, spec = session(), readers.load_spec(a.spec)
    writers.postgres_script(spec, readers.dataset_folder(spark, a.folder)).select("value").write.text(a.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="sparkloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(required=True)

    def command(name, run, /, *positional, **options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for x in positional:
            p.add_argument(x)
        for x, kw in options.items():
            p.add_argument(f"--{x}", **kw)
        if name not in ("validate", "verify"):
            p.add_argument("-o", "--out", required=True)

    command("profile", profile, "folder", keep={"nargs": "*", "default": []}, **{"no-limits": {"action": "store_true"}})
    command("profile-query", profile_query, "sql", "table", name={"required": True})
    command("plan", plan, "profile", rows={"type": int}, seed={"type": int, "default": 0})
    command("generate", generate, "spec", rules={}, format={"default": "parquet", "choices": ["csv", "json", "parquet"]}, **{"no-limits": {"action": "store_true"}})
    command("validate", check, "spec", "folder", rules={})
    command("verify", verify, "folder")
    command("export-postgres", postgres, "spec", "folder")
    a = top.parse_args(argv)
    try:
        return a.run(a)
    except (SpecError, ValueError, TypeError) as e:
        print(f"sparkloom: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
