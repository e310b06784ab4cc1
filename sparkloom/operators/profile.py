"""Column profiles.

All measures of all columns of a table come from one aggregation, so a table is
scanned once whatever its width.  Distinct counts are HyperLogLog++ sketches and
percentiles are approximate by default: both merge map-side and stay small at any
size.  ``exact=True`` gives exact ones; it expands rows by the number of columns and
shuffles every distinct value once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import parse, privacy
from sparkloom.model import Entity, Field

MOST_CATEGORIES, MOST_PATTERNS, SAMPLE = 20, 10, 100
#: Percentiles of a numeric profile, and the share of rows on either side that an exact one puts in order.
PERCENTILES, BAND = (0.05, 0.95), 0.0005
#: Fewer values than this are all put in order.
FEW = 100_000
IDENTIFIER_UNIQUE = 0.98


def identifier_name(name: str) -> bool:
    n = privacy.field_name(name)
    return n == "id" or n.endswith("_id")


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def melted(wide: DataFrame, parts: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    """A one-row aggregate as one row for each column: parts[column] = (measure, expression)."""
    rows = F.array(*(F.struct(F.lit(name).alias("column_name"), *(c.alias(m) for m, c in own)) for name, own in parts.items()))
    return wide.select(F.inline(rows))


def numeric_summary(df: DataFrame, columns: list[str], exact: bool = False, fused: bool = False) -> DataFrame:
    """column_name, row_count, non_null, null_ratio, distinct_count, min, max, p05, p95.

    Exact percentiles are those of Spark's ``percentile``, or with ``fused`` those of DuckDB's
    ``quantile_cont``: its interpolation is a fused multiply-add, so the last place may differ.
    """
    if exact:
        return _exact_summary(df, columns, fused)
    measures, parts = [F.count("*").alias("n")], {}
    for i, name in enumerate(columns):
        c = q(name).cast("double")
        measures += [
            F.count(q(name)).alias(f"c{i}"),
            F.approx_count_distinct(q(name)).alias(f"d{i}"),
            F.min(c).alias(f"lo{i}"),
            F.max(c).alias(f"hi{i}"),
            F.percentile_approx(c, [0.05, 0.95], 10_000).alias(f"p{i}"),
        ]
        parts[name] = [
            ("row_count", F.col("n")),
            ("non_null", F.col(f"c{i}")),
            ("null_ratio", null_ratio(F.col(f"c{i}"), F.col("n"))),
            ("distinct_count", F.col(f"d{i}")),
            ("min_value", F.col(f"lo{i}")),
            ("max_value", F.col(f"hi{i}")),
            ("p05", F.col(f"p{i}")[0]),
            ("p95", F.col(f"p{i}")[1]),
        ]
    return melted(df.agg(*measures), parts)


def _exact_summary(df: DataFrame, columns: list[str], fused: bool) -> DataFrame:
    """Values are counted first, map-side too; all measures come from values with their counts.

    A percentile needs an order.  Sketches bracket each one first, so that only the values
    between (BAND of the rows on either side) are put in order, and not a column in one task.
    """
    cells = F.array(*(F.struct(F.lit(n).alias("column_name"), q(n).cast("double").alias("v")) for n in columns))
    counted = df.select(F.inline(cells)).groupBy("column_name", "v").agg(F.count("*").alias("n"))
    plain = counted.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("v").alias("distinct_count"),
        F.min("v").alias("min_value"),
        F.max("v").alias("max_value"),
    )
    cuts = {f"p{i}": p for i, p in enumerate(PERCENTILES)}
    around = [x for p in PERCENTILES for x in (max(0.0, p - BAND), min(1.0, p + BAND))]
    sketched = df.agg(
        *(x.alias(f"{k}{i}") for i, n in enumerate(columns) for k, x in (("a", F.percentile_approx(q(n).cast("double"), around, 10_000)), ("n", F.count(q(n))), ("lo", F.min(q(n).cast("double"))), ("hi", F.max(q(n).cast("double")))))
    )
    brackets = melted(sketched, {n: [(k, F.col(f"{k}{i}")) for k in ("a", "n", "lo", "hi")] for i, n in enumerate(columns)})
    # of few values all are put in order: a bracket must hold the ranks on both sides of a percentile
    end = lambda i, bound: F.when(F.col("n") < FEW, F.col(bound)).otherwise(F.col("a")[i]).alias(bound)
    ends = F.array(*(F.struct(F.lit(c).alias("cut"), F.lit(p).alias("p"), end(2 * i, "lo"), end(2 * i + 1, "hi")) for i, (c, p) in enumerate(cuts.items())))
    ends = brackets.where("n > 0").select("column_name", F.inline(ends))
    held = counted.where("v IS NOT NULL").join(F.broadcast(ends), "column_name")  # a row for each column and percentile
    key = ["column_name", "cut"]
    some = lambda where, measure: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).alias(measure)
    below = held.groupBy(*key).agg(
        some(F.col("v") < F.col("lo"), "below"), some(F.col("v") <= F.col("hi"), "inside"), F.sum("n").alias("total"),
        F.first("p").alias("p"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min("v").alias("least"), F.max("v").alias("most"),
    ).withColumn("place", F.col("p") * (F.col("total") - 1))
    # a sketch may err: where its bracket misses a rank, the whole column is put in order
    holds = (F.col("below") <= F.floor("place")) & (F.col("inside") > F.ceil("place"))
    below = below.select(
        *key, "place", F.when(holds, F.col("below")).otherwise(0).alias("below"), F.when(holds, F.col("lo")).otherwise(F.col("least")).alias("lo"), F.when(holds, F.col("hi")).otherwise(F.col("most")).alias("hi")
    )
    band = held.drop("lo", "hi").join(F.broadcast(below), key).where("v BETWEEN lo AND hi")
    place, reached = F.col("place"), F.col("below") + F.sum("n").over(Window.partitionBy(*key).orderBy("v"))
    found = band.select(*key, "v", "place", reached.alias("reached")).groupBy(*key).agg(
        F.min(F.when(F.col("reached") > F.floor(place), F.col("v"))).alias("a"), F.min(F.when(F.col("reached") > F.ceil(place), F.col("v"))).alias("b"), F.first("place").alias("place")
    )
    a, b, at = F.col("a"), F.col("b"), F.col("place")
    up, down = at - F.floor(at), F.ceil(at) - at
    if fused:
        value = F.when(up == 0, a).otherwise(F.java_method(F.lit("java.lang.Math"), F.lit("fma"), a, down, b * up).cast("double"))
    else:
        value = F.when((a == b) | (up == 0), a).otherwise(down * a + up * b)
    found = found.withColumn("value", value)
    wide = found.groupBy("column_name").agg(*(F.max(F.when(F.col("cut") == c, F.col("value"))).alias(c) for c in cuts))
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column_name"))  # an empty table has its rows too
    out = names.join(plain, "column_name", "left").join(wide, "column_name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("row_count", "non_null", "distinct_count")})
    return out.select(
        "column_name", "row_count", "non_null", null_ratio(F.col("non_null"), F.col("row_count")).alias("null_ratio"), "distinct_count", "min_value", "max_value",
        F.col("p0").alias("p05"), F.col("p1").alias("p95"),
    )


def null_ratio(non_null: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(1 - non_null / total, 6))


def distinct_summary(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """column_name, non_null, distinct_count, unique_ratio; nested columns are refused."""
    for name in columns:
        parse.logical_type(df.schema[name].dataType)
    measures, parts = [], {}
    for i, name in enumerate(columns):
        distinct = F.count_distinct(q(name)) if exact else F.approx_count_distinct(q(name))
        measures += [F.count(q(name)).alias(f"c{i}"), distinct.alias(f"d{i}")]
        ratio = F.when(F.col(f"c{i}") == 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), F.col(f"d{i}") / F.col(f"c{i}")), 6))
        parts[name] = [("non_null", F.col(f"c{i}")), ("distinct_count", F.col(f"d{i}")), ("unique_ratio", ratio)]
    return melted(df.agg(*measures), parts)


def numeric_shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, max_abs_magnitude, has_negative, has_positive: no value is revealed."""
    measures, parts = [], {}
    for i, name in enumerate(columns):
        c = q(name).cast("double")
        measures += [
            F.max(F.when(c != 0, F.floor(F.log10(F.abs(c))))).cast("int").alias(f"m{i}"),
            F.coalesce(F.bool_or(c < 0), F.lit(False)).alias(f"n{i}"),
            F.coalesce(F.bool_or(c > 0), F.lit(False)).alias(f"p{i}"),
        ]
        parts[name] = [("max_abs_magnitude", F.col(f"m{i}")), ("has_negative", F.col(f"n{i}")), ("has_positive", F.col(f"p{i}"))]
    return melted(df.agg(*measures), parts)


def top_values(df: DataFrame, column: str, k: int = MOST_CATEGORIES) -> DataFrame:
    """value, n: the most frequent non-null values, ties by value."""
    c = q(column)
    return df.where(c.isNotNull()).groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def true_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = {n: [("true_ratio", F.col(f"r{i}"))] for i, n in enumerate(columns)}
    return melted(df.agg(*(F.round(F.avg(q(n).cast("int")), 6).alias(f"r{i}") for i, n in enumerate(columns))), parts)


def time_range(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = {n: [("min_time", F.col(f"a{i}")), ("max_time", F.col(f"b{i}"))] for i, n in enumerate(columns)}
    return melted(df.agg(*(x for i, n in enumerate(columns) for x in (F.min(q(n)).alias(f"a{i}"), F.max(q(n)).alias(f"b{i}")))), parts)


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = {n: [("min_length", F.col(f"a{i}")), ("max_length", F.col(f"b{i}"))] for i, n in enumerate(columns)}
    measures = [x for i, n in enumerate(columns) for x in (F.min(F.length(q(n))).cast("bigint").alias(f"a{i}"), F.max(F.length(q(n))).cast("bigint").alias(f"b{i}"))]
    return melted(df.agg(*measures), parts)


def pattern_histogram(df: DataFrame, column: str, semantic_type: str | None = None, k: int = MOST_PATTERNS) -> DataFrame:
    """pattern, n: masked patterns of a column's values."""
    c = parse.cell(q(column))
    return (
        df.where(c.isNotNull())
        .groupBy(privacy.mask_pattern(c, semantic_type).alias("pattern"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "pattern")
        .limit(k)
    )


def value_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and how many values look like secrets, emails, ssns and phones."""
    kinds = ("secret", "email", "ssn", "phone")
    typed = df.select(*(privacy.value_type(q(n)).alias(f"t{i}") for i, n in enumerate(columns)))
    wide = typed.agg(*(F.count_if(F.col(f"t{i}") == k).alias(f"{k}{i}") for i in range(len(columns)) for k in kinds))
    return melted(wide, {n: [(k, F.col(f"{k}{i}")) for k in kinds] for i, n in enumerate(columns)})


def parse_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and whether every non-blank cell reads as each type."""
    measures, parts = [], {}
    for i, name in enumerate(columns):
        text = parse.cell(q(name))
        measures.append(F.count(text).alias(f"n{i}"))
        measures += [F.coalesce(F.bool_and(F.when(text.isNotNull(), p(q(name)).isNotNull())), F.lit(False)).alias(f"{k}{i}") for k, p in parse.PARSERS.items()]
        parts[name] = [("non_blank", F.col(f"n{i}")), *((k, F.col(f"{k}{i}")) for k in parse.PARSERS)]
    return melted(df.agg(*measures), parts)


def infer_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Logical type of each text column: the first that all its cells read as."""
    columns = columns or df.columns
    return {
        r["column_name"]: next((k for k in parse.PRIORITY if r["non_blank"] and r[k]), "string") for r in parse_flags(df, columns).collect()
    }


def typed_frame(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*(parse.typed(q(n), types[n]).alias(n) for n in df.columns))


def profile(df: DataFrame, name: str, keep_values: tuple[str, ...] = (), exact: bool = False) -> Entity:
    """Safe profile of a table of scalar columns.

    Text of sensitive columns is never returned: they get the MOST_PATTERNS most frequent
    masked patterns, and numbers of sensitive columns only a shape.  Categories come back
    under rank labels, unless their column is in ``keep_values`` and its values pass the
    checks.  Two jobs in all: one aggregation of every column, one count of the values of
    all category columns and the patterns of all sensitive ones; two more for exact
    distinct counts and percentiles.
    """
    types = {c: parse.logical_type(df.schema[c].dataType) for c in df.columns}
    measures, ordered = [F.count("*").alias("n")], []
    for i, c in enumerate(df.columns):
        x, kind = q(c), types[c]
        measures.append(F.count(x).alias(f"c{i}"))
        ordered.append((F.count_distinct(x) if exact else F.approx_count_distinct(x)).alias(f"d{i}"))
        if kind in ("integer", "float"):
            d = x.cast("double")
            measures += [
                F.min(d).alias(f"lo{i}"),
                F.max(d).alias(f"hi{i}"),
                F.max(F.when(d != 0, F.floor(F.log10(F.abs(d))))).cast("int").alias(f"m{i}"),
                F.coalesce(F.bool_or(d < 0), F.lit(False)).alias(f"neg{i}"),
                F.coalesce(F.bool_or(d > 0), F.lit(False)).alias(f"pos{i}"),
            ]
            if not exact:
                ordered.append(F.percentile_approx(d, list(PERCENTILES), 10_000).alias(f"p{i}"))
        elif kind == "boolean":
            measures.append(F.avg(x.cast("int")).alias(f"t{i}"))
        elif kind in ("date", "datetime"):
            measures += [F.min(x).cast("string").alias(f"lo{i}"), F.max(x).cast("string").alias(f"hi{i}")]
        else:
            v = privacy.value_type(x)
            measures += [F.min(F.length(x)).alias(f"lo{i}"), F.max(F.length(x)).alias(f"hi{i}")]
            measures += [F.count_if(v == k).alias(f"{k}{i}") for k in ("secret", "email", "ssn", "phone")]
    got = df.agg(*measures, *(() if exact else ordered)).first().asDict()
    if exact:
        # exact distinct counts multiply rows by columns: nothing else is measured there
        got |= df.agg(*ordered).first().asDict()
        numbers = {c: i for i, c in enumerate(df.columns) if types[c] in ("integer", "float")}
        got |= {f"p{numbers[r['column_name']]}": (r["p05"], r["p95"]) for r in _exact_summary(df, list(numbers), True).collect()} if numbers else {}
    total, fields, category, masked = got["n"], [], [], []
    for i, c in enumerate(df.columns):
        held, distinct, kind = got[f"c{i}"], got[f"d{i}"], types[c]
        semantic = None
        if kind == "string":
            counts = {k: got[f"{k}{i}"] for k in ("secret", "email", "ssn", "phone")}
            semantic = "secret" if counts["secret"] else max(counts, key=counts.get) if any(counts.values()) else None
        f = Field(
            c, kind, held < total, round(1 - held / total, 6) if total else 0.0, round(min(1.0, distinct / held), 6) if held else 0.0,
            privacy.sensitive_field(c, semantic), semantic, identifier_name(c),
        )
        if f.is_identifier:
            f.distribution = {"kind": "synthetic_identifier", "prefix": name}
        elif kind in ("integer", "float") and held:
            if f.sensitive:
                f.distribution = {"kind": "numeric_shape", "max_abs_magnitude": got[f"m{i}"], "has_negative": got[f"neg{i}"], "has_positive": got[f"pos{i}"]}
            else:
                cut = (lambda v: round(v)) if kind == "integer" else float
                lo, hi, (p05, p95) = got[f"lo{i}"], got[f"hi{i}"], got[f"p{i}"]
                f.distribution = {"kind": "numeric", "min": cut(lo), "max": cut(hi), "p05": cut(p05), "p95": cut(p95)}
        elif kind == "boolean" and held:
            f.distribution = {"kind": "boolean", "true_ratio": round(got[f"t{i}"], 6)}
        elif kind in ("date", "datetime") and held:
            f.distribution = {"kind": f"{kind}_range" if kind == "date" else "datetime_range", "min": got[f"lo{i}"], "max": got[f"hi{i}"]}
        elif kind == "string" and held:
            if f.sensitive:
                masked.append(f)
                f.distribution = {"kind": "masked_patterns", "patterns": []}
            elif distinct <= MOST_CATEGORIES:
                category.append(c)
            if f.distribution is None:
                f.distribution = {"kind": "string_pattern", "min_length": got[f"lo{i}"], "max_length": got[f"hi{i}"]}
        fields.append(f)
    if category or masked:
        by = _value_counts(df, category, masked)
        for f in masked:
            f.distribution["patterns"] = [{"pattern": v, "count": n} for n, v in sorted(by.get(f.name, []), key=lambda x: (-x[0], x[1]))[:MOST_PATTERNS]]
        for f in fields:
            own = sorted(by.get(f.name, []), key=lambda x: (-x[0], x[1]))
            if f.name not in category or not 0 < len(own) <= MOST_CATEGORIES:
                continue
            if f.name in keep_values:
                check_local_categories(df.sparkSession, [v for _, v in own], f.name, f.semantic_type, f.sensitive)
                f.distribution = {"kind": "categorical", "values": [{"value": v, "weight": n} for n, v in own]}
            else:
                f.distribution = {"kind": "categorical", "values": privacy.rank_labels([n for n, _ in own], [v for _, v in own])}
    keys = [f.name for f in fields if f.is_identifier and f.unique_ratio >= IDENTIFIER_UNIQUE and not f.nullable]
    return Entity(name, total, fields, None, keys)


def _value_counts(df: DataFrame, category: list[str], masked: list[Field]) -> dict[str, list[tuple[int, str]]]:
    """(count, value) of category columns and (count, masked pattern) of sensitive ones, in one scan; the most frequent of each."""
    cells = [F.struct(F.lit(c).alias("c"), q(c).cast("string").alias("v")) for c in category]
    for f in masked:
        text = parse.cell(q(f.name))
        kind = privacy.value_type(text)
        pattern = F.when(kind.isNotNull(), F.lower(kind)).otherwise(privacy.mask_pattern(text, f.semantic_type))
        cells.append(F.struct(F.lit(f.name).alias("c"), F.when(text.isNotNull(), pattern).alias("v")))
    counted = df.select(F.inline(F.array(*cells))).where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))
    out: dict[str, list[tuple[int, str]]] = {}
    for r in counted.withColumn("rank", rank).where(F.col("rank") <= MOST_CATEGORIES + 1).collect():
        out.setdefault(r["c"], []).append((r["n"], r["v"]))
    return out


def check_local_categories(spark, values: list, name: str, semantic_type: str | None = None, sensitive: bool = False) -> list:
    """The policy of privacy.check_local_categories, with its values held against the content detectors too."""
    privacy.check_local_categories(values, name, semantic_type, sensitive)
    kinds = spark.createDataFrame([(str(v),) for v in values], "v string").select(privacy.value_type(F.col("v")).alias("k")).where("k IS NOT NULL")
    if not kinds.isEmpty():
        raise ValueError(f"{name}: values hold personal data or secrets")
    return values


def semantic_types(df: DataFrame, columns: list[str], order: Column, sample: int = SAMPLE, share: float = 0.8) -> dict[str, str | None]:
    """Semantic type of text columns: by name, or by what the first values (by order) look like.

    A secret anywhere in the sample decides; else the kind that ``share`` of the sample has.
    The sample is taken with a bounded aggregate, not with a sort of the table.
    """
    out: dict[str, str | None] = {}
    names = {"email": "email", "phone": "phone", "ssn": "ssn"}
    for c in columns:
        text = parse.cell(q(c))
        first = df.where(text.isNotNull()).select(order.alias("o"), text.alias("v")).orderBy("o").limit(sample)
        kinds = [r["kind"] for r in first.select(privacy.value_type(F.col("v")).alias("kind")).collect()]
        by_name = next((k for part, k in names.items() if part in privacy.field_name(c)), None)
        if "secret" in kinds:
            out[c] = "secret"
        elif by_name:
            out[c] = by_name
        else:
            out[c] = next((k for k in ("email", "ssn", "phone") if kinds and kinds.count(k) >= share * len(kinds)), None)
    return out
