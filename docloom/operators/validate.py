"""Validation of extracted records: issues as rows, scores as aggregates.

Records come as fields (a row for each record and top-level field); expected schemas and
rules are small tables that are joined to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.contains import contains_join

#: Rules that are broadcast.
BROADCAST_RULES = 10_000
SEVERITIES = ["critical", "error", "warning", "info"]
ISSUE = ["issue_type", "severity", "field_path", "message"]
#: Weights of severities in the schema score (fixed values).
WEIGHTS = {"critical": 1.0, "error": 0.8, "warning": 0.4, "info": 0.1}
#: Expected type -> accepted families; a bool is an int and a number, an int is no float (fixed values).
ACCEPTED = {
    "string": ["string"],
    "int": ["int", "bool"],
    "integer": ["int", "bool"],
    "float": ["float"],
    "number": ["int", "float", "bool"],
    "bool": ["bool"],
    "boolean": ["bool"],
    "array": ["array"],
    "object": ["object"],
}
#: Patterns on trimmed, lower-cased values (fixed values).
PLACEHOLDERS = [r"^(xxx+|aaa+|bbb+|ccc+)$", r"^(test|sample|placeholder|dummy)$", r"^n/?a$", r"^(tbd|tba)$"]
ERROR_TEXTS = [r"error|failed|exception|null|undefined", r"could\s+not\s+extract", r"unable\s+to\s+process"]
DATE_PREFIX = r"^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{2}/\d{2}/\d{2})"
#: Document rules (fixed values): type, field part, least length, pattern, least and greatest value.
DOCUMENT_RULES = [
    ("invoice", "total", None, None, 0.0, 1000000.0),
    ("invoice", "invoice_number", 3, r"^[A-Z0-9-]+$", None, None),
    ("invoice", "date", None, r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}", None, None),
    ("receipt", "total", None, None, 0.0, 10000.0),
    ("receipt", "store", 2, None, None, None),
    ("contract", "amount", None, None, 0.0, None),
    ("contract", "party", 5, None, None, None),
]


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_placeholder(c: Column) -> Column:
    return F.lower(stripped(c)).rlike("|".join(PLACEHOLDERS))


def is_error_text(c: Column) -> Column:
    return F.lower(c).rlike("|".join(ERROR_TEXTS))


def is_date_like(c: Column) -> Column:
    return stripped(c).rlike(DATE_PREFIX)


def accepts(expected: Column, tag: Column) -> Column:
    """Is a value of this family of the expected type? Unknown types accept all."""
    known = F.create_map(*[x for k, v in ACCEPTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(known, F.lower(expected)), tag), F.lit(True))


def issues(df: DataFrame, key: list[str], kind: str, severity: Column | str, message: Column | str, path: str = "path") -> DataFrame:
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(*key, F.lit(kind).alias("issue_type"), c(severity).alias("severity"), F.col(path).alias("field_path"), c(message).alias("message"))


def missing_required(records: DataFrame, fields: DataFrame, required: DataFrame, key: list[str]) -> DataFrame:
    """Required fields that a record lacks. ``required`` is (field); the schema side is small and joined by name."""
    asked = required.select(F.col("field").alias("path")).distinct()
    names = fields.select(*key, "path").join(asked, "path", "left_semi").groupBy(*key).agg(F.collect_set("path").alias("_have"))
    # One row, so this is no cross join.
    wanted = F.broadcast(required.agg(F.collect_set("field").alias("_want")))
    met = records.select(*key).join(names, key, "left").join(wanted, F.lit(True))
    lacking = met.select(*key, F.explode(F.array_except("_want", F.coalesce("_have", F.array().cast("array<string>")))).alias("field"))
    return issues(lacking, key, "required_fields", "error", F.format_string("Required field '%s' is missing", "field"), "field")


def type_issues(fields: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Fields whose type isn't the expected one. ``expected`` is (path, type)."""
    met = fields.join(expected, "path").where(~accepts(F.col("type"), F.col("tag")))
    return issues(met, key, "type_validation", "error", F.format_string("Type mismatch: expected %s, got %s", "type", "tag"))


def empty_checks() -> list[Column]:
    found = (
        F.when(F.col("tag") == "null", said("data_quality", "warning", F.lit("Field contains null value")))
        .when((F.col("tag") == "string") & (stripped(F.col("str_val")) == ""), said("data_quality", "warning", F.lit("Field contains empty string")))
        .when((F.col("tag") == "array") & (F.col("str_val") == "[]"), said("data_quality", "info", F.lit("Field contains empty array")))
    )
    return [found]


def format_checks() -> list[Column]:
    odd = (F.col("tag") == "string") & F.lower("path").contains("date") & ~is_date_like(F.col("str_val"))
    return [F.when(odd, said("format_validation", "warning", F.format_string("Inconsistent date format: '%s'", "str_val")))]


def suspicious_checks() -> list[Column]:
    text, value = F.col("tag") == "string", F.col("str_val")
    return [
        F.when(text & is_placeholder(value), said("data_quality", "warning", F.format_string("Suspicious placeholder value: '%s'", value))),
        F.when(text & is_error_text(value), said("data_quality", "error", F.format_string("Possible extraction error in value: '%s...'", F.substring(value, 1, 50)))),
    ]


def said(kind: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("t"), F.lit(severity).alias("s"), message.alias("m"))


def field_issues(fields: DataFrame, key: list[str], checks: list[tuple[int, Column]]) -> DataFrame:
    """Issues that a field shows by itself, all in one pass; ``ord`` is the number given with a check."""
    found = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("o"), c.alias("i"))) for n, c in checks]))
    rows = fields.select(*key, "path", F.explode(found).alias("_i"))
    return rows.select(
        *key, F.col("_i.i.t").alias("issue_type"), F.col("_i.i.s").alias("severity"), F.col("path").alias("field_path"), F.col("_i.i.m").alias("message"), F.col("_i.o").alias("ord")
    )


def duplicate_issues(fields: DataFrame, key: list[str]) -> DataFrame:
    """Strings of more than 5 characters that an earlier field of the record has."""
    w = Window.partitionBy(*key, "str_val").orderBy("pos")
    rows = fields.where((F.col("tag") == "string") & (F.char_length("str_val") > 5)).withColumn("_n", F.row_number().over(w)).where("_n > 1")
    return issues(rows, key, "data_quality", "warning", F.format_string("Duplicate value found: '%s'", "str_val"))


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DOCUMENT_RULES, "document_type string, part string, min_length int, pattern string, min_value double, max_value double"
    )


def rule_issues(fields: DataFrame, rules: DataFrame, document_type: str, key: list[str]) -> DataFrame:
    """Document rules: a rule holds for every field whose lower-cased name contains its part.

    No key joins a part to the names that contain it. Rules are broadcast; where there are more
    than BROADCAST_RULES the distinct names of fields find theirs by an index of q-grams.
    """
    own, holds = rules.where(F.col("document_type") == document_type.lower()), F.lower("path").contains(F.col("part"))
    if own.count() <= BROADCAST_RULES:
        met = fields.join(F.broadcast(own), holds)
    else:
        names = fields.select("path", F.lower("path").alias("_name")).distinct()
        met = fields.join(contains_join(names, own, "_name", "part").drop("_name").join(own, "part"), "path")
    text, number = F.col("tag") == "string", F.col("tag").isin("int", "float", "bool")
    prefix = F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")"))
    length = F.char_length("str_val")
    broken = F.array_compact(
        F.array(
            F.when(text & (length < F.col("min_length")), F.struct(F.lit("business_rules").alias("t"), F.lit("warning").alias("s"), F.format_string("Field too short: %d chars, minimum %d", length, "min_length").alias("m"))),
            F.when(text & ~F.rlike("str_val", prefix), F.struct(F.lit("format_validation").alias("t"), F.lit("error").alias("s"), F.lit("Field does not match expected pattern").alias("m"))),
            F.when(number & (F.col("num_val") < F.col("min_value")), F.struct(F.lit("business_rules").alias("t"), F.lit("error").alias("s"), F.lit("Value below minimum").alias("m"))),
            F.when(number & (F.col("num_val") > F.col("max_value")), F.struct(F.lit("business_rules").alias("t"), F.lit("error").alias("s"), F.lit("Value above maximum").alias("m"))),
        )
    )
    rows = met.select(*key, "path", F.explode(broken).alias("_i"))
    return rows.select(*key, F.col("_i.t").alias("issue_type"), F.col("_i.s").alias("severity"), F.col("path").alias("field_path"), F.col("_i.m").alias("message"))


def array_item_issues(df: DataFrame, key: list[str], path: str, tags: Column, expected: str) -> DataFrame:
    """Items of an array (given as an array of type families) whose type isn't the expected one."""
    rows = df.select(*key, F.posexplode(tags).alias("_i", "tag")).where(~accepts(F.lit(expected), F.col("tag")))
    rows = rows.withColumn("path", F.format_string(f"{path}[%d]", "_i"))
    return issues(rows, key, "type_validation", "error", F.format_string(f"Type mismatch: expected {expected}, got %s", "tag"))


def quality_issues(fields: DataFrame, key: list[str], rules: DataFrame | None = None, document_type: str | None = None, validators: list[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """All data-quality issues: empty values, consistency, suspicious text, then document rules and own validators.

    A validator maps fields to issues (key and ISSUE columns).
    """
    kinds = ((0, empty_checks()), (2, format_checks()), (3, suspicious_checks()))
    out = field_issues(fields, key, [(n, c) for n, checks in kinds for c in checks])
    others = [(1, duplicate_issues(fields, key))]
    if rules is not None and document_type:
        others.append((4, rule_issues(fields, rules, document_type, key)))
    others += [(5 + n, v(fields).select(*key, *ISSUE)) for n, v in enumerate(validators)]
    for n, p in others:
        out = out.unionByName(p.withColumn("ord", F.lit(n)))
    return out


def severity_counts(found: DataFrame, key: list[str]) -> DataFrame:
    """Issues of each severity, zero where there are none."""
    return found.groupBy(*key).agg(*[F.sum((F.col("severity") == s).cast("long")).alias(f"n_{s}") for s in SEVERITIES])


def scores(records: DataFrame, fields: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_fields, n_issues, compliance, completeness, type_accuracy, overall, is_valid) of every record."""
    filled = (F.col("tag") != "null") & ~((F.col("tag") == "string") & (stripped(F.col("str_val")) == ""))
    per = fields.groupBy(*key).agg(F.count("*").alias("n_fields"), F.sum(filled.cast("long")).alias("n_filled"))
    weight = F.lit(0.0)
    for s, w in WEIGHTS.items():
        weight = F.when(F.col("severity") == s, F.lit(w)).otherwise(weight)
    structural = F.col("issue_type").isin("schema_conformance", "required_fields", "type_validation")
    blank = F.lower("message").rlike("empty|null")
    bad = found.groupBy(*key).agg(
        F.count("*").alias("n_issues"),
        F.sum(F.when(structural, weight).otherwise(0.0)).alias("w"),
        F.sum(blank.cast("long")).alias("n_blank"),
        F.sum((F.col("issue_type") == "type_validation").cast("long")).alias("n_type"),
        F.sum(F.col("severity").isin("critical", "error").cast("long")).alias("n_bad"),
    )
    df = records.select(*key).join(per, key, "left").join(bad, key, "left").na.fill(0)
    n = F.col("n_fields")
    df = df.withColumns(
        {
            "compliance": F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("w") / n)),
            "completeness": F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("n_filled") / n - 0.1 * F.col("n_blank"))),
            "type_accuracy": F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("n_type") / n)),
        }
    )
    df = df.withColumn("overall", 0.4 * F.col("compliance") + 0.3 * F.col("completeness") + 0.3 * F.col("type_accuracy"))
    return df.select(*key, "n_fields", "n_issues", "compliance", "completeness", "type_accuracy", "overall", ((F.col("n_bad") == 0) & (F.col("overall") >= 0.7)).alias("is_valid"))
