"""Canonical records and their first-normal-form shape.

Everything is a projection over typed structs: the schema decides the columns, rows are
never collected. Arrays take indexed columns up to a width that is measured once or given;
the long form needs no width and is the one to use when arrays are unbounded.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUTO_FLATTEN = "auto_flatten_1nf"
SCHEMA_VERSION = "1.0"


def canonical(df: DataFrame, processing_id: Column, data: Column, timestamp: Column, confidence: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Records as (processing_id, extraction_data, timestamp, schema_version, confidence_scores, source_metadata)."""
    return df.select(
        processing_id.cast("string").alias("processing_id"),
        data.alias("extraction_data"),
        timestamp.cast("timestamp_ntz").alias("timestamp"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        (F.lit(None) if confidence is None else confidence).cast("map<string,double>").alias("confidence_scores"),
        (F.lit(None) if metadata is None else metadata).cast("map<string,string>").alias("source_metadata"),
    )


def canonical_text(*parts: Column) -> Column:
    """One string for a row: parts in order, null as an empty mark, with a separator that marks lengths."""
    shown = [F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]
    return F.concat_ws("\x1f", *shown)


def integrity_hash(*parts: Column) -> Column:
    """SHA-256 of the canonical text: JVM-side, and the same in any SQL engine."""
    return F.sha2(canonical_text(*parts), 256)


def compat_hash(records: DataFrame, name: str = "integrity_hash") -> DataFrame:
    """SHA-256 of key-sorted JSON as Python's json module writes it, for exchange with Python systems.

    Needs byte parity with ``json.dumps``, which no built-in has: Arrow batches, never row by row.
    """
    @F.pandas_udf("string")
    def digest(rows: pd.DataFrame) -> pd.Series:
        import hashlib

        def one(r) -> str:
            body = {
                "processing_id": r.processing_id, "extraction_data": json.loads(r.extraction_data), "timestamp": r.timestamp,
                "schema_version": r.schema_version, "confidence_scores": json.loads(r.confidence_scores) if r.confidence_scores else None,
            }
            return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()

        return pd.Series([one(r) for r in rows.itertuples()])

    row = F.struct(
        "processing_id",
        F.to_json("extraction_data", {"ignoreNullFields": "false"}).alias("extraction_data"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "schema_version",
        F.to_json("confidence_scores").alias("confidence_scores"),
    )
    return records.withColumn(name, digest(row))


def integrity_valid(processing_id: Column, data: Column, stored: Column, actual: Column) -> Column:
    """Id and data are there, and the stored hash, if any, is the actual one."""
    return F.coalesce(processing_id != "", F.lit(False)) & data.isNotNull() & (stored.isNull() | (stored == actual))


def modifications(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the parts that differ between two versions of a record."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in pairs.items()]))


def audit(records: DataFrame, valid: Column, as_of: Column) -> DataFrame:
    """Records with the struct that goes to auditors."""
    return records.withColumn(
        "audit_metadata",
        F.struct(
            as_of.alias("exported_at"),
            F.lit(f"canonical-v{SCHEMA_VERSION}").alias("format_version"),
            valid.alias("integrity_validated"),
            F.lit(len(records.schema["extraction_data"].dataType.fields)).alias("field_count"),
            F.col("confidence_scores").isNotNull().alias("has_confidence_scores"),
            F.col("source_metadata").isNotNull().alias("has_source_metadata"),
        ),
    )


def _leaves(kind: T.DataType, at: Column, name: str, sep: str) -> list[tuple[str, Column]]:
    """Columns of a struct's fields, structs within structs taken apart, lists left as they are."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(f.dataType, at[f.name], f"{name}{sep}{f.name}" if name else f.name, sep)]
    return [(name, at)]


def widths(df: DataFrame, column: str) -> dict[str, int]:
    """The longest array of each top-level array field: one aggregate row."""
    fields = [f.name for f in df.schema[column].dataType.fields if isinstance(f.dataType, T.ArrayType)]
    if not fields:
        return {}
    row = df.agg(*[F.coalesce(F.max(F.size(F.col(column)[n])), F.lit(0)).alias(n) for n in fields]).first()
    return {n: max(0, row[n]) for n in fields}


def flatten(df: DataFrame, column: str, sep: str = "_", preserve_arrays: bool = False, width: dict[str, int] | None = None, max_depth: int | None = None) -> dict[str, Column]:
    """The flat columns of a struct column, by name; of colliding names the last one's value stays.

    Top-level lists get indexed columns; lists further down stay lists.
    """
    out: dict[str, Column] = {}
    width = widths(df, column) if width is None and not preserve_arrays else width or {}
    for f in df.schema[column].dataType.fields:
        at = F.col(column)[f.name]
        if isinstance(f.dataType, T.StructType):
            inner = _leaves(f.dataType, at, f.name, sep) if max_depth is None else [(f"{f.name}{sep}{g.name}", at[g.name]) for g in f.dataType.fields]
            out |= dict(inner)
        elif isinstance(f.dataType, T.ArrayType) and not preserve_arrays:
            for k in range(width.get(f.name, 0)):
                item, name = F.get(at, F.lit(k)), f"{f.name}{sep}{k}"
                if isinstance(f.dataType.elementType, T.StructType) and max_depth is None:
                    out |= dict(_leaves(f.dataType.elementType, item, name, sep))
                else:
                    out[name] = item
        else:
            out[f.name] = at
    return out


def _item_rows(name: str, item: T.DataType, sep: str) -> Callable[[Column, Column], Column]:
    """The (key, value) structs of one array item."""

    def rows(x: Column, i: Column) -> Column:
        prefix = F.concat(F.lit(f"{name}{sep}"), i.cast("string"))
        if isinstance(item, T.StructType):
            return F.array(*[F.struct(F.concat(prefix, F.lit(f"{sep}{n}")).alias("key"), c.cast("string").alias("value")) for n, c in _leaves(item, x, "", sep)])
        return F.array(F.struct(prefix.alias("key"), x.cast("string").alias("value")))

    return rows


def flatten_long(df: DataFrame, column: str, keep: list[str], sep: str = "_") -> DataFrame:
    """(keep..., key, value): the flat fields as rows, values as strings; needs no array width."""
    scalars, parts = [], []
    for f in df.schema[column].dataType.fields:
        at = F.col(column)[f.name]
        if isinstance(f.dataType, T.ArrayType):
            rows = _item_rows(f.name, f.dataType.elementType, sep)
            parts.append(F.coalesce(F.flatten(F.transform(at, rows)), F.array().cast("array<struct<key:string,value:string>>")))
        else:
            scalars += [F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in _leaves(f.dataType, at, f.name, sep)]
    every = F.concat(F.array(*scalars), *parts) if scalars else F.concat(*parts)
    return df.select(*keep, F.explode(every).alias("_e")).select(*keep, "_e.key", "_e.value")


@dataclass
class Rule:
    """A transformation rule: normalize, aggregate, filter, rename or custom."""

    rule_id: str
    rule_type: str
    description: str = ""
    version: str = "1.0"
    parameters: dict = field(default_factory=dict)


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def apply_rule(df: DataFrame, rule: Rule, key: list[str] = ()) -> DataFrame:
    """A rule over flat columns; ``key`` columns stay as they are. An unknown type changes nothing."""
    p, names = rule.parameters, [c for c in df.columns if c not in key]
    if rule.rule_type == "normalize" and p.get("lowercase"):
        strings = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
        return df.withColumns({c: F.lower(F.col(c)) for c in strings}) if strings else df
    if rule.rule_type == "aggregate" and p.get("sum_fields"):
        total = F.lit(0.0)
        for c in p["sum_fields"]:
            if c in names and isinstance(df.schema[c].dataType, NUMERIC):
                total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return df.withColumn("_aggregated_sum", total)
    if rule.rule_type == "filter" and p.get("keep_fields"):
        return df.select(*key, *[c for c in names if c in set(p["keep_fields"])])
    if rule.rule_type == "rename" and p.get("field_mapping"):
        made: dict[str, Column] = {}
        for c in names:
            made[p["field_mapping"].get(c, c)] = F.col(c)
        return df.select(*key, *[v.alias(k) for k, v in made.items()])
    if rule.rule_type == "custom" and p.get("transform_fn"):
        fn: Callable[[DataFrame], DataFrame] = p["transform_fn"]
        return df.transform(fn)
    return df


class Rules:
    """Registered rules. Unknown ids in a configuration are passed over; asked for directly, they raise."""

    def __init__(self) -> None:
        self.known: dict[str, Rule] = {}

    def register(self, rule: Rule) -> None:
        self.known[rule.rule_id] = rule

    def available(self) -> list[str]:
        return list(self.known)

    def apply(self, df: DataFrame, rule_id: str, key: list[str] = ()) -> DataFrame:
        if rule_id not in self.known:
            raise ValueError(f"unknown rule: {rule_id}")
        return apply_rule(df, self.known[rule_id], key)


def shaped(records: DataFrame, rules: Rules | None = None, config: list[str] = (), as_of: Column | None = None, **how) -> DataFrame:
    """Canonical records as flat columns: flatten, then the configured rules in order.

    Adds ``_shaped_id``, ``_transformations`` (what was applied) and ``_1nf_compliant``
    (no list is left).
    """
    flat = flatten(records, "extraction_data", **how)
    key = ["processing_id"]
    df = records.select("processing_id", *[c.alias(n) for n, c in flat.items()])
    applied = [AUTO_FLATTEN]
    for rule_id in config:
        if rules is not None and rule_id in rules.known:
            df = rules.apply(df, rule_id, key)
            applied.append(rule_id)
    compliant = F.lit(True)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            compliant = compliant & (F.coalesce(F.size(f.name), F.lit(0)) == 0)
    return df.withColumns(
        {
            "_shaped_id": F.concat("processing_id", F.lit("_shaped")),
            "_transformations": F.array(*[F.lit(x) for x in applied]),
            "_1nf_compliant": compliant,
        }
    )


def transformation_lineage(df: DataFrame, rules: Rules) -> DataFrame:
    """One row for each applied rule of each shaped record."""
    kinds = F.create_map(*[x for r in rules.known.values() for x in (F.lit(r.rule_id), F.lit(r.rule_type))]) if rules.known else F.create_map(F.lit(""), F.lit(""))
    return df.select("processing_id", "_shaped_id", "_1nf_compliant", F.posexplode("_transformations").alias("step", "rule_id")).withColumn(
        "rule_type", F.coalesce(F.try_element_at(kinds, "rule_id"), F.lit("normalize"))
    )


# First normal form over variants, for records without a schema.


def type_family(v: Column) -> Column:
    """Family of a variant's type: object, array, string, bool, int, float or null."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), "null")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "bool")
        .when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float")
        .otherwise("other")
    )


def fields_view(df: DataFrame, variant: str, keep: list[str]) -> DataFrame:
    """(keep..., pos, path, tag, str_val, num_val): top-level fields of variant objects as rows."""
    df.createOrReplaceTempView("_fields_source")
    names = ", ".join(f"s.`{k}`" for k in keep)
    rows = df.sparkSession.sql(f"SELECT {names}, e.pos, e.key AS path, e.value AS v FROM _fields_source s, LATERAL variant_explode(s.`{variant}`) e")
    v = F.col("v")
    return rows.select(
        *keep, "pos", "path", type_family(v).alias("tag"),
        F.try_variant_get(v, "$", "string").alias("str_val"), F.try_variant_get(v, "$", "double").alias("num_val"), v.alias("value"),
    )


def atomic_records(fields: DataFrame, key: list[str]) -> DataFrame:
    """Are all values of a record atomic? Empty lists and objects are."""
    nested = F.col("tag").isin("array", "object") & ~F.coalesce(F.col("str_val").isin("[]", "{}"), F.lit(False))
    return fields.groupBy(*key).agg((~F.bool_or(nested)).alias("atomic"))


def duplicate_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """Records that occur twice or more, with their count."""
    return df.groupBy(*columns).agg(F.count("*").alias("n_records")).where("n_records > 1")


def type_consistency(fields: DataFrame) -> DataFrame:
    """Number of type families of each field, nulls aside; more than one is inconsistent."""
    return (
        fields.where("tag <> 'null'").groupBy("path").agg(F.count_distinct("tag").alias("n_types")).withColumn("consistent", F.col("n_types") <= 1)
    )


def numbered_duplicates(df: DataFrame, key: list[str], value: str, order: list[str], least: int = 5) -> DataFrame:
    """Rows of string values that stood earlier in the same record (values longer than ``least``)."""
    w = Window.partitionBy(*key, value).orderBy(*order)
    return df.where(F.char_length(value) > least).withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")
