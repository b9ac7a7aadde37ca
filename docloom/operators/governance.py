"""Governance rules over canonical and shaped records: a row for each record and rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ["canonical_integrity", "transformation_approval", "data_distortion", "compliance", "schema_conformance"]
SEVERITIES = ["critical", "error", "warning", "info"]
#: Rule types that need no approval (fixed values).
APPROVED = ["normalize", "filter", "rename", "aggregate"]


@dataclass
class Rule:
    """A predicate over a record's columns. A null verdict is a failure."""

    rule_id: str
    category: str
    severity: str
    predicate: Column
    recommendation: str = ""
    enabled: bool = True


def canonical_rules(as_of: Column) -> list[Rule]:
    """Rules over (processing_id, extraction_data, timestamp, schema_version, integrity_hash)."""
    return [
        Rule("canonical_001", "canonical_integrity", "critical", F.col("extraction_data").isNotNull(), "Preserve the extraction data"),
        Rule("canonical_002", "canonical_integrity", "error", F.coalesce(F.col("integrity_hash") != "", F.lit(False)), "Store an integrity hash"),
        Rule("canonical_003", "canonical_integrity", "warning", F.col("timestamp") <= as_of, "Correct the timestamp"),
        Rule("compliance_001", "compliance", "error", F.coalesce((F.col("processing_id") != "") & F.col("timestamp").isNotNull() & (F.col("schema_version") != ""), F.lit(False)), "Fill the required metadata"),
        Rule("compliance_002", "compliance", "error", F.lit(True)),
    ]


def shaped_rules(approved: list[str] = APPROVED) -> list[Rule]:
    """Rules over (processing_id, canonical_id, timestamp, rule_types, n_fields, is_1nf, atomic)
    joined to (canonical_processing_id, canonical_fields), null where there is no canonical record."""
    allowed = F.forall("rule_types", lambda t: t.isin(*approved))
    return [
        Rule("transform_001", "transformation_approval", "error", allowed, "Have the rule types approved"),
        Rule("transform_002", "transformation_approval", "critical", F.col("is_1nf"), "Bring the record to first normal form"),
        Rule("distortion_001", "data_distortion", "warning", F.col("canonical_fields").isNull() | (F.col("n_fields") >= F.col("canonical_fields") * 0.5), "Check which fields were lost"),
        Rule("distortion_002", "data_distortion", "warning", ~F.col("is_1nf") | F.col("atomic"), "Flatten nested values"),
        Rule("compliance_001", "compliance", "error", F.coalesce((F.col("processing_id") != "") & (F.col("canonical_id") != "") & F.col("timestamp").isNotNull(), F.lit(False)), "Fill the required metadata"),
        Rule("compliance_002", "compliance", "error", F.col("canonical_processing_id").isNull() | (F.col("canonical_id") == F.col("canonical_processing_id")), "Refer to the canonical record"),
    ]


class Registry:
    """Rules by id; disabled ones are not run."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = {r.rule_id: r for r in rules}

    def register(self, rule: Rule) -> None:
        self.rules[rule.rule_id] = rule

    def unregister(self, rule_id: str) -> bool:
        return self.rules.pop(rule_id, None) is not None

    def enable(self, rule_id: str, on: bool = True) -> bool:
        if rule_id not in self.rules:
            return False
        self.rules[rule_id].enabled = on
        return True

    def active(self, *categories: str) -> list[Rule]:
        return [r for r in self.rules.values() if r.enabled and (not categories or r.category in categories)]


def results(df: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """(key, rule_id, category, severity, passed, recommendation): all rules in one pass over the rows."""
    cells = [
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
            F.coalesce(r.predicate, F.lit(False)).alias("passed"), F.lit(r.recommendation).alias("recommendation"),
        )
        for r in rules
    ]
    return df.select(*key, F.explode(F.array(*cells)).alias("_r")).select(*key, "_r.*")


def with_canonical(shaped: DataFrame, canonical: DataFrame) -> DataFrame:
    """Shaped records with their canonical ones, if any. ``canonical`` is (processing_id, canonical_fields)."""
    side = canonical.select(F.col("processing_id").alias("canonical_processing_id"), "canonical_fields")
    return shaped.join(side, F.col("canonical_id") == F.col("canonical_processing_id"), "left")


def report(found: DataFrame) -> DataFrame:
    """Totals and failures in all, by severity and by category, with zeros: (grouping, name, n_total, n_passed, n_failed)."""
    spark = found.sparkSession
    found.createOrReplaceTempView("_results")
    got = spark.sql(
        """SELECT CASE grouping_id(severity, category) WHEN 3 THEN 'all' WHEN 1 THEN 'severity' ELSE 'category' END AS grouping,
                  coalesce(severity, category, '') AS name, count(*) AS n_total, sum(CAST(passed AS BIGINT)) AS n_passed
           FROM _results GROUP BY GROUPING SETS ((severity), (category), ())"""
    )
    names = [("all", "")] + [("severity", s) for s in SEVERITIES] + [("category", c) for c in CATEGORIES]
    every = spark.createDataFrame(names, "grouping string, name string")
    zero = F.lit(0).cast("long")
    return every.join(got, ["grouping", "name"], "left").select(
        "grouping", "name", F.coalesce("n_total", zero).alias("n_total"), F.coalesce("n_passed", zero).alias("n_passed"),
        (F.coalesce("n_total", zero) - F.coalesce("n_passed", zero)).alias("n_failed"),
    )


def approvals(applied: DataFrame, approve=None) -> DataFrame:
    """(rule_type, approved): decided once for each distinct type, by the list or a callback."""
    types = applied.select("rule_type").distinct()
    if approve is None:
        return types.withColumn("approved", F.col("rule_type").isin(*APPROVED))
    rows = [(t, bool(approve(t))) for (t,) in types.collect()]  # distinct rule types: a handful
    return applied.sparkSession.createDataFrame(rows, "rule_type string, approved boolean")
