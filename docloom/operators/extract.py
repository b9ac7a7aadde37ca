"""Extraction by a plugged-in model: pages in, records out, with retries and fallbacks.

A model is a function (payloads of one document, prompt) -> JSON text. It runs on Arrow
batches of grouped pages; what it returns is parsed by Spark with the compiled schema. A
document whose models all fail keeps its row with the error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import metrics, quality, shape, validate
from docloom.plans import schema as plans

Model = Callable[[list[bytes], str], str]
ANSWER = "raw string, client string, success boolean, fallback_applied boolean, attempts int, error string"


def stub(fields: list[str]) -> Model:
    """A deterministic stand-in: values depend on the pages only."""

    def run(pages: list[bytes], prompt: str) -> str:
        digest = hashlib.sha256(b"\0".join(pages)).hexdigest()
        return json.dumps({f: digest[k * 4 : k * 4 + 8] for k, f in enumerate(fields)})

    return run


def grouped(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, pages): the page images of each document in order."""
    held = F.array_sort(F.collect_list(F.struct("page_number", "image")))
    return pages.groupBy(key).agg(held.alias("_p")).select(key, F.col("_p.image").alias("pages"))


def answered(documents: DataFrame, models: dict[str, Model], chain: list[str], prompt: str, attempts: int = 2, key: str = "document_id") -> DataFrame:
    """(key, ANSWER) of every document: the models of the chain in turn, each tried ``attempts`` times."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for k, pages in zip(frame[key], frame["pages"]):
                error, tried, found = None, 0, None
                for client in chain:
                    for _ in range(attempts):
                        tried += 1
                        try:
                            found = models[client]([bytes(p) for p in pages], prompt)
                            break
                        except Exception as e:  # a model's failure is a result
                            error = f"{type(e).__name__}: {e}"
                    if found is not None:
                        break
                rows.append((k, found, client if found is not None else None, found is not None, found is not None and client != chain[0], tried, None if found is not None else error))
            yield pd.DataFrame(rows, columns=[key, *[x.split()[0] for x in ANSWER.split(", ")]])

    return documents.select(key, "pages").mapInPandas(run, f"{key} {kind}, {ANSWER}")


def combined(raw: Column) -> Column:
    """Answers of several pages as one: a single one as it is, more as {pages, total_pages}."""
    return F.when(F.size(raw) == 1, F.get(raw, F.lit(0))).otherwise(F.to_json(F.struct(raw.alias("pages"), F.size(raw).alias("total_pages"))))


def records(answers: DataFrame, schema: dict, as_of: Column, key: str = "document_id") -> DataFrame:
    """Canonical records of the answers; failed ones have null data."""
    kind = plans.compiled(schema)
    data = F.when(F.col("success"), F.from_json("raw", kind))
    names = F.array(*[F.lit(n) for n in kind.names])
    confidence = F.map_from_entries(F.transform(names, lambda n: F.struct(n, (F.when(F.col("success"), 0.8).otherwise(0.2) * F.when(F.col("fallback_applied"), 0.9).otherwise(1.0)))))
    meta = F.create_map(F.lit("client"), F.coalesce("client", F.lit("")), F.lit("error"), F.coalesce("error", F.lit("")))
    return shape.canonical(answers, F.col(key), data, as_of, confidence, meta)


def process(pages: DataFrame, schema: dict, models: dict[str, Model], chain: list[str], as_of: Column, key: str = "document_id") -> dict[str, DataFrame]:
    """Pages to canonical records, shaped rows, issues, scores and quality, all lazy."""
    plans.check(schema)
    prompt = plans.function(schema)["prompt"]
    answers = answered(grouped(pages, key), models, chain, prompt, key=key)
    canonical = records(answers, schema, as_of, key)
    spark = pages.sparkSession
    types, required = plans.expected(schema, spark)
    variant = canonical.select("processing_id", F.parse_json(F.to_json("extraction_data", {"ignoreNullFields": "false"})).alias("v")).where("v is not null")
    fields = shape.fields_view(variant, "v", ["processing_id"])
    ids = canonical.select("processing_id")
    present = fields.where("tag <> 'null'")
    issues = validate.missing_required(ids, present, required, ["processing_id"]).unionByName(validate.type_issues(present, types, ["processing_id"])).unionByName(validate.quality_issues(fields, ["processing_id"]).drop("ord"))
    executed = quality.execution_quality(F.col("success"), F.col("fallback_applied"), F.lit(len(schema["properties"])), F.lit(len(schema["properties"])), F.lit(True))
    return {
        "answers": answers,
        "canonical": canonical,
        "shaped": shape.shaped(canonical.where("extraction_data is not null"), width={}),
        "issues": issues,
        "scores": validate.scores(ids, fields, issues, ["processing_id"]),
        "quality": answers.select(key, *[c.alias(n) for n, c in executed.items()]),
        "errors": answers.where("not success").select(key, metrics.classify(F.col("error"), F.lit("")).alias("handling")),
    }
