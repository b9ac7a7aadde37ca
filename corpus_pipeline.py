"""The corpus pipeline: quality rules, near-dedup, exact substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and calls
one operator of docloom.llm. All stages but the last return the columns of ``documents``.

Edge cases: a null or empty text, or one of fewer than ten words, goes in the first stage; of
repeated rows and of ties one row stays; very long texts are worked on whole; a null doc_id,
language or source is a value of its own; an empty table gives an empty result of the same
columns; further columns, whatever their names, pass all stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from docloom.llm.common import written
from docloom.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays.

    Near duplicates have SimHash fingerprints that op9_simhash links, or share four fifths or more of their shingles
    of five words, which fingerprints can't tell; a group is what can be reached over both.
    """
    return simhash.representatives(docs, 5, 0.8, linked=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; n_chars follows."""
    out = suffix_dedup.cleaned(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mix, a row for each copy."""
    return bpe.round_trip(docs, tokenizer_path(), bpe.STAGE_KEPT, forget=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: The learned log ratios, fingerprints, repeats and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
