"""The queries op1 to op13 over the whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, fill_middle, filter_audit, kneser_ney, license_scan, media, mixing, packing, quality_rules, simhash, site_template, suffix_dedup, url_filter
from docloom.llm.common import documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file: in the folder DOCLOOM_TOKENIZERS, or as installed here."""
    folder = os.environ.get("DOCLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"))
    return packing.digests(packing.stored(rows))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.rules_table(spark))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_site_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_template.extract(table(spark, sf_dir, "pages"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_kneser_ney, op2_media, op3_suffix_dedup, op4_quality_rules, op5_packing,
        op6_url_filter, op7_mixing, op8_bpe, op9_simhash, op10_license_scan,
        op11_filter_audit, op12_site_template, op13_fill_middle,
    )
}
#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op6_url_filter": url_filter.ORACLE,
    "op10_license_scan": license_scan.oracle(),
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
