"""The queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, htmltext, mixing, pieces, pii, quality, secrets, simhash, topk, toxicity, variants, warc, whitening
from .common import table

#: A public SentencePiece model file; override with the environment's own path.
MODEL_PATH = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Wanted shares of tokens; the first domain keeps its expected tokens.
MIX_TARGETS = {"good": 0.95, "low": 0.04, "toxic": 0.01}


def model_bytes(path: str = MODEL_PATH) -> bytes:
    """Content of the model file (half a megabyte), read on the driver and sent along."""
    with open(path, "rb") as f:
        return f.read()


def labelled_domains(labels: DataFrame) -> DataFrame:
    """labels -> (doc_id, domain): toxic, else good or low by quality."""
    domain: Column = (F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").when(F.col("quality") <= 0, "low"))
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), labelled_domains(table(spark, sf_dir, "labels")), MIX_TARGETS)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_decode(table(spark, sf_dir, "documents"), model_bytes())


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % topk.QUERY_EVERY == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    ops = (op1_mixing, op2_html_extraction, op3_secret_scan, op4_quality_rules, op5_simhash, op6_quality_classifier,
           op7_sentencepiece, op8_exact_top_k, op9_warc, op10_toxicity, op11_whitening, op12_pii, op13_spelling_variants)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}
