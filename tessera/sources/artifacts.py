"""Load saved artifacts (label lists, code table, word vectors)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ARTIFACTS = ("train_data", "category_codes", "word_vectors")


def load_artifacts(spark: SparkSession, root: str, names=ARTIFACTS) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(root, n)) for n in names}


def load_artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, name))
