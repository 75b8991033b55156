"""Where the llm queries read their inputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A public vocabulary file, in the folder that CURATA_TOKENIZERS names or else where the installed package has it."""
    folder = os.environ.get("CURATA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
