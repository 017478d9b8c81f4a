"""What the operators need of the session: scratch tables, this package in Python workers, the documents."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

from reviewops.session import kept, new_path

__all__ = ["documents", "kept", "new_path", "ship"]

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    if _ROOT not in sys.path:
        sys.path.insert(0, _ROOT)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
