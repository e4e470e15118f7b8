"""What the operators of this subpackage share: written tables, batch limits, columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import bounded_batches, remove, scratch_path, shared_dir, written

__all__ = ["bounded_batches", "remove", "scratch_path", "shared_dir", "table", "text_of", "written"]

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text"):
    """The text column as a string, null as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))
