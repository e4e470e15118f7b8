"""Tab-separated documents and questions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import chunk_text, uuid5

PIECE_CHARS = 300
#: Fixed value: the UUID namespace of object identifiers.
OID = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


def read_pairs(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=False, schema=f"{first} string, {second} string", quote='"', escape='"', multiLine=False)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question)."""
    return read_pairs(spark, path, "qid", "question")


def documents(rows: DataFrame, most: int = PIECE_CHARS) -> DataFrame:
    """(uuid, date, metadata, body, lens) of rows (name, body): bodies in pieces of at most `most` characters, each a line."""

    @F.pandas_udf(ArrayType(StringType()))
    def pieces(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([[x.strip() + "\n" for x in chunk_text(t or "", most) if x.strip()] for t in p], dtype=object)

    cut = rows.select("name", pieces("body").alias("pieces")).withColumn("body", F.array_join("pieces", ""))
    meta = F.to_json(F.struct(F.col("name").alias("key")))
    return cut.select(uuid5(OID, F.col("body")).alias("uuid"), F.lit(None).cast("string").alias("date"), meta.alias("metadata"), "body", F.transform("pieces", lambda x: F.char_length(x)).alias("lens"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return documents(read_pairs(spark, path, "name", "body"))
