"""A corpus pipeline: toxic documents, copies, near copies and benchmark passages go, and what stays is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkseek.llm.common import table, written
from sparkseek.llm.decontaminate import decontaminate
from sparkseek.llm.exact_dedup import exact_dedup
from sparkseek.llm.near import near_dedup
from sparkseek.llm.pieces import encode
from sparkseek.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold; it learns from the labels of the training folds."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most code points, then the least doc_id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are 0.8 similar the least doc_id."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document that stayed: its piece ids' digest, number, n best scores, and the round trip."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("decontamination", benchmark), ("sentencepiece", pieces)]
#: Scores, fingerprints and the piece lattice are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; what each one returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
