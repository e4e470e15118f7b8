"""Markdown files as documents, and the files that configuration files refer to."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import chunk_markdown, uuid5
from ..operators.sessions import SESSION_NAMESPACE

SECTION_CHARS = 1500


def without_front_matter(text: str) -> str:
    if not text.startswith("---\n"):
        return text
    _, mark, rest = text[4:].partition("\n---\n")
    return rest if mark else text


def documents(files: DataFrame, kind: str, source: str, project: str | None = None) -> DataFrame:
    """(uuid, date, metadata, body, lens) of files (path, stem, mtime_ms, raw). kind: memory (named in its project) or authored (by path).

    A header line, then the sections; blank files are left out.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def sections(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([chunk_markdown(without_front_matter(t), SECTION_CHARS) for t in p], dtype=object)

    rows = files.filter(F.trim("raw") != "").withColumn("file", F.element_at(F.split("path", "/"), -1))
    rows = rows.withColumn("project", F.lit(project) if project is not None else F.element_at(F.split("path", "/"), -2))
    name = F.concat(F.lit("memory:"), "project", F.lit(":"), "file") if kind == "memory" else F.concat(F.lit("authored:"), "path")
    shown = F.regexp_replace("file", r"(\.md)+$", "") if kind == "memory" else F.col("file")
    header = F.concat(F.lit("["), "project", F.lit("] "), shown, F.lit("\n"))
    cut = rows.withColumn("parts", F.concat(F.array(header), sections("raw")))
    meta = F.to_json(F.struct(F.lit(source).alias("source"), "project", "path", "mtime_ms"))
    return cut.select(uuid5(SESSION_NAMESPACE, name).alias("uuid"), F.lit(None).cast("string").alias("date"), meta.alias("metadata"), F.array_join("parts", "").alias("body"), F.transform("parts", lambda x: F.char_length(x)).alias("lens"))


def references(text: str) -> list[str]:
    """Paths that lines name as @path, or as path.md, alone or before " - " and a description."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if line.startswith("@") and line[1:].split():
            out.append(line[1:].split()[0])
        named = line.split(" - ")[0].strip()
        if named.endswith(".md") and " " not in named:
            out.append(named)
    return out


#: Rounds of references after which lineage is cut.
CUT_ROUNDS = 4


def closure(files: DataFrame, roots: list[str]) -> DataFrame:
    """(path) of the files that roots reach by references, roots included. files: (path, raw).

    References of all files are found once; rounds then follow them by joins until nothing new comes, which the
    number of files bounds; every few rounds what was seen is written to the checkpoint folder. Paths are relative to the
    folder of the file that names them.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def found(raws: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([[_joined(p, r) for r in references(t or "")] for t, p in zip(raws, paths)], dtype=object)

    edges = files.select("path", F.explode(found("raw", "path")).alias("to")).join(files.select(F.col("path").alias("to")), "to", "left_semi").distinct().cache()
    seen = files.select("path").filter(F.col("path").isin(roots))
    context = files.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="sparkseek-"))
    count, turn = seen.count(), 0
    while True:
        turn += 1
        seen = seen.unionByName(edges.join(seen, "path").select(F.col("to").alias("path"))).distinct()
        if turn % CUT_ROUNDS == 0:
            seen = seen.checkpoint()
        more = seen.count()
        if more == count:
            break
        count = more
    return seen.orderBy("path")


def _joined(path: str, reference: str) -> str:
    parts = [] if reference.startswith("/") else path.split("/")[:-1]
    for p in reference.split("/"):
        if p == ".." and parts:
            parts.pop()
        elif p not in (".", "", ".."):
            parts.append(p)
    joined = "/".join(parts)
    return joined if not reference.startswith("/") else re.sub("^/*", "/", joined)
