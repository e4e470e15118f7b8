"""Incremental ingest and index upkeep with Structured Streaming.

Files that are new since the last run come as micro-batches (the file source's checkpoint is the watermark); every
batch is merged into the document table by uuid, and contents that have no vectors yet are encoded and appended.
Tables are versions in a folder: a batch writes the next version and then names it current, so a batch that is run
again after a failure starts from the same version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as docs
from ..operators.semantic import Levels, token_subs
from ..tables import remove, written

#: A table's format; another one makes sources come in again.
FORMAT = 1
CHUNK = "hash string, model string, pos int, sub_idx int, embedding array<float>"


@dataclass
class Store:
    """Versions of a table below a folder."""

    spark: SparkSession
    folder: str
    schema: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path(".")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path("."))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._path(f"{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{found[-1]}")

    def write(self, rows: DataFrame, keep: int = 2) -> DataFrame:
        """The next version; all but the last `keep` are deleted."""
        found = self.versions()
        following = (found[-1] if found else 0) + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{following}")
        for old in found[: max(0, len(found) + 1 - keep)]:
            self._fs().delete(self._path(f"v{old}"), True)
        return self.read()

    def append(self, rows: DataFrame) -> DataFrame:
        """rows added to the current version by one commit: what is written is in proportion to rows, not to the table.

        Rows must be new to the table by their key, so that a batch that runs again adds nothing twice.
        """
        found = self.versions()
        if not found:
            return self.write(rows)
        rows.write.mode("append").parquet(f"{self.folder}/v{found[-1]}")
        return self.read()

    def state(self) -> tuple:
        """Changes whenever the table does: its version and the commit's time."""
        found = self.versions()
        return (found[-1], self._fs().getFileStatus(self._path(f"v{found[-1]}/_SUCCESS")).getModificationTime()) if found else ()


class HashEncoder:
    """Stands in for a model: each word a unit vector drawn from its hash. encode(text) -> (matrix, end offsets in code points)."""

    def __init__(self, dim: int = 64, seed: int = 42):
        self.dim, self.seed, self.name = dim, seed, f"hash-{dim}-{seed}"

    def encode(self, text: str) -> tuple[np.ndarray, list[int]]:
        import re
        import zlib

        words = [(m[0].lower(), m.end()) for m in re.finditer(r"\w+", text)]
        rows = [np.random.default_rng((self.seed, zlib.crc32(w.encode()))).standard_normal(self.dim) for w, _ in words]
        matrix = np.array(rows).reshape(-1, self.dim)
        return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12), [e for _, e in words]


def encode_windows(encode: Callable[[list], np.ndarray], tokens: list, window: int = 2048, overlap: int = 256) -> np.ndarray:
    """Vectors of long token lists: windows that overlap, what lies in two windows summed."""
    if len(tokens) <= window:
        return encode(tokens)
    out, step = None, window - overlap
    for start in range(0, max(1, len(tokens) - overlap), step):
        part = encode(tokens[start : start + window])
        if out is None:
            out = np.zeros((len(tokens), part.shape[1]))
        out[start : start + len(part)] += part
    return out


def keep_long_vectors(matrix: np.ndarray, ends: list[int], least: float = 1.0) -> tuple[np.ndarray, list[int]]:
    """Vectors whose norm is at least 1, normalised; none left is an error."""
    size = np.linalg.norm(matrix, axis=1)
    good = size >= least
    if not good.any():
        raise ValueError("no vector is long enough")
    return matrix[good] / size[good, None], [e for e, g in zip(ends, good) if g]


def encode_backlog(waiting: DataFrame, encoder) -> DataFrame:
    """Chunk rows (hash, model, pos, sub_idx, embedding) of contents (hash, body, lens).

    Vectors shorter than the encoder's least_norm go, if it has one, and the others become unit vectors. An encoder of
    long token lists can run its model by encode_windows.
    """
    least = getattr(encoder, "least_norm", 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, body in zip(b["hash"], b["body"]):
                matrix, ends = encoder.encode(body)
                if len(matrix):
                    matrix, ends = keep_long_vectors(matrix, ends, least)
                rows += [(h, i, int(e), v.astype("float32")) for i, (v, e) in enumerate(zip(matrix, ends))]
            yield pd.DataFrame(rows, columns=["hash", "pos", "end", "embedding"])

    vectors = waiting.select("hash", "body").mapInPandas(run, "hash string, pos int, end int, embedding array<float>")
    placed = vectors.join(waiting.select("hash", "lens"), "hash")
    return placed.select("hash", F.lit(encoder.name).alias("model"), "pos", token_subs(F.array("end"), F.col("lens"))[0].cast("int").alias("sub_idx"), "embedding")


def merge_batch(batch: DataFrame, documents: Store, chunks: Store | None = None, encoder=None, stale: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Put a batch of (uuid, date, metadata, body, lens) into the stores; returns the number of its documents.

    stale: gives the (uuid) of stored documents that the batch makes obsolete.
    """
    current = documents.read()
    if stale is not None:
        current = current.join(stale(current), "uuid", "left_anti")
    merged = documents.write(docs.upsert(current, batch))
    if chunks is not None and encoder is not None:
        add_missing_chunks(merged, chunks, encoder)
    return batch.count()


def add_missing_chunks(documents: DataFrame, chunks: Store, encoder, limit: int | None = None) -> int:
    """Encode contents that have no chunk yet and append them; contents that no document has any more stay until the
    next deletion, and searches pass over them. Returns the number of contents."""
    waiting = written(docs.backlog(documents, chunks.read().select("hash").distinct(), limit), "backlog")
    count = waiting.count()
    if count:
        chunks.append(encode_backlog(waiting, encoder))
    remove(documents.sparkSession, waiting)
    return count


def run_stream(
    spark: SparkSession, folder: str, to_documents: Callable[[DataFrame], DataFrame], documents: Store, checkpoint: str,
    chunks: Store | None = None, encoder=None, pattern: str = "*.jsonl", files_per_batch: int = 1000, format_version: int = FORMAT,
    stale: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> int:
    """Take in all files below folder that came since the last run with this checkpoint; returns the number of documents.

    to_documents turns files (path, stem, mtime_ms, raw) into document rows. A new format_version reads everything anew.
    stale gives, from the stored documents and a batch's files, the (uuid) that the batch makes obsolete.
    """
    total = 0
    schema = "value string"
    source = (
        spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.col("value").alias("raw"))
    )
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")

    def each(batch: DataFrame, _: int) -> None:
        nonlocal total
        files = batch.withColumn("stem", stem)
        gone = (lambda stored: stale(stored, files)) if stale is not None else None
        total += merge_batch(to_documents(files), documents, chunks, encoder, gone)

    query = source.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/format={format_version}").trigger(availableNow=True).start()
    query.awaitTermination()
    return total


def fresh_enough(files: DataFrame, now_ms: int, active: str | None = None, idle_ms: int = 10 * 60_000) -> DataFrame:
    """Files without the active session's while it was written to within the last ten minutes."""
    return files.filter(~((F.col("stem") == active) & (F.col("mtime_ms") > now_ms - idle_ms))) if active else files


def next_merge(chunks: DataFrame, generations: DataFrame, levels: Levels = Levels()) -> tuple[int, int, int] | None:
    """(target level, vectors, first chunk) of the merge due now, or None. generations: (level, num_embeddings, min_chunk, max_chunk);
    chunks: (chunk, n). A few numbers come to the driver."""
    done = generations.agg(F.coalesce(F.max("max_chunk"), F.lit(0))).first()[0]
    waiting = chunks.filter(F.col("chunk") > done).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = {r["level"]: r["n"] for r in generations.groupBy("level").agg(F.sum("num_embeddings").alias("n")).collect()}
    plan = levels.plan(int(waiting), sizes)
    if plan is None:
        return None
    first = generations.filter(F.col("level") <= plan[0]).agg(F.coalesce(F.min("min_chunk"), F.lit(done + 1))).first()[0]
    return (*plan, int(first))


def session_windows(events: DataFrame, channel: str, ts: str, gap: str, late: str) -> DataFrame:
    """(channel, start, end, n) of a stream: session windows that close once the watermark has passed."""
    window = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(channel, window.alias("w")).agg(F.count("*").alias("n")).select(channel, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
