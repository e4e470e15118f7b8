"""An engine on a folder: documents, chunks and index generations as tables, and the searches over them.

It keeps no rows in memory. Every write is a new version of a table, so readers see a whole version or the one before.
"""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.filters import Filter
from .operators import documents as D
from .operators import fulltext, fusion, semantic
from .streaming.ingest import CHUNK, HashEncoder, Store, add_missing_chunks

GENERATION = "generation_id int, level int, bucket int, size long, center array<double>"
POSTING = "generation_id int, bucket int, rowid long, sub_idx int, hash string, residual binary"


class Engine:
    """encoder: encode(text) -> (matrix, end offsets), with a name."""

    def __init__(self, spark: SparkSession, folder: str, encoder=None, levels: semantic.Levels = semantic.Levels()):
        self.spark, self.encoder, self.levels = spark, encoder or HashEncoder(), levels
        self.documents, self.chunks = Store(spark, f"{folder}/documents", D.DOCUMENT), Store(spark, f"{folder}/chunks", CHUNK)
        self.centroids, self.postings = Store(spark, f"{folder}/centroids", GENERATION), Store(spark, f"{folder}/postings", POSTING)
        self.terms = Store(spark, f"{folder}/terms", fulltext.ENTRY)
        self._text: tuple[tuple, fulltext.Index | None] = ((), None)
        self._centers: tuple[tuple, list[semantic.Generation]] = ((), [])
        # Probes name up to some hundred buckets; row groups without any of them are skipped.
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "4096")
        self.query = lru_cache(256)(lambda text: self.encoder.encode(text)[0])

    # Documents.

    def add(self, rows: DataFrame, order: str | None = None) -> int:
        """Put in rows (uuid, date?, metadata, body, lens?); returns how many."""
        self.documents.write(D.upsert(self.documents.read(), rows, order))
        return rows.count()

    def remove(self, uuid: str) -> None:
        self._keep(D.remove(self.documents.read(), uuid))

    def delete(self, f: Filter | None) -> None:
        """Delete what the filter is true for; without a filter, everything."""
        self._keep(D.delete_where(self.documents.read(), f))

    def clear(self) -> None:
        for store in (self.documents, self.chunks, self.centroids, self.postings, self.terms):
            store.write(store.read().limit(0))

    def _keep(self, rows: DataFrame) -> None:
        self.chunks.write(D.live_chunks(self.chunks.read(), self.documents.write(rows)))

    # Vectors and index.

    def embed(self, limit: int | None = None) -> int:
        """Encode contents that have no chunk yet; returns how many."""
        return add_missing_chunks(self.documents.read(), self.chunks, self.encoder, limit)

    def _tokens(self) -> DataFrame:
        """Vectors of all documents; a content that several documents share stands for each of them."""
        return self.chunks.read().join(self.documents.read().select("rowid", "hash"), "hash").select("rowid", "sub_idx", "pos", "hash", "embedding")

    def unindexed(self) -> DataFrame:
        return self._tokens().join(self.postings.read().select("rowid", "hash").distinct(), ["rowid", "hash"], "left_anti")

    def count_unindexed(self) -> int:
        return self.unindexed().count()

    def index(self, rebuild: bool = False) -> int | None:
        """Take up waiting vectors by levels; returns the level that was built, or None while too few wait.

        All levels up to the target and the waiting vectors become one generation; rebuild starts from nothing.
        """
        centroids, postings = self.centroids.read(), self.postings.read()
        if rebuild:
            centroids, postings = centroids.limit(0), postings.limit(0)
        waiting = self._tokens() if rebuild else self.unindexed()
        sizes = {r["level"]: r["n"] for r in centroids.groupBy("level").agg(F.sum("size").alias("n")).collect()}
        plan = self.levels.plan(waiting.count(), sizes)
        if plan is None:
            if rebuild:
                self.centroids.write(centroids), self.postings.write(postings)
            return None
        merged = centroids.filter(F.col("level") <= plan[0]).select("generation_id").distinct()
        kept = postings.join(merged, "generation_id", "left_anti")
        tokens = self._tokens().join(kept.select("rowid", "hash").distinct(), ["rowid", "hash"], "left_anti")
        number = (centroids.agg(F.max("generation_id")).first()[0] or 0) + 1
        g = semantic.build_generation(tokens, number, plan[0])
        rows = [(number, plan[0], b, int(g.sizes[b]), g.centers[b].tolist()) for b in range(len(g.centers))]
        postings = kept.unionByName(g.postings.select(kept.columns))
        # Sorted by bucket, so that a probe reads the row groups of its buckets; a hot bucket is cut by rowid.
        self.postings.write(postings.repartitionByRange("generation_id", "bucket", "rowid").sortWithinPartitions("generation_id", "bucket"))
        self.centroids.write(centroids.join(merged, "generation_id", "left_anti").unionByName(self.spark.createDataFrame(rows, GENERATION)))
        return plan[0]

    def _generations(self) -> list[semantic.Generation]:
        state = (self.centroids.state(), self.postings.state())
        if state == self._centers[0]:
            return self._centers[1]
        rows: dict[int, list] = {}
        for r in self.centroids.read().collect():  # centres: their number grows with the root of the vectors
            rows.setdefault(r["generation_id"], []).append(r)
        postings, out = self.postings.read(), []
        for number, found in sorted(rows.items()):
            found.sort(key=lambda r: r["bucket"])
            out.append(semantic.Generation(number, found[0]["level"], np.array([r["center"] for r in found]), np.array([r["size"] for r in found]), postings.filter(F.col("generation_id") == number)))
        self._centers = (state, out)
        return out

    # Searches.

    def semantic_search(self, matrix: np.ndarray, threshold: float, top_k: int, f: Filter | None = None) -> DataFrame:
        return semantic.search_index(self._generations(), self.unindexed(), matrix, threshold, top_k, self.documents.read(), f)

    def fulltext_index(self) -> fulltext.Index:
        """The stored index, brought up to date: entries of new contents are appended, and only where documents have
        gone or changed are the others written anew."""
        state = self.documents.state()
        if self._text[1] is None or state != self._text[0]:
            documents, known = self.documents.read(), self.terms.read()
            live, key = documents.select("rowid", "hash"), ["rowid", "hash"]
            lengths = known.filter("term = ''")
            if not lengths.join(live, key, "left_anti").isEmpty():
                kept = known.join(live, key, "left_semi").select(*known.columns)
                known = self.terms.write(kept.repartitionByRange("term", "rowid").sortWithinPartitions("term", "rowid"))
            fresh = documents.join(known.filter("term = ''").select(*key), key, "left_anti")
            if not fresh.isEmpty():
                self.terms.append(fulltext.entries(fresh))
            self._text = (state, fulltext.stored(self.terms.read()))
        return self._text[1]

    def search(self, text: str, threshold: float = 0.7, top_k: int = 10, use_fulltext: bool = True, f: Filter | None = None) -> list[dict]:
        """Hits with score, metadata, bodies, sub_idx and date, best first."""
        found = fusion.hybrid_search(
            self.documents.read(), self.fulltext_index() if use_fulltext else None, lambda m: self.semantic_search(m, threshold, top_k, f), text, self.query, top_k, f
        )
        return [r.asDict() for r in found.collect()]

    def score(self, text: str, sentences: list[str]) -> list[float]:
        """How well each sentence answers the text."""
        rows = [(i, v.tolist()) for i, s in enumerate(sentences) for v in self.encoder.encode(s)[0]]
        tokens = self.spark.createDataFrame(rows, "sentence int, embedding array<double>")
        found = {r["sentence"]: r["score"] for r in semantic.sentence_scores(tokens, self.query(text)).collect()}
        return [found.get(i, 0.0) for i in range(len(sentences))]

    def bulk(self, questions: DataFrame, top_k: int = 100, use_fulltext: bool = True, use_semantic: bool = True) -> DataFrame:
        """(qid, rank, rowid, sub_idx) for all questions (qid, question); documents may come twice."""
        index = self.fulltext_index()
        asked = [(r["qid"], r["question"]) for r in questions.collect()]  # questions are encoded here
        empty = self.spark.createDataFrame([], "qid string, rowid long, sub_idx int, rank int")
        lexical, deep = empty, empty
        if use_fulltext:
            for qid, text in asked:
                lexical = lexical.unionByName(fulltext.search(self.documents.read(), index, text, top_k).select(F.lit(qid).cast("string").alias("qid"), "rowid", "sub_idx", "rank"))
        if use_semantic:
            names = dict(enumerate(q for q, _ in asked))
            matrices = {i: self.query(text) for i, (_, text) in enumerate(asked) if len(self.query(text))}
            hits = fusion.batched_maxsim(self._tokens(), matrices, top_k)
            table = F.create_map(*[F.lit(x) for i, q in names.items() for x in (i, str(q))])
            deep = hits.select(table[F.col("qid")].alias("qid"), "rowid", "sub_idx", "rank")
        if not use_semantic or not use_fulltext:
            return (lexical if use_fulltext else deep).select("qid", "rank", "rowid", "sub_idx")
        return fusion.batched_search(lexical, deep, top_k).select("qid", "rank", "rowid", "sub_idx")


@dataclass
class Job:
    kind: str
    run: Callable[[], object]
    done: threading.Event
    result: object = None
    error: Exception | None = None


class Jobs:
    """One worker that does jobs in order. Clearing or deleting discards the writes that wait before it."""

    def __init__(self, engine: Engine, log: Callable[[str], None] | None = None, batch: int = 10):
        self.engine, self.log, self.batch, self.stopped = engine, log or (lambda _: None), batch, False
        self.waiting: queue.Queue[Job | None] = queue.Queue()
        self.lock, self.discard = threading.Lock(), 0
        self.worker = threading.Thread(target=self._work, daemon=True)
        self.worker.start()

    def _put(self, kind: str, run: Callable[[], object]) -> Job:
        job = Job(kind, run, threading.Event())
        with self.lock:
            if kind in ("clear", "delete"):
                self.discard += 1
            self.waiting.put(job)
        return job

    def add(self, rows: DataFrame) -> Job:
        return self._put("add", lambda: self.engine.add(rows))

    def remove(self, uuid: str) -> Job:
        return self._put("remove", lambda: self.engine.remove(uuid))

    def index(self) -> Job:
        """Encode in batches until nothing waits, then index if enough does."""

        def run():
            total = 0
            while not self.discard and (n := self.engine.embed(self.batch)):
                total += n
                self.log(f"encoded {total}")
            return self.engine.index()

        return self._put("index", run)

    def clear(self) -> Job:
        return self._put("clear", self.engine.clear)

    def delete(self, f: Filter | None) -> Job:
        return self._put("delete", lambda: self.engine.delete(f))

    def shutdown(self) -> None:
        self.waiting.put(None)
        self.worker.join()

    def _work(self) -> None:
        while (job := self.waiting.get()) is not None:
            if job.kind in ("clear", "delete"):
                with self.lock:
                    self.discard -= 1
            elif self.discard:
                job.done.set()
                continue
            try:
                job.result = job.run()
            except Exception as e:  # noqa: BLE001  the worker lives on; the caller sees the error
                job.error = e
                self.log(f"{job.kind}: {e}")
            job.done.set()


def main(args: list[str]) -> int:
    """python -m sparkseek.engine FOLDER readcsv FILE | embed | index | reindex | query TEXT | hybrid TEXT | querycsv FILE OUT |
    hybridcsv FILE OUT | fulltextcsv FILE OUT | score TEXT SENTENCE... | clear"""
    from .sources import tsv

    if len(args) < 2:
        print(main.__doc__)
        return 2
    folder, verb, *rest = args
    spark = SparkSession.builder.appName("sparkseek").getOrCreate()
    engine = Engine(spark, folder)
    if verb == "readcsv":
        print(engine.add(tsv.read_documents(spark, rest[0]).dropDuplicates(["uuid"])))
    elif verb == "embed":
        print(engine.embed())
    elif verb in ("index", "reindex"):
        print(engine.index(rebuild=verb == "reindex"))
    elif verb in ("query", "hybrid"):
        for hit in engine.search(" ".join(rest), use_fulltext=verb == "hybrid"):
            print(json.dumps(hit, ensure_ascii=False))
    elif verb in ("querycsv", "hybridcsv", "fulltextcsv"):
        found = engine.bulk(tsv.read_questions(spark, rest[0]), use_fulltext=verb != "querycsv", use_semantic=verb != "fulltextcsv")
        keys = engine.documents.read().select("rowid", F.get_json_object("metadata", "$.key").alias("key"))
        fusion.ranked_lines(found.join(keys, "rowid")).write.mode("overwrite").text(rest[1])
    elif verb == "score":
        print(engine.score(rest[0], rest[1:]))
    elif verb == "clear":
        engine.clear()
    else:
        print(main.__doc__)
        return 2
    return 0


if __name__ == "__main__":
    import sys

    raise SystemExit(main(sys.argv[1:]))
