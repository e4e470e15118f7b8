"""WARC archives compressed record by record with a Zstandard dictionary.

An archive begins with a skippable frame that embeds a dictionary built from a bounded sample of its own records;
then every record is a frame of its own. Writing gives an index (archive, offset and size of each record), by which
one record is read without those before it. Of records with equal payloads the one with the least page_id is a response
and the others are revisits that refer to it. Ids go through Python as text, so 64-bit ids stay whole beside nulls.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_path, table, written

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: The dictionary's size, and the most records and bytes of records that one is built from.
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 32 << 10, 1000, 2 << 20
#: An archive is closed beyond this many bytes.
ARCHIVE_BYTES = 256 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
INDEX = "archive string, page_id string, offset long, size long"
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: str | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def build_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers, with the full payload's length, and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_uri(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_uri(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers by lower-case name, the block, and of an HTTP block the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": http.decode("utf-8"), "payload": payload}


def build_dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or the records' own beginnings where they are too few to train on; may be empty."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:2048] for r in records[:16])[:DICTIONARY_BYTES]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))


def filesystem(uri: str):
    """The file system of a shared folder and the path in it; plain paths are local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class Archive:
    """Writes one archive: dictionary frame, then a frame for each record. index: (page_id, offset, size) of its records."""

    def __init__(self, uri: str, dictionary: bytes):
        store, path = filesystem(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.out, self.at, self.index = uri, store.open_output_stream(path, compression=None), 0, []
        self.with_dictionary = _compressor(dictionary)
        self.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, page_id: str | None, record: bytes) -> None:
        data = self.with_dictionary.compress(record)
        self.index.append((page_id, self.at, len(data)))
        self.write(data)

    def close(self) -> pd.DataFrame:
        """The archive's rows of the index."""
        self.out.close()
        out = pd.DataFrame(self.index, columns=["page_id", "offset", "size"])
        out.insert(0, "archive", self.uri)
        return out


def _dictionary_of(source) -> zstandard.ZstdDecompressor:
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no leading dictionary frame")
    dictionary = source.read(size)
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_record_at(uri: str, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The records at these (offset, size) places of an archive; nothing between them is read."""
    store, path = filesystem(uri)
    with store.open_input_file(path) as source:
        reader = _dictionary_of(source)
        for offset, size in places:
            source.seek(offset)
            yield reader.decompressobj().decompress(source.read(size))


def read_archive(uri: str) -> Iterator[bytes]:
    """The records of an archive in order; memory holds a record and a read buffer."""
    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as source:
        reader = _dictionary_of(source)
        rest = source.read(READ_BYTES)
        while rest:
            frame, parts = reader.decompressobj(), []
            while True:
                parts.append(frame.decompress(rest))
                if frame.eof:
                    rest = frame.unused_data
                    break
                rest = source.read(READ_BYTES)
                if not rest:
                    raise ValueError("an archive ends within a record")
            yield b"".join(parts)
            rest = rest or source.read(READ_BYTES)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is set for records whose payload a lesser page_id has too.

    Payloads meet by digest as pairs (page_id, digest) only, and the least ids are a written table, so that a payload
    that a large share of the pages has can be split over tasks; pages then find their own pair, which spreads them.
    """
    payload = F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.sha2(F.col("payload"), 256)))
    pairs = written(rows.filter("key is not null and page_id is not null").select("page_id", "key"), "pairs")
    first = pairs.groupBy("key").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("key", "first")
    first = written(first, "first")
    revisits = pairs.join(first, "key").filter("page_id > first").select("page_id", "key", F.col("first").alias("refers_to")).distinct()
    return rows.join(revisits, ["page_id", "key"], "left").select("page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives under folder; returns the index (archive, page_id, offset, size).

    Each task writes archives of its own names and reports the records of those it finished; a task that runs again
    writes other files, and only archives in the index count. Pages without an id are responses.
    """
    bounded_batches(pages.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, waiting, size = None, [], 0

        def begin():
            nonlocal waiting, size
            made = Archive(f"{folder}/{uuid.uuid4().hex}.warc.zst", build_dictionary([r for _, r in waiting]))
            for page_id, r in waiting:
                made.add(page_id, r)
            waiting, size = [], 0
            return made

        for batch in batches:
            for page_id, url, payload, refers_to in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"]):
                record = build_record(page_id, url, bytes(payload), refers_to, date)
                if archive is None:
                    waiting.append((page_id, record))
                    size += len(record)
                    if len(waiting) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
                        archive = begin()
                    continue
                archive.add(page_id, record)
                if archive.at >= archive_bytes:
                    yield archive.close()
                    archive = None
        if archive is None and waiting:
            archive = begin()
        if archive is not None:
            yield archive.close()

    rows = with_revisits(pages, min_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return written(rows.mapInPandas(write, INDEX), "warc-index").withColumn("page_id", F.col("page_id").cast("long"))


def _page_of(uri: str | None) -> str | None:
    name = (uri or "").strip("<>").rsplit(":", 1)[-1]
    return name if re.fullmatch(r"-?\d+", name) else None


def _row(record: dict, uri: str) -> tuple:
    """A record as values of RECORD. A response's length and digest are computed and must equal its headers."""
    h = record["headers"]
    length = int(re.search(r"(?m)^Content-Length: (\d+)\r?$", record["http"])[1])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(record["payload"]), payload_digest(record["payload"])) != (length, digest):
        raise ValueError(f"a payload in {uri} differs from its headers")
    return _page_of(h["warc-record-id"]), h.get("warc-target-uri"), length, digest, h["warc-type"], _page_of(h.get("warc-refers-to"))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({c: object for c in names if c not in ("payload_bytes", "payload")})


def _with_ids(records: DataFrame) -> DataFrame:
    return records.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the index's archives, read in order: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's length and digest come from its headers.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["archive"]:
                rows = []
                for record in read_archive(uri):
                    rows.append(_row(parse_record(record), uri))
                    if len(rows) >= 10_000:
                        yield _frame(rows, names)
                        rows = []
                yield _frame(rows, names)

    archives = written(index.select("archive").distinct(), "archives")
    spread = archives.repartition(max(1, min(archives.count(), 10_000)))
    return _with_ids(spread.mapInPandas(read, RECORD))


def read_records(index: DataFrame) -> DataFrame:
    """The records that rows of an index name, each by its offset: the columns of read_archives, and payload (empty for revisits)."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, part in batch.groupby("archive"):
                places = list(zip(part["offset"].tolist(), part["size"].tolist()))
                found = [parse_record(r) for r in read_record_at(uri, places)]
                yield _frame([(*_row(r, uri), r["payload"]) for r in found], [*names, "payload"])

    bounded_batches(index.sparkSession)
    return _with_ids(index.select("archive", "offset", "size").mapInPandas(read, RECORD + ", payload binary"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page, read back from the archives.

    Null html is an empty payload, null urls have no target URI; empty payloads equal each other; repeated rows of the
    least page_id are responses all; rows without a page_id are responses and nothing refers to them; ids are 64-bit; an
    empty table writes no archive and gives no rows; extra columns are ignored.
    """
    index = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has SHA-1 in hex; five-bit groups of it are the base32 digits.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT *, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(16 + strpos('0123456789abcdef', substr(hex, CAST(i AS INT), 1)) - 1), 4)), '') AS bits FROM h)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, CAST(5*i+1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5*i+2 AS INT), 1) AS INT)
    + 4 * CAST(substr(bits, CAST(5*i+3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5*i+4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5*i+5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
