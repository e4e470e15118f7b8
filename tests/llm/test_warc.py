import base64
import hashlib
import struct

import pytest
import zstandard

from sparkseek.llm import warc as W


def slow(rows, min_bytes=0):
    first = {}
    for page, _, html in rows:
        key = (html or "").encode()
        if len(key) >= min_bytes:
            first[key] = min(first.get(key, page), page)
    out = []
    for page, _, html in rows:
        key = (html or "").encode()
        again = first.get(key, page) < page
        out.append((page, len(key), base64.b32encode(hashlib.sha1(key).digest()).decode(), "revisit" if again else "response", first[key] if again else None))
    return sorted(out)


ROWS = [(1, "http://a.b/ c\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "y" * 3_000_000), (7, "u", "<p>x</p>"), (7, "u", "<p>x</p>"), (-8, "u", "z")]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in ROWS], "page_id long, url string, html string, key int")
    index = W.write_archives(df, W.scratch_path(spark, "warc"), min_bytes, archive_bytes=1 << 10)
    got = W.read_archives(index).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == slow(ROWS, min_bytes)
    assert {r["url"] for r in got if r["page_id"] in (1, 2)} == {"http://a.b/%20c%0D%0A", None}


def test_empty(spark):
    manifest = W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), W.scratch_path(spark, "warc"))
    assert W.read_archives(manifest).count() == 0


def test_archive_layout(tmp_path):
    records = [W.build_record(i, "http://h/%d" % i, f"<html>{i} common words in every page</html>".encode() * 5, None, "2024-01-01T00:00:00Z") for i in range(300)]
    dictionary = W.build_dictionary(records)
    archive = W.Archive(str(tmp_path / "a.warc.zst"), dictionary)
    places = []
    for r in records:
        places.append(archive.at)
        archive.add(None, r)
    archive.close()
    data = (tmp_path / "a.warc.zst").read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == W.DICTIONARY_FRAME and data[8 : 8 + size] == dictionary
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj()
    assert one.decompress(data[places[123] :]) == records[123]  # a record by its offset alone
    assert list(W.read_archive(str(tmp_path / "a.warc.zst"))) == records
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - size < plain


def test_damage_is_seen(tmp_path):
    archive = W.Archive(str(tmp_path / "a.warc.zst"), b"")
    archive.add(None, b"x" * 1000)
    archive.close()
    (tmp_path / "b.warc.zst").write_bytes((tmp_path / "a.warc.zst").read_bytes()[:-3])
    with pytest.raises(Exception):
        list(W.read_archive(str(tmp_path / "b.warc.zst")))


def test_wide_ids_beside_nulls(spark):
    ids = [(1 << 53) + 1, (1 << 53) + 2, (1 << 62) + 3, -(1 << 62) - 1, None, 5]
    rows = [(i, "u", "same" if n < 5 else "other") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    index = W.write_archives(df, W.scratch_path(spark, "warc"))
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in W.read_archives(index).collect()}
    least = -(1 << 62) - 1
    assert got == {(i, "revisit", least) for i in ids[:3]} | {(least, "response", None), (None, "response", None), (5, "response", None)}
    assert {r["page_id"] for r in index.collect()} == set(ids)


def test_records_by_offset(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 7}</p>" * 20) for i in range(200)]
    index = W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), W.scratch_path(spark, "warc"), archive_bytes=4 << 10)
    assert index.select("archive").distinct().count() > 1
    got = W.read_records(index.filter("page_id in (3, 150)")).collect()
    assert {r["page_id"]: (r["url"], r["record_type"], bytes(r["payload"]).decode()) for r in got} == {
        3: ("http://h/3", "response", "<p>page 3</p>" * 20), 150: ("http://h/150", "revisit", ""),
    }


def test_one_payload_of_most_pages(spark):
    df = spark.range(100_000).selectExpr("id + 10 as page_id", "'u' as url", "case when id % 3 < 2 then '' when id % 3 = 2 then concat('p', id) end as html")
    rows = W.with_revisits(df)
    assert rows.filter("refers_to = 10").count() == rows.filter("octet_length(payload) = 0").count() - 1
    assert rows.filter("refers_to is not null and refers_to <> 10").count() == 0 and rows.count() == 100_000
