import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graftwork.llm import warc
from graftwork.llm.common import Scratch

PAGES = "page_id bigint, url string, html string, size int, folder string"


def pages():
    inner = warc.record("response", 77, "http://in", b"inner", hashlib.sha1(b"inner").digest(), None).decode()
    big = "y" * 1500
    rows = [(1, "http://a", "plain"), (2, "http://b", inner * 3), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "u", big), (6, "u", big), (6, "u", big), (None, "u", big)]
    rows += [(7, "u", "x" * 999), (8, "u", "x" * 999), (9, "é", "WARC/1.1\r\n" * 400), (10, "u", "\r\n\r\nWARC/1.0\r\nWARC-Type: a\r\nContent-Length: 9999999\r\n\r\n"), (11, "u", "z" * 300_000)]
    rows += [(i, "u", inner + "\r\n\r\n" + "q" * (i % 50)) for i in range(100, 160)]
    return [(*r, 1, "f") for r in rows]


def expected(rows):
    best = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        to = best.get(b)
        to = to if to is not None and to != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return Counter(out)


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), PAGES).repartition(2)
    for block in (500, 1 << 14, 1 << 23):
        got = warc.round_trip(spark, df, file_bytes=1 << 16, block_bytes=block).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(pages()), block
    assert {r.payload.decode() for r in got if r.page_id == 9} == {"WARC/1.1\r\n" * 400}


def test_shuffled_way_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BROADCAST", -1)
    got = warc.round_trip(spark, spark.createDataFrame(pages(), PAGES)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(pages())


def test_magic_inside_payloads_is_a_candidate_but_not_reached(spark):
    scratch = Scratch(spark, "t")
    manifest = warc.write_archives(spark, spark.createDataFrame(pages(), PAGES).coalesce(1), scratch)
    links = scratch.save(warc.link_blocks(manifest, 700), "links")
    reached = warc.reachable(scratch, links)
    assert links.count() > len(pages()) and 1 < reached.count() <= len(pages())


def test_truncated_file_loses_only_its_end(spark, tmp_path):
    data = b"".join(warc.record("response", i, "u", b"p" * 50, hashlib.sha1(b"p" * 50).digest(), None) for i in range(5))
    (tmp_path / "x.warc").write_bytes(data[:-20])
    manifest = spark.createDataFrame([(str(tmp_path), "x.warc", len(data) - 20)], "folder string, file string, size bigint")
    scratch = Scratch(spark, "t")
    got = warc.read_records(warc.reachable(scratch, scratch.save(warc.link_blocks(manifest, 100), "links")))
    assert sorted(r.key for r in got.collect()) == ["0", "1", "2", "3"]


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_urls_longer_than_a_window(spark):
    rows = [(i, "http://h/" + "u" * n, f"page {i}", 1, "f") for i, n in enumerate([5, 70_000, 5, 400_000, 65_536, 5])]
    rows.append((6, "http://h/" + "WARC/1.1" * 20_000, "WARC/1.1\r\na: WARC/1.1\r\n" * 30_000, 1, "f"))
    rows.append((7, "http://h/", "last", 1, "f"))
    df = spark.createDataFrame(rows, PAGES).coalesce(1)
    for block in (30_000, 1 << 23):
        got = warc.round_trip(spark, df, block_bytes=block).collect()
        assert sorted((r.page_id, r.url, r.payload.decode()) for r in got) == [r[:3] for r in rows], block


def test_missing_records_are_an_error(spark):
    scratch = Scratch(spark, "t")
    manifest = warc.write_archives(spark, spark.createDataFrame(pages(), PAGES).coalesce(1), scratch)
    links = scratch.save(warc.link_blocks(manifest, 700), "links")
    reached = warc.reachable(scratch, links)
    warc.verify_counts(manifest, links, reached)
    with pytest.raises(ValueError, match="records were written"):
        warc.verify_counts(manifest.withColumn("records", F.col("records") + 1), links, reached)


def test_keys_of_other_types(spark):
    rows = [("a/b c", "u", "x" * 2000), ("é>", "u", "x" * 2000), (None, "u", "y")]
    got = {r.page_id: r for r in warc.round_trip(spark, spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert set(got) == {"a/b c", "é>", None} and got["a/b c"].refers_to == "é>" and got["é>"].record_type == "response"
