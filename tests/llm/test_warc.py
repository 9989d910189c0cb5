import gzip
import hashlib

import pytest

from colonnade.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (5, "http://www.example.com/a?b=1#top", "<p>same</p>"), (3, "http://www.example.com/a?b=1", "<p>same</p>"), (9, "https://example.org", "<p>same</p>"),
    (1, None, None), (2, "", ""), (4, "http://x.y/\r\nWARC-Type: evil", "é\U0001f600" * 50_000), (None, "http://n.n/", "<p>same</p>"), (7, "http://z.z/", "own"),
    (7, "http://z.z/", "own"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, PAGES).withColumn("size", warc.F.lit(1)).withColumn("key", warc.F.lit("k")).repartition(3)


def test_records_round_trip_through_index_and_ranges(spark):
    archive = warc.index(spark, warc.write(pages(spark)), block_lines=2)
    captures = warc.lookup(archive, pages(spark).select("url"))
    got = warc.fetch(archive, captures).collect()
    assert len(got) == len(ROWS)
    smallest = {"<p>same</p>": 3, "": 1, "own": 7}
    for r in got:
        html = next(h or "" for i, _, h in ROWS if i == r.page_id)
        raw = html.encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == warc.digest_of(raw)
        first = smallest.get(html, r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.html == (html if r.record_type == "response" else None)
    digest = hashlib.sha1(b"<p>same</p>").digest()
    assert warc.base64.b32encode(digest).decode() in {r.payload_digest for r in got}


def test_archives_are_plain_gzip_and_single_ranges_read(spark):
    path = warc.write(pages(spark))
    archive = warc.index(spark, path)
    files = [r.content for r in warc._files(spark, path).collect()]
    text = b"".join(gzip.decompress(bytes(f)) for f in files if f)
    assert text.count(b"WARC/1.1\r\n") == len(ROWS)
    one = warc.lookup(archive, spark.createDataFrame([("http://z.z/",)], "url string")).first()
    record = warc.read_range(spark, one.file, one.offset, one.length)
    assert record["page_id"] == 7 and record["html"] == "own"


def test_lookup_finds_only_what_is_asked(spark):
    archive = warc.index(spark, warc.write(pages(spark)), block_lines=1)
    asked = spark.createDataFrame([("http://WWW.example.com:80/a?b=1",), ("http://none.example/",), (None,)], "url string")
    for most in (warc.DIRECTORY_ROWS, 0):
        found = warc.lookup(archive, asked, directory_rows=most).collect()
        assert sorted(r.page_id for r in found) == [1, 2, 3, 5]
    assert warc.lookup(archive, asked.limit(0)).count() == 0


def test_small_payloads_never_revisit(spark):
    archive = warc.index(spark, warc.write(pages(spark), min_revisit_bytes=5))
    kinds = {(r.payload_bytes, r.record_type) for r in warc.lookup(archive, pages(spark).select("url")).collect()}
    assert kinds == {(0, "response"), (3, "response"), (11, "response"), (11, "revisit"), (300_000, "response")}


def test_empty_table(spark):
    none = pages(spark).limit(0)
    archive = warc.index(spark, warc.write(none))
    assert warc.fetch(archive, warc.lookup(archive, none.select("url"))).count() == 0


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.com/a?b#c", "com,example,www)/a?b"), ("https://u:p@h.org:8080", "org,h)/"), ("h.org/x", "org,h)/x"), ("", ")/"), ("//a.b/\n", "b,a)/%0A"),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_damage_is_noticed():
    good = warc.record_of(1, "http://a/", b"payload", None)
    raw = gzip.decompress(good)
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload", b"pavload"))
    with pytest.raises(ValueError):
        list(warc.members(good[:-5]))
