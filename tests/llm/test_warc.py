import hashlib

import pytest

from siltstone.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "é" * 60
ROWS = [
    (5, "http://b.example.com/x", BIG, "d"),
    (3, "http://a.example.com:8080/?q=1 2", BIG, None),
    (9, "http://b.example.com/x", BIG, None),
    (1, None, None, None),
    (2, "not a url\r\nX: y", "short", None),
    (4, "", "short", None),
    (None, "http://[broken", BIG, None),
    (7, "http://b.example.com/x", "z" * 300_000, None),
    (8, "http://b.example.com/x", "WARC/1.1\r\n\r\n" * 20, None),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    captures = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), f"{folder}/archives")
    return captures, warc.write_index(captures, f"{folder}/index", lines_a_block=2)


def test_read_back(store):
    captures, parts = store
    got = {r.page_id: r for r in warc.read_records(warc.read_index(parts)).collect()}
    assert len(got) == len(ROWS)
    for page_id, _, html, _ in ROWS:
        payload, r = (html or "").encode(), got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        again = page_id in (5, 9)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
        assert r.payload == (None if again else payload)


def test_lookup(spark, store):
    _, parts = store
    find = lambda *urls: sorted(r.page_id for r in warc.lookup(parts, spark.createDataFrame([(u,) for u in urls], "url string")).collect())
    assert find("http://b.example.com/x") == [5, 7, 8, 9]
    assert find("HTTP://A.example.com:8080/?q=1 2") == [3]
    assert find("http://nowhere.example/", "http://zzz.zzz/") == []
    assert find("") == [1, 4]  # a null URL is `-`, and so is an empty one


def test_surt():
    assert warc.surt("http://www.Example.com:80/a?b") == "com,example,www)/a?b"
    assert " " not in warc.surt("http://x.y/a b") and warc.surt(None) == "-"


def test_empty(spark, tmp_path):
    captures = warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    parts = warc.write_index(captures, str(tmp_path / "i"))
    assert warc.read_records(warc.read_index(parts)).count() == 0


def test_damage(store):
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")


def test_schemes():
    assert warc._filesystem("file:///tmp/x")[1] == warc._filesystem("file:/tmp/x")[1] == warc._filesystem("/tmp/x")[1] == "/tmp/x"
    try:
        system, path = warc._filesystem("s3a://bucket/a/b")
    except OSError:  # no settings for S3 here
        return
    assert system.type_name == "s3" and path == "bucket/a/b"


def test_rows_that_share_an_id(spark, tmp_path):
    """Only the payload that is there twice is revisited, and every record has an id of its own."""
    rows = [(1, "http://x.y/a", BIG, None), (2, "http://x.y/b", BIG, None), (2, "http://x.y/b", "other" * 30, None), (2, "http://x.y/b", BIG, None)]
    captures = warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"))
    parts = warc.write_index(captures, str(tmp_path / "i"))
    got = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.read_records(warc.lookup(parts, spark.createDataFrame(rows, SCHEMA))).collect())
    assert got == [(1, "response", 0, 120), (2, "response", 0, 150), (2, "revisit", 1, 120), (2, "revisit", 1, 120)]


def test_lookup_of_many_keys_equals_reading_all(spark, tmp_path):
    rows = [(k, f"http://h{k % 97}.example/{k % 7}", f"page {k}", None) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = warc.write_index(warc.write_archives(df, str(tmp_path / "a")), str(tmp_path / "i"), lines_a_block=7)
    plain = lambda x: sorted((r.key, r.page_id, r.file, r.offset) for r in x.collect())
    assert plain(warc.lookup(parts, df)) == plain(warc.read_index(parts))
    some = {f"http://h{k}.example/{k}" for k in range(9)} | {"http://none.example/"}
    got = warc.lookup(parts, spark.createDataFrame([(u,) for u in some] * 2, "url string")).collect()
    assert sorted(r.page_id for r in got) == [k for k, u, *_ in rows if u in some]
