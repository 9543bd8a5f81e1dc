import gzip
import hashlib

from pyarrow import fs

from dyadscope.llm import warc

ROWS = [
    (5, "https://www.Example.org:8080/a?b=1#f", "<p>one</p>", 1), (3, "http://example.org/", "<p>one</p>", 1), (3, "http://example.org/", "<p>one</p>", 1),
    (9, None, None, 1), (4, "http://b.example.org/x y\r\nz", "", 1), (7, "no scheme", "ünï" * 5000, 1), (None, "http://c.d/", "<p>one</p>", None), (8, "http://b.example.org/x", "<p>two</p>", 2),
]


def _pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, key int")


def test_round_trip_and_revisits(spark):
    archive = warc.write_archive(_pages(spark), block_lines=2)
    rows = warc.lookup(archive, warc.keys_of(_pages(spark)), with_payload=True).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        html = next(h or "" for p, u, h, _ in ROWS if p == r["page_id"])
        assert r["payload_bytes"] == len(html.encode()) and warc.base32_sha1(html.encode()) == r["payload_digest"]
        assert r["payload"] == (html.encode() if r["record_type"] == "response" else b"")
    told = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in rows)
    assert told == [("3", "response", None), ("3", "response", None), ("4", "response", None), ("5", "revisit", 3), ("7", "response", None),
                    ("8", "response", None), ("9", "revisit", 4), ("None", "response", None)]


def test_smaller_payloads_are_all_responses(spark):
    archive = warc.write_archive(_pages(spark), least_bytes=11)
    assert {r["record_type"] for r in warc.lookup(archive, warc.keys_of(_pages(spark))).collect()} == {"response"}


def test_files_are_gzip_members_and_blocks_are_sorted(spark):
    archive = warc.write_archive(_pages(spark), block_lines=2)
    store, root = fs.FileSystem.from_uri(archive.folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".warc.gz")]
    whole = b"".join(gzip.decompress(store.open_input_file(f).read()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS) and whole.count(b"WARC-Type: revisit") == 2
    assert f"sha1:{warc.base32_sha1(b'<p>two</p>')}".encode() in whole and len(hashlib.sha1(b"").digest()) == 20
    assert archive.ranges == sorted(archive.ranges)


def test_lookup_reads_only_what_is_asked_for(spark):
    archive = warc.write_archive(_pages(spark), block_lines=1)
    ask = lambda *k: sorted(str(r["page_id"]) for r in warc.lookup(archive, spark.createDataFrame([(x,) for x in k], "key string")).collect())
    assert ask("org,example)/") == ["3", "3"] and ask("org,example,b)/x") == ["8"] and ask("", "zz") == ["9"] and ask("org,example)/none") == []


def test_many_captures_of_one_key_span_blocks(spark):
    rows = [(i, "http://hot.example.org/", f"<p>{i % 7}</p>", 1) for i in range(300)] + [(1000, "http://a.org/", "x", 1), (1001, "http://z.zz/", "y", 1)]
    archive = warc.write_archive(_pages(spark, rows), block_lines=16)
    found = warc.lookup(archive, warc.keys_of(_pages(spark, rows))).collect()
    assert sorted(r["page_id"] for r in found) == sorted(r[0] for r in rows)
    assert all((r["record_type"] == "revisit") == (7 <= r["page_id"] < 300) for r in found)
    assert all(r["refers_to"] == r["page_id"] % 7 for r in found if r["record_type"] == "revisit")


def test_keys_and_empty_table(spark):
    assert warc.url_key("HTTP://u@Www.A.org:80/P?q#f") == "org,a,www)/P?q" and warc.url_key("http://a.b") == "b,a)/" and warc.url_key(None) == ""
    none = _pages(spark, [])
    assert warc.lookup(warc.write_archive(none), warc.keys_of(none)).count() == 0
