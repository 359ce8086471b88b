import base64
import hashlib
import heapq
import random

from pyspark.sql import functions as F

from colscope.llm.warc import archived_pages, base32, capture_histories, capture_runs, merge_runs, parse, url_key, write_archives


def test_loser_tree_equals_a_sort():
    pick = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(pick.randint(0, 20) for _ in range(pick.randint(0, 12))) for _ in range(k)]
        assert list(merge_runs([iter(r) for r in runs], lambda x: x)) == list(heapq.merge(*runs))


def test_base32(spark):
    texts = ["", "a", "é😀"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", base32(F.sha1("t")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in rows)


def test_url_keys():
    assert url_key("http://www.Example.org/A?b=1#c") == "org,example,www)/A?b=1"
    assert url_key("http://a.b") == "b,a)" and url_key("") == ")"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string, name int, id string")


def test_records_and_revisits(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\u00e9\U0001f600"
    rows = [(1, "http://b.org/1", "same", None, 1, "x"), (2, "http://a.org/2", "same", None, 1, "x"),
            (3, "http://a.org/\r\n3", tricky, "s", None, None), (4, None, None, None, None, None), (5, "http://c.org/", "", None, 1, "x"),
            (None, "http://b.org/1", "same", None, 1, "x"), (2, "http://a.org/2", "same", None, 1, "x"), (6, "u", "x" * 300_000, None, 1, "x")]
    found = archived_pages(pages(spark, rows)).collect()
    key = [(r.urlkey, r.date, r.id is not None, r.id or "") for r in found]
    assert key == sorted(key)
    got = sorted((int(r.id or 0), r.type, int(r.refers_to or 0), r.payload_bytes) for r in found)
    assert got == [(0, "revisit", 2, 4), (1, "revisit", 2, 4), (2, "response", 0, 4), (2, "response", 0, 4),
                   (3, "response", 0, len(tricky.encode())), (4, "revisit", 5, 0), (5, "response", 0, 0), (6, "response", 0, 300_000)]
    digest = {int(r.id or 0): r.payload_digest for r in found}
    assert digest[3] == base64.b32encode(hashlib.sha1(tricky.encode()).digest()).decode() and digest[0] == digest[1] == digest[2]
    small = archived_pages(pages(spark, rows), least=5).collect()
    assert {r.type for r in small} == {"response"}


def test_archives_hold_their_payloads(spark, tmp_path):
    import glob
    import gzip

    write_archives(pages(spark, [(i, f"http://h{i % 7}.org/{i}", f"<p>{i}</p>", None, None, None) for i in range(50)]), f"{tmp_path}/w",
                   archive_bytes=4000)
    bodies = {}
    for path in glob.glob(f"{tmp_path}/w/part-*"):
        for _, fields, block in parse(gzip.open(path).read()):
            bodies[fields["WARC-Record-ID"]] = block.partition(b"\r\n\r\n")[2].decode()
    assert bodies == {f"<urn:page:{i}>": f"<p>{i}</p>" for i in range(50)}


def test_histories_are_in_global_order(spark, tmp_path):
    hot = [(i, "http://hot.org/" if i % 3 == 0 else f"http://h{i % 11}.org/{i % 5}", f"b{i}", None, None, None) for i in range(600)]
    write_archives(pages(spark, hot), f"{tmp_path}/w", archive_bytes=20_000)
    rows = capture_histories(capture_runs(spark, f"{tmp_path}/w"), per_range=40).collect()
    key = [(r.urlkey, r.date, r.id) for r in rows]
    assert len(key) == 600 and key == sorted(key)


def test_no_pages(spark):
    assert archived_pages(pages(spark, [])).count() == 0
