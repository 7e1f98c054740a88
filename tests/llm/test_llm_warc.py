import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from nichesearch.llm import common, warc

PAGES = "page_id long, url string, html string, file string, key string, digest string, payload string"


def page(page_id, url, html):
    return (page_id, url, html, "f", "k", "d", "p")


def brute(rows):
    found = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if r[2] == html and r[0] is not None]
        top = max(same) if len(data) >= warc.LEAST and same else page_id
        found.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if top == page_id else "revisit", None if top == page_id else top))
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    body = lambda n: "<p>" + "".join(rng.choices("abcdefg é\r\n", k=n)) + "</p>"
    pages = [page(i, f"http://h{i % 7}.example.com/{i}?q={i % 3}#x", body(rng.randint(0, 3000))) for i in range(60)]
    large, small = body(2000), body(100)
    pages += [page(100 + i, "https://hot.example.org/", large) for i in range(20)] + [page(130 + i, "https://hot.example.org/", small) for i in range(5)]
    edge = "x" * warc.LEAST
    pages += [page(140, None, None), page(141, "", ""), page(142, "http://u:p@Host.COM:8080?x\ty \r\nz", large), page(143, "http://h1.example.com/1?q=1", edge), page(144, "b", edge), page(145, "c", edge[1:]), page(146, "d", edge[1:])]
    pages += [page(None, "http://n.example/", large), page(None, "http://n.example/", "y" * 1500), page(None, "http://n.example/2", "y" * 1500), page(147, "http://long.example/", body(3_000_000))]
    pages += [page(148, "http://r.example/", "r" * 1200)] * 2 + [page(149, "http://w.example/", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 60)]
    return pages


@pytest.fixture(scope="module")
def archive(spark, rows):
    folder = common.shared_path(spark, "warc")
    with pytest.MonkeyPatch.context() as m:  # many blocks and stretches
        m.setattr(warc, "BLOCK_LINES", 4)
        m.setattr(warc, "FILE_BYTES", 30_000)
        warc.write(spark.createDataFrame(rows, PAGES).repartition(3), folder)
    return folder


def tuples(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_all_pages_come_back_through_the_index(spark, rows, archive, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 5000)
    monkeypatch.setattr(warc, "REQUEST", 4000)
    assert tuples(warc.fetch(spark, archive, spark.createDataFrame(rows, PAGES).select("url"))) == brute(rows)


def test_payloads_of_revisits_are_those_of_their_responses(spark, rows, archive):
    urls = spark.createDataFrame([("HTTPS://hot.example.org:443/#frag",), ("http://nowhere.example/",)], "url string")
    found = warc.fetch(spark, archive, urls, payloads=True).collect()
    wanted = {r[0]: r[2] for r in rows if r[1] == "https://hot.example.org/"}
    assert {r["page_id"]: r["payload"].decode() for r in found} == wanted
    assert len([r for r in found if r["record_type"] == "revisit"]) == 20  # the response is page 142, of another URL


def test_an_index_block_is_found_by_search_alone(spark, rows, archive):
    keys = spark.createDataFrame([("org,example,hot)/",), ("org,example,hot)/",), ("zz",), (None,)], "key string")
    found = warc.lookup(spark, archive, keys)
    assert found.count() == 25  # over seven blocks at least
    shards = spark.read.parquet(f"{archive}/shards")
    assert shards.agg(F.sum("lines")).first()[0] == len(rows)
    assert shards.agg(F.sum("blocks")).first()[0] >= len(rows) / 4


def test_files_are_plain_archives(spark, rows, archive):
    files = spark.read.format("binaryFile").load(f"{archive}/archive/*.warc.gz").collect()
    assert len(files) > 3
    kinds = []
    for f in files:
        data = io.BytesIO(gzip.decompress(bytes(f["content"])))
        while line := data.readline():
            assert line == b"WARC/1.1\r\n"
            head = dict(x.split(": ", 1) for x in iter(lambda: data.readline().decode().rstrip("\r\n"), ""))
            data.read(int(head["Content-Length"]))
            assert data.read(4) == b"\r\n\r\n"
            kinds.append(head["WARC-Type"])
    assert kinds.count("warcinfo") == len(files) and len(kinds) == len(rows) + len(files)


def test_keys_reverse_the_host(spark):
    cases = {"http://www.Example.com/A?b=1#c": "com,example,www)/A?b=1", "//a.b:80": "b,a)/", "https://u:p@a.b:8443?x": "b,a:8443)/?x", "a.b./c": "b,a)/c", "": ")/", None: ""}
    rows = spark.createDataFrame([(k,) for k in cases], "url string").select("url", warc.surt(F.col("url")).alias("key")).collect()
    assert {r["url"]: r["key"] for r in rows} == cases


def test_damage_is_seen():
    member = warc._page(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, warc.DATE)
    assert warc.parse(member)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(warc._page(1, "u", b"payload", hashlib.sha1(b"other").hexdigest(), None, warc.DATE))
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(member[:30] + bytes([member[30] ^ 255]) + member[31:])
    with pytest.raises(ValueError, match="length"):
        warc.parse(zlib.compress(zlib.decompress(member, 31)[:-3], wbits=31))


def test_an_empty_table_makes_an_empty_archive(spark):
    folder = common.shared_path(spark, "warc")
    none = spark.createDataFrame([], PAGES)
    warc.write(none, folder)
    assert warc.fetch(spark, folder, none.select("url")).count() == 0
    assert warc.fetch(spark, folder, spark.createDataFrame([("a",)], "url string"), payloads=True).count() == 0


def test_a_lost_attempt_leaves_nothing_that_is_read(spark, rows):
    folder = common.shared_path(spark, "warc")
    warc.write(spark.createDataFrame(rows[:10], PAGES), folder)
    stray = warc._File(f"{folder}/archive", ".warc.gz")
    stray.add(b"half a rec")
    stray.close()
    assert tuples(warc.fetch(spark, folder, spark.createDataFrame(rows[:10], PAGES).select("url"))) == brute(rows[:10])
