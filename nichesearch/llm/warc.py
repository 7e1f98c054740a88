"""Web archives (WARC 1.1) with a two-level capture index.

``write`` makes an archive of pages: gzipped files of one member a record, each a response
or, where its payload was seen, a revisit of the response that has it. Captures are sorted by
the reversed-host key of their URL (``com,example,www)/path``) and cut to blocks of
``BLOCK_LINES`` lines, which are compressed one by one into index files, a file a range of keys. Each
index file ends with its directory, the first key and the place of every block; a table of
index files with their first and last keys stands over them.

``lookup`` finds a key by binary search among index files, then in a directory, and ranges of
bytes are read from there on: the directory's, the block's, and, in ``read``, the record's,
neighbouring records in one request. Blocks and stretches of archives are dealt to tasks, so
that a key which holds a third of all captures is read by many. Files are written by tasks
under names of their own and count once a table names them, which Spark commits with the
task: what lost or repeated attempts leave is never read. Paths are opened by
``pyarrow.fs`` (local folders, HDFS, S3, GCS).

Defined cases: a null payload is empty; null URLs have the key ""; a null page_id is the
smallest, and copies whose ids are all null are all responses; rows that repeat a page_id and
payload are each written, all as what the first one is; payloads under ``LEAST`` bytes are all
responses; a payload of any length is one record; an empty table makes an archive without
files; other columns are ignored; a damaged record raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes from which on equal payloads are written once.
LEAST = 1000
#: Lines of an index block; bytes after which an archive file ends; bytes of an archive that a task reads, and that one request asks for.
BLOCK_LINES, FILE_BYTES, STRETCH, REQUEST = 1024, 1 << 30, 64 << 20, 4 << 20
#: The tables hold no time of capture; records carry this one unless told otherwise.
DATE = "2000-01-01T00:00:00Z"
#: Fixed value of the format: the profile of a record that repeats a payload.
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://|//)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^#]*)"
_CAPTURES = "key string, page_id long, file string, offset long, length long"
_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_url string"


def clean(url: Column) -> Column:
    """Spaces and control characters, which no header may hold, percent-encoded."""
    coded = url
    for c in (*range(33), 127):
        coded = F.replace(coded, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), coded).otherwise(url)


def surt(url: Column) -> Column:
    """The key of a URL, cleaned: host labels reversed and in lower case, path and query; no scheme, user, usual port or fragment."""
    url = clean(url)
    host = F.rtrim(F.lower(F.regexp_extract(url, _URL, 1)), F.lit("."))
    port, rest = F.regexp_extract(url, _URL, 2), F.regexp_extract(url, _URL, 3)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), rest), F.lit(""))


def _at(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


class _File:
    """A new file of a task's, with the place of its end."""

    def __init__(self, folder: str, suffix: str):
        fs, path = _at(folder)
        fs.create_dir(path, recursive=True)
        self.name, self.size = f"{uuid.uuid4().hex}{suffix}", 0
        self._out = fs.open_output_stream(f"{path}/{self.name}", compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        """Where ``data`` went: offset and length."""
        self._out.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)

    def close(self) -> None:
        self._out.close()


def _ranges(folder: str) -> Callable[[str, int, int], bytes]:
    """A reader of ranges of files in ``folder``; it holds the last file open."""
    fs, path = _at(folder)
    held: dict[str, Any] = {}

    def read(name: str, offset: int, length: int) -> bytes:
        if name not in held:
            for f in held.values():
                f.close()
            held.clear()
            held[name] = fs.open_input_file(f"{path}/{name}")
        data = held[name].read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{name} ends before {offset + length}")
        return data

    return read


# --- records


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member; headers without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}"]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def _page(page_id: int | None, url: str | None, payload: bytes, digest: str, response: dict | None, date: str) -> bytes:
    """A response, or a revisit of ``response``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    stated = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    headers: list[tuple[str, str | None]] = [("WARC-Record-ID", _name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", stated), ("Content-Type", "application/http;msgtype=response")]
    if response is None:
        return record("response", headers, head + payload)
    headers += [("WARC-Profile", _SAME), ("WARC-Refers-To", _name(response["page_id"])), ("WARC-Refers-To-Target-URI", response["url"])]
    return record("revisit", headers, head)


def _id(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse(member: bytes) -> dict:
    """A record of ``_RECORDS``, with its payload; ValueError where it is damaged."""
    try:
        head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    except zlib.error as e:
        raise ValueError(f"a damaged record: {e}") from e
    first, *lines = head.decode().split("\r\n")
    h = dict(line.split(": ", 1) for line in lines)
    size = int(h.get("Content-Length", -1))
    if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("a damaged record: its length is not the stated one")
    _, _, payload = rest[:size].partition(b"\r\n\r\n")
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    whole = h["WARC-Type"] == "response"
    if whole and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a damaged record: its payload has another digest")
    return {
        "page_id": _id(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "record_type": h["WARC-Type"], "payload_bytes": len(payload) if whole else None, "payload_digest": digest,
        "refers_to": _id(h.get("WARC-Refers-To")), "refers_to_url": h.get("WARC-Refers-To-Target-URI"), "payload": payload if whole else None,
    }


# --- writing


def _with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, response): the response of a revisit, else null. Only digests are grouped; a payload stays where it is unless copied payloads are too many to broadcast."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), clean(F.col("url").cast("string")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "second": F.sha2("payload", 256)})
    large = rows.filter(F.octet_length("payload") >= LEAST)
    copies = large.groupBy("digest", "second").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("response")).filter("n > 1 and response.page_id is not null").drop("n")
    rows = rows.join(common.few(common.written(copies, "warc-copies")), ["digest", "second"], "left")
    other = ~F.col("page_id").eqNullSafe(F.col("response.page_id"))
    return rows.select("page_id", "url", "payload", "digest", F.when(F.col("response").isNotNull() & other, F.col("response")).alias("response"))


def write(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """An archive of every row of ``pages`` (page_id, url, html) in a new ``folder``: ``archive``, ``index`` and the table ``shards``."""
    common.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _File | None = None
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                if out is None or out.size >= FILE_BYTES:
                    if out:
                        out.close()
                    out = _File(f"{folder}/archive", ".warc.gz")
                    out.add(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(out.name[:32])}>"), ("WARC-Date", date), ("WARC-Filename", out.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                made.append((r["key"], r["page_id"], out.name, *out.add(_page(r["page_id"], r["url"], r["payload"], r["digest"], r["response"], date))))
            yield _batch(made, _CAPTURES)
        if out:
            out.close()

    rows = _with_roles(pages).withColumn("key", surt(F.col("url")))
    captures = common.written(rows.mapInArrow(run, _CAPTURES), "warc-captures")
    _index(captures, folder)
    common.discard(pages.sparkSession, captures)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


_SHARDS = "file string, first string, last string, blocks long, lines long"
#: The end of an index file: place and length of its directory.
_FOOT = ">QQ"


def _index(captures: DataFrame, folder: str) -> None:
    """Index files, a range of keys each, and the table of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, directory, n, first, last = None, [], [], 0, "", ""

        def end_block() -> None:
            place = out.add(zlib.compress("\n".join(map(json.dumps, lines)).encode()))
            directory.append((lines[0][0], *place))
            lines.clear()

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True):
                if out is None:
                    out, first = _File(f"{folder}/index", ".idx"), line[0]
                lines.append(line)
                n, last = n + 1, line[0]
                if len(lines) == BLOCK_LINES:
                    end_block()
        if out:
            if lines:
                end_block()
            out.add(struct.pack(_FOOT, *out.add(zlib.compress(json.dumps(directory).encode()))))
            out.close()
            yield _batch([(out.name, first, last, len(directory), n)], _SHARDS)

    order = ["key", "page_id", "file", "offset"]
    captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _SHARDS).write.parquet(f"{folder}/shards")


# --- reading


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(key, page_id, file, offset, length) of all captures of each of ``keys`` (key); a key counts once, unknown ones have none.

    The driver holds a row an index file; directories are read by the tasks that need them.
    """
    common.small_batches(spark)
    shards = sorted(map(tuple, spark.read.schema(_SHARDS).parquet(f"{folder}/shards").select("first", "last", "file").collect()))
    firsts, lasts = [s[0] for s in shards], [s[1] for s in shards]
    place = "key string, file string, offset long, length long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _at(f"{folder}/index")

        @lru_cache(maxsize=4)
        def directory(name: str) -> tuple[list[str], list[tuple[int, int]]]:
            with fs.open_input_file(f"{path}/{name}") as f:
                offset, length = struct.unpack(_FOOT, f.read_at(size := struct.calcsize(_FOOT), f.size() - size))
                entries = json.loads(zlib.decompress(f.read_at(length, offset)))
            return [e[0] for e in entries], [(e[1], e[2]) for e in entries]

        for batch in batches:
            found = []
            for key in batch.column("key").to_pylist():
                for s in shards[bisect_left(lasts, key) : bisect_right(firsts, key)]:
                    keys, places = directory(s[2])
                    # the block before the first that begins with the key may end with it
                    found += [(key, s[2], *p) for p in places[max(0, bisect_left(keys, key) - 1) : bisect_right(keys, key)]]
            yield _batch(found, place)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, held, lines, own = _ranges(f"{folder}/index"), None, [], []
        for batch in batches:
            found = []
            for key, name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != (name, offset):
                    held, lines = (name, offset), [json.loads(x) for x in zlib.decompress(read(name, offset, length)).split(b"\n")]
                    own = [x[0] for x in lines]
                found += map(tuple, lines[bisect_left(own, key) : bisect_right(own, key)])
            yield _batch(found, _CAPTURES)

    wanted = keys.select("key").filter("key is not null").distinct()
    blocks = wanted.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(search, place)
    return blocks.repartition("file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(match, _CAPTURES)


def read(spark: SparkSession, folder: str, captures: DataFrame, payloads: bool = False) -> DataFrame:
    """A row of ``_RECORDS`` for each of ``captures`` (file, offset, length), and its payload if wanted; revisits have no payload, and its bytes are null."""
    common.small_batches(spark)
    schema = _RECORDS + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request = _ranges(f"{folder}/archive")
        for batch in batches:
            found, size, group = [], 0, []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (r[:2] != (group[-1][0], sum(group[-1][1:])) or sum(r[1:]) - group[0][1] > REQUEST):
                    for x in _records(request, group):
                        found.append(tuple(x[n] for n in names))
                        size += len(x["payload"] or b"") if payloads else 0
                    group = []
                    if size >= common.BATCH_BYTES:
                        yield _batch(found, schema)
                        found, size = [], 0
                group.append(r)
            found += [tuple(x[n] for n in names) for x in _records(request, group)]
            yield _batch(found, schema)

    stretch = F.floor(F.col("offset") / STRETCH).cast("long").alias("stretch")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, or captures would be joined to few tasks for their small rows
    return captures.select("file", "offset", "length", stretch).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch").mapInArrow(run, schema)


def _records(request: Callable, group: list[tuple]) -> Iterator[dict]:
    """The records of neighbouring captures, asked for together."""
    if not group:
        return
    begin = group[0][1]
    data = request(group[0][0], begin, sum(group[-1][1:]) - begin)
    for _, offset, length in group:
        yield parse(data[offset - begin : offset - begin + length])


def fetch(spark: SparkSession, folder: str, urls: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of each of ``urls`` (url), revisits with the bytes (and payload) of the response that they refer to, found through the index as well."""
    found = common.written(read(spark, folder, lookup(spark, folder, urls.select(surt(F.col("url")).alias("key"))), payloads), "warc-records")
    targets = found.filter("record_type = 'revisit'").select(surt(F.col("refers_to_url")).alias("key"))
    more = ["payload_bytes", "payload"][: 1 + payloads]
    responses = read(spark, folder, lookup(spark, folder, targets), payloads).filter("record_type = 'response'")
    needed = found.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    responses = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", *[F.col(c).alias(f"_{c}") for c in more]).dropDuplicates(["refers_to", "payload_digest"]).join(needed, ["refers_to", "payload_digest"], "left_semi")
    known = common.written(responses, "warc-responses")
    known = known.hint("shuffle_hash") if payloads else common.few(known)
    rows = found.join(known, ["refers_to", "payload_digest"], "left").withColumns({c: F.coalesce(c, f"_{c}") for c in more})
    return rows.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *more[1:])


#: DuckDB: the same rows from the table itself.
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, CASE WHEN n >= {LEAST} THEN max(page_id) OVER (PARTITION BY html) END AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM r"""
