"""WARC archives with a two-level capture index.

`write_archives` writes one gzip member per record into a file per task; of equal payloads of `least` bytes
or more, the one with the smallest id is kept whole and the others are revisit records that name it.
`write_index` sorts the captures by their reversed-host key and writes them as compressed blocks of lines,
with a sparse directory of the blocks' first keys. `lookup` sorts the keys asked for, bisects the list of
index parts, then the directory of a part, and range-reads the blocks, each once for neighbouring keys.
`read_records` range-reads the records; `read_index` reads all captures without a search.

Every file has a name of its own for each attempt of a task, and only files that a finished task returned
are ever read, so tasks may be run again. Null payloads are empty, a null URL is `-`, a null id is kept as
null (such a record is always whole); rows that share an id are records of their own, a revisit only where
id and payload both agree with it. Very long payloads are one member each; ties of key go by id.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.tables import scratch, table, written

CAPTURE = "key string, page_id long, url string, file string, offset long, length long, type string, digest string"
PART = "first string, blocks string, directory string, n long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_ID = "urn:page:"
#: Broadcast the revisits while they are no more than this.
MOST_BROADCAST_ROWS = 500_000


def surt(url: str | None) -> str:
    """`http://www.Example.com:80/a?b` becomes `com,example,www)/a?b`; what has no host is kept as it is."""
    try:
        parts = urlsplit(url or "-")
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return _clean(url)
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return _clean(",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


def _clean(url: str | None) -> str:
    return quote(url or "-", safe="".join(map(chr, range(33, 127))))


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Of a path as Spark has it: `s3a` and `s3n` are S3, `file:/x` is local."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        path = f"s3:{rest}"
    elif colon and scheme == "file":
        path = "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}:{uuid.uuid4().hex}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; an error if lengths don't agree."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    size = int(warc["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {warc.get('WARC-Record-ID')} isn't of the length it states")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, folder: str, least: int = 100, level: int = 4, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes (page_id, url, html) below folder; the captures as a written table."""
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    small = p.select("page_id", F.sha2("payload", 256).alias("digest")).where(F.octet_length("payload") >= least)
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    first = first.where("refers_to != last").drop("last")
    again = written(small.join(first, "digest").where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct())
    n = again.count()
    if n == 0:
        p = p.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        p = p.withColumn("digest", F.sha2("payload", 256))
        p = p.join(F.broadcast(again) if n <= MOST_BROADCAST_ROWS else again.hint("shuffle_hash"), ["page_id", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        name, out, at = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, payload, refers_to in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                digest = hashlib.sha256(payload).hexdigest()
                # a payload below `least` may share an id with a longer one
                record = _record(page_id, url, payload, digest, refers_to if len(payload) >= least else None, date)
                member = zlib.compress(record, level, 31)
                out.write(member)
                rows.append((surt(url), page_id, _clean(url), name, at, len(member), "response" if refers_to is None or len(payload) < least else "revisit", digest))
                at += len(member)
            if out is not None:
                out.flush()
            yield _batch(rows, CAPTURE)
        if out is not None:
            out.close()

    return written(p.select("page_id", "url", "payload", "refers_to").mapInArrow(write, CAPTURE))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def write_index(captures: DataFrame, folder: str, lines_a_block: int = 1000) -> DataFrame:
    """Sorted captures as blocks of lines below folder; one row for each part, as a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        name, at, n, first, lines, directory, out = f"{root}/{uuid.uuid4().hex}", 0, 0, None, [], [], None

        def block() -> None:
            nonlocal at, lines
            member = zlib.compress("".join(lines).encode(), 6, 31)
            out.write(member)
            directory.append(f"{lines[0].split(' ', 1)[0]} {at} {len(member)}\n")
            at += len(member)
            lines = []

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(root, recursive=True)
                    out, first = system.open_output_stream(name + ".cdx.gz", compression=None), row["key"]
                lines.append(f"{row['key']} {json.dumps({k: v for k, v in row.items() if k != 'key'})}\n")
                n += 1
                if len(lines) == lines_a_block:
                    block()
        if lines:
            block()
        if out is not None:
            out.close()
            with system.open_output_stream(name + ".dir") as f:
                f.write("".join(directory).encode())
            yield _batch([(first, name + ".cdx.gz", name + ".dir", n)], PART)

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return written(ordered.mapInArrow(write, PART))


def _blocks(system: fs.FileSystem, part: dict) -> list[tuple[str, int, int]]:
    with system.open_input_stream(part["directory"]) as f:
        return [(k, int(a), int(b)) for k, a, b in (x.split(" ") for x in f.read().decode().splitlines())]


def _lines(f, at: int, size: int) -> Iterator[dict]:
    for line in zlib.decompress(f.read_at(size, at), 31).decode().splitlines():
        key, _, rest = line.partition(" ")
        yield {"key": key} | json.loads(rest)


def read_index(parts: DataFrame) -> DataFrame:
    """All captures, from the blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CAPTURE.split(", ")]
        for batch in batches:
            for part in batch.to_pylist():
                system, _ = _filesystem(part["blocks"])
                with system.open_input_file(part["blocks"]) as f:
                    for _, at, size in _blocks(system, part):
                        yield _batch([tuple(x[n] for n in names) for x in _lines(f, at, size)], CAPTURE)

    return parts.mapInArrow(read, CAPTURE)


def read_records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that captures point at, each file in order of offset; an error if a payload isn't what its digest says."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            rows, held = [], 0
            for c in batch.to_pylist():
                if c["file"] != opened:
                    if f is not None:
                        f.close()
                    opened, f = c["file"], _filesystem(c["file"])[0].open_input_file(c["file"])
                rows.append(_read(f, c, payloads))
                held += len(rows[-1][-1] or b"")
                if held > 8 << 20:
                    yield _batch(rows, RECORD)
                    rows, held = [], 0
            yield _batch(rows, RECORD)
        if f is not None:
            f.close()

    near = captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(read, RECORD)


def _read(f, capture: dict, payloads: bool) -> tuple:
    warc, http, payload = parse(zlib.decompress(f.read_at(capture["length"], capture["offset"]), 31))
    own, digest = warc["WARC-Record-ID"][len(_ID) + 1 : -1].partition(":")[0], warc["WARC-Payload-Digest"].removeprefix("sha256:")
    whole = warc["WARC-Type"] == "response"
    if whole and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"record {own}: its payload isn't what its headers say")
    refers = None if whole else int(warc["WARC-Refers-To"][len(_ID) + 1 : -1])
    return (int(own) if own else None, warc["WARC-Target-URI"], warc["WARC-Type"], refers, int(http["Content-Length"]), digest, payload if whole and payloads else None)


class _Index:
    """Parts of an index, opened as they are asked for in order of keys; one part and one block are held."""

    def __init__(self, parts: list[dict]) -> None:
        self.parts, self.starts = parts, [p["first"] for p in parts]
        self.part, self.file, self.blocks, self.firsts, self.block, self.lines = -1, None, [], [], -1, {}

    def _open(self, k: int) -> None:
        if k != self.part:
            self.close()
            system, _ = _filesystem(self.parts[k]["blocks"])
            self.part, self.file, self.blocks, self.block = k, system.open_input_file(self.parts[k]["blocks"]), _blocks(system, self.parts[k]), -1
            self.firsts = [b[0] for b in self.blocks]

    def _read(self, j: int) -> dict[str, list[dict]]:
        if j != self.block:
            self.block, self.lines = j, {}
            for x in _lines(self.file, *self.blocks[j][1:]):
                self.lines.setdefault(x["key"], []).append(x)
        return self.lines

    def find(self, key: str) -> Iterator[dict]:
        k = max(0, bisect.bisect_left(self.starts, key) - 1)
        while k < len(self.parts) and self.starts[k] <= key:
            self._open(k)
            j = max(0, bisect.bisect_left(self.firsts, key) - 1)
            while j < len(self.blocks) and self.firsts[j] <= key:
                yield from self._read(j).get(key, ())
                j += 1
            k += 1

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def lookup(parts: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """The captures of the URLs asked for, those of each key once.

    Keys are brought into order by ranges, so a task asks few parts, and each block once. Only the list of
    parts, which has a row for each task that wrote the index, goes to the executors.
    """
    firsts = sorted((r.asDict() for r in parts.collect()), key=lambda r: r["first"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({surt(u) for u in batch.column(0).to_pylist()}), pa.string())], ["key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CAPTURE.split(", ")]
        index = _Index(firsts)
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for x in index.find(key):
                    rows.append(tuple(x[n] for n in names))
                    if len(rows) == 10_000:
                        yield _batch(rows, CAPTURE)
                        rows = []
            yield _batch(rows, CAPTURE)
        index.close()

    asked = urls.select(F.col(url).cast("string").alias("url")).mapInArrow(keys, "key string").distinct()
    return asked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(find, CAPTURE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: writes all pages as WARC records with their index, then looks every page's URL up in it and reads its records back."""
    folder = scratch(spark)
    pages = table(spark, sf_dir, "pages")
    parts = write_index(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    return read_records(lookup(parts, pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
