"""WARC archives as a PySpark Python data source, read and written through pyarrow file systems.

Reading plans partitions of about `partitionBytes`: groups of small archive files, and ranges of large .warc.gz files, whose members
(one for each record, as is customary) are found by their gzip and WARC signatures; a record belongs to the range that its
member begins in. Plain .warc files are not split. Record-type and header
predicates are pushed into the reader: as Spark filters on the columns `warc_type`, `record_id`, `target_uri`, `refers_to` and
`payload_digest` (where spark.sql.python.filterPushdown.enabled is true; `register` sets it), and as the options `types` and
`payload`. A record's WARC headers are parsed first; the body of an unwanted record, and any payload when `payload` is false,
is skipped without being split or decoded. Spark evaluates all filters again, so pushing down never changes results.

Writing takes record rows and makes one gzip member per record; each task writes files of its own, of about `rollBytes` (1 GiB by
default, the customary size) under temporary names and the driver's commit renames what succeeded, so lost or repeated tasks
leave nothing in the archive folder that is read.

`page_records` finds equal payloads by their SHA-1 without moving any payload by it: ids and digests meet in small rows, the few
digests that many pages share are broadcast, and the pages are then joined by id and digest, so a page that a third of all
rows hold is no hot key.

Nulls: a null payload is an empty one, a null header is left out. Empty tables give an empty archive, which reads as no rows. A
page without an id neither stores a payload for others nor revisits one. Of equal payloads with equal largest page_ids every row
is a response. Very long payloads are written whole. Columns beside those of the schema play no part.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from factgraph.llm import common

SCHEMA = (
    "warc_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, http_length long, payload binary"
)
#: Column -> WARC header that it comes from.
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
PUSHED = ("warc_type", "record_id", "target_uri", "refers_to", "payload_digest")
CRLF, CHUNK = b"\r\n", 1 << 18
GZIP, HEAD = b"\x1f\x8b\x08", 4096
#: A digest with more pages than total / HOT_PARTS (and at least HOT_LEAST) is hot, so at most HOT_PARTS digests are.
HOT_PARTS, HOT_LEAST = 2000, 1000


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop-style path; file:/x and file:///x are the same."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Stream:
    """Decompressed bytes of a sequence of gzip members (or plain bytes), with line reads and skips in bounded memory."""

    def __init__(self, raw: io.IOBase, gz: bool, base: int = 0):
        self._raw, self._gz, self._buf, self._pos = raw, gz, b"", 0
        self._z = zlib.decompressobj(31) if gz else None
        self._left, self._taken = b"", base
        #: Where in the file the member begins that was opened last.
        self.member = base

    def _more(self) -> bool:
        while True:
            data = self._left
            if not data:
                data = self._raw.read(CHUNK)
                self._taken += len(data)
            self._left = b""
            if not data:
                return False
            if self._z:
                if self._z.eof:
                    self._z, self.member = zlib.decompressobj(31), self._taken - len(data)
                data, rest = self._z.decompress(data, 1 << 20), self._z
                self._left = rest.unconsumed_tail or rest.unused_data
            if data:
                self._buf, self._pos = self._buf[self._pos :] + data, 0
                return True

    def line(self) -> bytes:
        while (k := self._buf.find(b"\n", self._pos)) < 0:
            if not self._more():
                k = len(self._buf) - 1
                break
        out, self._pos = self._buf[self._pos : k + 1], k + 1
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            part = self._buf[self._pos : self._pos + n]
            self._pos += len(part)
            n -= len(part)
            parts.append(part)
            if n and not self._more():
                raise EOFError("a WARC record ends early")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            k = min(n, len(self._buf) - self._pos)
            self._pos += k
            n -= k
            if n and not self._more():
                raise EOFError("a WARC record ends early")


def _header_block(lines: Iterator[bytes]) -> dict[str, str]:
    out, last = {}, ""
    for raw in lines:
        text = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and last:  # a folded line
            out[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def first_member(raw, start: int, end: int) -> int | None:
    """Where the first gzip member with a WARC record begins in [start, end) of a file that can seek; None if there is none."""
    raw.seek(start)
    buf, base = b"", start
    while base < end and (data := raw.read(CHUNK)):
        buf += data
        k = buf.find(GZIP)
        while k >= 0 and base + k < end:
            if len(buf) - k < HEAD:
                buf += raw.read(CHUNK)
            try:
                if zlib.decompressobj(31).decompress(buf[k : k + HEAD], 8).startswith(b"WARC/"):
                    return base + k
            except zlib.error:
                pass  # the signature occurs inside compressed data
            k = buf.find(GZIP, k + 1)
        keep = len(GZIP) - 1
        base, buf = base + len(buf) - keep, buf[-keep:]
    return None


def records(stream: _Stream, wanted, payloads: bool, end: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA; wanted(headers) decides from the WARC headers alone whether a record's body is looked at. With end, only records
    whose member begins before it."""
    while line := stream.line():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            continue
        if end is not None and stream.member >= end:
            return
        head = _header_block(iter(stream.line, b""))
        size = int(head.get("content-length") or 0)
        if not wanted(head):
            stream.skip(size)
            continue
        length, payload = None, None
        if head.get("content-type", "").startswith("application/http"):
            left = size
            http: list[bytes] = []
            while left:
                row = stream.line()[:left]
                left -= len(row)
                http.append(row)
                if not row.strip():
                    break
            fields = _header_block(iter(http[1:]))
            length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
            size = left
        if payloads:
            payload = stream.take(size)
        else:
            stream.skip(size)
        yield (*(head.get(h) for h in HEADERS.values()), length, payload)


@dataclass
class Ranges(InputPartition):
    """(path, start, end) of files or parts of them; end None: to the end."""

    parts: list[tuple[str, int, int | None]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self._path, self._options = path, options
        self._tests: list[tuple[str, frozenset[str] | None]] = []
        types = [x.strip() for x in options.get("types", "").split(",") if x.strip()]
        if types:
            self._tests.append((HEADERS["warc_type"], frozenset(types)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if name in PUSHED and isinstance(f, EqualTo | In | IsNotNull):
                values = None if isinstance(f, IsNotNull) else frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self._tests.append((HEADERS[name], values))
            yield f  # Spark checks it again

    def partitions(self) -> list[Ranges]:
        store, path = open_fs(self._path)
        target = max(1, int(self._options.get("partitionbytes", 64 << 20)))
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((f for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        out, size = [], target
        for f in files:
            if f.size > target and f.base_name.endswith(".gz"):
                n = -(-f.size // target)
                out += [Ranges([(f.path, f.size * k // n, f.size * (k + 1) // n)]) for k in range(n)]
                size = target
                continue
            if size + f.size > target:
                out.append(Ranges([]))
                size = 0
            out[-1].parts.append((f.path, 0, None))
            size += f.size
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = open_fs(self._path)
        tests, payloads = self._tests, self._options.get("payload", "true").lower() != "false"

        def wanted(head: dict[str, str]) -> bool:
            return all(head.get(h) is not None if v is None else head.get(h) in v for h, v in tests)

        for path, start, end in partition.parts:
            if end is None:
                with store.open_input_stream(path, compression=None) as raw:
                    yield from records(_Stream(raw, path.endswith(".gz")), wanted, payloads)
                continue
            with store.open_input_file(path) as raw:
                if (at := first_member(raw, start, end)) is not None:
                    raw.seek(at)
                    yield from records(_Stream(raw, True, at), wanted, payloads, end)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


def record_bytes(row) -> bytes:
    """One WARC record of a row of SCHEMA. http_length is the payload's length, also where the payload is left out."""
    payload = bytes(row["payload"] or b"")
    length = len(payload) if row["http_length"] is None else row["http_length"]
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % length, b"", b""])
    is_http = (row["content_type"] or "").startswith("application/http")
    body = http + payload if is_http else payload
    head = ["WARC/1.1"]
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
    for column, name in names.items():
        if row[column] is not None:
            head.append(f"{name}: {' '.join(str(row[column]).split())}")
    if row["warc_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + 2 * CRLF + body + 2 * CRLF


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, options: dict[str, str], overwrite: bool):
        self._path, self._level, self._overwrite, self._job = path, int(options.get("level", 1)), overwrite, uuid.uuid4().hex
        self._roll = int(options.get("rollbytes", 1 << 30))

    def write(self, iterator: Iterator) -> Written:
        store, path = open_fs(self._path)
        store.create_dir(path, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for row in iterator:
            if out is not None and size >= self._roll:
                out.close()
                out = None
            if out is None:
                names.append(f"{path}/.{self._job}-{uuid.uuid4().hex}.warc.gz")
                out, size = store.open_output_stream(names[-1], compression=None, buffer_size=1 << 20), 0
            z = zlib.compressobj(self._level, zlib.DEFLATED, 31)
            member = z.compress(record_bytes(row)) + z.flush()
            out.write(member)
            size += len(member)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = open_fs(self._path)
        store.create_dir(path, recursive=True)
        if self._overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.is_file and not f.base_name.startswith("."):
                    store.delete_file(f.path)
        for k, m in enumerate(messages):
            for j, name in enumerate(m.paths if m else []):
                store.move(name, f"{path}/part-{k:05d}-{j:03d}-{self._job}.warc.gz")
        self._sweep(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = open_fs(self._path)
        self._sweep(store, path)

    def _sweep(self, store: fs.FileSystem, path: str) -> None:
        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f".{self._job}-"):
                store.delete_file(f.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32(hexed: Column) -> Column:
    """The 32 base32 letters of 40 hex digits: letter k holds the bits 5k to 5k + 4, which lie within two hex digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    two = lambda k: F.conv(F.substring(hexed, 5 * k // 4 + 1, 2), 16, 10).cast("int")
    return F.concat(*(F.substr(alphabet, F.shiftright(two(k), 3 - 5 * k % 4).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(32)))


def hashed(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with payload_bytes and sha1 (hex) of the html in UTF-8."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.withColumn("payload_bytes", F.octet_length(html).cast("long")).withColumn("sha1", F.sha1(F.encode(html, "utf-8")))


def revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, stored) of the pages that revisit a payload of at least min_bytes, once each: stored is the largest page_id
    that has it. rows: page_id, sha1, payload_bytes."""
    keys = rows.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha1")
    keys = common.written(keys.distinct(), "page-digests")
    shared = common.written(keys.groupBy("sha1").agg(F.max("page_id").alias("stored"), F.count("*").alias("n")).where("n > 1"), "shared-digests")
    limit = max(HOT_LEAST, keys.count() // HOT_PARTS)
    hot = F.broadcast(shared.where(F.col("n") > limit))  # fewer than HOT_PARTS rows
    cold = shared.where(F.col("n") <= limit)
    found = keys.join(hot, "sha1").unionByName(keys.join(hot.select("sha1"), "sha1", "left_anti").join(cold, "sha1"))
    return found.where("page_id < stored").select("page_id", "sha1", "stored")


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """SCHEMA rows for pages (page_id, url, html): of equal payloads of at least min_bytes the largest page_id is stored."""
    rows = hashed(pages.select("page_id", "url", "html"))
    rows = rows.join(revisits(rows, min_bytes), ["page_id", "sha1"], "left")
    revisit = F.col("stored").isNotNull()
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        uri(F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2000-01-01T00:00:00Z").alias("date"),
        F.when(revisit, uri(F.col("stored"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32(F.col("sha1"))).alias("payload_digest"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.col("payload_bytes").alias("http_length"),
        F.when(~revisit, F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("payload"),
    )


def write_archive(records_: DataFrame, path: str, mode: str = "append") -> None:
    records_.write.format("warc").mode(mode).save(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(page_records(common.table(spark, sf_dir, "pages")), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    back = spark.read.format("warc").load(path)
    whole = back.where("warc_type = 'response'")
    again = spark.read.format("warc").option("payload", "false").load(path).where("warc_type = 'revisit'")
    # of responses, size and digest come from the payload that was read; of revisits, from the headers
    full = hashed(whole.select("warc_type", "record_id", "refers_to", F.decode("payload", "utf-8").alias("html")))
    full = full.select("warc_type", "record_id", "refers_to", "payload_bytes", base32(F.col("sha1")).alias("payload_digest"))
    rows = full.unionByName(
        again.select("warc_type", "record_id", "refers_to", F.col("http_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest")))
    return rows.select(
        number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.when(F.col("warc_type") == "revisit", number(F.col("refers_to"))).alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * k) // 4 + 1, 2))::INT) >> (3 - (5 * k) % 4)::INT) & 31) + 1, 1)), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS stored FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < stored THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < stored THEN stored END AS refers_to FROM m
"""
