"""WARC archives as a Spark data source, and duplicate payloads as revisit records.

``spark.read.format("warc").load(path)`` plans a partition for each archive file. Predicates on the record type and
on other header columns are pushed down: a record's header is parsed first, and where it doesn't match, or where the
option ``payload`` is ``none``, its payload is passed over without being kept or decoded. ``df.write.format("warc")``
writes archives of bounded size, each record a gzip member. Paths are whatever pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from fairlead.llm.common import materialize, new_folder, small_batches

#: Payloads of fewer bytes are never revisits. An archive file is closed beyond so many bytes.
MIN_PAYLOAD, FILE_BYTES = 1000, 64 << 20
#: Digests with at least this part of the repeated payloads are frequent.
LARGE = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Column and header of what is read from headers alone.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload_length long, payload binary, payload_sha1 string"
#: Bytes read at a time.
READ_BYTES = 1 << 20


def _open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32_of(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def hex_of(digest: str | None) -> str | None:
    """Bare lower-case hex of a ``sha1:`` digest in base 32 or hex."""
    if not digest or not digest.lower().startswith("sha1:"):
        return None
    value = digest[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


class _Members:
    """The gzip members of an archive (or plain records) as bytes on demand, a chunk in memory at a time."""

    def __init__(self, stream, zipped: bool):
        self.stream, self.zipped = stream, zipped
        self.buffer = bytearray()
        self.inflate = zlib.decompressobj(31) if zipped else None
        self.over = False

    def _more(self) -> bool:
        raw = self.inflate.unused_data if self.zipped and self.inflate.eof else b""
        if self.zipped and self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        raw = raw or (self.inflate.unconsumed_tail if self.zipped else b"") or self.stream.read(READ_BYTES)
        if not raw:
            self.over = True
            return False
        self.buffer += self.inflate.decompress(raw, READ_BYTES) if self.zipped else raw
        return True

    def header(self) -> bytes | None:
        """Up to and with the empty line that ends a record's header; None after the last record."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if bytes(self.buffer).strip():
                    raise ValueError("a WARC record is cut off")
                return None
        out = bytes(self.buffer[: at + 4])
        del self.buffer[: at + 4]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next ``n`` bytes; without ``keep`` they are only passed over."""
        parts = []
        while n:
            if not self.buffer and not self._more():
                raise ValueError("a WARC record is cut off")
            part = self.buffer[:n]
            if keep:
                parts.append(bytes(part))
            del self.buffer[: len(part)]
            n -= len(part)
        return b"".join(parts)


def parse_header(raw: bytes) -> dict[str, str]:
    """Names are lower-cased; a line that starts with white space goes on with the one before."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", raw.strip()).decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(stream, zipped: bool, wanted, payload: str) -> Iterator[tuple]:
    """Rows of SCHEMA. ``wanted`` judges the header's columns; ``payload``: full, digest (its SHA-1 only) or none."""
    source = _Members(stream, zipped)
    while (raw := source.header()) is not None:
        head = parse_header(raw)
        row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        length, ok = int(head.get("content-length", 0)), wanted(row)
        block = source.take(length, keep=ok and payload != "none")
        source.take(4, keep=False)
        if not ok:
            continue
        body, sha1, size = None, hex_of(row["digest"]), head.get("x-payload-length")
        if payload != "none" and row["record_type"] != "revisit":
            body = block.partition(b"\r\n\r\n")[2] if (row["content_type"] or "").startswith("application/http") else block
            sha1, size = hashlib.sha1(body).hexdigest(), len(body)
        yield (*row.values(), length, None if size is None else int(size), body if payload == "full" else None, sha1)


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "full")
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, path = _open_fs(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        names = sorted(x.path for x in found if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path))
        return [_File(p) for p in names] or [_File("")]

    def read(self, partition):
        import pyarrow as pa

        if not partition.path:
            return
        kinds = {"content_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds.get(x.split()[0], pa.string())) for x in SCHEMA.split(", ")])
        system, _ = _open_fs(self.path)
        wanted = lambda row: all(row[c] in values for c, values in self.tests)
        rows, size = [], 0
        with system.open_input_stream(partition.path, compression=None) as stream:
            for row in records(stream, partition.path.endswith(".gz"), wanted, self.payload):
                rows.append(row)
                size += len(row[-2] or b"") + 200
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Columns: ``record_id, record_type`` (response or revisit), ``target_uri, refers_to, payload`` (string or binary).

    Each write adds files to the folder and leaves those that are there. Names hold the job and the task's attempt; at
    the end the files of this job's repeated or failed attempts are removed, and no others.
    """

    def __init__(self, options, schema):
        self.path, self.names = options["path"], schema.fieldNames()
        self.limit, self.level = int(options.get("fileBytes", FILE_BYTES)), int(options.get("level", 1))
        self.job = uuid.uuid4().hex

    @staticmethod
    def record(record_id: str, kind: str, uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
        block = HTTP_HEAD + (payload if kind != "revisit" else b"")
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response"]
        if uri is not None:
            lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
        if kind == "revisit":
            lines += [f"WARC-Profile: {PROFILE}", *[f"WARC-Refers-To: <{refers_to}>"] * (refers_to is not None)]
        lines += [f"WARC-Payload-Digest: {base32_of(hashlib.sha1(payload).hexdigest())}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    def write(self, iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        system, path = _open_fs(self.path)
        system.create_dir(path, recursive=True)
        task, files, out = f"{self.job}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", [], None
        for batch in iterator:
            cols = {n: batch.column(i) for i, n in enumerate(self.names)}
            payload = cols["payload"].cast(pa.large_binary()).to_pylist()
            for i, (rid, kind, uri, to) in enumerate(zip(*(cols[c].to_pylist() for c in ("record_id", "record_type", "target_uri", "refers_to")), strict=True)):
                if out is None:
                    files.append(f"part-{task}-{len(files):04d}.warc.gz")
                    out = system.open_output_stream(f"{path}/{files[-1]}", compression=None)
                z = zlib.compressobj(self.level, wbits=31)
                out.write(z.compress(self.record(rid, kind, uri, to, payload[i] or b"")) + z.flush())
                if out.tell() > self.limit:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def _remove_but(self, kept: set) -> None:
        from pyarrow import fs

        system, path = _open_fs(self.path)
        for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if x.base_name.startswith(f"part-{self.job}-") and x.base_name not in kept:
                system.delete_file(x.path)

    def commit(self, messages):
        self._remove_but({f for m in messages if m is not None for f in m.files})

    def abort(self, messages):
        self._remove_but(set())


class WarcSource(DataSource):
    """Options: ``path``; reading, ``payload`` (full, digest or none); writing, ``fileBytes`` and ``level`` (of gzip)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def as_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """The columns that the writer takes. Of pages with equal payloads of at least ``min_payload`` bytes, that with the
    largest id is the response and the others revisit it; equality is that of SHA-1 and length. Null html counts as
    empty. Rows that repeat the largest id are responses all of them; a page without an id only ever revisits, unless
    no page with its payload has one. Only the digests are compared, and a frequent payload is counted before it is
    shuffled. Digests that a thousandth of the repeated payloads have, a thousand at most, are broadcast; pages that
    need no other join meet nothing and are spread by themselves."""
    digest = F.sha1(F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8"))
    payload = F.coalesce(F.col(html_col), F.lit(""))
    sized = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("target_uri"), payload.alias("payload"), F.when(F.octet_length(payload) >= min_payload, digest).alias("sha1"))
    groups = sized.where(F.col("sha1").isNotNull()).groupBy(F.col("sha1").alias("own")).agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("first")).where("n > 1")
    groups = materialize(groups, "payloads")
    repeated = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    large = groups.where(F.col("n") * LARGE >= repeated)  # LARGE rows at most
    often = F.broadcast(large.select(F.col("own").alias("often"), F.col("first").alias("first_often")))
    spread = F.concat(F.lit("-"), F.xxhash64("page", "target_uri", "payload").cast("string"))  # no digest
    sized = sized.join(often, F.col("sha1") == F.col("often"), "left").withColumn("key", F.when(F.col("often").isNull() & F.col("sha1").isNotNull(), F.col("sha1")).otherwise(spread))
    rest = groups.where(F.col("n") * LARGE < repeated).select(F.col("own").alias("key"), F.col("first").alias("first_rest"))
    joined = sized.join(rest, "key", "left").withColumn("first", F.coalesce("first_often", "first_rest"))
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        name(F.col("page")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(revisit, name(F.col("first"))).alias("refers_to"), "payload"
    )


def write_pages(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write ``pages`` as WARC archives to ``path`` (by default a new one in the shared folder) and return it."""
    spark = pages.sparkSession
    register(spark)
    small_batches(spark, 200)
    path = path or new_folder(spark, "warc")
    as_records(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def read_pages(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from archives. A response's size and digest
    are those of the payload that is there, a revisit's those that its header names. The record type is a predicate
    that the source takes: one scan hashes the payloads of responses and passes over all else, the other reads the
    headers of revisits alone."""
    register(spark)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast(id_type)

    def of(kind: str, payload: str) -> DataFrame:
        read = spark.read.format("warc").option("payload", payload).load(path).where(F.col("record_type") == kind)
        return read.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))

    return of("response", "digest").unionByName(of("revisit", "none"))
