"""WARC archives as a PySpark data source (operator 7).

The reader takes any WARC/1.0 or 1.1 file, plain or gzipped (one member a record, or one for all), a folder of them or a
glob.  It plans one partition a file, and several for a gzipped file above `split_bytes`, where a partition begins at the first member
in its range that inflates to a record.  It takes predicates on record type and header fields from Spark's filter push-down, parses the
headers of each record first, and decodes a block only if the predicates want the record and payloads are asked for (`payload`, to return
them, or `verify`, to recompute their digests).  Plain blocks are stepped over; so are gzip members that hold their own size in an extra
field ``sl``, as this writer's do; other members are inflated up to their end and thrown away.

The writer makes one gzip member a record and starts a new file at `file_bytes`; the names of files that committed tasks
wrote go into a manifest, and only those are read, so lost or repeated attempts do no harm.

Defined results: a null html is the empty payload; of equal payloads those with the smallest page_id are responses (several only if
rows share that id) and all others are revisits that refer to it; a null page_id is written without that header; an empty table gives an
archive without records.  Of foreign records page_id and refers_to are null, and payload_bytes is known where the block is read.
"""

from __future__ import annotations

import base64
import fnmatch
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tankline.llm.common import fresh_path
from tankline.llm.files import open_store

NAME = "tankline_warc"
SCHEMA = "record_type string, record_id string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, payload binary"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
MANIFEST = "_manifest.json"
#: A member: magic, deflate, FEXTRA, time, flags, system; then the extra field with subfield sl of 8 bytes.
HEAD = struct.Struct("<4sIBBH2sHQ")
HEAD_START = b"\x1f\x8b\x08\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4
EPOCH = "1970-01-01T00:00:00Z"


def member(raw: bytes) -> bytes:
    """One gzip member that knows its own size."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    size = HEAD.size + len(body) + 8
    return HEAD.pack(HEAD_START, 0, 0, 255, 12, b"sl", 8, size) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(row: dict) -> bytes:
    """A response or revisit record in WARC/1.1."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"], row["url"])), ("WARC-Date", EPOCH),
        ("WARC-Target-URI", " ".join((row["url"] or "").split())), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Bytes", row["payload_bytes"]),
    ]
    if row["page_id"] is not None:
        lines.append(("X-Page-Id", row["page_id"]))
    if revisit:
        uri = " ".join((row["first_url"] or "").split())
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"], row["first_url"])), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", EPOCH), ("X-Refers-To-Page-Id", row["refers_to"])]
    lines.append(("Content-Length", len(block)))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    out, name = {}, None
    for x in lines[1:]:
        if x[:1] in (" ", "\t") and name:  # a header that goes on
            out[name] += " " + x.strip()
        elif ":" in x:
            name, _, value = x.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _int(text: str | None) -> int | None:
    return int(text) if text else None


def fields(headers: dict[str, str]) -> dict:
    return {
        "record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "target_uri": headers.get("warc-target-uri"), "page_id": _int(headers.get("x-page-id")),
        "payload_bytes": _int(headers.get("x-payload-bytes")), "payload_digest": (headers.get("warc-payload-digest") or "").partition(":")[2] or None,
        "refers_to": _int(headers.get("x-refers-to-page-id")), "refers_to_id": headers.get("warc-refers-to"), "payload": None,
    }


class Plain:
    """An archive's bytes as they are, with what has been read ahead."""

    def __init__(self, f, at: int = 0):
        self.f, self.ahead, self.at = f, b"", at
        f.seek(at)

    def more(self) -> bytes:
        return self.f.read(1 << 16)

    def skip(self, n: int) -> None:
        took = min(n, len(self.ahead))
        self.ahead = self.ahead[took:]
        if n > took:
            self.f.seek(n - took, 1)
        self.at += n

    def read(self, n: int) -> bytes:
        parts, size = [self.ahead], len(self.ahead)
        while size < n and (part := self.more()):
            parts.append(part)
            size += len(part)
        whole = b"".join(parts)
        self.ahead = whole[n:]
        self.at += min(n, len(whole))
        return whole[:n]

    def headers(self) -> bytes | None:
        """Up to the blank line, which is dropped; None at the end.  Blank lines before a record are passed over."""
        while True:
            self.ahead = self.ahead.lstrip(b"\r\n")
            end = min((x for x in (self.ahead.find(b"\r\n\r\n"), self.ahead.find(b"\n\n")) if x >= 0), default=-1)
            if end >= 0:
                cut = end + (4 if self.ahead[end : end + 1] == b"\r" else 2)
                raw, self.ahead = self.ahead[:end], self.ahead[cut:]
                return raw
            part = self.more()
            if not part:
                if self.ahead:
                    raise ValueError("a record ends in its headers")
                return None
            self.ahead += part


class Inflated(Plain):
    """The same of gzip members one after another; `at` is where the member of the bytes read last begins."""

    def __init__(self, f, at: int = 0):
        super().__init__(f, at)
        self.raw, self.place, self.unpack = b"", at, None

    def more(self) -> bytes:
        while True:
            if self.unpack is None:
                self.raw = self.raw or self.f.read(1 << 16)
                if not self.raw:
                    return b""
                self.at, self.unpack = self.place, zlib.decompressobj(31)
            out = self.unpack.decompress(self.raw, 1 << 18)
            rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            self.place += len(self.raw) - len(rest)
            self.raw = rest
            if self.unpack.eof:
                self.unpack = None
            elif not rest:
                self.raw = self.f.read(1 << 16)
                if not self.raw and not out:
                    raise ValueError("a member is cut off")
            if out:
                return out

    def skip(self, n: int) -> None:
        while n > len(self.ahead):
            n -= len(self.ahead)
            self.ahead = self.more()
            if not self.ahead:
                return
        self.ahead = self.ahead[n:]


def body_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a block: what follows the head of an HTTP message, or all."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").lower().startswith("application/http") else block


def finish(row: dict, headers: dict[str, str], block: bytes, payload: bool, verify: bool) -> dict:
    """A record with what its block tells."""
    if row["record_type"] == "revisit":
        return row
    body = body_of(headers, block)
    if verify and row["record_type"] == "response":
        kind = headers.get("warc-payload-digest", "").partition(":")[0].lower()
        found = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if kind == "sha1" and found != row["payload_digest"] or row["payload_bytes"] not in (None, len(body)):
            raise ValueError(f"payload of {row['record_id']} is damaged")
    row["payload_bytes"] = len(body)
    if payload:
        row["payload"] = body
    return row


def scan(f, wanted, payload: bool, verify: bool, begin: int = 0, end: int | None = None) -> Iterator[dict]:
    """Records whose member or line begins in a range of an archive, headers first."""
    f.seek(begin)
    head = f.read(HEAD.size)
    f.seek(begin)
    if head[:4] == HEAD_START and head[12:14] == b"sl":
        yield from scan_sized(f, wanted, payload, verify, begin, end)
        return
    stream = Inflated(f, begin) if head[:2] == b"\x1f\x8b" else Plain(f, begin)
    while (raw := stream.headers()) is not None:
        if end is not None and stream.at >= end:
            return
        headers = parse_headers(raw)
        row, size = fields(headers), int(headers.get("content-length") or 0)
        if not wanted(row):
            stream.skip(size)
        elif payload or verify:
            yield finish(row, headers, stream.read(size), payload, verify)
        else:
            stream.skip(size)
            yield row


def first_member(f, begin: int, end: int) -> int | None:
    """Where the first gzip member in a range begins that holds the start of a record."""
    at, held = begin, b""
    while at < end:
        f.seek(at)
        held = f.read((1 << 20) + 64)
        if not held:
            return None
        k = held.find(b"\x1f\x8b\x08")
        while 0 <= k < 1 << 20 and at + k < end:
            try:
                f.seek(at + k)
                if zlib.decompressobj(31).decompress(f.read(4096), 5) == b"WARC/":
                    return at + k
            except zlib.error:
                pass
            k = held.find(b"\x1f\x8b\x08", k + 1)
        at += 1 << 20
    return None


def scan_sized(f, wanted, payload: bool, verify: bool, begin: int, end: int | None) -> Iterator[dict]:
    """Records of members that know their size."""
    at = begin
    while (end is None or at < end) and (head := f.read(HEAD.size)):
        if len(head) < HEAD.size or head[:4] != HEAD_START or head[12:14] != b"sl":
            raise ValueError("a member has no skip length")
        size = HEAD.unpack(head)[-1] - HEAD.size
        at += size + HEAD.size
        unpack = zlib.decompressobj(-15)
        took = min(size, 1024)
        raw = unpack.decompress(f.read(took), 8192)
        while (stop := raw.find(b"\r\n\r\n")) < 0:
            if unpack.unconsumed_tail:
                more = unpack.decompress(unpack.unconsumed_tail, 8192)
            else:
                more = unpack.decompress(part := f.read(min(1024, size - took)), 8192)
                took += len(part)
                if not part:
                    raise ValueError("a record ends in its headers")
            raw += more
        headers = parse_headers(raw[:stop])
        row = fields(headers)
        if wanted(row) and (payload or verify):
            tail = unpack.unconsumed_tail + f.read(size - took)
            raw = raw[stop + 4 :] + unpack.decompress(tail)
            yield finish(row, headers, raw[: int(headers["content-length"])], payload, verify)
            continue
        f.seek(size - took, 1)
        if wanted(row):
            yield row


#: Predicates on header fields that the reader itself decides.
TESTS = {
    EqualTo: lambda a, b: a is not None and a == b, EqualNullSafe: lambda a, b: a == b, In: lambda a, b: a is not None and a in b, GreaterThan: lambda a, b: a is not None and a > b,
    GreaterThanOrEqual: lambda a, b: a is not None and a >= b, LessThan: lambda a, b: a is not None and a < b, LessThanOrEqual: lambda a, b: a is not None and a <= b,
    StringStartsWith: lambda a, b: a is not None and a.startswith(b), IsNotNull: lambda a, b: a is not None,
}


class WarcFile(InputPartition):
    def __init__(self, path: str, begin: int = 0, end: int | None = None):
        self.path, self.begin, self.end = path, begin, end


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", 1 << 28))
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in FIELDS[:-1]:
                self.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def _store(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the path in it down to the first wild card, and the rest."""
        path = self.path.rstrip("/")
        wild = re.search(r"[*?\[]", path)
        cut = path.rindex("/", 0, wild.start()) if wild else len(path)
        return *open_store(path[:cut]), path[cut:]

    def partitions(self):
        store, root, rest = self._store()
        info = store.get_file_info(root)
        if rest:
            found = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and fnmatch.fnmatch(x.path, root + rest)]
        elif info.is_file:
            found = [info]
        elif store.get_file_info(f"{root}/{MANIFEST}").is_file:
            with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = [f"{root}/{name}" for name in json.loads(f.read())]
            found = store.get_file_info(names) if names else []
        else:
            found = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)]
        out = []
        for x in sorted(found, key=lambda x: x.path):
            pieces = max(1, -(-x.size // self.split_bytes)) if x.path.endswith(".gz") else 1
            out += [WarcFile(x.path, k * self.split_bytes, (k + 1) * self.split_bytes if k + 1 < pieces else None) for k in range(pieces)]
        return out or [WarcFile("")]

    def read(self, partition):
        if not partition.path:
            return
        tests = [(TESTS[kind], name, value) for kind, name, value in self.tests]
        store, name = self._store()[0], partition.path
        kind = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in FIELDS])
        rows, held = [], 0
        with store.open_input_file(name) as f:
            begin = partition.begin
            if begin:
                begin = first_member(f, begin, partition.end or f.size())
                if begin is None:
                    return
            for row in scan(io.BufferedReader(f, 1 << 20), lambda r: all(test(r[n], v) for test, n, v in tests), self.payload, self.verify, begin, partition.end):
                rows.append(row)
                held += 200 + len(row["payload"] or b"")
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


class Wrote(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", 1 << 28))

    def write(self, iterator):
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        names, f, size = [], None, 0
        for batch in iterator:
            for lo in range(0, batch.num_rows, 200):
                for row in batch.slice(lo, 200).to_pylist():
                    if f is None or size >= self.file_bytes:
                        if f is not None:
                            f.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        f, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                    raw = member(record(row))
                    f.write(raw)
                    size += len(raw)
        if f is not None:
            f.close()
        return Wrote(names)

    def commit(self, messages):
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(n for m in messages if m is not None for n in m.names)).encode())

    def abort(self, messages):
        store, root = open_store(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                store.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def labelled(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """The rows to write: response or revisit by the smallest page_id of each payload."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.min_by("url", F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "url")).alias("first_url"))
    joined = rows.join(first, "sha1")  # an equi-join that adaptive execution may split at a hot payload
    other = (F.octet_length("payload") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("first")).alias("refers_to"), F.when(other, F.col("first_url")).alias("first_url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "sha1", F.when(~other, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, out: str, min_revisit_bytes: int = 0) -> None:
    """One archive folder from rows page_id, url, html."""
    register(pages.sparkSession)
    labelled(pages, min_revisit_bytes).write.format(NAME).mode("append").option("path", out).save()


def read(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("path", path).option("payload", str(payload).lower()).option("verify", str(verify).lower()).load()


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back and check every payload's digest."""
    out = fresh_path(pages.sparkSession, "warc")
    write(pages, out, min_revisit_bytes)
    found = read(pages.sparkSession, out, payload=False, verify=True).where(F.col("record_type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
