"""WARC archives as a Spark data source, and revisit records for payloads that repeat.

`spark.dataSource.register(WarcSource)` adds format "warc". Writing puts one record per
row into gzip members whose `sl` extra field holds their compressed length, so a reader
that needs only headers inflates the start of a member and seeks past the rest. Reading
plans partitions from file sizes, applies predicates on header columns before anything
else of a record is inflated, and decodes a payload only where it is asked for.
Files of any folder that pyarrow's file systems reach can be read, with or without `sl`,
compressed or plain. Of a folder written by this source only committed files count, so
files of lost or repeated task attempts are never seen.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SCHEMA = ("record_type string, page_id long, url string, refers_to long, payload_digest string, "
          "payload_bytes long, payload binary")
_HEADER_COLUMNS = {"record_type", "page_id", "url", "refers_to"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_URN = "<urn:walksieve:page:%s>"


def revisits(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Rows for the writer: which page's payload is stored (response) and which pages refer to it (revisit).

    Of pages with equal payloads of at least min_bytes the largest key is the response. Null bodies are empty
    payloads. Null keys never are referred to; where all keys of a payload are null, or a key is repeated with
    its payload, each of these rows is a response. Short payloads skip the join; of long ones a hot payload is
    counted map-side, and adaptive execution splits its rows in the join.
    """
    data = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), data.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    long = rows.where(F.col("payload_bytes") >= min_bytes)
    first = long.groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = long.join(first, "payload_digest", "left")
    all_rows = joined.unionByName(rows.where(F.col("payload_bytes") < min_bytes).withColumn("first", F.lit(None).cast("long")))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return all_rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "url",
        F.when(again, F.col("first")).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"))


class WarcSource(D.DataSource):
    """Options: path; date (WARC-Date of written records), level (of compression), maxFileMb; partitionMb;
    verify (true: payloads are inflated, and their length and SHA-1 are compared with the headers)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(schema, dict(self.options), overwrite)


def file_system(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _option(options: dict, name: str, default):
    return next((v for k, v in options.items() if k.lower() == name.lower()), default)


def record_bytes(row: dict, date: str) -> bytes:
    """One uncompressed record. A null key or URL leaves its header out. ASCII control characters and outer spaces of a URL are
    percent-encoded, so `a` and a line end come back as `a%0A`, like a URL that was written so; all else comes back as it was."""
    body = b"" if row["record_type"] == "revisit" else row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {date}",
            f"WARC-Record-ID: {_URN % ('unknown-' + uuid.uuid4().hex if row['page_id'] is None else row['page_id'])}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_URN % row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode() + _END + http + body + _END


def member(data: bytes, level: int) -> bytes:
    """A gzip member with its own and the plain length in an `sl` extra field (0 where they exceed 32 bits)."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(packed) + 8
    sizes = (size, len(data)) if max(size, len(data)) < 1 << 32 else (0, 0)
    extra = struct.pack("<H2sHII", 12, b"sl", 8, *sizes)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, schema, options, overwrite):
        self.path, self.overwrite = _option(options, "path", ""), overwrite
        self.date, self.level = _option(options, "date", "2000-01-01T00:00:00Z"), int(_option(options, "level", 1))
        self.most = int(_option(options, "maxFileMb", 512)) << 20

    def write(self, iterator):
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    data = member(record_bytes(row, self.date), self.level)
                    size += len(data)
                    out.write(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.startswith("_committed-")] if self.overwrite else []
        with fs.open_output_stream(f"{base}/_committed-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        for p in old:
            fs.delete_file(p)

    def abort(self, messages):
        fs, base = file_system(self.path)
        for n in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{base}/{n}")


class Written(D.WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class Files(D.InputPartition):
    def __init__(self, paths):
        self.paths = paths


def _test(f):
    """A filter on one header column as (column, function of its value), or None."""
    column, value = ".".join(f.attribute), getattr(f, "value", None)
    if column not in _HEADER_COLUMNS:
        return None
    made = {
        D.EqualTo: lambda x: x is not None and x == value, D.EqualNullSafe: lambda x: x == value,
        D.In: lambda x: x is not None and x in value, D.IsNull: lambda x: x is None, D.IsNotNull: lambda x: x is not None,
        D.StringStartsWith: lambda x: x is not None and x.startswith(value),
        D.GreaterThan: lambda x: x is not None and x > value, D.GreaterThanOrEqual: lambda x: x is not None and x >= value,
        D.LessThan: lambda x: x is not None and x < value, D.LessThanOrEqual: lambda x: x is not None and x <= value,
    }.get(type(f))
    return made and (column, made)


class WarcReader(D.DataSourceReader):
    def __init__(self, schema, options):
        self.path, self.schema = _option(options, "path", ""), schema
        self.verify = str(_option(options, "verify", "false")).lower() == "true"
        self.goal = int(_option(options, "partitionMb", 64)) << 20
        self.filters = []

    def pushFilters(self, filters):
        for f in filters:
            if hasattr(f, "attribute") and _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, base = file_system(self.path)
        infos = {f.base_name: f for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.is_file}
        committed = [n for n in infos if n.startswith("_committed-")]
        names = sorted(n for n in infos if re.search(r"\.warc(\.gz)?$", n))
        if committed:
            listed = set()
            for n in committed:
                with fs.open_input_stream(f"{base}/{n}", compression=None) as f:
                    listed |= set(json.loads(f.read()))
            names = sorted(listed)
        made, size = [[]], 0
        for n in names:
            if made[-1] and size + infos[n].size > self.goal:
                made.append([])
                size = 0
            made[-1].append(f"{base}/{n}")
            size += infos[n].size
        return [Files(p) for p in made]

    def read(self, partition):
        tests = [_test(f) for f in self.filters]
        want = set(self.schema.fieldNames())
        body = self.verify or "payload" in want
        schema = to_arrow_schema(self.schema)
        fs, _ = file_system(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for row in records(f, tests, body, self.verify):
                    rows.append(row)
                    held += len(row["payload"] or b"") if "payload" in want else 0
                    if len(rows) >= 4096 or held >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class _Member:
    """Inflates a record bit by bit; `skip` goes on to the next one, by seeking if its length is known."""

    def __init__(self, f):
        self.f, self.start = f, f.tell()
        first = f.read(24)
        self.left, self.plain = b"", not first.startswith(b"\x1f\x8b")
        self.size = struct.unpack("<I", first[16:20])[0] if first[3:4] == b"\x04" and first[12:14] == b"sl" else 0
        f.seek(self.start)
        self.z = None if self.plain else zlib.decompressobj(31)
        self.pending = b""

    def more(self, n: int) -> bytes:
        if self.plain:
            return self.f.read(n)
        while not self.z.eof:
            if not self.pending:
                self.pending = self.f.read(min(1 << 14, self.start + self.size - self.f.tell()) if self.size else 1 << 14)
                if not self.pending:
                    raise EOFError("truncated archive")
            out = self.z.decompress(self.pending, n)
            self.pending = self.z.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes:
        while (at := self.left.find(mark)) < 0:
            got = self.more(1 << 12)
            if not got:
                raise EOFError("truncated record")
            self.left += got
        head, self.left = self.left[:at], self.left[at + len(mark):]
        return head

    def take(self, n: int) -> bytes:
        parts, have = [self.left], len(self.left)
        while have < n:
            got = self.more(1 << 20)
            if not got:
                raise EOFError("truncated record")
            parts.append(got)
            have += len(got)
        data = b"".join(parts)
        self.left = data[n:]
        return data[:n]

    def skip(self, rest: int) -> None:
        """Past the record, of which `rest` bytes and the two line ends have not been taken."""
        if self.plain:
            self.f.seek(self.f.tell() - len(self.left) + rest + len(_END))
        elif self.size:
            self.f.seek(self.start + self.size)
        else:
            while not self.z.eof:
                self.more(1 << 20)
            self.f.seek(self.f.tell() - len(self.z.unused_data))


def _fields(head: bytes) -> dict:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip(" \t").lower(): v.strip(" \t") for k, v in pairs}


def _page(urn) -> int | None:
    found = re.search(r":(-?\d+)>?$", urn or "")
    return int(found[1]) if found and "walksieve:page" in urn else None


def records(f, tests, body: bool, verify: bool):
    """Rows of one open archive that pass the tests on header columns."""
    end = f.size()
    while f.tell() < end:
        m = _Member(f)
        head = _fields(m.until(_END))
        rest = int(head.get("content-length", 0))
        row = {"record_type": head.get("warc-type"), "page_id": _page(head.get("warc-record-id")),
               "url": head.get("warc-target-uri"), "refers_to": _page(head.get("warc-refers-to")),
               "payload_digest": None, "payload_bytes": None, "payload": None}
        if not all(t(row[c]) for c, t in tests):
            m.skip(rest)
            continue
        digest = head.get("warc-payload-digest", "").partition(":")[2]
        if digest:
            row["payload_digest"] = base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower()
        length = None
        if head.get("content-type", "").startswith("application/http") and rest:
            http = m.until(_END)
            rest -= len(http) + len(_END)
            length = _fields(http).get("content-length")
        stored = row["record_type"] != "revisit"
        row["payload_bytes"] = int(length) if length is not None else rest if stored else None
        if body and stored:
            row["payload"] = m.take(rest)
            rest = 0
            if verify:
                found = hashlib.sha1(row["payload"]).hexdigest()
                if len(row["payload"]) != row["payload_bytes"] or found != (row["payload_digest"] or found):
                    raise ValueError(f"record {head.get('warc-record-id')} does not hold the payload its headers name")
                row["payload_digest"] = found
        m.skip(rest)
        yield row


def write(rows: DataFrame, path: str, **options) -> None:
    """Write rows of `revisits` to archives below `path`."""
    rows.sparkSession.dataSource.register(WarcSource)
    rows.select("record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes", "payload") \
        .write.format("warc").options(**options).mode("append").save(path)


def read(spark, path: str, *, columns=("record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes"), **options) -> DataFrame:
    """Read archives; only the named columns are produced, so leave `payload` out where headers suffice."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    types = dict(c.strip().split(" ") for c in SCHEMA.split(","))
    return spark.read.format("warc").schema(", ".join(f"{c} {types[c]}" for c in columns)).options(**options).load(path)
