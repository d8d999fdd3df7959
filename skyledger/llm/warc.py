"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

Writing, all on Spark:

1. ``repeated`` groups payloads by SHA-1 and size, combined before the shuffle, and keeps those
   that occur twice or more, with the greatest ``(id, url)`` of each: that record is the response,
   the others revisit it.
2. Records are merged where they repeat each other in one batch of a task, compressed, and sorted
   across the cluster by id, url and digest. The only shuffle that holds payloads is this one.
3. Each task writes its range, record by record, as gzip members of WARC/1.1 with headers and
   digests made anew from the payload. A file is closed once it holds ``roll`` compressed bytes.
   It has a temporary name, unique to the attempt; a row of the manifest says what it holds.
4. The manifest is a table that Spark commits: rows of lost, repeated or speculative attempts are
   not in it. ``commit`` renames the files it names and may be run again at any time; files of
   other attempts are under names that no reader looks at.

Reading takes the manifest's files, dealt over the cluster, streams each member, and compares the
digest and size in its headers with what it holds.

The same rows in the same partitions give the same bytes: gzip members carry no time, the date of
records is a parameter, and names of records follow from their id, url, payload and copy number.
Files are opened through Arrow's file systems, so ``path`` may be a local folder that all executors
share, HDFS or an object store.

Defined results: a null payload is an empty one; a null id ranks before all others and is written
as no header; a null url becomes one made of the id. Rows that agree in id, url and payload are
copies: one is the response if theirs is the response, the others revisit it. Payloads below
``least`` bytes are all responses. An empty table gives an archive without files. Further columns
are not written. Payloads are written and read whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skyledger.llm.frames import struct
from skyledger.llm.words import chunks
from skyledger.sources.tables import stage, staging_path

ROLL = 256 << 20
LEAST = 0
READ = 64 << 10
DATE = "1970-01-01T00:00:00Z"
SAFE = "!#$%&'()*+,/:;=?@[]~"
# Fixed value: the profile of a revisit with the same payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, temporary string, bytes long, records long, sha1 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


# --- records ----------------------------------------------------------------------


def target(name: int | None, url: str | None) -> str:
    return quote(url, safe=SAFE) if url else f"urn:record:{'' if name is None else name}"


def record_name(name: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    """Urn of a record, the same in every run."""
    seen = repr((name, url, digest, copy)).encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(seen).digest()[:16], version=4)}>"


def headers(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]
    return "\r\n".join(lines).encode()


def record(
    name: int | None,
    url: str | None,
    payload: bytes,
    first: tuple[int | None, str | None] | None,
    copy: int,
    date: str,
) -> bytes:
    """One record as bytes; a revisit of the record ``first`` if there is one."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
    block = http % len(payload) + (b"" if first else payload)
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", record_name(name, url, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target(name, url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if first:
        fields += [
            ("WARC-Profile", SAME_PAYLOAD),
            ("WARC-Refers-To", record_name(*first, digest)),
            ("WARC-Refers-To-Target-URI", target(*first)),
            ("X-Refers-To-Id", first[0]),
        ]
    fields += [
        ("X-Id", name),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return headers(fields) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# --- writing ----------------------------------------------------------------------


def repeated(pages: DataFrame, least: int) -> DataFrame:
    """``digest, size, first``: payloads of several rows, with the row that is the response."""
    key = F.struct("name", "url")
    facts = pages.select(
        "name", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")
    )
    groups = facts.filter(F.col("size") >= least).groupBy("digest", "size").agg(
        F.max(key).alias("first"), F.count("*").alias("n")
    )
    return groups.filter("n > 1").drop("n")


def merged(pages: DataFrame) -> DataFrame:
    """Records that travel: equal ones of a batch once, with their number, payloads compressed."""
    out = struct("name long, url string, digest string, size int, copies long, body binary")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch, payloads in chunks(batches, "payload"):
            rows: dict[tuple, list] = {}
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for key, payload in zip(keys, payloads):
                if key in rows:
                    rows[key][1] += 1
                else:
                    rows[key] = [len(payload), 1, pack(payload)]
            columns = zip(*((*key, *rest) for key, rest in rows.items()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names
            )

    digest = F.sha1("payload").alias("digest")
    return pages.select("name", "url", digest, "payload").mapInArrow(run, out)


class Roll:
    """The files of one task, closed by compressed size."""

    def __init__(self, path: str, shard: int, attempt: str, roll: int, date: str):
        self.files, self.path = open_files(path)
        self.shard, self.attempt, self.roll, self.date = shard, attempt, roll, date
        self.number, self.stream = 0, None
        self.done: list[dict] = []

    def write(self, data: bytes) -> None:
        if self.stream is None:
            self.file = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.file}.{self.attempt}"
            self.files.create_dir(f"{self.path}/_temporary", recursive=True)
            self.stream = self.files.open_output_stream(
                f"{self.path}/{self.temporary}", compression=None
            )
            self.bytes, self.records, self.sha1 = 0, 0, hashlib.sha1()
            self._put(member(self.info()))
        self._put(member(data))
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def info(self) -> bytes:
        block = b"format: WARC File Format 1.1\r\n"
        fields = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", record_name(None, self.file, base32_sha1(block))),
            ("WARC-Date", self.date),
            ("WARC-Filename", self.file),
            ("Content-Type", "application/warc-fields"),
            ("Content-Length", len(block)),
        ]
        return headers(fields) + block + b"\r\n\r\n"

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.sha1.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append(
                {
                    "file": self.file,
                    "temporary": self.temporary,
                    "bytes": self.bytes,
                    "records": self.records,
                    "sha1": self.sha1.hexdigest(),
                }
            )
            self.number, self.stream = self.number + 1, None


def write_files(records: DataFrame, path: str, roll: int, date: str) -> DataFrame:
    """Writes sorted records to temporary names; a row for each file."""
    out = struct(MANIFEST)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unpack = zstandard.ZstdDecompressor().decompress
        to = Roll(path, TaskContext.get().partitionId(), uuid.uuid4().hex, roll, date)
        last, copy = None, 0
        for batch in batches:
            for *key, copies, body, again, first_name, first_url in zip(
                *(c.to_pylist() for c in batch.columns)
            ):
                name, url, digest = key
                copy = copy if key == last else 0
                last = key
                payload = unpack(body)
                first = (first_name, first_url) if again else None
                for copy in range(copy, copy + copies):
                    response = first is None or (first == (name, url) and copy == 0)
                    to.write(
                        record(name, url, payload, None if response else first, copy, date)
                    )
                copy += 1
            yield pa.RecordBatch.from_pylist(to.done, arrow)
            to.done = []
        to.close()
        yield pa.RecordBatch.from_pylist(to.done, arrow)

    return records.mapInArrow(run, out)


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = LEAST,
    roll: int = ROLL,
    date: str = DATE,
) -> DataFrame:
    """Writes ``pages`` as an archive below ``path`` and returns its manifest, committed."""
    plain = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("name"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"),
    )
    # Written first, so that its true size decides how it is joined.
    groups = stage(repeated(plain, least), "repeated")
    told = merged(plain).join(
        groups.withColumn("again", F.lit(True)), ["digest", "size"], "left"
    )
    ordered = told.select(
        "name", "url", "digest", "copies", "body",
        F.coalesce("again", F.lit(False)).alias("again"),
        F.col("first.name").alias("first_name"),
        F.col("first.url").alias("first_url"),
    )
    keys = ["name", "url", "digest"]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    manifest = stage(write_files(ordered, path, roll, date), "manifest")
    commit(manifest, path)
    return manifest


def commit(manifest: DataFrame, path: str) -> None:
    """Gives the files of the manifest their names. Files that have them already are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_files(path)
        for batch in batches:
            for row in batch.to_pylist():
                source, to = f"{root}/{row['temporary']}", f"{root}/{row['file']}"
                if files.get_file_info(source).type != fs.FileType.NotFound:
                    files.move(source, to)
                found = files.get_file_info(to).size
                if found != row["bytes"]:
                    raise OSError(f"{to} holds {found} bytes, not {row['bytes']}")
            yield batch

    done = manifest.repartition("file").mapInArrow(run, manifest.schema)
    files = done.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    files.write.format("noop").mode("overwrite").save()


# --- reading ----------------------------------------------------------------------


class Block:
    """Takes a record's bytes piece by piece: its headers, and the digests of what follows."""

    def __init__(self) -> None:
        self.head, self.fields = b"", None
        self.http: bytes | None = b""
        self.size, self.taken = 0, 0
        self.block, self.payload = hashlib.sha1(), hashlib.sha1()

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record: {lines[0][:40]!r}")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            data, self.head = self.head[end + 4 :], b""
            self.left = int(self.fields["Content-Length"])
        body, self.left = data[: self.left], self.left - min(self.left, len(data))
        self.block.update(body)
        if self.http is not None:
            self.http += body
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            body, self.http = self.http[end + 4 :], None
        self.payload.update(body)
        self.size += len(body)

    def row(self) -> dict | None:
        """What the record says of itself, once it agrees with what it holds."""
        fields = self.fields or {}
        if self.left or not fields:
            raise ValueError("a record ends before its length")
        if fields["WARC-Type"] == "warcinfo":
            return None
        check = [("WARC-Block-Digest", self.block)]
        if fields["WARC-Type"] == "response":
            check.append(("WARC-Payload-Digest", self.payload))
            if self.size != int(fields["X-Payload-Length"]):
                raise ValueError(f"{fields['WARC-Record-ID']}: payload of {self.size} bytes")
        for key, got in check:
            if fields[key] != f"sha1:{base64.b32encode(got.digest()).decode()}":
                raise ValueError(f"{fields['WARC-Record-ID']}: wrong {key}")
        number = lambda k: int(fields[k]) if k in fields else None
        return {
            "id": number("X-Id"),
            "payload_bytes": int(fields["X-Payload-Length"]),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "record_type": fields["WARC-Type"],
            "refers_to": number("X-Refers-To-Id"),
            "record_id": fields["WARC-Record-ID"],
            "refers_to_record": fields.get("WARC-Refers-To"),
            "target_uri": fields["WARC-Target-URI"],
        }


def members(stream) -> Iterator[Block]:
    """The records of a file, one gzip member each, read a piece at a time."""
    open_, block = zlib.decompressobj(31), Block()
    rest = stream.read(READ)
    while rest:
        block.feed(open_.decompress(rest))
        rest = open_.unused_data
        if open_.eof:
            yield block
            open_, block = zlib.decompressobj(31), Block()
        rest = rest or stream.read(READ)
    if block.head or block.fields:
        raise ValueError("the file ends within a record")


def read_warc(manifest: DataFrame, path: str, id_col: str = "page_id") -> DataFrame:
    """A row for each record of the files that the manifest names, in no certain order."""
    out = struct(
        "id long, payload_bytes long, payload_digest string, record_type string, refers_to long,"
        " record_id string, refers_to_record string, target_uri string, file string"
    )
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_files(path)
        for batch in batches:
            for row in batch.to_pylist():
                held, n = [], 0
                with files.open_input_stream(f"{root}/{row['file']}", compression=None) as stream:
                    for block in members(stream):
                        got = block.row()
                        if got:
                            held.append({**got, "file": row["file"]})
                            n += 1
                        if len(held) >= 4096:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held = []
                yield pa.RecordBatch.from_pylist(held, arrow)
                if n != row["records"]:
                    raise ValueError(f"{row['file']} holds {n} records, not {row['records']}")

    found = manifest.repartition("file").mapInArrow(run, out)
    return found.withColumnRenamed("id", id_col)


def archived(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes an archive into the staging folder, reads it back, and tells of each record."""
    path = staging_path(spark, "warc")
    return read_warc(write_warc(pages, path, **options), path)
