"""Write pages to WARC archives and read archives back.

Method of the reader: sequential; one gzip member for each record, zlib
decompression block by block, framing by content length, and verification of
both digests. It holds a block of the file and the headers of one record, and
the payload only where the caller wants it.

Archives are written by the tasks themselves, each file under a name of its
own. Only the files that finished tasks report are ever read, so what a lost
executor or a second attempt leaves behind does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import keep, new_folder, query, table

FILE_BYTES = 32 << 20
#: Tasks of one read at most; each takes several files then.
READERS = 20_000
BLOCK_BYTES = 1 << 16
#: Fixed texts of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
ID = "urn:page:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Return ``(id, digest, size, refers_to)`` of the pages whose payload a page of larger id has too.

    An id may come with several payloads; each refers on its own. Only digests
    and sizes are shuffled. A page without an id neither refers nor is referred
    to.
    """
    payload = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    rows = pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.unhex(F.sha1(payload)).alias("digest"),
        F.octet_length(payload).alias("size"),
    )
    rows = rows.where(F.col("size") >= min_bytes)
    # Kept as a table, so that the join is between two plain scans and a digest of very many pages can be split.
    shared = keep(
        rows.groupBy("digest", "size")
        .agg(F.max("id").alias("refers_to"), F.min("id").alias("least"))
        .where("least < refers_to")
        .drop("least"),
        "warc-shared",
    )
    return rows.join(shared, ["digest", "size"]).where("id < refers_to").select("id", "digest", "size", "refers_to").distinct()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{ID}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + END


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES,
    level: int = 6,
) -> DataFrame:
    """Write a record for every row to archives in ``folder``; return ``(path, records)`` of the files.

    Of pages with equal payloads of at least ``min_bytes``, the one with the
    largest id is written as a response and the others as revisits of it.

    A null payload is empty. A null url is left out of its record. Pages with
    a null id are written as responses with no id. Rows that share id and
    payload are all written the same way; rows that share an id alone are
    judged each by its payload, and one may be a response and another a
    revisit. No rows: no files. Further columns
    are ignored. ``folder`` must be one that all executors and the reader share.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(payload_col, F.lit("")).alias("payload"),
    )
    # A page meets what is said of its own payload, whatever other payloads come with its id.
    payload = F.encode("payload", "UTF-8")
    named = rows.withColumns({"digest": F.unhex(F.sha1(payload)), "size": F.octet_length(payload)})
    joined = named.join(revisits(pages, id_col, payload_col, min_bytes), ["id", "digest", "size"], "left").drop("digest", "size")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        out, name, records, size = None, "", 0, 0
        done = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to"))
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                record = _record(page_id, url, payload.encode("utf-8", "surrogatepass"), refers_to, date)
                member = gz.compress(record) + gz.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((name, records))
        if out is not None:
            out.close()
            done.append((name, records))
        names, counts = [f"{folder}/{name}" for name, _ in done], [records for _, records in done]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    spark = pages.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    return keep(joined.mapInArrow(write, "path string, records long"), "warc-files")


class Record:
    """What one record says, taken in as its bytes come."""

    def __init__(self, with_payload: bool) -> None:
        self.fields: dict[str, str] = {}
        self.http: dict[str, str] = {}
        self.head: bytes | None = b""  # None once the headers are read
        self.http_head: bytes | None = b""
        self.left = 0
        self.tail = b""
        self.block, self.body = hashlib.sha1(), hashlib.sha1()
        self.size = 0
        self.payload: list[bytes] | None = [] if with_payload else None

    @staticmethod
    def _fields(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8").split("\r\n")[1:]
        return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}

    def feed(self, data: bytes) -> None:
        if self.head is not None:
            self.head += data
            at = self.head.find(END)
            if at < 0:
                return
            head, data = self.head[:at], self.head[at + len(END) :]
            if not head.startswith(b"WARC/1."):
                raise ValueError(f"no WARC record: {head[:40]!r}")
            self.head, self.fields = None, self._fields(head)
            self.left = int(self.fields["content-length"])
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.block.update(block)
        if self.http_head is not None:
            self.http_head += block
            at = self.http_head.find(END)
            if at < 0:
                block = b""
            else:
                self.http = self._fields(self.http_head[:at])
                block, self.http_head = self.http_head[at + len(END) :], None
        self.body.update(block)
        self.size += len(block)
        if self.payload is not None:
            self.payload.append(block)
        self.tail += rest

    def close(self) -> None:
        """Check the framing and the digests."""
        name = self.fields.get("warc-record-id", "a record")
        if self.head is not None or self.left or self.tail != END:
            raise ValueError(f"{name}: its length is not what it says")
        if self.fields.get("warc-block-digest", "") != f"sha1:{base32(self.block.digest())}":
            raise ValueError(f"{name}: the block digest differs")
        if self.fields["warc-type"] == "response" and self.digest != base32(self.body.digest()):
            raise ValueError(f"{name}: the payload digest differs")
        if self.fields["warc-type"] == "response" and int(self.http["content-length"]) != self.size:
            raise ValueError(f"{name}: the payload length differs")

    @property
    def digest(self) -> str:
        return self.fields.get("warc-payload-digest", "").removeprefix("sha1:")

    def page(self, field: str) -> int | None:
        number = self.fields.get(field, "").removeprefix(f"<{ID}").removesuffix(">")
        return int(number) if number else None


def read_records(source: BinaryIO, with_payload: bool = False) -> Iterator[Record]:
    """Read an archive record by record."""
    record, member, fed = Record(with_payload), zlib.decompressobj(31), False
    while data := source.read(BLOCK_BYTES):
        while data:
            fed = True
            record.feed(member.decompress(data, BLOCK_BYTES))
            while not member.eof and (more := member.decompress(member.unconsumed_tail, BLOCK_BYTES)):
                record.feed(more)
            if not member.eof:
                break
            data = member.unused_data
            record.close()
            yield record
            record, member, fed = Record(with_payload), zlib.decompressobj(31), False
    if fed:
        raise ValueError("the archive ends within a record")


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the archives named by ``files(path)``, each from its start to its end by one task, which may take several.

    Returns ``(page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload)``; size and digest are those of the full payload, also
    of revisits. ``payload`` is null unless asked for. A broken record ends the
    job with its id. No files: no rows.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(name, compression=None) as source:
                    for r in read_records(source, with_payload):
                        size = r.size if r.fields["warc-type"] == "response" else int(r.http["content-length"])
                        payload = b"".join(r.payload) if with_payload and r.fields["warc-type"] == "response" else None
                        held += len(payload or b"")
                        rows.append(
                            (r.page("warc-record-id"), r.fields.get("warc-target-uri"), size, r.digest, r.fields["warc-type"], r.page("warc-refers-to"), payload)
                        )
                        if len(rows) >= 4096 or held >= FILE_BYTES:
                            yield flush(rows)
                            rows, held = [], 0
                yield flush(rows)

    tasks = max(1, min(READERS, files.count()))
    return files.select("path").coalesce(1).repartition(tasks).mapInArrow(read, schema)


@query()
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    files = write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
