"""WARC archives: writing, normalising monolithic gzip files, and reading by a sidecar index.

``write`` makes one whole-file gzip stream per part (as careless crawlers do). ``normalise`` inflates such a stream once, in
chunks, and rewrites every record as a gzip member of its own, next to a sidecar index of (offset, length, record id, type) lines; a
file that already has several members is read the same way. ``read`` seeks each member by the index.

Equal payloads of at least ``least`` bytes are archived once: the row with the largest page_id is a response, the others are
revisits that refer to it by record id. Null html counts as empty; null url leaves the header out; a null page_id is written as
``null`` and never is the one referred to while another has an id. Rows that repeat the largest page_id are all responses. An
empty table gives no files and no rows. Other columns are ignored. Control characters of urls are percent-encoded.

Each file is streamed: memory is bounded by one record. Files are written under private names and moved in place, so a task
that runs again on another executor leaves no half file behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.files import resolve
from tidewell.llm.scratch import keep, new_dir

#: Raw bytes after which a part starts another file; groups of copies up to which their table is sent to all executors.
FILE_BYTES = 256 << 20
BROADCAST_GROUPS = 100_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{sha1_32(payload)}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Gunzip a stream of one or more members."""
    z, open_ = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            open_ = True
            yield z.decompress(chunk)
            chunk = z.unused_data
            if z.eof:
                z, open_ = zlib.decompressobj(31), False
    if open_:
        raise ValueError("the gzip stream ends within a member")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Raw records of an inflated stream; holds one record and a chunk."""
    buffer = bytearray()

    def fill() -> bool:
        for chunk in chunks:
            if chunk:
                buffer.extend(chunk)
                return True
        return False

    while True:
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not fill():
                if buffer.strip():
                    raise ValueError("the archive ends within a record")
                return
        length = re.search(rb"\r\nContent-Length: *(\d+)", bytes(buffer[:end]), re.I)
        if length is None or not buffer.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        size = end + 4 + int(length[1]) + 4
        while len(buffer) < size:
            if not fill():
                raise ValueError("the archive ends within a record")
        yield bytes(buffer[:size])
        del buffer[:size]


class _Out:
    """A file that gets its name once it is complete."""

    def __init__(self, uri: str):
        self.uri, (self.store, self.path) = uri, resolve(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.private = f"{self.path}.{uuid.uuid4().hex}"
        self.stream, self.size = self.store.open_output_stream(self.private, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.stream.close()
        self.store.move(self.private, self.path)
        return self.uri


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, and keeper: the page that a copy's payload is archived with, else null. Pages are not shuffled while
    the table of groups with copies is small; beyond that it is a join whose large partitions Spark splits."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    sha = F.sha1(body)
    big = pages.where(F.length(body) >= least).groupBy(sha.alias("sha")).agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = keep(big.where((F.col("n") > 1) & F.col("keeper").isNotNull()).select("sha", "keeper"), "warc-groups")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    rows = pages.withColumn("sha", sha).join(groups, "sha", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper"))
    return rows.select("page_id", "url", "html", F.when(other, F.col("keeper")).alias("keeper"))


def write(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write what ``marked`` gives as monolithic gzip files; returns their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, out, raw, z = TaskContext.get().partitionId(), 0, None, 0, None
        for batch in batches:
            for page_id, url, html, keeper in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    out, raw, z = _Out(f"{folder}/mono-{part:06d}-{seq:06d}.warc.gz"), 0, zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(page_id, url, html.encode(), keeper, keeper is not None)
                out.write(z.compress(data))
                raw += len(data)
                if raw >= FILE_BYTES:
                    out.write(z.flush())
                    yield pa.RecordBatch.from_pydict({"file": [out.close()]})
                    out, seq = None, seq + 1
        if out is not None:
            out.write(z.flush())
            yield pa.RecordBatch.from_pydict({"file": [out.close()]})

    return keep(rows.mapInArrow(run, "file string"), "warc-mono")


def _chunks(uri: str, size: int = 1 << 18) -> Iterator[bytes]:
    store, path = resolve(uri)
    with store.open_input_stream(path, compression=None) as src:
        while chunk := src.read(size):
            yield chunk


def normalise(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each file with a member per record, a task per file; returns (file, index, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                stem = f"{folder}/{name.rpartition('/')[2].replace('mono-', 'norm-').removesuffix('.warc.gz')}"
                out, index, n = _Out(f"{stem}.warc.gz"), _Out(f"{stem}.idx"), 0
                for raw in records(inflated(_chunks(name))):
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(raw) + z.flush()
                    kind, ident = (re.search(rb"\r\n%s: *([^\r]+)" % h, raw)[1].decode() for h in (b"WARC-Type", b"WARC-Record-ID"))
                    index.write(json.dumps([out.size, len(member), ident, kind]).encode() + b"\n")
                    out.write(member)
                    n += 1
                yield pa.RecordBatch.from_pydict({"file": [out.close()], "index": [index.close()], "n_records": [n]})

    return keep(files.repartition(max(1, files.count())).mapInArrow(run, "file string, index string, n_records long"), "warc-norm")


def member(file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record, by its place in the index."""
    store, path = resolve(file)
    with store.open_input_file(path) as src:
        return parse(zlib.decompress(src.read_at(length, offset), 31))


def read(normalised: DataFrame, per_batch: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, by the sidecar index."""

    def page(ident: str):
        return None if ident == "<urn:page:null>" else int(ident[10:-1])

    def rows(file: str, index: str):
        (store, path), lines = resolve(file), b"".join(_chunks(index)).splitlines()
        with store.open_input_file(path) as src:
            for offset, length, ident, kind in map(json.loads, lines):
                headers, block = parse(zlib.decompress(src.read_at(length, offset), 31))
                if (headers["WARC-Record-ID"], headers["WARC-Type"]) != (ident, kind):
                    raise ValueError(f"{index} does not match its archive at {offset}")
                http, _, payload = block.partition(b"\r\n\r\n")
                size, named = int(re.search(rb"Content-Length: (\d+)", http)[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload), sha1_32(payload)) != (size, named):
                    raise ValueError(f"{file} holds a damaged payload at {offset}")
                yield page(ident), size, named, kind, page(headers["WARC-Refers-To"]) if kind == "revisit" else None

    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(rows(file, index))
                for i in range(0, len(found), per_batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*found[i : i + per_batch], strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    return normalised.repartition(max(1, normalised.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write, normalise, and list the normalised archives of ``pages``."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    return normalise(write(marked(pages, least), f"{folder}/mono"), f"{folder}/norm")


def digest(pages: DataFrame) -> DataFrame:
    return read(archive(pages))
