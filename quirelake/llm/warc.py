"""Deterministic sharded WARC writer for pages, and a reader.

1. Each page becomes a response record: headers, digests and a record id are made from the page
   alone, and the record is compressed as a gzip member of its own, without time stamp. A first pass
   keeps only each member's key and size; the last makes the same members again, which costs less
   than to write them twice.
2. The records' keys (url, page_id, payload digest) and compressed sizes are range-sorted; a
   running sum of the sizes over all keys, by ranges and then within, gives each key a file: a file takes
   the keys whose sum falls in its share of ``file_bytes``. That depends on the pages alone, not on the
   cluster's partitioning. Records with the same key stay in one file.
3. Each file's records go to one task, in order. It writes under a temporary name of its own and renames
   the file when it is complete, so a task that is repeated after a lost executor gives the same
   file. When all files are there, the manifest is written in the same way; what it doesn't list
   isn't part of the dataset.

Defined results: a null url gives a record without target, sorted first; null html gives an empty
payload, as empty html does. A null page_id sorts first. Repeated rows give records with ids of their own,
by their number among equals. A null date is the default one. An empty
table gives an empty manifest and index. Control characters and spaces in urls are percent-encoded. Other
columns aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.session import materialize, scratch_path

FILE_BYTES = 64 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
_LOWEST = -(1 << 63)
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, block_digest string"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f]")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _record(kind: str, record_id: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _uuid(*parts: object) -> str:
    return str(uuid.UUID(bytes=hashlib.sha256("\0".join(map(str, parts)).encode("utf-8", "replace")).digest()[:16], version=5))


def page_record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> tuple[bytes, str, str]:
    """The record of a page, its payload digest and its block digest."""
    payload = (html or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    payload_digest, block_digest = _sha1(payload), _sha1(block)
    target = [] if url is None else [("WARC-Target-URI", _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))]
    number = [] if page_id is None else [("WARC-Page-ID", str(page_id))]
    fields = [*target, *number, ("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", block_digest), ("Content-Type", "application/http; msgtype=response")]
    return _record("response", _uuid(page_id, url, payload_digest), date, fields, block), payload_digest, block_digest


def _repeated(member: bytes, number: int) -> bytes:
    """The member with a record id of its own, for the ``number``-th repetition of a page."""
    record = gzip.decompress(member)
    old = re.search(rb"urn:uuid:([0-9a-f-]+)", record)[1]
    return _member(record.replace(old, _uuid(old.decode(), number).encode(), 1))


def info_record(file: str, date: str = DATE) -> bytes:
    return _record("warcinfo", _uuid(file), date, [("WARC-Filename", file), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def _members(whole: bool):
    """Keys and sizes of the members, and with ``whole`` the members and what the index needs."""
    names = ["k_url", "k_page", "payload_digest", "size"] + ["page_id", "url", "block_digest", "member"] * whole
    types = [pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.int64(), pa.string(), pa.string(), pa.binary()] * whole

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for page_id, url, html, date in zip(*(c.to_pylist() for c in part.columns)):
                    record, payload, block = page_record(page_id, url, html, date or DATE)
                    member = _member(record)
                    rows.append((url or "", _LOWEST if page_id is None else page_id, payload, len(member), page_id, url, block, member)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return go


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sum of the sizes before each key within the task's range."""
    total = 0
    for batch in batches:
        size = batch.column(3).to_numpy()
        before = total + size.cumsum() - size
        total += int(size.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=["k_url", "k_page", "payload_digest", "size", "range", "before"])


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _replace(system: fs.FileSystem, temporary: str, final: str) -> None:
    if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(final).type != fs.FileType.NotFound:
        system.delete_file(final)
    system.move(temporary, final)


def _writer(folder: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        name, stream, temporary, offset = None, None, "", 0
        last, repetition = None, 0

        def close() -> None:
            stream.close()
            _replace(system, temporary, f"{root}/{name}")

        for batch in batches:
            files, offsets, sizes = [], [], []
            for number, *key, member in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3)), batch.column(6)):
                file = f"part-{number:06d}.warc.gz"
                if file != name:
                    if stream:
                        close()
                    name, offset = file, 0
                    temporary = f"{root}/_tmp-{file}-{uuid.uuid4().hex}"
                    stream = system.open_output_stream(temporary, compression=None)
                    info = _member(info_record(file))
                    stream.write(info)
                    offset += len(info)
                data = member.as_py()
                repetition = repetition + 1 if key == last else 0
                last = key
                if repetition:
                    data = _repeated(data, repetition)
                stream.write(data)
                sizes.append(len(data))
                files.append(file)
                offsets.append(offset)
                offset += len(data)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(files), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), batch.column(3), batch.column(4)], names=["page_id", "url", "file", "offset", "length", "payload_digest", "block_digest"])
        if stream:
            close()

    return go


def write(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, date: Column | str = DATE) -> DataFrame:
    """Writes the pages to ``folder`` (a new one in the shared folder if none is given) and returns an index: a row for each record.

    date: the time of capture, one for all or a column of text or timestamps."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    if not isinstance(date, str):
        date = F.date_format(date.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pages = pages.select("page_id", "url", "html", (F.lit(date) if isinstance(date, str) else date).alias("date"))
    keys = ["k_url", "k_page", "payload_digest"]
    sizes = pages.mapInArrow(_members(False), "k_url string, k_page long, payload_digest string, size long").groupBy(keys).agg(F.sum("size").alias("size")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    sizes = sizes.withColumn("range", F.spark_partition_id())
    sums = materialize(sizes.mapInArrow(_running, "k_url string, k_page long, payload_digest string, size long, range int, before long"), "sums")
    ranges = sums.groupBy("range").agg(F.sum("size").alias("size"), F.min(F.struct(*keys)).alias("least")).orderBy("least").collect()  # one row for each range
    base, total = [], 0
    for r in ranges:
        base.append((r["range"], total))
        total += r["size"]
    sums = sums.join(F.broadcast(spark.createDataFrame(base, "range int, base long")), "range")
    share = F.floor((F.col("base") + F.col("before")) / F.lit(file_bytes))
    firsts = sums.groupBy(share.alias("share")).agg(F.min(F.struct(*keys)).alias("least")).orderBy("share").collect()  # one row for each file
    bounds = spark.sparkContext.broadcast([_sortable(*r.least) for r in firsts])

    make = _members(True)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make(batches):
            own = [bisect_right(bounds.value, _sortable(*key)) - 1 for key in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], names=["number", *batch.schema.names])

    placed = pages.mapInArrow(assign, "number int, k_url string, k_page long, payload_digest string, size long, page_id long, url string, block_digest string, member binary")
    ordered = placed.repartitionById(max(1, len(firsts)), F.col("number")).sortWithinPartitions("number", *keys, "member")
    index = materialize(ordered.select("number", "page_id", "url", "payload_digest", "block_digest", "size", "member").mapInArrow(_writer(folder), INDEX), "index")
    _commit(folder, index)
    return index


def _sortable(url: str, page: int, digest: str) -> tuple[bytes, int, str]:
    """Spark's order of strings: by bytes."""
    return url.encode("utf-8", "replace"), page, digest


def _commit(folder: str, index: DataFrame) -> None:
    files = index.groupBy("file").agg(F.count("*").alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes")).orderBy("file").toLocalIterator()
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    temporary = f"{root}/_tmp-manifest-{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as f:
        for r in files:
            f.write((json.dumps(r.asDict()) + "\n").encode())
    _replace(system, temporary, f"{root}/MANIFEST.jsonl")
    for info in system.get_file_info(fs.FileSelector(root)):
        if info.base_name.startswith("_tmp-part-"):
            system.delete_file(info.path)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, html, intact (both digests agree) of the response records in the files of the manifest."""
    system, root = _filesystem(folder)
    with system.open_input_stream(f"{root}/MANIFEST.jsonl") as f:
        names = [json.loads(line)["file"] for line in f.read().splitlines()]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows = [r for r in parse(gzip.GzipFile(fileobj=io.BufferedReader(f)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, [pa.int64(), pa.string(), pa.string(), pa.bool_()])], names=["page_id", "url", "html", "intact"])

    files = spark.createDataFrame([(n,) for n in names], "file string")
    return files.repartition(max(1, len(names))).mapInArrow(go, "page_id long, url string, html string, intact boolean")


def parse(f) -> Iterator[tuple[int | None, str | None, str, bool]]:
    """Response records of an uncompressed stream."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := f.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            head[k] = v
        block = f.read(int(head["Content-Length"]))
        if head["WARC-Type"] != "response":
            continue
        payload = block.partition(b"\r\n\r\n")[2]
        intact = head["WARC-Block-Digest"] == _sha1(block) and head["WARC-Payload-Digest"] == _sha1(payload)
        yield int(head["WARC-Page-ID"]) if "WARC-Page-ID" in head else None, head.get("WARC-Target-URI"), payload.decode(), intact
