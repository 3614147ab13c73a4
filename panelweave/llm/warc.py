"""WARC archives: write whole-file gzip archives, normalise them to one gzip member a record, read by index.

* :func:`write_archives` marks repeated payloads, then every task writes its records as one gzip stream
  (as crawlers' monolithic archives are) into the shared folder.
* :func:`normalise` inflates each such stream once, in pieces, and rewrites every record as a gzip member of
  its own, with a sidecar index of offsets, so that any record can be read alone.
* :func:`read_records` seeks to the records by the index and parses them.

Files are written by the tasks through pyarrow's file systems (local or mounted paths, HDFS, S3, GCS), never
to a machine-local temporary folder. File names hold the task attempt, and only files of successful attempts
are listed in the manifests, which are frozen in the checkpoint folder: a lost executor leaves at worst an
unlisted file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import byte_values, in_filter, pick, presence_filter
from panelweave.operators.scale import null_safe_join
from panelweave.session import durable, ensure_checkpoint_dir

LEAST_REVISIT = 100  # bytes
ROTATE = 64 << 20  # uncompressed bytes of an archive
PIECE = 1 << 20
MANIFEST = "path string, records long, bytes long"
_DATE = "2000-01-01T00:00:00Z"  # tables hold no crawl time; a fixed one keeps reruns equal


def file_system(uri: str):
    """pyarrow file system and path of a Hadoop-style URI."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def shared_folder(df: DataFrame, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def record(kind: str, page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to=None) -> bytes:
    """One WARC record. A revisit holds the HTTP header, which states the full length, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, block, whole record) of each record of an uncompressed stream."""
    buffer, at = b"", 0  # what is before ``at`` has been given out
    pieces = iter(pieces)

    def until(size: int) -> bool:
        """Read on until ``size`` bytes lie behind ``at``; the only place where the rest of a piece is copied."""
        nonlocal buffer, at
        have = len(buffer) - at
        if have >= size:
            return True
        more = [buffer[at:]]
        while have < size:
            piece = next(pieces, None)
            if piece is None:
                break
            more.append(piece)
            have += len(piece)
        buffer, at = b"".join(more), 0
        return have >= size

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not until(len(buffer) - at + 1):
                if buffer[at:].strip():
                    raise ValueError("archive ends inside a record header")
                return
        lines = buffer[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        head, length = end + 4 - at, int(fields["Content-Length"])
        if not until(head + length + 4):
            raise ValueError("archive ends inside a record block")
        yield fields, buffer[at + head:at + head + length], buffer[at:at + head + length + 4]
        at += head + length + 4


def inflate(stream, size: int = PIECE) -> Iterator[bytes]:
    """Pieces of a gzip file of one or many members, never the whole."""
    engine = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            if engine.eof:
                engine = zlib.decompressobj(31)
            out = engine.decompress(data, 8 * size)
            data = engine.unconsumed_tail or engine.unused_data
            if out:
                yield out
    if not engine.eof:
        raise ValueError("gzip stream is cut short")


def _manifest(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                                      names=["path", "records", "bytes"])


def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def with_digests(pages: DataFrame, filter_bits: int | None = None) -> DataFrame:
    """page_id, url, html, digest, size and refers_to. Only rows whose digest may repeat are shuffled:
    repeated digests are found on (digest, id) rows, and a fixed-size filter of them picks the suspects."""
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    size = F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("long")
    thin = pages.select("page_id", digest.alias("digest"), size.alias("size")).where(F.col("size") >= LEAST_REVISIT)
    groups = durable(thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1 AND first IS NOT NULL").select("digest", "first", F.conv(F.substring("digest", 1, 16), 16, -10).cast("long").alias("key")))
    flags = pages.sparkSession.sparkContext.broadcast(presence_filter(groups, "key", filter_bits))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(value) for value in byte_values(batch, "html")]
            keys = np.frombuffer(b"".join(d.digest()[:8] for d in digests), ">u8").astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("page_id", "url", "html")], pa.array([d.hexdigest() for d in digests], pa.string()),
                                              pa.array(in_filter(flags.value, keys))], names=["page_id", "url", "html", "digest", "suspect"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    marked = pages.mapInArrow(mark, f"page_id {id_type}, url string, html string, digest string, suspect boolean").withColumn("size", size)
    suspects = null_safe_join(marked.where("suspect"), groups.drop("key"), ["digest"])
    refers = F.when((F.col("size") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return (marked.where("NOT suspect").withColumn("refers_to", F.lit(None).cast(id_type))
            .unionByName(suspects.withColumn("refers_to", refers).drop("first"))).drop("suspect")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record of a whole-file gzip archive; returns path, records, bytes per archive.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of at least 100 bytes
    the smallest id is a response and the others revisit it; rows that repeat that id are responses as well,
    and a group without any id has responses only. Null ids and urls are kept as absent. Extra columns are
    ignored; an empty table writes no archive.
    """
    source = pick(pages, page_id=id_col, url=url_col, html=html_col)
    source = source.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        done, out, engine, path, count, size = [], None, None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(engine.flush())
                out.close()
                done.append((f"{folder}/{path}", count, size))
                out = None

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "digest", "size", "refers_to")]
            for payload, page_id, url, digest, length, refers in zip(byte_values(batch, "html"), *columns):
                if out is not None and size >= ROTATE:
                    close()
                if out is None:
                    path, count, size = f"whole-{_attempt()}-{len(done)}.warc.gz", 0, 0
                    out, engine = files.open_output_stream(f"{base}/{path}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                data = (record("response", page_id, url, payload, length, digest) if refers is None
                        else record("revisit", page_id, url, None, length, digest, refers))
                out.write(engine.compress(data))
                count, size = count + 1, size + len(data)
        close()
        yield _manifest(done)

    return durable(with_digests(source).mapInArrow(write, MANIFEST))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite gzip archives (``path``) with one member a record, each beside an index of JSON lines
    {offset, length, id, type}; returns path, records, bytes of the rewritten archives."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for at, path in enumerate(batch.column("path").to_pylist()):
                files, base = file_system(folder)
                files.create_dir(base, recursive=True)
                source_files, source = file_system(path)
                name = f"members-{_attempt()}-{at}-{zlib.crc32(path.encode()):08x}.warc.gz"
                offset = count = 0
                with (source_files.open_input_stream(source, compression=None) as whole,
                      files.open_output_stream(f"{base}/{name}", compression=None) as out,
                      files.open_output_stream(f"{base}/{name}.index", compression=None) as index):
                    for fields, _, data in split_records(inflate(whole)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(data) + engine.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": offset, "length": len(member), "id": fields["WARC-Record-ID"],
                                                "type": fields["WARC-Type"]}).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                done.append((f"{folder}/{name}", count, offset))
            yield _manifest(done)

    tasks = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return durable(archives.repartition(tasks).mapInArrow(rewrite, MANIFEST))


def _page(urn: str | None):
    return urn[len("<urn:page:"):-1] or None if urn else None


def read_records(archives: DataFrame) -> DataFrame:
    """page_id (text), url, record_type, payload (null for a revisit), payload_bytes, payload_digest, refers_to of
    every record, each read alone through the offset index. A response whose payload does not have its stated
    digest fails the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

        def table(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = file_system(path)
                rows, held = [], 0
                with files.open_input_stream(place + ".index", compression=None) as index:
                    entries = index.read().decode().splitlines()
                with files.open_input_file(place) as archive:
                    for entry in map(json.loads, entries):
                        archive.seek(entry["offset"])
                        data = zlib.decompress(archive.read(entry["length"]), 31)
                        fields, block, _ = next(split_records(iter([data])))
                        cut = block.index(b"\r\n\r\n")
                        http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        response = fields["WARC-Type"] == "response"
                        payload = block[cut + 4:] if response else None
                        if response and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], payload,
                                     len(payload) if response else int(http["Content-Length"]), digest, _page(fields.get("WARC-Refers-To"))))
                        held += len(data)
                        if held > ROTATE // 4:
                            yield table(rows)
                            rows, held = [], 0
                yield table(rows)

    return archives.repartition(archives.sparkSession.sparkContext.defaultParallelism).mapInArrow(
        read, "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def round_trip(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write, normalise and read back: the records of all pages, with ids in their own type."""
    folder = folder or shared_folder(pages, "warc")
    id_type = pages.select(columns.get("id_col", "page_id")).schema[0].dataType.simpleString()
    records = read_records(normalise(write_archives(pages, f"{folder}/whole", **columns), f"{folder}/members"))
    return records.withColumns({n: F.col(n).cast(id_type) for n in ("page_id", "refers_to")})
