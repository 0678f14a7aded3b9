"""WARC archives: write whole-file gzip streams, rewrite each record as its own member with an offset index, read back."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, frugal

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: An archive is closed once its payloads reach this; it bounds a normaliser's task.
ROLL_BYTES = 48 << 20
CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"


def store(uri: str):
    """File system and path of a URI, as Arrow opens it (local, HDFS, S3 ...)."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(archive: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{ordinal}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def clean(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an inflated stream; holds one record and a chunk."""
    held = bytearray()

    def more(n: int) -> bool:
        while len(held) < n:
            piece = next(chunks, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more(seen + 1):
                if held.strip():
                    raise ValueError("an archive ends within a record's header")
                return
        fields = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
        start, n = end + 4, int(fields["Content-Length"])
        if not more(start + n + 4):
            raise ValueError("an archive ends within a record's block")
        yield fields, bytes(held[start : start + n])
        del held[: start + n + 4]


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or more, a chunk at a time."""
    zipped = zlib.decompressobj(31)
    data = stream.read(CHUNK)
    while data:
        out = zipped.decompress(data, 4 * CHUNK)
        if out:
            yield out
        data = zipped.unconsumed_tail
        if zipped.eof:
            data, zipped = zipped.unused_data, zlib.decompressobj(31)
        data = data or stream.read(CHUNK)


def member(data: bytes, level: int = 6) -> bytes:
    zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
    return zipped.compress(data) + zipped.flush()


def write_archives(pages: DataFrame, base: str, roll: int = ROLL_BYTES) -> DataFrame:
    """One response record a row into whole-file gzip streams under base; a row of what was written for each.

    A task writes under a name of its own and renames at the end, so a task run again replaces its files.
    """

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, files, path = task.partitionId(), *store(base)
        files.create_dir(path, recursive=True)
        n, out, zipped, size, ordinal, name = 0, None, None, 0, 0, ""

        def close():
            out.write(zipped.flush())
            out.close()
            files.move(f"{path}/.{name}.{task.taskAttemptId()}", f"{path}/{name}")

        for b in batches:
            rows = []
            for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                if out is None or size >= roll:
                    if out is not None:
                        close()
                    name = f"whole-{part:06d}-{n:04d}.warc.gz"
                    n, size, ordinal = n + 1, 0, 0
                    out, zipped = files.open_output_stream(f"{path}/.{name}.{task.taskAttemptId()}"), zlib.compressobj(3, zlib.DEFLATED, 31)
                payload = (html or "").encode()
                sha = digest(payload)
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(name, ordinal)), ("WARC-Date", DATE), ("WARC-Target-URI", clean(url)), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-Id", page), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response")]
                out.write(zipped.compress(record(fields, HTTP + payload)))
                rows.append((page, sha, len(payload), name, ordinal, part))
                size, ordinal = size + len(payload) + 512, ordinal + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "sha", "n_bytes", "archive", "ordinal", "part"])
        if out is not None:
            close()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(frugal(run), "page_id long, sha string, n_bytes long, archive string, ordinal long, part long")


def revisits(written: DataFrame, least_bytes: int = 0) -> DataFrame:
    """archive, part and the revisit records in it. Of records of equal payload the largest page_id stays a response."""
    mark = F.struct(F.col("page_id").alias("page_id"), F.col("archive").alias("archive"), F.col("ordinal").alias("ordinal"))
    last = written.where(F.col("n_bytes") >= least_bytes).groupBy("sha", "n_bytes").agg(F.max(mark).alias("last"), F.count("*").alias("copies")).where("copies > 1").select("sha", "n_bytes", "last")
    told = written.join(last, ["sha", "n_bytes"], "left")
    again = F.when(F.col("last").isNotNull() & ~F.col("last").eqNullSafe(mark), F.struct(F.col("ordinal").alias("ordinal"), F.col("last.page_id").alias("page_id"), F.col("last.archive").alias("archive"), F.col("last.ordinal").alias("of")))
    return told.groupBy("archive", "part").agg(F.collect_list(again).alias("again"))  # at most an archive's records


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Inflate each archive once, write every record as its own gzip member, and beside it an offset index."""

    def run(batches):
        from pyspark import TaskContext

        task, (files, src), path = TaskContext.get(), store(source), store(target)[1]
        files.create_dir(path, recursive=True)
        for b in batches:
            done = []
            for archive, again in zip(b.column("archive").to_pylist(), b.column("again").to_pylist(), strict=True):
                other, name, at = {x["ordinal"]: x for x in again}, archive.replace("whole", "members"), 0
                tmp = [f"{path}/.{name}{end}.{task.taskAttemptId()}" for end in ("", ".idx")]
                with files.open_input_stream(f"{src}/{archive}", compression=None) as stream, files.open_output_stream(tmp[0], compression=None) as out, files.open_output_stream(tmp[1], compression=None) as index:
                    for ordinal, (fields, block) in enumerate(records(inflate(stream))):
                        fields.pop("Content-Length")
                        if hit := other.get(ordinal):
                            fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(hit["archive"], hit["of"]), "X-Refers-To-Page": hit["page_id"]}
                            block = HTTP
                        data = member(record([*fields.items()], block))
                        out.write(data)
                        index.write((json.dumps([ordinal, at, len(data), fields["WARC-Type"]]) + "\n").encode())
                        at += len(data)
                for t, end in zip(tmp, ("", ".idx"), strict=True):
                    files.move(t, f"{path}/{name}{end}")
                done.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    return archives.mapInArrow(frugal(run), "archive string")


def read_archives(archives: DataFrame, base: str) -> DataFrame:
    """A row for each record, found through the offset indexes; a response's digest and size are taken from its payload."""
    columns = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64())]

    def run(batches):
        files, path = store(base)
        for b in batches:
            for name in b.column("archive").to_pylist():
                rows = []
                with files.open_input_file(f"{path}/{name}") as data, files.open_input_stream(f"{path}/{name}.idx", compression=None) as index:
                    for line in index.read().splitlines():
                        _, at, n, kind = json.loads(line)
                        data.seek(at)
                        ((fields, block),) = records(iter([zlib.decompress(data.read(n), 31)]))
                        if kind != fields["WARC-Type"]:
                            raise ValueError(f"{name}: the index is of another archive")
                        size, sha = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            size, sha = len(payload), digest(payload)
                        page, other = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                        rows.append((page and int(page), size, sha, kind, other and int(other), name, at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], [c for c, _ in columns])

    return archives.mapInArrow(frugal(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long")


def round_trip(pages: DataFrame, least_bytes: int = 0, roll: int = ROLL_BYTES) -> DataFrame:
    """Write, normalise and read back every page.

    A null html is an empty payload, a null url no target, a null page_id sorts below all. Rows with equal
    page_id and payload count as records of their own: one is the response, the others refer to its page_id.
    Payloads are compared by SHA-1 and length. Extra columns are ignored; an empty table gives no rows.
    html is never shuffled: archives are written from the scan, and only digests meet.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    whole, single = scratch.path("whole"), scratch.path("members")
    written = scratch.table(write_archives(pages, whole, roll), "written")
    parts = (written.agg(F.max("part")).first()[0] or 0) + 1
    archives = scratch.table(normalise(revisits(written, least_bytes).repartitionById(parts, F.col("part").cast("int")).select("archive", "again"), whole, single), "members")
    scratch.drop(whole)
    return read_archives(archives.repartition(parts, "archive"), single)
