"""WARC archives: whole-stream gzip files brought to one gzip member per record, with an index of offsets.

Some crawlers compress an archive as a single stream, which can only be read from its start. The normaliser inflates
such a stream once, record by record, writes every record as a member of its own and notes where each begins, so later
readers fetch any record by offset, and many executors can read one file. On that pass it also applies decisions taken
over the whole corpus, such as which records become revisits of an equal payload.

Every file is named by the attempt of the task that writes it, and the manifest or the index, which hold what attempts
that succeeded have written, tell which files count; those of other attempts are removed at the end. All files are
reached through a URI, so the folder may be on any file system that pyarrow knows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from helixframe.llm._common import bounded_batches, scratch_path, written

#: Uncompressed bytes after which a writer begins another file.
ROLL_BYTES = 256 << 20
#: Bytes of archives that one task reads back, about.
READ_BYTES = 64 << 20
CHUNK = 1 << 20
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"

MANIFEST = "file string, ordinal long, page_id long, payload_bytes long, payload_digest string"
INDEX = "file string, offset long, length long, record_type string, page_id long, payload_digest string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encoded(r: Record) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (r.headers | {"Content-Length": str(len(r.block))}).items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + r.block + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, payload: bytes) -> Record:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    # A line break or an empty address would break the header.
    target = "".join((url or "").split("\r")).replace("\n", "")
    return Record({"WARC-Type": "response", "WARC-Record-ID": f"<{PAGE}{'' if page_id is None else page_id}>", "WARC-Date": DATE, **({"WARC-Target-URI": target} if target else {}), "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http; msgtype=response"}, http + payload)


def revisit(r: Record, refers_to: int | None) -> Record:
    """``r`` without its payload, pointing at the record that holds it."""
    head = r.block[: r.block.index(b"\r\n\r\n") + 4]
    return Record(r.headers | {"WARC-Type": "revisit", "WARC-Profile": REVISIT, "WARC-Refers-To": f"<{PAGE}{'' if refers_to is None else refers_to}>"}, head)


def _page(value: str | None) -> int | None:
    text = (value or "").removeprefix(f"<{PAGE}").removesuffix(">")
    return int(text) if text else None


def inflated(raw: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file in chunks, whether it is one member or many."""
    z, data = zlib.decompressobj(31), raw.read(CHUNK)
    while data:
        out = z.decompress(data, CHUNK)
        if out:
            yield out
        if z.eof:
            data, z = z.unused_data or raw.read(CHUNK), zlib.decompressobj(31)
        else:
            data = z.unconsumed_tail or raw.read(CHUNK)


def records(chunks: Iterator[bytes]) -> Iterator[Record]:
    """The records of an inflated archive, one at a time; a cut or foreign record is an error."""
    held, at = bytearray(), 0

    def need(n: int) -> bool:
        while len(held) - at < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while need(1):
        end = held.find(b"\r\n\r\n", at)
        while end < 0:
            if not need(len(held) - at + 1):
                raise ValueError("archive ends inside a header")
            end = held.find(b"\r\n\r\n", max(at, end))
        lines = bytes(held[at:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one is due")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size, start = int(headers.pop("Content-Length")), end + 4
        if not need(start - at + size + 4):
            raise ValueError("archive ends inside a record")
        yield Record(headers, bytes(held[start : start + size]))
        at = start + size + 4
        if at > CHUNK:
            del held[:at]
            at = 0


def normalise(raw: BinaryIO, out: BinaryIO, rewrite: Callable[[Record], Record] = lambda r: r) -> Iterator[tuple[int, int, Record]]:
    """Copy an archive record by record, each as its own gzip member; yields (offset, length, record written)."""
    offset = 0
    for r in records(inflated(raw)):
        new = rewrite(r)
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(encoded(new)) + z.flush()
        out.write(member)
        yield offset, len(member), new
        offset += len(member)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _attempt() -> str:
    return f"{TaskContext.get().taskAttemptId()}"


def _only(folder: str, table: DataFrame) -> None:
    """Remove the archives below ``folder`` that ``table`` does not name: failed attempts, or slow ones, have left them."""
    from pyarrow import fs

    files, base = _open(folder)
    count = {r["file"] for r in table.select("file").distinct().toLocalIterator()}
    for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.lstrip(".").removesuffix(".idx") not in count or f.base_name.startswith("."):
            files.delete_file(f.path)


def write_streams(pages: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as single-stream archives below ``folder``; gives their manifest (see MANIFEST)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        part, n, size, sink = TaskContext.get().partitionId(), 0, 0, None
        z = name = None

        def close() -> None:
            if sink is not None:
                sink.write(z.flush())
                sink.close()
                files.move(f"{base}/.{name}", f"{base}/{name}")

        ordinal = 0
        for b in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sink is None or size >= roll:
                    close()
                    name, n, size, ordinal = f"{part:06d}-{n:05d}-{_attempt()}.warc.gz", n + 1, 0, 0
                    sink, z = files.open_output_stream(f"{base}/.{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                payload = (html or "").encode()
                r = response(page_id, url, payload)
                data = encoded(r)
                sink.write(z.compress(data))
                size += len(data)
                rows.append((name, ordinal, page_id, len(payload), r.headers["WARC-Payload-Digest"].removeprefix("sha1:")))
                ordinal += 1
            yield _batch(rows, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), MANIFEST)
        close()

    manifest = written(pages.select("page_id", "url", "html").mapInArrow(run, MANIFEST), "manifest")
    _only(folder, manifest)
    return manifest


def _batch(rows: list[tuple], types: tuple, ddl: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in ddl.split(", ")])


def decisions(manifest: DataFrame, least_bytes: int = 0) -> DataFrame:
    """manifest with keep, file and ordinal of the record that holds each payload: the one of the largest page_id.

    Records of fewer than ``least_bytes`` hold their own. Only the manifest's short rows are moved; a payload with very
    many records is summed up before it is joined.
    """
    own = F.struct("page_id", "file", "ordinal")
    best = manifest.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max(own).alias("keep"))
    return manifest.join(best, ["payload_digest", "payload_bytes"], "left").withColumn("keep", F.coalesce("keep", own))


def normalise_streams(decided: DataFrame, source: str, folder: str) -> DataFrame:
    """Normalise the archives below ``source`` into ``folder``, with revisits as ``decided`` says; gives the index (see INDEX).

    Each archive is inflated once by one task, as its records arrive, with the decisions on it in the same order; beside
    each new archive stands a sidecar file with a line of JSON to each record. Neither is ever held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, base), (ours, to) = _open(source), _open(folder)
        ours.create_dir(to, recursive=True)
        name = new = stream = None
        sinks: dict[str, BinaryIO] = {}
        verdict: list[tuple] = []

        def rewrite(r: Record) -> Record:
            keeps, refers_to = verdict[0]
            return r if keeps else revisit(r, refers_to)

        def close() -> None:
            if name is not None:
                if next(stream, None) is not None:
                    raise ValueError(f"{name} has more records than its manifest")
                for x, f in sinks.items():
                    f.close()
                    ours.move(f"{to}/.{x}", f"{to}/{x}")

        for b in batches:
            rows = []
            for file, ordinal, page_id, keep in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    close()
                    name, new = file, f"{file.removesuffix('.warc.gz')}-{_attempt()}.warc.gz"
                    sinks = {x: ours.open_output_stream(f"{to}/.{x}", compression=None) for x in (new, new + ".idx")}
                    stream = normalise(io.BufferedReader(files.open_input_stream(f"{base}/{file}", compression=None), CHUNK), sinks[new], rewrite)
                verdict[:] = [(keep["file"] == file and keep["ordinal"] == ordinal, keep["page_id"])]
                offset, length, r = next(stream)
                if _page(r.headers["WARC-Record-ID"]) != page_id:
                    raise ValueError(f"{file} and its manifest differ at record {ordinal}")
                row = (new, offset, length, r.headers["WARC-Type"], page_id, r.headers["WARC-Payload-Digest"].removeprefix("sha1:"))
                sinks[new + ".idx"].write((json.dumps(dict(zip(("file", "offset", "length", "type", "page_id", "digest"), row, strict=True))) + "\n").encode())
                rows.append(row)
            yield _batch(rows, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), INDEX)
        close()

    # A task to an archive, whatever the size of the manifest, by whose bytes Spark would else join the tasks.
    rows = written(decided.select("file", "ordinal", "page_id", "keep"), "decisions")
    n = rows.select("file").distinct().count()
    index = written(rows.repartitionByRange(max(n, 1), "file").sortWithinPartitions("file", "ordinal").mapInArrow(run, INDEX), "index")
    _only(folder, index)
    return index


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives below ``folder``, each fetched by its offset (see RECORDS).

    payload_bytes and payload_digest are the full payload's also where a revisit holds none; a response's are computed
    from what was read, and one that doesn't match its header is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        name = f = None
        for b in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, files.open_input_file(f"{base}/{file}")
                (r,) = records(iter([zlib.decompress(f.read_at(length, offset), 31)]))
                kind, stated = r.headers["WARC-Type"], r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                head, _, payload = r.block.partition(b"\r\n\r\n")
                size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                if kind == "response" and (digest(payload) != stated or len(payload) != size):
                    raise ValueError(f"damaged payload in {file} at {offset}")
                refers = _page(r.headers["WARC-Refers-To"]) if kind == "revisit" else None
                rows.append((_page(r.headers["WARC-Record-ID"]), r.headers.get("WARC-Target-URI"), size, stated, kind, refers, payload if kind == "response" else None))
            yield _batch(rows, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), RECORDS)
        if f is not None:
            f.close()

    size = index.agg(F.sum("length").alias("n"), F.countDistinct("file").alias("files")).first()
    parts = max(size["files"], -(-(size["n"] or 0) // READ_BYTES), 1)
    dealt = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORDS)


def archived(pages: DataFrame, folder: str | None = None, *, least_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``folder`` (one in the shared scratch folder) and read the archives back.

    Gives a row per page as in RECORDS. A null html is an empty payload. Of records with equal payloads the one with the
    largest page_id is the response, others revisit it; of rows that share that page_id too, one is. A null page_id is
    the smallest. A null or empty url leaves the header out, and line breaks in one are dropped. Repeated rows are
    archived once each. A payload of any length is taken whole, by a task that holds one record at a time. No row gives
    no archive and no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    root = folder or scratch_path(spark, "warc")
    manifest = write_streams(pages, f"{root}/raw")
    index = normalise_streams(decisions(manifest, least_bytes), f"{root}/raw", f"{root}/warc")
    return read_records(index, f"{root}/warc")
