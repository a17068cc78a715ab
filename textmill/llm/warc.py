"""WARC archives with an index first: offset, length, URL and digest per record, then coalesced range reads.

Writing streams each task's pages into gzip-per-record files of the shared folder and returns an index row
per record. A file's name holds the attempt that wrote it, and the index names the files of the attempts
that succeeded, so a lost executor leaves at most files that nothing refers to. The index is stored before
it is used. Reading sorts the selected index rows by file and offset and fetches neighbours in one range.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import given_back, slices_by_bytes
from textmill.shared import shared_folder, stored

LEAST_REVISIT = 100  # bytes: smaller payloads are written each
FILE_BYTES = 1 << 30
GAP = 16 << 10  # bytes between two records that one range may still span
RANGE = 8 << 20
STRETCH = 4 << 20  # bytes of an archive whose records one task reads
TASK = 64 << 20  # bytes that a reading task gets, about
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def file_system(uri: str):
    """The file system of a folder that executors share, and the folder's path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, compressed by itself. A revisit has the response's head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 5, mtime=0)


def parsed(data: bytes) -> dict:
    """The fields of one decompressed record, its payload, and the length that its head gives."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(out["Content-Length"])]
    if len(block) != int(out["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    out["payload"] = payload
    out["size"] = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
    return out


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row and returns the index; store it before use, as each evaluation writes anew.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest id are responses and
    the others revisit that id. Rows without an id are responses and none revisits them. A null payload is
    empty. Rows that repeat an id and a payload are alike; other columns are not read.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    digests = stored(rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest"), "digests")
    # Partial sums by digest: a payload of which there are very many copies is one row per task here. Only digests
    # meet by digest; payloads are joined by id, of which none is frequent, and rows without an id aren't joined.
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = stored(digests.join(first, "digest").where("page_id > refers_to").distinct(), "revisits")
    found = rows.where("page_id is not null").join(revisits, ["page_id", "digest"], "left")
    rows = found.select("page_id", "url", "payload", "digest", "refers_to").unionByName(rows.where("page_id is null").withColumn("refers_to", F.lit(None).cast("long")))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("kind"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = file_system(folder)
        out, name, n, at = None, "", 0, 0
        for batch in (part for whole in batches for part in slices_by_bytes(whole, 2)):
            index = []
            for r in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, at = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    n += 1
                data = record(r["page_id"], r["url"], r["payload"], r["digest"], r["kind"], r["refers_to"], date)
                out.write(data)
                index.append((name, at, len(data), r["url"], r["digest"], r["page_id"], r["kind"]))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if index:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*index, strict=True), kinds, strict=True)], names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out is not None:
            out.close()
        given_back()

    return rows.mapInArrow(run, INDEX)


def ranges(rows: list[dict], gap: int = GAP, most: int = RANGE) -> Iterator[list[dict]]:
    """Runs of index rows, sorted by file and offset, that one read fetches."""
    run: list[dict] = []
    for r in rows:
        if run and (r["file"] != run[0]["file"] or r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > gap or r["offset"] + r["length"] - run[0]["offset"] > most):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows (see RECORDS), fetched by coalesced ranges; digests are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        opened: dict = {}
        for batch in batches:
            for group in ranges(batch.to_pylist()):
                name = group[0]["file"]
                if name not in opened:
                    for f in opened.values():
                        f.close()
                    opened = {name: store.open_input_file(f"{base}/{name}")}
                start = group[0]["offset"]
                data = opened[name].read_at(group[-1]["offset"] + group[-1]["length"] - start, start)
                out = []
                for r in group:
                    got = parsed(gzip.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]]))
                    digest, kind = got["WARC-Payload-Digest"].removeprefix("sha256:"), got["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(got["payload"]).hexdigest() != digest or len(got["payload"]) != got["size"]):
                        raise ValueError(f"the payload of {got['WARC-Record-ID']} isn't what was written")
                    page, refers = got.get("X-Page-ID"), got.get("X-Refers-To-Page-ID")
                    out.append((None if page is None else int(page), got["WARC-Target-URI"], kind, None if refers is None else int(refers), got["size"], digest, got["payload"] if with_payload and kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        for f in opened.values():
            f.close()
        given_back()

    # Tasks are dealt stretches of the archives, so they read about as many bytes each, however long records are.
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    spots = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return spots.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads all records back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_folder(pages.sparkSession) + "/warc"
    index = stored(write_archives(pages, folder), "warc_index")
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
