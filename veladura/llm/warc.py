"""WARC archives written by Spark's tasks, a gzip member for each record, and read back by a salvaging reader.

The folder of an archive has to be shared by driver and executors: tasks write binary files, which Spark has no
sink for. The reader takes plain archives and gzip members, also mixed. After a failed check (version line,
header, length, record end, block or payload digest, gzip member) it searches for the next member or version
line, whichever comes first, goes on there and reports the bytes between as a quarantined gap. Of a broken
member the records before the fault are kept.

Equal payloads, empty ones included: the one with the largest page_id is the response, the others revisit it.
Null html is an empty payload, a null url leaves the target out, a null page_id is written as an empty id and
never referred to while another has an id. Repeated rows with the largest page_id are all responses. An empty
table writes an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import small_batches

END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
STEP = 1 << 14
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ATTEMPTS = "_attempts"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int
    stop: int


@dataclass
class Gap:
    start: int
    stop: int
    reason: str


def _record(data: bytes, at: int) -> Record | str:
    """The record at a place, or what is wrong with it."""
    version = VERSION.match(data, at)
    if not version:
        return "no version line"
    stop = data.find(END, version.end() - 2)
    if stop < 0:
        return "header without end"
    headers = {}
    for line in data[version.end() : max(version.end(), stop)].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            return "broken header line"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no content length"
    begin = stop + 4
    block, last = data[begin : begin + int(length)], begin + int(length)
    if data[last : last + 4] != END:
        return "no record end where the length says"
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + digest(block):
        return "block digest differs"
    if headers.get("warc-type") == "response" and "warc-payload-digest" in headers:
        payload = block.partition(END)[2]
        if headers["warc-payload-digest"] != "sha1:" + digest(payload):
            return "payload digest differs"
    return Record(headers, block, at, last + 4)


def salvage_plain(data: bytes, base: int = 0) -> Iterator[Record | Gap]:
    at, lost = 0, None
    while at < len(data):
        got = _record(data, at)
        if isinstance(got, Record):
            if lost:
                yield Gap(base + lost[0], base + at, lost[1])
                lost = None
            yield Record(got.headers, got.block, base + got.start, base + got.stop)
            at = got.stop
            continue
        lost = lost or (at, got)
        following = VERSION.search(data, at + 1)
        at = following.start() if following else len(data)
    if lost:
        yield Gap(base + lost[0], base + len(data), lost[1])


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive. Places are bytes of the file (for members: of the member's start)."""
    at, lost, until, drawn = 0, None, 0, set()
    while at < len(data):
        if data.startswith(MEMBER, at):
            out, stop, bad = _inflated(data, at)
            found = [*salvage_plain(out)]
            records = [x for x in found if isinstance(x, Record)]
            # bytes that only look like a member, or a payload that is one, stay in the gap
            if not bad and lost and not records:
                bad = "member without records"
            if bad:
                yield from (Record(x.headers, x.block, at, at) for x in records)
                until, drawn = stop, {out[x.start : x.stop] for x in records}
            else:
                found = [Record(x.headers, x.block, at, stop) if isinstance(x, Record) else Gap(at, stop, x.reason) for x in found]
        else:
            got = _record(data, at)
            bad = got if isinstance(got, str) else ""
            if not bad:
                # a stored block shows its records as they are: they came with its broken member
                found, stop = ([] if at < until and data[at : got.stop] in drawn else [got]), got.stop
        if bad:
            lost = lost or (at, bad)
            following = START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost:
            yield Gap(lost[0], at, lost[1])
            lost = None
        yield from found
        at = stop
    if lost:
        yield Gap(lost[0], len(data), lost[1])


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What a member gives, where it or what could be read of it ends, and what is wrong with it."""
    inflate, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        for i in range(at, len(data), STEP):
            out.append(inflate.decompress(view[i : i + STEP]))
            if inflate.eof:
                return b"".join(out), min(i + STEP, len(data)) - len(inflate.unused_data), ""
        return b"".join(out), len(data), "member without end"
    except zlib.error:
        return *_before_fault(view, at), "broken member"


def _before_fault(view: memoryview, at: int) -> tuple[bytes, int]:
    """All that a broken member gives before the fault: steps halve down to the faulty byte, whose output is drawn singly."""
    inflate, out, step = zlib.decompressobj(31), [], STEP
    while at < len(view):
        kept = inflate.copy()
        try:
            out.append(inflate.decompress(view[at : at + step]))
            at += step
            continue
        except zlib.error:
            inflate = kept
        if step > 1:
            step //= 2
            continue
        try:
            rest = bytes(view[at : at + 1])
            while piece := inflate.decompress(rest, 1):
                out.append(piece)
                rest = inflate.unconsumed_tail
        except zlib.error:
            pass
        break
    return b"".join(out), min(at, len(view))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = batch.column(2)
        got = [digest(x or b"") for x in html.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), html.fill_null(""), pa.array(got)], names=["page_id", "url", "html", "digest"])


def records(pages: DataFrame) -> DataFrame:
    """(record): the text of each page's record, without its end."""
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(_digests, f"page_id {kind}, url string, html string, digest string")
    last = rows.groupBy("digest").agg(F.max("page_id").alias("last"))
    rows = rows.join(last, "digest")
    is_response = F.col("page_id").eqNullSafe(F.col("last"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.when(is_response, F.concat(F.lit(HTTP), "html")).otherwise(F.lit(HTTP))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
            line("WARC-Record-ID", urn(F.col("page_id"))),
            F.coalesce(line("WARC-Target-URI", target), F.lit("")),
            line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            line("WARC-Payload-Bytes", F.octet_length("html").cast("string")),
            F.when(is_response, "").otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("last"))))),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("record")
    )


def _files(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^file:(//)?(?=/)", "", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _write(path: str, per_file: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _files(path)
        names, sink, room = [], None, 0
        try:
            for batch in batches:
                for record in batch.column(0):
                    if not room:
                        if sink:
                            sink.close()
                        names.append(uuid.uuid4().hex)
                        sink, room = store.open_output_stream(f"{root}/{ATTEMPTS}/{names[-1]}", compression=None), per_file
                    sink.write(zlib.compress(record.as_py(), wbits=31))
                    room -= 1
        finally:
            if sink:
                sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return run


def write(pages: DataFrame, path: str, per_file: int = 2000) -> None:
    """One gzip member for each record. Tasks write under names of their own; only the files of those that Spark
    counts as done are moved into the archive."""
    store, root = _files(path)
    store.create_dir(f"{root}/{ATTEMPTS}", recursive=True)
    rows = records(small_batches(pages)).select(F.concat("record", F.lit(END.decode())).cast("binary").alias("record"))
    names = rows.mapInArrow(_write(path, per_file), "name string").toArrow()["name"].to_pylist()
    for i, name in enumerate(names):
        store.move(f"{root}/{ATTEMPTS}/{name}", f"{root}/part-{i:05d}.warc.gz")
    if not names:
        store.open_output_stream(f"{root}/part-00000.warc.gz", compression=None).close()


FOUND = "file string, start long, stop long, gap string, record_id string, record_type string, refers_to string, target string, payload_bytes long, payload_digest string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in FOUND.split(", ")]
    for batch in batches:
        for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for x in salvage(data.as_py()):
                if isinstance(x, Gap):
                    rows.append((file, x.start, x.stop, x.reason, None, None, None, None, None, None))
                    continue
                h = x.headers
                payload = x.block.partition(END)[2] if h.get("warc-type") == "response" else None
                said = h.get("warc-payload-bytes", "")
                rows.append(
                    (
                        file, x.start, x.stop, None, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-refers-to"), h.get("warc-target-uri"),
                        len(payload) if payload is not None else int(said) if said.isdigit() else None,
                        digest(payload) if payload is not None else h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    )
                )
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record or gap of the archives under a path; gap holds why bytes were set aside."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_read, FOUND)
