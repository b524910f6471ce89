"""Document files as a data source, and DOCX packages rewritten with everything but the replaced text kept.

`spark.read.format("veladura_files").load(folder)` gives one row for each file that the allow-list has, text or error;
partitions are runs of files of about `maxBytes` bytes. `df.write.format("veladura_files").save(folder)` writes rows
(name, content) as files: each task into a folder of its own below a pending one, which is moved into place when the whole
job commits, one move a task, and removed when it aborts, so that a failed job or a lost task leaves nothing. Folders
must be shared by driver and executors; any that pyarrow opens will do.

A package is rewritten by splicing the bytes of its parts: texts of a paragraph are put together, values claimed in one pass,
tokens written into the run in which a value begins, and what a value covers of later runs is cut. Runs, their formats,
name spaces and all other bytes of a part stay, other parts are copied as they are.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from veladura.functions.terms import Claims, claimed

from . import documents

NAME = "veladura_files"
#: Name spaces of word processing parts: fixed values.
SPACES = ("http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.oclc.org/ooxml/wordprocessingml/main")
PRESERVE = "http://www.w3.org/XML/1998/namespace space"
PARTS = re.compile(r"word/(?:document|header\d*|footer\d*)\.xml")
LARGEST = 256 << 20
COLUMNS = "path string, length long, modificationTime timestamp, ext string, text string, extractor string, error string"


def opened(path: str):
    """(file system, path in it). pyarrow.fs starts threads when it is imported, which a process that forks must not have: only
    what runs a task or plans imports it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def content_of(path: str) -> bytes:
    at, own = opened(path)
    with at.open_input_stream(own) as f:
        return f.read()


# --- rewriting ------------------------------------------------------------------------------------------------


@dataclass
class Piece:
    """The text of one w:t: where its bytes are, where its start tag begins and its name ends, whether white space is kept."""

    tag: int
    kept: bool
    start: int = -1
    stop: int = -1
    parts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def paragraphs(data: bytes) -> list[list[Piece]]:
    """The pieces of every paragraph of a part in UTF-8; those of a paragraph inside another's text box are the inner one's."""
    out: list[list[Piece]] = []
    stack: list[list[Piece]] = []
    now: Piece | None = None
    parser = expat.ParserCreate(namespace_separator=" ")

    def begin(name: str, attributes: dict) -> None:
        nonlocal now
        space, _, tag = name.rpartition(" ")
        if space not in SPACES:
            return
        if tag == "p":
            stack.append([])
            out.append(stack[-1])
        elif tag == "t" and stack:
            now = Piece(parser.CurrentByteIndex, attributes.get(PRESERVE) == "preserve")

    def text(chars: str) -> None:
        if now is not None:
            if now.start < 0:
                now.start = parser.CurrentByteIndex
            now.parts.append(chars)

    def section() -> None:
        if now is not None and now.start < 0:
            now.start = parser.CurrentByteIndex

    def end(name: str) -> None:
        nonlocal now
        space, _, tag = name.rpartition(" ")
        if space not in SPACES:
            return
        if tag == "p" and stack:
            stack.pop()
        elif tag == "t" and now is not None:
            if now.parts:
                now.stop = parser.CurrentByteIndex
                stack[-1].append(now)
            now = None

    parser.StartElementHandler, parser.EndElementHandler = begin, end
    parser.CharacterDataHandler, parser.StartCdataSectionHandler = text, section
    parser.Parse(data, True)
    return out


def spread(texts: list[str], claims: Claims) -> list[str]:
    """Texts that follow one another with what is claimed of all of them together replaced: each token stands in the text in
    which its span begins."""
    edges, at = [], 0
    for t in texts:
        at += len(t)
        edges.append(at)
    out: list[list[str]] = [[] for _ in texts]
    own, at = 0, 0

    def copy(stop: int) -> None:
        nonlocal own, at
        while at < stop:
            while edges[own] <= at:
                own += 1
            upto = min(stop, edges[own])
            out[own].append(claims.text[at:upto])
            at = upto

    for start in claims.starts:
        copy(start)
        while edges[own] <= start:
            own += 1
        stop, token = claims.spans[start]
        out[own].append(token)
        at = stop
    copy(len(claims.text))
    return ["".join(o) for o in out]


def part_rewritten(data: bytes, values: list[dict]) -> tuple[bytes, int]:
    """A part with values replaced, and how many places those are."""
    edits: list[tuple[int, int, bytes]] = []
    count = 0
    for pieces in paragraphs(data):
        claims = claimed("".join(p.text for p in pieces), values)
        if not claims.starts:
            continue
        count += len(claims.starts)
        for piece, new in zip(pieces, spread([p.text for p in pieces], claims), strict=True):
            if new == piece.text:
                continue
            edits.append((piece.start, piece.stop, escape(new).encode()))
            if new != new.strip() and not piece.kept:
                name = re.compile(rb"<[^\s/>]+").match(data, piece.tag)
                edits.append((name.end(), name.end(), b' xml:space="preserve"'))
    out, at = [], 0
    for start, stop, new in sorted(edits):
        out += [data[at:start], new]
        at = stop
    return b"".join(out) + data[at:], count


def rewritten_package(data: bytes, values: list[dict]) -> tuple[bytes | None, int, str | None]:
    """(package, places replaced, error)."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as old:
            if "word/document.xml" not in old.namelist():
                return None, 0, "DOCX_INVALID"
            if any(i.file_size > LARGEST for i in old.infolist()):
                return None, 0, "DOCX_TOO_LARGE"
            made, count = io.BytesIO(), 0
            with zipfile.ZipFile(made, "w") as new:
                for info in old.infolist():
                    own, n = old.read(info), 0
                    if PARTS.fullmatch(info.filename):
                        if own[:2] in (b"\xff\xfe", b"\xfe\xff"):
                            return None, 0, "DOCX_ENCODING"
                        changed, n = part_rewritten(own, values)
                        own = changed if n else own
                    count += n
                    same = zipfile.ZipInfo(info.filename, info.date_time)
                    same.compress_type, same.external_attr, same.comment = info.compress_type, info.external_attr, info.comment
                    new.writestr(same, own)
            return made.getvalue(), count, None
    except (zipfile.BadZipFile, expat.ExpatError, NotImplementedError, EOFError, OSError, RuntimeError, ValueError):
        return None, 0, "DOCX_INVALID"


VALUE = "array<struct<value:string,token:string,soft:boolean,type:string>>"


def rewritten(rows: DataFrame, fallback: bool = True) -> DataFrame:
    """rows (name, path, text, values) to name, content, replaced and error. The package is read in the task from its path, so
    that no content is shuffled. One that can't be rewritten becomes, with `fallback`, a text file of its text with the
    values replaced, else a row without content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, path, text, values in zip(batch["name"], batch["path"], batch["text"], batch["values"], strict=True):
                own = [dict(v) for v in values] if values is not None else []
                try:
                    data, count, error = rewritten_package(content_of(path), own)
                except OSError:
                    data, count, error = None, 0, "READ_FAILED"
                if data is None and fallback and text is not None:
                    claims = claimed(text, own)
                    name, data, count = re.sub(r"\.[^.]*$", "", name) + ".txt", claims.replaced().encode(), len(claims.starts)
                yield pd.DataFrame({"name": [name], "content": [data], "replaced": [count], "error": [error]})

    values = F.col("values").cast(VALUE).alias("values")
    return rows.select("name", "path", "text", values).mapInPandas(run, "name string, content binary, replaced int, error string")


# --- the data source ------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    files: tuple[tuple[str, int, float | None], ...]


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.with_content = options["path"], options.get("content", "false").lower() == "true"
        self.bytes = int(options.get("maxbytes", 64 << 20))
        self.variants = tuple(v.strip() for v in options.get("variants", "whole").split(","))

    def partitions(self) -> list[InputPartition]:
        """Runs of files of about so many bytes; names that begin with a dot or an underscore are passed over."""
        from pyarrow import fs

        at, root = opened(self.path)
        found = []
        for info in at.get_file_info(fs.FileSelector(root, recursive=True)):
            inside = info.path[len(root) :]
            if info.type == fs.FileType.File and not re.search(r"(^|/)[._]", inside) and extension(info.path) in documents.ALLOWED:
                found.append((info.path, info.size or 0, info.mtime.timestamp() if info.mtime else None))
        out, own, size = [], [], 0
        for one in sorted(found):
            if own and size + one[1] > self.bytes:
                out.append(Files(tuple(own)))
                own, size = [], 0
            own.append(one)
            size += one[1]
        return [*out, Files(tuple(own))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        at, _ = opened(self.path)
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), *[pa.string()] * 4, *[pa.binary()] * self.with_content]
        names = [c.split()[0] for c in COLUMNS.split(", ")] + ["content"] * self.with_content
        for path, size, changed in partition.files:
            ext, data = extension(path), None
            try:
                with at.open_input_stream(path) as f:
                    data = f.read()
                text, variant, error = documents.extract(ext, data, self.variants)
            except OSError:
                text, variant, error = None, None, "READ_FAILED"
            by = None if error else "_".join(["native", ext, *([variant] if variant and variant != self.variants[0] else [])])
            when = datetime.fromtimestamp(changed, UTC) if changed is not None else None
            row = [path, size, when, ext, text, by, error, *([data] if self.with_content else [])]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""


@dataclass
class Written(WriterCommitMessage):
    part: str | None
    files: int


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex[:12]

    @property
    def pending(self) -> str:
        return f"{opened(self.path)[1].rstrip('/')}/_pending-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        at, part, seen = opened(self.path)[0], uuid.uuid4().hex[:12], set()
        for row in iterator:
            name, data = row["name"], row["content"]
            if not name or "/" in name or name[0] in "._" or name in seen:
                raise ValueError(f"not a name for a new file: {name!r}")
            if data is None:
                continue
            if not seen:
                at.create_dir(f"{self.pending}/{part}", recursive=True)
            seen.add(name)
            with at.open_output_stream(f"{self.pending}/{part}/{name}") as f:
                f.write(bytes(data))
        return Written(part if seen else None, len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        """One move a task; with overwriting, what earlier jobs wrote goes afterwards."""
        from pyarrow import fs

        at, root = opened(self.path)
        root = root.rstrip("/")
        at.create_dir(root, recursive=True)
        old = [i.path for i in at.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name.startswith("part-")]
        for n, m in enumerate(messages):
            if m is not None and m.part:
                at.move(f"{self.pending}/{m.part}", f"{root}/part-{n:05d}-{self.job}")
        for path in old if self.overwrite else ():
            at.delete_dir(path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        at = opened(self.path)[0]
        if at.get_file_info(self.pending).type == fs.FileType.Directory:
            at.delete_dir(self.pending)


class DocumentFiles(DataSource):
    """The data source `veladura_files`. Options: path; reading: maxBytes a partition, variants of DOCX extraction in the order
    tried, content (true adds the bytes)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(NAME).options(**options).load(path)


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """rows (name, content) as files; rows without content are passed over."""
    rows.sparkSession.dataSource.register(DocumentFiles)
    rows.select("name", "content").write.format(NAME).mode(mode).save(path)


def anonymized(spark: SparkSession, source: str, target: str, review: bool = False, rounds: int = 2) -> DataFrame:
    """Every DOCX file below `source`, its confirmed entities (with `review`: all) as tokens, then up to `rounds` rounds of audit
    over what is left, written below `target` under its path below `source` with underscores for slashes. Gives name,
    replaced, error and is_safe (whether the last look found nothing) of each."""
    from veladura.functions.scratch import shared
    from veladura.operators import anonymize, audit, tokens

    root = len(opened(source)[1].rstrip("/")) + 2
    files = read(spark, source).where("ext = 'docx'").select("path", "text")
    docs = files.where("text IS NOT NULL").select(F.col("path").alias("doc_id"), "text")
    found = anonymize.entities(docs).where(F.lit(review) | (F.col("status") == "confirmed"))
    one = F.struct("value", "token", tokens.soft(F.col("type")).alias("soft"), "type")
    values = tokens.numbered(found, "last").groupBy(F.col("doc_id").alias("path")).agg(F.collect_set(one).alias("values"))
    rows = files.join(values, "path", "left")
    # what the audit finds in the replaced text is replaced by value as well, on from the numbers given
    clean = rows.where("text IS NOT NULL").select(F.col("path").alias("doc_id"), tokens.replaced_values(F.col("text"), F.col("values")).alias("text"))
    late = audit.repairs(clean, rounds).select(F.col("doc_id").alias("path"), "repairs", "is_safe")
    more = F.transform("repairs", lambda r: F.struct(r["value"].alias("value"), r["token"].alias("token"), F.lit(False).alias("soft"), F.lit("LEAK").alias("type")))
    every = F.concat(F.coalesce("values", F.array().cast(VALUE)), F.coalesce(more, F.array().cast(VALUE)))
    rows = rows.join(late, "path", "left").withColumns({"values": every, "name": F.replace(F.substring("path", F.lit(root), F.length("path")), F.lit("/"), F.lit("_"))})
    made, at = rewritten(rows).join(rows.select("name", "is_safe"), "name", "left"), shared(spark, "rewritten")
    made.write.parquet(at)
    made = spark.read.parquet(at)
    write(made, target)
    return made.select("name", "replaced", "error", F.coalesce("is_safe", F.lit(False)).alias("is_safe"))
