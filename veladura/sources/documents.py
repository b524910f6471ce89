"""Documents in and reports out: DOCX, plain text, format checks, mappings."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.functions.spans import Find, let, spans

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ALLOWED = ("docx", "pdf", "txt", "doc")


def _text(p: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{W}t"))


def _body(root: ElementTree.Element) -> Iterator[str]:
    """Body paragraphs first, then those of table cells."""
    inside = {id(p) for t in root.iter(f"{W}tbl") for p in t.iter(f"{W}p")}
    every = list(root.iter(f"{W}p"))
    for wanted in (False, True):
        for p in every:
            if (id(p) in inside) == wanted:
                yield _text(p)


def _preview(root: ElementTree.Element) -> Iterator[str]:
    """Paragraphs that aren't blank, then a line for each row of a table, its cells parted by a bar."""
    inside = {id(p) for t in root.iter(f"{W}tbl") for p in t.iter(f"{W}p")}
    yield from (t for p in root.iter(f"{W}p") if id(p) not in inside and (t := _text(p)).strip())
    for row in root.iter(f"{W}tr"):
        cells = [" ".join(t for p in c.iter(f"{W}p") if (t := _text(p)).strip()) for c in row.iter(f"{W}tc")]
        if any(cells):
            yield " | ".join(c for c in cells if c)


def _cells(root: ElementTree.Element) -> Iterator[str]:
    """Body paragraphs, then cells, each cell's paragraphs one a line."""
    inside = {id(p) for t in root.iter(f"{W}tbl") for p in t.iter(f"{W}p")}
    yield from (_text(p) for p in root.iter(f"{W}p") if id(p) not in inside)
    yield from ("\n".join(_text(p) for p in c.iter(f"{W}p")) for c in root.iter(f"{W}tc"))


#: How a document's parts become its text: lines of each part, what joins them, whether headers and footers count.
VARIANTS = {
    "whole": (_body, "\n", True), "primary": (_body, "\n", False), "simple": (lambda r: (t.text for t in r.iter(f"{W}t") if t.text), " ", False),
    "preview": (_preview, "\n", False), "cells": (_cells, "\n", False),
}


def docx_text(data: bytes, variant: str = "whole") -> tuple[str | None, str | None]:
    """(text, error) of one of the VARIANTS."""
    lines, join, headers = VARIANTS[variant]
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if "word/document.xml" not in names:
                return None, "DOCX_INVALID"
            parts = ["word/document.xml"]
            if headers:
                parts += sorted(n for n in names if n.startswith("word/header") and n.endswith(".xml"))
                parts += sorted(n for n in names if n.startswith("word/footer") and n.endswith(".xml"))
            return join.join(x for p in parts for x in lines(ElementTree.fromstring(z.read(p)))), None
    except (zipfile.BadZipFile, ElementTree.ParseError, EOFError, OSError):
        return None, "DOCX_INVALID"


def extract(ext: str, data: bytes, variants: tuple[str, ...] = ("whole",)) -> tuple[str | None, str | None, str | None]:
    """(text, variant, error) of one file: of DOCX the first variant that gives text, else the first one's answer; plain text in
    UTF-8; the others as the format check turns them down."""
    if ext == "docx":
        got = [(t, v, e) for v in variants for t, e in [docx_text(data, v)]]
        return next((g for g in got if g[0]), got[0])
    if ext == "txt":
        try:
            return data.decode(), None, None
        except UnicodeDecodeError:
            return None, None, "TXT_NOT_UTF8"
    if ext == "pdf":
        return None, None, "PDF_NO_READER" if data.startswith(b"%PDF") else "PDF_INVALID"
    return None, None, "DOC_UNSUPPORTED"


def zipped(parts: dict[str, str]) -> bytes:
    """A package of named parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def docx_bytes(paragraphs: list[str], rows: list[list[str]] = (), header: str | None = None) -> bytes:
    """A DOCX file with paragraphs, one table and a header."""
    para = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    space = f'xmlns:w="{W[1:-1]}"'
    table = "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    body = "".join(map(para, paragraphs)) + (f"<w:tbl>{table}</w:tbl>" if rows else "")
    parts = {"word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document {space}><w:body>{body}</w:body></w:document>'}
    if header is not None:
        parts["word/header1.xml"] = f'<?xml version="1.0" encoding="UTF-8"?><w:hdr {space}>{para(header)}</w:hdr>'
    return zipped(parts)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def output_extension(ext: Column) -> Column:
    return F.when(ext == "docx", "docx").otherwise("txt")


def magic(content: Column) -> Column:
    """What the first bytes say: pdf, zip or null."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head == "504B0304", "zip")


def extracted(files: DataFrame, variants: tuple[str, ...] = ("whole",)) -> DataFrame:
    """files (path, content) to path, ext, text, extractor, error. DOCX variants are tried one after another until one
    gives text; plain text is read by Spark alone; files that the format check turns down get an error; PDF needs a
    reader that isn't installed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for data in rows["content"]:
                got = [(t, e, v) for v in variants for t, e in [docx_text(data, v)]]
                out.append(next((g for g in got if g[0]), got[0]))
            yield pd.DataFrame({"path": rows["path"], "ext": rows["ext"], "text": [o[0] for o in out], "error": [o[1] for o in out], "variant": [o[2] for o in out]})

    files = files.select("path", "content").withColumns({"ext": extension(F.col("path")), "magic": magic(F.col("content"))}).where(F.col("ext").isin(*ALLOWED))
    docx = files.where("ext = 'docx'").select("path", "ext", "content").mapInPandas(run, "path string, ext string, text string, error string, variant string")
    none = F.lit(None).cast("string")
    plain = files.where("ext = 'txt'").select("path", "ext", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    plain = plain.select("*", F.when(F.col("text").isNull(), "TXT_NOT_UTF8").alias("error"), none.alias("variant"))
    refused = F.when((F.col("ext") == "pdf") & ~F.col("magic").eqNullSafe("pdf"), "PDF_INVALID").when(F.col("ext") == "pdf", "PDF_NO_READER").otherwise("DOC_UNSUPPORTED")
    other = files.where("ext IN ('pdf', 'doc')").select("path", "ext", none.alias("text"), refused.alias("error"), none.alias("variant"))
    every = docx.unionByName(plain).unionByName(other)
    name = F.concat_ws("_", F.lit("native"), "ext", F.when(F.col("variant") != variants[0], F.col("variant")))
    return every.withColumn("extractor", F.when(F.col("error").isNull(), name)).drop("variant")


def read(spark: SparkSession, path: str, variants: tuple[str, ...] = ("whole",)) -> DataFrame:
    """Every file under a path that the allow-list has, extracted."""
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"), variants)


def pages_joined(pages: Column, most: int = 50, join: str = "\n\n") -> Column:
    """struct<text, page_count, error> of what a PDF reader gives, an array of page texts: the first `most` pages; under
    100 characters in all the file is a scan."""
    text = F.array_join(F.slice(pages, 1, most), join)
    error = F.when(pages.isNull(), "PDF_NO_TEXT").when(F.length(F.trim(text)) < 100, "PDF_SCANNED")
    return F.struct(text.alias("text"), F.size(pages).alias("page_count"), error.alias("error"))


def stale(files: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """files (path, modificationTime) that have outlived their time; removing them is up to the caller."""
    return files.where(F.col("modificationTime") < now - F.make_interval(mins=F.lit(minutes)))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Training examples, one JSON object {text, entities: [[start, end, label]]} a line; lines that are none are left out."""
    rows = spark.read.schema("text string, entities array<array<string>>").json(path).where("text IS NOT NULL")
    one = lambda e: F.struct(F.get(e, F.lit(0)).cast("int").alias("start"), F.get(e, F.lit(1)).cast("int").alias("end"), F.get(e, F.lit(2)).alias("label"))
    return rows.select("text", F.transform("entities", one).alias("entities"))


def write_jsonl(records: DataFrame, path: str) -> None:
    """Training examples as `jsonl` reads them."""
    one = lambda e: F.array(e["start"].cast("string"), e["end"].cast("string"), e["label"])
    body = F.to_json(F.struct("text", F.transform("entities", one).alias("entities")))
    records.select(body.alias("value")).write.text(path)


def write_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, ext, text, blocks array<string>) as a table of files (doc_id, path, content) in Parquet below path: DOCX where
    the extension says so and its blocks are known, plain text else. `packages.write` makes files of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            data = [docx_bytes(list(b)) if e == "docx" and b is not None else t.encode() for e, t, b in zip(rows["ext"], rows["text"], rows["blocks"], strict=True)]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "ext": ["docx" if e == "docx" and b is not None else "txt" for e, b in zip(rows["ext"], rows["blocks"], strict=True)], "content": data})

    files = docs.select("doc_id", "ext", F.coalesce("text", F.lit("")).alias("text"), "blocks").mapInPandas(run, "doc_id long, ext string, content binary")
    files.write.partitionBy("ext").parquet(path)
    return docs.sparkSession.read.parquet(path).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("."), "ext").alias("path"), "content")


def report(rows: DataFrame) -> DataFrame:
    """rows (doc_id, type, value, token) to one JSON a document: total, counts by type, masked mapping."""
    from veladura.operators.tokens import masked

    counts = rows.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    counts = counts.groupBy("doc_id").agg(F.sum("n").alias("total_replaced"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("type_counts"))
    pairs = rows.select("doc_id", "token", masked(F.col("type"), F.col("value")).alias("shown")).dropDuplicates(["doc_id", "token"])
    mapping = pairs.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "shown")))).alias("mapping"))
    return counts.join(mapping, "doc_id").select("doc_id", F.to_json(F.struct("total_replaced", "type_counts", "mapping")).alias("report"))


def report_in(tokened: Column) -> Column:
    """The JSON that `report` gives of one document, from its array of entities with tokens; of values that share a token the
    smallest is shown."""
    from veladura.operators.tokens import masked

    rows = F.array_sort(F.transform(tokened, lambda e: F.struct(e["token"].alias("token"), e["value"].alias("value"), e["type"].alias("type"))))

    def json(every: Column) -> Column:
        kinds = F.array_sort(F.array_distinct(every["type"]))
        counts = F.map_from_entries(F.transform(kinds, lambda t: F.struct(t, F.size(F.filter(every, lambda e: e["type"] == t)).cast("long"))))
        first = F.filter(every, lambda e, i: (i == 0) | (F.get(every, i - 1)["token"] != e["token"]))
        pairs = F.map_from_entries(F.transform(first, lambda e: F.struct(e["token"], masked(e["type"], e["value"]))))
        return F.to_json(F.struct(F.size(every).cast("long").alias("total_replaced"), counts.alias("type_counts"), pairs.alias("mapping")))

    return let(rows, json)


def mapping_in(tokened: Column) -> Column:
    """The rows that `mapping_rows` gives of one document, as an array."""
    from veladura.operators.tokens import masked

    return F.array_distinct(F.transform(tokened, lambda e: F.struct(e["type"].alias("Tipo"), masked(e["type"], e["value"]).alias("Original"), e["token"].alias("Sustitucion"))))


def mapping_rows(rows: DataFrame) -> DataFrame:
    """The mapping as its CSV sink writes it: Tipo, Original (masked), Sustitucion."""
    from veladura.operators.tokens import masked

    return rows.select("doc_id", F.col("type").alias("Tipo"), masked(F.col("type"), F.col("value")).alias("Original"), F.col("token").alias("Sustitucion")).distinct()


def write_mapping(rows: DataFrame, path: str) -> None:
    mapping_rows(rows).write.option("header", True).csv(path)


REPORT = {
    "DIRECCION": "Las direcciones fueron detectadas mediante heurísticas. Revise el documento para confirmar la correcta anonimización.",
    "PERSONA": "Los nombres fueron detectados mediante NER y patrones. Pueden existir nombres adicionales no detectados.",
}  # fixed values: warnings of the report


def report_text(rows: DataFrame, name: Column, ext: Column, at: Column) -> DataFrame:
    """rows (doc_id, type, value, token, review) to one plain report a document: counts by type, replacements with masked
    values, warnings. name, ext and at (the time, as text) are of the document."""
    from veladura.operators.tokens import masked

    rows = rows.select("doc_id", "type", "token", "review", name.alias("name"), ext.alias("ext"), at.alias("at"), masked(F.col("type"), F.col("value")).alias("shown"))
    kinds = rows.groupBy("doc_id", "type").agg(
        F.count("*").alias("n"), F.count_if("review").alias("review"), F.array_sort(F.collect_set(F.struct("token", "shown"))).alias("pairs"),
        F.min("name").alias("name"), F.min("ext").alias("ext"), F.min("at").alias("at"),
    )
    docs = kinds.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("type", "n", "pairs"))).alias("kinds"), F.sum("n").alias("n"), F.sum("review").alias("review"),
        F.min("name").alias("name"), F.min("ext").alias("ext"), F.min("at").alias("at"),
    )
    line, thin = F.lit("=" * 60), F.lit("-" * 40)
    counts = F.transform("kinds", lambda k: F.concat(F.lit("  "), k["type"], F.lit(": "), k["n"]))
    pairs = F.transform("kinds", lambda k: F.concat(F.lit("\n"), k["type"], F.lit(":\n"), F.array_join(F.transform(k["pairs"], lambda p: F.concat(F.lit("  "), p["token"], F.lit(" <- "), p["shown"])), "\n")))
    told = F.filter(
        F.array(
            *(F.when(F.exists("kinds", lambda k: k["type"] == t), F.lit(f"  * {REPORT[t]}")) for t in REPORT),
            F.when(F.col("review") > 0, F.concat(F.lit("  * Se detectaron "), "review", F.lit(" entidades que requieren revisión manual."))),
        ),
        lambda w: w.isNotNull(),
    )
    head = F.array(
        line, F.lit("REPORTE DE ANONIMIZACIÓN"), line, F.lit(""), F.concat(F.lit("Fecha de procesamiento: "), "at"), F.concat(F.lit("Archivo original: "), "name"),
        F.concat(F.lit("Tipo de archivo: "), "ext"), F.lit("Modo de sustitución: tokens"), F.lit("Modo estricto: Sí"), F.lit(""), thin,
        F.lit("RESUMEN DE ENTIDADES DETECTADAS"), thin, F.concat(F.lit("Total de entidades: "), "n"), F.concat(F.lit("Pendientes de revisión: "), "review"), F.lit(""),
    )
    warned = F.when(F.size(told) > 0, F.concat(F.array(F.lit(""), thin, F.lit("ADVERTENCIAS"), thin), told)).otherwise(F.array().cast("array<string>"))
    body = F.concat(head, counts, F.array(F.lit(""), thin, F.lit("REEMPLAZOS REALIZADOS"), thin), pairs, warned, F.array(F.lit(""), line))
    return docs.select("doc_id", F.array_join(body, "\n").alias("report"))


# --- fixed values: training labels ---
TRAINING = (
    ("EMAIL", Find(r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", 0, ignore_case=True, hints=("@",))), ("DNI", Find(r"\b\d{8}\b", 0)),
    ("MONTO", Find(r"S\/\s?\d+(?:\.\d{2})?", 0, ignore_case=True, anchors=("s/",))),
    ("FECHA", Find(r"\d{1,2}\s+DE\s+[A-ZÁÉÍÓÚÑ]+\s+(?:DEL\s+)?\d{4}", 0, ignore_case=True)),
    ("PERSONA", Find(r"^[A-ZÁÉÍÓÚÑ\s]{10,}$", 0, multiline=True)),
)


def training_records(docs: DataFrame) -> DataFrame:
    """Training examples {text, entities: [[start, end, label]]}: addresses, identity numbers, sums, dates, capital lines."""
    every = F.concat(*(_labelled(spans(F.col("text"), find), label) for label, find in TRAINING))
    return docs.select("doc_id", "text", F.array_sort(every).alias("entities"))


def _labelled(found: Column, label: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("end"), F.lit(label).alias("label")))


# --- runs of a paragraph --------------------------------------------------------------------------------------


def replaced_in_runs(runs: list[str], values: list[tuple[str, str]]) -> list[str]:
    """Runs of one paragraph with values replaced across their borders: the token goes into the run in which a value
    begins, what it covers of later runs goes; longest values first."""
    for value, token in sorted(values, key=lambda v: -len(v[0])):
        at = 0
        while value:
            place = "".join(runs).find(value, at)
            if place < 0:
                break
            stop, seen, out, put = place + len(value), 0, [], False
            for run in runs:
                a, b = seen, seen + len(run)
                seen = b
                if b <= place or a >= stop:
                    out.append(run)
                    continue
                left, right = run[: max(0, place - a)], run[max(0, stop - a) :] if b > stop else ""
                out.append(left + ("" if put else token) + right)
                put = True
            runs, at = out, place + len(token)
    return runs


def replaced_blocks(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """blocks (doc_id, block_no, runs array<string>) with each document's values (value, token) replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = [replaced_in_runs(list(r), [(v["value"], v["token"]) for v in (vs if vs is not None else [])]) for r, vs in zip(rows["runs"], rows["vs"], strict=True)]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "block_no": rows["block_no"], "runs": done})

    own = values.groupBy("doc_id").agg(F.collect_set(F.struct("value", "token")).alias("vs"))
    return blocks.join(own, "doc_id", "left").select("doc_id", "block_no", "runs", "vs").mapInPandas(run, "doc_id long, block_no int, runs array<string>")
