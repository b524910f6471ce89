"""Queries over documents in and out: formats, variants of extraction, reports, training examples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.functions.scratch import shared
from veladura.operators import fields, labels, tokens
from veladura.sources import documents, packages

from . import sqltext as S
from .detection import _E, EMAIL_IN, tokened
from .legal_text import TEXT, legal_keys, legal_text
from .registry import dealt, query, table


def packed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, name, kind) as DOCX files: two paragraphs, a table of two rows, a header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [documents.docx_bytes([f"Parte {n}", ""], [["Uno", k], ["", "Dos"]], f"Cabeza {i}") for i, n, k in zip(b["doc_id"], b["name"], b["kind"], strict=True)]
            yield pd.DataFrame({"path": [f"/x/{i}.docx" for i in b["doc_id"]], "content": data})

    return rows.mapInPandas(run, "path string, content binary")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))


NL = "chr(10)"
DOCX = {
    "whole": f"'Parte ' || c_name || {NL} || '' || {NL} || 'Uno' || {NL} || c_mktsegment || {NL} || '' || {NL} || 'Dos' || {NL} || 'Cabeza ' || c_custkey",
    "primary": f"'Parte ' || c_name || {NL} || '' || {NL} || 'Uno' || {NL} || c_mktsegment || {NL} || '' || {NL} || 'Dos'",
    "simple": "'Parte ' || c_name || ' Uno ' || c_mktsegment || ' Dos'",
    "preview": f"'Parte ' || c_name || {NL} || 'Uno | ' || c_mktsegment || {NL} || 'Dos'",
    "cells": f"'Parte ' || c_name || {NL} || '' || {NL} || 'Uno' || {NL} || c_mktsegment || {NL} || '' || {NL} || 'Dos'",
}


def _docx(variant: str) -> None:
    @query(f"docx_{variant}", f"SELECT c_custkey AS doc_id, {DOCX[variant]} AS text, 'native_docx' AS extractor FROM customer")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = documents.extracted(packed(customers(spark, sf_dir)), (variant,))
        return got.select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("doc_id"), "text", "extractor")


for _v in DOCX:
    _docx(_v)


@query(
    "extraction_errors",
    "SELECT ext, coalesce(error, '') AS error, coalesce(extractor, '') AS extractor, count(*)::BIGINT AS n FROM customer JOIN (VALUES (0, 'txt', NULL, 'native_txt'), (1, 'txt', 'TXT_NOT_UTF8', NULL), "
    "(2, 'pdf', 'PDF_INVALID', NULL), (3, 'pdf', 'PDF_NO_READER', NULL), (4, 'doc', 'DOC_UNSUPPORTED', NULL), (5, 'docx', 'DOCX_INVALID', NULL)) x(i, ext, error, extractor) ON c_custkey % 7 = i GROUP BY ALL",
)
def extraction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.col("c_custkey") % 7).cast("int") + 1
    ext = F.element_at(F.array(*(F.lit(e) for e in ("txt", "TXT", "pdf", "PDF", "doc", "docx", "exe"))), i)
    data = F.element_at(F.array(*(F.unhex(F.lit(h)) for h in ("61C3B1", "FFFE", "00", "255044462D", "00", "504B0304", "00"))), i)
    files = dealt(spark, sf_dir, "customer").select(F.concat(F.lit("/x/"), "c_custkey", F.lit("."), ext).alias("path"), data.alias("content"))
    none = F.lit("")
    return documents.extracted(files).groupBy("ext", F.coalesce("error", none).alias("error"), F.coalesce("extractor", none).alias("extractor")).agg(F.count("*").alias("n"))


@query(
    "pdf_pages",
    "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 60 END AS page_count, CASE WHEN c_custkey % 3 = 0 THEN 'PDF_SCANNED' ELSE '' END AS error, "
    "CASE WHEN c_custkey % 3 = 0 THEN length(c_name) ELSE 50 * length(c_name) + 98 END::INTEGER AS chars FROM customer",
)
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the pages that a reader plugged in would give."""
    pages = F.when(F.col("doc_id") % 3 == 0, F.array("name")).otherwise(F.array_repeat("name", 60))
    rows = customers(spark, sf_dir).select("doc_id", documents.pages_joined(pages).alias("p"))
    return rows.select("doc_id", "p.page_count", F.coalesce("p.error", F.lit("")).alias("error"), F.length("p.text").alias("chars"))


@query("stale_files", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("modificationTime"))
    last = rows.agg(F.max("modificationTime").alias("now"))
    return documents.stale(rows.crossJoin(F.broadcast(last)), F.col("now")).select("event_id")


TRAINED = "'Correo a@b.pe y DNI 12345678' || chr(10) || 'paga s/ ' || (100 + c_custkey % 900) || '.50 el 5 de mayo del 2024' || chr(10) || 'JUAN CARLOS PEREZ'"


@query(
    "training_records",
    f"WITH t AS (SELECT c_custkey AS doc_id, {TRAINED} AS text FROM customer), w AS (SELECT doc_id, text, x.label, x.v FROM t, LATERAL (VALUES ('EMAIL', 'a@b.pe'), ('DNI', '12345678'), ('MONTO', 's/ ' || (100 + doc_id % 900) || '.50'), "
    "('FECHA', '5 de mayo del 2024'), ('PERSONA', 'JUAN CARLOS PEREZ')) x(label, v)) SELECT doc_id, label, CAST(instr(text, v) - 1 AS INTEGER) AS start, CAST(instr(text, v) - 1 + length(v) AS INTEGER) AS stop FROM w",
)
def training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{TRAINED} AS text")
    rows = documents.training_records(docs).select("doc_id", F.explode("entities").alias("e"))
    return rows.select("doc_id", "e.label", "e.start", F.col("e.end").alias("stop"))


# --- reports --------------------------------------------------------------------------------------------------

_N = (
    f", e AS ({_E}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY seq, key) AS number FROM (SELECT doc_id, type, upper(trim(value)) AS key, min(value) AS value, min(layer * 100000 + start) AS seq, count(*) AS k FROM e GROUP BY 1, 2, 3)), "
    "m AS (SELECT *, '{{' || type || '_' || number || '}}' AS token, CASE WHEN type = 'EMAIL' THEN substr(value, 1, 2) || '***@' || substr(value, instr(value, '@') + 1) ELSE substr(value, 1, 2) || repeat('*', length(value) - 4) || right(value, 2) END AS shown FROM n) "
)


@query("mapping_csv_rows", S.with_legal(_N + "SELECT doc_id, type AS \"Tipo\", shown AS \"Original\", token AS \"Sustitucion\" FROM m"))
def mapping_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokened(spark, sf_dir, "listed", lambda docs: docs.select("doc_id", F.inline(documents.mapping_in(F.col("found")))), documents.mapping_rows)


@query(
    "report_json",
    S.with_legal(
        _N + ", c AS (SELECT doc_id, type, sum(k) AS k, string_agg('\"' || token || '\":\"' || shown || '\"', ',' ORDER BY token) AS pairs FROM m GROUP BY 1, 2) "
        "SELECT doc_id, '{\"total_replaced\":' || sum(k) || ',\"type_counts\":{' || string_agg('\"' || type || '\":' || k, ',' ORDER BY type) || '},\"mapping\":{' || string_agg(pairs, ',' ORDER BY type) || '}}' AS report FROM c GROUP BY 1"
    ),
)
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokened(spark, sf_dir, "listed", lambda docs: docs.select("doc_id", documents.report_in(F.col("found")).alias("report")), documents.report)


@query("mapping_json", S.with_legal(_N + "SELECT doc_id, type, token, shown FROM m"))
def mapping_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping written as JSON and read back."""
    written = tokened(spark, sf_dir, "listed", lambda docs: docs.select("doc_id", tokens.summary_in(F.col("found")).alias("mapping")), tokens.summary)
    back = written.select("doc_id", tokens.mapping_of(F.col("mapping")).alias("m"))
    rows = back.select("doc_id", F.explode("m").alias("type", "pairs"))
    return rows.select("doc_id", "type", F.explode("pairs").alias("token", "shown"))


@query(
    "report_text",
    "SELECT c_custkey AS doc_id, array_to_string([repeat('=', 60), 'REPORTE DE ANONIMIZACIÓN', repeat('=', 60), '', 'Fecha de procesamiento: 2024-01-02T03:04:05', 'Archivo original: ' || c_name || '.docx', 'Tipo de archivo: docx', "
    "'Modo de sustitución: tokens', 'Modo estricto: Sí', '', repeat('-', 40), 'RESUMEN DE ENTIDADES DETECTADAS', repeat('-', 40), 'Total de entidades: 3', 'Pendientes de revisión: 1', '', '  DNI: 2', '  PERSONA: 1', '', repeat('-', 40), "
    "'REEMPLAZOS REALIZADOS', repeat('-', 40), '', 'DNI:', '  {{DNI_1}} <- 12****78', '', 'PERSONA:', '  {{PERSONA_1}} <- A. R.', '', repeat('-', 40), 'ADVERTENCIAS', repeat('-', 40), "
    "'  * Los nombres fueron detectados mediante NER y patrones. Pueden existir nombres adicionales no detectados.', '  * Se detectaron 1 entidades que requieren revisión manual.', '', repeat('=', 60)], chr(10)) AS report FROM customer",
)
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, v, k, r: F.struct(F.lit(t).alias("type"), F.lit(v).alias("value"), F.lit(k).alias("token"), F.lit(r).alias("review"))
    found = F.array(one("DNI", "12345678", "{{DNI_1}}", False), one("DNI", "12345678", "{{DNI_1}}", False), one("PERSONA", "Ana Ruiz", "{{PERSONA_1}}", True))
    rows = customers(spark, sf_dir).select("doc_id", "name", F.explode(found).alias("e")).select("doc_id", "name", "e.*")
    return documents.report_text(rows, F.concat("name", F.lit(".docx")), F.lit("docx"), F.lit("2024-01-02T03:04:05"))


# --- fields ---------------------------------------------------------------------------------------------------

FORM = "'Yo, {{NOMBRE_LARGO}}, con D.N.I. N° ........ y domicilio ____, celular N° ......' || chr(10) || 'domicilio ____ [RAZON SOCIAL]' || chr(10) || 'Firma del ' || c_mktsegment || ':' || chr(10) || '{x}'"


@query("field_names", "SELECT c_custkey AS doc_id, 'NOMBRE LARGO|NOMBRE LARGO|RAZON SOCIAL|Número de DNI|y domicilio|Número de celular|domicilio|Firma del ' || c_mktsegment AS fields FROM customer")
def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{FORM} AS text")
    return docs.select("doc_id", F.array_join(fields.named(F.col("text")), "|").alias("fields"))


@query(
    "field_places",
    "SELECT c_custkey AS doc_id, x.label, x.style, x.key FROM customer, LATERAL (VALUES ('NOMBRE LARGO', 'curly_double', 'nombre_largo'), ('Número de DNI', 'dots_underscores', 'numero_de_dni'), ('y domicilio', 'dots_underscores', 'y_domicilio'), "
    "('Número de celular', 'dots_underscores', 'numero_de_celular'), ('domicilio', 'dots_underscores', 'domicilio'), ('RAZON SOCIAL', 'brackets_single', 'razon_social'), ('Firma del ' || c_mktsegment, 'colon_field', 'firma_del_' || lower(c_mktsegment))) x(label, style, key)",
)
def field_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{FORM} AS text")
    rows = docs.select("doc_id", F.explode(fields.placed(F.col("text"))).alias("f"))
    return rows.select("doc_id", "f.label", "f.style", "f.key")


@query("long_fields", "SELECT c_custkey AS doc_id, c_custkey % 2 = 0 AS long_field FROM customer")
def long_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.lit("mis hechos y más")).otherwise(F.lit("nombre"))
    return dealt(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), fields.long_field(name).alias("long_field"))


@query("pre_redact_restored", S.with_legal("SELECT doc_id, true AS same FROM lt"))
def pre_redact_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-redaction undone by its marks gives the text again."""
    from veladura.operators import templates

    rows = templates.pre_redacted(legal_text(spark, sf_dir))
    return rows.select("doc_id", templates.restored(F.col("clean"), F.col("marks")).eqNullSafe(F.col("text")).alias("same"))


# --- files through the data source ----------------------------------------------------------------------------


def _named(path: str) -> Column:
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long")


@query("docx_round_trip", f"SELECT c_custkey AS doc_id, {DOCX['whole']} AS text, 'native_docx' AS extractor FROM customer")
def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOCX files written by one job of the data source and read by another."""
    at = shared(spark, "docx")
    packages.write(packed(customers(spark, sf_dir)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"), at)
    return packages.read(spark, at).select(_named("path").alias("doc_id"), "text", "extractor")


@query(
    "file_errors",
    "SELECT ext, coalesce(error, '') AS error, coalesce(extractor, '') AS extractor, count(*)::BIGINT AS n FROM customer JOIN (VALUES (0, 'txt', NULL, 'native_txt'), (1, 'txt', 'TXT_NOT_UTF8', NULL), "
    "(2, 'pdf', 'PDF_INVALID', NULL), (3, 'pdf', 'PDF_NO_READER', NULL), (4, 'doc', 'DOC_UNSUPPORTED', NULL), (5, 'docx', 'DOCX_INVALID', NULL)) x(i, ext, error, extractor) ON c_custkey % 7 = i GROUP BY ALL",
)
def file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every kind on disk, read by the data source: one row a file, text or error."""
    i = (F.col("c_custkey") % 7).cast("int") + 1
    ext = F.element_at(F.array(*(F.lit(e) for e in ("txt", "TXT", "pdf", "PDF", "doc", "docx", "exe"))), i)
    data = F.element_at(F.array(*(F.unhex(F.lit(h)) for h in ("61C3B1", "FFFE", "00", "255044462D", "00", "504B0304", "00"))), i)
    at, none = shared(spark, "kinds"), F.lit("")
    packages.write(dealt(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("."), ext).alias("name"), data.alias("content")), at)
    return packages.read(spark, at).groupBy("ext", F.coalesce("error", none).alias("error"), F.coalesce("extractor", none).alias("extractor")).agg(F.count("*").alias("n"))


def in_runs(rows: DataFrame, width: int = 5) -> DataFrame:
    """rows (name, text, head) as DOCX files (name, content) whose runs hold `width` characters each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = f'xmlns:w="{packages.SPACES[0]}"'
        for b in batches:
            data = []
            for text, head in zip(b["text"], b["head"], strict=True):
                cut = "".join(f'<w:r><w:t xml:space="preserve">{packages.escape(text[i : i + width])}</w:t></w:r>' for i in range(0, len(text), width))
                parts = {"word/document.xml": f"<w:document {space}><w:body><w:p>{cut}</w:p></w:body></w:document>", "word/header1.xml": f"<w:hdr {space}><w:p><w:r><w:t>{packages.escape(head)}</w:t></w:r></w:p></w:hdr>"}
                data.append(documents.zipped(parts))
            yield pd.DataFrame({"name": b["name"], "content": data})

    return rows.select("name", "text", "head").mapInPandas(run, "name string, content binary")


LETTER = "'Yo, ' || c_name || ', con correo u' || c_custkey || '@mail.pe y de ' || c_mktsegment || ', otra vez ' || c_name || ' y U' || c_custkey || '@MAIL.PE.'"


@query(
    "redacted_files",
    f"SELECT c_custkey AS doc_id, 'Yo, {{{{PERSONA_1}}}}, con correo {{{{EMAIL_1}}}} y de ' || c_mktsegment || ', otra vez {{{{PERSONA_1}}}} y {{{{EMAIL_1}}}}.' || {NL} || 'Cabeza {{{{PERSONA_1}}}}' AS text, 5 AS replaced FROM customer",
)
def redacted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that lie across runs replaced in the packages of one folder, written to another and read again."""
    source, target, made = shared(spark, "letters"), shared(spark, "redacted"), shared(spark, "made")
    rows = dealt(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "concat(c_custkey, '.docx') AS name", f"{LETTER} AS text", "'Cabeza ' || c_name AS head")
    packages.write(in_runs(rows), source)
    one = lambda v, t, s, k: F.struct(v.alias("value"), F.lit(t).alias("token"), F.lit(s).alias("soft"), F.lit(k).alias("type"))
    values = F.array(one(F.col("c_name"), "{{PERSONA_1}}", True, "PERSONA"), one(F.concat(F.lit("u"), "c_custkey", F.lit("@mail.pe")), "{{EMAIL_1}}", False, "EMAIL"))
    files = packages.read(spark, source).withColumn("c_custkey", _named("path")).join(rows.select("c_custkey", "name", values.alias("values")), "c_custkey")
    packages.rewritten(files).write.parquet(made)
    done = spark.read.parquet(made)
    packages.write(done, target)
    text = packages.read(spark, target).select(_named("path").alias("doc_id"), "text")
    return text.join(done.select(_named("name").alias("doc_id"), "replaced"), "doc_id")


@query("training_jsonl", f"WITH t AS (SELECT c_custkey AS doc_id, {TRAINED} AS text FROM customer) SELECT text, count(*)::BIGINT AS n, 5::BIGINT * count(*) AS entities FROM t GROUP BY 1")
def training_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples written one a line and read again."""
    at = shared(spark, "jsonl")
    documents.write_jsonl(documents.training_records(dealt(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{TRAINED} AS text")), at)
    return documents.jsonl(spark, at).groupBy("text").agg(F.count("*").alias("n"), F.sum(F.size("entities")).alias("entities"))


# --- users' own labels and many values ------------------------------------------------------------------------


@query(
    "user_labels",
    "WITH a AS (SELECT user_id, event_id, CASE WHEN event_id % 11 = 0 THEN 'mal nombre' ELSE ' etiqueta_' || event_id % 70 END AS label_name FROM events), v AS (SELECT *, upper(trim(label_name)) AS label FROM a), "
    "f AS (SELECT user_id, label, min(event_id) AS first FROM v WHERE regexp_full_match(label, '[A-Z0-9_]{1,30}') GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS r FROM f) "
    "SELECT v.event_id AS seq, CASE WHEN NOT regexp_full_match(v.label, '[A-Z0-9_]{1,30}') THEN 'invalid' WHEN k.r > 50 THEN 'limit' WHEN k.first = v.event_id THEN 'created' ELSE 'duplicate' END AS outcome "
    "FROM v LEFT JOIN k ON k.user_id = v.user_id AND k.label = v.label",
)
def user_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 11 == 0, "mal nombre").otherwise(F.concat(F.lit(" etiqueta_"), F.col("event_id") % 70))
    return labels.created(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), name.alias("label_name"))).select("seq", "outcome")


@query(
    "user_terms",
    S.with_legal(
        f"SELECT doc_id, start, 'PARTE' AS label FROM ({S.spans('Juan Perez Soto', 0)}) UNION ALL SELECT doc_id, start, CASE WHEN substr(text, stop + 1, 6) = ' Norte' AND client % 2 = 0 THEN 'ZONA' ELSE 'LUGAR' END "
        f"FROM (SELECT s.*, client FROM ({S.spans('Lima', 0)}) s JOIN (SELECT doc_id, client FROM lt) USING (doc_id))"
    ),
)
def user_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's own terms in that client's documents: of those that overlap the longest."""
    docs = legal_keys(spark, sf_dir).withColumnRenamed("client", "user_id")
    one = lambda t, k, even=False: F.struct(F.lit(t).alias("term"), F.lit(k).alias("label"), F.lit(even).alias("even"))
    every = F.array(one("Juan Perez Soto", "PARTE"), one("Perez Soto", "APELLIDOS"), one("Lima", "LUGAR"), one("Lima Norte", "ZONA", True), one("Li", "SILABA"))
    terms = docs.select("user_id").distinct().select("user_id", F.inline(every)).where("NOT even OR user_id % 2 = 0")
    return labels.marked(docs, terms, text=F.expr(TEXT)).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.start", "f.label")


@query(
    "redact_many",
    S.with_legal(f"SELECT doc_id, replace(replace(replace(text, {EMAIL_IN}, '{{{{EMAIL_1}}}}'), 'Juan Perez Soto', '{{{{PERSONA_1}}}}'), 'Lima', '{{{{LUGAR_1}}}}') AS clean FROM lt"),
)
def redact_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred values a document, most of which it lacks, in one pass."""
    one = lambda v, t, s, k: F.struct(v.alias("value"), t.alias("token"), F.lit(s).alias("soft"), F.lit(k).alias("type"))
    email = F.concat(F.lit("USER"), "client", F.lit("@mail"), (F.col("client") % 10), F.lit(".gob.pe"))
    # written out, so that they are one constant
    absent = F.array(*(one(F.lit(f"ausente {i}"), F.lit(f"{{{{X_{i}}}}}"), True, "PERSONA") for i in range(1, 198)))
    known = F.array(one(F.lit("Juan Perez Soto"), F.lit("{{PERSONA_1}}"), True, "PERSONA"), one(F.lit("Lima"), F.lit("{{LUGAR_1}}"), True, "LUGAR"), one(email, F.lit("{{EMAIL_1}}"), False, "EMAIL"))
    return legal_text(spark, sf_dir).select("doc_id", tokens.replaced_values(F.col("text"), F.concat(known, absent)).alias("clean"))
