"""Queries over the seams for models, each with a small model whose answers are known beforehand."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.operators import detect, merge, models

from .registry import dealt, query, table

#: what the stand-in recogniser knows
KNOWN = (("PER", r"Rosa Campos"), ("ORG", r"Molino Azul"), ("LOC", r"Calle Real|Lima"), ("PER", r"Sala"))


def load() -> models.Recogniser:
    return lambda text: [(label, m.start(), m.end()) for label, p in KNOWN for m in re.finditer(p, text)]


def docs(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return dealt(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{text} AS text")


NER = "c_name || ': la testigo Rosa Campos de Molino Azul, domicilio Calle Real, Lima. Sala'"


def _ner(value: str) -> str:
    return f"CAST(instr({NER}, '{value}') - 1 AS INTEGER)"


@query("ner_entities", " UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{k}' AS type, '{v}' AS value, {_ner(v)} AS start, 'spacy' AS source FROM customer" for k, v in (("PERSONA", "Rosa Campos"), ("ENTIDAD", "Molino Azul"), ("DIRECCION", "Calle Real"))))
def ner_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.as_entities(models.recognised(docs(spark, sf_dir, NER), load)).select("doc_id", "type", "value", "start", "source")


@query("ner_chunks", "SELECT c_custkey AS doc_id, 25 AS found, (24 * 40 + 5)::INTEGER AS last FROM customer")
def ner_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 40 characters: what a recogniser finds is placed in the whole text."""
    text = docs(spark, sf_dir, "repeat('abcd Rosa Campos, sin nada mas, final...', 25)")
    return models.recognised(text, load, 40).groupBy("doc_id").agg(F.count("*").cast("int").alias("found"), F.max("start").alias("last"))


@query("ner_trained", " UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{k}' AS type, '{v}' AS value, 0.85::DOUBLE AS confidence FROM customer" for k, v in (("PER", "Rosa Campos"), ("ORG", "Molino Azul"), ("LOC", "Calle Real"), ("LOC", "Lima"), ("PER", "Sala"))))
def ner_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir, NER)
    return models.as_trained(models.recognised(rows, load), rows).select("doc_id", "type", "value", F.col("confidence").cast("double").alias("confidence"))


@query("ner_claims", " UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{k}' AS type, '{v}' AS value, {c}::DOUBLE AS confidence FROM customer" for k, v, c in (("PERSONA", "Rosa Campos", 0.90), ("DIRECCION", "Calle Real", 0.70))))
def ner_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir, "'el menor Rosa Campos; ' || " + NER.replace("la testigo Rosa Campos", "{{Rosa Campos}}"))
    return models.as_claims(models.recognised(rows, load), rows).select("doc_id", "type", "value", F.col("confidence").cast("double").alias("confidence"))


@query("ner_in_detection", "SELECT c_custkey AS doc_id, 'ENTIDAD' AS type, 'Molino Azul' AS value FROM customer UNION ALL SELECT c_custkey, 'DNI', '00000042' FROM customer")
def ner_in_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recogniser finds joins what the detectors find, before merging."""
    rows = docs(spark, sf_dir, "c_mktsegment || ': Molino Azul con DNI 00000042 y nada mas'")
    found = models.as_entities(models.recognised(rows, load)).groupBy("doc_id").agg(models.by_document(F.col("value")).alias("more"))
    rows = rows.join(found, "doc_id", "left")
    more = F.coalesce("more", F.array().cast(detect.ENTITY)).cast(detect.ENTITY)
    merged = merge.merged(detect.detect(F.col("text"), more=more), detect.ENTITY)
    return rows.select("doc_id", F.explode(merged).alias("e")).select("doc_id", "e.type", "e.value")


# --- a stand-in language model --------------------------------------------------------------------------------

VALUES = (
    ("PERSONA", "Ana Ruiz", 0.75), ("PERSONA", "Base Legal", 0.75), ("ENTIDAD", "Molino Azul", 0.9), ("DIRECCION", "algo raro", 0.9), ("PERSONA", "la", 0.9), ("PERSONA", "123 45", 0.9),
    ("DNI", "12", 0.3), ("OTRO", "x", 0.4), ("PERSONA", "falla todo", 0.7),
)
SAYS = {"Ana Ruiz": "persona_real", "Base Legal": "TITULO_JURIDICO", "Molino Azul": "ENTIDAD_INSTITUCIONAL", "algo raro": "que se yo"}
JUDGED = (("PERSONA", "Ana Ruiz", 0.82, "r+ai_confirmed"), ("ENTIDAD", "Molino Azul", 0.9, "r+ai_confirmed"), ("DIRECCION", "algo raro", 0.65, "r"), ("DNI", "12", 0.3, "r"), ("OTRO", "x", 0.4, "r"), ("PERSONA", "falla todo", 0.65, "r"))


def judge(batch: list[dict]) -> list[str]:
    if any(r["value"] == "falla todo" for r in batch):
        raise TimeoutError
    return [SAYS[r["value"]] for r in batch]


@query("semantic_filter", " UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{k}' AS type, '{v}' AS value, {c}::DOUBLE AS confidence, '{s}' AS source FROM customer" for k, v, c, s in JUDGED))
def semantic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(*(F.struct(F.lit(k).alias("type"), F.lit(v).alias("value"), F.lit(c).alias("confidence")) for k, v, c in VALUES))
    rows = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(one).alias("e"))
    rows = rows.select("doc_id", "e.type", "e.value", F.lit(3).alias("start"), F.lit(5).alias("stop"), F.lit("r").alias("source"), "e.confidence")
    return models.validated(rows, docs(spark, sf_dir, "'abcdefghij'"), judge, batch=1).select("doc_id", "type", "value", "confidence", "source")


def finder(batch: list[dict]) -> list[list[dict]]:
    names = lambda t: [{"type": "nombre_persona", "value": v} for v in re.findall(r"[A-Z][a-z]+ Torres", t)]
    return [[*names(r["chunk"]), *names(r["chunk"]), {"type": "X", "value": "{{DNI_1}}"}, {"type": "cci", "value": " 77 "}] for r in batch]


@query("model_detection", "SELECT c_custkey AS doc_id, 'PERSONA' AS type, 'Ana Torres' AS value FROM customer UNION ALL SELECT c_custkey, 'CUENTA', '77' FROM customer")
def model_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.detected_by(docs(spark, sf_dir, "'Comparece Ana Torres, que vive lejos de aqui y no dice mas, ' || c_name"), finder)


LONG = "repeat('nada. ', 400) || 'aqui Luis Torres' || chr(10) || repeat('mas ', 600) || 'y Ana Torres'"


def recall(batch: list[dict]) -> list[list[dict]]:
    found = lambda t: [{"type": "persona", "value": v, "priority": "critical" if v.startswith("Ana") else "normal"} for v in re.findall(r"[A-Z][a-z]+ Torres", t)]
    return [[*found(r["chunk"]), {"type": "PERSONA", "value": "No Existe", "priority": ""}] for r in batch]


@query("model_recall", f"SELECT c_custkey AS doc_id, 'Luis Torres' AS value, CAST(instr({LONG}, 'Luis Torres') - 1 AS INTEGER) AS start, 0.85::DOUBLE AS confidence FROM customer")
def model_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir, LONG)
    known = rows.select("doc_id", F.lit("ANA TORRES").alias("value"))
    return models.recalled(rows, known, recall).select("doc_id", "value", F.col("start").cast("int").alias("start"), F.col("confidence").cast("double").alias("confidence"))


@query("model_audit", "SELECT c_custkey AS doc_id, 'Luis Torres' AS value, 0.82::DOUBLE AS confidence FROM customer UNION ALL SELECT c_custkey, 'Ana Torres', 0.85 FROM customer")
def model_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir, LONG)
    known = rows.select("doc_id", F.lit("otro").alias("value"))
    return models.recalled(rows, known, recall, focused=("aqui",)).select("doc_id", "value", F.col("confidence").cast("double").alias("confidence"))


def librarian(batch: list[dict]) -> list[list[int]]:
    return [[int(i) for i in re.findall(r'"id":(\d+)', r["documents"])][:12] + [999999999] for r in batch]


@query(
    "similar_documents",
    "WITH d AS (SELECT o_custkey AS tenant, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_custkey % 10 = 1), "
    "p AS (SELECT tenant, id, row_number() OVER (PARTITION BY tenant ORDER BY id) AS place FROM d WHERE n <= 100) SELECT tenant, id FROM p WHERE place <= 10",
)
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth user asks about the latest of their own documents."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("description"), F.lit("").alias("body"), F.col("o_orderdate").alias("created"))
    asks = own.where("tenant % 10 = 1").select("tenant", F.lit("parecidos").alias("question")).distinct()
    return models.similar(own, asks, librarian).select("tenant", "id")


def critic(batch: list[dict]) -> list[list[dict]]:
    return [[{"severity": s, "kind": "estructura", "fragment": f} for s, f in (("sugerencia", "c"), ("advertencia", "b"), ("error", "a"), ("error", "d"))] for _ in batch]


@query("document_review", "SELECT c_custkey AS doc_id, x.position, x.severity, x.fragment FROM customer, (VALUES (1, 'error', 'a'), (2, 'error', 'd'), (3, 'advertencia', 'b'), (4, 'sugerencia', 'c')) x(position, severity, fragment)")
def document_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.reviewed(docs(spark, sf_dir, "c_name"), critic).select("doc_id", "position", "severity", "fragment")


PLEA = "'Sumilla' || chr(10) || 'I. DE LOS HECHOS:' || chr(10) || c_name || chr(10) || 'POR TANTO:' || chr(10) || 'pido'"


def writer(batch: list[dict]) -> list[str | None]:
    return [f"HECHOS: {r['body'].splitlines()[-1]}" for r in batch]


@query(
    "argumentation_jobs",
    f"WITH d AS (SELECT c_custkey, c_name, {PLEA} AS text, c_custkey % 3 AS k FROM customer) SELECT c_custkey AS job_id, CASE k WHEN 2 THEN 'not_found' ELSE 'done' END AS status, "
    "CASE k WHEN 0 THEN 'rewrite' WHEN 1 THEN 'explanation' ELSE 'rewrite' END AS kind, CASE k WHEN 0 THEN 'Sumilla' || chr(10) || 'HECHOS: ' || c_name || chr(10) || 'POR TANTO:' || chr(10) || 'pido' ELSE text END AS text FROM d",
)
def argumentation_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir, PLEA)
    k = F.col("doc_id") % 3
    wish = F.when(k == 1, "¿qué dice?").otherwise("agrega un párrafo")
    jobs = rows.select(F.col("doc_id").alias("job_id"), "doc_id", F.when(k == 2, "fundamentos").otherwise("hechos").alias("section"), wish.alias("wish"))
    return models.argued(jobs, rows, writer).select("job_id", "status", "kind", "text")


@query("missed_persons", "SELECT c_custkey AS doc_id, 'Rosa Campos' AS value FROM customer WHERE c_custkey % 2 = 0")
def missed_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons that a recogniser still finds and that are not known yet."""
    from veladura.operators import context

    rows = docs(spark, sf_dir, NER)
    found = models.as_entities(models.recognised(rows, load)).groupBy("doc_id").agg(F.collect_list(F.struct("type", "value", "start", "stop")).alias("more"))
    known = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit("otra").alias("value")))).otherwise(F.array(F.struct(F.lit("ROSA CAMPOS").alias("value"))))
    rows = rows.join(found, "doc_id").select("doc_id", F.explode(context.missed(F.col("text"), F.col("more"), known)).alias("e"))
    return rows.select("doc_id", "e.value")
