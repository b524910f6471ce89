"""Queries over templates, sections, forms and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.functions import fixed as X
from veladura.operators import detect, templates

from . import sqltext as S
from .legal_text import legal_text
from .registry import query, table

FORM = "'Yo {{NOMBRE}}, con DNI {{ DNI }}, de ' || c_mktsegment || ' y {FECHA_DE_INICIO} pago [[monto]] a [RAZON SOCIAL]; {{NOMBRE}}'"


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{FORM} AS text", "c_name", "c_nationkey", "c_mktsegment")


@query("placeholders", f"SELECT c_custkey AS doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({FORM}, '\\{{\\{{([^}}]+)\\}}\\}}', 1), lambda x: trim(x)))), '|') AS fields FROM customer")
def placeholders(spark, sf_dir):
    return forms(spark, sf_dir).select("doc_id", F.array_join(templates.placeholders(F.col("text")), "|").alias("fields"))


@query("bracket_fields", "SELECT c_custkey AS doc_id, 'NOMBRE|DNI|NOMBRE|NOMBRE|DNI|FECHA DE INICIO|NOMBRE|monto|RAZON SOCIAL' AS fields FROM customer")
def bracket_fields(spark, sf_dir):
    return forms(spark, sf_dir).select("doc_id", F.array_join(templates.bracket_fields(F.col("text")), "|").alias("fields"))


@query("field_key", "SELECT c_custkey AS doc_id, 'ano_n_o_' || replace(replace(lower(c_name), '#', '_'), ' ', '_') || '_x' AS key FROM customer")
def field_key(spark, sf_dir):
    return forms(spark, sf_dir).select("doc_id", templates.field_key(F.concat(F.lit(" Año N°/Ó "), "c_name", F.lit(" (x)..."))).alias("key"))


@query("given_or_missing", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN '{{FALTA_DATO}}' WHEN c_custkey % 3 = 1 THEN '{{FALTA_DATO}}' ELSE c_name END AS value FROM customer")
def given_or_missing(spark, sf_dir):
    value = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).when(F.col("doc_id") % 3 == 2, F.concat(F.lit(" "), "c_name"))
    return forms(spark, sf_dir).select("doc_id", templates.given(value).alias("value"))


PLEADING = (
    "CASE WHEN c_custkey % 4 = 0 THEN 'Sumilla' || chr(10) ELSE '' END || 'I. DE LOS HECHOS:' || chr(10) || c_name || chr(10) || "
    "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'FUNDAMENTOS DE DERECHO' || chr(10) || 'art. 1' || chr(10) END || 'POR TANTO:' || chr(10) || 'pido'"
)
_A, _F = "(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END)", "(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END)"


@query(
    "section_bounds",
    f"WITH s AS (SELECT c_custkey AS doc_id, 'hechos' AS section, {_A} AS first, {_A} + 2 AS last FROM customer UNION ALL SELECT c_custkey, 'fundamentos', {_A} + 2, {_A} + 4 FROM customer WHERE c_custkey % 3 <> 0 "
    f"UNION ALL SELECT c_custkey, 'petitorio', {_A} + 2 + {_F}, {_A} + 4 + {_F} FROM customer) SELECT doc_id, section, first::INTEGER AS first, last::INTEGER AS last FROM s",
)
def section_bounds(spark, sf_dir):
    return templates.sections(table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{PLEADING} AS text"))


@query("section_rewrite", f"SELECT c_custkey AS doc_id, 'I. DE LOS HECHOS:' || chr(10) || c_name AS old, replace({PLEADING}, 'I. DE LOS HECHOS:' || chr(10) || c_name, 'HECHOS NUEVOS') AS new FROM customer")
def section_rewrite(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{PLEADING} AS text")
    rows = docs.join(templates.sections(docs).where("section = 'hechos'"), "doc_id")
    first, last = F.col("first"), F.col("last")
    return rows.select("doc_id", templates.section_text(F.col("text"), first, last).alias("old"), templates.with_section(F.col("text"), first, last, F.lit("HECHOS NUEVOS")).alias("new"))


SAID = ("¿está bien así?", "muéstrame los cambios", "dime el plazo", "agrega un párrafo", "sería útil saber si debería agregar algo, es correcto", "ok", "reduce y resume el texto, está bien")
MEANT = ("explanation", "explanation", "explanation", "rewrite", "explanation", "rewrite", "rewrite")
_M = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MEANT))


@query("intent_class", f"WITH m(i, intent) AS (VALUES {_M}) SELECT intent, count(*)::BIGINT AS n FROM customer JOIN m ON c_custkey % {len(SAID)} = i GROUP BY 1")
def intent_class(spark, sf_dir):
    text = F.element_at(F.lit(list(SAID)), (F.col("c_custkey") % len(SAID)).cast("int") + 1)
    return table(spark, sf_dir, "customer").select(templates.intent(text).alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))


@query("form_tables", "SELECT c_custkey AS form_id, 'gastos' AS tabla, 0 AS row_no, c_name AS concepto, c_mktsegment AS monto FROM customer UNION ALL SELECT c_custkey, 'gastos', 2, '', c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def form_tables(spark, sf_dir):
    even = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ")
    pairs = (("tabla_gastos_0_concepto", F.col("c_name")), ("tabla_gastos_0_monto", F.col("c_mktsegment")), ("tabla_gastos_1_concepto", F.lit(" ")), ("tabla_gastos_1_monto", F.lit("")), ("tabla_gastos_2_concepto", F.lit("")), ("tabla_gastos_2_monto", even), ("otro", F.lit("x")))
    fields = F.create_map(*(x for k, v in pairs for x in (F.lit(k), v)))
    rows = templates.form_tables(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("form_id"), fields.alias("fields")))
    return rows.select("form_id", "tabla", "row_no", F.col("cells")["concepto"].alias("concepto"), F.col("cells")["monto"].alias("monto"))


@query(
    "chunk_overlap",
    "SELECT doc_id, start::INTEGER AS start, substr(text, start + 1, 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 101, 0) + 1, 1900)) AS start FROM documents)",
)
def chunk_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(templates.overlapping(F.col("text"))).alias("c"))
    return rows.select("doc_id", "c.start", "c.chunk")


@query("chunk_paragraph")
def chunk_paragraph(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(templates.paragraphs(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("chars"))


@query("focus_text", S.with_legal("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'sello') OR contains(lower(x), 'abogado')), chr(10)) || chr(10) || right(text, 200) AS focus FROM lt"))
def focus_text(spark, sf_dir):
    return legal_text(spark, sf_dir).select("doc_id", templates.focus(F.col("text"), ("sello", "abogado"), 200).alias("focus"))


def _pre_sql() -> str:
    """Counts of marks; the order of kinds matters, so that each count is taken on what the kinds before left."""
    text, out = "text", []
    for name, p in X.PRE_REDACT:
        flag = "(?i)" if name in ("EMAIL_PRE", "PLACA_PRE") else ""
        out.append(f"len(regexp_extract_all({text}, '{flag}{S.quoted(p)}', 0))::INTEGER AS {name.lower()}")
        text = f"regexp_replace({text}, '{flag}{S.quoted(p)}', '[{name}]', 'g')"
    return S.with_legal(f"SELECT doc_id, {', '.join(out)} FROM lt")


@query("pre_redact_counts", _pre_sql())
def pre_redact_counts(spark, sf_dir):
    rows = templates.pre_redacted(legal_text(spark, sf_dir))
    return rows.select("doc_id", *(F.size(F.regexp_extract_all("clean", F.lit(rf"\[{n}_\d+\]"), F.lit(0))).alias(n.lower()) for n, _ in X.PRE_REDACT))


@query("suggestions_merged", S.with_legal("SELECT doc_id, 'EMAIL' AS type, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)" + S.quoted(X.EMAIL) + "', 1)) FROM lt) GROUP BY 1 UNION ALL SELECT doc_id, 'LUGAR', 1 FROM lt"))
def suggestions_merged(spark, sf_dir):
    docs = legal_text(spark, sf_dir)
    local = docs.select("doc_id", F.explode(detect.found(F.col("text"), "email")).alias("s")).select("doc_id", F.lit("EMAIL").alias("type"), "s.value", "s.start", "s.stop")
    said = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("LUGAR").alias("type"), F.lit("Lima").alias("value")), F.struct(F.lit("LUGAR").alias("type"), F.lit("Cusco").alias("value")), F.struct(F.lit("EMAIL").alias("type"), F.expr("concat('USER', client, '@mail', client % 10, '.gob.pe')").alias("value")))).alias("x"))
    rows = templates.merged_suggestions(local, said.select("doc_id", "x.type", "x.value"), docs)
    return rows.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("all_places", S.with_legal(f"SELECT doc_id, start FROM ({S.spans('Lima', 0)})"))
def all_places(spark, sf_dir):
    docs = legal_text(spark, sf_dir).select("doc_id", "text")
    return templates.all_places(docs, docs.select("doc_id", F.lit("Lima").alias("value"))).select("doc_id", "start")


# --- values, suggestions, runs --------------------------------------------------------------------------------


@query(
    "value_candidates",
    "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN c_name || '  de  Lima|' || c_name || ' de Lima' ELSE c_name || '  de  Lima|' || c_name || ' de Lima|' || c_name || 'deLima' END AS spellings FROM customer",
)
def value_candidates(spark, sf_dir):
    from veladura.operators import merge

    value = F.concat(F.lit(" "), "c_name", F.lit("  de  Lima "))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), merge.candidates(value, F.col("c_custkey") % 2 == 0).alias("c"))
    return rows.select("doc_id", F.array_join("c", "|").alias("spellings"))


@query(
    "suggestion_policy",
    "WITH d AS (SELECT c_custkey AS doc_id, c_custkey % 100 / 100.0 AS conf, c_custkey % 4 AS k FROM customer) SELECT doc_id, round(CASE k WHEN 0 THEN greatest(conf, 0.82) ELSE least(conf, 0.65) END, 4)::DOUBLE AS confidence FROM d WHERE k <> 2",
)
def suggestion_policy(spark, sf_dir):
    """What a model says of an ambiguous value: keep it, doubt it, drop it; no answer is a doubt."""
    said = F.element_at(F.lit(["KEEP", "DUDOSO", "DROP", "?"]), (F.col("c_custkey") % 4).cast("int") + 1)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), said.alias("said"), (F.col("c_custkey") % 100 / 100).alias("conf"))
    return rows.where("said <> 'DROP'").select("doc_id", F.round(F.when(F.col("said") == "KEEP", F.greatest("conf", F.lit(0.82))).otherwise(F.least("conf", F.lit(0.65))), 4).alias("confidence"))


@query("redact_runs", "SELECT c_custkey AS doc_id, replace('El senor ' || c_name || ' y ' || c_name || ' firman', c_name, '{{PERSONA_1}}') AS clean FROM customer")
def redact_runs(spark, sf_dir):
    from veladura.sources import documents

    rows = table(spark, sf_dir, "customer")
    runs = F.array(F.lit("El se"), F.lit("nor "), F.substring("c_name", 1, 5), F.concat(F.substring("c_name", 6, 99), F.lit(" y ")), F.col("c_name"), F.lit(" firman"))
    blocks = rows.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("block_no"), runs.alias("runs"))
    values = rows.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("value"), F.lit("{{PERSONA_1}}").alias("token"))
    return documents.replaced_blocks(blocks, values).select("doc_id", F.array_join("runs", "").alias("clean"))
