"""Sentences with what has to be found in them, written out by hand: one document an order holds a third of them.

Each sentence lies between runs of 130 equals signs, wider than any window that a detector looks into. The text
and the rows expected come from the same sentences, the rows without any pattern, word list or rule of the library:
`<value|type|source|confidence|status>` marks an entity, `pre^value^post` one whose span is wider than its value,
{c} and {k} stand for the client's and the order's number, {c8} for eight digits of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura import sqlviews
from veladura.operators import anonymize, audit, context, detect, tokens

from .registry import dealt, query, table

SENTENCES = (
    "Lleva DNI <{c8}|DNI|regex|1.0|confirmed> consigo.",
    "Pago la suma de S/ {c8} en total.",
    "Tiene RUC <20{c9}|RUC|regex|1.0|confirmed> activo.",
    "Escriba <user{c}@mail.pe|EMAIL|regex|1.0|confirmed> pronto.",
    "Llame al celular <^9{k8}^ |TELEFONO|context|1.0|confirmed>hoy.",
    "Use la <casilla electronica {k}|CASILLA|regex|1.0|confirmed> ahora.",
    "Vea el <acta de conciliacion {k}|ACTA|regex|1.0|confirmed> vigente.",
    "Abre la <cuenta de ahorros ^191{k11}^|CUENTA|regex|1.0|confirmed> mensual.",
    "Numero <CCI: ^002{k17}^|CUENTA|regex|1.0|confirmed> interno.",
    "Perito con <CMP 45678|COLEGIATURA|regex|1.0|confirmed> habil.",
    "Pasa la Sala Civil: cuarta",
    "Pasa la <Sala Laboral|SALA|regex|1.0|review>: cuarta",
    "Ante el <Juzgado de Familia|JUZGADO|regex|1.0|review>: lugar",
    "Ante el <Tribunal Constitucional|TRIBUNAL|regex|1.0|review>; luego",
    "Inscrito en <partida electronica 1{k7}|PARTIDA|regex|1.0|confirmed> vigente.",
    "Cita la <resolucion directoral n° {k2}-2024|RESOLUCION|regex|1.0|confirmed> vigente.",
    "Con DNI N° {c8} del caso.",
    "Segun <HC-{k6}|HISTORIA_CLINICA|regex|1.0|confirmed> revisada.",
    "Consta <CLI-{k5}|CODIGO_CLIENTE|regex|1.0|confirmed> activo.",
    "Porta <LIC-A{k5}|LICENCIA|regex|1.0|confirmed> vigente.",
    "Contrata <POL-{k6}|POLIZA|regex|1.0|confirmed> anual.",
    "El vehiculo de placa <ABC-{k3}|PLACA|regex|1.0|review> circula.",
    "El bien XYZ-{k3} figura.",
    "<Sello: Notaria Paz|SELLO|regex|0.7|review>",
    "<Huella digital: indice derecho|HUELLA|regex|0.7|review>",
    "<Firma: Maria Lopez Diaz|FIRMA|regex|0.7|review>",
    "Domicilio real: <Calle Los Pinos {k3}, Lima|DIRECCION|context|0.75|review>; sigue",
    "Ubicado: <Avenida Grau {k3} piso 2|DIRECCION|context|1.0|review>; queda",
    "Comparece don <Carlos Alberto Ruiz|PERSONA|strong_context_persona|0.78|review> por derecho",
    "El procurador <Luis Torres Vega|PERSONA|strong_context_persona|0.78|review> acude",
    "Para: <Ana Torres Ruiz|PERSONA|strong_context_persona|0.78|review>",
    "La menor de nombre <Lucia Diaz Rojas|PERSONA|strong_context_persona|0.78|review>.",
    "Demandante: <Rosa Flores Diaz|PERSONA|strong_context_persona|0.78|review> (presente)",
    "Dr. <Pedro Gomez Salas opina|PERSONA|strong_context_persona|0.78|review>",
    "<JUAN CARLOS PEREZ|PERSONA|heuristic|0.7|review>{n}Abogado",
    "<ROSA MARIA DIAZ|PERSONA|heuristic|0.7|review>, <CAL 4567|COLEGIATURA|regex|1.0|confirmed> presente",
    "del <CAL|ENTIDAD|context_colegio|0.65|review>: <PEDRO GOMEZ|ENTIDAD|context_colegio|0.65|review>; fin",
    "ante SUNAT: <INTENDENCIA DE LIMA|ENTIDAD|context_entidad_publica|0.65|review>; fin",
    "DATOS GENERALES: <Nombre Rosa Elena Quispe|PERSONA|section|0.65|review> Mamani vecina con numero <{c8}|DNI|regex|1.0|confirmed> y otros datos de contacto.",
    "<Pedro Soto Luna|PERSONA|context|0.78|review>, identificado con DNI <{c8}|DNI|regex|1.0|confirmed> declara",
    "REMITENTE:{n}<Ana Torres Ruiz|PERSONA|strong_context_persona|0.78|review>",
    "<Expediente ^{k5}-2024-0-1801-JR-CI-01^|EXPEDIENTE|regex|1.0|confirmed> en giro",
    "hijo de apellidos <Quispe Mamani|PERSONA|strong_context_persona|0.78|review> presente",
    "<EL ABOGADO PEDRO GOMEZ SALAS|PERSONA|heuristic|0.7|review> expuso.",
    "El demandado: <LUIS DIAZ|PERSONA|strong_context_persona|0.78|review>",
    "Consta {{DNI_1}} previo.",
)
GAP = "chr(10) || chr(10) || repeat('=', 130) || chr(10) || chr(10)"
WIDTH = 134
ENTITY = re.compile(r"<([^<>|]*)\|([^<>|]*)\|([^<>|]*)\|([^<>|]*)\|([^<>|]*)>")
KEY = re.compile(r"\{([ck])(\d*)\}|\{n\}")


def sql(text: str) -> str:
    """A text with its keys as one SQL expression that Spark and DuckDB read alike."""
    parts, at = [], 0
    for m in KEY.finditer(text):
        parts.append("'" + text[at : m.start()].replace("'", "''") + "'")
        col = "o_custkey" if m[1] == "c" else "o_orderkey"
        if m[0] == "{n}":
            parts.append("chr(10)")
        elif m[2] == "2":
            parts.append(f"cast(10 + {col} % 90 AS STRING)")
        elif m[2] == "3":
            parts.append(f"cast(100 + {col} % 900 AS STRING)")
        elif m[2]:
            parts.append(f"lpad(cast({col} AS STRING), {m[2]}, '0')")
        else:
            parts.append(f"cast({col} AS STRING)")
        at = m.end()
    parts.append("'" + text[at:].replace("'", "''") + "'")
    return " || ".join(p for p in parts if p != "''") or "''"


def bare(sentence: str) -> str:
    return ENTITY.sub(lambda m: m[1].replace("^", ""), sentence)


def _has(i: int) -> str:
    return f"(o_orderkey + {i}) % 3 = 0"


TEXT = " || ".join(f"CASE WHEN {_has(i)} THEN {sql(bare(s))} || {GAP} ELSE '' END" for i, s in enumerate(SENTENCES))


def _expected() -> list[str]:
    rows = []
    for i, s in enumerate(SENTENCES):
        before = " + ".join(["0", *(f"CASE WHEN {_has(j)} THEN length({sql(bare(p))}) + {WIDTH} ELSE 0 END" for j, p in enumerate(SENTENCES[:i]))])
        for m in ENTITY.finditer(s):
            lead, value, _ = m[1].split("^") if "^" in m[1] else ("", m[1], "")
            start = f"{before} + length({sql(bare(s[: m.start()]))})"
            rows.append(
                f"SELECT o_orderkey AS doc_id, '{m[2]}' AS type, {sql(value)} AS value, CAST({start} AS INTEGER) AS start, "
                f"CAST({start} + length({sql(m[1].replace('^', ''))}) AS INTEGER) AS stop, '{m[3]}' AS source, {m[4]}::DOUBLE AS confidence, '{m[5]}' AS status FROM orders WHERE {_has(i)}"
            )
    return rows


WANT = " UNION ALL ".join(_expected())


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{TEXT} AS text")


def detected(docs: DataFrame) -> DataFrame:
    """All detectors, merged, filtered, the last filter, status: one row for each entity that stays."""
    return anonymize.entities(docs).drop("seq")


@query("detect_all", WANT)
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(cases(spark, sf_dir))


@query("detect_sql", WANT)
def detect_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `detect_all` gives, from a view in SQL."""
    cases(spark, sf_dir).createOrReplaceTempView("veladura_cases")
    entities, *_ = sqlviews.views(spark, "veladura_cases")
    columns = ", ".join(detected(cases(spark, sf_dir)).columns)
    return spark.sql(f"SELECT {columns} FROM {entities}")


@query("entities_by_status", f"SELECT status, type, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS distinct_values FROM ({WANT}) GROUP BY ALL")
def entities_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed entities and those for review, by type."""
    return detected(cases(spark, sf_dir)).groupBy("status", "type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


@query("post_scan", f"SELECT type, count(*)::BIGINT AS n FROM ({WANT}) WHERE type NOT IN ('DNI', 'RUC', 'EMAIL', 'TELEFONO') AND value NOT IN ('CAL 4567', 'CMP 45678') GROUP BY 1")
def post_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What detectors still find after redaction by value, by type: identity and tax numbers, addresses, phones and registry numbers are gone."""
    found = detected(cases(spark, sf_dir)).where(F.col("type").isin("DNI", "RUC", "EMAIL", "TELEFONO", "COLEGIATURA"))
    marked = found.select("doc_id", F.struct("start", "stop", F.concat(F.lit("{{"), "type", F.lit("_1}}")).alias("token")).alias("s")).groupBy("doc_id").agg(F.collect_list("s").alias("s"))
    docs = cases(spark, sf_dir).join(marked, "doc_id", "left")
    text = F.when(F.col("s").isNull(), F.col("text")).otherwise(tokens.replaced_at(F.col("text"), F.col("s")))
    return detected(docs.select("doc_id", text.alias("text"))).groupBy("type").agg(F.count("*").alias("n"))


def _only(*kinds: str) -> str:
    return f"SELECT doc_id, start, stop, value FROM ({WANT}) WHERE type IN ({', '.join(repr(k) for k in kinds)})"


def _spans(name: str, sql_text: str, *rules: str, least: float = 0.0) -> None:
    @query(name, sql_text)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = cases(spark, sf_dir).select("doc_id", F.explode(detect.found(F.col("text"), *rules)).alias("s"))
        return rows.select("doc_id", "s.start", "s.stop", "s.value")


def _of(*wanted: tuple[int, str]) -> str:
    """Rows for the named values of the named sentences, whatever becomes of them later."""
    rows = []
    for i, value in wanted:
        before = " + ".join(["0", *(f"CASE WHEN {_has(j)} THEN length({sql(bare(p))}) + {WIDTH} ELSE 0 END" for j, p in enumerate(SENTENCES[:i]))])
        text = bare(SENTENCES[i])
        start = f"{before} + length({sql(text[: text.index(value)])})"
        rows.append(f"SELECT o_orderkey AS doc_id, CAST({start} AS INTEGER) AS start, CAST({start} + length({sql(value)}) AS INTEGER) AS stop, {sql(value)} AS value FROM orders WHERE {_has(i)}")
    return " UNION ALL ".join(rows)


def _at(text: str) -> int:
    return next(i for i, s in enumerate(SENTENCES) if text in bare(s))


_spans("detect_titulo", _of((_at("don Carlos"), "Carlos Alberto Ruiz"), (_at("Dr. Pedro"), "Pedro Gomez Salas")), "titulo")
_spans("detect_procurador", _of((_at("procurador Luis"), "Luis Torres Vega")), "procurador")
_spans("detect_firmante", _of((_at("Firma: Maria"), "Maria Lopez Diaz")), "firmante")
_spans("detect_remitente", _of((_at("Para: Ana"), "Ana Torres Ruiz"), (_at("Firma: Maria"), "Maria Lopez Diaz")), "remitente")
_spans("detect_menor", _of((_at("La menor"), "Lucia Diaz Rojas")), "menor")
_spans("detect_apellido", _of((_at("apellidos"), "Quispe Mamani"), (_at("La menor"), "Lucia Diaz Rojas")), "apellido")
_spans("detect_parte", _of((_at("Demandante: Rosa"), "Rosa Flores Diaz"), (_at("El demandado:"), "LUIS DIAZ")), "parte")
_spans("detect_profesional", _of((_at("Dr. Pedro"), "Pedro Gomez Salas opina")), "profesional")
_spans("detect_cargo", _of((_at("JUAN CARLOS"), "JUAN CARLOS PEREZ")), "cargo")
_spans("detect_nombre_colegiado", _of((_at("ROSA MARIA"), "ROSA MARIA DIAZ")), "nombre_colegiado")
_spans("detect_alone", _of((_at("REMITENTE"), "Ana Torres Ruiz")), "alone")
_spans("detect_identified", _of((_at("Pedro Soto"), "Pedro Soto Luna")), "identified")
_spans("detect_identified_loose", _of((_at("Pedro Soto"), "Pedro Soto Luna")), "identified_loose")
_spans("detect_capital_lines", _of((_at("JUAN CARLOS"), "JUAN CARLOS PEREZ")), "capital_line")
_spans("detect_in_sections", _of((_at("DATOS GENERALES"), "Nombre Rosa Elena Quispe"), (_at("DATOS GENERALES"), "{c8}")), "section_name", "section_dni")
_spans("detect_boards", _of((_at("del CAL"), "CAL"), (_at("del CAL"), "PEDRO GOMEZ")), "association", "association_name")
_spans("detect_institutions", _of((_at("ante SUNAT"), "SUNAT"), (_at("ante SUNAT"), "INTENDENCIA DE LIMA"), (_at("Juzgado de"), "Juzgado de Familia")), "institution", "institution_name", "institution_court")
_spans("detect_domicilio", _of((_at("Calle Los"), "Calle Los Pinos {k3}, Lima")), "domicilio")


@query(
    "detect_capitals",
    "SELECT doc_id, start, stop, value, 'heuristic' AS source FROM (" + _of((_at("JUAN CARLOS"), "JUAN CARLOS PEREZ"), (_at("ROSA MARIA"), "ROSA MARIA DIAZ"), (_at("EL ABOGADO"), "EL ABOGADO PEDRO GOMEZ SALAS"), (_at("ante SUNAT"), "INTENDENCIA DE LIMA"))
    + ") UNION ALL SELECT doc_id, start, stop, value, 'strong_context_persona' AS source FROM (" + _of((_at("El demandado:"), "LUIS DIAZ")) + ")",
)
def detect_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).select("doc_id", F.explode(detect.entities(F.col("text"), "capitals")).alias("s"))
    return rows.select("doc_id", "s.start", "s.stop", "s.value", "s.source")


@query("detect_address", _of((_at("Calle Los"), "Calle Los Pinos {k3}, Lima"), (_at("Avenida Grau"), "Avenida Grau {k3} piso 2"), (_at("ante SUNAT"), "INTENDENCIA DE LIMA")))
def detect_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that begin with a word for a street or plot (numbers after N° also begin one; they are left out here)."""
    rows = cases(spark, sf_dir).select("doc_id", F.explode(detect.found(F.col("text"), "address")).alias("s")).where(~F.lower("s.value").startswith("n°"))
    return rows.select("doc_id", "s.start", "s.stop", "s.value")


ADDRESSES = (
    ("Calle Lima 12", "Calle Lima 12"), ("Calle Lima 12. Distrito de Ate. Otro dato", "Calle Lima 12., Distrito de Ate."), ("Jiron Puno 5;  Piso 2, Lima , ", "Jiron Puno 5, Piso 2, Lima"),
    ("Av. Grau 1", "Av."), ("  a   b  ", "a b"),
)


@query("trimmed_address", "SELECT c_custkey AS doc_id, CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (_, w) in enumerate(ADDRESSES)) + " END AS address FROM customer")
def trimmed_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*(F.lit(r) for r, _ in ADDRESSES)), (F.col("c_custkey") % 5).cast("int") + 1)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), detect.trimmed_address(raw).alias("address"))


# --- redaction, audit, gate -----------------------------------------------------------------------------------

HARD = "Correo user{c}@mail.pe, numero {c8}, 20{c9}; movil 9{k8} o +51 987 654 321; CAL: 12345, C.A.L. 4567; fin"
HARD_WANT = "Correo {{EMAIL_REDACT}}, numero {{DNI_REDACT}}, {{RUC_REDACT}}; movil {{TEL_REDACT}} o {{TEL_REDACT}}; {{COLEGIATURA_REDACT}}, {{COLEGIATURA_REDACT}}; fin"


@query("hard_redact", f"SELECT o_orderkey AS doc_id, '{HARD_WANT}' AS clean FROM orders")
def hard_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{sql(HARD)} AS text").select("doc_id", tokens.hard_redacted(F.col("text")).alias("clean"))


LEAKY = ("Ya consta {{RUC_3}} ahi.", "Lleva DNI {c8} consigo.", "Escriba user{c}@mail.pe pronto.", "Tiene RUC 20{c9} activo.", "Repite DNI {c8} luego.", "Fecha 20240115 sola.")
FIXED = ("Ya consta {{RUC_3}} ahi.", "Lleva DNI {{DNI_100}} consigo.", "Escriba {{EMAIL_100}} pronto.", "Tiene RUC {{RUC_4}} activo.", "Repite DNI {{DNI_100}} luego.", "Fecha 20240115 sola.")


def _joined(parts: tuple[str, ...]) -> str:
    return f" || {GAP} || ".join(sql(p) for p in parts)


def leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{_joined(LEAKY)} AS text")


@query("audit_fix", f"SELECT o_orderkey AS doc_id, {_joined(FIXED)} AS fixed_text, 4 AS leaks_found, 4 AS fixes, 0 AS remaining, true AS is_safe FROM orders")
def audit_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.fixed(leaky(spark, sf_dir)).drop("text")


@query("audit_rounds", f"SELECT o_orderkey AS doc_id, {_joined(FIXED)} AS text, 4 AS leaks_found, true AS is_safe FROM orders")
def audit_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repaired(leaky(spark, sf_dir))


@query("audit_warnings", "SELECT o_orderkey AS doc_id, 'Applied 4 emergency auto-fixes' AS told FROM orders")
def audit_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.fixed(leaky(spark, sf_dir)).select("doc_id", F.array_join(audit.warnings(), "; ").alias("told"))


@query("download_gate", f"SELECT o_orderkey AS doc_id, {_joined(FIXED)} AS text, false AS hard, 0 AS remaining, true AS is_safe, 'safe' AS verdict FROM orders")
def download_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gated(leaky(spark, sf_dir))


#: no round of repair before: what is left has to go hard
HARD_FIXED = tuple(p.replace("{{DNI_100}}", "{{DNI_REDACT}}").replace("{{EMAIL_100}}", "{{EMAIL_REDACT}}").replace("{{RUC_4}}", "{{RUC_REDACT}}").replace("20240115", "{{DNI_REDACT}}") for p in FIXED)


@query("download_hard", f"SELECT o_orderkey AS doc_id, {_joined(HARD_FIXED)} AS text, true AS hard, 'safe' AS verdict FROM orders")
def download_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gated(leaky(spark, sf_dir), rounds=0).select("doc_id", "text", "hard", "verdict")


@query("download_forced", f"SELECT o_orderkey AS doc_id, {_joined(LEAKY)} AS text, 'forced' AS verdict, 4 AS remaining FROM orders")
def download_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gated(leaky(spark, sf_dir), rounds=0, force=True).select("doc_id", "text", "verdict", "remaining")


def _leaks(name: str, kind: str, text: str, *values: str) -> None:
    """One finder on one sentence a document: spans of what stands there, by hand."""
    rows = []
    for v in values:
        start = f"length({sql(text[: text.index(v)])})"
        rows.append(f"SELECT o_orderkey AS doc_id, CAST({start} AS INTEGER) AS start, CAST({start} + length({sql(v)}) AS INTEGER) AS stop, {sql(v)} AS value FROM orders")

    @query(name, " UNION ALL ".join(rows))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{sql(text)} AS text")
        rows = docs.select("doc_id", F.explode(audit.leaks(F.col("text"), kind)).alias("s"))
        return rows.select("doc_id", "s.start", "s.stop", "s.value")


_leaks("audit_direccion", "DIRECCION", "Vive en Calle Los Olivos {k3}, Dpto. 4; o en Mz B, Lt 7; ver {{A_1}} Av Grau {k3}", "Calle Los Olivos {k3}, Dpto. 4", "Mz B, Lt 7")
_leaks("audit_expediente", "EXPEDIENTE", "Ver {k5}-2024-0-1801-JR-CI-01; luego proceso {k2}-2023; otra vez proceso {k2}-2023; fin", "{k5}-2024-0-1801-JR-CI-01", "proceso {k2}-2023")
_leaks("audit_juzgado", "JUZGADO", "Ante {k2}° Juzgado Civil de Lima:Sala Penal; Tribunal; fin", "{k2}° Juzgado Civil de Lima", "Sala Penal")


@query("leak_types", "SELECT type, count(*)::BIGINT AS n FROM (SELECT unnest(['JUZGADO', 'SALA', 'TRIBUNAL', 'FISCALIA']) AS type FROM customer) GROUP BY 1")
def leak_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.lit("2 Juzgado Civil; Sala Laboral; Tribunal Constitucional; Fiscalia Penal").alias("text"))
    return docs.select(F.explode(audit.leaks(F.col("text"), "JUZGADO")).alias("l")).groupBy("l.type").agg(F.count("*").alias("n"))


# --- the evaluator --------------------------------------------------------------------------------------------

ORIGINAL = "Uno {c8}, dos user{c}@mail.pe, tres 9{k8}, cuatro JUAN PEREZ."
REST = "Uno {{DNI_1}}, dos user{c}@mail.pe, y ademas muy lejos de todo lo anterior tres 9{k8}, cuatro {{PERSONA_1}}."


@query("potential_leaks", "SELECT o_orderkey AS doc_id, 'EMAIL' AS type, 'high' AS severity, " + sql("user{c}@mail.pe") + " AS value FROM orders UNION ALL SELECT o_orderkey, 'TELEFONO', 'medium', " + sql("9{k8}") + " FROM orders")
def potential_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{sql(REST)} AS text")
    return docs.select("doc_id", F.explode(audit.potential_leaks(F.col("text"))).alias("l")).select("doc_id", "l.type", "l.severity", "l.value")


@query(
    "evaluation_report",
    "SELECT o_orderkey AS doc_id, 3 AS detected, 2 AS replaced, 2 AS leak_count, 1 AS over_count, round(1/3, 4) AS privacy_recall, 0.5::DOUBLE AS precision, round(0.7/3 + 0.15, 4) AS final_score, 'low_recall|low_precision|2 potential leaks' AS warnings FROM orders",
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in (("PERSONA", "FUNDAMENTOS DE HECHO"), ("DNI", "1"))))
    rows = dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{sql(ORIGINAL)} AS original", f"{sql(REST)} AS anonymized").withColumn("applied", applied)
    out = audit.evaluated(rows)
    return out.select("doc_id", "detected", "replaced", "leak_count", "over_count", "privacy_recall", "precision", "final_score", F.array_join("warnings", "|").alias("warnings"))


OVER = (
    ("FUNDAMENTOS DE HECHO", "whitelist_violation", "high"), ("ALEGATOS FINALES", "legal_title_tokenized", "high"), ("Ruego Atienda Usted", "contains_legal_verb", "medium"),
    ("uno dos tres cuatro cinco seis", "too_many_words", "low"), ("Rosa Diaz", None, None),
)


@query("over_anonymized", "SELECT reason, severity, count(*)::BIGINT AS n FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{r}', '{s}')" for i, (_, r, s) in enumerate(OVER) if r) + ") x(i, reason, severity) ON c_custkey % 5 = i GROUP BY ALL")
def over_anonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.element_at(F.array(*(F.lit(v) for v, *_ in OVER)), (F.col("c_custkey") % 5).cast("int") + 1)
    rows = table(spark, sf_dir, "customer").select(audit.over_anonymized(value).alias("o")).where("o IS NOT NULL")
    return rows.groupBy("o.reason", "o.severity").agg(F.count("*").alias("n"))


# --- the older detector ---------------------------------------------------------------------------------------

OLD = "Casilla electronica N° {k}, RUC 20{c9}; DNI {c8}; pago {c8}; correo user{c}@mail.pe; tel 9{k8}; don Luis Torres dice; placa ABC-{k3}; Banco Norte: {{DNI_1}} fin"
OLD_WANT = (
    ("CASILLA", "Casilla electronica N° {k}", 0.95), ("RUC", "20{c9}", 0.90), ("DNI", "{c8}", 0.85), ("EMAIL", "user{c}@mail.pe", 0.95), ("TELEFONO", "9{k8}", 0.85),
    ("PERSONA", "Luis Torres dice", 0.80), ("PLACA", "placa ABC-{k3}", 0.90), ("ENTIDAD", "Banco Norte", 0.85),
)


def _old_sql(kind: str, value: str, confidence: float) -> str:
    start = f"length({sql(OLD[: OLD.index(value)])})"
    return f"SELECT o_orderkey AS doc_id, '{kind}' AS type, {sql(value)} AS value, CAST({start} AS INTEGER) AS start, CAST({start} + length({sql(value)}) AS INTEGER) AS stop, {confidence}::DOUBLE AS confidence FROM orders"


def old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{sql(OLD)} AS text")


def _old_rows(docs: DataFrame, found) -> DataFrame:
    rows = docs.select("doc_id", F.explode(found).alias("e"))
    return rows.select("doc_id", "e.type", "e.value", "e.start", "e.stop", F.round("e.confidence", 2).alias("confidence"))


@query("old_regex", " UNION ALL ".join(_old_sql(*w) for w in OLD_WANT))
def old_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _old_rows(old(spark, sf_dir), context.by_rules(F.col("text"), context.REGEX))


PLACES = "Domicilio real: Calle Los Pinos {k3}; luego Jr. Puno {k3}, Lima; fono: 01 {k3}4567x; (01) 234 5678; 987 654 321"


@query("old_addresses", "SELECT o_orderkey AS doc_id, " + sql("Calle Los Pinos {k3}") + " AS value, 0.9::DOUBLE AS confidence FROM orders UNION ALL SELECT o_orderkey, " + sql("Jr. Puno {k3}, Lima") + ", 0.8 FROM orders")
def old_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{sql(PLACES)} AS text")
    return _old_rows(docs, context.by_rules(F.col("text"), context.ADDRESSES)).select("doc_id", "value", "confidence")


@query("old_phones", "SELECT o_orderkey AS doc_id, '987 654 321' AS value FROM orders UNION ALL SELECT o_orderkey, '(01) 234 5678' FROM orders UNION ALL SELECT o_orderkey, " + sql("01 {k3}4567") + " FROM orders")
def old_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{sql(PLACES)} AS text")
    return _old_rows(docs, context.by_rules(F.col("text"), context.PHONES)).select("doc_id", "value")


@query("old_hybrid", f"SELECT doc_id, type, value, start, stop, confidence, false AS review FROM ({' UNION ALL '.join(_old_sql(*w) for w in OLD_WANT)})")
def old_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = old(spark, sf_dir).select("doc_id", F.explode(context.hybrid(F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.type", "e.value", "e.start", "e.stop", F.round("e.confidence", 2).alias("confidence"), context.needs_review(F.col("e")).alias("review"))


@query("old_left_over", f"SELECT doc_id, type, value FROM ({' UNION ALL '.join(_old_sql(*w) for w in OLD_WANT)})")
def old_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = old(spark, sf_dir).select("doc_id", F.explode(context.left_over(F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.type", "e.value")


@query("coverage_log", "SELECT o_orderkey AS doc_id, 8 AS remaining, 'CASILLA|DNI|EMAIL|ENTIDAD|PERSONA|PLACA|RUC|TELEFONO' AS kinds FROM orders")
def coverage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = context.left_over(F.col("text"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(left, lambda e: e["type"]))), "|")
    return old(spark, sf_dir).select("doc_id", F.size(left).alias("remaining"), kinds.alias("kinds"))


@query("detector_fallback", "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'layers' WHEN 1 THEN 'hybrid' ELSE 'regex' END AS detector, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def detector_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attempt that works; here attempts fail by the document's number."""
    fails = lambda found, test: F.when(~test, found)
    k = F.col("doc_id") % 3
    one = lambda found: F.transform(found, lambda e: e["value"])
    text = F.col("text")
    got = context.first_that_works(("layers", fails(one(detect.entities(text, "ruc")), k != 0)), ("hybrid", fails(one(context.by_rules(text, context.PHONES)), k == 2)), ("regex", one(context.by_rules(text, context.PHONES))))
    return old(spark, sf_dir).select(got.alias("g")).groupBy("g.detector").agg(F.count("*").alias("n"))


NAMES = "El demandante JUAN CARLOS QUISPE y Ana Torres, mas lejos de todo lo dicho hasta aqui y sin que nadie lo note queda Piedra Azul con LOMA VERDE, {{X_1}}"


@query("scored_persons", "SELECT c_custkey AS doc_id, v AS value, s::DOUBLE AS score FROM customer, (VALUES ('JUAN CARLOS QUISPE', 0.85), ('Ana Torres', 0.85), ('LOMA VERDE', 0.5)) x(v, s)")
def scored_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(NAMES).alias("text"))
    rows = rows.select("doc_id", F.explode(context.scored_persons(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.value", "s.score")


@query("outside_tokens", "SELECT c_custkey AS doc_id, '12' AS value FROM customer UNION ALL SELECT c_custkey, '7' FROM customer")
def outside_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veladura.functions.spans import Find, spans

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("12 {{DNI_1}} 7").alias("text"))
    found = context.outside(spans(F.col("text"), Find(r"[0-9]+", 0)), context.tokens_in(F.col("text")))
    return rows.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.value")


@query("sanitized_text", "SELECT c_custkey AS doc_id, 'a b c' || c_name AS clean FROM customer")
def sanitized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), context.sanitized(F.concat(F.lit("a\u0000b\u000bc"), "c_name")).alias("clean"))


# --- replacement after review, residual addresses -------------------------------------------------------------


@query("residual_emails", "SELECT o_orderkey AS doc_id, " + sql("{{EMAIL_4}} {{EMAIL_10}} {{EMAIL_9}} {{EMAIL_10}} {{x@y.pe fin") + " AS clean FROM orders")
def residual_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(F.lit("KNOWN@MAIL.PE"), F.lit("{{EMAIL_4}}"))
    rows = dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", sql("known@mail.pe user{c}@mail.pe {{EMAIL_9}} USER{c}@mail.pe {{x@y.pe fin") + " AS text")
    return rows.select("doc_id", tokens.residual_emails(F.col("text"), known).alias("clean"))


@query("review_decisions", "SELECT o_orderkey AS doc_id, " + sql("{{PERSONA_2}} y {{PERSONA_1}} con DNI {c8}, otra vez Ana Ruiz y {c8}") + " AS clean FROM orders")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", sql("Ana Ruiz y Luis Vega con DNI {c8}, otra vez Ana Ruiz y {c8}") + " AS text")
    one = lambda t, v, at, yes: F.struct(F.lit(t).alias("type"), F.lit(v).alias("value"), F.lit(at).alias("start"), F.lit(yes).alias("accepted"))
    pending = F.array(one("PERSONA", "Ana Ruiz", 0, True), one("PERSONA", "Luis Vega", 11, True), one("PERSONA", "otra vez", 40, False), one("DNI", "99999999", 5, True))
    return rows.select("doc_id", tokens.decided(F.col("text"), pending).alias("clean"))


WHOLE = ("Lleva DNI {c8} consigo.", "Escriba user{c}@mail.pe pronto.", "Ante el Juzgado de Familia: lugar", "Tiene DNI {c8} igual.", "Otro DNI 4{c7} mas.")
WHOLE_CLEAN = ("Lleva DNI {{DNI_2}} consigo.", "Escriba {{EMAIL_1}} pronto.", "Ante el{{JUZGADO_100}}: lugar", "Tiene DNI {{DNI_2}} igual.", "Otro DNI {{DNI_1}} mas.")


@query("anonymized_text", f"SELECT o_orderkey AS doc_id, {_joined(WHOLE_CLEAN)} AS clean, 4 AS replaced, true AS is_safe FROM orders")
def anonymized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text to anonymized text: what needs review isn't replaced by detection; the audit then finds the court."""
    docs = dealt(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{_joined(WHOLE)} AS text")
    return anonymize.anonymized(docs).select("doc_id", "clean", "replaced", "is_safe")
