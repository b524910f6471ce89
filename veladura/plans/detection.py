"""Queries over detectors, merging, filters, tokens, redaction and audit, on the derived legal text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.functions import fixed as X
from veladura.functions.spans import Find, settled, spans
from veladura.operators import audit, detect, filters, merge, tokens

from . import sqltext as S
from .legal_text import legal_copies, legal_text
from .registry import query, table

COLUMNS = "doc_id, start, stop, value"


def exploded(docs: DataFrame, array) -> DataFrame:
    return docs.select("doc_id", F.explode(array).alias("s")).select("doc_id", "s.start", "s.stop", "s.value")


#: name of a query's rule, patterns, group of the value, where the span lies, whether case matters not, least length
PLAIN_RULES = (
    ("ruc", (X.RUC,), 1, "match", False, 0), ("expediente", X.CASE_FILES, 1, "match", True, 0), ("casilla", (X.MAILBOX,), 0, "match", True, 0),
    ("acta", X.RECORDS, 0, "match", True, 0), ("juzgado", (X.COURT,), 1, "match", True, 0), ("cuenta", X.ACCOUNTS, 1, "match", True, 0),
    ("colegiatura", (X.LICENSED,), 0, "match", True, 0), ("sala", (X.CHAMBER,), 1, "match", True, 0), ("tribunal", (X.TRIBUNAL,), 1, "match", True, 0),
    ("partida", (X.REGISTRY,), 0, "match", True, 0), ("resolucion", (X.RULING,), 0, "match", True, 0), ("historia_clinica", (X.MEDICAL,), 1, "match", True, 0),
    ("codigo_cliente", (X.CLIENT,), 1, "match", True, 0), ("licencia", (X.LICENCE,), 1, "match", True, 5), ("poliza", (X.POLICY,), 1, "match", True, 0),
    ("firma", X.SIGNATURES, 1, "match", True, 5), ("sello", X.SEALS, 1, "match", True, 4), ("huella", X.PRINTS, 1, "match", True, 5),
    ("email_context", (X.EMAIL_TRIGGER,), 1, "last", True, 0),
)


def _rule(name: str, patterns: tuple[str, ...], group: int, at: str, ignore_case: bool, least: int) -> None:
    parts = [f"SELECT doc_id, start, stop, trim(value) AS value FROM ({S.spans(('(?i)' if ignore_case else '') + p, group, at)})" for p in patterns]
    long = f" WHERE length(value) >= {least}" if least else ""

    @query(f"detect_{name}", S.with_legal(f"SELECT {COLUMNS} FROM ({' UNION ALL '.join(parts)}){long}"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return exploded(legal_text(spark, sf_dir), detect.found(F.col("text"), name))


for _r in PLAIN_RULES:
    _rule(*_r)

LONE = f"NOT regexp_matches({S.around(3)}, '\\d{{11}}')"
MONEY_SQL = "(" + " OR ".join(S.has_any(f"lower({c})", [w.lower() for w in X.MONEY]) for c in (S.before(30), S.after(30))) + ")"


def _sql_dni() -> str:
    told = " UNION ".join(f"SELECT {COLUMNS} FROM ({S.spans('(?i)' + p, 1, 'last')}) WHERE {LONE}" for p in (X.DNI_TRIGGER, X.DNI_SPACED))
    rest = f"SELECT {COLUMNS} FROM ({S.spans(X.DNI)}) WHERE {LONE} AND (contains(lower({S.before(10)}), 'dni') OR NOT {MONEY_SQL})"
    return S.with_legal(f"SELECT {COLUMNS} FROM (({told}) UNION ({rest}))")


@query("detect_dni", _sql_dni())
def detect_dni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(legal_text(spark, sf_dir), detect.dni(F.col("text")))


@query("detect_email", S.with_legal(f"SELECT {COLUMNS} FROM ({S.spans('(?i)' + X.EMAIL)})"))
def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(legal_text(spark, sf_dir), detect.found(F.col("text"), "email"))


def _sql_phone() -> str:
    every = " UNION ALL ".join(f"SELECT * FROM ({S.spans(p)})" for p in X.PHONES)
    cases = " UNION ALL ".join(f"SELECT doc_id, start, stop FROM ({S.spans('(?i)' + p)})" for p in X.CASE_FILES)
    marks = S.has_any(f"upper({S.before(40)} || ' ' || {S.after(20)})", X.CASE_MARKS)
    return S.with_legal(
        f", e AS ({cases}) SELECT {COLUMNS} FROM ({every}) m WHERE length(regexp_replace(value, '\\s+', '', 'g')) >= 9 AND NOT {marks} "
        "AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = m.doc_id AND e.start <= m.start AND m.stop <= e.stop + 5)"
    )


@query("detect_phone", _sql_phone())
def detect_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(legal_text(spark, sf_dir), detect.found(F.col("text"), "phone"))


@query("detect_phone_told", S.with_legal(f"SELECT {COLUMNS} FROM ({S.spans('(?i)' + X.PHONE_TRIGGER, 1, 'last')}) WHERE length(regexp_replace(value, '[\\s\\-()]', '', 'g')) >= 9"))
def detect_phone_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(legal_text(spark, sf_dir), detect.found(F.col("text"), "phone_told"))


@query("detect_plate", S.with_legal(f"SELECT {COLUMNS} FROM ({S.spans('(?i)' + X.PLATE)}) WHERE {S.has_any(f'lower({S.around(120)})', X.VEHICLE)}"))
def detect_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(legal_text(spark, sf_dir), detect.found(F.col("text"), "plate"))


# --- documents ------------------------------------------------------------------------------------------------


@query(
    "email_counts_by_lang",
    "SELECT lang, count(*)::BIGINT AS emails, count(DISTINCT v)::BIGINT AS addresses FROM (SELECT lang, unnest(regexp_extract_all(text, "
    f"'(?i){S.quoted(X.EMAIL)}', 1)) AS v FROM documents) GROUP BY lang",
)
def email_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.explode(detect.found(F.col("text"), "email")).alias("s"))
    return docs.groupBy("lang").agg(F.count("*").alias("emails"), F.countDistinct("s.value").alias("addresses"))


# --- merging --------------------------------------------------------------------------------------------------

SPANS_SQL = "SELECT l_orderkey AS doc_id, CAST(l_partkey % 200 AS INTEGER) AS start, CAST(l_partkey % 200 + 1 + l_linenumber * 3 AS INTEGER) AS stop, l_linenumber AS rank, l_suppkey AS tie FROM lineitem"
PLAIN = "array<struct<start:int,stop:int,rank:int,seq:bigint>>"


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "CAST(l_partkey % 200 AS INT) AS start", "CAST(l_partkey % 200 + 1 + l_linenumber * 3 AS INT) AS stop", "l_linenumber AS rank", "l_suppkey AS seq"
    )
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "rank", "seq")).alias("e"))


def _recursive(order: str, step: str) -> str:
    return f"""WITH RECURSIVE s AS (SELECT doc_id, start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS i FROM ({SPANS_SQL})),
r AS (SELECT doc_id, i, [{{'a': start, 'b': stop}}] AS st FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, {step} FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
f AS (SELECT doc_id, unnest(st) AS u FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)
SELECT doc_id, u.a AS start, u.b AS stop FROM f"""


MERGE_STEP = (
    "CASE WHEN st[-1].b <= s.start THEN list_append(st, {'a': s.start, 'b': s.stop}) "
    "WHEN s.stop - s.start > st[-1].b - st[-1].a THEN list_append(st[1:len(st)-1], {'a': s.start, 'b': s.stop}) ELSE st END"
)
CLAIM_STEP = "CASE WHEN len(list_filter(st, lambda k: s.start < k.b AND k.a < s.stop)) > 0 THEN st ELSE list_append(st, {'a': s.start, 'b': s.stop}) END"


def _last(sql: str) -> str:
    return sql.replace(
        "f AS (SELECT doc_id, unnest(st) AS u FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)",
        "f AS (SELECT doc_id, unnest(st) AS u FROM (SELECT doc_id, arg_max(st, i) AS st FROM r GROUP BY doc_id))",
    )


@query("merge_overlaps", _last(_recursive("start, start - stop, tie", MERGE_STEP)))
def merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic(spark, sf_dir).select("doc_id", F.explode(merge.merged(F.col("e"), PLAIN)).alias("s"))
    return rows.select("doc_id", "s.start", "s.stop")


@query("priority_claims", _last(_recursive("rank, tie, start", CLAIM_STEP)))
def priority_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = F.transform("e", lambda x: x.withField("seq", x["seq"] * 1000 + x["start"]))
    rows = synthetic(spark, sf_dir).select("doc_id", F.explode(merge.claims(fine, PLAIN)).alias("s"))
    return rows.select("doc_id", "s.start", "s.stop")


@query(
    "first_wins",
    "SELECT c_mktsegment AS kind, c_nationkey AS value, min(c_custkey) AS first_id FROM customer GROUP BY ALL",
)
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    kept = merge.first_of(rows, [F.col("c_mktsegment"), F.col("c_nationkey")], [F.col("c_custkey")])
    return kept.select(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("value"), F.col("c_custkey").alias("first_id"))


@query(
    "split_emails",
    S.with_legal(
        ", v AS (SELECT doc_id, text, unnest(regexp_extract_all('user' || client || '@mail' || client % 10 || '.gob.pe; x@y.org', '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})', 1)) AS value FROM lt) "
        "SELECT doc_id, value, CAST(instr(text, value) - 1 AS INTEGER) AS start, CAST(instr(text, value) - 1 + length(value) AS INTEGER) AS stop FROM v WHERE instr(text, value) > 0"
    ),
)
def split_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(F.lit("user"), "client", F.lit("@mail"), (F.col("client") % 10), F.lit(".gob.pe; x@y.org"))
    return merge.split_emails(legal_text(spark, sf_dir).withColumn("value", both), r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})")


# --- filters --------------------------------------------------------------------------------------------------

#: value, type, strong context -> whether it stays, and why
CASES = (
    ("Juan Perez Quispe", "PERSONA", False, True, "proper_name"),
    ("FUNDAMENTOS DE HECHO", "PERSONA", False, False, "whitelist_exact"),
    ("LEY N° 30364", "PERSONA", False, False, "whitelist_pattern"),
    ("Interpongo Demanda Civil", "PERSONA", False, False, "contains_legal_verb"),
    ("no obstante", "PERSONA", False, False, "legal_connector"),
    ("por lo que", "PERSONA", False, False, "whitelist_exact"),
    ("ALEGATOS FINALES", "PERSONA", False, False, "legal_title"),
    ("DEL CIVIL", "PERSONA", False, False, "all_excluded_words"),
    ("Ruiz Diaz", "PERSONA", True, True, "context_persona"),
    ("12 34", "PERSONA", True, False, "no_alpha_strong_ctx"),
    ("Enero Quispe", "PERSONA", True, False, "contains_month_or_date"),
    ("a b c d e f g h", "PERSONA", True, False, "too_long_strong_ctx"),
    ("a b c d e f g h", "PERSONA", False, False, "too_long_not_name"),
    ("Mamani Li", "PERSONA", False, True, "possible_name"),
    ("casa azul", "PERSONA", False, False, "default_reject_persona"),
    ("x", "PERSONA", False, False, "too_short"),
    ("12345678", "DNI", False, True, "structured_pii"),
    ("Calle Los Pinos 123", "DIRECCION", False, True, "address_structure"),
    ("cerca del rio", "DIRECCION", False, False, "no_address_structure"),
    ("Sala Civil", "SALA", False, True, "legal_entity"),
    ("SUMILLA", "ENTIDAD", False, False, "whitelist_exact"),
    ("Banco Norte", "ENTIDAD", False, True, "entity_needs_review"),
    ("Firma: X", "FIRMA", False, True, "signature_mark"),
    ("ABC-123", "PLACA", False, True, "vehicle_plate"),
    ("otro valor", "OTRO", False, True, "default_accept"),
)
_N = len(CASES)
_EXPECTED = ", ".join(f"({i}, {str(k).lower()}, '{r}')" for i, (_, _, _, k, r) in enumerate(CASES))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(i, v, t, s) for i, (v, t, s, _, _) in enumerate(CASES)], "case_no int, value string, type string, strong boolean")
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % _N).cast("int").alias("case_no"), "c_acctbal")
    return rows.join(F.broadcast(known), "case_no")


@query(
    "filter_reasons",
    f"WITH x(case_no, keep, reason) AS (VALUES {_EXPECTED}) SELECT reason, count(*)::BIGINT AS n, count(*) FILTER (keep)::BIGINT AS accepted, count(*) FILTER (NOT keep)::BIGINT AS rejected "
    f"FROM customer JOIN x ON c_custkey % {_N} = case_no GROUP BY reason",
)
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).select(filters.decide(F.col("value"), F.col("type"), F.col("strong")).alias("d"))
    return rows.groupBy("d.reason").agg(F.count("*").alias("n"), F.count_if("d.keep").alias("accepted"), F.count_if(~F.col("d.keep")).alias("rejected"))


LONG = "a b c d e f g h con muchas palabras mas que siguen hasta pasar de los cincuenta caracteres "


@query(
    "filter_rejected",
    f"WITH x(case_no, keep, reason) AS (VALUES {_EXPECTED}), v(case_no, type, value) AS (VALUES "
    + ", ".join(f"({i}, '{t}', '{S.quoted(v)}')" for i, (v, t, *_) in enumerate(CASES))
    + f") SELECT c_custkey AS id, type, value, reason FROM customer JOIN x ON c_custkey % {_N} = case_no JOIN v USING (case_no) WHERE NOT keep "
    f"UNION ALL SELECT c_custkey, 'PERSONA', substr('{LONG}' || c_name, 1, 50), 'too_long_not_name' FROM customer",
)
def filter_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a filter report lists of the rejected: type, the value's first 50 characters, reason."""
    known = spark.createDataFrame([(i, v, t, s) for i, (v, t, s, _, _) in enumerate(CASES)], "case_no int, value string, type string, strong boolean")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % _N).cast("int").alias("case_no"), "c_name")
    cases = rows.join(F.broadcast(known), "case_no").select("id", "type", "value", "strong")
    long = rows.select("id", F.lit("PERSONA").alias("type"), F.concat(F.lit(LONG), "c_name").alias("value"), F.lit(False).alias("strong"))
    return filters.rejected(cases.unionByName(long)).select("id", "type", "value", "reason")


@query(
    "filter_confidence",
    f"WITH x(case_no, keep, reason) AS (VALUES {_EXPECTED}), y AS (SELECT reason, CASE reason WHEN 'context_persona' THEN 0.78 WHEN 'possible_name' THEN 0.55 WHEN 'proper_name' THEN 0.75 ELSE 1.0 END AS cap, "
    f"CAST(c_custkey % 100 AS DOUBLE) / 100 AS conf FROM customer JOIN x ON c_custkey % {_N} = case_no WHERE keep) "
    "SELECT reason, round(sum(least(conf, cap)), 4) AS capped, round(sum(CASE reason WHEN 'possible_name' THEN least(conf, 0.7) WHEN 'proper_name' THEN greatest(conf, 0.9) ELSE conf END), 4) AS legacy FROM y GROUP BY reason",
)
def filter_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(i, v, t, s) for i, (v, t, s, _, _) in enumerate(CASES)], "case_no int, value string, type string, strong boolean")
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % _N).cast("int").alias("case_no"), (F.col("c_custkey") % 100 / 100).alias("conf")).join(F.broadcast(known), "case_no")
    rows = rows.withColumn("d", filters.decide(F.col("value"), F.col("type"), F.col("strong"))).where("d.keep")
    return rows.groupBy("d.reason").agg(
        F.round(F.sum(filters.capped(F.col("conf"), F.col("d.reason"))), 4).alias("capped"), F.round(F.sum(filters.legacy_confidence(F.col("conf"), F.col("d.reason"))), 4).alias("legacy")
    )


@query(
    "status_policy",
    "WITH e AS (SELECT c_custkey % 100 / 100.0 AS conf, CASE c_custkey % 4 WHEN 0 THEN 'DNI' WHEN 1 THEN 'PERSONA' WHEN 2 THEN 'ENTIDAD' ELSE 'PLACA' END AS type FROM customer), "
    "s AS (SELECT type, CASE WHEN type IN ('ENTIDAD', 'PLACA') THEN 'review' WHEN conf >= 0.8 THEN 'confirmed' WHEN conf >= 0.5 THEN 'review' END AS status FROM e) "
    "SELECT status, type, count(*)::BIGINT AS n FROM s WHERE status IS NOT NULL GROUP BY ALL",
)
def status_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    kind = F.element_at(F.lit(["DNI", "PERSONA", "ENTIDAD", "PLACA"]), (key % 4).cast("int") + 1)
    rows = table(spark, sf_dir, "customer").select(kind.alias("type"), filters.status(kind, key % 100 / 100).alias("status"))
    return rows.where("status IS NOT NULL").groupBy("status", "type").agg(F.count("*").alias("n"))


# --- tokens ---------------------------------------------------------------------------------------------------


def _found() -> Column:
    """Announced numbers, addresses and company numbers of a text, in that order."""
    told = spans(F.col("text"), Find(X.DNI_TRIGGER, 1, (1, 1), ignore_case=True, anchors=("d", "identificad", "con")))
    kinds = (("DNI", told), ("EMAIL", detect.found(F.col("text"), "email")), ("RUC", detect.found(F.col("text"), "ruc")))

    def named(kind: str, found):
        return F.transform(found, lambda s: F.struct(F.lit(kind).alias("type"), s["value"].alias("value"), s["start"].alias("start"), s["stop"].alias("stop")))

    return F.concat(*(named(k, a) for k, a in kinds))


def _entities_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(_found()).alias("seq", "e")).select("doc_id", "e.type", "e.value", "e.start", "e.stop", "seq")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities_of(legal_text(spark, sf_dir))


#: Texts of so many characters at most are numbered in place.
SHORT = 1 << 16


def tokened(spark: SparkSession, sf_dir: str, order: str, one: Callable[[DataFrame], DataFrame], rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Entities with tokens: documents of one row and a short text as arrays (doc_id, found) put through `one`, those that come in
    several rows or are long as rows put through `rows`, which need a shuffle."""
    docs = legal_copies(spark, sf_dir)
    alone = F.coalesce((F.col("copies") == 1) & (F.length("text") <= SHORT), F.lit(False))
    seq = F.transform(_found(), lambda e, i: F.struct(*(e[c].alias(c) for c in ("type", "value", "start", "stop")), i.alias("seq")))
    # a filter before the array is settled would have every text looked through twice
    found = settled(docs.where(alone), found=tokens.numbered_in(seq, order)).where(F.size("found") > 0).select("doc_id", "found")
    return one(found).unionByName(rows(tokens.numbered(_entities_of(docs.where(~alone)), order)))


_E = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS type, value, start, stop, {i} AS layer FROM ({S.spans(p, 1, at)})" for i, (k, p, at) in enumerate((("DNI", "(?i)" + X.DNI_TRIGGER, "last"), ("EMAIL", "(?i)" + X.EMAIL, "match"), ("RUC", X.RUC, "match")))
)


def _token_sql(order: str) -> str:
    return S.with_legal(
        f", e AS ({_E}), k AS (SELECT doc_id, type, upper(trim(value)) AS key, max(start) AS late, max(length(value)) AS size, min(layer * 100000 + start) AS seq FROM e GROUP BY ALL), "
        f"n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY {order}, key) AS number FROM k) "
        "SELECT e.doc_id, e.type, e.value, e.start, '{{' || e.type || '_' || n.number || '}}' AS token FROM e JOIN n ON e.doc_id = n.doc_id AND e.type = n.type AND upper(trim(e.value)) = n.key"
    )


for _order, _sql in (("last", "late DESC"), ("longest", "size DESC, seq"), ("listed", "seq")):

    @query(f"tokens_{_order}", _token_sql(_sql))
    def tokens_by(spark: SparkSession, sf_dir: str, order: str = _order) -> DataFrame:
        columns = ("doc_id", "type", "value", "start", "token")
        return tokened(spark, sf_dir, order, lambda docs: docs.select("doc_id", F.inline("found")).select(*columns), lambda rows: rows.select(*columns))


@query(
    "mask_values",
    S.with_legal(
        f", e AS ({_E}) SELECT doc_id, type, value, CASE WHEN type IN ('DNI', 'RUC') THEN substr(value, 1, 2) || repeat('*', length(value) - 4) || right(value, 2) "
        "ELSE substr(value, 1, 2) || '***@' || substr(value, instr(value, '@') + 1) END AS masked FROM e"
    ),
)
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("doc_id", "type", "value", tokens.masked(F.col("type"), F.col("value")).alias("masked"))


EMAIL_IN = "'user' || client || '@mail' || client % 10 || '.gob.pe'"


@query("redact_at", S.with_legal(f"SELECT doc_id, replace(text, {EMAIL_IN}, '{{{{EMAIL_1}}}}') AS clean FROM lt"))
def redact_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = legal_text(spark, sf_dir)
    spots = F.transform(detect.found(F.col("text"), "email"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit("{{EMAIL_1}}").alias("token")))
    return docs.select("doc_id", tokens.replaced_at(F.col("text"), spots).alias("clean"))


@query("redact_values", S.with_legal(f"SELECT doc_id, replace(replace(text, {EMAIL_IN}, '{{{{EMAIL_1}}}}'), 'Juan Perez Soto', '{{{{PERSONA_1}}}}') AS clean FROM lt"))
def redact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = legal_text(spark, sf_dir)
    one = lambda v, t, s, k: F.struct(v.alias("value"), F.lit(t).alias("token"), F.lit(s).alias("soft"), F.lit(k).alias("type"))
    email = F.concat(F.lit("USER"), "client", F.lit("@mail"), (F.col("client") % 10), F.lit(".gob.pe"))
    values = F.array(one(F.lit("Juan Perez Soto"), "{{PERSONA_1}}", True, "PERSONA"), one(email, "{{EMAIL_1}}", False, "EMAIL"))
    return docs.select("doc_id", tokens.replaced_values(F.col("text"), values).alias("clean"))


@query(
    "redact_first",
    S.with_legal("SELECT doc_id, CASE WHEN instr(text, 'Lima') > 0 THEN substr(text, 1, instr(text, 'Lima') - 1) || '{{LUGAR_1}}' || substr(text, instr(text, 'Lima') + 4) ELSE text END AS clean FROM lt"),
)
def redact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal_text(spark, sf_dir).select("doc_id", tokens.replaced_first(F.col("text"), F.lit("Lima"), F.lit("{{LUGAR_1}}")).alias("clean"))


# --- audit ----------------------------------------------------------------------------------------------------

FREE = f"NOT regexp_matches({S.around(20)}, '{X.TOKEN}')"
AUDIT_MONEY = "(" + " OR ".join(S.has_any(f"lower({c})", [w.lower() for w in X.MONEY]) for c in (S.before(40), S.after(40))) + ")"
_DATE = "(CAST(value[1:4] AS INT) BETWEEN 1900 AND 2100 AND CAST(value[5:6] AS INT) BETWEEN 1 AND 12 AND CAST(value[7:8] AS INT) BETWEEN 1 AND 31)"


def _firsts(sql: str) -> str:
    return f"SELECT doc_id, min(start) AS start, arg_min(stop, start) AS stop, value FROM ({sql}) GROUP BY doc_id, value"


AUDIT_SQL = {
    "DNI": f"SELECT {COLUMNS} FROM ({S.spans(X.DNI)}) WHERE {FREE} AND NOT {_DATE} AND ({S.has_any(f'lower({S.before(50)})', X.DNI_CONTEXT)} OR NOT ({AUDIT_MONEY} OR {S.has_any(f'lower({S.before(30)})', X.LEGAL_NUMBERS)}))",
    "EMAIL": f"SELECT {COLUMNS} FROM ({S.spans('(?i)' + X.AUDIT_EMAIL)}) WHERE NOT regexp_matches(lower(value), 'example\\.com|test\\.com')",
    "TELEFONO": "SELECT DISTINCT " + COLUMNS + " FROM (" + " UNION ALL ".join(f"SELECT * FROM ({S.spans(p)})" for p in X.AUDIT_PHONES) + f") WHERE {FREE} AND NOT {AUDIT_MONEY}",
    "COLEGIATURA": f"SELECT {COLUMNS} FROM ({S.spans('(?i)' + X.AUDIT_LICENSED, 0)}) WHERE {FREE}",
    "RUC": f"SELECT {COLUMNS} FROM ({S.spans(X.AUDIT_RUC)}) WHERE {FREE} AND contains(lower({S.before(30)}), 'ruc')",
    "PLACA": f"SELECT {COLUMNS} FROM ({S.spans('(?i)' + X.AUDIT_PLATE)}) WHERE {FREE} AND ({S.has_any(f'lower({S.before(50)})', X.AUDIT_VEHICLE)} OR {S.has_any(f'lower({S.after(50)})', X.AUDIT_VEHICLE)}) AND length(regexp_replace(value, '[- ]', '', 'g')) >= 5",
    "ACTA_REGISTRO": _firsts(f"SELECT * FROM ({S.spans('(?i)' + X.AUDIT_RECORD, 0)}) WHERE {FREE}"),
    "RESOLUCION": _firsts(f"SELECT * FROM ({S.spans('(?i)' + X.AUDIT_RULING, 0)}) WHERE {FREE}"),
    "PARTIDA": _firsts(f"SELECT * FROM ({S.spans('(?i)' + X.AUDIT_REGISTRY, 0)}) WHERE {FREE}"),
    "CASILLA": _firsts(" UNION ALL ".join(f"SELECT * FROM ({S.spans('(?i)' + p, 0)}) WHERE {FREE}" for p in X.AUDIT_MAILBOXES)),
}


def _audit(kind: str) -> None:
    sql = AUDIT_SQL[kind]

    @query(f"audit_{kind.lower()}", S.with_legal(sql))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return exploded(legal_text(spark, sf_dir), audit.find(F.col("text"), kind))


for _kind in AUDIT_SQL:
    _audit(_kind)


@query(
    "eval_scores",
    "WITH d AS (SELECT o_custkey AS doc_id, count(*) AS found, count(*) FILTER (o_orderstatus = 'F') AS leaked, count(*) FILTER (o_orderstatus <> 'F') AS replaced, "
    "count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 5 = 0) AS over FROM orders GROUP BY 1), m AS (SELECT *, greatest(0.0, (found - leaked)::DOUBLE / found) AS r, "
    "CASE WHEN replaced > 0 THEN greatest(0.0, 1 - over::DOUBLE / replaced) ELSE 1.0 END AS p FROM d) SELECT doc_id, round(r, 4) AS privacy_recall, round(p, 4) AS precision, round(0.7 * r + 0.3 * p, 4) AS final_score FROM m",
)
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.count("*").alias("found"), F.count_if(s == "F").alias("leaked"), F.count_if(s != "F").alias("replaced"), F.count_if((s == "P") & (F.col("o_orderkey") % 5 == 0)).alias("over")
    )
    return rows.select("doc_id", *audit.scores(F.col("found"), F.col("leaked"), F.col("replaced"), F.col("over")))


# --- reports --------------------------------------------------------------------------------------------------


@query("report_counts", S.with_legal(f", e AS ({_E}) SELECT type, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS distinct_values FROM e GROUP BY 1"))
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))
