"""Seams for models: named-entity recognisers and language models, handed in by the caller.

A recogniser is `load() -> (text -> [(label, start, stop)])`, loaded once a worker. A language model is a function
`ask(list of requests) -> list of answers`, called with a batch of requests at a time; a batch whose call fails has no
answers. Python runs the model and nothing else: chunks, batches, policies and places are Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veladura.functions import lexicon as L
from veladura.functions.spans import has_any

from . import filters, templates
from .context import overlaps, tokens_in
from .detect import excluded

Recogniser = Callable[[str], list[tuple[str, int, int]]]
CHUNK = 100_000
# --- fixed values: types of a language model, what an address holds -------------------------------------------
ALIASES = {
    "DNI": "DNI", "RUC": "RUC", "CE": "DNI", "PASAPORTE": "DNI", "EMAIL": "EMAIL", "TELEFONO": "TELEFONO", "DIRECCION": "DIRECCION",
    "PERSONA": "PERSONA", "NOMBRE_PERSONA": "PERSONA", "NOMBRE_MENOR": "PERSONA", "PLACA": "PLACA", "CUENTA_BANCARIA": "CUENTA",
    "CCI": "CUENTA", "TARJETA": "CUENTA", "EXPEDIENTE": "EXPEDIENTE", "FECHA_NACIMIENTO": "FECHA_NACIMIENTO", "FIRMA": "FIRMA",
    "COLEGIATURA": "COLEGIATURA", "CAL": "COLEGIATURA", "CMP": "COLEGIATURA", "CIP": "COLEGIATURA", "ENTIDAD": "ENTIDAD", "ORG": "ENTIDAD",
    "ACTA": "ACTA_REGISTRO", "REGISTRO": "ACTA_REGISTRO", "RESOLUCION": "RESOLUCION", "PARTIDA": "PARTIDA", "CASILLA": "CASILLA",
    "CASILLA_ELECTRONICA": "CASILLA", "JUZGADO": "JUZGADO", "TRIBUNAL": "TRIBUNAL", "SALA": "SALA",
}
AMBIGUOUS = ("PERSONA", "ENTIDAD", "DIRECCION")
REAL = ("PERSONA_REAL", "ENTIDAD_INSTITUCIONAL", "DIRECCION_FISICA")
DROPPED = ("TITULO_JURIDICO", "TEXTO_NO_SENSIBLE")
STOPWORDS = ("de", "la", "el", "en", "y", "a", "que", "por", "con", "del", "al", "los", "las", "un", "una", "su", "sus", "es", "se")
PLACE_HINTS = ("av", "jr", "calle", "urb", "mz", "lt")
NEAR_PERSON = ("identificado", "demandante", "demandado", "señor", "señora", "don", "doña", "abogado", "menor", "madre", "padre")
NEAR_PLACE = ("domicilio", "reside", "ubicado", "dirección", "av.", "jr.", "calle")
SEVERITY = ("error", "advertencia", "sugerencia")


def recognised(docs: DataFrame, load: Callable[[], Recogniser], chunk: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) to doc_id, label, value, start, stop: what a recogniser finds in chunks of a text, placed in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for rows in batches:
            out = [(i, label, t[a:b], o + a, o + b) for i, o, t in zip(rows["doc_id"], rows["at"], rows["chunk"], strict=True) for label, a, b in model(t)]
            yield pd.DataFrame(out, columns=["doc_id", "label", "value", "start", "stop"])

    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(chunk))
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(starts).alias("at"))
    rows = rows.select("doc_id", "at", F.substring("text", F.col("at") + 1, F.lit(chunk)).alias("chunk"))
    return rows.mapInPandas(run, "doc_id long, label string, value string, start int, stop int")


def as_entities(found: DataFrame, source: str = "spacy") -> DataFrame:
    """What counts of a general recogniser: persons, organisations, and places that look like addresses."""
    value, label = F.trim("value"), F.col("label")
    kind = F.when(label.isin("PER", "PERSON"), "PERSONA").when(label == "ORG", "ENTIDAD").when(label.isin("LOC", "GPE"), "DIRECCION")
    rows = found.select("doc_id", kind.alias("type"), value.alias("value"), "start", "stop", F.lit(source).alias("source"), F.lit(1.0).alias("confidence"))
    long = F.length("value") > F.when(F.col("type") == "PERSONA", 2).otherwise(3)
    return rows.where(F.col("type").isNotNull() & long & ~excluded(F.col("value")) & ((F.col("type") != "DIRECCION") | has_any(F.lower("value"), PLACE_HINTS)))


def as_trained(found: DataFrame, docs: DataFrame) -> DataFrame:
    """What counts of a recogniser trained on these labels: every value of two characters in texts of ten, at .85."""
    long = docs.where(F.length(F.trim("text")) >= 10).select("doc_id")
    rows = found.join(long, "doc_id", "left_semi").select("doc_id", F.col("label").alias("type"), F.trim("value").alias("value"), "start", "stop")
    return rows.where(F.length("value") >= 2).select("*", F.lit("local_ner").alias("source"), F.lit(0.85).alias("confidence"))


def as_claims(found: DataFrame, docs: DataFrame) -> DataFrame:
    """What the older detector takes of a recogniser: names of two words at .75, .90 with a word for a person in the 50
    characters before; places with a word for an address in the 30 before; nothing inside placeholders, and nothing of
    what lies beyond the first 100,000 characters, which is all that it reads."""
    rows = found.where(F.col("stop") <= CHUNK).join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.withColumn("__tokens", tokens_in(F.col("text")))
    here = F.struct("start", "stop")
    rows = rows.where(~F.exists("__tokens", lambda t: overlaps(t, here)))
    left = lambda n: F.lower(F.substring("text", F.greatest(F.col("start") - n, F.lit(0)) + 1, F.least(F.col("start"), F.lit(n))))
    name = (F.col("label") == "PER") & (F.length("value") > 3) & F.contains("value", F.lit(" "))
    name = name & ~F.forall(filters.words(F.upper("value")), lambda w: F.array_contains(filters.listed(L.OLD_NO_NAMES), w))
    place = (F.col("label") == "LOC") & (F.length("value") > 5) & has_any(left(30), NEAR_PLACE)
    sure = F.when(place, 0.70).when(has_any(left(50), NEAR_PERSON), 0.90).otherwise(0.75)
    return rows.where(name | place).select("doc_id", F.when(place, "DIRECCION").otherwise("PERSONA").alias("type"), "value", "start", "stop", sure.alias("confidence"))


# --- language models ------------------------------------------------------------------------------------------


def asked(requests: DataFrame, ask: Callable[[list[dict]], list], answer: str, batch: int = 25) -> DataFrame:
    """requests (any columns) with a column `answer` of the given type: batches of up to `batch` rows of a partition go to
    the model at once; where the call fails or gives another number of answers, answers are null and `error` says why."""
    names = requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            answers, errors = [], []
            for at in range(0, len(rows), batch):
                part, error = rows.iloc[at : at + batch], None
                try:
                    got = list(ask(part.to_dict("records")))
                    if len(got) != len(part):
                        error = f"{len(got)} answers to {len(part)} requests"
                except Exception as e:  # noqa: BLE001  whatever a client raises is an answer not given, and is told
                    got, error = [], f"{type(e).__name__}: {e}"[:500]
                answers += [None] * len(part) if error else got
                errors += [error] * len(part)
            yield rows.assign(answer=pd.Series(answers, index=rows.index, dtype=object), error=pd.Series(errors, index=rows.index, dtype=object))

    kinds = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
    return requests.mapInPandas(run, f"{kinds}, answer {answer}, error string").select(*names, "answer", "error")


def detected_by(docs: DataFrame, ask: Callable[[list[dict]], list]) -> DataFrame:
    """docs (doc_id, text of 50 characters or more) to what a model finds in them: texts are pre-redacted, cut into chunks of
    whole paragraphs, asked about; types go by their canonical names, placeholders are no values, each value once."""
    rows = templates.pre_redacted(docs.where(F.length(F.trim("text")) >= 50).select("doc_id", "text"))
    chunks = rows.select("doc_id", F.posexplode(templates.paragraphs(F.col("clean"))).alias("chunk_no", "chunk"))
    found = asked(chunks, ask, "array<struct<type:string,value:string>>").select("doc_id", "chunk_no", F.posexplode("answer").alias("place", "e"))
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    kind = F.upper("e.type")
    found = found.select("doc_id", "chunk_no", "place", F.coalesce(F.try_element_at(alias, kind), kind).alias("type"), F.trim("e.value").alias("value"))
    found = found.where((F.col("value") != "") & ~F.col("value").rlike(r"^\{\{.*\}\}$")).withColumn("key", F.lower("value"))
    first = Window.partitionBy("doc_id", "type", "key").orderBy("chunk_no", "place")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select("doc_id", "type", "value")


def validated(entities: DataFrame, docs: DataFrame, ask: Callable[[list[dict]], list], context: int = 120, batch: int = 25) -> DataFrame:
    """entities (doc_id, type, value, start, stop, source, confidence) after a model has judged the ambiguous ones, each with
    `context` characters on either side. Values that are empty, short, without letters or a stop word go before; what it
    takes for real rises to .82 at least, what it doubts or doesn't answer falls to .65 at most, titles and plain text go.
    All other types stay as they are. decision tells what it said."""
    open_to = entities.where(F.upper("type").isin(*AMBIGUOUS))
    rest = entities.where(~F.upper("type").isin(*AMBIGUOUS)).withColumn("decision", F.lit(None).cast("string"))
    value = F.trim("value")
    fine = (F.length(value) >= 4) & ~value.rlike(r"(?U)^[\d\W_]+$") & ~F.lower(value).isin(*STOPWORDS)
    rows = open_to.where(fine).join(docs.select("doc_id", "text"), "doc_id")
    before = F.substring("text", F.greatest(F.col("start") - context, F.lit(0)) + 1, F.least(F.col("start"), F.lit(context)))
    rows = rows.select(*entities.columns, before.alias("before"), F.substring("text", F.col("stop") + 1, F.lit(context)).alias("after"))
    said = asked(rows, ask, "string", batch).withColumn("decision", F.upper(F.trim(F.coalesce("answer", F.lit("DUDOSO")))))
    said = said.withColumn("decision", F.when(F.col("decision").isin(*REAL, *DROPPED), F.col("decision")).otherwise("DUDOSO")).where(~F.col("decision").isin(*DROPPED))
    real = F.col("decision").isin(*REAL)
    said = said.withColumns({
        "confidence": F.when(real, F.greatest("confidence", F.lit(0.82))).otherwise(F.least("confidence", F.lit(0.65))),
        "source": F.when(real, F.concat("source", F.lit("+ai_confirmed"))).otherwise(F.col("source")),
    })
    return rest.unionByName(said.select(*entities.columns, "decision"))


def recalled(docs: DataFrame, known: DataFrame, ask: Callable[[list[dict]], list], focused: tuple[str, ...] | None = None) -> DataFrame:
    """What a model finds beyond the known values (doc_id, value): only what stands in its chunk and isn't known, each value
    once, where it first stands in the text. With `focused` words it sees the end of a text and the lines that hold them
    (a last audit: critical finds count .85, others .82); else all of it in overlapping chunks, at .85."""
    rows = docs.select("doc_id", "text")
    seen = F.col("text") if focused is None else F.when(F.length("text") <= 2000, F.col("text")).otherwise(templates.focus(F.col("text"), focused))
    chunks = rows.select("doc_id", F.posexplode(templates.overlapping(seen)).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.chunk")
    found = asked(chunks, ask, "array<struct<type:string,value:string,priority:string>>").select("doc_id", "chunk_no", "chunk", F.posexplode("answer").alias("place", "e"))
    found = found.select("doc_id", "chunk_no", "place", "chunk", F.upper(F.trim("e.type")).alias("type"), F.trim("e.value").alias("value"), F.lower("e.priority").alias("priority"))
    found = found.where((F.col("type") != "") & (F.col("value") != "") & F.contains("chunk", F.col("value"))).withColumn("key", F.lower("value"))
    found = found.join(known.select("doc_id", F.lower("value").alias("key")).distinct(), ["doc_id", "key"], "left_anti")
    first = Window.partitionBy("doc_id", "key").orderBy("chunk_no", "place")
    found = found.withColumn("n", F.row_number().over(first)).where("n = 1").join(rows, "doc_id").withColumn("start", F.expr("locate(value, text) - 1")).where("start >= 0")
    sure = F.lit(0.85) if focused is None else F.when(F.col("priority") == "critical", 0.85).otherwise(0.82)
    return found.select("doc_id", "type", "value", "start", (F.col("start") + F.length("value")).alias("stop"), sure.alias("confidence"), F.lit("ai_recall" if focused is None else "ai_final_audit").alias("source"))


def similar(documents: DataFrame, questions: DataFrame, ask: Callable[[list[dict]], list], latest: int = 100, most: int = 10) -> DataFrame:
    """questions (tenant, question) with up to `most` ids of a tenant's `latest` documents (tenant, id, name, description,
    body, created) that a model picks by their names and first characters. The two numbers are what the feature is; an id
    of another tenant, or of no document, is no answer."""
    new = Window.partitionBy("tenant").orderBy(F.col("created").desc(), F.col("id").desc())
    last = documents.withColumn("n", F.row_number().over(new)).where(F.col("n") <= latest)
    shown = F.struct("id", "name", F.substring("description", 1, 200).alias("description"), F.substring("body", 1, 500).alias("body"))
    offers = last.groupBy("tenant").agg(F.array_sort(F.collect_list(shown)).alias("documents"))
    said = asked(questions.join(offers, "tenant").select("tenant", "question", F.to_json("documents").alias("documents")), ask, "array<long>", 1)
    picked = said.select("tenant", "question", F.posexplode(F.slice("answer", 1, most)).alias("place", "id"))
    return picked.join(documents.select("tenant", "id", "name"), ["tenant", "id"])


def reviewed(docs: DataFrame, ask: Callable[[list[dict]], list]) -> DataFrame:
    """What a model has to say of each document (doc_id, text), issue by issue, errors first, then warnings, then the rest."""
    said = asked(docs.select("doc_id", "text"), ask, "array<struct<severity:string,kind:string,fragment:string>>", 1)
    rows = said.select("doc_id", F.posexplode("answer").alias("place", "i")).select("doc_id", "place", "i.severity", "i.kind", "i.fragment")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(s) for s in SEVERITY[:2])), F.col("severity")), F.lit(0)), F.lit(len(SEVERITY)))
    order = Window.partitionBy("doc_id").orderBy(rank, "place")
    return rows.withColumn("position", F.row_number().over(order)).drop("place")


def argued(jobs: DataFrame, docs: DataFrame, ask: Callable[[list[dict]], list]) -> DataFrame:
    """jobs (job_id, doc_id, section, wish) against docs (doc_id, text): the section is found, a model rewrites or explains it,
    a rewritten one goes back in its place. status is done, not_found or failed; kind is the wish's intent."""
    bounds = templates.sections(docs)
    rows = jobs.join(docs.select("doc_id", "text"), "doc_id").join(bounds, ["doc_id", "section"], "left").withColumn("kind", templates.intent(F.col("wish")))
    found = rows.where("first IS NOT NULL").withColumn("body", templates.section_text(F.col("text"), F.col("first"), F.col("last")))
    said = asked(found.select("job_id", "text", "first", "last", "kind", "wish", "body"), ask, "string", 1)
    again = F.when(F.col("kind") == "rewrite", templates.with_section(F.col("text"), F.col("first"), F.col("last"), F.col("answer"))).otherwise(F.col("text"))
    done = said.select("job_id", "kind", F.when(F.col("answer").isNull(), "failed").otherwise("done").alias("status"), "answer", F.when(F.col("answer").isNull(), F.col("text")).otherwise(again).alias("text"))
    lost = rows.where("first IS NULL").select("job_id", "kind", F.lit("not_found").alias("status"), F.lit(None).cast("string").alias("answer"), "text")
    return done.unionByName(lost)


def by_document(entities: DataFrame) -> Column:
    """Entities of a table as the array that the detectors take for those of a model (`detect(more=...)`)."""
    return F.collect_list(F.struct("type", "value", "start", "stop", "source", "confidence", F.lit(0).alias("seq")))
