"""Templates, sections, forms and chunks: text analytics around the anonymizer, as column expressions."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veladura.functions import fixed as X
from veladura.functions.spans import has_any, java, settled

# --- fixed values: sections, intents --------------------------------------------------------------------------
SECTIONS = {
    "hechos": (
        r"(I+\.?\s*)?(DE\s+LOS\s+)?HECHOS\s*:?", r"PRIMERO\s*[:.\-]", r"ANTECEDENTES\s*:?", r"EXPOSICI[OÓ]N\s+DE\s+(LOS\s+)?HECHOS",
        r"RELACI[OÓ]N\s+DE\s+(LOS\s+)?HECHOS", r"NARRACI[OÓ]N\s+DE\s+(LOS\s+)?HECHOS",
    ),
    "fundamentos": (
        r"(I+\.?\s*)?FUNDAMENTOS?\s+(DE\s+)?(DERECHO|JUR[IÍ]DICO|HECHO\s+Y\s+DERECHO)", r"FUNDAMENTACI[OÓ]N\s+JUR[IÍ]DICA", r"BASE\s+LEGAL",
        r"MARCO\s+(LEGAL|JUR[IÍ]DICO|NORMATIVO)", r"CONSIDERACIONES\s+(DE\s+)?DERECHO", r"AMPARO\s+LEGAL",
    ),
    "petitorio": (
        r"PETITORIO\s*:?", r"POR\s+(LO\s+)?TANTO\s*:?", r"POR\s+ESTAS?\s+CONSIDERACIONES?\s*:?", r"SOLICITO\s*:?", r"SE\s+SIRVA\s*:?",
        r"PEDIMENTO\s*:?", r"CONCLUSI[OÓ]N\s*:?",
    ),
}
ASKED = (
    "cuales son", "cuáles son", "que hiciste", "qué hiciste", "que cambiaste", "qué cambiaste", "que modificaste", "qué modificaste",
    "que parte", "qué parte", "que partes", "qué partes", "quiero ver", "quiero saber", "muestrame", "muéstrame", "dime que", "dime qué",
    "explica que", "explica qué", "cuales fueron", "cuáles fueron", "que son los cambios", "qué son los cambios",
    "los cambios que hiciste", "los cambios que realizaste", "me puedes decir", "me puedes explicar", "puedes decirme", "puedes explicarme",
)
OPENINGS = (
    "qué ", "que ", "cuál ", "cual ", "cómo ", "como ", "por qué ", "por que ", "dónde ", "donde ", "cuándo ", "cuando ", "quién ",
    "quien ", "explica", "explicame", "explícame", "dime ", "cuéntame", "cuentame",
)
QUESTIONS = (
    "explica", "explicame", "explícame", "por qué", "por que", "qué pasa si", "que pasa si", "cómo puedo", "como puedo",
    "ayúdame a entender", "ayudame a entender", "qué argumento", "que argumento", "está bien", "esta bien", "es correcto", "qué opinas",
    "que opinas", "crees que", "debería", "deberia", "puedo agregar", "puedo añadir", "sugieres", "recomiendas", "significa", "cuál es",
    "cual es", "qué es", "que es", "dime", "cuéntame", "cuentame", "los cambios", "que hiciste", "que modificaste", "que cambiaste",
)
CHANGES = (
    "añade", "anade", "agrega", "elimina", "quita", "borra", "reescribe", "modifica", "cambia a", "cambia el", "cambia la", "cambia los",
    "mejora el", "mejora la", "mejora los", "refuerza", "amplía", "amplia", "reduce", "resume", "desarrolla", "incluye", "incorpora",
    "expande", "reestructura", "pon ", "coloca", "escribe",
)


def placeholders(text: Column) -> Column:
    """The distinct {{FIELDS}}, sorted."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"\{\{([^}]+)\}\}"), F.lit(1)), lambda f: F.trim(f))
    return F.array_sort(F.array_distinct(names))


BRACKETS = (
    ("curly_double", r"\{\{([^}]+)\}\}"), ("curly_single", r"\{([^{}]+)\}"), ("brackets_double", r"\[\[([^\]]+)\]\]"),
    ("brackets_single", r"\[([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s_]+)\]"),
)


def bracket_fields(text: Column) -> Column:
    """Names in the four bracket styles, style after style, underscores as spaces."""
    every = F.concat(*(F.regexp_extract_all(text, F.lit(java(p)), F.lit(1)) for _, p in BRACKETS))
    return F.filter(F.transform(every, lambda f: F.trim(F.replace(F.trim(f), F.lit("_"), F.lit(" ")))), lambda f: F.length(f) > 1)


def field_key(name: Column) -> Column:
    """A field's key: without accents, other characters as one underscore, 50 characters at most."""
    plain = F.translate(F.lower(F.trim(name)), "áàäâéèëêíìïîóòöôúùüûñ", "aaaaeeeeiiiioooouuuun")
    key = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(key == "", "campo").otherwise(F.substring(key, 1, 50))


def given(value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("{{FALTA_DATO}}"))


def sections(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, section, first, last: the first line of 200 characters at most that opens each
    section, counted from 0, and the line before which it ends."""
    lines = docs.select("doc_id", F.size(F.split("text", "\n")).alias("lines"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    short = F.length(F.trim("body")) <= 200
    named = F.explode(F.array(*(F.when(short & F.col("body").rlike(java("|".join(ps), True)), F.lit(k)) for k, ps in SECTIONS.items()))).alias("section")
    starts = lines.select("doc_id", "lines", "line", named).where("section IS NOT NULL").groupBy("doc_id", "section").agg(F.min("line").alias("first"), F.first("lines").alias("lines"))
    rank = F.array_position(F.lit(list(SECTIONS)), F.col("section"))
    following = F.lead("first").over(Window.partitionBy("doc_id").orderBy("first", rank))
    return starts.select("doc_id", "section", "first", F.coalesce(following, "lines").alias("last"))


def section_text(text: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), first + 1, last - first), "\n")


def with_section(text: Column, first: Column, last: Column, body: Column) -> Column:
    """The text with lines first to last (left out) replaced."""
    lines = F.split(text, "\n")
    return F.array_join(F.concat(F.slice(lines, 1, first), F.array(body), F.slice(lines, last + 1, F.size(lines))), "\n")


def intent(text: Column) -> Column:
    """explanation or rewrite, by question marks, phrases, openings, then the larger count of key phrases."""
    low = F.lower(F.trim(text))
    count = lambda words: F.size(F.filter(F.lit(list(words)), lambda w: F.contains(low, w)))
    asks = text.rlike("[?¿]") | has_any(low, ASKED) | low.rlike("^(?:" + "|".join(OPENINGS) + ")")
    return F.when(asks, "explanation").when((count(QUESTIONS) >= count(CHANGES)) & (count(QUESTIONS) > 0), "explanation").otherwise("rewrite")


def form_tables(answers: DataFrame) -> DataFrame:
    """answers (form_id, fields map) with keys tabla_{t}_{i}_{col} to form_id, tabla, row_no, cells (map): rows with any data."""
    cells = answers.select("form_id", F.explode("fields").alias("k", "v")).where(F.col("k").rlike(r"^tabla_[a-z0-9]+_\d+_"))
    part = lambda i: F.regexp_extract("k", r"^tabla_([a-z0-9]+)_(\d+)_(.+)$", i)
    cells = cells.select("form_id", part(1).alias("tabla"), part(2).cast("int").alias("row_no"), part(3).alias("col"), F.trim("v").alias("v"))
    rows = cells.groupBy("form_id", "tabla", "row_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "v")))).alias("cells"), F.max(F.col("v") != "").alias("any"))
    return rows.where("any").drop("any")


# --- chunks and pre-redaction ---------------------------------------------------------------------------------


def overlapping(text: Column, size: int = 2000, overlap: int = 100) -> Column:
    """array<struct<start, chunk>>: chunks of `size` characters, each `overlap` before the last one's end."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda o: F.struct(o.alias("start"), F.substring(text, o + 1, F.lit(size)).alias("chunk")))


def paragraphs(text: Column, most: int = 6000) -> Column:
    """Chunks of whole paragraphs up to `most` characters; longer paragraphs are cut between words."""
    add = lambda acc, piece, sep: F.when(
        (F.size(acc) == 0) | (F.length(F.element_at(acc, -1)) + F.length(piece) + len(sep) > most), F.concat(acc, F.array(piece))
    ).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(sep), piece))))
    empty = F.array().cast("array<string>")
    cut = lambda para: F.when(F.length(para) <= most, F.array(para)).otherwise(F.aggregate(F.filter(F.split(para, r"\s+"), lambda w: w != ""), empty, lambda acc, w: add(acc, w, " ")))
    pieces = F.flatten(F.transform(F.split(text, "\n\n"), cut))
    chunks = F.aggregate(pieces, empty, lambda acc, piece: add(acc, piece, "\n\n"))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.filter(F.transform(chunks, lambda c: F.trim(c)), lambda c: c != ""))


def focus(text: Column, words: tuple[str, ...], tail: int = 2000) -> Column:
    """The lines that hold sensitive words, and the end of the text."""
    lines = F.array_join(F.filter(F.split(text, "\n"), lambda line: has_any(F.lower(line), words)), "\n")
    return F.concat(lines, F.lit("\n"), F.right(text, F.lit(tail)))


PRE_REDACTED = T.StructType([T.StructField("clean", T.StringType()), T.StructField("marks", T.MapType(T.StringType(), T.StringType()))])
#: The same patterns, each beginning with what is rare in a text, what stands before it looked at afterwards; the addresses'
#: part from the @ on. Tests hold them against the patterns themselves.
PRE_KINDS = tuple((n, re.compile(p, re.I if n in ("EMAIL_PRE", "PLACA_PRE") else 0)) for n, p in (
    ("EMAIL_PRE", r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"), ("RUC_PRE", r"(?:10|15|17|20)(?<=\b..)\d{9}\b"),
    ("TEL_PRE", r"\+51[\s\-]?9[\d\s\-]{8,12}|9(?<=\b9)(?:\d{8}\b|\d{2}[\s\-]?\d{3}[\s\-]?\d{3}\b)"), ("CCI_PRE", r"\d(?<=\b\d)\d{19}\b"),
    ("PLACA_PRE", r"(?<=\b[A-Z]{3})[-\s]?\d{3}\b"), ("DNI_PRE", r"\d(?<=\b\d)\d{7}\b"),
))
LOCAL = string.ascii_letters + string.digits + "._%+-" + "\u0130\u0131\u017f\u212a"  # the last ones are letters where case doesn't matter
_EDGE = re.compile(r"\b(?=[^@])")


def pre_places(name: str, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Where a kind stands in a text: start and stop."""
    free = 0
    for m in pattern.finditer(text):
        start = m.start()
        if name == "EMAIL_PRE":
            edge = _EDGE.search(text, free + len(text[free:start].rstrip(LOCAL)), start)
            if edge is None:
                continue
            start = edge.start()
        elif name == "PLACA_PRE":
            start -= 3
        free = m.end()
        yield start, free


def _marked(text: str) -> tuple[str, list[tuple[str, str]]]:
    """One text with its marks; a number of eight digits that money or a law precedes is none of identity."""
    marks: list[tuple[str, str]] = []
    for name, pattern in PRE_KINDS:
        parts, at, n = [], 0, 0
        for start, stop in pre_places(name, pattern, text):
            if name == "DNI_PRE" and any(w in text[max(start - 20, 0) : start].lower() for w in X.PRE_REDACT_DNI_AFTER):
                continue
            n += 1
            parts += [text[at:start], mark := f"[{name}_{n}]"]
            marks.append((mark, text[start:stop]))
            at = stop
        text = "".join(parts) + text[at:] if n else text
    return text, marks


@F.arrow_udf(PRE_REDACTED)
def _pre_redacted(texts: pa.Array) -> pa.Array:
    done = [(None, []) if t is None else _marked(t) for t in texts.to_pylist()]
    clean, marks = pa.array([c for c, _ in done], pa.string()), pa.array([m for _, m in done], pa.map_(pa.string(), pa.string()))
    return pa.StructArray.from_arrays([clean, marks], names=["clean", "marks"])


def pre_redacted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with clean and marks: addresses, company numbers, phones, accounts, plates and identity numbers
    as numbered marks, kind after kind over the text as the kind before left it; marks maps each to what it stands for.
    One pass of Python a text does all kinds."""
    return settled(docs, done=_pre_redacted(F.col("text"))).select(*docs.columns, "done.clean", "done.marks")


def restored(clean: Column, marks: Column) -> Column:
    """The text with its marks replaced by what they stand for."""
    return F.aggregate(F.map_entries(marks), clean, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def merged_suggestions(local: DataFrame, suggested: DataFrame, docs: DataFrame, confidence: float = 0.9) -> DataFrame:
    """local (doc_id, type, value, start, stop) and what a model suggests (doc_id, type, value) that no local value
    equals without regard to case and that the text holds, placed where it first stands."""
    known = local.select("doc_id", F.lower("value").alias("v"))
    fresh = suggested.withColumn("v", F.lower("value")).join(known, ["doc_id", "v"], "left_anti").dropDuplicates(["doc_id", "v"]).join(docs.select("doc_id", "text"), "doc_id")
    fresh = fresh.withColumn("start", F.expr("locate(value, text) - 1")).where("start >= 0")
    fresh = fresh.select("doc_id", "type", "value", "start", (F.col("start") + F.length("value")).alias("stop"), F.lit(confidence).alias("confidence"))
    return local.select("doc_id", "type", "value", "start", "stop", F.lit(1.0).alias("confidence")).unionByName(fresh)


def all_places(docs: DataFrame, values: DataFrame) -> DataFrame:
    """Every place of each value (doc_id, value) in its text."""
    rows = docs.join(values, "doc_id")
    parts = F.expr("split(text, concat('\\\\Q', value, '\\\\E'), -1)")
    fold = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length("value")).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out")),
        lambda acc: acc["out"],
    )
    return rows.select("doc_id", "value", F.explode(fold).alias("start"))
