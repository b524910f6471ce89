"""Fields of templates: names in brackets, blanks of dots or underscores with the words before them, lines that end in a
colon. One pass finds the places, folds in Spark name and number them in the order in which the patterns speak."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veladura.functions.spans import Find, matches

from .templates import BRACKETS, field_key

# --- fixed values: blanks, long fields ------------------------------------------------------------------------
BLANK = r"([A-Za-zÁÉÍÓÚáéíóúÑñ\s\.\,\-°]+?)(?:N[°º]?\s*)?([\.…]{3,}|_{3,})"
BLANK_LOOSE = r"([A-Za-zÁÉÍÓÚáéíóúÑñ\s\.\,\-°]+?)(?:N[°º]?\s*)?[\.…]{3,}|_{3,}"
WORDS = r"([A-Za-zÁÉÍÓÚáéíóúÑñ]+(?:\s+[A-Za-zÁÉÍÓÚáéíóúÑñ]+)*)"
LONG_FIELDS = (
    "HECHOS", "FUNDAMENTOS", "DETALLE", "NARRACION", "DESCRIPCION", "PETITORIO", "PRETENSION", "CONCLUSION", "OBSERVACIONES",
    "ANTECEDENTES",
)

#: Runs of what a blank and its words are made of, up to their last blank: no other place can hold one.
_RUN = Find(r"(?<![A-Za-zÁÉÍÓÚáéíóúÑñ\s.,\-°º…_])([A-Za-zÁÉÍÓÚáéíóúÑñ\s.,\-°º…_]*(?:[.…]{3}|_{3})[.…_]*)", hints=("...", "…", "___"))
COLON = Find(r"^([^:\n]*):(?:[^\n]*:)?[^\S\n]*$", 1, (1, 0), multiline=True, hints=(":",))
STYLES = (*(n for n, _ in BRACKETS), "dots_underscores", "colon_field")


def long_field(name: Column) -> Column:
    return F.upper(name).rlike("|".join(LONG_FIELDS))


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def _label(text: Column, m: Column) -> Column:
    """What a blank is called: the words in its match, else the last ones of the 50 characters before it."""
    told = F.regexp_replace(_strip(F.coalesce(m["key"], F.lit(""))), r"(?U)^[,.\s]+|[,.\s]+$", "")
    start = F.greatest(m["start"] - 50, F.lit(0))
    words = F.regexp_extract_all(F.substring(text, start + 1, m["start"] - start), F.lit(f"(?U){WORDS}"), F.lit(1))
    last = F.element_at(words, -1)
    near = F.when(F.size(words) == 0, told).when((F.length(last) > 2) | (F.size(words) == 1), last).otherwise(F.array_join(F.slice(words, -2, 2), " "))
    name = F.when(F.length(told) < 3, near).otherwise(told)
    numbered = m["value"].contains("N°") | name.contains("N.") | m["value"].contains("Nº")
    return F.when(
        numbered,
        F.when(name.contains("D.N.I") | name.contains("DNI"), "Número de DNI").when(F.lower(name).rlike("celular|teléfono"), "Número de celular")
        .when(F.lower(name).contains("expediente"), "Número de expediente").otherwise("Número"),
    ).otherwise(name)


FIELD = "array<struct<label:string,base:string,start:int,stop:int,match:string,style:string,shown:boolean>>"


def _fold(text: Column, blank: str, guarded: bool) -> Column:
    finds = tuple(Find(p, 0, key=1) for _, p in BRACKETS) + (Find(blank, 0, key=1, inside=_RUN), COLON)
    found = matches(finds)(text)
    style = lambda m: F.element_at(F.array(*(F.lit(s) for s in STYLES)), m["rule"] + 1)

    def one(label: Column, base: Column, start: Column, stop: Column, match: Column, m: Column, shown: Column) -> Column:
        field = F.struct(label.alias("label"), base.alias("base"), start.alias("start"), stop.alias("stop"), match.alias("match"), style(m).alias("style"), shown.alias("shown"))
        return F.array(field).cast(FIELD)

    def step(acc: Column, m: Column) -> Column:
        colon = m["rule"] == len(BRACKETS) + 1
        start = m["start"] + F.when(colon, F.length(m["value"]) - F.length(F.regexp_replace(m["value"], r"(?U)^\s+", ""))).otherwise(0)
        inside = F.exists(acc, lambda k: ((k["start"] <= start) & (start < k["stop"])) | ((k["start"] < m["stop"]) & (m["stop"] <= k["stop"])))
        used = lambda base: F.size(F.filter(acc, lambda k: k["base"] == F.lower(base)))
        bracket = F.replace(_strip(F.coalesce(m["key"], F.lit(""))), F.lit("_"), F.lit(" "))
        base = F.substring(_label(text, m), 1, 100)
        name = _strip(m["value"])
        nth = used(base) + 1
        blank_field = one(F.when(nth > 1, F.concat(base, F.lit(" "), nth)).otherwise(base), F.lower(base), start, m["stop"], m["value"], m, F.length(base) >= 2)
        colon_field = one(name, F.lower(name), start, m["stop"], name, m, F.lit(True))
        bracket_field = one(bracket, F.lit(None).cast("string"), start, m["stop"], m["value"], m, F.length(bracket) > 1)
        kept = (
            F.when(m["rule"] < len(BRACKETS), bracket_field)
            .when(m["rule"] == len(BRACKETS), blank_field if guarded else F.when(F.length(base) >= 2, blank_field).otherwise(F.array().cast(FIELD)))
            .when((F.length(name) > 2) & (used(name) == 0), colon_field)
            .otherwise(F.array().cast(FIELD))
        )
        clash = inside if guarded else F.lit(False)
        return F.when(clash, acc).otherwise(F.concat(acc, kept))

    every = F.aggregate(found, F.array().cast(FIELD), step)
    return F.filter(every, lambda f: f["shown"])


def named(text: Column) -> Column:
    """The fields' names: bracket styles one after another, then blanks (repeated names numbered), then lines with a colon."""
    return F.transform(_fold(text, BLANK_LOOSE, False), lambda f: _strip(f["label"]))


def placed(text: Column) -> Column:
    """array<struct<start, stop, key, label, context, match, style>> by place: a place taken by an earlier pattern is not
    found again; context is the match with 30 characters on either side."""

    def field(f: Column) -> Column:
        at = F.greatest(f["start"] - 30, F.lit(0))
        around = F.substring(text, at + 1, f["stop"] + 30 - at)
        return F.struct(
            f["start"].alias("start"), f["stop"].alias("stop"), field_key(f["label"]).alias("key"), f["label"].alias("label"), around.alias("context"),
            f["match"].alias("match"), f["style"].alias("style"),
        )

    return F.array_sort(F.transform(_fold(text, BLANK, True), field))
