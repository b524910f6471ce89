"""Filters against too much anonymization: predicates on a value and one decision list with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.functions import lexicon as L
from veladura.functions.spans import has_any, is_any, let, strip

LETTERS = "A-Za-záéíóúñÁÉÍÓÚÑ"


def listed(words: tuple[str, ...]) -> Column:
    """Fixed words as one constant array."""
    return F.split(F.lit("|".join(words)), r"\|")


def words(value: Column) -> Column:
    return F.filter(F.split(value, r"(?U)\s+"), lambda w: w != "")


def normal(value: Column) -> Column:
    return F.upper(F.array_join(words(value), " "))


def whitelisted(value: Column, exact: tuple[str, ...] = L.WHITELIST) -> Column:
    return is_any(normal(value), exact)


def white_pattern(value: Column) -> Column:
    return strip(value).rlike("(?Uiu)^(?:" + "|".join(L.WHITE_PATTERNS) + ")")


def has_verb(value: Column) -> Column:
    clean = F.transform(words(F.lower(value)), lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""))
    return F.exists(clean, lambda w: is_any(w, L.VERBS))


def is_connector(value: Column) -> Column:
    return is_any(F.lower(F.array_join(words(value), " ")), L.CONNECTORS)


def is_title(value: Column) -> Column:
    return normal(value).rlike("^(?:" + "|".join(L.TITLES) + ")(?: |$)")


def all_excluded(value: Column, excluded: tuple[str, ...] = L.EXCLUDED) -> Column:
    return F.forall(words(F.upper(value)), lambda w: is_any(w, excluded))


def has_month(value: Column) -> Column:
    return F.exists(F.transform(words(F.upper(value)), lambda w: F.regexp_replace(w, r"[.,;:]+$", "")), lambda w: is_any(w, L.CALENDAR))


def common_noun(word: Column) -> Column:
    w = F.upper(word)
    endings = "(?:" + "|".join(L.NOUN_ENDINGS) + ")$"
    return is_any(w, L.COMMON + L.EXCLUDED) | ((F.length(w) >= 7) & w.rlike(endings))


def proper_name(value: Column) -> Column:
    """Two to six words within 80 characters, none of the legal forms, two words of the shape of names at least."""
    parts = words(value)
    shaped = lambda w: w.rlike("^(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,}|[A-ZÁÉÍÓÚÑ]{3,})$")
    named = F.filter(parts, lambda w: ~is_any(F.upper(w), L.PARTICLES) & ~common_noun(w) & shaped(w))
    legal = has_month(value) | whitelisted(value) | white_pattern(value) | has_verb(value) | is_connector(value) | is_title(value) | all_excluded(value)
    return F.size(parts).between(2, 6) & (F.length(value) <= 80) & ~legal & (F.size(named) >= 2)


def possible_name(value: Column) -> Column:
    rest = F.filter(words(value), lambda w: ~common_noun(w))
    shaped = lambda w: w.rlike("^(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{3,}|[A-ZÁÉÍÓÚÑ]{3,})$")
    fits = let(rest, lambda r: (F.size(r) >= 2) & F.exists(r, shaped))
    return value.rlike(rf"(?U)^[{LETTERS}\s]+$") & F.size(words(value)).between(2, 5) & fits


def decide(value: Column, kind: Column, strong: Column) -> Column:
    """struct<keep, reason>: the first reason that applies."""
    text = F.coalesce(value, F.lit(""))
    n = F.size(words(text))
    is_person = kind.isin("PERSONA", "PER")
    low = F.lower(text)
    address = (has_any(low, L.VIA) & text.rlike(r"\d")) | has_any(low, L.PLOT)
    yes = lambda r: F.struct(F.lit(True).alias("keep"), F.lit(r).alias("reason"))
    no = lambda r: F.struct(F.lit(False).alias("keep"), F.lit(r).alias("reason"))
    strong_person = (
        F.when(n > 7, no("too_long_strong_ctx"))
        .when(~text.rlike(f"[{LETTERS}]"), no("no_alpha_strong_ctx"))
        .when(has_month(text) & (n <= 2), no("contains_month_or_date"))
        .otherwise(yes("context_persona"))
    )
    person = (
        F.when(text.rlike("[\n\r]"), no("contains_newline"))
        .when(whitelisted(text), no("whitelist_exact"))
        .when(white_pattern(text), no("whitelist_pattern"))
        .when(has_verb(text), no("contains_legal_verb"))
        .when(is_connector(text), no("legal_connector"))
        .when(is_title(text), no("legal_title"))
        .when(all_excluded(text), no("all_excluded_words"))
        .when(strong, strong_person)
        .when(n > 7, no("too_long_not_name"))
        .when(proper_name(text), yes("proper_name"))
        .when(has_month(text), no("contains_month_or_date"))
        .when(possible_name(text), yes("possible_name"))
        .otherwise(no("default_reject_persona"))
    )
    return (
        F.when(kind.isin(*L.STRUCTURED), yes("structured_pii"))
        .when(F.length(strip(text)) < 2, no("too_short"))
        .when(is_person, person)
        .when(kind == "DIRECCION", F.when(address, yes("address_structure")).otherwise(no("no_address_structure")))
        .when(kind.isin(*L.LEGAL_ENTITIES), yes("legal_entity"))
        .when(kind == "ENTIDAD", F.when(whitelisted(text), no("whitelist_exact")).when(all_excluded(text), no("all_excluded_words")).otherwise(yes("entity_needs_review")))
        .when(kind.isin("FIRMA", "SELLO", "HUELLA"), yes("signature_mark"))
        .when(kind == "PLACA", yes("vehicle_plate"))
        .otherwise(yes("default_accept"))
    )


def capped(confidence: Column, reason: Column) -> Column:
    cap = F.when(reason == "context_persona", 0.78).when(reason == "possible_name", 0.55).when(reason == "proper_name", 0.75)
    return F.least(confidence, F.coalesce(cap, confidence))


def legacy_confidence(confidence: Column, reason: Column) -> Column:
    return F.when(reason == "possible_name", F.least(confidence, F.lit(0.7))).when(reason == "proper_name", F.greatest(confidence, F.lit(0.9))).otherwise(confidence)


def is_strong(source: Column) -> Column:
    return source.isin("strong_context_persona", "context", "context_identificado")


def status(kind: Column, confidence: Column) -> Column:
    """confirmed, review, or null where an entity is dropped."""
    return F.when(kind.isin(*L.ALWAYS_REVIEW), "review").when(confidence >= 0.80, "confirmed").when(confidence >= 0.50, "review")


def filtered(entities: Column) -> Column:
    """Entities that pass, with their capped confidence."""
    judged = F.transform(entities, lambda e: F.struct(e.alias("e"), decide(e["value"], e["type"], is_strong(e["source"])).alias("d")))
    kept = F.filter(judged, lambda x: x["d"]["keep"])
    return F.transform(kept, lambda x: x["e"].withField("confidence", capped(x["e"]["confidence"], x["d"]["reason"])))


def rejected(rows: DataFrame) -> DataFrame:
    """rows (type, value, strong; others kept) that the filters turn down, with the reason; of the value the first 50 characters,
    as reports list them."""
    told = rows.withColumn("__d", decide(F.col("value"), F.col("type"), F.col("strong"))).where("NOT __d.keep")
    return told.withColumns({"value": F.substring("value", 1, 50), "reason": F.col("__d.reason")}).drop("__d")
