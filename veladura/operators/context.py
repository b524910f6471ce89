"""The older detector: patterns with guards that look at what was found before, scored names, claims by priority.

Everything is an array of struct<type, value, start, stop, confidence, seq> over one document, made of Spark's
expressions over the matches of one pass; guards and claims are folds in the order in which the patterns speak.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veladura.functions import fixed as X
from veladura.functions import lexicon as L
from veladura.functions.spans import CAPITALS, TITLE, UPPER, Find, after, before, digits, has_any, is_any, keep, let, matches, spaced, spans, strip

from . import filters, merge

OLD = "array<struct<type:string,value:string,start:int,stop:int,confidence:double,seq:int>>"
RANKED = "array<struct<type:string,value:string,start:int,stop:int,confidence:double,seq:int,rank:int>>"
TOKEN = Find(r"\{\{[^}]+\}\}", 0, anchors=("{{",))


def tokens_in(text: Column) -> Column:
    """Placeholders that the text already holds."""
    return spans(text, TOKEN)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def outside(found: Column, taken: Column) -> Column:
    """Spans that overlap none of the taken ones."""
    free = lambda both: keep(both["found"], lambda s: ~F.exists(both["taken"], lambda t: overlaps(s, t)))
    return let(F.struct(found.alias("found"), taken.alias("taken")), free)


def sanitized(text: Column) -> Column:
    return F.translate(text, "\u0000\u000b\u000c", "   ")


def no_name(value: Column) -> Column:
    return F.forall(filters.words(F.upper(value)), lambda w: is_any(w, L.OLD_NO_NAMES))


def money_before(text: Column, span: Column) -> Column:
    return has_any(F.lower(before(text, span, 20)), X.OLD_MONEY)


def date_after(text: Column, span: Column) -> Column:
    """Two digits after a slash or a dash."""
    return F.lower(strip(after(text, span, 15))).rlike(r"(?U)^[/\-]\d(?:\d|$)")


@dataclass(frozen=True)
class Old:
    type: str
    finds: tuple[Find, ...]
    confidence: float
    #: `any`: always; `start`: nothing begins at the same place; `cross`: no end of it lies in what is there; `clear`: no overlap
    guard: str = "any"
    least: int = 0
    most: int = 1 << 30
    test: str = ""


#: What a pattern asks of the search, beside the pattern.
SEARCH = ("hints", "leads", "run", "first")


def _old(kind: str, patterns: tuple[str, ...], confidence: float, guard: str = "any", ignore_case: bool = True, value: int = 0, place: tuple[int, int] = (0, 0), anchors: tuple[tuple[str, ...], ...] = (), **more) -> Old:
    own = {k: more.pop(k) for k in SEARCH if k in more}
    finds = tuple(Find(p, value, place, ignore_case=ignore_case, anchors=a, **own) for p, a in zip(patterns, anchors, strict=True))
    return Old(kind, finds, confidence, guard, **more)


STREETS = ("av", "jr", "calle", "psje", "mz", "lt", "dpto", "urb", "aahh", "aa.hh", "pj", "p.j", "distrito", "provincia")
MORE_STREETS = ("jiron", "pasaje", "manzana", "lote", "departamento", "n", "bloque", "piso", "int")
NAMED_BY = ("señor", "sr.", "sra.", "don", "doña", *spaced("el", "la"), "identificad", "abogad", "letrad", "madre", "padre", "hij", "cónyuge", "espos", "testigo", "perito")
ADDRESS_RUN, FIRM_RUN = r"A-Za-z0-9._%+\-", UPPER + r"a-záéíóúñ\s&"


#: Patterns in the order in which they speak.
REGEX = (
    _old("EXPEDIENTE", (X.OLD_CASE,), 0.95, anchors=((digits(5),),)),
    _old("CASILLA", (X.OLD_MAILBOX,), 0.95, anchors=(("casilla",),)),
    _old("JUZGADO", (X.OLD_COURT,), 0.90, anchors=(("juzgado", digits()),), hints=("juzgado",)),
    _old("RUC", (X.OLD_RUC,), 0.90, ignore_case=False, test="money", anchors=((digits(11, first="12"),),)),
    _old("DNI", (X.OLD_DNI,), 0.85, ignore_case=False, test="money and date", anchors=((digits(8),),)),
    _old("EMAIL", (X.OLD_EMAIL,), 0.95, ignore_case=False, anchors=(("@",),), run=ADDRESS_RUN),
    _old("TELEFONO", X.OLD_PHONES, 0.85, "start", ignore_case=False, anchors=(("+51",), (digits(9, first="9"),), (digits(3, 9, 10, first="0"),), ("(",))),
    _old("DIRECCION", (X.OLD_ADDRESS,), 0.75, least=11, anchors=(STREETS,)),
    _old("PERSONA", (X.OLD_NAME,), 0.80, value=1, place=(1, 1), least=6, test="name", anchors=(NAMED_BY,)),
    _old("PERSONA", (X.OLD_CAPITALS,), 0.60, "cross", ignore_case=False, value=1, test="two to five", anchors=((CAPITALS,),)),
    _old("ACTA", (X.OLD_RECORD,), 0.90, anchors=(("acta",),)),
    _old("ENTIDAD", X.OLD_ENTITIES[:1], 0.85, "start", least=6, anchors=(("banco", "caja", "financiera", "cooperativa"),)),
    _old("ENTIDAD", X.OLD_ENTITIES[1:2], 0.85, "start", least=6, anchors=(("s.a", "s.r.l", "e.i.r.l"),), run=FIRM_RUN),
    _old("ENTIDAD", X.OLD_ENTITIES[2:], 0.85, "start", least=6, anchors=(("notar",),)),
    _old("CUENTA", X.OLD_ACCOUNTS, 0.90, "start", anchors=(("cuenta", "cta"), ("cci",), (digits(3, 6, *range(16, 21)),))),
    _old("PLACA", (X.OLD_PLATE,), 0.90, anchors=(("placa", digits(3)),), leads=(3, 4)),
    _old("FIRMA", X.OLD_SIGNATURES, 0.70, "start", anchors=(("firma", "suscrit"), ("_____",), ("/s/",), ("firmado",))),
    _old("SELLO", X.OLD_SEALS, 0.70, "start", anchors=(("sell",), ("[sello",))),
    _old("HUELLA", X.OLD_PRINTS, 0.70, "start", anchors=(("huella",), ("[huella",))),
)
ADDRESSES = (
    _old("DIRECCION", X.OLD_HOMES, 0.90, "start", value=1, least=11, most=299, anchors=(("domicilio",), ("con", "domicilio"), ("reside",), ("ubicad",), ("dirección",))),
    _old("DIRECCION", (X.OLD_MORE_ADDRESS,), 0.80, "clear", least=9, anchors=((*STREETS, *MORE_STREETS),)),
)
MORE_PHONES = (("+51",), ("+51",), (digits(3, 6, 9, first="9"),), (digits(9, first="9"),), ("(",), (digits(2, 5, 9, first="0"),), ("(",))
PHONES = (
    _old("TELEFONO", X.OLD_MORE_PHONES, 0.90, "start", ignore_case=False, test="seven", anchors=MORE_PHONES),
    _old("TELEFONO", (X.OLD_PHONE_TOLD,), 0.90, "start", value=1, test="seven", anchors=(("telefono", "teléfono", "cel", "móvil", "movil", "fono"),)),
)


def by_rules(text: Column, rules: tuple[Old, ...]) -> Column:
    """What some patterns find outside placeholders, each guarded by what was found before it."""
    number = [r for r in range(len(rules)) for _ in rules[r].finds]
    found = matches(tuple(f for r in rules for f in r.finds))(text)
    of = lambda m, what: F.element_at(filters.listed(tuple(str(what(rules[r])) for r in number)), m["rule"] + 1)

    def fits(m: Column) -> Column:
        v, kind = m["value"], of(m, lambda r: r.test)
        n = F.size(filters.words(v))
        test = (
            F.when(kind == "money", ~money_before(text, m))
            .when(kind == "money and date", ~money_before(text, m) & ~date_after(text, m))
            .when(kind == "name", F.contains(v, F.lit(" ")) & ~no_name(v))
            .when(kind == "two to five", n.between(2, 5) & ~no_name(v))
            .when(kind == "seven", F.length(F.regexp_replace(v, r"(?U)[\s\-()]", "")) >= 7)
            .otherwise(True)
        )
        long = F.length(v).between(of(m, lambda r: r.least).cast("int"), of(m, lambda r: r.most).cast("int"))
        return long & test

    def step(acc: Column, m: Column) -> Column:
        guard = of(m, lambda r: r.guard)
        ends = lambda e: ((e["start"] <= m["start"]) & (m["start"] < e["stop"])) | ((e["start"] < m["stop"]) & (m["stop"] <= e["stop"]))
        clash = (
            F.when(guard == "start", F.exists(acc, lambda e: e["start"] == m["start"]))
            .when(guard == "cross", F.exists(acc, ends))
            .when(guard == "clear", F.exists(acc, lambda e: overlaps(e, m)))
            .otherwise(False)
        )
        one = F.struct(
            of(m, lambda r: r.type).alias("type"), m["value"].alias("value"), m["start"].alias("start"), m["stop"].alias("stop"),
            of(m, lambda r: r.confidence).cast("double").alias("confidence"), F.size(acc).alias("seq"),
        )
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(one).cast(OLD)))

    trimmed = F.transform(found, lambda m: m.withField("value", strip(m["value"])))
    return F.aggregate(keep(outside(trimmed, tokens_in(text)), fits), F.array().cast(OLD), step)


def scored_persons(text: Column, first_names: tuple[str, ...] = L.FIRST_NAMES, last_names: tuple[str, ...] = L.LAST_NAMES) -> Column:
    """array<struct<span, score>> of names in capitals (from .40) and in title case (from .35), raised by a trigger in the
    80 characters before or 30 after, a first name, a last name and, for capitals, two to four words; .50 is the least,
    .95 the most."""

    def of(pattern: str, anchor: str, base: float, trigger: float, name: float, short: float, title: bool) -> Column:
        near = lambda s: has_any(F.lower(F.concat(before(text, s, 80), s["value"], after(text, s, 30))), L.OLD_TRIGGERS)
        small = lambda w: F.lower(w).isin("de", "la", "del", "los", "las")
        parts = lambda s: F.filter(filters.words(s["value"]), lambda w: ~small(w)) if title else filters.words(F.initcap(s["value"]))
        has = lambda s, names: F.exists(parts(s), lambda w: is_any(w, names))
        add = lambda test, x: F.when(test, x).otherwise(0.0)
        score = lambda s: F.round(
            F.lit(base) + add(near(s), trigger) + add(has(s, first_names), name) + add(has(s, last_names), name) + add(F.size(parts(s)).between(2, 4), short), 2
        )
        fits = keep(outside(spans(text, Find(pattern, anchors=(anchor,))), tokens_in(text)), lambda s: F.size(parts(s)).between(2, 5) & ~no_name(s["value"]))
        return F.transform(fits, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), F.least(score(s), F.lit(0.95)).alias("score")))

    upper = of(X.OLD_CAPITALS, CAPITALS, 0.40, 0.15, 0.10, 0.10, False)
    title = of(X.OLD_TITLE_CASE, TITLE, 0.35, 0.20, 0.15, 0.0, True)
    return F.filter(F.concat(upper, title), lambda s: s["score"] >= 0.5)


def _persons(text: Column) -> Column:
    return F.transform(
        scored_persons(text),
        lambda s, i: F.struct(F.lit("PERSONA").alias("type"), s["value"].alias("value"), s["start"].alias("start"), s["stop"].alias("stop"), s["score"].alias("confidence"), i.alias("seq")),
    ).cast(OLD)


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda e: e.withField("rank", F.lit(rank))).cast(RANKED)


def hybrid(text: Column, model: Column | None = None) -> Column:
    """Claims by priority: patterns, addresses, phones, what a model found (OLD, optional), names scored .65 or more; each
    stays unless it overlaps one that claimed its place before. By place, the longest first."""
    layers = [by_rules(text, REGEX), by_rules(text, ADDRESSES), by_rules(text, PHONES)]
    layers += [] if model is None else [model.cast(OLD)]
    layers.append(keep(_persons(text), lambda e: e["confidence"] >= 0.65))
    ranked = [_ranked(a, r) for r, a in enumerate(layers)]
    return merge.claims(F.concat(*ranked), RANKED)


def needs_review(entity: Column) -> Column:
    return (entity["type"] == "PERSONA") & (entity["confidence"] < 0.75)


def regex_only(text: Column) -> Column:
    """Patterns, addresses, phones and scored names side by side, nothing claimed; from .80 on they need no review."""
    return F.concat(by_rules(text, REGEX), by_rules(text, ADDRESSES), by_rules(text, PHONES), _persons(text))


def first_that_works(*attempts: tuple[str, Column]) -> Column:
    """struct<detector, entities> of the first attempt that gave an array: a plug-in that failed gives null."""
    out = None
    for name, found in attempts:
        one = F.struct(F.lit(name).alias("detector"), found.alias("entities"))
        out = F.when(found.isNotNull(), one) if out is None else out.when(found.isNotNull(), one)
    return out


def left_over(text: Column, model: Column | None = None) -> Column:
    """The last scan of the older detector: each value once, confirmed ones and names of .70 or more, no placeholders."""

    def distinct(found: Column) -> Column:
        sure = F.filter(found, lambda e: ~needs_review(e))
        maybe = F.filter(found, lambda e: needs_review(e) & (e["confidence"] >= 0.70))
        every = F.filter(F.concat(sure, maybe), lambda e: ~F.startswith(e["value"], F.lit("{{")))
        return F.filter(every, lambda e, i: ~F.exists(F.slice(every, 1, i), lambda k: k["value"] == e["value"]))

    return let(hybrid(text, model), distinct)


def missed(text: Column, model: Column, known: Column) -> Column:
    """Persons that a model finds in a text and that are not among the known entities, whatever their case."""

    def of(both: Column) -> Column:
        fresh = lambda e: ~F.exists(both["known"], lambda k: F.upper(k["value"]) == F.upper(e["value"]))
        return F.filter(both["found"], lambda e: (e["type"] == "PERSONA") & fresh(e) & ~F.startswith(e["value"], F.lit("{{")))

    return let(F.struct(outside(model, tokens_in(text)).alias("found"), known.alias("known")), of)
