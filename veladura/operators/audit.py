"""The audit: a second, independent set of detectors for what anonymization left, its repair, the gate and the scores.

All of it works on one document at a time: leaks are an array, repair is a fold over it, so that nothing is shuffled
and no text is read twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.functions import fixed as X
from veladura.functions.spans import Blocked, Find, after, around, before, blocked, digits, has_any, let, matches, plain, settled, spaced, spans, strip

from . import filters, tokens
from .merge import merged

LEAK = "array<struct<type:string,value:string,start:int,stop:int,seq:int>>"


def _free(text: Column | Blocked, span: Column, n: int = 20) -> Column:
    """No token within n characters."""
    return ~around(text, span, n).rlike(X.TOKEN)


def _money(text: Column | Blocked, span: Column, n: int = 40) -> Column:
    low = [w.lower() for w in X.MONEY]
    return has_any(F.lower(before(text, span, n)), low) | has_any(F.lower(after(text, span, n)), low)


def _is_date(value: Column) -> Column:
    part = lambda a, n: F.substring(value, a, n).try_cast("int")
    return F.coalesce(part(1, 4).between(1900, 2100) & part(5, 2).between(1, 12) & part(7, 2).between(1, 31), F.lit(False))


def _dni(text: Column | Blocked, m: Column) -> Column:
    told = has_any(F.lower(before(text, m, 50)), X.DNI_CONTEXT)
    legal = has_any(F.lower(before(text, m, 30)), X.LEGAL_NUMBERS)
    return _free(text, m) & ~_is_date(m["value"]) & (told | ~(_money(text, m) | legal))


def _plate(text: Column | Blocked, m: Column) -> Column:
    near = has_any(F.lower(before(text, m, 50)), X.AUDIT_VEHICLE) | has_any(F.lower(after(text, m, 50)), X.AUDIT_VEHICLE)
    return _free(text, m) & near & (F.length(F.regexp_replace(m["value"], "[- ]", "")) >= 5)


def _clear(n: int = 20) -> Callable[[Column | Blocked, Column], Column]:
    return lambda text, m: _free(text, m, n) & ~F.contains(m["value"], F.lit("{{"))


@dataclass(frozen=True)
class Finder:
    finds: tuple[Find, ...]
    test: Callable[[Column | Blocked, Column], Column]
    #: each `value` or each `span` once, or `every`
    once: str = "value"


def _plain(*patterns: str, anchors: tuple[tuple[str, ...], ...] = (), hints: tuple[str, ...] = (), value: int = 0, ignore_case: bool = True, **more) -> tuple[Find, ...]:
    words = anchors or ((),) * len(patterns)
    return tuple(Find(p, value, (value, value), ignore_case=ignore_case, anchors=a, hints=hints, **more) for p, a in zip(patterns, words, strict=True))


COURT_WORDS = ("juzgado", "tribunal", "sala", "corte", "fiscal")
CASES = ((digits(5),), ("exp", "proceso"))
STREETS = (("calle", "av", "jr", "jir", "psje", "pasaje", "alameda", "malec"), ("mz", "manzana"))
PHONES = (
    ("+51",), (digits(3, 6, 9, first="9"),), (digits(9, first="9"),), ("(",), (digits(1, 2, 4, 5, 8, 9, first="01"),), (digits(2, 3, 8, 9, 10, first="0"),),
)
ADDRESS_RUN = r"A-Za-z0-9._%+\-"
FINDERS: dict[str, Finder] = {
    "DNI": Finder(_plain(r"\b(\d{8})\b", value=1, ignore_case=False, anchors=((digits(8),),)), _dni, "every"),
    "EMAIL": Finder(_plain(X.AUDIT_EMAIL, value=1, anchors=(("@",),), run=ADDRESS_RUN), lambda t, m: ~m["value"].rlike(X.TOKEN) & ~F.lower(m["value"]).rlike(r"example\.com|test\.com"), "every"),
    "TELEFONO": Finder(_plain(*X.AUDIT_PHONES, value=1, ignore_case=False, anchors=PHONES), lambda t, m: _free(t, m) & ~_money(t, m), "span"),
    "COLEGIATURA": Finder(_plain(X.AUDIT_LICENSED, anchors=(("cal", "ca.", "c.a", "cmp", "cip", "cap", "cpa", "colegi", "n°", "nº", "nd", "nc", *spaced("n")),)), lambda t, m: _free(t, m), "every"),
    "RUC": Finder(_plain(X.AUDIT_RUC, value=1, ignore_case=False, anchors=((digits(11, first="12"),),)), lambda t, m: _free(t, m) & F.contains(F.lower(before(t, m, 30)), F.lit("ruc")), "every"),
    "DIRECCION": Finder(_plain(*X.AUDIT_ADDRESSES, anchors=STREETS), _clear(10)),
    "ACTA_REGISTRO": Finder(_plain(X.AUDIT_RECORD, anchors=(("acta", "n°", "nº", "registro", "constancia", "documento", "expediente"),)), _clear()),
    "PLACA": Finder(_plain(X.AUDIT_PLATE, value=1, anchors=((digits(*range(1, 7)),),), leads=(1, 2, 3, 4)), _plate, "every"),
    "EXPEDIENTE": Finder(_plain(*X.AUDIT_CASES, anchors=CASES), _clear()),
    "RESOLUCION": Finder(_plain(X.AUDIT_RULING, anchors=(("resoluci", "auto", "oficio", "informe"),)), _clear()),
    "PARTIDA": Finder(_plain(X.AUDIT_REGISTRY, anchors=(("partida", "sunarp", "asiento", "tomo", "ficha", "folio"),)), _clear()),
    "CASILLA": Finder(_plain(*X.AUDIT_MAILBOXES, anchors=(("casilla",), ("mesa",))), _clear()),
    "JUZGADO": Finder(_plain(X.AUDIT_COURT, anchors=(COURT_WORDS,), run=r"\d°ºo\s"), lambda t, m: _clear()(t, m) & (F.length(m["value"]) >= 10)),
}


def court_kind(value: Column) -> Column:
    low = F.lower(value)
    return F.when(F.contains(low, F.lit("tribunal")), "TRIBUNAL").when(F.contains(low, F.lit("sala")), "SALA").when(F.contains(low, F.lit("fiscal")), "FISCALIA").otherwise("JUZGADO")


def _firsts(rows: Column, key: Callable[[Column, Column], Column]) -> Column:
    """(i, e) of the first element of each key, in the array's order: sorted by key and place, each held against its neighbour."""
    keyed = F.sort_array(F.transform(rows, lambda e, i: F.struct(key(e, i).alias("k"), i.alias("i"), e.alias("e"))))
    firsts = let(keyed, lambda every: F.filter(every, lambda x, j: (j == 0) | (F.get(every, j - 1)["k"] != x["k"])))
    return F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["e"].alias("e"))))


def leaks(text: Column, *kinds: str) -> Column:
    """All leaks, finder after finder; each finder gives a value or a span once where it says so."""
    asked = [(k, f) for k, f in FINDERS.items() if not kinds or k in kinds]
    number = [i for i, (_, f) in enumerate(asked) for _ in f.finds]
    found = matches(tuple(x for _, f in asked for x in f.finds))(text)
    of = lambda m, what: F.element_at(filters.listed(tuple(str(what(i)) for i in number)), m["rule"] + 1)

    def fits(m: Column, text: Blocked) -> Column:
        out = None
        for i, (_, f) in enumerate(asked):
            here = m["rule"].isin(*(r for r, n in enumerate(number) if n == i))
            out = F.when(here, f.test(text, m)) if out is None else out.when(here, f.test(text, m))
        return out

    def leak(m: Column) -> Column:
        kind = of(m, lambda i: asked[i][0])
        named = F.when(kind == "JUZGADO", court_kind(m["value"])).otherwise(kind)
        return F.struct(named.alias("type"), m["value"].alias("value"), m["start"].alias("start"), m["stop"].alias("stop"), of(m, lambda i: i).alias("finder"), of(m, lambda i: asked[i][1].once).alias("once"))

    trimmed = F.transform(found, lambda m: m.withField("value", F.when(of(m, lambda i: asked[i][0]) == "JUZGADO", strip(m["value"])).otherwise(m["value"])))
    rows = F.transform(blocked(text, trimmed, lambda every, t: F.filter(every, lambda m: fits(m, t))), leak)
    key = lambda a, i: F.when(a["once"] == "every", i.cast("string")).when(a["once"] == "value", a["value"]).otherwise(F.concat_ws(":", a["start"], a["stop"]))
    once = F.transform(_firsts(rows, lambda a, i: F.concat_ws("\x00", a["finder"], key(a, i))), lambda x: x["e"])
    out = lambda a, i: F.struct(a["type"].alias("type"), a["value"].alias("value"), a["start"].alias("start"), a["stop"].alias("stop"), i.alias("seq"))
    return F.transform(once, out).cast(LEAK)


def find(text: Column, kind: str) -> Column:
    """The spans of one finder."""
    return plain(leaks(text, kind))


FIX = "array<struct<start:int,stop:int,value:string,type:string,number:int,token:string>>"


def _fixes(text: Column, found: Column, first: int) -> Column:
    """A token for each of a document's disjoint leaks, counted from the end of the text: one for each value (of the type
    that has it first), within its type on from the numbers that the text already holds, else from `first`.

    The values' first places are sorted by type; a value's number is its place less that at which its type begins."""
    used = lambda kind: F.array_max(F.transform(F.regexp_extract_all(text, F.concat(F.lit(r"\{\{"), kind, F.lit(r"_(\d{1,9})\}\}")), F.lit(1)), lambda x: x.cast("int")))

    def numbered(firsts: Column) -> Column:
        by_type = F.sort_array(F.transform(firsts, lambda x: F.struct(x["e"]["type"].alias("type"), x["i"].alias("i"), x["e"]["value"].alias("value"))))

        def told(every: Column) -> Column:
            begins = F.filter(F.transform(every, lambda x, j: F.when((j == 0) | (F.get(every, j - 1)["type"] != x["type"]), F.struct(x["type"].alias("type"), j.alias("at")))), lambda b: b.isNotNull())
            based = F.transform(begins, lambda b: F.struct(b["type"].alias("type"), (F.coalesce(used(b["type"]), F.lit(first - 1)) + 1 - b["at"]).alias("base")))
            one = lambda x, j, own: F.struct(x["type"].alias("type"), (F.get(F.filter(own, lambda b: b["type"] == x["type"]), F.lit(0))["base"] + j).alias("number"))
            return let(based, lambda own: F.map_from_entries(F.transform(every, lambda x, j: F.struct(x["value"].alias("key"), one(x, j, own).alias("value")))))

        return let(by_type, told)

    def fix(e: Column, known: Column) -> Column:
        token = F.concat(F.lit("{{"), known["type"], F.lit("_"), known["number"], F.lit("}}"))
        return F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["value"].alias("value"), known["type"].alias("type"), known["number"].alias("number"), token.alias("token"))

    def every(back: Column) -> Column:
        return let(numbered(_firsts(back, lambda e, _: e["value"])), lambda known: F.transform(back, lambda e: let(known[e["value"]], lambda k: fix(e, k))))

    return let(F.reverse(found), every).cast(FIX)


def fixed(docs: DataFrame, first: int = 100, pairs_too: bool = False) -> DataFrame:
    """docs (doc_id, text, others kept) with fixed_text, leaks_found, fixes, remaining and is_safe; with `pairs_too` also
    __pairs, the values replaced with their tokens.

    Overlapping leaks are merged first, so that no repair splices into another. Each scan is a stage of its own over
    columns already computed: leaks, then tokens, then the fixed text, then what is left in it."""
    rows = settled(docs, __leaks=leaks(F.col("text")))
    rows = settled(rows, __fixes=_fixes(F.col("text"), merged(F.col("__leaks"), LEAK), first))
    rows = settled(rows, fixed_text=F.when(F.size("__fixes") == 0, F.col("text")).otherwise(tokens.replaced_at(F.col("text"), F.col("__fixes"))))
    rows = settled(rows, remaining=F.size(leaks(F.col("fixed_text"))))
    pairs = F.transform("__fixes", lambda x: F.struct(x["value"].alias("value"), x["token"].alias("token")))
    rows = rows.withColumns({"leaks_found": F.size("__leaks"), "fixes": F.size("__fixes"), "is_safe": F.col("remaining") == 0, "__pairs": pairs})
    return (rows if pairs_too else rows.drop("__pairs")).drop("__leaks", "__fixes")


def warnings(row: str = "") -> Column:
    """What an audit has to say, from the columns of `fixed`."""
    c = lambda n: F.col(f"{row}{n}")
    unsafe = F.concat(F.lit("CRITICAL: "), c("remaining"), F.lit(" leaks could not be auto-fixed"))
    fixes = F.concat(F.lit("Applied "), c("fixes"), F.lit(" emergency auto-fixes"))
    every = F.array(F.when(c("remaining") > 0, unsafe), F.when(c("remaining") > 0, F.lit("DOCUMENT MARKED AS NOT SAFE - manual review required")), F.when(c("fixes") > 0, fixes))
    return F.filter(every, lambda w: w.isNotNull())


def repaired(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """docs (doc_id, text) after up to `rounds` rounds of audit and repair, each on what the one before left: text,
    leaks_found and is_safe of the last round. A text that is safe stays as it is, so that a round more changes nothing."""
    rows = docs.select("*", F.lit(0).alias("__found"), F.lit(False).alias("__safe"))
    for i in range(rounds):
        done = fixed(docs if i == 0 else rows)
        found = F.col("leaks_found") if i == 0 else F.col("__found")
        kept = [F.col("fixed_text" if c == "text" else c).alias(c) for c in docs.columns]
        rows = done.select(*kept, found.alias("__found"), F.col("is_safe").alias("__safe"))
    return rows.withColumnRenamed("__found", "leaks_found").withColumnRenamed("__safe", "is_safe")


def repairs(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """docs (doc_id, text) to doc_id, repairs (value, token of all rounds, each pair once) and is_safe after the last round."""
    rows = docs.select("doc_id", "text", F.array().cast("array<struct<value:string,token:string>>").alias("repairs"))
    for _ in range(rounds):
        done = fixed(rows, pairs_too=True)
        rows = done.select("doc_id", F.col("fixed_text").alias("text"), F.array_distinct(F.concat("repairs", "__pairs")).alias("repairs"), "is_safe")
    return rows.drop("text")


def gated(docs: DataFrame, rounds: int = 2, strict: bool = True, force: bool = False) -> DataFrame:
    """The gate before a document leaves: rounds of repair, then (strict and not forced) hard redaction of what is not yet
    safe and one more look. Columns: text, is_safe, hard (whether it was redacted hard), remaining, verdict (`safe`,
    `forced`, `blocked`)."""
    rows = repaired(docs, rounds).drop("leaks_found", "is_safe")
    rows = settled(rows, __left=F.size(leaks(F.col("text"))))
    hard = (F.col("__left") > 0) & F.lit(strict and not force)
    rows = settled(rows, __text=F.when(hard, tokens.hard_redacted(F.col("text"))).otherwise(F.col("text")))
    rows = rows.withColumn("hard", F.col("__text") != F.col("text")).drop("text").withColumnRenamed("__text", "text")
    rows = settled(rows, __again=F.size(leaks(F.col("text"))))
    rows = rows.withColumn("remaining", F.when(F.col("hard"), F.col("__again")).otherwise(F.col("__left"))).drop("__left", "__again")
    verdict = F.when(F.col("remaining") == 0, "safe").when(F.lit(force), "forced").otherwise("blocked")
    return rows.withColumns({"is_safe": F.col("remaining") == 0, "verdict": verdict})


# --- the evaluator --------------------------------------------------------------------------------------------

EVAL_EMAIL = Find(X.OLD_EMAIL, 0, ignore_case=True, anchors=("@",), run=ADDRESS_RUN)
EVAL_DNI = Find(X.OLD_DNI, 0, anchors=(digits(8),))
EVAL_PHONE = Find(r"(?:\+51\s*)?9[0-9]{8}\b", 0)
EVAL = (("DNI", "high"), ("EMAIL", "high"), ("TELEFONO", "medium"))


def potential_leaks(text: Column) -> Column:
    """array<struct<type, severity, value, position>> of what an anonymized text may still hold: identity numbers far from
    tokens and money, addresses, phones."""
    found = matches((EVAL_DNI, EVAL_EMAIL, EVAL_PHONE))(text)
    near = lambda m: around(text, m, 30)
    fits = lambda m: F.when(m["rule"] == 0, ~near(m).rlike(X.TOKEN) & ~near(m).rlike(f"(?iu){X.EVAL_MONEY}")).otherwise(~m["value"].rlike(X.TOKEN))
    name = lambda m, i: F.element_at(F.array(*(F.lit(e[i]) for e in EVAL)), m["rule"] + 1)
    return F.transform(F.filter(found, fits), lambda m: F.struct(name(m, 0).alias("type"), name(m, 1).alias("severity"), m["value"].alias("value"), m["start"].alias("position")))


def identifiers(text: Column) -> Column:
    """How many identity numbers, addresses and phones the evaluator counts in an original text."""
    return F.size(spans(text, EVAL_DNI, EVAL_EMAIL, EVAL_PHONE))


def over_anonymized(value: Column) -> Column:
    """struct<reason, severity> of a person's value that should have stayed, or null."""
    why = lambda r, s: F.struct(F.lit(r).alias("reason"), F.lit(s).alias("severity"))
    return (
        F.when(filters.whitelisted(value), why("whitelist_violation", "high"))
        .when(filters.is_title(value), why("legal_title_tokenized", "high"))
        .when(filters.has_verb(value), why("contains_legal_verb", "medium"))
        .when(F.size(filters.words(value)) > 5, why("too_many_words", "low"))
    )


def scores(found: Column, leaked: Column, replaced: Column, over: Column) -> list[Column]:
    """recall, precision and their weighted score."""
    recall = F.when(found > 0, F.greatest(F.lit(0.0), (found - leaked) / found)).otherwise(1.0)
    precision = F.when(replaced > 0, F.greatest(F.lit(0.0), 1 - over / replaced)).otherwise(1.0)
    return [F.round(c, 4).alias(n) for n, c in (("privacy_recall", recall), ("precision", precision), ("final_score", 0.7 * recall + 0.3 * precision))]


def evaluated(rows: DataFrame) -> DataFrame:
    """rows (doc_id, original, anonymized, applied array<struct<type, value>>) with one report a document: counts, scores
    rounded to four places, the first ten leaks and cases of too much, warnings."""
    persons = F.transform(F.filter("applied", lambda e: e["type"] == "PERSONA"), lambda e: F.struct(e["value"].alias("value"), over_anonymized(e["value"]).alias("why")))
    rows = settled(rows, __leaks=potential_leaks(F.col("anonymized")), __found=identifiers(F.col("original")), __over=F.filter(persons, lambda p: p["why"].isNotNull()))
    rows = rows.select("*", *scores(F.col("__found"), F.size("__leaks"), F.size("applied"), F.size("__over")))
    told = F.filter(
        F.array(
            F.when(F.col("privacy_recall") < 0.95, F.lit("low_recall")), F.when(F.col("precision") < 0.90, F.lit("low_precision")),
            F.when(F.size("__leaks") > 0, F.concat(F.size("__leaks"), F.lit(" potential leaks"))),
        ),
        lambda w: w.isNotNull(),
    )
    return rows.select(
        "doc_id", F.col("__found").alias("detected"), F.size("applied").alias("replaced"), F.size("__leaks").alias("leak_count"), F.size("__over").alias("over_count"),
        "privacy_recall", "precision", "final_score", F.slice("__leaks", 1, 10).alias("potential_leaks"), F.slice("__over", 1, 10).alias("potential_over"), told.alias("warnings"),
    )
