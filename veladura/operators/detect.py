"""Detectors as column expressions: text in, array of entities or of spans out.

A rule is a table row: patterns, what the span and the value are, and a test on what stands around a match. One
function finds the matches of all rules asked for, in the order in which the rules speak; tests, values and the
making of entities are one pass of Spark's expressions over its result.

An entity is struct<type, value, start, stop, source, confidence, seq>; seq is its place among all of a document's
entities, on which ties depend. Offsets are code points, stop is exclusive. Null and empty texts have no entities.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veladura.functions import fixed as X
from veladura.functions import lexicon as L
from veladura.functions.spans import CAPITALS, LINES, UPPER, Find, after, around, before, digits, has_any, is_any, let, matches, plain, spaced, strip

from . import filters

ENTITY = "array<struct<type:string,value:string,start:int,stop:int,source:string,confidence:double,seq:int>>"


@dataclass(frozen=True)
class Seen:
    """A match and what its test may look at: the text, all matches, and which numbers are the patterns of a rule."""

    text: Column
    m: Column
    every: Column
    numbers: dict[str, list[int]]

    def others(self, name: str, test: Callable[[Column], Column]) -> Column:
        return F.exists(self.every, lambda o: o["rule"].isin(*self.numbers[name]) & test(o))


@dataclass(frozen=True)
class Rule:
    type: str
    finds: tuple[Find, ...]
    source: str = "regex"
    confidence: float = 1.0
    least: int = 0
    test: Callable[[Seen], Column] | None = None
    value: Callable[[Column], Column] | None = None
    needs: tuple[str, ...] = ()
    #: what stands for source and confidence where they depend on the match
    weak: Callable[[Seen], Column] | None = None


# --- tests ----------------------------------------------------------------------------------------------------


def money_near(text: Column, span: Column, n: int = 30) -> Column:
    words = [w.lower() for w in X.MONEY]
    return has_any(F.lower(before(text, span, n)), words) | has_any(F.lower(after(text, span, n)), words)


def trigger_near(text: Column, span: Column, n: int = 100) -> Column:
    return has_any(F.lower(before(text, span, n)), X.PERSON_TRIGGERS)


def excluded(value: Column) -> Column:
    """Whether a value is no name: an excluded word or phrase, or of two words or more 60 in 100 excluded or one hard."""
    words = F.regexp_extract_all(F.upper(value), F.lit("([A-ZÁÉÍÓÚÑ]+)"), F.lit(1))
    hits = F.size(F.filter(words, lambda w: is_any(w, L.NO_NAMES)))
    many = (F.size(words) >= 2) & ((hits >= 0.6 * F.size(words)) | F.exists(words, lambda w: is_any(w, X.HARD)))
    return (strip(value) == "") | is_any(filters.normal(value), L.NO_NAMES) | many


def _alone(s: Seen) -> Column:
    return ~around(s.text, s.m, 3).rlike(r"\d{11}")


def _same(s: Seen) -> Callable[[Column], Column]:
    return lambda o: (o["start"] == s.m["start"]) & (o["stop"] == s.m["stop"])


def _told(s: Seen) -> Column:
    """Announced numbers: none twice, none that is part of a longer one."""
    first, second = s.numbers["dni_told"]
    again = F.exists(s.every, lambda o: (o["rule"] == first) & _same(s)(o))
    return _alone(s) & ((s.m["rule"] == first) | ~again)


def _untold(s: Seen) -> Column:
    named = F.contains(F.lower(before(s.text, s.m, 10)), F.lit("dni"))
    return ~s.others("dni_told", _same(s)) & (named | ~money_near(s.text, s.m)) & _alone(s)


def _phone(s: Seen) -> Column:
    """Nine characters or more, in no case number and near no word about cases."""
    long = F.length(F.regexp_replace(s.m["value"], r"(?U)\s+", "")) >= 9
    inside = s.others("expediente", lambda c: (c["start"] <= s.m["start"]) & (s.m["stop"] <= c["stop"] + 5))
    marks = F.upper(F.concat(before(s.text, s.m, 40), F.lit(" "), after(s.text, s.m, 20)))
    return long & ~inside & ~has_any(marks, X.CASE_MARKS)


def _vehicle(s: Seen) -> Column:
    return has_any(F.lower(around(s.text, s.m, 120)), X.VEHICLE)


def _named(s: Seen) -> Column:
    return ~excluded(s.m["value"])


def _court(s: Seen) -> Column:
    return F.lower(strip(s.m["key"])).isin(*X.COURTS)


def _no_court(s: Seen) -> Column:
    return ~_court(s)


def _known_association(s: Seen) -> Column:
    return F.upper(F.regexp_replace(s.m["key"], "[. ]", "")).isin(*X.ASSOCIATIONS)


def _three_words(s: Seen) -> Column:
    return F.size(F.split(strip(s.m["value"]), r"(?U)\s+")) >= 3


def _legal(s: Seen) -> Column:
    return F.exists(F.split(strip(s.m["value"]), r"(?U)\s+"), lambda w: is_any(w, X.LEGAL_CAPITALS))


def trimmed_address(raw: Column) -> Column:
    """An address up to where its sentence ends, with parts that go on with it."""
    parts = F.split(strip(F.regexp_replace(raw, r"(?U)\s+", " ")), X.ADDRESS_BREAK)
    goes_on = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.lower(strip(p)).rlike("^(?:" + "|".join(f"\\Q{t}\\E" for t in X.ADDRESS_GOES_ON) + ")"))
    stop = F.array_position(goes_on, F.lit(False)).cast("int")
    kept = F.slice(parts, 1, F.when(stop == 0, F.size(parts)).otherwise(stop))
    return strip(F.array_join(F.transform(F.filter(kept, lambda p: p != ""), lambda p: F.regexp_replace(strip(p), "[;, ]+$", "")), ", "))


# --- rules, in the order in which they speak ------------------------------------------------------------------


def _finds(*patterns: str, value: int = 1, place: tuple[int, int] = (0, 0), ignore_case: bool = True, anchors: tuple[tuple[str, ...], ...] = (), **more) -> tuple[Find, ...]:
    words = anchors or ((),) * len(patterns)
    return tuple(Find(p, value, place, ignore_case=ignore_case, anchors=a, **more) for p, a in zip(patterns, words, strict=True))


def _person(announced: str, confidence: float, least: int, anchors: tuple[str, ...], name: str = X.NAME_STRICT, hints: tuple[str, ...] = ()) -> Rule:
    found = _finds(f"(?i:{announced})({name})", place=(1, 1), ignore_case=False, anchors=(anchors,), hints=hints)
    return Rule("PERSONA", found, "strong_context_persona", confidence, least, _named)


INSTITUTION_WORDS = (
    "juzgado", "sala", "corte", "poder", "fiscal", "ministerio", "defensor", "sunarp", "registro", "reniec", "rnp", "municipalidad",
    "gobierno", "superintendencia", "sbs", "osiptel", "osinergmin", "sunat", "indecopi", "migraciones", "notar", "colegio", "centro",
    "conciliador", "pnp", "polic", "comisar",
)


def _institution(value: int, place: tuple[int, int], test: Callable[[Seen], Column]) -> Rule:
    found = tuple(Find(rf"\b({X.INSTITUTIONS}){gap}({X.FOLLOWING})\b", value, place, 1, True, anchors=INSTITUTION_WORDS) for gap in (r"\s+", r"\s*[:\-]\s*"))
    return Rule("ENTIDAD", found, "context_entidad_publica", 0.65, test=test)


def _association(value: int) -> Rule:
    return Rule("ENTIDAD", (Find(X.ASSOCIATION, value, (value, value), 1, anchors=(CAPITALS,)),), "context_colegio", 0.65, test=_known_association)


def _section(pattern: str) -> tuple[Find, ...]:
    """One pattern inside the data sections; the numbered headings of the fixed list hold others and give the same."""
    return tuple(Find(pattern, 1, (1, 1), inside=Find(h + X.SECTION, ignore_case=True, anchors=(h.lower(),))) for h in X.HEADINGS)


CASE_ANCHORS = (("exp-", "exp_"), ("exp",), (digits(5),), ("exp-", "exp_"), (digits(5, 6),), ("exp",))
PHONE_ANCHORS = (("+51",), ("+51",), (digits(3, 6, 9, first="9"),), (digits(9, first="9"),), ("(",), (digits(2, 5, 9, first="0"),), (digits(3, 9, 10, first="0"),), ("(",))
ORDINALS = ("primer", "segund", "tercer", "cuart", "quint", "sext", digits(1, 2))
JOB_WORDS = (
    "abogad", "procurador", "defensor", "especialista", "asistente", "juez", "fiscal", "notari", "médic", "psicólog", "trabajador", "asesor",
    "coordinador", "director", "gerente", "jefe", "responsable", "consultor", "perito",
)
ADDRESS_ANCHORS = ("av", "jr", "calle", "psje", "mz", "lt", "urb", "aahh", "aa.hh", "pj", "p.j", "piso", "n", "bloque", "int", "dpto")
#: What may stand between the beginning of a name and the word that tells that it is one.
NAME_RUN = UPPER + r"a-záéíóúñ\s,"
ADDRESS_RUN = r"A-Za-z0-9._%+\-"

RULES: dict[str, Rule] = {
    "dni_told": Rule("DNI", _finds(X.DNI_TRIGGER, X.DNI_SPACED, place=(1, 1), anchors=(("dn", "d.n", "documento", "identificad", *spaced("con")), ("dn", "d.", *spaced("d")))), test=_told),
    "dni_untold": Rule("DNI", _finds(X.DNI, place=(1, 1), ignore_case=False, anchors=((digits(8),),)), test=_untold, needs=("dni_told",)),
    "ruc": Rule("RUC", _finds(X.RUC, ignore_case=False, anchors=((digits(11, first="12"),),))),
    "email": Rule("EMAIL", _finds(X.EMAIL_GUARD + X.EMAIL, anchors=(("@",),), run=ADDRESS_RUN)),
    "expediente": Rule("EXPEDIENTE", _finds(*X.CASE_FILES, anchors=CASE_ANCHORS)),
    "phone": Rule("TELEFONO", _finds(*X.PHONES, ignore_case=False, anchors=PHONE_ANCHORS), test=_phone, needs=("expediente",)),
    "casilla": Rule("CASILLA", _finds(X.MAILBOX, value=0, anchors=(("casilla",),))),
    "acta": Rule("ACTA", _finds(*X.RECORDS, value=0, anchors=(("acta",), ("acta",)))),
    "juzgado": Rule("JUZGADO", _finds(X.COURT, anchors=(("juzgado", *ORDINALS),), hints=("juzgado",))),
    "cuenta": Rule("CUENTA", _finds(*X.ACCOUNTS, anchors=(("cuenta", "cta"), ("cci",), (digits(3, 6, *range(16, 21)),)))),
    "colegiatura": Rule("COLEGIATURA", _finds(X.LICENSED, value=0, anchors=(("cal", "cac", "caa", "ca.", "c.a", "cmp", "cip", "cap", "cpa", "cpp", "cnp", "colegi"),))),
    "sala": Rule("SALA", _finds(X.CHAMBER, anchors=(("sala", *ORDINALS),), hints=("sala",))),
    "tribunal": Rule("TRIBUNAL", _finds(X.TRIBUNAL, anchors=(("tribunal",),))),
    "partida": Rule("PARTIDA", _finds(X.REGISTRY, value=0, anchors=(("partida", "asiento", "tomo", "sunarp"),))),
    "resolucion": Rule("RESOLUCION", _finds(X.RULING, value=0, anchors=(("resoluci", "auto", "decreto", "acuerdo", "oficio", "informe"),))),
    "historia_clinica": Rule("HISTORIA_CLINICA", _finds(X.MEDICAL, anchors=(("hc-", "hc_", "historia"),))),
    "codigo_cliente": Rule("CODIGO_CLIENTE", _finds(X.CLIENT, anchors=(("cli-", "cli_", "codigo", "código"),))),
    "licencia": Rule("LICENCIA", _finds(X.LICENCE, anchors=(("lic-", "lic_", "licencia"),)), least=5),
    "poliza": Rule("POLIZA", _finds(X.POLICY, anchors=(("pol-", "pol_", "poliza", "póliza"),))),
    "plate": Rule("PLACA", _finds(X.PLATE, anchors=((digits(3),),), leads=(3, 4)), test=_vehicle),
    "firma": Rule("FIRMA", _finds(*X.SIGNATURES, anchors=(("firma",), ("_____",), ("firmado",), ("/s/",), ("firmante",), ("suscribe",))), confidence=0.7, least=5),
    "sello": Rule("SELLO", _finds(*X.SEALS, anchors=(("sello",), ("[sello]",), ("sellado",))), confidence=0.7, least=4),
    "huella": Rule("HUELLA", _finds(*X.PRINTS, anchors=(("huella",), ("[huella]",), ("impresión",))), confidence=0.7, least=5),
    "section_name": Rule("PERSONA", _section(X.SECTION_NAME), "section", 0.65, test=lambda s: _named(s) & filters.proper_name(s.m["value"])),
    "section_dni": Rule("DNI", _section(X.SECTION_DNI), "section"),
    "institution": _institution(1, (1, 1), _no_court),
    "institution_name": _institution(2, (2, 2), _no_court),
    "institution_court": replace(_institution(0, (1, 2), _court), value=strip),
    "association": _association(1),
    "association_name": _association(2),
    "domicilio": Rule("DIRECCION", _finds(*X.HOMES, place=(1, 1), anchors=(("domicilio",), ("con", "domicilio"), ("reside", "vive", "habita"), ("direcci",), ("ubicad",))), "context", 0.75, 8, value=trimmed_address),
    "address": Rule("DIRECCION", _finds(X.ADDRESS, value=0, anchors=(ADDRESS_ANCHORS,)), "context", least=9),
    "identified": Rule("PERSONA", (Find(X.NAMED, 1, (1, 1), anchors=("identificad",), run=NAME_RUN, first=UPPER),), "context", test=_named),
    "identified_dni": Rule("DNI", (Find(X.NAMED, 2, (2, 2), anchors=("identificad",), run=NAME_RUN, first=UPPER),), "context"),
    "phone_told": Rule("TELEFONO", _finds(X.PHONE_TRIGGER, place=(1, 1), anchors=(("tel", "cel", "móvil", "movil", "whatsapp", "fono", "contacto"),)), "context", test=lambda s: F.length(F.regexp_replace(s.m["value"], r"(?U)[\s\-()]", "")) >= 9),
    "email_context": Rule("EMAIL", _finds(X.EMAIL_TRIGGER, place=(1, 1), anchors=(("correo", "email", "e-mail"),)), "context"),
    "capitals": Rule("PERSONA", (Find(X.CAPITALS, anchors=(CAPITALS,)),), "strong_context_persona", 0.80, weak=lambda s: ~trigger_near(s.text, s.m), test=lambda s: _named(s) & (_three_words(s) | trigger_near(s.text, s.m))),
    "titulo": _person(f"(?:{X.TITLES})\\s+", 0.82, 0, ("señ", "senor", "sr", "don", "doñ", "dona", "abogad", "letrad", "dr", *spaced("el", "la"), "representante"), X.NAME_TITLE),
    "procurador": _person(X.ATTORNEYS, 0.82, 4, ("procurador",)),
    "firmante": _person(X.SIGNERS, 0.80, 5, ("atentamente", "firma", "suscri", "abogad", "nombre")),
    "remitente": _person(X.SENDERS, 0.80, 5, ("de:", "a:", *spaced("de", "a", by=" \t"), "para", "remitente", "destinatario", "dirigido", "emisor"), hints=(":",)),
    "menor": _person(X.MINORS, 0.80, 5, ("menor", "hij", *spaced("la", "el", by=" \t"))),
    "apellido": _person(X.SURNAMES, 0.82, 5, (*spaced("de", by=" \t"), "apellidad", "cuyo")),
    "parte": _person(X.PARTIES, 0.82, 5, ("demandad", "demandante", "codemandad", "solicitante", "invitad", *spaced("el", "la", by=" \t"), "ciudadan")),
    "alone": Rule("PERSONA", _finds(*X.ALONE, place=(1, 1), multiline=True, anchors=(("remitente", "destinatario"), ("atentamente",))), "strong_context_persona", 0.82, test=_named),
    "identified_loose": Rule("PERSONA", (Find(X.IDENTIFIED, 1, (1, 1), anchors=("identificad",), run=NAME_RUN, first=UPPER),), "strong_context_persona", 0.80, test=_named),
    "profesional": Rule("PERSONA", _finds(rf"\b{X.DEGREES}({X.NAME_STRICT})", place=(1, 1), anchors=(("dr", "abg", "lic", "psic", "mg", "ing", "c.", "cp", *spaced("c"), "trab", "bach"),)), "strong_context_persona", 0.84, 5, _named),
    "capital_line": Rule("PERSONA", (Find(X.CAPITAL_LINE, 1, (1, 1), multiline=True, anchors=(LINES,)),), "context", 0.72, 6, test=lambda s: ~_legal(s) & _named(s)),
    "cargo": Rule("PERSONA", (Find(rf"({X.NAME_STRICT})[ \t]*\n[ \t]*(?i:{X.JOBS})\b", 1, (1, 1), anchors=JOB_WORDS, run=NAME_RUN, first=UPPER),), "strong_context_persona", 0.86, 5, _named),
    "nombre_colegiado": Rule(
        "PERSONA",
        (Find(rf"({X.NAME_STRICT})(?:[ \t]*\n[ \t]*|[ \t]*,[ \t]*)(?i:{X.BOARDS})\s*(?:N[°º]?\s*)?\d{{3,7}}", 1, (1, 1), anchors=tuple(b.lower() for b in X.BOARDS.split("|")), run=NAME_RUN, first=UPPER),),
        "strong_context_persona", 0.88, 5, _named,
    ),
}


def entities(text: Column, *names: str, compat: bool = False) -> Column:
    """The entities of some rules, in the order of RULES, not yet merged. `compat` keeps medical records and client codes
    only in texts that hold a ruling, as the system matched here does by a slip."""
    if compat and {"historia_clinica", "codigo_cliente"} & set(names):
        names = (*names, "resolucion")
    needed = {h for n in names for h in RULES[n].needs}
    asked = [n for n in RULES if n in names or n in needed]
    numbers: dict[str, list[int]] = {}
    finds: list[Find] = []
    for name in asked:
        numbers[name] = list(range(len(finds), len(finds) + len(RULES[name].finds)))
        finds += RULES[name].finds

    def by_rule(m: Column, group: Callable[[str], object], make: Callable[[str], Column], default: Column) -> Column:
        """CASE over the rules: those of one group share a branch, those of the group None the default."""
        groups: dict[object, list[str]] = {}
        for name in asked:
            if (g := group(name)) is not None:
                groups.setdefault(g, []).append(name)
        out = None
        for members in groups.values():
            test, made = m["rule"].isin(*(r for n in members for r in numbers[n])), make(members[0])
            out = F.when(test, made) if out is None else out.when(test, made)
        return default if out is None else out.otherwise(default)

    def value(m: Column) -> Column:
        own = by_rule(m, lambda n: RULES[n].value, lambda n: RULES[n].value(m["value"]), strip(m["value"]))
        return m.withField("value", own)

    def quirk(name: str) -> bool:
        return compat and name in ("historia_clinica", "codigo_cliente")

    def group(name: str) -> object:
        rule = RULES[name]
        if name not in names:
            return "left out"
        return (rule.test, rule.least, quirk(name)) if rule.test or rule.least or quirk(name) else None

    def fits(every: Column, m: Column) -> Column:
        seen = Seen(text, m, every, numbers)

        def make(name: str) -> Column:
            rule = RULES[name]
            if name not in names:
                return F.lit(False)
            tests = [F.length(m["value"]) >= rule.least] if rule.least else []
            tests += [rule.test(seen)] if rule.test else []
            tests += [seen.others("resolucion", lambda o: F.lit(True))] if quirk(name) else []
            return reduce(lambda a, b: a & b, tests)

        return by_rule(m, group, make, F.lit(True))

    def entity(every: Column, m: Column, i: Column) -> Column:
        pick = lambda what: F.element_at(filters.listed(tuple(str(what(RULES[n])) for n in asked for _ in numbers[n])), m["rule"] + 1)
        weak = by_rule(m, lambda n: RULES[n].weak, lambda n: RULES[n].weak(Seen(text, m, every, numbers)), F.lit(False))
        return F.struct(
            pick(lambda r: r.type).alias("type"), m["value"].alias("value"), m["start"].alias("start"), m["stop"].alias("stop"),
            F.when(weak, "heuristic").otherwise(pick(lambda r: r.source)).alias("source"),
            F.when(weak, 0.70).otherwise(pick(lambda r: r.confidence).cast("double")).alias("confidence"), i.alias("seq"),
        )

    def of(every: Column) -> Column:
        kept = F.filter(F.transform(every, value), lambda m: fits(every, m))
        return F.transform(kept, lambda m, i: entity(every, m, i))

    return let(matches(tuple(finds))(text), of).cast(ENTITY)


def found(text: Column, *names: str) -> Column:
    """The spans of some rules."""
    return plain(entities(text, *names))


def dni(text: Column) -> Column:
    """Announced numbers first; others unless money stands near without the word, or they are part of a longer one."""
    return found(text, "dni_told", "dni_untold")


def detect(text: Column, compat: bool = False, more: Column | None = None) -> Column:
    """All entities of all layers, not yet merged. `more` are entities of a model, which speak last."""
    own = entities(text, *RULES, compat=compat)
    if more is None:
        return own
    return let(F.struct(own.alias("own"), more.alias("more")), _after)


def _after(both: Column) -> Column:
    placed = F.transform(both["more"], lambda e, i: e.withField("seq", (F.size(both["own"]) + i).cast("int")))
    return F.concat(both["own"], placed.cast(ENTITY))


def final(entities_kept: Column) -> Column:
    """The last filter: no value that can be no name, of whatever type."""
    return F.filter(entities_kept, lambda e: ~excluded(e["value"]))


__all__ = ["ENTITY", "RULES", "Rule", "detect", "dni", "entities", "excluded", "final", "found", "money_near", "trigger_near", "trimmed_address"]
