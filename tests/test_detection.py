"""Detectors, merging, filters, tokens and audit on single sentences and against plain models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veladura.functions import fixed as X
from veladura.functions.spans import Find, spans
from veladura.operators import audit, detect, filters, merge, tokens

rng = random.Random(3)


def values(spark, text, find):
    row = spark.createDataFrame([(text,)], "text string").select(find(F.col("text")).alias("s")).first()
    return [(s["value"], s["start"], s["stop"]) for s in row.s]


LEAKS = [
    ("DNI", "El demandante identificado con DNI N° 12345678", 1),
    ("DNI", "Fecha: 20240115", 0),
    ("DNI", "DNI: {{DNI_1}}", 0),
    ("DNI", "pago de S/ 12345678", 0),
    ("EMAIL", "Contactar a manuel.monty@gmail.com para más información.", 1),
    ("EMAIL", "escribir a x@example.com", 0),
    ("TELEFONO", "Celular: 987654321", 1),
    ("TELEFONO", "Teléfono: 987 654 321", 1),
    ("TELEFONO", "Celular: 987-654-321", 1),
    ("COLEGIATURA", "Abogado con CAL N° 12345", 1),
    ("COLEGIATURA", "C.A.L. 54321", 1),
    ("COLEGIATURA", "Médico CMP N° 67890", 1),
    ("DIRECCION", "Domicilio: Calle Los Olivos N° 123", 1),
    ("DIRECCION", "Mz A, Lt 15, Urb Los Jardines", 1),
    ("RUC", "Con RUC 20123456789", 1),
    ("RUC", "Número 10123456789", 0),
    ("RESOLUCION", "Resolución N° 123-2024", 1),
    ("RESOLUCION", "Oficio N° 789-2024", 1),
    ("PARTIDA", "Partida electrónica N° 12345678", 1),
    ("CASILLA", "Casilla electrónica N° 12345", 1),
    ("CASILLA", "Mesa de partes N° 67890", 1),
    ("JUZGADO", "1° Juzgado de Paz Letrado de Lima", 1),
    ("PLACA", "el vehículo de placa ABC-123", 1),
    ("PLACA", "el código ABC-123", 0),
]


@pytest.mark.parametrize("kind, text, n", LEAKS)
def test_leaks(spark, kind, text, n):
    assert len(values(spark, text, lambda t: audit.find(t, kind))) == n


def test_dni_rules(spark):
    assert values(spark, "DNI 12345678 y RUC 20123456789", detect.dni) == [("12345678", 4, 12)]
    assert values(spark, "suma de S/ 12345678", detect.dni) == []
    assert values(spark, "D . N . I . 12345678 en soles", detect.dni) == [("12345678", 12, 20)]


def test_phone_rules(spark):
    assert values(spark, "Expediente 987654321", lambda t: detect.found(t, "phone")) == []
    assert {v for v, *_ in values(spark, "llamar al 987654321", lambda t: detect.found(t, "phone"))} == {"987654321"}


def test_plate_needs_a_vehicle(spark):
    assert len(values(spark, "camioneta ABC-123", lambda t: detect.found(t, "plate"))) == 1
    assert values(spark, "expediente interno ABC-123", lambda t: detect.found(t, "plate")) == []


@pytest.mark.parametrize("pattern", [X.DNI, X.RUC, r"(\w+)@", X.CAPITALS, X.MAILBOX])
def test_span_offsets_are_those_of_python(spark, pattern):
    alphabet = "ab1 2ñÑ@😀.AB\n" + "9" * 3
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(200)] + ["12345678 20123456789 CASILLA n° 5 JUAN PEREZ x@y", "", "casilla 1casilla 2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: [(s.start, s.stop, s.value) for s in r.s] for r in rows.select("i", spans(F.col("text"), Find(pattern, ignore_case=True)).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(m.start(), m.end(), m.group(1)) for m in re.finditer(pattern, t, re.I)]


PLAIN = "array<struct<start:int,stop:int,rank:int,seq:int>>"


def test_merge_is_the_quadratic_model(spark):
    docs = [[(a := rng.randint(0, 40), a + rng.randint(1, 12), rng.randint(0, 3), i) for i in range(rng.randint(0, 9))] for _ in range(300)]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], f"i int, e {PLAIN}")
    got = {r.i: [(s.start, s.stop) for s in r.m] for r in rows.select("i", merge.merged(F.col("e"), PLAIN).alias("m")).collect()}
    for i, d in enumerate(docs):
        kept = []
        for e in sorted(d, key=lambda e: (e[0], e[0] - e[1], e[3])):
            clash = next((k for k in kept if e[0] < k[1] and e[1] > k[0]), None)
            if clash is None:
                kept.append(e)
            elif e[1] - e[0] > clash[1] - clash[0]:
                kept[kept.index(clash)] = e
        assert got[i] == sorted((e[0], e[1]) for e in kept)
        assert all(a[1] <= b[0] for a, b in zip(got[i], got[i][1:]))


def test_proper_names(spark):
    names = {"Juan Pérez García": True, "EDUARDO GAMARRA LÓPEZ": True, "FUNDAMENTOS DE HECHO": False, "Enero Quispe": False, "Juan": False, "María De Los Ángeles Ruiz": True}
    rows = spark.createDataFrame([(n,) for n in names], "v string")
    assert {r.v: r.p for r in rows.select("v", filters.proper_name(F.col("v")).alias("p")).collect()} == names


def test_whole_document_keeps_identifiers_and_drops_headings(spark):
    text = "FUNDAMENTOS DE HECHO\nPRIMERO: el señor Juan Pérez García, identificado con DNI 12345678, correo juan@correo.pe, celular 987654321."
    row = spark.createDataFrame([(text,)], "text string").select(filters.filtered(merge.merged(detect.detect(F.col("text")), detect.ENTITY)).alias("e")).first()
    got = {(e.type, e.value) for e in row.e}
    assert {("DNI", "12345678"), ("EMAIL", "juan@correo.pe"), ("PERSONA", "Juan Pérez García")} <= got
    assert not any("FUNDAMENTOS" in v for _, v in got)


def test_tokens_are_shared_and_numbered(spark):
    rows = [(1, "DNI", "12345678", 0, 8, 0), (1, "DNI", "87654321", 20, 28, 1), (1, "DNI", " 12345678", 40, 49, 2), (1, "EMAIL", "a@b.pe", 60, 66, 3)]
    df = spark.createDataFrame(rows, "doc_id long, type string, value string, start int, stop int, seq int")
    listed = {r.start: r.token for r in tokens.numbered(df, "listed").collect()}
    assert listed == {0: "{{DNI_1}}", 20: "{{DNI_2}}", 40: "{{DNI_1}}", 60: "{{EMAIL_1}}"}
    assert {r.start: r.token for r in tokens.numbered(df.where("start < 40"), "last").collect()} == {0: "{{DNI_2}}", 20: "{{DNI_1}}"}


def test_soft_values_need_boundaries(spark):
    df = spark.createDataFrame([("Ana Ruiz y Ana Ruizal, X@y.pe x@Y.PE a\\Eb",)], "text string")
    one = lambda v, t, s, k: F.struct(F.lit(v).alias("value"), F.lit(t).alias("token"), F.lit(s).alias("soft"), F.lit(k).alias("type"))
    out = df.select(tokens.replaced_values(F.col("text"), F.array(one("Ana Ruiz", "{{P}}", True, "PERSONA"), one("x@y.pe", "{{E}}", False, "EMAIL"), one("a\\Eb", "{{Q}}", False, "EMAIL"))).alias("o")).first().o
    assert out == "{{P}} y Ana Ruizal, {{E}} {{E}} {{Q}}"


def test_masks(spark):
    cases = {("DNI", "12345678"): "12****78", ("EMAIL", "juan@x.pe"): "ju***@x.pe", ("TELEFONO", "987654321"): "987***21", ("PERSONA", "Juan Perez"): "J. P.", ("OTRO", "abc"): "***", ("OTRO", "abcdefghij"): "abc...hij"}
    df = spark.createDataFrame([(k, v) for k, v in cases], "k string, v string")
    assert {(r.k, r.v): r.m for r in df.select("k", "v", tokens.masked(F.col("k"), F.col("v")).alias("m")).collect()} == cases


def test_audit_repairs(spark):
    text = "Demandante con DNI N° 12345678, RUC 20123456789, correo a.b@c.pe. Repite DNI N° 12345678."
    row = audit.fixed(spark.createDataFrame([(1, text), (2, "nada")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].is_safe and row[0].remaining == 0 and "12345678" not in row[0].fixed_text and "{{DNI_100}}" in row[0].fixed_text
    assert row[1].fixed_text == "nada" and row[1].is_safe


def test_long_texts_do_not_break_the_ruling_pattern(spark):
    text = "resolucion " + "palabra " * 20000 + "n° 123"
    assert len(values(spark, text, lambda t: detect.found(t, "resolucion"))) == 1


def test_a_number_after_its_sign_is_lost_to_the_longer_address(spark):
    """As in the system matched here: an address may begin at N° and is longer; the filters then turn it down."""
    kept = lambda t: detect.final(filters.filtered(merge.merged(detect.detect(t), detect.ENTITY)))
    row = spark.createDataFrame([("Con DNI N° 12345678 del caso.",)], "text string").select(kept(F.col("text")).alias("e")).first()
    assert row.e == []


def test_word_lists_are_whole():
    from veladura.functions import lexicon

    assert [len(set(w)) for w in (lexicon.WHITELIST, lexicon.EXCLUDED, lexicon.COMMON, lexicon.NO_NAMES)] == [172, 358, 68, 337]


@pytest.mark.parametrize("find", [f for r in detect.RULES.values() for f in r.finds if f.anchors and f.inside is None], ids=lambda f: f.pattern[:30])
def test_anchors_lose_no_match(find):
    """What a pattern finds at its anchors is what it finds everywhere."""
    from veladura.functions.spans import Scanned

    words = [*(a for a in find.anchors if a != "0-9"), "N° 123", "12345678", "987 654 321", "Juan Pérez", "DE LA", ": ", "sala civil", "KİſK", "\n", "-", "de ", "el ", "dni", "con ", "ELECTRONICA ", "ſala"]
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 25)))
        text = "".join(c.upper() if rng.random() < 0.2 else c for c in text)
        assert [m.span() for m in Scanned(text).search(find)] == [m.span() for m in re.compile(find.pattern, find.flags).finditer(text)]


def test_compat_keeps_medical_records_beside_rulings_only(spark):
    df = spark.createDataFrame([(1, "HC-123456 y auto n° 12"), (2, "HC-123456")], "i int, text string")
    got = {r.i: {e.type for e in r.e} for r in df.select("i", detect.detect(F.col("text"), compat=True).alias("e")).collect()}
    assert "HISTORIA_CLINICA" in got[1] and "HISTORIA_CLINICA" not in got[2]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.e for r in df.select(detect.detect(F.col("text")).alias("e")).collect()] == [[], []]
    assert [(r.leaks_found, r.is_safe) for r in audit.fixed(df).collect()] == [(0, True)] * 2


def test_what_a_model_raises_is_told(spark):
    from veladura.operators import models

    def ask(requests):
        if any(r["i"] == 3 for r in requests):
            raise ValueError("no such model")
        return [str(r["i"]) for r in requests if r["i"] != 5]

    rows = spark.createDataFrame([(i,) for i in range(8)], "i int").coalesce(1)
    got = {r.i: (r.answer, r.error) for r in models.asked(rows, ask, "string", 2).collect()}
    assert got[0] == ("0", None) and got[2] == got[3] == (None, "ValueError: no such model")
    assert got[4] == got[5] == (None, "1 answers to 2 requests") and got[7] == ("7", None)


def test_a_text_without_anchors_is_passed_over():
    """A pattern none of whose anchors stand in a text isn't tried; tables share what the same patterns found."""
    from veladura.functions.spans import Find, Scanned, _steps

    finds = (Find(r"\bcasilla\s+(\d+)", anchors=("casilla",), ignore_case=True), Find(r"\bcasilla\s+(\d+)", 0, anchors=("casilla",), ignore_case=True))
    one, two = _steps(finds)
    assert one.slot == two.slot and one.hints == ("casilla",)
    scanned = Scanned("Nada de eso 12")
    assert scanned.places(one) == [] and not scanned.seen
    scanned = Scanned("CASILLA 12")
    assert scanned.places(one) is scanned.places(two) and [m[1] for m, _ in scanned.places(one)] == ["12"]
