"""The automaton against searching term by term, claims against replacing one value after another."""

import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from veladura.functions.terms import WORD, Terms, claimed, folded
from veladura.operators import labels, tokens

rng = random.Random(4)
ALPHABET = "abAB ñÑ-é.@"


def text_of(n):
    return "".join(rng.choices(ALPHABET, k=n))


def in_turn(text, values):
    """What replacing one value after another gives."""
    for v in sorted(values, key=lambda v: (v["soft"], -len(v["value"]), v["value"], v["token"])):
        if not v["value"]:
            continue
        quoted = re.escape(v["value"])
        if v["soft"]:
            text = re.sub(f"(?<![{WORD}]){quoted}(?![{WORD}])", lambda m: v["token"], text)  # noqa: B023
        elif v["type"] == "EMAIL":
            text = re.sub(quoted, lambda m: v["token"], text, flags=re.I)  # noqa: B023
        else:
            text = text.replace(v["value"], v["token"])
    return text


def random_values(n):
    return [{"value": text_of(rng.randint(0, 4)), "token": f"{{{{{i}}}}}", "soft": rng.random() < 0.5, "type": rng.choice(["EMAIL", "DNI"])} for i in range(n)]


def test_places():
    for _ in range(300):
        terms = [(text_of(rng.randint(0, 3)), rng.random() < 0.5) for _ in range(6)]
        text = text_of(40)
        want = {}
        for i, (t, any_case) in enumerate(terms):
            at = [k for k in range(len(text)) if t and (folded(text[k : k + len(t)]) == folded(t) if any_case else text.startswith(t, k))]
            if at:
                want[i] = at
        assert Terms(terms).places(text) == want
    assert Terms([]).places("abc") == {} and Terms([("", True)]).places("abc") == {} and Terms([("a", True)]).places("") == {}
    assert folded("İ ß ŉ Ñ") == "İ ß ŉ ñ" and len(folded("ΑΣ😀")) == 3


def test_claims_are_what_replacing_in_turn_gives():
    for _ in range(2000):
        values, text = random_values(5), text_of(30)
        assert claimed(text, values).replaced() == in_turn(text, values), (text, values)


def test_values_are_not_looked_for_in_tokens():
    values = [{"value": "Ana Ruiz", "token": "{{PERSONA_1}}", "soft": False, "type": "DNI"}, {"value": "PERSONA", "token": "{{X}}", "soft": True, "type": "ENTIDAD"}]
    assert claimed("Ana Ruiz es PERSONA", values).replaced() == "{{PERSONA_1}} es {{X}}"


def test_time_follows_the_text():
    values = [{"value": f"valor{i}", "token": f"{{{{V_{i}}}}}", "soft": False, "type": "DNI"} for i in range(10_000)]
    text = " ".join(f"valor{rng.randrange(10_000)}" for _ in range(20_000))
    began = time.time()
    got = claimed(text, values).replaced()
    assert time.time() - began < 5 and re.sub(r"\{\{V_(\d+)\}\}", r"valor\1", got) == text and "{{V_" in got


def test_column(spark):
    rows = [(i, text_of(50), random_values(4)) for i in range(60)] + [(90, None, random_values(2)), (91, "abc", None), (92, "", []), (93, "sin nada", [])]
    kind = "doc_id long, text string, vs array<struct<value:string,token:string,soft:boolean,type:string>>"
    df = spark.createDataFrame([(i, t, None if vs is None else [(v["value"], v["token"], v["soft"], v["type"]) for v in vs]) for i, t, vs in rows], kind)
    got = {r.doc_id: r.out for r in df.select("doc_id", tokens.replaced_values(F.col("text"), F.col("vs")).alias("out")).collect()}
    assert got == {i: None if t is None else in_turn(t, vs or []) for i, t, vs in rows}


def test_labels_accepted(spark):
    rows = [(1, i, f"label_{i}") for i in range(55)] + [(1, 60, " LABEL_3 "), (1, 61, "mal nombre"), (1, 62, None), (1, 63, "label_52"), (1, 64, "X" * 31), (2, 1, "label_3"), (2, 2, "Label_3")]
    got = {(r.user_id, r.seq): r.outcome for r in labels.created(spark.createDataFrame(rows, "user_id long, seq long, label_name string")).collect()}
    assert len(got) == len(rows)
    assert [got[1, i] for i in (0, 49, 50, 54, 60, 61, 62, 63, 64)] == ["created", "created", "limit", "limit", "duplicate", "invalid", "invalid", "limit", "invalid"]
    assert (got[2, 1], got[2, 2]) == ("created", "duplicate")


def plain_marks(text, own):
    word = re.compile(f"[{WORD}]")
    spots = []
    for t, label in own:
        spots += [(-len(t), i, t, label) for i in range(len(text)) if t and text.startswith(t, i) and not word.match(text[i - 1 : i] if i else "") and not word.match(text[i + len(t) : i + len(t) + 1])]
    out = []
    for size, i, t, label in sorted(spots):
        if all(i - size <= a or b <= i for a, b, _, _ in out):
            out.append((i, i - size, t, label))
    return sorted(out)


def test_users_own_terms(spark):
    terms = {u: list({(text_of(rng.randint(1, 4)), rng.choice("PQ")) for _ in range(50)}) for u in (1, 2, 3)}
    docs = [(rng.choice([1, 1, 1, 2, 3, 4]), i, text_of(80)) for i in range(200)] + [(1, 900, None), (None, 901, "ab"), (1, 902, "")]
    table = [(u, t, k) for u, own in terms.items() for t, k in own] + [(1, None, "P"), (1, "", "P")] + [(1, *terms[1][0])]
    for size in (100_000, 20):
        got = labels.marked(spark.createDataFrame(docs, "user_id long, doc_id long, text string"), spark.createDataFrame(table, "user_id long, term string, label string"), size).collect()
        assert {(r.user_id, r.doc_id): [tuple(f) for f in r.found] for r in got} == {(u, i): plain_marks(t or "", terms.get(u, [])) for u, i, t in docs}


def test_absent_values_cost_no_automaton(monkeypatch):
    """Of many values only those that stand in a small text reach the automaton, with the same result as all of them."""
    import pyarrow as pa

    from veladura.functions import terms

    built, whole = [], terms.Terms.__init__

    def counted(self, given):
        given = list(given)
        built.append(len(given))
        whole(self, given)

    monkeypatch.setattr(terms.Terms, "__init__", counted)
    values = [{"value": f"ausente {i}", "token": "{{X}}", "soft": True, "type": "PERSONA"} for i in range(300)] + [{"value": "A@B.PE", "token": "{{EMAIL_1}}", "soft": False, "type": "EMAIL"}]
    run = getattr(tokens._replaced, "func", tokens._replaced)
    assert run(pa.array(["va a a@b.pe ya"]), pa.array([values])).to_pylist() == ["va a {{EMAIL_1}} ya"]
    assert built == [1]


def test_terms_to_the_letter_fold_nothing(monkeypatch):
    """Only terms found in any case need the text's lower case."""
    from veladura.functions import terms

    monkeypatch.setattr(terms, "folded", lambda text: 1 / 0)
    assert Terms([("Ñandú", False), ("N°", False), ("", True)]).places("el Ñandú N° 1, ÑANDÚ, n°") == {0: [3], 1: [9]}


def test_folds_ascii_stretches_whole():
    """Lower case of what isn't ASCII alone is looked up character by character; every character's is what it was."""
    every = "".join(chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000) + "😀Σ𐐀"
    one = lambda c: x if len(x := c.upper()) == 1 and len(x := x.lower()) == 1 else c
    assert folded(every) == "".join(map(one, every)) and all(folded(c) == one(c) for c in every)
    text = "Partida ELECTRONICA N° " * 100_000
    began = time.time()
    assert folded(text) == text.lower()
    took, began = time.time() - began, time.time()
    "".join(map(one, text))
    assert took < (time.time() - began) / 2


def test_texts_are_made_after_rows_are_dealt(spark, capsys):
    """Keys are shuffled and sorted by user, not whole texts."""
    from veladura.plans.catalogue import QUERIES

    QUERIES["user_terms"](spark, "/root/testdata/sf0.001").explain("formatted")
    steps = [s for s in capsys.readouterr().out.split("\n\n") if re.match(r"\(\d+\) (Exchange|Sort)\b", s)]
    assert any("Sort" in s for s in steps) and not any(re.search(r"\b(__)?text#", s) for s in steps)


def test_users_terms_in_texts_made_late(spark):
    """The text is an expression over other columns; terms given twice or without a label count once, users are split."""
    docs = spark.createDataFrame([(1, i, "Lima", f"Norte {i}") for i in range(50)] + [(2, 90, "Lima", None), (None, 91, "Lima", "x")], "user_id int, doc_id int, a string, term string")
    own = spark.createDataFrame([(1, "Lima", "Q"), (1, "Lima", "P"), (1, "Lima", None), (1, "Lima Norte", "Z"), (1, "Lima Norte", "Z"), (2, "Lima", "L")], "user_id int, term string, label string")
    for size in (100_000, 7):
        got = {r.doc_id: [tuple(f) for f in r.found] for r in labels.marked(docs, own, size, F.concat_ws(" ", "a", "term", "a")).collect()}
        n = lambda i: len(f"Lima Norte {i} ")
        want = {i: [(0, 10, "Lima Norte", "Z"), (n(i), n(i) + 4, "Lima", None)] for i in range(50)}
        assert got == want | {90: [(0, 4, "Lima", "L"), (5, 9, "Lima", "L")], 91: []}


def test_values_of_many_documents_are_looked_for_together(spark):
    """Values that a batch repeats are found in one pass over a text, in any case where they may be; others one by one, to the
    same end. Before each of them was looked for in every text."""
    from veladura.operators.tokens import _Together

    every = [("Ana Ruiz", "{{PERSONA_1}}", True, "PERSONA"), ("X@y.pe", "{{EMAIL_1}}", False, "EMAIL"), ("x@Y.pe", "{{Z_1}}", None, "OTRO"), (None, "{{N}}", True, None), ("", "{{N}}", False, "EMAIL")]
    texts = [f"Ana Ruiz y x@y.PE, x@Y.pe con u{i}@m.pe; Ana Ruizz {i}" if i % 3 else f"nada {i}" for i in range(40)]
    rows = [(i, t, [*every, (f"u{i}@M.pe", "{{EMAIL_2}}", False, "EMAIL"), (f"{i}", f"{{{{I_{i}}}}}", True, "N")]) for i, t in enumerate(texts)]
    rows += [(40, None, every), (41, "Ana Ruiz", None), (42, "Ana Ruiz", []), (43, "", every)]
    df = spark.createDataFrame(rows, "i int, t string, v array<struct<value:string,token:string,soft:boolean,type:string>>").coalesce(1)
    got = {r.i: r.o for r in df.select("i", tokens.replaced_values(F.col("t"), F.col("v")).alias("o")).collect()}
    for i, t, v in rows:
        own = [dict(zip(("value", "token", "soft", "type"), x, strict=True)) for x in v or []]
        assert got[i] == (claimed(t, own).replaced() if t and v else t)
    assert got[1] == "{{PERSONA_1}} y {{EMAIL_1}}, {{EMAIL_1}} con {{EMAIL_2}}; Ana Ruizz {{I_1}}" and got[41] == "Ana Ruiz"

    kind = pa.struct([("value", pa.string()), ("soft", pa.bool_()), ("type", pa.string())])
    batch = _Together(pa.array([{"value": f"ausente {i % 50}", "soft": True, "type": "PERSONA"} for i in range(1000)], kind))
    assert len(batch.shared) == 50 and batch.here("un ausente 7 aqui", 0, 50) == [7]
