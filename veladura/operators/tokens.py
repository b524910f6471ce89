"""Tokens for values, replacement in texts, masks for reports."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veladura.functions import fixed as X
from veladura.functions import lexicon as L
from veladura.functions.spans import Blocked, Find, before, blocked, java, keep, let, spans
from veladura.functions.terms import Terms, claimed, present


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows (doc_id, type, value, start, stop, seq) with a token each; equal values (trimmed, upper case) of a type share
    one. Numbering within document and type: `last` by last occurrence in the text, from the end; `longest` by length,
    then seq; `listed` by seq. One shuffle by document serves every window."""
    rows = rows.withColumn("__key", F.upper(F.trim("value"))).repartition("doc_id")
    value, kind = Window.partitionBy("doc_id", "type", "__key"), Window.partitionBy("doc_id", "type")
    places = {
        "last": [F.max("start").over(value).alias("__0")],
        "longest": [F.max(F.length("value")).over(value).alias("__0"), F.min("seq").over(value).alias("__1")],
        "listed": [F.min("seq").over(value).alias("__0")],
    }[order]
    rows = rows.select("*", *places)
    by = [F.col("__0") if order == "listed" else F.col("__0").desc(), *(["__1"] if order == "longest" else []), "__key"]
    rows = rows.withColumn("number", F.dense_rank().over(kind.orderBy(*by)))
    return rows.drop("__key", "__0", "__1").withColumn("token", F.concat(F.lit("{{"), "type", F.lit("_"), "number", F.lit("}}")))


def numbered_in(found: Column, order: str) -> Column:
    """What `numbered` gives, within one document's array of entities (type, value, start, stop, seq): the array with a token
    each. Nothing is shuffled; keys are compared in pairs, so that documents with very many entities are better left to rows."""
    key = lambda e: F.upper(F.trim(e["value"]))
    pair = lambda e: F.struct(e["type"].alias("type"), key(e).alias("key"))

    def ranked(every: Column, *by: Callable[[Column], Column]) -> Column:
        rows = F.transform(every, lambda e: F.struct(e["type"].alias("a"), *(b(e).alias(f"b{i}") for i, b in enumerate(by)), key(e).alias("key")))
        return F.array_distinct(F.transform(F.array_sort(rows), lambda r: F.struct(r["a"].alias("type"), r["key"].alias("key"))))

    def tokened(every: Column, keys: Column) -> Column:
        number = lambda e: F.array_position(keys, pair(e)) - F.array_position(keys["type"], e["type"]) + 1
        return F.transform(every, lambda e: F.struct(*(e[c].alias(c) for c in ("type", "value", "start", "stop", "seq")), F.concat(F.lit("{{"), e["type"], F.lit("_"), number(e), F.lit("}}")).alias("token")))

    seq, last = lambda e: e["seq"], F.lit((1 << 31) - 1)
    if order == "last":
        return let(found, lambda every: let(ranked(every, lambda e: F.coalesce(-e["start"], last)), lambda keys: tokened(every, keys)))
    if order == "listed":
        return let(found, lambda every: let(ranked(every, seq), lambda keys: tokened(every, keys)))
    longest = lambda every, listed: ranked(every, lambda e: F.coalesce(-F.length(e["value"]), last), lambda e: F.array_position(listed, pair(e)))
    return let(found, lambda every: let(ranked(every, seq), lambda listed: let(longest(every, listed), lambda keys: tokened(every, keys))))


def replaced_at(text: Column, spans: Column) -> Column:
    """The text with disjoint spans (start, stop, token) replaced: each gap and its token a piece, all joined once."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["token"].alias("token"))))

    def stitched(every: Column, whole: Blocked) -> Column:
        last = lambda i: F.coalesce(F.get(every, i - 1)["stop"], F.lit(0))
        pieces = F.transform(every, lambda s, i: F.concat(whole.piece(last(i), s["start"] - last(i)), s["token"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last(F.size(every)) + 1, F.length(text)))

    return blocked(text, order, stitched)


#: Values that so many documents of a batch have are looked for together, as long as they are no more than this.
SHARED, MOST = 8, 1 << 16


class _Together:
    """The values of a batch of documents (value, soft, type): those that many of them have are looked for in one pass over a
    text, the others one by one."""

    def __init__(self, flat: pa.StructArray):
        known = pc.fill_null(flat.field("value"), "").dictionary_encode()
        loose = pc.and_(pc.invert(pc.fill_null(flat.field("soft"), False)), pc.fill_null(pc.equal(flat.field("type"), "EMAIL"), False))
        code = 2 * known.indices.to_numpy().astype(np.int64) + loose.to_numpy(zero_copy_only=False)
        self.values, self.codes = known.dictionary, code.tolist()
        often = np.flatnonzero(np.bincount(code) >= SHARED).tolist() if len(code) else []
        often = often if len(often) <= MOST else []
        self.shared = set(often)
        kinds = [(loose, [c for c in often if c % 2 == loose]) for loose in (0, 1)]
        self.sought = [(Terms((self.term(c), bool(loose)) for c in own), own) for loose, own in kinds if own]

    def term(self, code: int) -> str:
        return self.values[code // 2].as_py()

    def here(self, text: str, start: int, stop: int) -> list[int]:
        """Which of a document's values may stand in its text."""
        held = {own[i] for terms, own in self.sought for i in terms.places(text)}
        out, rest = [], []
        for j, c in enumerate(self.codes[start:stop], start):
            if c in held:
                out.append(j)
            elif c not in self.shared:
                rest.append(j)
        return sorted(out + present(text, ((j, self.term(self.codes[j]), self.codes[j] % 2 == 1) for j in rest), len(rest)))


@F.arrow_udf(T.StringType())
def _replaced(texts: pa.Array, values: pa.Array) -> pa.Array:
    flat, ends = values.values, values.offsets.to_pylist()
    fields = [(k, flat.field(k)) for k in ("value", "token", "soft", "type")]
    valid, out, together = values.is_valid().to_pylist(), [], _Together(flat)
    for i, text in enumerate(texts.to_pylist()):
        if text and valid[i]:
            here = together.here(text, ends[i], ends[i + 1])
            if here:
                text = claimed(text, [{k: column[j].as_py() for k, column in fields} for j in here]).replaced()
        out.append(text)
    return pa.array(out, pa.string())


def replaced_values(text: Column, values: Column) -> Column:
    """The text with values (value, token, soft, type) replaced everywhere, in one pass over it: those that aren't soft first,
    longest first. Soft values need a boundary on both sides, addresses match in any case, others to the letter. Values are
    not looked for inside tokens. Without values (null, empty) the text stays; a null text stays null."""
    return _replaced(text, F.transform(values, lambda v: F.struct(*(v[k].alias(k) for k in ("value", "token", "soft", "type")))))


def replaced_first(text: Column, value: Column, token: Column) -> Column:
    place = F.instr(text, value)
    return F.when(place > 0, F.overlay(text, token, place, F.length(value))).otherwise(text)


def soft(kind: Column) -> Column:
    return kind.isin(*L.SOFT)


def replaceable(kind: Column, value: Column) -> Column:
    """Whether a value may be replaced at all: soft ones need four characters, names a space, addresses eight characters."""
    v = F.trim(value)
    names = kind.isin("PERSONA", "ENTIDAD", "JUZGADO", "SALA", "TRIBUNAL")
    fine = (F.length(v) >= 4) & (~names | F.contains(v, F.lit(" "))) & ((kind != "DIRECCION") | (F.length(v) >= 8))
    return F.when(soft(kind), fine).otherwise(F.length(value) >= 2)


def masked(kind: Column, value: Column, long: int = 8) -> Column:
    """A value as reports show it."""
    n = F.length(value)
    stars = lambda k: F.repeat(F.lit("*"), k)
    at = F.instr(value, F.lit("@"))
    initials = F.array_join(F.transform(F.filter(F.split(value, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), " ")
    return (
        F.when(n <= 4, stars(n))
        .when(kind.isin("DNI", "RUC"), F.concat(F.substring(value, 1, 2), stars(n - 4), F.right(value, F.lit(2))))
        .when((kind == "EMAIL") & (at > 0), F.concat(F.substring(value, 1, 2), F.lit("***@"), F.substring(value, at + 1, n)))
        .when(kind == "TELEFONO", F.concat(F.substring(value, 1, 3), F.lit("***"), F.right(value, F.lit(2))))
        .when(kind == "PERSONA", initials)
        .when(n > long, F.concat(F.substring(value, 1, 3), F.lit("..."), F.right(value, F.lit(3))))
        .otherwise(F.concat(F.substring(value, 1, 2), stars(n - 2)))
    )


def hard_redacted(text: Column) -> Column:
    """The last resort: whatever has the shape of an address, an identity or tax number, a phone or a registry number."""
    for pattern, token in X.HARD_REDACT:
        text = F.regexp_replace(text, java(pattern, True), token)
    return text


NUMBERED = "array<struct<start:int,stop:int,key:string,token:string>>"


def _next(kind: Column, taken: Column, text: Column) -> Column:
    """The number after the highest that tokens of a type have in a text or among those given since."""
    number = lambda t: F.regexp_extract(t, r"_(\d{1,9})\}\}$", 1).cast("int")
    here = F.regexp_extract_all(text, F.concat(F.lit(r"(\{\{"), kind, F.lit(r"_\d{1,9}\}\})")), F.lit(1))
    own = F.filter(taken, lambda t: F.startswith(t, F.concat(F.lit("{{"), kind, F.lit("_"))))
    return F.coalesce(F.array_max(F.transform(F.concat(here, own), number)), F.lit(0)) + 1


def residual_emails(text: Column, known: Column | None = None) -> Column:
    """The text with every address left in it replaced: by its token where known (map<upper-case value, token>) has one,
    by the next number of its type else, in the order of the text. What follows two braces is part of a token."""
    known = F.create_map().cast("map<string,string>") if known is None else known
    left = keep(spans(text, Find(X.EMAIL_SAFETY, 0, hints=("@",))), lambda s: ~F.contains(before(text, s, 2), F.lit("{{")))

    def step(acc: Column, s: Column) -> Column:
        key = F.upper(F.trim(s["value"]))
        again = F.get(F.filter(acc, lambda a: a["key"] == key), F.lit(0))["token"]
        fresh = F.concat(F.lit("{{EMAIL_"), _next(F.lit("EMAIL"), F.concat(F.map_values(known), F.transform(acc, lambda a: a["token"])), text), F.lit("}}"))
        one = F.struct(s["start"].alias("start"), s["stop"].alias("stop"), key.alias("key"), F.coalesce(known[key], again, fresh).alias("token"))
        return F.concat(acc, F.array(one).cast(NUMBERED))

    return replaced_at(text, F.aggregate(left, F.array().cast(NUMBERED), step))


DECIDED = "struct<text:string,given:array<struct<type:string,key:string,token:string>>>"


def decided(text: Column, pending: Column) -> Column:
    """The text after a review: pending (type, value, start, accepted) that were accepted, from the end of the text on; each
    replaces the first place where its value still stands, equal values of a type share a token."""
    order = F.array_sort(F.transform(F.filter(pending, lambda e: e["accepted"]), lambda e: F.struct((-e["start"]).alias("a"), e["type"].alias("type"), e["value"].alias("value"))))

    def step(acc: Column, e: Column) -> Column:
        key = F.upper(F.trim(e["value"]))
        again = F.get(F.filter(acc["given"], lambda g: (g["type"] == e["type"]) & (g["key"] == key)), F.lit(0))["token"]
        fresh = F.concat(F.lit("{{"), e["type"], F.lit("_"), _next(e["type"], F.transform(acc["given"], lambda g: g["token"]), F.lit("")), F.lit("}}"))
        token = F.coalesce(again, fresh)
        given = F.when(again.isNull(), F.concat(acc["given"], F.array(F.struct(e["type"].alias("type"), key.alias("key"), token.alias("token"))))).otherwise(acc["given"])
        done = F.struct(replaced_first(acc["text"], e["value"], token).alias("text"), given.alias("given")).cast(DECIDED)
        return F.when((e["value"] != "") & F.contains(acc["text"], e["value"]), done).otherwise(acc)

    start = F.struct(text.alias("text"), F.array().cast("array<struct<type:string,key:string,token:string>>").alias("given")).cast(DECIDED)
    return F.aggregate(order, start, step, lambda acc: acc["text"])


def summary(rows: DataFrame) -> DataFrame:
    """rows with tokens to one JSON mapping a document, {type: {token: masked value}}."""
    one = rows.select("doc_id", "type", "token", masked(F.col("type"), F.col("value")).alias("shown")).dropDuplicates(["doc_id", "token"])
    kinds = one.groupBy("doc_id", "type").agg(F.array_sort(F.collect_list(F.struct("token", "shown"))).alias("pairs"))
    docs = kinds.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("type", "pairs"))).alias("kinds"))
    entries = F.transform("kinds", lambda k: F.struct(k["type"].alias("type"), F.map_from_entries(k["pairs"]).alias("m")))
    return docs.select("doc_id", F.to_json(F.map_from_entries(entries)).alias("mapping"))


def summary_in(tokened: Column) -> Column:
    """The mapping that `summary` gives of one document, from its array of entities with tokens; of values that share a token the
    smallest is shown."""
    shown = F.array_sort(F.transform(tokened, lambda e: F.struct(e["type"].alias("type"), e["token"].alias("token"), e["value"].alias("value"))))
    first = lambda every: F.filter(every, lambda e, i: (i == 0) | (F.get(every, i - 1)["token"] != e["token"]))
    kinds = lambda every: F.transform(
        F.array_distinct(every["type"]),
        lambda t: F.struct(t.alias("type"), F.map_from_entries(F.transform(F.filter(every, lambda e: e["type"] == t), lambda e: F.struct(e["token"], masked(t, e["value"])))).alias("m")),
    )
    return let(let(shown, first), lambda every: F.to_json(F.map_from_entries(kinds(every))))


def mapping_of(mapping: Column) -> Column:
    """The mapping that `summary` wrote, read back."""
    return F.from_json(mapping, "map<string,map<string,string>>")
