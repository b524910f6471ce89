"""Merging, deduplication and claims of entities, all as folds over one document's array or as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veladura.functions.spans import let


def _stop(every: Column) -> Column:
    """The last stop of some entities, null of none."""
    return F.array_max(F.transform(every, lambda x: x["e"]["stop"]))


def _islands(every: Column, wide: int = 64) -> Column:
    """Sorted entities in stretches that nothing overlaps from outside: one begins where nothing before reaches. What lies
    before is known by the last stops of whole stretches of `wide` and a look at what is left of its own."""
    spans = F.transform(F.sequence(F.lit(0), F.size(every) - 1, F.lit(wide)), lambda at: _stop(F.slice(every, at + 1, F.lit(wide))))

    def cut(before: Column) -> Column:
        reach = lambda i: F.greatest(F.get(before, F.floor(i / wide).cast("int")), _stop(F.slice(every, (F.floor(i / wide) * wide + 1).cast("int"), i % wide)))
        begins = F.filter(F.transform(every, lambda x, i: F.when(x["e"]["start"] >= F.coalesce(reach(i), F.lit(0)), i)), lambda i: i.isNotNull())
        return let(begins, lambda at: F.transform(at, lambda b, j: F.slice(every, b + 1, F.coalesce(F.get(at, j + 1), F.size(every)) - b)))

    return let(let(spans, lambda own: F.transform(own, lambda _, c: F.array_max(F.slice(own, F.lit(1), c)))), cut)


def merged(entities: Column, kind: str) -> Column:
    """Disjoint entities by start. Of two that overlap the longer stays, of equals the earlier in seq.

    Accepted entities are disjoint and start no later than the next one, so that only the last can overlap it. A fold copies
    what it has gathered at every step: many entities are folded stretch by stretch. kind is the array's type."""
    order = F.sort_array(F.transform(entities, lambda e: F.struct(e["start"].alias("a"), (e["start"] - e["stop"]).alias("b"), e["seq"].alias("c"), e.alias("e"))))
    empty = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        e, last = x["e"], F.element_at(acc, -1)
        apart = (F.size(acc) == 0) | (last["stop"] <= e["start"])
        longer = (e["stop"] - e["start"]) > (last["stop"] - last["start"])
        return F.when(apart, F.concat(acc, F.array(e))).when(longer, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(e))).otherwise(acc)

    def fold(every: Column) -> Column:
        return F.aggregate(every, empty, lambda acc, x: F.when(F.size(acc) == 0, F.concat(empty, F.array(x["e"]))).otherwise(step(acc, x)))

    return let(order, lambda every: F.when(F.size(every) <= 256, fold(every)).otherwise(F.flatten(F.transform(_islands(every), fold))))


def claims(entities: Column, kind: str) -> Column:
    """Entities by rank (field `rank`, then seq), each kept unless it overlaps one kept before; then by start, longest first."""
    order = F.sort_array(F.transform(entities, lambda e: F.struct(e["rank"].alias("a"), e["seq"].alias("b"), e.alias("e"))))
    clash = lambda acc, e: F.exists(acc, lambda k: (e["start"] < k["stop"]) & (k["start"] < e["stop"]))
    kept = F.aggregate(order, F.array().cast(kind), lambda acc, x: F.when(clash(acc, x["e"]), acc).otherwise(F.concat(acc, F.array(x["e"]))))
    place = F.sort_array(F.transform(kept, lambda e: F.struct(e["start"].alias("a"), (e["start"] - e["stop"]).alias("b"), e["seq"].alias("c"), e.alias("e"))))
    return F.transform(place, lambda x: x["e"])


def first_of(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def split_emails(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows (doc_id, value, text) with several addresses in the value become one row an address, placed where the
    address first stands in the text; addresses that the text lacks are left out."""
    found = rows.select("doc_id", "text", F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("value"))
    return found.withColumn("start", F.expr("locate(value, text) - 1")).where("start >= 0").withColumn("stop", F.col("start") + F.length("value")).drop("text")


def candidates(value: Column, soft: Column) -> Column:
    """Up to four spellings of a value: trimmed, with single spaces and, unless soft, without spaces; of four
    characters at least and different without regard to case, the first spelling of each kept."""
    trimmed = F.trim(value)
    single = F.regexp_replace(trimmed, r"\s+", " ")
    tight = F.when(~soft, F.regexp_replace(trimmed, r"\s+", ""))
    every = F.filter(F.array(trimmed, single, tight), lambda v: v.isNotNull() & (F.length(v) >= 4))
    known = lambda acc, v: F.exists(acc, lambda k: F.lower(k) == F.lower(v))
    out = F.aggregate(every, F.array().cast("array<string>"), lambda acc, v: F.when(known(acc, v), acc).otherwise(F.concat(acc, F.array(v))))
    return F.slice(out, 1, 4)
