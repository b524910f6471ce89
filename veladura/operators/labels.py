"""Users' own labels: which are accepted, and where the terms that a user put under them stand in that user's documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veladura.functions.terms import Claims, Terms

MOST = 50
FOUND = "array<struct<start:int,stop:int,value:string,label:string>>"


def created(asked: DataFrame, most: int = MOST) -> DataFrame:
    """asked (user_id, seq, label_name), in order of seq, with label and outcome: `invalid` (a label is 1 to 30 of A-Z, 0-9 and _
    after trimming and upper case), `duplicate` of one that the user has, `limit` beyond `most`, `created`.

    Only first requests are ranked, each task keeping a user's first `most`: no user's requests meet in one task."""
    rows = asked.withColumn("label", F.upper(F.trim(F.coalesce("label_name", F.lit("")))))
    fine = F.col("label").rlike("^[A-Z0-9_]{1,30}$")
    first = rows.where(fine).groupBy("user_id", "label").agg(F.min("seq").alias("__first"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("__first"))
    kept = first.withColumn("__rank", rank).where(F.col("__rank") <= most).select("user_id", "label", "__first")
    both = rows.join(kept, ["user_id", "label"], "left")
    outcome = F.when(~fine, "invalid").when(F.col("__first").isNull(), "limit").when(F.col("seq") == F.col("__first"), "created").otherwise("duplicate")
    return both.select(*rows.columns, outcome.alias("outcome"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (user, part, doc, text, term, label) by user and part, terms first: one user's terms are held at a time, documents
    pass by."""
    key, given, own, auto = None, set(), [], None
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        ends, spans = [0], []
        for user, part, text, term, label in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
            if (user, part) != key:
                key, given, auto = (user, part), set(), None
            if term is not None:
                given.add((term, label))
                continue
            if auto is None:
                own = sorted(given, key=lambda t: (-len(t[0]), t[0], t[1] is not None, t[1] or ""))
                auto = Terms((t, False) for t, _ in own)
            places = auto.places(text or "")
            if places:
                claims, plain = Claims(text), Claims(text)
                # the order of `own` is by length, then term and label
                for size, at, i in sorted((-len(own[i][0]), at, i) for i, starts in places.items() for at in starts):
                    # boundaries are those of the text, whatever was claimed beside it
                    if claims.free(at, at - size) and plain.bounded(at, at - size):
                        claims.put(at, at - size, own[i][1])
                for a in claims.starts:
                    stop, label = claims.spans[a]
                    spans.append((a, stop, text[a:stop], label))
            ends.append(len(spans))
        if len(ends) > 1:
            docs = batch.filter(batch.column(4).is_null())
            cells = [pa.array(c, k) for c, k in zip(zip(*spans, strict=True) if spans else [()] * 4, kinds, strict=True)]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cells, names=["start", "stop", "value", "label"]))
            yield pa.RecordBatch.from_arrays([docs.column(0), docs.column(2), found], names=["user_id", "doc_id", "found"])


def marked(docs: DataFrame, terms: DataFrame, rows_a_part: int = 100_000, text: str | Column = "text") -> DataFrame:
    """docs (user_id, doc_id and what `text` is made from) to user_id, doc_id and found: the places of the user's terms (user_id,
    term, label), to the letter and between boundaries; of those that overlap the longest stays, then the first, then the
    smaller label.

    Terms and documents are dealt by user; users with more than `rows_a_part` documents (there are few: that many documents
    each) are split, their terms sent to every part. Documents stream past one user's terms. `text` is evaluated after rows
    are dealt and sorted: where it is made from short columns, these move in place of whole texts."""
    session = docs.sparkSession
    dealt = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumns({"__user": F.col("user_id").cast("long"), "__doc": F.col("doc_id").cast("long")})
    terms = terms.where("term IS NOT NULL AND term <> '' AND user_id IS NOT NULL").select(F.col("user_id").cast("long").alias("__user"), F.col("term").alias("__term"), F.col("label").alias("__label"))
    hot = docs.groupBy("__user").count().where(F.col("count") > rows_a_part).select("__user", F.ceil(F.col("count") / rows_a_part).cast("int").alias("__parts"))
    hot = F.broadcast(hot)
    parts = F.coalesce("__parts", F.lit(1))
    rows = docs.join(hot, "__user", "left").withColumn("__part", F.pmod(F.xxhash64("__doc"), parts).cast("int")).drop("__parts")
    own = terms.join(hot, "__user", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    term = F.col("__term")
    both = rows.unionByName(own, allowMissingColumns=True).repartition(dealt, "__user", "__part").sortWithinPartitions("__user", "__part", term.isNull())
    made = F.when(term.isNull(), F.col(text) if isinstance(text, str) else text)
    return both.select("__user", "__part", "__doc", made.alias("__text"), term, "__label").mapInArrow(_marked, f"user_id long, doc_id long, found {FOUND}")
