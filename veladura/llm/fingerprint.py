"""Bottom-k sketches of documents: fingerprints that can be merged and compared without the texts.

A text's shingles are its distinct runs of five words (all words as one run where there are fewer; words
`[^\\x20\\x09-\\x0D]+` of the text in lower case), each hashed to 64 bits. The sketch is the sorted array of the k smallest hashes.
The sketch of two texts taken together is the k smallest of both sketches, so that sketches of parts merge into that
of the whole. From sketches alone come the number of distinct shingles, the resemblance of two sets (intersection over
union) and the containment of one in the other. All of it is Spark's own expressions: no Python runs in tasks.

Null texts count as empty. Texts without words have the empty sketch; two of them are alike (1), one of them and a text
with words are not (0). Equal texts have equal fingerprints, whatever else their rows hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import written
from .order import ranked

K = 128
WORDS = 5
_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it: a lambda's variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles of a text, repeated ones as often as they occur."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")

    def runs(h: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(h[i + j] for j in range(words))))
        short = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
        return F.when(F.size(h) >= words, whole).when(F.size(h) > 0, short).otherwise(F.array().cast("array<long>"))

    return let(F.transform(found, lambda w: F.xxhash64(w)), runs)


def bottom(hashes: Column, k: int = K) -> Column:
    """The k smallest of an array of hashes, each once."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return bottom(shingles(text, words), k)


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two sets taken together."""
    return bottom(F.concat(a, b), k)


def distinct(s: Column, k: int = K) -> Column:
    """How many distinct shingles a sketch stands for: exact below k, else from the place of the kth hash in their range."""
    share = (F.element_at(s, -1).cast("double") + F.lit(2.0**63) + 0.5) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def _compared(a: Column, b: Column, k: int, of: Callable[[Column, Column], Column]) -> Column:
    """of(the union's sketch, those of its hashes that both sets hold); every hash of the union's sketch that a set holds is in
    that set's own sketch, so that membership is certain."""
    both = F.size(F.array_intersect(a, b))
    told = let(union(a, b, k), lambda u: of(u, F.array_intersect(F.array_intersect(u, a), b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(told)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """An unbiased estimate of intersection over union; exact where the union has at most k shingles."""
    return _compared(a, b, k, lambda u, c: F.size(c) / F.size(u))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """An estimate of the share of a's shingles that b has; 1 for the empty set."""
    share = _compared(a, b, k, lambda u, c: F.coalesce(F.try_divide(F.size(c), F.size(F.array_intersect(u, a))), F.lit(0.0)))
    return F.when(F.size(a) == 0, 1.0).otherwise(share)


def told(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def read(fingerprint: Column) -> Column:
    """The sketch that told() wrote."""
    at = F.sequence(F.lit(1), F.length(fingerprint), F.lit(16))
    parts = F.transform(at, lambda i: F.conv(F.substring(fingerprint, i, F.lit(16)), 16, -10).cast("long"))
    return F.when(F.length(fingerprint) >= 16, parts).otherwise(F.array().cast("array<long>"))


def merged(parts: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """keys and the sketch of all parts of equal keys taken together.

    Hashes are dealt by key and hash and kept once each; a limit by rank runs before the next shuffle, so that no task
    holds more than k hashes of a key from each task before it. Keys whose parts are all empty keep the empty sketch."""
    named = {c: f"__k{i}" for i, c in enumerate(keys)}
    rows = parts.select(*(F.col(c).alias(n) for c, n in named.items()), F.explode_outer(column).alias("__h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*named.values()).orderBy(F.asc_nulls_last("__h")))
    least = rows.withColumn("__rank", rank).where(F.col("__rank") <= k)
    out = least.groupBy(*named.values()).agg(F.sort_array(F.collect_list("__h")).alias(column))
    return out.select(*(F.col(n).alias(c) for c, n in named.items()), column)


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document beside its successor and its edited text: doc_id, text, its sketch `own`, the edited text `edit` (the last
    third of the code points, rounded down, replaced by as many from the start of the next document) and the next document's
    sketch `next`. The next document is that before it in rising doc_id (after the smallest the largest); ids that are null
    come last, equal ids are ordered by a hash of their text. Rows that repeat an id and its text are one document, answered as
    often as they occur.

    Documents meet by the hash of their text, copies of one row summed up before the shuffle; their order is found over
    narrow rows. Of the next document only its sketch and the characters asked for travel."""
    text = F.coalesce("text", F.lit(""))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.xxhash64(F.col("doc_id").isNull(), text).alias("__h")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *key)
    # equal ids and hashes bear one text; all columns go to both of its uses, so that one shuffle serves them
    known = rows.groupBy("__id", "__h").agg(F.first(F.struct("doc_id", "text")).alias("row"), F.count("*").alias("copies"))
    known = known.select("__id", "__h", "row.doc_id", "row.text", "copies")
    narrow = rows.select("__id", "__h", F.col("doc_id").isNull().alias("none"), F.char_length("text").alias("chars")).distinct()
    places = ranked(narrow, [], [F.asc("none"), F.desc("__id"), F.asc("__h")])
    places = written(places, "fingerprint-order")
    # for each document the one before it in the order, which takes characters from it
    takers = places.select(F.col("__id").alias("to_id"), F.col("__h").alias("to_h"), F.floor(F.col("chars") / 3).alias("third"), ((F.col("place") + 1) % F.col("size")).alias("place"))
    takers = places.select("__id", "__h", "place").join(takers, "place").drop("place")
    own = known.where("copies > 0").join(takers, ["__id", "__h"])
    given = own.select(F.col("to_id").alias("__id"), F.col("to_h").alias("__h"), F.substring("text", F.lit(1), F.col("third").cast("int")).alias("start"), sketch(F.col("text"), k).alias("next"))
    both = known.join(given, ["__id", "__h"])
    kept = F.substring("text", F.lit(1), (F.char_length("text") - F.floor(F.char_length("text") / 3)).cast("int"))
    both = both.withColumns({"edit": F.concat(kept, "start"), "own": sketch(F.col("text"), k)})
    return both.select("doc_id", "text", "copies", "own", "edit", "next")


def compared(docs: DataFrame, k: int = K) -> DataFrame:
    """For every row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and estimates
    of the number of distinct shingles and of the share of the text's shingles that the edited text keeps."""
    rows = edited(docs, k).withColumn("edit_sketch", sketch(F.col("edit"), k))
    own, other, after = F.col("own"), F.col("edit_sketch"), F.col("next")
    out = rows.select(
        "doc_id", "copies", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        told(own).alias("fingerprint"), told(other).alias("edited_fingerprint"), resemblance(own, other, k).alias("near_edited"),
        resemblance(own, after, k).alias("near_next"), distinct(own, k).alias("n_shingles"), containment(own, other, k).alias("kept_shingles"),
    )
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
