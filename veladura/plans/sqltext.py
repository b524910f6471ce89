"""Pieces of the comparison SQL (DuckDB): spans by prefix sums, context windows, word tests."""

from __future__ import annotations

from collections.abc import Iterable

from .legal_text import SQL as LEGAL


def quoted(text: str) -> str:
    return text.replace("'", "''")


def spans(pattern: str, group: int = 1, at: str = "match", src: str = "lt") -> str:
    """SELECT doc_id, text, start, stop, value of all matches; start counts from 0."""
    p = quoted(pattern)
    size = "lambda x: length(x)"
    a = f"coalesce(list_sum(list_transform(g[1:i], {size})), 0) + coalesce(list_sum(list_transform(w[1:i-1], {size})), 0)"
    start = "a + length(w[i]) - length(v[i])" if at == "last" else "a"
    stop = "a + length(v[i])" if at == "first" else "a + length(w[i])"
    return f"""SELECT doc_id, text, CAST({start} AS INTEGER) AS start, CAST({stop} AS INTEGER) AS stop, v[i] AS value
FROM (SELECT *, {a} AS a FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT doc_id, text, regexp_extract_all(text, '{p}', 0) AS w, regexp_extract_all(text, '{p}', {group}) AS v, regexp_split_to_array(text, '{p}') AS g FROM {src})))"""


def with_legal(rest: str) -> str:
    return f"WITH lt AS ({LEGAL}) {rest}"


def before(n: int) -> str:
    return f"substr(text, greatest(start - {n}, 0) + 1, start - greatest(start - {n}, 0))"


def after(n: int) -> str:
    return f"substr(text, stop + 1, {n})"


def around(n: int) -> str:
    return f"substr(text, greatest(start - {n}, 0) + 1, stop + {n} - greatest(start - {n}, 0))"


def has_any(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{quoted(w)}')" for w in words) + ")"
