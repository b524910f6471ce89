"""Many terms in one pass over a text: an Aho-Corasick automaton finds them, claims by priority settle overlaps.

Time follows the text, the terms and the places found, not terms times text. Places are code points, stop exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable

import ahocorasick

#: Characters that make a boundary where none stands on either side: a fixed value.
WORD = r"A-Za-z0-9_À-ɏ\-"
_WORD = re.compile(f"[{WORD}]")


#: Characters that aren't ASCII: they are folded one by one, all others together.
_RARE = re.compile(r"([^\x00-\x7f]+)")


class _Folds(dict):
    """Of each character met its lower case, or the character where that would be several."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = x if len(x := c.upper()) == 1 and len(x := x.lower()) == 1 else c
        return self[code]


_FOLDS = _Folds()


def folded(text: str) -> str:
    """Lower case character by character, so that places stay; characters that would become several stay as they are."""
    if text.isascii():
        return text.lower()
    parts = _RARE.split(text)
    parts[::2] = [p.lower() for p in parts[::2]]
    parts[1::2] = [p.translate(_FOLDS) for p in parts[1::2]]
    return "".join(parts)


class Terms:
    """An automaton over terms; `any_case` says of each whether it is found in any case: only then texts are folded. Empty
    terms are found nowhere."""

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.terms = list(terms)
        self.fold = any(any_case for term, any_case in self.terms if term)
        keys: dict[str, list[int]] = {}
        for i, (term, _) in enumerate(self.terms):
            if term:
                keys.setdefault(folded(term) if self.fold else term, []).append(i)
        self.auto = ahocorasick.Automaton()
        for key, own in keys.items():
            self.auto.add_word(key, (len(key), own))
        if keys:
            self.auto.make_automaton()
        self.found_any = bool(keys)

    def places(self, text: str) -> dict[int, list[int]]:
        """For each term found, where it begins, rising."""
        out: dict[int, list[int]] = {}
        if self.found_any and text:
            for last, (size, own) in self.auto.iter(folded(text) if self.fold else text):
                start = last + 1 - size
                for i in own:
                    term, any_case = self.terms[i]
                    if any_case or not self.fold or text.startswith(term, start):
                        out.setdefault(i, []).append(start)
        return out


#: Up to so many characters times terms a search term by term costs less than an automaton over all of them.
SMALL = 1 << 20


def present(text: str, terms: Iterable[tuple[int, str, bool]], n: int) -> list[int]:
    """The keys of the n terms (key, term, any_case) that may stand in a text. In a small text every term is looked for,
    so that an automaton holds no more than what is there; in a large one they are all left to it."""
    if len(text) * n > SMALL:
        return [key for key, _, _ in terms]
    low = folded(text)
    return [key for key, term, any_case in terms if (folded(term) in low if any_case else term in text)]


class Claims:
    """Disjoint spans of a text, each with what stands for it."""

    def __init__(self, text: str):
        self.text, self.starts = text, []
        self.spans: dict[int, tuple[int, str]] = {}
        self.stops: dict[int, str] = {}

    def free(self, start: int, stop: int) -> bool:
        at = bisect_left(self.starts, start)
        if at < len(self.starts) and self.starts[at] < stop:
            return False
        return not at or self.spans[self.starts[at - 1]][0] <= start

    def bounded(self, start: int, stop: int) -> bool:
        """Whether no word goes on at either side; beside a claimed span that is its token's side."""
        left = self.stops[start][-1:] if start in self.stops else self.text[start - 1 : start] if start else ""
        right = self.spans[stop][1][:1] if stop in self.spans else self.text[stop : stop + 1]
        return not (_WORD.match(left) or _WORD.match(right))

    def put(self, start: int, stop: int, token: str) -> None:
        insort(self.starts, start)
        self.spans[start] = (stop, token)
        self.stops[stop] = token

    def replaced(self) -> str:
        parts, at = [], 0
        for start in self.starts:
            stop, token = self.spans[start]
            parts += [self.text[at:start], token]
            at = stop
        return "".join(parts) + self.text[at:]


def claimed(text: str, values: list[dict]) -> Claims:
    """Spans of values (value, token, soft, type): those that aren't soft first, then the longest, then by value. Soft ones
    need a boundary on both sides; addresses are found in any case. What a token stands for is never looked into again."""
    order = sorted(values, key=lambda v: (bool(v["soft"]), -len(v["value"] or ""), v["value"] or "", v["token"] or ""))
    places = Terms((v["value"] or "", not v["soft"] and v["type"] == "EMAIL") for v in order).places(text)
    claims = Claims(text)
    for i in sorted(places):
        v, free = order[i], 0
        for start in places[i]:
            stop = start + len(v["value"])
            if start >= free and claims.free(start, stop) and (not v["soft"] or claims.bounded(start, stop)):
                claims.put(start, stop, v["token"] or "")
                free = stop
    return claims
