"""Spans of patterns as columns: arrays of struct<start, stop, value> with code-point offsets, stop exclusive.

One Arrow function looks for all patterns of a table in one pass over each text and gives offsets and groups as
Python's own regular expressions see them; it knows nothing of what the patterns mean. The rules about what
stands around a match, and all that is done with matches, are Spark's expressions over its result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Anchors that are no words: places where digits begin; where a word begins with a capital and goes on with capitals or a
#: dot; with a capital and no other; where lines begin.
DIGITS, CAPITALS, TITLE, LINES = "0-9", "A-Z", "A-z", "^"
SPAN = "array<struct<start:int,stop:int,value:string>>"
MATCH = "array<struct<rule:int,start:int,stop:int,value:string,key:string>>"
#: What \s is to Python.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
UPPER = "A-ZÁÉÍÓÚÑ"


def digits(*sizes: int, first: str = "") -> str:
    """An anchor: whole runs of digits of some sizes (of any, if none), beginning with one of the first characters."""
    return f"{DIGITS}{first}#{','.join(map(str, sizes))}"


def spaced(*words: str, by: str = WHITE) -> tuple[str, ...]:
    """Anchors: words that a character of white space follows."""
    return tuple(w + c for w in words for c in by)


@dataclass(frozen=True)
class Find:
    """A pattern to look for. `value` is the group whose text is given, `place` the groups that the span begins and ends
    with, `key` a group whose text comes along. `anchors` are folded words with one of which every match begins (or what
    `digits` and the constants above stand for): only there is the pattern tried. With `leads` matches begin so many
    characters before digits; with `run`, a class of characters, at an anchor or where only such characters lead up to one; with
    `first`, a class as well, only at one of these. `hints` are folded words one of which every text with a match holds: texts
    without any are passed over. `inside` is a pattern whose groups 1 are the texts to look in."""

    pattern: str
    value: int = 1
    place: tuple[int, int] = (0, 0)
    key: int | None = None
    ignore_case: bool = False
    multiline: bool = False
    anchors: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    inside: Find | None = None
    leads: tuple[int, ...] = ()
    run: str = ""
    first: str = ""

    @property
    def flags(self) -> int:
        return (re.I if self.ignore_case else 0) | (re.M if self.multiline else 0)


@lru_cache(512)
def _compiled(pattern: str, flags: int) -> re.Pattern:
    return re.compile(pattern, flags)


def _stretch(chars: str, flags: int = 0) -> re.Pattern:
    """Longest stretches of a class; written such that a search skips to its first character."""
    return _compiled(f"{chars}{chars}*", flags)


_ASCII = bytes(range(128))


def folded(text: str) -> str:
    """Lower case such that whatever a pattern may match regardless of case is found as plain lower case. ASCII is folded as
    bytes, other characters one by one as long as a text holds few different ones."""
    if text.isascii():
        return text.lower()
    raw = text.encode("utf-8", "surrogatepass")
    rare = set(raw.translate(None, _ASCII).decode("utf-8", "surrogatepass"))
    if len(rare) > 24:
        return text.replace("İ", "i").replace("ı", "i").casefold()
    out = raw.lower().decode("utf-8", "surrogatepass")
    for c in rare:
        if (x := "i" if c in "İı" else c.casefold()) != c:
            out = out.replace(c, x)
    return out


def _wordy(c: str) -> bool:
    """Whether \\w takes a character."""
    return c.isalnum() or c == "_"


def _special(anchor: str) -> bool:
    return anchor.startswith(DIGITS) or anchor in (CAPITALS, TITLE, LINES)


@dataclass(frozen=True)
class Step:
    """A pattern made ready: a number shared by the finds that search the same, what to search with and where. `marks` are the
    anchors that are no words, `gate` the number of a pattern whose words a text must hold, if there is one."""

    slot: int
    pattern: re.Pattern
    anchors: tuple[str, ...]
    hints: tuple[str, ...]
    inside: Step | None
    leads: tuple[int, ...]
    run: re.Pattern | None
    first: re.Pattern | None
    marks: tuple[str, ...]
    gate: int | None


@lru_cache(256)
def _steps(finds: tuple[Find, ...]) -> tuple[Step, ...]:
    """The steps of a table of patterns; what doesn't depend on a text is settled here once."""
    slots: dict[tuple, int] = {}

    def step(find: Find) -> Step:
        inside = None if find.inside is None else step(find.inside)
        slot = slots.setdefault((find.pattern, find.flags, find.inside), len(slots))
        marks = tuple(a for a in find.anchors if _special(a))
        # every match begins with an anchor, so that a text without any is passed over as one without hints is
        here = () if inside is not None or marks else find.anchors
        gate = inside.gate if inside is not None else slot if here else None
        run = _compiled(f"[{find.run}]", find.flags) if find.run else None
        first = _compiled(f"[{find.first}]", find.flags) if find.first else None
        return Step(slot, _compiled(find.pattern, find.flags), find.anchors, find.hints or here, inside, find.leads, run, first, marks, gate)

    return tuple(step(find) for find in finds)


#: From so many words on they are looked for together.
MANY = 12


@lru_cache(256)
def _index(finds: tuple[Find, ...]) -> ahocorasick.Automaton | None:
    """All words of a table of patterns in one automaton, with the patterns that they anchor; null where they are few."""
    words: dict[str, set[int]] = {}
    steps = [*_steps(finds)]
    while steps:
        step = steps.pop()
        for word in {*step.anchors, *step.hints} - {*step.marks}:
            words.setdefault(word, set()).update([step.slot] if word in step.anchors else [])
        steps += [step.inside] if step.inside else []
    if len(words) < MANY:
        return None
    auto = ahocorasick.Automaton()
    for word, slots in words.items():
        auto.add_word(word, (len(word), word, tuple(slots)))
    auto.make_automaton()
    return auto


class Scanned:
    """One text on its way past the patterns: its folded form, where words begin, what each pattern matched. With an index
    all its words are found in one pass."""

    def __init__(self, text: str, index: ahocorasick.Automaton | None = None):
        self.text, self.fold = text, folded(text)
        self.same = len(self.fold) == len(text)
        self.at: dict[str, list[int]] = {}
        self.seen: dict[int, list[tuple[re.Match, int]]] = {}
        self.runs: dict[re.Pattern, tuple[list[int], list[int]]] = {}
        #: where the anchors of each pattern begin, and the words that the text holds
        self.spots: dict[int, list[int]] | None = None
        self.held: set[str] = set()
        if index is not None:
            self.spots = spots = {}
            for last, (size, word, slots) in index.iter(self.fold):
                self.held.add(word)
                for slot in slots:
                    if slot in spots:
                        spots[slot].append(last + 1 - size)
                    else:
                        spots[slot] = [last + 1 - size]

    def word(self, word: str) -> list[int]:
        """Where a word begins, or what a constant stands for."""
        if (at := self.at.get(word)) is None:
            if _special(word):
                at = self.special(word)
            else:
                at, i, find = [], self.fold.find(word), self.fold.find
                while i >= 0:
                    at.append(i)
                    i = find(word, i + 1)
            self.at[word] = at
        return at

    def stretches(self, pattern: re.Pattern) -> tuple[list[int], list[int]]:
        """Where the longest stretches of a class of characters begin and stop."""
        if (got := self.runs.get(pattern)) is None:
            spans = [m.span() for m in pattern.finditer(self.text)]
            self.runs[pattern] = got = [a for a, _ in spans], [b for _, b in spans]
        return got

    def special(self, anchor: str) -> list[int]:
        text = self.text
        if anchor == LINES:
            return [0, *(m.end() for m in _compiled("\n", 0).finditer(text))]
        if anchor in (CAPITALS, TITLE):
            starts, stops = self.stretches(_stretch(f"[{UPPER}]"))
            more = anchor == CAPITALS
            fits = lambda a, b: (b - a > 1 or text[b : b + 1] == ".") if more else b - a == 1
            return [a for a, b in zip(starts, stops, strict=True) if fits(a, b) and not (a and _wordy(text[a - 1]))]
        starts, stops = self.stretches(_stretch(r"\d"))
        first, _, sizes = anchor[len(DIGITS) :].partition("#")
        wanted = {int(n) for n in sizes.split(",") if n}
        if not first and not wanted:
            return starts
        return [a for a, b in zip(starts, stops, strict=True) if (not wanted or b - a in wanted) and (not first or text[a] in first)]

    def begins(self, step: Step) -> list[int]:
        """The places at which a pattern is tried, rising."""
        if self.spots is None:
            places = [i for w in step.anchors if w not in step.marks for i in self.word(w)]
        else:
            places = self.spots.get(step.slot, [])
        if step.leads:
            return sorted({*places, *(i - n for w in step.marks for i in self.word(w) for n in step.leads if i >= n)})
        if step.marks:
            if len(step.anchors) == 1:
                return self.word(step.anchors[0])
            places = [*places, *(i for w in step.marks for i in self.word(w))]
        if step.run is not None and places:
            return self.led(step, places)
        return sorted(set(places)) if len(places) > 1 else places

    def led(self, step: Step, places: list[int]) -> list[int]:
        """Anchors (unless matches begin with a class of their own) and the places from which a stretch leads up to them: a walk
        back from each anchor, as far as the one before has not been already."""
        within, text = step.run.match, self.text
        spans: list[tuple[int, int]] = []
        for i in sorted(set(places)):
            at, free = i, spans[-1][1] if spans else 0
            while at > free and within(text, at - 1):
                at -= 1
            if spans and at == free:
                at = spans.pop()[0]
            spans.append((at, i))
        if step.first is None:
            return [i for at, stop in spans for i in range(at, stop + 1)]
        return [m.start() for at, stop in spans for m in step.first.finditer(text, at, stop)]

    def search(self, find: Find | Step) -> Iterator[re.Match]:
        """What finditer gives, with the pattern tried at its anchors only."""
        step = _steps((find,))[0] if isinstance(find, Find) else find
        if not step.anchors or not self.same:
            yield from step.pattern.finditer(self.text)
            return
        free, match, text = 0, step.pattern.match, self.text
        for at in self.begins(step):
            if at >= free and (m := match(text, at)):
                yield m
                free = m.end()

    def any_of(self, words: tuple[str, ...]) -> bool:
        if self.spots is not None:
            return not self.held.isdisjoint(words)
        fold = self.fold
        return any(w in fold for w in words)

    def places(self, step: Step) -> list[tuple[re.Match, int]]:
        """Matches with the place in the text that their own offsets count from; one search a pattern."""
        if step.hints and not self.any_of(step.hints):
            return []
        found = self.seen.get(step.slot)
        if found is None:
            if step.inside is None:
                found = [(m, 0) for m in self.search(step)]
            else:
                found = [(m, o.start(1)) for o, _ in self.places(step.inside) for m in step.pattern.finditer(o[1])]
            self.seen[step.slot] = found
        return found


def matches(finds: tuple[Find, ...]) -> Callable[[Column], Column]:
    """A function of a text column: all matches, pattern after pattern, with the pattern's place in the table as rule."""

    @F.arrow_udf(MATCH)
    def run(texts: pa.Array) -> pa.Array:
        steps, index = _steps(finds), _index(finds)
        rule, start, stop, value, key, ends = [], [], [], [], [], [0]
        for text in texts.to_pylist():
            if text:
                scanned = Scanned(text, index)
                spots = scanned.spots
                for i, (find, step) in enumerate(zip(finds, steps, strict=True)):
                    if spots is not None and step.gate is not None and step.gate not in spots:
                        continue
                    for m, at in scanned.places(step):
                        rule.append(i)
                        start.append(at + m.start(find.place[0]))
                        stop.append(at + m.end(find.place[1]))
                        value.append(m[find.value])
                        key.append(None if find.key is None else m[find.key])
            ends.append(len(rule))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        cols = [pa.array(c, k) for c, k in zip((rule, start, stop, value, key), kinds, strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, names=["rule", "start", "stop", "value", "key"]))

    return run


@lru_cache(256)
def _one(find: Find) -> Callable[[Column], Column]:
    return matches((find,))


def plain(found: Column) -> Column:
    """Matches as spans."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value")))


def spans(text: Column, *finds: Find) -> Column:
    """The spans of some patterns, pattern after pattern. Null texts have none."""
    return plain(_one(finds[0])(text) if len(finds) == 1 else matches(finds)(text))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE))


def java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """The pattern for Spark's own regular expressions under the rules of Python: Unicode classes, only \\n ends a line."""
    return f"(?Ud{'iu' if ignore_case else ''}{'m' if multiline else ''}){pattern}"


def empty() -> Column:
    return F.array().cast(SPAN)


class Blocked:
    """A text cut into blocks of 1,024 characters, from which pieces are taken without a walk from the text's first byte to
    where they stand: what is asked of each of many places of a long text costs no more than in a short one."""

    def __init__(self, blocks: Column):
        self.blocks = blocks

    def piece(self, start: Column, n: Column) -> Column:
        first = F.shiftright(start, 10)
        count = F.shiftright(start + F.greatest(n, F.lit(1)) - 1, 10) - first + 1
        return F.substring(F.array_join(F.slice(self.blocks, first + 1, count), ""), start.bitwiseAND(1023) + 1, n)


def blocked(text: Column, value: Column, use: Callable[[Column, Blocked], Column]) -> Column:
    """use(value, text in blocks), both computed once."""
    cut = F.transform(F.sequence(F.lit(0), F.length(text), F.lit(1024)), lambda at: F.substring(text, at + 1, F.lit(1024)))
    return let(F.struct(value.alias("value"), cut.alias("blocks")), lambda both: use(both["value"], Blocked(both["blocks"])))


def _piece(text: Column | Blocked, start: Column, n: Column) -> Column:
    return text.piece(start, n) if isinstance(text, Blocked) else F.substring(text, start + 1, n)


def before(text: Column | Blocked, span: Column, n: int) -> Column:
    """Up to n characters that precede the span."""
    start = F.greatest(span["start"] - n, F.lit(0))
    return _piece(text, start, span["start"] - start)


def after(text: Column | Blocked, span: Column, n: int) -> Column:
    return _piece(text, span["stop"], F.lit(n))


def around(text: Column | Blocked, span: Column, n: int) -> Column:
    """The span with up to n characters on either side."""
    start = F.greatest(span["start"] - n, F.lit(0))
    return _piece(text, start, span["stop"] - start + n)


@lru_cache(256)
def tree(words: tuple[str, ...], whole: bool = False) -> str:
    """A pattern of any of the words, as they are, written as a tree of their letters: at each place only the words that go on
    as the text does are followed. Unless they are to be met `whole`, a word that begins with another adds nothing."""
    nodes: dict = {}
    for word in words:
        at = nodes
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        if "" in at and (not whole or len(at) == 1):
            return ""
        ways = [(c if c.isalnum() else f"\\{c}") + written(below) for c, below in at.items() if c]
        return f"(?:{'|'.join(ways)}){'?' if '' in at else ''}" if len(ways) > 1 or "" in at else ways[0]

    return written(nodes)


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a text holds any of the words, as they are: one pass, which stops only where one of them may begin."""
    words = tuple(words)
    first = "".join(c if c.isalnum() else f"\\{c}" for c in sorted({w[:1] for w in words}))
    return text.rlike(f"(?=[{first}]){tree(words)}")


def is_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a text is one of the words."""
    return text.rlike(rf"\A{tree(tuple(words), True)}\z")


def keep(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(array, test)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns computed once for each row, however often later columns use them: a generator of one element is
    a place that the optimizer neither copies expressions through nor moves Python functions past."""
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__settled")
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, one).select(*kept, "__settled.*")
