"""License scan: license templates with markup, compiled into automata over words.

A template is wording with markup. ``<<beginOptional>>...<<endOptional>>`` may
be absent; ``<<var;words="0-40">>`` stands for any words, so many of them;
``<<any="released|made available">>`` for one of several wordings. All else is
mandatory and has to match word by word; letter case of A-Z, punctuation and
white space don't count. All templates, and the plain phrases beside them, are
one nondeterministic automaton whose sets of states are worked out as texts
bring them up. It is started at each word that some template can begin with, and
a start is given up as soon as no template can go on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices, unlike
from tidemark.llm.decontamination import words
from tidemark.llm.license_templates import PHRASES, TEMPLATES

#: Words that a replaceable region may have at most, and has unless the template says otherwise.
LONGEST_GAP, USUAL_GAP = 200, (1, 20)
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Sets of states that a worker remembers.
KEPT_SETS = 50_000

_TAG = re.compile(r"<<(.*?)>>", re.S)
_WIDTH = re.compile(r'words="(\d+)-(\d+)"')


@dataclass(frozen=True)
class Template:
    """label: what a match gives the document; markup: its wording; base: whether it is one of the plain phrases."""

    label: str
    markup: str
    base: bool = False


@dataclass
class _Nfa:
    """Steps by state: on a word, on any word, on none; ends: which template each final state accepts."""

    on: list[dict[bytes, int]] = field(default_factory=list)
    wild: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)

    def state(self) -> int:
        self.on.append({})
        self.wild.append(None)
        self.free.append([])
        return len(self.on) - 1

    def wording(self, at: int, text: str) -> int:
        for w in words(text):
            to = self.on[at].get(w)
            if to is None:
                to = self.on[at][w] = self.state()
            at = to
        return at

    def gap(self, at: int, low: int, high: int) -> int:
        if not 0 <= low <= high <= LONGEST_GAP:
            raise ValueError(f"a replaceable region of {low} to {high} words; at most {LONGEST_GAP} are possible")
        out = self.state()
        for k in range(high + 1):
            here = self.state()  # a fresh one: nothing else leads into the count
            if k:
                self.wild[at] = here
            else:
                self.free[at].append(here)
            at = here
            if k >= low:
                self.free[at].append(out)
        return out


def _tokens(markup: str) -> list[tuple[str, object]]:
    out, at = [], 0
    for tag in _TAG.finditer(markup):
        out.append(("words", markup[at : tag.start()]))
        kind = tag[1].strip()
        if kind in ("beginOptional", "endOptional"):
            out.append((kind, None))
        elif kind.startswith("var"):
            width = _WIDTH.search(kind)
            out.append(("gap", (int(width[1]), int(width[2])) if width else USUAL_GAP))
        elif choice := re.fullmatch(r'any="(.*)"', kind, re.S):
            out.append(("any", choice[1].split("|")))
        else:
            raise ValueError(f"unknown markup <<{kind}>>")
        at = tag.end()
    return [*out, ("words", markup[at:])]


def _compile(nfa: _Nfa, markup: str) -> tuple[int, int, int, int]:
    """First and last state of a template, its fewest fixed words, and its most words of any kind."""
    start = at = nfa.state()
    fixed = most = 0
    open_at: list[tuple[int, int]] = []
    for kind, value in _tokens(markup):
        if kind == "words":
            n = len(words(value))
            joint = nfa.state()  # so that wordings before and after a branch don't share states
            nfa.free[at].append(joint)
            at, fixed, most = nfa.wording(joint, value), fixed + n, most + n
        elif kind == "gap":
            at, most = nfa.gap(at, *value), most + value[1]
        elif kind == "any":
            out = nfa.state()
            for choice in value:
                first = nfa.state()
                nfa.free[at].append(first)
                nfa.free[nfa.wording(first, choice)].append(out)
            at, fixed, most = out, fixed + min(len(words(c)) for c in value), most + max(len(words(c)) for c in value)
        elif kind == "beginOptional":
            open_at.append((at, fixed))
        else:
            if not open_at:
                raise ValueError("endOptional without beginOptional")
            before, fixed = open_at.pop()
            out = nfa.state()
            nfa.free[at].append(out)
            nfa.free[before].append(out)
            at = out
    if open_at:
        raise ValueError("beginOptional without endOptional")
    if not fixed:
        raise ValueError("a template without mandatory words")
    return start, at, fixed, most


class Automaton:
    """All templates in one; ``find`` gives their matches in a text."""

    def __init__(self, templates: list[Template]):
        self.templates, self.nfa = templates, _Nfa()
        starts, self.fixed, self.longest = [], [], 1
        for k, template in enumerate(templates):
            start, end, fixed, most = _compile(self.nfa, template.markup)
            starts.append(start)
            self.nfa.ends[end] = k
            self.fixed.append(fixed)
            self.longest = max(self.longest, most)
        self.first = self._closed(starts)
        #: words that a template can begin with; None if one begins with any word
        self.openers = None if any(self.nfa.wild[s] is not None for s in self.first) else {w for s in self.first for w in self.nfa.on[s]}
        self.known = {w for on in self.nfa.on for w in on}
        self._forget()

    def _forget(self) -> None:
        self.sets: dict[tuple, int] = {(): 0}
        self.members: list[tuple] = [()]
        self.steps: list[dict] = [{}]
        self.accepts: list[tuple] = [()]
        self.begin = self._number(self.first)

    def _closed(self, states) -> tuple:
        found, todo = set(states), list(states)
        while todo:
            for s in self.nfa.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return tuple(sorted(found))

    def _number(self, states: tuple) -> int:
        k = self.sets.get(states)
        if k is None:
            k = self.sets[states] = len(self.members)
            self.members.append(states)
            self.steps.append({})
            self.accepts.append(tuple(self.nfa.ends[s] for s in states if s in self.nfa.ends))
        return k

    def _step(self, at: int, word: bytes | None) -> int:
        on, wild = self.nfa.on, self.nfa.wild
        to = {on[s][word] for s in self.members[at] if word in on[s]} | {wild[s] for s in self.members[at] if wild[s] is not None}
        k = self.steps[at][word] = self._number(self._closed(to))
        return k

    def matches(self, text: list[bytes], first: int) -> dict[int, int]:
        """The longest match of each template that begins at a word: its number, and the word after its end."""
        if len(self.members) > KEPT_SETS:
            self._forget()
        at, found, steps, known = self.begin, {}, self.steps, self.known
        for i in range(first, len(text)):
            word = text[i] if text[i] in known else None
            to = steps[at].get(word)
            at = self._step(at, word) if to is None else to
            if not at:
                break
            for k in self.accepts[at]:
                found[k] = i + 1
        return found

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
        """The number of a text's words, and (first word, word after the last, template) of all matches, in order.

        The text is cut into words a piece at a time; a piece is followed by as
        many words as the longest template can have.
        """
        n, found, held = 0, [], []
        for piece, last in _pieces(text or ""):
            held += words(piece)
            safe = len(held) if last else max(0, len(held) - self.longest)
            openers = self.openers
            for i in range(safe) if openers is None else [i for i, w in enumerate(held[:safe]) if w in openers]:
                found += [(n + i, n + end, k) for k, end in self.matches(held, i).items()]
            n += safe
            del held[:safe]
        return n, found


def _pieces(text: str):
    """text in pieces that end between words, and whether a piece is the last."""
    at = 0
    while len(text) - at > PIECE:
        gap = _BREAK.search(text, at + PIECE)
        if gap is None:
            break
        yield text[at : gap.end()], False
        at = gap.end()
    yield text[at:], True


_BREAK = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def widest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches that lie inside no longer one, in order; of equally wide ones all stay."""
    out, reach, begins = [], -1, -1
    for first, end, k in sorted(found, key=lambda m: (m[0], -m[1], m[2])):
        if end > reach or (end == reach and first == begins):
            out.append((first, end, k))
            reach, begins = end, first
    return out


_RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))),
    ]
)


def judge(automaton: Automaton, text: str | None) -> tuple:
    """The result columns of one text."""
    n, found = automaton.find(text)
    base = [m for m in found if automaton.templates[m[2]].base]
    own = widest([m for m in found if not automaton.templates[m[2]].base])
    label = lambda ms: {automaton.templates[k].label for _, _, k in ms}
    starts = [m[0] for m in base]
    most = max((automaton.fixed[k] for _, _, k in [*base, *own]), default=0)
    spans = [{"label": automaton.templates[k].label, "first_word": a, "n_words": b - a} for a, b, k in own]
    return (
        n,
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(label(base))),
        ",".join(sorted(label(base) | label(own))),
        most / (most + 2.0),
        spans,
    )


def _scan(templates: list[Template], keep: list[str], text_col: str):
    made: list[Automaton] = []

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(_RESULT)
        if not made:
            made.append(Automaton(templates))
        for batch in (part for whole in batches for part in slices(whole)):
            rows = [judge(made[0], t) for t in batch.column(text_col).to_pylist()]
            out = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *out], [*keep, *_RESULT.names])

    return run


def scan(docs: DataFrame, keep: list[str] | None = None, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """The licenses that each document names or states; one row per row of docs, without a shuffle.

    templates: markup by label; phrases: label by plain wording (both as in
    ``license_templates`` unless given). Returns the columns ``keep`` of docs (all
    unless given), then n_words, n_base (places where a phrase stands),
    first_word and last_word (the smallest and largest start of one, from 0,
    else null), base_labels and labels (distinct, sorted, joined by commas; the
    phrases' alone, and with the templates'), score (m / (m + 2), m the most
    mandatory words of an accepted template or phrase; 0 without one) and spans
    (label, first word and number of words of each template's match). A match
    that lies inside a longer template's match is not reported: of "version 3 or
    any later version" only the whole counts. Phrases count at all places.

    A null or empty text has no words, no labels and score 0. Rows that repeat
    a document have equal results, an empty table gives an empty one. Of
    templates that match equally far all labels count. A text of any length is
    read whole, a piece at a time. A kept column with the name of a result gives
    way to it; further columns are not read.
    """
    made = [Template(label, markup, True) for markup, label in (PHRASES if phrases is None else phrases).items()]
    made += [Template(label, markup) for label, several in (TEMPLATES if templates is None else templates).items() for markup in several]
    Automaton(made)  # errors of markup show here, not in tasks
    keep = unlike(docs.columns if keep is None else keep, _RESULT.names)
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*[fields[c] for c in keep], *_RESULT.fields])
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])]).mapInArrow(_scan(made, keep, text_col), schema)
