"""Values after labels and in the columns of tables, by the label rows of the languages and those that a person taught."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, dropwhile, groupby, islice

from .lexicon import LabelRow
from .words import Hit, Kept, Reading, Word, capital, nfc, numberish

# Words between a label and its number.
NUMBER_WORDS = frozenset({"nr", "nr.", "-nr", "-nr.", "nummer"})
MOST_WORDS, MOST_LABEL_WORDS = 8, 4
_CELL = re.compile(r"[^\t ]+(?: [^\t ]+)*")
_REFERENCE = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9/-]+")
_DATE = re.compile(r"(?=.*[0-9]{2})[0-9]{1,4}[/.\-][0-9]{1,4}[/.\-][0-9]{1,4}")
_INSURANCE = re.compile(r"[A-Za-z]{2}[0-9]{6}[A-Za-z]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9.-]*\.)[A-Za-z]{2,}")


def _group(s: str) -> bool:
    return s.isalnum() and (any(map(str.isdigit, s)) or not any(map(str.islower, s)))


#: By validator: how many words a value has at most, whether a word can be its first, whether it can be a further one, and
#: what the whole has to be.
_ONE = 1
_SHAPES: dict[str, tuple[int, Callable[[str], bool], Callable[[str], bool], Callable[[str], bool]]] = {
    "Number": (MOST_WORDS, lambda v: numberish(v) or (v[:1] == "+" and len(v) > 1), numberish, bool),
    "Word": (_ONE, bool, bool, bool),
    "Any": (_ONE, bool, bool, bool),
    "Mail": (_ONE, lambda v: bool(_EMAIL.fullmatch(v)), bool, bool),
    "Grouped": (MOST_WORDS, _group, _group, bool),
    "NationalInsurance": (MOST_WORDS, _group, _group, lambda v: bool(_INSURANCE.fullmatch(re.sub("[ -]", "", v)))),
    "Reference": (_ONE, lambda v: bool(_REFERENCE.fullmatch(v)), bool, lambda v: bool(_REFERENCE.fullmatch(v))),
    "Date": (_ONE, numberish, bool, lambda v: bool(_DATE.fullmatch(v.strip()))),
    "Name": (4, capital, capital, bool),
    "NamePair": (4, capital, capital, bool),
}
_NAMES, _STOP_AT_LABEL, _STOP_AT_GAP = ("Name", "NamePair"), ("Grouped", "Name", "NamePair"), ("Number", "Grouped")


class Labels:
    """Label rows made ready: prose takes the last row of a label, tables the first."""

    def __init__(self, rows: list[LabelRow]) -> None:
        self.rows = list(rows)
        self.last = {r.label: r for r in self.rows}
        self.first = {r.label: r for r in reversed(self.rows)}
        tails = {r.label.split()[-1] for r in self.rows if r.label.split()}
        self.widest = min(MOST_LABEL_WORDS, max((len(r.label.split()) for r in self.rows), default=1))
        self._tail = Kept(lambda w: self.key(w) in tails)

    def __reduce__(self):
        return Labels, (self.rows,)

    @staticmethod
    def key(written: str) -> str:
        return nfc(written.rstrip(":")).lower()

    def names(self, written: str) -> bool:
        bare = written.strip(",;.():")
        return self.key(bare) in self.last or (bare != written and self.key(written) in self.last)

    def hits(self, doc: Reading, honorifics: frozenset) -> Iterator[Hit]:
        for k in (k for k, tail in enumerate(map(self._tail.__getitem__, doc.words)) if tail):
            if (row := self._ending_at(doc, k)) and (span := self._value(doc, k, row, honorifics)):
                yield Hit(*span, row.kind, row.decision == "auto", row.source, row.id)
        if "\t" in doc.text or "  " in doc.text:
            yield from self._columns(doc.text)

    def _ending_at(self, doc: Reading, k: int) -> LabelRow | None:
        """The longest label that ends with this word, on one line."""
        least = k
        while least > 0 and k - least + 1 < self.widest and doc.gaps[least] not in "\n\v":
            least -= 1
        written = (self.key(" ".join(doc.words[a : k + 1])) for a in range(least, k + 1))
        return next((self.last[w] for w in written if w in self.last), None)

    def _value(self, doc: Reading, k: int, row: LabelRow, honorifics: frozenset) -> tuple[int, int] | None:
        """Where the value after a label stands: as many words of its line as fit the row's validator."""
        kind = row.validator
        most, first_fits, more_fit, whole = _SHAPES[kind]
        passed = lambda w, words: nfc(w.value).lower() in words or w.text.lower() in words
        line = _line_after(doc, k)
        first = next(line, None)
        if first and (passed(first, NUMBER_WORDS) or first.text.lower().strip(",;:()") in NUMBER_WORDS):
            first = next(line, None)
        line = chain([first] if first else [], line)
        words = list(islice(dropwhile(lambda w: passed(w, honorifics), line) if kind == "Name" else line, MOST_WORDS))
        if not words or not (doc.words[k].endswith(":") or _proves_itself(words[0].value, kind)):
            return None
        n = 0
        for n, w in enumerate([*words, None]):  # noqa: B007
            if w is None or n >= most or not (more_fit if n else first_fits)(w.value) or self._stops(w, n, kind):
                break
            if kind in _NAMES and n and w.text.endswith(","):
                n += 1
                break
        if not n or (kind == "NamePair" and n < 2):
            return None
        span = words[0].start, words[n - 1].value_end
        return span if whole(doc.text[slice(*span)]) else None

    def _stops(self, w: Word, n: int, kind: str) -> bool:
        """Whether another label or a column's gap ends a value before this word."""
        if w.labelling and self.key(w.text) in self.last:
            return True
        return n > 0 and ((kind in _STOP_AT_LABEL and self.names(w.text)) or (kind in _STOP_AT_GAP and w.wide))

    def _columns(self, text: str) -> Iterator[Hit]:
        """Tables: neighbouring lines with as many cells, of which the first with a label's cell is the header.

        A cell belongs to the header cell that it begins under, give or take two characters, and stands where it stands
        (not at the first equal text of its line).
        """
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append([(at, m.start(), m[0]) for m in _CELL.finditer(line)])
            at += len(line) + 1
        for n, block in groupby(lines, len):
            if n < 2:
                continue
            for head in block:
                if heads := [(column, row) for _, column, cell in head if (row := self.first.get(self.key(cell.strip())))]:
                    break
            for cells in block:
                for column, row in heads:
                    for line_at, place, cell in cells:
                        if abs(place - column) <= 2 and (value := _in_cell(cell, row.validator)):
                            start = line_at + place + cell.find(value)
                            yield Hit(start, start + len(value), row.kind, row.decision == "auto", row.source, row.id)


def _line_after(doc: Reading, k: int) -> Iterator[Word]:
    while w := doc.on_line(k := k + 1):
        yield w


def _proves_itself(value: str, kind: str) -> bool:
    """Whether a value may follow a label that has no colon: it has a digit, or is one long group of capitals."""
    return bool(re.search("[0-9]", value)) or (kind == "Grouped" and len(value) >= 8 and _group(value) and not re.search("[a-z]", value))


def _in_cell(cell: str, kind: str) -> str | None:
    """What a cell holds, if it fits the column's validator."""
    words = Reading(cell)
    value = cell.strip().rstrip(",;.):")
    most, first_fits, more_fit, whole = _SHAPES[kind]
    if not words.words or not value or (kind == "NamePair" and len(words.words) < 2) or not whole(value):
        return None
    values = [words.word(k).value for k in range(min(len(words.words), 1 if most == _ONE else MOST_WORDS))]
    fit = len(values) <= most and first_fits(values[0]) and all(map(more_fit, values[1:]))
    return value if fit else None
