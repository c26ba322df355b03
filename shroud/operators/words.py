"""A document as words, and words as classes: what every walk over a text reads.

A reading holds a text's words, where they begin, and the gap before each as one character: blank, line break, page break,
or both. What a word is (a title, a capital, a number …) hangs on its letters alone, so it is worked out once a word in
each worker and kept, for all languages at once; a document then is a string of classes, and a rule a regular expression
over that string.
Offsets are code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate, chain

GENERAL, VAULT, LANGUAGE, HAND = "GeneralRule", "Vault", "LanguagePack", "Hand"
# Characters at the edges of a word, characters that a reader doesn't see.
EDGE, EDGE_BUT_DOT = ',;:.!?"()»«', ',;:!?"()»«'
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0xFEFF])
_PAIR = re.compile(r"(\s*+)(\S++)")
_VALUE = re.compile(r"(?:[^\W_]|[+@.\-/])(?:.*(?:[^\W_]|[+@.\-/]))?", re.DOTALL)


@dataclass
class Hit:
    start: int
    end: int
    kind: str
    sure: bool
    source: str
    rule: str
    also: list[str] = field(default_factory=list)
    entities: list[int] = field(default_factory=list)


def nfc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFC", s)


def as_read(s: str) -> str:
    """Without invisible characters, composed."""
    return s if s.isascii() else unicodedata.normalize("NFC", s.translate(_INVISIBLE))


def capital(s: str) -> bool:
    return s[:1].isupper()


def numberish(value: str) -> bool:
    """Digits and the marks that numbers are written with, one digit at least."""
    return any(map(str.isdigit, value)) and all(c.isdigit() or c in "+-/.()" for c in value)


class _Gaps(dict):
    def __missing__(self, space: str) -> str:
        code = (" ", "\n", "\f", "\v")[("\n" in space) + 2 * ("\f" in space)]
        if len(self) < 10_000:
            self[space] = code
        return code


_gaps = _Gaps()


def value_of(text: str) -> str:
    """A word without the marks at its edges, but for + @ . - / which values have."""
    if text.isalnum():
        return text
    m = _VALUE.search(text)
    return m[0].rstrip(",;.):") if m else ""


def is_number(text: str) -> bool:
    return not text.isalpha() and numberish(value_of(text))


@dataclass(slots=True)
class Word:
    """A word in its place, for rules that look at few of them. `value` keeps + @ . - / at its edges, as labels need."""

    at: int
    start: int
    text: str
    space: str

    @property
    def breaks(self) -> bool:
        return "\n" in self.space

    @property
    def wide(self) -> bool:
        """Whether a column's gap stands before it."""
        return len(self.space) > 1 or "\t" in self.space

    @property
    def bare(self) -> str:
        return self.text.strip(EDGE)

    @property
    def value(self) -> str:
        return value_of(self.text)

    @property
    def value_end(self) -> int:
        return self.start + len(self.text.rstrip(",;.):"))

    @property
    def labelling(self) -> bool:
        return self.text.endswith(":")


class Reading:
    """Only words and gaps are made at once; where words stand is worked out for texts in which a rule asks for it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words = text.split()
        self.gaps = "".join(map(_gaps.__getitem__, self.spaces)) if "\n" in text or "\f" in text else " " * len(self.words)
        self.runs: list | None = None  # of number words, read when a rule asks for them
        self.run_sizes: frozenset[int] = frozenset()  # how many characters those have

    @cached_property
    def spaces(self) -> list[str]:
        return [s for s, _ in _PAIR.findall(self.text)]

    @cached_property
    def ends(self) -> list[int]:
        return list(accumulate(map(len, chain.from_iterable(zip(self.spaces, self.words, strict=True)))))[1::2]

    @cached_property
    def starts(self) -> list[int]:
        return [z - len(w) for z, w in zip(self.ends, self.words, strict=True)]

    def word(self, k: int) -> Word | None:
        return Word(k, self.starts[k], self.words[k], self.spaces[k]) if 0 <= k < len(self.words) else None

    def on_line(self, k: int) -> Word | None:
        """The word, if it stands on the line of the one before."""
        return self.word(k) if k < len(self.words) and self.gaps[k] not in "\n\v" else None

    def bare_end(self, k: int) -> int:
        """Where a word ends without the marks after it."""
        return self.starts[k] + len(self.words[k].rstrip(EDGE))

    @cached_property
    def digits(self) -> list[int]:
        return list(map(_digits.__getitem__, self.words))

    @cached_property
    def numbers(self) -> list[int]:
        """Words that have digits."""
        return [k for k, n in enumerate(self.digits) if n]

    def spelled(self, letters: str) -> str:
        """Gap and letter of each word in turn: what the rules' expressions run over."""
        both = [""] * (2 * len(letters))
        both[::2], both[1::2] = self.gaps, letters
        return "".join(both)

    def plain(self, hits: list[Hit]) -> int:
        """Words that no hit touches."""
        touched, k, n = 0, 0, len(self.words)
        if not hits:
            return n
        for a, z in sorted((h.start, h.end) for h in hits):
            while k < n and self.starts[k] < z:
                touched += self.ends[k] > a
                k += 1
        return n - touched


class Kept(dict):
    """What a function gives for a word, kept for the next time; emptied when it has grown large."""

    def __init__(self, of: Callable[[str], object], most: int = 100_000) -> None:
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        self[word] = made = self.of(word)
        return made


_digits = Kept(lambda w: 0 if w.isalpha() else sum(map(str.isdigit, w.strip(EDGE))))


@dataclass(slots=True)
class Form:
    """A word in the forms that facts are asked of."""

    text: str
    bare: str
    dotted: str
    low: str
    dotted_low: str
    read: str
    number: bool

    @classmethod
    def of(cls, text: str) -> Form:
        bare, dotted = text.strip(EDGE), text.strip(EDGE_BUT_DOT)
        return cls(text, bare, dotted, bare.lower(), dotted.lower(), as_read(bare), is_number(text))


class Facts:
    """What one set of rules wants to know of words, as bits; `bits` follows the numbers of the lexer's classes."""

    def __init__(self, of: Callable[[Form], int], words: frozenset) -> None:
        self.of, self.words, self.bits = of, words, []

    def present(self, classes: str) -> int:
        """All facts that some word of a document has."""
        if not classes.strip("\0"):
            return 0
        out = 0
        for c in set(classes):
            out |= self.bits[ord(c)]
        return out


class Lexer:
    """Words that are alike for every set of rules share a character, so a document is a string of classes, made once for
    all. A word in small letters that no set lists is of class 0, which has no facts."""

    def __init__(self, *facts: Facts) -> None:
        self.facts, self.number = facts, {}
        self.listed = frozenset().union(*(f.words for f in facts))
        self._class(tuple(0 for _ in facts))
        self.kept = Kept(self._character)

    def _class(self, bits: tuple[int, ...]) -> str:
        if bits not in self.number:
            self.number[bits] = len(self.number)
            for f, b in zip(self.facts, bits, strict=True):
                f.bits.append(b)
        return chr(self.number[bits])

    def _character(self, word: str) -> str:
        bare = word.strip(EDGE)
        if not capital(bare) and (word.isascii() or word.islower()) and bare.lower() not in self.listed and word.strip(EDGE_BUT_DOT).lower() not in self.listed:
            return "\0"
        form = Form.of(word)
        return self._class(tuple(f.of(form) for f in self.facts))

    def of(self, doc: Reading) -> str:
        return "".join(map(self.kept.__getitem__, doc.words))


class Letters(dict):
    """A rule's alphabet: from a class's character to the letter of the first test that its facts pass, else x."""

    def __init__(self, facts: Facts, *tests: tuple[str, Callable[[int], object]]) -> None:
        super().__init__()
        self.facts, self.tests = facts, tests

    def __missing__(self, number: int) -> str:
        bits = self.facts.bits[number]
        self[number] = letter = next((x for x, test in self.tests if test(bits)), "x")
        return letter


class Marks(dict):
    """An alphabet for words that are several things at once: a letter for each combination of the tests."""

    def __init__(self, facts: Facts, *tests: Callable[[int], object]) -> None:
        super().__init__()
        self.facts, self.tests = facts, tests

    def __missing__(self, number: int) -> str:
        bits = self.facts.bits[number]
        self[number] = letter = chr(0x100 + sum(1 << k for k, test in enumerate(self.tests) if test(bits)))
        return letter

    @staticmethod
    def of(letter: str) -> int:
        """Which tests a letter stands for, as bits."""
        return ord(letter) - 0x100

    def some(self, *which: int) -> str:
        """A class of an expression: letters of words that pass any of these tests."""
        return "[" + "".join(chr(0x100 + n) for n in range(1 << len(self.tests)) if any(n >> k & 1 for k in which)) + "]"

    def all(self, *which: int, without: tuple[int, ...] = ()) -> str:
        """A class of an expression: letters of words that pass all of these tests and none of those."""
        every = range(1 << len(self.tests))
        return "[" + "".join(chr(0x100 + n) for n in every if all(n >> k & 1 for k in which) and not any(n >> k & 1 for k in without)) + "]"
