"""Places of known values in a text: any case, any white space, a line's end hyphen inside a word, whole words only.

Many spellings are looked up at once by their first stretch of letters and digits, as a place of one begins with just that
stretch; only spellings whose first stretch the text has are searched for. Spellings in scripts that join words (Arabic, and
those without spaces) go by their first three characters, as they may begin or end inside a stretch.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from .words import VAULT, Hit, nfc

# Scripts without spaces between words, Arabic prefixes, hyphens.
_OPEN = [("฀", "໿"), ("က", "႟"), ("ក", "៿"), ("぀", "ヿ"), ("㐀", "鿿"), ("가", "힯")]
_CLITICS = "وبلفك"
_HYPHENS = "-‐‑‒–"
_STRETCH = re.compile(r"[^\W_]+")
_BROKEN = re.compile("[-‐­]\n")
_ONE_I = {0x130: "i", 0x131: "i", 0x345: " "}


def _alone(text: str, a: int, z: int) -> bool:
    """Whether a place is a word of its own, as its script has words."""
    first = text[a]
    if any(lo <= first <= hi for lo, hi in _OPEN):
        return True
    if "؀" <= first <= "ۿ":
        while a > 0 and text[a - 1] in _CLITICS:
            a -= 1
        return not text[a - 1 : a].isalnum()
    while z < len(text) and unicodedata.combining(text[z]):
        z += 1
    return not text[z : z + 1].isalnum() and not text[a - 1 : a].isalnum()


@lru_cache(20_000)
def _blind(needle: str) -> re.Pattern:
    parts = []
    for k, c in enumerate(needle):
        if c.isspace():
            parts.append(r"\s+" if k == 0 or not needle[k - 1].isspace() else "")
            continue
        parts.append(f"[{re.escape(_HYPHENS)}]" if c == "-" else re.escape(c))
        if k + 1 < len(needle) and c.isalpha() and needle[k + 1].isalpha():
            parts.append(r"(?:[-‐­]\n(?=(?-i:[^\W\d_A-ZÄÖÜÅÉÈ])))?")
    return re.compile("".join(parts), re.IGNORECASE)


def occurrences(text: str, needle: str) -> list[tuple[int, int]]:
    """Every place of a value: in any case, as a word of its own."""
    if not needle.strip():
        return []
    return [m.span() for m in _blind(needle).finditer(text) if _alone(text, *m.span())]


_SPACES = str.maketrans({c: " " for c in map(chr, range(128)) if c.isspace()})
_RUN = re.compile("  +")
_ODD_SPACE = re.compile(r"[^\S ]|  ")


def _flat(s: str) -> str:
    """Small letters, and a space for all white space on end."""
    return _RUN.sub(" ", s.lower().translate(_SPACES)) if _ODD_SPACE.search(s) else s.lower()


def finder(text: str) -> Callable[[str], list[tuple[int, int]]]:
    """occurrences() of any number of needles in one text: where both are ASCII and no line's end cuts a word, by a plain search in
    small letters with one space for all white space, so that no pattern is made for each needle."""
    if not text.isascii() or "-\n" in text:
        return lambda needle: occurrences(text, needle)
    flat = text.lower().replace("\n", " ")
    if _ODD_SPACE.search(flat):
        flat = flat.translate(_SPACES)
    short = _RUN.sub(" ", flat)

    def find(needle: str) -> list[tuple[int, int]]:
        if not needle.isascii():
            return occurrences(text, needle)
        one = _flat(needle)
        if not one.strip() or (at := short.find(one)) < 0:
            return []
        if len(short) < len(flat):
            return occurrences(text, needle)
        out = []
        while at >= 0:
            z = at + len(one)
            if not text[z : z + 1].isalnum() and not text[at - 1 : at].isalnum():  # _alone() in ASCII
                out.append((at, z))
            at = short.find(one, z)
        return out

    return find


def _same(s: str) -> str:
    """Equal for all that a search in any case takes for equal (and for more)."""
    return s.lower() if s.isascii() else s.translate(_ONE_I).casefold()


def _joins(c: str) -> bool:
    return "؀" <= c <= "ۿ" or any(lo <= c <= hi for lo, hi in _OPEN)


def key(needle: str) -> tuple[bool, str]:
    """Whether a spelling goes by its first characters, and what it is looked up by (nothing: always searched for)."""
    same = _same(needle)
    m = _STRETCH.search(same)
    if not m:
        return True, ""
    loose = any(map(_joins, same[: m.start() + 1]))
    return loose, m[0][:3] if loose else m[0]


class Stretches:
    """A text's stretches of letters and digits, with those that a line's end hyphen cuts joined as well."""

    def __init__(self, text: str) -> None:
        same = _same(text)
        self.n = Counter(_STRETCH.findall(same))
        self.whole = same
        if _BROKEN.search(same):
            self.whole = _BROKEN.sub("", same)
            self.n.update(_STRETCH.findall(self.whole))

    def has(self, loose: bool, head: str) -> int:
        """How many places a spelling with this key can have at most (for a loose one: 2 if any)."""
        return 2 * (head in self.whole) if loose else self.n[head]


@dataclass(frozen=True)
class Hint:
    """A spelling of a known value."""

    text: str
    kind: str
    policy: str  # Always, Suggest or Manual
    entity: int


class Known:
    """Spellings made ready for look-up. Those that more than one entity claims are only suggested."""

    def __init__(self, hints: list[Hint]) -> None:
        claims: dict[str, list[Hint]] = defaultdict(list)
        for h in hints:
            if h.policy != "Manual":
                claims[nfc(h.text)].append(h)
        self.claims = list(claims.items())
        self.heads: dict[str, list[int]] = defaultdict(list)
        self.grams: dict[str, list[int]] = defaultdict(list)
        for n, (spelling, _) in enumerate(self.claims):
            loose, head = key(spelling)
            (self.grams if loose else self.heads)[head].append(n)
        self.lengths = sorted({len(g) for g in self.grams})

    def _named(self, text: str) -> list[int]:
        """Numbers of the spellings that the text may hold, in their order."""
        s = Stretches(text)
        found = [n for head in self.heads.keys() & s.n.keys() for n in self.heads[head]]
        for size in self.lengths:
            grams = {s.whole[k : k + size] for k in range(len(s.whole) - size + 1)} if size else {""}
            found += [n for g in self.grams.keys() & grams for n in self.grams[g]]
        return sorted(found)

    def places(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, spelling) of every place."""
        return [(a, z, self.claims[n][0]) for n in self._named(text) for a, z in occurrences(text, self.claims[n][0])]

    def hits(self, text: str) -> Iterator[Hit]:
        for n in self._named(text) if self.claims else ():
            spelling, claims = self.claims[n]
            owners = sorted({c.entity for c in claims})
            sure = len(owners) == 1 and any(c.policy == "Always" for c in claims)
            for a, z in occurrences(text, spelling):
                yield Hit(a, z, claims[0].kind, sure, VAULT, "vault", entities=list(owners))
