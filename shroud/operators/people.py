"""Names and companies in running text: one set of rules for all languages, each an expression over classes of words.

In the expressions a word is two characters: the gap before it (blank, \\n line, \\f page, \\v both) and its letter in the
rule's alphabet, so `[ \\f]` means the same line and `[ \\n]` the same page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from .lexicon import Pack
from .words import EDGE, EDGE_BUT_DOT, LANGUAGE, Facts, Form, Hit, Kept, Letters, Marks, Reading, as_read, capital

JOINERS = frozenset({"von", "van", "de", "der", "zu"})
(SHAPED, JOINER, SALUTES, GREETS, TITLE, PART, FORM, JOINS, STOP, FUNCTION, ROLE, CLOSES, COPULA, GIVEN, GIVEN_RAW, FAMILY, KNOWN_FAMILY, CAPITAL, NUMBER, LABEL, OPENS, COMMA, ENDS, PAUSE, SOFT_END, SMALL, SHORT) = (1 << k for k in range(27))
#: Words of a text that is kept as one in which nothing is found.
MOST_KEPT = 16
ANY, LINE, PAGE = "[ \n\f\v]", "[ \f]", "[ \n]"


@dataclass
class Names:
    given: frozenset
    family: frozenset
    met_given: set = field(default_factory=set)  # names of a bank that this worker's texts hold
    met_family: set = field(default_factory=set)

    def is_given(self, s: str) -> bool:
        return s.lower() in self.given or s.lower() in self.met_given

    def is_family(self, s: str) -> bool:
        return s.lower() in self.family or s.lower() in self.met_family


def _all(bits: int, wanted: int, without: int = 0) -> bool:
    return bits & wanted == wanted and not bits & without


def _one_to_three(last: str, open_: str) -> str:
    """Up to three words on a line, of which only the last may end a phrase."""
    return f"(?:{last}|{open_}(?:{LINE}(?:{last}|{open_}(?:{LINE}(?:{last}|{open_}))?+))?+)"


_read = Kept(lambda w: as_read(w.strip(EDGE)).lower())


class People:
    """The rules of one pack, made ready once a worker; all() and discover() read documents with them."""

    def __init__(self, pack: Pack, names: Names) -> None:
        self.pack, self.names = pack, names
        self._none: set[tuple[str, str]] = set()  # spelled short texts in which nothing is found
        low = lambda *lists: frozenset(x.lower() for words in lists for x in words)
        self._low = {SALUTES: low(pack.salutations), GREETS: low(pack.greetings), TITLE: low(pack.titles), PART: low(pack.title_parts)}
        self._openers, self._stops = frozenset().union(*self._low.values()), low(pack.stop_words)
        written = low(pack.salutations, pack.greetings, pack.titles, pack.title_parts, pack.function_words, pack.stop_words, pack.roles, pack.closings, pack.copulas, pack.company_forms, pack.conjunctions, JOINERS, "+")
        self._words = frozenset(x for w in written for x in (w, w.strip(EDGE), w.strip(EDGE_BUT_DOT), w.rstrip(".")))
        c = self.facts = Facts(self._facts, self._words)
        name = lambda b: b & (SHAPED | JOINER) and not b & (OPENS | LABEL)
        self.openers = m = Marks(c, lambda b: b & SALUTES, lambda b: b & GREETS, lambda b: b & TITLE, lambda b: b & PART, lambda b: name(b) and not b & ENDS, lambda b: name(b) and b & ENDS)
        titles, words = f"{m.all(2)}(?:{LINE}{m.some(2, 3)})*+", _one_to_three(m.all(5), m.all(4))
        self.after_opener = re.compile(f"(?P<opener>{m.some(0, 1)})(?:{ANY}{titles})?+(?P<name>{LINE}{words})|(?:(?<=^.)|(?<=[\n\v])){m.all(0)}(?P<below>[\n\v]{words})", re.DOTALL)
        self.after_title = re.compile(f"(?<!{m.some(0, 2, 3)}{ANY}){titles}(?P<name>{LINE}{words})")
        self.pairs = Marks(c, lambda b: _all(b, GIVEN | GIVEN_RAW | SHAPED, FUNCTION), lambda b: _all(b, SHAPED | FAMILY))
        self.known_pair = re.compile(f"{self.pairs.all(0)}{PAGE}{self.pairs.all(1)}")
        fits = lambda b: _all(b, SHAPED, LABEL | OPENS | SHORT | FORM | FUNCTION)
        self.shapes = Letters(c, ("f", lambda b: b & FORM), ("e", lambda b: fits(b) and _all(b, ENDS | SMALL)), ("E", lambda b: fits(b) and b & ENDS), ("w", lambda b: fits(b) and b & SMALL), ("W", fits))
        self.shape_run = re.compile(f"{ANY}(?:[eE]|[wW](?: [wW])*+(?: [eE])?+)")
        self.turned = Marks(c, lambda b: _all(b, COMMA | SHAPED, FUNCTION | STOP), lambda b: _all(b, GIVEN | SHAPED, FUNCTION))
        self.turned_pair = re.compile(f"{self.turned.all(0)}{LINE}{self.turned.all(1)}")
        self.lines = m = Marks(c, lambda b: _all(b, CAPITAL, NUMBER | LABEL), lambda b: b & CLOSES, lambda b: b & ROLE)
        line = f"{m.all(0)}(?:{LINE}{m.all(0)}){{1,2}}"
        self.signed = re.compile(f"(?<={m.all(1)})[\n\v]{line}(?=[\n\v]|$)|(?:^.|[\n\v]){line}(?=[\n\v]{m.all(2)})", re.DOTALL)
        self.beside = m = Marks(c, lambda b: b & SHAPED, lambda b: b & COMMA, lambda b: b & LABEL, lambda b: b & ROLE, lambda b: b & COPULA, lambda b: b & GIVEN, lambda b: b & FAMILY)
        self.role_first = re.compile(f"{m.all(3, without=(1,))}{LINE}{m.all(4)}(?=({ANY}{m.all(0)}{PAGE}{m.all(0)}))")
        known = f"(?:{m.all(0, 5, without=(2,))}{PAGE}{m.all(0, 1)}|{m.all(0, without=(2,))}{PAGE}{m.all(0, 1, 6)})"
        self.role_last = re.compile(f"(?=({LINE}{known}){LINE}{m.all(3)})")
        usable = lambda b: _all(b, CAPITAL, STOP | SALUTES | SOFT_END | JOINS)
        self.firms = Letters(c, ("F", lambda b: b & FORM and usable(b)), ("f", lambda b: _all(b, FORM | CAPITAL, STOP)), ("g", lambda b: b & FORM), ("&", lambda b: _all(b, JOINS, SOFT_END)), ("w", usable), ("u", lambda b: _all(b, CAPITAL, STOP)))
        # Read backwards, where a word's letter stands before its gap. A joining word counts after a capital that doesn't begin its line.
        self.before_form = re.compile(f"[Ffg](?:{LINE}(?:[Fw]|&(?={ANY}[Ffwu]{LINE})))*+")
        self.unknown = Marks(c, lambda b: _all(b, SHAPED | GIVEN, FUNCTION | PAUSE), lambda b: _all(b, SHAPED, KNOWN_FAMILY), lambda b: _all(b, SHAPED | COMMA, KNOWN_FAMILY), lambda b: _all(b, SHAPED | GIVEN))
        m = self.unknown
        self.candidate = re.compile(f"(?=(?P<after>{m.all(0)} {m.all(1)})|(?P<before>{m.all(2)} {m.all(3)}))")

    def shaped(self, text: str) -> bool:
        """A capital, then letters, hyphens or apostrophes; neither stop word, degree nor opener."""
        if text.islower():
            return False
        n = as_read(text.strip(EDGE)).rstrip(".,;:")
        p = self.pack
        return len(n) >= 2 and capital(n) and all(c.isalpha() or c in "-'’" for c in n) and n not in p.stop_words and n not in p.degrees and n.lower() not in self._openers

    def like_family(self, bare: str) -> bool:
        p, low = self.pack, bare.lower()
        if len(bare) < 5 or not capital(bare) or low in self._stops or low in p.function_words or low in p.roles or low in p.closings:
            return False
        return any(len(low) > len(s) and low.endswith(s) for s in p.family_suffixes)

    def _facts(self, w: Form) -> int:
        p, text, bare, dotted, low, dotted_low, read, last = self.pack, w.text, w.bare, w.dotted, w.low, w.dotted_low, w.read, w.text[-1]
        bits = sum(bit for bit, words in self._low.items() if dotted_low in words)
        for bit, true in (
            (JOINER, bare in JOINERS), (FORM, dotted in p.company_forms or bare in p.company_forms or dotted.rstrip(".") in p.company_forms),
            (JOINS, bare in p.conjunctions or bare == "+"), (STOP, bare in p.stop_words), (FUNCTION, low in p.function_words), (ROLE, dotted_low.rstrip(",.;:") in p.roles),
            (CLOSES, low in p.closings), (COPULA, low in p.copulas), (CAPITAL, capital(bare)), (NUMBER, w.number), (LABEL, last == ":"),
            (OPENS, text[0] in '([{«"'), (COMMA, last == ","), (ENDS, last in ",.;:!?)"), (PAUSE, last in ",.;:!?"), (SOFT_END, last in ":,;."), (SMALL, any(map(str.islower, bare[1:]))),
            (SHORT, len(bare) <= 3 and not any(map(str.islower, bare))), (SHAPED, self.shaped(text)),
        ):
            bits |= bit * true
        if bits & SHAPED:
            known = self.names.is_family(read)
            bits |= GIVEN * self.names.is_given(read) | GIVEN_RAW * self.names.is_given(bare) | KNOWN_FAMILY * known | FAMILY * (known or self.like_family(bare))
        return bits

    def _hit(self, doc: Reading, a: int, z: int, sure: bool, rule: str, kind: str = "Person") -> Hit:
        return Hit(doc.starts[a], doc.bare_end(z), kind, sure, LANGUAGE, f"{self.pack.id}:{rule}")

    def _over(self, doc: Reading, span: tuple[int, int], sure: bool, rule: str) -> Hit:
        """A hit over the words of a part of a spelled document."""
        return self._hit(doc, span[0] // 2, (span[1] - 1) // 2, sure, rule)

    def _opened(self, doc: Reading, text: str) -> Iterator[Hit]:
        for m in self.after_opener.finditer(text):
            sure = m["opener"] is None or self.openers.of(m["opener"]) & 1 > 0
            yield self._over(doc, m.span("name" if m["name"] else "below"), sure, "salutation" if sure else "greeting")

    def _titled(self, doc: Reading, text: str) -> Iterator[Hit]:
        for m in self.after_title.finditer(text):
            yield self._over(doc, m.span("name"), True, "title")

    def _by_shape(self, doc: Reading, text: str) -> Iterator[Hit]:
        for m in self.shape_run.finditer(text):
            if len(m[0]) in (4, 6) and not m[0].isupper() and text[m.end() : m.end() + 2] not in (" f", "\ff"):
                yield self._over(doc, m.span(), False, "name-shape")

    def _turned(self, doc: Reading, text: str) -> Iterator[Hit]:
        at = 0
        while m := self.turned_pair.search(text, at):
            k = m.end() // 2  # the word after the pair, which has to end its field
            if k == len(doc.words) or doc.gaps[k] in "\n\v" or re.search("\t|  ", doc.text[doc.bare_end(k - 1) : doc.starts[k]]):
                yield self._over(doc, m.span(), False, "name-reversed-pair")
                at = m.end()
            else:
                at = m.start() + 1

    def _beside_role(self, doc: Reading, text: str) -> Iterator[Hit]:
        for rule in (self.role_first, self.role_last):
            for m in rule.finditer(text):
                yield self._over(doc, m.span(1), False, "role-beside-a-name")

    def _companies(self, doc: Reading, classes: str) -> Iterator[Hit]:
        text = doc.spelled(classes.translate(self.firms))[::-1]
        for k in (k for k, c in enumerate(classes) if self.facts.bits[ord(c)] & FORM):
            m = self.before_form.match(text, len(text) - 2 * (k + 1))
            first = k - len(m[0]) // 2
            if first < k:
                yield self._hit(doc, first, k + 3 if self._goes_on(doc.words[k + 1 : k + 4]) else k, False, "company-form", "Company")

    def _goes_on(self, after: tuple[str, ...]) -> bool:
        """Whether a form goes on as in GmbH & Co. KG."""
        dotted = [w.strip(EDGE_BUT_DOT) for w in after]
        return len(dotted) == 3 and after[0].strip(EDGE) in self.pack.conjunctions and dotted[1].lower() == "co." and dotted[2] in self.pack.company_forms

    def _before_found(self, doc: Reading, found: list[Hit]) -> Iterator[Hit]:
        """The word before each place of a word that begins a name found so far."""
        people = [h for h in found if h.kind == "Person"]
        if not people:
            return
        begins = {h.start for h in people}
        read = list(map(_read.__getitem__, doc.words))
        known, taken = {r for r, a in zip(read, doc.starts, strict=True) if a in begins}, {(h.start, h.end) for h in people}
        for k in (k for k in range(1, len(read)) if read[k] in known and doc.gaps[k] in " \f"):
            a, text = doc.starts[k - 1], doc.words[k - 1]
            if text[-1] not in ",.;:!?" and self.shaped(text) and not any(x <= a < z for x, z in taken):
                yield self._hit(doc, k - 1, k - 1, False, "given-name")

    def all(self, doc: Reading, classes: str) -> list[Hit]:
        """Hits of a document; classes: what the lexer makes of it."""
        present = self.facts.present(classes)
        if not present:
            return []
        # Whether anything is found hangs on classes and gaps alone, but for pairs that a comma turns.
        spelling = None if len(classes) > MOST_KEPT or _all(present, GIVEN | COMMA) else (classes, doc.gaps)
        if spelling in self._none:
            return []
        spelled = lambda letters: doc.spelled(classes.translate(letters))
        found: list[Hit] = []
        if present & (SALUTES | GREETS | TITLE):
            text = spelled(self.openers)
            found += [*self._opened(doc, text), *self._titled(doc, text)]
        if self.pack.names_by_shape:
            found += self._by_shape(doc, spelled(self.shapes))
        elif present & GIVEN:
            found += [self._over(doc, m.span(), False, "name-dictionary") for m in self.known_pair.finditer(spelled(self.pairs))]
        if _all(present, GIVEN | COMMA):
            found += self._turned(doc, spelled(self.turned))
        if present & (CLOSES | ROLE):
            found += [self._over(doc, m.span(), True, "signature") for m in self.signed.finditer(spelled(self.lines))]
        if present & ROLE:
            found += self._beside_role(doc, spelled(self.beside))
        if present & FORM:
            found += self._companies(doc, classes)
        if found:
            found += self._before_found(doc, found)
        elif spelling:
            if len(self._none) >= 50_000:
                self._none.clear()
            self._none.add(spelling)
        if self.pack.names_by_shape:
            found = [replace(h, sure=False) if h.kind == "Person" else h for h in found]
        return found

    def discover(self, doc: Reading, classes: str) -> Iterator[tuple[int, int, bool, str]]:
        """Unknown surnames: after a known given name, or before a comma and one. (start, end, family, rule)."""
        if self.facts.present(classes) & GIVEN:
            for m in self.candidate.finditer(doc.spelled(classes.translate(self.unknown))):
                k = m.start() // 2 + (m["after"] is not None)
                yield doc.starts[k], doc.bare_end(k), True, "after-a-given-name" if m["after"] else "before-a-given-name"
