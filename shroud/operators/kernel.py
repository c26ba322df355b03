"""The walk over one document: all layers of findings, the laws, and settling. Plain Python on one text, called in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from .contains import standing
from .known import Hint, Known, occurrences
from .labels import Labels
from .lexicon import AR, DE, EN, ES, FR, SV
from .people import Names, People
from .rules import EXTRA
from .settle import one_word_names, settle, token_spans
from .words import GENERAL, HAND, LANGUAGE, VAULT, Hit, Lexer, Reading, as_read, nfc

__all__ = ["EXTRA", "GENERAL", "HAND", "LANGUAGE", "PACKS", "VAULT", "Hint", "Hit", "Knowledge", "Labels", "Names", "People", "Reading", "as_read", "nfc", "occurrences", "scan_text", "settle", "token_spans"]

PACKS = {p.id: p for p in (DE, EN, SV, AR, FR, ES)}


@dataclass
class Knowledge:
    """All a scan needs besides the text; small dimension tables, made once and sent to the workers."""

    packs: tuple[str, ...]
    labels: Labels
    honorifics: frozenset
    names: dict[str, Names]
    hints: list[Hint] = field(default_factory=list)
    exceptions: frozenset = frozenset()  # (kind, NFC value)

    @cached_property
    def people(self) -> dict[str, People]:
        """The rules for names by pack (Arabic has its own), made ready in each worker."""
        return {p: People(PACKS[p], self.names[p]) for p in self.packs if p in PACKS and p != "ar"}

    @cached_property
    def lexer(self) -> Lexer:
        return Lexer(*(p.facts for p in self.people.values()))

    @cached_property
    def known(self) -> Known:
        return Known(self.hints)

    def learn(self, met: Iterable[dict], most: int = 500_000) -> None:
        """Takes in what a bank says of a text's words, before the text is read. Whether a word is a name hangs on the bank alone and
        each text brings all of its names, so what has been kept of words before stays right; past `most` all is begun anew."""
        for row in met or ():
            for lang, kind in ((x["lang"], x["type"]) for x in row["is"]):
                if lang in self.names and kind in ("given", "family"):
                    own = self.names[lang].met_given if kind == "given" else self.names[lang].met_family
                    if len(own) >= most:
                        own.clear()
                        self.lexer.kept.clear()
                    own.add(row["spelling"])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("people", "lexer", "known")}


def scan_document(doc: Reading, general: list[Hit], k: Knowledge, met: Iterable[dict] = ()) -> list[Hit]:
    """Layers in order (general, packs, labels, known values), then the laws, then settling. met: spellings of known values that the text may hold."""
    text, hits = doc.text, list(general)
    classes = k.lexer.of(doc)
    for p in k.packs:
        if p in k.people:
            hits += k.people[p].all(doc, classes)
        for rule in EXTRA.get(p, ()):
            hits += rule(doc, k.names.get(p))
    hits += k.labels.hits(doc, k.honorifics)
    hits += k.known.hits(text)
    for c, places in sorted(standing(text, met), key=lambda x: (-len(x[0]["spelling"].encode()), x[0]["spelling"])):
        hits += [Hit(a, z, c["kind"], c["sure"], VAULT, "vault", entities=list(c["entities"])) for a, z in places]
    if not hits:
        return hits
    hits = one_word_names(text, hits)
    hits = [h for h in hits if h.source in (VAULT, HAND) or not k.labels.names(text[h.start : h.end])]
    if k.exceptions:
        hits = [h for h in hits if (h.kind, nfc(text[h.start : h.end])) not in k.exceptions]
    if tokens := token_spans(text):
        hits = [h for h in hits if not any(h.start < z and a < h.end for a, z in tokens)]
    return settle(hits)


def scan_text(text: str, general: list[Hit], k: Knowledge) -> list[Hit]:
    return scan_document(Reading(text), general, k)
