"""Laws that findings obey, and how overlaps settle."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import replace
from itertools import pairwise

from .words import GENERAL, HAND, LANGUAGE, VAULT, Hit

SOURCE_RANK = {GENERAL: 0, VAULT: 1, LANGUAGE: 2, HAND: 3}
_TOKEN = re.compile("__Z_[A-Za-z0-9]{4}_[A-Z0-9]+_[A-Za-z0-9]{4,8}__")
#: What begins like a token, up to the next pair of underscores.
_LIKE_A_TOKEN = re.compile("__Z_.*?__", re.DOTALL)
_WORDS = re.compile(r"\S+")


def token_spans(text: str) -> list[tuple[int, int]]:
    """Tokens from left to right; what begins like one and isn't hides whatever stands before its own end."""
    return [] if "__Z_" not in text else [m.span() for m in _LIKE_A_TOKEN.finditer(text) if _TOKEN.fullmatch(m[0])]


def _edge(c: str) -> bool:
    return not (c.isalnum() or c.isspace() or unicodedata.combining(c))


def one_word_names(text: str, hits: list[Hit]) -> list[Hit]:
    """A name of several words becomes a hit a word, unless a person wrote it into the vault."""
    out = []
    if all(h.kind != "Person" for h in hits):
        return hits
    for h in hits:
        words = [m.span() for m in _WORDS.finditer(text, h.start, h.end)] if h.kind == "Person" and h.source not in (VAULT, HAND) else []
        if len(words) < 2:
            out.append(h)
            continue
        for a, z in words:
            while a < z and _edge(text[a]):
                a += 1
            while z > a and _edge(text[z - 1]):
                z -= 1
            if a < z:
                out.append(replace(h, start=a, end=z, also=[], entities=list(h.entities)))
    return out


def settle(hits: list[Hit]) -> list[Hit]:
    """By place, then certainty, length and source; an overlap folds into the hit that was kept first.

    Kept hits don't overlap and come by their start, so only the last one can reach a hit that begins later.
    """
    kept: list[Hit] = []
    if all(a.start < b.start >= a.end for a, b in pairwise(hits)):
        return hits  # in order and apart
    for h in sorted(hits, key=lambda h: (h.start, not h.sure, h.start - h.end, SOURCE_RANK[h.source])):
        last = kept[-1] if kept else None
        if last is None or h.start >= last.end:
            kept.append(h)
            continue
        last.entities += [e for e in h.entities if e not in last.entities]
        if last.kind == h.kind:
            if h.rule not in last.also:
                last.also.append(h.rule)
            last.sure = last.sure or h.sure
    return kept
