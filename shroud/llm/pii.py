"""Personal data: patterns propose spans, checksums confirm them, context words (outside all spans) move the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping per kind; a match that
fails its check is dropped and not tried again. The method adds `iban` (mod-97; of space-joined groups the longest run that
passes), `ssn` and `key` spans.
Null and empty texts have no spans. Whole texts are read; every pattern runs in time linear in the text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import arrow

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "key")
SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
# A match can't begin inside a run of digits: what fails at its first digit fails at the others.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,48})(?![A-Za-z0-9])")

# Words that make a kind likelier when they stand nearby, and words that make any kind less likely.
_CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "login", "adresse"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "llame", "appel"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "key": ("key", "secret", "token", "access"),
}
_AGAINST = ("version", "example", "sample", "isbn", "order", "invoice", "part")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
#: Score of a match alone, and what a passed checksum and a nearby word add or take.
_START = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.5, "key": 0.8}
CHECKED, NEAR, AGAINST, REACH = 0.4, 0.15, 0.2, 48
#: Score of a confirmed span before any context word.
_ALONE = {k: round(v + CHECKED * (k in ("card", "iban")), 4) for k, v in _START.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            yield first, m.end()
            done = m.end()
        else:
            done = max(done, first)
        at = text.find("@", max(at + 1, done))


def _ibans(text: str):
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1  # a match is of bounded length, so trying again inside it stays linear
        for n in [len(m[0]), *(k for k in range(len(m[0]) - 1, 0, -1) if m[0][k] == " ")]:
            if 15 <= len(s := m[0][:n].replace(" ", "")) <= 34 and mod97(s):
                yield m.start(), m.start() + n
                at = m.start() + n
                break


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _candidates(text: str):
    """(kind, start, end, whether a checksum confirmed it)."""
    for a, b in _emails(text):
        yield "email", a, b, False
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end(), False
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end(), True
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end(), False
    for a, b in _ibans(text):
        yield "iban", a, b, True
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end(), False
    for m in _KEY.finditer(text):
        yield "key", m.start(), m.end(), False


def find(text: str | None) -> list[Span]:
    """All spans, by kind as listed in BASE_KINDS and EXTRA_KINDS, then by start."""
    if not text:
        return []
    found, met = [], [*_candidates(text)]
    pieces, done = [], 0
    for _, a, b, _ in sorted(met, key=lambda c: c[1:3]):
        pieces += [text[done:a], " " * (b - max(a, done))]
        done = max(done, b)
    free = "".join([*pieces, text[done:]])  # the text with its spans blanked: a mail address has no context words
    for kind, a, b, checked in met:
        near = {w.lower() for w in _WORD.findall(free[max(0, a - REACH) : a] + " " + free[b : b + REACH // 2])}
        score = _START[kind] + CHECKED * checked + NEAR * any(w in near for w in _CONTEXT[kind]) - AGAINST * any(w in near for w in _AGAINST)
        found.append(Span(kind, a, b, round(min(1.0, max(0.0, score)), 4)))
    return found


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs with out_col: array of (kind, start, end, score); code points, end exclusive.

    Every other column passes unchanged; a column already named out_col is replaced.
    """
    base = docs.drop(out_col)
    schema = T.StructType([*base.schema.fields, T.StructField(out_col, SPAN_TYPE)])

    def run(batches):
        for b in batches:
            spans = [[s._asdict() for s in find(t)] for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, _ARROW_SPAN)], names=[*b.schema.names, out_col])

    return base.transform(arrow, run, schema)


def redact(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Replaces spans by their kind in brackets; of overlapping spans the one that starts first (then the longer) is named.

    Base kinds go whatever their score. Of the added kinds those of that score at least go, and context words only lift a
    span over it: one that reaches it by its pattern and checksum is never kept for a word that stands nearby.
    """

    def clean(text):
        if not text:
            return text
        out, done = [], 0
        for s in sorted((s for s in find(text) if s.kind in BASE_KINDS or max(s.score, _ALONE[s.kind]) >= least), key=lambda s: (s.start, -s.end)):
            if s.start >= done:
                out += [text[done : s.start], f"[{s.kind.upper()}]"]
            done = max(done, s.end)
        return "".join([*out, text[done:]]) if out else text

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index(text_col)
            yield b.set_column(k, b.schema.field(k), pa.array([clean(t) for t in b.column(k).to_pylist()], b.schema.field(k).type))

    return docs.transform(arrow, run, docs.schema)


def digest(found: DataFrame, id_col: str = "doc_id", pii_col: str = "pii") -> DataFrame:
    """Counts by base kind, the base spans' hash and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: lambda s: s["kind"] == kind
    base = F.filter(pii_col, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        id_col,
        *[F.size(F.filter(pii_col, of(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col(pii_col)).alias("spans"),
        F.transform(pii_col, lambda s: s["score"]).alias("scores"),
    )
