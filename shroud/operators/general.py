"""The seven general rules, which know no language: native expressions from text to spans.

A boundary is an ASCII letter or digit only, so a preceding accented letter doesn't hide a number. Order of the rules: IBANs,
e-mails, social insurance, national identity, tax identification, payment cards, phones. Null and empty texts have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import validators as V
from .batches import spread
from .spans import first_of_overlapping, matches

SPAN = "struct<start:int,end:int,value:string>"
FOUND = "struct<start:int,end:int,kind:string,confidence:string,rule:string>"
_B, _A = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_STEP = r"(?:[ \-/().]?[0-9])*+"
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+"


def _spaced(groups: str) -> str:
    return _B + groups.replace(" ", " ?") + _A


def _only(spans: Column, test) -> Column:
    return F.filter(spans, lambda s: test(s["value"]))


def ibans(text: Column) -> Column:
    """From each start the longest run of space-joined groups of 15 to 34 characters whose checksum holds."""
    heads = matches(text, _B + r"[A-Z]{2}[0-9]{2}")
    runs = F.transform(heads, lambda s: F.struct(s["start"].alias("start"), F.split(F.regexp_extract(F.substr(text, s["start"] + 1, F.lit(70)), r"^[A-Z]{2}[0-9]{2}[0-9A-Z]*(?: [0-9A-Z]+)*", 0), " ").alias("g")))
    tried = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.size(r["g"]), F.lit(1), F.lit(-1)), lambda n: F.struct(r["start"].alias("start"), (r["start"] + F.length(F.array_join(F.slice(r["g"], F.lit(1), n), " "))).alias("end"), F.array_join(F.slice(r["g"], F.lit(1), n), " ").alias("value")))))
    ends = lambda s: ~F.substr(text, s["end"] + 1, F.lit(1)).rlike("^[A-Za-z0-9]")
    good = F.filter(tried, lambda s: V.iban_ok(F.replace(s["value"], F.lit(" "))) & ends(s))
    return first_of_overlapping(good.cast(f"array<{SPAN}>"), SPAN)


def emails(text: Column) -> Column:
    cut = F.transform(matches(text, _EMAIL), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(F.rtrim(s["value"], F.lit(".")))).alias("end"), F.rtrim(s["value"], F.lit(".")).alias("value")))
    return _only(cut, V.is_an_email)


def social_insurance(text: Column) -> Column:
    return _only(matches(text, _spaced("[0-9]{2} [0-9]{6} [A-Z] [0-9]{3}")), lambda v: V.social_insurance_ok(F.replace(v, F.lit(" "))))


def national_identity(text: Column) -> Column:
    date = lambda v: F.regexp_extract(v, "^[0-9]+", 0)
    return _only(matches(text, _B + "(?:[0-9]{8}|[0-9]{6})[-+][0-9]{4}" + _A), lambda v: V.is_a_long_date(date(v)) | V.is_a_short_date(date(v)))


def tax_identification(text: Column) -> Column:
    return _only(matches(text, _spaced("[0-9]{2} [0-9]{3} [0-9]{3} [0-9]{3}")), lambda v: V.tax_id_ok(F.replace(v, F.lit(" "))))


def payment_cards(text: Column) -> Column:
    """Groups of digits that a space or hyphen joins, read as a whole. Where that is no card and the first group ends a number with
    points (an address like 10.0.0.42 right before a card), the rest is read once more without it."""
    card = lambda v: V.is_a_card_number(F.regexp_replace(v, "[ -]", ""))

    def read(s: Column) -> Column:
        first = F.length(F.regexp_extract(s["value"], "^[0-9]+[ -]", 0))
        rest = F.substr(s["value"], first + 1, F.length(s["value"]))
        pointed = (first > 0) & (s["start"] >= 2) & F.substr(text, F.greatest(s["start"] - 1, F.lit(1)), F.lit(2)).rlike(r"^[0-9]\.$")
        return F.when(card(s["value"]), s).when(pointed & card(rest), F.struct((s["start"] + first).alias("start"), s["end"].alias("end"), rest.alias("value")))

    long_ = F.filter(matches(text, _B + r"[0-9]++(?:[ \-][0-9]++)*+" + _A), lambda s: F.length(s["value"]) >= 13)
    return F.when(~text.rlike(r"[0-9](?:[ \-]?[0-9]){12}"), F.array().cast(f"array<{SPAN}>")).otherwise(F.filter(F.transform(long_, read), lambda s: s.isNotNull()))


def _few(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)


def international_phones(text: Column) -> Column:
    return _only(matches(text, r"\+[0-9]" + _STEP + _A), _few)


def local_phones(text: Column) -> Column:
    """From 0; not 000, and not a date with points."""
    return _only(matches(text, r"(?<![A-Za-z0-9+])0(?!00)" + r"(?=[ \-/().]?[0-9])" + _STEP + _A), lambda v: _few(v) & ~V.looks_like_a_date(v))


#: rule, kind, confidence, spans.
RULES = (
    ("iban", "Iban", "auto", ibans),
    ("email", "Email", "auto", emails),
    ("social-insurance number", "SocialInsuranceNo", "auto", social_insurance),
    ("national identity number", "TaxId", "auto", national_identity),
    ("tax identification number", "TaxId", "auto", tax_identification),
    ("payment-card", "Account", "auto", payment_cards),
    ("phone-intl", "Phone", "auto", international_phones),
    ("phone-local", "Phone", "suggest", local_phones),
)


#: What every rule's spans hold: the head of an IBAN, an at sign, the ends of a social insurance or national identity number, the
#: eleven digits of a tax number or card, a country's prefix, or eight digits from 0.
_ANYTHING = r"[A-Z]{2}[0-9]{2}|@|[0-9]{6}(?: ?[A-Z] ?[0-9]{3}|[-+][0-9]{4})|[0-9](?:[ \-]?[0-9]){10}|\+[0-9]|0(?:[ \-/().]?[0-9]){7}"


def found(text: Column, rules: tuple[str, ...] | None = None) -> Column:
    """array of start, end, kind, confidence, rule; every rule's spans, in the order of the rules."""
    parts = [_named(spans(text), rule, kind, sure) for rule, kind, sure, spans in RULES if rules is None or rule in rules]
    none = F.array().cast(f"array<{FOUND}>")
    return F.when(text.isNull() | ~text.rlike(_ANYTHING), none).otherwise(F.concat(*parts).cast(f"array<{FOUND}>"))


def _named(spans: Column, rule: str, kind: str, sure: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), F.lit(rule).alias("rule")))


def general(docs: DataFrame, text_col: str = "text", rules: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each span of a rule, with the other columns of docs; overlapping spans of different rules all stay."""
    shape = F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.kind").alias("kind"), F.col("f.confidence").alias("confidence"), F.col("f.rule").alias("rule")
    rest = [c for c in docs.columns if c not in ("start", "end", "kind", "confidence", "rule", "value", text_col)]
    return spread(docs).withColumn("f", F.explode(found(F.col(text_col), rules))).select(*rest, *shape, F.substr(F.col(text_col), F.col("f.start") + 1, F.col("f.end") - F.col("f.start")).alias("value"))
