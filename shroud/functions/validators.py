"""Validators and checksums as Column functions: whole-stage code on the JVM, no Python in the row path.

Each takes a Column of strings (or a column's name) and gives a boolean Column; null gives null. Spaces and hyphens are
the caller's to remove unless the rule itself allows them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Str = Column | str


def _c(value: Str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _guarded(value: Column, shape: str, test: Column) -> Column:
    """The test where the value has the shape; false elsewhere; null stays null."""
    return F.when(value.isNull(), F.lit(None).cast("boolean")).when(value.rlike(shape), F.coalesce(test, F.lit(False))).otherwise(False)


def _numbers(value: Column) -> Column:
    """The characters as numbers, digits as themselves and letters A to Z as 10 to 35."""
    return F.transform(F.filter(F.split(value, ""), lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]$"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55))


def _fold(numbers: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(numbers, F.lit(start).cast("long"), lambda a, x: step(a, x.cast("long")))


def _part(value: Column, start: int, size: int) -> Column:
    return F.substring(value, start, size)


def _int(value: Column) -> Column:
    return value.try_cast("long")


def _luhn(value: Column) -> Column:
    return F.call_function("luhn_check", value)


def luhn_ok(value: Str) -> Column:
    v = _c(value)
    return _guarded(v, "^[0-9]{2,}$", _luhn(v))


def is_a_card_number(value: Str) -> Column:
    """13 to 19 digits that pass Luhn, of a length their issuer's first digits allow."""
    v = _c(value)
    n = F.length(v)
    first = [_int(_part(v, 1, k)) for k in range(5)]
    issued = (
        ((first[1] == 4) & n.isin(13, 16, 19))
        | (first[2].between(51, 55) & (n == 16))
        | (first[4].between(2221, 2720) & (n == 16))
        | (first[2].isin(34, 37) & (n == 15))
        | (((first[4] == 6011) | (first[2] == 65) | first[3].between(644, 649)) & (n == 16))
        | (first[4].between(3528, 3589) & (n == 16))
        | ((first[3].between(300, 305) | (first[4] == 3095) | first[2].isin(36, 38, 39)) & (n == 14))
        | ((first[2] == 62) & n.between(16, 19))
    )
    return _guarded(v, "^[0-9]{13,19}$", issued & _luhn(v))


def iban_checksum_ok(value: Str) -> Column:
    """Four characters from the front moved to the end, letters as numbers, modulo 97 is 1."""
    v = _c(value)
    turned = _numbers(F.concat(F.substr(v, F.lit(5)), _part(v, 1, 4)))
    return _guarded(v, "^[0-9A-Z]{5,}$", _fold(turned, 0, lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1)


def iban_ok(value: Str) -> Column:
    v = _c(value)
    return F.length(v).between(15, 34) & v.rlike("^[A-Z]{2}[0-9]{2}") & iban_checksum_ok(v)


def is_an_email(value: Str) -> Column:
    return _c(value).rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9.-]*\.)[A-Za-z]{2,}$")


def _day_of_month(day: Column, month: Column) -> Column:
    most = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & day.between(1, most)


def is_a_short_date(value: Str) -> Column:
    """YYMMDD; February always has 29 days."""
    v = _c(value)
    return _guarded(v, "^[0-9]{6}$", _day_of_month(_int(_part(v, 5, 2)), _int(_part(v, 3, 2))))


def is_a_long_date(value: Str) -> Column:
    """YYYYMMDD from 1850 to 2100."""
    v = _c(value)
    return _guarded(v, "^[0-9]{8}$", _int(_part(v, 1, 4)).between(1850, 2100) & _day_of_month(_int(_part(v, 7, 2)), _int(_part(v, 5, 2))))


def looks_like_a_date(value: Str) -> Column:
    """d.m.yyyy with a real day and month."""
    v = _c(value)
    return _guarded(v, r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", _day_of_month(_int(F.split_part(v, F.lit("."), F.lit(1))), _int(F.split_part(v, F.lit("."), F.lit(2)))))


def social_insurance_ok(value: Str) -> Column:
    """German: eight digits, a letter, three digits; day and month inside; weighted digit sums end in the check digit."""
    v = _c(value)
    letter = F.ascii(_part(v, 9, 1)) - 64
    spelled = F.concat(_part(v, 1, 8), F.lpad(letter.cast("string"), 2, "0"), _part(v, 10, 2))
    weights = F.array(*[F.lit(w) for w in (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1)])
    sums = F.zip_with(_numbers(spelled), weights, lambda d, w: F.floor(d * w / 10) + (d * w) % 10)
    test = _day_of_month(_int(_part(v, 3, 2)), _int(_part(v, 5, 2))) & (_fold(sums, 0, lambda a, x: a + x) % 10 == _int(_part(v, 12, 1)))
    return _guarded(v, "^[0-9]{8}[A-Z][0-9]{3}$", test)


def tax_id_ok(value: Str) -> Column:
    """German, 11 digits: one digit of the first ten two or three times, no other twice; ISO 7064 modulo 11, 10."""
    v = _c(value)
    ten = _part(v, 1, 10)
    times = F.transform(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.lit(10) - F.length(F.replace(ten, d, F.lit(""))))
    often = F.size(F.filter(times, lambda n: n.between(2, 3))) == 1
    fair = ~F.exists(times, lambda n: n > 3) & F.exists(times, lambda n: n == 0)
    step = lambda a, x: (F.when((a + x) % 10 == 0, 10).otherwise((a + x) % 10) * 2) % 11
    check = (F.lit(11) - _fold(_numbers(ten), 10, step)) % 10
    return _guarded(v, "^[1-9][0-9]{10}$", often & fair & (check == _int(_part(v, 11, 1))))


def is_a_numeric_date(value: Str) -> Column:
    """Three numbers of up to four digits between / - or . of which one at least has two."""
    return F.trim(_c(value)).rlike(r"^(?=.*[0-9]{2})[0-9]{1,4}[/.\-][0-9]{1,4}[/.\-][0-9]{1,4}$")


def is_a_national_insurance_number(value: Str) -> Column:
    return F.regexp_replace(_c(value), "[ -]", "").rlike("^[A-Za-z]{2}[0-9]{6}[A-Za-z]$")


def is_a_reference(value: Str) -> Column:
    return _c(value).rlike("^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9/-]+$")


def is_a_group(value: Str) -> Column:
    """Letters and digits, with a digit or without a small letter."""
    return _c(value).rlike(r"^(?=.*\p{N}|[^\p{Ll}]+$)[\p{L}\p{N}]+$")


def is_an_outward_postcode(value: Str) -> Column:
    return _c(value).rlike("^(?=.{2,4}$)[A-Z]{1,2}[0-9]{1,2}[A-Z]?$")


def is_an_inward_postcode(value: Str) -> Column:
    return _c(value).rlike("^[0-9][A-Z]{2}$")


def nir_ok(value: Str) -> Column:
    """French, 15 characters; 2A and 2B count as 19 and 18; the key is 97 less the rest modulo 97."""
    v = _c(value)
    number = F.when(_part(v, 6, 2) == "2A", F.concat(_part(v, 1, 5), F.lit("19"), _part(v, 8, 6))).when(_part(v, 6, 2) == "2B", F.concat(_part(v, 1, 5), F.lit("18"), _part(v, 8, 6))).otherwise(_part(v, 1, 13))
    return _guarded(v, "^[123478][0-9]{4}(?:[0-9]{2}|2[AB])[0-9]{8}$", F.lit(97) - _int(number) % 97 == _int(_part(v, 14, 2)))


def siren_ok(value: Str) -> Column:
    v = _c(value)
    return _guarded(v, "^[0-9]{9}$", _luhn(v))


def siret_ok(value: Str) -> Column:
    """14 digits that pass Luhn; those of the post office (356000000) need a digit sum that 5 divides."""
    v = _c(value)
    return _guarded(v, "^[0-9]{14}$", _luhn(v) | (v.startswith("356000000") & (_fold(_numbers(v), 0, lambda a, x: a + x) % 5 == 0)))


def french_vat_ok(value: Str) -> Column:
    """FR, a key of two digits, and the SIREN that it is made from."""
    v = _c(value)
    siren = _part(v, 5, 9)
    return _guarded(v, "^FR[0-9]{11}$", (F.lit(12) + 3 * (_int(siren) % 97)) % 97 == _int(_part(v, 3, 2)))


_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def dni_ok(value: Str) -> Column:
    v = _c(value)
    return _guarded(v, "^[0-9]{8}[A-Z]$", F.substr(F.lit(_DNI), (_int(_part(v, 1, 8)) % 23 + 1).cast("int"), F.lit(1)) == _part(v, 9, 1))


def nie_ok(value: Str) -> Column:
    """X, Y or Z stand for 0, 1 or 2 before seven digits."""
    v = _c(value)
    return _guarded(v, "^[XYZ][0-9]{7}[A-Z]$", dni_ok(F.concat(F.translate(_part(v, 1, 1), "XYZ", "012"), _part(v, 2, 8))))


def cif_ok(value: Str) -> Column:
    """Spanish company number: doubled digits at odd places; the check is a digit or a letter as the first letter asks."""
    v = _c(value)
    digits = F.transform(F.split(_part(v, 2, 7), ""), lambda x: _int(x))
    total = F.aggregate(F.transform(F.filter(digits, lambda x: x.isNotNull()), lambda x, k: F.when(k % 2 == 0, F.floor(x * 2 / 10) + x * 2 % 10).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    check = (F.lit(10) - total % 10) % 10
    last, lead = _part(v, 9, 1), _part(v, 1, 1)
    as_digit, as_letter = last == check.cast("string"), last == F.substr(F.lit("JABCDEFGHI"), (check + 1).cast("int"), F.lit(1))
    test = F.when(lead.isin("A", "B", "E", "H"), as_digit).when(lead.isin("K", "P", "Q", "R", "S", "N", "W"), as_letter).otherwise(as_digit | as_letter)
    return _guarded(v, "^[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]$", test)


def seguridad_social_ok(value: Str) -> Column:
    """Spanish social security, 12 digits: province 1 to 53, number, two digits modulo 97."""
    v = _c(value)
    province, number = _int(_part(v, 1, 2)), _int(F.substr(v, F.lit(3), F.length(v) - 4))
    whole = F.when(number < 10_000_000, province * 10_000_000 + number).otherwise(province * 100_000_000 + number)
    return _guarded(v, "^[0-9]{12}$", province.between(1, 53) & (whole % 97 == _int(F.substr(v, F.length(v) - 1, F.lit(2)))))


def is_a_token(value: Str) -> Column:
    """__Z_ns_KIND_tail__ : four letters or digits, capitals and digits, four to eight letters or digits."""
    return _c(value).rlike("^__Z_[A-Za-z0-9]{4}_[A-Z0-9]+_[A-Za-z0-9]{4,8}__$")


#: By the name under which each can be asked for.
ALL: dict[str, Callable[[Str], Column]] = {
    f.__name__: f
    for f in (
        luhn_ok, is_a_card_number, iban_ok, is_an_email, is_a_short_date, is_a_long_date, looks_like_a_date, social_insurance_ok, tax_id_ok,
        is_a_numeric_date, is_a_national_insurance_number, is_a_reference, is_a_group, is_an_outward_postcode, is_an_inward_postcode,
        nir_ok, siren_ok, siret_ok, french_vat_ok, dni_ok, nie_ok, cif_ok, seguridad_social_ok, is_a_token,
    )
}
