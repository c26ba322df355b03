"""Rules of single languages: plates, addresses, local phones, Arabic names, and numbers with a checksum."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

from .lexicon import AR, DE, EN, ES, FR, Pack
from .people import LINE, Names
from .words import EDGE, LANGUAGE, Facts, Hit, Kept, Lexer, Marks, Reading, capital, is_number, nfc

Rule = Callable[[Reading, Names], Iterable[Hit]]


def _hit(pack: Pack, doc: Reading, a: int, z: int, kind: str, sure: bool, rule: str) -> Hit:
    return Hit(doc.starts[a], doc.bare_end(z), kind, sure, LANGUAGE, f"{pack.id}:{rule}")


# -- German and English ------------------------------------------------------------------------------------------------

(PLATE, FOUR, ZERO, DIGITS, SAYS_PHONE, POSTCODE, TOWN, STREET, NUMBER, JOINS) = (1 << k for k in range(10))


def _german(text: str) -> int:
    bare = text.strip(EDGE)
    low = bare.lower()
    if text.isalpha() and not capital(text) and low not in DE.more["phone_words"] and not low.endswith(DE.more["streets"]):
        return 0
    town, dash, letters = bare.partition("-")
    digits = bare.isascii() and bare.isdigit()
    plate = dash and 1 <= len(town) <= 3 and 1 <= len(letters) <= 2 and (town + letters).isalpha() and (town + letters).isupper()
    joins = capital(bare) and bare not in DE.stop_words and text[-1] not in ",.:"
    tests = (plate, digits and len(bare) <= 4, digits and len(bare) >= 3 and bare[0] == "0", digits, low.rstrip(":") in DE.more["phone_words"], digits and len(bare) == 5, capital(text), low.endswith(DE.more["streets"]), is_number(text), joins)
    return sum(1 << k for k, true in enumerate(tests) if true)


_de = Kept(_german)


def german(doc: Reading, _: Names) -> Iterator[Hit]:
    """Plates, local phones, addresses: all are found from their words with digits."""
    if not doc.numbers:
        return
    bits = list(map(_de.__getitem__, doc.words))
    is_ = lambda k, what: 0 <= k < len(bits) and bits[k] & what
    same_line = lambda k: doc.gaps[k] in " \f"
    for k in doc.numbers:
        if bits[k] & FOUR and is_(k - 1, PLATE) and same_line(k):
            yield _hit(DE, doc, k - 1, k, "Vehicle", True, "plate")
    for k in [k for k in doc.numbers if bits[k] & ZERO]:
        # A word that names a phone, up to six words before; the first word of a line doesn't count.
        line = max(doc.gaps.rfind("\n", 0, k), doc.gaps.rfind("\v", 0, k)) + 1
        if any(is_(b, SAYS_PHONE) for b in range(max(line, k - 6), k)):
            last = next((z for z in range(k, k + 3) if not (is_(z + 1, DIGITS) and same_line(z + 1))), k + 3)
            yield _hit(DE, doc, k, last, "Phone", True, "local-phone")
    for k in [k for k in doc.numbers if bits[k] & POSTCODE and is_(k + 1, TOWN)]:
        first = k
        if is_(k - 1, NUMBER) and is_(k - 2, STREET):
            first = k - 2 - bool(is_(k - 3, JOINS) and same_line(k - 2))
        yield _hit(DE, doc, first, k + 1, "Address", False, "address")


(INWARD, OUTWARD, STEP, HOUSE) = (1 << k for k in range(4))


def _english(text: str) -> int:
    bare, label, number = text.strip(EDGE), text.endswith(":"), is_number(text)
    if bare.isalpha():
        return STEP * (capital(bare) and not label)
    tests = (re.fullmatch("[0-9][A-Z]{2}", bare), re.fullmatch("(?=.{2,4}$)[A-Z]{1,2}[0-9]{1,2}[A-Z]?", bare), capital(bare) and not number and not label, number and not label)
    return sum(1 << k for k, true in enumerate(tests) if true)


_en = Kept(_english)


def english(doc: Reading, _: Names) -> Iterator[Hit]:
    """A postcode's two halves, with a house number at most six words before them, capitals between."""
    for k in doc.numbers:
        if k and _en[doc.words[k]] & INWARD and _en[doc.words[k - 1]] & OUTWARD:
            before = [_en[w] for w in doc.words[max(0, k - 7) : k - 1]][::-1]
            steps = next((n for n, b in enumerate(before) if not b & STEP), len(before))
            house = steps < len(before) and before[steps] & HOUSE
            yield _hit(EN, doc, k - 2 - steps if house else k - 1, k, "Address", False, "address")


# -- Arabic --------------------------------------------------------------------------------------------------------------

_MARKS = re.compile("[ً-ْٰـٓ-ٕ]")
_ARABIC = re.compile("[؀-ۿ]")
_AR_EDGE = ".,;:!?\"()»«،؛؟"
_DIGITS = re.compile(r"(?<!\S)[.,;:!?\"()»«،؛؟]*([٠-٩۰-۹–-]+(?:[^\S\n]+[٠-٩۰-۹–-]+)*)(?=[.,;:!?\"()»«،؛؟]*(?!\S))")
(OPENER, HONOUR, NAME, CLOSED) = range(4)


def _folded(text: str) -> str:
    return _MARKS.sub("", nfc(text.strip(_AR_EDGE)))


def _arabic(text: str) -> int:
    bare, fold = text.strip(_AR_EDGE), _folded(text)
    letters = len(fold) >= 2 and all("؀" <= c <= "ۿ" and c.isalpha() for c in fold)
    opener = fold in AR.salutations or fold in AR.titles or text in AR.titles
    name = letters and fold not in AR.function_words and fold not in AR.stop_words and fold not in AR.more["courtesies"] and text[-1] != ":"
    tests = (opener, opener or fold in AR.more["courtesies"], name, bare != text)
    return sum(1 << k for k, true in enumerate(tests) if true)


_ar = Facts(lambda w: _arabic(w.text), AR.salutations | AR.titles)
_ar_lexer = Lexer(_ar)
_ar_marks = Marks(_ar, *[lambda b, k=k: b >> k & 1 for k in range(4)])
_open, _last = _ar_marks.all(NAME, without=(CLOSED,)), _ar_marks.all(NAME)
_AR_NAME = re.compile(f"{_ar_marks.all(OPENER)}(?:{LINE}{_ar_marks.all(HONOUR)})*+(?P<name>(?:{LINE}{_open}){{0,3}}{LINE}{_last})")


def arabic(doc: Reading, names: Names) -> Iterator[Hit]:
    """Names of up to four words after a salutation or title and its courtesies; known given names; numbers in Arabic digits."""
    if not _ARABIC.search(doc.text):
        return
    made = lambda a, z, sure, rule: Hit(doc.starts[a], doc.starts[z] + len(doc.words[z].rstrip(_AR_EDGE)), "Person", sure, LANGUAGE, f"ar:{rule}")
    classes = _ar_lexer.of(doc)
    for m in _AR_NAME.finditer(doc.spelled(classes.translate(_ar_marks))):
        yield made(m.start("name") // 2, (m.end() - 1) // 2, True, "salutation")
    for k, c in enumerate(classes):
        if _ar.bits[ord(c)] >> NAME & 1 and names.is_given(_folded(doc.words[k])):
            if not ((after := doc.on_line(k + 1)) and (_folded(doc.words[k]), _folded(after.text)) in AR.more["fixed"]):
                yield made(k, k, False, "name-library")
    for m in _DIGITS.finditer(doc.text):
        if 8 <= sum(map(str.isdigit, m[1])) <= 15:
            yield Hit(m.start(1), m.end(1), "Phone", False, LANGUAGE, "ar:digits-local")


# -- numbers with a checksum ---------------------------------------------------------------------------------------------


@dataclass
class Run:
    """Words on a line read as one number: its characters, the lengths of its groups, and the words before it."""

    doc: Reading
    first: int
    last: int
    text: str
    pieces: tuple[str, ...]

    @cached_property
    def groups(self) -> tuple[int, ...]:
        return tuple(sum(map(str.isalnum, p)) for p in self.pieces)

    @cached_property
    def before(self) -> frozenset:
        return _before(self.doc, self.first)

    def in_groups(self, *shapes: tuple[int, ...]) -> bool:
        return self.groups in shapes


#: Every number of a language has as many digits at least; shorter runs aren't read at all.
LEAST_DIGITS, LONGEST_RUN = 7, 7
_RUNNABLE = re.compile(r"(?=.*[A-Za-z0-9])\+?[A-Za-z0-9./-]+")


_CUT = re.compile("[./-]")


def _piece(text: str) -> tuple | None:
    """Of a word that can stand in a number: its pieces, whether it can only begin one, whether it ends one."""
    bare = text.strip(EDGE)
    if text[-1] == ":" or not _RUNNABLE.fullmatch(bare):
        return None
    return (bare,) if bare.isalnum() else tuple(p for p in _CUT.split(bare) if p), "+" in bare, text[-1] in ",;:.!?)"


_pieces = Kept(_piece)


def number_runs(doc: Reading) -> list[tuple[int, list[Run]]]:
    """For each word that can begin a number, its runs from the longest to the shortest."""
    total = [0, *accumulate(doc.digits)]
    if total[-1] < LEAST_DIGITS:
        return []
    out, n = [], len(doc.words)
    words, gaps, numbers = doc.words, doc.gaps, doc.numbers
    for k in range(max(0, numbers[0] - LONGEST_RUN + 1), numbers[0] + 1) if len(numbers) == 1 else sorted({a for d in numbers for a in range(max(0, d - LONGEST_RUN + 1), d + 1)}):
        end = min(k + LONGEST_RUN, n)
        if total[end] - total[k] < LEAST_DIGITS:
            continue
        pieces: tuple[str, ...] = ()
        found: list[Run] = []
        for x in range(k, end):
            piece = _pieces[words[x]]
            if piece is None or (x > k and (gaps[x] != " " or piece[1])):
                break
            pieces += piece[0]
            if total[x + 1] - total[k] >= LEAST_DIGITS:
                found.append(Run(doc, k, x, "".join(pieces), pieces))
            if piece[2]:
                break
        if found:
            out.append((k, found[::-1]))
    return out


def _before(doc: Reading, k: int) -> frozenset:
    """Up to four words before, on its line, in small letters; words of marks alone aren't counted."""
    out: list[str] = []
    while k > 0 and doc.gaps[k] in " \f" and len(out) < 4:
        k -= 1
        if low := doc.words[k].strip(EDGE).lower():
            out.append(low)
    return frozenset(out)


def checked(doc: Reading, rule: Callable[[Run], tuple[str, bool, str] | None], sizes: frozenset, pack: Pack) -> Iterator[Hit]:
    """From each word the longest run that the rule takes; the next begins after it. sizes: how many characters its numbers have."""
    done = 0
    for k, found in doc.runs:
        if k >= done and (taken := next(((r, v) for r in found if len(r.text) in sizes and (v := rule(r))), None)):
            run, (kind, sure, name) = taken
            first, last = doc.words[run.first], doc.words[run.last]
            a = doc.starts[run.first] + len(first) - len(first.lstrip(EDGE))
            yield Hit(a, doc.starts[run.last] + len(last.rstrip(EDGE)), kind, sure, LANGUAGE, f"{pack.id}:{name}")
            done = run.last + 1


#: Twice a digit, its own digits summed.
_DOUBLED = str.maketrans("0123456789", "0246813579")


def _luhn(s: str) -> bool:
    return (sum(map(int, s[::-2])) + sum(map(int, s[-2::-2].translate(_DOUBLED)))) % 10 == 0


def _digits(s: str, n: int) -> bool:
    return len(s) == n and s.isascii() and s.isdigit()


def _nir(r: Run):
    m = re.fullmatch(r"([123478][0-9]{4})([0-9]{2}|2[AB])([0-9]{6})([0-9]{2})", r.text)
    if m and 97 - int(m[1] + {"2A": "19", "2B": "18"}.get(m[2], m[2]) + m[3]) % 97 == int(m[4]):
        return "SocialInsuranceNo", r.in_groups((1, 2, 2, 2, 3, 3, 2), (13, 2)) or bool(r.before & {"nir", "sécurité", "sociale", "insee", "sécu"}), "nir"
    return None


def _siret(r: Run):
    t = r.text
    if _digits(t, 14) and (_luhn(t) or (t.startswith("356000000") and sum(map(int, t)) % 5 == 0)):
        return "TaxId", r.in_groups((3, 3, 3, 5), (9, 5)) or "siret" in r.before, "siret"
    if _digits(t, 9) and _luhn(t) and r.in_groups((3, 3, 3), (9,)):
        return "TaxId", bool(r.before & {"siren", "siret", "rcs"}), "siren"
    return None


def _french_vat(r: Run):
    m = re.fullmatch("FR([0-9A-Z]{2})([0-9]{9})", r.text)
    if not m:
        return None
    if m[1].isdigit():
        return ("TaxId", True, "vat") if int(m[1]) == (12 + 3 * (int(m[2]) % 97)) % 97 else None
    return ("TaxId", False, "vat") if _luhn(m[2]) else None


def _fiscal(r: Run):
    if _digits(r.text, 13) and r.text[0] in "0123" and r.in_groups((13,), (2, 2, 3, 3, 3)):
        return "TaxId", bool(r.before & {"fiscal", "spi"}), "numero-fiscal"
    return None


def _french_phone(r: Run):
    if r.text.startswith("+33"):
        return ("Phone", True, "phone") if re.fullmatch("[1-9][0-9]{8}", r.text[3:]) else None
    if re.fullmatch("0[1-9][0-9]{8}", r.text) and r.in_groups((2, 2, 2, 2, 2), (10,)):
        return "Phone", r.in_groups((2, 2, 2, 2, 2)), "phone"
    return None


_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _dni(t: str) -> bool:
    return t[:1].isdigit() and bool(re.fullmatch("[0-9]{8}[A-Z]", t)) and _LETTERS[int(t[:8]) % 23] == t[8]


def _nie(t: str) -> bool:
    return t[:1] in ("X", "Y", "Z") and bool(re.fullmatch("[XYZ][0-9]{7}[A-Z]", t)) and _dni(str("XYZ".index(t[0])) + t[1:])


def _cif(t: str) -> bool:
    if t[:1].isdigit() or not re.fullmatch("[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]", t):
        return False
    d = [int(c) for c in t[1:8]]
    check = -sum(sum(divmod(2 * x, 10)) if k % 2 == 0 else x for k, x in enumerate(d)) % 10
    digit, letter = t[8] == str(check), t[8] == "JABCDEFGHI"[check]
    return letter if t[0] in "KPQRSNW" else digit if t[0] in "ABEH" else digit or letter


def _spanish_id(r: Run):
    return ("IdCard", True, "dni") if _dni(r.text) else ("IdCard", True, "nie") if _nie(r.text) else None


def _spanish_social(r: Run):
    t = r.text
    if not _digits(t, 12) or not 1 <= int(t[:2]) <= 53 or not r.in_groups((2, 8, 2), (12,)):
        return None
    p, m = int(t[:2]), int(t[2:10])
    if (p * 10**7 + m if m < 10**7 else p * 10**8 + m) % 97 != int(t[10:]):
        return None
    return "SocialInsuranceNo", r.in_groups((2, 8, 2)) or bool(r.before & {"social", "nuss", "naf", "afiliación"}), "seguridad-social"


#: Rules with the sizes that their numbers can have.
_FRENCH = ((_nir, frozenset({15})), (_siret, frozenset({9, 14})), (_french_vat, frozenset({13})), (_fiscal, frozenset({13})), (_french_phone, frozenset({10, 12})))
_SPANISH = (
    (_spanish_id, frozenset({9})),
    (lambda r: ("TaxId", True, "cif") if _cif(r.text) else None, frozenset({9})),
    (lambda r: ("TaxId", True, "vat") if r.text.startswith("ES") and (_dni(r.text[2:]) or _nie(r.text[2:]) or _cif(r.text[2:])) else None, frozenset({11})),
    (_spanish_social, frozenset({12})),
    (lambda r: ("Phone", True, "phone") if re.fullmatch(r"\+34[6-9][0-9]{8}", r.text) else None, frozenset({12})),
)


def _by_number(doc: Reading, rules: tuple, pack: Pack) -> list[Hit]:
    """What rules find among the runs of a text; a rule for whose sizes there is no run is passed."""
    if doc.runs is None:
        doc.runs = number_runs(doc)
        doc.run_sizes = frozenset([len(r.text) for _, found in doc.runs for r in found])
    there = doc.run_sizes
    return [h for rule, sizes in rules if not sizes.isdisjoint(there) for h in checked(doc, rule, sizes, pack)] if there else []


def french(doc: Reading, _: Names) -> Iterable[Hit]:
    return _by_number(doc, _FRENCH, FR)


def spanish(doc: Reading, _: Names) -> Iterable[Hit]:
    return _by_number(doc, _SPANISH, ES)


#: Extension point: more rules of a language can be added here before a scan.
EXTRA: dict[str, list[Rule]] = {"de": [german], "en": [english], "ar": [arabic], "fr": [french], "es": [spanish], "sv": []}
