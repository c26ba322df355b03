"""Documents from files: TXT, DOCX and PDF through binaryFile, user lists from CSV, and limits that refuse by name.

A reader gives text, pages, readable (percent) and places, or a refusal: TooLarge, Empty, NotUtf8, Malformed, Encrypted,
TooManyPages, NoText, Unreadable, UnmappedFont, TooSlow, DisplayOrder, TooMuchText, Swells, UnknownKind. Nothing is read in part: a file is whole or refused.
"""

from __future__ import annotations

import contextlib
import csv
import io
import re
import signal
import threading
import time
import zipfile
import zlib
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.batches import by_batch, by_pieces, spread
from ..operators.staging import kept

MOST_BYTES, MOST_PAGES, MOST_TEXT = 25 << 20, 2000, 4 << 20
MOST_ENTRIES, MOST_ENTRY, MOST_RATIO, LEAST_UNPACKED = 512, 8 << 20, 200, 16 << 20
READABLE, DISPLAY_SHARE, LEAST_ARABIC = 80, 33, 8
RESULT = "path string, kind string, text string, pages int, readable int, places array<struct<start:int,page:int,paragraph:int>>, refusal string"


#: Seconds that a document may take.
MOST_SECONDS = 20.0


class Refused(Exception):
    """Why a document can't be read."""


class _Builder:
    """Text with the page and paragraph of each run."""

    def __init__(self) -> None:
        self.parts, self.size, self.places, self.page, self.paragraph = [], 0, [], 1, 1
        self.until = time.monotonic() + MOST_SECONDS

    def add(self, run: str) -> None:
        if run:
            if not self.places or self.places[-1][1:] != (self.page, self.paragraph):
                self.places.append((self.size, self.page, self.paragraph))
            self.parts.append(run)
            self.size += len(run)
            if self.size > MOST_TEXT:
                raise Refused("TooMuchText")
            if time.monotonic() > self.until:
                raise Refused("TooSlow")

    def break_page(self) -> None:
        self.page, self.paragraph = self.page + 1, 1
        if self.page > MOST_PAGES:
            raise Refused("TooManyPages")

    @property
    def text(self) -> str:
        return "".join(self.parts)


def read_txt(data: bytes) -> _Builder:
    try:
        text = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
    except UnicodeDecodeError:
        raise Refused("NotUtf8") from None
    out = _Builder()
    for piece in re.split("(\f|\n\n)", text):
        out.add(piece)
        if piece == "\f":
            out.break_page()
        elif piece == "\n\n":
            out.paragraph += 1
    return out


def unzip(data: bytes, name: str) -> bytes:
    """One entry, stored or deflated, within the limits of entries, size and ratio."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if len(z.infolist()) > MOST_ENTRIES:
                raise Refused("Malformed")
            entry = z.getinfo(name)
            if entry.flag_bits & 1:
                raise Refused("Encrypted")
            if entry.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise Refused("Malformed")
            with z.open(entry) as f:
                out = f.read(MOST_ENTRY + 1)
            if len(out) > MOST_ENTRY or len(out) > MOST_RATIO * max(1, entry.compress_size):
                raise Refused("Swells")
            return out
    except (zipfile.BadZipFile, KeyError, EOFError, zlib.error):
        raise Refused("Malformed") from None


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(data: bytes) -> _Builder:
    xml = unzip(data, "word/document.xml")
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise Refused("Malformed")
    out = _Builder()
    try:
        for event, node in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
            if event == "start":
                if node.tag == f"{_W}lastRenderedPageBreak" or (node.tag == f"{_W}br" and node.get(f"{_W}type") == "page"):
                    out.break_page()
            elif node.tag == f"{_W}t":
                out.add(node.text or "")
            elif node.tag == f"{_W}tab":
                out.add("\t")
            elif node.tag == f"{_W}br" and node.get(f"{_W}type") != "page":
                out.add("\n")
            elif node.tag == f"{_W}p":
                out.add("\n\n")
                out.paragraph += 1
    except ElementTree.ParseError:
        raise Refused("Malformed") from None
    return out


# -- PDF -------------------------------------------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = rb"(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?[0-9.]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _Pdf:
    def __init__(self, data: bytes) -> None:
        if not data.lstrip()[:5] == b"%PDF-":
            raise Refused("Malformed")
        if re.search(rb"/Encrypt\b", data):
            raise Refused("Encrypted")
        self.room = max(LEAST_UNPACKED, 32 * len(data))
        self.objects: dict[int, bytes] = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)
        self.fonts: dict[int, dict[bytes, str] | None] = {}

    def _unpack(self, body: bytes) -> None:
        raw, first, n = self.stream(body), re.search(rb"/First\s+(\d+)", body), re.search(rb"/N\s+(\d+)", body)
        if raw is None or not first or not n:
            return
        head = list(map(int, re.findall(rb"\d+", raw[: int(first[1])])[: 2 * int(n[1])]))
        at = [*head[1::2], len(raw) - int(first[1])]
        for k, number in enumerate(head[::2]):
            self.objects.setdefault(number, raw[int(first[1]) + at[k] : int(first[1]) + at[k + 1]])

    def stream(self, body: bytes) -> bytes | None:
        m = _STREAM.search(body)
        if not m:
            return None
        if b"/FlateDecode" not in body[: m.start()]:
            return m[1]
        try:
            unzip_ = zlib.decompressobj()
            out = unzip_.decompress(m[1], self.room)
        except zlib.error:
            raise Refused("Malformed") from None
        self.room -= len(out)
        if unzip_.unconsumed_tail or self.room <= 0:
            raise Refused("Swells")
        return out

    def pages(self) -> list[bytes]:
        """Page objects in the order of the tree."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        top = re.search(rb"/Pages\s+" + _REF, root) if root else None
        out: list[bytes] = []
        stack, seen = [int(top[1])] if top else [], set()
        while stack:
            k = stack.pop()
            body = self.objects.get(k)
            if body is None or k in seen:
                continue
            seen.add(k)
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                stack += [int(x) for x in re.findall(_REF, kids[1])][::-1]
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body)
            if len(out) > MOST_PAGES:
                raise Refused("TooManyPages")
        return out

    def _dictionary(self, body: bytes, name: bytes) -> bytes:
        m = re.search(rb"/" + name + rb"\s*(?:" + _REF + rb"|<<(.*?)>>)", body, re.S)
        return b"" if not m else self.objects.get(int(m[1]), b"") if m[1] else m[2]

    def page_fonts(self, page: bytes) -> dict[bytes, dict[bytes, str] | None]:
        own = page
        if not re.search(rb"/Resources", page) and (p := re.search(rb"/Parent\s+" + _REF, page)):
            own = self.objects.get(int(p[1]), b"")
        m = re.search(rb"/Resources\s+" + _REF, own)
        fonts = self._dictionary(self.objects.get(int(m[1]), b"") if m else own, b"Font")
        return {m[1]: self.font(int(m[2])) for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+" + _REF, fonts)}

    def font(self, number: int) -> dict[bytes, str] | None:
        """Code to text from the font's ToUnicode map; None where it has none. Composite fonts without one can't be read."""
        if number not in self.fonts:
            m = re.search(rb"/ToUnicode\s+" + _REF, self.objects.get(number, b""))
            if not m and re.search(rb"/Subtype\s*/Type0\b", self.objects.get(number, b"")):
                raise Refused("UnmappedFont")
            raw = self.stream(self.objects.get(int(m[1]), b"")) if m else None
            self.fonts[number] = _cmap(raw) if raw is not None else None
        return self.fonts[number]


def _hex(x: bytes) -> bytes:
    x = re.sub(rb"\s", b"", x)
    return bytes.fromhex((x + b"0" * (len(x) % 2)).decode())


def _cmap(raw: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    text = lambda h: _hex(h).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]*)>", block):
            out[_hex(a)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
        for a, z, b, many in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*(?:<([0-9A-Fa-f\s]*)>|\[(.*?)\])", block, re.S):
            size, lo, hi = len(_hex(a)), int(_hex(a).hex(), 16), int(_hex(z).hex(), 16)
            listed = re.findall(rb"<([0-9A-Fa-f\s]*)>", many)
            for k in range(min(hi - lo, 65535) + 1):
                out[(lo + k).to_bytes(size, "big")] = text(listed[k]) if k < len(listed) else (text(b)[:-1] + chr(ord(text(b)[-1]) + k) if b else "")
    return out


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        return _hex(token[1:-1])
    body = re.sub(rb"\\\r?\n", b"", token[1:-1])
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def _decode(code: bytes, font: dict[bytes, str] | None) -> str:
    if font is None:
        return code.decode("cp1252", "replace")
    size = max(map(len, font), default=1)
    return "".join(font.get(code[k : k + size], "�") for k in range(0, len(code), size))


def _number(operand: bytes) -> float:
    """A number of a content stream; other operands where one has to stand make the file malformed."""
    try:
        return float(operand)
    except ValueError:
        raise Refused("Malformed") from None


def _page_text(content: bytes, fonts: dict) -> str:
    out: list[str] = []
    stack: list[bytes] = []
    font, line = None, None
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/+-.0123456789":
            stack.append(t)
            continue
        if t == b"Tf" and len(stack) >= 2:
            font = fonts.get(stack[-2][1:], None)
        elif t in (b"Tj", b"'", b'"') and stack:
            if t != b"Tj":
                out.append("\n")
            out.append(_decode(_literal(stack[-1]), font))
        elif t == b"TJ":
            for x in stack:
                if x[:1] in b"(<":
                    out.append(_decode(_literal(x), font))
                elif x[:1] in b"-0123456789." and _number(x) < -180:
                    out.append(" ")
        elif t in (b"Td", b"TD") and len(stack) >= 2:
            out.append("\n" if _number(stack[-1]) else " ")
        elif t == b"T*":
            out.append("\n")
        elif t == b"Tm" and len(stack) >= 6:
            if line is not None and stack[-1] != line:
                out.append("\n")
            line = stack[-1]
        stack = []
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()


def read_pdf(data: bytes) -> _Builder:
    pdf, out = _Pdf(data), _Builder()
    pages = pdf.pages()
    if not pages:
        raise Refused("Malformed")
    for k, page in enumerate(pages):
        if k:
            out.add("\f")
            out.break_page()
        refs = re.search(rb"/Contents\s*(?:" + _REF + rb"|\[(.*?)\])", page, re.S)
        numbers = [] if not refs else [int(refs[1])] if refs[1] else [int(x) for x in re.findall(_REF, refs[2])]
        content = b"\n".join(pdf.stream(pdf.objects.get(n, b"")) or b"" for n in numbers)
        text = _page_text(content, pdf.page_fonts(page))
        if readable_percent(text) < READABLE:
            raise Refused("Unreadable")
        for n, block in enumerate(text.split("\n\n")):
            out.paragraph = n + 1
            out.add(("\n\n" if n else "") + block)
    if not out.text.strip("\f \n"):
        raise Refused("NoText")
    return out


READERS = {"txt": read_txt, "docx": read_docx, "pdf": read_pdf}


def readable_percent(text: str) -> int:
    marks = [c for c in text if not c.isspace()]
    return 100 if not marks else 100 * sum(c != "�" and (c.isprintable()) for c in marks) // len(marks)


def display_share(text: str) -> int | None:
    """Percent of Arabic letters in presentation forms; None under 8 of them."""
    shown = sum("ﭐ" <= c <= "﷿" or "ﹰ" <= c <= "﻿" for c in text)
    all_ = shown + sum("؀" <= c <= "ۿ" for c in text)
    return None if all_ < LEAST_ARABIC else 100 * shown // all_


@contextlib.contextmanager
def _within(seconds: float):
    """Stops what takes longer, wherever it is: a timer of the worker's main thread, in which Spark runs its functions."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise Refused("TooSlow")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract(data: bytes, kind: str, protecting: bool = True, seconds: float = MOST_SECONDS) -> _Builder:
    if len(data) > MOST_BYTES:
        raise Refused("TooLarge")
    if not data:
        raise Refused("Empty")
    if kind not in READERS:
        raise Refused("UnknownKind")
    try:
        with _within(seconds):
            out = READERS[kind](data)
    except (ArithmeticError, AttributeError, EOFError, LookupError, RecursionError, TypeError, ValueError, zlib.error) as why:  # a file's own faults never stop the others
        raise Refused("Malformed") from why
    if protecting and (display_share(out.text) or 0) >= DISPLAY_SHARE:
        raise Refused("DisplayOrder")
    return out


def read_documents(spark: SparkSession, path: str, protecting: bool = True, glob: str = "*.{txt,docx,pdf}") -> DataFrame:
    """A row a file under path, read or refused by name; the kind is the file's extension. Files over MOST_BYTES are refused by
    the listing alone: their content is never loaded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return extracted(files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), "length", "content"), protecting)


def extracted(files: DataFrame, protecting: bool = True, most_bytes: int = MOST_BYTES, seconds: float = MOST_SECONDS) -> DataFrame:
    """From path, kind, content (and length, where the files' listing gives it): text, pages … or a refusal. A file that is too large
    doesn't reach the reader; one that takes longer than `seconds` is stopped.

    Files of a listing are parted by it, so that large ones are never loaded; contents at hand, which may cost much to make, are gone
    through once."""
    if "length" not in files.columns:
        large = F.coalesce(F.octet_length("content"), F.lit(0)) > most_bytes
        at_hand = spread(files).select("path", "kind", F.when(~large, F.col("content")).alias("content"), large.alias("large"))
        return _read(at_hand, protecting, seconds)
    size = F.coalesce("length", F.lit(0))
    large = files.where(size > most_bytes).select("path", "kind")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(RESULT).fields[2:-1]]
    refused = large.select("path", "kind", *nothing, F.lit("TooLarge").alias("refusal"))
    return _read(spread(files.where(size <= most_bytes).select("path", "kind", "content")), protecting, seconds).unionByName(refused)


def _read(files: DataFrame, protecting: bool, seconds: float) -> DataFrame:
    """path, kind, content; and large, where a content that was too large is left out."""
    places = pa.list_(pa.struct([("start", pa.int32()), ("page", pa.int32()), ("paragraph", pa.int32())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        marked = b.column("large").to_pylist() if "large" in b.schema.names else [False] * b.num_rows
        for path, kind, data, large in zip(*(b.column(c).to_pylist() for c in ("path", "kind", "content")), marked, strict=True):
            try:
                if large:
                    raise Refused("TooLarge")
                r = extract(bytes(data or b""), kind, protecting, seconds)
                out.append((path, kind, r.text, r.page, readable_percent(r.text), [{"start": s, "page": p, "paragraph": g} for s, p, g in r.places], None))
            except Refused as why:
                out.append((path, kind, None, None, None, None, str(why)))
        kinds = pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), places, pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "kind", "text", "pages", "readable", "places", "refusal"])

    return by_batch(files, run, RESULT)


def place_of(read: DataFrame, start: Column) -> Column:
    """page and paragraph of an offset: the last place that begins at or before it."""
    return F.try_element_at(F.filter("places", lambda p: p["start"] <= start), F.lit(-1))


# -- user lists ------------------------------------------------------------------------------------------------------------

#: What a further column of a user's list holds, by its header.
COLUMNS = {"email": "Email", "e-mail": "Email", "mail": "Email", "phone": "Phone", "telefon": "Phone", "tel": "Phone", "mobile": "Phone", "mobil": "Phone", "iban": "Iban", "bic": "Bic", "address": "Address", "adresse": "Address", "customer number": "CustomerNo", "kundennummer": "CustomerNo", "tax id": "TaxId", "steuernummer": "TaxId", "birthdate": "Birthdate", "geburtsdatum": "Birthdate"}
TYPES = ("given", "family", "person", "company")


def split_line(line: str) -> list[str]:
    """Semicolons separate if the line has one and no comma; a quote toggles, and two of them are none."""
    sep = ";" if ";" in line and "," not in line else ","
    out, quoted = [""], False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == sep and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def user_list(text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]], list[str], list[str]]:
    """(names, values, reasons of refused lines, columns not used) of a list with a header of name and type."""
    lines = [x for x in text.removeprefix("﻿").splitlines() if x.strip() and not x.startswith("#")]
    head = [h.lower() for h in split_line(lines[0])] if lines else []
    if "name" not in head or "type" not in head:
        return [], [], ["the header needs name and type"], head
    names, values, reasons = [], [], []
    for n, line in enumerate(lines[1:], 2):
        row = dict(zip(head, split_line(line), strict=False))
        if not row.get("name"):
            reasons.append(f"line {n}: no name")
        elif row.get("type", "").lower() not in TYPES:
            reasons.append(f"line {n}: unknown type")
        else:
            names.append((row["name"], row["type"].lower()))
            values += [(COLUMNS[h], v) for h, v in row.items() if h in COLUMNS and v]
    return names, values, reasons, [h for h in head if h not in ("name", "type", "source", "licence", *COLUMNS)]


def user_lists(files: DataFrame) -> DataFrame:
    """From path, content of people's own lists (UTF-8): path, names (name, type), values (kind, value), refused (why), unused (columns)."""
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))
    kinds = pa.string(), pair("name", "type"), pair("kind", "value"), pa.list_(pa.string()), pa.list_(pa.string())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for path, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            names, values, reasons, unused = user_list((data or b"").decode("utf-8", "replace"))
            out.append((path, [{"name": n, "type": t} for n, t in names], [{"kind": k, "value": v} for k, v in values], reasons, unused))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "names", "values", "refused", "unused"])

    return by_batch(files.select("path", "content"), run, "path string, names array<struct<name:string,type:string>>, values array<struct<kind:string,value:string>>, refused array<string>, unused array<string>")


def registers(spark: SparkSession, city_paths: dict[str, str]) -> DataFrame:
    """city -> path of newborn registers, read by register_rows()."""
    files = [spark.read.format("binaryFile").load(path).select(F.lit(city).alias("city"), "content") for city, path in city_paths.items()]
    return register_rows(reduce(DataFrame.unionByName, files))


def register_rows(files: DataFrame) -> DataFrame:
    """From city, content: city, name, count, gender. Each file is UTF-8 (with or without a mark) or else cp1252, parted by semicolons
    or commas, with vorname, anzahl and geschlecht among its headings in any case."""

    def run(batches):
        for b in batches:
            out = []
            for city, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    text = data.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = data.decode("cp1252", "replace")
                lines = text.splitlines()
                sep = ";" if lines and ";" in lines[0] else ","
                for row in csv.DictReader([lines[0].lower(), *lines[1:]] if lines else [], delimiter=sep):
                    name, n = (row.get("vorname") or "").strip(), (row.get("anzahl") or "").strip()
                    if name and n.isdigit():
                        out.append((city, name, int(n), (row.get("geschlecht") or "").strip().lower()))
            kinds = pa.string(), pa.string(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["city", "name", "count", "gender"])

    return by_pieces(files.select("city", "content"), run, "city string, name string, count long, gender string")


def arabic_library(lines: DataFrame) -> DataFrame:
    """From line_no, value of a sectioned text (headings in brackets): name, section. Each line takes the last heading above it (null: none):
    in its own range of lines, else the last one of the ranges before, of which there is a row each."""
    head = F.when(F.col("value").rlike(r"^\[.*\]$"), F.struct("line_no", F.regexp_extract("value", r"^\[(.*)\]$", 1).alias("section")))
    dealt = kept(lines.select("line_no", "value").repartitionByRange("line_no").select("line_no", "value", head.alias("head"), F.spark_partition_id().alias("part")), "library-lines")
    before = F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    above = dealt.groupBy("part").agg(F.max("head").alias("last")).select("part", before.alias("before"))  # a row a range
    inside = F.max("head").over(Window.partitionBy("part").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1))
    names = dealt.withColumn("inside", inside).where(F.col("head").isNull() & (F.trim("value") != "")).join(F.broadcast(above), "part")
    return names.select(F.trim("value").alias("name"), F.coalesce("inside", "before")["section"].alias("section"))
