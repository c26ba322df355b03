"""Small DOCX and PDF files for queries and tests."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F, types as T


def docx(paragraphs: list[str]) -> bytes:
    runs = "".join("<w:p><w:r>" + "<w:tab/>".join(f"<w:t>{escape(t)}</w:t>" for t in p.split("\t")) + "</w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{runs}</w:body></w:document>')
    return out.getvalue()


def pdf(pages: list[list[str]], font: str = "Type1") -> bytes:
    """A page for each list of lines, of one font."""
    kids = b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages)))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[%s]/Count %d>>" % (kids, len(pages)), b"<</Type/Font/Subtype/%s>>" % font.encode()]
    for k, lines in enumerate(pages):
        shown = b" 0 -14 Td ".join(b"(%s) Tj" % x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252", "replace") for x in lines)
        body = zlib.compress(b"BT /F1 12 Tf %s ET" % shown)
        objects += [b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % (5 + 2 * k), b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(body), body)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj%s endobj\n" % (k + 1, o) for k, o in enumerate(objects))


@F.pandas_udf(T.BinaryType())
def content(which: pd.Series, name: pd.Series, more: pd.Series) -> pd.Series:
    """0: a DOCX, 1: a PDF of two pages, 2: a PDF whose font has no map, 3: neither."""
    make = (lambda n, s: docx([f"Client {n}\tx", s]), lambda n, s: pdf([[f"Client {n}", s], ["End"]]), lambda n, s: pdf([[n]], font="Type0"), lambda n, s: b"x")
    return pd.Series([make[w](n, s) for w, n, s in zip(which, name, more, strict=True)])
