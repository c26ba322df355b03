"""A test for each finding of round 4."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shroud.operators import contains, windows
from shroud.operators.known import occurrences

LETTERS = ["an", "na", "meier", "müller", "straße", "STRASSE", "x1", "ب", "محمد", "日本", "a", "ß", "İ", "о", "K", "ſ", "ı", "é", "é", "22", "ǰ"]
GAPS = [" ", " ", " ", "\n", "-", "‑", "-\n", "­\n", "_", ", ", "", "·", "++", "  ", "\x1f"]


def made(rng, n, letters):
    return "".join(rng.choice(letters) + rng.choice(GAPS) for _ in range(n))


def test_windows_turn_away_nothing_that_stands():
    """Cut and joined words, other scripts, spellings of more stretches than a window has, and lengths and first stretches not looked at."""
    rng, plain, held = random.Random(4), [x for x in LETTERS if x.isascii()], 0
    for _ in range(12):
        texts = [made(rng, rng.randrange(30), rng.choice([LETTERS, plain])) for _ in range(30)]
        cuts = [t[a : a + rng.randint(1, 30)] for t in texts for a in (rng.randrange(len(t) + 1) for _ in range(8))]
        spellings = [s.replace("-\n", rng.choice(["", "-\n"])).replace("\n", " ") for s in cuts + [made(rng, rng.randint(1, 7), LETTERS) for _ in range(100)]]
        w = windows.Windows(pa.array([*spellings, None]))
        for lengths, heads in (([1, 2, 3, 4], None), ([2, 4], np.unique(w.head)[::3]), ([1], np.unique(w.head)[:5])):
            for text in texts:
                lacks = ~np.isin(w.hash, windows.text_windows(pa.array([text]), lengths, heads)) & np.isin(w.n, lengths) & (heads is None or np.isin(w.head, heads))
                away = set(w.row[lacks].tolist())
                stands = {k for k, s in enumerate(spellings) if occurrences(text, s)}
                held += len(stands)
                assert not away & stands
    assert held > 1000


def test_a_long_text_has_the_windows_of_a_short_one():
    words = [f"w{k}" for k in range(200_000)]  # more than is hashed at once
    got = windows.text_windows(pa.array([" ".join(words)]), [1, 3], None)
    assert set(got.tolist()) == {*windows.hash_strings(words).tolist(), *windows.hash_strings(["".join(words[k : k + 3]) for k in range(len(words) - 2)]).tolist()}
    assert len(set(windows.hash_strings(words).tolist())) == len(words)


@pytest.mark.parametrize(("first", "few", "lists"), [(1 << 16, 1 << 10, False), (1 << 16, 0, True), (3, 1 << 10, False), (1 << 16, 1 << 10, True)])
def test_of_many_spellings_those_that_no_text_holds_are_never_shuffled(spark, monkeypatch, first, few, lists):
    """vault_contains (F1): all 9000 were shuffled, written and met their texts."""
    written, kept = {}, contains.kept
    monkeypatch.setattr(contains, "kept", lambda df, name: written.update({name: kept(df, name)}) or written[name])
    monkeypatch.setattr(contains, "dropped", lambda *tables: None)
    for name, value in (("MANY", 1000), ("FIRST", first), ("FEW", few)):
        monkeypatch.setattr(windows, name, value)
    docs = spark.createDataFrame([(k, f"Order {k}\nline {k % 7}") for k in range(1000)] + [(1000, "or-\nder 5 li-\nne 8, größer als 1 日本語"), (1001, None), (1002, "line")], "doc_id int, text string")
    rows = [(f"order {k} line {n}",) for k in range(1000) for n in range(9)] + [("order 3  LINE 3",), ("größer ALS",), ("本語",), ("line",), (" ",), (None,), ("line",)]
    spellings = spark.createDataFrame(rows, "spelling string").coalesce(1)
    if lists:
        spellings = spark.createDataFrame([([s for s, in rows[k : k + 70]],) for k in range(0, len(rows), 70)] + [([],), (None,)], "spelling array<string>").coalesce(1)
    got = sorted((r["doc_id"], r["spelling"], r["start"], r["end"]) for r in contains.places(docs, spellings).collect())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    line = [(k, "line", a, z) for k, t in texts.items() for a, z in occurrences(t, "line")]
    each = [(k, f"order {k} line {k % 7}", 0, len(texts[k])) for k in range(1000)]
    odd = [(k, s, *occurrences(texts[k], s)[0]) for k, s in ((3, "order 3  LINE 3"), (1000, "größer ALS"), (1000, "本語"), (1000, "order 5 line 8"))]
    assert got == sorted(line + each + odd)
    assert written["contains-spellings"].count() < 1200
    assert windows.may_stand(docs.where(F.lit(False)), spellings)[0].where("spelling like 'order%'").count() <= (9001 if first == 3 else 20)
