"""Neighbours of words against plain loops."""

import random
import re

from pyspark.sql import functions as F

from shroud.operators import adjacent


def test_neighbours(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["Anna", "Weber", "tel", "123456", "x", "é\U0001F600"]) + rng.choice([" ", "  ", "\n", "\t", " \f", "\r"]) for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, "", " ", "Anna", " \nAnna Weber"]
    name = lambda w: w["value"].rlike("^[A-Z][a-z]+$")
    w = adjacent.words(F.col("text"))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("w", w)
    got = df.select("id", "w", adjacent.pairs(F.col("w"), name, name).alias("p"), adjacent.led_by(F.col("w"), lambda x: x["value"].rlike("^[0-9]+$"), lambda x: x["value"] == "tel", 3).alias("l"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        text = texts[r["id"]] or ""
        ws, at = [], 0
        for m in re.finditer(r"[^ \t\n\r\f]+", text):
            ws.append((m.start(), m.end(), m[0], text[at : m.start()]))
            at = m.end()
        assert [tuple(x) for x in r["w"]] == ws
        new = ["\n" in g or "\f" in g for *_, g in ws]
        is_name = [bool(re.fullmatch("[A-Z][a-z]+", x[2])) for x in ws]
        assert [(p["a"]["start"], p["b"]["start"]) for p in r["p"]] == [(ws[k][0], ws[k + 1][0]) for k in range(len(ws) - 1) if is_name[k] and is_name[k + 1] and not new[k + 1]]
        led = [x[0] for k, x in enumerate(ws) if x[2].isdigit() and any(ws[j][2] == "tel" and not any(new[j + 1 : k + 1]) for j in range(max(0, k - 3), k))]
        assert [x["start"] for x in r["l"]] == led


def test_patterns_find_what_words_beside_each_other_are(spark):
    """Also where a text has very many words, of which an array took seconds."""
    rng = random.Random(5)
    some = ["Anna", "Weber.", "Tel:", "phone", "+49", "a123b", "99", "x", "é\U0001F600", "Ab ", "tel,tel", "12345.", "Mobile"]
    texts = ["".join(rng.choice(some) + rng.choice([" ", "  ", "\n", "\t", " \f", "\r", " "]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, "", "Tel", "tel 123", "a tel x x x x x 123 123"]
    many = "x y " * 300_000 + "Anna Weber tel 12345"
    word, lead, ws = r"[^ \t\n\r\f]*[0-9]{3}[^ \t\n\r\f]*", r"(?i:phone|tel|mobile|\+[0-9]{1,3})[.,:]*", r"[^ \t\n\r\f]+"
    df = spark.createDataFrame(list(enumerate([*texts, many])), "id int, text string")
    got = df.select("id", adjacent.pairs_like(F.col("text"), "[A-Z][a-z]+", "[A-Z][a-z]+[.]*").alias("p"), adjacent.led_like(F.col("text"), word, lead).alias("l")).collect()
    for r in got:
        text = [*texts, many][r["id"]] or ""
        found = list(re.finditer(ws, text))
        new = [bool(re.search("[\n\f]", text[(found[k - 1].end() if k else 0) : m.start()])) for k, m in enumerate(found)]
        assert [tuple(p) for p in r["p"]] == [(a.start(), a.end(), a[0], b[0]) for a, b, n in zip(found, found[1:], new[1:]) if not n and re.fullmatch("[A-Z][a-z]+", a[0]) and re.fullmatch("[A-Z][a-z]+[.]*", b[0])]
        leads = [k for k, m in enumerate(found) if re.fullmatch(lead, m[0])]
        led = {j for k in leads for j in range(k + 1, min(k + 7, len(found))) if not any(new[k + 1 : j + 1])}
        assert sorted(tuple(x) for x in r["l"]) == [(found[j].start(), found[j].end(), found[j][0]) for j in sorted(led) if re.fullmatch(word, found[j][0])]
