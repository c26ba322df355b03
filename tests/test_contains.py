"""The contains join against a search for every spelling in every text."""

import random

from shroud.operators import contains, protect, scan, vault
from shroud.operators.known import occurrences

LETTERS = ["an", "na", "meier", "müller", "straße", "STRASSE", "x1", "ب", "محمد", "日本", "本語", "ก", "กิน", "a", "ß", "İ", "о"]
GAPS = [" ", " ", " ", "\n", "-", "‑", "-\n", "_", ", ", "", "·", "++", "،"]


def made(rng, n):
    return "".join(rng.choice(LETTERS) + rng.choice(GAPS) for _ in range(n))


def test_places_are_those_of_a_search_for_each(spark, monkeypatch):
    monkeypatch.setattr(contains, "HEAVY", 7)
    rng = random.Random(11)
    texts = [made(rng, rng.randint(1, 30)) for _ in range(120)] + ["", None, "Mei-\ner und Mül-\nler, a-\nmei-\ner", "++ a ++", "x " * 3000]
    texts += [texts[0]] * 20
    spellings = sorted({made(rng, rng.randint(1, 3)).strip() for _ in range(250)} | {"Meier", "Müller", "++", "-", "،", "محمد", "nobody here", "日"})
    docs = spark.createDataFrame([(k, t, "other") for k, t in enumerate(texts)], "doc_id long, text string, met string").repartition(4)
    known = spark.createDataFrame([(s,) for s in [*spellings, " ", None, spellings[3]]], "spelling string")
    got = sorted((r["doc_id"], r["spelling"], r["start"], r["end"]) for r in contains.places(docs, known).collect())
    assert got == sorted((k, s, a, z) for k, t in enumerate(texts) if t for s in spellings if s for a, z in occurrences(t, s))
    assert contains.places(docs, known.where("false")).count() == 0
    assert contains.places(docs.where("false"), known).count() == 0


def test_a_scan_takes_a_table_of_any_size(spark):
    hints = spark.createDataFrame([("Anna Quell", "Person", "Always", 1), ("Quell", "Company", "Suggest", 2), ("both", "Custom", "Always", 3), ("both", "Person", "Always", 1), ("never", "Custom", "Manual", 4)], "spelling string, kind string, policy string, entity_id int")
    docs = spark.createDataFrame([(1, "so anna  quell said both, and quell never"), (2, "both"), (2, "both"), (3, None), (4, "nothing")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["kind"], r["state"], r["value"]) for r in scan.findings(scan.scan(docs, scan.knowledge(("sv",)), hints=hints)).where("source = 'Vault'").collect())
    assert got == [(1, 3, "Person", "Protected", "anna  quell"), (1, 20, "Person", "Suggested", "both"), (1, 30, "Company", "Suggested", "quell"), (2, 0, "Person", "Suggested", "both"), (2, 0, "Person", "Suggested", "both")]
    assert scan.scan(docs, scan.knowledge(("sv",)), hints=hints).count() == 5
    assert {tuple(r["entities"]) for r in vault.claims(hints).where("spelling = 'both'").collect()} == {(1, 3)}


def test_an_audit_is_over_the_whole_session(spark):
    def place(text, value, token):
        at = text.index(value)
        return [(at, at + len(value), "Person", value, token)]

    a, b, t = "Jos\u00e9 Quell wrote", "nobody wrote", "__Z_ab12_PERSON_1A2B3C4D__"
    rows = [
        (1, "x", a, f"{t} wrote", place(a, "Jos\u00e9 Quell", t), "sum up", f"{t} wrote {protect.REQUEST}sum up"),
        (2, "x", b, b, [], "sum up", f"nobody wrote, but Jose\u0301 Quells {t}{protect.REQUEST}sum up"),  # another document's value, decomposed, inside a word
        (3, "x", b, b, [], "is it Jos\u00e9 Quell?", f"{b}{protect.REQUEST}is it Jos\u00e9 Quell?"),  # stood in the request that entered
        (4, "x", b, b, [], "is it?", f"{b}{protect.REQUEST}is it Jos\u00e9 Quell?"),
        (5, "y", b, f"{b} Jos\u00e9 Quell", [], "", f"{b} Jos\u00e9 Quell"),  # another session
        (6, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"doc_id long, session string, text string, protected string, protections {protect.PROTECTION}, request string, payload string")
    got = {r["doc_id"]: (r["left"], r["allowed"], r["leak"]) for r in protect.audit(df, out="payload", request="request", session="session").collect()}
    assert got == {1: (0, 0, False), 2: (1, 0, True), 3: (1, 1, False), 4: (1, 0, True)}
