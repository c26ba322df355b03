"""Versions of tables, odd PDF files, and counts inside documents of many findings."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shroud.operators import marks, protect, report, scan, vault
from shroud.operators.known import occurrences
from shroud.plans import made_files
from shroud.sources import readers, sinks, versions

VALUES = sinks.TABLES["values"]


def row(k, value):
    return (k, 1, "Person", value, "Always", 0, None)


def names(tables):
    return sorted(r["value"] for r in tables["values"].collect())


def test_a_table_is_changed_and_saved_where_it_came_from(spark, tmp_path):
    at = str(tmp_path / "vault")
    assert sinks.save_tables({"values": spark.createDataFrame([row(1, "Anna")], VALUES), "lists": spark.createDataFrame([("l", True)], sinks.TABLES["lists"])}, at) == 1
    read = sinks.load_tables(spark, at)
    old = read["values"]
    read["values"] = old.union(spark.createDataFrame([row(2, "Bea")], VALUES))
    assert sinks.save_tables(read, at) == 2
    now = sinks.load_tables(spark, at)
    assert names(now) == ["Anna", "Bea"] and now["lists"].count() == 1 and now.version == 2
    assert [r["value"] for r in old.collect()] == ["Anna"]  # an open reader of the version before
    assert names(sinks.load_tables(spark, at, version=1)) == ["Anna"]
    now["values"] = now["values"].where("value = 'Bea'")
    sinks.save_tables(now, at)
    versions.keep_last(spark, at, 1)
    assert versions.versions(spark, at) == [3] and names(sinks.load_tables(spark, at)) == ["Bea"]


def test_a_killed_save_leaves_the_version_before(spark, tmp_path):
    at = str(tmp_path / "vault")
    sinks.save_tables({"values": spark.createDataFrame([row(1, "Anna")], VALUES)}, at)
    bad = spark.createDataFrame([row(2, "Bea")], VALUES).withColumn("value", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        sinks.save_tables({"lists": spark.createDataFrame([("l", True)], sinks.TABLES["lists"]), "values": bad}, at)
    now = sinks.load_tables(spark, at)
    assert names(now) == ["Anna"] and now["lists"].count() == 0 and now.version == 1


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "vault")
    sinks.save_tables({"values": spark.createDataFrame([row(1, "Anna")], VALUES)}, at)
    mine, other = sinks.load_tables(spark, at), sinks.load_tables(spark, at)
    other["values"] = spark.createDataFrame([row(1, "Cleo")], VALUES)
    assert sinks.save_tables(other, at) == 2
    with pytest.raises(versions.Changed):
        sinks.save_tables(mine, at)
    real, late = versions.manifest, sinks.load_tables(spark, at)

    def meanwhile(*args):  # the other writer comes in after the check and before the rename
        monkeypatch.setattr(versions, "manifest", real)
        sinks.save_tables(sinks.load_tables(spark, at), at)
        return real(*args)

    monkeypatch.setattr(versions, "manifest", meanwhile)
    with pytest.raises(versions.Changed, match="meanwhile"):
        sinks.save_tables(late, at)
    assert names(sinks.load_tables(spark, at)) == ["Cleo"]


@pytest.mark.parametrize("odd", [b"0 1.2.3 Td", b"/F1 /F1 Td", b"[(a) 1.2.3 (b)] TJ", b"0 . Td"])
def test_an_odd_page_is_refused_and_the_others_are_read(spark, odd):
    with pytest.raises(readers.Refused, match="Malformed"):
        readers._page_text(b"BT /F1 12 Tf " + odd + b" (x) Tj ET", {})
    good = spark.range(1).select(made_files.content(F.lit(0), F.lit("Anna"), F.lit("x")).alias("c")).first()["c"]
    files = spark.createDataFrame([("a.docx", "docx", good), ("b.pdf", "pdf", b"%PDF-1.4 1 0 obj << /Type /Page >> garbage"), ("c.docx", "docx", b"PK\x03\x04garbage")], "path string, kind string, content binary")
    got = {r["path"]: r["refusal"] for r in readers.extracted(files).collect()}
    assert got["a.docx"] is None and got["b.pdf"] and got["c.docx"]


def test_findings_of_a_long_document(spark):
    text = "é" * 5000 + " " + " ".join(f"a{k % 700}@x.de" for k in range(4000)) + " " + "b" * 6000 + "@x.de"
    places = [m.span() for m in re.finditer(r"\S+@x\.de", text)]
    found = [(a, z, "Email", "auto" if k % 2 else "suggest", "g", "r", [], []) for k, (a, z) in enumerate(places)]
    docs = spark.createDataFrame([(1, text, found), (2, "", []), (3, None, None), (4, "ab", [(0, 1, "Email", "auto", "g", "r", [], []), (0, 1, "Phone", "auto", "g", "r", [], [])])], f"doc_id long, text string, findings {scan.FINDING}")
    same = Counter((text[a:z], k % 2) for k, (a, z) in enumerate(places))
    want = [(1, a, z, text[a:z], same[text[a:z], k % 2]) for k, (a, z) in enumerate(places)] + [(4, 0, 1, "a", 1)] * 2
    assert sorted((r["doc_id"], r["start"], r["end"], r["value"], r["occurrences"]) for r in scan.findings(docs).collect()) == sorted(want)


def test_files_are_refused_before_they_are_read(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("short")
    (tmp_path / "b.txt").write_text("long " * 100)
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path", "'txt' AS kind", "length", "content")
    got = readers.extracted(files, most_bytes=100)
    assert {r["path"][-5:]: (r["text"], r["refusal"]) for r in got.collect()} == {"a.txt": ("short", None), "b.txt": (None, "TooLarge")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "length" in plan and readers.read_documents(spark, str(tmp_path)).where("refusal IS NULL").count() == 2
    monkeypatch.setitem(readers.READERS, "slow", lambda data: re.match(r"(a|b|ab)*c", "ab" * 40))
    with pytest.raises(readers.Refused, match="TooSlow"):
        readers.extract(b"x", "slow", seconds=0.3)
    assert readers.extract(b"x", "txt").text == "x"


def test_numbers_by_ranges(spark):
    values = [f"+49 30 {k:07d}" for k in range(5000)]
    made = spark.createDataFrame([(v,) for v in values[::-1]], "v string").repartition(7)
    assert {r["v"]: r["place"] for r in vault.numbered(made, "v", "place").collect()} == {v: k + 1 for k, v in enumerate(values)}


def test_candidates_lines_pages_and_places(spark):
    lines = [f"we saw Laura Quill {k} there" for k in range(50)]
    docs = [(k, "\n".join(lines[k : k + 3]) + "\f" + lines[k]) for k in range(40)] + [(5, lines[5]), (None, "met Laura Quill here")]
    got = report.name_candidates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), scan.knowledge(("en",))).collect()
    assert [(r["word"], r["rule"], r["occurrences"], r["pages"], r["examples"]) for r in got] == [("Quill", "after-a-given-name", 162, 81, ["met Laura Quill here", lines[0], lines[1]])]
    assert "Window" not in report.name_candidates(spark.createDataFrame(docs, "doc_id long, text string"), scan.knowledge(("en",)))._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_values_are_those_of_all_pairs():
    rng = random.Random(7)
    for _ in range(60):
        text = " ".join(rng.choice(["ann", "ann lee", "lee", "bo", "x"]) for _ in range(40))
        found = []
        for m in rng.sample([*re.finditer("ann lee|ann|lee|bo", text)], 8):
            found.append({"start": m.start(), "end": m.end(), "kind": rng.choice(["Person", "Company"]), "confidence": rng.choice(["auto", "suggest"])})
        sure = [f for f in found if f["confidence"] == "auto"]
        want = [(f["start"], f["end"], f["kind"]) for f in sure]
        for value, kind in dict.fromkeys((text[f["start"] : f["end"]], f["kind"]) for f in sure):
            for a, z in occurrences(text, value):
                if not any(a < e and s < z for s, e, _ in want) and not any(a < f["end"] and f["start"] < z and f["kind"] != kind for f in found):
                    want.append((a, z, kind))
        assert protect.fan_out(text, found) == sorted(want)


def test_an_explanation_names_agreeing_rules_and_owners(spark):
    rows = [(1, "Person", "Protected", "Vault", "vault", ["de:salutation", "vault"], [3]), (2, "Person", "Suggested", "Vault", "vault", [], [3, 4]), (3, "Custom", "Protected", "Vault", "vault", None, [-1]), (4, "Email", "Protected", "GeneralRule", "email", ["de-14"], [])]
    f = spark.createDataFrame(rows, "doc_id long, kind string, state string, source string, rule string, also array<string>, entities array<int>")
    e = spark.createDataFrame([(3, "Anna"), (4, "Bea")], "entity_id int, label string")
    got = {r["doc_id"]: (r["because"], r["agreeing"], r["owners"]) for r in marks.explain(f, e).collect()}
    assert got == {1: ("it is a value you keep", ["de:salutation"], ["Anna"]), 2: ("2 of your entries claim it", [], ["Anna", "Bea"]), 3: ("you protected it before, and it was kept", [], []), 4: ("the rule for email fits, and its arithmetic comes out", ["de-14"], [])}
