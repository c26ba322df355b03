"""Faults that the review of round 3 found, each on a small case that failed before."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from shroud.functions import text as X
from shroud.operators import bank, batches, bloom, contains, general, intervals, known, marks, protect, rules, scan
from shroud.operators.kernel import Reading, scan_document
from shroud.plans import queries
from shroud.sources import readers


def test_every_line_takes_the_section_above_it_however_many_there_are(spark):
    lines = [(k, f"[s{k}]" if k % 3 == 1 else " " if k % 7 == 0 else f" n{k} ") for k in range(2, 6000)]
    df = spark.createDataFrame(lines, "line_no int, value string").repartition(3)
    got = readers.arabic_library(df)
    head, want = None, []
    for _, v in lines:
        if v.startswith("["):
            head = v.strip("[]")
        elif v.strip():
            want.append((v.strip(), head))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()  # no line meets all headings


def test_a_card_right_after_an_address_with_points(spark):
    texts = ["at 38.211.12.42 4366089147969128 by", "12.42 4366089147969127", "12 4366089147969128", "5.4111111111111111,4111-1111-1111-1111", "1.4 4111 1111 1111 1111"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = [(r["k"], r["start"], r["value"]) for r in general.general(df, rules=("payment-card",)).collect()]
    assert sorted(got) == [(0, 16, "4366089147969128"), (3, 2, "4111111111111111"), (3, 19, "4111-1111-1111-1111"), (4, 4, "4111 1111 1111 1111")]


class Narrow(protect.Naming):
    """First tokens of eight bits, so that 300 values have to share some."""

    def token(self, kind, value, again=0):
        made = super().token(kind, value, again)
        return made if again else made[:-10] + "000000" + made[-4:]


def test_letters_keep_values_apart_whose_tokens_collide(spark, tmp_path, monkeypatch):
    spark.range(1, 301).select(F.col("id").cast("int").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(protect, "Naming", Narrow)
    assert tuple(queries.QUERIES["protect_take_out"](spark, str(tmp_path)).first()) == (300, 0)
    assert {r["kind"]: r["tokens"] for r in queries.QUERIES["report_tally"](spark, str(tmp_path)).collect()} == {"CustomerNo": 300, "Email": 300, "Phone": 300, "Person": 5}


def test_days_of_years_with_five_digits_have_no_sign(spark):
    got = spark.createDataFrame([(0,), (253402300800,), (777591000000,), (-1,)], "s long").select(X.day_of(F.col("s"))).collect()
    assert [r[0] for r in got] == ["1970-01-01", "10000-01-01", "26610-11-17", "1969-12-31"]


def test_a_plain_search_finds_what_the_pattern_finds():
    rng = random.Random(3)
    for _ in range(20_000):
        text, needle = ("".join(rng.choices("aAbB1 \n\t-._é", k=k)) for k in (rng.randrange(30), rng.randrange(1, 5)))
        assert known.finder(text)(needle) == known.occurrences(text, needle)


def test_a_spelling_costs_one_row_of_the_contains_join(spark, monkeypatch):
    """No row a spelling and key is written, and numbers that share their parts don't meet."""
    written = {}
    kept = contains.kept
    monkeypatch.setattr(contains, "kept", lambda df, name: written.update({name: kept(df, name)}) or written[name])
    monkeypatch.setattr(contains, "dropped", lambda *tables: None)
    docs = spark.createDataFrame([(k, f"Order {k}\nline {k % 7}") for k in range(1000)], "doc_id int, text string")
    spellings = spark.createDataFrame([(f"order {k} line {n}",) for k in range(1000) for n in range(9)], "spelling string")
    got = contains.places(docs, spellings)
    assert got.count() == 1000 and "contains-keys" not in written
    assert written["contains-spellings"].count() == 9000 and written["contains-chosen"].count() <= 9000
    digits = spark.createDataFrame([(k, f"{k * 7919 % 10**8:08d}") for k in range(3000)], "doc_id int, text string")
    met = contains.met(digits, digits.select(F.col("text").alias("spelling")), keys_of=contains.substring_keys, keys_in=contains.substring_text_keys)
    assert met.select(F.sum(F.size("met"))).first()[0] == 3000


def test_filters_of_many_blocks_hold_their_keys_and_little_else(spark):
    names = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("k")).repartition(5)
    made = bloom.bloom(names, "k", 200_000)  # four blocks
    assert made.may_hold([f"k{n}" for n in range(200_000)]).all()
    assert made.may_hold([f"other {n}" for n in range(20_000)]).mean() < 0.02
    assert bloom.MOST_BITS >= 12 * 80_000_000  # keys of the secrets of five million letters


def test_spellings_that_no_text_holds_are_done_before_the_join_and_copies_are_posted_once(spark, monkeypatch):
    """Also where the counters are all in use, as with very many different words."""
    written = {}
    kept = contains.kept
    monkeypatch.setattr(contains, "kept", lambda df, name: written.update({name: kept(df, name)}) or written[name])
    monkeypatch.setattr(contains, "dropped", lambda *tables: None)
    monkeypatch.setattr(contains, "_SLOTS", 1 << 6)
    monkeypatch.setattr(contains, "_counts", lambda posts, count=contains._counts: count(posts, block=1 << 4))
    docs = spark.createDataFrame([(k, f"word{k % 500} stands") for k in range(1500)], "doc_id int, text string").repartition(7)
    spellings = spark.createDataFrame([(f"word{k}",) for k in range(500)] + [(f"none{k}",) for k in range(5000)], "spelling string")
    assert contains.places(docs, spellings).count() == 1500
    assert written["contains-posts"].count() <= 600 and written["contains-chosen"].count() < 700 and written["contains-met"].count() < 700


def test_names_that_no_text_holds_are_turned_away_before_the_bank_is_written(spark, monkeypatch):
    written = {}
    kept = contains.kept
    monkeypatch.setattr(contains, "kept", lambda df, name: written.update({name: kept(df, name)}) or written[name])
    monkeypatch.setattr(contains, "dropped", lambda *tables: None)
    docs = spark.createDataFrame([(k, f"We met Name{chr(97 + k % 26)}, there.") for k in range(200)] + [(200, None)], "doc_id int, text string")
    names = [("en", f"name{chr(97 + k)}", "given") for k in range(26)] + [("en", f"nobody{k}", "family") for k in range(9000)] + [("en", None, "given")]
    got = bank.met_in(docs, spark.createDataFrame(names, "lang string, name string, type string"))
    assert got.count() == 200 and written["contains-spellings"].count() < 500


def test_texts_and_last_pieces_without_a_token_never_meet_the_names(spark):
    """They all had one key of the join, the blank token, so one task had a row of every text."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "none").when(F.col("id") % 5 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("a __Z_ab12_PERSON_"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("__ b __Z_x__ c"))).alias("text"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t.replace("ab12", "zz99")

    names = protect.tokens_in(docs).select(F.col("token").alias("old"), counted("token").alias("new"))
    got = {r["doc_id"]: r["text"] for r in protect.rename_all(docs, names).collect()}
    assert got == {k: "none" if k % 5 == 0 else f"a __Z_zz99_PERSON_{k:08d}__ b __Z_x__ c" for k in range(500) if k % 5 != 1}
    plan = protect.rename_all(docs, names)._jdf.queryExecution().executedPlan().toString()
    assert "coalesce(token" not in plan and seen.value >= 300


def test_intervals_are_shuffled_once(spark):
    own = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    plan = intervals.marked(own, own.where("start % 2 = 0"), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_large_inputs_have_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """A task was a core's share of the files, or a whole row group, however large."""
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/d")
    monkeypatch.setattr(batches, "SMALL_SHARE", 16 << 10)
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert docs.rdd.getNumPartitions() <= 4
    tasks = lambda df: int(re.search(r"Repartition (\d+)", df._jdf.queryExecution().analyzed().toString())[1])
    assert tasks(batches.spread(docs)) > 50
    assert tasks(batches.spread(docs.crossJoin(docs.select(F.col("doc_id").alias("o"))))) < 500  # estimates of joins multiply
    scan.readable(docs, "spread_view")
    assert tasks(spark.table("spread_view")) > 50


def test_a_text_without_findings_is_done_without_places_or_rules(spark, monkeypatch):
    """Every text's places were worked out, every rule for numbers asked of every run, and all native rules of every text."""
    asked = []
    monkeypatch.setattr(rules, "checked", lambda *a: asked.append(a) or iter(()))
    for pack, text in (("es", "documento 12345678901"), ("fr", "SIREN 123 456 78"), ("de", "eine Zeile ohne alles")):
        doc = Reading(text)
        assert scan_document(doc, [], scan.knowledge((pack,))) == [] and doc.plain([]) == len(text.split())
        assert "starts" not in vars(doc) and len(asked) <= 2  # of five rules a language
        asked.clear()
    df = spark.createDataFrame([(t,) for t in ("no 12 of 345 here", "ask 0301 2345", "x", None, "+4930123456", "GB82 WEST 1234 5698 7654 32", "a@b.de", "4111 1111 1111 1111", "65 070649 B 007")], "text string")
    each = F.concat(*[general._named(spans(F.col("text")), rule, kind, sure) for rule, kind, sure, spans in general.RULES])
    got = df.select(general.found(F.col("text")).alias("got"), each.cast(f"array<{general.FOUND}>").alias("want")).collect()
    assert all(r["got"] == r["want"] for r in got) and sum(len(r["got"]) for r in got) >= 5
    rng = random.Random(8)
    more = spark.createDataFrame([("".join(rng.choices("00123456789 +-/.()A@b", k=rng.randrange(8, 40))),) for _ in range(3000)], "text string")
    more = more.union(spark.createDataFrame([(rng.choice(("", "x ", "+")) + rng.choice(("19", "0")) + "".join(rng.choices("0123456789 -", k=rng.randrange(7, 16))) + rng.choice(("", " ", "A123", "-1234")),) for _ in range(3000)], "text string"))
    assert more.where(general.found(F.col("text")) != each.cast(f"array<{general.FOUND}>")).count() == 0
    assert more.where(F.size(each) > 0).count() > 300


def test_contents_are_made_once_and_in_many_tasks(spark, tmp_path, monkeypatch):
    """They were made twice (for the files read and for those refused), in as many tasks as the table has row groups."""
    rows = 600
    spark.range(rows).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("s").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(batches, "LEAST_SHARE", 1 << 9)
    made, parts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def content(which, name, more):
        @F.pandas_udf("binary")
        def one(w: pd.Series) -> pd.Series:
            made.add(len(w))
            parts.add(1)
            return pd.Series([b"x"] * len(w))

        return one(which)

    monkeypatch.setattr(queries.made_files, "content", content)
    assert queries.QUERIES["read_files"](spark, str(tmp_path)).count() == rows
    assert made.value == rows and parts.value > 2
    files = spark.createDataFrame([("a", "txt", b"12345"), ("b", "txt", b"1"), ("c", "txt", None), ("d", "odt", b"123456")], "path string, kind string, content binary")
    for given in (files, files.withColumn("length", F.octet_length("content"))):
        got = {r["path"]: (r["text"], r["refusal"]) for r in readers.extracted(given, most_bytes=4).collect()}
        assert got == {"a": (None, "TooLarge"), "b": ("1", None), "c": (None, "Empty"), "d": (None, "TooLarge")}


def _walks(df):
    """How often a plan runs Python over rows."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_answers_over_findings_scan_the_letters_once(spark, tmp_path, monkeypatch):
    spark.range(1, 61).select(F.col("id").cast("int").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    walks = []
    monkeypatch.setattr(queries, "kept", lambda df, name, kept=queries.kept: walks.append(_walks(df)) or kept(df, name))
    got = queries.QUERIES["vault_decisions"](spark, str(tmp_path))
    assert sum(walks) + _walks(got) == 1
    assert sorted(map(tuple, got.collect())) == [("CustomerNo", "Suggested", 60), ("Email", "Suggested", 30), ("Person", "Suggested", 60), ("Phone", "Protected", 20), ("Phone", "Suggested", 40)]


def test_ranges_of_lines_scan_the_letters_once(spark, tmp_path):
    spark.range(1, 61).select(F.col("id").cast("int").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["marks_lines"](spark, str(tmp_path))
    assert _walks(got) == 1
    want = [(k, *r) for k in range(1, 61) for r in (((0, 2), (1, 1), (1, 3)) if k % 2 == 0 else ((0, 1), (1, 2)))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    cells = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 1, 0, 6, 9), (1, 1, 1, 11, 14)], "doc_id int, line int, cell int, start int, end int")
    found = spark.createDataFrame([(1, 0), (1, 6), (1, 12), (1, 14), (2, 0)], "doc_id int, start int")
    several = marks.line_selections(found, cells, [(0, 0), (0, 1), (0, 0), (2, 3)]).collect()
    assert sorted(map(tuple, several)) == [(1, 0, 0, 1), (1, 0, 1, 3)]
    assert [tuple(r) for r in marks.line_selection(found, cells, 1, 1).collect()] == [(1, 2)]


def test_questions_are_protected_in_one_pass(spark):
    """Each of three passes had a worker process of its own beside the others' in every task."""
    store = spark.createDataFrame([("__Z_zz99_EMAIL_00000001__", "Northern Light")], "token string, value string")
    asked = spark.createDataFrame([(1, "Did Mr Cooper write to northern LIGHT on +49 30 1234567?", "x"), (2, None, "y"), (3, "__Z_ab12_PHONE_0000000A__ only", "z"), (4, "Mr Northern Light called", "w")], "doc_id int, text string, protected string")
    got = protect.protect_lines(asked, store, scan.knowledge(("en",)), "s")
    assert _walks(got) == 1 and got.columns == ["doc_id", "text", "findings", "plain_words", "protections", "protected"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert re.fullmatch(r"Did Mr __Z_\w{4}_PERSON_\w{8}__ write to __Z_zz99_EMAIL_00000001__ on __Z_\w{4}_PHONE_\w{8}__\?", rows[1]["protected"])
    assert rows[2]["protected"] is None and rows[3]["protected"] == "__Z_ab12_PHONE_0000000A__ only"
    assert rows[4]["protected"] == "Mr __Z_zz99_EMAIL_00000001__ called" and rows[4]["findings"] == []
