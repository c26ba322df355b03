"""One query an operator of the engine, over the driver's tables; and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X, validators as V
from ..operators import adjacent, bank, contains, general, intervals, marks, names, protect, report, scan, vault
from ..operators.batches import spread
from ..operators.lexicon import LABELS
from ..operators.spans import matches, splice
from ..operators.staging import kept
from ..sources import readers, sinks
from . import made_files, rule_cases
from .kinds import kinds
from .languages import languages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


# -- general rules -----------------------------------------------------------------------------------------------------------


def _general(rule: str) -> Query:
    def run(spark, sf_dir):
        found = general.general(documents(spark, sf_dir), rules=(rule,))
        return found.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("value")).cast("long").alias("chars"), F.min("start").cast("long").alias("first_start"), F.max("end").cast("long").alias("last_end"))

    return run


_EMAIL_SQL = r"""
WITH m AS (SELECT lang, text, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS raw FROM documents WHERE text LIKE '%@%'),
v AS (SELECT lang, text, rtrim(raw, '.') AS value FROM m), ok AS (SELECT * FROM v WHERE regexp_full_match(value, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*\.[A-Za-z]{2,}'))
"""


@query(_EMAIL_SQL + "SELECT lang, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM ok GROUP BY lang")
def general_email(spark, sf_dir):
    return _general("email")(spark, sf_dir).select("lang", "n", "chars")


_CARD_SQL = r"""
WITH m AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9])([0-9]+(?:[ -][0-9]+)*)(?:$|[^A-Za-z0-9])', 1)) AS value FROM documents),
d AS (SELECT doc_id, lang, value, regexp_replace(value, '[ -]', '', 'g') AS digits FROM m),
c AS (SELECT *, list_transform(range(1, length(digits) + 1), lambda i: CAST(digits[-i] AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) AS w FROM d WHERE length(digits) BETWEEN 13 AND 19),
ok AS (SELECT * FROM c WHERE list_sum(list_transform(w, lambda x: x // 10 + x % 10)) % 10 = 0 AND (
  (digits[1] = '4' AND length(digits) IN (13, 16, 19)) OR (CAST(digits[1:2] AS INTEGER) BETWEEN 51 AND 55 AND length(digits) = 16)
  OR (CAST(digits[1:4] AS INTEGER) BETWEEN 2221 AND 2720 AND length(digits) = 16) OR (digits[1:2] IN ('34', '37') AND length(digits) = 15)
  OR ((digits[1:4] = '6011' OR digits[1:2] = '65' OR CAST(digits[1:3] AS INTEGER) BETWEEN 644 AND 649) AND length(digits) = 16)
  OR (CAST(digits[1:4] AS INTEGER) BETWEEN 3528 AND 3589 AND length(digits) = 16)
  OR ((CAST(digits[1:3] AS INTEGER) BETWEEN 300 AND 305 OR digits[1:4] = '3095' OR digits[1:2] IN ('36', '38', '39')) AND length(digits) = 14)
  OR (digits[1:2] = '62' AND length(digits) BETWEEN 16 AND 19)))
"""


@query(_CARD_SQL + "SELECT lang, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM ok GROUP BY lang")
def general_card(spark, sf_dir):
    return _general("payment-card")(spark, sf_dir).select("lang", "n", "chars")


@query(
    _EMAIL_SQL.replace("ok AS", "e AS")
    + ", "
    + _CARD_SQL.strip().removeprefix("WITH ").replace("m AS", "cm AS", 1).replace("FROM m)", "FROM cm)")
    + "SELECT lang, kind, n FROM (SELECT lang, 'Email' AS kind, count(*) AS n FROM e GROUP BY lang UNION ALL SELECT lang, 'Account', count(*) FROM ok GROUP BY lang)"
)
def general_report(spark, sf_dir):
    """The flagship: e-mails and payment cards by language and kind."""
    return general.general(documents(spark, sf_dir), rules=("email", "payment-card")).groupBy("lang", "kind").agg(F.count("*").alias("n"))


def general_all(spark, sf_dir):
    """Every general rule's spans; rows only, as SQL without look-around can't draw their boundaries."""
    return general.general(documents(spark, sf_dir)).select("doc_id", "lang", "start", "end", "kind", "confidence", "rule")


QUERIES["general_all"] = general_all

_PHONE = "concat('49-30-', lpad(CAST(c_custkey AS {s}), 7, '0'))"
_PHONE_SPARK, _PHONE_SQL = _PHONE.format(s="STRING"), _PHONE.format(s="VARCHAR")
_PHONE_LINES = f"concat('+', replace({_PHONE_SPARK}, '-', ' '), ' is ', c_name)"


@query(f"SELECT c_custkey AS doc_id, 0::BIGINT AS start, CAST(length({_PHONE_SQL}) + 1 AS BIGINT) AS \"end\", '+' || replace({_PHONE_SQL}, '-', ' ') AS value FROM customer")
def general_phone(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_PHONE_LINES).alias("text"))
    return general.general(lines, rules=("phone-intl",)).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value")


_IBAN = "lpad(CAST((c_custkey * 7919 + 12345) % 100000000 AS STRING), 8, '0') || lpad(CAST(c_custkey AS STRING), 10, '0')"
_IBAN_SQL = """
WITH b AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 12345) % 100000000 AS VARCHAR), 8, '0') || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS bban FROM customer),
k AS (SELECT c_custkey, 'DE' || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') || bban AS iban, CAST(bban || '1314' || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') AS HUGEINT) % 97 AS rest FROM b)
"""


@query(_IBAN_SQL + "SELECT c_custkey AS doc_id, iban AS value FROM k WHERE rest = 1")
def general_iban(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(f"concat('IBAN DE', lpad(CAST(c_custkey % 97 AS STRING), 2, '0'), {_IBAN}, '.')").alias("text"))
    return general.general(lines, rules=("iban",)).select("doc_id", "value")


# -- validators --------------------------------------------------------------------------------------------------------------

_N16 = "lpad(CAST((o_orderkey * 7919 + 104729) % 10000000000000000 AS {s}), 16, '0')"


MADE: dict[str, tuple[str, str, str]] = {}


def _checked(name: str, made: str, made_sql: str, test_sql: str) -> None:
    """Counts of values that pass a validator, by the last digit of the order's key."""
    MADE[name] = made, made_sql, test_sql

    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "orders").select(F.expr("o_orderkey % 10").alias("k"), F.expr(made).alias("v"))
        return rows.groupBy("k").agg(F.count_if(V.ALL[name]("v")).alias("passed"), F.count("*").alias("n"))

    QUERIES[f"validate_{name}"] = run
    SQL[f"validate_{name}"] = f"WITH r AS (SELECT o_orderkey % 10 AS k, {made_sql} AS v FROM orders) SELECT k, count(*) FILTER (WHERE {test_sql}) AS passed, count(*) AS n FROM r GROUP BY k"


def _both(pattern: str) -> tuple[str, str]:
    return pattern.format(s="STRING"), pattern.format(s="VARCHAR")


_LUHN_SQL = "list_sum(list_transform(range(1, length({v}) + 1), lambda i: (CASE WHEN i % 2 = 0 THEN (CAST({v}[-i] AS INTEGER) * 2) // 10 + (CAST({v}[-i] AS INTEGER) * 2) % 10 ELSE CAST({v}[-i] AS INTEGER) END))) % 10 = 0"
_N9 = "lpad(CAST((o_orderkey * 7919) % 1000000000 AS {s}), 9, '0')"
_checked("luhn_ok", *_both(_N16), _LUHN_SQL.format(v="v"))
_checked("siren_ok", *_both(_N9), _LUHN_SQL.format(v="v"))
_checked("french_vat_ok", *_both("'FR' || lpad(CAST(o_orderkey % 97 AS {s}), 2, '0') || " + _N9), "(12 + 3 * (CAST(v[5:13] AS BIGINT) % 97)) % 97 = CAST(v[3:4] AS BIGINT)")
_checked("dni_ok", *_both("lpad(CAST((o_orderkey * 7919) % 100000000 AS {s}), 8, '0') || substring('TRWAGMYFPDXBNJZSQVHLCKE', CAST(o_orderkey % 23 AS INT) + 1, 1)"), "substring('TRWAGMYFPDXBNJZSQVHLCKE', CAST(CAST(v[1:8] AS BIGINT) % 23 AS INTEGER) + 1, 1) = v[9]")
_checked("nie_ok", *_both("substring('XYZ', CAST(o_orderkey % 3 AS INT) + 1, 1) || lpad(CAST((o_orderkey * 7919) % 10000000 AS {s}), 7, '0') || substring('TRWAGMYFPDXBNJZSQVHLCKE', CAST(o_orderkey % 23 AS INT) + 1, 1)"), "substring('TRWAGMYFPDXBNJZSQVHLCKE', CAST(CAST(translate(v[1], 'XYZ', '012') || v[2:8] AS BIGINT) % 23 AS INTEGER) + 1, 1) = v[9]")
_checked("seguridad_social_ok", *_both("lpad(CAST(o_orderkey % 60 AS {s}), 2, '0') || lpad(CAST((o_orderkey * 7919) % 100000000 AS {s}), 8, '0') || lpad(CAST(o_orderkey % 97 AS {s}), 2, '0')"), "CAST(v[1:2] AS BIGINT) BETWEEN 1 AND 53 AND (CASE WHEN CAST(v[3:10] AS BIGINT) < 10000000 THEN CAST(v[1:2] AS BIGINT) * 10000000 ELSE CAST(v[1:2] AS BIGINT) * 100000000 END + CAST(v[3:10] AS BIGINT)) % 97 = CAST(v[11:12] AS BIGINT)")
_checked("nir_ok", *_both("CAST(o_orderkey % 10 AS {s}) || lpad(CAST((o_orderkey * 7919) % 1000000000000 AS {s}), 12, '0') || lpad(CAST(o_orderkey % 97 + 1 AS {s}), 2, '0')"), "v[1] IN ('1', '2', '3', '4', '7', '8') AND 97 - CAST(v[1:13] AS BIGINT) % 97 = CAST(v[14:15] AS BIGINT)")
_checked("is_a_short_date", *_both("lpad(CAST((o_orderkey * 7919) % 1000000 AS {s}), 6, '0')"), "CAST(v[3:4] AS INTEGER) BETWEEN 1 AND 12 AND CAST(v[5:6] AS INTEGER) BETWEEN 1 AND (CASE WHEN CAST(v[3:4] AS INTEGER) = 2 THEN 29 WHEN CAST(v[3:4] AS INTEGER) IN (4, 6, 9, 11) THEN 30 ELSE 31 END)")
_checked("is_a_long_date", *_both("CAST(1840 + o_orderkey % 300 AS {s}) || lpad(CAST((o_orderkey * 7919) % 10000 AS {s}), 4, '0')"), "CAST(v[1:4] AS INTEGER) BETWEEN 1850 AND 2100 AND CAST(v[5:6] AS INTEGER) BETWEEN 1 AND 12 AND CAST(v[7:8] AS INTEGER) BETWEEN 1 AND (CASE WHEN CAST(v[5:6] AS INTEGER) = 2 THEN 29 WHEN CAST(v[5:6] AS INTEGER) IN (4, 6, 9, 11) THEN 30 ELSE 31 END)")
_checked("is_a_reference", *_both("CASE WHEN o_orderkey % 2 = 0 THEN 'NGE-' || CAST(o_orderkey AS {s}) WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS {s}) ELSE 'a b' END"), "regexp_full_match(v, '[A-Za-z0-9/-]+') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")
_checked("is_a_numeric_date", *_both("CAST(o_orderkey % 31 AS {s}) || '/' || CAST(o_orderkey % 13 AS {s}) || (CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '/' END) || CAST(o_orderkey % 12000 AS {s})"), "regexp_full_match(v, '[0-9]{{1,4}}[/.-][0-9]{{1,4}}[/.-][0-9]{{1,4}}') AND regexp_matches(v, '[0-9]{{2}}')".replace("{{", "{").replace("}}", "}"))
_checked("is_an_email", *_both("'c' || CAST(o_orderkey AS {s}) || (CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '@' END) || 'mail' || (CASE WHEN o_orderkey % 5 = 0 THEN '.d' ELSE '.de' END)"), "regexp_full_match(v, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*\\.[A-Za-z]{2,}')")
_checked("is_a_token", *_both("'__Z_ab1' || CAST(o_orderkey % 12 AS {s}) || '_PERSON_' || lpad(CAST(o_orderkey AS {s}), 8, '0') || '__'"), "regexp_full_match(v, '__Z_[A-Za-z0-9]{4}_[A-Z0-9]+_[A-Za-z0-9]{4,8}__')")
_checked("is_an_outward_postcode", *_both("substring('ABCDEFGH', CAST(o_orderkey % 8 AS INT) + 1, CAST(o_orderkey % 3 AS INT)) || CAST(o_orderkey % 140 AS {s}) || (CASE WHEN o_orderkey % 7 = 0 THEN 'A' ELSE '' END)"), "regexp_full_match(v, '[A-Z]{1,2}[0-9]{1,2}[A-Z]?') AND length(v) BETWEEN 2 AND 4")
_checked("is_a_national_insurance_number", *_both("substring('ABCDEFGH', CAST(o_orderkey % 7 AS INT) + 1, 2) || ' ' || lpad(CAST(o_orderkey % 1200000 AS {s}), 6, '0') || (CASE WHEN o_orderkey % 5 = 0 THEN '-9' ELSE ' C' END)"), "regexp_full_match(regexp_replace(v, '[ -]', '', 'g'), '[A-Za-z]{2}[0-9]{6}[A-Za-z]')")
_checked("tax_id_ok", *_both("lpad(CAST((o_orderkey * 7919000003 + 11) % 100000000000 AS {s}), 11, '0')"), "v[1] <> '0' AND len(list_filter(range(0, 10), lambda d: (10 - length(replace(v[1:10], CAST(d AS VARCHAR), ''))) IN (2, 3))) = 1 AND len(list_filter(range(0, 10), lambda d: (10 - length(replace(v[1:10], CAST(d AS VARCHAR), ''))) > 3)) = 0 AND len(list_filter(range(0, 10), lambda d: length(replace(v[1:10], CAST(d AS VARCHAR), '')) = 10)) > 0 AND (11 - list_reduce(list_prepend(10::BIGINT, list_transform(range(1, 11), lambda i: CAST(v[i] AS BIGINT))), lambda a, x: ((CASE WHEN (a + x) % 10 = 0 THEN 10 ELSE (a + x) % 10 END) * 2) % 11)) % 10 = CAST(v[11] AS BIGINT)")
_checked("social_insurance_ok", *_both("lpad(CAST(o_orderkey % 90 AS {s}), 2, '0') || lpad(CAST(o_orderkey % 31 + 1 AS {s}), 2, '0') || lpad(CAST(o_orderkey % 12 + 1 AS {s}), 2, '0') || lpad(CAST(o_orderkey % 100 AS {s}), 2, '0') || substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(o_orderkey % 26 AS INT) + 1, 1) || lpad(CAST((o_orderkey * 7) % 1000 AS {s}), 3, '0')"), "CAST(v[5:6] AS INTEGER) BETWEEN 1 AND 12 AND CAST(v[3:4] AS INTEGER) BETWEEN 1 AND (CASE WHEN CAST(v[5:6] AS INTEGER) = 2 THEN 29 WHEN CAST(v[5:6] AS INTEGER) IN (4, 6, 9, 11) THEN 30 ELSE 31 END) AND list_sum(list_transform(range(1, 13), lambda i: (CAST((v[1:8] || lpad(CAST(ascii(v[9]) - 64 AS VARCHAR), 2, '0') || v[10:11])[i] AS INTEGER) * ([2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1])[i]) // 10 + (CAST((v[1:8] || lpad(CAST(ascii(v[9]) - 64 AS VARCHAR), 2, '0') || v[10:11])[i] AS INTEGER) * ([2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1])[i]) % 10)) % 10 = CAST(v[12] AS INTEGER)")

_checked("siret_ok", *_both("lpad(CAST((o_orderkey * 7919 + 31) % 1000000000 AS {s}), 9, '0') || lpad(CAST(o_orderkey % 100000 AS {s}), 5, '0')"), _LUHN_SQL.format(v="v") + " OR (v[1:9] = '356000000' AND list_sum(list_transform(range(1, 15), lambda i: CAST(v[i] AS INTEGER))) % 5 = 0)")
_checked("cif_ok", *_both("substring('ABCDEFGHJNPQRSUVW', CAST(o_orderkey % 17 AS INT) + 1, 1) || lpad(CAST((o_orderkey * 7919) % 10000000 AS {s}), 7, '0') || substring('0123456789ABCDEFGHIJ', CAST((o_orderkey * 7) % 20 AS INT) + 1, 1)"), "CASE WHEN v[1] IN ('K', 'P', 'Q', 'R', 'S', 'N', 'W') THEN v[9] = substring('JABCDEFGHI', CAST(" + (_CIF := "(10 - list_sum(list_transform(range(1, 8), lambda i: CASE WHEN i % 2 = 1 THEN (2 * CAST(v[i + 1] AS INTEGER)) // 10 + (2 * CAST(v[i + 1] AS INTEGER)) % 10 ELSE CAST(v[i + 1] AS INTEGER) END)) % 10) % 10") + " AS INTEGER) + 1, 1) WHEN v[1] IN ('A', 'B', 'E', 'H') THEN v[9] = CAST(" + _CIF + " AS VARCHAR) ELSE v[9] = CAST(" + _CIF + " AS VARCHAR) OR v[9] = substring('JABCDEFGHI', CAST(" + _CIF + " AS INTEGER) + 1, 1) END")
_checked("is_an_inward_postcode", *_both("CAST(o_orderkey % 10 AS {s}) || substring('ABCDEFGH', CAST(o_orderkey % 8 AS INT) + 1, CAST(o_orderkey % 3 AS INT) + 1)"), "regexp_full_match(v, '[0-9][A-Z]{2}')")
_checked("is_a_group", *_both("CASE WHEN o_orderkey % 3 = 0 THEN 'AB' || CAST(o_orderkey AS {s}) WHEN o_orderkey % 3 = 1 THEN 'Ab' ELSE 'AB C' END"), "regexp_full_match(v, '[A-Za-z0-9]+') AND (regexp_matches(v, '[0-9]') OR NOT regexp_matches(v, '[a-z]'))")
_checked("looks_like_a_date", *_both("CAST(o_orderkey % 40 AS {s}) || '.' || CAST(o_orderkey % 15 AS {s}) || '.' || CAST(o_orderkey % 3000 AS {s})"), "regexp_full_match(v, '[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}') AND CAST(split_part(v, '.', 2) AS INTEGER) BETWEEN 1 AND 12 AND CAST(split_part(v, '.', 1) AS INTEGER) BETWEEN 1 AND (CASE WHEN CAST(split_part(v, '.', 2) AS INTEGER) = 2 THEN 29 WHEN CAST(split_part(v, '.', 2) AS INTEGER) IN (4, 6, 9, 11) THEN 30 ELSE 31 END)")


#: General rule, the validator of its number, and what stands after the number in a text.
_NUMBERED = (("tax identification number", "tax_id_ok", ""), ("social-insurance number", "social_insurance_ok", ""), ("national identity number", "is_a_short_date", "-1234"))


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, k, count(*) AS n FROM (SELECT o_orderkey % 10 AS k, {MADE[name][1]} AS v FROM orders) WHERE {MADE[name][2]} GROUP BY k" for rule, name, _ in _NUMBERED))
def general_numbers(spark, sf_dir):
    """The general rules for national numbers over a line of text for each order: found where the number's checksum or date holds."""
    o, parts = table(spark, sf_dir, "orders"), []
    for rule, name, after in _NUMBERED:
        lines = o.select(F.expr("o_orderkey % 10").alias("k"), F.concat(F.lit("No. "), F.expr(MADE[name][0]), F.lit(after + ", seen")).alias("text"))
        parts.append(general.general(lines, rules=(rule,)).groupBy(F.col("rule"), "k").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


@query(r"""
WITH m AS (SELECT o_orderkey AS k, '0' || (o_orderkey % 3) || (o_orderkey % 7) || ' ' || repeat('5', CAST(o_orderkey % 11 AS INTEGER)) || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END AS v FROM orders)
SELECT length(v) AS size, count(*) AS n FROM m WHERE v[1:3] <> '000' AND k % 5 <> 0 AND k % 11 >= 5 GROUP BY ALL
""")
def general_local_phones(spark, sf_dir):
    """Local phones: from 0 but not 000, eight digits at least, ending at a word's end."""
    k = F.col("o_orderkey")
    value = F.concat(F.lit("0"), (k % 3).cast("string"), (k % 7).cast("string"), F.lit(" "), F.repeat(F.lit("5"), (k % 11).cast("int")), F.when(k % 5 == 0, "x").otherwise(""))
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("call "), value, F.lit(" soon")).alias("text"))
    return general.general(lines, rules=("phone-local",)).groupBy(F.length("value").cast("long").alias("size")).agg(F.count("*").alias("n"))


# -- text primitives ---------------------------------------------------------------------------------------------------------


@query(r"SELECT lang, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def text_counts(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.groupBy("lang").agg(F.sum(F.size(X.lines(F.col("text")))).alias("lines"), F.sum(X.plain_words(F.col("text"))).alias("words"), F.sum(F.length("text")).alias("chars"))


@query("SELECT o_orderkey AS k, strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y-%m-%d') AS day, lower(regexp_extract('Folder.x/File' || o_orderkey || (CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE '' END), '\\.([^./]+)$', 1)) AS extension FROM orders")
def text_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("Folder.x/File"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".PDF").otherwise(""))
    return o.select(F.col("o_orderkey").alias("k"), X.day_of(F.col("o_orderkey") * 86399).alias("day"), X.file_extension(path).alias("extension"))


@query(r"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z0-9]+@')) AS word FROM documents) GROUP BY lang, word")
def text_extracts(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+@"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, len(regexp_extract_all(line, '[^\t ]+(?: [^\t ]+)*'))::INTEGER AS cells, regexp_extract_all(line, '[^\t ]+(?: [^\t ]+)*')[2] AS second FROM (SELECT c_custkey, c_name || chr(9) || c_custkey || '  ' || c_mktsegment AS line FROM customer)")
def text_cells(spark, sf_dir):
    line = F.concat("c_name", F.lit("\t"), F.col("c_custkey").cast("string"), F.lit("  "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(X.cells(line)).alias("cells"), F.get(X.cells(line), F.lit(1)).alias("second"))


# -- spans -------------------------------------------------------------------------------------------------------------------


@query(_EMAIL_SQL + "SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9-]', '[EMAIL]', 'g')) AS hash FROM documents WHERE text LIKE '%@%' AND text IN (SELECT text FROM ok)")
def spans_splice(spark, sf_dir):
    d = documents(spark, sf_dir)
    spans = F.transform(general.emails(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("[EMAIL]").alias("token")))
    return d.withColumn("s", spans).where(F.size("s") > 0).select("doc_id", F.md5(splice(F.col("text"), F.col("s"))).alias("hash"))


@query("SELECT doc_id, lang, pos, CAST(length(before) - length(replace(before, chr(10), '')) AS INTEGER) AS line FROM (SELECT doc_id, lang, CAST(strpos(text, 'License') - 1 AS INTEGER) AS pos, text[1:strpos(text, 'License') - 1] AS before FROM documents WHERE contains(text, 'License'))")
def spans_place(spark, sf_dir):
    """Where a word first stands, and on which line: the last line that begins at or before it."""
    d = documents(spark, sf_dir).where(F.col("text").contains("License"))
    first = F.get(matches(F.col("text"), "License"), F.lit(0))["start"]
    starts = F.concat(F.array(F.lit(0)), F.transform(matches(F.col("text"), "\n"), lambda m: m["end"]))
    return d.withColumn("pos", first).withColumn("starts", starts).select("doc_id", "lang", "pos", (F.size(F.filter("starts", lambda s: s <= F.col("pos"))) - 1).alias("line"))


@query("""
WITH a AS (SELECT l_orderkey AS k, l_linenumber AS i, CAST(l_linenumber * 10 AS INTEGER) AS s, CAST(l_linenumber * 10 + l_suppkey % 14 AS INTEGER) AS e, l_suppkey % 2 AS kind FROM lineitem)
SELECT k, count(*) AS free FROM a x WHERE kind = 0 AND NOT EXISTS (SELECT 1 FROM a y WHERE y.k = x.k AND y.kind = 1 AND x.s < y.e AND y.s < x.e) GROUP BY k
""")
def spans_anti_overlap(spark, sf_dir):
    """Candidates that no span of the other kind overlaps: a sweep over both."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).cast("int").alias("s"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 14).cast("int").alias("e"), (F.col("l_suppkey") % 2).alias("kind"))
    free = intervals.untouched(a.where("kind = 0"), a.where("kind = 1"), ["k"], start="s", end="e")
    return free.groupBy("k").agg(F.count("*").alias("free"))


@query(r"""
WITH w AS (SELECT l_suppkey % 7 AS k, CAST(l_orderkey AS INTEGER) AS s, CAST(l_orderkey + 1 + l_linenumber % 3 AS INTEGER) AS e, l_partkey % 3 AS side FROM lineitem),
x AS (SELECT DISTINCT k, s, e FROM w WHERE side = 0), y AS (SELECT DISTINCT k, s, e FROM w WHERE side = 1)
SELECT k, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM y WHERE y.k = x.k AND x.s < y.e AND y.s < x.e)) AS touched FROM x GROUP BY k
""")
def spans_semi_overlap(spark, sf_dir):
    """Seven groups of very many intervals each: how many an interval of the other side overlaps."""
    w = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("k"), F.col("l_orderkey").cast("int").alias("s"), (F.col("l_orderkey") + 1 + F.col("l_linenumber") % 3).cast("int").alias("e"), (F.col("l_partkey") % 3).alias("side"))
    one = lambda side: w.where(F.col("side") == side).select("k", "s", "e").distinct()
    got = intervals.marked(one(0), one(1), ["k"], start="s", end="e")
    return got.groupBy("k").agg(F.count("*").alias("n"), F.count_if("touched").alias("touched"))


# -- neighbours of words -----------------------------------------------------------------------------------------------------

_WORDS_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w, string_split_regex(text, '[^ \t\n\r\f]+') AS g FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, unnest(g[1:len(w)]) AS g, unnest(range(len(w))) AS k FROM d WHERE len(w) > 0),
p AS (SELECT *, contains(g, chr(10)) OR contains(g, chr(12)) AS new, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY k) - length(w) AS pos FROM u)
"""


@query(_WORDS_SQL + r"""
, n AS (SELECT doc_id, pos, w, lead(w) OVER v AS b, lead(new) OVER v AS b_new FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, CAST(pos AS INTEGER) AS start, w || ' ' || rtrim(b, '.,;:!?') AS pair FROM n WHERE regexp_full_match(w, '[A-Z][a-z]+') AND regexp_full_match(b, '[A-Z][a-z]+[.,;:!?]*') AND NOT b_new
""")
def words_name_pairs(spark, sf_dir):
    """Two words with capitals beside each other on a line, in native arrays."""
    found = adjacent.pairs_like(F.col("text"), "[A-Z][a-z]+", "[A-Z][a-z]+[.,;:!?]*")
    d = documents(spark, sf_dir).select("doc_id", F.explode(found).alias("p"))
    return d.select("doc_id", F.col("p.start").alias("start"), F.concat(F.col("p.value"), F.lit(" "), F.regexp_replace("p.next", "[.,;:!?]+$", "")).alias("pair"))


@query(_WORDS_SQL + r"""
, l AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY k) AS line FROM p),
f AS (SELECT *, max(CAST(regexp_full_match(lower(rtrim(w, '.,;:!?')), 'phone|tel|telefon|call|mobile|contact|\+[0-9]{1,3}') AS INTEGER)) OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS led FROM l)
SELECT doc_id, CAST(pos AS INTEGER) AS start, w AS word FROM f WHERE led = 1 AND regexp_matches(w, '[0-9]{3}')
""")
def words_after_phone_words(spark, sf_dir):
    """Words with digits that a word for telephones or a country's prefix leads, up to six words back on the line."""
    found = adjacent.led_like(F.col("text"), r"[^ \t\n\r\f]*[0-9]{3}[^ \t\n\r\f]*", r"(?i:phone|tel|telefon|call|mobile|contact|\+[0-9]{1,3})[.,;:!?]*")
    d = documents(spark, sf_dir).select("doc_id", F.explode(found).alias("w"))
    return d.select("doc_id", F.col("w.start").alias("start"), F.col("w.value").alias("word"))


# -- scan, protect, restore --------------------------------------------------------------------------------------------------

_LETTER = "concat('Customer number: ', c_custkey, {n}, 'E-mail: c', c_custkey, '@example.com', {n}, 'Phone: +', replace({phone}, '-', ' '), {n}, 'We met Mr ', {name}, ' there.')"
_NAME_SPARK = "element_at(array('Baker', 'Cooper', 'Hall', 'Turner', 'Walker'), CAST(c_custkey % 5 AS INT) + 1)"
_NAME_SQL = "(['Baker', 'Cooper', 'Hall', 'Turner', 'Walker'])[c_custkey % 5 + 1]"
_LETTER_SQL = f"SELECT c_custkey AS doc_id, {_LETTER.format(n='chr(10)', name=_NAME_SQL, phone=_PHONE_SQL)} AS text, 'c' || c_custkey || '@example.com' AS email, '+' || replace({_PHONE_SQL}, '-', ' ') AS phone, {_NAME_SQL} AS person FROM customer"
SECRET = "a run's secret"


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("doc_id"), F.expr(_LETTER.format(n="'\\n'", name=_NAME_SPARK, phone=_PHONE_SPARK)).alias("text"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(letters(spark, sf_dir), scan.knowledge(("en",)))


def _own_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protected letters, written once, with a token of its own for every value of the session."""
    return protect.reminted(kept(protect.protect(_scanned(spark, sf_dir), SECRET).select("doc_id", "text", "findings", "protections", "protected"), "letters"), SECRET)


_FOUND_SQL = f"""
WITH t AS ({_LETTER_SQL}), f AS (
SELECT doc_id, 'CustomerNo' AS kind, CAST(doc_id AS VARCHAR) AS value FROM t UNION ALL SELECT doc_id, 'Email', email FROM t
UNION ALL SELECT doc_id, 'Phone', phone FROM t UNION ALL SELECT doc_id, 'Person', person FROM t)
"""


@query(_FOUND_SQL + "SELECT f.doc_id, kind, 'Protected' AS state, value, CAST(strpos(text, value) - 1 AS INTEGER) AS start FROM f JOIN t ON f.doc_id = t.doc_id WHERE kind <> 'CustomerNo' UNION ALL SELECT doc_id, kind, 'Protected', value, 17 FROM f WHERE kind = 'CustomerNo'")
def scan_letters(spark, sf_dir):
    """Labels, general rules and salutations over letters made from customers."""
    return scan.findings(_scanned(spark, sf_dir)).select("doc_id", "kind", "state", "value", "start")


@query(_FOUND_SQL + "SELECT f.doc_id, kind, 'auto' AS confidence, value, CASE WHEN kind = 'CustomerNo' THEN 17 ELSE CAST(strpos(text, value) - 1 AS INTEGER) END AS start FROM f JOIN t ON f.doc_id = t.doc_id")
def scan_table_function(spark, sf_dir):
    """The scan as SQL: pii_scan over a view of the letters, with its pack as an argument."""
    scan.register(spark)
    scan.readable(letters(spark, sf_dir), "letters_to_scan")
    return spark.sql("SELECT doc_id, kind, confidence, value, start FROM pii_scan(TABLE(letters_to_scan), 'en')")


@query(_FOUND_SQL + "SELECT kind, 'Protected' AS state, count(*) AS n FROM f GROUP BY kind")
def report_by_kind(spark, sf_dir):
    return report.by_kind(scan.findings(_scanned(spark, sf_dir)))


@query(_FOUND_SQL + "SELECT doc_id, 4::BIGINT AS auto, 0::BIGINT AS suggested, CAST(len(regexp_extract_all(text, '\\S+')) - 3 - len(string_split(phone, ' ')) AS BIGINT) AS normal FROM t")
def report_scan(spark, sf_dir):
    return report.scan_report(_scanned(spark, sf_dir))


@query(_FOUND_SQL + "SELECT source, detail, count(*) AS places FROM (SELECT CASE WHEN kind IN ('Person', 'CustomerNo') THEN 'LanguagePack' ELSE 'GeneralRule' END AS source, CASE WHEN kind IN ('Person', 'CustomerNo') THEN 'en' ELSE '' END AS detail FROM f) GROUP BY source, detail")
def report_by_layer(spark, sf_dir):
    return report.by_layer(scan.findings(_scanned(spark, sf_dir)))


@query(_FOUND_SQL + "SELECT kind, count(*) AS protected, 0::BIGINT AS suggested FROM f GROUP BY kind")
def report_import(spark, sf_dir):
    return report.import_report(scan.findings(_scanned(spark, sf_dir)))


@query(_FOUND_SQL + "SELECT kind, count(DISTINCT value) AS tokens FROM f GROUP BY kind")
def report_tally(spark, sf_dir):
    """Distinct tokens by kind: as many as distinct values."""
    return report.tally(protect.protections(_own_tokens(spark, sf_dir)))


@query(_FOUND_SQL + "SELECT kind, count(*) AS finds, max(n) AS most FROM (SELECT kind, count(*) OVER (PARTITION BY doc_id, kind, value) AS n FROM f) GROUP BY kind")
def report_occurrences(spark, sf_dir):
    return report.occurrences_of(scan.findings(_scanned(spark, sf_dir))).groupBy("kind").agg(F.count("*").alias("finds"), F.max("occurrences").alias("most"))


@query(_FOUND_SQL + "SELECT doc_id, text AS restored, 4 AS tokens, 0 AS unresolved FROM t")
def protect_round_trip(spark, sf_dir):
    """Protected, sent, returned and restored: the text as it was."""
    sent = protect.protect(_scanned(spark, sf_dir), SECRET)
    values = F.map_from_entries(F.array_distinct(F.transform("protections", lambda p: F.struct(p["token"], p["value"]))))
    back = protect.restore(sent.select("doc_id", F.col("protected").alias("text"), values.alias("tokens")))
    return back.select("doc_id", "restored", F.size("tokens").alias("tokens"), F.size("unresolved").alias("unresolved"))


@query(_FOUND_SQL + """, s AS (SELECT DISTINCT value AS v FROM f),
w AS (SELECT doc_id, text || chr(10) || chr(10) || '--- Request ---' || chr(10) || 'Summarise this.' AS entered,
concat('Customer number: ', chr(1), chr(10), 'E-mail: ', chr(1), chr(10), 'Phone: ', chr(1), chr(10), 'We met Mr ', chr(1), ' there.', CASE doc_id % 5 WHEN 0 THEN ' by ' || person WHEN 1 THEN ' by c' || (doc_id + 1) || '@example.com' ELSE '' END,
chr(10), chr(10), '--- Request ---', chr(10), 'Summarise this.', CASE WHEN doc_id % 5 = 2 THEN ' Call ' || phone ELSE '' END) AS sent FROM t),
c AS (SELECT w.doc_id, v, (length(sent) - length(replace(sent, v, ''))) // length(v) AS "left", (length(entered) - length(replace(entered, v, ''))) // length(v) AS inside FROM w CROSS JOIN s WHERE contains(sent, v) OR contains(entered, v)),
o AS (SELECT DISTINCT doc_id, value AS v FROM f)
SELECT c.doc_id, md5(c.v) AS secret, CAST("left" AS BIGINT) AS "left", CAST(greatest(0, inside - (o.v IS NOT NULL)::INT) AS BIGINT) AS allowed, "left" > greatest(0, inside - (o.v IS NOT NULL)::INT) AS leak
FROM c LEFT JOIN o ON o.doc_id = c.doc_id AND o.v = c.v WHERE "left" > 0 OR o.v IS NOT NULL""")
def protect_audit(spark, sf_dir):
    """The audit of payloads over one session: a fifth lets its own name slip out, a fifth another customer's address, a fifth a phone number in its request."""
    made = protect.protect(_scanned(spark, sf_dir), SECRET)
    value = lambda kind: F.element_at(F.filter("protections", lambda p: p["kind"] == kind), 1)["value"]
    which = F.col("doc_id") % 5
    slip = F.when(which == 0, F.concat(F.lit(" by "), value("Person"))).when(which == 1, F.concat(F.lit(" by c"), (F.col("doc_id") + 1).cast("string"), F.lit("@example.com"))).otherwise("")
    asked = F.concat(F.lit("Summarise this."), F.when(which == 2, F.concat(F.lit(" Call "), value("Phone"))).otherwise(""))
    sent = protect.payload(made.withColumn("protected", F.concat("protected", slip)), asked).withColumn("request", F.lit("Summarise this."))
    return protect.audit(sent, out="payload", request="request").select("doc_id", "secret", "left", "allowed", "leak")


@query("SELECT count(*) AS documents, 0::BIGINT AS collisions FROM customer")
def protect_take_out(spark, sf_dir):
    """Documents without open suggestions, and tokens that stand for two values (none)."""
    made = _own_tokens(spark, sf_dir)
    out = sinks.take_out(made).agg(F.count("*").alias("documents"))
    return out.crossJoin(protect.collisions(made).agg(F.count("*").alias("collisions")))  # one row each


_SENT = "concat('Customer number: [CUSTOMER]', {n}, 'E-mail: [EMAIL]', {n}, 'Phone: [PHONE]', {n}, 'We met Mr [PERSON] there.', {n}, {n}, '--- Request ---', {n}, 'Summarise this.')"


@query(_FOUND_SQL + f"SELECT doc_id, md5({_SENT.format(n='chr(10)')}) AS sent, 'CUSTOMER,EMAIL,PERSON,PHONE' AS kinds, 4 AS allowed, 4 AS carried FROM t")
def protect_payload(spark, sf_dir):
    """What leaves, each token as its kind; and how many of the allowed tokens it carries."""
    sent = protect.payload(protect.protect(_scanned(spark, sf_dir), SECRET), F.lit("Summarise this."))
    kinds_only = F.regexp_replace("payload", "__Z_[A-Za-z0-9]{4}_([A-Z0-9]+)_[A-Za-z0-9]{4,8}__", r"[$1]")
    carried = F.size(F.filter("allowed", lambda t: F.col("payload").contains(t)))
    return sent.select("doc_id", F.md5(kinds_only).alias("sent"), F.array_join(F.array_sort(F.map_keys("counts")), ",").alias("kinds"), F.size("allowed").alias("allowed"), carried.alias("carried"))


@query(_FOUND_SQL + f"SELECT doc_id, 'Did [PERSON] of __Z_ab12_PHONE_0000000A__ write to __Z_zz99_EMAIL_00000001__ on [PHONE]?' AS said FROM t")
def protect_questions(spark, sf_dir):
    """Questions about letters: a value that the session has takes its token, tokens stay, the rest is scanned anew."""
    made = letters(spark, sf_dir).select("doc_id", F.regexp_extract("text", "We met Mr ([A-Za-z]+) there", 1).alias("name"), F.regexp_extract("text", "Phone: (.+)", 1).alias("phone"))
    store = spark.createDataFrame([("__Z_zz99_EMAIL_00000001__", "Northern Light"), ("__Z_zz99_EMAIL_00000002__", "Northern")], "token string, value string")
    asked = made.select("doc_id", F.concat(F.lit("Did Mr "), "name", F.lit(" of __Z_ab12_PHONE_0000000A__ write to NORTHERN light on "), "phone", F.lit("?")).alias("text"))
    said = F.regexp_replace(F.col("protected"), "__Z_(?!ab12|zz99)[A-Za-z0-9]{4}_([A-Z0-9]+)_[A-Za-z0-9]{4,8}__", r"[$1]")
    return protect.protect_lines(asked, store, scan.knowledge(("en",)), SECRET).select("doc_id", F.replace(said, F.lit("Mr ["), F.lit("[")).alias("said"))


_TOKENS_SQL = """
WITH t AS (SELECT o_orderkey AS doc_id, '__Z_' || (CASE WHEN o_orderkey % 3 = 0 THEN 'ab12' ELSE 'cd34' END) || '_PERSON_' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || '__' AS token, o_custkey FROM orders)
"""


def _returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.concat(F.lit("__Z_"), F.when(F.col("o_orderkey") % 3 == 0, "ab12").otherwise("cd34"), F.lit("_PERSON_"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("__"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Dear "), token, F.lit(", thank you.")).alias("text"))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return c.select(F.concat(F.lit("__Z_ab12_PERSON_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("__")).alias("token"), F.col("c_name").alias("value"))


@query(_TOKENS_SQL + "SELECT doc_id, token, substring(token, 5, 4) AS namespace, 0 AS n FROM t")
def restore_tokens(spark, sf_dir):
    return protect.tokens_in(_returned(spark, sf_dir)).select("doc_id", "token", "namespace", "n")


@query(_TOKENS_SQL + "SELECT doc_id, token, c_name AS value FROM t LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 AND token LIKE '!_!_Z!_ab12%' ESCAPE '!'")
def restore_resolve(spark, sf_dir):
    return protect.resolve(protect.tokens_in(_returned(spark, sf_dir)), _store(spark, sf_dir)).select("doc_id", "token", "value")


@query(_TOKENS_SQL + "SELECT substring(token, 5, 4) AS namespace, count(*) AS tokens, count(DISTINCT CASE WHEN c_name IS NOT NULL THEN token END) AS brought_back, count(DISTINCT CASE WHEN c_name IS NULL THEN token END) AS unresolved FROM t LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 AND token LIKE '!_!_Z!_ab12%' ESCAPE '!' GROUP BY 1")
def restore_statistics(spark, sf_dir):
    return protect.returned_statistics(protect.resolve(protect.tokens_in(_returned(spark, sf_dir)), _store(spark, sf_dir)))


@query(_TOKENS_SQL + "SELECT doc_id, 'Dear ' || replace(token, '_ab12_', '_zz99_') || ', thank you.' AS text FROM t")
def restore_rename(spark, sf_dir):
    tokens = protect.tokens_in(_returned(spark, sf_dir)).where("namespace = 'ab12'").select(F.col("token").alias("old"), F.replace("token", F.lit("_ab12_"), F.lit("_zz99_")).alias("new")).distinct()
    return protect.rename_all(_returned(spark, sf_dir), tokens)


# -- vault -------------------------------------------------------------------------------------------------------------------


def _vault(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Entities from nations, values from suppliers, aliases from their phones, lists and blocks made to match."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return {
        "entities": n.select(F.col("n_nationkey").cast("int").alias("entity_id"), F.lit("Company").alias("kind"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 5 == 0, "p1").alias("profile_id")),
        "values": s.select(F.col("s_suppkey").cast("int").alias("value_id"), F.col("s_nationkey").cast("int").alias("entity_id"), F.when(F.col("s_suppkey") % 4 == 0, "Person").otherwise("Phone").alias("kind"), F.concat(F.lit("V"), (F.col("s_suppkey") % 40).cast("string")).alias("value"), F.when(F.col("s_suppkey") % 7 == 0, "Manual").when(F.col("s_suppkey") % 3 == 0, "Suggest").otherwise("Always").alias("policy"), F.lit(0).cast("long").alias("learned_at"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("L"), (F.col("s_suppkey") % 3).cast("string"))).alias("list")),
        "aliases": s.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").cast("int").alias("value_id"), F.concat(F.lit("A"), (F.col("s_suppkey") % 20).cast("string")).alias("alias")),
        "lists": spark.createDataFrame([("L0", True), ("L1", False)], "name string, enabled boolean"),
        "blocks": n.where("n_nationkey < 3").select(F.col("n_nationkey").cast("int").alias("block_id"), F.lit("Custom").alias("kind"), F.concat(F.lit("B"), F.col("n_nationkey").cast("string")).alias("value"), F.array(F.lit("t")).alias("tokens")),
        "exemptions": spark.createDataFrame([(1, "profile", "p1")], "block_id int, reach string, ref string"),
    }


_VAULT_SQL = """
WITH e AS (SELECT CAST(n_nationkey AS INTEGER) AS entity_id, n_name AS label, CASE WHEN n_nationkey % 5 = 0 THEN 'p1' END AS profile_id FROM nation),
v AS (SELECT CAST(s_suppkey AS INTEGER) AS value_id, CAST(s_nationkey AS INTEGER) AS entity_id, CASE WHEN s_suppkey % 4 = 0 THEN 'Person' ELSE 'Phone' END AS kind, 'V' || (s_suppkey % 40) AS value,
  CASE WHEN s_suppkey % 7 = 0 THEN 'Manual' WHEN s_suppkey % 3 = 0 THEN 'Suggest' ELSE 'Always' END AS policy, CASE WHEN s_suppkey % 2 = 0 THEN 'L' || (s_suppkey % 3) END AS list FROM supplier),
a AS (SELECT CAST(s_suppkey AS INTEGER) AS value_id, 'A' || (s_suppkey % 20) AS alias FROM supplier WHERE s_suppkey % 5 = 0),
sp AS (SELECT value_id, value AS spelling FROM v UNION SELECT value_id, alias FROM a),
h AS (SELECT DISTINCT spelling, kind, policy, v.entity_id FROM v JOIN e ON v.entity_id = e.entity_id JOIN sp ON sp.value_id = v.value_id
  WHERE policy <> 'Manual' AND profile_id IS NULL AND coalesce(list, '') <> 'L1'),
hints AS (SELECT * FROM h UNION ALL SELECT 'B' || n_nationkey, 'Custom', 'Always', -1 FROM nation WHERE n_nationkey < 3)
"""


def _hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _vault(spark, sf_dir)
    return vault.hints(t["entities"], t["values"], t["aliases"], t["lists"], t["blocks"], t["exemptions"])


@query(_VAULT_SQL + "SELECT * FROM hints")
def vault_hints(spark, sf_dir):
    return _hints(spark, sf_dir)


@query(_VAULT_SQL + "SELECT spelling, count(DISTINCT entity_id) AS claimants FROM hints GROUP BY spelling HAVING count(DISTINCT entity_id) > 1")
def vault_conflicts(spark, sf_dir):
    return vault.conflicts(_hints(spark, sf_dir))


@query(_VAULT_SQL + """, gone AS (SELECT DISTINCT value_id FROM sp WHERE spelling = 'V5'), still AS (SELECT g.value_id, count(DISTINCT o.value_id) AS n FROM sp g JOIN sp o ON g.spelling = o.spelling WHERE g.value_id IN (SELECT * FROM gone) AND o.value_id NOT IN (SELECT * FROM gone) GROUP BY 1)
SELECT v.value_id, v.entity_id, e.profile_id, (SELECT count(*) FROM a WHERE a.value_id = v.value_id) AS aliases, v.entity_id NOT IN (SELECT entity_id FROM v WHERE value_id NOT IN (SELECT * FROM gone)) AS entity_empties, coalesce(still.n, 0) AS still_known_by
FROM v LEFT JOIN e ON e.entity_id = v.entity_id LEFT JOIN still ON still.value_id = v.value_id WHERE v.value_id IN (SELECT * FROM gone)""")
def vault_forget_plan(spark, sf_dir):
    t = _vault(spark, sf_dir)
    return vault.forget_plan(t["entities"], t["values"], t["aliases"], "V5")


@query(_VAULT_SQL + "SELECT entity_id, count(*) FILTER (WHERE policy = 'Always') AS always, count(*) FILTER (WHERE policy = 'Suggest') AS suggest, count(*) FILTER (WHERE policy = 'Manual') AS manual, concat_ws(' · ', CASE WHEN count(*) FILTER (WHERE policy = 'Always') > 0 THEN count(*) FILTER (WHERE policy = 'Always') || ' always' END, CASE WHEN count(*) FILTER (WHERE policy = 'Suggest') > 0 THEN count(*) FILTER (WHERE policy = 'Suggest') || ' suggest' END, CASE WHEN count(*) FILTER (WHERE policy = 'Manual') > 0 THEN count(*) FILTER (WHERE policy = 'Manual') || ' manual' END) AS summary FROM v GROUP BY entity_id")
def vault_policies(spark, sf_dir):
    return vault.policy_summary(_vault(spark, sf_dir)["values"])


@query(_VAULT_SQL + "SELECT list, list <> 'L1' AS enabled, count(*) FILTER (WHERE kind IN ('Person', 'Company')) AS names, count(*) FILTER (WHERE kind NOT IN ('Person', 'Company')) AS \"values\" FROM v WHERE list IS NOT NULL GROUP BY list")
def vault_lists(spark, sf_dir):
    t = _vault(spark, sf_dir)
    return vault.list_sizes(t["lists"], spark.createDataFrame([], vault.SCHEMAS["names"]), t["values"])


@query(_VAULT_SQL + "SELECT entity_id, label FROM e WHERE contains(lower(label), 'v1') OR entity_id IN (SELECT v.entity_id FROM v JOIN sp ON sp.value_id = v.value_id WHERE contains(lower(spelling), 'v1'))")
def vault_search(spark, sf_dir):
    t = _vault(spark, sf_dir)
    return vault.search(t["entities"], t["values"], t["aliases"], "V1").select("entity_id", "label")


@query("SELECT CAST(n_nationkey AS INTEGER) AS block_id, 'Custom' AS kind, 'B' || n_nationkey AS value, CASE WHEN n_nationkey = 1 THEN 't,u' ELSE 't' END AS tokens FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 3, 'Email', 'later', 'y' UNION ALL SELECT 4, 'Iban', 'new', 'w'")
def vault_upsert_blocks(spark, sf_dir):
    new = spark.createDataFrame([("Person", "B1", "u", 1), ("Custom", "B1", "u", 2), ("Phone", "new", "w", 3), ("Iban", "new", "w", 4), ("Iban", " ", "x", 5), ("Email", "later", "y", 6)], "kind string, value string, token string, act int")
    return vault.upsert_blocks(_vault(spark, sf_dir)["blocks"], new).select("block_id", "kind", "value", F.array_join("tokens", ",").alias("tokens"))


@query("SELECT 'de' AS lang, CAST(n_name AS VARCHAR) AS name, 'given' AS type FROM nation UNION ALL SELECT 'de', x, 'given' FROM (VALUES ('ZORA'), ('émile'), ('Émile')) AS t(x)")
def vault_teach_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit("de").alias("lang"), F.col("n_name").alias("name"), F.lit("given").alias("type"), F.lit(None).cast("string").alias("profile_id"), F.lit(None).cast("string").alias("list"))
    new = n.select("lang", F.lower("name").alias("name"), "type", "profile_id", "list").unionByName(spark.createDataFrame([("de", "Zora", "given", None, None), ("de", "ZORA", "given", None, None), ("de", "Émile", "given", None, None), ("de", "émile", "given", None, None)], "lang string, name string, type string, profile_id string, list string"))
    return vault.teach_names(n, new).select("lang", "name", "type")


@query(_VAULT_SQL + """, n AS (SELECT x FROM (VALUES ('unheard'), ('V5'), ('A10')) AS t(x) WHERE x NOT IN (SELECT spelling FROM sp))
SELECT (SELECT count(*) FROM v) + (SELECT count(*) FROM n) AS n, CAST((SELECT max(value_id) FROM v) + (SELECT count(*) FROM n) AS INTEGER) AS last, (SELECT count(*) FROM n WHERE x = 'unheard') AS fresh""")
def vault_learn(spark, sf_dir):
    t = _vault(spark, sf_dir)
    new = spark.createDataFrame([("Custom", "unheard"), ("Custom", "V5"), ("Custom", "A10")], "kind string, value string")
    return vault.learn_values(t["values"], t["aliases"], new, 999).agg(F.count("*").alias("n"), F.max("value_id").alias("last"), F.count_if(F.col("value") == "unheard").alias("fresh"))


@query(_FOUND_SQL + "SELECT kind, CASE WHEN kind = 'Phone' AND doc_id % 3 = 1 THEN 'Protected' ELSE 'Suggested' END AS state, count(*) AS n FROM f WHERE NOT (kind = 'Email' AND doc_id % 2 = 0) GROUP BY 1, 2")
def vault_decisions(spark, sf_dir):
    """Answers over findings; of two answers to one finding the later counts."""
    f = kept(scan.findings(_scanned(spark, sf_dir)).select("doc_id", "kind", "value", F.lit("Suggested").alias("state")), "findings")  # read four times
    key = f.select("doc_id", "kind", "value")
    no = key.where("kind = 'Email' AND doc_id % 2 = 0").withColumn("answer", F.lit("NotSensitive")).withColumn("act", F.lit(1))
    yes = key.where("kind = 'Phone' AND doc_id % 3 = 1").withColumn("answer", F.lit("Protect")).withColumn("act", F.lit(2))
    early = key.where("kind = 'Phone'").withColumn("answer", F.lit("Skip")).withColumn("act", F.lit(1))
    return vault.decide(f, no.unionByName(yes).unionByName(early)).groupBy("kind", "state").agg(F.count("*").alias("n"))


@query(_VAULT_SQL + """, c AS (SELECT spelling, arg_min(kind, entity_id) AS kind, count(DISTINCT entity_id) = 1 AND bool_or(policy = 'Always') AS sure, count(DISTINCT entity_id) AS owners FROM hints WHERE policy <> 'Manual' GROUP BY spelling)
SELECT c_custkey AS doc_id, kind, CASE WHEN sure THEN 'Protected' ELSE 'Suggested' END AS state, 4 AS start, owners FROM customer JOIN c ON spelling = 'V' || (c_custkey % 60)""")
def vault_scan(spark, sf_dir):
    """Known values found in texts; a spelling that two entities claim is only suggested."""
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("ask v"), (F.col("c_custkey") % 60).cast("string"), F.lit(" now")).alias("text"))
    hints = _hints(spark, sf_dir)
    found = scan.findings(scan.scan(docs, scan.knowledge(("sv",)), hints=hints)).where("source = 'Vault'")
    owners = vault.claims(hints).select("spelling", F.size("entities").cast("long").alias("owners"))
    return found.join(owners, F.upper("value") == F.col("spelling")).select("doc_id", "kind", "state", "start", "owners")


@query("""
WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem), s AS (SELECT o_orderkey, n FROM orders, range(1, 71) r(n))
SELECT doc_id, count(*) AS places, CAST(sum(length('order ' || doc_id || ' line ' || t.n)) AS BIGINT) AS chars FROM t JOIN s ON s.o_orderkey = t.doc_id AND s.n = t.n GROUP BY doc_id
""")
def vault_contains(spark, sf_dir):
    """Orders' texts against seventy spellings an order (over a million at sf0.01), most of which no text holds."""
    line = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit("\nline "), F.col("l_linenumber").cast("string"))
    texts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("text"))
    docs = kept(texts, "texts")  # read three times
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" line ")).alias("order"))
    spellings = orders.select(F.transform(F.lit([str(n) for n in range(1, 71)]), lambda n: F.concat("order", n)).alias("spelling"))
    return contains.places(docs, spellings).groupBy("doc_id").agg(F.count("*").alias("places"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


# -- name banks, chats, readers ----------------------------------------------------------------------------------------------

_REGISTER_SQL = "WITH r AS (SELECT 'c' || (c_nationkey % 4) AS city, 'N' || (c_custkey % 97) AS name, CAST(c_custkey % 50 + 1 AS BIGINT) AS n, CASE WHEN (c_custkey // 97) % 7 = 0 THEN 'w' ELSE 'm' END AS g FROM customer)"


def _registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("c"), (F.col("c_nationkey") % 4).cast("string")).alias("city"), F.concat(F.lit("N"), (F.col("c_custkey") % 97).cast("string")).alias("name"), (F.col("c_custkey") % 50 + 1).cast("long").alias("count"), F.when(F.floor(F.col("c_custkey") / 97) % 7 == 0, "w").otherwise("m").alias("gender"))


@query(_REGISTER_SQL + """, g AS (SELECT name, CAST(sum(n) AS BIGINT) AS count, count(DISTINCT city) AS cities, sum(CASE WHEN g = 'm' THEN n ELSE 0 END) AS m, sum(CASE WHEN g = 'w' THEN n ELSE 0 END) AS w FROM r GROUP BY name)
SELECT name, count, cities, CASE WHEN cities >= 3 THEN 1 WHEN cities = 2 THEN 2 ELSE 3 END AS tier, CASE WHEN m / count >= 0.2 AND w / count < 0.2 THEN 'm' WHEN w / count >= 0.2 AND m / count < 0.2 THEN 'w' ELSE 'u' END AS gender, CAST(row_number() OVER (ORDER BY count DESC, name) AS INTEGER) AS rank FROM g""")
def names_given(spark, sf_dir):
    return names.given_names(_registers(spark, sf_dir))


@query("WITH g AS (SELECT 'S' || (c_custkey % 211) AS name, count(*) AS count FROM customer GROUP BY 1) SELECT name, count, CASE WHEN count >= 10 THEN 1 ELSE 2 END AS tier, CAST(row_number() OVER (ORDER BY count DESC, name) AS INTEGER) AS rank FROM g WHERE name NOT IN ('S1', 'S2')")
def names_family(spark, sf_dir):
    bearers = table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), (F.col("c_custkey") % 211).cast("string")).alias("name"))
    return names.family_names(bearers, spark.createDataFrame([("S1",), ("S2",)], "name string"))


@query("SELECT name, CASE WHEN m AND w THEN 'u' WHEN m THEN 'm' ELSE 'w' END AS gender FROM (SELECT 'N' || (c_custkey % 97) AS name, bool_or(c_nationkey % 2 = 0) AS m, bool_or(c_nationkey % 3 = 0) AS w FROM customer GROUP BY 1) WHERE m OR w")
def names_library(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), (F.col("c_custkey") % 97).cast("string")).alias("name"), "c_nationkey")
    return names.library_genders(c.where("c_nationkey % 2 = 0"), c.where("c_nationkey % 3 = 0"))


@query("SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS request, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer, count(*) AS turns FROM conversations GROUP BY conv_id")
def report_chats(spark, sf_dir):
    return report.chat_so_far(table(spark, sf_dir, "conversations"))


@query(r"SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, 1 AS pages, CAST(len(string_split(text, chr(10) || chr(10))) AS INTEGER) AS paragraphs FROM documents WHERE length(text) > 0")
def read_txt(spark, sf_dir):
    """Texts through the TXT reader: whole, with pages and paragraphs."""
    files = documents(spark, sf_dir).where(F.length("text") > 0).select(F.col("doc_id").cast("string").alias("path"), F.lit("txt").alias("kind"), F.col("text").cast("binary").alias("content"))
    got = readers.extracted(files).where("refusal IS NULL")
    return got.select(F.col("path").cast("long").alias("doc_id"), F.length("text").alias("chars"), "pages", F.aggregate("places", F.lit(1), lambda a, p: F.greatest(a, p["paragraph"])).alias("paragraphs"))


_FILES_SQL = """
WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_custkey % 4 AS which FROM customer)
SELECT k AS doc_id, CASE which WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'pdf' ELSE 'odt' END AS kind, CASE which WHEN 0 THEN 'Client ' || name || chr(9) || 'x' || chr(10) || chr(10) || seg || chr(10) || chr(10) WHEN 1 THEN 'Client ' || name || chr(10) || seg || chr(12) || 'End' ELSE '' END AS text,
CASE which WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS pages, CASE which WHEN 2 THEN 'UnmappedFont' WHEN 3 THEN 'UnknownKind' ELSE '' END AS refusal FROM c
"""


@query(_FILES_SQL)
def read_files(spark, sf_dir):
    """DOCX and PDF files made from customers, read or refused by name."""
    which = F.col("c_custkey") % 4
    kind = F.when(which == 0, "docx").when(which == 3, "odt").otherwise("pdf")
    files = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").cast("string").alias("path"), kind.alias("kind"), made_files.content(which, "c_name", "c_mktsegment").alias("content"))
    read = readers.extracted(files)
    return read.select(F.col("path").cast("long").alias("doc_id"), "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("refusal", F.lit("")).alias("refusal"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN n > 400 THEN '' ELSE repeat('line ' || o_orderkey || chr(10), CAST(o_orderkey % 90 + 1 AS INTEGER)) END AS text, CASE WHEN n > 400 THEN 'TooLarge' ELSE '' END AS refusal
FROM (SELECT o_orderkey, (6 + length(CAST(o_orderkey AS VARCHAR))) * (o_orderkey % 90 + 1) AS n FROM orders)""")
def read_refusals(spark, sf_dir):
    """Files of which the large ones are refused before they are read."""
    text = F.expr("repeat(concat('line ', o_orderkey, '\n'), CAST(o_orderkey % 90 + 1 AS INT))")
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit("txt").alias("kind"), text.cast("binary").alias("content"))
    read = readers.extracted(files, most_bytes=400)
    return read.select(F.col("path").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("refusal", F.lit("")).alias("refusal"))


@query("""SELECT kind, word FROM (VALUES ('Person', 'PERSON'), ('Company', 'COMPANY'), ('Phone', 'PHONE'), ('Email', 'EMAIL'), ('Address', 'ADDRESS'), ('Iban', 'IBAN'), ('Bic', 'BIC'),
('Account', 'ACCOUNT'), ('CustomerNo', 'CUSTOMER'), ('TaxId', 'TAX'), ('IdCard', 'IDCARD'), ('Vehicle', 'VEHICLE'), ('Birthdate', 'BIRTHDATE'), ('EmployeeNo', 'EMPLOYEE'),
('SocialInsuranceNo', 'SOCIAL'), ('Contract', 'CONTRACT'), ('Amount', 'AMOUNT'), ('Date', 'DATE'), ('Custom', 'CUSTOM')) AS t(kind, word)""")
def dimension_kinds(spark, sf_dir):
    return kinds(spark)


def scan_documents(spark, sf_dir):
    """All rules of six languages over the documents; rows only."""
    known = scan.knowledge(("de", "en", "sv", "ar", "fr", "es"))
    return scan.findings(scan.scan(documents(spark, sf_dir), known)).select("doc_id", "lang", "start", "end", "kind", "state", "source", "rule", "occurrences")


def protect_documents(spark, sf_dir):
    """Documents with every sure finding as a token."""
    known = scan.knowledge(("de", "en", "fr", "es"))
    made = protect.protect(scan.scan(documents(spark, sf_dir), known), SECRET)
    return made.select("doc_id", "lang", F.md5("protected").alias("protected"), F.size("protections").alias("places"))


QUERIES |= {f.__name__: f for f in (scan_documents, protect_documents)}


# -- marks -------------------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber * 10 AS INTEGER) AS s, CAST(l_linenumber * 10 + 8 AS INTEGER) AS e, 'Phone' AS kind FROM lineitem),
a AS (SELECT o_orderkey AS doc_id, 1 AS act, CAST(12 + o_orderkey % 20 AS INTEGER) AS s, CAST(20 + o_orderkey % 20 AS INTEGER) AS e FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)
SELECT doc_id, s AS start, e AS "end", kind FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = p.doc_id AND p.s < a.e AND a.s < p.e)
UNION ALL SELECT doc_id, s, e, 'Custom' FROM a WHERE doc_id % 4 = 0
""")
def marks_overlay(spark, sf_dir):
    """Marks set or taken by hand on even orders; those of orders that 3 divides are undone."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10).cast("int").alias("start"), (F.col("l_linenumber") * 10 + 8).cast("int").alias("end"), F.lit("Phone").alias("kind"))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    acts = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("act"), F.when(F.col("o_orderkey") % 4 == 0, "protect").otherwise("unprotect").alias("op"), (F.col("o_orderkey") % 20 + 12).cast("int").alias("start"), (F.col("o_orderkey") % 20 + 20).cast("int").alias("end"), F.lit("Custom").alias("kind"), F.lit(None).cast("int").alias("of"))
    undo = acts.where("doc_id % 3 = 0").withColumn("of", F.col("act")).withColumn("act", F.lit(2)).withColumn("op", F.lit("undo"))
    return marks.overlay(p, acts.unionByName(undo))


@query("SELECT c_custkey AS doc_id, 1 AS line, 1 AS cell, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 2, 1, CAST(c_custkey AS VARCHAR) FROM customer")
def marks_column(spark, sf_dir):
    """A column by example: the second cell of the second and third lines."""
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("a  b\n"), "c_name", F.lit("\t"), "c_mktsegment", F.lit("\nx  "), F.col("c_custkey").cast("string"))
    docs = c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    example = docs.select("doc_id", F.lit(1).alias("first_line"), F.lit(2).alias("last_line"), F.lit(1).alias("cell"))
    return marks.column_by_example(marks.cells(docs), example).select("doc_id", "line", "cell", "value")


@query(_FOUND_SQL + """, p AS (SELECT f.doc_id, kind, CASE WHEN kind = 'CustomerNo' THEN 17 ELSE strpos(text, value) - 1 END AS start, text FROM f JOIN t ON f.doc_id = t.doc_id WHERE kind <> 'Email' OR f.doc_id % 2 = 0),
l AS (SELECT *, length(text[1:start]) - length(replace(text[1:start], chr(10), '')) AS line FROM p)
SELECT doc_id, first, count(*) AS marks FROM l JOIN (VALUES (0, 1), (1, 1), (1, 3)) r(first, last) ON line BETWEEN first AND last GROUP BY doc_id, first, last""")
def marks_lines(spark, sf_dir):
    """Findings on three ranges of lines of each letter, of which half lack an address."""
    found = scan.findings(_scanned(spark, sf_dir)).where("kind != 'Email' OR doc_id % 2 = 0")
    cells = marks.cells(letters(spark, sf_dir))
    return marks.line_selections(found, cells, [(0, 1), (1, 1), (1, 3)]).select("doc_id", "first", "marks")


@query(_VAULT_SQL + """, c AS (SELECT spelling, list_sort(list(DISTINCT entity_id)) AS ids FROM hints WHERE policy <> 'Manual' GROUP BY spelling)
SELECT c_custkey AS doc_id, CASE WHEN len(ids) > 1 THEN len(ids) || ' of your entries claim it' WHEN list_contains(ids, -1) THEN 'you protected it before, and it was kept' ELSE 'it is a value you keep' END AS because, len(list_filter(ids, lambda i: i >= 0)) AS owners FROM customer JOIN c ON spelling = 'V' || (c_custkey % 60)""")
def marks_owners(spark, sf_dir):
    """Why known values were found, and how many of the vault's entities own them."""
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("ask v"), (F.col("c_custkey") % 60).cast("string"), F.lit(" now")).alias("text"))
    t = _vault(spark, sf_dir)
    found = scan.findings(scan.scan(docs, scan.knowledge(("sv",)), hints=_hints(spark, sf_dir))).where("source = 'Vault'")
    labels = t["entities"].select("entity_id", F.concat(F.lit("e"), F.col("entity_id").cast("string")).alias("label"))
    return marks.explain(found, labels).select("doc_id", "because", F.size("owners").cast("long").alias("owners"))


@query(_FOUND_SQL + "SELECT doc_id, kind, kind || ' is protected' AS headline, CASE kind WHEN 'CustomerNo' THEN 'a rule of the language fits: en-14' WHEN 'Person' THEN 'a rule of the language fits: en:salutation' WHEN 'Email' THEN 'the rule for email fits, and its arithmetic comes out' ELSE 'the rule for phone-intl fits, and its arithmetic comes out' END AS because FROM f")
def marks_explain(spark, sf_dir):
    return marks.explain(scan.findings(_scanned(spark, sf_dir))).select("doc_id", "kind", "headline", "because")


@query("SELECT payload_id FROM (SELECT o_orderkey AS payload_id, o_orderkey % 10 = 0 AS answered, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 16 OR answered")
def marks_newest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return marks.newest(o.select(F.col("o_orderkey").alias("payload_id"), (F.col("o_custkey") % 50).alias("session"), F.col("o_orderdate").alias("made"), (F.col("o_orderkey") % 10 == 0).alias("answered"))).select("payload_id")


@query("""SELECT id, id IN ('de', 'en', 'sv', 'ar', 'fr', 'es') AS has_rules FROM (SELECT unnest(string_split(replace('af am ar az be bg bn bs ca cs cy da de el en es et eu fa fi fr ga gl gu he hi hr hu hy id is it
ja ka kk km kn ko ku ky lo lt lv mk ml mn mr ms my nb ne nl nn pa pl ps pt ro ru si sk sl sq sr sv sw ta te th tl tr uk ur uz vi zh', chr(10), ' '), ' ')) AS id)""")
def dimension_languages(spark, sf_dir):
    return languages(spark).select("id", "has_rules")


@query("SELECT * FROM (VALUES ('zz', 3::BIGINT, 3::BIGINT), ('de', 45, 39), ('en', 50, 50), ('sv', 20, 18)) AS t(set, n, auto)")
def dimension_labels(spark, sf_dir):
    rows = [(r.set, r.id, r.label, r.kind, r.validator, r.decision) for rows in LABELS.values() for r in rows]
    t = spark.createDataFrame(rows, "set string, id string, label string, kind string, validator string, decision string")
    return t.groupBy("set").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "auto").alias("auto"))


# -- languages, candidates, finding a value ------------------------------------------------------------------------------------

_N9_FREE = "CAST((o_orderkey * 7919) % 900000000 + 100000000 AS {s})"


@query(f"""
WITH o AS (SELECT o_orderkey AS k, {_N9_FREE.format(s="VARCHAR")} AS siren, lpad(CAST((o_orderkey * 7919) % 100000000 AS VARCHAR), 8, '0') AS dni FROM orders)
SELECT 'de' AS pack, 'Vehicle' AS kind, 'Protected' AS state, count(*) AS n FROM o
UNION ALL SELECT 'de', 'Address', 'Suggested', count(*) FROM o
UNION ALL SELECT 'fr', 'TaxId', 'Protected', count(*) FROM o WHERE {_LUHN_SQL.format(v="siren")}
UNION ALL SELECT 'es', 'IdCard', 'Protected', count(*) FROM o WHERE CAST(dni AS BIGINT) % 23 = k % 23
""")
def scan_packs(spark, sf_dir):
    """Rules of one language each: plates and addresses (de), company numbers (fr), identity numbers (es)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    siren = F.expr(_N9_FREE.format(s="STRING"))
    three = F.concat_ws(" ", F.substring(siren, 1, 3), F.substring(siren, 4, 3), F.substring(siren, 7, 3))
    letter = F.substr(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (k % 23 + 1).cast("int"), F.lit(1))
    plate = F.concat(F.lit("Wagen B-"), F.substr(F.lit("ABCDEFGH"), (k % 8 + 1).cast("int"), F.lit(1)), F.lit(" "), (k % 9999 + 1).cast("string"), F.lit("\nGartenstraße 8, 10115 Berlin"))
    texts = {"de": plate, "fr": F.concat(F.lit("SIREN "), three), "es": F.concat(F.lit("documento "), F.lpad((k * 7919 % 100000000).cast("string"), 8, "0"), letter)}
    out = None
    for pack, text in texts.items():
        found = scan.findings(scan.scan(o.select(k.alias("doc_id"), text.alias("text")), scan.knowledge((pack,))))
        one = found.groupBy(F.lit(pack).alias("pack"), "kind", "state").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def _literal(x: object) -> str:
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


_CASES = len(rule_cases.TEXTS)


@query(f"SELECT \"case\", rule, kind, state, value, count(*) AS n FROM (VALUES {', '.join('(' + ', '.join(map(_literal, row)) + ')' for row in rule_cases.FINDINGS)}) AS f(\"case\", rule, kind, state, value) JOIN customer ON c_custkey % {_CASES} = \"case\" GROUP BY ALL")
def scan_rules(spark, sf_dir):
    """Each rule for names, companies, tables, phones and addresses on a line of its own; the findings are written out beside them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % _CASES).cast("int").alias("case"))
    made = spark.createDataFrame([(k, pack, text) for k, (pack, text) in enumerate(rule_cases.TEXTS)], "case int, pack string, text string")
    docs = c.join(F.broadcast(made), "case")  # some twenty lines
    parts = [scan.findings(scan.scan(docs.where(F.col("pack") == p), scan.knowledge((p,)))) for p in dict.fromkeys(p for p, _ in rule_cases.TEXTS)]
    return reduce(DataFrame.unionByName, parts).groupBy("case", "rule", "kind", "state", "value").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT c_nationkey, c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'given' WHEN 1 THEN 'Family' WHEN 2 THEN 'company' WHEN 3 THEN 'thing' ELSE 'person' END AS type FROM customer)
SELECT c_nationkey AS list, count(*) FILTER (WHERE type <> 'thing' AND c_custkey % 7 <> 0) AS names, count(*) FILTER (WHERE type <> 'thing' AND c_custkey % 7 <> 0 AND c_custkey % 2 = 0) AS "values",
count(*) FILTER (WHERE type = 'thing' OR c_custkey % 7 = 0) AS refused, 'note' AS unused, min('N, ' || c_custkey) FILTER (WHERE type <> 'thing' AND c_custkey % 7 <> 0) AS first FROM l GROUP BY c_nationkey""")
def lists_of_users(spark, sf_dir):
    """A list of people for each nation, with quoted names, e-mails, a column of no use and lines that have to be refused."""
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"N, '), k.cast("string"), F.lit('"')))
    type_ = F.element_at(F.array(*map(F.lit, ("given", "Family", "company", "thing", "person"))), (k % 5 + 1).cast("int"))
    line = F.concat_ws(",", name, type_, F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))).otherwise(""), F.lit("x"))
    files = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("# own\nName,type,Email,note\n"), F.array_join(F.collect_list(line), "\n")).cast("binary").alias("content"))
    got = readers.user_lists(files.select(F.col("c_nationkey").cast("string").alias("path"), "content"))
    return got.select(F.col("path").cast("int").alias("list"), F.size("names").cast("long").alias("names"), F.size("values").cast("long").alias("values"), F.size("refused").cast("long").alias("refused"), F.array_join("unused", ",").alias("unused"), F.array_min(F.transform("names", lambda x: x["name"])).alias("first"))


@query("""WITH l AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 50 = 1 THEN '[' || CASE (c_custkey // 50) % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'family' END || ']' WHEN c_custkey % 50 = 7 THEN ' ' ELSE ' n' || c_custkey END AS v FROM customer),
h AS (SELECT *, max(CASE WHEN v LIKE '[%' THEN n END) OVER (ORDER BY n) AS head FROM l)
SELECT trim(a.v) AS name, trim(b.v, '[]') AS section FROM h a LEFT JOIN l b ON b.n = a.head WHERE a.v NOT LIKE '[%' AND trim(a.v) <> ''""")
def names_arabic_library(spark, sf_dir):
    """Lines under headings: each name takes the section above it."""
    k = F.col("c_custkey")
    head = F.element_at(F.array(F.lit("[male]"), F.lit("[female]"), F.lit("[family]")), (F.floor(k / 50) % 3 + 1).cast("int"))
    value = F.when(k % 50 == 1, head).when(k % 50 == 7, " ").otherwise(F.concat(F.lit(" n"), k.cast("string")))
    return readers.arabic_library(table(spark, sf_dir, "customer").select(k.alias("line_no"), value.alias("value")))


@query("""SELECT DISTINCT 'n' || (c_custkey % 400) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'given' ELSE 'family' END AS type FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 3 IN (1, 2) AND c_custkey % 4 <> 3""")
def names_bank_lines(spark, sf_dir):
    """A bank's lines: comments, a header and other tiers are passed, names are lower-cased and taken once."""
    k = F.col("c_custkey")
    line = F.concat_ws(",", F.concat(F.lit(" N"), (k % 400).cast("string")), F.when(k % 2 == 0, "given").otherwise("family"), (k % 3).cast("string"))
    line = F.when(k % 9 == 0, F.concat(F.lit("# "), line)).when(k % 4 == 3, F.lit("name,type,tier")).otherwise(line)
    return names.loaded(table(spark, sf_dir, "customer").select(line.alias("value")), tiers=(1, 2))


@query("""SELECT 'c' || c_nationkey AS city, CASE WHEN c_nationkey % 3 = 1 THEN 'Jörg ' ELSE 'Anna ' END || c_custkey AS name, CAST(c_custkey % 9 + 1 AS BIGINT) AS count, CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'w' END AS gender FROM customer WHERE c_custkey % 11 <> 0""")
def names_registers(spark, sf_dir):
    """Registers of cities in three encodings and with both separators, of which lines without a number are passed."""
    k, city = F.col("c_custkey"), F.col("c_nationkey")
    sep = F.when(city % 2 == 0, ";").otherwise(",")
    name = F.concat(F.when(city % 3 == 1, "Jörg ").otherwise("Anna "), k.cast("string"))
    line = F.concat(name, sep, F.when(k % 11 == 0, "many").otherwise((k % 9 + 1).cast("string")), sep, F.when(k % 2 == 0, "M").otherwise("w"))
    text = F.concat(F.lit("Vorname"), sep, F.lit("anzahl"), sep, F.lit("GESCHLECHT\n"), F.array_join(F.collect_list(line), "\n"))
    files = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(text.alias("text"))
    mark = F.when(city % 3 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    content = F.when(city % 3 == 1, F.encode("text", "ISO-8859-1")).otherwise(F.concat(mark, F.encode("text", "UTF-8")))
    return readers.register_rows(files.select(F.concat(F.lit("c"), city.cast("string")).alias("city"), content.alias("content")))


_BANK_WORDS = 40


@query(r"""
WITH w AS (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents), f AS (SELECT doc_id, lang, lower(trim(w, ',;:.!?"()»«')) AS w FROM w),
own AS (SELECT DISTINCT doc_id, w FROM f WHERE regexp_full_match(w, '[a-z]+')),
b AS (SELECT w AS name, lang, CASE WHEN length(w) % 3 = 0 THEN 'given' ELSE 'family' END AS type FROM (SELECT DISTINCT lang, w FROM f WHERE regexp_full_match(w, '[a-z]+') AND length(w) % 2 = 1))
SELECT doc_id, b.lang AS lang, type, count(*) AS names, min(name) AS first FROM own JOIN b ON name = w GROUP BY doc_id, b.lang, type
""")
def names_in_texts(spark, sf_dir):
    """Words of all documents in a bank of millions: half of their words in their languages, and forty further writings of each
    distinct word, which no text holds."""
    docs = documents(spark, sf_dir)
    words = docs.select("lang", F.explode(F.split("text", r"\s+")).alias("w")).select("lang", F.lower(F.expr("trim(BOTH ',;:.!?\"()»«' FROM w)")).alias("w")).where("w RLIKE '^[a-z]+$'").distinct()
    kind = F.when(F.length("w") % 3 == 0, "given").otherwise("family").alias("type")
    real = words.where(F.length("w") % 2 == 1).select("lang", F.col("w").alias("name"), kind)
    more = words.select("lang", "w", F.explode(F.sequence(F.lit(1), F.lit(_BANK_WORDS))).alias("n")).select("lang", F.concat("w", F.col("n").cast("string")).alias("name"), kind)
    return bank.met_in(docs.select("doc_id", "text"), real.union(more)).groupBy("doc_id", "lang", "type").agg(F.count("*").alias("names"), F.min("name").alias("first"))


_WORD = "'Q' || translate(CAST(c_custkey % 300 AS {s}), '0123456789', 'abcdefghij') || 'ill'"


@query(f"""WITH c AS (SELECT {_WORD.format(s='VARCHAR')} AS word, c_custkey, 'we saw Laura ' || {_WORD.format(s='VARCHAR')} || ' there ' || c_custkey AS line FROM customer)
SELECT word, 'after-a-given-name' AS rule, count(*) AS occurrences, count(*) AS pages, array_to_string(list(line ORDER BY c_custkey)[1:3], ' / ') AS examples FROM c GROUP BY word""")
def report_name_candidates(spark, sf_dir):
    """Surnames that no list holds, after a given name that one does."""
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("we saw Laura "), F.expr(_WORD.format(s="STRING")), F.lit(" there "), F.col("c_custkey").cast("string")).alias("text"))
    return report.name_candidates(docs, scan.knowledge(("en",))).select("word", "rule", "occurrences", "pages", F.array_join("examples", " / ").alias("examples"))


@query(_FOUND_SQL + "SELECT doc_id, CAST(strpos(text, 'Mr ') + 2 AS INTEGER) AS start, 'Protected' AS state FROM t WHERE person = 'Cooper'")
def find_value(spark, sf_dir):
    """Places of a value and what covers them."""
    return protect.find_in_document(_scanned(spark, sf_dir), "cooper").select("doc_id", "start", "state")
