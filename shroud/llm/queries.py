"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, bpe, embed_dedup, exact_search, lm, merkle, near_search, ngram_join, packing, pii, quality, suffix_dedup, toxicity
from .shared import fold, read_table


#: Words of the shortest passage that counts as a repeat.
PASSAGE = 51


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's figures of the 400-byte rule, and n_passage_bytes: bytes in repeats of 400 bytes or of over 50 words."""
    return suffix_dedup.digest(read_table(spark, sf_dir, "documents"), words=PASSAGE)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.exact_search(read_table(spark, sf_dir, "embeddings"))


def op4_near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_search.near_search(read_table(spark, sf_dir, "embeddings"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0; not learnt from), expected_grade, tail_probability, keep."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    graded = quality.grade(docs, model)
    return graded.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("keep"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b, ranks = map(tokenizer_path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    return align.scored(read_table(spark, sf_dir, "documents"), a, b, ranks, public_tokenizers.PATTERN)


def op12_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_suffix_dedup, op2_pii, op3_exact_search, op4_near_search, op5_lm, op6_ngram_join, op7_quality, op8_bpe, op9_toxicity, op10_packing, op11_align, op12_embed_dedup, op13_merkle)
    return {f.__name__: f for f in each}


EXACT_SEARCH_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

NGRAM_JOIN_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\t-\r ]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM met JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
root AS (SELECT x, least(x, min(y)) AS class_id FROM r GROUP BY x),
links AS (SELECT l.x, count(*) AS n, count(DISTINCT CASE WHEN a.text <> b.text THEN b.text END) AS m, count(*) FILTER (WHERE a.text = b.text) AS copies FROM l JOIN d a ON a.doc_id = l.x JOIN d b ON b.doc_id = l.y GROUP BY l.x)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n, 0) AS n_links, coalesce(m, 0) AS n_text_links, coalesce(copies, 0) + 1 AS n_copies
FROM d LEFT JOIN root ON root.x = d.doc_id LEFT JOIN links ON links.x = d.doc_id
"""


EMBED_DEDUP_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT p.vec_id AS x, q.vec_id AS y FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
root AS (SELECT x, least(x, min(y)) AS component_id FROM r GROUP BY x),
links AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN root ON root.x = vec_id LEFT JOIN links ON links.x = vec_id
"""

#: Levels of a tree that the SQL has: 16^5 leaves.
_LEVELS = 5


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs of a tree: the nodes of each level with their runs (kids), from leaves of (g, i, n, d)."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(_LEVELS):
        out.append(f"{name}_run{k} AS (SELECT g, i // 16 AS i, any_value(n) AS n, string_agg(d, '' ORDER BY i) AS kids FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16)")
        out.append(f"{name}{k + 1} AS (SELECT g, i, (n + 15) // 16 AS n, sha256(kids) AS d FROM {name}_run{k})")
    tops = " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE n = 1" for k in range(_LEVELS + 1))
    return ",\n".join([*out, f"{name}_top AS ({tops})"])


def _climb_sql(name: str, made: str) -> str:
    """CTEs that fold a leaf (g, i, n, own, x: digest now, p: siblings so far) up to its tree's root."""
    out, last = [], made
    for k in range(_LEVELS):
        at = f"64 * (s.i % 16)"
        side = f"substr(t.kids, 1, {at}), ", f", substr(t.kids, {at} + 65)"
        step = f"CASE WHEN s.n > 1 THEN s.p || concat({side[0]}'' {side[1]}) ELSE s.p END AS p, CASE WHEN s.n > 1 THEN sha256(concat({side[0]}s.x{side[1]})) ELSE s.x END AS x"
        out.append(f"{name}_up{k} AS (SELECT s.g, CASE WHEN s.n > 1 THEN s.i // 16 ELSE s.i END AS i, (s.n + 15) // 16 AS n, s.own, {step} FROM {last} s LEFT JOIN {name}_run{k} t ON t.g IS NOT DISTINCT FROM s.g AND t.i = s.i // 16)")
        last = f"{name}_up{k}"
    return ",\n".join(out)


_FIELDS_SQL = "concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: crc32 of the decimal id, bit by bit; DuckDB has no such function.
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE_SQL = f"""
WITH l AS (SELECT doc_id, source, sha256({_FIELDS_SQL.format(text="text")}) AS d, CASE WHEN {_CRC_SQL} % 5 = 0 THEN sha256({_FIELDS_SQL.format(text=_LOWER_SQL)}) END AS now FROM documents),
placed AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, d, doc_id, coalesce(now, d) AS x FROM l),
{_tree_sql("t", "SELECT g, i, n, d FROM placed")},
subs AS (SELECT g AS source, row_number() OVER (ORDER BY g IS NOT NULL, encode(g)) - 1 AS i, count(*) OVER () AS n, d FROM t_top),
{_tree_sql("u", "SELECT 0 AS g, i, n, d FROM subs")},
start AS (SELECT g, i, n, {{'doc_id': doc_id, 'leaf': d}} AS own, '' AS p, x FROM placed),
{_climb_sql("t", "start")},
upper AS (SELECT 0 AS g, subs.i, subs.n, {{'doc_id': s.own.doc_id, 'leaf': s.own.leaf, 'subroot': subs.d}} AS own, s.p, s.x FROM t_up{_LEVELS - 1} s JOIN subs ON subs.source IS NOT DISTINCT FROM s.g),
{_climb_sql("u", "upper")}
SELECT own.doc_id AS doc_id, own.leaf AS leaf, own.subroot AS subroot, d AS root, sha256(p) AS proof_sha256, x AS folded_root, x = d AS verified FROM u_up{_LEVELS - 1} CROSS JOIN u_top
"""


def oracle_sql() -> dict[str, str]:
    """The other operators can't be said in SQL: tests/llm holds them against brute force, round trips or held-out labels."""
    return {"op3_exact_search": EXACT_SEARCH_SQL, "op6_ngram_join": NGRAM_JOIN_SQL, "op12_embed_dedup": EMBED_DEDUP_SQL, "op13_merkle": MERKLE_SQL}
