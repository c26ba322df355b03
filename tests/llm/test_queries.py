"""The registered queries themselves, on one small folder, each against a brute-force version or held-out labels."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from shroud.llm import lm, queries, toxicity

from .conftest import words
from .test_text_operators import base_spans, join_of, removed
from .test_vector_searches import exact

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fold(i, parts=5):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    texts, good, toxic = [], [], []
    for k in range(420):
        bad, insult, group = rng.random() < 0.4, rng.random() < 0.5, rng.random() < 0.5
        t = f"{words(rng, rng.randint(15, 60))} {'dullard' if insult else 'painter'} {'northerners' if group else 'gardens'} {words(rng, 5)}"
        texts.append(" ".join(w + "&&&" for w in t.split()) if bad else t)
        good.append(int(not bad))
        toxic.append(int(insult and group and not bad))
    texts += [texts[1], texts[2], None, "", "call +49 30 1234567 or a@b.de", words(rng, 5000)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, "nobody's text", "en", "s", 13), (1, texts[1], "en", "s", 1)]
    at = tmp_path_factory.mktemp("queries")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, g, t) for k, (g, t) in enumerate(zip(good, toxic, strict=True))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    x = np.random.default_rng(5).normal(size=(300, 8))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(None, [0.0] * 8), (500, None)], "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return str(at), [(r[0], r[1]) for r in rows], good, toxic, x


def test_removal_of_repeats(spark, folder):
    at, rows, *_ = folder
    want = Counter((i, *r) for (i, _), r in zip(rows, removed([t for _, t in rows]), strict=True))
    got = queries.op1_suffix_dedup(spark, at)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want
    assert all(r["n_passage_bytes"] >= r["n_removed"] for r in got.collect())


def test_personal_data(spark, folder):
    at, rows, *_ = folder
    want = Counter((i, hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in queries.op2_pii(spark, at).collect()) == want


def test_searches(spark, folder):
    at, *_, x = folder
    y = np.floor(256 * x).astype(np.int64)
    score = {q: y @ y[q] for q in range(0, 300, 50)}
    assert sorted(map(tuple, queries.op3_exact_search(spark, at).collect())) == sorted((q, n, i, int(s)) for q, n, i, s in exact(range(300), score, score, 5))
    near = {q: x @ x[q] for q in range(0, 300, 20)}
    want = {(q, i) for q, _, i, _ in exact(range(300), near, near, 20)}
    got = queries.op4_near_search(spark, at).collect()
    assert len(got) == len(want) and len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)
    assert all(r["score"] == pytest.approx(near[r["query_id"]][r["vec_id"]], abs=1e-12) for r in got)


def test_language_model(spark, folder):
    at, rows, *_ = folder
    learnt = Counter(w for i, t in rows if fold(i) != 1 for w in lm.tokens(t))
    n, v = sum(learnt.values()), len(learnt)
    got = queries.op5_lm(spark, at).collect()
    want = Counter((i, fold(i) == 1, len(lm.tokens(t)), sum(learnt[w] > 0 for w in lm.tokens(t)), n, round(sum(np.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in lm.tokens(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_near_duplicates(spark, folder):
    at, rows, *_ = folder
    want = Counter((i, n) for (i, _), (_, _, n, _) in zip(rows, join_of([t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], r["n_links"]) for r in queries.op6_ngram_join(spark, at).collect()) == want


def test_quality_and_toxicity(spark, folder):
    at, rows, good, toxic, _ = folder
    kept = {r["doc_id"]: r for r in queries.op7_quality(spark, at).collect()}
    marked = {r["doc_id"]: r for r in queries.op9_toxicity(spark, at).collect()}
    held = [i for i in range(420) if fold(i) == 0]
    assert all(kept[i]["held_out"] == marked[i]["held_out"] == (fold(i) == 0) for i, _ in rows)
    assert np.mean([kept[i]["keep"] == bool(good[i]) for i in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in marked.values())
    assert np.mean([marked[i]["predicted"] == toxic[i] for i in held]) > 0.85


def test_tokens_and_pieces(spark, folder):
    from tokenizers import Tokenizer

    at, rows, *_ = folder
    library = Tokenizer.from_file(queries.tokenizer_path())
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    want = Counter((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for (i, _), x in zip(rows, ids, strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in queries.op8_bpe(spark, at).collect()) == want
    pieces = sorted(queries.op10_packing(spark, at).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["sequence_id"] * 4096 + r["offset"] for r in pieces] == np.r_[0, np.cumsum([r["length"] for r in pieces])[:-1]].tolist()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == Counter((i, len(x) + 1) for (i, _), x in zip(rows, ids, strict=True))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for run in (queries.op7_quality, queries.op9_toxicity, corpus_pipeline.run):
        assert run(spark, str(tmp_path)).count() == 0


def test_terms_that_tell_only_together():
    """Neither word says anything alone: a text is marked when it has both or none of the two."""
    rng = np.random.default_rng(3)
    rows, label = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique(np.r_[rng.integers(10, 3000, 30), [1] if a else [2], [3] if b else [4]]))
        label.append(float(a == b))
    m = toxicity.fit(rows[:2500], np.array(label[:2500]))
    assert {1, 2, 3, 4} <= set(m.terms.tolist())
    doc = np.repeat(np.arange(500), [len(r) for r in rows[2500:]])
    got = m.score(doc, np.concatenate(rows[2500:]), 500)
    assert np.mean((got >= 0.5) == np.array(label[2500:])) > 0.9
