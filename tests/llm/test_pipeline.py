"""The pipeline's stages on a small corpus, each against a brute-force version on its own input."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shroud.llm import pii

from .conftest import words
from .test_text_operators import join_of, removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    passage = words(rng, 110)
    texts, good = [], []
    for k in range(160):
        bad = k % 4 == 0
        t = words(rng, rng.randint(40, 120))
        if k % 10 == 1:
            t = f"{t} {passage} write to a{k}@b.de {words(rng, 5)}"
        texts.append(" ".join(w + "&&&" for w in t.split()) if bad else t)
        good.append(int(not bad))
    texts += [texts[1], texts[1] + " more", texts[2], None, ""]
    at = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, g, 0) for k, g in enumerate(good)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), good


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, folder, tmp_path):
    sf, good = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.schema.names == docs.schema.names
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs, (docs := spark.read.parquet(str(tmp_path / name)))

    before, after = map(texts_of, seen["quality"])
    assert all((d in after) == bool(good[d]) for d in range(len(good))) and all(after[d] == before[d] for d in after)

    before, after = map(texts_of, seen["near_duplicates"])
    ids = sorted(before)
    roots = {ids[k]: ids[r] for k, r, *_ in join_of([before[d] for d in ids])}
    assert len(after) == len({roots[d] if (before[d] or "").split() else (d,) for d in ids}) and all(after[d] == before[d] for d in after)

    before, after = map(texts_of, seen["repeated_passages"])
    ids = sorted(before)
    kept = removed([before[d] for d in ids])
    assert sorted(after) == ids and any(n for _, n, *_ in kept)
    for d, (n, gone, *_) in zip(ids, kept, strict=True):
        assert len((after[d] or "").encode()) == n - gone
    assert all(r["n_chars"] == len(r["text"] or "") for r in seen["repeated_passages"][1].where("text IS NOT NULL").collect())

    before, after = map(texts_of, seen["personal_data"])
    for d, t in before.items():
        spans = [s for s in pii.find(t) if s.score >= 0.5]
        assert sorted(before) == sorted(after) and (bool(spans) == (after[d] != t)) and "@b.de" not in (after[d] or "")

    before, pieces = texts_of(seen["packing"][0]), seen["packing"][1].collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in before.items()}
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values())) and {p["doc_id"] for p in pieces} == set(before)
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])


def test_repeated_passages_of_over_fifty_short_words(spark):
    rng = random.Random(4)
    passage, line = words(rng, 51), words(rng, 50)
    texts = [f"{words(rng, 80)} {p} {words(rng, 80)}" for p in (passage, passage, line, line)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    after = texts_of(corpus_pipeline.repeated_passages(spark, docs, ""))
    assert len(passage) < 400 and [after[k] for k in range(4)] == [t.replace(passage, "") for t in texts]


def test_run_is_the_stages_in_order(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def test_the_query_gives_the_ids(spark, folder):
    from __spark_entry__ import queries

    pieces = queries()["pipeline"](spark, folder[0]).collect()
    assert len(pieces) > 100 and all(len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"] for p in pieces)
