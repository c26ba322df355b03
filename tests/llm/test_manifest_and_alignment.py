"""Alignment of tokenizers, near duplicates of vectors and the Merkle manifest, each against a brute-force version."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from shroud.llm import align, embed_dedup, merkle, queries, shared

# -- alignment


def groups_of(text, library, model, letters):
    """Groups of one text as ([ids of A], [ids of B]) by walking along both."""
    if not text:
        return []
    a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    spelt_a = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
    spelt_b = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
        return []
    ends = [set(np.cumsum([len(s) for s in x]).tolist()) for x in (spelt_a, spelt_b)]
    out, at = [([], [])], 0
    cuts = sorted(ends[0] & ends[1])
    for side, (ids, spelt) in enumerate(((a, spelt_a), (b, spelt_b))):
        at, k = 0, 0
        for i, s in zip(ids, spelt, strict=True):
            while len(out) <= k:
                out.append(([], []))
            out[k][side].append(i)
            at += len(s)
            k += at == cuts[k]
    return out


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    return library, sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model")), letters


def odd_texts():
    rng = random.Random(4)
    fixed = [None, "", " ", "  a  b ", "▁x", "é" * 300, "日本 語の" * 40, "<|endoftext|> </s> <0x41>", "\x00\x01", "a" * 3000, " " * 5000 + "x", "\n" * 3000, "𓀀𓀁 ﬁ ０", "Don't 12345 stop", "same text", "same text"]
    return fixed + ["".join(rng.choice("ab é日\n0９ ﷺ'x") for _ in range(rng.randint(1, 80))) for _ in range(60)] + [" ".join(rng.choice(["the", "of", "naïve", "x1", "\n", "Straße"]) for _ in range(4000))]


def aligned_rows(ids, texts, tokenizers):
    all_groups = [groups_of(t, *tokenizers) for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in all_groups]
    count = Counter(p for x in links for p in set(x))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = []
    for i, g, x in zip(ids, all_groups, links, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        want.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), sha256(said.encode()).hexdigest() if g else ""))
    return all_groups, Counter(want)


def test_the_queries_themselves(spark, make, tokenizers, tmp_path):
    texts = odd_texts()[:40]
    ids = [None, *range(1, 39), 3]
    make(texts, ids).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, queries.op11_align(spark, str(tmp_path)).collect())) == aligned_rows(ids, texts, tokenizers)[1]
    rows = [(i, "s", "en", len(t or ""), t) for i, t in zip(ids, texts, strict=True)]
    assert Counter(map(tuple, queries.op13_merkle(spark, str(tmp_path)).collect())) == Counter(manifest_of(rows))
    x = np.random.default_rng(1).normal(size=(60, 6))
    x[30:34] = 2 * x[3]
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert Counter(map(tuple, queries.op12_embed_dedup(spark, str(tmp_path)).collect())) == Counter(linked(range(60), x))


@pytest.mark.parametrize(("head", "wide"), [(1 << 18, 4096), (12, 1)])
def test_alignment(spark, make, tokenizers, monkeypatch, head, wide):
    monkeypatch.setattr(align, "HEAD", head)
    monkeypatch.setattr(align, "WIDE", wide)
    texts = odd_texts()
    ids = [None if k == 20 else k for k in range(len(texts))]
    all_groups, want = aligned_rows(ids, texts, tokenizers)
    paths = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"), queries.tokenizer_path("byte_bpe_50k.tiktoken")
    import public_tokenizers

    got = align.scored(make(texts, ids), *paths, public_tokenizers.PATTERN).collect()
    assert Counter(map(tuple, got)) == want
    if wide == 1:  # by the file's own library, and the groups themselves
        plain = align.aligned(make(texts[:30], ids[:30]), *paths[:2]).collect()
        assert sorted((str(r["doc_id"]), r["groups"]) for r in plain) == sorted((str(i), ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)) for i, g in zip(ids[:30], all_groups, strict=False))
        assert align.scored(make([]), *paths).count() == 0


def test_packed_sets():
    rng = np.random.default_rng(2)
    for size in (1, 63, 64, 65, 1000):
        places = np.flatnonzero(rng.random(size) < 0.4)
        words = align.bits(places, size)
        assert align.members(words).tolist() == places.tolist()
        assert align.rank(words, np.arange(size)).tolist() == [int((places <= k).sum()) for k in range(size)]


# -- near duplicates of vectors

VECTORS = "vec_id long, embedding array<float>, vec binary, key string, label int"


def linked(ids, x, threshold=0.95):
    """(vec_id, links, component, kept) of usable vectors."""
    y = x / np.linalg.norm(x, axis=1)[:, None]
    near = y @ y.T >= threshold
    np.fill_diagonal(near, False)
    least = np.array(ids)
    while True:
        now = np.minimum(least, np.where(near, least[None], np.iinfo(np.int64).max).min(1))
        if (now == least).all():
            return [(i, int(n), int(c), i == c) for i, n, c in zip(ids, near.sum(1), least, strict=True)]
        least = now


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 12))
    for k in range(0, 300, 3):
        x[k + 1] = x[k] + 0.05 * rng.normal(size=12)
    x[400:460] = x[400] + 0.03 * rng.normal(size=(60, 12))  # one large cluster
    x[500:540], x[541] = x[500], 3 * x[500]
    x = x.astype(np.float32)
    ids = [*range(1500)]
    ids[700] = 3  # an id that stands twice
    bad = [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [None] * 12), (2004, [1.0, 2.0]), (2005, []), (2006, [float("inf")] + [1.0] * 11)]
    rows = [(i, v.tolist(), b"", "k", 1) for i, v in zip(ids, x, strict=True)] + [(i, v, b"", "k", 1) for i, v in bad]
    df = spark.createDataFrame([*rows, (None, x[0].tolist(), b"", "k", 1)], VECTORS).repartition(4)
    want = Counter([*linked(ids, x.astype(float)), *((i, 0, i, True) for i, _ in bad), (None, 0, None, True)])
    for rows_a_group in (8192, 25):
        monkeypatch.setattr(embed_dedup, "GROUP_ROWS", rows_a_group)
        assert Counter(map(tuple, embed_dedup.near_duplicates(df, centroids=16).collect())) == want
    none = spark.createDataFrame([], VECTORS)
    assert embed_dedup.near_duplicates(none).count() == 0
    assert embed_dedup.near_duplicates(df.where("vec_id >= 2000")).count() == 7
    assert embed_dedup.near_duplicates(df.where("vec_id in (2004)")).collect()[0]["n_links"] == 0


def test_recall_at_the_threshold_without_clusters():
    """Vectors without any clusters, and pairs just above the threshold: nearly all are in cells that the traversal passes."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    way = rng.normal(size=x.shape)
    way -= (way * x).sum(1)[:, None] * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * way / np.linalg.norm(way, axis=1)[:, None]
    grid = embed_dedup.Grid(x, 256, 0.95, 0.999)
    a, b = grid.cells(y)
    d1, d2 = grid.distances(x)
    met = cells = 0
    for k in range(2000):
        p, q = grid.passed(d1[k], d2[k])
        met += bool(((p == a[k]) & (q == b[k])).any())
        cells += len(p)
    assert met >= 0.99 * 2000 and cells < 0.02 * 2000 * 256**2


def test_passed_cells_are_those_of_the_heap():
    rng = np.random.default_rng(6)
    grid = embed_dedup.Grid(rng.normal(size=(400, 6)), 8, 0.9, 0.9)
    for _ in range(30):
        d1, d2 = rng.normal(size=8), rng.normal(size=8)
        grid.slack = float(rng.random() * 3)
        p, q = grid.passed(d1, d2)
        assert sorted(zip(p.tolist(), q.tolist(), strict=True)) == [(i, j) for i in range(8) for j in range(8) if d1[i] + d2[j] <= d1.min() + d2.min() + grid.slack]


# -- Merkle manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def sides(tree, k):
    out = []
    for nodes in tree[:-1]:
        run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
        out.append((run[: k % 16], run[k % 16 + 1 :]))
        k //= 16
    return out


def manifest_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for j, s in enumerate(names):
        for k, (*_, own, r) in enumerate(by[s]):
            way = sides(trees[s], k) + sides(top, j)
            x = own
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0:
                x = leaf(*r[:4], None if r[4] is None else r[4].translate(lower))
            for a, b in way:
                x = h(*a, x, *b)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h(*(d for a, b in way for d in a + b)), x, x == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, idx int, n int, way string"


@pytest.mark.parametrize("kind", ["many", "one", "single", "powers"])
def test_manifest(spark, kind):
    rng = random.Random(9)
    if kind == "single":
        rows = [(5, "s", None, 3, "Abc")]
    elif kind == "one":
        rows = [(k, "only", "en", k, f"T{k}") for k in range(273)]
    elif kind == "powers":
        rows = [(k, s, "en", k, f"Text {k}") for s, n in (("a", 16), ("b", 256), ("c", 17), ("d", 1), ("e", 257), ("f", 2)) for k in range(n)]
    else:
        rows = [(rng.randint(0, 5000), rng.choice(["hot"] * 40 + ["é", "z", None, "", "Z", *(f"s{k}" for k in range(30))]), rng.choice(["en", None]), rng.choice([None, 1, -7]), rng.choice([None, "", "ABC é", "low", "long " * 3000])) for _ in range(1200)]
        rows += [rows[0]] * 40 + [(None, "hot", "en", 1, "Nobody's"), (None, "hot", "en", 2, "x")]
    df = spark.createDataFrame([(*r, 1, 2, "w") for r in rows], DOCS).repartition(5)
    assert Counter(map(tuple, merkle.verified(df).collect())) == Counter(manifest_of(rows))


def test_an_empty_manifest(spark):
    assert merkle.verified(spark.createDataFrame([], DOCS)).count() == 0


def test_partitions_follow_the_input(spark):
    made = spark.createDataFrame([(1, "x")] * 20, "a int, b string")
    assert shared.parts_for(made) <= 8 and shared.parts_for(made.join(made.withColumnRenamed("b", "c"), "a")) <= 8
