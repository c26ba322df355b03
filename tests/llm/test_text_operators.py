import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from shroud.llm import bpe, lm, ngram_join, packing, pii, quality, suffix_dedup, toxicity

from .conftest import SCHEMA, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- suffix-array dedup


def removed(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                covered[k : k + length] = True
        gone = covered[:-1] if len(d) else covered[:0]
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [50_000, 1])
def test_suffix_dedup_is_exact(make, corpus, hot):
    texts = [t for t in corpus if len(t or "") < 9000] * 1
    got = suffix_dedup.dedup(make(texts), hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_id(got) == sorted([(k, *r) for k, r in enumerate(removed(texts))], key=str)


def test_suffix_dedup_keeps_columns_and_rows(make, corpus):
    texts = [t for t in corpus if len(t or "") < 9000]
    docs = make(texts + texts[:2], [*range(len(texts)), 0, 1])
    out = suffix_dedup.remove_repeats(docs)
    assert out.schema == docs.schema and out.count() == docs.count()


def test_a_whole_repeated_row(make):
    text = words(random.Random(1), 100)
    assert by_id(suffix_dedup.digest(make([text, text], [7, 7])).select("doc_id", "n_removed", "n_spans")) == [(7, len(text), 1)] * 2


def windows(text, count):
    """(start, end) in bytes of each string of so many words, marks at its ends left out."""
    cores = []
    for m in re.finditer(rb"[^\t-\r ]+", text):
        mark = lambda c: c < "\x80" and not c.isalnum() or "\x80" <= c < "\xc0" or "\u2000" <= c < "\u2080" or "\u3000" <= c < "\u3040"
        marks = "".join(filter(mark, m[0].decode()))
        left, right = len(m[0]) - len(m[0].decode().lstrip(marks).encode()), len(m[0].decode().rstrip(marks).encode())
        cores.append((m.start() + left, m.start() + right) if left < right else m.span())
    return [(cores[k][0], cores[k + count - 1][1]) for k in range(len(cores) - count + 1)]


def test_repeated_strings_of_words_are_exact(make):
    rng = random.Random(8)
    short, other = " ".join(rng.choice("abcdefg") for _ in range(51)), words(rng, 58)
    texts = [f"{words(rng, 30)} ({short}), {words(rng, 20)}", f"{short}. {words(rng, 9)}", f"{words(rng, 70)} “{other}” {words(rng, 4)}", f"{words(rng, 7)}\n{other}\n{short}", words(rng, 90)]
    texts += [f"{words(rng, 20)} {' '.join(other.split()[3:53])} {words(rng, 20)}", "x " * 60, " ".join(["-"] * 70), None, "", words(rng, 600), "q r s"]
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[a:z] for d in data for a, z in windows(d, 51))
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(make(texts), words=51).collect()}
    for k, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for a, z in windows(d, 51):
            gone[a:z] |= seen[d[a:z]] > 1
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        assert (got[k]["n_passage_bytes"], d if got[k]["kept"] is None else bytes(got[k]["kept"])) == (gone.sum(), kept), k
    assert [got[k]["n_passage_bytes"] for k in (0, 1)] == [101] * 2 and got[3]["n_passage_bytes"] >= 101 + len(other) and not got[5]["n_passage_bytes"]
    assert [(got[k]["n_removed"], got[k]["kept_sha256"]) for k in range(len(texts))] == [(gone, sha) for _, gone, _, sha in removed(texts)]


def test_copies_of_over_fifty_words(make):
    text = words(random.Random(3), 51)
    got = suffix_dedup.digest(make([text, text, "a b"]), words=51).orderBy("n_bytes").collect()
    assert len(text) < 400 and [r["n_passage_bytes"] for r in got] == [0, len(text), len(text)]
    assert {r["n_removed"] for r in got} == {0} and [r["kept_sha256"] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in ("a b", text, text)]
    assert {r["n_removed"] for r in suffix_dedup.dedup(make([text, text, "a b"])).collect()} == {0}


def test_cover_gives_all_differences():
    d = suffix_dedup.difference_cover()
    assert {(a - b) % 32 for a in d for b in d} == set(range(32)) and max(b - a for a, b in pairwise([*d, 32])) <= 8


# -- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "-", "+", "4", "1", " ", "4111 1111 1111 1111", "255", "256", "é", "b.c", "(", "_", "x@y.z", "10.0.0.1", "49"]), max_size=24).map("".join))
def test_base_spans_are_the_patterns(text):
    assert [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE_KINDS] == base_spans(text)


def test_digest_and_redaction(make):
    texts = ["call +49 30 1234567 or a@b.de", None, "", "iban DE89 3704 0044 0532 0130 00 of bank", "é" * 5 + "1.2.3.4"]
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(make(texts))).collect()}
    for k, t in enumerate(texts):
        text = ",".join(f"{a}:{b}:{c}" for a, b, c in base_spans(t or ""))
        assert got[k]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert "iban:5:32" in got[3]["spans"] and got[0]["n_phone"] == 1 and got[4]["spans"] == "ip:5:12"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(make(texts)).collect()}
    assert clean[0] == "call [PHONE] or [EMAIL]" and clean[1] is None and clean[3].startswith("iban [IBAN] of")


def test_redaction_takes_every_base_span(make):
    texts = [f"{before} {value} {after}" for value in ("+1 (068) 555-2748", "10.1.2.3", "a.b@mail7.example.com", "4111 1111 1111 1111") for before in ("order", "invoice part", "version", "x@mail7.example.com") for after in ("sample", "isbn")]
    texts += ["order 219-09-9999 for the ssn example", "part 219-09-9999"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(make(texts)).collect()}
    for k, t in enumerate(texts[:-2]):
        assert base_spans(t) and base_spans(clean[k]) == [] and clean[k].count("[") == len(base_spans(t))
    assert clean[len(texts) - 2] == "order [SSN] for the ssn example" and clean[len(texts) - 1] == "part [SSN]"


def test_words_inside_other_spans_are_no_context():
    assert {s.kind: s.score for s in pii.find("+1 (068) 555-2748 the.65@mail7.example.com")} == {"email": 0.8, "phone": 0.6}


def test_ibans_before_and_after_other_groups():
    de, gb = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    for text in (f"IBAN {de} BIC COBADEFFXXX", f"{de} 2 times", f"{de} {gb}", f"AB12 CODE {de}", f"{gb} {de} {gb}", f"{de.replace(' ', '')} 2 times", f"{de} BIC and {gb} X"):
        found = [text[s.start : s.end] for s in pii.find(text) if s.kind == "iban"]
        assert found == [x.strip() for x in re.findall("DE89 ?3704 ?0044 ?0532 ?0130 ?00|" + gb, text)], text
    assert [s for s in pii.find("DE88 3704 0044 0532 0130 00 BIC") if s.kind == "iban"] == []


def test_long_digits_take_linear_time():
    assert pii.find("1" * 200_000 + "a" * 200_000 + "@") == []


# -- BPE


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["the", " ", "Σ", "İ", "\x1c", "\x85", "<|endoftext|>", "123", "don't", "!!", "é", "é", "😀", "aaaa", ":\U0003d000"]), max_size=12).map("".join))
def test_bpe_is_the_library(text):
    model, library = bpe.loaded(PATH), Tokenizer.from_file(PATH)
    ids, ends = model.encode([text])
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and ends.tolist() == [len(want)]
    assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_long_words_and_small_cache():
    model, library, rng = bpe.WordBpe(PATH), Tokenizer.from_file(PATH), random.Random(2)
    texts = ["".join(rng.choice("abcdeét") for _ in range(n)) for n in (255, 256, 257, 3000)] + [words(rng, 50) for _ in range(30)]
    for _ in range(3):
        for t in texts:
            assert model.encode([t], most=100)[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_bpe_digest(make, corpus):
    library = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in bpe.bpe_digest(make(corpus), PATH).collect()}
    full = {r["doc_id"]: r for r in bpe.bpe(make(corpus), PATH).collect()}
    for k, t in enumerate(corpus):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and full[k]["ids"] == ids
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# -- packing


def test_packing_is_a_partition_of_all_ids(make, corpus):
    library = Tokenizer.from_file(PATH)
    texts = [*corpus, corpus[0]]
    rows = packing.pack(make(texts, [*range(len(corpus)), 0]), PATH, size=256).collect()
    at = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    place = 0
    for r in at:
        assert r["sequence_id"] * 256 + r["offset"] == place and 0 < r["length"] <= 256 - r["offset"]
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        place += r["length"]
    own = defaultdict(list)
    for r in at:
        own[r["doc_id"]].append(r)
    for k, t in enumerate(corpus[1:], 1):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(r["ids"] for r in own[k]), "<u4").tolist() == want
        assert {r["doc_tokens"] for r in own[k]} == {len(want)} and [r["start"] for r in own[k]] == [sum(x["length"] for x in own[k][:n]) for n in range(len(own[k]))]
    assert sum(r["length"] for r in own[0]) == 2 * own[0][0]["doc_tokens"]


# -- n-gram join


def shingles(t):
    w = (t or "").lower().encode().split()
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(*(w[k:] for k in range(5)), strict=False))


def join_of(texts):
    sets = [shingles(t) for t in texts]
    root, links, texts_linked = list(range(len(texts))), [0] * len(texts), [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * len(sets[i] | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                if texts[i] != texts[j]:
                    texts_linked[i].add(texts[j])
                    texts_linked[j].add(texts[i])
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(k, root[k], links[k], len(texts_linked[k])) for k in range(len(texts))]


def test_join_is_brute_force(make, corpus):
    got = ngram_join.classes(make(corpus)).select("doc_id", "class_id", "n_links", "n_text_links")
    assert by_id(got) == sorted(join_of(corpus), key=str)


def test_join_over_several_blocks(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(9)
    base = words(rng, 80).split()
    texts = []
    for _ in range(70):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(80)] = "w%d" % rng.randrange(1000)
        texts.append(" ".join(t))
    got = ngram_join.classes(make(texts)).select("doc_id", "class_id", "n_links", "n_text_links")
    assert by_id(got) == sorted(join_of(texts), key=str)


def test_a_bucket_joins_what_may_reach_the_threshold():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 32, (5, ngram_join.HASHES), dtype=np.uint32)
    sig = base[rng.integers(0, 5, 60)].copy()
    for row in sig:
        row[rng.choice(ngram_join.HASHES, rng.integers(0, 60), replace=False)] = rng.integers(0, 1 << 32)
    agree = (sig[:, None] == sig[None]).sum(2)
    for least in (30, 57, 90):
        root = np.arange(60)
        for _ in range(60):
            root = np.array([root[agree[k] >= least].min() for k in range(60)])
        assert ngram_join.reached(sig, least).tolist() == root.tolist()


def test_a_chain_of_weak_likeness_never_meets(make):
    """A chain in which neighbours share two fifths of their shingles gives many buckets but no component."""
    rng = random.Random(2)
    line = words(rng, 3000).split()
    texts = [" ".join(line[k * 50 : k * 50 + 120]) for k in range(56)]
    signed = ngram_join.signatures(make(texts)).withColumnRenamed("row", "t")
    assert ngram_join._candidates(signed).count() == 0
    assert {(r["class_id"], r["n_links"]) for r in ngram_join.classes(make(texts)).collect()} == {(k, 0) for k in range(56)}


@pytest.mark.parametrize("members", [8, 4096])
def test_buckets_over_several_blocks(make, monkeypatch, members):
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    rng = random.Random(11)
    base = words(rng, 90).split()
    texts = [" ".join(w if rng.random() > 0.004 else f"v{k}" for w in base) for k in range(40)] + [words(rng, 60) for _ in range(5)]
    got = ngram_join.classes(make(texts)).select("doc_id", "class_id", "n_links", "n_text_links")
    assert by_id(got) == sorted(join_of(texts), key=str)


def test_one_of_each_class_stays(make, corpus):
    want = {k for k, root, *_ in join_of(corpus) if k == root or not shingles(corpus[k])}
    kept = ngram_join.keep_one(make(corpus))
    classes = {k: root for k, root, *_ in join_of(corpus)}
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(want) and {classes[k] for k in got} == {classes[k] for k in want} and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_bayesian_bound():
    least = ngram_join.least_agreeing(0.8, 1e-6, range(8, 97, 8))
    x = (np.arange(200_000) + 0.5) / 200_000
    for n, m in least.items():  # the posterior's own integral
        above = [float((f := x**k * (1 - x) ** (n - k))[x >= 0.8].sum() / f.sum()) for k in (m - 1, m) if k >= 0]
        assert above[-1] >= 1e-6 * 0.999 and (len(above) == 1 or above[0] < 1e-6)


# -- language model


def test_base_score_and_counts(make, corpus):
    from pyspark.sql import functions as F

    docs = make(corpus)
    held = F.col("doc_id") % 4 == 1
    rows = {r["doc_id"]: r for r in lm.score(docs, held).collect()}
    learnt = Counter(w for k, t in enumerate(corpus) if k % 4 != 1 for w in lm.tokens(t))
    n, v = sum(learnt.values()), len(learnt)
    for k, t in enumerate(corpus):
        w = lm.tokens(t)
        want = sum(np.log10((learnt[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert rows[k]["base_score"] == pytest.approx(want, rel=1e-9) and rows[k]["n_tokens"] == len(w)
        assert rows[k]["n_known"] == sum(learnt[x] > 0 for x in w) and rows[k]["train_tokens"] == n and rows[k]["score"] < 0


def test_rare_words_are_joined(make, corpus, monkeypatch):
    from pyspark.sql import functions as F

    full = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda counted: full(counted, head=20))
    rows = {r["doc_id"]: r for r in lm.score(make(corpus), F.col("doc_id") % 4 == 1).collect()}
    learnt = Counter(w for k, t in enumerate(corpus) if k % 4 != 1 for w in lm.tokens(t))
    n, v = sum(learnt.values()), len(learnt)
    for k, t in enumerate(corpus):
        assert rows[k]["base_score"] == pytest.approx(sum(np.log10((learnt[x] + 0.5) / (n + 0.5 * (v + 1))) for x in lm.tokens(t)), rel=1e-9)
        assert rows[k]["n_known"] == sum(learnt[x] > 0 for x in lm.tokens(t))


def test_probabilities_sum_to_one_and_learning_helps():
    rng = random.Random(3)
    follow = {w: rng.choices([f"w{k}" for k in range(300)], k=3) for w in (f"w{k}" for k in range(300))}

    def text():
        w, out = "w0", []
        for _ in range(80):
            out.append(w)
            w = rng.choice(follow[w])
        return " ".join(out)

    texts, more = [text() for _ in range(600)], [text() for _ in range(50)]
    n = Counter(w for t in texts for w in lm.tokens(t))
    ranked = sorted(n.items(), key=lambda x: (-x[1], x[0]))
    v = lm.Vocabulary([w for w, _ in ranked], np.array([c for _, c in ranked]), sum(n.values()), len(n), np.zeros(lm.SLOTS))
    table, grown = v.bias(), np.ones(lm.ROWS, np.float32)
    before = lm.log_probability(table, lm.batch(more, v)).sum()
    for _ in range(3):
        lm.learn(table, grown, lm.batch(texts, v), step=2048)
    after = lm.log_probability(table, lm.batch(more, v)).sum()
    assert after > before + 0.2 * len(more) * 81
    some = lm.batch([" ".join(["w5", "w7"])], v)
    total = 0.0
    for leaf in range(lm.CLASSES * lm.SLOTS):
        some.leaf[:] = leaf
        total += 10 ** lm.log_probability(table, some)[1]
    assert total == pytest.approx(1, abs=1e-4)


# -- classifiers


def test_toxicity_learns_pairs(make, spark):
    rng = random.Random(4)
    texts, label = [], []
    for _ in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(f"{words(rng, 25)} {'dullard' if insult else 'painter'} {words(rng, 10)} {'northerners' if group else 'gardens'} {words(rng, 5)}")
        label.append(int(insult and group))
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, toxic int")
    from pyspark.sql import functions as F

    docs = make([*texts, None, ""])
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(1600) if k % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == bool(label[k]) for k in held]) > 0.95 and 0 <= got[1600] <= 1 and got[1600] == got[1601]


def test_quality_grades_in_order(make, spark):
    rng = random.Random(6)
    texts, grade = [], []
    for k in range(900):
        g = k % 3
        w = words(rng, 60).split()
        texts.append(" ".join(x + "&&&" * (rng.random() < (0.9, 0.35, 0.0)[g]) for x in w))
        grade.append(g)
    labels = spark.createDataFrame(list(enumerate(grade)), "doc_id long, quality int")
    from pyspark.sql import functions as F

    docs = make([*texts, None, ""])
    model = quality.train(docs, labels, F.col("doc_id") % 5 != 0)
    assert len(model.thresholds) == 2 and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.grade(docs, model, 2.0).collect()}
    held = [k for k in range(900) if k % 5 == 0]
    assert np.mean([round(got[k]["expected_grade"]) == grade[k] for k in held]) > 0.9
    assert all(0 <= r["tail_probability"] <= 1 for r in got.values()) and len(got) == 902
    assert quality.keep_good(docs, model, 2.0).schema == docs.schema


def test_no_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    docs = make(["a b", None])
    assert toxicity.score(docs, toxicity.train(docs, none)).count() == 2
    assert quality.grade(docs, quality.train(docs, none)).count() == 2


# -- empty tables


@pytest.mark.parametrize(
    "run",
    [
        suffix_dedup.digest, lambda d: pii.digest(pii.find_pii(d)), pii.redact, ngram_join.classes, ngram_join.keep_one, suffix_dedup.remove_repeats, lambda d: bpe.bpe_digest(d, PATH),
        lambda d: packing.pack(d, PATH), lambda d: lm.score(d, d["doc_id"] % 5 == 1),
    ],
)
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_nulls(spark, make):
    docs = make([None, None, ""], [None, 1, None])
    for run in (suffix_dedup.digest, ngram_join.classes, ngram_join.keep_one, suffix_dedup.remove_repeats, lambda d: lm.score(d, d["doc_id"] == 1)):
        try:
            assert run(docs).count() == 3
        except AssertionError:
            raise AssertionError(run) from None


def test_changes_are_summed_by_a_tree(spark):
    rng = np.random.default_rng(2)
    own = rng.normal(size=(20, 2, 3, lm.CLASSES)).astype("<f2")
    own[3:, 1, 2] = 0
    rows = [(b, p, own[p, b].tobytes(), b"") for p in range(20) for b in range(2)]
    got = {r["block"]: r for r in lm._summed(spark.createDataFrame(rows, lm._CHANGE), 20, 2).collect()}
    for b in range(2):
        assert np.allclose(np.frombuffer(got[b]["change"], "<f4").reshape(3, -1), own[:, b].astype(np.float32).sum(0), atol=1e-3)
    assert np.frombuffer(got[0]["made"], "<i4").tolist() == [20] * 3 and np.frombuffer(got[1]["made"], "<i4").tolist() == [20, 20, 3]
    assert lm._summed(spark.createDataFrame([], lm._CHANGE), 0, 2).count() == 0
