"""Sweeps against pairs of intervals."""

import random
import time

import pytest
from pyspark.sql import functions as F

from shroud.operators import intervals, marks


@pytest.mark.parametrize("bin_", [4, 1 << 16])
def test_overlaps_are_those_of_all_pairs(spark, bin_):
    rng = random.Random(bin_)
    some = lambda n: [(rng.choice([1, 2, None]), s, s + rng.randint(0, 9), k) for k in range(n) for s in [rng.randint(0, 60)]]
    own, other = some(300) + [(1, None, 4, -1), (2, 3, None, -2), (9, 1, 2, -3)], [*some(25), (1, None, 9, 0), (1, 9, None, 0)]
    o, t = (spark.createDataFrame(x, "doc_id long, start int, end int, k int").repartition(3) for x in (own, other))
    hit = lambda a: any(a[0] == b[0] and None not in (*a[1:3], *b[1:3]) and a[1] < b[2] and b[1] < a[2] for b in other)
    got = intervals.marked(o, t, ["doc_id"], bin_=bin_)
    assert got.columns == ["doc_id", "start", "end", "k", "touched"]
    assert sorted((r["k"], str(r["doc_id"]), r["touched"]) for r in got.collect()) == sorted((a[3], str(a[0]), hit(a)) for a in own)
    assert intervals.touching(o, t, ["doc_id"]).count() + intervals.untouched(o, t, ["doc_id"]).count() == len(own)
    assert intervals.touching(o, t.where("false"), ["doc_id"]).count() == 0 and intervals.marked(o.where("false"), t, ["doc_id"]).count() == 0


def test_one_document_of_very_many_spans(spark):
    own = spark.range(200_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 40).alias("start"), (F.col("id") * 40 + 10).alias("end"))
    other = spark.range(200_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 80 + 9).alias("start"), (F.col("id") * 80 + 30).alias("end"))
    began = time.time()
    assert intervals.touching(own, other, ["doc_id"]).count() == 100_000
    assert time.time() - began < 60


def test_overlay_goes_by_the_sweep(spark):
    rng = random.Random(4)
    spans = [(d, s, s + rng.randint(1, 8), "Person") for d in (1, 2) for s in rng.sample(range(200), 40)]
    acts = [(d, k, rng.choice(["protect", "unprotect"]), s, s + rng.randint(1, 12), "Custom", None) for d in (1, 2) for k, s in enumerate(rng.sample(range(200), 25))] + [(1, 99, "undo", None, None, None, 3)]
    p = spark.createDataFrame(spans, "doc_id long, start int, end int, kind string")
    a = spark.createDataFrame(acts, "doc_id long, act int, op string, start int, end int, kind string, of int")
    live = [x for x in acts if x[2] != "undo" and not (x[0] == 1 and x[1] == 3)]
    meet = lambda x, y: x[0] < y[1] and y[0] < x[1]
    want = [s for s in spans if not any(s[0] == x[0] and meet(s[1:3], x[3:5]) for x in live)]
    want += [(x[0], x[3], x[4], x[5]) for x in live if x[2] == "protect" and not any(x[0] == y[0] and y[1] > x[1] and meet(x[3:5], y[3:5]) for y in live)]
    assert sorted(map(tuple, marks.overlay(p, a).collect())) == sorted(want)
