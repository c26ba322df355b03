"""A Bloom filter over a key column: what surely isn't among the keys is dropped before a shuffle.

The filter is made of blocks. A key sets all of its bits in one of them, so keys go to their blocks by a shuffle and each
block is made in one place, whatever the number of tasks. It has BITS_A_KEY bits a key up to MOST_BITS (128 MB), the largest that is
sent to all tasks; beyond that it only lets more through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS_A_KEY, MOST_BITS, _BLOCK, _PROBES = 12, 1 << 30, 1 << 20, 4
#: Keys of a task among which repeated ones are sent once.
_GATHERED = 1 << 20


def hashed(keys: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(keys, categorize=False)


class Bloom:
    """_PROBES bits a key, all in one block; block and bits come from its hash."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    def blocks(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(40)) & np.uint64(max(self.bits // _BLOCK, 1) - 1)

    def places(self, h: np.ndarray, probe: int) -> np.ndarray:
        """Inside the key's block."""
        return (h + np.uint64(probe) * (h >> np.uint64(20) | np.uint64(1))) & np.uint64(min(self.bits, _BLOCK) - 1)

    def may_hold(self, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        return self.may_hold_hashed(hashed(np.array(keys, object)))

    def may_hold_hashed(self, h: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(h), bool), np.arange(len(h))
        for probe in range(_PROBES):  # most keys that aren't held are done after the first
            own = h[left]
            at = self.blocks(own) * np.uint64(_BLOCK) + self.places(own, probe)
            left = left[(self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        out[left] = True
        return out


def bloom(keys: DataFrame, col: str, n: int | None = None) -> Bloom:
    """Over the non-null strings of a column, or over hashes of them (longs, or arrays of longs). n: about how many differ; without it
    they are counted."""
    n = keys.agg(F.approx_count_distinct(col)).first()[0] if n is None else n
    bits = 1 << 13
    while bits < min(BITS_A_KEY * n, MOST_BITS):
        bits *= 2
    block = min(_BLOCK, bits)
    shape = Bloom(np.zeros(0, np.uint8), bits)

    def gathered(batches):
        held, n = [], 0
        for b in batches:
            c = b.column(0)
            c = c.flatten() if pa.types.is_list(c.type) else c
            held.append(np.unique(c.to_numpy().view(np.uint64) if pa.types.is_int64(c.type) else hashed(c.to_numpy(zero_copy_only=False))))
            n += len(held[-1])
            if n >= _GATHERED:
                yield np.unique(np.concatenate(held))
                held, n = [], 0
        if n:
            yield np.unique(np.concatenate(held))

    def run(batches):
        for h in gathered(batches):
            of = shape.blocks(h)
            order = np.argsort(of, kind="stable")
            used, first = np.unique(of[order], return_index=True)
            parts = np.split(h[order], first[1:])
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "keys"])

    def made(t: pa.Table) -> pa.Table:
        out = np.zeros(block // 8, np.uint8)
        for x in t["keys"]:
            h = np.frombuffer(x.as_py(), np.uint64)
            for probe in range(_PROBES):
                at = shape.places(h, probe)
                np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return pa.table({"block": t["block"][:1], "bits": pa.array([out.tobytes()], pa.binary())})

    words = np.zeros(bits // 8, np.uint8).reshape(-1, block // 8)
    by_block = keys.select(col).where(F.col(col).isNotNull()).mapInArrow(run, "block int, keys binary").groupBy("block")
    for r in by_block.applyInArrow(made, "block int, bits binary").collect():  # MOST_BITS in all
        words[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return Bloom(words.ravel(), bits)


def may_hold(filter_: Bloom, spark, col: Column) -> Column:
    """As a condition: false only for values that surely aren't keys."""
    shared = spark.sparkContext.broadcast(filter_)

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(shared.value.may_hold(values.fillna("").tolist()))

    return test(col)
