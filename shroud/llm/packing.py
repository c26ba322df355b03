"""Packing by concatenate and cut: two-pass prefix sums give each document its place in one endless row of tokens,
fixed windows cut it, and a document that crosses a window's edge leaves a record on either side.

First pass: each partition encodes its documents and keeps running totals; the staged table holds ids and the start
inside the partition. Second pass: partition totals (one number a partition) become bases on the driver, and every
document is cut independently. Only the last sequence has padding. A null text counts as empty and still carries the
end id, so every document has at least one piece. Repeated rows are packed as often as they occur. Ids are those of the
public tokenizers library for the same file, from this package's cached encoder, which the tests hold against it.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import by_size, loaded
from .shared import arrow, staged

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _width(tokenizer: str, end_id: int) -> int:
    """Bytes that hold any id of the vocabulary."""
    return 2 if max(len(loaded(tokenizer).tokens) - 1, end_id) < 1 << 16 else 4


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian, 2 or 4 bytes by the vocabulary), n, part, and the tokens before it in its partition."""
    width = _width(tokenizer, end_id)

    def run(batches):
        model, part, before = loaded(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            names, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in by_size(texts):
                ids, ends = model.encode(texts[lo:hi])
                raw = np.insert(ids, ends, end_id).astype(f"<u{width}").tobytes()
                ends = ends + np.arange(1, hi - lo + 1)
                n = np.diff(np.r_[0, ends])
                data = [raw[width * (y - x) : width * y] for x, y in zip(n.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names[lo:hi], pa.array(data, pa.binary()), pa.array(n), pa.array(np.full(hi - lo, part, np.int32)), pa.array(before + ends - n)], names=["doc_id", "ids", "n", "part", "local_start"])
                before += int(ends[-1])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(arrow, run, "doc_id long, ids binary, n long, part int, local_start long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece; sequence_id and offset are gapless from 0. The ids themselves stand in column `ids`, if asked for."""
    width = _width(tokenizer, end_id)
    encoded = staged(encode(docs, tokenizer, end_id, id_col, text_col), "packing-ids")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row a partition
    bases = dict(zip([r["part"] for r in totals], accumulate((r["n"] for r in totals), initial=0), strict=False))

    def run(batches):
        for b in batches:
            out = []
            for name, raw, n, part, local in zip(*(c.to_pylist() for c in b.columns), strict=True):
                base, start = bases[part] + local, 0
                while start < n:
                    where = base + start
                    length = min(size - where % size, n - start)
                    piece = np.frombuffer(raw, f"<u{width}", length, width * start).astype("<u4").tobytes()
                    out.append((name, start, length, zlib.crc32(piece), n, where // size, where % size, *[piece] * with_ids))
                    start += length
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

    return encoded.select("doc_id", "ids", "n", "part", "local_start").transform(arrow, run, PIECES + ", ids binary" * with_ids)
