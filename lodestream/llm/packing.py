"""Packing of tokenized documents into windows of fixed length, best fit decreasing.

Every document is tokenized and cut into full windows and a remainder. Pieces are dealt by
hash into groups of about ``GROUP`` and each group is packed by itself, longest piece first,
each into the tightest open window; a segment tree over remaining capacities finds it.
A group leaves about one window part-filled, so the padding doesn't depend on their number.

Defined results: a null or empty text has the end id only; rows that repeat are packed like
any other; a null id is kept; an empty table gives an empty result; other columns are never
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

WINDOW = 2048
GROUP = 4096
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: full windows first, then what is left of the document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        encode = encoder(vocabulary).encode
        types = [pa.int64()] * 5 + [pa.binary()] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, *[part] * with_ids))
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


class OpenWindows:
    """Open windows by remaining capacity; a segment tree counts them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, number: int) -> None:
        self.held[capacity].append(number)
        self._add(capacity, 1)

    def _add(self, capacity: int, n: int) -> None:
        node, count = self.leaves + capacity, self.count
        while node:
            count[node] += n
            node >>= 1

    def tightest(self, length: int) -> int:
        """The least capacity, ``length`` or more, that an open window has; -1 if none has."""
        node, count = self.leaves + length, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.held[capacity].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) for each length; lengths come longest first."""
    opened, n = OpenWindows(window), 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        capacity = opened.tightest(length) if length < window else -1
        if capacity < 0:
            number, capacity, n = n, window, n + 1
        else:
            number = opened.take(capacity)
        where[i], offset[i] = number, window - capacity
        if capacity > length:
            opened.put(capacity - length, number)
    return where, offset


def pack(cut: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (as from :func:`pieces`)."""
    cut = written(cut, "pieces")
    groups = max(1, round(cut.count() / group))
    # the row's place in the written table deals out rows that repeat
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        where, offset = best_fit(pdf["length"].to_numpy(), window)
        pdf["sequence_id"], pdf["offset"] = (pdf["pack_group"].to_numpy() << 32) + where, offset
        return pdf.drop(columns="pack_group")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("pack_group").applyInPandas(fit, schema)
