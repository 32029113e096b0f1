"""SimHash near-duplicates by an inverted index over the bytes of the fingerprints.

A fingerprint has eight bytes at fixed positions. Two that differ in at most three bits share
at least five of the eight positional bytes, so the index need not list single bytes, whose
lists grow with the square of the corpus: it lists 14 groups of four positions each, chosen
so that any five positions hold exactly one whole group. Pairs that meet in a list have their
shared positional bytes counted, pairs with fewer than five go, the rest are verified bit by
bit.

Equal fingerprints are one class before anything is paired. A list longer than ``LIST``
distinct fingerprints (a very large group of near copies) isn't paired at all: its members
are linked through common neighbours, one flip from the one and at most two from the other,
which finds the same components with work in proportion to the members.

Defined results: a null, empty or blank text has fingerprint zero, which links like any
other; a null id belongs to its class but never names a component unless the class has no
other; rows that repeat have rows of their own; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import LOWER, written
from .components import components

BITS = 64
MOST_BITS = 3
SHINGLE = 3
LEAST_BYTES = 8 - MOST_BITS
LIST = 256
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    shingle = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, ones, digest = len(words) - shingle + 1, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(at + BLOCK, n)].tolist(), ends[at + shingle - 1 : min(at + BLOCK, n) + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed 64-bit integer) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return texts.mapInArrow(hashed, "doc_id bigint, text_hash bigint, fp bigint")


def position_groups(size: int = 4, whole: int = LEAST_BYTES) -> list[tuple[int, ...]]:
    """Groups of byte positions of which any ``whole`` positions hold one; greedy cover."""
    need, picked = set(combinations(range(8), whole)), []
    while need:
        best = max(combinations(range(8), size), key=lambda g: (sum(set(g) <= set(w) for w in need), g))
        picked.append(best)
        need = {w for w in need if not set(best) <= set(w)}
    return picked


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(classes: DataFrame) -> DataFrame:
    """One row per fingerprint and position group: list (the group), key (its bytes), fp."""
    masks = [_signed(sum(0xFF << (8 * p) for p in g)) for g in position_groups()]
    lists = F.array(*[F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return classes.select("fp", F.explode(lists).alias("at")).select("at.list", "at.key", "fp")


def _shared_bytes(differ: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    equal = [F.when(F.shiftrightunsigned(differ, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(8)]
    return sum(equal[1:], equal[0])


def paired(lists: DataFrame) -> DataFrame:
    """Verified links among the members of short lists: a, b (fingerprints)."""
    left = lists.select("list", "key", F.col("fp").alias("a"))
    right = lists.select("list", "key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    met = left.join(right.hint("merge"), ["list", "key"]).where("a < b")
    tallied = met.where(_shared_bytes(differ) >= LEAST_BYTES)
    return tallied.where(F.bit_count(differ) <= MOST_BITS).select("a", "b").distinct()


def _flips(most: int) -> Column:
    masks = [_signed(sum(1 << b for b in bits)) for k in range(most + 1) for bits in combinations(range(BITS), k)]
    return F.array(*[F.lit(m) for m in masks])


def through_neighbours(members: DataFrame) -> DataFrame:
    """Links among ``members`` (fp) that join exactly those within three bits of one another,
    directly or through others: a, b. Each row makes as many rows, however many are alike."""
    near = members.select("fp", F.explode(F.transform(_flips(1), lambda m: F.col("fp").bitwiseXOR(m))).alias("between"))
    far = members.select("fp", F.explode(F.transform(_flips(2), lambda m: F.col("fp").bitwiseXOR(m))).alias("between"))
    hubs = written(near.groupBy("between").agg(F.min("fp").alias("a")), "between")
    return far.join(hubs.hint("merge"), "between").select("a", F.col("fp").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, longest_list: int = LIST) -> DataFrame:
    """doc_id, text_hash, fp, component (its least fingerprint), component_id: the least id that
    links of at most three bits reach."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    listed = postings(classes)
    sizes = written(listed.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "list-sizes")
    shared = written(listed.join(sizes.hint("merge"), ["list", "key"]), "shared-lists")
    links = paired(shared.where(F.col("n") <= longest_list))
    long = shared.where(F.col("n") > longest_list).select("fp").distinct()
    if not long.isEmpty():
        links = links.unionByName(through_neighbours(long))
    roots = components(links)
    rooted = written(
        classes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("component")),
        "rooted-classes",
    )
    least = written(rooted.groupBy("component").agg(F.min("rep").alias("component_id")), "component-ids")
    named = written(rooted.join(least.hint("merge"), "component").select("fp", "component", "component_id"), "named-classes")
    return prints.join(named.hint("merge"), "fp")


#: Filters a corpus: of texts that are alike in shingles of five words, one stays.
drop_near_copies = near_copies.drop_near_copies
