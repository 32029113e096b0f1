"""Near copies by SimHash for the pipeline: byte-position index, count filter, verification.

Two texts are near copies where the sets of their five-word shingles have a Jaccard similarity
of 0.8 or more. Fingerprints of such a pair differ in 15 % of their bits, so the radius of three
of 64 bits of ``simhash`` finds few of them. Here the fingerprint has ``BITS`` bits, which are
``POSITIONS`` positional bytes:

1. Each text has its fingerprint and its steadiest positions: a bit whose shingles are far from
   a tie is hardly ever another one in a near copy, so of each part of the positions the
   ``LISTED`` bytes with the best chance to be kept are indexed. Equal shingle sets are one class.
2. The index lists groups of positions with their bytes, as in ``simhash``: single bytes have
   lists that grow with the square of the corpus. Its coarse lists (three of the ``COARSE`` steadiest
   bytes of a part) join large groups of near copies with work in proportion to their size:
   each class is first a candidate with the least member of its lists alone, then with the least
   members of its other lists, as far as it isn't joined with them. Those whose fingerprints are
   akin belong to one region with it. The links of a region are found from the members' differences
   (``variants``), not from pairs, since very many texts may be almost near copies of one another.
   The fine lists (two of the ``LISTED`` bytes of a part) then hold all pairs that are in
   different regions; only pairs of like size whose first fingerprint words are near leave that join.
3. The count filter: pairs that share too few of the positional bytes or differ in too many bits
   go; the rest is verified by the shingle sets themselves.
4. Components of the links that hold.

A pair of similarity 0.8 shares a fine list with probability 0.999, a more similar one with more.

Defined results: a null, empty or blank text has no shingles, and all such are copies of one
another; a text of fewer words than a shingle has all its words as the only one; of each
component the row with the least id stays, a null id only where there is no other; of rows
that repeat id and text one stays; an empty table gives an empty result; other columns are never
read, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import erfc, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, whole_text, written
from .components import components
from .exact_dedup import without
from .quality import ODD, Block, _blocks, _mixed
from .variants import variant_pairs

SHINGLE = 5
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
BITS, WORD = 1024, 64
WORDS, POSITIONS = BITS // WORD, BITS // 8
#: Positions are dealt to so many parts, each of which has lists of its own.
PARTS = 8
#: Steadiest positions of a part in the fine and in the coarse lists.
LISTED, COARSE = 7, 5
#: Positions of a list: two of LISTED, three of COARSE.
FINE_GROUP, COARSE_GROUP = 2, 3
#: A pair of similarity 0.8 differs in 155 bits on average, with deviation 11.5, and shares 34 bytes, with deviation 5.
MOST_BITS, LEAST_BYTES = 203, 15
#: The same for texts of less than STEADY shingles: with four and five it differs in 192 bits and shares 24 bytes.
MOST_BITS_SHORT, LEAST_BYTES_SHORT = 260, 8
STEADY = 64
#: Bits in which the first words may differ; they differ in ten on average, in 12 for four and five shingles.
MOST_WORD_BITS = 22
#: Texts of one region differ in so many bits at most; a pair of similarity 0.5 differs in 274 on average, strangers in 512.
AKIN_BITS = 330
LAST = (1 << 63) - 1
#: Shingles whose bits are added up at once in bytes.
RUN = 255
#: Texts whose bits are weighed at once.
TEXTS = 512

_SALTS = _mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_COSINE = 2 * SIMILAR[0] / sum(SIMILAR)
#: By hundredths of a bit's distance from a tie, in deviations: the log of its chance to be the same in a pair of similarity 0.8.
_KEPT = np.array([log(1 - erfc(_COSINE / sqrt(1 - _COSINE**2) * k / 100 / sqrt(2)) / 2) for k in range(601)])


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): text k has the distinct shingle hashes hashes[starts[k] : starts[k + 1]], in order."""
    block = Block([t.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass") for t in texts])
    grams, text = block.word_grams(shingle)
    grams, text = grams[text >= 0], text[text >= 0]
    words = np.bincount(block.word_text, minlength=block.n)
    first = np.cumsum(words) - words
    short = np.flatnonzero((words > 0) & (words < shingle))
    if len(short):
        told = np.zeros(len(short), np.uint64)
        for k in range(shingle - 1):  # word k of each short text that has one
            has = words[short] > k
            told[has] = told[has] * ODD + block.words[first[short[has]] + k]
        grams, text = np.concatenate([grams, _mixed(told + words[short].astype(np.uint64))]), np.concatenate([text, short])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(block.n + 1))


def _fingerprints(grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, which has shingles: the positional bytes, the steadiest positions of each part in order."""
    n, size = len(starts) - 1, np.diff(starts)
    ones = np.zeros((n, BITS), np.int64)
    for k in range(n):
        for at in range(starts[k], starts[k + 1], RUN):
            told = _mixed(grams[at : min(at + RUN, starts[k + 1]), None] + _SALTS)
            ones[k] += np.unpackbits(told.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    away = 2 * ones - size[:, None]
    hundredths = np.minimum(np.abs(away) * (100 / np.sqrt(size))[:, None], len(_KEPT) - 1).astype(np.int64)
    chance = _KEPT[hundredths].reshape(n, POSITIONS // PARTS, PARTS, 8).sum(axis=3)
    steady = np.argsort(-chance, axis=1, kind="stable")[:, :LISTED].transpose(0, 2, 1) * PARTS + np.arange(PARTS)[:, None]
    return np.packbits((away > 0).astype(np.uint8), axis=1, bitorder="little"), steady.reshape(n, -1).astype(np.uint8)


def sketches(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """set_hash, size, fingerprint (longs), steadiest positions (bytes), a row per text; zeros without shingles."""
    grams, starts = shingle_sets(texts, shingle)
    size = np.diff(starts)
    some, n = np.flatnonzero(size), len(texts)
    set_hash, told, steady = np.zeros(n, np.uint64), np.zeros((n, POSITIONS), np.uint8), np.zeros((n, PARTS * LISTED), np.uint8)
    if len(some):
        at = starts[:-1][some]
        set_hash[some] = _mixed(np.add.reduceat(_mixed(grams + ODD), at) + size[some].astype(np.uint64))
        ends = np.append(at, len(grams))
        for k in range(0, len(some), TEXTS):
            part = some[k : k + TEXTS]
            told[part], steady[part] = _fingerprints(grams, ends[k : k + len(part) + 1])
    return set_hash, size, told.view("<i8"), steady


SKETCH = "doc_id bigint, text_hash bigint, set_hash bigint, size bigint, bits array<bigint>, steady binary"


def _rows(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _blocks(t.as_py() for t in batch.column("text")):
                set_hash, size, told, steady = sketches(texts, shingle)
                own = [batch.column(c).slice(at, len(texts)) for c in ("doc_id", "text_hash")]
                at += len(texts)
                arrays = [pa.array(set_hash.view(np.int64)), pa.array(size.astype(np.int64))]
                spans = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * WORDS)
                arrays += [pa.ListArray.from_arrays(spans, pa.array(told.ravel())), pa.array([row.tobytes() for row in steady], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *arrays], [c.split()[0] for c in SKETCH.split(", ")])

    return _rows(docs).mapInArrow(make, SKETCH)


def postings(sketch: DataFrame, most: int, group: int) -> DataFrame:
    """key, node, size, fp (the first word of the fingerprint) and root of each list of a class: all
    groups of so many positions among the ``most`` steadiest of a part, with their bytes."""
    places = np.array(list(combinations(range(most), group)))
    schema = "key bigint, node bigint, size bigint, fp bigint, root bigint"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), TEXTS):
                batch = whole.slice(at, TEXTS)
                n = len(batch)
                words = batch.column("bits").flatten().to_numpy().reshape(n, WORDS)
                steady = np.frombuffer(b"".join(batch.column("steady").to_pylist()), np.uint8).reshape(n, PARTS, LISTED)
                chosen = np.sort(steady[:, :, :most], axis=2).astype(np.int64)
                held = np.take_along_axis(words.view(np.uint8).reshape(n, 1, POSITIONS), chosen, axis=2)
                byte, key = chosen << 8 | held, np.zeros((n, PARTS, len(places)), np.int64)
                for k in range(group):
                    key = key << 15 | byte[:, :, places[:, k]]
                row = pa.array(np.repeat(np.arange(n), PARTS * len(places)))
                own = [batch.column("node"), batch.column("size"), pa.array(words[:, 0]), batch.column("root")]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *[c.take(row) for c in own]], [c.split()[0] for c in schema.split(", ")])

    return sketch.where("size > 0").select("node", "size", "bits", "steady", "root").mapInArrow(make, schema)


def _like_size(a: str, b: str) -> Column:
    many, of = SIMILAR
    return (of * F.col(f"{a}.size") >= many * F.col(f"{b}.size")) & (of * F.col(f"{b}.size") >= many * F.col(f"{a}.size"))


def _other_bytes(differ: Column) -> Column:
    """In how many of its eight bytes a word isn't zero."""
    for k in (4, 2, 1):
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, k))
    return F.bit_count(differ.bitwiseAND(F.lit(0x0101010101010101)))


def _differ(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k]) for k in range(WORDS)]


def _akin(a: str, b: str) -> Column:
    """Whether two texts may belong to one region."""
    bits = [F.bit_count(d) for d in _differ(a, b)]
    return sum(bits[1:], bits[0]) <= AKIN_BITS


def _alike(a: str, b: str) -> Column:
    """The count filter: the positional bytes and the bits that the fingerprints of a pair must share."""
    differ = _differ(a, b)
    bits, other = ([told(d) for d in differ] for told in (F.bit_count, _other_bytes))
    steady = F.least(F.col(f"{a}.size"), F.col(f"{b}.size")) >= STEADY
    few = sum(bits[1:], bits[0]) <= F.when(steady, MOST_BITS).otherwise(MOST_BITS_SHORT)
    many = POSITIONS - sum(other[1:], other[0]) >= F.when(steady, LEAST_BYTES).otherwise(LEAST_BYTES_SHORT)
    return _like_size(a, b) & many & few


def _similar(a: str, b: str) -> Column:
    """Whether two shingle sets are as similar as ``SIMILAR``."""
    many, of = SIMILAR
    both = F.size(F.array_intersect(a, b))
    return of * both >= many * (F.size(a) + F.size(b) - both)


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, hashes: the shingle sets of the classes in ``nodes``."""
    chosen = written(classes.join(nodes, F.col("set_hash") == F.col("node")).select("node", "rep_id", "rep_hash"), "chosen")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _blocks(t.as_py() for t in batch.column("text")):
                grams, starts = shingle_sets(texts, shingle)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(texts)), lists], ["node", "hashes"])
                at += len(texts)

    own = _rows(docs).join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))).select("node", "text")
    sets = written(own.mapInArrow(make, "node bigint, hashes array<bigint>"), "shingle-sets")
    return written(sets.dropDuplicates(["node"]), "distinct-sets")  # rows may repeat id and text


def _holding(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar."""
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_hashes")) for c in ("a", "b"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return written(met.where(_similar("a_hashes", "b_hashes")).select("a", "b"), "near-links")


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    return _holding(pairs, _sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle))


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, component (the least class of it) of every row."""
    prints = written(sketched(docs, shingle), "sketches")
    first = F.coalesce("doc_id", F.lit(LAST))
    classes = prints.groupBy("set_hash").agg(
        F.min("doc_id").alias("rep_id"),
        F.min_by("text_hash", first).alias("rep_hash"),
        *[F.first(c).alias(c) for c in ("size", "bits", "steady")],
    )
    classes = written(classes, "shingle-classes")
    sketch = classes.select(F.col("set_hash").alias("node"), "size", "bits", "steady")
    listed = postings(sketch.withColumn("root", F.lit(None).cast("bigint")), COARSE, COARSE_GROUP).select("key", "node")
    hubs = written(listed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    shared = written(listed.join(hubs.hint("merge"), "key").select("key", "node", "hub"), "shared-keys")
    comp = F.coalesce("root", "node")

    def joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
        """What the links join beyond what is joined already."""
        return components(links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    def linked(pairs: DataFrame, roots: DataFrame | None, akin: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """The same for those of ``pairs`` that hold; and the pairs that are ``akin`` or pass the count filter."""
        met = pairs.join(sketch.alias("x").hint("merge"), F.col("a") == F.col("x.node")).join(sketch.alias("y").hint("merge"), F.col("b") == F.col("y.node"))
        alike = _alike("x", "y")
        near = written(met.where(alike if akin is None else alike | akin).select("a", "b", alike.alias("alike")), "candidates")
        return joined(_links(docs, classes, near.where("alike").select("a", "b"), shingle), roots), near.select("a", "b")

    def members(roots: DataFrame) -> DataFrame:
        return shared.join(roots.hint("merge"), "node", "left").select("key", "node", "hub", comp.alias("comp"))

    # each text with the least of its lists' least members
    tried = written(shared.where("hub < node").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")), "least-hubs")
    akin = _akin("x", "y")
    roots, near = linked(tried, None, akin)
    # the least members of its other lists, where they are not joined yet
    hub_roots = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    open_ = members(roots).where("hub <> node").join(hub_roots.hint("merge"), "hub", "left").where(F.coalesce("hub_root", "hub") != F.col("comp"))
    pairs = open_.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")
    pairs = written(pairs, "other-hubs")
    if not pairs.isEmpty():
        roots, more = linked(pairs, roots, akin)
        near = near.unionByName(more)
    # what these have joined or found akin: all links of a region
    regions = joined(near, roots).select("node", F.col("root").alias("region"))
    regions = regions.unionByName(regions.select(F.col("region").alias("node"), "region").distinct())
    regions = written(regions, "regions")
    sets = _sets(docs, classes, regions.select("node"), shingle)
    held = sets.join(regions.hint("merge"), "node").join(roots.hint("merge"), "node", "left").select("region", "node", comp.alias("root"), "hashes")
    links, pairs = variant_pairs(written(held, "members"), SIMILAR)
    roots = joined(links.unionByName(_holding(pairs, sets)), roots)
    # what shares a fine list and is in different regions
    placed = postings(sketch.join(regions.withColumnRenamed("region", "root").hint("merge"), "node", "left"), LISTED, FINE_GROUP)
    apart = F.coalesce("x.root", "x.node") < F.coalesce("y.root", "y.node")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MOST_WORD_BITS
    told = (F.col("x.key") == F.col("y.key")) & apart & _like_size("x", "y") & near
    met = placed.alias("x").join(placed.alias("y").hint("merge"), told).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = written(met.distinct(), "fine-pairs")
    if not pairs.isEmpty():
        roots, _ = linked(pairs, roots)
    rooted = classes.select(F.col("set_hash").alias("node")).join(roots.hint("merge"), "node", "left").select("node", comp.alias("component"))
    rooted = written(rooted, "rooted")
    return prints.select("doc_id", "text_hash", F.col("set_hash").alias("node")).join(rooted.hint("merge"), "node").select("doc_id", "text_hash", "component")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` of which one of each component stays."""
    found = written(near_copies(docs, shingle), "near-copies")
    order = F.coalesce("doc_id", F.lit(LAST))
    least = found.groupBy("component").agg(F.min("doc_id").alias("kept_id"), F.min_by("text_hash", order).alias("kept_hash"))
    least = written(least, "kept-of-components")
    judged = found.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).join(least.hint("merge"), "component")
    judged = judged.select("doc_id", "text_hash", "n", (F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))).alias("stays"))
    return without(docs, judged, F.xxhash64(whole_text("d.text")), "text_hash")
