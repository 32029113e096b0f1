"""Removal of repeated byte strings across documents with sharded suffix arrays.

Every byte that a string of ``MATCH`` bytes covers which also starts earlier (in a document of
smaller id, or in the same one) goes. Windows of ``MATCH`` bytes are never compared one with
another across the corpus; they are dealt into shards by what they contain:

1. Each window's anchor is the least hash of its ``ANCHOR``-byte substrings. Equal windows have
   equal anchors, and neighbours mostly share one, so a document becomes runs of windows.
   Equal runs are combined in each task before anything is shuffled.
2. Runs meet by anchor, in sorted order, so that no task holds an anchor's runs. Of equal runs only the earliest can hold first occurrences; anchors
   with one distinct run need nothing more, unless the anchor occurs in it twice.
3. The bytes of the distinct runs that share an anchor go to the anchor's shard; each shard
   builds a suffix array by induced sorting and its common prefixes, and marks windows that
   an earlier place holds. The runs of an anchor that very many distinct ones share (a common
   line with all kinds of neighbours) are parted and dealt out by further hashes of their windows.
4. Marks are gathered per document and the covered bytes removed.

Defined results: a null text counts as empty; texts shorter than ``MATCH`` bytes stay whole;
rows that repeat an id come in order of a hash of their texts, and rows that repeat id and text
are one document given once for each row; a null id comes first; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .suffixes import later_copies
from .tokens import forget

MATCH = 100
ANCHOR = 32
BLOCK = 1 << 18
#: Windows in a run at most, so that runs of one character stay short strings.
LONGEST_RUN = 256
#: Distinct runs of an anchor from which they are dealt out in parts.
COMMON_ANCHOR = 512
#: Other hashes that part the runs of a common anchor.
FURTHER = 4
#: Parts of common anchors' runs that a task holds at once.
ALONE = 100_000
SHARD_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15
RUN, MARK, SHARED, COMMON, REPEATING = 0, 1, 2, 3, 4


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def rising(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return rising(BASE), rising(pow(BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverses): (sums[b] - sums[a]) * inverses[a] is a hash of data[a:b] alone."""
    powers, inverses = _powers(BLOCK + 2 * MATCH)
    if len(data) + 1 > len(powers):
        powers, inverses = _powers(1 << (len(data) + 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums, inverses


def _sliding(values: np.ndarray, span: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``span`` neighbouring values."""
    pick, fill = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    padded = np.full(-(-len(values) // span) * span, fill, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(-1, span)
    to_right = pick.accumulate(padded, axis=1).ravel()
    to_left = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - span + 1
    return pick(to_left[:n], to_right[span - 1 : span - 1 + n])


def _repeating(grams: np.ndarray, anchor: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs in which an anchor may occur twice: only these can hold two equal windows."""
    span = MATCH - ANCHOR + 1
    around = np.zeros(len(anchor) + 2 * (span - 1), np.uint64)
    around[span - 1 : span - 1 + len(anchor)] = anchor
    is_anchor = np.flatnonzero(_sliding(around, span, least=False) == grams)
    order = np.argsort(grams[is_anchor], kind="stable")
    at = is_anchor[order]
    near = (grams[at][1:] == grams[at][:-1]) & (at[1:] - at[:-1] < LONGEST_RUN)
    twice = np.sort(at[1:][near])
    return np.searchsorted(twice, place + size + span - 1) > np.searchsorted(twice, place)


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, windows, anchor, content, repeating) of the runs in texts data[starts:ends];
    content hashes the run's bytes."""
    windows = len(data) - MATCH + 1
    if windows < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
    sums, inverses = _prefix_hashes(data)
    grams = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * inverses[: len(data) - ANCHOR + 1])
    anchor = _sliding(grams, MATCH - ANCHOR + 1, least=True)
    long = ends - starts >= MATCH
    inside = np.zeros(windows + 1, np.int8)
    inside[starts[long]] += 1
    inside[ends[long] - MATCH + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    place = np.flatnonzero(new)
    size = np.diff(np.append(place, windows))
    keep = inside[place]
    place, size = place[keep], size[keep]
    if len(size) and size.max() > LONGEST_RUN:
        parts = -(-size // LONGEST_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        place, size = np.repeat(place, parts) + nth * LONGEST_RUN, np.repeat(size, parts) - nth * LONGEST_RUN
        size = np.minimum(size, LONGEST_RUN)
    content = _mixed((sums[place + size + MATCH - 1] - sums[place]) * inverses[place] + size.astype(np.uint64) * np.uint64(BASE))
    return place, size, anchor[place], content, _repeating(grams, anchor, place, size)


def _blocks(keys: list[int], texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in blocks of about BLOCK bytes; longer ones are cut so that each window is in one block."""
    block: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    filled = 0
    for key, text in zip(keys, texts, strict=True):
        for at in range(0, max(1, len(text) - MATCH + 1), BLOCK):
            part = text[at : at + BLOCK + MATCH - 1]
            if filled and filled + len(part) > BLOCK + MATCH:
                yield block
                block, filled = ([], [], []), 0
            for column, value in zip(block, (key, at, part), strict=True):
                column.append(value)
            filled += len(part)
    if filled:
        yield block


def _runs_of(keys: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, start, windows, anchor, content, repeating) of all runs of the texts."""
    for own, offsets, parts in _blocks(keys, texts):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        place, size, anchor, content, repeating = _runs(np.frombuffer(b"".join(parts), np.uint8), ends - sizes, ends)
        nth = np.searchsorted(ends, place, side="right")
        start = place - (ends - sizes)[nth] + np.array(offsets, np.int64)[nth]
        yield np.array(own, np.int64)[nth], start, size, anchor, content, repeating


def _firsts(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows in order of all columns, the last one least; new where the columns but
    the last two (key, start) change."""
    order = np.lexsort(by[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for column in by[:-2]:
            same &= column[order][1:] == column[order][:-1]
        new[1:] = ~same
    return order, new


def _merged(key: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching runs of windows of a document as one."""
    if not len(key):
        return key, start, size
    order = np.lexsort((start, key))
    key, start, size = key[order], start[order], size[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + size[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], start[last] + size[last] - start[first]


ROWS = "kind tinyint, anchor bigint, content bigint, doc bigint, start bigint, windows bigint"


def _rows(kind: int | np.ndarray, anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind).astype(np.int8)), *(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in (anchor, content, doc, start, windows))],
        ["kind", "anchor", "content", "doc", "start", "windows"],
    )


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    found: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        found += _runs_of(_column(batch, "doc").tolist(), batch.column("bytes").to_pylist())
    if not found:
        return
    doc, start, size, anchor, content, repeating = map(np.concatenate, zip(*found, strict=True))
    found.clear()
    order, new = _firsts(anchor, content, doc, start)
    first, later = order[new], order[~new]
    for some in np.array_split(first, -(-len(first) // 100_000)) if len(first) else []:
        yield _rows(np.where(repeating[some], REPEATING, RUN), anchor[some], content[some], doc[some], start[some], size[some])
    if len(later):
        own, begins, windows = _merged(doc[later], start[later], size[later])
        # marks only pass the next shuffle, so they may go anywhere
        yield _rows(MARK, _mixed(own.astype(np.uint64)), np.zeros(len(own), np.int64), own, begins, windows)


RUN_COLUMNS = ("kind", "anchor", "content", "doc", "start", "windows")


def _kinds(kinds: np.ndarray, distinct: np.ndarray, common: int) -> np.ndarray:
    """What becomes of distinct runs whose anchor has ``distinct`` of them; RUN where nothing more is needed."""
    needed = (distinct > 1) | (kinds == REPEATING)
    return np.where(distinct > common, COMMON, np.where(needed, SHARED, RUN))


def _meet(batches: Iterator[pa.RecordBatch], common: int) -> Iterator[pa.RecordBatch]:
    """Runs in order of anchor, content, doc and start; no more than ``common`` of one anchor are held at once."""
    pending = tuple(np.empty(0, np.int64) for _ in RUN_COLUMNS)  # the distinct runs so far of the last anchor
    hot: tuple[int, int] | None = None  # anchor and last content of one that has more than ``common``

    def marked(rows: tuple[np.ndarray, ...], later: np.ndarray) -> Iterator[pa.RecordBatch]:
        if later.any():
            own, begins, windows = _merged(*(c[later] for c in rows[3:]))
            yield _rows(MARK, np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), own, begins, windows)

    def given(rows: tuple[np.ndarray, ...], kinds: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = kinds != RUN
        if some.any():
            yield _rows(kinds[some], *(c[some] for c in rows[1:]))

    for batch in batches:
        is_mark = pa.compute.equal(batch.column("kind"), MARK)
        marks = batch.filter(is_mark)
        if marks.num_rows:
            yield marks
        rows = tuple(_column(batch.filter(pa.compute.invert(is_mark)), c) for c in RUN_COLUMNS)
        if hot is not None:
            n = int(np.searchsorted(rows[1], hot[0], side="right"))
            if n:
                more = tuple(c[:n] for c in rows)
                new = np.concatenate([[more[2][0] != hot[1]], more[2][1:] != more[2][:-1]])
                yield from marked(more, ~new)
                yield from given(more, np.where(new, COMMON, RUN))
                hot = (hot[0], int(more[2][-1]))
            if n == len(rows[1]):
                continue
            hot, rows = None, tuple(c[n:] for c in rows)
        rows = tuple(np.concatenate([p, c]) for p, c in zip(pending, rows, strict=True))
        if not len(rows[1]):
            continue
        new = np.ones(len(rows[1]), bool)
        new[1:] = (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
        yield from marked(rows, ~new)
        rows = tuple(c[new] for c in rows)
        group = np.flatnonzero(np.concatenate([[True], rows[1][1:] != rows[1][:-1]]))
        sizes = np.diff(np.append(group, len(rows[1])))
        last = int(group[-1])
        distinct = np.repeat(sizes, sizes)
        yield from given(tuple(c[:last] for c in rows), _kinds(rows[0][:last], distinct[:last], common))
        pending = tuple(c[last:] for c in rows)
        if sizes[-1] > common:
            yield from given(pending, np.full(sizes[-1], COMMON))
            hot = (int(pending[1][-1]), int(pending[2][-1]))
            pending = tuple(c[:0] for c in pending)
    if len(pending[1]):
        yield from given(pending, _kinds(pending[0], np.full(len(pending[1]), len(pending[1])), common))


PIECES = "anchor bigint, doc bigint, start bigint, windows bigint, piece binary"


def _pieces(anchor, doc, start, windows, piece) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(pa.array(np.asarray(c).astype(np.int64)) for c in (anchor, doc, start, windows)), pa.array(piece, pa.binary())],
        ["anchor", "doc", "start", "windows", "piece"],
    )


def _parted(piece: bytes, windows: int) -> Iterator[tuple[int, int, int]]:
    """(key, first window, windows) of the parts of a common anchor's run. A window's key is made of its
    anchors by ``FURTHER`` other hashes, of which mostly one at least lies in what is not common."""
    sums, inverses = _prefix_hashes(np.frombuffer(piece, np.uint8))
    grams = (sums[ANCHOR:] - sums[:-ANCHOR]) * inverses[: len(piece) - ANCHOR + 1]
    key = np.zeros(windows, np.uint64)
    for k in range(1, FURTHER + 1):
        key = _mixed(key + _sliding(_mixed(grams + np.uint64(k)), MATCH - ANCHOR + 1, least=True))
    place = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    yield from zip(key[place].view(np.int64).tolist(), place.tolist(), np.diff(np.append(place, windows)).tolist(), strict=True)


def _combined(alone: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Parts (key, doc, start, windows, bytes); of equal ones the first keeps its bytes, the others are marks."""
    alone.sort(key=lambda w: (w[0], w[4], w[1], w[2]))
    marks, kept, last = [], [], None
    for key, doc, start, n, part in alone:
        if last == (key, part):
            marks.append((key, doc, start, n, None))
        else:
            kept.append((key, doc, start, n, part))
            last = (key, part)
    alone.clear()
    for rows in (marks, kept):
        for at in range(0, len(rows), 50_000):
            yield _pieces(*zip(*rows[at : at + 50_000], strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the shared runs; runs of common anchors in parts, equal ones combined ``ALONE`` at a time."""
    alone: list[tuple[int, int, int, int, bytes]] = []
    for batch in batches:
        out: list[tuple[int, int, int, int, bytes]] = []
        for doc, text, runs in zip(_column(batch, "doc").tolist(), batch.column("bytes"), batch.column("runs").to_pylist(), strict=True):
            text = text.as_py()
            for run in runs:
                start, n = run["start"], run["windows"]
                piece = text[start : start + n + MATCH - 1]
                if run["kind"] == SHARED:
                    out.append((run["anchor"], doc, start, n, piece))
                else:
                    alone += [(key, doc, start + at, size, piece[at : at + size + MATCH - 1]) for key, at, size in _parted(piece, n)]
                    if len(alone) >= ALONE:
                        yield from _combined(alone)
        if out:
            yield _pieces(*zip(*out, strict=True))
    if alone:
        yield from _combined(alone)


MARKS = "doc bigint, start bigint, windows bigint"


def _marks(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (doc, start, windows)], ["doc", "start", "windows"])


def _sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: the suffix array of its pieces in order of document and place."""
    forget()
    found, pieces = [], []
    for batch in batches:
        given = pa.compute.is_valid(batch.column("piece"))
        passed = batch.filter(pa.compute.invert(given))
        if passed.num_rows:
            yield _marks(*(_column(passed, c) for c in ("doc", "start", "windows")))
        batch = batch.filter(given)
        found.append(tuple(_column(batch, c) for c in ("doc", "start")))
        pieces += batch.column("piece").to_pylist()
    if not pieces:
        return
    doc, start = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    pieces = [pieces[k] for k in order.tolist()]
    copies = np.flatnonzero(later_copies(pieces, MATCH))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    ends = np.cumsum(sizes)
    nth = np.searchsorted(ends, copies, side="right")
    yield _marks(*_merged(doc[nth], start[nth] + copies - (ends - sizes)[nth], np.ones(len(copies), np.int64)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all rows with doc_id, doc, bytes, carried; one row per doc): doc is an order-preserving integer key."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    plain = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    if plain:
        keyed = rows.withColumn("doc", F.col("doc_id"))
        return keyed, keyed
    told = F.xxhash64("bytes")
    ordered = rows.select("doc_id", told.alias("text_hash")).distinct().orderBy("doc_id", "text_hash")
    keys = written(ordered.withColumn("doc", F.monotonically_increasing_id()), "document-keys")
    named = keys.withColumnRenamed("doc_id", "own_id")
    keyed = rows.join(named.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (told == F.col("text_hash")))
    keyed = keyed.drop("text_hash", "own_id")
    return keyed, keyed.dropDuplicates(["doc"])


def repeated(keyed: DataFrame, common: int = COMMON_ANCHOR) -> DataFrame:
    """Windows that an earlier place holds: doc, start, windows. keyed: doc, bytes, one row each."""
    texts = keyed.select("doc", "bytes")
    found = texts.mapInArrow(_find_runs, ROWS).repartition("anchor").sortWithinPartitions("anchor", "content", "doc", "start")
    met = written(found.mapInArrow(partial(_meet, common=common), ROWS), "runs")
    shared = met.where(F.col("kind").isin(SHARED, COMMON))
    per_run = F.when(F.col("kind") == COMMON, F.col("windows") * MATCH / FURTHER).otherwise(F.col("windows") + MATCH).cast("bigint")
    total = shared.agg(F.sum(per_run)).first()[0] or 0
    runs = shared.groupBy("doc").agg(F.collect_list(F.struct("kind", "anchor", "start", "windows")).alias("runs"))
    cut = texts.join(runs.hint("merge"), "doc").mapInArrow(_cut, PIECES)
    marks = cut.repartition(max(1, -(-total // SHARD_BYTES)), "anchor").mapInArrow(_sort_shard, MARKS)
    return met.where(F.col("kind") == MARK).select("doc", "start", "windows").unionByName(marks)


RESULT = "doc_id bigint, doc bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def _remove(batches: Iterator[pa.RecordBatch], whole_characters: bool, carried: bool) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        spans, kept, sizes = [], [], []
        for text, marks in zip(batch.column("bytes"), batch.column("marks").to_pylist(), strict=True):
            text = text.as_py()
            gone: list[dict[str, int]] = []
            for mark in sorted(marks or [], key=lambda m: m["start"]):
                start, stop = mark["start"], mark["start"] + mark["windows"] + MATCH - 1
                if gone and start <= gone[-1]["stop"]:
                    gone[-1]["stop"] = max(stop, gone[-1]["stop"])
                else:
                    gone.append({"start": start, "stop": stop})
            if whole_characters:
                gone = [g for g in (_within(text, g) for g in gone) if g["start"] < g["stop"]]
            edges = [0, *(x for g in gone for x in (g["start"], g["stop"])), len(text)]
            spans.append(gone)
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary()), *([batch.column("carried")] if carried else [])],
            ["doc_id", "doc", "n_bytes", "spans", "kept"] + ["carried"] * carried,
        )


def _within(text: bytes, span: dict[str, int]) -> dict[str, int]:
    """The span less the parts of characters at its ends."""
    start, stop = span["start"], span["stop"]
    while start < stop and text[start] & 0xC0 == 0x80:
        start += 1
    while stop > start and stop < len(text) and text[stop] & 0xC0 == 0x80:
        stop -= 1
    return {"start": start, "stop": stop}


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, carry: list[str] | None = None
) -> DataFrame:
    """doc_id, doc, n_bytes, spans (the removed runs of bytes), kept (the other bytes) of every row.

    whole_characters: a character that is covered in part stays. carry: columns to give with
    each row, as the struct ``carried``.
    """
    keyed, single = _keyed(docs, id_col, text_col, carry or [])
    marks = repeated(single).groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    met = keyed.join(marks.hint("merge"), "doc", "left")
    schema = RESULT + (f", carried {keyed.schema['carried'].dataType.simpleString()}" if carry else "")
    return met.mapInArrow(partial(_remove, whole_characters=whole_characters, carried=bool(carry)), schema)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what repeats removed from their texts, whole characters at a time; n_chars follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = remove_repeats(docs, whole_characters=True, carry=others)
    text = F.col("kept").cast("string")
    own = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("bigint")}
    return out.select(*[(own[c] if c in own else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def removed_bytes(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
