"""BPE encoding and decoding by a table of distinct words.

1. Texts are split into words where they are read, in chunks of about ``CHUNK`` characters, and
   each chunk lists its distinct words once.
2. The words of all chunks meet by hash; each distinct word of the corpus is encoded once.
3. The words' ids go back to the chunks that asked for them; there they meet the chunk's texts,
   which become ids by the number of the word at each position.
4. Decoding joins ids with the vocabulary's table of pieces, whose size the vocabulary bounds.

What is shuffled is the distinct words of chunks, their ids and the texts, all as compressed
blocks; a frequent word crosses once for each chunk, however often it occurs. Each answer says
which words it is for; should a repeated read deal the rows out otherwise, so that a chunk
comes to hold other words, the chunk encodes them itself.

Defined results: a null or empty text has no ids; rows that repeat have rows of their own; a
null id is kept; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PIECES, SEPARATORS, Encoder, byte_symbols, encoder

CHUNK = 8 << 20
#: Rows that are decoded together.
ROWS = 500


class _Numbers(dict):
    """Word -> its number in the chunk."""

    def __init__(self, words: list[str], lead: str = ""):
        self.words, self.lead = words, lead

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.words)
        self.words.append(self.lead + word)
        return number


class _Split:
    """Numbers the words of texts; the words of a chunk are in ``words``."""

    def __init__(self, encoder_: Encoder):
        self.encoder, self.words = encoder_, []
        self.plain, self.led = _Numbers(self.words), _Numbers(self.words, " ")

    def numbers(self, text: str) -> list[int]:
        if not text:
            return []
        kind, plain = self.encoder, self.plain
        if any(s in text for s in kind.special) or not (kind.spaced or kind.dropped) or SEPARATORS.search(text):
            return [plain[text]]
        if kind.dropped:
            return [plain[w] for w in text.split()]
        out, led, first, quick = [], self.led.__getitem__, len(self.words), True
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(plain[words[0]])
            out.extend(map(led, words[1:]))
            out.append(plain["\n"])
        for word in self.words[first:]:
            bare = word.removeprefix(" ")
            if word != "\n" and bare.split() != [bare]:  # other white space: not to be met as known
                quick = False
                plain.pop(word, None)
                self.led.pop(bare, None)
        return out[:-1] if quick else [plain[p] for p in PIECES.findall(text)]


def _packed(*arrays: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes, each array behind its length."""
    import zstandard

    parts = [np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()]
    parts += [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(block: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<u4", n, 4).tolist(), 4 + 4 * n, []
    for size in sizes:
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 * size
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(chunk, ids, texts) of the rows of a task."""
    from pyspark import TaskContext

    chunk, filled, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            filled += len(texts[-1])
            if filled >= CHUNK:
                yield chunk, ids, texts
                chunk, filled, ids, texts = chunk + 1, 0, [], []
    if ids:
        yield chunk, ids, texts


def _joined(texts: list[str]) -> tuple[bytes, bytes]:
    """Texts as two compressed blocks: their lengths, and the texts."""
    import zstandard

    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return _packed(sizes), zstandard.ZstdCompressor(level=3).compress("".join(texts).encode())


def _parted(sizes: bytes, block: bytes) -> list[str]:
    import zstandard

    text, ends = zstandard.ZstdDecompressor().decompress(block).decode(), np.cumsum(_unpacked(sizes)[0]).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _dealt(words: list[str], buckets: int) -> Iterator[tuple[int, np.ndarray, list[str], int]]:
    """(bucket, numbers, words, check) of a chunk's words; check tells what words they are."""
    import xxhash

    where = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(buckets + 1))
    for bucket in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        numbers = order[edges[bucket] : edges[bucket + 1]]
        own = [words[k] for k in numbers.tolist()]
        told = "".join(own) + "\n" + ",".join(map(str, map(len, own)))
        yield bucket, numbers, own, xxhash.xxh64_intdigest(told) >> 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def chunk_words(docs: DataFrame, vocabulary: str, buckets: int) -> DataFrame:
    """chunk, bucket, check, sizes, words: the distinct words of each chunk by bucket."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in _chunks(batches):
            cut = _Split(encoder(vocabulary))
            for text in texts:
                cut.numbers(text)
            for bucket, _, words, check in _dealt(cut.words, buckets):
                sizes, block = _joined(words)
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "bucket": bucket, "check": check, "sizes": sizes, "words": block}])

    return _texts(docs).mapInArrow(split, "chunk bigint, bucket bigint, check bigint, sizes binary, words binary")


def chunk_texts(docs: DataFrame) -> DataFrame:
    """chunk, doc_ids, sizes, texts: the same chunks' texts."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in _chunks(batches):
            sizes, block = _joined(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.binary()), pa.array([block], pa.binary())],
                ["chunk", "doc_ids", "sizes", "texts"],
            )

    return _texts(docs).mapInArrow(joined, "chunk bigint, doc_ids array<bigint>, sizes binary, texts binary")


def encode_words(words: DataFrame, vocabulary: str, buckets: int) -> DataFrame:
    """chunk, bucket, check, found: each bucket encodes its distinct words once and answers every chunk."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, known = encoder(vocabulary), {}
        for batch in batches:
            for row in batch.to_pylist():
                ids = []
                for word in _parted(row.pop("sizes"), row.pop("words")):
                    if (found := known.get(word)) is None:
                        known[word] = found = kind.encode_piece(word)
                    ids.append(found)
                yield pa.RecordBatch.from_pylist([row | {"found": _packed(*_counted(ids))}])

    return words.repartition(buckets, "bucket").mapInArrow(answer, "chunk bigint, bucket bigint, check bigint, found binary")


def _counted(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of counts[k] places each, one after the other."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts - starts, counts)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _lookup(texts: pa.Table, answers: pa.Table, vocabulary: str, buckets: int) -> pa.Table:
    """Ids of one chunk's texts from the ids of its words."""
    kind, out = encoder(vocabulary), []
    given = {(r["bucket"], r["check"]): r["found"] for r in answers.select(["bucket", "check", "found"]).to_pylist()}
    for row in texts.to_pylist():
        cut = _Split(kind)
        numbers = [np.array(cut.numbers(t), np.int64) for t in _parted(row["sizes"], row["texts"])]
        starts, counts, ids, at = np.zeros(len(cut.words), np.int64), np.zeros(len(cut.words), np.int64), [np.empty(0, np.uint32)], 0
        for bucket, own, words, check in _dealt(cut.words, buckets):
            block = given.get((bucket, check))
            own_counts, own_ids = _unpacked(block) if block else _counted([kind.encode_piece(w) for w in words])
            counts[own] = own_counts
            starts[own] = at + np.cumsum(own_counts, dtype=np.int64) - own_counts
            ids.append(own_ids)
            at += len(own_ids)
        ids = np.concatenate(ids)
        place = np.concatenate(numbers)
        before = np.concatenate([[0], np.cumsum(counts[place])])
        ends = before[np.concatenate([[0], np.cumsum([len(n) for n in numbers])])]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[_spread(starts[place], counts[place])].astype(np.int32)))
        out.append(pa.table([pa.array(row["doc_ids"], pa.int64()), lists], names=["doc_id", "ids"]).cast(ENCODED))
    return pa.concat_tables(out) if out else ENCODED.empty_table()


def encode(docs: DataFrame, vocabulary: str, buckets: int | None = None) -> DataFrame:
    """doc_id, ids of every row. buckets: parts of the word table; by default the session's shuffle partitions."""
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = encode_words(chunk_words(docs, vocabulary, buckets), vocabulary, buckets)

    def lookup(texts: pa.Table, found: pa.Table) -> pa.Table:
        return _lookup(texts, found, vocabulary, buckets)

    return chunk_texts(docs).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lookup, "doc_id bigint, ids array<int>")


def piece_table(vocabulary: str) -> list[bytes | None]:
    """The bytes of each id; the vocabulary's size bounds the table."""
    kind = encoder(vocabulary)
    back = {s: b for b, s in enumerate(byte_symbols())}
    out: list[bytes | None] = [None] * kind.library.get_vocab_size(with_added_tokens=True)
    for piece, k in kind.library.get_vocab(with_added_tokens=True).items():
        out[k] = piece.encode() if piece in kind.special else bytes(back[c] for c in piece)
    return out


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded: the text that a byte-level vocabulary's ids stand for, special tokens kept."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(piece_table(vocabulary), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                lists = some.column("ids")
                ends = np.cumsum([0, *pa.compute.list_value_length(lists).fill_null(0).to_pylist()])
                found = pieces.take(lists.flatten())
                data = found.buffers()[2] or b""
                place = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1)[ends].tolist() if len(found) else [0] * len(ends)
                texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(place, place[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id bigint, ids array<int>, decoded string")
