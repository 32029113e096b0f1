"""Token-id files of independent zstandard frames with a trailing seek table.

A file is a row of frames, one per document, in ascending id order, then a skippable frame
with the documents' ids and the bytes of a token id (two where the vocabulary allows, else
four), and the seek table of the public zstandard seekable format: for each
frame its compressed size, its size and the low 32 bits of the XXH64 of its content. A reader
takes the table from the end of the file and decompresses only the frames it wants; every
frame is checked against its checksum.

Documents are tokenized and compressed where they are read; only frames are sorted. A task
that is repeated writes a file of its own name, and readers go by the manifest, which holds
the files of the attempts that counted.

Defined results: a null or empty text has the end id only; rows that repeat an id are written
side by side; a null id comes first; an empty table gives no file; other columns are never
read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, written
from .tokens import encoder

SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
FILE_BYTES = 32 << 20
LEVEL = 1
NO_ID = -(1 << 63)
MANIFEST = "file string, place int, documents bigint, tokens bigint"


def id_bytes(vocabulary: str) -> int:
    return 2 if encoder(vocabulary).library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def frames(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, frame (its compressed ids), n_tokens, checksum."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        end, width = np.array([end_id], "<u4").tobytes(), id_bytes(vocabulary)
        encode, squeeze = encoder(vocabulary).encode, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        for batch in batches:
            made, sizes, sums = [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py()) + end
                sizes.append(len(ids) // 4)
                ids = np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()
                made.append(squeeze(ids))
                sums.append(xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "frame", "n_tokens", "checksum"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.mapInArrow(compress, "doc_id bigint, frame binary, n_tokens bigint, checksum bigint")


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents to files in ``folder`` and return the manifest."""
    made = written(frames(docs, vocabulary, end_id), "frames")
    total = made.agg(F.sum(F.octet_length("frame"))).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        place, ids, table, tokens, out, width = task.partitionId(), [], [], 0, None, id_bytes(vocabulary)
        for batch in batches:
            for doc_id, frame, n, checksum in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    store, at = fs.FileSystem.from_uri(folder)
                    store.create_dir(at, recursive=True)
                    name = f"part-{place:06d}-{task.taskAttemptId()}.zst"
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                out.write(frame)
                ids.append(NO_ID if doc_id is None else doc_id)
                table.append((len(frame), width * n, checksum))
                tokens += n
        if out is not None:
            listed = np.array(ids, "<i8").tobytes()
            out.write(struct.pack("<III", SKIPPABLE_IDS, 4 + len(listed), width) + listed)
            entries = np.array(table, "<u4").tobytes()
            tail = struct.pack("<IBI", len(table), 0x80, SEEKABLE)
            out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(tail)) + entries + tail)
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"file": name, "place": place, "documents": len(ids), "tokens": tokens}],
                pa.schema([("file", pa.string()), ("place", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]),
            )

    n = max(1, -(-total // file_bytes))
    # the row's place in the written table lets rows that repeat an id fill several files
    numbered = made.withColumn("nth", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(n, "doc_id", "checksum", "nth").sortWithinPartitions("doc_id", "checksum", "nth")
    return written(ordered.mapInArrow(write, MANIFEST), "manifest")


def open_table(stored) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ids, offsets of the frames, seek table rows, bytes of a token id) of an open file."""
    end = stored.size()
    stored.seek(end - 9)
    n, descriptor, magic = struct.unpack("<IBI", stored.read(9))
    if magic != SEEKABLE or not descriptor & 0x80:
        raise ValueError("not a seekable file with checksums")
    stored.seek(end - 9 - 12 * n - 8 - 8 * n - 4)
    raw = stored.read(4 + 8 * n + 8 + 12 * n)
    table = np.frombuffer(raw, "<u4", 3 * n, 8 * n + 12).reshape(n, 3)
    starts = np.zeros(n, np.int64)
    np.cumsum(table[:-1, 0], out=starts[1:])
    return np.frombuffer(raw, "<i8", n, 4), starts, table, struct.unpack("<I", raw[:4])[0]


def read_files(manifest: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (bytes) from the files.

    ``doc_ids``: decompress only these documents' frames.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        expand = zstandard.ZstdDecompressor().decompress
        wanted = None if doc_ids is None else np.array(doc_ids, np.int64)
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{file}") as stored:
                    ids, offsets, table, width = open_table(stored)
                    first = before + np.concatenate([[0], np.cumsum(table[:, 1].astype(np.int64) // width)])
                    picked = np.arange(len(ids)) if wanted is None else np.flatnonzero(np.isin(ids, wanted))
                    for some in np.array_split(picked, -(-len(picked) // 2000)) if len(picked) else []:
                        texts = []
                        for k in some.tolist():
                            stored.seek(int(offsets[k]))
                            content = expand(stored.read(int(table[k, 0])))
                            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != table[k, 2]:
                                raise ValueError(f"checksum of document {ids[k]} in {file} does not hold")
                            texts.append(np.frombuffer(content, f"<u{width}").astype("<u4").tobytes())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[some], mask=ids[some] == NO_ID), pa.array(first[some]), pa.array(texts, pa.binary())],
                            ["doc_id", "start", "ids"],
                        )

    before = F.sum("tokens").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", "place", F.coalesce(before, F.lit(0)).alias("before"))
    # one task for each file
    spread = files.repartition(max(1, manifest.count())).select("file", "before")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, ids binary")


def new_folder(docs: DataFrame) -> str:
    return new_path(docs.sparkSession, "token-files")
