import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestream.llm import exact_dedup, packing, sharding, token_files
from lodestream.llm.common import new_path

ROWS = [(5, "a"), (3, "a"), (9, "b"), (9, "b"), (1, None), (2, ""), (None, "c"), (7, "x" * 20000), (8, "x" * 20000), (4, "é\n")]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit("clash")).withColumn("virtual_slot", F.lit(1)).repartition(3)


def test_exact_dedup_of_one_batch(spark):
    index = exact_dedup.DigestIndex(spark, "idx_one", buckets=4)
    got = index.add(table(spark)).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[hashlib.sha256((t or "").encode()).digest()].append(i)
    for r in got:
        same = groups[bytes(r.digest)]
        assert r.group_size == len(same) and r.keep_id == max((i for i in same if i is not None), default=None)
    kept = sorted(str(r.doc_id) for r in got if r.kept)
    assert kept == sorted(str(max((i for i in g if i is not None), default=None)) for g in groups.values())


def test_a_later_batch_meets_the_index(spark):
    index = exact_dedup.DigestIndex(spark, "idx_two", buckets=4)
    assert exact_dedup.drop_copies(index, table(spark)).count() == 6
    later = spark.createDataFrame([(100, "a"), (101, "new"), (102, "new")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in index.add(later).collect()}
    assert not got[100].kept and got[100].keep_id == 5
    assert not got[101].kept and got[102].kept and got[101].keep_id == 102
    assert index.batches() == 2 and index.table().count() == 7
    plan = later.select(F.col("text").cast("binary").alias("digest")).distinct().repartition(4, "digest").join(index.table().hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text


def test_exact_dedup_keeps_columns_and_takes_empty_tables(spark):
    index = exact_dedup.DigestIndex(spark, "idx_three", buckets=4)
    df = table(spark)
    out = exact_dedup.drop_copies(index, df)
    assert out.columns == df.columns
    empty = exact_dedup.DigestIndex(spark, "idx_four")
    assert empty.add(df.limit(0)).count() == 0


def test_dropping_copies_with_clashing_columns_nulls_and_repeats(spark):
    names = ["kept_id", "kept_digest", "gone_id", "gone_told", "digest", "stays", "n", "row", "id", "told", "a.b"]
    df = spark.createDataFrame([(1, None), (1, ""), (2, "x"), (3, "x"), (3, "x"), (None, "y"), (None, "y"), (None, "z")], "doc_id bigint, text string")
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    out = exact_dedup.drop_copies(exact_dedup.DigestIndex(spark, "idx_five"), df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == [("1", ""), ("3", "x"), ("None", "y"), ("None", "z")]


def test_the_index_is_sized_by_data_kept_by_name_and_compacted(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 50)
    monkeypatch.setattr(exact_dedup, "MOST_FILES", 2)
    name = "idx_grown"
    seen = 0
    for batch in range(4):
        index = exact_dedup.DigestIndex(spark, name)  # meets the table of the batches before
        docs = spark.createDataFrame([(k, f"text {k}") for k in range(400 * batch, 400 * batch + 500)], "doc_id bigint, text string")
        got = index.add(docs).collect()
        seen += sum(r.kept for r in got)
        assert index.files_per_bucket() <= 2
    assert seen == 1700 == index.table().count() and index.batches() == 4
    assert exact_dedup.DigestIndex(spark, name).buckets == index.buckets >= 20
    # while buckets are one file each, a join takes the index in its order
    index.compact()
    with index._in_order():
        plan = index.table().join(index.table().alias("o").hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan
    index.drop()
    assert not index.exists()


def test_shards_are_near_equal_and_places_have_no_gaps(spark):
    rng = random.Random(1)
    rows = [(i, "w" * rng.randint(0, 3000)) for i in range(3000)] + [(5, None), (5, None), (None, "n")]
    got = sharding.shard_by_bytes(table(spark, rows), 8).collect()
    assert len(got) == len(rows)
    load, places = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(load) == set(range(8)) and max(load.values()) < 1.001 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    sizes = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sizes
    assert sharding.shard_by_bytes(table(spark).limit(0), 8).count() == 0


def test_shards_of_one_repeated_record_are_near_equal(spark):
    rows = [(7, "same")] * 900 + [(None, None)] * 900 + [(k, "x" * 5) for k in range(20)] + [(8, "w" * 40)] * 500
    got = sharding.shard_by_bytes(table(spark, rows), 8).collect()
    load, places = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert len(got) == len(rows) and max(load.values()) <= 1.01 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards_by_brute_force(spark):
    """The map and the places rebuilt from the virtual slots."""
    rows = [(i, "t" * (i * 37 % 900)) for i in range(1500)]
    path = new_path(spark, "brute-map")
    sharding.store_map(sharding.first_map(spark, 5, 64), path)
    got = sharding.shard_by_bytes(table(spark, rows), 5, path, 64).collect()
    held = defaultdict(list)
    for r in got:
        held[r.virtual_slot].append(r)
    size = {s: sum(r.size for r in held[s]) for s in range(64)}
    fair, load, over, shard_of = sum(size.values()) / 5, [0] * 5, [], {}
    for shard in range(5):
        for s in sorted((s for s in range(64) if s % 5 == shard), key=lambda s: (-size[s], s)):
            before = sum(size[o] for o in range(64) if o % 5 == shard and (-size[o], o) < (-size[s], s))
            if before + size[s] <= fair:
                shard_of[s], load[shard] = shard, load[shard] + size[s]
            else:
                over.append((-size[s], s))
    for less, s in sorted(over):
        shard_of[s] = load.index(min(load))
        load[shard_of[s]] -= less
    assert {r.virtual_slot: r.shard for r in sharding.latest_map(spark, path).collect()} == shard_of
    assert sharding.latest_map(spark, path).first().version == 2
    at = [0] * 5
    for s in range(64):
        own = sorted(held[s], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(at[shard_of[s]], at[shard_of[s]] + len(own))) and {r.shard for r in own} <= {shard_of[s]}
        assert [r.doc_id for r in own] == sorted(r.doc_id for r in own)
        at[shard_of[s]] += len(own)


def test_a_new_shard_takes_slots_only_into_itself(spark):
    rows = sharding.with_slots(table(spark, [(i, "t" * (i % 700)) for i in range(4000)]), slots=512)
    totals = sharding.slot_totals(rows, 512)
    path = new_path(spark, "map")
    first = sharding.store_map(sharding.rebalance(sharding.first_map(spark, 4, 512), totals, 4), path)
    second = sharding.store_map(sharding.add_shard(first, totals), path)
    old, new = ({r.virtual_slot: (r.shard, r.version) for r in m.collect()} for m in (first, second))
    moved = [s for s in old if old[s][0] != new[s][0]]
    assert moved and all(new[s] == (4, 3) for s in moved) and set(old) == set(new) == set(range(512))
    size = {r.virtual_slot: r.bytes for r in totals.collect()}
    loads = defaultdict(int)
    for s, (shard, _) in new.items():
        loads[shard] += size[s]
    assert max(loads.values()) < 1.2 * sum(loads.values()) / 5
    assert sharding.latest_map(spark, path).first().version == 3


def reference_ids(name, text, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing_gives_every_id_once_with_little_padding(spark):
    rng = random.Random(2)
    rows = ROWS + [(i, " ".join(rng.choice(["alpha", "béta", "gamma."]) for _ in range(rng.randint(0, 900)))) for i in range(100, 300)]
    cut = packing.pieces(table(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 1, window=256, with_ids=True)
    got = packing.pack(cut, window=256, group=100).collect()
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert total == sum(len(reference_ids("byte_bpe_50k.json", t, 1)) for _, t in rows)
    assert len(windows) <= 1.03 * total / 256 + 3
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in rows[10:]:
        own = sorted(by[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == reference_ids("byte_bpe_50k.json", t, 1).tobytes()
    assert packing.pack(packing.pieces(table(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json"), 1)).count() == 0


def test_best_fit_takes_the_tightest_window():
    where, offset = packing.best_fit(np.array([9, 7, 6, 3, 3, 1, 1]), 10)
    assert where.tolist() == [0, 1, 2, 1, 2, 2, 0] and offset.tolist() == [0, 0, 0, 7, 6, 9, 9]


def test_files_give_back_every_document(spark):
    rng = random.Random(3)
    rows = ROWS + [(i, " ".join(rng.choice(["Alpha", "béta", "γ"]) for _ in range(rng.randint(0, 300)))) for i in range(100, 400)]
    df = table(spark, rows)
    folder = token_files.new_folder(df)
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_files(df, folder, path, 2, file_bytes=4000)
    assert manifest.count() > 3
    got = sorted(token_files.read_files(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at, texts = 0, defaultdict(list)
    for i, t in rows:
        texts[i].append(reference_ids("word_bpe_49k.json", t, 2).tobytes())
    for r in got:
        assert r.start == at and bytes(r.ids) in texts[r.doc_id]
        at += len(r.ids) // 4
    some = token_files.read_files(manifest, folder, [7, 200, 12345]).collect()
    assert sorted(r.doc_id for r in some) == [7, 200] and all(bytes(r.ids) in texts[r.doc_id] for r in some)
    none = token_files.write_files(df.limit(0), folder + "-empty", path, 2)
    assert token_files.read_files(none, folder + "-empty").count() == 0


def test_files_are_plain_zstandard_and_guard_their_frames(spark):
    import io
    import struct

    import pytest
    import zstandard

    df = table(spark, [(1, "one two"), (2, "three")])
    folder = token_files.new_folder(df)
    manifest = token_files.write_files(df, folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    name = folder.removeprefix("file://") + "/" + manifest.first().file
    raw = open(name, "rb").read()
    want = b"".join(reference_ids("word_bpe_49k.json", t, 2).astype("<u2").tobytes() for t in ("one two", "three"))
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == want
    assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    broken = bytearray(raw)
    broken[8] ^= 0xFF
    open(name, "wb").write(bytes(broken))
    with pytest.raises(Exception):
        token_files.read_files(manifest, folder).collect()
