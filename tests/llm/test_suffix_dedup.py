import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lodestream.llm import suffix_dedup, suffixes
from lodestream.llm.suffixes import later_copies, suffix_array


def brute_copies(pieces, depth):
    seen, out = set(), []
    for p in pieces:
        for i in range(len(p) + 1):
            w = p[i : i + depth]
            out.append(len(w) == depth and w in seen)
            if len(w) == depth:
                seen.add(w)
    return out


def brute(rows, match=100):
    """rows: (id, text) in order; (n_removed, spans, kept) for each."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - match + 1):
            w = data[i : i + match]
            if w in seen:
                gone[i : i + match] = b"\1" * match
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(data), sum(gone), spans, kept))
    return out


def test_suffix_array_and_copies_equal_brute_force(monkeypatch):
    rng = random.Random(4)
    for trial in range(400):
        monkeypatch.setattr(suffixes, "TOGETHER", rng.choice([2, 16, 4096]))
        k, depth = rng.choice([1, 2, 3, 26]), rng.choice([1, 2, 5, 9])
        pieces = [bytes(rng.choice(range(97, 97 + k)) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        pieces.append(rng.choice(pieces) + rng.choice(pieces))
        assert later_copies(pieces, depth).tolist() == brute_copies(pieces, depth)
        text = [rng.randrange(1, k + 1) for _ in range(rng.randint(0, 50))] + [0]
        order = suffix_array(np.array(text, np.uint16), k + 1).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])


def test_large_alphabets_and_periodic_texts_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    for trial in range(150):
        text = rng.integers(1, rng.integers(2, 250) + 1, rng.integers(2, 250))
        text = np.repeat(text, rng.integers(1, 7, len(text))) if trial % 5 == 0 else np.tile(text[:9], 25) if trial % 7 == 0 else text
        text = np.append(text, 0).astype(np.int32)
        for together in (8, 64, 4096):
            monkeypatch.setattr(suffixes, "TOGETHER", together)
            assert suffix_array(text, int(text.max()) + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_the_reduced_string_of_a_shard_is_sorted_by_recursion(spark, monkeypatch):
    texts = [r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sizes = []
    monkeypatch.setattr(suffixes, "suffix_array", lambda text, symbols, real=suffix_array: sizes.append((len(text), symbols)) or real(text, symbols))
    data, n = [], 0
    for t in texts:
        if n + len(t) < suffix_dedup.SHARD_BYTES:
            data.append(t)
            n += len(t) + 1
    copies = later_copies(data, 100)
    assert len(sizes) >= 4 and sizes[1][1] > 10_000, sizes
    seen, at = set(), 0
    for t in data:
        for i in range(0, len(t) - 99, 13):
            assert not copies[at + i] or t[i : i + 100] in seen or t.find(t[i : i + 100]) < i
        seen |= {t[i : i + 100] for i in range(len(t) - 99)}
        at += len(t) + 1


def test_runs_meet_in_a_stream():
    """Whatever the batches and the bound: each content's first run passes, the others are marked."""
    rng = random.Random(6)
    for trial in range(60):
        rows = [(suffix_dedup.RUN, a, 10 * a + rng.randrange(1 + 4 * a), d, 7 * rng.randrange(5), 3) for a in range(6) for d in range(rng.randrange(1, 9))]
        rows = sorted(set(rows), key=lambda r: r[1:])
        rows = [(suffix_dedup.REPEATING if r[2] % 3 == 0 else r[0], *r[1:]) for r in rows]
        common, size = rng.choice([0, 1, 3, 99]), rng.choice([1, 2, 5, 100])
        batches = [suffix_dedup._rows(*(np.array(c, np.int64) for c in zip(*rows[k : k + size], strict=True))) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in suffix_dedup._meet(iter(batches), common) for r in b.to_pylist()]
        first, contents, marks = {}, {}, set()
        for r in rows:
            contents.setdefault(r[1], set()).add(r[2])
            if r[1:3] in first:
                marks |= {(r[3], r[4] + k) for k in range(3)}
            else:
                first[r[1:3]] = r
        want = set()
        for (a, _), r in first.items():
            n = len(contents[a])
            if n > common or n > 1 or r[0] == suffix_dedup.REPEATING:
                want.add((suffix_dedup.COMMON if n > common else suffix_dedup.SHARED, *r[1:]))
        assert {g for g in got if g[0] != suffix_dedup.MARK} == want
        assert {(g[3], g[4] + k) for g in got if g[0] == suffix_dedup.MARK for k in range(g[5])} == marks


def planted(rng):
    words = ["".join(rng.choice("abcdeé ñ") for _ in range(rng.randint(2, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, line = prose(60), prose(13)[:70]
    texts = [prose(rng.randint(1, 200)) for _ in range(60)]
    texts += [prose(30) + passage + prose(40) for _ in range(10)] + [prose(20) + line + prose(20) for _ in range(30)]
    texts += [texts[3], texts[5] + " tail", "x" * 700, "ab" * 400, passage + passage, "", None, "é" * 120, texts[0][:99]]
    return texts


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc", F.lit("clash")).repartition(3)
    return suffix_dedup.remove_repeats(df).withColumn("n_removed", suffix_dedup.removed_bytes()).collect()


def check(got, rows):
    want = dict(zip([r[0] for r in rows], brute(rows), strict=True))
    assert len(got) == len(rows)
    for r in got:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).digest()) == (n, removed, spans, hashlib.sha256(kept).digest()), r.doc_id


def test_whole_documents_equal_brute_force(spark):
    rng = random.Random(8)
    texts = planted(rng)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    check(run(spark, rows), rows)


def test_blocks_of_long_documents(monkeypatch):
    rng = random.Random(9)
    rows = list(enumerate(planted(rng)))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    blocks = list(suffix_dedup._runs_of([1], [rows[5][1].encode() * 3]))
    covered = sorted((int(s), int(s + w)) for _, start, size, *_ in blocks for s, w in zip(start, size, strict=True))
    assert covered[0][0] == 0 and covered[-1][1] == len(rows[5][1].encode() * 3) - 99
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


def test_windows_of_common_anchors_alone(spark):
    """The same rows when every shared anchor counts as common."""
    rng = random.Random(10)
    rows = list(enumerate(planted(rng)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed, single = suffix_dedup._keyed(df, "doc_id", "text", [])
    plain = suffix_dedup.repeated(single).collect()
    apart = suffix_dedup.repeated(single, common=0).collect()

    def starts(marks):
        return {(m.doc, m.start + k) for m in marks for k in range(m.windows)}

    assert starts(plain) == starts(apart)


def test_repeated_and_null_ids_and_empty_table(spark):
    rng = random.Random(11)
    texts = planted(rng)
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[70]), (None, None), (2, texts[70]), (2, texts[71])]
    got = run(spark, rows)
    assert len(got) == 6
    by = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    assert by[(1, len(texts[0].encode()))] == 0 and by[(None, 0)] == 0
    assert by[(2, len(texts[70].encode()))] == len(texts[70].encode())
    assert run(spark, [])[:1] == []


def test_stage_keeps_columns_and_whole_characters(spark):
    rng = random.Random(12)
    rows = [(i, t, f"s{i}", len(t or "")) for i, t in enumerate(planted(rng))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    out = suffix_dedup.drop_repeats(df)
    assert out.columns == df.columns
    want = brute([(i, t) for i, t, _, _ in rows])
    for r in out.collect():
        assert r.source == f"s{r.doc_id}" and r.n_chars == len(r.text) and "\ufffd" not in r.text
        assert 0 <= len(r.text.encode()) - len(want[r.doc_id][3]) <= 2 * want[r.doc_id][2]
