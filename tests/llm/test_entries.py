"""The registered queries themselves, on the smallest tables, against brute force or their SQL."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestream.llm import entries, simhash

from ..oracle import compare
from .test_pages_and_quality import brute_measures, brute_rule
from .test_simhash import brute as brute_roots
from .test_suffix_dedup import brute as brute_removed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def ran(spark, name, types):
    out = entries.QUERIES[name](spark, SF)
    assert {c: t for c, t in out.dtypes if c in types} == types, out.dtypes
    return out.collect()


def test_exact_dedup_equals_its_sql_and_leaves_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    compare(spark, entries.QUERIES["op10_exact_dedup"], entries.SQL["op10_exact_dedup"], SF)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_sharding(spark, texts):
    types = {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got, places = ran(spark, "op1_sharding", types), defaultdict(list)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        places[r.shard].append(r.slot)
    assert len(got) == len(texts) and set(places) <= set(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in ran(spark, "op2_html_extraction", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}):
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) > 0
    got = ran(spark, "op4_url_filter", {c: "string" for c in ("host", "path", "rule", "verdict")})
    assert len(got) == len(pages)
    for r in got:
        host, path, best = brute_rule(pages[r.page_id].url)
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None) and r.verdict in ({best[1]} if best else {"block", "allow"})


def test_quality(spark, texts):
    got = ran(spark, "op3_quality", {c: "bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": "boolean", "kept": "boolean"})
    assert len(got) == len(texts)
    for r in got:
        n, *_, repeat = want = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (r.base_failed and r.kept)


def test_suffix_dedup_and_simhash(spark, texts):
    ids = sorted(texts)
    want = dict(zip(ids, brute_removed([(i, texts[i]) for i in ids]), strict=True))
    got = ran(spark, "op5_suffix_dedup", {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()}
    prints = [simhash.fingerprint(texts[i]) for i in ids]
    roots = brute_roots(prints)
    got = ran(spark, "op7_simhash", {"fingerprint": "string", "component_id": "bigint"})
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, roots, strict=True)}


def test_token_queries(spark, texts):
    words, pieces = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    at, want = 0, {}
    for i in sorted(texts):
        ids = np.array(words.encode(texts[i], add_special_tokens=False).ids + [2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = ran(spark, "op6_token_files", {"start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    plain = {i: pieces.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    got = ran(spark, "op8_bpe", {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    told = {i: (len(x), *(hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, x)), pieces.decode(x, skip_special_tokens=False)))) for i, x in plain.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == told
    got, windows = ran(spark, "op9_packing", {c: "bigint" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}), defaultdict(list)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for i, x in plain.items():
        ids, place = np.array(x + [1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (place, len(ids), zlib.crc32(ids[place : place + r.length].tobytes()))
            place += r.length
        assert place == len(ids)
    assert all(sum(n for _, n in w) <= 2048 and [o for o, _ in sorted(w)] == [sum(n for o2, n in w if o2 < o) for o, _ in sorted(w)] for w in windows.values())
