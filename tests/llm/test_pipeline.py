import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestream.llm import quality
from lodestream.llm.suffix_dedup import _within

from .test_pages_and_quality import brute_measures
from .test_simhash import brute_near

SF = "/root/testdata/sf0.001"


def brute_removed(rows, match=100):
    """Texts in order of id without covered characters."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows.items()):
        data = text.encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - match + 1):
            w = data[i : i + match]
            if w in seen:
                gone[i : i + match] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        keep = np.ones(len(data), bool)
        for a, b in edges.reshape(-1, 2).tolist():
            span = _within(data, {"start": a, "stop": b})
            keep[span["start"] : span["stop"]] = False
        out[doc_id] = bytes(np.frombuffer(data, np.uint8)[keep]).decode()
    return out


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model is not None

    good = {}
    for doc_id, text in rows.items():
        n, _, _, _, repeat = brute_measures(text)
        buckets, values = quality.features(text)
        raw = model.slope * (model.weights[buckets] @ values + model.bias) + model.shift
        if n >= 10 and 100 * repeat <= 20 * n and 1 / (1 + np.exp(-raw)) >= quality.LEAST_PROBABILITY:
            good[doc_id] = text
    last = {text: doc_id for doc_id, text in sorted(good.items())}
    single = {doc_id: text for text, doc_id in last.items()}
    ids = sorted(single)
    roots = brute_near([single[i] for i in ids])
    apart = {ids[k]: single[ids[k]] for k in range(len(ids)) if roots[k] == k}
    left = brute_removed(apart)

    wants = [good, single, apart, left]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], wants, strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.written(out, f"test-{name}")
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        assert docs.count() == len(want)

    pieces = defaultdict(list)
    got = corpus_pipeline.run(spark, SF).collect()
    for r in got:
        pieces[r.doc_id].append(r)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(pieces) == set(left)
    for doc_id, text in left.items():
        whole = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(whole), zlib.crc32(whole[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(whole)


def test_stages_take_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs
    for c in ("label", "labelled", "class", "told", "kept_id", "kept_hash", "kept_digest", "gone_id", "digest", "doc", "bytes", "marks", "spans", "kept", "node", "row"):
        odd = odd.withColumn(c, F.lit(7))
    for name, stage in corpus_pipeline.STAGES[:4]:
        want, got = stage(spark, docs, SF), stage(spark, odd, SF)
        assert got.columns == odd.columns, name
        assert sorted(map(tuple, got.select(docs.columns).collect())) == sorted(map(tuple, want.collect())), name
    assert corpus_pipeline.packed(spark, odd, SF).count() == corpus_pipeline.packed(spark, docs, SF).count()


def test_stages_take_odd_tables(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (None, "x y", None, None, None), (1, None, "en", "s", 0), (2, "word " * 9, "en", "s", 45), (2, "other", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes = [0, 4, 4, 5, 5]
    for (name, stage), size in zip(corpus_pipeline.STAGES, sizes, strict=True):
        assert stage(spark, df, str(tmp_path)).count() == size, name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
