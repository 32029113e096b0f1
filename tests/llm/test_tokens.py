import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestream.llm import bpe_table
from lodestream.llm.tokens import Encoder

ODD = ["a", "B", "é", "ß", "İ", "ς", "Σ", "中", "1", "²", ".", ",", "'s", "'", " ", "  ", "\n", "\t", " ", "　", "́", "\x1c"]
ODD += ["<|endoftext|>", "😀", "!", "\r\n", "ﬁ", "\x85", "​", "᠎", "\0", "word"]


def fuzzed(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_by_word_equals_the_library(name):
    path = public_tokenizers.path(name)
    own, library = Encoder(path), Tokenizer.from_file(path)
    for text in fuzzed(4000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.encode(None) == b""


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_table_of_words_equals_the_library(spark, name, monkeypatch):
    monkeypatch.setattr(bpe_table, "CHUNK", 300)
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = [*fuzzed(400, 2), None, "", "a b\nc d", "tab\there and  more", "x" * 5000, "plain words in a row " * 50]
    rows = [*enumerate(texts), (3, texts[3]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).repartition(5)
    got = bpe_table.encode(df, path, buckets=3).collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert bpe_table.encode(df.limit(0), path, buckets=3).count() == 0


def test_a_chunk_without_its_answers_encodes_for_itself():
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    sizes, block = bpe_table._joined(["one two", "three two"])
    texts = pa.Table.from_pylist([{"chunk": 0, "doc_ids": [4, 5], "sizes": sizes, "texts": block}])
    other = pa.table({"bucket": [0], "check": [1], "found": [bpe_table._packed(np.array([1]), np.array([7]))]})
    library = Tokenizer.from_file(path)
    got = bpe_table._lookup(texts, other, path, 1).to_pylist()
    assert [r["ids"] for r in got] == [library.encode(t).ids for t in ("one two", "three two")]


def test_decoding_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    rows = [(k, [rng.randrange(50257) for _ in range(rng.randint(0, 20))]) for k in range(300)]
    got = bpe_table.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), path).collect()
    assert {r.doc_id: r.decoded for r in got} == {k: library.decode(ids, skip_special_tokens=False) for k, ids in rows}
    texts = spark.createDataFrame(list(enumerate(fuzzed(200, 5))), "doc_id bigint, text string")
    there = bpe_table.decode(bpe_table.encode(texts, path, buckets=2), path)
    assert there.join(texts, "doc_id").where("decoded <> text").count() == 0
