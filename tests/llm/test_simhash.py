import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestream.llm import near_copies, simhash, variants
from lodestream.llm.components import components


def brute(prints):
    ids = list(range(len(prints)))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in ids]


def test_any_five_positions_hold_exactly_one_group():
    groups = simhash.position_groups()
    assert len(groups) == 14
    from itertools import combinations

    for w in combinations(range(8), 5):
        assert sum(set(g) <= set(w) for g in groups) == 1


def test_fingerprint_by_definition():
    import xxhash

    text = "The CAT sat on\x0bthe mat and É the\ncat sat"
    words = "the cat sat on the mat and É the cat sat".split(" ")
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("two Words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0


def test_links_of_classes_equal_brute_force(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        prints += [base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(25)]
    prints = list(dict.fromkeys(prints))
    want = brute(prints)
    rows = [(simhash._signed(p),) for p in prints]
    classes = spark.createDataFrame(rows, "fp bigint")
    short = simhash.paired(simhash.postings(classes).withColumn("n", F.lit(1)))
    for links in (short, simhash.through_neighbours(classes)):
        roots = {r.node: r.root for r in components(links).collect()}
        found = [roots.get(p, p) for (p,) in rows]
        assert [found.index(r) for r in found] == want


def test_documents_with_copies_nulls_and_repeats(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(500)]
    base = " ".join(rng.choice(words, 400))
    rows = [(10, base), (3, base.upper()), (5, base + " tail"), (7, " ".join(rng.choice(words, 300))), (8, None), (9, "  "), (None, "x y z"), (7, None), (10, base)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = [simhash.fingerprint(t) for _, t in rows]
    roots = brute(prints)
    for r in got:
        same = [k for k, (i, t) in enumerate(rows) if i == r.doc_id and simhash._signed(prints[k]) == r.fp]
        ids = [rows[k][0] for k in range(len(rows)) if roots[k] == roots[same[0]] and rows[k][0] is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def shingles(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute_near(texts):
    """Of each text the first of its component, where five-word shingles are alike by 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["Ärger", "É", "ABC"]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 9, 30, 120, 400]))]
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40 * 2 + 1)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append((" " if rng.random() < 0.5 else "\n").join(own))
    # very many near copies of one text in a chain, and a passage that texts of two kinds share
    base = [f"v{k}" for k in range(200)]
    texts += [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 120)]
    texts += [" ".join(base[:100] + [f"own{n}-{k}" for k in range(100)]) for n in range(30)]
    texts += [None, "", " \n", texts[0].upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_near(texts)
    found = {r.doc_id: r.component for r in near_copies.near_copies(df).collect()}
    for c in ("component", "text_hash", "kept_id", "kept_hash", "node", "key", "row", "stays"):
        df = df.withColumn(c, F.lit("clash"))
    assert len(found) == len(texts)
    first = {}
    assert [first.setdefault(found[k], k) for k in range(len(texts))] == want
    kept = near_copies.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert near_copies.drop_near_copies(df.limit(0)).count() == 0


def test_near_copies_meet_in_the_position_index_alone(spark, monkeypatch):
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[:k] + ["x"] + words[k + 1 :])) for k in (5, 100, 200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert simhash.drop_near_copies(df).count() == 1
    postings = near_copies.postings
    monkeypatch.setattr(near_copies, "postings", lambda sketch, most, group: postings(sketch.limit(0), most, group))
    assert simhash.drop_near_copies(df).count() == 3


def test_position_lists_and_count_filter_by_definition(spark):
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(200):  # a pair of similarity 0.8
        own = rng.choice(1 << 62, 100, replace=False).astype(np.uint64)
        sets += [own[:90], np.concatenate([own[:80], own[90:]])]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    told, steady = near_copies._fingerprints(np.concatenate(sets), starts)
    for k in (0, 77):  # every bit by its definition
        words = near_copies._mixed(sets[k][:, None] + near_copies._SALTS)
        ones = [sum(int(w) >> b & 1 for w in words[:, at].tolist()) for at in range(near_copies.WORDS) for b in range(64)]
        assert np.unpackbits(told[k], bitorder="little").tolist() == [int(2 * n > len(sets[k])) for n in ones]
    assert (steady.reshape(-1, near_copies.PARTS, near_copies.LISTED) % near_copies.PARTS == np.arange(near_copies.PARTS)[:, None]).all()
    rows = [(k, 90, told[k].view("<i8").tolist(), bytearray(steady[k]), None) for k in range(len(sets))]
    sketch = spark.createDataFrame(rows, "node bigint, size bigint, bits array<bigint>, steady binary, root bigint")
    lists = {}
    for r in near_copies.postings(sketch, near_copies.LISTED, near_copies.FINE_GROUP).collect():
        lists.setdefault(r.node, set()).add(r.key)
    for k in (0, 77):
        parts = np.sort(steady[k].reshape(near_copies.PARTS, -1), axis=1).tolist()
        want = {(p << 8 | int(told[k][p])) << 15 | q << 8 | int(told[k][q]) for part in parts for i, p in enumerate(part) for q in part[i + 1 :]}
        assert lists[k] == want
    # pairs of similarity 0.8 meet and pass, others don't pass
    met = [k for k in range(0, len(sets), 2) if lists[k] & lists[k + 1]]
    assert len(met) >= 198
    x, y = sketch.alias("x"), sketch.alias("y")
    passed = x.join(y, F.col("x.node") < F.col("y.node")).where(near_copies._alike("x", "y")).select("x.node", "y.node").collect()
    assert sorted(map(tuple, passed)) == [(k, k + 1) for k in range(0, len(sets), 2)]
    shared = sketch.select(near_copies._other_bytes(F.col("bits")[0]).alias("n")).collect()
    assert [r.n for r in shared] == [int((told[k][:8] > 0).sum()) for k in range(len(sets))]


def test_near_copies_of_odd_rows(spark):
    rows = [(1, None), (1, ""), (2, "one two three"), (2, "one two three"), (None, "one TWO three"), (None, "x"), (None, "x"), (3, "y " * 20000)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:3]) for r in kept) == [("1", ""), ("2", "one"), ("3", "y y"), ("None", "x")]


def test_long_lists_give_the_same_components(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    base = list(rng.choice(words, 900))
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.integers(900)] = "edited"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    a = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    b = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, longest_list=2).collect()}
    assert a == b == dict(zip(range(60), brute([simhash.fingerprint(t) for _, t in rows]), strict=True))


def test_components_of_chains_cycles_hubs_and_ready_stars(spark, monkeypatch):
    chain = [(k, k + 1) for k in range(100, 140)]
    cycle = [(200 + k, 200 + (k + 7) % 20) for k in range(20)]
    hub = [(900, k) for k in range(300, 360)]
    links = chain + cycle + hub + [(139, 900), (5, 5), (None, 7), (8, None), (101, 100)]
    want: dict[int, int] = {}
    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((want.setdefault(a, a), want.setdefault(b, b)))
            want = {n: a if r == b else r for n, r in want.items()}
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {n: r for n, r in want.items() if n != r}
    assert len(got) == len({r.node for r in got})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    # links that are stars already need no step
    monkeypatch.setattr("lodestream.llm.components._least", None)
    stars = components(spark.createDataFrame([(1, 9), (8, 1), (3, 2), (8, 1)], "a bigint, b bigint"))
    assert {(r.node, r.root) for r in stars.collect()} == {(9, 1), (8, 1), (3, 2)}


def test_variants_of_one_text_are_not_paired(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(140)]

    def edited(words, n):
        own = list(words)
        for k in rng.sample(range(len(own)), n):
            own[k] = f"v{rng.randrange(10**6)}"
        return own

    made = [edited(base, 6) for _ in range(200)]  # pairs of them are alike by about 0.5 to 0.7
    made += [edited(made[k], 2) for k in range(0, 200, 20)]
    texts = [" ".join(words) for words in made]
    want, counts = brute_near(texts), {}
    assert len(set(want)) == 200

    def counted(df, name):
        out = near_written(df, name)
        if name in ("candidates", "fine-pairs", "variant-pairs", "near-links"):
            counts[name] = counts.get(name, 0) + out.count()
        return out

    near_written = near_copies.written
    for module in (near_copies, variants):
        monkeypatch.setattr(module, "written", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found, first = {r.doc_id: r.component for r in near_copies.near_copies(df).collect()}, {}
    assert [first.setdefault(found[k], k) for k in range(len(texts))] == want
    # all pairs are 21945; work in proportion to the texts is some rows for each
    assert sum(counts.get(name, 0) for name in ("fine-pairs", "variant-pairs")) < 10 * len(texts)


def test_links_of_regions_equal_brute_force(spark):
    rng = random.Random(8)
    sets = []
    for size in (5, 40, 130):
        base = set(rng.sample(range(10**9), size))
        lists = [base]
        for k in range(60 if size > 100 else 25):  # variants, variants of variants, with differences that many share
            own = set(rng.choice(lists) if k % 2 else base)
            gone = rng.sample(sorted(own), min(len(own) - 1, rng.randrange(1 + size // 8)))
            lists.append(own - set(gone) | set(rng.sample(range(3 * size), rng.randrange(1 + size // 8))))
        sets += [(size % 2, own) for own in lists]  # two regions, one of which is of two kinds
    sets += [(2, set(range(100 * k, 100 * k + 20 + k))) for k in range(4)] + [(2, set(range(300, 321)))]  # no base
    sets = list({(r, frozenset(own)) for r, own in sets})
    rows = [(r, k, k, sorted(own)) for k, (r, own) in enumerate(sets)]
    links, pairs = variants.variant_pairs(spark.createDataFrame(rows, "region bigint, node bigint, root bigint, hashes array<bigint>"), (4, 5))

    def alike(a, b):
        return 5 * len(sets[a][1] & sets[b][1]) >= 4 * len(sets[a][1] | sets[b][1])

    links = [tuple(r) for r in links.collect()]
    assert len(links) > 9 and all(alike(*link) for link in links)
    told = links + [(r.a, r.b) for r in pairs.collect() if alike(r.a, r.b)]
    true = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][0] == sets[b][0] and alike(a, b)]
    assert set(true) - set(told) - {(b, a) for a, b in told}
    got, want = ({r.node: r.root for r in components(spark.createDataFrame(x, "a bigint, b bigint")).collect()} for x in (told, true))
    assert got == want
