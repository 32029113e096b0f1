"""Quality rules: base measures of each text and a calibrated logistic regression.

The classifier sees hashed word n-grams and character n-grams. It is trained here on a bounded
sample of labelled rows, half of it for each class, calibrated on scores of rows that the
scoring model was not trained on, and scores Arrow batches against a fixed threshold. Everything
else covers whole texts of all rows.

Defined results: a null or empty text has no words, so it fails the base rules; only where no
row of ``docs`` has a label of the one class or the other do the base rules decide alone; rows
that repeat are judged alike; labels that contradict each other for one id are left out of
training; an id that repeats among the documents trains with one of its texts; an empty table
gives an empty result; other columns are never read, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written
from .tokens import forget

#: Labelled rows that training uses at most, half of them of each class.
SAMPLE = 1000
#: Bytes of text that training uses at most, half of them of each class.
SAMPLE_BYTES = 16 << 20
#: Rows that a training step takes at once.
TOGETHER = 64
#: With fewer rows of a class, all rows train the model and calibration goes by cross-fitting.
FEW = 100
FOLDS = 4
BUCKETS = 1 << 18
WORD_GRAMS = (1, 2)
CHARACTER_GRAMS = (3, 5)
#: A text whose calibrated probability of good quality is less goes; a clean text that is lost
#: counts for more than one junk text that stays.
LEAST_PROBABILITY = 0.2
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLOCK = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)

_WHITE = np.zeros(128, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(128, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rising(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Block:
    """Some texts as one array of code points, each text followed by a line feed."""

    def __init__(self, texts: list[str]):
        joined = "".join(t + "\n" for t in texts)
        self.points = points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, self.n) + 1
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        low = np.minimum(points, 127)
        self.white, self.symbol = _WHITE[low], _SYMBOL[low]
        before, after = np.ones(len(points), bool), np.ones(len(points), bool)
        before[1:], after[:-1] = self.white[:-1], self.white[1:]
        self.word_start = np.flatnonzero(~self.white & before)
        self.word_end = np.flatnonzero(~self.white & after) + 1
        self.word_text = np.searchsorted(self.ends, self.word_start, side="right")
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(1)) * _rising(len(points), int(ODD)), out=self.sums[1:])
        self.inverse = _rising(len(points) + 1, pow(int(ODD), -1, 1 << 64))
        self.words = self.hashed(self.word_start, self.word_end)

    def hashed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.ends] - total[self.starts]

    def word_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of each n words of one text in a row."""
        count = max(0, len(self.words) - n + 1)
        out = np.zeros(count, np.uint64)
        for k in range(n):
            out = out * ODD + self.words[k : k + count]
        whole = self.word_text[:count] == self.word_text[n - 1 : n - 1 + count]
        return _mixed(out + np.uint64(n)), np.where(whole, self.word_text[:count], -1)

    def character_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, texts' ends): n-grams of characters by their first place; the last n of a text aren't whole."""
        count = max(0, len(self.points) - n + 1)
        out = np.zeros(count, np.uint64)
        for k in range(n):
            out = out * ODD + self.points[k : k + count]
        return _mixed(out), np.maximum(self.ends - n, self.starts)

    def measures(self) -> dict[str, np.ndarray]:
        words = np.bincount(self.word_text, minlength=self.n)
        line_end = np.flatnonzero(self.points == 10)
        line_start = np.concatenate([[0], line_end[:-1] + 1])
        has_word = np.searchsorted(self.word_start, line_end) > np.searchsorted(self.word_start, line_start)
        line_start, line_end = line_start[has_word], line_end[has_word]
        line_text = np.searchsorted(self.ends, line_start, side="right")
        key = _mixed(self.hashed(line_start, line_end) + line_text.astype(np.uint64) * ODD)
        order = np.argsort(key, kind="stable")
        again = order[1:][key[order][1:] == key[order][:-1]]
        grams, gram_text = self.word_grams(REPEAT_WINDOW)
        whole = np.flatnonzero(gram_text >= 0)
        key = _mixed(grams[whole] + gram_text[whole].astype(np.uint64) * ODD)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order) + 1, bool)
        twice[:-1][1:] |= same
        twice[:-1][:-1] |= same
        repeated = whole[order[twice[:-1]]]
        covers = np.zeros(len(self.words) + REPEAT_WINDOW + 1, np.int64)
        covers[repeated] += 1
        covers[repeated + REPEAT_WINDOW] -= 1
        covered = np.cumsum(covers)[: len(self.words)] > 0
        return {
            "n_words": words,
            "word_chars": self.per_text(~self.white),
            "n_symbols": self.per_text(self.symbol),
            "n_dup_lines": np.bincount(line_text[again], minlength=self.n),
            "n_repeat_words": np.bincount(self.word_text[covered], minlength=self.n),
        }


def _bucket(hashes: np.ndarray, family: int) -> np.ndarray:
    return ((hashes + np.uint64(family * int(ODD) & (1 << 64) - 1)) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of one text; each kind of n-gram has values that sum to 1."""
    block, buckets, values = Block([text]), [], []
    for n in WORD_GRAMS:
        grams, _ = block.word_grams(n)
        buckets.append(_bucket(grams, n))
        values.append(np.full(len(grams), 1 / max(1, len(grams))))
    for n in CHARACTER_GRAMS:
        grams, stop = block.character_grams(n)
        grams = grams[: stop[0]]
        buckets.append(_bucket(grams, 10 + n))
        values.append(np.full(len(grams), 1 / max(1, len(grams))))
    found, where = np.unique(np.concatenate(buckets), return_inverse=True)
    return found.astype(np.int32), np.bincount(where, np.concatenate(values), len(found)).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, block: Block) -> np.ndarray:
        """Scores before calibration, one for each text of the block."""
        out = np.full(block.n, self.bias)
        for n in WORD_GRAMS:
            grams, text = block.word_grams(n)
            whole = text >= 0
            count = np.bincount(text[whole], minlength=block.n)
            out += np.bincount(text[whole], self.weights[_bucket(grams[whole], n)], block.n) / np.maximum(count, 1)
        for n in CHARACTER_GRAMS:
            grams, stop = block.character_grams(n)
            total = np.concatenate([[0.0], np.cumsum(self.weights[_bucket(grams, 10 + n)], dtype=np.float64)])
            stop = np.minimum(stop, len(grams))
            out += (total[stop] - total[np.minimum(block.starts, stop)]) / np.maximum(stop - block.starts, 1)
        return out

    def probability(self, block: Block) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(block) + self.shift, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 150, rate: float = 3.0, decay: float = 1e-5) -> Model:
    """Logistic regression by adaptive gradient steps on sparse rows, classes weighted alike.

    Rows are taken ``TOGETHER`` at a time within a step, so that its arrays stay small.
    """
    some = [rows[k : k + TOGETHER] for k in range(0, len(rows), TOGETHER)]
    index = [np.concatenate([r[0] for r in part]) for part in some]
    value = [np.concatenate([r[1] for r in part]) for part in some]
    row = [np.repeat(np.arange(len(part), dtype=np.int32), [len(r[0]) for r in part]) for part in some]
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    weights, bias, seen, seen_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        slope, slope_bias = decay * weights, 0.0
        for k, (i, v, r) in enumerate(zip(index, value, row, strict=True)):
            at = slice(k * TOGETHER, k * TOGETHER + len(some[k]))
            z = np.bincount(r, v * weights[i], len(some[k])) + bias
            error = share[at] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at])
            slope += np.bincount(i, v * error[r], BUCKETS)
            slope_bias += error.sum()
        seen += slope**2
        seen_bias += slope_bias**2
        weights -= rate * slope / np.sqrt(seen)
        bias -= 0.1 * slope_bias / np.sqrt(seen_bias)
    return Model(weights.astype(np.float32), bias)


def calibrate(model: Model, raw: np.ndarray, labels: np.ndarray) -> None:
    """Slope and shift of the logistic curve from scores of rows that training hasn't seen."""
    target = np.where(labels == 1, ((labels == 1).sum() + 1) / ((labels == 1).sum() + 2), 1 / ((labels == 0).sum() + 2))

    def loss(a: float, b: float) -> float:
        z = a * raw + b
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * (a * a + b * b))

    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g = np.array([((p - target) * raw).sum() + 1e-3 * a, (p - target).sum() + 1e-3 * b])
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        step, now = np.linalg.solve(h, g), loss(a, b)
        while np.abs(step).max() >= 1e-6 and loss(a - step[0], b - step[1]) > now:  # a whole step may lead away
            step /= 2
        if np.abs(step).max() < 1e-6:
            break
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = float(a), float(b)


def _fitted(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """A calibrated model from rows of both classes."""

    def fit_where(chosen: np.ndarray) -> Model:
        return fit([r for r, c in zip(rows, chosen, strict=True) if c], y[chosen])

    def raw_where(model: Model, chosen: np.ndarray) -> np.ndarray:
        return np.array([model.weights[b] @ a + model.bias for (b, a), c in zip(rows, chosen, strict=True) if c])

    # the folds are dealt within each class, so that each has rows of both
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    if np.bincount(y).min() >= FEW:
        held = fold == FOLDS - 1
        model = fit_where(~held)
        calibrate(model, raw_where(model, held), y[held])
        return model
    model, raw = fit_where(np.ones(len(y), bool)), np.zeros(len(y))
    for k in range(FOLDS):
        held = fold == k
        # the only row of a class stays in training, as nothing could be learnt without it
        stays = ~held | np.isin(y, [label for label in (0, 1) if (y == label).sum() == 1])
        if held.any():
            raw[held] = raw_where(fit_where(stays), held)
    calibrate(model, raw, y)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A calibrated model from at most ``sample`` labelled rows of ``docs``, half of them of each class by
    hash, as long as the texts of a class have no more than half of ``sample_bytes``; the first of each
    class always counts.

    None, so that only the base rules decide, where the labels of ``docs``' rows are all of one class or there are none.
    """
    told = labels.select(F.col("doc_id").cast("bigint").alias("labelled"), F.col("quality").cast("int").alias("told"))
    agreed = told.where("told is not null and labelled is not null").groupBy("labelled").agg(F.min("told").alias("class"), F.max("told").alias("other"))
    known = docs.select(F.col("doc_id").cast("bigint").alias("labelled")).distinct()
    there = agreed.where("class = other").join(known, "labelled", "left_semi")
    halves = [there.where(F.col("class") == k).orderBy(F.xxhash64("labelled"), "labelled").limit(sample // 2).select("labelled", "class") for k in (0, 1)]
    # at most ``sample`` rows, so it may be broadcast
    picked = F.broadcast(halves[0].unionByName(halves[1]))
    own = docs.select(F.col("doc_id").cast("bigint").alias("labelled"), whole_text().alias("own_text"))
    # an id that repeats trains with one text, the one of least hash
    texts = own.join(picked, "labelled").groupBy("labelled", "class").agg(F.min_by("own_text", F.xxhash64("own_text")).alias("own_text"))
    texts = written(texts, "labelled-texts")
    size, order = F.octet_length("own_text"), (F.xxhash64("labelled"), F.col("labelled"))
    sizes = texts.select("labelled", "class", size.alias("size"))
    before = F.sum("size").over(Window.partitionBy("class").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    within = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") + F.col("size") <= sample_bytes // 2) | (F.col("before") == 0))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("own_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("labelled"), batch.column("class"), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())],
                ["labelled", "class", "buckets", "amounts"],
            )

    # rows and bytes of the sample have a bound, so its features may come to the driver
    chosen = texts.join(F.broadcast(within.select("labelled")), "labelled", "left_semi").select("labelled", "class", "own_text")
    found = chosen.mapInArrow(featured, "labelled bigint, class int, buckets binary, amounts binary").orderBy("labelled").collect()
    y = np.array([r["class"] for r in found], np.int64)
    if len({*y.tolist()}) < 2:
        return None
    return _fitted([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.amounts, np.float32)) for r in found], y)


SCORED = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, probability double"


def _judged(block: Block, model: Model | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    found = block.measures()
    failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED_PERCENT * found["n_words"])
    probability = model.probability(block) if model else np.ones(block.n)
    return list(found.values()), failed, ~failed & (probability >= LEAST_PROBABILITY), probability


def _blocks(texts: Iterator[str]) -> Iterator[list[str]]:
    block, filled = [], 0
    for text in texts:
        if block and filled + len(text) > BLOCK:
            yield block
            block, filled = [], 0
        block.append(text)
        filled += len(text)
    if block:
        yield block


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """The measures and the verdict of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            at = 0
            for texts in _blocks(t.as_py() or "" for t in batch.column("text")):
                measures, failed, kept, probability = _judged(Block(texts), model)
                ids = batch.column("doc_id").slice(at, len(texts))
                at += len(texts)
                arrays = [ids, *(pa.array(m.astype(np.int64)) for m in measures), pa.array(failed), pa.array(kept), pa.array(probability)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(judge, SCORED)


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def judge(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in texts:
            kept = [k for some in _blocks(t.as_py() or "" for t in batch.column("text").cast(pa.string())) for k in _judged(Block(some), model)[2].tolist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
