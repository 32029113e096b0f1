"""URL filters: rules by host and path, and a classifier for the URLs that no rule fits.

The classifier is a logistic regression on hashed character n-grams of host and path, trained
here from a small table of labelled URLs. Rules are Spark expressions.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule, and
the classifier, which has nothing to judge then, lets it pass; rows that repeat are judged alike; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import Block

GRAMS = (3, 4, 5)
BUCKETS = 1 << 16
#: Probability of an unwanted page from which a URL is blocked.
BLOCKED_FROM = 0.55

#: Words for the default table of labelled URLs: of unwanted pages; of others; and of others that
#: hold or resemble an unwanted one.
UNWANTED = """casino poker slots bets bet betting jackpot lottery roulette win winbig pills pharma viagra cialis diet slim adult porn
xxx sex escort webcam hot spam farm ads track tracker click clicks popunder cheap free bonus loan loans payday cash money rich crack
cracked warez keygen torrent torrents replica gambling gamble milf nude dating singles hookup followers traffic banner""".split()
WANTED = """news journal library museum school college science history garden kitchen travel weather sports music theatre cinema
health clinic council county river mountain harbour books poetry review archive forum wiki docs developer code data maps transport
energy nature birds physics chemistry biology language translation recipes photo design studio gallery radio charity blog shop
mobile open public city town village church hotel bakery farmers market bank university research institute press times post
daily weekly local world earth ocean forest animal family children parents teacher student doctor hospital law court police""".split()
HARD = """essex sussex middlesex specialist therapist scunthorpe betsy alphabet better abet tibet winter window windsor winery pillow pillar
caterpillars freedom freelance freestyle address adsorption roads tracks trackfield clicker cheapside cheddar lotus slotcar pokeweed
diets-research pharmacology adulthood analytics crackers moneta enrich cashmere loansome farming bonsai clickable""".split()
SYLLABLES = "ti on er an th in re st nd ou ble ea ly sh or wh tion en la de und el os men ver".split()
PLAIN_PATHS = ("/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "/{w}/{n}", "/{w}/index.html", "/", "", "/2019/{w}-{v}", "/a/{n}/{w}.php")

Labelled = list[tuple[str, int]]


def labelled_urls() -> Labelled:
    """(url, 1 if unwanted): a small table by rule. Both classes share the shapes of hosts and of paths,
    numbers and top-level domains, so only the words tell them apart; invented names count as wanted."""
    invented = ["".join(SYLLABLES[(k * k + f * k + f) % len(SYLLABLES)] for f in (0, 5, 11)[: 2 + k % 2]) for k in range(150)]
    invented += [2 * a + b for a, b in zip(SYLLABLES, SYLLABLES[5:] + SYLLABLES[:5], strict=True)]
    rows: Labelled = []
    for words, label in ((UNWANTED, 1), (WANTED + HARD + invented, 0)):
        for k, w in enumerate(words):
            v = words[(7 * k + 3) % len(words)]
            hosts = (f"{w}-{v}.example", f"www.{w}{v}", f"{w}{37 * k % 1000}", f"m.{w}.{invented[k % len(invented)]}", f"blog.{v}-{w}", f"{invented[(3 * k) % len(invented)]}.{w}")
            for j in range(6 if label else 3):
                host = hosts[(k + j) % len(hosts)]
                path = PLAIN_PATHS[(3 * k + j) % len(PLAIN_PATHS)]
                path = path.format(n=(37 * k + 911 * j) % 10000, w=w if j % 2 else invented[(k + j) % len(invented)], v=v)
                rows.append((f"{('http', 'https')[j % 2]}://{host}.{('com', 'net', 'org', 'info', 'biz')[(k + 2 * j) % 5]}{path}", label))
    return rows


def split_url(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    ends = [k for k in map(rest.find, "/?#") if k >= 0]
    host, rest = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    return "".join(c.lower() if c.isascii() else c for c in host), rest.split("#")[0].split("?")[0]


def _grams(texts: list[str], family: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    block = Block([f"^{t}$" if t else "" for t in texts])
    for n in GRAMS:
        hashes, stop = block.character_grams(n)
        yield block, ((hashes >> np.uint64(20)).astype(np.int64) * (2 * family + 1) + n) % BUCKETS, np.minimum(stop, len(hashes))


def _sums(values: np.ndarray, block: Block, stop: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[stop] - total[np.minimum(block.starts, stop)]


def _share(block: Block, stop: np.ndarray) -> np.ndarray:
    """What one n-gram of each text counts: by the root of their number, so that long URLs don't score larger."""
    return 1 / np.sqrt(np.maximum(stop - np.minimum(block.starts, stop), 1))


def raw_scores(weights: np.ndarray, bias: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    out = np.full(len(hosts), bias)
    for family, texts in enumerate((hosts, paths)):
        for block, bucket, stop in _grams(texts, family):
            out += _sums(weights[bucket], block, stop) * _share(block, stop)
    return out


@lru_cache(maxsize=4)
def train(table: tuple[tuple[str, int], ...], steps: int = 300, rate: float = 0.2, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logistic regression, classes weighted alike. A URL without host and path
    scores the bias."""
    split = [split_url(url) for url, _ in table]
    labels = np.array([label for _, label in table], float)
    index, row, value = [], [], []
    for family in (0, 1):
        for block, bucket, stop in _grams([s[family] for s in split], family):
            share = _share(block, stop)
            for k in range(block.n):
                own = bucket[min(block.starts[k], stop[k]) : stop[k]]
                index.append(own)
                row.append(np.full(len(own), k))
                value.append(np.full(len(own), share[k]))
    index, row, value = np.concatenate(index), np.concatenate(row), np.concatenate(value)
    class_share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    weights, bias, seen, seen_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, value * weights[index], len(labels)) + bias
        error = class_share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        slope = np.bincount(index, value * error[row], BUCKETS) + decay * weights
        seen += slope**2
        seen_bias += error.sum() ** 2
        weights -= rate * slope / np.sqrt(seen)
        bias -= 0.1 * error.sum() / np.sqrt(seen_bias)
    return weights, bias


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower()), F.regexp_extract(url, pattern, 2)


Rules = list[tuple[str, str]]  # (block or allow, host and path)


def by_rules(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict); null if none fits."""
    fits = []
    for verdict, rule in rules:
        rule_host, _, rule_path = rule.partition("/")
        inside = (host == rule_host) | host.endswith("." + rule_host)
        found = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(inside & path.startswith("/" + rule_path), found))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def judge(pages: DataFrame, rules: Rules, table: Labelled | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every URL."""
    weights, bias = train(tuple(labelled_urls() if table is None else table))
    weights = weights.astype(np.float32)

    @F.pandas_udf("double")
    def unwanted(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(raw_scores(weights, bias, hosts.tolist(), paths.tolist()), -30, 30))))

    host, path = host_and_path(F.col("url").cast("string"))
    split = pages.select(F.col("page_id").cast("bigint"), host.alias("host"), path.alias("path"))
    fit = split.withColumn("fit", by_rules(F.col("host"), F.col("path"), rules)).withColumn("unwanted", unwanted("host", "path"))
    told = F.concat("host", "path") != ""
    by_method = F.when(told & (F.col("unwanted") >= BLOCKED_FROM), "block").otherwise("allow")
    return fit.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_method).alias("verdict"), "unwanted")
