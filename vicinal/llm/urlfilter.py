"""URL filter: rules by host and path, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm import words as W

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (3, 4, 5)
DIMENSIONS = 1 << 16
#: A labelled table is small by definition; a larger one is refused, since it is fitted in the driver.
MOST_LABELLED = 100_000
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

# Words of hosts to block and words that go with them, words of ordinary hosts, syllables of made-up names, and what
# stands around either kind.
BLOCKED_WORDS = (
    "casino bets pills viagra adult porn cams spam ads track click loans replica jackpot poker slots escorts payday warez crack keygen torrent"
    " gambling betting meds diet"
).split()
BLOCKED_WITH = "win free cheap x farm online best royal now bonus daily deals discount live hot easy quick super top vip".split()
ORDINARY_WORDS = (
    "news garden museum library university river weather recipes school history theatre railway health science music travel council market"
    " archive physics bakery village harbour letters kitchen winter orchard bridge chess language"
).split()
SYLLABLES = "th er on an in re ti es or te of ed is it al ar st to nt ng se ha as ou le nd en at sh wh ly ion ble ing".split()
PREFIXES, ENDINGS = ("", "www.", "m.", "blog.", "shop."), (".test", ".com", ".example.org", ".net", ".example.com", ".org", ".example.net")
PATHS = ("/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}?page=2", "/", "/{n}#top", "/post/{n}", "/en/{n}?id=7", "")
LABELLED_ROWS = 720


def labelled_urls(rows: int = LABELLED_ROWS) -> list[tuple[str, int]]:
    """Labelled addresses the production filter is trained on: (url, 1 to block), as many of either kind.

    Only the name of the host tells the kinds apart; scheme, prefix, ending and path run through all their forms in both.
    """
    out = []
    for n in range(rows):
        turn, block = n // 2, n % 2
        if block:
            word, other = BLOCKED_WORDS[turn % len(BLOCKED_WORDS)], BLOCKED_WITH[turn * 7 // 3 % len(BLOCKED_WITH)]
            name = (f"{word}-{other}", f"{other}-{word}", f"{other}{word}", f"{word}-{BLOCKED_WORDS[(turn * 5 + 3) % len(BLOCKED_WORDS)]}")[turn % 4]
        elif turn % 3:
            parts = [SYLLABLES[(turn * k + turn // k) % len(SYLLABLES)] for k in (3, 5, 7, 11)[: 2 + turn % 3]]
            name = "".join(parts)
        else:
            word, other = ORDINARY_WORDS[turn % len(ORDINARY_WORDS)], ORDINARY_WORDS[(turn * 11 + 4) % len(ORDINARY_WORDS)]
            name = (f"{word}-{other}", word, f"{word}{other}")[turn // 3 % 3]
        around = PREFIXES[turn % len(PREFIXES)], ENDINGS[turn // 2 % len(ENDINGS)], PATHS[turn // 3 % len(PATHS)].format(n=turn * 37 % 9000)
        out.append((f"{('http', 'https')[turn // 5 % 2]}://{around[0]}{name}{around[1]}{around[2]}", block))
    return out


LABELLED = labelled_urls()


def address(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url. Both are empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits: its host or a subdomain, and a path that begins with the rule's. Else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted({r for _, r in rules}, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def _features(hosts: Sequence[str], paths: Sequence[str], grams: Sequence[int], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): hashed n-grams of ``^host$`` and ``^path$``, apart from each other, once per row."""
    rows, features = [], []
    for part, values in enumerate((hosts, paths)):
        data = [b"^" + v.encode() + b"$" for v in values]
        size = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        owner, left = np.repeat(np.arange(len(data)), size), np.repeat(np.cumsum(size), size) - np.arange(len(raw))
        for n in grams:
            if len(raw) < n:
                continue
            inside = left[: len(raw) - n + 1] >= n
            hashed = W.windows(raw, n, W.BASE + 2 * part)[inside]
            rows.append(owner[: len(raw) - n + 1][inside])
            features.append((hashed % np.uint64(dimensions)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(rows) * dimensions + np.concatenate(features))
    return both // dimensions, both % dimensions


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", grams: Sequence[int] = GRAMS, dimensions: int = DIMENSIONS, steps: int = 300, rate: float = 1.0, penalty: float = 1e-3) -> np.ndarray:
    """Weights and, last, the intercept. Rows without a url or a label are left out; the fit is the same in every run."""
    host, path = address(F.col(url_col))
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(host.alias("h"), path.alias("p"), F.col(label_col).cast("double").alias("y"))
    data = sorted(tuple(r) for r in rows.limit(MOST_LABELLED + 1).collect())
    if len(data) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled addresses")
    weights = np.zeros(dimensions + 1)
    if not data:
        return weights
    row, feature = _features([d[0] for d in data], [d[1] for d in data], grams, dimensions)
    y = np.array([d[2] for d in data])
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    for _ in range(steps):
        score = np.bincount(row, weights[feature], len(y)) * scale + weights[-1]
        error = 1 / (1 + np.exp(-score)) - y
        weights[:-1] -= rate * (np.bincount(feature, (error * scale)[row], dimensions) + penalty * weights[:-1])
        weights[-1] -= rate * error.mean()
    return weights


def _score(weights: np.ndarray, grams: Sequence[int]):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            row, feature = _features(hosts.to_pylist(), paths.to_pylist(), grams, len(weights) - 1)
            scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))
            yield pa.array(1 / (1 + np.exp(-(np.bincount(row, weights[row * 0 + feature], len(hosts)) * scale + weights[-1]))))

    return score


def url_verdicts(pages: DataFrame, weights: np.ndarray, rules: Sequence[tuple[str, str]], url_col: str = "url", grams: Sequence[int] = GRAMS, threshold: float = 0.5) -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule, score and verdict.

    The verdict is the longest rule's, and without one ``block`` where the regression's score reaches the threshold. A url
    without ``://``, also null, has an empty host and path and is scored as such. Every row is judged by itself, so
    repeated rows agree; an empty table gives an empty result; a column named like a result is replaced.
    """

    @F.arrow_udf("double")
    def score(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _score(weights, grams)(parts)

    host, path = address(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    named = pages.select(*kept, host.alias("host"), path.alias("path"))
    named = named.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), score("host", "path").alias("score"))
    says = reduce(lambda done, r: F.when(F.col("rule") == r[1], r[0]).otherwise(done), rules, F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return named.withColumn("verdict", says)
