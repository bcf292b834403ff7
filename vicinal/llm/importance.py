"""Importance resampling towards a target text: hashed word runs, an Aho-Corasick dictionary, and Gumbel scores.

Words are found by an automaton whose entries are distinct words with a delimiter on both sides. An entry carries the CRC-32
of the word and its length, and a scan emits these payloads only. The CRC of a run of words is composed from the payloads
of neighbours: a CRC is linear, so appending n bytes maps the CRC so far by a fixed 32 x 32 bit matrix per n.

A task starts without entries and takes up words that no entry covers and that a slice of texts holds more than once, up to
``DICTIONARY_WORDS``. Words that are not taken up are computed one by one, so the dictionary changes the speed and never the result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.rows import KEY, attach, keyed, slices
from vicinal.session import parallelism, stored

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
DICTIONARY_WORDS = 200_000
LONGEST_ENTRY = 64
"""bytes; longer words never enter the dictionary"""
SLICE_BYTES = 2 << 20

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _WORD[b] else 0x20 for b in range(256))
"""A-Z to a-z, every byte outside a word to a space"""
_POLYNOMIAL = 0xEDB88320
_SHIFTS: dict[int, np.ndarray] = {}


def _times(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The matrix with these 32 columns, over bits, applied to every value."""
    out = np.zeros(len(values), np.uint32)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def shift(n: int) -> np.ndarray:
    """Columns of the matrix that takes the CRC of a text to its share in the CRC of that text and ``n`` more bytes."""
    if n not in _SHIFTS:
        if n == 0:
            made = np.uint32(1) << np.arange(32, dtype=np.uint32)
        elif n == 1:
            made = np.uint32(1) << np.arange(32, dtype=np.uint32)
            for _ in range(8):
                made = np.where(made & np.uint32(1), (made >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), made >> np.uint32(1))
        else:
            half = shift(n // 2)
            made = _times(half, half)
            made = _times(shift(1), made) if n % 2 else made
        _SHIFTS[n] = made.astype(np.uint32)
    return _SHIFTS[n]


def joined_crc(before: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of ``before``, a space and the word with this CRC and length, each given as arrays."""
    out = np.empty(len(crc), np.uint32)
    spaced = _times(shift(1), before) ^ np.uint32(zlib.crc32(b" "))
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order], prepend=-1)) if len(order) else []
    for begin, end in zip(edges, [*edges[1:], len(order)]):
        at = order[begin:end]
        out[at] = _times(shift(int(length[at[0]])), spaced[at]) ^ crc[at]
    return out


class Dictionary:
    """Delimiter-bounded words with payloads (CRC, length) in an Aho-Corasick automaton."""

    def __init__(self, most: int = DICTIONARY_WORDS):
        self.most, self.automaton = most, ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.crc, self.length, self.ready = np.zeros(0, np.uint32), np.zeros(0, np.int64), False

    def learn(self, words: list[bytes], crc: np.ndarray, length: np.ndarray) -> None:
        taken = [i for i, w in enumerate(words) if len(w) <= LONGEST_ENTRY][: max(0, self.most - len(self.crc))]
        if taken:
            for n, i in enumerate(taken, len(self.crc)):
                self.automaton.add_word(f" {words[i].decode('latin-1')} ", n)
            self.crc, self.length = np.append(self.crc, crc[taken]), np.append(self.length, length[taken])
            self.automaton.make_automaton()
            self.ready = True

    def scan(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, CRC, length) of every word of a normalised text that begins and ends with a space, in order."""
        inside = _WORD[np.frombuffer(raw, np.uint8)]
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        crc, length = np.zeros(len(ends), np.uint32), np.zeros(len(ends), np.int64)
        open_ = np.ones(len(ends), bool)
        if self.ready:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(raw.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(ends, found[:, 0])
            crc[at], length[at], open_[at] = self.crc[found[:, 1]], self.length[found[:, 1]], False
        if open_.any():
            begins = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
            left = [raw[a:b] for a, b in zip(begins[open_].tolist(), ends[open_].tolist())]
            new = {w: n for n, w in enumerate(dict.fromkeys(left))}
            sums = np.array([zlib.crc32(w) for w in new], np.uint32)
            sizes = np.array([len(w) for w in new], np.int64)
            which = np.array([new[w] for w in left])
            crc[open_], length[open_] = sums[which], sizes[which]
            again = np.bincount(which) > 1
            self.learn([w for w, twice in zip(new, again.tolist()) if twice], sums[again], sizes[again])
        return ends, crc, length


def features(texts: list[bytes], known: Dictionary, runs: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words per text, and for runs of 1, 2, ... words the buckets and the numbers of their texts."""
    raw = (b" " + b" ".join(texts) + b" ").translate(_PLAIN)
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    ends, crc, length = known.scan(raw)
    text = np.searchsorted(starts, ends - 1, "right") - 1
    bucket, owner, so_far = [(crc % buckets).astype(np.int64)], [text], crc
    for n in range(2, runs + 1):
        so_far = joined_crc(so_far[:-1], crc[n - 1 :], length[n - 1 :]) if len(so_far) else so_far
        same = text[n - 1 :] == text[: max(0, len(text) - n + 1)]
        bucket.append((so_far[same] % buckets).astype(np.int64))
        owner.append(text[n - 1 :][same])
    return np.bincount(text, minlength=len(texts)), bucket, owner


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def _count(runs: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Dictionary(), np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            for found in features(_raw(batch.column("text")), known, runs, buckets)[1]:
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, text_col: str = "text", runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket. A task sends one row per bucket at most. Null texts have none."""
    rows = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_count(runs, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) by bucket; ``buckets`` numbers reach the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, to in ((source, s), (target, t)):
        for bucket, n in counts.collect():
            to[bucket] = n
    up, down = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * up / ((a + 1.0) * down))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def _weigh(gain: np.ndarray, runs: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary()
        for batch in slices(batches, "text", SLICE_BYTES):
            words, bucket, owner = features(_raw(batch.column("text")), known, runs, len(gain))
            n, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for b, o in zip(bucket, owner):
                n += np.bincount(o, minlength=len(words))
                np.add.at(weight, o, gain[b])
            made = [pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column(KEY), *made], names=["id", KEY, "n_words", "n_features", "weight"])

    return weigh


def noise(seed: int, id_col: str) -> Column:
    """-1000 times the logarithm of an exponential draw that the seed and the id decide; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place 1, 2, 3, ... in a total order, without one task that holds them all.

    Rows are cut into sorted ranges and written; a row's place is its place in its range and the rows in earlier ranges.
    Only the counts of the ranges, one per partition, meet in a window.
    """
    tasks = max(parallelism(rows.sparkSession), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    kept = stored(cut.withColumn("__place", F.monotonically_increasing_id()), "ranges")
    kept = kept.withColumn("__range", F.shiftright("__place", 33)).withColumn("__place", F.col("__place").bitwiseAND((1 << 33) - 1))
    earlier, found = 0, []
    for row in sorted(kept.groupBy("__range").count().collect()):
        found.append((row["__range"], earlier))
        earlier += row["count"]
    sums = rows.sparkSession.createDataFrame(found, "__range long, __before long")
    return kept.join(F.broadcast(sums), "__range").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__range", "__place", "__before")


def importance(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    runs: int = 1,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(id, __fp, n_words, n_features, weight, score, rank), one row per row of ``docs``.

    A document's weight is the sum of the gains of its runs of 1 to ``runs`` words; its score adds noise by id. Of the
    documents with ``least_words`` words or more, the ``percent`` of 100 with the highest scores have a rank, 1 for the
    highest, ties to the smaller id; all others have null. Null and empty texts have no features, weight 0 and no rank. A null id
    comes first among ties; rows that repeat an id and a text are ranked one after the other. An empty table gives
    an empty result, and an empty ``target`` gives gains that depend on ``docs`` alone. Extra columns do not matter.
    """
    gain = gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, text_col, runs, buckets), buckets)
    kind = dict(docs.dtypes)[id_col]
    found = keyed(docs, id_col, text_col).mapInArrow(_weigh(gain, runs), f"id {kind}, {KEY} long, n_words long, n_features long, weight long")
    found = found.withColumn("score", F.col("weight") + F.floor(noise(seed, "id")))
    scored = stored(found.withColumn("__row", F.monotonically_increasing_id()), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = ranked(able, [F.col("score").desc(), F.col("id").asc(), F.col(KEY).asc(), F.col("__row").asc()], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("__row")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, and weight, score and rank; settings and odd cases as in ``importance``.

    Rows that repeat an id and a text are one row of the result if one of them is drawn, with the best rank.
    """
    drawn = importance(docs, target, id_col, text_col, **settings).where("rank IS NOT NULL")
    best = drawn.groupBy("id", KEY).agg(F.max("weight").alias("weight"), F.max("score").alias("score"), F.min("rank").alias("rank"))
    rows = attach(docs, best, id_col, text_col).where("rank IS NOT NULL")
    return rows.dropDuplicates(["rank"])
