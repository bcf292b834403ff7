"""Importance resampling, shards and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.llm import importance as imp
from vicinal.llm.quantize import LARGEST, Masks, books_sha256, codebooks, compress, restore, usable
from vicinal.llm.shuffled import ROW_BYTES, sharded, write_shards

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def runs_of(text, runs):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return len(words), [b" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def brute_importance(rows, target, runs=1, buckets=10_000, percent=10, least=20, seed=2024):
    source, wanted = Counter(), Counter()
    for texts, to in (([t for _, t in rows], source), (target, wanted)):
        for text in texts:
            to.update(zlib.crc32(f) % buckets for f in runs_of(text, runs)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * (s + buckets) / ((source[b] + 1.0) * (t + buckets)))) for b in range(buckets)]
    scored = []
    for doc, text in rows:
        words, found = runs_of(text, runs)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    return scored, able[: len(able) * percent // 100]


@pytest.mark.parametrize("runs,percent", [(1, 10), (3, 50)])
def test_importance_equals_brute_force(spark, odd_docs, sf_dir, runs, percent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id > 20")
    docs = docs.unionByName(odd_docs.select("doc_id", "text"))
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [tuple(r) for r in docs.collect()]
    want, drawn = brute_importance(rows, [r.text for r in target.collect()], runs, percent=percent)
    got = imp.importance(docs, target, runs=runs, percent=percent).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    placed = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in placed] == list(range(1, len(drawn) + 1))
    assert [(r.id, r.score) for r in placed] == [(r[0], r[4]) for r in drawn]


def test_importance_of_nothing(spark, odd_docs, no_docs):
    assert imp.importance(no_docs, odd_docs).count() == 0
    assert imp.importance(odd_docs, no_docs).where("weight IS NULL").count() == 0
    drawn = imp.importance_resample(odd_docs, no_docs, percent=100)
    assert drawn.count() == 2 and set(odd_docs.columns) < set(drawn.columns)  # 1 and 2 are too short, 5 and 6 are long


@pytest.mark.parametrize("most", [0, 3, 200_000])
def test_dictionary_never_changes_the_result(most):
    texts = [b"One two two three 12a", b"", "été ÉTÉ  two\nx".encode(), b"q" * 100 + b" one", b"...", b"two", b"\x00a\x7fb"]
    known = imp.Dictionary(most)
    for _ in range(3):
        words, buckets, owners = imp.features(texts, known, 4, 1009)
        got = Counter((o, b) for bs, os in zip(buckets, owners) for b, o in zip(bs.tolist(), os.tolist()))
        want = Counter((i, zlib.crc32(f) % 1009) for i, t in enumerate(texts) for f in runs_of(t.decode(), 4)[1])
        assert got == want and words.tolist() == [runs_of(t.decode(), 1)[0] for t in texts]
    assert len(known.crc) <= most


def test_rank_is_global(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 AS score")
    got = imp.ranked(rows, [F.col("score").desc(), F.col("id")], "place").collect()
    want = sorted(got, key=lambda r: (-r.score, r.id))
    assert [r.place for r in want] == list(range(1, 5001))


def check_shards(rows, shards):
    counts = Counter(r.shard for r in rows)
    sizes = [counts[s] for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


@pytest.mark.parametrize("bucket_rows", [16, 1 << 16])
def test_shards(spark, sf_dir, odd_docs, bucket_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = sharded(docs, ["doc_id"], shards=7, bucket_rows=bucket_rows).collect()
    check_shards(rows, 7)
    want = Counter((r.doc_id, len((r.text or "").encode()) + ROW_BYTES, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_shards_are_a_uniform_order(spark):
    """Places of numbered rows have no trend, and neighbours of the input are apart; equal rows spread over all shards."""
    docs = spark.range(0, 20_000, 1, 4).selectExpr("id AS doc_id", "'same text' AS text")
    rows = sharded(docs, ["doc_id"], shards=10, bucket_rows=1000).collect()
    check_shards(rows, 10)
    place = np.empty(20_000)
    for r in rows:
        place[r.doc_id] = r.shard * 2000 + r.slot
    assert abs(np.corrcoef(np.arange(20_000), place)[0, 1]) < 0.04
    assert abs(np.corrcoef(place[:-1], place[1:])[0, 1]) < 0.04
    cells = np.histogram2d(np.arange(20_000), place, bins=10)[0]
    assert ((cells - 200) ** 2 / 200).sum() < 140  # 81 degrees of freedom
    again = sharded(docs, ["doc_id"], shards=10, bucket_rows=1000, seed=1).collect()
    assert sum(r.shard * 2000 + r.slot == place[r.doc_id] for r in again) < 20


def test_shards_of_few_rows(spark, odd_docs, no_docs):
    assert sharded(no_docs, ["doc_id"]).count() == 0
    check_shards(sharded(odd_docs, odd_docs.columns).collect(), 40)
    with pytest.raises(ValueError):
        sharded(odd_docs, ["doc_id"], shards=0)


def test_shards_use_column_functions_only(spark, odd_docs):
    plan = sharded(odd_docs, ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_written_shards(spark, odd_docs, tmp_path):
    write_shards(odd_docs, str(tmp_path / "out"), shards=3, bucket_rows=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    check_shards(back.collect(), 3)
    assert Counter(map(str, back.select(odd_docs.columns).collect())) == Counter(map(str, odd_docs.collect()))


@pytest.mark.parametrize("entries,dims,spread", [(256, 16, 400), (100, 3, 5), (1, 4, 10), (64, 1, 3), (65, 2, 1000)])
def test_masks_find_the_nearest_entry(entries, dims, spread):
    rng = np.random.default_rng(entries)
    book, x = rng.integers(-spread, spread, (entries, dims)), rng.integers(-2 * spread, 2 * spread, (500, dims))
    x[:50] = book[rng.integers(0, entries, 50)]
    apart = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    found, least = Masks(book).nearest(x)
    assert found.tolist() == apart.argmin(axis=1).tolist() and least.tolist() == apart.min(axis=1).tolist()


def test_masks_leave_exact_candidates():
    rng = np.random.default_rng(3)
    book, x, radius = rng.integers(-50, 50, (130, 5)), rng.integers(-50, 50, (40, 5)), rng.integers(0, 60, 40)
    want = (np.abs(x[:, None] - book[None]) <= radius[:, None, None]).all(axis=2)
    assert (Masks(book).candidates(x, radius) == want).all() and 0 < want.mean() < 0.5


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 0.3, 8)], i % 3, "x") for i in range(60)]
    rows += [(7, rows[7][1], None, None), (7, rows[8][1], None, None), (None, rows[9][1], 1, None), (61, None, 1, "x"), (62, [], 1, "x")]
    rows += [(63, [0.1] * 7 + [None], 2, "x"), (64, [0.1] * 7 + [math.inf], 2, "x"), (65, [math.nan] + [0.1] * 7, 2, "x"), (66, [0.0] * 4, 0, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")


def brute_codes(rows, parts, entries, rounds):
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    dims = len(ints[0]) // parts
    cut = [[v[p * dims : (p + 1) * dims] for p in range(parts)] for v in ints]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            apart = [[sum((a - b) ** 2 for a, b in zip(c[p], e)) for e in books[p]] for p in range(parts)]
            out.append([(d.index(min(d)), min(d)) for d in apart])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][0] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    flat = [x for p in books for e in p for x in e]
    return [("".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f)) for f in found], hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


@pytest.mark.parametrize("entries", [10, 256])
def test_codes_equal_brute_force(spark, odd_vectors, entries):
    kept = [(r.vec_id, r.embedding, r.label) for r in odd_vectors.collect() if r.embedding and len(r.embedding) == 8]
    kept = [r for r in kept if all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    codes, digest = brute_codes(kept, 4, entries, 4)
    errors = Counter()
    for (_, _, label), (_, error) in zip(kept, codes):
        errors[label] += error
    got = compress(odd_vectors, entries=entries).collect()
    want = Counter((r[0], r[2], c, e, errors[r[2]], digest) for r, (c, e) in zip(kept, codes))
    assert Counter((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want


def test_codes_restore_their_entries(spark, odd_vectors):
    rows = usable(odd_vectors, "vec_id", "embedding")
    books = codebooks(rows, entries=16)
    found = compress(odd_vectors, entries=16)
    back = restore(found, books).where("vec_id = 3").first()
    want = [v / 1024 for p in range(4) for v in books[p][int(back.code[2 * p : 2 * p + 2], 16)].tolist()]
    assert back.restored == want and back.codebooks_sha256 == books_sha256(books)
    vector = rows.where("id = 3").first().vec
    assert sum((math.floor(1024 * a) - 1024 * b) ** 2 for a, b in zip(vector, back.restored)) == back.error


def test_codes_of_odd_tables(spark, odd_vectors):
    assert compress(odd_vectors.limit(0)).count() == 0
    assert compress(odd_vectors.where("vec_id >= 61 AND vec_id < 66")).count() == 0
    with pytest.raises(ValueError):
        compress(odd_vectors, parts=3).count()
    large = spark.createDataFrame([(1, [float(LARGEST)] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        compress(large).count()
