"""Exact copies, near copies, benchmark passages and repeats against brute force."""

from __future__ import annotations

import hashlib
import importlib
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from vicinal.llm.catalog import QUERIES, SQL
from vicinal.llm.components import components
from vicinal.llm.contamination import contamination, decontaminate, remove_spans
from vicinal.llm.exact import exact_dedup
from vicinal.llm.langid import identify
from vicinal.llm.neardup import near_components, near_dedup
from vicinal.llm.repeats import lengths, remove_repeats
from vicinal.llm.rows import single_rows

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS13 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = SPACED.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def linked(texts, percent=85):
    """Component of each place by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label, [len(s) for s in sets]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(QUERIES[name], SQL[name], spark, connect(sf_dir), sf_dir) is None


@pytest.mark.parametrize("block", [3, 4096])
def test_exact(odd_docs, block):
    got = exact_dedup(odd_docs, block_bytes=block).collect()
    texts = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    assert len(got) == len(texts)
    for r in got:
        ids = [i for i, t in texts if t == (r.text or "")]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    assert "text_sha256" in got[0].asDict()  # other columns are handed through


def test_exact_rows_that_repeat(odd_docs):
    kept = single_rows(exact_dedup(odd_docs).where("kept"), "doc_id", "repeats")
    assert Counter(r.text or "" for r in kept.collect()) == Counter({t or "": 1 for t in {r.text or "" for r in odd_docs.collect()}})


@pytest.fixture
def shared_ids(spark):
    """Two repeated texts under one id and under null, and near copies that share an id or have none."""
    story = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a"), (None, "a"), (None, "b"), (None, "b"), (5, "c"), (5, "c"), (5, "d"), (5, "d"), (6, None), (6, ""), (7, " ")]
    rows += [(None, story), (None, story + " x"), (None, story + " x"), (8, story.upper() + " Y W1"), (8, story + " z"), (None, "n " + story[::-1]), (None, "m " + story[::-1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_exact_keeps_each_text_of_an_id(shared_ids):
    kept = single_rows(exact_dedup(shared_ids).where("kept"), "doc_id", "repeats")
    assert Counter(r.text or "" for r in kept.collect()) == Counter({r.text or "": 1 for r in shared_ids.collect()})


def test_near_keeps_one_row_of_shared_and_missing_ids(shared_ids):
    got = [(r.doc_id, r.text or "") for r in near_dedup(shared_ids).collect()]
    assert sorted(t for _, t in got if len(t) < 2) == ["", " ", "a", "b", "c", "d"]
    assert sorted((i is None, len(t) > 100) for i, t in got if len(t) > 1) == [(False, True), (True, True)]


def test_exact_empty(no_docs):
    assert exact_dedup(no_docs).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 6)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_odd(odd_docs):
    rows = odd_docs.collect()
    label, sizes = linked([r.text for r in rows])
    smallest = {}
    for r, x in zip(rows, label):
        if r.doc_id is not None:
            smallest[x] = min(r.doc_id, smallest.get(x, r.doc_id))
    want = Counter((r.doc_id, n, smallest.get(x) if n else r.doc_id) for r, x, n in zip(rows, label, sizes))
    assert Counter((r.id, r.n_shingles, r.component_id) for r in near_components(odd_docs).collect()) == want


def test_near_chains_and_crowded_buckets(spark):
    """A hot group of edited copies, more than a chunk holds, and chains of small steps."""
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(300):
        words = list(base)
        words[(7 * i) % 120] = f"e{i}"
        if i % 3 == 0:
            words[(11 * i + 5) % 120] = f"f{i}"
        texts.append(" ".join(words))
    words = [f"c{i}" for i in range(100)]
    for i in range(12):
        words = words[1:] + [f"d{i}"]
        texts.append(" ".join(words))
    texts += [f"lonely {i} " + " ".join(f"l{i}_{k}" for k in range(i % 7)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label, _ = linked(texts)
    got = {r.id: r.component_id for r in near_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_near_dedup_keeps_one(odd_docs, no_docs):
    kept = near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8, 8, 9, 10, 11]
    assert near_dedup(no_docs).collect() == []


@pytest.mark.parametrize("module, makers, most", [("neardup", ["_sign", "_sets", "_confirm"], 1 << 20), ("langid", ["_likelihoods"], 1 << 20), ("exact", ["_cut"], 4 << 20)])
def test_workers_get_small_batches(spark, monkeypatch, module, makers, most):
    """300 pairs of near copies of 20 KB each, in one task."""
    long = [[f"w{i}x{k}" for k in range(2500)] for i in range(300)]
    texts = [(i, " ".join(w), "en", "h") for i, w in enumerate([*long, *[[*w[:-1], "other"] for w in long]])]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").coalesce(1)

    def watched(make):
        def made(*args):
            inner = make(*args)

            def run(batches):
                def small():
                    for batch in batches:
                        assert batch.nbytes < 1.5 * most, f"a batch of {batch.nbytes} bytes"
                        yield batch

                return inner(small())

            return run

        return made

    at = importlib.import_module(f"vicinal.llm.{module}")
    for maker in makers:
        monkeypatch.setattr(at, maker, watched(getattr(at, maker)))
    name, partitions = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set(name, "60m")
    try:
        jobs = {"neardup": near_components, "langid": lambda d: identify(d, np.zeros((4, 64))), "exact": exact_dedup}
        assert jobs[module](docs).count() == 600
        assert spark.conf.get(name) == "60m"  # as it was set before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset(name)


def test_contamination_odd(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Quick brown FOX"), (2, "fox"), (3, None), (4, " ... "), (5, "quick-brown fox"), (5, "zwei")], "item_id long, text string")
    got = contamination(odd_docs, items).collect()
    by = {(r.id, r.n_words): r for r in got}
    assert by[1, 12].n_hit == 3 and by[1, 12]["items"] == ["1", "2", "5"] and by[1, 12].contaminated
    assert by[8, 2].n_hit == 1 and by[4, 0].n_hit == 0 and not by[4, 0].contaminated
    assert sum(r.repeats for r in got) == odd_docs.count()
    clean = decontaminate(odd_docs, items)
    assert clean.columns == odd_docs.columns and 1 not in {r.doc_id for r in clean.collect()}
    spans = {r.doc_id: r.clean_words for r in remove_spans(odd_docs, items).collect()}
    assert spans[1] == "the jumps over the lazy dog and runs away".split()
    assert contamination(no_docs, items).collect() == []
    assert all(not r.contaminated for r in contamination(odd_docs, items.limit(0)).collect())


def test_contamination_large_benchmark(spark, sf_dir, monkeypatch):
    """A benchmark whose bit table is full, and whose numbers are not broadcast, gives the same result."""
    from vicinal.llm import contamination as C

    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    docs = docs.where("length(text) < 5000")
    want = sorted(map(str, contamination(docs, items).collect()))
    monkeypatch.setattr(C, "LEAST_BITS", 64)
    monkeypatch.setattr(C, "BITS_PER_WINDOW", 0)
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    assert sorted(map(str, contamination(docs, items).collect())) == want


def test_contamination_by_many_windows(spark, sf_dir):
    """200,000 windows: nothing but numbers is shuffled between the scan of the documents and the hits."""
    from vicinal.llm import contamination as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000")
    planted = docs.where("doc_id % 9 = 0").selectExpr("doc_id AS item_id", "text")
    filler = "array_join(transform(sequence(1, 412), i -> concat('w', cast(hash(id, i) AS string))), ' ') AS text"
    items = spark.range(500).selectExpr("id + 1000000 AS item_id", filler).unionByName(planted)
    numbers = C.window_numbers(C.benchmark_windows(items, "item_id", "text")).checkpoint()
    windows = numbers.count()
    assert windows > 200_000
    lengths = sorted(r.length for r in numbers.select("length").distinct().collect())
    hits = C.window_hits(docs, numbers, lengths, windows, "doc_id", "text")
    assert "gram" not in hits.columns and "text" not in hits.columns and "Exchange hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()
    texts = {r.doc_id: WORDS13.findall((r.text or "").translate(LOWER)) for r in docs.collect()}
    asked = set()
    for r in items.collect():
        words = WORDS13.findall((r.text or "").translate(LOWER))
        asked |= {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12))} if words else set()
    sizes = {len(g) for g in asked}
    want = {d: {(i + 1, n) for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in asked} for d, w in texts.items()}
    got = {d: set() for d in want}
    for r in hits.where("hit").collect():
        got[r.id].add((r.start, r.length))
    assert got == want and sum(map(len, want.values())) > 1000
    passed = C.scanned_windows(docs, "doc_id", "text", lengths, *C.bit_table(numbers, windows)).where("h IS NOT NULL").count()
    assert passed < 1.5 * sum(map(len, want.values())) + 0.1 * sum(len(w) for w in texts.values())


def repeats_by_hand(texts, window):
    words = [SPACED.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("window,shortest,limit", [(35, 9, None), (6, 2, None), (7, 2, 0), (5, 5, None)])
def test_repeats(spark, odd_docs, monkeypatch, window, shortest, limit):
    from vicinal.llm import repeats as R

    if limit is not None:
        monkeypatch.setattr(R, "BROADCAST_RUNS", limit)
    shared = " ".join(f"s{i}" for i in range(60))
    cut = shared.split()
    more = [shared, "a b c " + shared, " ".join(cut[5:50]) + " end", "tic tac " * 60, " ".join(cut[:30] + ["x"] + cut[30:]), "q " + " ".join(cut[20:])]
    more += [" ".join(f"s{(i * k) % 7}" for i in range(80)) for k in (1, 2, 3)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = [r.text for r in docs.collect()]
    got = Counter((r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs, window=window, shortest=shortest).collect())
    assert got == Counter(repeats_by_hand(texts, window))


def test_repeats_levels(no_docs):
    assert lengths(35, 9) == [9, 18, 35] and lengths(5, 9) == [5]
    assert remove_repeats(no_docs).collect() == []


def test_near_query_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    label, sizes = linked([r.text for r in docs])
    want = {(r.doc_id, n, docs[x].doc_id, x == i) for i, (r, x, n) in enumerate(zip(docs, label, sizes))}
    assert {tuple(r) for r in QUERIES["op3_near_dedup"](spark, sf_dir).collect()} == want


def test_stored_digest_is_of_the_text(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op1_exact_dedup"](spark, sf_dir).where(F.col("doc_id") < 20).collect():
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
