"""Answer store, distinct-text encoding, value counts, summaries, budgets under a tokenizer, evidence by block."""

import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vicinal.catalog import fixtures as X
from vicinal.catalog.queries import cases, letter_encoder, majority_reader
from vicinal.config import RunConfig
from vicinal.operators import prompts as P
from vicinal.operators.distinct_texts import embed_distinct, encode_distinct
from vicinal.operators.embed import pooled
from vicinal.operators.evidence import with_distance, with_distance_in_blocks
from vicinal.operators.knn import knn_join
from vicinal.operators.mutual_info import mutual_info, mutual_info_binned
from vicinal.operators.quantiles import Summary, bin_edges, mutual_info_sketched, rank_error
from vicinal.operators.token_fit import _together, fitting, message_text, plain_chat
from vicinal.plans.fused import budgeted_prompts, fused_classification
from vicinal.sources.answered import answer_stored, read_answers
from vicinal.sources.value_counts import append_counts, load_counts, save_counts, stored_binned_scores, stored_scores

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this folder on their path
ASK = dict(model="m", max_new_tokens=5)


def shouting():
    return lambda prompts: [p.upper() for p in prompts]


def breaking():
    def generate(prompts):
        if any(p == "p7" for p in prompts):
            raise RuntimeError("the model is gone")
        return [p.upper() for p in prompts]

    return generate


def test_answers_survive_a_broken_run(spark, tmp_path):
    path = str(tmp_path / "answers")
    prompts = spark.createDataFrame([(i, f"p{i % 20}") for i in range(60)] + [(60, None), (61, "")], "id long, prompt string")
    with pytest.raises(Exception, match="gone"):
        answer_stored(prompts, breaking, path, **ASK, wave_prompts=3)
    kept = read_answers(spark, path).count()
    assert 0 < kept < 21
    out, asked = answer_stored(prompts, shouting, path, **ASK, wave_prompts=3)
    assert asked == 21 - kept
    got = {r.id: r.raw for r in out.collect()}
    assert got == {i: f"P{i % 20}" for i in range(60)} | {60: None, 61: ""}
    assert answer_stored(prompts, breaking, path, **ASK)[1] == 0


def test_many_waves_are_few_jobs(spark, tmp_path):
    prompts, context = spark.range(60).selectExpr("id", "concat('q', id) AS prompt"), spark.sparkContext
    context.setJobGroup("waves", "answers in sixty waves")
    out, asked = answer_stored(prompts, shouting, str(tmp_path / "answers"), **ASK, wave_prompts=1)
    jobs = len(context.statusTracker().getJobIdsForGroup("waves"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert asked == 60 and {r.raw for r in out.collect()} == {f"Q{i}" for i in range(60)}
    assert jobs < 30


def test_answers_stay_when_a_later_task_fails(spark, tmp_path):
    path = str(tmp_path / "answers")

    def slow_to_break():
        def generate(prompts):
            if "p150" in prompts:
                import time

                time.sleep(5)
                raise RuntimeError("the model is gone")
            return [p.upper() for p in prompts]

        return generate

    prompts = spark.range(200).selectExpr("id", "concat('p', id) AS prompt")
    with pytest.raises(Exception, match="gone"):
        answer_stored(prompts, slow_to_break, path, **ASK, wave_prompts=100, batch_rows=1)
    kept = read_answers(spark, path).count()
    assert kept > 100
    assert answer_stored(prompts, shouting, path, **ASK)[1] == 200 - kept


def test_another_model_or_limit_asks_again(spark, tmp_path):
    path = str(tmp_path / "answers")
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    assert answer_stored(prompts, shouting, path, **ASK)[1] == 2
    assert answer_stored(prompts, shouting, path, model="m", max_new_tokens=6)[1] == 2
    assert answer_stored(prompts, shouting, path, model="m1", max_new_tokens=5)[1] == 2
    assert answer_stored(prompts.limit(0), shouting, path, **ASK)[1] == 0
    with pytest.raises(ValueError):
        answer_stored(prompts, shouting, path, model="", max_new_tokens=5)


def test_a_fused_run_with_a_store(spark, sf_dir, tmp_path):
    split, path = X.vector_split(spark, sf_dir), str(tmp_path / "answers")
    runs = [
        fused_classification(*split, X.VECTOR_NAMES, RunConfig(), make_generator=make, answer_store=path, model="m").select("prediction", "llm_raw_outputs")
        for make in (majority_reader, breaking)
    ]
    assert sorted(map(str, runs[0].collect())) == sorted(map(str, runs[1].collect()))


def test_each_text_is_encoded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        encode = letter_encoder()

        def run(texts):
            calls.add(len(texts))
            return encode(texts)

        return run

    rows = [(i, ["abc", f"only {i}", "hgf"][: 1 + i % 3], "k") for i in range(3000)]
    df = spark.createDataFrame(rows, "sample_id long, texts array<string>, kept string").repartition(5)
    out, encoded = embed_distinct(df, "texts", counting)
    got = {r.sample_id: r.vec for r in out.collect()}
    assert calls.value == encoded.texts == 2 + 2000 and encoded.references == 6000
    want = pooled(df, "texts", 8, letter_encoder).collect()
    assert len(got) == len(want) and all(np.allclose(got[r.sample_id], r.vec) for r in want)
    hot = encoded.vectors.where(F.col("n") > encoded.references // 1000).count()
    assert hot == 2  # these two go by broadcast


def test_blank_texts_are_refused(spark):
    for texts in (["a", " "], [None], []):
        df = spark.createDataFrame([(1, texts)], "sample_id long, texts array<string>")
        with pytest.raises(Exception, match="blank text"):
            embed_distinct(df, "texts", letter_encoder)
    nothing = spark.createDataFrame([], "sample_id long, texts array<string>")
    assert embed_distinct(nothing, "texts", letter_encoder)[0].count() == 0
    with pytest.raises(ValueError):
        encode_distinct(nothing, letter_encoder, "texts", 0)


def test_scores_follow_appended_counts(spark, sf_dir, tmp_path):
    rows, path = X.documents(spark, sf_dir), str(tmp_path / "counts")
    save_counts(rows.where("sample_id % 3 = 0"), path, X.DOCUMENT_NAMES, "s")
    first = stored_scores(spark, path).count()
    assert first == 5
    assert append_counts(rows.where("sample_id % 3 = 1"), path, "b") != append_counts(rows.where("sample_id % 3 = 2"), path, "c")
    whole = {r.feature: r.score for r in mutual_info(rows, X.DOCUMENT_NAMES).collect()}
    assert {r.feature: r.score for r in stored_scores(spark, path).collect()} == pytest.approx(whole)
    binned = {r.feature: r.score for r in mutual_info_binned(rows, X.DOCUMENT_NAMES).collect()}
    assert {r.feature: r.score for r in stored_binned_scores(spark, path).collect()} == pytest.approx(binned)
    assert load_counts(spark, path)[0].where("pos = 0").agg(F.sum("c")).first()[0] == rows.count()
    with pytest.raises(ValueError):
        append_counts(rows, path, "no/name")


@pytest.mark.parametrize("n,size", [(100, 512), (5000, 16), (5000, 64), (60_000, 512)])
def test_ranks_of_merged_summaries(n, size):
    rng = np.random.default_rng(n + size)
    values = np.where(rng.random(n) < 0.3, 1.5, rng.normal(size=n).round(2))
    parts = [Summary(size) for _ in range(7)]
    for i, chunk in enumerate(np.array_split(values, 50)):
        parts[i % 7].add(chunk)
    whole = Summary(size)
    for part in parts:
        for level, points in enumerate(part.levels):
            whole.add(points, level, part.odd[level])
    held, weights = whole.weighted()
    assert weights.sum() == n and all(len(level) <= size for level in whole.levels)
    at = np.unique(values)
    off = [abs(int(weights[held < v].sum()) - int((values < v).sum())) for v in at]
    assert max(off) <= rank_error(n, size)
    assert n <= size or max(off) < n / 4


def test_bins_within_the_bound(spark, sf_dir):
    rows = X.lines(spark, sf_dir).repartition(7)
    size, bins = 128, 10
    edges, n = bin_edges(rows, 5, bins, size=size)
    matrix = np.array([r.features for r in rows.select("features").collect()])
    assert n == len(matrix) and edges.shape == (5, bins - 1)
    for pos in range(5):
        for b, edge in enumerate(edges[pos], 1):
            below = (matrix[:, pos] < edge).sum()
            up_to = (matrix[:, pos] < matrix[matrix[:, pos] < edge, pos].max()).sum()  # one value less would be too few
            assert below >= b * n / bins - rank_error(n, size) and up_to <= b * n / bins + rank_error(n, size)
    plan = mutual_info_sketched(rows, X.LINE_NAMES, size=size)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pos") >= 1 and "v#" not in " ".join(re.findall(r"Exchange [^\n]*", plan))
    with pytest.raises(ValueError):
        mutual_info_sketched(rows.limit(0), X.LINE_NAMES)


def tokens_of(texts):
    """A counter that is not additive: words of up to five letters, and runs of three digits."""
    return [len(re.findall(r"[A-Za-z]{1,5}|\d{1,3}|\S", t)) for t in texts]


def test_budget_under_a_tokenizer_is_the_exhaustive_choice():
    draw = random.Random(2)
    for round_ in range(120):
        items = lambda: [f"name {draw.randint(0, 10 ** draw.randint(1, 9))}={draw.random():.4f}" for _ in range(20)]
        case = {
            "reverse": round_ % 3 == 1, "compact": round_ % 3 == 2, "summary": "s " * draw.randint(1, 30), "query_items": items(),
            "examples": [{"head": f"label={i} [", "items": items()} for i in range(draw.randint(1, 5))],
        }
        limit = 3 if case["compact"] else 99
        most, high = min(5, len(case["examples"]), limit), min(20, limit)

        def text_of(e, f):
            return plain_chat([{"role": "system", "content": P.SYSTEM_TEXT}, {"role": "user", "content": message_text(case, e, f)}])

        grid = [(e, f) for e in range(most, 0, -1) for f in range(high, 2, -1)]
        sizes = dict(zip(grid, tokens_of([text_of(*p) for p in grid])))
        budget = draw.randint(min(sizes.values()) - 40, max(sizes.values()) + 40)
        want = next((p for p in grid if sizes[p] <= budget), None)
        parts = {f"Example 1: {e['head']}]" for e in case["examples"]} | {i for e in case["examples"] for i in e["items"]} | {*case["query_items"]}
        cost = dict(zip(parts, tokens_of(list(parts))))
        [(found, asked)] = _together([fitting(case, text_of, cost, budget, most, (3, high))], tokens_of)
        assert (found and found[:2]) == want and asked <= 9
        assert found is None or found[2:] == (text_of(*want), sizes[want])


def test_python_prompts_equal_column_prompts(spark, sf_dir):
    some = cases(spark, sf_dir, 5)
    config = RunConfig(k=5, max_prompt_tokens=900)
    mine = budgeted_prompts(some, config, make_counter=lambda: lambda texts: [len(t) // 4 for t in texts])
    theirs = budgeted_prompts(some, config, count=lambda t: F.floor(F.length(t) / 4).cast("int"))
    key = ("query_id", "variant", "n_examples", "n_features", "prompt", "prompt_tokens")
    assert sorted(map(tuple, mine.select(*key).collect())) == sorted(map(tuple, theirs.select(*key).collect()))
    assert mine.agg(F.avg("counted")).first()[0] < 6
    with pytest.raises(Exception, match="no prompt fits"):
        budgeted_prompts(some, RunConfig(max_prompt_tokens=5), make_counter=lambda: lambda texts: [99] * len(texts)).collect()
    with pytest.raises(ValueError):
        budgeted_prompts(some, config, count=lambda t: F.length(t), make_counter=lambda: len)


def test_evidence_by_block_equals_the_join(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(rng.normal(size=(300, 6)))]
    index = spark.createDataFrame(rows, "sample_id long, raw array<float>, label int")
    queries = index.where("sample_id % 3 = 0").selectExpr("sample_id AS query_id", "raw")
    near = knn_join(queries.withColumnRenamed("raw", "vec"), index.withColumnRenamed("raw", "vec"), 3)
    near = near.withColumn("sample_id", F.when(F.col("rank") == 2, 7).otherwise(F.col("sample_id")))  # a hub
    got = with_distance_in_blocks(near, queries, index, block_bytes=4 * 6 * 20)
    want = with_distance(near, queries, index)
    assert "Join [sample_id" not in got._jdf.queryExecution().executedPlan().toString()
    rows = [Counter((r.query_id, r["rank"], r.sample_id, round(r.mean_abs_distance, 9), tuple(r.raw)) for r in df.collect()) for df in (got, want)]
    assert rows[0] == rows[1] and sum(rows[0].values()) == 300
    assert math.isclose(got.agg(F.min("mean_abs_distance")).first()[0], 0.0)


def test_a_scope_leaves_no_files(spark, sf_dir, tmp_path):
    from pathlib import Path

    from vicinal.catalog.queries import REGISTRY
    from vicinal.session import scratch_scope

    with scratch_scope(spark) as path:
        REGISTRY["index_append"](spark, sf_dir).write.parquet(str(tmp_path / "kept"))
        assert any(Path(path.removeprefix("file:")).rglob("*.parquet"))
    assert not Path(path.removeprefix("file:")).exists() and spark.read.parquet(str(tmp_path / "kept")).count() == 300
    with pytest.raises(RuntimeError):
        with scratch_scope(spark) as path:
            X.vectors(spark, sf_dir).write.parquet(f"{path}/rows")
            raise RuntimeError
    assert not Path(path.removeprefix("file:")).exists()


def test_looked_up_rows_come_in_small_blocks(spark, sf_dir, monkeypatch):
    from vicinal.operators import evidence as EV

    blocks, block_of = [], EV.block_of
    monkeypatch.setattr(EV, "block_of", lambda column, n: blocks.append(n) or block_of(column, n))
    monkeypatch.setattr(EV, "LOOKUP_ROWS", 50)
    queries, index = X.vector_sides(spark, sf_dir)
    found = knn_join(queries, index, 2)
    got, want = (fn(found, queries, index).select("query_id", "rank", F.round("mean_abs_distance", 9)) for fn in (with_distance_in_blocks, with_distance))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert blocks and set(blocks) == {-(-index.count() // 50)}
