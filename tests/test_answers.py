import pytest
from pyspark.sql import functions as F

from vicinal.catalog import fixtures as X
from vicinal.catalog.queries import cases
from vicinal.functions.text import token_count
from vicinal.operators import answers as A
from vicinal.operators import fusion as FU
from vicinal.operators import prompts as P


@pytest.mark.parametrize(
    "raw, want",
    [
        ("MALWARE", 1), ("goodware.", 0), ("The file is Malware", 1), ("malware, malware", 1), ("goodware or malware", None),
        ("", None), ("  ", None), (None, None), ("antimalware tool", None), ("malware_x", None), ("émalware", None), ("GoodWare\n", 0),
    ],
)
def test_parse(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "raw string").select(A.parse_answer(F.col("raw"))).first()[0] == want


def consensus(spark, raws, **settings):
    rows = [(1, i, f"v{i}", raw) for i, raw in enumerate(raws)]
    df = spark.createDataFrame(rows, "query_id long, variant_no int, variant string, raw string")
    r = A.vote_consensus(df, variants=len(raws), **settings).first()
    return r["candidate"], r["consensus_votes"], r["unanimous"]


def test_consensus(spark):
    m, g = "malware", "goodware"
    assert consensus(spark, [m, m, m]) == (1, 3, True)
    assert consensus(spark, [m, g, m]) == (1, 2, False)
    assert consensus(spark, [m, "?", "?"]) == (None, 1, False)
    assert consensus(spark, ["?", "?", "?"]) == (None, 0, False)
    assert consensus(spark, [m, g]) == (None, 1, False)
    assert consensus(spark, [g]) == (0, 1, True)
    assert consensus(spark, [m, "?", "?"], minimum=0) == (1, 1, False)


def test_every_decision_branch(spark):
    rows = [
        (0, 1, None, False, "MV", FU.FALLBACK, False, 0),
        (1, 3, 1, True, "LLM", FU.AGREES, False, 1),
        (0, 1, 1, True, "LLM", FU.OVERRIDES, True, 1),
        (0, 3, 1, True, "MV", FU.RETAINED, False, 0),
        (0, 1, 1, False, "MV", FU.RETAINED, False, 0),
    ]
    for vote, margin, candidate, unanimous, kind, source, override, final in rows:
        df = spark.createDataFrame([(vote, margin, candidate, unanimous)], "v int, m int, c int, u boolean")
        columns = [F.col(c) for c in "vmcu"]
        r = df.select(FU.decide(*columns).alias("d")).first()["d"]
        assert (r["final"], r["pred_type"], r["decision_source"], r["override_applied"]) == (final, kind, source, override)
        r = df.select(FU.decide(*columns, always_override=True).alias("d")).first()["d"]
        want = (0, "MV", FU.FALLBACK, False) if candidate is None else (candidate, "LLM", FU.ALWAYS, True)
        assert (r["final"], r["pred_type"], r["decision_source"], r["override_applied"]) == want


@pytest.fixture(scope="module")
def prompt_cases(spark, sf_dir):
    few = cases(spark, sf_dir, 5).filter(F.col("query_id") % 50 == 0)  # a fixture, not a registered query
    return P.with_variants(few).cache()


@pytest.mark.parametrize("budget", [2048, 900, 620, 480])
def test_budget_equals_trying_every_text(prompt_cases, budget):
    columns = ["query_id", "variant_no", "n_examples", "n_features", "prompt", "prompt_tokens"]
    fast = P.fit_budget(prompt_cases, budget=budget).select(columns).orderBy("query_id", "variant_no").collect()
    slow = P.fit_budget_by_text(prompt_cases, token_count, budget=budget).select(columns)
    assert fast == slow.orderBy("query_id", "variant_no").collect()
    assert all(r["prompt_tokens"] <= budget for r in fast)


def test_priced_tokens_are_counted_tokens(prompt_cases):
    out = P.fit_budget(prompt_cases, budget=700).select("prompt_tokens", token_count(F.col("prompt")).alias("n"))
    assert out.filter("prompt_tokens <> n").count() == 0


def test_nothing_fits(prompt_cases):
    with pytest.raises(Exception, match="no prompt fits"):
        P.fit_budget(prompt_cases, budget=50).collect()


def test_prompt_text(prompt_cases):
    rows = {r["variant"]: r for r in P.fit_budget(prompt_cases).filter("query_id = 0").collect()}
    normal, flipped, compact = (rows[v]["prompt"] for v in ("normal", "reversed", "compact"))
    assert normal.startswith("SYSTEM: You are a binary classifier") and normal.endswith("GOODWARE or MALWARE.\nASSISTANT:")
    assert normal.count("\nExample ") == 5 and compact.count("\nExample ") == 3
    first = rows["normal"]["examples"][0]["head"]
    assert "Example 1: " + first in normal and "Example 5: " + first in flipped
    assert "DECISION RULES" in normal and "DECISION RULES" not in compact
    assert (rows["compact"]["n_examples"], rows["compact"]["n_features"], rows["compact"]["truncated"]) == (3, 3, False)


@pytest.mark.parametrize("count, names", [(0, 1), (1, 1), (2, 2), (3, 3), (9, 3)])
def test_number_of_variants(spark, count, names):
    assert P.with_variants(spark.range(2), count).count() == 2 * names


def test_model_must_answer_every_prompt(spark):
    def wrong_length():
        return lambda prompts: []

    df = spark.createDataFrame([(1, "p")], "query_id long, prompt string")
    with pytest.raises(Exception, match="different number"):
        A.answer_with(df, wrong_length).collect()


def test_answer_fixture_hits_every_answer(spark, sf_dir):
    assert X.answers(spark, sf_dir).select("raw").distinct().count() == len(X.RAW_ANSWERS)
