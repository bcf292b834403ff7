"""Prompt texts within a token budget, for all queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.functions import text as X
from vicinal.functions.vectors import let
from vicinal.operators.labels import label_name

# The prompt variants as (name, examples reversed, compact).
VARIANTS = [
    ("normal", False, False),
    ("reversed", True, False),
    ("compact", False, True),
]
COMPACT_LIMIT = 3  # most examples and features in a compact prompt

# The wording of the prompts.
SYSTEM_TEXT = (
    "You are a binary classifier for Windows PE files.\n"
    "The class meanings are fixed and must never be inverted:\n"
    "- GOODWARE means benign, clean, or safe software.\n"
    "- MALWARE means malicious or harmful software.\n"
    "Use only the retrieved numerical evidence supplied by the user.\n"
    "Cosine similarity closer to 1 indicates a more similar example.\n"
    "A smaller mean absolute standardized-feature distance indicates a closer example.\n"
    "Return exactly one word: GOODWARE or MALWARE."
)
RULES_TEXT = (
    "DECISION RULES:\n"
    "- Preserve the fixed GOODWARE/MALWARE meanings.\n"
    "- Consider all-neighbor label agreement.\n"
    "- Give more importance to higher cosine similarity.\n"
    "- Use full-vector distance as supporting evidence.\n"
    "- Do not infer a class from the cybersecurity topic alone.\n"
    "\n"
)
SUMMARY_TITLE = "RETRIEVAL SUMMARY OVER ALL NEIGHBORS:"
EXAMPLES_TITLE = "LABELED RETRIEVED EXAMPLES:"
COMPACT_EXAMPLES_TITLE = "CLOSEST LABELED EXAMPLES:"
QUERY_TITLE = "UNLABELED QUERY:"
CLOSING_TEXT = "Classify the query from the retrieved evidence.\nAnswer with exactly GOODWARE or MALWARE."
ITEM_SEPARATOR = ", "

Counter = Callable[[Column], Column]
#: A chat template: from an array of (role, content) to the text the model reads.
Template = Callable[[Column], Column]


def variant_rows(count: int) -> Column:
    """Literal array of the first variants, at least one."""
    chosen = VARIANTS[: max(1, min(count, len(VARIANTS)))]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("variant_no"),
                F.lit(name).alias("variant"),
                F.lit(reverse).alias("reverse"),
                F.lit(compact).alias("compact"),
            )
            for i, (name, reverse, compact) in enumerate(chosen)
        ]
    )


def with_variants(cases: DataFrame, count: int = 3) -> DataFrame:
    return cases.withColumn("__variant", F.explode(variant_rows(count))).select("*", "__variant.*").drop("__variant")


def summary_text() -> Column:
    """Evidence block from the columns of ``neighbor_evidence``."""

    def big(c: str) -> Column:
        return F.upper(label_name(F.col(c)))

    return F.concat_ws(
        "\n",
        F.lit(SUMMARY_TITLE),
        F.concat(F.lit("- GOODWARE count: "), F.col("votes_0")),
        F.concat(F.lit("- MALWARE count: "), F.col("votes_1")),
        F.concat(F.lit("- Label-count majority: "), big("majority")),
        F.concat(F.lit("- Mean GOODWARE cosine similarity: "), X.fixed(F.col("mean_similarity_0"), 4, signed=True)),
        F.concat(F.lit("- Mean MALWARE cosine similarity: "), X.fixed(F.col("mean_similarity_1"), 4, signed=True)),
        F.concat(F.lit("- Weighted GOODWARE evidence: "), X.fixed(F.col("weight_0"), 4)),
        F.concat(F.lit("- Weighted MALWARE evidence: "), X.fixed(F.col("weight_1"), 4)),
        F.concat(F.lit("- Closest-neighbor class: "), big("nearest_label")),
    )


def user_text(n_examples: Column, n_features: Column, summary: Column | None = None) -> Column:
    """User message with that many examples and displayed features."""
    compact = F.col("compact")
    shown = F.slice(F.col("examples"), 1, n_examples)
    shown = F.when(F.col("reverse"), F.reverse(shown)).otherwise(shown)
    lines = F.transform(
        shown,
        lambda e, i: F.concat(
            F.lit("Example "),
            (i + 1).cast("string"),
            F.lit(": "),
            e["head"],
            F.array_join(F.slice(e["items"], 1, n_features), ITEM_SEPARATOR),
            F.lit("]"),
        ),
    )
    return F.concat(
        F.when(compact, F.lit("")).otherwise(F.lit(RULES_TEXT)),
        summary_text() if summary is None else summary,
        F.lit("\n\n"),
        F.when(compact, F.lit(COMPACT_EXAMPLES_TITLE)).otherwise(F.lit(EXAMPLES_TITLE)),
        F.lit("\n"),
        F.array_join(F.concat(lines, F.array(F.lit(""), F.lit(QUERY_TITLE))), "\n"),
        F.lit("\ndisplayed_features=["),
        F.array_join(F.slice(F.col("query_items"), 1, n_features), ITEM_SEPARATOR),
        F.lit("]\n\n" + CLOSING_TEXT),
    )


def messages(user: Column) -> Column:
    """Chat form: array of (role, content)."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_TEXT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def render(chat: Column) -> Column:
    """Plain rendering of a chat, used where the model brings no template of its own."""
    parts = F.transform(chat, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\nASSISTANT:"))


def _limits(compact: Column, value: Column) -> Column:
    return F.when(compact, F.least(value, F.lit(COMPACT_LIMIT))).otherwise(value)


def fit_budget(
    cases: DataFrame,
    *,
    budget: int = 2048,
    max_examples: int = 5,
    max_features: int = 20,
    min_features: int = 3,
    count: Counter = X.token_count,
) -> DataFrame:
    """Largest prompt that fits, per query and variant.

    Order of preference: most examples first, then most features. Token costs add up over the parts of
    a prompt, so every combination is priced from a handful of counts instead of building its text.
    ``count`` must be additive over parts separated by blanks and punctuation, as the default is; for
    any other counter use ``fit_budget_by_text``.

    Adds n_examples, n_features, prompt, prompt_tokens, neighbor_tokens, truncated.
    """

    def prefix_costs(items: Column) -> Column:
        # cost of the first 1..n items, with the separators between them
        return let(
            F.transform(items, lambda item: count(item)),
            lambda costs: F.transform(
                F.sequence(F.lit(1), F.size(costs)),
                lambda n: F.aggregate(F.slice(costs, 1, n), F.lit(0), lambda a, c: a + c) + n - 1,
            ),
        )

    priced = cases.withColumn(
        "__costs",
        F.struct(
            F.transform(
                F.col("examples"),
                lambda e: F.struct(
                    count(F.concat(F.lit("Example 1: "), e["head"], F.lit("]"))).alias("head"),
                    prefix_costs(e["items"]).alias("items"),
                ),
            ).alias("examples"),
            prefix_costs(F.col("query_items")).alias("query"),
            count(render(messages(user_text(F.lit(0), F.lit(0))))).alias("base"),
        ),
    )

    def upto(prefix: Column, n: Column) -> Column:
        return F.element_at(prefix, F.least(n, F.size(prefix)))

    compact = F.col("compact")

    def price(costs: Column, e: Column, f: Column) -> Column:
        shown_e, shown_f = _limits(compact, e), _limits(compact, f)
        examples = F.aggregate(
            F.slice(costs["examples"], 1, shown_e),
            F.lit(0),
            lambda acc, x: acc + x["head"] + upto(x["items"], shown_f),
        )
        return F.struct(
            shown_e.alias("n_examples"),
            shown_f.alias("n_features"),
            examples.alias("neighbor_tokens"),
            (costs["base"] + examples + upto(costs["query"], shown_f)).alias("tokens"),
            ((shown_e < _limits(compact, F.least(F.lit(max_examples), F.size(costs["examples"]))))
             | (shown_f < _limits(compact, F.lit(max_features)))).alias("truncated"),
        )

    candidates = let(
        F.col("__costs"),
        lambda costs: F.flatten(
            F.transform(
                F.sequence(F.least(F.lit(max_examples), F.size(costs["examples"])), F.lit(1), F.lit(-1)),
                lambda e: F.transform(
                    F.sequence(F.lit(max_features), F.lit(min_features), F.lit(-1)), lambda f: price(costs, e, f)
                ),
            )
        ),
    )
    fitting = F.filter(candidates, lambda c: c["tokens"] <= budget)
    chosen = F.coalesce(
        F.get(fitting, F.lit(0)), F.raise_error(F.lit(f"no prompt fits into {budget} tokens"))
    )
    fitted = priced.withColumn("__fit", chosen).select("*", "__fit.*").drop("__fit", "__costs")
    return (
        fitted.withColumn("prompt", render(messages(user_text(F.col("n_examples"), F.col("n_features")))))
        .withColumnRenamed("tokens", "prompt_tokens")
    )


def fit_budget_by_text(
    cases: DataFrame,
    count: Counter,
    *,
    budget: int = 2048,
    max_examples: int = 5,
    max_features: int = 20,
    min_features: int = 3,
    query_id: str = "query_id",
    template: Template = render,
) -> DataFrame:
    """The same choice with any counter, a pandas UDF around a tokenizer for instance, and any chat template.

    Builds the text of every combination of examples and features, so it costs more by that factor.
    (query_id, variant_no, variant, n_examples, n_features, prompt, prompt_tokens)
    """
    compact = F.col("compact")
    grid = F.flatten(
        F.transform(
            F.sequence(F.least(F.lit(max_examples), F.size("examples")), F.lit(1), F.lit(-1)),
            lambda e: F.transform(
                F.sequence(F.lit(max_features), F.lit(min_features), F.lit(-1)),
                lambda f: F.struct(e.alias("e"), f.alias("f")),
            ),
        )
    )
    options = cases.select("*", F.posexplode_outer(grid).alias("__no", "__pair"))
    options = options.withColumn("n_examples", _limits(compact, F.col("__pair.e"))).withColumn(
        "n_features", _limits(compact, F.col("__pair.f"))
    )
    texts = options.withColumn("prompt", template(messages(user_text(F.col("n_examples"), F.col("n_features")))))
    counted = texts.select(
        query_id, "variant_no", "variant", "__no", "n_examples", "n_features", "prompt",
        count(F.col("prompt")).alias("prompt_tokens"),
    )
    fits = F.when(F.col("prompt_tokens") <= budget, F.col("__no"))
    best = counted.groupBy(query_id, "variant_no", "variant").agg(
        F.min_by(F.struct("n_examples", "n_features", "prompt", "prompt_tokens"), fits).alias("b")
    )
    checked = F.coalesce(F.col("b"), F.raise_error(F.lit(f"no prompt fits into {budget} tokens")))
    return best.withColumn("b", checked).select(query_id, "variant_no", "variant", "b.*")
