"""Label rows by the vote and by a model that sees the neighbours, and combine both."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.config import RunConfig
from vicinal.functions.text import display_labels, token_count
from vicinal.operators.answers import Generator, answer_with, vote_consensus
from vicinal.operators.embed import Encoder
from vicinal.operators.evidence import neighbor_evidence, prompt_examples, with_distance_in_blocks
from vicinal.operators.fusion import fuse, result_rows
from vicinal.operators.token_fit import ChatTemplate, TokenCounter, fit_budget_counted, plain_chat
from vicinal.operators.prompts import Counter, Template, fit_budget, fit_budget_by_text, render, with_variants
from vicinal.operators.search import nearest
from vicinal.operators.vote import neighbor_lists
from vicinal.plans.classify import as_queries, prepare, require_neighbors, with_vectors
from vicinal.session import materialize
from vicinal.sources.answered import answer_stored


def prompt_cases(
    neighbors: DataFrame, queries: DataFrame, index: DataFrame, names: Sequence[str], descriptions: dict[str, str], config: RunConfig
) -> DataFrame:
    """Per query: evidence, examples and the displayed query, all that a prompt needs."""
    shown = neighbors.filter(F.col("rank") <= config.max_examples)
    raw = with_distance_in_blocks(shown, queries.select("query_id", "raw"), index.select("sample_id", "raw"))
    examples = prompt_examples(
        raw,
        display_labels(list(names), descriptions),
        max_examples=config.max_examples,
        max_features=config.max_features,
    )
    return neighbor_evidence(neighbors).join(examples, "query_id")


def budgeted_prompts(
    cases: DataFrame,
    config: RunConfig,
    count: Counter | None = None,
    template: Template | None = None,
    make_counter: Callable[[], TokenCounter] | None = None,
    chat: ChatTemplate | None = None,
) -> DataFrame:
    """The largest prompts that fit.

    A caller's tokenizer (``make_counter``, ``chat``: Python functions) counts few whole texts per case; a token counter or chat template
    made of column functions (``count``, ``template``) prices every combination.
    """
    if (count or template) and (make_counter or chat):
        raise ValueError("give column functions or Python functions, not both")
    limits = dict(
        budget=config.max_prompt_tokens,
        max_examples=config.max_examples,
        max_features=config.max_features,
        min_features=config.min_features,
    )
    variants = with_variants(cases, config.prompt_variants)
    if make_counter is not None:
        return fit_budget_counted(variants, make_counter, chat=chat or plain_chat, **limits)
    if chat is not None:
        raise ValueError("a chat template needs the tokenizer that counts its texts")
    if count is None and template is None:
        return fit_budget(variants, **limits)
    return fit_budget_by_text(variants, count or token_count, template=template or render, **limits)


def fused_classification(
    train: DataFrame,
    test: DataFrame,
    names: Sequence[str],
    config: RunConfig,
    *,
    answers: DataFrame | None = None,
    make_generator: Callable[[int], Generator] | None = None,
    descriptions: dict[str, str] | None = None,
    scores: DataFrame | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
    count: Counter | None = None,
    template: Template | None = None,
    make_counter: Callable[[], TokenCounter] | None = None,
    chat: ChatTemplate | None = None,
    answer_store: str | None = None,
    model: str = "",
) -> DataFrame:
    """Full result rows. Give either ``answers`` (query_id, variant, raw) or a model.

    ``make_encoder``, ``count`` and ``template`` (or ``make_counter`` and ``chat``) are the caller's text encoder, token counter and
    chat template; ``make_generator`` is called with ``max_new_tokens`` and returns the function that answers prompts. With
    ``answer_store``, a path, the answers of the ``model`` of that name are kept there and a run goes on where one broke off.
    """
    train, test, chosen = prepare(train, test, names, config, scores)
    index = with_vectors(train, chosen, config, make_encoder)
    require_neighbors(index, config.k)
    queries = as_queries(with_vectors(test, chosen, config, make_encoder))
    return fused_from_sides(
        index, queries, chosen, config, answers=answers, make_generator=make_generator, descriptions=descriptions, count=count, template=template,
        make_counter=make_counter, chat=chat, answer_store=answer_store, model=model,
    )


def fused_from_sides(
    index: DataFrame,
    queries: DataFrame,
    chosen: Sequence[str],
    config: RunConfig,
    *,
    answers: DataFrame | None = None,
    make_generator: Callable[[int], Generator] | None = None,
    descriptions: dict[str, str] | None = None,
    count: Counter | None = None,
    template: Template | None = None,
    make_counter: Callable[[], TokenCounter] | None = None,
    chat: ChatTemplate | None = None,
    answer_store: str | None = None,
    model: str = "",
) -> DataFrame:
    """The same from an index (sample_id, vec, raw, label) and queries (query_id, vec, raw, true_label)."""
    if (answers is None) == (make_generator is None):
        raise ValueError("give either answers or make_generator")
    # narrow and read four times below
    neighbors = materialize(nearest(queries, index, config.k))
    cases = prompt_cases(neighbors, queries, index, chosen, descriptions or {}, config)
    prompts = budgeted_prompts(cases, config, count, template, make_counter, chat)
    kept = prompts.select("query_id", "variant_no", "variant", "prompt", "prompt_tokens")
    if make_generator is not None:
        longest = config.max_new_tokens
        if answer_store is None:
            answered = answer_with(kept, lambda: make_generator(longest))
        else:
            answered, _ = answer_stored(materialize(kept), lambda: make_generator(longest), answer_store, model=model, max_new_tokens=longest)
    else:
        answered = kept.join(answers.select("query_id", "variant", "raw"), ["query_id", "variant"], "left")
    variants = max(1, min(config.prompt_variants, 3))
    consensus = vote_consensus(
        answered, minimum=config.min_consistent_votes, variants=variants, tokens="prompt_tokens"
    )
    votes = (
        neighbor_evidence(neighbors)
        .select("query_id", "votes_0", "votes_1", F.col("majority").alias("prediction"))
        .withColumn("margin", F.abs(F.col("votes_0") - F.col("votes_1")))
        .join(neighbor_lists(neighbors), "query_id")
        .join(queries.select("query_id", "true_label"), "query_id")
    )
    return result_rows(fuse(votes, consensus, always_override=config.always_override))
