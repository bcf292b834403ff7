"""Prompts within a token budget under a caller's own tokenizer, counting few texts.

A tokenizer's counts do not add up over the parts of a text, but nearly so. Fragments (an example's head, a displayed item) are
counted once and remembered; their sums point at the choice of examples and features, and whole texts are counted from there,
one step at a time, until the largest that fits is found next to one that does not. Cases of a batch take their steps
together, so the tokenizer gets lists of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.operators import prompts as P

TokenCounter = Callable[[list[str]], list[int]]
ChatTemplate = Callable[[list[dict[str, str]]], str]
FRAGMENTS_HELD = 200_000
CASES_TOGETHER = 256


def plain_chat(chat: list[dict[str, str]]) -> str:
    """As ``prompts.render``."""
    return "\n\n".join(f"{m['role'].upper()}: {m['content']}" for m in chat) + "\nASSISTANT:"


def message_text(case: dict, n_examples: int, n_features: int) -> str:
    """As ``prompts.user_text``, with the summary already written."""
    shown = case["examples"][:n_examples]
    lines = [
        f"Example {i}: {e['head']}{P.ITEM_SEPARATOR.join(e['items'][:n_features])}]"
        for i, e in enumerate(reversed(shown) if case["reverse"] else shown, 1)
    ]
    title = P.COMPACT_EXAMPLES_TITLE if case["compact"] else P.EXAMPLES_TITLE
    query = P.ITEM_SEPARATOR.join(case["query_items"][:n_features])
    head = "" if case["compact"] else P.RULES_TEXT
    body = "\n".join([*lines, "", P.QUERY_TITLE])
    return f"{head}{case['summary']}\n\n{title}\n{body}\ndisplayed_features=[{query}]\n\n{P.CLOSING_TEXT}"


def fragments(case: dict) -> list[str]:
    return [*(f"Example 1: {e['head']}]" for e in case["examples"]), *(i for e in case["examples"] for i in e["items"]), *case["query_items"]]


def fitting(
    case: dict, text_of: Callable[[int, int], str], cost: dict[str, int], budget: int, most_examples: int, features: tuple[int, int]
) -> Generator[str, int, tuple[int, int, str, int] | None]:
    """Most examples first, then most features. Yields texts, is sent their counts, returns the choice or None.

    Counts are taken to grow with the text: with more examples, or more features of the same examples.
    """
    low, high = features
    known: dict[tuple[int, int], tuple[str, int]] = {}

    def counted(e: int, f: int) -> Generator[str, int, bool]:
        if (e, f) not in known:
            text = text_of(e, f)
            known[e, f] = text, (yield text)
        return known[e, f][1] <= budget

    base = text_of(0, 0)
    fixed = yield base

    def guess(e: int, f: int) -> int:
        items = [i for x in case["examples"][:e] for i in x["items"][:f]] + case["query_items"][:f]
        return fixed + sum(cost[f"Example 1: {x['head']}]"] for x in case["examples"][:e]) + sum(cost[i] for i in items) + len(items)

    e = next((n for n in range(most_examples, 0, -1) if guess(n, low) <= budget), 1)
    fits = yield from counted(e, low)
    while fits and e < most_examples and (yield from counted(e + 1, low)):
        e += 1
    while not fits:
        if e <= 1:
            return None
        e -= 1
        fits = yield from counted(e, low)
    f = next((n for n in range(high, low, -1) if guess(e, n) <= budget), low)
    fits = yield from counted(e, f)
    while fits and f < high and (yield from counted(e, f + 1)):
        f += 1
    while not fits:
        f -= 1
        fits = yield from counted(e, f)
    return e, f, *known[e, f]


def _together(steps: list[Generator], count: TokenCounter) -> list[tuple]:
    """(result, texts counted) of every generator; all that wait are counted in one call."""
    out: list = [None] * len(steps)
    asked = [0] * len(steps)
    waiting = {i: next(step) for i, step in enumerate(steps)}
    while waiting:
        numbers = list(count(list(waiting.values())))
        if len(numbers) != len(waiting):
            raise RuntimeError("the tokenizer returned a different number of counts")
        after = {}
        for i, n in zip(waiting, numbers):
            asked[i] += 1
            try:
                after[i] = steps[i].send(int(n))
            except StopIteration as done:
                out[i] = done.value
        waiting = after
    return list(zip(out, asked))


def fit_budget_counted(
    cases: DataFrame,
    make_counter: Callable[[], TokenCounter],
    *,
    budget: int = 2048,
    max_examples: int = 5,
    max_features: int = 20,
    min_features: int = 3,
    query_id: str = "query_id",
    chat: ChatTemplate = plain_chat,
) -> DataFrame:
    """(query_id, variant_no, variant, n_examples, n_features, prompt, prompt_tokens, counted), as ``fit_budget_by_text`` chooses.

    ``make_counter`` runs once per Python worker and returns a function from texts to token counts; ``chat`` writes messages
    (role, content) as the text the model reads. ``counted`` is how many whole texts of the case were tokenised, the empty
    one included. A case that does not fit with one example and the fewest features stops the job.
    """
    texts = cases.select(
        query_id, "variant_no", "variant", "reverse", "compact", P.summary_text().alias("summary"),
        F.transform("examples", lambda e: F.struct(e["head"].alias("head"), e["items"].alias("items"))).alias("examples"), "query_items",
    )
    added = [T.StructField(n, T.IntegerType()) for n in ("n_examples", "n_features")]
    added += [T.StructField("prompt", T.StringType()), T.StructField("prompt_tokens", T.IntegerType()), T.StructField("counted", T.IntegerType())]
    schema = T.StructType([*(texts.schema[c] for c in (query_id, "variant_no", "variant")), *added])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cost = make_counter(), {}

        def begun(case: dict) -> Generator:
            def text_of(e: int, f: int) -> str:
                return chat([{"role": "system", "content": P.SYSTEM_TEXT}, {"role": "user", "content": message_text(case, e, f)}])

            limit = P.COMPACT_LIMIT if case["compact"] else max(max_examples, max_features)
            most, high = min(max_examples, len(case["examples"]), limit), min(max_features, limit)
            return fitting(case, text_of, cost, budget, most, (min(min_features, high), high))

        for batch in batches:
            for begin in range(0, batch.num_rows, CASES_TOGETHER):
                part = batch.slice(begin, CASES_TOGETHER)
                rows = part.to_pylist()
                if len(cost) > FRAGMENTS_HELD:
                    cost.clear()
                new = list(dict.fromkeys(x for case in rows for x in fragments(case) if x not in cost))
                cost.update(zip(new, map(int, count(new)) if new else ()))
                found = _together([begun(case) for case in rows], count)
                if any(choice is None for choice, _ in found):
                    raise ValueError(f"no prompt fits into {budget} tokens")
                values = list(zip(*[(*choice, asked) for choice, asked in found]))
                columns = [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in range(3)] + columns, names=schema.names)

    return texts.mapInArrow(choose, schema)
