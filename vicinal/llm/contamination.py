"""Benchmark decontamination: hash set of normalised test n-grams, scanned against every window of the training texts.

DataFrame functions only. A word is hashed once, and numbers of two and four words are made of those. The four words a window
begins with are tested in the row against a bit table of the benchmark's windows, of bounded size whatever the benchmark. What
passes is hashed as a whole window, leaves the row as a number, meets the set of the benchmark's 64-bit numbers, and is verified
by a second number of all its words, which is independent of the first. No text of a window is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.functions.vectors import let
from vicinal.llm.rows import KEY, attach, text_of
from vicinal.session import stored

WINDOW = 13
#: Bits per window of the table that is tested in the row, and its least and largest size in bits, powers of two.
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 24
#: A larger set (numbers and the table around them, bytes) is not broadcast.
BROADCAST_BYTES, NUMBER_BYTES = 256 << 20, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Words of digits, a-z and everything beyond ASCII, A-Z in lower case. Null has none."""
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), BREAKS), "")


def _starts(words: Column, length: int) -> Column:
    last = F.size(words) - length
    return F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))


def _next_to(a: Column, shift: int) -> Column:
    """Numbers of two runs one after the other; beyond the end of a text they mean nothing."""
    return F.zip_with(a, F.slice(a, shift + 1, F.size(a)), lambda x, y: F.xxhash64(x, y))


def _begin(length: int) -> int:
    """Words at the beginning of a window that are tested in the row."""
    return max(n for n in (1, 2, 4) if n <= length)


def _with_runs(words: Column, most: int, body: Callable[[dict[int, Column]], Column]) -> Column:
    """``body`` of the numbers of all runs of 1, 2 and 4 words, by their starts, as far as ``most`` asks."""

    def more(known: dict[int, Column], size: int) -> Column:
        if size >= most:
            return body(known)
        return let(_next_to(known[size], size), lambda twice: more(known | {2 * size: twice}, 2 * size))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda ones: more({1: ones}, 1))


def _numbers(words: Column) -> tuple[Column, Column]:
    """Two independent numbers of a window."""
    return F.xxhash64(words), F.xxhash64(F.lit(1), words)


def window_numbers(grams: DataFrame) -> DataFrame:
    """(length, begin, h, check, items) of the windows; ``begin`` is the number of the words that are tested first."""
    words = F.split("gram", " ")

    def first(runs: dict[int, Column]) -> Column:
        size = F.col("length")
        return F.when(size >= 4, F.get(runs[4], F.lit(0))).when(size >= 2, F.get(runs[2], F.lit(0))).otherwise(F.get(runs[1], F.lit(0)))

    h, check = _numbers(words)
    return grams.select("length", _with_runs(words, 4, first).alias("begin"), h.alias("h"), check.alias("check"), "items")


def _bit(number: Column, bits: int) -> tuple[Column, Column]:
    """(entry of the table, bit in the entry)."""
    return F.shiftright(number, 6).bitwiseAND(bits // 64 - 1).cast("int"), number.bitwiseAND(63).cast("int")


def bit_table(numbers: DataFrame, windows: int) -> tuple[Column, int]:
    """(array of 64-bit entries, bits): a bit is set for the beginning of every window. At most ``MOST_BITS``, with the plan."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_WINDOW * windows):
        bits *= 2
    at, bit = _bit(F.col("begin"), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one")
    entries = [0] * (bits // 64)
    for row in numbers.select(at.alias("at"), one).groupBy("at").agg(F.bit_or("one").alias("v")).collect():
        entries[row["at"]] = row["v"]
    return F.from_json(F.lit(json.dumps(entries)), "array<bigint>"), bits


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(length, gram, items): every window of the items with the sorted ids it comes from.

    An item of fewer words than a window, but not none, is one window of its own length.
    """

    def grams_of(words: Column) -> Column:
        length = F.least(F.size(words), F.lit(window))
        starts = F.when(length > 0, F.sequence(F.lit(1), F.size(words) - length + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(length.alias("length"), F.array_join(F.slice(words, s, length), " ").alias("gram")))

    each = items.select(F.col(id_col).cast("string").alias("item"), F.explode(let(normal_words(F.col(text_col)), grams_of)).alias("g"))
    return each.select("item", "g.*").groupBy("length", "gram").agg(F.collect_set("item").alias("items"))


def scanned_windows(docs: DataFrame, id_col: str, text_col: str, lengths: list[int], table: Column, bits: int) -> DataFrame:
    """(id, __fp, n_words, no, start, length, h, check): windows whose beginning has its bit set; one row, numbered 0, for a text without any."""

    def of_size(words: Column, run: Column, size: int, own: list[int]) -> Column:
        """Windows of the lengths that begin with so many tested words."""

        def marked(s: Column) -> Column:
            at, bit = _bit(F.element_at(run, s), bits)
            return F.getbit(F.get(table, at), bit) == 1

        def window(s: Column, length: int) -> Column:
            h, check = _numbers(F.slice(words, s, length))
            found = F.struct(s.alias("start"), F.lit(length).alias("length"), h.alias("h"), check.alias("check"))
            return F.when(s + length - 1 <= F.size(words), found)

        starts = F.filter(_starts(words, size), marked)
        return F.array_compact(F.flatten(F.transform(starts, lambda s: F.array(*[window(s, length) for length in own]))))

    def passing(words: Column, runs: dict[int, Column]) -> Column:
        none = F.array().cast("array<struct<start:int,length:int,h:bigint,check:bigint>>")
        own = {size: [n for n in lengths if _begin(n) == size] for size in (1, 2, 4)}
        found = [of_size(words, runs[size], size, own[size]) for size in own if own[size]]
        return F.struct(F.size(words).alias("n_words"), F.concat(none, *found).alias("c"))

    # the words are bound once and do not leave the row
    most = max(map(_begin, lengths), default=1)
    value = let(normal_words(F.col(text_col)), lambda words: _with_runs(words, most, lambda runs: passing(words, runs)))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias(KEY), value.alias("v"))
    each = rows.select("id", KEY, F.col("v.n_words").alias("n_words"), F.posexplode_outer("v.c").alias("no", "c"))
    return each.select("id", KEY, "n_words", F.coalesce("no", F.lit(0)).alias("no"), "c.*")


def window_hits(docs: DataFrame, numbers: DataFrame, lengths: list[int], windows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, __fp, n_words, no, start, length, h, hit): the rows of ``scanned_windows``, and whether they are the benchmark's."""
    table, bits = bit_table(numbers, windows)
    each = scanned_windows(docs, id_col, text_col, lengths, table, bits)
    # texts without a candidate are told apart by a number of their own, so they do not meet in one task
    each = each.withColumn("h", F.coalesce("h", F.xxhash64("id", KEY)))
    known = numbers.select(F.col("h").alias("__h"), F.col("check").alias("__check"), F.col("length").alias("__length"))
    if windows * NUMBER_BYTES <= BROADCAST_BYTES:
        known = F.broadcast(known)
    same = (F.col("h") == F.col("__h")) & (F.col("check") == F.col("__check")) & (F.col("length") == F.col("__length"))
    return each.join(known, same, "left").select("id", KEY, "n_words", "no", "start", "length", "h", "check", F.col("__h").isNotNull().alias("hit"))


def _covered(hits: Column) -> Column:
    """Number of words inside the hits, which are (start, length) in order of start."""
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(h["start"], acc["upto"]))).alias("n"),
        F.greatest(acc["upto"], h["start"] + h["length"]).alias("upto"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(F.array_sort(hits), zero, step, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, __fp, repeats, n_words, n_hit, n_items, items, spans, contaminated), one row per id and text.

    A word inside any occurrence of an item's window is hit; spans are the hit (start, length) in words from 1. A document
    is contaminated if at least one word in twenty is hit. Null and empty texts have no words and are clean, as are all
    documents where there are no items or only blank ones; items that repeat a window or an id count once per id.
    """
    grams = stored(benchmark_windows(items, item_id, item_text, window), "grams")
    sizes = {r["length"]: r["count"] for r in grams.groupBy("length").count().collect()}  # one row per length, 13 at most
    lengths, windows = sorted(sizes), sum(sizes.values())
    numbers = stored(window_numbers(grams), "numbers")
    hits = window_hits(docs, numbers, lengths, windows, id_col, text_col)
    mark = F.when(F.col("hit"), F.struct("length", "h", "check"))
    rows = hits.groupBy("id", KEY).agg(
        F.sum(F.when(F.col("no") == 0, 1).otherwise(0)).alias("repeats"),
        F.first("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("hit"), F.struct("start", "length"))).alias("spans"),
        F.collect_set(mark).alias("marks"),
    )
    rows = stored(rows, "rows")
    marked = rows.where(F.size("marks") > 0).select("id", KEY, F.explode("marks").alias("m")).select("id", KEY, "m.*")
    named = marked.join(numbers, ["length", "h", "check"]).groupBy("id", KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    named = named.select(F.col("id").alias("__nid"), F.col(KEY).alias("__nfp"), "items")
    both = rows.join(named, F.col("id").eqNullSafe(F.col("__nid")) & (F.col(KEY) == F.col("__nfp")), "left")
    counted = both.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    counted = counted.select("*", _covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"))
    bad = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return counted.select("id", KEY, "repeats", "n_words", "n_hit", "n_items", "items", F.array_sort("spans").alias("spans"), bad.alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The clean rows of ``docs`` with all their columns."""
    found = contamination(docs, items, id_col, text_col, **names).select("id", KEY, F.col("contaminated").alias("__bad"))
    return attach(docs, found, id_col, text_col).where(~F.col("__bad")).drop("__bad")


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """All rows of ``docs`` with ``clean_words``: the normalised words outside every hit."""
    found = contamination(docs, items, id_col, text_col, **names).select("id", KEY, F.col("spans").alias("__spans"))

    def outside(word: Column, i: Column) -> Column:
        return ~F.exists("__spans", lambda s: (s["start"] <= i + 1) & (i + 1 < s["start"] + s["length"]))

    return attach(docs, found, id_col, text_col).withColumn("clean_words", F.filter(normal_words(F.col(text_col)), outside)).drop("__spans")
