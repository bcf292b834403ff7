"""Repeated passages by level-wise doubling.

A window of 35 words can only occur twice if the shorter windows inside it do. So windows are compared at 9 words, those
that repeat are extended to 18, and what is left to 35. At every length a window of 35 is looked up by one shorter window
in it, the one with the smallest number, so that equal windows are looked up by the same. Neighbouring windows with the
same look-up form a run. A look-up that occurs once is dropped and equal runs are settled. Where one look-up has different
runs, one run of each kind goes on to the next length, as a candidate and as a witness for the others, until no candidates
survive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm import words as W
from vicinal.llm.rows import KEY, keyed, slices
from vicinal.session import stored

WINDOW = 35
SHORTEST = 9
#: Runs of all documents (24 bytes each) below which they are broadcast to the scan of the texts; else texts are shuffled.
BROADCAST_RUNS = 1_000_000
FACTOR = 0x2545F4914F6CDD1D


def lengths(window: int, shortest: int) -> list[int]:
    """Window lengths of the levels: each at most twice the one before, the last the window itself."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def _lowest(numbers: np.ndarray, span: int) -> np.ndarray:
    """For each position the place of the smallest of the next ``span`` numbers, the first of equal ones."""
    place = np.arange(len(numbers) - span + 1 if len(numbers) >= span else 0)
    best, width = np.arange(len(numbers)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(numbers[left] <= numbers[right], left, right)
        width += step
    return best[: len(place)]


def runs_of(numbers: np.ndarray, candidate: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """(look-up, content, start, count) of the runs among the candidate window starts of one stream of words."""
    grams = W.windows(numbers, length, FACTOR)
    lowest = _lowest(grams, window - length + 1)
    starts = np.flatnonzero(candidate)
    seed = lowest[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    sums = np.zeros(len(numbers) + 1, np.uint64)
    up, down = W.powers(W.BASE, len(numbers) + 1), W.powers(W.INVERSE, len(numbers) + 1)
    np.cumsum(numbers * up[: len(numbers)], out=sums[1:])
    size = count + window - 1
    content = W.mix((sums[begin + size] - sums[begin]) * down[begin] + size.astype(np.uint64))
    return grams[seed[first]], content, begin, count


def _candidates(first: np.ndarray, total: int, window: int) -> np.ndarray:
    """Positions where a window lies inside one text."""
    ok = np.zeros(max(total, 0), bool)
    ok[: max(0, total - window + 1)] = True
    for end in first[1:-1].tolist():
        ok[max(0, end - window + 1) : end] = False
    return ok


def _level(length: int, window: int, open_only: bool):
    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            numbers, first = W.words(batch.column("text"))
            ok = _candidates(first, len(numbers), window)
            if open_only:
                wanted = np.zeros(len(numbers) + 1, np.int64)
                lists = batch.column("open")
                runs, base = lists.flatten(), np.repeat(first[:-1], pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
                begin = runs.field("start").to_numpy() + base
                np.add.at(wanted, begin, 1)
                np.add.at(wanted, begin + runs.field("count").to_numpy(), -1)
                ok &= np.cumsum(wanted[:-1]) > 0
            gram, content, begin, count = runs_of(numbers, ok, length, window)
            row = np.searchsorted(first, begin, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram.view(np.int64)),
                    pa.array(content.view(np.int64)),
                    batch.column("id").take(pa.array(row)),
                    batch.column(KEY).take(pa.array(row)),
                    pa.array((begin - first[row]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                names=["gram", "content", "id", KEY, "start", "count"],
            )

    return level


def _with_runs(rows: DataFrame, runs: DataFrame, name: str, how: str) -> DataFrame:
    """Texts with their (start, count) pairs; a text's pairs are bounded by its length."""
    lists = runs.groupBy("id", KEY).agg(F.collect_list(F.struct("start", "count")).alias(name))
    lists = lists.select(F.col("id").alias("__lid"), F.col(KEY).alias("__lfp"), name)
    if runs.count() <= BROADCAST_RUNS:
        lists = F.broadcast(lists)
    return rows.join(lists, rows["id"].eqNullSafe(lists["__lid"]) & (rows[KEY] == lists["__lfp"]), how).drop("__lid", "__lfp")


def _merged(runs: DataFrame) -> DataFrame:
    """Runs of a text that touch or overlap as one."""
    by_start = Window.partitionBy("id", KEY).orderBy("start")
    before = F.max(F.col("start") + F.col("count")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    no = F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    joined = runs.withColumn("new", new).withColumn("no", no).groupBy("id", KEY, "no")
    joined = joined.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("count")).alias("end"))
    return joined.select("id", KEY, "start", (F.col("end") - F.col("start")).alias("count"))


def repeated_windows(rows: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """(id, __fp, start, count): runs of window starts whose windows occur elsewhere. ``rows`` as from ``rows.keyed``.

    The runs of a level are computed twice rather than stored, which takes less disk than reading the texts takes time.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"gram bigint, content bigint, id {id_type}, {KEY} bigint, start int, count int"
    settled, source, open_only = [], rows.select("id", KEY, "text"), False
    for length in lengths(window, shortest):
        found = source.mapInArrow(_level(length, window, open_only), schema)
        # at full length a window is its own look-up, and both numbers, 128 bits, must agree
        by = ["gram", "content"] if length == window else ["gram"]
        groups = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("x"), F.max("content").alias("y"))
        # written before the join, which is then a plain one: adaptive execution splits the runs of a very common look-up
        groups = stored(groups.where("n > 1").select(*by, (F.col("x") == F.col("y")).alias("same")), f"lookups{length}")
        level = stored(found.join(groups, by), f"repeats{length}")
        settled.append(level.where("same"))
        mixed = level.where(~F.col("same"))
        one = F.min(F.struct("id", KEY, "start", "count")).alias("one")
        kinds = stored(mixed.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("n"), one), f"kinds{length}")
        if kinds.isEmpty():
            break
        settled.append(mixed.join(kinds.where("n > 1").select("gram", "content"), ["gram", "content"]))
        source, open_only = _with_runs(rows, kinds.select("one.*"), "open", "inner").select("id", KEY, "text", "open"), True
    return reduce(DataFrame.unionByName, [part.select("id", KEY, "start", "count") for part in settled])


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total, removed, kept = [], [], []
            for text, runs in zip(batch.column("text"), batch.column("repeats")):
                words = text.as_py().encode().split()
                gone = 0
                total.append(len(words))
                if runs.is_valid:
                    begin, count = (runs.values.field(k).to_numpy() for k in ("start", "count"))
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + count + window - 1, -1)
                    keep = np.cumsum(change[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words = compress(words, keep.tolist())
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column(KEY), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["id", KEY, "n_words", "n_removed", "kept_text"],
            )

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """(id, __fp, n_words, n_removed, kept_text), one row per row of ``docs``.

    Every word that lies in a window of ``window`` words (cut at white space, unchanged) which starts anywhere else too is
    removed, in all its places; kept words are joined by one space. All windows are judged on the input. Null and empty
    texts have no words; texts shorter than a window lose none. Rows that repeat an id are documents of their own, and
    if they repeat the text too, they are each other's copies. An empty table gives an empty result; other columns are
    not needed.
    """
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    runs = stored(_merged(repeated_windows(rows, window, shortest)), "repeats")
    with_runs = _with_runs(rows, runs, "repeats", "left")
    out = f"id {id_type}, {KEY} bigint, n_words bigint, n_removed bigint, kept_text string"
    return with_runs.select("id", KEY, "text", "repeats").mapInArrow(_remove(window), out)
