"""Near duplicates by min-max hashing.

Each hash function gives two values of a signature, the smallest and the largest number of the set, so half as many hash
evaluations are needed. Bands of a signature are buckets. In a bucket every text is first compared with one pivot;
components of these links come next, and only then, and only where a bucket still holds several components, are texts of
different components compared, chunk against chunk. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import words as W
from vicinal.llm.components import components
from vicinal.llm.rows import KEY, keyed, slices
from vicinal.session import small_batches, stored

SHINGLE = 5
PERCENT = 85
#: 20 bands of 4 values: a pair at 0.85 shares no band with a chance of 4e-7.
BANDS, BAND_VALUES = 20, 4
#: Members of a bucket that are compared within one task.
CHUNK = 256
#: Bytes of rows that travel to a Python worker at once, and of texts that are cut into shingles at once, about.
BATCH_BYTES = 1 << 20
#: Rows of (id, key, class) below which they are broadcast to the scan of the texts, about 60 MB.
BROADCAST_ROWS = 1_000_000


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle numbers of all texts, one after the other, and where each text's begin.

    A text of fewer words is one shingle; a text without words has none.
    """
    numbers, first = W.words(column, lower=True)
    grams = W.windows(numbers, size, 0x5851F42D4C957F2D)
    parts = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            parts.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            parts.append(W.windows(numbers[a:b], b - a, 0x14057B7EF767814F + 2 * (b - a)))
        else:
            parts.append(numbers[:0])
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else numbers[:0], np.concatenate(([0], np.cumsum(sizes)))


def signatures(sets: np.ndarray, begin: np.ndarray, bands: int, values: int) -> np.ndarray:
    """One number per band for each set, none of which is empty. A band joins minima and maxima of different functions."""
    functions = -(-bands * values // 2)
    seeds = W.mix(np.arange(1, 2 * functions + 1, dtype=np.uint64) * np.uint64(W.BASE))
    low, high = np.empty((functions, len(begin)), np.uint64), np.empty((functions, len(begin)), np.uint64)
    for k in range(functions):
        hashed = (sets ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
        low[k], high[k] = np.minimum.reduceat(hashed, begin), np.maximum.reduceat(hashed, begin)
    both = np.concatenate((low, np.roll(high, values // 2, axis=0)))
    half = values // 2
    out = np.empty((len(begin), bands), np.uint64)
    for band in range(bands):
        rows = [(band * half + i) % functions for i in range(half)]
        rows += [functions + (band * (values - half) + i) % functions for i in range(values - half)]
        total = np.full(len(begin), band + 1, np.uint64)
        for row in rows:
            total = W.mix(total * np.uint64(W.BASE) + both[row])
        out[:, band] = total
    return out


def _sign(size: int, bands: int, values: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            sets, begin = shingle_sets(batch.column("text"), size)
            n = np.diff(begin)
            full = np.flatnonzero(n)
            signed = signatures(sets, begin[:-1][full], bands, values) if len(full) else np.zeros((0, bands), np.uint64)
            names: list[bytes | None] = [None] * batch.num_rows
            for i in full.tolist():
                names[i] = hashlib.blake2b(sets[begin[i] : begin[i + 1]].tobytes(), digest_size=16).digest()
            ends = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column(KEY),
                    pa.array(n),
                    pa.array(names, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed.ravel().view(np.int64))),
                ],
                names=["id", KEY, "n_shingles", "cls", "bands"],
            )

    return sign


def _sets(size: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            sets, begin = shingle_sets(batch.column("text"), size)
            packed = [sets[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(packed, pa.binary())], names=["cls", "set"])

    return full


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    shared = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("set_a"), batch.column("set_b"))
            keep = [_similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _chunk_links(percent: int):
    """Links between the two chunks of a group (or within, if it is one) that join different components."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        names, labels = table.column("cls").to_pylist(), table.column("component").to_pylist()
        side = np.array(table.column("side").to_pylist())
        sizes = np.array([len(s) for s in sets])
        number: dict[bytes, int] = {}
        group = np.array([number.setdefault(x, len(number)) for x in labels])
        parent = list(range(len(number)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        # the largest component is not compared with itself; its shingles are columns all the same
        largest = np.bincount(group).argmax()
        rows = np.flatnonzero(group != largest)
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        often = np.bincount(column, minlength=len(values)) > 1
        column, owner = (np.cumsum(often) - 1)[column[often[column]]], owner[often[column]]
        place = np.full(len(sets), -1)
        place[rows] = np.arange(len(rows))
        shared = np.zeros((len(rows), len(sets)), np.float32)
        for low in range(0, int(often.sum()), 4096):
            part = (column >= low) & (column < low + 4096)
            block = np.zeros((len(sets), 4096), np.float32)
            block[owner[part], column[part] - low] = 1
            shared += block[rows] @ block.T
        union = sizes[rows][:, None] + sizes[None, :] - shared
        good = (100 * shared >= percent * union) & (group[rows][:, None] != group[None, :])
        good &= (side[rows][:, None] != side[None, :]) | (side.min() == side.max())
        found = []
        for i, j in zip(*np.nonzero(good)):
            a, b = root(group[rows[i]]), root(group[j])
            if a != b:
                parent[a] = b
                found.append((names[rows[i]], names[j]))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return compare


def _chosen(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text): the text of one row of each wanted class."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    picked = wanted.select(F.col("id").alias("__wid"), F.col(KEY).alias("__wfp"), "cls")
    return docs.join(picked, docs["id"].eqNullSafe(picked["__wid"]) & (docs[KEY] == picked["__wfp"])).select("cls", "text")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE, bands: int = BANDS, values: int = BAND_VALUES) -> DataFrame:
    """(id, __fp, n_shingles, component_id, first), one row per row of ``docs``.

    Texts are linked if their sets of distinct shingles (``size`` words at white space, A-Z as a-z) have a Jaccard
    similarity of at least ``percent`` in a hundred. A component is named by its smallest id. Texts with equal sets are
    one node of the graph, so copies never meet in pairs. A text without words (also null) has no shingles and is its own
    component. Rows that repeat an id have equal results; null ids never name a component unless it has no other.
    ``first`` marks the row of smallest id, then smallest ``__fp``; only rows that repeat both share it. An empty table gives an empty result; other columns are not needed.
    """
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    signed = rows.mapInArrow(_sign(size, bands, values), f"id {id_type}, {KEY} bigint, n_shingles bigint, cls binary, bands array<bigint>")
    with small_batches(docs.sparkSession, BATCH_BYTES):
        signed = stored(signed, "signatures")
    nodes = signed.where("n_shingles > 0").groupBy("cls").agg(F.min(F.struct("id", KEY)).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = nodes.select("cls", "n", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("cls", "n")).alias("pivot")).where("count > 1")
    held = stored(members.join(buckets, "bucket"), "members")

    # every member of a bucket against its pivot
    near = f"100 * least(n, pivot.n) >= {percent} * greatest(n, pivot.n)"
    star = held.where("cls <> pivot.cls").where(near).select(F.least("cls", "pivot.cls").alias("a"), F.greatest("cls", "pivot.cls").alias("b"))
    star = stored(star.distinct(), "pairs")
    wanted = held.select("cls").distinct().join(nodes.select("cls", "row.*"), "cls")
    chosen = _chosen(rows, stored(wanted, "wanted")).mapInArrow(_sets(size), "cls binary, set binary")
    with small_batches(docs.sparkSession, BATCH_BYTES):
        sets = stored(chosen, "sets")
    with_b = star.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b")
    with_both = with_b.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a")
    with small_batches(docs.sparkSession, BATCH_BYTES):
        links = stored(with_both.mapInArrow(_confirm(percent), "a binary, b binary"), "links")
    found = components(links)

    # buckets of three and more that still hold several components
    label = F.coalesce("component", "cls").alias("component")
    labelled = held.where("count > 2").join(found, F.col("cls") == F.col("node"), "left").select("bucket", "count", "cls", label)
    content = F.sum(F.xxhash64("cls").cast("decimal(38,0)"))
    open_ = labelled.groupBy("bucket", "count").agg(F.min("component").alias("x"), F.max("component").alias("y"), content.alias("content"))
    open_ = open_.where("x <> y").groupBy("count", "content").agg(F.min("bucket").alias("bucket")).select("bucket")
    chunks = F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")
    rest = labelled.join(open_, "bucket").select("bucket", "cls", "component", chunks)
    rest = rest.withColumn("side", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rest = rest.select("bucket", "cls", "component", "side", other)
    rest = rest.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "component", "cls")
    rest = rest.join(sets, "cls")
    more = rest.groupBy("bucket", "i", "j").applyInArrow(_chunk_links(percent), "a binary, b binary")
    more = stored(more, "more")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    per_row = signed.select("id", KEY, "n_shingles", "cls").join(found, F.col("cls") == F.col("node"), "left")
    per_row = stored(per_row.select("id", KEY, "n_shingles", F.coalesce("component", "cls").alias("component")), "labelled")
    smallest = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", KEY)).alias("first")
    names = stored(per_row.where("component is not null").groupBy("component").agg(smallest), "names")
    named = per_row.join(names, "component", "left")
    alone = F.col("component").isNull()
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col(KEY) == F.col("first")[KEY])
    component_id = F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("component_id")
    return named.select("id", KEY, "n_shingles", component_id, (alone | own).alias("first"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """One row of each component of ``docs``, with all columns: the one with the smallest id, if that is null or shared with the smallest key."""
    from vicinal.llm.rows import attach, single_rows

    found = near_components(docs, id_col, text_col, **settings)
    decided = found.groupBy("id", KEY).agg(F.max("first").alias("__kept"), F.count(F.lit(1)).alias("__repeats"))
    rows = attach(docs, decided, id_col, text_col).where("__kept").drop("__kept")
    return single_rows(rows, id_col, "__repeats", text_col)
