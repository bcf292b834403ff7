"""Exact duplicates by deterministic block naming.

A text is cut into blocks of equal size. All blocks are sorted and named by integers, equal blocks by the same one. Then
neighbouring names are paired and the pairs are named in the same way, until one name is left per text. Two texts have
the same (level, name) exactly if they are equal: blocks and pairs are compared whole, never by a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.rows import KEY, attach, keyed, slices
from vicinal.session import small_batches, stored

BLOCK_BYTES = 4096
#: Bytes of texts that travel to a Python worker, and are cut, at once, about. Of equal blocks among them one is sent.
BATCH_BYTES = 4 << 20
#: Blocks that are sorted together, about; and buckets at least. There are as many buckets as the blocks of the input ask for.
BUCKET_BLOCKS, LEAST_BUCKETS = 50_000, 4096


def _cut(block_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            places: dict[bytes, list[dict]] = {}
            ids, keys = batch.column("id"), batch.column(KEY).to_pylist()
            for row, text in enumerate(batch.column("text").to_pylist()):
                raw = text.encode()
                count = max(1, -(-len(raw) // block_bytes))
                for n in range(count):
                    block = raw[n * block_bytes : (n + 1) * block_bytes]
                    places.setdefault(block, []).append((row, keys[row], count, n))
            flat = [p for found in places.values() for p in found]
            entries = pa.StructArray.from_arrays(
                [
                    ids.take(pa.array([p[0] for p in flat], pa.int64())),
                    pa.array([p[1] for p in flat], pa.int64()),
                    pa.array([p[2] for p in flat], pa.int32()),
                    pa.array([p[3] for p in flat], pa.int32()),
                ],
                names=["id", KEY, "blocks", "n"],
            )
            ends = [0]
            for found in places.values():
                ends.append(ends[-1] + len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(places), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)],
                names=["block", "places"],
            )

    return cut


def bucket_count(docs: DataFrame, text_col: str, block_bytes: int) -> int:
    blocks = F.sum(F.ceil(F.octet_length(F.col(text_col)) / block_bytes))
    return max(LEAST_BUCKETS, -(-(docs.agg(blocks).first()[0] or 0) // BUCKET_BLOCKS))


def _rank(order: list[Column], buckets: int) -> Column:
    """Integer name: place of the value among the sorted values of its bucket. The same in every run."""
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    return bucket * F.lit(1 << 32) + F.dense_rank().over(Window.partitionBy(bucket).orderBy(*order))


def block_names(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """(id, __fp, blocks, n, name): named blocks of every text.

    Blocks are compared after one shuffle; a task sends each of its different blocks once with the list of its places,
    so a block of a third of all texts is a few rows per task.
    """
    rows = keyed(docs, id_col, text_col)
    kind = dict(rows.dtypes)["id"]
    schema = f"block binary, places array<struct<id:{kind},{KEY}:bigint,blocks:int,n:int>>"
    cut = rows.mapInArrow(_cut(block_bytes), schema)
    named = cut.select("places", _rank([F.col("block")], buckets).alias("name"))
    return named.select(F.explode("places").alias("p"), "name").select("p.*", "name")


def _pairs(names: DataFrame, buckets: int) -> DataFrame:
    """The next level: neighbouring names joined and named. An odd last name is paired with -1."""
    half = F.floor(F.col("n") / 2).cast("int")
    paired = names.groupBy("id", KEY, "blocks", half.alias("half")).agg(
        F.max(F.when(F.col("n") % 2 == 0, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(F.col("n") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
    )
    order = [F.col("a"), F.col("b")]
    known = paired.select("a", "b").distinct().select("a", "b", _rank(order, buckets).alias("name"))
    blocks = F.ceil(F.col("blocks") / 2).cast("int").alias("blocks")
    return paired.join(known, ["a", "b"]).select("id", KEY, blocks, F.col("half").alias("n"), "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, __fp, repeats, level, name): the collision-free identity of every text, one row per id and text.

    ``repeats`` counts the rows that share both. Every level is written to the shared folder, so a lost executor costs
    one level; a level holds two integers per pair, and half as many rows as the one before.
    """
    buckets = bucket_count(docs, text_col, block_bytes)
    with small_batches(docs.sparkSession, BATCH_BYTES):
        names = stored(block_names(docs, id_col, text_col, block_bytes, buckets), "blocks")
    repeats = names.where("n = 0").groupBy("id", KEY).agg(F.count(F.lit(1)).alias("repeats"))
    longest = names.agg(F.max("blocks")).first()[0] or 1
    level, done = 0, [names.where("blocks = 1").select("id", KEY, F.lit(0).alias("level"), "name").distinct()]
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        names = stored(_pairs(names.where("blocks > 1"), buckets), f"pairs{level}")
        done.append(names.where("blocks = 1").select("id", KEY, F.lit(level).alias("level"), "name"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    right = repeats.select(F.col("id").alias("__rid"), F.col(KEY).alias("__rfp"), "repeats")
    return found.join(right, found["id"].eqNullSafe(right["__rid"]) & (found[KEY] == right["__rfp"])).drop("__rid", "__rfp")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with keep_id, group_size, kept and repeats.

    Of equal texts the row with the largest id stays; ``group_size`` counts the rows with that text. A null text is an
    empty text; a null id loses against any other id and stays where all ids of the group are null. Rows that repeat an
    id and its text have equal results and ``repeats`` over 1 (see ``rows.single_rows``); rows that share an id but not a
    text are different documents. An empty table gives an empty result. Extra columns are handed through; one that is
    named like a result is replaced.
    """
    ids = identities(docs, id_col, text_col, block_bytes)
    # written before the join, which is then a plain one: adaptive execution splits a group that holds very many rows
    groups = stored(ids.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("repeats").alias("group_size")), "groups")
    decided = ids.join(groups, ["level", "name"]).select(
        "id", KEY, "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "repeats"
    )
    return attach(docs, decided, id_col, text_col)
