"""Shards of a corpus in random order: a two-pass external shuffle.

The first pass scatters rows uniformly over buckets that fit in memory, by a seeded hash of the row's number. The second pass
puts each bucket into a random order by itself (``shuffle`` of an array is a Fisher-Yates shuffle). The buckets one after the
other are a random order of all rows, which is cut into shards of equal counts. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.session import stored

SHARDS = 40
SEED = 2024
BUCKET_ROWS = 1 << 16
"""rows of a few numbers each, so a bucket is a few megabytes"""
MOST_TASKS = 20_000
ROW_BYTES = 16
"""counted for every row besides its text"""
NUMBER = "__number"


def text_size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col)).cast("long"), F.lit(0)) + F.lit(ROW_BYTES)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a number of their own, written, so that all later readers see the same numbers."""
    return stored(rows.withColumn(NUMBER, F.monotonically_increasing_id()), "numbered")


def _offsets(bucketed: DataFrame, block: int) -> DataFrame:
    """(bucket, before): rows in buckets with smaller numbers, by running totals of ``block`` buckets, then inside each block."""
    sizes = bucketed.groupBy("bucket").count().withColumn("block", F.floor(F.col("bucket") / block))
    blocks = sizes.groupBy("block").agg(F.sum("count").alias("n"))
    earlier = blocks.withColumn("ahead", F.sum("n").over(Window.orderBy("block")) - F.col("n")).select("block", "ahead")
    inside = F.sum("count").over(Window.partitionBy("block").orderBy("bucket")) - F.col("count")
    return sizes.withColumn("inside", inside).join(F.broadcast(earlier), "block").select("bucket", (F.col("ahead") + F.col("inside")).alias("before"))


def shuffled(records: DataFrame, count: int, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``count`` numbered ``records`` with ``bucket`` and ``place``, their places 0, 1, 2, ... in a random order.

    The bucket depends on the seed and a row's number, so a third of all rows being equal, or having one id, does not
    fill a bucket. A bucket is collected into an array of about ``bucket_rows`` rows, sorted by number and shuffled.
    The result is written before it is returned, so every reader sees the same order.
    """
    buckets = max(1, -(-count // bucket_rows))
    bucketed = records.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), NUMBER), F.lit(buckets)))
    row = F.struct(NUMBER, *[F.col(f"`{c}`") for c in records.columns if c != NUMBER])
    whole = bucketed.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    mixed = whole.sortWithinPartitions("bucket").select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "row"))
    placed = mixed.join(_offsets(bucketed, max(1, int(buckets**0.5))), "bucket")
    return stored(placed.select("row.*", "bucket", (F.col("before") + F.col("at")).alias("place")), "shuffled")


def cut(placed: DataFrame, count: int, shards: int) -> DataFrame:
    """Consecutive places as ``shards`` of equal counts: the first ``count % shards`` of them have one row more."""
    low, longer = divmod(count, shards)
    edge = longer * (low + 1)
    first = F.col("place") < edge
    shard = F.when(first, F.floor(F.col("place") / (low + 1))).otherwise(longer + F.floor((F.col("place") - edge) / max(1, low)))
    slot = F.when(first, F.col("place") % (low + 1)).otherwise((F.col("place") - edge) % max(1, low))
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("place")


def sharded(
    docs: DataFrame, columns: list[str], text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """All rows of ``docs`` as their ``columns``, which are small, and size, text_crc32, law, bucket, shard, slot, grown_shard.

    The law is ``rows``: shards hold equally many rows or one more. Slots count from 0 in each shard, in random order.
    ``size`` is the text's UTF-8 bytes and ``ROW_BYTES``; ``text_crc32`` its unsigned CRC-32 (null text: of nothing, 0). Equal rows,
    repeated ids and nulls are rows like all others: the order rests on row numbers alone, so copies lie spread over all
    shards. ``grown_shard`` is null, since under this law one more shard moves rows between all of them. ``columns`` that are
    named like a result are replaced. An empty table gives an empty result; with fewer rows than shards the last shards
    are empty.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    results = ("size", "text_crc32", "law", "bucket", "place", "shard", "slot", "grown_shard")
    carried = [f"`{c}`" for c in columns if c not in results]
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32")
    records = numbered(docs.select(*carried, text_size(text_col).alias("size"), crc))
    count = records.count()
    found = cut(shuffled(records, count, seed, bucket_rows), count, shards)
    grown = F.lit(None).cast("int").alias("grown_shard")
    return found.select(*carried, "size", "text_crc32", F.lit("rows").alias("law"), "bucket", "shard", "slot", grown)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> None:
    """Writes the rows of ``docs`` as Parquet below ``path``/shard=N: all columns and ``slot``, by which files are cut and sorted.

    Only row numbers are shuffled by bucket. Whole rows move twice, to meet their places and into the order of the places.
    Columns named shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = numbered(docs.drop("shard", "slot"))
    count = rows.count()
    places = cut(shuffled(rows.select(NUMBER), count, seed, bucket_rows), count, shards).select(NUMBER, "shard", "slot")
    tasks = min(MOST_TASKS, max(shards, rows.rdd.getNumPartitions()))
    whole = rows.join(places, NUMBER).drop(NUMBER).repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot")
    whole.write.partitionBy("shard").parquet(path)
