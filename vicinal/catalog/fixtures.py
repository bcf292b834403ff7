"""Labelled inputs derived from the given tables. ``oracles`` states the same inputs as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.vectors import let
from vicinal.session import spread
from vicinal.sources.dictionary import feature_names

VECTOR_DIM = 64
VECTOR_NAMES = feature_names()[:VECTOR_DIM]
DOCUMENT_NAMES = ["n_chars", "n_words", "n_digits", "n_distinct", "mean_length"]
LINE_NAMES = ["quantity", "extendedprice", "discount", "tax", "linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return stream.parquet(path) if folder else stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a labelled numeric table with a train/test split."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"),
    )


def vector_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the vector table."""
    rows = spread(vectors(spark, sf_dir))
    return tuple(rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))


def vector_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, index): test rows look up training rows."""
    train, test = vector_split(spark, sf_dir)
    raw = F.col("features").cast("array<float>")
    queries = test.select(
        F.col("sample_id").alias("query_id"), raw.alias("vec"), raw.alias("raw"), F.col("label").alias("true_label")
    )
    return queries, train.select("sample_id", raw.alias("vec"), raw.alias("raw"), "label")


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\r\\n]+"), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """Documents with five counted features; unbalanced and full of ties. All of them, or those with a label."""
    text = F.col("text")
    rows = spread(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id", "inner" if labelled else "left")

    def counted(w: Column) -> Column:
        letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
        return F.array(
            F.col("n_chars").cast("double"),
            F.size(w).cast("double"),
            F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double"),
            F.size(F.array_distinct(w)).cast("double"),
            F.coalesce(letters / F.nullif(F.size(w), F.lit(0)), F.lit(0.0)),
        )

    return rows.select(
        F.col("doc_id").alias("sample_id"),
        let(words(text), counted).alias("features"),
        F.col("quality").alias("label"),
        "text",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a labelled table with five numeric features."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("sample_id"),
        F.array(
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_linenumber").cast("double")
        ).alias("features"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_linestatus") == "F").cast("int").alias("prediction"),
    )


# Spellings used by the messy label column, per class, chosen by doc_id modulo 5.
SPELLINGS = {
    0: ["goodware", "Benign ", "0", "SAFE", "clean"],
    1: [" MALWARE ", "true", "1", "Threat", "malicious"],
}


def messy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels.toxic`` in many spellings, with some unknown and missing ones."""
    pick = (F.col("doc_id") % 5 + 1).cast("int")
    word = F.when(F.col("toxic") == 1, F.element_at(F.lit(SPELLINGS[1]), pick)).otherwise(
        F.element_at(F.lit(SPELLINGS[0]), pick)
    )
    turn = F.col("doc_id") % 11
    raw = F.when(turn == 3, "1.0").when(turn == 5, "unknown").when(turn == 7, F.lit(None)).otherwise(word)
    return table(spark, sf_dir, "labels").select("doc_id", raw.alias("raw_label"))


def broken_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table with nulls, NaN, infinities, short rows, bad labels and blank texts."""
    turn = F.col("sample_id") % 50
    v = F.col("features")

    def put(place: int, value: Column) -> Column:
        return F.concat(F.slice(v, 1, place), F.array(value.cast("double")), F.slice(v, place + 2, VECTOR_DIM))

    features = (
        F.when(turn == 7, put(3, F.lit(None)))
        .when(turn == 11, put(5, F.lit(float("nan"))))
        .when(turn == 13, put(0, F.lit(float("inf"))))
        .when(turn == 17, put(63, F.lit(float("-inf"))))
        .when(turn == 19, F.slice(v, 1, VECTOR_DIM - 1))
        .otherwise(v)
    )
    label = F.when(turn == 23, F.lit(None)).when(turn == 29, F.lit(2)).otherwise(F.col("label"))
    text = F.when(turn == 31, "  ").otherwise(F.col("sample_id").cast("string"))
    return vectors(spark, sf_dir).select(
        "sample_id", features.alias("features"), label.alias("label"), text.alias("text")
    )


# Raw answers of the answer table, chosen by (vec_id div 5 + variant number) modulo 6.
RAW_ANSWERS = ["MALWARE", "goodware.", "The file is Malware", "goodware or malware", "", "antimalware tool"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, variant_no, variant, raw) for every test row."""
    variant = F.posexplode(F.lit(["normal", "reversed", "compact"])).alias("variant_no", "variant")
    pick = ((F.floor(F.col("query_id") / 5) + F.col("variant_no")) % 6 + 1).cast("int")
    return (
        vectors(spark, sf_dir)
        .filter(F.col("split") == "test")
        .select(F.col("sample_id").alias("query_id"), variant)
        .withColumn("raw", F.element_at(F.lit(RAW_ANSWERS), pick))
    )
