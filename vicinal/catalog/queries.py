"""Registered queries: one per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.catalog import fixtures as X
from vicinal.config import RunConfig
from vicinal.functions import text as TX
from vicinal.functions import vectors as V
from vicinal.operators import answers as A
from vicinal.operators import distinct_texts as DT
from vicinal.operators import embed as E
from vicinal.operators import evidence as EV
from vicinal.operators import features as FT
from vicinal.operators import fusion as FU
from vicinal.operators import knn as K
from vicinal.operators import labels as L
from vicinal.operators import metrics as M
from vicinal.operators import mutual_info as MI
from vicinal.operators import prompts as P
from vicinal.operators import quantiles as QU
from vicinal.operators import sample as S
from vicinal.operators import validate as VD
from vicinal.operators import token_fit as TF
from vicinal.operators import vote as VT
from vicinal.operators.prefixes import prefix_join
from vicinal.operators.pruned import knn_join_pruned
from vicinal.plans.classify import vote_classification
from vicinal.plans.fused import budgeted_prompts, fused_classification, prompt_cases
from vicinal.plans import runs as R
from vicinal.plans.sweep import sweep_k, sweep_prefixes, sweep_settings
from vicinal.plans.text_index import build_text_index, search_text_index
from vicinal.operators.tree import knn_join_tree, search_cells
from vicinal.session import materialize, scratch_path, spread
from vicinal.sources import cells as CL
from vicinal.sources import labelled as CSV
from vicinal.sources import sinks as SK
from vicinal.sources import store as ST
from vicinal.sources import value_counts as VC
from vicinal.sources.answered import answer_stored
from vicinal.sources.dictionary import feature_descriptions, feature_dim
from vicinal.streaming.score import score_stream, score_stream_versions

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

K_NEAREST = 3
TOP_FEATURES = 32
TIGHT_BUDGET = 620
SWEEP = (1, 3, 5, 7, 9)
PREFIXES = (8, 16, 32, 64)
CONFIG = RunConfig()


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__.removeprefix("q_")] = fn
    return fn


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def long_form(df: DataFrame, key: str, array: str) -> DataFrame:
    """(key, pos, value) of an array column, values to six decimals."""
    entries = df.select(key, F.posexplode_outer(array).alias("pos", "v"))
    return entries.select(key, "pos", r6(F.col("v").cast("double"), "value"))


def neighbors(spark: SparkSession, sf: str, k: int = K_NEAREST, metric: str = "cosine") -> DataFrame:
    queries, index = X.vector_sides(spark, sf)
    return K.knn_join(queries, index, k, metric)


def votes(spark: SparkSession, sf: str) -> DataFrame:
    queries, _ = X.vector_sides(spark, sf)
    return VT.majority_vote(neighbors(spark, sf)).join(queries.select("query_id", "true_label"), "query_id")


def cases(spark: SparkSession, sf: str, k: int = K_NEAREST) -> DataFrame:
    queries, index = X.vector_sides(spark, sf)
    found = materialize(K.knn_join(queries, index, k))  # read for the evidence and for the examples
    return prompt_cases(found, queries, index, X.VECTOR_NAMES, feature_descriptions(), CONFIG)


# --- sources and sinks ----------------------------------------------------------------------------


@query
def q_scan_labelled(spark, sf):
    rows = X.vectors(spark, sf).withColumn("label", L.label_name(F.col("label")))
    path = scratch_path(spark, "labelled-csv")
    CSV.write_csv(CSV.unpack(rows, X.VECTOR_NAMES, ["sample_id"]), path)
    data = CSV.load_csv(spark, path, id_column="sample_id")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return data.rows.select("sample_id", "label", F.size("features").alias("n_features"), r6(total, "total"))


@query
def q_rename_positional(spark, sf):
    rows = X.vectors(spark, sf)
    wide = CSV.unpack(rows, [f"c{i}" for i in range(X.VECTOR_DIM)], [])
    named = CSV.rename_positional(wide, X.VECTOR_NAMES)
    means = named.groupBy("label").agg(*[F.avg(n).alias(n) for n in X.VECTOR_NAMES])
    entries = F.explode_outer(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in X.VECTOR_NAMES]))
    return means.select("label", entries.alias("e")).select("label", "e.feature", r6("e.v", "mean"))


def _feature_stats(spark, sf):
    return (
        X.vectors(spark, sf)
        .select(F.posexplode_outer("features").alias("pos", "v"))
        .groupBy("pos")
        .agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max(F.abs("v")).alias("largest"))
    )


@query
def q_feature_dim(spark, sf):
    named = feature_dim(spark).join(_feature_stats(spark, sf), "pos", "left")
    return named.select("pos", "name", F.col("group").alias("feature_group"), "ord", "n", r6("mean", "mean"))


@query
def q_feature_descriptions(spark, sf):
    named = feature_dim(spark).join(_feature_stats(spark, sf), "pos", "left")
    return named.select("name", F.coalesce("description", "name").alias("description"), r6("largest", "largest"))


@query
def q_predictions_vote(spark, sf):
    path = scratch_path(spark, "vote-predictions")
    out = SK.vote_predictions(votes(spark, sf), CONFIG.mode, keep=("query_id",))
    SK.write_vote_predictions(out, path)
    return spark.read.parquet(path).select("query_id", "prediction", "true_label", "pred_type", "retrieval_mode")


def fused(spark, sf, **settings):
    train, test = X.vector_split(spark, sf)
    config = RunConfig(k=K_NEAREST, **settings)
    return fused_classification(
        train, test, X.VECTOR_NAMES, config, answers=X.answers(spark, sf), descriptions=feature_descriptions()
    )


@query
def q_predictions_fused(spark, sf):
    path = scratch_path(spark, "fused-predictions")
    SK.write_fused_predictions(fused(spark, sf), path)
    rows = spark.read.csv(path, header=True)
    return rows.groupBy("prediction", "true_label", "pred_type").agg(F.count("*").alias("n"))


@query
def q_results_full(spark, sf):
    joined = {
        c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("neighbor_labels", "llm_votes")
    }
    joined["neighbor_similarities"] = F.array_join(
        F.transform("neighbor_similarities", lambda s: TX.fixed(s.cast("float"), 4, signed=True)), ","
    ).alias("neighbor_similarities")
    for c in ("llm_raw_outputs", "prompt_tokens"):
        entries = F.transform(
            F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        )
        joined[c] = F.array_join(entries, "|").alias(c)
    results = fused(spark, sf)
    return results.select(*[joined.get(c, F.col(c)) for c in results.columns])


@query
def q_mi_cache_roundtrip(spark, sf):
    rows = X.documents(spark, sf).drop("text")
    root = scratch_path(spark, "scores")
    signature = ST.fingerprint(ST.file_parts(spark, f"{sf}/documents.parquet"), CONFIG, X.DOCUMENT_NAMES, scores_only=True)
    ST.cached_scores(spark, root, signature, lambda: MI.mutual_info(rows, X.DOCUMENT_NAMES))

    def unused() -> DataFrame:
        raise AssertionError("the stored scores must be used")

    return ST.cached_scores(spark, root, signature, unused).select("feature", r6("score", "score"))


def _stored_index(spark, sf):
    queries, index = X.vector_sides(spark, sf)
    path = scratch_path(spark, "index")
    signature = ST.fingerprint(ST.file_parts(spark, f"{sf}/embeddings.parquet"), CONFIG, X.VECTOR_NAMES)
    return queries, index, path, signature


@query
def q_index_roundtrip(spark, sf):
    queries, index, path, signature = _stored_index(spark, sf)
    common = dict(names=X.VECTOR_NAMES, config=CONFIG)
    _, first = ST.cached_index(spark, path, signature, lambda: index, **common)
    stored, second = ST.cached_index(spark, path, signature, lambda: index, **common)
    found = K.knn_join(queries, stored, K_NEAREST)
    return found.select(
        "query_id", "rank", "sample_id", "label", r6("similarity", "similarity"),
        F.lit(first).alias("built"), F.lit(second).alias("rebuilt"),
    )


@query
def q_index_append(spark, sf):
    queries, index, path, signature = _stored_index(spark, sf)
    half = F.col("sample_id") % 2 == 0
    ST.save_index(index.filter(half), path, names=X.VECTOR_NAMES, config=CONFIG, signature=signature)
    for _ in range(2):  # a batch that is sent twice is stored once
        ST.append_index(index.filter(~half), path, "odd")
    stored, _ = ST.load_index(spark, path, CONFIG.mode)
    found = K.knn_join(queries, stored, K_NEAREST)
    return found.select("query_id", "rank", "sample_id", r6("similarity", "similarity"))


CELL_ROWS = 16  # the given tables are small; production cells hold thousands of rows


@query
def q_index_cells(spark, sf):
    queries, index, path, signature = _stored_index(spark, sf)
    CL.save_cells(index, path, signature=signature, cell_rows=CELL_ROWS)
    cells, _ = CL.open_cells(spark, path)
    found = search_cells(queries, cells, K_NEAREST)
    return found.select("query_id", "rank", "sample_id", r6("similarity", "similarity"))


@query
def q_index_cells_append(spark, sf):
    queries, index, path, signature = _stored_index(spark, sf)
    half = F.col("sample_id") % 2 == 0
    CL.save_cells(index.filter(half), path, signature=signature, metric="l2", cell_rows=CELL_ROWS)
    for _ in range(2):  # a batch that is sent twice is stored once
        CL.append_cells(index.filter(~half), path, "odd")
    cells, _ = CL.open_cells(spark, path)
    found = search_cells(queries, cells, K_NEAREST)
    return found.select("query_id", "rank", "sample_id", r6("distance", "distance"))


@query
def q_dataset_roundtrip(spark, sf):
    path = scratch_path(spark, "dataset")
    ST.save_dataset(X.documents(spark, sf).select("sample_id", "text", "label"), path)
    stored = ST.load_dataset(spark, path, "text")
    return stored.select("sample_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "label")


@query
def q_fingerprint(spark, sf):
    rows = X.documents(spark, sf).drop("text")
    signature = ST.fingerprint(["documents"], CONFIG, X.DOCUMENT_NAMES, classes=L.class_sizes(rows))
    return rows.agg(F.count("*").alias("training_rows")).withColumn("signature", F.lit(signature))


# --- checks and labels ----------------------------------------------------------------------------


@query
def q_normalise_labels(spark, sf):
    return L.normalise_labels(X.messy_labels(spark, sf), "raw_label").select("doc_id", "raw_label", "label")


@query
def q_invalid_labels(spark, sf):
    return L.invalid_labels(X.messy_labels(spark, sf), "raw_label")


@query
def q_cast_report(spark, sf):
    part = X.table(spark, sf, "part")
    return VD.cast_report(part, ["p_name", "p_brand", "p_size", "p_retailprice"], "p_partkey")


@query
def q_validation_report(spark, sf):
    return VD.validation_report(X.broken_vectors(spark, sf), X.VECTOR_DIM, text="text")


@query
def q_duplicate_names(spark, sf):
    header = X.table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"), F.md5(F.col("text").cast("binary")).alias("name")
    )
    return VD.duplicate_names(header)


def _headers(spark, sf):
    number = F.substring("c_name", -9, 9)
    left = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("Supplier#"), number).alias("name"))
    right = X.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + F.when(F.col("s_suppkey") % 7 == 0, 1).otherwise(0)).alias("pos"),
        F.col("s_name").alias("name"),
    )
    return left, right


@query
def q_schema_diff(spark, sf):
    return VD.schema_diff(*_headers(spark, sf))


@query
def q_missing_features(spark, sf):
    return VD.missing_features(*_headers(spark, sf))


@query
def q_select_features(spark, sf):
    wanted = [X.VECTOR_NAMES[i] for i in (5, 0, 63, 17)]
    return long_form(FT.select_features(X.vectors(spark, sf), X.VECTOR_NAMES, wanted), "sample_id", "features")


@query
def q_class_counts(spark, sf):
    return L.class_counts(X.lines(spark, sf))


# --- sampling and ranking -------------------------------------------------------------------------


@query
def q_sample_uniform(spark, sf):
    orders = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_totalprice")
    sampled = S.sample_rows(orders, 5000, CONFIG.seed)
    return sampled.select("sample_id", "o_totalprice", "sample_order")


@query
def q_sample_balanced(spark, sf):
    rows = X.documents(spark, sf).select("sample_id", "label")
    return S.sample_rows(rows, 100, CONFIG.seed, balanced=True)


@query
def q_select_best_features(spark, sf):
    scores = MI.mutual_info(X.vector_split(spark, sf)[0], X.VECTOR_NAMES)
    return FT.best_features(scores, TOP_FEATURES).select("feature", r6("score", "score"))


@query
def q_top10_features(spark, sf):
    scores = MI.mutual_info(X.vectors(spark, sf), X.VECTOR_NAMES)
    ranked = FT.rank_features(scores).filter(F.col("rank") <= 10)
    return ranked.select("rank", "feature", r6("score", "score"))


@query
def q_top_abs_features(spark, sf):
    picked = F.posexplode_outer(TX.top_abs(F.col("features"), 10)).alias("slot", "e")
    rows = X.vectors(spark, sf).select("sample_id", picked)
    return rows.select("sample_id", "slot", F.col("e.pos").alias("pos"), r6(F.col("e.value").cast("double"), "value"))


@query
def q_mutual_info_knn(spark, sf):
    scores = MI.mutual_info(X.vectors(spark, sf), X.VECTOR_NAMES)
    return scores.select("feature", r6("score", "score"))


@query
def q_mutual_info_binned(spark, sf):
    scores = MI.mutual_info_binned(spread(X.lines(spark, sf)), X.LINE_NAMES, bins=10)
    return scores.select("feature", r6("score", "score"))


@query
def q_mutual_info_runs(spark, sf):
    """Features cut into runs that no task holds as a whole."""
    scores = MI.mutual_info(X.documents(spark, sf), X.DOCUMENT_NAMES, run_rows=100)
    return scores.select("feature", r6("score", "score"))


@query
def q_mutual_info_appended(spark, sf):
    """Scores from stored value counts, to which two batches of rows were appended."""
    rows, path = spread(X.vectors(spark, sf)), scratch_path(spark, "counts")
    third = F.col("sample_id") % 3
    VC.save_counts(rows.filter(third == 0), path, X.VECTOR_NAMES, "first-third")
    for batch, part in (("second", 1), ("third", 2), ("second", 1)):  # a batch that is sent twice counts once
        VC.append_counts(rows.filter(third == part), path, batch)
    return VC.stored_scores(spark, path).select("feature", r6("score", "score"))


SUMMARY_SIZE = 1 << 17  # so many rows have exact ranks; beyond, ranks are within a bound that tests hold


@query
def q_mutual_info_sketched(spark, sf):
    scores = QU.mutual_info_sketched(spread(X.lines(spark, sf)), X.LINE_NAMES, bins=10, size=SUMMARY_SIZE)
    return scores.select("feature", r6("score", "score"))


@query
def q_standardize(spark, sf):
    rows = X.documents(spark, sf, labelled=False).drop("text")
    return long_form(FT.standardize(rows, FT.fit_scaler(rows)), "sample_id", "features")


# --- neighbours and votes -------------------------------------------------------------------------


@query
def q_knn_cosine(spark, sf):
    return neighbors(spark, sf).select("query_id", "rank", "sample_id", "label", r6("similarity", "similarity"))


@query
def q_knn_inner_product(spark, sf):
    found = neighbors(spark, sf, metric="ip")
    return found.select("query_id", "rank", "sample_id", "label", r6("similarity", "similarity"))


@query
def q_knn_l2(spark, sf):
    found = neighbors(spark, sf, metric="l2")
    return found.select("query_id", "rank", "sample_id", "label", r6("distance", "distance"))


@query
def q_knn_pruned(spark, sf):
    rows = X.documents(spark, sf, labelled=False).select("sample_id", "label", F.col("features").cast("array<float>").alias("vec"))
    index = materialize(rows)
    queries = index.select(F.col("sample_id").alias("query_id"), "vec")
    found = knn_join_pruned(queries, index, K_NEAREST, "l2", cells=16)
    return found.select("query_id", "rank", "sample_id", "label", r6("distance", "distance"))


@query
def q_knn_tree(spark, sf):
    """All documents against all, through pivots of pivots."""
    rows = X.documents(spark, sf, labelled=False).select("sample_id", "label", F.col("features").cast("array<float>").alias("vec"))
    index = materialize(rows)
    queries = index.select(F.col("sample_id").alias("query_id"), "vec")
    found = knn_join_tree(queries, index, K_NEAREST, "l2", cell_rows=CELL_ROWS)
    return found.select("query_id", "rank", "sample_id", "label", r6("distance", "distance"))


@query
def q_knn_prefixes(spark, sf):
    queries, index = X.vector_sides(spark, sf)
    found = prefix_join(queries, index, K_NEAREST, PREFIXES)
    return found.select("query_id", "prefix", "rank", "sample_id", "label", r6("similarity", "similarity"))


@query
def q_knn_prefixes_l2(spark, sf):
    """All documents against all, in a grid of blocks."""
    rows = X.documents(spark, sf, labelled=False).select("sample_id", "label", F.col("features").cast("array<float>").alias("vec"))
    index = materialize(rows)
    queries = index.select(F.col("sample_id").alias("query_id"), "vec")
    found = prefix_join(queries, index, K_NEAREST, (2, 5), "l2", few_bytes=0)
    return found.select("query_id", "prefix", "rank", "sample_id", r6("distance", "distance"))


@query
def q_knn_single(spark, sf):
    rows = X.vectors(spark, sf)
    vector = rows.orderBy("sample_id").first()["features"]  # the client's one query vector
    found = K.knn_single(rows, vector, 10, vec="features")
    return found.select("sample_id", "label", r6("similarity", "similarity"))


@query
def q_neighbor_metadata(spark, sf):
    _, index = X.vector_sides(spark, sf)
    found = neighbors(spark, sf).select("query_id", "rank", "sample_id")
    rows = K.neighbor_metadata(found, index.select("sample_id", "label", "raw"))
    first = F.element_at("raw", 1).cast("double")
    return rows.select("query_id", "rank", "sample_id", "label", F.size("raw").alias("width"), r6(first, "first_value"))


@query
def q_majority_vote(spark, sf):
    return VT.majority_vote(neighbors(spark, sf))


@query
def q_neighbor_lists(spark, sf):
    lists = VT.neighbor_lists(neighbors(spark, sf, k=5))
    similarities = F.transform("neighbor_similarities", lambda s: TX.fixed(s.cast("float"), 4, signed=True))
    return lists.select(
        "query_id",
        F.array_join(F.transform("neighbor_labels", lambda x: x.cast("string")), ",").alias("neighbor_labels"),
        F.array_join(similarities, ",").alias("neighbor_similarities"),
    )


@query
def q_neighbor_evidence(spark, sf):
    out = EV.neighbor_evidence(neighbors(spark, sf, k=5))
    numbers = ("mean_similarity_0", "mean_similarity_1", "weight_0", "weight_1")
    return out.select("query_id", "votes_0", "votes_1", "nearest_label", "majority", *[r6(c, c) for c in numbers])


@query
def q_mean_abs_distance(spark, sf):
    queries, index = X.vector_sides(spark, sf)
    out = EV.with_distance_in_blocks(neighbors(spark, sf), queries.select("query_id", "raw"), index.select("sample_id", "raw"))
    return out.select("query_id", "rank", "sample_id", r6("mean_abs_distance", "mean_abs_distance"))


# --- metrics --------------------------------------------------------------------------------------


@query
def q_metrics_summary(spark, sf):
    out = M.metrics_summary(X.lines(spark, sf))
    return out.select("n", *[r6(c, c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


@query
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(X.lines(spark, sf))


@query
def q_classification_report(spark, sf):
    out = M.classification_report(X.lines(spark, sf))
    return out.select("entry", *[r6(c, c) for c in ("precision", "recall", "f1")], "support")


@query
def q_decision_distribution(spark, sf):
    return M.distributions(fused(spark, sf), ["prediction", "pred_type", "decision_source"])


# --- rows as text, vectors of texts ---------------------------------------------------------------


@query
def q_feature_statements(spark, sf):
    selected = TX.top_abs(F.col("features"), 10)
    parts = TX.feature_statements(selected, F.lit(X.VECTOR_NAMES))
    return X.vectors(spark, sf).select("sample_id", F.posexplode_outer(parts).alias("slot", "statement"))


@query
def q_text_chunks(spark, sf):
    return E.row_chunks(X.vectors(spark, sf), X.VECTOR_NAMES)


@query
def q_display_vector(spark, sf):
    labels = TX.display_labels(X.VECTOR_NAMES, feature_descriptions())
    items = TX.display_items(F.col("features"), labels, 5)
    return X.vectors(spark, sf).select("sample_id", F.array_join(items, P.ITEM_SEPARATOR).alias("displayed"))


@query
def q_l2_normalize(spark, sf):
    rows = X.documents(spark, sf, labelled=False).withColumn("features", V.l2_normalize(F.col("features")))
    return long_form(rows, "sample_id", "features")


@query
def q_embed_hashing(spark, sf):
    return long_form(E.embed_hashing(spread(X.table(spark, sf, "documents")), "text", ["doc_id"], 64), "doc_id", "vec")


def letter_encoder() -> E.Encoder:
    """Stand-in for a caller's model: counts of eight letters."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) + 1 for c in "abcdefgh"] for t in texts], dtype=np.float32)

    return encode


@query
def q_embed_callback(spark, sf):
    return long_form(E.embed_with(spread(X.table(spark, sf, "documents")), "text", letter_encoder), "doc_id", "vec")


@query
def q_embed_distinct(spark, sf):
    """Lines of documents, each different line encoded once, pooled per document."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  ")) != "")
    rows = spread(X.table(spark, sf, "documents")).select("doc_id", lines.alias("lines")).where(F.size("lines") > 0)
    pooled, encoded = DT.embed_distinct(rows, "lines", letter_encoder, "doc_id")
    return long_form(pooled, "doc_id", "vec").withColumn("encoded", F.lit(encoded.texts).cast("long"))


@query
def q_mean_pool(spark, sf):
    return long_form(E.mean_pool(X.table(spark, sf, "embeddings"), "label", "embedding"), "label", "vec")


# --- prompts and answers --------------------------------------------------------------------------


@query
def q_prompt_examples(spark, sf):
    rows = cases(spark, sf, k=5).select("query_id", F.explode_outer("examples").alias("e"))
    return rows.select(
        "query_id", F.col("e.rank").alias("rank"), F.col("e.head").alias("head"),
        F.array_join("e.items", P.ITEM_SEPARATOR).alias("items"),
    )


@query
def q_prompts(spark, sf):
    return budgeted_prompts(cases(spark, sf), CONFIG).select("query_id", "variant", "prompt")


@query
def q_render_prompt(spark, sf):
    turns = X.table(spark, sf, "conversations")
    chat = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(P.SYSTEM_TEXT).alias("content")),
        F.struct(F.col("role"), F.col("text").alias("content")),
    )
    return turns.select("conv_id", "turn", P.render(chat).alias("prompt"))


def _budgeted(spark, sf, budget, k):
    settings = RunConfig(max_prompt_tokens=budget, k=k)
    out = budgeted_prompts(cases(spark, sf, k), settings)
    return out.select(
        "query_id", "variant", "n_examples", "n_features", "prompt_tokens", "neighbor_tokens", "truncated"
    )


@query
def q_prompt_budget(spark, sf):
    return _budgeted(spark, sf, TIGHT_BUDGET, 5)


@query
def q_token_usage(spark, sf):
    return _budgeted(spark, sf, CONFIG.max_prompt_tokens, K_NEAREST)


@query
def q_parse_answers(spark, sf):
    return X.answers(spark, sf).withColumn("vote", A.parse_answer(F.col("raw")))


@query
def q_answers_join(spark, sf):
    prompts = budgeted_prompts(cases(spark, sf), CONFIG).select("query_id", "variant", "prompt_tokens")
    answered = prompts.join(X.answers(spark, sf), ["query_id", "variant"])
    return answered.select("query_id", "variant", "raw", "prompt_tokens")


def majority_reader(max_new_tokens: int = CONFIG.max_new_tokens) -> A.Generator:
    """Stand-in for a caller's model: repeats the majority stated in the prompt."""

    def generate(prompts: list[str]) -> list[str]:
        return [p.split("Label-count majority: ")[1].split("\n")[0].lower() for p in prompts]

    return generate


@query
def q_answer_callback(spark, sf):
    prompts = budgeted_prompts(cases(spark, sf), CONFIG).select("query_id", "variant_no", "variant", "prompt")
    out = A.answer_with(prompts, majority_reader)
    return out.select("query_id", "variant", "raw", A.parse_answer(F.col("raw")).alias("vote"))


def no_reader() -> A.Generator:
    def generate(prompts: list[str]) -> list[str]:
        raise RuntimeError(f"{len(prompts)} prompts were asked again")

    return generate


@query
def q_answer_store(spark, sf):
    """Two runs; the second finds all answers and would fail if it asked."""
    prompts = materialize(budgeted_prompts(cases(spark, sf), CONFIG).select("query_id", "variant", "prompt"))
    path, settings = scratch_path(spark, "answers"), dict(model="majority", max_new_tokens=CONFIG.max_new_tokens)
    _, asked = answer_stored(prompts, majority_reader, path, **settings, wave_prompts=100)
    out, again = answer_stored(prompts, no_reader, path, **settings)
    counts = F.lit(asked).cast("long").alias("asked"), F.lit(again).cast("long").alias("asked_again")
    return out.select("query_id", "variant", "raw", A.parse_answer(F.col("raw")).alias("vote"), *counts)


@query
def q_vote_consensus(spark, sf):
    out = A.vote_consensus(X.answers(spark, sf))
    return out.select(
        "query_id", "valid_votes", "goodware_votes", "malware_votes", "consensus_votes", "candidate", "unanimous"
    )


@query
def q_decision_fusion(spark, sf):
    found, consensus = votes(spark, sf), A.vote_consensus(X.answers(spark, sf))
    both = [
        FU.fuse(found, consensus, always_override=flag).withColumn("always", F.lit(flag)) for flag in (False, True)
    ]
    return both[0].unionByName(both[1]).select(
        "query_id", "always", "final", "pred_type", "decision_source", "override_applied", "unanimous", "margin"
    )


# --- whole runs -----------------------------------------------------------------------------------


def _vote_run(spark, sf, **settings):
    train, test = X.vector_split(spark, sf)
    config = RunConfig(k=K_NEAREST, **settings)
    out = vote_classification(train, test, X.VECTOR_NAMES, config)
    return out.select("query_id", "prediction", "true_label", "votes_0", "votes_1")


@query
def q_classify_vote_original(spark, sf):
    return _vote_run(spark, sf, top_k_features=TOP_FEATURES)


@query
def q_classify_vote_embedding(spark, sf):
    return _vote_run(spark, sf, mode="embedding")


@query
def q_classify_fused(spark, sf):
    results = fused(spark, sf)
    return results.select("query_id", "prediction", "true_label", "pred_type", "decision_source", "mv_margin")


def _csv_sides(spark, sf):
    """Train and test as CSV; the test file has its columns in another order."""
    paths = []
    for side, names in zip(X.vector_split(spark, sf), (X.VECTOR_NAMES, X.VECTOR_NAMES[::-1])):
        path = scratch_path(spark, "side-csv")
        rows = FT.select_features(side, X.VECTOR_NAMES, names).withColumn("label", L.label_name(F.col("label")))
        CSV.write_csv(CSV.unpack(rows, names, ["sample_id"]), path)
        paths.append(path)
    return paths


@query
def q_run_vote(spark, sf):
    paths, store, out = _csv_sides(spark, sf), scratch_path(spark, "run"), scratch_path(spark, "run-out")
    config = RunConfig(k=K_NEAREST, top_k_features=TOP_FEATURES)
    for _ in range(2):  # the second run finds scores and index
        votes, report = R.run_vote(spark, *paths, config, store, out, id_column="sample_id")
    written = spark.read.parquet(out).select("query_id", F.col("prediction").alias("written"))
    return written.join(votes, "query_id").select("query_id", "written", "true_label", "votes_0", "votes_1")


@query
def q_run_fused(spark, sf):
    store, out = scratch_path(spark, "run"), scratch_path(spark, "run-out")
    config = RunConfig(k=K_NEAREST)
    results = R.run_fused(
        spark, *_csv_sides(spark, sf), config, store, out, id_column="sample_id", answers=X.answers(spark, sf), descriptions=feature_descriptions()
    )
    return results.select("query_id", "prediction", "true_label", "pred_type", "decision_source", "mv_margin")


def chat_template(chat: Column) -> Column:
    """A caller's template: every turn between marks."""
    turns = F.transform(chat, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"], F.lit("<|end|>")))
    return F.concat(F.array_join(turns, ""), F.lit("<|assistant|>"))


def letter_count(text: Column) -> Column:
    """A caller's token counter: four characters are a token."""
    return F.ceil(F.length(text) / 4).cast("int")


@query
def q_prompt_hooks(spark, sf):
    found = budgeted_prompts(cases(spark, sf), RunConfig(k=K_NEAREST, max_prompt_tokens=2 * TIGHT_BUDGET), letter_count, chat_template)
    return found.select("query_id", "variant", "n_examples", "n_features", "prompt_tokens", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def letter_counter() -> TF.TokenCounter:
    """The same counter as a caller's tokenizer in Python."""
    return lambda texts: [-(-len(t) // 4) for t in texts]


def marked_chat(chat: list[dict[str, str]]) -> str:
    return "".join(f"<|{m['role']}|>{m['content']}<|end|>" for m in chat) + "<|assistant|>"


@query
def q_prompt_tokenizer(spark, sf):
    found = budgeted_prompts(cases(spark, sf), RunConfig(k=K_NEAREST, max_prompt_tokens=2 * TIGHT_BUDGET), make_counter=letter_counter, chat=marked_chat)
    return found.select("query_id", "variant", "n_examples", "n_features", "prompt_tokens", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query
def q_text_index_search(spark, sf):
    texts = X.documents(spark, sf, labelled=False).select("sample_id", "text", "label")
    index = build_text_index(texts)
    queries = index.select(F.col("sample_id").alias("query_id"), "vec")
    found = search_text_index(queries, index, k=3)
    return found.select(
        "query_id", "rank", "sample_id", "label", F.md5(F.col("text").cast("binary")).alias("text_md5"),
        r6("distance", "distance"),
    )


@query
def q_sweep_k(spark, sf):
    queries, _ = X.vector_sides(spark, sf)
    found = neighbors(spark, sf, k=max(SWEEP))
    out = sweep_k(found, queries.select("query_id", "true_label"), SWEEP)
    return out.select("k", "n", *[r6(c, c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


@query
def q_sweep_settings(spark, sf):
    train, test = X.vector_split(spark, sf)
    configs = [CONFIG, RunConfig(top_k_features=TOP_FEATURES), RunConfig(mode="embedding")]
    out = sweep_settings(train, test, X.VECTOR_NAMES, configs, [K_NEAREST])
    numbers = [r6(c, c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")]
    return out.select("mode", "top_k_features", "k", "n", *numbers)


@query
def q_sweep_prefixes(spark, sf):
    train, test = X.vector_split(spark, sf)
    out = sweep_prefixes(train, test, X.VECTOR_NAMES, PREFIXES, SWEEP)
    numbers = [r6(c, c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")]
    return out.select("top_k_features", "k", "n", *numbers)


@query
def q_stream_score(spark, sf):
    _, index = X.vector_sides(spark, sf)
    arriving = X.arriving(spark, sf, "embeddings").filter(F.col("vec_id") % 5 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")
    )
    sink, state = scratch_path(spark, "stream-votes"), scratch_path(spark, "stream-state")
    score_stream(arriving, index, K_NEAREST, sink, state).awaitTermination()
    return spark.read.parquet(sink).select("query_id", "votes_0", "votes_1", "nearest_label", "prediction")


@query
def q_stream_versions(spark, sf):
    """A stored index that grows between two micro-batches of a stream."""
    queries, index, path, signature = _stored_index(spark, sf)
    half = F.col("sample_id") % 2 == 0
    ST.save_index(index.filter(half), path, names=X.VECTOR_NAMES, config=CONFIG, signature=signature)
    source, sink, state = (scratch_path(spark, name) for name in ("arriving", "stream-votes", "stream-state"))
    early = F.col("query_id") % 10 == 0
    versions = [signature]
    for part in (early, ~early):
        if len(versions) == 1 and part is not early:
            versions.append(ST.append_index(index.filter(~half), path, "odd"))
        queries.filter(part).select("query_id", "vec").write.mode("append").parquet(source)
        stream = spark.readStream.schema("query_id long, vec array<float>").parquet(source)
        score_stream_versions(stream, path, K_NEAREST, sink, state, mode=CONFIG.mode).awaitTermination()
    number = F.when(F.col("index_version") == versions[0], 1).when(F.col("index_version") == versions[1], 2)
    return spark.read.parquet(sink).select("query_id", "votes_0", "votes_1", "nearest_label", "prediction", number.alias("version"))
