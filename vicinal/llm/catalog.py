"""Registered queries of the text operators and the same queries as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from vicinal.llm.bytepairs import decode, encode, read_ranks
from vicinal.llm.contamination import contamination
from vicinal.llm.exact import exact_dedup
from vicinal.llm.importance import importance
from vicinal.llm.langid import fit, identify, page_evidence
from vicinal.llm.licenses import license_matches
from vicinal.llm.neardup import near_components
from vicinal.llm.quantize import ENTRIES, PARTS, ROUNDS, compress
from vicinal.llm.repeats import remove_repeats
from vicinal.llm.shuffled import sharded
from vicinal.llm.tokencount import sentencepiece_vocabulary, token_counts
from vicinal.llm.urlfilter import LABELLED, RULES, train, url_verdicts
from vicinal.llm.wrappers import extract

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@query
def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    found = found.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", names, "contaminated")


SQL["op2_decontaminate"] = r"""
WITH norm AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
gram AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM gram),
win AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM norm, lengths, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n),
hit AS (SELECT doc_id, s, n, item FROM win JOIN gram USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM norm LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op7_byte_pairs(spark: SparkSession, sf: str) -> DataFrame:
    ranks = read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = decode(encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    hashes = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", *hashes)


@query
def op3_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_components(table(spark, sf, "documents"))
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept)


SQL["op3_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS t(s) WHERE len(w) >= 5
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM d
  UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM d JOIN reach ON node = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = remove_repeats(table(spark, sf, "documents"))
    kept = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", kept)


SQL["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS g FROM d, unnest(range(1, len(w) - 33)) AS t(s) WHERE len(w) >= 35),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM win SEMI JOIN twice USING (g), unnest(range(s, s + 35)) AS t(p)),
lists AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(p, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""


@query
def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    weights = train(spark.createDataFrame(LABELLED, "url string, label int"))
    found = url_verdicts(table(spark, sf, "pages").select("page_id", "url"), weights, RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query
def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = license_matches(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", "matched", F.round("coverage", 6).alias("coverage"), "first_word", "end_word", "first_byte", "end_byte")


@query
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    pieces = sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(table(spark, sf, "documents"), pieces).select(F.col("id").alias("doc_id"), "n_words", "n_tokens")


@query
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = identify(docs, fit(docs), declared=F.col("lang"), host=F.col("source"))
    return found.select(F.col("id").alias("doc_id"), "language", F.round("probability", 6).alias("probability"), "accepted")


@query
def language_id_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The same operator on raw pages, which have markup and addresses. The character model comes from the documents."""
    pages = page_evidence(table(spark, sf, "pages"))
    evidence = {"declared": F.col("declared"), "host": F.col("host"), "suffix": F.col("suffix")}
    found = identify(pages, fit(table(spark, sf, "documents")), "page_id", **evidence)
    return found.select(F.col("id").alias("page_id"), "language", F.round("probability", 6).alias("probability"), "accepted")


@query
def op4_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract(table(spark, sf, "pages")).withColumnRenamed("id", "page_id")


@query
def op11_importance(spark: SparkSession, sf: str) -> DataFrame:
    found = importance(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL["op11_importance"] = r"""
WITH bits AS (
  SELECT list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
used AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM docs) GROUP BY ALL),
target AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM items) GROUP BY word),
words AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM used UNION ALL SELECT word FROM target)),
hashed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM words, bits),
source AS (SELECT bucket, sum(n) AS s FROM used JOIN hashed USING (word) GROUP BY bucket),
wanted AS (SELECT bucket, sum(n) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(s) FROM source), 0) + 10000)
    / ((coalesce(s, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM wanted), 0) + 10000)))) AS g
  FROM (SELECT range AS bucket FROM range(10000)) b LEFT JOIN source USING (bucket) LEFT JOIN wanted USING (bucket)),
weights AS (SELECT doc_id, CAST(sum(n * g) AS BIGINT) AS weight FROM used JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT count(*) FROM placed) * 10 // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


@query
def op12_shards(spark: SparkSession, sf: str) -> DataFrame:
    found = sharded(table(spark, sf, "documents"), ["doc_id"])
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return compress(table(spark, sf, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _rounds_sql() -> str:
    """Assignments a0, a1, ... to the codebooks b0, b1, ..., each made from the assignments before it."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, d2 * {ENTRIES} + e) AS e, CAST(min(d2) AS BIGINT) AS d2
  FROM (SELECT vec_id, part.p, e, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d2 FROM part JOIN b{r} ON part.p = b{r}.p)
  GROUP BY vec_id, p)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (
  SELECT p, e, list(m ORDER BY i) AS c
  FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM a{r} JOIN part USING (vec_id, p), unnest(range(1, len(x) + 1)) AS t(i) GROUP BY p, e, i) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))""")
    return ",\n".join(steps)


SQL["op13_vector_codes"] = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM kept, unnest(range({PARTS})) AS t(p)),
b0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM part) WHERE e < {ENTRIES}),
{_rounds_sql()},
book AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM b{ROUNDS}, unnest(range(1, len(c) + 1)) AS t(i)),
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d2) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), book
"""
