"""The registered queries as plain SQL over the same tables, for an independent engine."""

from __future__ import annotations

import json

from vicinal.catalog import fixtures as X
from vicinal.catalog import queries as Q
from vicinal.config import RunConfig
from vicinal.functions.digamma import digamma_sql
from vicinal.functions.text import CHUNK_PREFIX, display_labels
from vicinal.operators import fusion as FU
from vicinal.operators import prompts as P
from vicinal.sources.dictionary import FEATURE_GROUPS, feature_descriptions
from vicinal.sources.store import payload

ORACLES: dict[str, str] = {}
CONFIG = RunConfig()


def text(value: str) -> str:
    """A Python string as a SQL literal."""
    parts = ["'" + part.replace("'", "''") + "'" for part in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def lst(values) -> str:
    return "[" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in values) + "]"


def put(name: str, *parts: str) -> None:
    """Register: all but the last part are CTEs."""
    ctes = ",".join(p.strip().rstrip(",") for p in parts[:-1])
    ORACLES[name] = (f"WITH {ctes} " if ctes else "") + parts[-1].strip()


NAMES = lst(X.VECTOR_NAMES)
FIXED = "printf('%.4f', {0}::DOUBLE)"
SIGNED = "printf('%+.4f', {0}::DOUBLE)"
NAME_OF = "CASE {0} WHEN 0 THEN 'goodware' WHEN 1 THEN 'malware' END"
SINGLE = "CAST(CAST({0} AS FLOAT) AS DOUBLE)"

VECTORS = """
vectors AS (
  SELECT vec_id AS sample_id, CAST(embedding AS DOUBLE[]) AS features, CAST(label >= 5 AS INT) AS label,
         CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM embeddings)"""
SIDES = VECTORS + """,
q AS (SELECT sample_id AS query_id, features AS v, label AS true_label FROM vectors WHERE split = 'test'),
i AS (SELECT sample_id, features AS v, label FROM vectors WHERE split = 'train')"""
DOCUMENTS = r"""
docs0 AS (
  SELECT d.doc_id, d.text, d.n_chars, l.quality,
         list_filter(string_split_regex(d.text, '[ \t\r\n]+'), lambda w: w <> '') AS w
  FROM documents d JOIN labels l USING (doc_id)),
docs AS (
  SELECT doc_id AS sample_id, text, quality AS label,
         [CAST(n_chars AS DOUBLE), CAST(len(w) AS DOUBLE),
          CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE),
          CAST(list_unique(w) AS DOUBLE),
          coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / nullif(len(w), 0), 0)] AS features
  FROM docs0)"""
ALL_DOCUMENTS = DOCUMENTS.replace("JOIN labels", "LEFT JOIN labels")
LINES = """
lines AS (
  SELECT [l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS DOUBLE)] AS features,
         CAST(l_returnflag = 'R' AS INT) AS label, CAST(l_linestatus = 'F' AS INT) AS prediction
  FROM lineitem)"""
ANSWERS = f"""
answers AS (
  SELECT vec_id AS query_id, no AS variant_no, ['normal', 'reversed', 'compact'][no + 1] AS variant,
         {lst(X.RAW_ANSWERS)}[(vec_id // 5 + no) % 6 + 1] AS raw
  FROM embeddings, (SELECT unnest([0, 1, 2]) AS no) WHERE vec_id % 5 = 0)"""
MESSY = f"""
messy AS (
  SELECT doc_id, CASE doc_id % 11 WHEN 3 THEN '1.0' WHEN 5 THEN 'unknown' WHEN 7 THEN NULL
    ELSE CASE WHEN toxic = 1 THEN {lst(X.SPELLINGS[1])}[doc_id % 5 + 1]
         ELSE {lst(X.SPELLINGS[0])}[doc_id % 5 + 1] END END AS raw_label
  FROM labels)"""


def knn(k: int, metric: str = "cosine") -> str:
    score = {
        "cosine": "list_cosine_similarity(q.v, i.v)",
        "ip": "list_inner_product(q.v, i.v)",
        "l2": "list_distance(q.v, i.v) ** 2",
    }[metric]
    direction = "ASC" if metric == "l2" else "DESC"
    return f"""
pairs AS (SELECT query_id, sample_id, i.label, {score} AS s FROM q, i),
nn AS (
  SELECT * FROM (
    SELECT query_id, sample_id, label, s,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) {direction}, sample_id) AS INT) AS rank
    FROM pairs) WHERE rank <= {k})"""


VOTES = """
votes0 AS (
  SELECT query_id, count(*) FILTER (label = 0) AS votes_0, count(*) FILTER (label = 1) AS votes_1,
         min_by(label, rank) AS nearest_label
  FROM nn GROUP BY query_id),
votes AS (
  SELECT *, CASE WHEN votes_0 > votes_1 THEN 0 WHEN votes_1 > votes_0 THEN 1 ELSE nearest_label END AS prediction,
         abs(votes_0 - votes_1) AS margin
  FROM votes0)"""

# --- sources and sinks ----------------------------------------------------------------------------

put("scan_labelled", VECTORS,
    "SELECT sample_id, label, CAST(len(features) AS INT) AS n_features, round(list_sum(features), 6) AS total FROM vectors")

LONG = "long AS (SELECT sample_id, label, unnest(features) AS v, unnest(range(len(features))) AS pos FROM vectors)"
put("rename_positional", VECTORS, LONG,
    f"SELECT label, {NAMES}[pos + 1] AS feature, round(avg(v), 6) AS mean FROM long GROUP BY label, pos")

_dims = " UNION ALL ".join(
    f"SELECT {no} AS g, '{group}' AS feature_group, unnest(range({size})) AS ord, "
    + ("'" + pattern.replace("{n}", "' || ord || '").replace("{x}", "0x' || printf('%02X', ord) || '") + "'")
    + " AS description"
    for no, (group, size, pattern) in enumerate(FEATURE_GROUPS)
)
DIM = f"""
dim0 AS ({_dims}),
dim AS (SELECT CAST(row_number() OVER (ORDER BY g, ord) - 1 AS INT) AS pos, feature_group || '_' || ord AS name,
               feature_group, CAST(ord AS INT) AS ord, description FROM dim0)"""
STATS = "stats AS (SELECT pos, count(*) AS n, avg(v) AS mean, max(abs(v)) AS largest FROM long GROUP BY pos)"
put("feature_dim", VECTORS, LONG, STATS, DIM,
    "SELECT dim.pos, name, feature_group, ord, n, round(mean, 6) AS mean FROM dim LEFT JOIN stats ON stats.pos = dim.pos")
put("feature_descriptions", VECTORS, LONG, STATS, DIM,
    "SELECT name, description, round(largest, 6) AS largest FROM dim LEFT JOIN stats ON stats.pos = dim.pos")

put("predictions_vote", SIDES, knn(Q.K_NEAREST), VOTES,
    f"SELECT query_id, {NAME_OF.format('prediction')} AS prediction, {NAME_OF.format('true_label')} AS true_label, "
    "'PMV' AS pred_type, 'original' AS retrieval_mode FROM votes JOIN q USING (query_id)")

PARSED = r"""
parsed0 AS (SELECT *, list_distinct(regexp_extract_all(lower(raw), '\b(goodware|malware)\b', 1)) AS found FROM answers),
parsed AS (SELECT query_id, variant_no, variant, raw,
                  CASE WHEN len(found) = 1 THEN CASE found[1] WHEN 'goodware' THEN 0 ELSE 1 END END AS vote FROM parsed0)"""
CONSENSUS = """
tally AS (
  SELECT query_id, CAST(count(vote) AS INT) AS valid_votes, CAST(count(*) FILTER (vote = 0) AS INT) AS goodware_votes,
         CAST(count(*) FILTER (vote = 1) AS INT) AS malware_votes,
         string_agg(CAST(vote AS VARCHAR), ',' ORDER BY variant_no) AS llm_votes,
         string_agg(variant || '=' || raw, '|' ORDER BY variant) AS raw_outputs
  FROM parsed GROUP BY query_id),
consensus AS (
  SELECT *, greatest(goodware_votes, malware_votes) AS consensus_votes,
         CASE WHEN greatest(goodware_votes, malware_votes) >= 2 THEN
           CASE WHEN goodware_votes > malware_votes THEN 0 WHEN malware_votes > goodware_votes THEN 1 END END AS candidate,
         valid_votes = 3 AND greatest(goodware_votes, malware_votes) = 3 AS unanimous
  FROM tally)"""


def decision(always: bool) -> str:
    if always:
        rules = f"ELSE [CAST(candidate AS VARCHAR), 'LLM', '{FU.ALWAYS}', 'true']"
    else:
        rules = f"""WHEN candidate = prediction THEN [CAST(prediction AS VARCHAR), 'LLM', '{FU.AGREES}', 'false']
             WHEN margin <= 1 AND unanimous THEN [CAST(candidate AS VARCHAR), 'LLM', '{FU.OVERRIDES}', 'true']
             ELSE [CAST(prediction AS VARCHAR), 'MV', '{FU.RETAINED}', 'false']"""
    return f"""
  SELECT *, CASE WHEN candidate IS NULL THEN [CAST(prediction AS VARCHAR), 'MV', '{FU.FALLBACK}', 'false'] {rules} END AS d
  FROM votes JOIN consensus USING (query_id)"""


FUSED_COLUMNS = (
    "CAST(d[1] AS INT) AS final, d[2] AS pred_type, d[3] AS decision_source, CAST(d[4] AS BOOLEAN) AS override_applied"
)
FUSED = f"""
decided AS ({decision(False)}),
fused AS (SELECT * EXCLUDE (d), {FUSED_COLUMNS} FROM decided JOIN (SELECT query_id, true_label FROM q) USING (query_id))"""
FUSED_CTES = (SIDES, knn(Q.K_NEAREST), VOTES, ANSWERS, PARSED, CONSENSUS, FUSED)

put("predictions_fused", *FUSED_CTES,
    f"SELECT {NAME_OF.format('final')} AS prediction, {NAME_OF.format('true_label')} AS true_label, pred_type, "
    "count(*) AS n FROM fused GROUP BY ALL")
put("decision_distribution", *FUSED_CTES,
    f"SELECT 'prediction' AS field, {NAME_OF.format('final')} AS value, count(*) AS n FROM fused GROUP BY ALL "
    "UNION ALL SELECT 'pred_type', pred_type, count(*) FROM fused GROUP BY ALL "
    "UNION ALL SELECT 'decision_source', decision_source, count(*) FROM fused GROUP BY ALL")
put("classify_fused", *FUSED_CTES,
    f"SELECT query_id, {NAME_OF.format('final')} AS prediction, {NAME_OF.format('true_label')} AS true_label, "
    "pred_type, decision_source, CAST(margin AS INT) AS mv_margin FROM fused")

# --- checks and labels ----------------------------------------------------------------------------

put("normalise_labels", MESSY, """
SELECT doc_id, raw_label,
  CASE WHEN lower(trim(raw_label)) IN ('0', 'goodware', 'benign', 'safe', 'clean', 'false') THEN 0
       WHEN lower(trim(raw_label)) IN ('1', 'malware', 'malicious', 'threat', 'true') THEN 1 END AS label
FROM messy""")
put("invalid_labels", MESSY, """
SELECT raw_label, count(*) AS n FROM messy
WHERE raw_label IS NOT NULL AND lower(trim(raw_label)) NOT IN
  ('0', 'goodware', 'benign', 'safe', 'clean', 'false', '1', 'malware', 'malicious', 'threat', 'true')
GROUP BY raw_label""")
put("cast_report", """
raw AS (SELECT unnest(['p_name', 'p_brand', 'p_size', 'p_retailprice']) AS feature,
          unnest([p_name, p_brand, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)]) AS raw FROM part)""",
    """SELECT feature, count(*) AS n_bad, min(raw) AS first_bad FROM raw
WHERE raw IS NOT NULL AND try_cast(raw AS DOUBLE) IS NULL GROUP BY feature""")

BROKEN = VECTORS + """,
broken AS (
  SELECT sample_id,
    CASE sample_id % 50
      WHEN 7 THEN list_concat(features[1:3], [CAST(NULL AS DOUBLE)], features[5:64])
      WHEN 11 THEN list_concat(features[1:5], ['NaN'::DOUBLE], features[7:64])
      WHEN 13 THEN list_concat(['Infinity'::DOUBLE], features[2:64])
      WHEN 17 THEN list_concat(features[1:63], ['-Infinity'::DOUBLE])
      WHEN 19 THEN features[1:63] ELSE features END AS features,
    CASE sample_id % 50 WHEN 23 THEN NULL WHEN 29 THEN 2 ELSE label END AS label,
    CASE sample_id % 50 WHEN 31 THEN '  ' ELSE CAST(sample_id AS VARCHAR) END AS text
  FROM vectors),
flags AS (
  SELECT sample_id, label,
    len(list_filter(features, lambda x: x IS NULL OR isnan(x))) > 0 AS missing_value,
    len(list_filter(features, lambda x: isinf(x))) > 0 AS infinite_value,
    len(features) <> 64 AS wrong_length, label IS NULL AS missing_label,
    coalesce(label NOT IN (0, 1), false) AS label_not_binary, trim(text) = '' AS blank_text
  FROM broken)"""
_row_checks = ["missing_value", "infinite_value", "wrong_length", "missing_label", "label_not_binary", "blank_text"]
put("validation_report", BROKEN,
    " UNION ALL ".join(
        [f"SELECT '{c}' AS \"check\", count(*) FILTER ({c}) AS n, CAST(min(sample_id) FILTER ({c}) AS VARCHAR) AS sample FROM flags"
         for c in _row_checks]
        + ["SELECT 'empty_table', CAST(count(*) = 0 AS BIGINT), NULL FROM flags"]
        + [f"SELECT 'class_{c}_absent', CAST(count(*) FILTER (label = {c}) = 0 AS BIGINT), NULL FROM flags" for c in (0, 1)]
    ))
put("duplicate_names", "SELECT md5(text) AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
HEADERS = """
l AS (SELECT c_custkey AS pos, 'Supplier#' || right(c_name, 9) AS name FROM customer),
r AS (SELECT s_suppkey + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS pos, s_name AS name FROM supplier)"""
put("schema_diff", HEADERS,
    "SELECT coalesce(l.pos, r.pos) AS pos, l.name AS left_name, r.name AS right_name FROM l FULL JOIN r ON l.pos = r.pos "
    "WHERE l.name IS DISTINCT FROM r.name")
put("missing_features", HEADERS,
    "SELECT pos, name FROM l WHERE name NOT IN (SELECT name FROM r)")
put("select_features", VECTORS,
    "SELECT sample_id, CAST(p AS INT) AS pos, round(features[[5, 0, 63, 17][p + 1] + 1], 6) AS value "
    "FROM vectors, (SELECT unnest(range(4)) AS p)")
put("class_counts", LINES, "SELECT label, count(*) AS n FROM lines GROUP BY label")

# --- sampling and ranking -------------------------------------------------------------------------

put("sample_uniform",
    "SELECT o_orderkey AS sample_id, o_totalprice, md5('42:' || o_orderkey) AS sample_order FROM orders "
    "ORDER BY sample_order, o_orderkey LIMIT 5000")
put("sample_balanced", """
l AS (SELECT d.doc_id AS sample_id, quality AS label, md5('42:' || d.doc_id) AS sample_order
      FROM documents d JOIN labels USING (doc_id)),
size AS (SELECT least(min(n), 100 // 2) AS per FROM (SELECT count(*) AS n FROM l GROUP BY label)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_order, sample_id) AS r FROM l)""",
    "SELECT sample_id, label, sample_order FROM ranked, size WHERE r <= per")


def mutual_info(rows: str, names: str) -> str:
    """CTE ``scores`` by comparing all pairs of values of a feature."""
    near = "CASE WHEN r > 0 THEN kk ELSE c END"
    return f"""
mi_long AS (SELECT label AS y, unnest(features) AS v, unnest(range(len(features))) AS pos FROM {rows}),
mi_size AS (SELECT label AS y, count(*) AS ny FROM {rows} GROUP BY label HAVING count(*) > 1),
mi_h AS (SELECT pos, v, y, ny, least(3, ny - 1) AS kk, count(*) AS c FROM mi_long JOIN mi_size USING (y) GROUP BY ALL),
mi_d AS (SELECT a.pos, a.v, a.y, a.kk, abs(b.v - a.v) AS d, CASE WHEN a.v = b.v THEN b.c - 1 ELSE b.c END AS n
         FROM mi_h a JOIN mi_h b ON a.pos = b.pos AND a.y = b.y),
mi_s AS (SELECT *, sum(n) OVER (PARTITION BY pos, v, y ORDER BY d) AS seen FROM mi_d),
mi_r AS (SELECT pos, v, y, min(d) AS r FROM mi_s WHERE seen >= kk GROUP BY pos, v, y),
mi_m AS (SELECT a.pos, a.v, a.y, r, sum(b.c) AS m FROM mi_r a JOIN mi_h b
           ON a.pos = b.pos AND CASE WHEN r > 0 THEN abs(b.v - a.v) < greatest(r - (r * 1e-9 + abs(a.v) * 1e-15), r / 2) ELSE b.v = a.v END GROUP BY a.pos, a.v, a.y, r),
mi_n AS (SELECT CAST(sum(ny) AS DOUBLE) AS n FROM mi_size),
mi_t AS (SELECT pos, sum(c * ({digamma_sql(f"CAST({near} AS DOUBLE)")} - {digamma_sql("CAST(m AS DOUBLE)")}
                  - {digamma_sql("CAST(ny AS DOUBLE)")})) AS total FROM mi_m JOIN mi_h USING (pos, v, y) GROUP BY pos),
scores AS (SELECT {names}[pos + 1] AS feature, pos, greatest(total / n + {digamma_sql("n")}, 0.0) AS score FROM mi_t, mi_n)"""


TRAIN = "train AS (SELECT * FROM vectors WHERE split = 'train')"
put("mutual_info_knn", VECTORS, mutual_info("vectors", NAMES), "SELECT feature, round(score, 6) AS score FROM scores")
ORACLES["mutual_info_appended"] = ORACLES["mutual_info_knn"]
put("mutual_info_runs", DOCUMENTS, mutual_info("docs", lst(X.DOCUMENT_NAMES)), "SELECT feature, round(score, 6) AS score FROM scores")
put("select_best_features", VECTORS, TRAIN, mutual_info("train", NAMES),
    f"SELECT feature, round(score, 6) AS score FROM scores ORDER BY scores.score DESC, feature LIMIT {Q.TOP_FEATURES}")
put("top10_features", VECTORS, mutual_info("vectors", NAMES),
    "SELECT CAST(row_number() OVER (ORDER BY score DESC, feature) AS INT) AS rank, feature, round(score, 6) AS score "
    "FROM scores ORDER BY scores.score DESC, feature LIMIT 10")
put("mi_cache_roundtrip", DOCUMENTS, mutual_info("docs", lst(X.DOCUMENT_NAMES)),
    "SELECT feature, round(score, 6) AS score FROM scores")
put("mutual_info_binned", LINES, f"""
b_long AS (SELECT label AS y, unnest(features) AS v, unnest(range(len(features))) AS pos FROM lines),
b_bins AS (SELECT pos, y, (rank() OVER (PARTITION BY pos ORDER BY v) - 1) * 10 // count(*) OVER (PARTITION BY pos) AS bin
           FROM b_long),
b_cells AS (SELECT pos, bin, y, count(*) AS c FROM b_bins GROUP BY ALL),
b_joint AS (SELECT *, sum(c) OVER (PARTITION BY pos, bin) AS cb, sum(c) OVER (PARTITION BY pos, y) AS cy,
                   CAST(sum(c) OVER (PARTITION BY pos) AS DOUBLE) AS n FROM b_cells)""",
    f"SELECT {lst(X.LINE_NAMES)}[pos + 1] AS feature, round(greatest(sum(c / n * ln(c * n / (cb * cy))), 0.0), 6) AS score "
    "FROM b_joint GROUP BY pos")
ORACLES["mutual_info_sketched"] = ORACLES["mutual_info_binned"]
put("top_abs_features", VECTORS, LONG, """
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(CAST(v AS FLOAT)) DESC, pos) AS r FROM long),
kept AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS slot FROM ranked WHERE r <= 10)""",
    "SELECT sample_id, CAST(slot AS INT) AS slot, CAST(pos AS INT) AS pos, round(v, 6) AS value FROM kept")
put("standardize", ALL_DOCUMENTS, """
d_long AS (SELECT sample_id, unnest(features) AS v, unnest(range(len(features))) AS pos FROM docs),
d_fit AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM d_long GROUP BY pos)""",
    "SELECT sample_id, CAST(pos AS INT) AS pos, round((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS value "
    "FROM d_long JOIN d_fit USING (pos)")

# --- neighbours and votes -------------------------------------------------------------------------

_nn_similarity = "SELECT query_id, rank, sample_id, label, round(s, 6) AS similarity FROM nn"
put("knn_cosine", SIDES, knn(Q.K_NEAREST), _nn_similarity)
put("knn_inner_product", SIDES, knn(Q.K_NEAREST, "ip"), _nn_similarity)
put("knn_l2", SIDES, knn(Q.K_NEAREST, "l2"), _nn_similarity.replace("similarity", "distance"))
put("knn_pruned", ALL_DOCUMENTS, """
f AS (SELECT sample_id, label, list_transform(features, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS v FROM docs),
q AS (SELECT sample_id AS query_id, v FROM f),
i AS (SELECT sample_id, v, label FROM f)""", knn(Q.K_NEAREST, "l2"), _nn_similarity.replace("similarity", "distance"))


def knn_by_prefix(k: int, prefixes, metric: str = "cosine") -> str:
    """As ``knn`` for every prefix p of the vectors."""
    one = knn(k, metric).replace("q.v", "q.v[1:p]").replace("i.v", "i.v[1:p]").replace("PARTITION BY query_id", "PARTITION BY query_id, p")
    one = one.replace("FROM q, i)", f"FROM q, i, (SELECT unnest({lst(prefixes)}) AS p))")
    return one.replace("SELECT query_id, sample_id, i.label", "SELECT query_id, p, sample_id, i.label").replace("SELECT query_id, sample_id, label", "SELECT query_id, p, sample_id, label")


put("knn_prefixes", SIDES, knn_by_prefix(Q.K_NEAREST, Q.PREFIXES),
    "SELECT query_id, CAST(p AS INT) AS prefix, rank, sample_id, label, round(s, 6) AS similarity FROM nn")
put("knn_prefixes_l2", ALL_DOCUMENTS, """
f AS (SELECT sample_id, CAST(CAST(features AS FLOAT[]) AS DOUBLE[]) AS v, label FROM docs),
q AS (SELECT sample_id AS query_id, v FROM f),
i AS (SELECT sample_id, v, label FROM f)""", knn_by_prefix(Q.K_NEAREST, (2, 5), "l2"),
    "SELECT query_id, CAST(p AS INT) AS prefix, rank, sample_id, round(s, 6) AS distance FROM nn")
put("knn_single", VECTORS, """
first AS (SELECT features AS f FROM vectors ORDER BY sample_id LIMIT 1),
scored AS (SELECT sample_id, label, list_cosine_similarity(features, f) AS s FROM vectors, first)""",
    "SELECT sample_id, label, round(s, 6) AS similarity FROM scored ORDER BY round(s, 12) DESC, sample_id LIMIT 10")
put("neighbor_metadata", SIDES, knn(Q.K_NEAREST),
    "SELECT query_id, rank, sample_id, nn.label, CAST(len(i.v) AS INT) AS width, round(i.v[1], 6) AS first_value "
    "FROM nn JOIN i USING (sample_id)")
put("index_roundtrip", SIDES, knn(Q.K_NEAREST),
    "SELECT query_id, rank, sample_id, label, round(s, 6) AS similarity, true AS built, false AS rebuilt FROM nn")
put("index_append", SIDES, knn(Q.K_NEAREST), "SELECT query_id, rank, sample_id, round(s, 6) AS similarity FROM nn")
ORACLES["index_cells"] = ORACLES["index_append"]
put("index_cells_append", SIDES, knn(Q.K_NEAREST, "l2"), "SELECT query_id, rank, sample_id, round(s, 6) AS distance FROM nn")
ORACLES["knn_tree"] = ORACLES["knn_pruned"]
put("majority_vote", SIDES, knn(Q.K_NEAREST), VOTES,
    "SELECT query_id, votes_0, votes_1, nearest_label, prediction, margin FROM votes")
put("stream_score", SIDES, knn(Q.K_NEAREST), VOTES,
    "SELECT query_id, votes_0, votes_1, nearest_label, prediction FROM votes")
LISTS = f"""
lists AS (
  SELECT query_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY rank) AS neighbor_labels,
         string_agg({SIGNED.format('CAST(s AS FLOAT)')}, ',' ORDER BY rank) AS neighbor_similarities
  FROM nn GROUP BY query_id)"""
put("stream_versions", SIDES, knn(Q.K_NEAREST).replace("FROM q, i)", "FROM q, i WHERE query_id % 10 <> 0 OR sample_id % 2 = 0)"), VOTES,
    "SELECT query_id, votes_0, votes_1, nearest_label, prediction, CASE WHEN query_id % 10 = 0 THEN 1 ELSE 2 END AS version FROM votes")
put("neighbor_lists", SIDES, knn(5), LISTS, "SELECT * FROM lists")
_s = SINGLE.format("s")
_w = f"least(greatest(({_s} + 1) / 2, 0), 1)"
EVIDENCE_ONLY = f"""
evidence AS (
  SELECT query_id, coalesce(avg({_s}) FILTER (label = 0), 0) AS mean_similarity_0,
         coalesce(avg({_s}) FILTER (label = 1), 0) AS mean_similarity_1,
         coalesce(sum({_w}) FILTER (label = 0), 0) AS weight_0, coalesce(sum({_w}) FILTER (label = 1), 0) AS weight_1
  FROM nn GROUP BY query_id)"""
EVIDENCE = VOTES + "," + EVIDENCE_ONLY
put("neighbor_evidence", SIDES, knn(5), EVIDENCE,
    "SELECT query_id, votes_0, votes_1, nearest_label, prediction AS majority, round(mean_similarity_0, 6) AS mean_similarity_0, "
    "round(mean_similarity_1, 6) AS mean_similarity_1, round(weight_0, 6) AS weight_0, round(weight_1, 6) AS weight_1 "
    "FROM votes JOIN evidence USING (query_id)")
_mad = "list_sum(list_transform(range(1, len(q.v) + 1), lambda p: abs(q.v[p] - i.v[p]))) / len(q.v)"
DISTANCE = f"""
shown AS (SELECT nn.*, i.v AS raw, q.v AS query_raw, {_mad} AS mad
          FROM nn JOIN i USING (sample_id) JOIN q USING (query_id))"""
put("mean_abs_distance", SIDES, knn(Q.K_NEAREST), DISTANCE,
    "SELECT query_id, rank, sample_id, round(mad, 6) AS mean_abs_distance FROM shown")

# --- metrics --------------------------------------------------------------------------------------

RATES = """
classes AS (SELECT unnest([0, 1]) AS c),
rates0 AS (
  SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS support,
         count(*) FILTER (prediction = c) AS predicted FROM lines, classes GROUP BY c),
rates AS (
  SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM rates0)"""
put("metrics_summary", LINES, RATES,
    "SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, "
    "round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM rates")
put("confusion_matrix", LINES,
    "SELECT label AS truth, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1 "
    "FROM lines GROUP BY label")
_weighted = ", ".join(f"round(sum({c} * support) / sum(support), 6)" for c in ("precision", "recall", "f1"))
put("classification_report", LINES, RATES,
    f"SELECT {NAME_OF.format('c')} AS entry, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rates "
    "UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rates "
    "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM rates "
    f"UNION ALL SELECT 'weighted avg', {_weighted}, CAST(sum(support) AS BIGINT) FROM rates")

# --- rows as text, vectors of texts ---------------------------------------------------------------

STATEMENT = f"{NAMES}[pos + 1] || ' has standardized value ' || " + SIGNED.format("CAST(v AS FLOAT)")
put("feature_statements", VECTORS, LONG, """
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(CAST(v AS FLOAT)) DESC, pos) AS r FROM long),
kept AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS slot FROM ranked WHERE r <= 10)""",
    f"SELECT sample_id, CAST(slot AS INT) AS slot, {STATEMENT} AS statement FROM kept")
CHUNKS = LONG + f""",
chunks AS (SELECT sample_id, CAST(pos // 8 AS INT) AS chunk_no,
                  {text(CHUNK_PREFIX)} || string_agg({STATEMENT}, '; ' ORDER BY pos) || '.' AS chunk
           FROM long GROUP BY sample_id, pos // 8)"""
put("text_chunks", VECTORS, CHUNKS, "SELECT sample_id, chunk_no, chunk FROM chunks")
LABELS = lst(display_labels(X.VECTOR_NAMES, feature_descriptions()))
ITEM = "{labels}[{p}] || '=' || printf('%+.3f', CAST(CAST({v}[{p}] AS FLOAT) AS DOUBLE))"


def items(v: str, n: str) -> str:
    item = ITEM.format(labels=LABELS, p="p", v=v)
    return f"list_transform(range(1, least({n}, len({v})) + 1), lambda p: {item})"


put("display_vector", VECTORS,
    f"SELECT sample_id, array_to_string({items('features', '5')}, ', ') AS displayed FROM vectors")
put("l2_normalize", ALL_DOCUMENTS,
    "n AS (SELECT sample_id, features, sqrt(list_sum(list_transform(features, lambda x: x * x))) AS s FROM docs), "
    "u AS (SELECT sample_id, s, unnest(features) AS v, unnest(range(len(features))) AS pos FROM n)",
    "SELECT sample_id, CAST(pos AS INT) AS pos, round(CASE WHEN s > 0 THEN v / s ELSE v END, 6) AS value FROM u")


def hashing(source: str, keys: str, column: str, out: str) -> str:
    """CTE ``out`` (keys, bucket, x): unit vectors without their zero entries."""
    return rf"""
{out}_w AS (SELECT {keys}, unnest(list_filter(string_split_regex({column}, '[ \t\r\n]+'), lambda w: w <> '')) AS w FROM {source}),
{out}_h AS (SELECT {keys}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM {out}_w),
{out}_s AS (SELECT {keys}, h % 64 AS bucket, CAST(sum(1 - 2 * ((h // 64) % 2)) AS DOUBLE) AS s FROM {out}_h GROUP BY ALL),
{out} AS (SELECT {keys}, bucket,
            coalesce(s / nullif(sqrt(sum(s * s) OVER (PARTITION BY {keys})), 0), 0) AS x FROM {out}_s)"""


put("embed_hashing", hashing("documents", "doc_id", "text", "hv"),
    "g AS (SELECT doc_id, unnest(range(64)) AS b FROM documents)",
    "SELECT g.doc_id, CAST(b AS INT) AS pos, round(coalesce(x, 0), 6) AS value "
    "FROM g LEFT JOIN hv ON g.doc_id = hv.doc_id AND g.b = hv.bucket")
put("embed_callback", """
letters AS (SELECT doc_id, list_transform(['a','b','c','d','e','f','g','h'],
              lambda c: CAST(length(text) - length(replace(text, c, '')) + 1 AS DOUBLE)) AS v FROM documents),
n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM letters),
u AS (SELECT doc_id, s, unnest(v) AS x, unnest(range(8)) AS pos FROM n)""",
    "SELECT doc_id, CAST(pos AS INT) AS pos, round(CAST(CAST(x / s AS FLOAT) AS DOUBLE), 6) AS value FROM u")
put("embed_distinct", r"""
lines AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(translate(x, chr(9) || chr(13), '  ')) <> '')) AS line FROM documents),
letters AS (SELECT doc_id, line, list_transform(['a','b','c','d','e','f','g','h'],
              lambda c: CAST(length(line) - length(replace(line, c, '')) + 1 AS DOUBLE)) AS v FROM lines),
n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM letters),
u AS (SELECT doc_id, CAST(CAST(unnest(v) / s AS FLOAT) AS DOUBLE) AS x, unnest(range(8)) AS pos FROM n),
m AS (SELECT doc_id, pos, avg(x) AS m FROM u GROUP BY doc_id, pos)""",
    "SELECT doc_id, CAST(pos AS INT) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY doc_id)), 6) AS value, "
    "(SELECT count(DISTINCT line) FROM lines) AS encoded FROM m")
put("mean_pool", """
m_long AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(64)) AS pos FROM embeddings),
m_mean AS (SELECT label, pos, avg(v) AS m FROM m_long GROUP BY label, pos),
m_unit AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM m_mean)""",
    "SELECT label, CAST(pos AS INT) AS pos, round(x, 6) AS value FROM m_unit")

# --- prompts and answers --------------------------------------------------------------------------

HEAD = (
    f"'label=' || upper({NAME_OF.format('label')}) || '; cosine_similarity=' || {SIGNED.format('CAST(s AS FLOAT)')} || "
    f"'; full_vector_mean_abs_distance=' || {FIXED.format('CAST(mad AS FLOAT)')} || '; displayed_features=['"
)
FRAGMENTS = f"""
frag AS (SELECT query_id, rank, {HEAD} AS head, {items('raw', '20')} AS items, {items('query_raw', '20')} AS query_items
         FROM shown WHERE rank <= 5)"""
put("prompt_examples", SIDES, knn(5), DISTANCE, FRAGMENTS,
    "SELECT query_id, rank, head, array_to_string(items, ', ') AS items FROM frag")
_big = "upper(" + NAME_OF + ")"
_summary = " || chr(10) || ".join(
    [
        text(P.SUMMARY_TITLE),
        "'- GOODWARE count: ' || votes_0",
        "'- MALWARE count: ' || votes_1",
        f"'- Label-count majority: ' || {_big.format('prediction')}",
        f"'- Mean GOODWARE cosine similarity: ' || {SIGNED.format('mean_similarity_0')}",
        f"'- Mean MALWARE cosine similarity: ' || {SIGNED.format('mean_similarity_1')}",
        f"'- Weighted GOODWARE evidence: ' || {FIXED.format('weight_0')}",
        f"'- Weighted MALWARE evidence: ' || {FIXED.format('weight_1')}",
        f"'- Closest-neighbor class: ' || {_big.format('nearest_label')}",
    ]
)


PLAIN_CHAT = ("'SYSTEM: '", "chr(10) || chr(10) || 'USER: '", "chr(10) || 'ASSISTANT:'")
MARKED_CHAT = ("'<|system|>'", "'<|end|><|user|>'", "'<|end|><|assistant|>'")


def prompt_ctes(pairs: str, chat: tuple[str, str, str] = PLAIN_CHAT) -> str:
    """CTE ``texts``: the prompt of every query, variant and (e, f) of ``pairs``; ``chat`` is written around the two messages."""
    line = "'Example ' || no || ': ' || head || array_to_string(items[1:ff], ', ') || ']'"
    return f"""
variants AS (SELECT * FROM (VALUES (0, 'normal', false, false), (1, 'reversed', true, false), (2, 'compact', false, true))
             AS t(variant_no, variant, reverse, compact)),
pairs_ef AS ({pairs}),
have AS (SELECT query_id, CAST(count(*) AS INT) AS examples FROM frag GROUP BY query_id),
options AS (
  SELECT query_id, variant_no, variant, reverse, compact, examples, e, f,
         CASE WHEN compact THEN least(e, 3) ELSE e END AS ee, CASE WHEN compact THEN least(f, 3) ELSE f END AS ff
  FROM have, variants, pairs_ef WHERE e <= examples),
numbered AS (
  SELECT o.query_id, o.variant_no, o.e, o.f, o.ff, head, items,
         row_number() OVER (PARTITION BY o.query_id, o.variant_no, o.e, o.f ORDER BY CASE WHEN reverse THEN -rank ELSE rank END) AS no
  FROM options o JOIN frag ON o.query_id = frag.query_id AND frag.rank <= o.ee),
shown_lines AS (
  SELECT query_id, variant_no, e, f, string_agg({line}, chr(10) ORDER BY no) AS lines
  FROM numbered GROUP BY query_id, variant_no, e, f),
texts AS (
  SELECT o.*, lines,
    {chat[0]} || {text(P.SYSTEM_TEXT)} || {chat[1]}
    || CASE WHEN compact THEN '' ELSE {text(P.RULES_TEXT)} END || {_summary} || chr(10) || chr(10)
    || CASE WHEN compact THEN {text(P.COMPACT_EXAMPLES_TITLE)} ELSE {text(P.EXAMPLES_TITLE)} END || chr(10)
    || lines || chr(10) || chr(10) || {text(P.QUERY_TITLE)} || chr(10) || 'displayed_features=['
    || array_to_string(query_items[1:ff], ', ') || ']' || chr(10) || chr(10) || {text(P.CLOSING_TEXT)}
    || {chat[2]} AS prompt
  FROM options o JOIN shown_lines USING (query_id, variant_no, e, f)
  JOIN (SELECT query_id, query_items FROM frag WHERE rank = 1) USING (query_id)
  JOIN votes USING (query_id) JOIN evidence USING (query_id))"""


TOKENS = r"len(regexp_extract_all({0}, '(\w+|[^\w\s])', 1))"


def budget_ctes(budget: int, grid: str, chat: tuple[str, str, str] = PLAIN_CHAT, tokens: str = TOKENS) -> str:
    return prompt_ctes(grid, chat) + f""",
counted AS (SELECT *, CAST({tokens.format('prompt')} AS INT) AS tokens, CAST({TOKENS.format('lines')} AS INT) AS neighbor_tokens FROM texts),
best AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY e DESC, f DESC) AS choice
  FROM counted WHERE tokens <= {budget}) WHERE choice = 1)"""


GRID = "SELECT * FROM (SELECT unnest(range(1, 6)) AS e), (SELECT unnest(range(3, 21)) AS f)"
_chosen = (
    "CAST(ee AS INT) AS n_examples, CAST(ff AS INT) AS n_features, tokens AS prompt_tokens, neighbor_tokens, "
    "(ee < CASE WHEN compact THEN least(3, least(5, examples)) ELSE least(5, examples) END) "
    "OR (ff < CASE WHEN compact THEN 3 ELSE 20 END) AS truncated"
)
PROMPT_BASE = (SIDES, knn(Q.K_NEAREST), EVIDENCE, DISTANCE, FRAGMENTS)
put("prompts", *PROMPT_BASE, budget_ctes(CONFIG.max_prompt_tokens, GRID), "SELECT query_id, variant, prompt FROM best")
put("prompt_budget", SIDES, knn(5), EVIDENCE, DISTANCE, FRAGMENTS, budget_ctes(Q.TIGHT_BUDGET, GRID),
    f"SELECT query_id, variant, {_chosen} FROM best")
put("token_usage", *PROMPT_BASE, budget_ctes(CONFIG.max_prompt_tokens, GRID), f"SELECT query_id, variant, {_chosen} FROM best")
put("answers_join", *PROMPT_BASE, budget_ctes(CONFIG.max_prompt_tokens, GRID), ANSWERS,
    "SELECT query_id, variant, raw, tokens AS prompt_tokens FROM best JOIN answers USING (query_id, variant)")
put("prompt_hooks", *PROMPT_BASE, budget_ctes(2 * Q.TIGHT_BUDGET, GRID, MARKED_CHAT, "(length({0}) + 3) // 4"),
    "SELECT query_id, variant, CAST(ee AS INT) AS n_examples, CAST(ff AS INT) AS n_features, tokens AS prompt_tokens, md5(prompt) AS prompt_md5 FROM best")
put("answer_store", f"asked AS ({ORACLES['prompts']})", SIDES, knn(Q.K_NEAREST), VOTES,
    f"SELECT query_id, variant, {NAME_OF.format('prediction')} AS raw, CAST(prediction AS INT) AS vote, "
    "(SELECT count(DISTINCT prompt) FROM asked) AS asked, CAST(0 AS BIGINT) AS asked_again "
    "FROM votes, (SELECT unnest(['normal', 'reversed', 'compact']) AS variant)")
put("answer_callback", SIDES, knn(Q.K_NEAREST), VOTES,
    f"SELECT query_id, variant, {NAME_OF.format('prediction')} AS raw, CAST(prediction AS INT) AS vote "
    "FROM votes, (SELECT unnest(['normal', 'reversed', 'compact']) AS variant)")
put("render_prompt",
    f"SELECT conv_id, turn, 'SYSTEM: ' || {text(P.SYSTEM_TEXT)} || chr(10) || chr(10) || upper(role) || ': ' || text "
    "|| chr(10) || 'ASSISTANT:' AS prompt FROM conversations")
put("parse_answers", ANSWERS, PARSED, "SELECT query_id, variant_no, variant, raw, vote FROM parsed")
put("vote_consensus", ANSWERS, PARSED, CONSENSUS,
    "SELECT query_id, valid_votes, goodware_votes, malware_votes, consensus_votes, candidate, unanimous FROM consensus")
put("decision_fusion", SIDES, knn(Q.K_NEAREST), VOTES, ANSWERS, PARSED, CONSENSUS,
    f"both_ways AS (SELECT *, false AS always FROM ({decision(False)}) UNION ALL SELECT *, true AS always FROM ({decision(True)}))",
    f"SELECT query_id, always, {FUSED_COLUMNS}, unanimous, margin FROM both_ways")
put("results_full", *FUSED_CTES, LISTS, EVIDENCE_ONLY, DISTANCE, FRAGMENTS,
    budget_ctes(CONFIG.max_prompt_tokens, GRID), """
tokens AS (SELECT query_id, string_agg(variant || '=' || tokens, '|' ORDER BY variant) AS prompt_tokens FROM best GROUP BY query_id)""",
    f"""SELECT query_id, {NAME_OF.format('final')} AS prediction, {NAME_OF.format('true_label')} AS true_label, pred_type,
  final AS prediction_num, true_label AS true_label_num, decision_source,
  coalesce({NAME_OF.format('candidate')}, 'invalid') AS llm_prediction, candidate AS llm_prediction_num,
  valid_votes AS llm_valid_votes, consensus_votes AS llm_consensus_votes, goodware_votes AS llm_goodware_votes,
  malware_votes AS llm_malware_votes, unanimous AS llm_unanimous, override_applied AS llm_override_applied,
  {NAME_OF.format('fused.prediction')} AS mv_prediction, fused.prediction AS mv_prediction_num,
  CAST(votes_0 AS INT) AS mv_goodware_votes, CAST(votes_1 AS INT) AS mv_malware_votes, CAST(margin AS INT) AS mv_margin,
  neighbor_labels, neighbor_similarities, coalesce(llm_votes, '') AS llm_votes, raw_outputs AS llm_raw_outputs, prompt_tokens
FROM fused JOIN lists USING (query_id) JOIN tokens USING (query_id)""")

# --- whole runs -----------------------------------------------------------------------------------

put("classify_vote_original", VECTORS, TRAIN, mutual_info("train", NAMES), f"""
top AS (SELECT pos, row_number() OVER (ORDER BY score DESC, feature) AS r FROM scores ORDER BY r LIMIT {Q.TOP_FEATURES}),
picked AS (SELECT list(pos ORDER BY r) AS places FROM top),
reduced AS (SELECT sample_id, label, split, list_transform(places, lambda p: features[p + 1]) AS v FROM vectors, picked),
q AS (SELECT sample_id AS query_id, v, label AS true_label FROM reduced WHERE split = 'test'),
i AS (SELECT sample_id, v, label FROM reduced WHERE split = 'train')""", knn(Q.K_NEAREST), VOTES,
    "SELECT query_id, prediction, true_label, votes_0, votes_1 FROM votes JOIN q USING (query_id)")
put("classify_vote_embedding", VECTORS, CHUNKS, hashing("chunks", "sample_id, chunk_no", "chunk", "hv"), """
pooled0 AS (SELECT sample_id, bucket, sum(x) / 8 AS m FROM hv GROUP BY sample_id, bucket),
pooled AS (SELECT sample_id, bucket, CAST(CAST(m / sqrt(sum(m * m) OVER (PARTITION BY sample_id)) AS FLOAT) AS DOUBLE) AS x FROM pooled0),
dense AS (SELECT id AS sample_id, list(coalesce(x, 0) ORDER BY b) AS v
          FROM (SELECT sample_id AS id, unnest(range(64)) AS b FROM vectors) g LEFT JOIN pooled ON id = sample_id AND b = bucket
          GROUP BY id),
q AS (SELECT sample_id AS query_id, v, label AS true_label FROM dense JOIN vectors USING (sample_id) WHERE split = 'test'),
i AS (SELECT sample_id, v, label FROM dense JOIN vectors USING (sample_id) WHERE split = 'train')""", knn(Q.K_NEAREST), VOTES,
    "SELECT query_id, prediction, true_label, votes_0, votes_1 FROM votes JOIN q USING (query_id)")
put("run_vote", ORACLES["classify_vote_original"].removeprefix("WITH ").rsplit("SELECT query_id, prediction", 1)[0],
    f"SELECT query_id, {NAME_OF.format('prediction')} AS written, true_label, votes_0, votes_1 FROM votes JOIN q USING (query_id)")
ORACLES["run_fused"] = ORACLES["classify_fused"]
ORACLES["prompt_tokenizer"] = ORACLES["prompt_hooks"]
put("dataset_roundtrip", DOCUMENTS, "SELECT sample_id, md5(text) AS text_md5, label FROM docs")
put("text_index_search", ALL_DOCUMENTS, hashing("docs", "sample_id", "text", "hv"), """
dense AS (SELECT id AS sample_id, list(CAST(CAST(coalesce(x, 0) AS FLOAT) AS DOUBLE) ORDER BY b) AS v
          FROM (SELECT sample_id AS id, unnest(range(64)) AS b FROM docs) g LEFT JOIN hv ON id = sample_id AND b = bucket
          GROUP BY id),
q AS (SELECT sample_id AS query_id, v FROM dense),
i AS (SELECT sample_id, v, label FROM dense JOIN docs USING (sample_id))""", knn(3, "l2"),
    "SELECT query_id, rank, sample_id, nn.label, md5(text) AS text_md5, round(s, 6) AS distance FROM nn JOIN docs USING (sample_id)")
_per_k = f"""
nnk AS (SELECT nn.*, k FROM nn, (SELECT unnest({list(Q.SWEEP)}) AS k) WHERE rank <= k),
voted AS (
  SELECT query_id, k, CASE WHEN count(*) FILTER (label = 0) > count(*) FILTER (label = 1) THEN 0
       WHEN count(*) FILTER (label = 0) < count(*) FILTER (label = 1) THEN 1 ELSE min_by(label, rank) END AS prediction
  FROM nnk GROUP BY query_id, k),
judged AS (SELECT voted.*, true_label AS label FROM voted JOIN q USING (query_id)),
rates0 AS (
  SELECT k, c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS support,
         count(*) FILTER (prediction = c) AS predicted FROM judged, (SELECT unnest([0, 1]) AS c) GROUP BY k, c),
rates AS (
  SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM rates0)"""
put("sweep_k", SIDES, knn(max(Q.SWEEP)), _per_k,
    "SELECT CAST(k AS INT) AS k, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, "
    "round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 "
    "FROM rates GROUP BY k")

put("sweep_prefixes", VECTORS, TRAIN, mutual_info("train", NAMES), """
picked AS (SELECT list(pos ORDER BY score DESC, feature) AS places FROM scores),
ordered AS (SELECT sample_id, label, split, list_transform(places, lambda p: features[p + 1]) AS v FROM vectors, picked),
q AS (SELECT sample_id AS query_id, v, label AS true_label FROM ordered WHERE split = 'test'),
i AS (SELECT sample_id, v, label FROM ordered WHERE split = 'train')""", knn_by_prefix(max(Q.SWEEP), Q.PREFIXES), f"""
nnk AS (SELECT nn.*, k FROM nn, (SELECT unnest({list(Q.SWEEP)}) AS k) WHERE rank <= k),
voted AS (
  SELECT query_id, p, k, CASE WHEN count(*) FILTER (label = 0) > count(*) FILTER (label = 1) THEN 0
       WHEN count(*) FILTER (label = 0) < count(*) FILTER (label = 1) THEN 1 ELSE min_by(label, rank) END AS prediction
  FROM nnk GROUP BY query_id, p, k),
judged AS (SELECT voted.*, true_label AS label FROM voted JOIN q USING (query_id)),
rates0 AS (
  SELECT p, k, c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS support,
         count(*) FILTER (prediction = c) AS predicted FROM judged, (SELECT unnest([0, 1]) AS c) GROUP BY p, k, c),
rates AS (
  SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM rates0)""",
    "SELECT CAST(p AS INT) AS top_k_features, CAST(k AS INT) AS k, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, "
    "round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 "
    "FROM rates GROUP BY p, k")

ALL_VOTED = "SELECT query_id, prediction, true_label FROM votes JOIN q USING (query_id)"
put("_all_features", SIDES, knn(Q.K_NEAREST), VOTES, ALL_VOTED)
_runs = " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, {n} AS top_k_features, prediction, true_label FROM ({ORACLES[run]})"
    for mode, n, run in (
        ("original", X.VECTOR_DIM, "_all_features"),
        ("original", Q.TOP_FEATURES, "classify_vote_original"),
        ("embedding", X.VECTOR_DIM, "classify_vote_embedding"),
    )
)
del ORACLES["_all_features"]
put("sweep_settings", f"runs AS ({_runs})", """
rates0 AS (
  SELECT mode, top_k_features, c, count(*) FILTER (true_label = c AND prediction = c) AS tp,
         count(*) FILTER (true_label = c) AS support, count(*) FILTER (prediction = c) AS predicted
  FROM runs, (SELECT unnest([0, 1]) AS c) GROUP BY mode, top_k_features, c),
rates AS (
  SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM rates0)""",
    f"SELECT mode, top_k_features, {Q.K_NEAREST} AS k, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, "
    "round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 "
    "FROM rates GROUP BY mode, top_k_features")

_rest = json.loads(payload(["documents"], CONFIG, X.DOCUMENT_NAMES))
del _rest["classes"]
put("fingerprint", DOCUMENTS, """
t AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM docs)""",
    "SELECT n AS training_rows, sha256('{\"classes\": {\"0\": ' || a || ', \"1\": ' || b || '}, ' || "
    f"{text(json.dumps(_rest, sort_keys=True)[1:])}) AS signature FROM t")
