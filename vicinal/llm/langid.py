"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are combined for every text: character statistics, the language its markup declares, the suffix of its
address, and what is usual on its host. The last two are counted over the whole collection by grouped aggregation and
smoothed from the collection to the suffix to the host. Next to the languages stands the hypothesis that the text is of none
of them (another language, or no language at all): under it every gram is as likely as any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.functions.vectors import let
from vicinal.llm import words as W
from vicinal.llm.rows import KEY, slices, text_of
from vicinal.session import small_batches, stored

LANGUAGES = ("de", "en", "es", "fr")
GRAM = 3
BUCKETS = 1 << 15
#: Labelled texts per language that the character model is fitted on, about; chosen by a hash of the id.
FIT_ROWS = 1_000
#: Grams of a text are not independent: this many count as one observation.
DEPENDENCE = 8.0
#: A declaration is right this often.
DECLARED = 0.9
#: Strength of the coarser level in a prior, in texts.
SUFFIX_STRENGTH, HOST_STRENGTH = 50.0, 20.0
#: Share of texts that are of none of the languages, before anything is known. It is not counted, so that it holds for each host.
OTHER = 0.2
#: However long a text is, its evidence for none of the languages is that of so many grams: a model of 1,000 texts has not seen all.
OTHER_GRAMS = 64
#: Declarations of a language that is not asked for: on texts of none of the languages, on others. And of a certain one that is, on the former.
UNLISTED, UNLISTED_WRONG, LISTED_WRONG = 0.9, 0.05, 0.0025
#: Below this posterior no language is named.
LEAST = 0.5
#: Bytes of rows that travel to a Python worker at once, and of texts that are scored at once, about.
BATCH_BYTES = 1 << 20


def _grams(raw: np.ndarray, at: np.ndarray, gram: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each run of ``gram`` bytes inside one text, A-Z as a-z and all but letters as blanks."""
    folded = W.SMALL[raw]
    letter = ((folded >= 97) & (folded <= 122)) | (folded >= 128)
    folded = np.where(letter, folded, np.uint8(32))
    n = max(0, len(raw) - gram + 1)
    code, some = np.zeros(n, np.uint32), np.zeros(n, bool)
    for k in range(gram):
        code = code * np.uint32(0x01000193) + folded[k : k + n]
        some |= letter[k : k + n]
    code ^= code >> np.uint32(15)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    inside = some & (np.arange(n) + gram <= at[owner + 1]) if n else some
    return (code % np.uint32(buckets)).astype(np.int32)[inside], owner[inside]


def _framed(text: Column) -> Column:
    """With a blank at both ends, so that a single letter is a gram too."""
    return F.concat(F.lit(" "), text, F.lit(" "))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", languages: Sequence[str] = LANGUAGES, fit_rows: int = FIT_ROWS, gram: int = GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Log probabilities (language, bucket) of character grams, from about ``fit_rows`` labelled texts of each language.

    A language without a labelled text gets even probabilities. Rows without a label or with one that is not asked for
    are left out.
    """
    labelled = docs.where(F.col(label_col).isin(*languages)).select(F.col(label_col).alias("lang"), _framed(text_of(text_col)).alias("text"), F.xxhash64(id_col).alias("h"))
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    unit = 1_000_000
    share = F.lit(0.0)
    for name, count in rows.items():
        share = F.when(F.col("lang") == name, min(1.0, fit_rows / count)).otherwise(share)
    sample = labelled.where(F.pmod("h", F.lit(unit)) < share * unit)
    order = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(order), buckets), np.int64)
        for batch in slices(batches, "text"):
            raw, at = W.buffers(batch.column("text"))
            code, owner = _grams(raw, at, gram, buckets)
            lang = np.array([order[x] for x in batch.column("lang").to_pylist()], np.int64)
            total += np.bincount(lang[owner] * buckets + code, minlength=total.size).reshape(total.shape)
        held = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total.ravel()[held])], names=["at", "n"])

    counts = np.ones((len(order), buckets))
    for row in sample.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row["at"] // buckets, row["at"] % buckets] += row["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _likelihoods(model: np.ndarray, gram: int):
    table = np.ascontiguousarray(model.T.astype(np.float32))
    mean = table.mean(axis=1, keepdims=True)
    table = np.hstack([table - mean, np.float32(-np.log(len(table))) - mean])  # the last column is none of the languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            raw, at = W.buffers(batch.column("text"))
            code, owner = _grams(raw, at, gram, len(table))
            sums = np.stack([np.bincount(owner, table[code, k], batch.num_rows) for k in range(table.shape[1])], axis=1)
            best, n = sums[:, :-1].max(axis=1), np.maximum(1, np.bincount(owner, minlength=batch.num_rows))
            sums[:, -1] = best + (sums[:, -1] - best) * np.minimum(1, OTHER_GRAMS / n)
            ends = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
            fields = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            more = [pa.array(np.bincount(owner, minlength=batch.num_rows)), pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel().astype(np.float64)))]
            yield pa.RecordBatch.from_arrays([*fields, *more], names=[*names, "n_grams", "ll"])

    return score


def _softmax(scores: Column) -> Column:
    """Probabilities of an array of log scores."""

    def normal(s: Column) -> Column:
        e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
        return let(e, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, b: a + b)))

    return let(scores, normal)


def _counts(texts: DataFrame, by: list[str], n: int, out: str) -> DataFrame:
    """Expected texts of each language per group; sums are taken before the shuffle, so a hot host is one row per task."""
    sums = [F.sum(F.col("p")[k]).alias(f"__{k}") for k in range(n)]
    grouped = texts.groupBy(*by).agg(*sums) if by else texts.agg(*sums)
    return grouped.select(*by, F.array(*[F.coalesce(f"__{k}", F.lit(0.0)) for k in range(n)]).alias(out))


def _smoothed(counts: Column, coarser: Column, strength: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return let(total, lambda t: F.zip_with(counts, coarser, lambda c, q: (c + strength * q) / (t + strength)))


def identify(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, languages: Sequence[str] = LANGUAGES, gram: int = GRAM, least: float = LEAST) -> DataFrame:
    """(id, __fp, language, probability, n_grams, accepted), one row per row of ``docs``.

    ``declared``, ``host`` and ``suffix`` are expressions over ``docs``; a missing one and a null are no evidence. ``en-GB``
    declares ``en``. A declared code of two letters that is not in ``languages`` is evidence for none of them; other words are
    no evidence. ``probability`` is the best posterior of ``languages``. A text without letters is rejected with language
    ``und``, as is one that is more likely of none of them, by its posterior or by text and declaration alone, or has a
    probability below ``least``; a null text is an empty text. Ties go to the language named first.
    Rows that repeat an id are judged one by one; an empty table gives an empty result; other columns are not needed.
    """
    n = len(languages)
    said = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]+)", 1)) if declared is not None else F.lit(None)
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias(KEY),
        _framed(text).alias("text"),
        said.cast("string").alias("said"),
        (host if host is not None else F.lit(None)).cast("string").alias("host"),
        (suffix if suffix is not None else F.lit(None)).cast("string").alias("suffix"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, {KEY} bigint, said string, host string, suffix string, n_grams bigint, ll array<double>"
    with small_batches(docs.sparkSession, BATCH_BYTES):
        scored = stored(rows.mapInArrow(_likelihoods(model, gram), schema), "likelihoods")

    names = F.array(*[F.lit(x) for x in languages])
    wrong = (1 - DECLARED) / max(1, n - 1)
    listed, unlisted = F.array_contains(names, F.col("said")), F.length("said") == 2
    hint = F.transform(names, lambda x: F.when(listed, F.log(F.when(x == F.col("said"), DECLARED).otherwise(wrong))).when(unlisted, float(np.log(UNLISTED_WRONG))).otherwise(0.0))
    none = F.when(listed, float(np.log(LISTED_WRONG))).when(unlisted, float(np.log(UNLISTED))).otherwise(0.0)
    hint = F.concat(hint, F.array(none))
    own = F.zip_with(F.transform("ll", lambda x: x / DEPENDENCE), hint, lambda a, b: a + b)
    single = scored.where("n_grams > 0").select("host", "suffix", _softmax(own).alias("p"))

    # collection -> suffix -> host. The first is one row; all three are sums over every text.
    whole = _counts(single, [], n, "c").select(_smoothed(F.col("c"), F.array_repeat(F.lit(1.0 / n), n), 1.0).alias("q")).first()
    base = F.array(*[F.lit(float(q)) for q in whole["q"]])
    by_host = _counts(single, ["host", "suffix"], n, "hc")
    by_suffix = by_host.groupBy("suffix").agg(F.array(*[F.sum(F.col("hc")[k]) for k in range(n)]).alias("sc"))
    by_suffix = by_suffix.select(F.col("suffix").alias("__s"), F.when(F.col("suffix").isNull(), base).otherwise(_smoothed(F.col("sc"), base, SUFFIX_STRENGTH)).alias("sq"))
    priors = by_host.join(by_suffix, F.col("suffix").eqNullSafe(F.col("__s")))
    prior = F.when(F.col("host").isNull(), F.col("sq")).otherwise(_smoothed(F.col("hc"), F.col("sq"), HOST_STRENGTH))
    priors = stored(priors.select(F.col("host").alias("__h"), F.col("suffix").alias("__s"), prior.alias("prior")), "priors")

    joined = scored.join(priors, F.col("host").eqNullSafe(F.col("__h")) & F.col("suffix").eqNullSafe(F.col("__s")), "left")
    logs = F.concat(F.transform(F.coalesce("prior", base), lambda q: F.log(q * (1 - OTHER))), F.array(F.lit(float(np.log(OTHER)))))
    posterior = _softmax(F.zip_with(own, logs, lambda a, b: a + b))
    judged = joined.select("id", KEY, "n_grams", own.alias("own"), posterior.alias("post"))
    best = F.array_max(F.slice("post", 1, n))
    place = F.array_position("post", best).cast("int")
    # what is usual settles between languages, but does not outweigh a text that speaks for none of them
    spoken = F.element_at("own", place) >= F.element_at("own", -1) - 1e-3
    accepted = (F.col("n_grams") > 0) & (best >= least) & (best > F.element_at("post", -1)) & spoken
    named = F.when(accepted, F.element_at(names, place)).otherwise("und")
    return judged.select("id", KEY, named.alias("language"), best.alias("probability"), "n_grams", accepted.alias("accepted"))


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with text, declared, host and suffix, ready for ``identify``: markup taken off, ``<html lang>``, last part of the host.

    A null or empty page has a text of nothing, which ``identify`` rejects, and declares nothing. A url without a host, also
    null, gives null for host and suffix, a host without a dot a null suffix. All rows come back, repeated ones as often as they
    came; an empty table gives an empty result; other columns stay, and those named like a result are replaced.
    """
    from vicinal.llm.urlfilter import address

    html = F.coalesce(html_col, F.lit(""))
    plain = F.regexp_replace(html, r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    host, _ = address(F.col(url_col))
    said = F.nullif(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1), F.lit(""))
    others = [c for c in pages.columns if c not in ("host", "declared", "text", "suffix")]
    named = pages.select(*others, F.nullif(host, F.lit("")).alias("host"), said.alias("declared"), plain.alias("text"))
    return named.withColumn("suffix", F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit("")))
