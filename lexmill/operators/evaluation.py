"""Answer metrics, paired comparisons and their bootstrap."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from lexmill.functions import text as T


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, by bit vectors: one big integer, one pass over b."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = at.get(w, 0) & v
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


@pandas_udf(DoubleType())
def _rouge(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    def one(r, p) -> float:
        r, p = list(r), list(p)
        n = _lcs(r, p) if len(r) and len(p) else 0
        return 2 * n / (len(r) + len(p)) if n else 0.0

    return pd.Series([one(r, p) for r, p in zip(reference, prediction)], dtype=float)


def rouge_l(reference: Column, prediction: Column) -> Column:
    """Harmonic F of the longest common subsequence over ASCII words; 0 if either side has none."""
    empty = F.array().cast("array<string>")
    return _rouge(F.coalesce(T.rouge_tokens(reference), empty), F.coalesce(T.rouge_tokens(prediction), empty))


def meteor(reference: Column, prediction: Column) -> Column:
    """METEOR by NLTK, where it and its WordNet data are installed."""
    try:
        from nltk.translate.meteor_score import meteor_score
    except ImportError as e:
        raise RuntimeError("METEOR needs NLTK and its WordNet data") from e

    @pandas_udf(DoubleType())
    def score(r: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([meteor_score([x.split()], y.split()) for x, y in zip(r, p)], dtype=float)

    return score(reference, prediction)


def score_mapping(references: DataFrame, predictions: DataFrame, *, id_col: str = "question_id") -> DataFrame:
    """``id, rouge_l`` for two tables of the same ids; an id on one side only is an error."""
    j = references.select(id_col, F.col("answer").alias("r"), F.lit(True).alias("in_r")).join(
        predictions.select(id_col, F.col("answer").alias("p"), F.lit(True).alias("in_p")), id_col, "full_outer")
    bad = F.raise_error(F.concat(F.lit("id on one side only: "), F.col(id_col).cast("string"))).cast("string")
    return j.select(id_col, F.when(F.col("in_r") & F.col("in_p"), F.col("r")).otherwise(bad).alias("r"), "p").select(id_col, rouge_l(F.col("r"), F.col("p")).alias("rouge_l"))


def answer_diagnostics(answer: Column) -> list[Column]:
    """Four flags: a repeated line (8 characters on), a repeated sentence (20 on), an abbreviation loop, no end mark."""
    lines = F.filter(F.transform(F.split(answer, "\r?\n"), F.trim), lambda x: F.length(x) >= 8)
    sentences = F.filter(F.transform(F.split(answer, r"(?<=[.!?])\s+"), F.trim), lambda x: F.length(x) >= 20)
    return [
        (F.size(lines) != F.size(F.array_distinct(lines))).alias("duplicate_line"),
        (F.size(sentences) != F.size(F.array_distinct(sentences))).alias("duplicate_sentence"),
        answer.rlike("(?:-[A-ZĐ]{2,10}){10,}").alias("abbreviation_loop"),
        (~F.trim(answer).rlike("[.!?;:]$")).alias("non_sentence_ending"),
    ]


def coverage(answer: Column, contexts: Column) -> Column:
    """Share of an answer's distinct words that its contexts hold; null without words."""
    a, c = F.array_distinct(T.word_list(answer)), F.array_distinct(T.word_list(contexts))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, c)) / F.size(a))


def paired(scores: DataFrame, *, variant: str, id_col: str, metric: str, control: str, candidate: str) -> DataFrame:
    """``id, delta`` (candidate minus control); an id that lacks a side is an error."""
    p = scores.groupBy(id_col).pivot(variant, [control, candidate]).agg(F.first(metric))
    bad = F.raise_error(F.lit("a pair lacks a side")).cast("double")
    return p.select(id_col, F.when(F.col(f"`{control}`").isNotNull() & F.col(f"`{candidate}`").isNotNull(), F.col(f"`{candidate}`") - F.col(f"`{control}`")).otherwise(bad).alias("delta"))


def paired_summary(deltas: DataFrame, *by: str) -> DataFrame:
    """Mean delta and how many rows rose, fell and tied; a null mean without rows."""
    d = F.col("delta")
    return deltas.groupBy(*by).agg(F.avg("delta").alias("mean_delta"), F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("worsened"), F.count_if(d == 0).alias("tied"))


def bootstrap_ci(values: DataFrame, *, column: str, order: str, seed: str, iterations: int = 10_000) -> DataFrame:
    """``low, high``: the 2.5 and 97.5 percent means of seeded resamples, in the order of ``order``.

    The generator is Python's, seeded by the SHA-256 of the seed, so bounds repeat exactly. One
    evaluation sample (a few thousand numbers) meets in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[column].to_numpy(float)
        rng = random.Random(hashlib.sha256(seed.encode()).digest())
        means = np.sort([v[[rng.randrange(len(v)) for _ in range(len(v))]].mean() for _ in range(iterations)])
        return pd.DataFrame({"low": [means[int(0.025 * (iterations - 1))]], "high": [means[int(0.975 * (iterations - 1))]]})

    return values.select(order, column).groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: run(pdf), "low double, high double")


def bootstrap_all(values: DataFrame, *, column: str, seed: str, iterations: int = 10_000) -> DataFrame:
    """``low, high`` as in ``bootstrap_ci``, over all rows: what meets in one task is the count of each distinct value.

    A resample of n rows is a multinomial draw of those counts. The generator is NumPy's PCG64, seeded
    by the SHA-256 of the seed. Meant for metrics of few distinct values; nulls are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(column)
        v, c = pdf[column].to_numpy(float), pdf["count"].to_numpy("int64")
        rng, n = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(seed.encode()).digest()))), int(c.sum())
        means = np.sort([rng.multinomial(n, c / n) @ v / n for _ in range(iterations)])
        return pd.DataFrame({"low": [means[int(0.025 * (iterations - 1))]], "high": [means[int(0.975 * (iterations - 1))]]})

    counts = values.where(F.col(column).isNotNull()).groupBy(column).count()
    return counts.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: run(pdf), "low double, high double")


def _resampled(seed: str, iterations: int, column: str):
    """Of each batch of distinct values and counts the sums of ``iterations`` Poisson resamples, and their sizes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, size = np.zeros(iterations), np.zeros(iterations, np.int64)
        for pdf in batches:
            for v, n in zip(pdf[column].to_numpy(float), pdf["count"]):
                w = poisson_weights(seed, v, n, iterations)
                total += w * v
                size += w
        if size.any():
            yield pd.DataFrame({"draw": np.arange(iterations), "total": total, "n": size})

    return run


def poisson_weights(seed: str, value: float, n: int, iterations: int) -> np.ndarray:
    """How often each resample draws a value that is there n times: Poisson of mean n, by a generator of the seed and the value alone."""
    key = hashlib.sha256(f"{seed}:{float(value)!r}".encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(key))).poisson(n, iterations)


def bootstrap_poisson(values: DataFrame, *, column: str, seed: str, iterations: int = 10_000, by: list[str] | None = None) -> DataFrame:
    """``low, high`` (for each group of ``by``): the 2.5 and 97.5 percent means of resamples of any number of rows, by any number of tasks.

    In place of n draws from n rows each row is drawn Poisson(1) times, so resamples are sums over rows and partitions
    add up: each gives one row for each resample. Rows of one value are drawn together. A resample's mean is over what
    it drew; draws depend on the seed and the value, not on how rows are dealt. Nulls are left out; no rows give none.
    """
    by = by or []
    counts = values.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias(column)).count()
    if by:
        kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by)

        def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for key, part in pdf.groupby(by, dropna=False):
                    for out in _resampled(seed, iterations, column)(iter([part])):
                        yield out.assign(**{c: pd.Series([None if pd.isna(k) else k] * len(out), dtype=object) for c, k in zip(by, key)})[[*by, "draw", "total", "n"]]

        parts = counts.mapInPandas(grouped, f"{kinds}, draw long, total double, n long")
    else:
        parts = counts.mapInPandas(_resampled(seed, iterations, column), "draw long, total double, n long")
    means = parts.groupBy(*by, "draw").agg((F.sum("total") / F.sum("n")).alias("mean"))
    rank = Window.partitionBy(*by).orderBy("mean")  # as many rows a group as there are resamples
    nth = means.where("mean is not null").select(*by, "mean", F.row_number().over(rank).alias("i"), F.count("*").over(Window.partitionBy(*by)).alias("m"))
    at = lambda q: F.max(F.when(F.col("i") == F.floor((F.col("m") - 1) * q) + 1, F.col("mean")))
    return nth.groupBy(*by).agg(at(0.025).alias("low"), at(0.975).alias("high")).where("low is not null")


def leader(metrics: DataFrame, *, variant: str, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """The variant with the greatest keys, in that order (ties: the last name)."""
    return metrics.groupBy(*(by or [])).agg(F.max(F.struct(*keys, variant)).alias("m")).select(*(by or []), F.col(f"m.{variant}").alias(variant), *[F.col(f"m.{k}").alias(k) for k in keys])


def promotion(summary: DataFrame) -> DataFrame:
    """``promoted``: the mean delta and the lower bound are above zero."""
    return summary.withColumn("promoted", (F.col("mean_delta") > 0) & (F.col("low") > 0))


# References to articles and to numbered documents in an answer.
ANSWER_ARTICLE = r"(?iU)\bĐiều\s+([0-9]+(?:[a-zđ])?)"
ANSWER_DOCUMENT = r"(?U)\b[0-9]{1,4}/[0-9]{4}/[A-ZĐ]+(?:-[A-ZĐ0-9]+)+\b"


def answer_derived(answer: Column, contexts: Column) -> list[Column]:
    """How much of an answer its contexts (an array of ``text, article_number``) hold: words, and the references it makes.

    An article is held if a context is of it or names it, a document if a context names its number.
    """
    whole = F.array_join(F.transform(contexts, lambda c: F.coalesce(c["text"], F.lit(""))), "\n")
    words, held = F.array_distinct(T.folded_tokens(answer)), T.folded_tokens(whole)
    folded = F.transform(contexts, lambda c: T.fold_accents(F.coalesce(c["text"], F.lit(""))))
    articles = F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit(ANSWER_ARTICLE), F.lit(1)))
    documents = F.array_distinct(F.regexp_extract_all(F.upper(answer), F.lit(ANSWER_DOCUMENT), F.lit(0)))
    of = F.transform(contexts, lambda c: F.lower(F.coalesce(c["article_number"], F.lit(""))))
    article_hits = F.size(F.filter(articles, lambda a: F.array_contains(of, a) | F.exists(folded, lambda t: t.contains(F.concat(F.lit("dieu "), T.fold_accents(a))))))
    document_hits = F.size(F.filter(documents, lambda n: T.fold_accents(whole).contains(T.fold_accents(n))))
    made, hits = F.size(articles) + F.size(documents), article_hits + document_hits
    return [
        F.size(words).alias("answer_words"), F.when(F.size(words) > 0, F.size(F.array_intersect(words, held)) / F.size(words)).otherwise(0.0).alias("coverage"),
        made.alias("references"), hits.alias("reference_hits"), (hits > 0).alias("any_hit"), ((made > 0) & (hits == made)).alias("all_hit"), F.length(whole).alias("context_characters")]


def changed_effect(deltas: DataFrame, changed: Column) -> DataFrame:
    """``paired_summary`` over all rows and over the changed ones only: ``scope, questions, mean_delta, improved, worsened, tied``."""
    d = deltas.withColumn("scope", F.explode(F.when(changed, F.array(F.lit("all"), F.lit("changed"))).otherwise(F.array(F.lit("all")))))
    return d.groupBy("scope").agg(
        F.count("*").alias("questions"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("improved"),
        F.count_if(F.col("delta") < 0).alias("worsened"), F.count_if(F.col("delta") == 0).alias("tied"))
