"""Inverted-index retrieval (BM25 over words or trigrams) and exact dense search."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.session import durable, spread

K1, B = 1.2, 0.75


def postings(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """``id, term, tf, dl``: one row per document and term, dl its number of tokens.

    Counted within each document's own array before anything is shuffled, so a frequent term costs
    one row per document and no shuffle is keyed by term here.
    """
    d = docs.select(F.col(id_col).alias("id"), tokens.alias("t"))
    return d.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: number of documents and their mean length."""
    return docs.select(F.size(tokens).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def top_k(scored: DataFrame, k: int, query: str = "query_id", item: str = "id", score: str = "score", within: tuple[str, ...] = ()) -> DataFrame:
    """Best k rows of each query (and ``within`` columns) by (score desc, item); Spark cuts each partition to k before the shuffle."""
    w = Window.partitionBy(*within, query).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries of one block; each is scored in one pass over the documents' own counts of its terms.
QUERY_BLOCK = 2048

#: Documents whose tokens or texts are counted at one time, and (term, query) pairs that are scored at one time.
COUNT_ROWS, SCORE_PAIRS = 1024, 1 << 20

#: ``(terms of the block) -> (documents' column values) -> (row << 32 | term number of each hit, hits it stands for, lengths)``
Counter_ = Callable[[dict[str, int]], Callable[[pa.Array], tuple[np.ndarray, np.ndarray, pa.Array]]]


def _count_tokens(vocabulary: dict[str, int]):
    known = pa.array(list(vocabulary), pa.string())

    def count(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        lengths = pc.list_value_length(tokens)
        rows = np.repeat(np.arange(len(tokens)), pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False))
        term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        key = (rows[term >= 0] << 32) | term[term >= 0]
        return key, np.ones(len(key), np.int64), lengths

    return count


def _count_substrings(shortest: int):
    """Terms as substrings of a text's words; what a word holds is found once and remembered in a bounded table."""
    word = regex.compile(T.WORDS)

    def over(vocabulary: dict[str, int]):
        lengths = sorted({len(t) for t in vocabulary})
        known: dict[str, tuple[tuple[int, int], ...]] = {}

        def look(w: str) -> tuple[tuple[int, int], ...]:
            if len(known) > 400_000:
                known.clear()
            found = {w[i : i + n] for n in lengths for i in range(len(w) - n + 1)} & vocabulary.keys()
            out = known[w] = tuple((vocabulary[t], w.count(t)) for t in sorted(found))
            return out

        def count(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
            key, tf, sizes = array("q"), array("q"), []
            for row, value in enumerate(texts):
                text = value.as_py()
                sizes.append(None if text is None else max(len(text) - 2, 0))
                for w in word.findall(text or ""):
                    if len(w) >= shortest:
                        for j, n in known.get(w) or look(w):
                            key.append(row << 32 | j)
                            tf.append(n)
            return np.array(key, np.int64), np.array(tf, np.int64), pa.array(sizes, pa.int64())

        return count

    return over


def ten_decimals(x: np.ndarray) -> np.ndarray:
    """Rounded to ten decimals, halves away from zero as SQL's ``round`` has them; NumPy's go to the even digit."""
    y = x * 1e10
    whole = np.trunc(y)
    return (whole + (y - whole >= 0.5) - (y - whole <= -0.5)) / 1e10


def exact_parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` as two parts whose sums, added, are rounded once and so alike in any order: what lies above 2**-20 adds up without rounding."""
    high = np.rint(values * 2.0**20) * 2.0**-20
    return high, values - high


def _best_by_query(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (score, id, query number) the best k of each query, by falling score and then id."""
    order = np.lexsort((ids, -scores, queries))
    q = queries[order]
    first = np.searchsorted(q, q)  # place where each row's query begins
    keep = order[np.arange(len(q)) - first < k]
    return scores[keep], ids[keep], queries[keep]


def _parts(rows: pd.DataFrame, cost: np.ndarray) -> Iterator[pd.DataFrame]:
    """Runs of at most 500 rows that cost ``SCORE_PAIRS`` together, or one row that costs more."""
    lo, total = 0, np.cumsum(cost)
    while lo < len(rows):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SCORE_PAIRS, "right"))
        hi = min(max(hi, lo + 1), lo + 500)
        yield rows.iloc[lo:hi]
        lo = hi


def _rank_block(docs: DataFrame, block: list[tuple[object, list[str]]], counter: Counter_, k: int, pairs: bool, query_type: str) -> DataFrame:
    """``query_id, id, score`` of one block of queries: the best k of each partition of ``docs`` (``id, x``)."""
    spark, id_type = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    vocabulary: dict[str, int] = {}
    asked = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms], int) for _, terms in block]
    shared = spark.sparkContext.broadcast(vocabulary)  # the terms of at most QUERY_BLOCK queries

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, COUNT_ROWS):
                part = batch.slice(lo, COUNT_ROWS)
                key, n, lengths = of(part.column("x"))
                key, place = np.unique(key, return_inverse=True)
                tf = np.bincount(place, n, len(key)).astype(np.int32)
                starts = pa.array(np.searchsorted(key >> 32, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(v)) for v in ((key & 0xFFFFFFFF).astype(np.int32), tf)]
                yield pa.RecordBatch.from_arrays([part.column("id"), lengths.cast(pa.int64()), *lists], names=["id", "dl", "terms", "tf"])

    # the only pass over texts: from here on a document is its length and the counts of terms that someone asks for
    counted = durable(docs.mapInArrow(count, f"id {id_type}, dl long, terms array<int>, tf array<int>"))
    n, mean = counted.agg(F.count("*"), F.avg("dl")).first()
    df = np.zeros(len(vocabulary))
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # one number a term of the block
        df[r.t] = r.df
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    # for each term the numbers of the queries that ask for it, end to end
    owner = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    term = np.concatenate(asked) if len(owner) else np.empty(0, int)
    order = np.argsort(term, kind="stable")
    table = spark.sparkContext.broadcast((owner[order], np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), idf, [len(a) for a in asked], [q for q, _ in block]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_term, start, idf, n_terms, names = table.value
        n_terms, width = np.array(n_terms), len(n_terms)
        best, least = None, np.full(width, -np.inf)  # and of queries with k documents the score of the k-th
        for pdf in batches:
            asked = np.array([(start[t + 1] - start[t]).sum() for t in pdf["terms"]])
            for part in _parts(pdf[asked > 0], asked[asked > 0]):
                m = np.array([len(t) for t in part["terms"]])
                doc, t, tf = np.repeat(np.arange(len(part)), m), np.concatenate(part["terms"].to_numpy()), np.concatenate(part["tf"].to_numpy()).astype(float)
                dl = part["dl"].to_numpy(float)[doc]
                gain = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
                many = start[t + 1] - start[t]
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[t], many)
                cell = np.repeat(doc * width, many) + by_term[at]
                s = sum(np.bincount(cell, np.repeat(x, many), len(part) * width) for x in exact_parts(gain))
                hits = np.bincount(cell, minlength=len(part) * width)
                found = np.flatnonzero(hits)
                q, own = found % width, s[found]
                if pairs:
                    one = n_terms[q] == 1
                    own = np.where(one, own, own * (hits[found] - 1))
                    keep = one | (hits[found] >= 2)
                    found, q, own = found[keep], q[keep], own[keep]
                own = ten_decimals(own)
                keep = own >= least[q]
                rows = (own[keep], part["id"].to_numpy()[found[keep] // width], q[keep])
                best = _best_by_query(*(rows if best is None else [np.concatenate(x) for x in zip(best, rows)]), k)
                full = np.flatnonzero(np.bincount(best[2], minlength=width) == k)
                least[full] = best[0][np.searchsorted(best[2], full, "right") - 1]
        if best is not None and len(best[0]):
            yield pd.DataFrame({"query_id": [names[i] for i in best[2]], "id": best[1], "score": best[0]})

    return counted.mapInPandas(score, f"query_id {query_type}, id {id_type}, score double")


def _candidates(docs: DataFrame, queries: DataFrame, counter: Counter_, k: int, pairs: bool) -> DataFrame:
    """BM25 of ``docs`` (``id, x``) for ``queries`` (``query_id, t``), in blocks of queries of a fixed size; unranked."""
    query_type = queries.schema["query_id"].dataType.simpleString()
    found, block = None, []

    def add() -> DataFrame:
        got = _rank_block(docs, block, counter, k, pairs, query_type)
        return got if found is None else found.unionByName(got)

    for r in queries.where(F.size("t") > 0).toLocalIterator():
        block.append((r.query_id, list(r.t)))
        if len(block) == QUERY_BLOCK:
            found, block = add(), []
    if block or found is None:
        found = add()
    return found


def ranked_branches(branches: dict[str, DataFrame], k: int) -> DataFrame:
    """``query_id, branch, id, rank, score`` of several branches' candidates, each branch ranked on its own.

    Branches are joined to one table before they are ranked: Spark 4.1 takes a union of tables dealt by one key as
    dealt by it, which does not hold once each side's partitions are coalesced on their own.
    """
    every = None
    for name, found in branches.items():
        part = found.select("query_id", F.lit(name).alias("branch"), "id", "score")
        every = part if every is None else every.unionByName(part)
    return top_k(every, k, within=("branch",)).select("query_id", "branch", "id", "rank", "score")


def bm25_candidates(
    docs: DataFrame, queries: DataFrame, *, doc_tokens: Column, query_tokens: Column, k: int, id_col: str = "doc_id", query_col: str = "item_id", pairs: bool = False
) -> DataFrame:
    """What ``bm25`` ranks: ``query_id, id, score`` with the best k of each query and partition, in no order."""
    d = spread(docs).select(F.col(id_col).alias("id"), doc_tokens.alias("x"))
    return _candidates(d, queries.select(F.col(query_col).alias("query_id"), query_tokens.alias("t")), _count_tokens, k, pairs)


def bm25(docs: DataFrame, queries: DataFrame, *, k: int, **how) -> DataFrame:
    """``query_id, id, rank, score``: BM25 with k1 1.2, b 0.75, and idf not under 1e-6.

    Queries are taken in blocks of a fixed size, whose terms are broadcast. Documents are tokenised once a block:
    what stays of each is its length and its counts of the block's terms. Scores are summed within a document,
    and each partition keeps the best k of a query, so what is shuffled is k rows a query and partition, whatever
    a term's frequency. Scores are rounded to ten decimals so that ties break alike however sums are ordered.
    With ``pairs`` at least two of a query's terms must match (one, if it has one) and a term counts once for
    each pair it forms with others matched. Queries without tokens give no rows; null texts count as documents only.
    """
    return top_k(bm25_candidates(docs, queries, k=k, **how), k).select("query_id", "id", "rank", "score")


def trigram_tokens(c: Column) -> Column:
    """All three-character windows."""
    one = F.split(c, "")
    n = F.greatest(F.size(one) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(one, F.lit(1), n), F.slice(one, F.lit(2), n), lambda x, y: F.concat(x, y))
    return F.zip_with(pairs, F.slice(one, F.lit(3), n), lambda x, y: F.concat(x, y))


def substring_candidates(
    docs: DataFrame, queries: DataFrame, *, text: Column, terms: Column, k: int, max_chars: int | None = None, shortest: int = 3, id_col: str = "doc_id", query_col: str = "item_id"
) -> DataFrame:
    """What ``substring_bm25`` ranks, in no order."""
    x = text if max_chars is None else F.substring(text, 1, max_chars)
    d = spread(docs).select(F.col(id_col).alias("id"), x.alias("x"))
    return _candidates(d, queries.select(F.col(query_col).alias("query_id"), terms.alias("t")), _count_substrings(shortest), k, True)


def substring_bm25(docs: DataFrame, queries: DataFrame, *, k: int, **how) -> DataFrame:
    """The trigram branch: a term is any substring, dl the number of trigrams, two terms must match.

    Terms are letters and digits only, ``shortest`` characters at least, so each of their occurrences
    lies within one word: terms are sought in the words of each document. ``max_chars`` cuts the texts, if given.
    """
    return top_k(substring_candidates(docs, queries, k=k, **how), k).select("query_id", "id", "rank", "score")


def _product(k: int, step: int = 256):
    """Of one block of queries and one of vectors the best k vectors of each query, by falling product and then id."""
    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(own):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})
        ids, x, out = own["id"].to_numpy(), np.stack(own["v"].to_numpy()), []
        for lo in range(0, len(asked), step):
            part = asked.iloc[lo : lo + step]
            s = ten_decimals(np.stack(part["v"].to_numpy()) @ x.T)
            least = np.partition(s, -k, axis=1)[:, -k][:, None] if k < s.shape[1] else -np.inf
            q, c = np.nonzero(s >= least)
            score, found, owner = _best_by_query(s[q, c], ids[c], q, k)
            out.append(pd.DataFrame({"query_id": part["id"].to_numpy()[owner], "id": found, "score": score}))
        return pd.concat(out)

    return run


def dense_top_k(vectors: DataFrame, queries: DataFrame, *, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_rows: int = 4096, vector_rows: int = 8192) -> DataFrame:
    """``query_id, id, rank, score``: exact inner products, ties by id.

    A product of blocks: queries are dealt into rows of about ``query_rows`` and vectors into columns of about
    ``vector_rows``, each row of blocks gets a copy of each column and each column of each row, and a task multiplies one
    pair of blocks. What is shuffled after that is k rows a query and column; nothing of either side passes the driver but
    its count. Null vectors are left out; a query's own row may be found. Rows are dealt by id and vector together.
    """
    def side(df: DataFrame) -> DataFrame:
        return df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    own, asked = side(vectors), side(queries)
    rows, columns = (max(1, -(-df.count() // n)) for df, n in ((asked, query_rows), (own, vector_rows)))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(deal(rows).alias("row"), every(columns).alias("column"), "id", "v").groupBy("row", "column")
    right = own.select(every(rows).alias("row"), deal(columns).alias("column"), "id", "v").groupBy("row", "column")
    found = left.cogroup(right).applyInPandas(lambda a, b: _product(k)(a, b), "query_id long, id long, score double")
    return top_k(found, k).select("query_id", "id", "rank", "score")
