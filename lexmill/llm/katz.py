"""Language-model scoring with Katz backoff over n-gram tables that are counted, stored and looked up by key ranges.

Documents are packed once into blocks of a bounded number of tokens. A block asks each range of n-gram keys for the
counts of its own distinct n-grams, so a frequent n-gram costs one entry a block and no range holds more than its even
share of keys. Keys are 64-bit hashes, sorted and delta-coded; what a task holds is one block or one range.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.shingles import _CACHE, _M1, mix, words
from lexmill.session import durable

#: Tokens of one block (a longer document is a block of its own) and keys that one range is planned for.
BLOCK_TOKENS, RANGE_KEYS = 2_000_000, 1_500_000
#: Counts up to this are discounted, as is usual with Katz's model.
DISCOUNTED = 5

START, END = np.uint64(0x5BD1E995A3C59AC3), np.uint64(0x27D4EB2F165667C5)


# ---- packing of arrays -----------------------------------------------------------------------------------


def _squeeze(a: np.ndarray) -> bytes:
    """An array by byte planes, so that bytes which are mostly zero compress away."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())


def _squeeze_bits(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(a).tobytes())


def _expand_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=n // 8 + 1), np.uint8), count=n).astype(bool)


def _expand(b: bytes, kind: type, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b, max_output_size=max(1, n * np.dtype(kind).itemsize)) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).reshape(n)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _expand_keys(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(_expand(b, np.uint64, n), dtype=np.uint64)


def _start_key(level: int) -> np.uint64:
    """Key of the n-gram of start marks alone."""
    k = np.array([START])
    for _ in range(level - 1):
        k = mix(k * _M1 + START)
    return k[0]


# ---- blocks ----------------------------------------------------------------------------------------------


def blocks_of(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``block, n_tokens, ids, learn, lengths, n_words, vocabulary, frequent, tokens``, checkpointed: rows of bounded size.

    A block holds its distinct words as sorted keys, their numbers by falling frequency, and its documents end to end,
    each a start mark, its words and an end, as places in that list, so that frequent words are small numbers.
    """
    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[object, bool, np.ndarray]] = []
        size = 0

        def block() -> pd.DataFrame:
            every = np.concatenate([h for _, _, h in held])
            code, vocabulary = pd.factorize(every, sort=True)
            frequent = np.argsort(-np.bincount(code), kind="stable")
            place = np.empty(len(vocabulary), np.uint32)
            place[frequent] = np.arange(len(vocabulary), dtype=np.uint32)
            return pd.DataFrame({
                "n_tokens": [len(every)], "ids": [[i for i, _, _ in held]], "learn": [[w for _, w, _ in held]], "lengths": [[len(h) for _, _, h in held]],
                "n_words": [len(vocabulary)], "vocabulary": [_squeeze_keys(vocabulary)], "frequent": [_squeeze(frequent.astype(np.uint32))], "tokens": [_squeeze(place[code])]})

        for pdf in batches:
            for i, text, w in zip(pdf["id"], pdf["text"], pdf["learn"]):
                own = words(text)
                h = np.empty(len(own) + 2, np.uint64)
                h[0], h[-1] = START, END
                h[1:-1] = np.fromiter(map(_CACHE.__getitem__, own), np.uint64, len(own))
                held.append((i, bool(w), h))
                size += len(h)
                if size >= BLOCK_TOKENS:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    kind = "n_tokens long, ids array<string>, learn array<boolean>, lengths array<long>, n_words long, vocabulary binary, frequent binary, tokens binary"
    return durable(d.mapInPandas(run, kind).select(F.monotonically_increasing_id().alias("block"), "*"))


@dataclass
class _Grams:
    """The n-grams of one level in a block: sorted distinct keys, and for each the first place it ends at."""

    keys: np.ndarray
    first: np.ndarray
    at: np.ndarray  # for each place, the number of its n-gram


class _Block:
    """A block unpacked; places are those of tokens, start marks among them."""

    def __init__(self, row, order: int):
        vocabulary = _expand_keys(row.vocabulary, row.n_words)
        at = _expand(row.frequent, np.uint32, row.n_words).astype(np.int64)[_expand(row.tokens, np.uint32, row.n_tokens)]
        self.ids, self.lengths = list(row.ids), np.array(row.lengths, np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.is_start = np.zeros(len(at), bool)
        self.is_start[self.begin] = True
        self.learn = np.repeat(np.array(row.learn, bool), self.lengths)
        _, first = np.unique(at, return_index=True)
        self.levels = [_Grams(vocabulary, first, at)]
        word = key = vocabulary[at]
        for level in range(2, order + 1):
            key = mix(np.concatenate([key[:1], key[:-1]]) * _M1 + word)
            key[self.begin] = _start_key(level)  # nothing is before a start mark but more of them
            self.levels.append(_Grams(*np.unique(key, return_index=True, return_inverse=True)))

    def context(self, level: int) -> np.ndarray:
        """For each n-gram of the level (from 2) the number of its context a level lower; start marks alone have none."""
        g = self.levels[level - 1]
        return np.where(self.is_start[g.first], -1, self.levels[level - 2].at[np.maximum(g.first - 1, 0)])

    def suffix(self, level: int) -> np.ndarray:
        return self.levels[level - 2].at[self.levels[level - 1].first]


# ---- rounds of questions and answers ---------------------------------------------------------------------

_ASK = "level int, range long, block long, n long, keys binary, values array<binary>"
_ANSWER = "block long, level int, range long, n long, values array<binary>"


def _by_range(level: int, bits: int, block: int, keys: np.ndarray, values: list[np.ndarray]) -> Iterator[dict]:
    """Sorted keys cut where ranges end: one row for each range that is met."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
        yield {"level": level, "range": part[lo], "block": block, "n": hi - lo, "keys": _squeeze_keys(keys[lo:hi]), "values": [(_squeeze_bits if v.dtype == bool else _squeeze)(v[lo:hi]) for v in values]}


def _frame(rows: list[dict], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])


def _meet(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[tuple[object, slice]]]:
    """All keys that meet in one range: the distinct ones, each entry's number, and each row's slice of entries."""
    keys, at = np.unique(np.concatenate([_expand_keys(r.keys, r.n) for r in pdf.itertuples()]), return_inverse=True)
    ends = np.cumsum(pdf["n"].to_numpy())
    return keys, at, [(r, slice(hi - r.n, hi)) for r, hi in zip(pdf.itertuples(), ends)]


def _ask_counts(order: int, bits: int) -> Callable:
    """Each block's distinct n-grams of every level with how often they end at a place to be learnt from."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                b = _Block(row, order)
                for level, g in enumerate(b.levels, 1):
                    n = np.bincount(g.at[b.learn], minlength=len(g.keys)).astype(np.int64)
                    yield _frame(list(_by_range(level, bits, row.block, g.keys, [n])), _ASK)

    return run


def _count(top: int) -> Callable:
    """Counts of a range's n-grams: its table rows (``block`` -1), and to each block the counts of what it asked for.

    Of the blocks that an n-gram was learnt from one is told that it speaks for it.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        level, part = int(pdf["level"].iloc[0]), int(pdf["range"].iloc[0])
        keys, at, rows = _meet(pdf)
        n = np.concatenate([_expand(r.values[0], np.int64, r.n) for r, _ in rows])
        total = np.bincount(at, n, len(keys)).astype(np.int64)  # exact below 2**53
        speaks = np.full(len(keys), -1)
        learnt = np.flatnonzero(n)[::-1]
        speaks[at[learnt]] = learnt
        mine = speaks[at] == np.arange(len(at))
        out = [{"block": r.block, "level": level, "range": part, "n": r.n, "values": [_squeeze(total[at[s]]), _squeeze_bits(mine[s])], "stats": []} for r, s in rows if r.block >= 0]
        known = (total > 0) & (keys != _start_key(level))  # start marks count as contexts only
        t = total[known]
        stats = np.bincount(np.minimum(t, top + 1), minlength=top + 2)[1 : top + 1]
        table = total > 0
        out.append({"block": -1, "level": level, "range": part, "n": int(table.sum()), "values": [_squeeze_keys(keys[table]), _squeeze(total[table])], "stats": [int(t.sum()), len(t), *map(int, stats)]})
        return pd.DataFrame(out, columns=["block", "level", "range", "n", "values", "stats"])

    return run


# ---- discounts and weights -------------------------------------------------------------------------------


def discounts(seen: list[int]) -> np.ndarray:
    """Good-Turing factors of counts 0 to ``len(seen)`` - 1, then 1: ``seen[r - 1]`` n-grams were met r times.

    Counts above that are kept whole, and what is left for unseen events is what Good and Turing give to them, n1 / N.
    A factor that the counts of counts make useless (a gap in them, not in (0, 1]) is 1.
    """
    k = len(seen) - 1
    d = np.ones(k + 2)
    common = (k + 1) * seen[k] / seen[0] if seen[0] else 1.0
    for r in range(1, k + 1):
        if seen[r - 1] and seen[r] and common < 1:
            f = ((r + 1) * seen[r] / (r * seen[r - 1]) - common) / (1 - common)
            if 0 < f <= 1:
                d[r] = f
    return d


@dataclass
class Facts:
    """What scoring knows besides the tables: a few numbers for each level."""

    order: int
    bits: int
    total: int
    distinct: int
    factors: list[np.ndarray]

    def discounted(self, level: int, n: np.ndarray) -> np.ndarray:
        d = self.factors[level - 1]
        return d[np.minimum(n, len(d) - 1)] * n


class _Answers:
    """A block's answers, put back into the order of its keys."""

    def __init__(self, answers: pd.DataFrame):
        self.rows = sorted(answers.itertuples(), key=lambda r: (r.level, r.range))

    def _read(self, level: int, i: int, kind: type) -> np.ndarray:
        got = [_expand_bits(r.values[i], r.n) if kind is bool else _expand(r.values[i], kind, r.n) for r in self.rows if r.level == level]
        return np.concatenate([np.empty(0, kind), *got])

    def counts(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram of the block the count, and whether the block speaks for it."""
        return self._read(level, 0, np.int64), self._read(level, 1, bool)

    def weights(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Denominator and backoff weight of each n-gram of the level that the block asked for; 0 and 1 if it is no context."""
        return self._read(-level, 0, np.int64), self._read(-level, 1, np.float64)


def _unigram(f: Facts, b: _Block, n: np.ndarray, spare: tuple[float, float]) -> np.ndarray:
    """Probability of each word of the block; what is left is the unknown word's."""
    whole, unknown = spare
    return np.where(n > 0, f.discounted(1, n) / whole, unknown)


def _lower(f: Facts, b: _Block, a: _Answers, level: int, spare: tuple[float, float]) -> np.ndarray:
    """Discounted probability of each n-gram of the level after its context; 0 if it was not learnt (words: the unknown one's)."""
    n, _ = a.counts(level)
    if level == 1:
        return _unigram(f, b, n, spare)
    whole, _ = a.weights(level - 1)
    return np.where(n > 0, f.discounted(level, n), 0) / np.maximum(whole[np.maximum(b.context(level), 0)], 1)


def _contexts(f: Facts, level: int, spare: tuple[float, float]) -> Callable:
    """For contexts of ``level``: how many n-grams with each discounted count a block speaks for, and what those weigh a level lower.

    On the last level a block also says what it has of its documents' scores, and asks only for the weights that they lack.
    """
    last = level == f.order - 1

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in block.itertuples():
            b, a = _Block(row, f.order), _Answers(answers)
            n, mine = a.counts(level + 1)
            low, _ = a.counts(level)
            context, size = b.context(level + 1), len(b.levels[level - 1].keys)
            own = mine & (context >= 0)
            seen = [np.bincount(context[own & (n == r)], minlength=size).astype(np.int64) for r in range(1, DISCOUNTED + 1)]
            lower = np.bincount(context[own], _lower(f, b, a, level, spare)[b.suffix(level + 1)[own]], size)
            wanted = np.ones(size, bool)
            if last:
                part, wanted = _documents(f, b, a, spare)
                out.append({"level": 0, "range": row.block, "block": row.block, "n": len(b.ids), "keys": None, "values": part})
            out += list(_by_range(-level, f.bits, row.block, b.levels[level - 1].keys, [low, lower, wanted, *seen]))
        return _frame(out, _ASK)

    return run


def _documents(f: Facts, b: _Block, a: _Answers, spare: tuple[float, float]) -> tuple[list[bytes], np.ndarray]:
    """What a block knows of its documents' scores, from the lowest level up, and which contexts of the top level it must ask about.

    A seen n-gram has its own probability, another one its context's weight times the lower probability. Of the top level's
    contexts the weights are not known yet: of these a list of (document, context) is kept, for unseen n-grams, and for seen
    ones whose denominator the block cannot tell, as it knows of no discounted n-gram of that context.
    """
    known, _ = a.counts(1)
    at = b.levels[0].at
    score = np.log10(_unigram(f, b, known, spare))[at]
    base = np.log10((known + 0.1) / (f.total + 0.1 * (f.distinct + 1)))[at]
    lack = wanted = np.zeros(0, np.int64)
    alpha = np.zeros(0, bool)
    for level in range(2, f.order + 1):
        n, _ = a.counts(level)
        g, context = b.levels[level - 1], np.maximum(b.context(level), 0)
        with np.errstate(divide="ignore"):
            own = np.log10(f.discounted(level, n))
        there = (n > 0)[g.at]
        if level < f.order:
            whole, weight = (x[context] for x in a.weights(level - 1))
            score = np.where(there, (own - np.log10(np.maximum(whole, 1)))[g.at], np.log10(weight)[g.at] + score)
            continue
        low, _ = a.counts(level - 1)
        loses = np.bincount(context[(n > 0) & (f.discounted(level, n) < n)], minlength=len(low)) > 0
        score = np.where(there, np.where(loses[context], own - np.log10(np.maximum(low[context], 1)), own)[g.at], score)
        lack = np.flatnonzero(np.where(there, ~loses[context[g.at]], low[context[g.at]] > 0) & ~b.is_start)
        alpha, wanted = ~there[lack], context[g.at[lack]]
    score[b.is_start] = base[b.is_start] = 0
    counted = (known > 0)[at] & ~b.is_start
    mask = np.zeros(len(b.levels[max(f.order - 2, 0)].keys), bool)
    mask[wanted] = True
    place = np.cumsum(mask) - 1  # of a context among those asked for
    document = np.repeat(np.arange(len(b.ids)), b.lengths)[lack]
    sums = [np.add.reduceat(x, b.begin) for x in (counted.astype(np.int64), base, score)]
    return [zstandard.ZstdCompressor(level=1).compress(json.dumps(b.ids).encode()), *map(_squeeze, (b.lengths - 1, *sums, document, place[wanted])), _squeeze_bits(alpha), str(len(lack)).encode()], mask


def _finish(f: Facts) -> Callable:
    """Scores of a block's documents from what it had of them and the weights that they lacked."""
    def run(answers: pd.DataFrame) -> pd.DataFrame:
        r = next(x for x in answers.itertuples() if x.level == 0)
        ids = json.loads(zstandard.ZstdDecompressor().decompress(r.values[0]))
        kinds = (np.int64, np.int64, np.float64, np.float64)
        n_tokens, n_known, base, score = (_expand(v, kind, r.n) for v, kind in zip(r.values[1:5], kinds))
        m = int(r.values[8])
        document, place, alpha = _expand(r.values[5], np.int64, m), _expand(r.values[6], np.int64, m), _expand_bits(r.values[7], m)
        if m:
            whole, weight = _Answers(answers).weights(f.order - 1)
            score = score + np.bincount(document, np.where(alpha, np.log10(weight[place]), -np.log10(np.maximum(whole[place], 1))), r.n)
        return pd.DataFrame({"id": pd.Series(ids, dtype=object), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": f.total, "base_score": base, "score": score})

    return run


def _weigh(f: Facts) -> Callable:
    """Backoff weights of a range's contexts: what they keep, over what their words do not weigh a level lower."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        level, part = int(pdf["level"].iloc[0]), int(pdf["range"].iloc[0])
        if level == 0:  # what a block has of its documents' scores goes on as it is
            return pdf[["block", "level", "range", "n", "values"]]
        keys, at, rows = _meet(pdf)
        read = lambda i, kind: np.concatenate([_expand(r.values[i], kind, r.n) for r, _ in rows])
        n = np.zeros(len(keys), np.int64)
        n[at] = read(0, np.int64)  # each asker knows the same count
        lower = np.bincount(at, read(1, np.float64), len(keys))
        d = f.factors[-level]  # of the n-grams a level higher
        lost = sum((1 - d[r]) * r * np.bincount(at, read(2 + r, np.int64), len(keys)) for r in range(1, DISCOUNTED + 1))
        context = lower > 0
        whole = np.where(context, n + (lost == 0), 0)  # a context that loses no mass gets that of one more event
        alpha = np.ones(len(keys))
        alpha[context] = (1 - (n - lost)[context] / whole[context]) / (1 - lower[context])
        out = []
        for r, s in rows:
            asked = at[s][_expand_bits(r.values[2], r.n)]
            out.append({"block": r.block, "level": level, "range": part, "n": len(asked), "values": [_squeeze(whole[asked]), _squeeze(alpha[asked])]})
        out.append({"block": -1, "level": level, "range": part, "n": int(context.sum()), "values": [_squeeze_keys(keys[context]), _squeeze(whole[context]), _squeeze(alpha[context])]})
        return _frame(out, _ANSWER)

    return run


def _words_only(f: Facts, spare: tuple[float, float]) -> Callable:
    """Scores by single words."""
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        part, _ = _documents(f, b := _Block(next(block.itertuples()), 1), _Answers(answers), spare)
        return _finish(f)(pd.DataFrame([{"level": 0, "n": len(b.ids), "values": part}]))

    return run


# ---- fitting and scoring ---------------------------------------------------------------------------------


def _facts(counted: DataFrame, order: int, bits: int) -> Facts:
    """Totals and counts of counts, a few numbers from each level."""
    got = {r.level: r for r in counted.where("kind = 'table'").groupBy("level").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(DISCOUNTED + 3))).collect()}
    seen = [[int(got[i][f"s{r + 2}"] or 0) if i in got else 0 for r in range(DISCOUNTED + 1)] for i in range(1, order + 1)]
    return Facts(order, bits, int(got[1].s0) if 1 in got else 0, int(got[1].s1) if 1 in got else 0, [discounts(x) for x in seen])


def _spare(f: Facts, counted: DataFrame) -> tuple[float, float]:
    """Denominator of words, and the probability of the unknown one: what words keep, summed over counts of counts."""
    seen = counted.where("kind = 'table' and level = 1").agg(*(F.sum(F.col("stats")[r + 1]).alias(f"n{r}") for r in range(1, DISCOUNTED + 1))).first()
    d = f.factors[0]
    lost = math.fsum((1 - d[r]) * r * int(seen[f"n{r}"] or 0) for r in range(1, DISCOUNTED + 1))
    return (float(f.total), lost / f.total) if lost > 0 else (float(f.total + 1), 1 / (f.total + 1))


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """Written by kind and level and read back, so that neither lineage nor a second copy is kept."""
    kind = F.when(F.col("block") < 0, "table").otherwise("answers").alias("kind")
    rows.select(kind, "*").write.partitionBy("kind", "level").parquet(path)
    return rows.sparkSession.read.schema(f"{', '.join(f'{c} {t}' for c, t in rows.dtypes if c != 'level')}, kind string, level int").parquet(path)


def katz_scores(docs: DataFrame, path: str, *, learn: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of every document, by a model of those where ``learn`` holds.

    Tokens are words with A-Z in lower case and an end; histories begin with start marks, which are never predicted.
    Counts to five are discounted after Good and Turing at each level, words included; the unknown word has what words
    leave. A context whose counts are all kept whole is given one more event, so each weight is exact and above 0:
    over all words and the unknown one a history's probabilities sum to 1. Tables are stored under ``path`` as Parquet,
    partitioned by level: in ``grams`` kind ``table`` has the sorted keys and counts of each range, in ``contexts1`` and so
    on keys, denominators and weights; kind ``answers`` has what blocks were told.

    Null texts are empty texts, of one end; where ``learn`` is null a row is not learnt from. With nothing to learn from
    all is unknown, at probability 1. Rows that repeat an id are each scored, other columns are not read, an empty table
    gives no rows. Keys of 64 bits may collide: about n * n / 2**65 pairs of n distinct n-grams.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    blocks = blocks_of(docs, learn, id_col=id_col, text_col=text_col)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, tokens / RANGE_KEYS))))
    counted = _stored(blocks.mapInPandas(_ask_counts(order, bits), _ASK).groupBy("level", "range").applyInPandas(_count(DISCOUNTED + 1), _ANSWER + ", stats array<long>"), f"{path}/grams")
    facts = _facts(counted, order, bits)
    spare = _spare(facts, counted)
    columns = ["block", "level", "range", "n", "values"]
    answers = counted.where("kind = 'answers'").select(*columns)
    kind = "id string, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if order == 1:
        out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_words_only(facts, spare), kind)
        return out.withColumn("id", F.col("id").cast(id_type))
    for level in range(1, order):
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_contexts(facts, level, spare), _ASK)
        weighed = _stored(asked.groupBy("level", "range").applyInPandas(_weigh(facts), _ANSWER), f"{path}/contexts{level}")
        answers = answers.unionByName(weighed.where("kind = 'answers'").select(*columns))
    return weighed.where("kind = 'answers'").select(*columns).groupBy("block").applyInPandas(_finish(facts), kind).withColumn("id", F.col("id").cast(id_type))


def stored_grams(spark: SparkSession, path: str) -> DataFrame:
    """``level, key, n`` of a stored model, one row for each n-gram."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame({"level": r.level, "key": _expand_keys(r.values[0], r.n).view(np.int64), "n": _expand(r.values[1], np.int64, r.n)})

    return spark.read.parquet(f"{path}/grams").where("kind = 'table'").select("level", "n", "values").mapInPandas(run, "level int, key long, n long")
