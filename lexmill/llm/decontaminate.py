"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class TilingParams:
    #: Least words in a tile, and in the seeds that tiles grow from.
    min_match: int = 5
    #: Share of an item's words under tiles from which a document holds it.
    coverage: float = 0.6
    #: Words of benchmark text compared in one pass over the documents: 28 bytes each as an index.
    block_words: int = 4_000_000


def tokens(text: str | None) -> list[str]:
    """Letters and digits in lower case; marks and white space only separate."""
    return _WORD.findall((text or "").lower())


class _Hashes(dict):
    """64-bit hash of each word, never 0; emptied when it gets large, so a worker's memory stays bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
        return v


_HASH = _Hashes()


def numbers(text: str | None) -> np.ndarray:
    """The words of a text as 64-bit numbers."""
    w = tokens(text)
    return np.fromiter(map(_HASH.__getitem__, w), np.uint64, len(w))


def fingerprints(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every window of n numbers, modulo 2^64."""
    many = max(0, len(ids) - n + 1)
    acc = np.zeros(many, np.uint64)
    for i in range(n if many else 0):
        acc = acc * _BASE + ids[i : many + i]
    return acc


class _Rolling:
    """Hashes of all windows of any length that hold no marked place, from running sums."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.marked = ids, np.zeros(len(ids), bool)
        self.power = np.full(len(ids) + 1, _BASE)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        self.sums = np.concatenate([[np.uint64(0)], np.add.accumulate(ids * self.power[:-1])])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of unmarked windows of n numbers and their hashes, alike for equal windows anywhere."""
        if n > len(self.ids):
            return np.empty(0, int), np.empty(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(self.marked)])
        start = np.flatnonzero(taken[n:] == taken[:-n])
        return start, (self.sums[start + n] - self.sums[start]) * self.power[len(self.ids) - start]


def tile(doc: np.ndarray, item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Tiles ``(in doc, in item, length)`` of at least n words: longest first, none overlapping another on either side.

    Each round finds the greatest length at which any unmarked windows of both sides agree, by bisection over
    running Karp-Rabin hashes, and marks all its matches in order of their place in the document and then the item.
    No pair of places is listed, so words that repeat cost no more than others; rounds are as many as
    tiles have lengths, at most the root of twice the item's words. Matches are compared word by word before they count.
    """
    top = max(len(doc), len(item))
    a, b = _Rolling(np.concatenate([doc, np.zeros(top - len(doc), np.uint64)])), _Rolling(np.concatenate([item, np.zeros(top - len(item), np.uint64)]))
    a.marked[len(doc) :] = b.marked[len(item) :] = True
    out, hi = [], min(len(doc), len(item))

    def common(size: int) -> np.ndarray:
        return np.intersect1d(a.windows(size)[1], b.windows(size)[1])

    while hi >= n:
        lo, high = n - 1, hi
        while lo < high:  # the greatest length with a match
            mid = (lo + high + 1) // 2
            lo, high = (mid, high) if len(common(mid)) else (lo, mid - 1)
        if lo < n:
            break
        shared = common(lo)
        at, h = b.windows(lo)
        places: dict[int, list[int]] = defaultdict(list)
        for j, x in zip(at[::-1].tolist(), h[::-1].tolist()):
            places[x].append(j)  # the first place comes off the end first
        starts, h = a.windows(lo)
        own = np.isin(h, shared)
        for i, x in zip(starts[own].tolist(), h[own].tolist()):
            if a.marked[i : i + lo].any():
                continue
            left = places[x]
            while left:
                j = left.pop()
                if not b.marked[j : j + lo].any():
                    if np.array_equal(doc[i : i + lo], item[j : j + lo]):
                        out.append((i, j, lo))
                        a.marked[i : i + lo] = b.marked[j : j + lo] = True
                    break
        hi = lo - 1
    return out


def _covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Places within n of a start."""
    edge = np.zeros(length + 1, int)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + n, length), -1)
    return np.cumsum(edge[:-1]) > 0


class Index:
    """Seeds of a block of benchmark items as sorted arrays; an item of fewer than n words is one seed, whole."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.items = [(item, numbers(text)) for item, text in items]
        sizes = np.array([min(n, len(ids)) for _, ids in self.items])
        #: By seed size: distinct fingerprints in order, and for each the items that hold it, end to end.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted(set(sizes[sizes > 0].tolist())):
            of = np.flatnonzero(sizes == size)
            prints = [np.unique(fingerprints(self.items[k][1], size)) for k in of]
            h, k = np.concatenate(prints), np.repeat(of, [len(p) for p in prints])
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            self.seeds[size] = keys, np.append(first, len(h)), k[order]

    def matches(self, text: str | None, least: float = 0.0) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """``(item, words under tiles, words of the item, tiles)`` for each item that shares a seed.

        Items whose shared seeds cover less than ``least`` of their words are left out untiled: tiles cover no more.
        """
        doc = numbers(text)
        for size, (keys, first, owner) in self.seeds.items():
            h = fingerprints(doc, size)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            starts = np.flatnonzero(keys[at] == h)
            if not len(starts):
                continue
            held = keys[np.unique(at[starts])]
            covered = _covered(starts, size, len(doc))
            # places under no seed are in no tile: each run of them becomes one 0, which no item holds
            cut = np.where(covered, doc, np.uint64(0))
            keep = covered | np.concatenate([[False], covered[:-1]])
            where, short = np.flatnonzero(keep), cut[keep]
            for k in np.unique(np.concatenate([owner[first[p] : first[p + 1]] for p in np.unique(at[starts])])).tolist():
                item, ids = self.items[k]
                seeds = np.flatnonzero(np.isin(fingerprints(ids, size), held))
                if _covered(seeds, size, len(ids)).sum() < least * len(ids):
                    continue
                tiles = [(int(where[i]), j, length) for i, j, length in tile(short, ids, size)]
                yield item, sum(t[2] for t in tiles), len(ids), tiles


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, params: TilingParams) -> Iterator[list[tuple[int, str]]]:
    """Items that are not null, in blocks of about ``block_words`` words; no more than one block is held."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    block, held = [], 0
    for r in items.orderBy("item", "text").toLocalIterator():
        block.append((r.item, r.text))
        held += len(r.text) // 5
        if held >= params.block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", params: TilingParams = TilingParams(),
) -> DataFrame:
    """One row per document and benchmark item it holds: ``doc_id, item_id, matched, item_words, coverage``.

    An item is held if tiles of at least ``min_match`` words cover ``coverage`` of its words, in any
    order, so passages whose parts were moved are caught. Items are compared in blocks of bounded size,
    each one map-only pass over whole documents: all items against all rows. Items shorter than
    a tile are held where all their words follow each other. Null or blank texts match nothing; rows of a null id
    are judged like others and give null ids; documents that repeat are each judged, and rows that share an id give
    the greatest coverage once. Other columns are not read; an empty table on either side gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sc = docs.sparkSession.sparkContext

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        shared = sc.broadcast(Index(block, params.min_match))  # arrays of at most block_words seeds

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in batches:
                out = [
                    (i, item, m, n) for i, text in zip(pdf["id"].astype("Int64"), pdf["text"]) for item, m, n, _ in index.matches(text, params.coverage) if m >= params.coverage * n]
                yield pd.DataFrame(out, columns=["id", "item", "m", "n"]).astype({"id": "Int64", "item": "int64", "m": "int64", "n": "int64"})

        return own.mapInPandas(run, "id long, item long, m long, n long")

    found = None
    for block in _blocks(benchmark, item_col, item_text_col, params):
        found = scan(block) if found is None else found.unionByName(scan(block))
    if found is None:
        found = scan([])
    best = found.groupBy("id", "item").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("c"), "m", "n")).alias("s"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("s.m").alias("matched"), F.col("s.n").alias("item_words"), F.col("s.c").alias("coverage"))


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: TilingParams = TilingParams(),
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are; each row is judged by its own text.

    Map-only, one pass a block. Null and blank texts stay, whatever a row's id is, and so does an empty table.
    """
    out, sc = docs, docs.sparkSession.sparkContext

    def clean_of(block: list[tuple[int, str]]):
        shared = sc.broadcast(Index(block, params.min_match))

        def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = shared.value
            for part in texts:
                yield pd.Series([not any(m >= params.coverage * n for _, m, n, _ in index.matches(t, params.coverage)) for t in part], dtype=bool)

        return F.pandas_udf(clean, "boolean")

    for block in _blocks(benchmark, item_col, item_text_col, params):
        out = out.where(clean_of(block)(F.col(text_col)))
    return out
