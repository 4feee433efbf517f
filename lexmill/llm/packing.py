"""Token ids packed by best-fit decreasing into fixed-length rows, for binary output."""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the byte-level BPE's split pattern without its look-ahead, which only matters next to
# runs of white space; texts that have such runs take the full pattern.
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_FULL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = re.compile(r"\s\s")
SCHEMA = "shard int, row int, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, parts array<int>"


@dataclass(frozen=True)
class PackParams:
    #: Ranks of a byte-level BPE of at most 65,535 ids; read by the driver, shipped as a broadcast of its fixed size.
    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    row_tokens: int = 2048
    #: Id that ends each document, and fills the rest of a row.
    end_id: int = 50256
    #: Tokens that one packing window holds.
    window_tokens: int = 2_000_000


class Tokenizer:
    """A byte-level BPE from its ranks; text in, ids out, without special tokens."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.full = tiktoken.Encoding("full", pat_str=_FULL, mergeable_ranks=table, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=_PLAIN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array((self.full if _RUN.search(text) else self.plain).encode_ordinary(text), np.uint16)

    def decode(self, ids: np.ndarray) -> str:
        return self.full.decode([int(i) for i in ids])


class CapacityTree:
    """Segment tree over capacities 0..top: which is the least held capacity that is at least n?"""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.held = [0] * (2 * self.size)
        self.bins: list[deque[int]] = [deque() for _ in range(top + 1)]

    def push(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        i = self.size + capacity
        while i:
            self.held[i] += 1
            i >>= 1

    def pop(self, least: int) -> tuple[int, int] | None:
        """Take the bin opened first among those of the tightest capacity >= least."""
        i = self.size + least
        if not self.held[i]:
            while i > 1 and (i & 1 or not self.held[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.held[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            self.held[i] -= 1
            i >>= 1
        return capacity, self.bins[capacity].popleft()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling length (ties: as given), each to the fullest bin that has room."""
    tree, bins = CapacityTree(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        got = tree.pop(lengths[k])
        room, b = got if got else (capacity, len(bins))
        if not got:
            bins.append([])
        bins[b].append(k)
        tree.push(room - lengths[k], b)
    return bins


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: PackParams = PackParams()) -> DataFrame:
    """Rows of ``row_tokens`` ids: ``shard, row, ids, n_tokens, cu_seqlens, position_resets, doc_ids, parts``.

    ``ids`` is a little-endian uint16 row of the id matrix, filled with the end id; ``cu_seqlens`` has 0
    and the end of each segment; positions restart at ``position_resets``. A document is its ids and the
    end id; one longer than a row is split into full rows and a rest, numbered in ``parts``, with no id
    lost. Each input partition packs its own documents, window by window, so nothing is shuffled,
    memory is bounded, and a lost task is redone alike; ``shard`` is the partition. Null and blank
    texts are the end id alone; null ids are carried as null; repeated rows are packed each; an empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(open(params.tokenizer, "rb").read())
    cap, end = params.row_tokens, params.end_id

    def rows(shard: int, first: int, segs: list[tuple[object, int, np.ndarray]]) -> pd.DataFrame:
        out = []
        for k, b in enumerate(best_fit_decreasing([len(s[2]) for s in segs], cap)):
            line = np.full(cap, end, "<u2")
            cu = np.cumsum([0, *(len(segs[j][2]) for j in b)])
            for j, a in zip(b, cu):
                line[a : a + len(segs[j][2])] = segs[j][2]
            out.append((shard, first + k, line.tobytes(), int(cu[-1]), cu.tolist(), cu[:-1].tolist(), [segs[j][0] for j in b], [segs[j][1] for j in b]))
        return pd.DataFrame(out, columns=["shard", "row", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "parts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, shard, first = Tokenizer(shared.value), TaskContext.get().partitionId(), 0
        segs: list[tuple[object, int, np.ndarray]] = []
        held = 0
        for pdf in batches:
            for i, text in zip(pdf["id"].astype("Int64"), pdf["text"]):
                ids = np.append(tok.encode(text or ""), np.uint16(end))
                i = None if pd.isna(i) else int(i)
                segs += [(i, p, ids[a : a + cap]) for p, a in enumerate(range(0, len(ids), cap))]
                held += len(ids)
                if held >= params.window_tokens:
                    done = rows(shard, first, segs)
                    first, segs, held = first + len(done), [], 0
                    for a in range(0, len(done), 1000):
                        yield done.iloc[a : a + 1000]
        if segs:
            yield rows(shard, first, segs)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, **how) -> None:
    """Write the id matrix and its segment tables as Parquet, one file per partition; one pass, no shuffle."""
    pack(docs, **how).write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame, *, params: PackParams = PackParams()) -> DataFrame:
    """``doc_id, text`` read back from packed rows (rows with null ids are left out)."""
    shared = packed.sparkSession.sparkContext.broadcast(open(params.tokenizer, "rb").read())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                line = np.frombuffer(r.ids, "<u2")
                out += [(d, p, line[a:b].tobytes()) for d, p, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens[:-1], r.cu_seqlens[1:]) if d is not None and not pd.isna(d)]
            yield pd.DataFrame(out, columns=["doc_id", "part", "ids"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizer(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [tok.decode(np.frombuffer(b"".join(x), "<u2")[:-1]) for x in pdf["ids"]]})

    parts = packed.select("ids", "cu_seqlens", "doc_ids", "parts").mapInPandas(cut, "doc_id long, part int, ids binary")
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("s")).select("doc_id", F.col("s.ids").alias("ids"))
    return whole.mapInPandas(read, "doc_id long, text string")
