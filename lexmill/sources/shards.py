"""Vectors in shards of a fixed number of rows, written and read by a data source; a write that died goes on where it was.

A shard is ``vectors-n.npy`` (half precision), ``ids-n.jsonl`` and, written last, ``shard-n.json`` with its count and
digests: a shard with that record is finished. ``manifest.json`` is there only once all shards are.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lexmill.operators.ordered import numbered
from lexmill.session import durable
from lexmill.sources import stores


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ids_digest(ids: list[str]) -> str:
    """Digest of a shard's ids in order."""
    return _sha("\n".join(ids).encode())


def records(path: str) -> dict[int, dict]:
    """Records of the finished shards by number: a line for each shard of thousands of rows."""
    found = [json.loads(stores.get(f"{path}/{n}")) for n in stores.names(path) if n.startswith("shard-")]
    return {r["shard"]: r for r in found}


@dataclass
class _Written(WriterCommitMessage):
    shards: list[int]


class _Writer(DataSourceArrowWriter):
    """Rows ``shard, id, embedding`` come sorted by shard, each shard whole in one task."""

    def __init__(self, options, fail_on: int | None = None):
        self.path, self.dimension = options["path"], int(options["dimension"])
        self.fail_on = None if options.get("fail_on") is None else int(options["fail_on"])

    def _shard(self, n: int, ids: list[str], vectors: np.ndarray) -> None:
        if self.fail_on == n:
            raise RuntimeError(f"shard {n} fails, as asked")
        half = vectors.astype(np.float16)
        if half.shape != (len(ids), self.dimension) or not np.isfinite(half).all():
            raise ValueError(f"shard {n}: vectors of shape {half.shape}, or not finite")
        packed = io.BytesIO()
        np.save(packed, half, allow_pickle=False)
        lines = "".join(json.dumps(i) + "\n" for i in ids).encode()
        stores.put(f"{self.path}/vectors-{n:05d}.npy", packed.getvalue())
        stores.put(f"{self.path}/ids-{n:05d}.jsonl", lines)
        record = {"shard": n, "rows": len(ids), "ids_order_sha256": ids_digest(ids), "vectors_sha256": _sha(packed.getvalue()), "ids_sha256": _sha(lines)}
        stores.put(f"{self.path}/shard-{n:05d}.json", json.dumps(record).encode())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        done, number, ids, parts = [], None, [], []

        def close() -> None:
            if number is not None:
                self._shard(number, ids, np.concatenate(parts))
                done.append(number)

        for batch in iterator:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if shard[lo] != number:
                    close()
                    number, ids, parts = int(shard[lo]), [], []
                piece = batch.slice(lo, hi - lo)
                ids += piece.column("id").to_pylist()
                v = piece.column("embedding")
                if v.null_count or v.flatten().null_count or len(v.flatten()) != len(v) * self.dimension:
                    raise ValueError(f"shard {number}: a vector is missing or of another dimension")
                parts.append(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), self.dimension))
        close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        """What tasks wrote stands by its own records; the manifest is for ``finish``, which sees older shards as well."""

    def abort(self, messages: list[_Written | None]) -> None:
        """Finished shards stay, so that the next run need not write them; what is half written has hidden names."""


@dataclass
class _Shard(InputPartition):
    record: dict


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[_Shard]:
        if "manifest.json" not in stores.names(self.path):
            raise ValueError(f"{self.path}: not all shards are written")
        return [_Shard(r) for _, r in sorted(records(self.path).items())]

    def read(self, partition: _Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's partition of a table without any
            return
        r = partition.record
        vectors, lines = stores.get(f"{self.path}/vectors-{r['shard']:05d}.npy"), stores.get(f"{self.path}/ids-{r['shard']:05d}.jsonl")
        if _sha(vectors) != r["vectors_sha256"] or _sha(lines) != r["ids_sha256"]:
            raise ValueError(f"shard {r['shard']}: checksum differs")
        v = np.load(io.BytesIO(vectors), allow_pickle=False).astype(np.float32)
        ids = [json.loads(x) for x in lines.decode().splitlines()]
        if len(v) != r["rows"] or len(ids) != r["rows"]:
            raise ValueError(f"shard {r['shard']}: {len(v)} vectors, {len(ids)} ids, {r['rows']} expected")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "embedding"])


class VectorShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_shards"

    def schema(self) -> str:
        return "id string, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def placed(rows: DataFrame, *, id_col: str, shard_rows: int) -> DataFrame:
    """``rows`` with ``shard`` and ``place``: in the order of ids as text, ``shard_rows`` in a shard."""
    n = numbered(rows.withColumn("id", F.col(id_col).cast("string")), "id", name="__row")
    return n.withColumn("shard", F.floor(F.col("__row") / shard_rows).cast("int")).withColumn("place", F.col("__row") % shard_rows).drop("__row")


def write_vector_shards(
    rows: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, *, id_col: str, dimension: int, shard_rows: int = 4096, fail_on: int | None = None
) -> int:
    """Encode and write what is missing of ``rows`` under ``path``; the number of shards written by this run.

    ``encode`` maps rows (``id, shard, place`` and theirs) to rows with ``embedding`` beside those three; it sees only rows
    of shards that are not finished, so a second run costs no model call for what the first one did. A finished
    shard whose ids are not the ones that belong there now, or a missing or repeated id, is an error. ``fail_on`` is for tests.
    """
    spark = rows.sparkSession
    spark.dataSource.register(VectorShards)
    own = placed(rows, id_col=id_col, shard_rows=shard_rows)
    if own.where("id is null").limit(1).count() or own.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("ids must be there and differ")
    # the ids of one shard are bounded, so their digest is a group's
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), "\n")
    expected = durable(own.groupBy("shard").agg(F.sha2(listed.cast("binary"), 256).alias("digest"), F.count("*").alias("n")))
    finished = records(path)
    saved = spark.createDataFrame([(n, r["ids_order_sha256"]) for n, r in finished.items()], "shard int, saved string")
    other = saved.join(expected, "shard", "left").where("digest is null or digest <> saved").limit(1).collect()
    if other:
        raise ValueError(f"shard {other[0].shard} holds other ids")
    todo = own.join(F.broadcast(saved.select("shard")), "shard", "left_anti")  # a number for each finished shard
    missing = expected.count() - len(finished)
    if missing:
        out = encode(todo).select("shard", "place", "id", F.col("embedding").cast("array<float>").alias("embedding"))
        dealt = out.repartition(min(missing, 4 * spark.sparkContext.defaultParallelism), "shard").sortWithinPartitions("shard", "place").select("shard", "id", "embedding")
        options = {"dimension": dimension} | ({} if fail_on is None else {"fail_on": fail_on})
        dealt.write.format("vector_shards").options(**options).mode("append").save(path)
    finish(spark, path, expected, dimension)
    return missing


def finish(spark: SparkSession, path: str, expected: DataFrame, dimension: int) -> None:
    """Write the manifest if each expected shard is finished with its ids and rows."""
    found = records(path)
    saved = spark.createDataFrame([(n, r["ids_order_sha256"], r["rows"]) for n, r in found.items()], "shard int, digest string, n long")
    if expected.exceptAll(saved.select("shard", "digest", "n")).limit(1).count() or expected.count() != len(found):
        raise ValueError(f"{path}: shards are missing or hold other ids")
    manifest = {"rows": sum(r["rows"] for r in found.values()), "dimension": dimension, "shards": [r for _, r in sorted(found.items())]}
    stores.put(f"{path}/manifest.json", json.dumps(manifest).encode())


def read_vector_shards(spark: SparkSession, path: str) -> DataFrame:
    """``id, embedding`` of a finished set of shards, one task for each; a file that differs from its record is an error."""
    spark.dataSource.register(VectorShards)
    return spark.read.format("vector_shards").load(path)
