"""Drifted Parquet files rewritten to one evolved schema: DuckDB inside tasks, columns matched by the footer's field ids."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from tempfile import TemporaryDirectory
from urllib.parse import urlsplit

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.ordered import numbered
from lexmill.session import durable


@dataclass(frozen=True)
class Field:
    """A column of the evolved schema; ``missing`` is what rows of files without it get."""

    id: int
    name: str
    kind: str
    missing: object = None


#: The evolved schema of ``clients``, with its field ids.
CLIENTS = (
    Field(1, "client_id", "BIGINT"), Field(2, "master_id", "BIGINT"), Field(3, "source", "VARCHAR", "none"), Field(4, "updated_at", "TIMESTAMP"), Field(5, "name", "VARCHAR"),
    Field(6, "email", "VARCHAR"), Field(7, "city", "VARCHAR"), Field(8, "nation_id", "BIGINT", -1), Field(9, "segment", "VARCHAR"), Field(10, "balance", "DOUBLE"))

_ARROW = {"BIGINT": pa.int64(), "INTEGER": pa.int32(), "VARCHAR": pa.string(), "TIMESTAMP": pa.timestamp("us"), "DOUBLE": pa.float64(), "FLOAT": pa.float32()}
_SPARK = {"BIGINT": "long", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "DOUBLE": "double"}
_FIELD_ID = b"PARQUET:field_id"

#: Rows of a row group, the most that a writing task holds, and what DuckDB may use in one task.
ROW_GROUP, DUCKDB_MEMORY = 50_000, "256MB"


# ---- files in whatever store holds them ------------------------------------------------------------------


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``file:/a``, ``/a`` or another scheme that Arrow knows."""
    s = urlsplit(uri)
    return (fs.LocalFileSystem(), s.path) if s.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


@contextmanager
def _read_here(uri: str) -> Iterator[str]:
    """A path that DuckDB can open: the file itself, or a copy for the time of one file where the store is remote."""
    store, path = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        yield path
        return
    with TemporaryDirectory() as d:
        fs.copy_files(path, f"{d}/x.parquet", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        yield f"{d}/x.parquet"


@contextmanager
def _written(uri: str, staging: str) -> Iterator[str]:
    """A path to write to; once written, the file is put in place whole, so that a task that dies or runs twice leaves no half."""
    store, path = _store(uri)
    _, aside = _store(f"{staging}/{uuid.uuid4().hex}")
    for p in (path, aside):
        store.create_dir(os.path.dirname(p), recursive=True)
    if isinstance(store, fs.LocalFileSystem):
        yield aside
    else:
        with TemporaryDirectory() as d:
            yield f"{d}/x.parquet"
            fs.copy_files(f"{d}/x.parquet", aside, source_filesystem=fs.LocalFileSystem(), destination_filesystem=store)
    store.move(aside, path)


# ---- starting files --------------------------------------------------------------------------------------


def drifted(version: int, fields: tuple[Field, ...] = CLIENTS) -> list[tuple[Field, str, str]]:
    """Columns of a starting file as (field, name there, type there), in order, by the bits of its version.

    1: name and email swap names only; 2: columns after the first reverse; 4: nation_id and source are missing;
    8: balance is a float and nation_id an int.
    """
    swap = {"name": "email", "email": "name"} if version & 1 else {}
    narrow = {"balance": "FLOAT", "nation_id": "INTEGER"} if version & 8 else {}
    kept = [f for f in fields if not (version & 4 and f.name in ("nation_id", "source"))]
    if version & 2:
        kept = kept[:1] + kept[:0:-1]
    return [(f, swap.get(f.name, f.name), narrow.get(f.name, f.kind)) for f in kept]


def _tasks(df: DataFrame, files: int) -> int:
    """Partitions for so many files: few short rows would else be put together for one task."""
    return max(1, min(files, 4 * df.sparkSession.sparkContext.defaultParallelism))


def _file_name(n: int) -> str:
    return f"clients-{n:05d}.parquet"


def write_drifted(rows: DataFrame, folder: str, fields: tuple[Field, ...] = CLIENTS) -> DataFrame:
    """Write ``rows`` (``file_no, version, row`` and the fields) as one file for each file_no, in the order of ``row``: ``file_no, version, path``.

    A file is written by one task, a row group at a time; the table of files is checkpointed.
    """
    names = [f.name for f in fields]

    def schema(version: int) -> pa.Schema:
        return pa.schema([pa.field(name, _ARROW[kind], True, {_FIELD_ID: str(f.id).encode()}) for f, name, kind in drifted(version, fields)])

    def table(batches: list[pa.RecordBatch], version: int) -> pa.Table:
        whole = pa.Table.from_batches(batches)
        to = schema(version)
        return pa.Table.from_arrays([whole[f.name].cast(to.field(i).type) for i, (f, _, _) in enumerate(drifted(version, fields))], schema=to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by file; pieces of one file go to its writer until another file begins."""
        def pieces() -> Iterator[tuple[int, int, pa.RecordBatch]]:
            for b in batches:
                file_no, at = b.column("file_no").to_numpy(), 0
                while at < len(file_no):
                    to = int(file_no.searchsorted(file_no[at], "right"))
                    yield int(file_no[at]), b.column("version")[at].as_py(), b.slice(at, to - at)
                    at = to

        source = pieces()
        piece = next(source, None)
        while piece is not None:
            number, version, _ = piece
            uri, held, n = f"{folder}/files/{_file_name(number)}", [], 0
            with _written(uri, f"{folder}/staging") as path, pq.ParquetWriter(path, schema(version)) as out:
                while piece is not None and piece[0] == number:
                    held.append(piece[2])
                    n += piece[2].num_rows
                    if n >= ROW_GROUP:
                        out.write_table(table(held, version))
                        held, n = [], 0
                    piece = next(source, None)
                if held:
                    out.write_table(table(held, version))
            yield pa.RecordBatch.from_pydict({"file_no": [number], "version": pa.array([version], pa.int32()), "path": [uri]})

    by_file = rows.select("file_no", "version", "row", *(F.col(f.name).cast(_SPARK[f.kind]) for f in fields)).repartition(_tasks(rows, (rows.agg(F.max("file_no")).first()[0] or 0) + 1), "file_no").sortWithinPartitions("file_no", "row")
    return durable(by_file.select("file_no", "version", *names).mapInArrow(run, "file_no long, version int, path string"))


# ---- the rewrite -----------------------------------------------------------------------------------------


def _connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY})
    con.execute("SET preserve_insertion_order = true")
    con.execute("SET disabled_optimizers = 'statistics_propagation'")  # else columns without a null in this file are written as required
    return con


def _text(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def footer(con: duckdb.DuckDBPyConnection, path: str) -> dict[int, str]:
    """Names of a file's columns by their field ids, in the file's order."""
    got = con.execute(f"SELECT field_id, name FROM parquet_schema({_text(path)}) WHERE field_id IS NOT NULL").fetchall()
    if len({i for i, _ in got}) < len(got):
        raise ValueError(f"{path}: a field id comes twice")
    return dict(got)


def select_by_ids(con: duckdb.DuckDBPyConnection, path: str, fields: tuple[Field, ...]) -> str:
    """The SELECT of one file: each evolved column from the column of its id, cast, or its stand-in where there is none."""
    there = footer(con, path)
    value = lambda f: _name(there[f.id]) if f.id in there else "NULL" if f.missing is None else _text(f.missing)
    return f"SELECT {', '.join(f'CAST({value(f)} AS {f.kind}) AS {_name(f.name)}' for f in fields)} FROM read_parquet({_text(path)})"


def copy_evolved(con: duckdb.DuckDBPyConnection, path: str, to: str, fields: tuple[Field, ...]) -> None:
    ids = ", ".join(f"{_name(f.name)}: {f.id}" for f in fields)
    con.execute(f"COPY ({select_by_ids(con, path, fields)}) TO {_text(to)} (FORMAT parquet, FIELD_IDS {{{ids}}}, ROW_GROUP_SIZE {ROW_GROUP})")


def rewrite(files: DataFrame, folder: str, *, untouched: Callable[[int], bool], look: Callable, fields: tuple[Field, ...] = CLIENTS, kind: str) -> DataFrame:
    """Each file of ``files`` (``file_no, version, path``) once in the evolved schema, under ``folder/files``.

    A task reads a file's footer, writes the evolved file beside the table and describes it with ``look(con, path)``;
    only when all are there does the driver put them in the old ones' places, some hundred renames. Until then the old
    files are as they were, so tasks can be run again. Files for which ``untouched(version)`` holds are described only.
    Returns ``file_no, version, start_columns, rewritten, path`` and the columns of ``kind``, checkpointed.
    """
    spark = files.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        con = _connect()
        for pdf in batches:
            for r in pdf.itertuples():
                new = not untouched(r.version)
                target = f"{folder}/evolved/{os.path.basename(r.path)}" if new else r.path
                with _read_here(r.path) as old:
                    start = ",".join(footer(con, old).values())
                    if new:
                        with _written(target, f"{folder}/staging") as to:
                            copy_evolved(con, old, to, fields)
                with _read_here(target) as now:
                    yield pd.DataFrame([{"file_no": r.file_no, "version": r.version, "start_columns": start, "rewritten": new, "path": r.path} | look(con, now)])

    done = durable(files.repartition(_tasks(files, files.count()), "file_no").mapInPandas(run, f"file_no long, version int, start_columns string, rewritten boolean, path string, {kind}"))
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in done.where("rewritten").select("path").collect():  # a path for each file of the table, not a row of it
        new, old = jvm.org.apache.hadoop.fs.Path(f"{folder}/evolved/{os.path.basename(r.path)}"), jvm.org.apache.hadoop.fs.Path(r.path)
        if store.exists(new):
            store.delete(old, False)
            if not store.rename(new, old):
                raise OSError(f"cannot put {r.path} in place")
    for name in ("evolved", "staging"):
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return done


# ---- the clients table -----------------------------------------------------------------------------------


def placed(clients: DataFrame, *, files: int = 500) -> DataFrame:
    """``clients`` with ``row``, ``file_no`` and ``version``: rows by the hash of their id, cut into ``files`` files at most.

    Null ids hash as empty text and come before others of that hash; rows that share an id follow each other by their
    other columns, so an id that is repeated without end still lies in many tasks. An empty table has no files.
    """
    own = clients.select(*(F.col(f.name) for f in CLIENTS))
    digest = F.crc32(F.coalesce(F.col("client_id").cast("string"), F.lit("")).cast("binary"))
    rows = numbered(own.withColumn("__crc", digest), "__crc", *(f.name for f in CLIENTS)).drop("__crc")
    size = 1 + rows.count() // files
    numbers = rows.withColumn("file_no", F.floor(F.col("row") / size).cast("long"))
    version = F.crc32(F.concat(F.lit("42:"), F.col("file_no").cast("string")).cast("binary")) % 24
    return numbers.withColumn("version", F.when(version > 15, 0).otherwise(version).cast("int"))


def _digests(con: duckdb.DuckDBPyConnection, path: str) -> dict:
    """Counts and digests of a file of clients, its rows streamed in their order."""
    values = [
        "epoch_us(updated_at)" if f.name == "updated_at" else "TRY_CAST(floor(1048576 * balance) AS HUGEINT)" if f.name == "balance" else _name(f.name) for f in CLIENTS]
    row = " || '|' || ".join(f"coalesce(CAST({v} AS VARCHAR), '?')" for v in values)
    nulls = " + ".join(f"CAST({_name(f.name)} IS NULL AS INTEGER)" for f in CLIENTS)
    got = con.execute(f"SELECT coalesce(CAST(client_id AS VARCHAR), '?'), {row}, {nulls} FROM read_parquet({_text(path)})")
    ids, rows, n, empty = hashlib.sha256(), hashlib.sha256(), 0, 0
    while part := got.fetchmany(10_000):
        ids.update(("," * bool(n) + ",".join(x for x, _, _ in part)).encode())
        rows.update(("\n" * bool(n) + "\n".join(x for _, x, _ in part)).encode())
        n += len(part)
        empty += sum(x for _, _, x in part)
    return {"n_rows": n, "n_nulls": empty, "ids_sha256": ids.hexdigest(), "rows_sha256": rows.hexdigest(), "columns": ",".join(footer(con, path).values())}


def evolve_clients(clients: DataFrame, folder: str) -> DataFrame:
    """Write the drifted files of ``clients`` under ``folder/files``, rewrite them there, and describe each file that is there in the end."""
    files = write_drifted(placed(clients), folder)
    done = rewrite(
        files, folder, untouched=lambda version: version == 0, look=_digests, kind="n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, columns string")
    return done.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
