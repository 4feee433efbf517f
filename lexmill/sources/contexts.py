"""Reading context archives, question files and model lists, strictly: what is not as it must be is an error."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.sources import archives
from lexmill.sources.archives import MEMBER
from lexmill.sources.stores import open_seekable

SCHEMA = "document_id string, source_title string, source_url string, raw_text string, source_name string"


def strict_json(data: bytes) -> dict:
    """One JSON object in UTF-8; a repeated key is an error."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key is there twice")
        return out

    value = json.loads(data.decode("utf-8"), object_pairs_hook=unique)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value


def adapt(name: str, record: dict) -> tuple[str, str | None, str, str, str]:
    """A source document of one record; the file's number is its id, its link https, its fields the known ones."""
    if not set(record) <= {"id", "name", "link", "passage"} or not {"id", "link", "passage"} <= set(record):
        raise ValueError(f"{name}: fields {sorted(record)}")
    key = record["id"]
    if isinstance(key, bool) or not isinstance(key, (int, str)) or not str(key).strip():
        raise ValueError(f"{name}: id {key!r}")
    key = str(key).strip()
    if key != MEMBER.fullmatch(name)[1]:
        raise ValueError(f"{name}: holds id {key}")
    if not re.match(r"https://[^/\s]+", str(record["link"])):
        raise ValueError(f"{name}: link {record['link']!r}")
    if not isinstance(record["passage"], str) or not record["passage"].strip():
        raise ValueError(f"{name}: blank passage")
    return key, record.get("name"), record["link"], record["passage"], name


def read_contexts(spark: SparkSession, path: str, *, tasks: int | None = None) -> DataFrame:
    """Documents of ZIP archives or of folders of JSON files.

    Each archive is read by ``tasks`` tasks (as many as the session has cores, if not given), a range of its members each.
    Ids must be unique: an id twice is an error when rows are read.
    """
    archives.register(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [adapt(name, strict_json(data)) for name, data in zip(pdf["source_name"], pdf["content"])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").load(path)
    zips = [r.path for r in files.select("path").where("path like '%.zip'").collect()]  # names of files, as Spark lists them
    found = [spark.read.format("context_zip").option("tasks", tasks or spark.sparkContext.defaultParallelism).load(z) for z in zips]
    plain = files.where("path not like '%.zip'").select(F.substring_index("path", "/", -1).alias("source_name"), "content")
    rows = reduce(DataFrame.unionByName, found, plain).mapInPandas(run, SCHEMA)
    twice = F.count("*").over(Window.partitionBy("document_id")) > 1
    return rows.withColumn("document_id", F.when(twice, F.raise_error(F.concat(F.lit("id twice: "), F.col("document_id"))).cast("string")).otherwise(F.col("document_id")))


def archive_identity(path: str) -> tuple[str, int]:
    """Digest over the ordered names and contents of an archive, each led by its length, and their number.

    The digest is defined over the bytes one after the other, so they pass through one process, a member at a time;
    ``audit.tree_digest`` of ``context_zip`` rows is the identity to use for large archives.
    """
    h = hashlib.sha256()
    with open_seekable(path) as file, zipfile.ZipFile(file) as z:
        found = archives.members(z)
        for name, e in found:
            for part in (name.encode(), z.read(e)):
                h.update(len(part).to_bytes(8, "big"))
                h.update(part)
    return h.hexdigest(), len(found)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def read_questions(spark: SparkSession, path: str, *, require_answer: bool) -> DataFrame:
    """``question_id, question, answer`` of a JSON object of questions; blank questions, and answers there or not as asked, are errors."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<question: string, answer: string>>", {"mode": "FAILFAST"}).alias("m"))
    rows = raw.select(F.explode("m").alias("question_id", "x")).select("question_id", "x.question", "x.answer")
    has = F.trim(F.coalesce("answer", F.lit(""))) != ""
    bad = (F.trim(F.coalesce("question", F.lit(""))) == "") | (~has if require_answer else has)
    return rows.withColumn("question", F.when(bad, F.raise_error(F.concat(F.lit("bad record: "), F.col("question_id"))).cast("string")).otherwise(F.col("question")))


def repeated_questions(questions: DataFrame) -> DataFrame:
    """``normalized, questions, first_id`` of questions that are alike once normalised: what a reader of questions has to count."""
    key = T.normalize_question(F.col("question")).alias("normalized")
    return questions.groupBy(key).agg(F.count("*").alias("questions"), F.min("question_id").alias("first_id")).where("questions > 1")


def read_model_links(spark: SparkSession, path: str) -> DataFrame:
    """Distinct links of a CSV whose header has ``Link`` in any case, without a closing slash."""
    csv = spark.read.csv(path, header=True, encoding="UTF-8")
    column = next(c for c in csv.columns if c.strip("﻿ ").lower() == "link")
    return csv.select(F.regexp_replace(F.trim(F.col(f"`{column}`")), "/+$", "").alias("link")).where("link <> ''").distinct()
