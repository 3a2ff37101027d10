"""Record sources: CSV and TSV with line spans, JSON, JSON lines, SQLite, URLs; file selection by digest."""

from __future__ import annotations

import csv
import io
import json
import sqlite3
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

RECORD = "path string, start int, end int, fields map<string,string>"


def format_of(path: str) -> str:
    """csv, tsv, json, jsonl or sqlite, by ending."""
    end = path.rpartition(".")[2].lower()
    return {"ndjson": "jsonl", "db": "sqlite", "sqlite3": "sqlite"}.get(end, end)


def parse_csv(text: str, delimiter: str = ",") -> list[tuple[int, int, dict[str, str]]]:
    """(first line, last line, fields) of each record: quoted line breaks, byte order mark, short rows padded, blank ones left out."""
    reader = csv.reader(io.StringIO(text.removeprefix("﻿")), delimiter=delimiter)
    head: list[str] | None = None
    out, at = [], 0
    for row in reader:
        start, at = at + 1, reader.line_num
        if not row or row == [""]:
            continue
        if head is None:
            head = [h.strip() for h in row]
            continue
        if len(row) > len(head):
            raise ValueError(f"line {start}: {len(row)} fields under {len(head)} names")
        out.append((start, at, dict(zip(head, [*row, *[""] * (len(head) - len(row))], strict=True))))
    return out


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", spans: bool = False) -> DataFrame:
    """Spark's own reader, a file a task, for quoted fields may hold line ends; with spans, whole files at a time, as RECORD rows."""
    if not spans:
        return spark.read.csv(path, header=True, sep=delimiter, multiLine=True, escape='"', encoding="UTF-8")
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, s, e, f) for p, t in zip(b["path"], b["value"], strict=True) for s, e, f in parse_csv(t, delimiter)], columns=["path", "start", "end", "fields"])

    return docs.mapInPandas(parse, RECORD)


def read_json(spark: SparkSession, path: str, records: str | None = None) -> DataFrame:
    """An array of objects, or the one at a dot path."""
    df = spark.read.json(path, multiLine=True)
    return df if records is None else df.select(F.explode(records).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


class SQLiteSource(DataSource):
    """spark.read.format("tenet_sqlite").option("path", …).option("table" or "query", …): read-only; exactly one of the two."""

    @classmethod
    def name(cls) -> str:
        return "tenet_sqlite"

    def statement(self) -> str:
        table, query = self.options.get("table"), self.options.get("query")
        if (table is None) == (query is None):
            raise ValueError("give exactly one of table and query")
        return query or 'SELECT * FROM "{}"'.format(table.replace('"', '""'))

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            names = [c[0] for c in db.execute(self.statement()).description]
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SQLiteReader(self.options["path"], self.statement())


class SQLiteReader(DataSourceReader):
    def __init__(self, path: str, statement: str) -> None:
        self.path, self.statement = path, statement

    def read(self, partition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(self.statement):
                yield tuple(None if v is None else str(v) for v in row)


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None) -> DataFrame:
    spark.dataSource.register(SQLiteSource)
    reader = spark.read.format(SQLiteSource.name()).option("path", path)
    for k, v in (("table", table), ("query", query)):
        reader = reader.option(k, v) if v is not None else reader
    return reader.load()


def read_url(spark: SparkSession, url: str, fetch: Callable[[str], tuple[str, str]]) -> DataFrame:
    """fetch(url) -> (content type, body), given by the caller; one response is a driver-side value by nature."""
    kind, body = fetch(url)
    if "json" in kind:
        found = json.loads(body)
        rows = [{k: v if isinstance(v, str) or v is None else json.dumps(v) for k, v in r.items()} for r in (found if isinstance(found, list) else [found])]
    else:
        rows = [f for _, _, f in parse_csv(body)]
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def select_files(spark: SparkSession, path: str, digests: DataFrame | None = None) -> DataFrame:
    """(path, digest) of files whose digest is not among the known ones (path, digest)."""
    found = spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 12).alias("digest"))
    return found if digests is None else found.join(digests.select("path", "digest"), ["path", "digest"], "left_anti")


def batches(files: DataFrame, size: int) -> DataFrame:
    """Files with a batch number, at most so many in one. Listings are small: their numbering is one ordered pass."""
    from pyspark.sql import Window

    return files.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("path")) - 1) / size))
