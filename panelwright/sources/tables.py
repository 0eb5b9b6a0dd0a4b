"""Readers and writers of tables: Parquet, CSV, JSON, spreadsheets, SQLite, dated files, upserts."""

from __future__ import annotations

import sqlite3
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelwright.operators.contracts import ContractError, alias_faults
from panelwright.operators.windows import best_row


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of ``folder``; codec and part layout are found by the reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parquet(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Parquet files whatever their extension says of the codec."""
    r = spark.read
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


def text_table(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",", missing: str = "NA", schema: str | None = None) -> DataFrame:
    """CSV with a header: all columns are text unless a schema is given; a byte-order mark and marks of missing values fall away."""
    r = spark.read.option("header", True).option("encoding", encoding).option("sep", sep).option("nullValue", missing).option("multiLine", False)
    df = (r.schema(schema) if schema else r.option("inferSchema", False)).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def alias_table(spark: SparkSession, path: str, key: str = "alias", status: str = "status", ident: str = "canonical_id") -> DataFrame:
    """Tab-separated aliases without quoting; raises if the table breaks its contract."""
    df = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    df = df if status in df.columns else df.withColumn(status, F.lit("reviewed"))
    bad = alias_faults(df, key, status, ident).where("n > 0").collect()
    if bad:
        raise ContractError(f"alias table {path}: {[tuple(b) for b in bad]}")
    return df


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def sheet_with_header(rows: DataFrame, order: str, sentinel_column: str, sentinel: str) -> DataFrame:
    """The table below the row whose first cell is ``sentinel``: that row gives the names, rows above fall away.

    ``rows``: cells as text in columns, with an order column; a sheet as it was read without a header.
    """
    head = rows.where(F.trim(sentinel_column) == sentinel).orderBy(order).limit(1).collect()
    if not head:
        raise ContractError(f"no row begins with {sentinel}")
    names = {c: (head[0][c] or c).strip() for c in rows.columns if c != order}
    return rows.where(F.col(order) > head[0][order]).withColumnsRenamed(names)


def dated_files(spark: SparkSession, path: str, pattern: str = r"(\d{4})[-_](\d{2})[-_](\d{2})", form: str = "parquet", **options: object) -> DataFrame:
    """Files of a folder with the date in their names as ``file_date`` (NULL if there is none)."""
    df = spark.read.format(form).options(**options).load(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    g = [F.regexp_extract(name, pattern, k) for k in (1, 2, 3)]
    return df.withColumn("file_date", F.to_date(F.try_to_timestamp(F.concat_ws("-", *g), F.lit("yyyy-MM-dd"))))


def write_named(df: DataFrame, path: str, by: str, name: str) -> str:
    """One CSV file for each value of ``by`` in one folder, with the value in its name (``name`` has a ``{}``); the folder.

    Values are as many as files: days, sources. Rows of a value are written by one task, as one file needs.
    """
    df.repartition(by).sortWithinPartitions(by).write.partitionBy(by).option("header", True).csv(f"{path}/parts")
    jvm = df.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    fs = folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/files"))
    for part in fs.listStatus(folder):
        if part.isDirectory():
            value = part.getPath().getName().split("=", 1)[1]
            files = [f.getPath() for f in fs.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
            for k, f in enumerate(files):
                fs.rename(f, jvm.org.apache.hadoop.fs.Path(f"{path}/files/{name.format(value if not k else f'{value}.{k}')}"))
    return f"{path}/files"


def replace_table(df: DataFrame, path: str) -> None:
    """Write a Parquet table beside the old one and put it in its place once it is whole: readers see either of them.

    If the write fails the old table stays. The swap is two renames in one folder.
    """
    jvm = df.sparkSession.sparkContext._jvm
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(new), at(path)):
        raise OSError(f"{new} could not be put in place of {path}")
    fs.delete(at(old), True)


def union_by_name(frames: list[DataFrame], wanted: dict[str, str], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """The wanted columns (name: type) of several tables: missing ones NULL, other names of a column coalesced, all cast."""
    def one(df: DataFrame) -> DataFrame:
        out = []
        for c, t in wanted.items():
            have = [x for x in [c, *(aliases or {}).get(c, [])] if x in df.columns]
            out.append((F.coalesce(*[F.col(x).try_cast(t) for x in have]) if have else F.lit(None).cast(t)).alias(c))
        return df.select(*out)

    return reduce(lambda a, b: a.unionByName(b), [one(d) for d in frames])


def completed_parts(spark: SparkSession, folder: str, marker: str = "_SUCCESS") -> list[str]:
    """Sub-folders of a folder that hold the marker of a finished write, in order of names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(str(s.getPath()) for s in fs.listStatus(path) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), marker)))


def cached_lookup(rows: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with what the cache has, distinct keys it lacks): the misses are what is still to be fetched."""
    return rows.join(cache, keys, "left"), rows.select(*keys).dropna().distinct().join(cache.select(*keys), keys, "left_anti")


class SqliteSource(DataSource):
    """Data source ``sqlite``: options path, table, schema (DDL), key (integer column) and partitions.

    The range of the key is cut into partitions; each is read by its own query on an executor in order of the key.
    Without a key there is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(schema, dict(self.options))


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns = [f.name for f in schema.fields]
        self.options = options

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        key, n = self.options.get("key"), int(self.options.get("partitions", "1"))
        if not key:
            return [InputPartition(None)]
        con = self._open()
        lo, hi = con.execute(f'select min("{key}"), max("{key}") from "{self.options["table"]}"').fetchone()
        con.close()
        if lo is None:
            return []
        step = max(1, -(-(hi - lo + 1) // n))
        return [InputPartition((a, min(a + step - 1, hi))) for a in range(lo, hi + 1, step)]

    def read(self, partition: InputPartition) -> object:
        con = self._open()
        names = ", ".join(f'"{c}"' for c in self.columns)
        sql = f'select {names} from "{self.options["table"]}"'
        key = self.options.get("key")
        if partition.value is not None:
            sql += f' where "{key}" between {partition.value[0]} and {partition.value[1]} order by "{key}"'
        yield from con.execute(sql)
        con.close()


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str, key: str | None = None, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    r = spark.read.format("sqlite").option("path", path).option("table", name).option("schema", schema)
    return (r.option("key", key).option("partitions", str(partitions)) if key else r).load()


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, one folder a value of ``by``; the committer replaces the old table only when all parts are written."""
    w = df.write.mode(mode).option("compression", codec)
    (w.partitionBy(*by) if by else w).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The table after rows with known keys have replaced the old ones; of several new rows the first in the order stays."""
    latest = best_row(new, keys, order)
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows of ``new`` with keys that the table lacks, one a key: what an insert would add."""
    return best_row(new, keys, order).join(old.select(*keys), keys, "left_anti")
