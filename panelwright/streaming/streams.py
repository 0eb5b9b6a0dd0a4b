"""Structured Streaming forms of resumable, idempotent ingestion and of event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.tables import completed_parts, upsert


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream, with the schema of those that are there."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(hadoop):
        return r.parquet(path)
    # A single file is the folder it lies in, without its neighbours.
    folder, name = path.rsplit("/", 1)
    return r.option("pathGlobFilter", name).parquet(folder)


def event_time(df: DataFrame, column: str, lateness: str) -> DataFrame:
    """``df`` with ``event_ts``, a timestamp with a watermark of ``lateness``."""
    return df.withColumn("event_ts", F.col(column).cast("timestamp")).withWatermark("event_ts", lateness)


def tumbling(df: DataFrame, width: str, keys: list[str], aggs: list[Column], slide: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, aggregates) in fixed or, with ``slide``, sliding windows."""
    w = F.window("event_ts", width, slide) if slide else F.window("event_ts", width)
    g = df.groupBy(w.alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in g.columns if c != "w"])


def sessions(df: DataFrame, gap: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """(session_start, session_end, keys, aggregates): runs of events with less than ``gap`` between them; runs that touch merge."""
    g = df.groupBy(F.session_window("event_ts", gap).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in g.columns if c != "w"])


def first_seen(df: DataFrame, keys: list[str], within_watermark: bool = False) -> DataFrame:
    """The first row of each key of a stream; with a watermark the state of old keys is let go."""
    return df.dropDuplicatesWithinWatermark(keys) if within_watermark else df.dropDuplicates(keys)


def run_to_end(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there in micro-batches and stop. A batch's number comes with it, so that a repeated one is known."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def exactly_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder and replaces it if the batch comes again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_state(spark: SparkSession, path: str, keys: list[str], order: list) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the latest row of each key in versions of a table; a repeated batch writes its version anew."""

    def merge(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else batch.limit(0)
        upsert(old.select(*batch.columns), batch, keys, order).write.mode("overwrite").parquet(f"{path}/v={number}")

    return merge


def last_version(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last batch left it: the version of the highest number that was written to its end."""
    done = completed_parts(spark, path)
    if not done:
        raise FileNotFoundError(f"no version of the table in {path}")
    return spark.read.parquet(max(done, key=lambda x: int(x.rsplit("=", 1)[1])))


def repeated(each: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink that gets every batch twice, as after a stop between the write and its record."""

    def twice(batch: DataFrame, number: int) -> None:
        each(batch, number)
        each(batch, number)

    return twice


def split_windows(start: int, end: int, count: Callable[[int, int], int], cap: int) -> list[tuple[int, int, int]]:
    """(from, to, n) windows of which each holds at most ``cap``, by halving; a single step that holds more stays.

    A plan for requests, made on the driver.
    """
    out, todo = [], [(start, end)]
    while todo:
        a, b = todo.pop()
        n = count(a, b)
        if n > cap and b > a:
            m = (a + b) // 2
            todo += [(m + 1, b), (a, m)]
        elif n:
            out.append((a, b, n))
    return out
