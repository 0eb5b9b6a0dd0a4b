"""Lines that a large share of a source's rows hold: mergeable summaries, then exact counts.

The first pass keeps, in each partition and for each source, a lossy-counting summary: after every
``1 / eps`` rows of the source, keys whose count cannot reach the mean are dropped. A key's count is then
too small by at most ``eps`` of the rows seen. Summaries are merged by adding counts, so the sum over all
partitions is too small by at most ``eps`` of the source's rows, however the rows lie. Keys whose summed
count reaches the threshold less ``eps`` are candidates: no key at or above the threshold is missed. A
source has at most (mean lines of a row) / (threshold - eps) candidates, so one source never makes a large
set, whatever share of all rows it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import broadcast_if_small

#: Sets of all sources together up to so many bytes go to the executors as one broadcast value.
BROADCAST_SET_BYTES = 48 * 1024 * 1024
#: Longer keys are kept as a digest of the whole key.
KEY_CHARS = 160


def short_key(key: str) -> str:
    return key if len(key) <= KEY_CHARS else "\x02" + hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class LossyCounter:
    """Counts of the keys of rows, each at most ``eps`` of the rows too small."""

    def __init__(self, eps: float):
        self.width = max(1, round(1 / eps))
        self.rows = 0
        self.counts: dict[str, list[int]] = {}

    def add(self, keys: set[str]) -> None:
        bucket = self.rows // self.width
        for k in keys:
            c = self.counts.get(k)
            if c is None:
                self.counts[k] = [1, bucket]
            else:
                c[0] += 1
        self.rows += 1
        if self.rows % self.width == 0:
            b = self.rows // self.width
            self.counts = {k: c for k, c in self.counts.items() if c[0] + c[1] > b}


#: The source under which keys of all rows together are counted; no site is named so.
ALL = "\x01all"


def candidates(df: DataFrame, source: str, text: str, keys_of: Callable[[str], object], share: float, eps: float, wide: tuple[float, float] | None = None) -> DataFrame:
    """(source, key, n_least, n_rows): keys that may be in ``share`` of the source's rows with text.

    Rows with a null source are a source of their own. Blank and null texts count as no row. With ``wide``, the
    (share, eps) of keys over all rows, ``keys_of`` gives two sets, those of the source and those of all rows,
    which are counted in the same pass under the source ALL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str | None, LossyCounter] = {}
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and not t.isspace():
                    c = by.get(s)
                    if c is None:
                        c = by[s] = LossyCounter(eps)
                    if wide is None:
                        c.add(keys_of(t))
                    else:
                        own, every = keys_of(t)
                        c.add(own)
                        c = by.get(ALL)
                        if c is None:
                            c = by[ALL] = LossyCounter(wide[1])
                        c.add(every)
        src, key, n, rows = [], [], [], []
        for s, c in by.items():
            src.append(s), key.append(None), n.append(0), rows.append(c.rows)
            for k, (x, _) in c.counts.items():
                src.append(s), key.append(k), n.append(x), rows.append(0)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(key, pa.string()), pa.array(n, pa.int64()), pa.array(rows, pa.int64())], names=["source", "key", "n", "rows"])

    parts = df.select(F.col(source).cast("string"), F.col(text)).mapInArrow(run, "source string, key string, n long, rows long")
    merged = parts.groupBy("source", "key").agg(F.sum("n").alias("n_least"), F.sum("rows").alias("rows"))
    # The row of a source's total has no key; it goes to the source's keys by a join, not by a window over the group.
    totals = merged.where("key is null").select(F.col("source").alias("__s"), F.col("rows").alias("n_rows"))
    keys = merged.where("key is not null").join(broadcast_if_small(totals), F.col("source").eqNullSafe(F.col("__s")))
    least = F.lit(share - eps) if wide is None else F.when(F.col("source") == ALL, F.lit(wide[0] - wide[1])).otherwise(F.lit(share - eps))
    return keys.where(F.col("n_least") >= least * F.col("n_rows")).select("source", "key", "n_least", "n_rows")


class SourceSets:
    """The confirmed or candidate keys of every source, carried to the rows by broadcast or, beyond its bound, by a join."""

    def __init__(self, sets: DataFrame, limit: int | None = BROADCAST_SET_BYTES):
        """``sets``: (source, key), already small in proportion to the number of sources; no limit: their number is bounded."""
        self.spark = sets.sparkSession
        size = sets.agg(F.coalesce(F.sum(F.length("key") + 64), F.lit(0))).first()[0]
        self.frame = sets
        self.value = None
        if limit is None or size <= limit:
            by: dict[str | None, set[str]] = {}
            for s, k in sets.select("source", "key").toLocalIterator():
                by.setdefault(s, set()).add(k)
            self.value = self.spark.sparkContext.broadcast(by)

    def rows(self, df: DataFrame, source: str) -> DataFrame:
        """``df`` with the last column ``__keys``: null under a broadcast, else the keys of the row's source."""
        if self.value is not None:
            return df.withColumn("__keys", F.lit(None).cast("array<string>"))
        lists = self.frame.groupBy(F.col("source").alias("__s")).agg(F.collect_set("key").alias("__keys"))
        return df.join(lists, F.col(source).cast("string").eqNullSafe(F.col("__s")), "left").drop("__s")

    def getter(self) -> Callable[[str | None, list | None], set[str]]:
        """A function for the workers: the keys of a row from its source and its ``__keys``."""
        value, none = self.value, frozenset()

        def get(source: str | None, keys: list | None) -> set[str]:
            if value is not None:
                return value.value.get(source, none)
            return set(keys) if keys is not None else none

        return get
