"""Running sums, ranks and exact quantiles over a whole order, without one task that holds it.

Rows are range-partitioned and sorted; each partition runs on its own, and what lies before it comes from one
number a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import broadcast_if_small, cut


def running(df: DataFrame, order: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running values over all rows in an order: out: (numeric column, "sum" or "max").

    NULL counts as nothing. The order must tell rows apart wherever the result depends on it. Columns must not be
    named ``__...``. An empty table gives no rows.
    """
    ins = {o: f"__in{i}" for i, o in enumerate(values)}
    d = df.withColumns({ins[o]: F.col(c).cast("double" if how == "max" else df.select(c).schema[0].dataType.simpleString()) for o, (c, how) in values.items()})
    d = d.withColumns({i: F.coalesce(F.col(i), F.lit(float("-inf")) if values[o][1] == "max" else F.lit(0)) for o, i in ins.items()})
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    whole = {o: how == "sum" and d.schema[ins[o]].dataType.typeName() in ("long", "integer", "short", "byte") for o, (_, how) in values.items()}
    n_kept = len(df.columns)
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{o}` {'long' if whole[o] else 'double'}" for o in values] + ["__task int", "__at long"])
    hows = [how for _, how in values.values()]
    ints = [*whole.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at = 0
        carry = [0 if how == "sum" else -np.inf for how in hows]
        for b in batches:
            arrays = list(b.columns[:n_kept])
            for k, how in enumerate(hows):
                x = b.column(n_kept + k).to_numpy(zero_copy_only=False).astype(np.int64 if ints[k] else np.float64)
                y = np.cumsum(x) + carry[k] if how == "sum" else np.maximum(np.maximum.accumulate(x), carry[k])
                carry[k] = y[-1] if len(y) else carry[k]
                arrays.append(pa.array(y))
            arrays += [pa.array(np.full(b.num_rows, task, np.int32)), pa.array(np.arange(at, at + b.num_rows))]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:n_kept], *values, "__task", "__at"])

    d = cut(d.mapInArrow(run, schema))
    # One row a partition: what its last row has.
    ends = d.groupBy("__task").agg(*[F.max_by(o, "__at").alias(o) for o in values])
    w = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("__task", *[(F.coalesce(F.sum(o).over(w), F.lit(0)) if how == "sum" else F.coalesce(F.max(o).over(w), F.lit(float("-inf")))).alias(f"__b_{o}") for o, (_, how) in values.items()])
    d = d.join(F.broadcast(before), "__task")  # one row a partition
    return d.select(*df.columns, *[(F.col(o) + F.col(f"__b_{o}") if how == "sum" else F.greatest(o, f"__b_{o}")).alias(o) for o, (_, how) in values.items()])


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``out``: 1..n in an order that tells all rows apart."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), order, {out: ("__one", "sum")}).drop("__one")


def cumulative_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, c, upto, n): each distinct value of a group that is not NULL, how often it comes, how many of the
    group's values are not above it, and how many the group has. Equal values are counted before they are shuffled."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    r = cut(running(counts, [*group, value], {"__upto": ("c", "sum")}))
    g = [f"__g{i}" for i in range(len(group))]
    per = r.groupBy(*[F.col(c).alias(k) for c, k in zip(group, g, strict=True)]).agg(F.sum("c").alias("n"), F.min(F.col("__upto") - F.col("c")).alias("__from"))
    same = F.lit(True)
    for c, k in zip(group, g, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    j = r.join(broadcast_if_small(cut(per)), same) if group else r.join(F.broadcast(per))  # one row
    return j.select(*group, value, "c", (F.col("__upto") - F.col("__from")).alias("upto"), "n")


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """(group, one column for each of ``probs``): exact quantiles of type 7; a group without values does not come out.

    Of each group only the values at the two places of each quantile are aggregated.
    """
    group = group or []
    c = cumulative_counts(df, group, value)
    aggs = []
    for name, p in probs.items():
        place = (F.col("n") - 1) * F.lit(float(p))
        at = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("c") <= k), F.col(value).cast("double")))
        aggs += [at(F.floor(place)).alias(f"__lo_{name}"), at(F.ceil(place)).alias(f"__hi_{name}"), F.max(place - F.floor(place)).alias(f"__f_{name}")]
    q = c.groupBy(*group).agg(*aggs)
    return q.select(*group, *[((1 - F.col(f"__f_{x}")) * F.col(f"__lo_{x}") + F.col(f"__f_{x}") * F.col(f"__hi_{x}")).alias(x) for x in probs])
