"""Prefix-filtered self-join of sets under a Jaccard threshold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut


def grams(words: list[str], q: int = 3) -> list[str]:
    """Letter q-grams of each word with marks at both ends, without repeats; whole words shorter than q stay."""
    out: set[str] = set()
    for w in words:
        s = f"^{w}$"
        out.update(s[i : i + q] for i in range(max(1, len(s) - q + 1)))
    return sorted(out)


def similar_sets(sets: DataFrame, threshold: float, key: str = "id", items: str = "grams", asks: str | None = None) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of rows of ``sets`` (key, array) with at least ``threshold`` similarity.

    Two sets that similar share one of their first n - ceil(t * n) + 1 items in any common order of the items;
    here the rarest come first, so only rows that share a rare item are paired. Then sizes, what is left behind the
    shared items, and the sets themselves are compared where the rows meet: sets go to each of their first items, so what
    is shuffled grows with the rows, and pairs that are not similar are never written. Rows with equal sets should be
    merged before. Null and empty sets pair with nothing. ``asks`` names a boolean column: only pairs with a row that
    asks are returned.
    """
    ask = F.col(asks) if asks else F.lit(True)
    sets = sets.select(F.col(key).alias("id"), F.array_distinct(items).alias("items"), ask.alias("ask")).where(F.size("items") > 0)
    each = sets.select("id", "ask", F.explode("items").alias("g"))
    # Items are numbered: a number is less to carry than a text.
    count = cut(each.groupBy("g").agg(F.count("*").alias("n"))).withColumn("k", F.monotonically_increasing_id())
    ordered = each.join(count, "g").groupBy("id", "ask").agg(F.sort_array(F.collect_list(F.struct("n", "k"))).alias("o"))
    ordered = ordered.select("id", "ask", F.transform("o", lambda x: x["k"]).alias("o"))
    # Sets are few bytes for the pairs they make: they are spread over all cores and not put together again.
    spark = sets.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(ordered.repartition(tasks))
    n = F.size("o")
    first = ordered.select("id", "ask", "o", n.alias("n"), F.posexplode(F.slice("o", F.lit(1), (n - F.ceil(F.lit(threshold - 1e-9) * n) + 1).cast("int"))).alias("at", "g"))
    x, y = first.alias("x"), first.alias("y")
    sizes = (F.col("x.n") >= F.lit(threshold) * F.col("y.n")) & (F.col("y.n") >= F.lit(threshold) * F.col("x.n"))
    # At the first item that two sets share, no more than this one and what follows it in the shorter rest is common.
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    sizes = sizes & (left >= F.lit(threshold / (1 + threshold)) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    same = F.size(F.array_intersect("x.o", "y.o"))
    jaccard = same / (F.col("x.n") + F.col("y.n") - same)
    # The rows that ask are joined with all, so that the others are never paired among themselves.
    once = (F.col("x.id") < F.col("y.id")) | (~F.col("y.ask") & (F.col("x.id") != F.col("y.id"))) if asks else F.col("x.id") < F.col("y.id")
    pairs = (x.where("x.ask") if asks else x).join(y, (F.col("x.g") == F.col("y.g")) & once & sizes & (jaccard >= threshold))
    # Sets meet at each of their first items that they share.
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), jaccard.alias("jaccard")).distinct()


def prefix_length(n: int, threshold: float) -> int:
    """Items of a set of ``n`` that take part in the search."""
    return n - math.ceil(threshold * n - 1e-9) + 1
