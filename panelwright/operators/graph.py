"""Classes of linked ids, found by rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut, forget

#: Rounds end as soon as no label changes; so many are more than a path of 2 ** 20 links needs.
MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    """Number and two independent checksums of distinct links: equal for equal sets of links."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the smallest id that each linked id can be reached from.

    Rounds of alternating star contraction: every id is linked to the smallest neighbour of its larger and then
    of its smaller neighbours, which halves long chains. Only links, never members of a class, are grouped; a
    hub's links are reduced to a minimum by partial aggregation. Ids without links do not come out.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: the larger neighbours of an id go to its smallest neighbour or itself.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: the smaller neighbours of an id, and the id itself, go to the smallest of them.
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = small.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        new = cut(new)
        old, edges, before, state = edges, new, state, _state(new)
        forget(old)
        if state == before:
            break
    else:
        raise RuntimeError("classes did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("u").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root")).distinct()
