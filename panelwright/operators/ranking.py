"""Orders, limits and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sorted_rows(df: DataFrame, keys: list[tuple[str, bool]], tiebreak: str) -> DataFrame:
    """Rows by (column, descending?) keys, NULL last in either direction, then by the tiebreak."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in keys], tiebreak)


def top_with_ties(df: DataFrame, value: str, k: int) -> DataFrame:
    """The rows whose value is among the ``k`` largest, and all that equal the last of these."""
    low = df.where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(k).agg(F.min(value).alias("__low"))
    return df.join(F.broadcast(low), F.col(value) >= F.col("__low")).drop("__low")  # one row


def top_rows(df: DataFrame, value: str, tiebreak: str, k: int) -> DataFrame:
    """The ``k`` rows of the largest values, of equal ones those of the smallest tiebreak."""
    return df.orderBy(F.col(value).desc_nulls_last(), F.asc(tiebreak)).limit(k)


def top_per_group(df: DataFrame, group: list[str], value: str, tiebreak: str, k: int) -> DataFrame:
    """``rank_no`` 1..k within each group; only k rows a group and partition are shuffled."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc_nulls_last(), F.asc(tiebreak))
    return df.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


def extremes(df: DataFrame, value: str, tiebreak: str, k: int) -> DataFrame:
    """The ``k`` largest increases and decreases, with ``direction`` and ``rank_no``."""
    known = df.where(F.col(value).isNotNull())
    up = known.where(F.col(value) > 0).orderBy(F.desc(value), F.asc(tiebreak)).limit(k)
    down = known.where(F.col(value) < 0).orderBy(F.asc(value), F.asc(tiebreak)).limit(k)
    up = up.withColumn("direction", F.lit("increase")).withColumn("rank_no", F.row_number().over(Window.partitionBy("direction").orderBy(F.desc(value), F.asc(tiebreak))))
    down = down.withColumn("direction", F.lit("decrease")).withColumn("rank_no", F.row_number().over(Window.partitionBy("direction").orderBy(F.asc(value), F.asc(tiebreak))))
    return up.unionByName(down)


def nested_top(df: DataFrame, outer: DataFrame, key: str, value: str, tiebreak: str, k: int) -> DataFrame:
    """The ``k`` largest rows among those whose key is in ``outer``."""
    return top_rows(df.join(outer.select(key).distinct(), key, "left_semi"), value, tiebreak, k)


def head_of_queue(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
