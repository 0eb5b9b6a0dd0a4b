"""Unions, distinct rows, set operations, and long and wide forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows by column names; missing columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_on(df: DataFrame, keys: list[str], order: list, keep: str = "first") -> DataFrame:
    """The first or last row of each key in a full order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(w)
    if keep == "first":
        return df.withColumn("__n", n).where("__n = 1").drop("__n")
    back = F.lead(F.lit(1)).over(w)
    return df.withColumn("__n", back).where("__n is null").drop("__n")


def set_members(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(value, in_a, in_b) of the distinct values of a column in two relations: union, with what intersects and differs."""
    x = a.select(F.col(column).alias("value")).distinct().withColumn("a", F.lit(True))
    y = b.select(F.col(column).alias("value")).distinct().withColumn("b", F.lit(True))
    j = x.join(y.withColumnRenamed("value", "v2"), F.col("value").eqNullSafe(F.col("v2")), "full")
    return j.select(F.coalesce("value", "v2").alias("value"), F.coalesce("a", F.lit(False)).alias("in_a"), F.coalesce("b", F.lit(False)).alias("in_b"))


def missing_business_days(df: DataFrame, date: str) -> DataFrame:
    """Business days between the first and last date that no row has."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias(date)).where(F.weekday(date) < 5)
    return days.join(df.select(date).distinct(), date, "left_anti")


def wide(df: DataFrame, keys: list[str], name: str, values: list[str], names: list[str], template: str = "{value}_{name}") -> DataFrame:
    """One row a key, one column for each value and stated name; NULL where there is none."""
    out = df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == n, F.col(v))).alias(template.format(value=v, name=n)) for v in values for n in names])
    return out


def long(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def split_rows(df: DataFrame, column: str, sep: str, out: str) -> DataFrame:
    """One row for each non-empty trimmed piece of a delimited cell; rows without any fall away."""
    parts = F.filter(F.transform(F.split(column, sep), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return df.withColumn(out, F.explode(parts))


def extract_rows(df: DataFrame, column: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """One row for each match of a pattern in a text."""
    return df.withColumn(out, F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(group))))


def dummies(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """0/1 columns for stated values; NULL is 0 in all."""
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def parameter_grid(spark, axes: dict[str, list]) -> DataFrame:
    """All combinations of settings, numbered; built on the driver, as it is a plan and no data."""
    from itertools import product

    names = list(axes)
    rows = [(i + 1, *x) for i, x in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, ["grid_no", *names])


def assumed_rows(rows: DataFrame, entity: str, date: str, given: Column, target: str, flag: str = "assumed") -> DataFrame:
    """Rows of ``target`` on the dates when another entity was there and it was not, flagged; a second call adds none."""
    base = rows if flag in rows.columns else rows.withColumn(flag, F.lit(False))
    have = base.where(F.col(entity) == target).select(date).distinct()
    add = base.where(given).select(date).distinct().join(have, date, "left_anti").withColumn(entity, F.lit(target)).withColumn(flag, F.lit(True))
    return base.unionByName(add, allowMissingColumns=True)
