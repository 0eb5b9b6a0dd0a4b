"""Data contracts: checks that raise, and checks that report. Each reads aggregates or one row, never a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table does not keep what its contract promises."""


def require_unique(df: DataFrame, keys: list[str], what: str = "key") -> DataFrame:
    """``df``, if no two rows share their keys (NULL equals NULL)."""
    dup = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if dup:
        raise ContractError(f"{what} {keys} is not unique: {dup[0].asDict()}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"columns are missing: {missing}")
    return df


def require_rows_kept(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, if it has as many rows as ``before``."""
    a, b = before.count(), after.count()
    if a != b:
        raise ContractError(f"{a} rows became {b}")
    return after


def require_before(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    """``df``, if no date reaches ``cutoff``: no look-ahead."""
    last = df.agg(F.max(column)).first()[0]
    if last is not None and str(last)[: len(cutoff)] >= cutoff:
        raise ContractError(f"{column} reaches {last}, the cutoff is {cutoff}")
    return df


def require_true(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """``df``, if no row makes ``condition`` false (NULL passes)."""
    bad = df.where(~condition).limit(1).collect()
    if bad:
        raise ContractError(f"{what}: {bad[0].asDict()}")
    return df


def missingness_report(df: DataFrame, observed: Column, columns: list[str]) -> DataFrame:
    """(column, null_observed, value_unobserved): both are 0 where a value is NULL exactly if not observed."""
    rows = [F.struct(F.lit(c).alias("column"), F.count_if(observed & F.col(c).isNull()).alias("null_observed"), F.count_if(~observed & F.col(c).isNotNull()).alias("value_unobserved")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def domain_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_broken) of rules that every row should keep; NULL counts as kept."""
    rows = [F.struct(F.lit(k).alias("rule"), F.count_if(~v).alias("n_broken")) for k, v in sorted(rules.items())]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations hold the same rows, as often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def require_idempotent(df: DataFrame, step) -> DataFrame:
    """``step(df)``, if a second application changes nothing."""
    once = step(df)
    if not same_rows(once, step(once)):
        raise ContractError("a second application changes rows")
    return once


def id_changes(old: DataFrame, new: DataFrame, key: list[str], ident: str) -> DataFrame:
    """(key, old_id, new_id) of keys in both tables whose id is another."""
    a, b = old.select(*key, F.col(ident).alias("old_id")), new.select(*key, F.col(ident).alias("new_id"))
    return a.join(b, key).where(~F.col("old_id").eqNullSafe(F.col("new_id")))


def range_coverage(ranges: DataFrame, rows: DataFrame, group: str, first: str, last: str, row: str) -> DataFrame:
    """(group, row, n): rows that the ranges [first, last] of their group do not cover exactly once."""
    covered = ranges.select(group, F.explode(F.sequence(first, last)).alias(row)).groupBy(group, row).agg(F.count("*").alias("n"))
    return rows.select(group, row).distinct().join(covered, [group, row], "full").select(group, row, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def orphan_links(links: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Links that name a row which is not there."""
    a = links.join(left.select(left_id).distinct(), left_id, "left_anti")
    b = links.join(right.select(right_id).distinct(), right_id, "left_anti")
    return a.unionByName(b).distinct()


def alias_faults(aliases: DataFrame, key: str, status: str, ident: str, domain: tuple[str, ...] = ("reviewed", "needs_review")) -> DataFrame:
    """(fault, n): empty keys, repeated keys, unknown status, and an id where there should be none or the reverse."""
    a = aliases.groupBy(key).agg(F.count("*").alias("n"))
    empty = aliases.agg(F.count_if(F.col(key).isNull() | (F.trim(key) == "")).alias("n")).select(F.lit("empty key").alias("fault"), "n")
    twice = a.where(F.col(key).isNotNull()).agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit("repeated key").alias("fault"), "n")
    odd = aliases.agg(F.count_if(~F.coalesce(F.col(status).isin(*domain), F.lit(False))).alias("n")).select(F.lit("unknown status").alias("fault"), "n")
    link = aliases.agg(F.count_if((F.col(status) == domain[0]) != F.col(ident).isNotNull()).alias("n")).select(F.lit("id against status").alias("fault"), "n")
    return empty.unionByName(twice).unionByName(odd).unionByName(link)


def require_file_hash(spark, path: str, digest: str) -> str:
    """SHA-256 of a file, if it is ``digest``."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if got != digest:
        raise ContractError(f"{path} has changed: {got}")
    return got


def file_hashes(spark, folder: str, glob: str = "*") -> DataFrame:
    """(file, n_bytes, sha256) of the files of a folder, each hashed on an executor."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
