"""Projections, predicates and rules kept as data."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.keys import label_key
from panelwright.functions.numbers import finite
from panelwright.session import broadcast_if_small, cut


def project(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """The columns of ``renames``, under their new names and in its order."""
    return df.select(*[F.col(a).alias(b) for a, b in renames.items()])


def across(df: DataFrame, test: Callable[[T.StructField], bool], fn: Callable[[Column], Column], template: str = "{}") -> DataFrame:
    """``fn`` of every column that passes ``test``."""
    return df.withColumns({template.format(f.name): fn(F.col(f.name)) for f in df.schema.fields if test(f)})


def is_numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


def interactions(df: DataFrame, by: str, levels: list, value: str, template: str = "{value}_{level}") -> DataFrame:
    """One column for each level: the value there and 0 elsewhere."""
    return df.withColumns({template.format(value=value, level=v): F.when(F.col(by) == v, F.col(value)).otherwise(F.lit(0)) for v in levels})


def in_range(c: Column, low, high) -> Column:
    return F.coalesce(c.between(low, high), F.lit(False))


def is_member(c: Column, values: list) -> Column:
    """Membership that is false, not NULL, for NULL."""
    return F.coalesce(c.isin(*values), F.lit(False))


def first_match(c: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The label of the first rule (pattern, label) whose pattern is in a text."""
    out = None
    for pattern, label in rules:
        test = c.rlike(pattern)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out if otherwise is None else out.otherwise(otherwise)


def rule_audit(df: DataFrame, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_no, label, n_first, n_any): rows that each rule decides, and rows that its pattern is in at all."""
    rows = []
    seen = F.lit(False)
    for i, (pattern, label) in enumerate(rules):
        hit = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
        rows.append(F.struct(F.lit(i + 1).alias("rule_no"), F.lit(label).alias("label"), F.count_if(hit & ~seen).alias("n_first"), F.count_if(hit).alias("n_any")))
        seen = seen | hit
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def exact_role(c: Column, roles: list[str]) -> Column:
    """Whether a role, once normalized, is one of ``roles`` as a whole; mixed roles and NULL are not."""
    return is_member(label_key(c), roles)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    return df.where(reduce(lambda a, b: a & b, [finite(F.col(c)) for c in columns]))


def informative_groups(df: DataFrame, group: list[str], flag: str) -> DataFrame:
    """Rows of the groups that have both a 1 and a 0."""
    g = df.groupBy(*group).agg(F.max(flag).alias("__hi"), F.min(flag).alias("__lo")).where("__hi = 1 and __lo = 0").select(*group)
    return df.join(g, group, "left_semi")


def frequent(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Rows whose key more than so many rows have."""
    k = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > more_than).select(key)
    return df.join(k, key, "left_semi")


def rare_entities(df: DataFrame, entity: str, date: str, evidence: str, days: int) -> DataFrame:
    """(entity, n_days, n_rows, evidence) of the entities seen on so many days at most."""
    g = df.groupBy(entity).agg(F.count_distinct(date).alias("n_days"), F.count("*").alias("n_rows"), F.min(evidence).alias("evidence"))
    return g.where((F.col("n_days") <= days) & F.col(entity).isNotNull())


def usable_rows(df: DataFrame, text: str, date: str, error: str, min_chars: int) -> DataFrame:
    """Rows with a date, a text of so many characters and no error."""
    ok = F.col(date).isNotNull() & (F.length(F.trim(F.coalesce(text, F.lit("")))) >= min_chars) & (F.coalesce(F.trim(error), F.lit("")) == "")
    return df.where(ok)


def prune_to_support(df: DataFrame, rules: list[tuple[list[str], int]], max_rounds: int = 100) -> DataFrame:
    """Rows whose group has the least number of rows, for all rules (keys, rows) at once: repeated until none falls out.

    Each round reads one small aggregate per rule; lineage is cut by a reliable checkpoint.
    """
    now, n = cut(df), None
    for _ in range(max_rounds):
        m = now.count()
        if m == n:
            return now
        n = m
        for keys, least in rules:
            ok = now.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*keys)
            now = now.join(ok, keys, "left_semi").select(*df.columns)
        now = cut(now)
    raise RuntimeError("support did not settle")


def admissible_url(c: Column, hosts: list[str] | None, path: str | None, refuse: str | None) -> Column:
    """Whether a URL has one of the hosts (or a part of it), a path that matches, and nothing that is refused."""
    host = F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://(?:www\.)?([^/:?#]+)", 1))
    ok = host != ""
    if hosts:
        ok = ok & reduce(lambda a, b: a | b, [(host == h) | host.endswith("." + h) for h in hosts])
    rest = F.regexp_replace(c, r"^[a-zA-Z]+://[^/]+", "")
    if path:
        ok = ok & rest.rlike(path)
    if refuse:
        ok = ok & ~rest.rlike(refuse)
    return F.coalesce(ok, F.lit(False))


def apply_aliases(df: DataFrame, column: str, aliases: DataFrame, alias: str, canonical: str, out: str) -> DataFrame:
    """``out``: the canonical name of a reviewed alias with the same normal form, else the value as it is."""
    a = aliases.where(F.col(canonical).isNotNull()).select(label_key(F.col(alias)).alias("__k"), F.col(canonical).alias("__c")).dropna()
    # An alias that stands for several names decides nothing.
    a = a.groupBy("__k").agg(F.when(F.count_distinct("__c") == 1, F.max("__c")).alias("__c")).dropna()
    return df.withColumn("__k", label_key(F.col(column))).join(broadcast_if_small(a), "__k", "left").withColumn(out, F.coalesce("__c", column)).drop("__k", "__c")


def rank_rule(df: DataFrame, keys: list[str], rule_no: Column) -> DataFrame:
    """The rows of the first rule that decides each key."""
    return df.withColumn("__r", rule_no).withColumn("__m", F.min("__r").over(Window.partitionBy(*keys))).where("__r = __m").drop("__r", "__m")
