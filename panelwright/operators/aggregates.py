"""Aggregates named by what they do with missing values, and summaries built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.ordering import cumulative_counts, exact_quantiles
from panelwright.session import broadcast_if_small


def sum_or_zero(c: Column) -> Column:
    """Sum of what is there; 0 of nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def sum_or_null(c: Column) -> Column:
    """Sum of what is there; NULL of nothing."""
    return F.sum(c)


def max_or_null(c: Column) -> Column:
    return F.max(c)


def sum_if_complete(c: Column, expected: int | Column) -> Column:
    """Sum only if ``expected`` rows are there and all have a value, else NULL."""
    return F.when(F.count(c) == expected, F.sum(c))


def distinct_with_null(c: Column) -> Column:
    """Distinct values, NULL counted as one."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def distinct_where(c: Column, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, c))


def collapse_unique(c: Column, sep: str = " | ") -> Column:
    """Distinct values in order, joined; NULL if there are none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c)), sep), F.lit(""))


def first_seen_unique(c: Column, order: Column, sep: str = ";") -> Column:
    """Distinct values in the order in which they came, joined; ``order`` must tell all rows apart."""
    pairs = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("v")))))
    return F.nullif(F.array_join(F.array_distinct(F.transform(pairs, lambda x: x["v"])), sep), F.lit(""))


def consensus(c: Column) -> Column:
    """The one distinct value; NULL if there is none or more."""
    return F.when(F.count_distinct(c) == 1, F.max(c))


def category_or_conflict(c: Column, informative: Column, conflict: str = "conflict", none: str = "unknown") -> Column:
    """The one informative value; ``conflict`` if there are several, ``none`` if there is none."""
    v = F.when(informative, c)
    return F.when(F.count_distinct(v) == 1, F.max(v)).when(F.count_distinct(v) > 1, F.lit(conflict)).otherwise(F.lit(none))


def any_flag(c: Column) -> Column:
    """1 if any is 1; a missing flag counts as 0."""
    return F.coalesce(F.max(c), F.lit(0))


def two_level(df: DataFrame, entity: list[str], group: list[str], value: str, eligible: Column) -> DataFrame:
    """Per group: entities eligible and active (value above 0), their sum, and the means over either."""
    per = df.groupBy(*group, *entity).agg(sum_or_zero(F.col(value)).alias("v"), F.bool_or(F.coalesce(eligible, F.lit(False))).alias("e"))
    g = per.groupBy(*group).agg(F.count_if("e").alias("n_eligible"), F.count_if(F.col("v") > 0).alias("n_active"), F.sum("v").alias("total"))
    return g.withColumns({"per_eligible": F.try_divide("total", "n_eligible"), "per_active": F.try_divide("total", "n_active")})


def share_within(df: DataFrame, group: list[str], value: str, out: str = "share") -> DataFrame:
    """``df`` with each row's share in the total of its group; NULL where that is 0."""
    return df.withColumn(out, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*group))))


def fan_out_weighted(facts: DataFrame, crosswalk: DataFrame, key: str, target: str, value: str) -> DataFrame:
    """Sums per target of facts divided among all targets of their key, so that totals are kept."""
    c = crosswalk.select(key, target).distinct()
    n = c.groupBy(key).agg(F.count("*").alias("__n"))
    return facts.join(c.join(n, key), key).groupBy(target).agg(F.sum(F.col(value) / F.col("__n")).alias(value))


def with_total(df: DataFrame, group: str, aggs: list[Column], total: str = "All") -> DataFrame:
    """Aggregates by group and over all rows, by grouping sets in one pass; a NULL group keeps its own row."""
    g = df.rollup(group).agg(*aggs, F.grouping(group).alias("__all"))
    return g.withColumn(group, F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(group).cast("string"))).drop("__all")


def quantiles(df: DataFrame, value: str, probs: list[float], group: list[str] | None = None) -> DataFrame:
    """Exact quantiles (type 7), one column for each, named by per mille or per cent; no task holds a group."""
    return exact_quantiles(df, value, {f"p{p * 100:g}".replace(".", "_"): p for p in probs}, group)


def histogram(df: DataFrame, value: str, breaks: list[float]) -> DataFrame:
    """(bin_no, low, high, n) of right-closed bins, the first closed on both sides; empty bins stay, values outside don't."""
    bins = [F.struct(F.lit(i + 1).alias("bin_no"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for i, (a, b) in enumerate(zip(breaks, breaks[1:], strict=False))]
    no = None
    for i, (a, b) in enumerate(zip(breaks, breaks[1:], strict=False)):
        test = (F.col(value) > a) & (F.col(value) <= b) if i else F.col(value).between(a, b)
        no = F.when(test, i + 1) if no is None else no.when(test, i + 1)
    counts = df.select(no.alias("bin_no")).where("bin_no is not null").groupBy("bin_no").agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1).select(F.inline(F.array(*bins)))
    return grid.join(F.broadcast(counts), "bin_no", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # as many rows as bins


def quantile_classes(df: DataFrame, value: str, k: int, out: str = "klass") -> DataFrame:
    """``df`` with the class 1..k of a value between the quantiles of equal shares; NULL stays."""
    q = exact_quantiles(df, value, {f"q{i}": i / k for i in range(1, k)})
    cuts = q.select(F.array(*[f"q{i}" for i in range(1, k)]).alias("__cuts"))
    n = F.size(F.filter("__cuts", lambda x: F.col(value) > x)) + 1
    return df.join(F.broadcast(cuts)).withColumn(out, F.when(F.col(value).isNotNull(), n)).drop("__cuts")  # one row


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` by the stated values of ``columns``, 0 where there are none."""
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0, values)


def chi_square(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """(chi2, dof) of two categories without missing values."""
    cell = df.dropna(subset=[rows, columns]).groupBy(rows, columns).agg(F.count("*").alias("n"))
    r = cell.groupBy(rows).agg(F.sum("n").alias("nr"))
    c = cell.groupBy(columns).agg(F.sum("n").alias("nc"))
    # Cells without rows add their expected count: sum of n^2 / expected over the filled cells, less the total.
    joined = cell.join(r, rows).join(c, columns)
    t = joined.agg(F.sum(F.col("n") * F.col("n") / (F.col("nr") * F.col("nc"))).alias("s"), F.sum("n").alias("n"), F.count_distinct(rows).alias("a"), F.count_distinct(columns).alias("b"))
    return t.select((F.col("n") * (F.col("s") - 1)).alias("chi2"), ((F.col("a") - 1) * (F.col("b") - 1)).alias("dof"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) of all pairs of columns, from one aggregate."""
    rows = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(a, b).alias("r")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def text_summary(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows of each group and the first and last non-blank text of each column; NULL groups are kept."""
    aggs = [F.count("*").alias("n_rows")]
    for c in columns:
        v = F.nullif(F.trim(c), F.lit(""))
        aggs += [F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    return df.groupBy(*group).agg(*aggs)


def sample_flow(stages: dict[str, DataFrame], unit: str, date: str, treated: Column) -> DataFrame:
    """(stage, n_rows, n_units, n_dates, n_treated) of named samples."""
    out = None
    for k, df in stages.items():
        row = df.agg(F.count("*").alias("n_rows"), F.count_distinct(unit).alias("n_units"), F.count_distinct(date).alias("n_dates"), F.count_if(treated).alias("n_treated"))
        row = row.select(F.lit(k).alias("stage"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def ratio_of_sums(a: Column, b: Column, covered: Column) -> Column:
    """Sum of ``a`` over sum of ``b`` on rows where both are covered; NULL if the latter is not above 0."""
    x, y = F.sum(F.when(covered, a)), F.sum(F.when(covered, b))
    return F.when(y > 0, x / y)


def top_share(df: DataFrame, value: str, tiebreak: str, k: int = 10) -> DataFrame:
    """(top_sum, total, share) of the ``k`` largest values."""
    top = df.orderBy(F.col(value).desc_nulls_last(), F.col(tiebreak)).limit(k).agg(F.sum(value).alias("top_sum"))
    total = df.agg(F.sum(value).alias("total"))
    return top.join(F.broadcast(total)).withColumn("share", F.try_divide("top_sum", "total"))  # one row each


def iso_week_mean(df: DataFrame, date: str, value: str) -> DataFrame:
    """(iso_year, iso_week, mean_value, last_value) of a daily series."""
    y, w = F.extract(F.lit("YEAROFWEEK"), F.col(date)), F.extract(F.lit("WEEK"), F.col(date))
    return df.groupBy(y.cast("int").alias("iso_year"), w.cast("int").alias("iso_week")).agg(F.avg(value).alias("mean_value"), F.max_by(value, date).alias("last_value"))


def gini(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, gini, cv, total): Gini by ranks, coefficient of variation; NULL for a zero sum. NULL values don't count."""
    c = cumulative_counts(df, group, value)
    # Equal values share the ranks upto - c + 1 .. upto, whatever their order.
    v, k, up = F.col(value).cast("double"), F.col("c"), F.col("upto")
    ranks = k * (up - k) + k * (k + 1) / 2
    g = c.groupBy(*group).agg(F.sum("c").alias("n"), F.sum(v * k).alias("total"), F.sum(ranks * v).alias("__rs"))
    spread = df.groupBy(*group).agg(F.stddev_samp(value).alias("__sd"), F.avg(value).alias("__m"))
    same = F.lit(True)
    for x in group:
        same = same & F.col(f"g.{x}").eqNullSafe(F.col(f"s.{x}"))
    g = g.alias("g").join(broadcast_if_small(spread.alias("s")), same).select("g.*", "__sd", "__m")
    n = F.col("n")
    return g.select(*group, "n", F.when(F.col("total") > 0, 2 * F.col("__rs") / (n * F.col("total")) - (n + 1) / n).alias("gini"), F.try_divide("__sd", "__m").alias("cv"), "total")


def balanced_cohort(df: DataFrame, unit: str, period: str, min_periods: int | None = None) -> DataFrame:
    """Rows of the units that are there in every period (or in ``min_periods`` of them at least)."""
    need = F.lit(min_periods) if min_periods is not None else F.col("__all")
    total = df.agg(F.count_distinct(period).alias("__all"))
    keep = df.groupBy(unit).agg(F.count_distinct(period).alias("__n")).join(F.broadcast(total)).where(F.col("__n") >= need).select(unit)  # one row
    return df.join(keep, unit, "left_semi")
