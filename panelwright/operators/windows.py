"""Operators over ordered rows. Every order is stated with a tiebreak by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.ordering import numbered


def _w(group: list[str], order: list) -> object:
    return Window.partitionBy(*group).orderBy(*order)


def number_rows(df: DataFrame, group: list[str], order: list, out: str = "row_no") -> DataFrame:
    return df.withColumn(out, F.row_number().over(_w(group, order)))


def lag_any(df: DataFrame, group: list[str], order: list, flag: str, k: int, out: str) -> DataFrame:
    """``out``: 1 if the flag was 1 in any of the ``k`` rows before; 0 before the first row."""
    return df.withColumn(out, F.coalesce(F.max(flag).over(_w(group, order).rowsBetween(-k, -1)), F.lit(0)))


def difference(df: DataFrame, group: list[str], order: list, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(_w(group, order)))


def days_since_event(df: DataFrame, group: list[str], date: str, flag: Column, out: str) -> DataFrame:
    """Days since the last earlier date with the event; NULL before any."""
    w = _w(group, [date]).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.datediff(F.col(date), F.last(F.when(flag, F.col(date)), True).over(w)))


def trailing_mean(df: DataFrame, group: list[str], order: list, value: str, k: int, out: str) -> DataFrame:
    """Mean of a row and the ``k - 1`` before it, of fewer at the start."""
    return df.withColumn(out, F.avg(value).over(_w(group, order).rowsBetween(1 - k, 0)))


def centered_mean(df: DataFrame, group: list[str], order: list, value: str, before: int, after: int, out: str) -> DataFrame:
    """Mean over a window around a row; NULL where it is not full."""
    w = _w(group, order).rowsBetween(-before, after)
    return df.withColumn(out, F.when(F.count(value).over(w) == before + after + 1, F.avg(value).over(w)))


def spell_status(df: DataFrame, group: list[str], order: list, event: str, unknown: str, width: int, out: str = "in_spell") -> DataFrame:
    """1 if an event is among a row and the ``width - 1`` before it, else NULL if an unknown is, else 0."""
    w = _w(group, order).rowsBetween(1 - width, 0)
    hit, dim = F.max(event).over(w), F.max(unknown).over(w)
    return df.withColumn(out, F.when(hit == 1, 1).when(dim == 1, F.lit(None).cast("int")).otherwise(0))


def runs(df: DataFrame, group: list[str], order: list, label: str, out: str = "run_no") -> DataFrame:
    """Number of the run of equal labels (NULL equals NULL) that a row is in, from 1."""
    w = _w(group, order)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def event_labels(df: DataFrame, group: list[str], order: list, state: str, k: int = 5) -> DataFrame:
    """``onset`` and ``exit``: steps from a change of a 0/1 state, -k..-1 before it and 1..k from it on.

    An onset is a run of 1 right behind a run of 0, an exit the reverse; a NULL between them makes none. Steps
    stop at the ends of the two runs.
    """
    d = runs(df, group, order, state, "__run")
    per = [*group, "__run"]
    pos = F.row_number().over(_w(per, order))
    size = F.count("*").over(Window.partitionBy(*per))
    d = d.withColumn("__pos", pos).withColumn("__left", size - pos + 1)
    s = d.groupBy(*per).agg(F.max(state).alias("__s"))
    w = _w(group, ["__run"])
    s = s.withColumn("__before", F.lag("__s").over(w)).withColumn("__after", F.lead("__s").over(w)).drop("__s")
    d = d.join(s, per)
    st = F.col(state)
    up = lambda lo, hi: (
        F.when((st == hi) & (F.col("__before") == lo) & (F.col("__pos") <= k), F.col("__pos")).when((st == lo) & (F.col("__after") == hi) & (F.col("__left") <= k), -F.col("__left"))
    )
    return d.withColumns({"onset": up(0, 1), "exit": up(1, 0)}).drop("__run", "__pos", "__left", "__before", "__after")


def carry_forward(df: DataFrame, group: list[str], order: list, value: Column, out: str) -> DataFrame:
    """The last value up to a row that is not NULL; NULL before the first."""
    return df.withColumn(out, F.last(value, True).over(_w(group, order).rowsBetween(Window.unboundedPreceding, 0)))


def interpolate(df: DataFrame, group: list[str], date: str, value: str, out: str, digits: int | None = None) -> DataFrame:
    """``out``: known values, and linear ones between two known ones; ``gap_days`` between these. NULL outside."""
    from panelwright.operators.joins import nearest_anchors

    d = nearest_anchors(df, group, date, value)
    gap = F.datediff("next_at", "prev_at")
    line = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * F.datediff(F.col(date), F.col("prev_at")) / gap
    line = F.round(line, digits) if digits is not None else line
    known = F.col(value).isNotNull()
    return d.withColumn(out, F.coalesce(value, line)).withColumn("gap_days", F.when(~known & F.col("prev_at").isNotNull() & F.col("next_at").isNotNull(), gap)).drop("prev_value", "prev_at", "next_value", "next_at")


def isolated_outliers(df: DataFrame, group: list[str], date: str, value: str, jump: float, reach_days: int = 4, out: str = "outlier") -> DataFrame:
    """Whether a value lies ``jump`` or more off both neighbours, on the same side, both within ``reach_days``."""
    w = _w(group, [date])
    a, b = F.col(value) - F.lag(value).over(w), F.col(value) - F.lead(value).over(w)
    near = (F.datediff(F.col(date), F.lag(date).over(w)) <= reach_days) & (F.datediff(F.lead(date).over(w), F.col(date)) <= reach_days)
    return df.withColumn(out, F.coalesce(near & (F.abs(a) >= jump) & (F.abs(b) >= jump) & (F.signum(a) == F.signum(b)), F.lit(False)))


def best_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a full order; Spark keeps one row a key and partition before the shuffle."""
    return df.withColumn("__r", F.row_number().over(_w(keys, order))).where("__r = 1").drop("__r")


def first_and_rest(df: DataFrame, keys: list[str], order: list, out: str = "is_first") -> DataFrame:
    return df.withColumn(out, F.row_number().over(_w(keys, order)) == 1)


def time_index(df: DataFrame, group: list[str], date: str, out: str = "t") -> DataFrame:
    """Rank of a date among the distinct dates of its group."""
    return df.withColumn(out, F.dense_rank().over(_w(group, [date])))


def day_index(date: Column, origin: str) -> Column:
    """Days from ``origin``, 1 on it: unlike ``time_index`` it counts days without rows."""
    return F.datediff(date, F.to_date(F.lit(origin))) + 1


def center(df: DataFrame, group: list[str], columns: list[str], suffix: str = "_c") -> DataFrame:
    """Columns less their group means."""
    w = Window.partitionBy(*group)
    return df.withColumns({c + suffix: F.col(c) - F.avg(c).over(w) for c in columns})


def next_where(df: DataFrame, group: list[str], order: list, condition: Column, value: str, out: str) -> DataFrame:
    """``value`` of the next row that meets a condition."""
    w = _w(group, order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.first(F.when(condition, F.col(value)), True).over(w))


def evenly_spaced(df: DataFrame, order: str, k: int) -> DataFrame:
    """``k`` rows at even distances in an order, the first and last among them; all rows if there are no more.

    Places are rounded half to even. Rows are numbered within and then across ranges of the order, so that no
    task holds them all.
    """
    ranked = numbered(df, [order], "__rank")
    n = df.count()
    if n <= k:
        return df
    places = sorted({round(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)})
    return ranked.where(F.col("__rank").isin(*[p + 1 for p in places])).drop("__rank")


def first_date_eligibility(df: DataFrame, unit: str, date: str, active: Column, out: str = "eligible") -> DataFrame:
    """Whether a date is not before the unit's first active one; false if it has none."""
    first = F.min(F.when(active, F.col(date))).over(Window.partitionBy(unit))
    return df.withColumn(out, F.coalesce(F.col(date) >= first, F.lit(False)))
