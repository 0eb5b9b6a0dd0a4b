"""Transforms of numbers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def finite(c: Column) -> Column:
    """Whether a number is neither NULL nor NaN nor infinite; never NULL."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def ratio_or_null(a: Column, b: Column) -> Column:
    """``a / b``; NULL unless ``b`` is above 0."""
    return F.when(b > 0, a / b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """``a / b``; 0 where ``b`` is 0, NULL where it is missing."""
    return F.when(b > 0, a / b).when(b.isNotNull(), F.lit(0.0))


def log_floor(y: Column, at_zero: float = -4.0) -> Column:
    """Natural logarithm; ``at_zero`` at and below 0."""
    return F.when(y > 0, F.ln(y)).when(y.isNotNull(), F.lit(at_zero))


def log1p_or_null(x: Column) -> Column:
    """log(1 + x); NULL below 0."""
    return F.when(x >= 0, F.log1p(x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of the mean radius of the earth."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def winsorize(df: DataFrame, columns: list[str], upper: float = 0.99, lower: float | None = None, suffix: str = "_w") -> DataFrame:
    """Each column cut at its pooled quantiles (type 7); NULL stays."""
    from panelwright.operators.ordering import exact_quantiles

    bounds = None
    for c in columns:
        q = exact_quantiles(df, c, {f"__hi_{c}": upper} | ({f"__lo_{c}": lower} if lower is not None else {}))
        bounds = q if bounds is None else bounds.join(F.broadcast(q))  # one row each
    out = df.join(F.broadcast(bounds))  # one row
    for c in columns:
        v = F.least(F.col(c), F.col(f"__hi_{c}"))
        v = F.greatest(v, F.col(f"__lo_{c}")) if lower is not None else v
        out = out.withColumn(c + suffix, F.when(F.col(c).isNotNull(), v))
    return out.drop(*[x for x in out.columns if x.startswith(("__hi_", "__lo_"))])


def zero_safe_log(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: logarithm of a column, that of the pooled smallest positive value at and below 0."""
    low = df.agg(F.min(F.when(F.col(column) > 0, F.col(column))).alias("__low"))
    y = F.col(column)
    return df.join(F.broadcast(low)).withColumn(out, F.when(y > 0, F.ln(y)).when(y.isNotNull(), F.ln("__low"))).drop("__low")  # one row


def standardize(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: a column less its mean, over its sample standard deviation; NULL if that is 0."""
    m = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return df.join(F.broadcast(m)).withColumn(out, F.try_divide(F.col(column) - F.col("__m"), F.col("__s"))).drop("__m", "__s")  # one row


def anchored_index(raw: Column, anchor_in_batch: Column, anchor_alone: Column) -> Column:
    """A value of a batch on the scale of its anchor's own series; NULL where the anchor is 0 in the batch."""
    return F.when(anchor_in_batch > 0, raw / anchor_in_batch * anchor_alone)
