"""Regressions with fixed effects from sums that Spark gathers; the driver solves systems as small as their terms.

Rows never leave the executors: effects are taken out by group means, normal equations and cluster scores are
aggregates, and only matrices of the number of terms come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.numbers import finite
from panelwright.operators.ordering import numbered, running
from panelwright.operators.windows import event_labels
from panelwright.session import broadcast_if_small, cut, forget

SWEEPS, TOLERANCE = 200, 1e-9


def drop_singletons(df: DataFrame, effects: list[str], max_rounds: int = 50) -> DataFrame:
    """Rows of effects that have more than one row each, repeated until none falls out."""
    now, n = cut(df), None
    for _ in range(max_rounds):
        m = now.count()
        if m == n:
            return now
        n = m
        for e in effects:
            now = now.join(now.groupBy(e).agg(F.count("*").alias("__n")).where("__n > 1").select(e), e, "left_semi")
        now = cut(now)
    raise RuntimeError("singletons did not settle")


def level_effects(d: DataFrame, columns: list[str], effects: list[str], weight: str | None = None, spread: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """For each of several effects a table (level, one mean a column) that together make up the columns' additive part.

    Rows stay where they are: each step aggregates what the other effects leave over, partially before the shuffle,
    and joins tables of levels, which are broadcast while they are small. It is an error if they do not settle.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    spread = spread or {c: 1.0 for c in columns}
    tables = {e: cut(d.groupBy(e).agg(*[F.lit(0.0).alias(f"__{i}_{k}") for k in range(len(columns))])) for i, e in enumerate(effects)}
    for _ in range(SWEEPS):
        moved = 0.0
        for i, e in enumerate(effects):
            j = d
            for o in effects:
                if o != e:
                    j = j.join(broadcast_if_small(tables[o]), o)
            left = [F.col(c) - sum((F.col(f"__{n}_{k}") for n, o in enumerate(effects) if o != e), F.lit(0.0)) for k, c in enumerate(columns)]
            new = cut(j.groupBy(e).agg(*[(F.sum(x * w) / F.sum(w)).alias(f"__{i}_{k}") for k, x in enumerate(left)]))
            old = tables[e].select(F.col(e).alias("__e"), *[F.col(f"__{i}_{k}").alias(f"__o_{k}") for k in range(len(columns))])
            change = new.join(broadcast_if_small(old), F.col(e) == F.col("__e")).agg(*[F.max(F.abs(F.col(f"__{i}_{k}") - F.col(f"__o_{k}"))) for k in range(len(columns))]).first()
            forget(tables[e])
            tables[e] = new
            moved = max([moved, *[(x or 0.0) / max(spread[c] or 0.0, 1e-300) for x, c in zip(change, columns, strict=True) if spread[c]]])
        if moved <= TOLERANCE:
            return tables
    raise RuntimeError(f"effects did not settle in {SWEEPS} sweeps")


def demean(df: DataFrame, columns: list[str], effects: list[str], weight: str | None = None) -> DataFrame:
    """Columns less the means of all effects: exact for one, by alternating means of levels for several."""
    w = F.col(weight) if weight else F.lit(1.0)
    if len(effects) == 1:
        e = effects[0]
        means = df.groupBy(F.col(e).alias("__e")).agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(f"__m{k}") for k, c in enumerate(columns)])
        out = df.join(broadcast_if_small(cut(means)), F.col(e).eqNullSafe(F.col("__e")))
        return out.select(*[(F.col(c) - F.col(f"__m{columns.index(c)}")).alias(c) if c in columns else F.col(c) for c in df.columns])
    d = cut(df)
    spread = d.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first().asDict()
    out = d
    for t in (tables := level_effects(d, columns, effects, weight, spread)).items():
        out = out.join(broadcast_if_small(t[1]), t[0])
    part = lambda k: sum((F.col(f"__{i}_{k}") for i in range(len(tables))), F.lit(0.0))
    return out.select(*[(F.col(c) - part(columns.index(c))).alias(c) if c in columns else F.col(c) for c in df.columns])


def moments(df: DataFrame, xs: list[str], y: str | None = None) -> tuple[np.ndarray, np.ndarray | None, int, float]:
    """(X'X, X'y, rows, y'y) in one aggregate."""
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if j >= i]
    if y:
        aggs += [F.sum(F.col(a) * F.col(y)).alias(f"v{i}") for i, a in enumerate(xs)] + [F.sum(F.col(y) * F.col(y)).alias("yy")]
    r = df.agg(F.count("*").alias("n"), *aggs).first()
    g = np.zeros((len(xs), len(xs)))
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            g[i, j] = g[j, i] = r[f"m{i}_{j}"] or 0.0
    return g, (np.array([r[f"v{i}"] or 0.0 for i in range(len(xs))]) if y else None), r["n"], (r["yy"] or 0.0 if y else 0.0)


def independent_columns(gram: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns kept by pivot-free Cholesky: each that is not a combination of those before it."""
    kept: list[int] = []
    for j in range(len(gram)):
        if gram[j, j] <= 0:
            continue
        rest = gram[j, j]
        if kept:
            k = np.ix_(kept, kept)
            rest -= gram[kept, j] @ np.linalg.solve(gram[k], gram[kept, j])
        if rest > tolerance * gram[j, j]:
            kept.append(j)
    return kept


@dataclass
class Fit:
    """Estimates of a regression: names, coefficients, variance, rows, clusters, degrees of freedom, dropped names."""

    names: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    n: int
    clusters: int
    dof: int
    dropped: list[str]

    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov))

    def p_values(self) -> np.ndarray:
        return np.array([2 * t_tail(abs(b / s), self.dof) if s > 0 else math.nan for b, s in zip(self.beta, self.se(), strict=True)])

    def contrast(self, weights: dict[str, float]) -> tuple[float, float]:
        w = np.array([weights.get(n, 0.0) for n in self.names])
        return float(w @ self.beta), float(np.sqrt(w @ self.vcov @ w))

    def wald(self, names: list[str]) -> tuple[float, int, float]:
        """(F, restrictions, p) that all named coefficients are 0."""
        return self.restrict(np.eye(len(self.names))[[self.names.index(n) for n in names]])

    def equal(self, names: list[str]) -> tuple[float, int, float]:
        """(F, restrictions, p) that all named coefficients are the same."""
        k = [self.names.index(n) for n in names]
        r = np.zeros((len(k) - 1, len(self.names)))
        r[:, k[0]] = 1.0
        r[np.arange(len(k) - 1), k[1:]] = -1.0
        return self.restrict(r)

    def restrict(self, r: np.ndarray) -> tuple[float, int, float]:
        """(F, restrictions, p) that ``r`` times the coefficients is 0."""
        b, v = r @ self.beta, r @ self.vcov @ r.T
        f = float(b @ np.linalg.pinv(v) @ b) / len(r)
        return f, len(r), f_tail(f, len(r), self.dof)


def _meat(df: DataFrame, xs: list[str], cluster: list[str]) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer products of their scores; the scores stay on the executors."""
    s = df.groupBy(*cluster).agg(*[F.sum(F.col(x) * F.col("__e")).alias(f"s{i}") for i, x in enumerate(xs)])
    g, _, n, _ = moments(s, [f"s{i}" for i in range(len(xs))])
    return g, n


def fixed_effects(df: DataFrame, y: str, xs: list[str], effects: list[str], cluster: list[str], nested: bool = True, weight: str | None = None) -> Fit:
    """Least squares of ``y`` on ``xs`` within ``effects``, with variance clustered on one or two columns.

    Rows with a missing or infinite value and singletons of effects are left out, as are collinear terms. One-way:
    factor G / (G - 1) * (n - 1) / (n - k), where k counts the terms, and the effects not nested in the clusters;
    t with G - 1 degrees. Two-way: V1 + V2 - V12 with the smaller number of clusters. ``weight`` weighs rows.
    """
    ok = finite(F.col(y).cast("double"))
    for x in xs:
        ok = ok & finite(F.col(x).cast("double"))
    keep = list(dict.fromkeys([y, *xs, *effects, *cluster, *([weight] if weight else [])]))
    d = df.select(*keep).where(ok if weight is None else ok & (F.col(weight) > 0)).dropna(subset=[*effects, *cluster]).withColumns({c: F.col(c).cast("double") for c in [y, *xs]})
    d = drop_singletons(d, effects) if effects else cut(d)
    if not effects:
        d = d.withColumn("(const)", F.lit(1.0))
        xs = ["(const)", *xs]
    ids = {c: f"__id_{i}" for i, c in enumerate(cluster)}
    m = d.withColumns({i: F.col(c) for c, i in ids.items()})
    m = cut(demean(m, [y, *[x for x in xs if x != "(const)"]], effects, weight)) if effects else m
    if weight:
        root = F.sqrt(F.col(weight).cast("double"))
        m = m.withColumns({c: F.col(c) * root for c in [y, *xs]})
    g, v, n, _ = moments(m, xs, y)
    kept = independent_columns(g)
    names = [xs[i] for i in kept]
    inv = np.linalg.inv(g[np.ix_(kept, kept)])
    beta = inv @ v[kept]
    e = F.col(y)
    for name, b in zip(names, beta, strict=True):
        e = e - F.col(name) * F.lit(float(b))
    m = cut(m.withColumn("__e", e))
    levels = [d.select(c).distinct().count() for c in effects]
    k = len(names) + sum(n_l - (1 if i else 0) for i, (c, n_l) in enumerate(zip(effects, levels, strict=True)) if not (nested and c in cluster))

    def one(cols: list[str]) -> tuple[np.ndarray, int]:
        meat, groups = _meat(m, names, [ids[c] for c in cols])
        factor = groups / (groups - 1) * (n - 1) / max(n - k, 1) if groups > 1 else math.nan
        return factor * inv @ meat @ inv, groups

    if len(cluster) == 1:
        vcov, groups = one(cluster)
    else:
        (v1, g1), (v2, g2), (v12, _) = one(cluster[:1]), one(cluster[1:2]), one(cluster[:2])
        vcov, groups = v1 + v2 - v12, min(g1, g2)
    return Fit(names, beta, vcov, n, groups, max(groups - 1, 1), [x for i, x in enumerate(xs) if i not in kept])


def interacted(df: DataFrame, y: str, x: str, group: str, levels: list[str], effects: list[str], cluster: list[str]) -> Fit:
    """Slopes of ``x`` by group, the groups' effects apart from each other: terms ``x:level``."""
    d = df.withColumns({f"{x}:{v}": F.when(F.col(group) == v, F.col(x)).otherwise(F.lit(0.0)) for v in levels})
    d = d.withColumns({f"{e}*{group}": F.concat_ws("|", F.col(e).cast("string"), F.col(group)) for e in effects})
    return fixed_effects(d.where(F.col(group).isin(*levels)), y, [f"{x}:{v}" for v in levels], [f"{e}*{group}" for e in effects], cluster)


def pairwise(fit: Fit, names: list[str]) -> list[tuple[str, str, float, float, float]]:
    """(a, b, difference, se, p) of each two of the named coefficients."""
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d, se = fit.contrast({a: 1.0, b: -1.0})
            out.append((a, b, d, se, 2 * t_tail(abs(d / se), fit.dof) if se > 0 else math.nan))
    return out


def fit_effects(df: DataFrame, y: str, unit: str, date: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((unit, a), (date, b)): effects of a two-way model by alternating group means; raises if they do not settle."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = cut(df.select(unit, date, F.col(y).cast("double").alias("__y"), w.alias("__w")).dropna().where("__w > 0"))
    spread = {"__y": d.agg(F.stddev_samp("__y")).first()[0] or 1.0}
    t = level_effects(d, ["__y"], [unit, date], "__w", spread)
    return t[unit].withColumnRenamed("__0_0", "a"), t[date].withColumnRenamed("__1_0", "b")


def imputation_effects(df: DataFrame, y: str, treated: Column, unit: str, date: str, controls: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Treated rows with ``effect``: outcome less what untreated rows predict; NULL without both effects or a control.

    The model of the untreated rows has unit and date effects and, with ``controls``, their slopes; ``weight`` weighs rows.
    """
    d = df.withColumn("__t", F.coalesce(treated, F.lit(False))).withColumn("__y", F.col(y).cast("double"))
    if controls:
        fit = fixed_effects(d.where(~F.col("__t")), "__y", controls, [unit, date], [unit], weight=weight)
        for name, k in zip(fit.names, fit.beta, strict=True):
            d = d.withColumn("__y", F.col("__y") - F.col(name).cast("double") * F.lit(float(k)))
    units, dates = fit_effects(d.where(~F.col("__t")), "__y", unit, date, weight)
    t = d.where("__t").join(broadcast_if_small(units), unit, "left").join(broadcast_if_small(dates), date, "left")
    return t.withColumn("effect", F.col("__y") - F.col("a") - F.col("b")).drop("a", "b", "__t", "__y")


def att(df: DataFrame, y: str, treated: Column, unit: str, date: str, by: str | None = None, controls: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, n, att): mean effect of treated rows, by event label if one is named; weighed if ``weight`` is."""
    e = imputation_effects(df, y, treated, unit, date, controls, weight).where("effect is not null")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return e.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), (F.sum(F.col("effect") * w) / F.sum(w)).alias("att"))


def event_horizons(df: DataFrame, y: str, state: str, unit: str, date: str, k: int, controls: list[str] | None = None) -> DataFrame:
    """(side, horizon, n, att): mean effects at 1..k steps from an onset on and 1..k steps after an exit (carryover).

    Rows at these steps, and all others whose state is 1, are left out of the model of the untreated.
    """
    labelled = event_labels(df, [unit], [date], state, k)
    on, off = F.col("onset") > 0, F.col("exit") > 0
    side = F.when(on, F.lit("onset")).when(off, F.lit("exit"))
    d = cut(labelled.withColumn("__side", side).withColumn("__h", F.when(on, F.col("onset")).when(off, F.col("exit"))))
    e = imputation_effects(d, y, (F.col(state) == 1) | F.col("__side").isNotNull(), unit, date, controls)
    e = e.where(F.col("effect").isNotNull() & F.col("__side").isNotNull())
    return e.groupBy(F.col("__side").alias("side"), F.col("__h").alias("horizon")).agg(F.count("*").alias("n"), F.avg("effect").alias("att"))


def standardized_differences(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """(column, mean_1, mean_0, smd): difference of means over the root of the mean of both variances."""
    rows = []
    for c in columns:
        a, b = F.when(F.col(flag) == 1, F.col(c)), F.when(F.col(flag) == 0, F.col(c))
        smd = F.try_divide(F.avg(a) - F.avg(b), F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2))
        rows.append(F.struct(F.lit(c).alias("column"), F.avg(a).alias("mean_1"), F.avg(b).alias("mean_0"), smd.alias("smd")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def missing_patterns(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """(df with missing values 0 and one indicator for each distinct pattern of them, column to indicator)."""
    flags = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    some = [c for c in columns if flags[c]]
    # Two columns are missing together if as many rows miss either as miss both.
    pairs = [(a, b) for i, a in enumerate(some) for b in some[i + 1 :] if flags[a] == flags[b]]
    both = df.agg(*[F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    head = {c: c for c in some}
    for (a, b), n in zip(pairs, both, strict=True):
        if n == flags[a]:
            head[b] = head[a]
    names = {c: f"missing_{head[c]}" for c in some}
    out = df.withColumns({n: F.col(n[8:]).isNull().cast("int") for n in dict.fromkeys(names.values())} | {c: F.coalesce(F.col(c), F.lit(0)) for c in columns})
    return out, names


def holm(df: DataFrame, p: str, tiebreak: str, out: str = "p_holm") -> DataFrame:
    """Holm's adjusted p-values of a table of tests; NULL stays."""
    known = numbered(df.where(F.col(p).isNotNull()), [p, tiebreak], "__k")
    n = known.count()
    adj = known.withColumn("__s", F.least(F.lit(1.0), F.col(p) * (n - F.col("__k") + 1)))
    adj = running(adj, [p, tiebreak], {out: ("__s", "max")}).drop("__s", "__k")
    return adj.unionByName(df.where(F.col(p).isNull()), allowMissingColumns=True)


# ---- inference by draws --------------------------------------------------------------------------------------


def cluster_sums(df: DataFrame, y: str, x: str, controls: list[str], effects: list[str], cluster: str) -> DataFrame:
    """(cluster, sxu, sxx): per cluster, the score of the null model and the square of ``x``, all else taken out."""
    d = df.select(*dict.fromkeys([y, x, *controls, *effects, cluster])).dropna().withColumns({c: F.col(c).cast("double") for c in [y, x, *controls]})
    d = d.withColumn("__c", F.col(cluster))
    m = cut(demean(d, [y, x, *controls], effects)) if effects else cut(d)
    if controls:
        g, _, _, _ = moments(m, controls)
        for c in (y, x):
            _, v, _, _ = moments(m, controls, c)
            b = np.linalg.lstsq(g, v, rcond=None)[0]
            e = F.col(c)
            for name, k in zip(controls, b, strict=True):
                e = e - F.col(name) * F.lit(float(k))
            m = cut(m.withColumn(c, e))
    return m.groupBy(F.col("__c").alias(cluster)).agg(F.sum(F.col(x) * F.col(y)).alias("sxu"), F.sum(F.col(x) * F.col(x)).alias("sxx"))


def wild_bootstrap(sums: DataFrame, draws: int = 9_999, seed: int = 1, max_clusters: int = 1_000_000) -> dict[str, float]:
    """Wild cluster bootstrap of one coefficient with the null imposed, signs by Rademacher draws.

    ``sums`` of ``cluster_sums``: two numbers a cluster come to the driver, which must not be more than
    ``max_clusters``. p = (1 + draws at least as large as the t of the data) / (1 + draws).
    """
    rows = sums.select("sxu", "sxx").limit(max_clusters + 1).collect()
    if len(rows) > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters")
    s, q = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    total = q.sum()

    def t_of(scores: np.ndarray) -> np.ndarray:
        b = scores.sum(axis=-1, keepdims=True) / total
        u = scores - b * q
        return (b[..., 0] * total) / np.sqrt((u * u).sum(axis=-1))

    t0 = float(t_of(s[None, :])[0])
    rng, more, done = np.random.default_rng(seed), 0, 0
    while done < draws:
        k = min(draws - done, max(1, 4_000_000 // max(len(s), 1)))
        more += int((np.abs(t_of(rng.choice([-1.0, 1.0], (k, len(s))) * s)) >= abs(t0) - 1e-12).sum())
        done += k
    return {"beta": float(s.sum() / total), "t": t0, "p": (1 + more) / (1 + draws), "clusters": len(s), "draws": draws}


def unit_weights(units: DataFrame, unit: str, draw: int, seed: int = 1, stratum: str | None = None) -> DataFrame:
    """(unit, weight): how often each unit is drawn in one draw of as many as there are, within its stratum.

    Every unit makes one draw: the place it draws is a hash of it, so units are never collected.
    """
    group = [stratum] if stratum else []
    d = cut(numbered(units.select(unit, *group).distinct(), [*group, unit], "__k"))
    per = d.groupBy(*group).agg(F.count("*").alias("__n"), F.min("__k").alias("__from"))
    d = d.join(broadcast_if_small(per), group) if group else d.join(F.broadcast(per))  # one row
    place = F.col("__from") + F.pmod(F.xxhash64(unit, F.lit(draw), F.lit(seed)), F.col("__n"))
    drawn = d.groupBy(place.alias("__k")).agg(F.count("*").alias("weight"))
    return d.join(drawn, "__k", "left").select(unit, F.coalesce("weight", F.lit(0)).alias("weight"))


def unit_bootstrap(
    df: DataFrame, y: str, treated: str, unit: str, date: str, draws: int, seed: int = 1, max_cells: int = 5_000_000, done: DataFrame | None = None,
    stratum: str | None = None, controls: list[str] | None = None,
) -> DataFrame:
    """(draw, att): imputation effects with units drawn with replacement, within strata, as weights and not as copies.

    A panel of at most ``max_cells`` rows goes to the workers as arrays, and draws are spread over them. A larger one
    stays where it is: each draw is a weighted fit of its own. ``done`` (draw, att): draws already made, which are
    kept; so a stopped run goes on. With ``controls`` their slopes are those of the whole sample's untreated rows.
    """
    import pandas as pd

    spark = df.sparkSession
    d = df.withColumn("__y", F.col(y).cast("double")).withColumn("__d", F.col(treated).cast("int"))
    if controls:
        fit = fixed_effects(d.where("__d = 0"), "__y", controls, [unit, date], [unit])
        for name, k in zip(fit.names, fit.beta, strict=True):
            d = d.withColumn("__y", F.col("__y") - F.col(name).cast("double") * F.lit(float(k)))
    group = (F.col(stratum) if stratum else F.lit(0)).cast("string").alias("__s")
    d = cut(d.select(unit, date, "__y", "__d", group).dropna())
    todo = spark.range(draws).select(F.col("id").cast("int").alias("draw"))
    todo = todo.join(done.select("draw"), "draw", "left_anti") if done is not None else todo
    if d.count() > max_cells:
        rows = []
        for k in sorted(r[0] for r in todo.collect()):  # numbers of draws, a setting
            w = unit_weights(d, unit, k, seed, "__s")
            one = att(d.join(w, unit), "__y", F.col("__d") == 1, unit, date, weight="weight").first()
            rows.append((k, one["att"] if one else None))
        new = spark.createDataFrame(rows, "draw int, att double")
        return done.unionByName(new) if done is not None else new
    p = d.toPandas()
    u, n_u = pd.factorize(p[unit])[0], p[unit].nunique()
    t, n_t = pd.factorize(p[date])[0], p[date].nunique()
    of_unit = p.groupby(u)["__s"].first()
    strata = [of_unit.index[of_unit == x].to_numpy() for x in sorted(of_unit.unique())]
    arrays = spark.sparkContext.broadcast((u, t, p["__y"].to_numpy(), p["__d"].to_numpy() == 1, n_u, n_t, strata))

    def run(parts):
        u, t, y, d, n_u, n_t, strata = arrays.value
        c = ~d
        for part in parts:
            out = []
            for k in part["draw"]:
                rng = np.random.default_rng([seed, int(k)])
                w_u = np.zeros(n_u)
                for s in strata:
                    w_u[s] = np.bincount(rng.integers(0, len(s), len(s)), minlength=len(s))
                w = w_u[u]
                b = np.zeros(n_t)
                for _ in range(5_000):
                    a = _mean(u[c], (y - b[t])[c], w[c], n_u)
                    new = _mean(t[c], (y - a[u])[c], w[c], n_t)
                    moved = np.nanmax(np.abs(new - b)) if (~np.isnan(new)).any() else 0.0
                    b = new
                    if moved < 1e-10 * max(1.0, np.nanmax(np.abs(y))):
                        break
                else:
                    raise RuntimeError(f"effects of draw {k} did not settle")
                e = (y - a[u] - b[t])[d]
                ok = ~np.isnan(e)
                out.append(float((e * w[d])[ok].sum() / w[d][ok].sum()) if w[d][ok].sum() > 0 else None)
            yield pd.DataFrame({"draw": part["draw"], "att": out}).astype({"att": "float64"})

    new = todo.repartition(32).mapInPandas(run, "draw int, att double")
    return done.unionByName(new) if done is not None else new


def _mean(k: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    # What was not drawn counts nothing, whatever its value.
    s, t = np.bincount(k, np.where(w > 0, v * w, 0.0), n), np.bincount(k, w, n)
    return np.divide(s, t, out=np.full(n, np.nan), where=t > 0)


def max_t_bands(estimates: np.ndarray, draws: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray, float]:
    """(low, high, joint p) of several estimates from draws (rows) of them: bands that hold all at once."""
    se = draws.std(axis=0, ddof=1)
    top = np.max(np.abs(draws - draws.mean(axis=0)) / se, axis=1)
    c = np.quantile(top, level)
    return estimates - c * se, estimates + c * se, float((1 + (top >= np.max(np.abs(estimates) / se)).sum()) / (1 + len(draws)))


# ---- tails of distributions ----------------------------------------------------------------------------------


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    # Lentz's evaluation of the continued fraction, two coefficients a round.
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def t_tail(t: float, dof: float) -> float:
    """P(T > t) for t >= 0."""
    return 0.5 * _beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return _beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0
