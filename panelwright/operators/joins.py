"""Joins that state what they join: cardinality, ambiguity, ranges and nearest anchors."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.contracts import require_unique
from panelwright.operators.graph import components
from panelwright.session import broadcast_if_small, cut


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return require_unique(left, keys).join(require_unique(right, keys), keys, how)


def lookup(left: DataFrame, dim: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Many rows to one of ``dim``, whose keys must be unique; broadcast while ``dim`` is small."""
    return left.join(broadcast_if_small(require_unique(dim, keys)), keys, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns both have."""
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL; the left keys stay."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def reduce_join(frames: list[DataFrame], keys: list[str], how: str = "left") -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, how), frames)


def through_crosswalk(facts: DataFrame, crosswalk: DataFrame, key: str, target: str, sums: list[str]) -> DataFrame:
    """Facts per source key, first summed there, then mapped many-to-many and summed per target."""
    per = facts.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])
    return per.join(broadcast_if_small(crosswalk.select(key, target).distinct()), key).groupBy(target).agg(*[F.sum(c).alias(c) for c in sums])


def by_occurrence(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str], how: str = "left") -> DataFrame:
    """The n-th row of a key with the n-th row of that key on the other side, in stated orders."""
    a = left.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(*left_order)))
    b = right.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(*right_order)))
    return a.join(b, [key, "occurrence"], how)


def unambiguous_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct pairs whose left and right side each have this one partner only; NULL sides are left out."""
    p = pairs.select(left, right).dropna().distinct()
    one_l = p.groupBy(left).agg(F.count("*").alias("n")).where("n = 1").select(left)
    one_r = p.groupBy(right).agg(F.count("*").alias("n")).where("n = 1").select(right)
    return p.join(one_l, left, "left_semi").join(one_r, right, "left_semi").select(left, right)


def with_fallback(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """``rows`` with ``value`` from ``first``, else from ``second``, and which of them gave it."""
    a = first.select(key, F.col(value).alias("__a"))
    b = second.select(key, F.col(value).alias("__b"))
    out = rows.join(broadcast_if_small(a), key, "left").join(broadcast_if_small(b), key, "left")
    method = F.when(F.col("__a").isNotNull(), names[0]).when(F.col("__b").isNotNull(), names[1])
    return out.withColumn(value, F.coalesce("__a", "__b")).withColumn("method", method).drop("__a", "__b")


def preferred_key(rows: DataFrame, known: DataFrame, raw: str, cleaned: str, key: str, out: str) -> DataFrame:
    """``out``: the raw key if ``known`` has it, else the cleaned one if known, else NULL."""
    k = known.select(F.col(key)).dropna().distinct()
    a = rows.join(broadcast_if_small(k.select(F.col(key).alias("__a"))), F.col(raw) == F.col("__a"), "left")
    b = a.join(broadcast_if_small(k.select(F.col(key).alias("__b"))), F.col(cleaned) == F.col("__b"), "left")
    return b.withColumn(out, F.coalesce("__a", "__b")).drop("__a", "__b")


def in_windows(facts: DataFrame, windows: DataFrame, date: str, start: str = "from_date", end: str = "to_date") -> DataFrame:
    """Facts with each window that holds their date (both ends belong to it); windows may overlap.

    Windows are laid on the months they touch, so that facts meet them by equal months, whatever their number.
    """
    months = F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    w = windows.where(F.col(start) <= F.col(end)).withColumn("__month", months)
    f = facts.withColumn("__month", F.trunc(date, "month"))
    return f.join(broadcast_if_small(w), "__month").where(F.col(date).between(F.col(start), F.col(end))).drop("__month")


def flag_covered(rows: DataFrame, intervals: DataFrame, entity: str, date: str, start: str, end: str, out: str = "covered") -> DataFrame:
    """``rows`` (unique on entity and date) with whether any interval of the entity holds the date; never NULL."""
    i = intervals.select(F.col(entity).alias("__e"), F.col(start).alias("__s"), F.col(end).alias("__t"))
    hit = rows.select(entity, date).distinct().join(i, (F.col(entity) == F.col("__e")) & F.col(date).between(F.col("__s"), F.col("__t"))).select(entity, date).distinct()
    return rows.join(hit.withColumn(out, F.lit(True)), [entity, date], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def nearest_anchors(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """``df`` with the last known value before and the first known one after each row, and where they stand."""
    back = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    return df.select(
        "*", F.last(value, True).over(back).alias("prev_value"), F.last(at, True).over(back).alias("prev_at"),
        F.first(value, True).over(ahead).alias("next_value"), F.first(at, True).over(ahead).alias("next_at"),
    )


def lagged_context(rows: DataFrame, context: DataFrame, key: str, date: str, text: str, sep: str = "\n") -> DataFrame:
    """(key, context): the texts of the days before a row: Friday to Sunday for a Monday, else the day before."""
    offsets = F.when(F.weekday(date) == 0, F.array(F.lit(3), F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))
    days = rows.select(key, F.explode(F.transform(offsets, lambda k: F.date_sub(F.col(date), k))).alias("__day"))
    c = context.select(F.col(date).alias("__day"), F.col(text).alias("__text"))
    got = days.join(c, "__day").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__day", "__text"))).alias("t"))
    return got.select(key, F.array_join(F.transform("t", lambda x: x["__text"]), sep).alias("context"))


def verified_links(links: DataFrame, roster: DataFrame, keys: list[str], canonical: str) -> DataFrame:
    """Links valid on one day, each with whether the roster of that day has it, under the same canonical name."""
    r = roster.select(*keys, F.col(canonical).alias("__roster")).dropDuplicates(keys)
    out = links.join(r, keys, "left")
    status = F.when(F.col("__roster").isNull(), "absent").when(F.col("__roster") == F.col(canonical), "ok").otherwise("differs")
    return out.withColumn("link_status", status).drop("__roster")


def done_anti(queue: DataFrame, done: DataFrame, keys: list[str], refresh: Column | None = None) -> DataFrame:
    """The rows of a queue that are not done, and those done whose ``refresh`` condition (on ``done``) holds."""
    d = done.where(~F.coalesce(refresh, F.lit(False))) if refresh is not None else done
    return queue.join(d.select(*keys).distinct(), keys, "left_anti")


def jaro_winkler(a: str, b: str, p: float = 0.1) -> float:
    """Jaro-Winkler similarity of two strings, prefix weight ``p`` over at most four letters."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used, hit = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hit.append(c)
                break
    if not hit:
        return 0.0
    other = [b[j] for j in range(m) if used[j]]
    t = sum(x != y for x, y in zip(hit, other, strict=True)) // 2
    k = len(hit)
    jaro = (k / n + k / m + (k - t) / k) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * p * (1 - jaro)


def _least_shared(n: int, threshold: float) -> int:
    """Letters that a string of ``n`` has in common with any string it is similar to, at least.

    Four letters of common prefix add most, so Jaro is at least j = (threshold - 0.4) / 0.6. It is at most
    (k / n + k / m + 1) / 3 for k common letters; as k / m is at most 1, k / n is at least 3 j - 2.
    """
    return max(0, math.ceil(((threshold - 0.4) / 0.6 * 3 - 2) * n - 1e-9))


def _choice(n: int, threshold: float) -> int:
    """How many letters a name of ``n`` is paired by: SHARED, or fewer where there would be more than CHOICES of them."""
    least = _least_shared(n, threshold)
    return next((k for k in range(min(SHARED, least), 1, -1) if math.comb(n - least + k, k) <= CHOICES), min(1, least))


def _letters(s: str) -> list[tuple[str, int]]:
    """The letters of a string, each with how often it has come before."""
    seen: dict[str, int] = {}
    out = []
    for c in s:
        seen[c] = k = seen.get(c, -1) + 1
        out.append((c, k))
    return out


def _letter_counts(strings: list[str]) -> np.ndarray:
    """A row of letter counts for each string; letters that share a column only make strings look more alike."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="uint32") % LETTER_COLUMNS
    at = np.repeat(np.arange(len(strings)), [len(x) for x in strings])
    return np.bincount(at * LETTER_COLUMNS + codes, minlength=len(strings) * LETTER_COLUMNS).reshape(len(strings), LETTER_COLUMNS).astype("int16")


def fuzzy_pairs(names: DataFrame, name: str, threshold: float = 0.9) -> DataFrame:
    """(left, right, similarity), left < right: all pairs of distinct names at or above ``threshold``.

    Similar names have so many letters in common that, in any common order of the letters, they share k of the
    first n - least + k letters of each; here the rarest come first. Names are paired by each choice of k of these
    letters, then held against the bound by all their letters, then compared. Null names pair with nothing. Up to a threshold of 0.8 there is no such bound, and all names are compared with all.
    """
    low = (threshold - 0.4) / 0.6 * 3 - 2
    n = cut(names.select(F.col(name).alias("n")).dropna().distinct())

    def letters(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            count = Counter(x for s in p["n"] for x in _letters(s))
            yield pd.DataFrame([(c, k, v) for (c, k), v in count.items()], columns=["c", "k", "v"]).astype({"k": "int64", "v": "int64"})

    # The order only has to be the same for all names: letters beyond MOST_LETTERS are the rarest and follow their own.
    often = n.mapInPandas(letters, "c string, k long, v long").groupBy("c", "k").agg(F.sum("v").alias("v")).orderBy(F.desc("v"), "c", "k").limit(MOST_LETTERS).collect()
    rank = names.sparkSession.sparkContext.broadcast({(r["c"], r["k"]): -i for i, r in enumerate(often)})

    def signs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = rank.value
        for p in parts:
            out = []
            for s in p["n"]:
                size, least = len(s), _least_shared(len(s), threshold)
                items = sorted(_letters(s), key=lambda x: (order.get(x, -MOST_LETTERS), x))
                # A pair shares as many letters as its shorter name needs at least, so the choices are of the size for that.
                for k in sorted({_choice(q, threshold) for q in range(math.ceil(low * size - 1e-9), size + 1)}):
                    for chosen in itertools.combinations(items[: size - least + k], k) if k else ():
                        out.append((s, size, "".join(f"{c}{j}" for c, j in chosen)))
            yield pd.DataFrame(out, columns=["n", "size", "sign"]).astype({"size": "int32"})

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            a, b = p["left"].tolist(), p["right"].tolist()
            if not a:
                continue
            k = np.minimum(_letter_counts(a), _letter_counts(b)).sum(axis=1)
            jaro = (k / np.array([len(x) for x in a]) + k / np.array([len(x) for x in b]) + 1) / 3
            same = np.array([next((i for i in range(4) if x[i : i + 1] != y[i : i + 1] or i >= len(x)), 4) for x, y in zip(a, b, strict=True)])
            p = p[jaro + same * 0.1 * (1 - jaro) >= threshold - 1e-9]
            s = np.array([jaro_winkler(x, y) for x, y in zip(p["left"], p["right"], strict=True)], dtype="float64")
            yield p.assign(similarity=s)[s >= threshold]

    if low <= 0:
        pairs = n.alias("x").join(n.alias("y"), F.col("x.n") < F.col("y.n"))
        return pairs.select(F.col("x.n").alias("left"), F.col("y.n").alias("right")).mapInPandas(score, "left string, right string, similarity double")
    signed = cut(n.mapInPandas(signs, "n string, size int, sign string"))
    fits = F.least("x.size", "y.size") >= F.lit(low) * F.greatest("x.size", "y.size") - 1e-9
    pairs = signed.alias("x").join(signed.alias("y"), (F.col("x.sign") == F.col("y.sign")) & (F.col("x.n") < F.col("y.n")) & fits)
    return pairs.select(F.col("x.n").alias("left"), F.col("y.n").alias("right")).mapInPandas(score, "left string, right string, similarity double").distinct()


#: Letters that names are paired by, at most: more make longer lists of choices and fewer pairs.
SHARED = 4
CHOICES = 1000
#: Letters, each with its number, that are ordered by how rare they are.
MOST_LETTERS = 10_000
LETTER_COLUMNS = 64


def clusters(links: DataFrame, left: str, right: str) -> DataFrame:
    """(member, root): the smallest member that a member is linked with; rows with a NULL end link nothing."""
    return components(links.dropna(subset=[left, right]), left, right).select(F.col("id").alias("member"), "root")


def representatives(members: DataFrame, counts: DataFrame, member: str = "member", root: str = "root", n: str = "n") -> DataFrame:
    """(root, representative): the most frequent member of each cluster; of equals the smallest."""
    j = members.join(counts.select(member, n), member, "left")
    return j.groupBy(root).agg(F.min_by(member, F.struct(-F.coalesce(F.col(n), F.lit(0)), F.col(member))).alias("representative"))


def matching_blocks(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, left_at, right_at, size): matching blocks of two arrays of paragraphs of each row of ``pairs``."""
    import difflib

    kind = pairs.schema[key].dataType.simpleString()

    def run(parts):
        for p in parts:
            out = []
            for k, a, b in zip(p[key], p[left], p[right], strict=True):
                for m in difflib.SequenceMatcher(None, [*(() if a is None else a)], [*(() if b is None else b)], autojunk=False).get_matching_blocks():
                    if m.size:
                        out.append((k, m.a, m.b, m.size))
            yield pd.DataFrame(out, columns=[key, "left_at", "right_at", "size"])

    return pairs.select(key, left, right).mapInPandas(run, f"`{key}` {kind}, left_at int, right_at int, size int")
