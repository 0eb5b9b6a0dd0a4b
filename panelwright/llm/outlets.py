"""Free labels to the outlets of a reference list, with the labels that name none reported.

A symmetric-delete dictionary over the forms of all outlet names is broadcast; each distinct label is looked
up once, in several clean forms. Hits are ranked by weighted Damerau-Levenshtein distance and then by how
often the outlet is named without any error. Labels that name two outlets, or none within the bound, come
out as ``unmatched``. Spellings already reviewed are met by a join, as their number has no bound. A reference
list larger than a dictionary may be is looked up in shards, one dictionary at a time: each gives the outlets a
label could touch by any lookup, and the label is then resolved among these alone, with the same result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.names import ARTICLES, KINDS, LINKS, DeleteIndex, compact, core, expand, plain, rotations, spoken, tokens, weighted_distance
from panelwright.session import broadcast_if_small, cut
from panelwright.sources.tables import table

UNMATCHED = "unmatched"
#: Greatest weighted distance of a hit, for names of at least eight letters; shorter ones get one.
MOST = 2.0
#: Greatest weighted distance of a hit found by one of its words, and the letters such a name has at least.
MOST_LONG = 3.0
LONG = 14
#: Outlets of a dictionary, which takes some ten kilobytes an outlet and is broadcast; a longer list has several.
SHARD_OUTLETS = 20_000
#: A cut label goes to the most named of several outlets if that is named so many times as often as the next.
CUT_LEAD = 3.0


class OutletIndex:
    """Forms of the outlets' names, for lookup of labels."""

    def __init__(self, outlets: list[tuple[str, str, str | None, str | None, str | None]], weight: dict[str, float], places: frozenset[str] | None = None):
        """outlets: (canonical_id, name, short name, site, state); places: those of the whole list if this is a part of it."""
        self.weight = weight
        self._asked: tuple[str | None, bool] = (None, False)
        self.places = frozenset(" ".join(tokens(o[4])) for o in outlets if o[4]) if places is None else places
        owners: dict[str, set[str]] = {}
        whole: dict[str, set[str]] = {}
        for cid, name, short, site, _ in outlets:
            w = tokens(name)
            forms = {compact(w), core(w), compact([x for i, x in enumerate(w) if i or x not in ARTICLES]), compact(tokens(cid))}
            if site:
                forms.add(compact(tokens(site.rsplit(".", 1)[0])))
            for f in forms:
                owners.setdefault(f, set()).add(cid)
                whole.setdefault(f, set()).add(cid)
            if short:
                whole.setdefault(compact(tokens(short)), set()).add(cid)
        self.whole_owners = whole
        self.whole = {f: next(iter(c)) for f, c in whole.items() if len(c) == 1}
        self.owners = {f: sorted(c) for f, c in owners.items()}
        self.index = DeleteIndex(sorted(self.owners))
        self.sorted_forms = self.index.forms
        self.kinds = frozenset(KINDS)
        self.forms_of: dict[str, list[str]] = {}
        for f, cs in self.owners.items():
            for c in cs:
                self.forms_of.setdefault(c, []).append(f)
        self.word_owners: dict[str, set[str]] = {}
        for cid, name, *_ in outlets:
            for x in tokens(name):
                if len(x) >= 5 and x not in self.kinds:
                    self.word_owners.setdefault(x, set()).add(cid)
        self.words = DeleteIndex(sorted(self.word_owners))

    def _best(self, hits: list[tuple[float, int]]) -> str | None:
        """The outlet nearest to a label; of equally near ones the most named."""
        ranked = sorted({(d, -self.weight.get(c, 0), c) for d, k in hits for c in self.owners[self.index.forms[k]]})
        return ranked[0][2] if ranked else None

    def _fuzzy(self, words: list[str], d: int, most: float) -> list[tuple[float, int]]:
        out: list[tuple[float, int]] = []
        for f in {compact(words), core(words)}:
            if len(f) >= 5:
                out += self.index.matches(f, d, min(most, 1.0) if len(f) < 8 else most)
        return sorted(out)

    def names_two(self, label: str) -> bool:
        """Whether a label names two outlets; asked twice of a label, it is found once."""
        if self._asked[0] != label:
            self._asked = (label, self._names_two(label))
        return self._asked[1]

    def _names_two(self, label: str) -> bool:
        s = plain(label)
        parts = [p for p in re.split(r"[/;,|+]| - | – | y | e | and ", s) if p.strip()]
        if 2 <= len(parts) <= 4:
            found = set()
            for p in parts:
                w = expand(tokens(p))
                if len(w) >= 2 and (m := self._fuzzy(w, 1, 1.0)):
                    found.add(self._best(m))
                elif len(w) >= 2 and w[0] in self.kinds | ARTICLES and any(x not in LINKS and x not in self.kinds and len(x) > 3 for x in w):
                    found.add(p)
            if len(found) >= 2:
                return True
        w = expand(tokens(label))
        if len(w) >= 4:
            for i in range(2, len(w) - 1):
                a = self._fuzzy(w[:i], 1, 1.0)
                if a:
                    rest = w[i + 1 :] if w[i] in ("y", "e") else w[i:]
                    b = self._fuzzy(rest, 1, 1.0)
                    if b and self._best(a) != self._best(b):
                        return True
        return False

    def _cut(self, form: str) -> str | None:
        """The outlet of a name cut short: the only one that begins so, or the one named far more than the next."""
        lo = bisect.bisect_left(self.sorted_forms, form)
        seen: set[str] = set()
        while lo < len(self.sorted_forms) and self.sorted_forms[lo].startswith(form):
            seen.update(self.owners[self.sorted_forms[lo]])
            lo += 1
        if not seen:
            return None
        by = sorted(seen, key=lambda c: (-self.weight.get(c, 0), c))
        if len(by) == 1 or self.weight.get(by[0], 0) >= CUT_LEAD * max(1.0, self.weight.get(by[1], 0)):
            return by[0]
        return None

    def _by_word(self, ways: list[tuple[list[str], int]]) -> tuple[str, float] | None:
        """A long name with more slips than the index reaches: found by one of its own words, verified as a whole."""
        best: tuple | None = None
        for w, n in ways:
            e = expand(w)
            f = core(e)
            if len(f) < LONG or n > 2:
                continue
            owners = {c for x in e if len(x) >= 5 and x not in self.kinds for _, k in self.words.matches(x, 2, 1.6) for c in self.word_owners[self.words.forms[k]]}
            for c in owners:
                for g in self.forms_of[c]:
                    if abs(len(g) - len(f)) <= 3 and (dist := weighted_distance(f, g, MOST_LONG)) <= MOST_LONG:
                        key = (dist + 0.25 * n, -self.weight.get(c, 0), c, dist)
                        best = key if best is None or key < best else best
        return (best[2], best[3]) if best else None

    def exact_forms(self, label: str | None) -> list[str]:
        """Forms of a label that may be an outlet's or a reviewed spelling's, the likeliest first."""
        if not label or not label.strip():
            return []
        out: dict[str, None] = {}
        for x, _ in spoken(label, self.places):
            for r in rotations(x.split()):
                e = expand(r)
                out.update((f, None) for f in (compact(r), compact(e), core(e)) if len(f) >= 3)
        return [*out]

    def touched(self, label: str | None) -> set[str]:
        """All outlets that a lookup of a label may come upon, whatever comes of the others."""
        out: set[str] = set()
        for f in self.exact_forms(label):
            if f in self.whole_owners:
                out |= self.whole_owners[f]
        if not label or not label.strip():
            return out
        pieces = [tokens(p) for p in re.split(r"[/;,|+]| - | – | y | e | and ", plain(label))]
        w = expand(tokens(label))
        pieces += [x for i in range(2, len(w) - 1) for x in (w[:i], w[i:], w[i + 1 :])]
        ways = [x.split() for x, _ in spoken(label, self.places)]
        forms = {f for p in pieces for f in (compact(expand(p)), core(expand(p)))}
        for x in ways:
            e = expand(x)
            forms |= {compact(x), compact(e), core(x), core(e), *(core(r) for r in rotations(e))}
            for y in e:
                if len(y) >= 5 and y not in self.kinds:
                    out |= {c for _, k in self.words.matches(y, 2, 1.6) for c in self.word_owners[self.words.forms[k]]}
            for f in (compact(e), core(e)):
                lo = bisect.bisect_left(self.sorted_forms, f)
                while len(f) >= 7 and lo < len(self.sorted_forms) and self.sorted_forms[lo].startswith(f):
                    out.update(self.owners[self.sorted_forms[lo]])
                    lo += 1
        for f in forms:
            out |= {c for k in self.index.near(f, 2) for c in self.owners[self.index.forms[k]]}
        return out

    def resolve(self, label: str | None) -> tuple[str, float | None]:
        """(canonical_id or ``unmatched``, weighted distance)."""
        return self.ranked(label)[:2]

    def ranked(self, label: str | None, forms: list[str] | None = None) -> tuple[str, float | None, int | None]:
        """As ``resolve``, with the number of the form of ``exact_forms`` that is an outlet's own, if one is."""
        if not label or not label.strip():
            return UNMATCHED, None, None
        for n, f in enumerate(self.exact_forms(label) if forms is None else forms):
            if f in self.whole:
                return self.whole[f], 0.0, n
        return *self._inexact(label), None

    def _inexact(self, label: str) -> tuple[str, float | None]:
        ways = [(x.split(), n) for x, n in spoken(label, self.places)]
        if self.names_two(label):
            return UNMATCHED, None
        for d in (1, 2):
            best: tuple | None = None
            for w, n in ways:
                forms = {compact(w): 0, compact(expand(w)): 0, core(w): 0, core(expand(w)): 0}
                for r in rotations(expand(w))[1:]:
                    forms.setdefault(core(r), 1)
                for f, turned in forms.items():
                    if len(f) < 5:
                        continue
                    for dist, k in self.index.matches(f, d, 1.0 if len(f) < 8 or d == 1 else MOST):
                        c = self._best([(dist, k)])
                        key = (dist + 0.25 * (n + turned), -self.weight.get(c, 0), c, dist)
                        if best is None or key < best:
                            best = key
            if best:
                return best[2], best[3]
        if far := self._by_word(ways):
            return far
        for w, n in ways:
            e = expand(w)
            if n <= 1 and len(w) >= 1:
                for form in {compact(e), core(e)}:
                    kind = next((x for x in sorted(self.kinds, key=len, reverse=True) if form.startswith(x)), "")
                    if len(form) >= max(7, len(kind) + 2) and (c := self._cut(form)):
                        return c, None
        return UNMATCHED, None


class Outlets:
    """The reference list as one dictionary, or as several where it is too long, with the spellings reviewed."""

    def __init__(self, registry: DataFrame, reviewed: DataFrame, weight: DataFrame, shard_outlets: int = SHARD_OUTLETS):
        """registry: (canonical_id, outlet_name, siglas, sitio, estado); reviewed: (label, canonical_id, n); weight: (canonical_id, count)."""
        self.spark = registry.sparkSession
        reg = registry.dropna(subset=["canonical_id", "outlet_name"]).groupBy("canonical_id").agg(F.min(F.struct("outlet_name", "siglas", "sitio", "estado")).alias("r"))
        self.registry = cut(reg.select("canonical_id", "r.*").join(weight, "canonical_id", "left"))
        # Places are as many as states are.
        self.places = frozenset(" ".join(tokens(r[0])) for r in self.registry.select("estado").dropna().distinct().toLocalIterator())
        self.shards = max(1, -(-self.registry.count() // shard_outlets))
        self.reviewed = reviewed
        self.whole = self._shard(0) if self.shards == 1 else OutletIndex([], {}, self.places)

    def _shard(self, k: int) -> OutletIndex:
        part = self.registry.where(F.pmod(F.xxhash64("canonical_id"), F.lit(self.shards)) == k).orderBy("canonical_id").collect()
        return OutletIndex([tuple(r)[:5] for r in part], {r["canonical_id"]: float(r["count"] or 0) for r in part}, self.places)

    def lookup(self, distinct: DataFrame, column: str) -> DataFrame:
        """(label, canonical_id, distance, two, forms): what the outlets' own names say of distinct labels; two: it names two."""
        schema = "label string, canonical_id string, distance double, two boolean, forms array<string>"

        def frame(labels: list[str], found: list[tuple], forms: list[list[str]], two: list[bool]) -> pd.DataFrame:
            # Reviewed spellings count only before the form that is an outlet's own.
            left = [f if g[2] is None else f[: g[2]] for f, g in zip(forms, found, strict=True)]
            return pd.DataFrame({"label": labels, "canonical_id": [g[0] for g in found], "distance": [g[1] for g in found], "two": two, "forms": left}).astype({"distance": "float64"})

        cores = self.spark.sparkContext.defaultParallelism
        # Lookups take long for what they read: more tasks than the bytes ask for, which are not put together again.
        tasks = max(cores * 2, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        distinct = distinct.select(F.col(column).alias("label")).repartition(tasks)
        if self.shards == 1:
            shared = self.spark.sparkContext.broadcast(self.whole)

            def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                index = shared.value
                for p in parts:
                    labels = p["label"].tolist()
                    forms = [index.exact_forms(x) for x in labels]
                    found = [index.ranked(x, f) for x, f in zip(labels, forms, strict=True)]
                    yield frame(labels, found, forms, [g[0] == UNMATCHED and bool(x.strip()) and index.names_two(x) for x, g in zip(labels, found, strict=True)])

            return distinct.mapInPandas(run, schema)
        touched = None
        for k in range(self.shards):
            shard = self.spark.sparkContext.broadcast(self._shard(k))

            def touch(parts: Iterator[pd.DataFrame], shard=shard) -> Iterator[pd.DataFrame]:
                for p in parts:
                    yield pd.DataFrame([(x, c) for x in p["label"] for c in shard.value.touched(x)], columns=["label", "canonical_id"], dtype="object")

            got = cut(distinct.mapInPandas(touch, "label string, canonical_id string"))
            touched = got if touched is None else touched.unionByName(got)
        few = touched.join(self.registry, "canonical_id").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("canonical_id", "outlet_name", "siglas", "sitio", "estado", "count"))).alias("few"))
        places = self.places

        def small(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                labels, found, forms, two = p["label"].tolist(), [], [], []
                for x, rows in zip(labels, p["few"], strict=True):
                    rows = [] if rows is None else [*rows]
                    index = OutletIndex([(r["canonical_id"], r["outlet_name"], r["siglas"], r["sitio"], r["estado"]) for r in rows], {r["canonical_id"]: float(r["count"] or 0) for r in rows}, places)
                    forms.append(index.exact_forms(x))
                    found.append(index.ranked(x, forms[-1]))
                    two.append(found[-1][0] == UNMATCHED and bool(x.strip()) and index.names_two(x))
                yield frame(labels, found, forms, two)

        return distinct.join(few, "label", "left").select("label", "few").mapInPandas(small, schema)

    def resolve(self, labels: DataFrame, column: str = "label") -> DataFrame:
        """(label, canonical_id, distance, two) of the distinct labels of a column; null labels are left out."""
        found = cut(self.lookup(labels.select(column).dropna().distinct(), column))
        # Of the spellings reviewed, the one that comes first among the label's forms; of equal ones the most voted.
        told = self.reviewed.select(_form("label").alias("form"), "canonical_id", "n").where("form <> ''").groupBy("form", "canonical_id").agg(F.sum("n").alias("n"))
        told = told.groupBy("form").agg(F.max_by("canonical_id", F.struct("n", "canonical_id")).alias("told"))
        # Forms of outlets, which may belong to several of them, are not for a spelling to decide.
        own = self._own_forms().groupBy("form").agg(F.max("full").alias("full"), F.count_distinct("canonical_id").alias("m")).where("full or m = 1").select("form")
        told = broadcast_if_small(cut(told.join(broadcast_if_small(cut(own)), "form", "left_anti")))
        hits = found.select("label", F.posexplode("forms").alias("k", "form")).join(told, "form").groupBy("label").agg(F.min_by("told", "k").alias("told"))
        out = found.drop("forms").join(broadcast_if_small(cut(hits)), "label", "left")
        has = F.col("told").isNotNull()
        return out.select("label", F.coalesce("told", "canonical_id").alias("canonical_id"), F.when(has, 0.0).otherwise(F.col("distance")).alias("distance"), (F.col("two") & ~has).alias("two"))

    def _own_forms(self) -> DataFrame:
        """(form, canonical_id, full): forms of the outlets' names; full: not only a short name."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                index = OutletIndex([*p[["canonical_id", "outlet_name", "siglas", "sitio", "estado"]].astype(object).where(p.notna(), None).itertuples(index=False, name=None)], {}, frozenset())
                out = [(f, c, f in index.owners) for f, cs in index.whole_owners.items() for c in cs]
                yield pd.DataFrame(out, columns=["form", "canonical_id", "full"]).astype({"form": "object", "canonical_id": "object", "full": "bool"})

        return self.registry.select("canonical_id", "outlet_name", "siglas", "sitio", "estado").mapInPandas(run, "form string, canonical_id string, full boolean")


def _form(column: str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: compact(tokens(x)) if x else ""), "string")(column)


def build_index(spark: SparkSession, folder: str) -> Outlets:
    """outlet_registry with the reviewed aliases and the number of times each outlet is named without error."""
    reg = table(spark, folder, "outlet_registry").select("canonical_id", "outlet_name", "siglas", "sitio", "estado")
    al = table(spark, folder, "question_aliases").where("status = 'reviewed' and canonical_id is not null and alias is not null")
    ids = broadcast_if_small(reg.select("canonical_id").dropna().distinct())
    named = table(spark, folder, "attendance").select(F.col("outlet_final").alias("canonical_id")).join(ids, "canonical_id", "left_semi")
    weight = named.unionByName(al.select("canonical_id").join(ids, "canonical_id", "left_semi")).groupBy("canonical_id").count()
    known = al.join(ids, "canonical_id", "left_semi").groupBy(F.col("alias").alias("label"), "canonical_id").agg(F.lit(1).alias("n"))
    return Outlets(reg, known, weight)


def match_labels(rows: DataFrame, outlets: Outlets, column: str = "label") -> DataFrame:
    """``rows`` with canonical_id, distance and two (it names two outlets) of its labels; every row comes out once."""
    box = cut(outlets.resolve(rows, column)).withColumnRenamed("label", "__label")
    return rows.join(broadcast_if_small(box), F.col(column) == F.col("__label"), "left").drop("__label")


def open_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, row_id, label): the labels to be mapped."""
    al = table(spark, folder, "question_aliases").where("status = 'needs_review'").select(F.lit("question_aliases").alias("tbl"), F.col("alias_id").alias("row_id"), F.col("alias").alias("label"))
    ids = table(spark, folder, "outlet_registry").select(F.col("canonical_id").alias("outlet_final")).dropna().distinct()
    att = table(spark, folder, "attendance").select("attendance_row", "outlet_final").where("outlet_final is not null")
    att = att.join(broadcast_if_small(ids), "outlet_final", "left_anti").select(F.lit("attendance").alias("tbl"), F.col("attendance_row").alias("row_id"), F.col("outlet_final").alias("label"))
    return al.unionByName(att)


def p5_outlets(spark: SparkSession, folder: str) -> DataFrame:
    """Every open label with its outlet and distance, or as unmatched."""
    out = match_labels(open_labels(spark, folder), build_index(spark, folder))
    return out.select("tbl", "row_id", "label", F.coalesce("canonical_id", F.lit(UNMATCHED)).alias("canonical_id"), "distance")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every open label with the outlet it means, or unmatched."""
    return p5_outlets(spark, folder).select("tbl", F.col("row_id").cast("long").alias("row_id"), "canonical_id")


QUERIES = {"p5_found": p5_found}
ORACLES: dict[str, str] = {}
