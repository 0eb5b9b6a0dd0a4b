"""Links between the spellings of one person or organisation.

Names are compared as sets of letter q-grams of their words by a prefix-filtered join, rarest q-grams first.
Candidates are verified by a soft similarity of words in which rare words count more; persons also by what
else the row says of them. Rows that say exactly the same are merged first, and links become classes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.graph import components
from panelwright.llm.names import KINDS, LINKS, compact, core, expand, plain, rotations, spoken, tokens, weighted_distance
from panelwright.llm.outlets import UNMATCHED, build_index, match_labels
from panelwright.llm.setjoin import grams, similar_sets
from panelwright.session import broadcast_if_small, cut
from panelwright.sources.tables import table

# Short names in use for given names.
NICKNAMES = {
    "nacho": "ignacio", "paco": "francisco", "pancho": "francisco", "chela": "graciela", "lola": "dolores", "beto": "roberto", "neto": "ernesto",
    "gaby": "gabriela", "bety": "beatriz", "betty": "beatriz", "paty": "patricia", "rafa": "rafael", "mary": "maria", "lupita": "guadalupe", "lupe": "guadalupe",
    "pepe": "jose", "memo": "guillermo", "lety": "leticia", "tere": "teresa", "concha": "concepcion", "conchita": "concepcion", "tono": "antonio", "toño": "antonio",
    "quique": "enrique", "kike": "enrique", "chucho": "jesus", "chuy": "jesus", "manolo": "manuel", "meme": "manuel", "charly": "carlos", "lalo": "eduardo",
    "chava": "salvador", "fer": "fernando", "nando": "fernando", "ale": "alejandra", "isa": "isabel", "chabela": "isabel", "susy": "susana", "susi": "susana",
    "meche": "mercedes", "cuco": "refugio", "cuca": "refugio", "tencha": "hortensia", "rosy": "rosa", "rosi": "rosa", "chelo": "consuelo", "rodo": "rodolfo",
    "javi": "javier", "fito": "rodolfo", "anita": "ana", "juanito": "juan", "lucho": "luis", "güicho": "luis", "guicho": "luis", "lulu": "lourdes", "vicky": "victoria",
}
TITLES = frozenset("lic ing dr dra mtro mtra c sr sra srita srta prof profa arq cp don dona d".split())
#: Remarks that name nobody.
REMARKS = frozenset(
    "independiente freelance free lance por su cuenta por cuenta propia cuenta propia n a na no aplica ninguno ninguna sin medio s d sd pendiente por confirmar "
    "invitado invitada especial estudiante publico general pool de prensa comunicacion social desconocido no identificado particular reportero reportera libre varios otro otros x".split()
)
#: Link score of persons from which two records are one person.
PERSON_LINK = 2.0
#: The most that two names are worth, and if their numbers of words differ or are under three.
BEST_NAME, BEST_PARTIAL = 2.5, 1.4
#: Rows of a class that are paired with all of it in one part.
CLASS_PART = 5_000
WORD_JACCARD = 0.25
#: Plain edits between two alike words: exchanged neighbours are two each, and two of them lie within the bound of names.
WORD_EDITS = 4
#: The words of a name that are left out of the search weigh less than this share of all.
REST = 0.35
JOINED_JACCARD = 0.5
NAME_MOST = 2.2


# ---- organisations -------------------------------------------------------------------------------------------


def remark(label: str) -> bool:
    """Whether a label holds no word that could be a name."""
    w = tokens(label)
    return not any(len(x) >= 2 and not x.isdigit() for x in w) or all(x in REMARKS or x.isdigit() for x in w)


_LONG_KINDS = tuple(k for k in KINDS if len(k) >= 4)


def name_keys(label: str, places: frozenset[str]) -> tuple[str, list[str], list[str]]:
    """(name as joined letters, keys that equal names share, words) of an organisation's label."""
    ways = [(x, n) for x, n in spoken(label, places) if n <= 3]
    keys: list[str] = []
    best: list[str] = []
    single = bool(ways) and " " not in ways[0][0]
    for x, _ in ways:
        e = expand(x.split())
        own = [w for w in e if w not in LINKS]
        if not any(w not in KINDS and len(w) >= 3 for w in own) or len(compact(own)) < 6:
            continue
        # One word that is left of several is a name run together only if no kind of medium was taken from it: what is
        # left without its kind is a place that many media share.
        lost = set(ways[0][0].split()) - set(x.split())
        if len(own) < 2 and not single and any(expand([w])[0] in KINDS for w in lost) and not own[0].startswith(_LONG_KINDS):
            continue
        best = e
        keys += [core(e), compact(e)]
        if len(own) > 1:
            keys.append("~".join(sorted(own)))
            keys += [core(r) for r in rotations(own)[1:]] if len(own) <= 4 else []
    keys = list(dict.fromkeys(keys))
    if not keys:
        # Too short or too plain for slips: the same name is still the same, unless only a kind of medium is named.
        own = [w for w in expand(tokens(label)) if w not in LINKS]
        if any(w not in KINDS for w in own) and len(own) <= 4:
            keys = ["=" + compact(own)]
    return (core(best) if best else ""), keys, [w for w in best if w not in LINKS]


def _kind_of(words: list[str]) -> str | None:
    """The kind of medium a name begins or ends with, if it shows one."""
    for w in (words[0], words[-1]):
        if w in KINDS:
            return w
    if len(words) == 1:
        return next((k for k in sorted(KINDS, key=len, reverse=True) if words[0].startswith(k)), None)
    return None


def _name_distance(a: str, wa: list[str], b: str, wb: list[str]) -> float | None:
    """Distance of two names as joined letters in any turn; None if too far, or if kind of medium or figures differ."""
    ka, kb = _kind_of(wa), _kind_of(wb)
    if ka and kb and ka != kb:
        return None
    if min(len(a), len(b)) < 9:
        d = weighted_distance(a, b, 1.0)
        return d if d <= 1.0 else None
    # Turned names are looked at only where the order as it stands does not fit.
    best = weighted_distance(a, b, NAME_MOST)
    if best > NAME_MOST:
        best = min(weighted_distance(a, "".join(r), NAME_MOST) for r in rotations(list(wb)))
    if best > NAME_MOST:
        return None
    figures = [sorted(x for x in w if x.isdigit()) for w in (wa, wb)]
    if len(wa) > 1 and len(wb) > 1 and figures[0] and figures[1] and figures[0] != figures[1]:
        return None
    if best >= FAR_START and len(wa) > 1 and len(wb) > 1 and not set(max(wa, key=len)[:2]) & set(max(wb, key=len)[:2]):
        return None
    return best


def alike_words(vocabulary: DataFrame, edits: int = WORD_EDITS, jaccard: float = WORD_JACCARD) -> DataFrame:
    """(a, b) in both directions and with itself: words (w) no farther apart than names may be and no more than so many
    plain edits, found by their q-grams."""

    def with_grams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"id": p["w"], "grams": [grams([w]) for w in p["w"]]})

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p[may_be_alike(p["a"].tolist(), p["b"].tolist(), False)]
            yield p[[weighted_distance(a, b, NAME_MOST) <= NAME_MOST for a, b in zip(p["a"], p["b"], strict=True)]]

    pairs = similar_sets(vocabulary.mapInPandas(with_grams, "id string, grams array<string>"), jaccard)
    pairs = pairs.where(F.levenshtein("a", "b", edits) >= 0).select("a", "b")
    pairs = cut(pairs.mapInPandas(near, "a string, b string"))
    return cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(vocabulary.select(F.col("w").alias("a"), F.col("w").alias("b"))))


def from_rarer(alike: DataFrame, counts: DataFrame) -> DataFrame:
    """Each pair of alike words (a, b) once, from the one in fewer names (w, c): a slip goes to the word that many bear,
    never the many to all their slips."""
    c = counts.select("w", "c")
    both = alike.join(c.select(F.col("w").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("w").alias("b"), F.col("c").alias("cb")), "b")
    return both.where((F.col("ca") < F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("a") <= F.col("b")))).select("a", "b")


def _met_once() -> Column:
    """Whether names x and y that meet at word v of y count here: of a shared word one order, of two alike words the one way."""
    return F.when(F.col("x.w") == F.col("x.v"), F.col("x.id") < F.col("y.id")).otherwise(F.col("x.id") != F.col("y.id"))


def rarest_words(each: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, w): the rarest words of each name (id, w), up to where the others weigh less than REST of all.

    Alike names share one of these words, but for a slip; counts: (w, weight). Words under four letters do not search
    for slips, and at all only where a name has no longer ones.
    """
    weighed = each.join(counts, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("weight", "w")), asc=False).alias("o"), F.sum("weight").alias("total"))
    before = F.expr("aggregate(slice(o, 1, k), 0D, (s, y) -> s + y.weight)")
    short = F.forall("o", lambda x: F.length(x["w"]) < 4)
    first = weighed.select("id", "total", "o", short.alias("short"), F.posexplode("o").alias("k", "x"))
    first = first.where(F.col("short") | (F.col("total") - before >= F.col("total") * REST)).select("id", F.col("x.w").alias("w"), "short")
    return cut(first.where(F.col("short") | (F.length("w") >= 4)).select("id", "w"))


@lru_cache(maxsize=200_000)
def _letter_counts(name: str) -> bytes:
    """How often a name has each letter and figure."""
    out = bytearray(36)
    for c in name:
        k = ord(c) - 97 if "a" <= c <= "z" else ord(c) - 22 if "0" <= c <= "9" else -1
        if k >= 0 and out[k] < 255:
            out[k] += 1
    return bytes(out)


def may_be_alike(a: list[str], b: list[str], strict: bool = True) -> np.ndarray:
    """Whether two names may be within the greatest distance, whatever the order of their words; strict: less for short ones.

    An edit of two letters' counts costs at least 0.7, one of a single letter's at least 0.7, and a turn changes none.
    """
    if not len(a):
        return np.zeros(0, bool)
    x, y = (np.frombuffer(b"".join(_letter_counts(s) for s in z), np.uint8).reshape(-1, 36).astype(np.int16) for z in (a, b))
    apart = np.abs(x - y).sum(axis=1)
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    short = np.minimum(la, lb) < 9
    most = np.where(short & strict, 1.0, NAME_MOST)
    d = np.abs(la - lb)
    return apart <= d + 2 * np.floor(np.maximum(most - 0.7 * d, 0) / 0.7 + 1e-9)


def soft_similarity(wa: list[str], xa: list[float], wb: list[str], xb: list[float]) -> float:
    """Share of the weight of two names' words that have an alike word in the other, weighed by how alike they are.

    Rare words weigh more (xa, xb). Words run together are met by the joined letters of neighbours.
    """
    left = list(range(len(wb)))
    got = 0.0
    for i in sorted(range(len(wa)), key=lambda i: -xa[i]):
        best = max(((_word_alike(wa[i], wb[j]), -j) for j in left), default=(0.0, 0))
        if best[0] > 0:
            left.remove(-best[1])
            got += best[0] * (xa[i] + xb[-best[1]])
    return got / max(sum(xa) + sum(xb), 1e-9)


def spelling_facts(forms: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(forms with the weights of their words, (w, c, weight) of all words, how often a slip is usually written)."""
    forms = forms.where("name <> ''")
    # How often a slip is written: of all forms the lower quarter, so that a table repeated k times gives the same.
    slip = forms.agg(F.percentile_approx("n", 0.25)).first()[0] or 1
    n = forms.count()
    each = forms.select("id", F.explode(F.array_distinct("words")).alias("w"))
    counts = cut(each.groupBy("w").agg(F.count("*").alias("c"))).withColumn("weight", F.log(F.lit(float(max(n, 2)) + 1) / F.col("c")))
    weight = each.join(counts, "w").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "weight"))).alias("of"))
    return cut(forms.join(weight, "id").withColumn("weights", F.transform("words", lambda w: F.element_at("of", w))).drop("of")), counts, slip


def spelling_candidates(forms: DataFrame, counts: DataFrame, word_edits: int = WORD_EDITS, word_jaccard: float = WORD_JACCARD) -> DataFrame:
    """(a, b): pairs of names that share an alike word among their rarest ones, found by a prefix-filtered join on the
    q-grams of words, and of names run together with all others, found by their own q-grams. What tells early that two
    names are too far apart (length, letters in order, mark) goes with their words into the join."""

    def with_grams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "grams": [grams([*w]) for w in p["words"]], "alone": p["alone"]})

    letters = F.array_join(F.array_sort(F.split("name", "")), "")
    each = forms.select("id", F.explode(F.array_distinct("words")).alias("w"))
    alike = alike_words(counts.where(F.length("w") >= 4).select("w"), word_edits, word_jaccard)
    facts = forms.select("id", F.length("name").alias("len"), letters.alias("letters"), "mark")
    words = rarest_words(each, counts.select("w", "weight")).join(facts, "id")
    near = words.join(from_rarer(alike, counts), F.col("w") == F.col("a")).select("id", "len", "letters", "mark", "w", F.col("b").alias("v"))
    near = near.unionByName(words.where(F.length("w") < 4).select("id", "len", "letters", "mark", "w", F.col("w").alias("v")))
    most = 2 * int(NAME_MOST / 0.7)
    x, y = near.alias("x"), words.alias("y")
    d = F.abs(F.col("x.len") - F.col("y.len"))
    close = (d <= most // 2) & F.coalesce(F.levenshtein("x.mark", "y.mark") <= 1, F.lit(True))
    # An edit that changes the length changes one letter in order, another one two at most.
    apart = F.levenshtein("x.letters", "y.letters", most)
    close = close & (apart >= 0) & (apart <= most - d)
    pairs = x.join(y, (F.col("v") == F.col("y.w")) & _met_once() & close).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    # Names run together have no words of their own: they are compared as one word with the joined forms of all.
    joined = forms.select("id", F.array("name").alias("words"), (F.size("words") == 1).alias("alone"))
    joined = joined.mapInPandas(with_grams, "id string, grams array<string>, alone boolean")
    return cut(pairs.unionByName(similar_sets(joined, JOINED_JACCARD, asks="alone").select("a", "b")).distinct())


def spelling_distance(a: tuple, b: tuple, slip: float) -> float | None:
    """Distance of two spellings (name, words, weights, times written) of one name; None if they are not."""
    (na, wa, xa, ma), (nb, wb, xb, mb) = a, b
    d = _name_distance(na, wa, nb, wb)
    if d is None:
        return None
    lo, hi = min(ma, mb), max(ma, mb)
    if (lo >= OFTEN * slip and hi < OFTEN_LEAD * lo) or (lo > slip and d >= FAR and hi < FAR_LEAD * lo):
        return None
    # Words that run together or are split differently are judged by their letters alone.
    if len(wa) == len(wb) > 1 and soft_similarity(wa, xa, wb, xb) < SOFT:
        return None
    return d


def spelling_links(forms: DataFrame, word_edits: int = WORD_EDITS, word_jaccard: float = WORD_JACCARD) -> DataFrame:
    """(a, b): each spelling with the one it is a slip of; forms: (id, name, words, n, mark), one row for each name.

    ``n`` says how often a form is written. Forms whose ``mark`` is known and more than one letter apart are never linked.
    Candidates are verified by the soft similarity of their words, in which rare words weigh more, and by the distance
    of their letters. What depends on how often a form is written depends on ratios only. ``word_edits``, ``word_jaccard``:
    how far apart the word they share may be; less where names are close to one another and codes tie most slips.
    """
    forms, counts, slip = spelling_facts(forms)
    pairs = spelling_candidates(forms, counts, word_edits, word_jaccard)
    columns = ("id", "name", "words", "n", "mark", "weights")
    left = forms.select(*[F.col(c).alias(f"{c}_a") for c in columns])
    right = forms.select(*[F.col(c).alias(f"{c}_b") for c in columns])
    both = pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b")).where(F.coalesce(F.levenshtein("mark_a", "mark_b") <= 1, F.lit(True)))

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p[may_be_alike(p["name_a"].tolist(), p["name_b"].tolist())]
            out = []
            for a, b, na, wa, xa, ma, nb, wb, xb, mb in zip(*(p[c] for c in ("a", "b", "name_a", "words_a", "weights_a", "n_a", "name_b", "words_b", "weights_b", "n_b")), strict=True):
                d = spelling_distance((na, [*wa], [*xa], ma), (nb, [*wb], [*xb], mb), slip)
                if d is not None:
                    out.append((a, b, ma, mb, d))
            yield pd.DataFrame(out, columns=["a", "b", "n_a", "n_b", "d"]).astype({"a": "object", "b": "object", "n_a": "int64", "n_b": "int64", "d": "float64"})

    near = cut(both.mapInPandas(verify, "a string, b string, n_a long, n_b long, d double"))
    # A spelling belongs to the nearest of those written more often; so a slip that lies between two names links only one.
    swap = (F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    way = near.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("n_a", "n_b").alias("n"), "d")
    return way.groupBy("a").agg(F.min_by("b", F.struct(F.col("d"), -F.col("n"), F.col("b"))).alias("b"))


def organisation_classes(labels: DataFrame, places: frozenset[str]) -> DataFrame:
    """(label, org): the class of each distinct label that may name one organisation; others do not come out."""

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [(x, n, *name_keys(x, places)) for x, n in zip(p["label"], p["n"], strict=True) if not remark(x)]
            yield pd.DataFrame([g for g in got if g[3]], columns=["label", "n", "name", "keys", "words"])

    distinct = labels.select("label").dropna().groupBy("label").agg(F.count("*").alias("n"))
    named = cut(distinct.mapInPandas(keyed, "label string, n long, name string, keys array<string>, words array<string>"))
    # Labels that share a key: each is linked to the least label of the key, never to all others.
    each = named.select("label", F.explode("keys").alias("key"))
    least = each.groupBy("key").agg(F.min("label").alias("a"), F.count("*").alias("m")).where("m > 1")
    same = each.join(least, "key").select("a", F.col("label").alias("b")).where("a <> b").distinct()
    # Alike names: the distinct joined forms, by q-grams.
    forms = cut(named.where("name <> ''").groupBy("name").agg(F.min("label").alias("id"), F.sum("n").alias("n"), F.min_by("words", "label").alias("words")).withColumn("mark", F.lit(None).cast("string")))
    alike = spelling_links(forms)
    # Cut names: a name that is the start of another, at most so many letters short, belongs to it if it has one such.
    longer = forms.select(F.col("id").alias("b"), "name").where(F.length("name") >= CUT_LEAST + 1)
    starts = longer.select("b", F.explode(F.expr(f"transform(sequence(greatest({CUT_LEAST}, length(name) - {CUT_MOST}), length(name) - 1), k -> substring(name, 1, k))")).alias("start"))
    cuts = forms.select(F.col("id").alias("a"), F.col("name").alias("start")).join(starts, "start").select("a", "b")
    links = cut(same.unionByName(alike))
    roots = components(links)
    cuts = cuts.join(roots.select(F.col("id").alias("b"), F.col("root")), "b", "left").withColumn("root", F.coalesce("root", "b"))
    only = cuts.groupBy("a").agg(F.count_distinct("root").alias("m"), F.min("root").alias("b")).where("m = 1").select("a", "b")
    roots = components(cut(links.unionByName(only)))
    return named.select("label").join(roots, F.col("label") == F.col("id"), "left").select("label", F.coalesce("root", "label").alias("org"))


#: Two names that are both written so many times as often as a slip usually is are not slips of each other, unless one is
#: written so many times as often as the other.
OFTEN, OFTEN_LEAD = 3, 4
#: Nor are names so far apart, if both are written more often than a slip usually is, without such a lead.
FAR, FAR_LEAD = 1.7, 8
#: Least soft similarity of the words of two spellings of one name.
SOFT = 0.5
#: Nor are names so far apart whose longest words begin with other letters: slips seldom change both.
FAR_START = 1.5
#: Letters of a name cut short, at least, and letters it lacks, at most.
CUT_LEAST, CUT_MOST = 9, 12


# ---- persons -------------------------------------------------------------------------------------------------


def person_words(name: str | None) -> list[str]:
    """Words of a person's name: without titles and marks, nicknames as the given names they stand for."""
    if not name:
        return []
    w = [x for x in re.findall(r"[a-z]+", plain(name))]
    while w and w[0] in TITLES and len(w) > 2:
        w = w[1:]
    return [NICKNAMES.get(x, x) for x in w if x not in ("de", "del", "la", "los", "y")]


def _word_alike(a: str, b: str) -> float:
    """1 for the same word, less for a slip, half for an initial; 0 for different words."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 0.0
    n = min(len(a), len(b))
    most = 1.0 if n < 4 else 1.8 if n == 4 else 2.0
    d = weighted_distance(a, b, most)
    if d <= most:
        return max(0.6, 1 - d / max(n, 5))
    if n >= 4 and (a.startswith(b) or b.startswith(a)):
        return 0.7
    return 0.0


def person_alike(a: list[str], b: list[str], weight) -> float:
    """How much two names speak for one person: 2.5 all words the same, 2 with slips, 1.2 with words missing, 0.9 the same
    words that many bear; 0 against."""
    left, pairs = list(range(len(b))), []
    for i in sorted(range(len(a)), key=lambda i: (len(a[i]) == 1, -weight(a[i]))):
        best = max(((_word_alike(a[i], b[j]), j) for j in left), default=(0.0, -1))
        if best[0] > 0:
            left.remove(best[1])
            pairs.append((i, best[1], best[0]))
    open_a, open_b = len(a) - len(pairs), len(left)
    if open_a and open_b:
        return 0.0
    # A word that tells persons apart, a family name, must be among the pairs, and not only as an initial.
    telling = [s for i, j, s in pairs if s >= 0.6 and max(weight(a[i]), weight(b[j])) >= TELLING and len(a[i]) > 2 and len(b[j]) > 2]
    full = all(s >= 0.99 for _, _, s in pairs)
    if not telling:
        # A full name of words that many bear is one person's only with the same telephone or organisation.
        return SAME_COMMON if full and not open_a and not open_b and len(pairs) >= 2 else 0.0
    if not open_a and not open_b and len(pairs) >= 3:
        if full:
            return 2.5
        return 2.0 if all(s >= 0.6 for _, _, s in pairs) else 1.3
    return (1.2 if full else 1.0) + (0.2 if len(telling) >= 2 else 0.0)


#: Weight (natural logarithm of rows per row with the word) from which a word tells persons apart.
TELLING = 4.6
#: A word of so few names tells persons apart in a small table too.
FEW = 3
#: What the same full name of common words is worth: not enough with the same place alone.
SAME_COMMON = 0.9


def _tel_evidence(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 2.0
    if len(a) == len(b):
        diff = [i for i in range(len(a)) if a[i] != b[i]]
        if len(diff) == 1:
            return 0.2
        if len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]:
            return 1.0
    return -2.0


def _place_evidence(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b or weighted_distance(a, b, 2.0) <= 2.0 else -1.0


def _most_evidence() -> Column:
    """The most that a pair of records x and y can be worth from all but its names, and with the best of names."""
    both = lambda c, e: F.when(F.col(f"x.{c}").isNull() | F.col(f"y.{c}").isNull(), 0.0).otherwise(e)
    apart = lambda c: F.levenshtein(f"x.{c}", f"y.{c}")
    tel = both("tel", F.when(apart("tel") == 0, 2.0).when(apart("tel") <= 2, 1.0).otherwise(-2.0))
    # Exchanged neighbours are two plain edits each; two of them are still one place.
    place = both("place", F.when(apart("place") <= 4, 1.0).otherwise(-1.0))
    org = both("org", F.when(F.col("x.org") == F.col("y.org"), 1.5).otherwise(-0.5))
    name = F.when((F.col("x.k") == F.col("y.k")) & (F.col("x.k") >= 3), BEST_NAME).otherwise(BEST_PARTIAL)
    return name + tel + place + org


def _may_be_word(a: Column, b: Column) -> Column:
    """Whether ``_word_alike`` of two words may be above 0: two slips, of which an exchange is two plain edits and changes
    no letter."""
    in_order = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    apart = F.levenshtein(a, b, 4)
    mixed = F.levenshtein(in_order(a), in_order(b))
    slip = ((apart >= 0) & (apart <= 2)) | ((apart == 3) & (mixed <= 2)) | ((apart == 4) & (mixed == 0))
    shorter = F.least(F.length(a), F.length(b))
    return F.when(shorter == 1, F.substring(a, 1, 1) == F.substring(b, 1, 1)).otherwise(slip | ((shorter >= 4) & (a.startswith(b) | b.startswith(a))))


def _may_be_name() -> Column:
    """Whether each word of the shorter of two names x and y (ws) has one in the other that it may be: else the names speak
    against one person."""
    within = lambda a, b: F.forall(a, lambda w: F.exists(b, lambda u: _may_be_word(w, u)))
    return F.when(F.col("x.k") <= F.col("y.k"), within("x.ws", "y.ws")).otherwise(within("y.ws", "x.ws"))


def person_candidates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b), records with ``tells``, the words of each name that tell persons apart): pairs of records (id, words, place,
    tel, org) that share an alike word among the rarest of their names and could be one person by their other words and all
    else that is known."""
    # How rare a word is: counted over distinct names, so that one person with many rows does not make it common.
    names = cut(records.select("words").distinct())
    n = names.count()
    split = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.split("words", " "))).alias("w"))
    counts = cut(split(names).groupBy("w").agg(F.count("*").alias("c"))).withColumn("weight", F.log(F.lit(float(max(n, 2))) / F.col("c")))
    each = split(names, F.col("words").alias("id"))
    alike = alike_words(counts.where(F.length("w") >= 4).select("w"))
    rare = rarest_words(each, counts).select(F.col("id").alias("words"), "w")
    tells = split(names, "words").join(counts.where((F.col("weight") >= TELLING) | (F.col("c") <= FEW)), "w").groupBy("words").agg(F.collect_list("w").alias("tells"))
    records = cut(records.join(tells, "words", "left"))
    # What else is known goes with the words into the join, so that pairs that no name can save are never built.
    facts = [F.col(c) for c in ("id", "place", "tel", "org")]
    ws = F.split("words", " ")
    words = records.join(rare, "words").select(*facts, "w", ws.alias("ws"), F.size(ws).alias("k"))
    near = words.join(from_rarer(alike, counts), F.col("w") == F.col("a")).select(*facts, "w", "ws", "k", F.col("b").alias("v"))
    near = near.unionByName(words.where(F.length("w") < 4).select(*facts, "w", "ws", "k", F.col("w").alias("v")))
    x, y = near.alias("x"), words.alias("y")
    pairs = x.join(y, (F.col("v") == F.col("y.w")) & _met_once() & (_most_evidence() >= PERSON_LINK) & _may_be_name())
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return cut(pairs), records


def person_evidence(a: tuple, b: tuple) -> tuple[float, bool]:
    """(what two records (words, place, tel, org, tells) are worth as one person, whether more than the name speaks for it)."""
    (wa, pa, ta, oa, ra), (wb, pb, tb, ob, rb) = a, b
    more = [_tel_evidence(ta, tb), _place_evidence(pa, pb), 0.0 if not oa or not ob else 1.5 if oa == ob else -0.5]
    if BEST_NAME + sum(more) < PERSON_LINK:
        return 0.0, False
    rare = {*(() if ra is None else ra), *(() if rb is None else rb)}
    s = person_alike(wa.split(" "), wb.split(" "), lambda w: TELLING + 1 if w in rare else 1.0)
    return (s + sum(more) if s else 0.0), max(more) > 0.5


def person_classes(rows: DataFrame) -> DataFrame:
    """(row_id, person) of rows (row_id, name, place, tel, org): persons told apart by name and what else is known.

    Rows whose name is null or has less than two words do not come out.
    """

    def cleaned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            words = [" ".join(person_words(x)) for x in p["name"]]
            place = [" ".join(tokens(x)) if x else None for x in p["place"]]
            tel = ["".join(c for c in x if c.isdigit()) or None if x else None for x in p["tel"]]
            out = pd.DataFrame({"row_id": p["row_id"], "words": words, "place": place, "tel": tel, "org": p["org"]})
            yield out[[" " in w for w in words]]

    clean = cut(rows.mapInPandas(cleaned, "row_id long, words string, place string, tel string, org string"))
    # Rows that say the same are one record; its number is its least row.
    same = ["words", "place", "tel", "org"]
    records = cut(clean.groupBy(*same).agg(F.min("row_id").alias("id")))
    pairs, records = person_candidates(records)
    more = [*same, "tells"]
    left = records.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in more])
    right = records.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in more])
    both = pairs.join(left, "a").join(right, "b")

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sides = [zip(*(p[f"{c}_{x}"] for c in more), strict=True) for x in "ab"]
            out = []
            for a, b, x, y in zip(p["a"], p["b"], *sides, strict=True):
                worth, sure = person_evidence(x, y)
                if worth >= PERSON_LINK:
                    out.append((a, b, sure))
            yield pd.DataFrame(out, columns=["a", "b", "sure"]).astype({"a": "int64", "b": "int64", "sure": "bool"})

    links = cut(both.mapInPandas(verify, "a long, b long, sure boolean"))
    roots = cut(components(links.where("sure")))
    records = records.join(roots.select("id", "root"), "id", "left").withColumn("person", F.coalesce("root", "id"))
    # Links by the name alone join two classes only if nothing known of these differs and neither has another such link.
    known = cut(records.groupBy("person").agg(F.mode("tel", True).alias("tel"), F.mode("place", True).alias("place")))
    side = records.select("id", "person")
    weak = links.where("not sure").join(side.select(F.col("id").alias("a"), F.col("person").alias("pa")), "a").join(side.select(F.col("id").alias("b"), F.col("person").alias("pb")), "b")
    weak = weak.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
    weak = weak.join(known.select(F.col("person").alias("a"), F.col("tel").alias("ta"), F.col("place").alias("la")), "a")
    weak = cut(weak.join(known.select(F.col("person").alias("b"), F.col("tel").alias("tb"), F.col("place").alias("lb")), "b"))
    ends = weak.select(F.col("a").alias("id")).unionByName(weak.select(F.col("b").alias("id"))).groupBy("id").count().where("count > 1").select("id")
    weak = weak.where(F.coalesce(F.col("ta") == F.col("tb"), F.lit(True)) & F.coalesce(F.col("la") == F.col("lb"), F.lit(True)))
    weak = weak.join(ends.withColumnRenamed("id", "a"), "a", "left_anti").join(ends.withColumnRenamed("id", "b"), "b", "left_anti")
    merged = weak.select(F.col("b").alias("old"), F.col("a").alias("new"))
    records = records.join(merged, F.col("person") == F.col("old"), "left").withColumn("person", F.coalesce("new", "person")).select("id", *same, "person")
    on = [clean[c].eqNullSafe(records[c]) for c in same]
    return clean.join(records, on).select(clean["row_id"], "person")


def class_pairs(rows: DataFrame, kind: str, row_id: str, group: str) -> DataFrame:
    """(kind, id_a, id_b), id_a < id_b, of the rows of each class.

    A class of many rows is joined in parts: each row meets the rows of every part, and no task has all pairs of a class.
    """
    ids = cut(rows.select(F.col(group).alias("g"), F.col(row_id).alias("i")))
    size = ids.groupBy("g").agg(F.ceil(F.count("*") / CLASS_PART).cast("int").alias("parts")).where("parts > 1")
    ids = ids.join(broadcast_if_small(size), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = ids.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("i").alias("id_a"))
    y = ids.select("g", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int").alias("part"), F.col("i").alias("id_b"))
    return x.join(y, ["g", "part"]).where("id_a < id_b").select(F.lit(kind).alias("kind"), F.col("id_a").cast("long").alias("id_a"), F.col("id_b").cast("long").alias("id_b"))


def variant_classes(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """(row_id, class) of the rows of each kind that name somebody."""
    accred = table(spark, folder, "accreditations").select(F.col("accred_id").alias("row_id"), F.col("reporter").alias("name"), F.col("estado").alias("place"), F.col("tel_final").alias("tel"), F.col("medios").alias("label"))
    index = build_index(spark, folder)
    orgs = cut(organisation_classes(accred, index.places))
    rows = cut(accred.join(broadcast_if_small(orgs), "label", "left"))
    people = person_classes(rows.select("row_id", "name", "place", "tel", "org"))
    open_ = table(spark, folder, "question_aliases").where("status = 'needs_review' and alias is not null").select(F.col("alias_id").alias("row_id"), F.col("alias").alias("label"))
    # Labels of two organisations name no single one.
    pool = cut(match_labels(open_, index).where((F.col("canonical_id") == UNMATCHED) & ~F.col("two")).select("row_id", "label"))
    classes = organisation_classes(pool, index.places)
    return {
        "reporter": people.select("row_id", F.col("person").alias("class")),
        "medios": rows.where("org is not null").select("row_id", F.col("org").alias("class")),
        "alias": pool.join(broadcast_if_small(cut(classes)), "label").select("row_id", F.col("org").alias("class")),
    }


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows that mean the same person or organisation."""
    return functools.reduce(DataFrame.unionByName, [class_pairs(c, kind, "row_id", "class") for kind, c in variant_classes(spark, folder).items()])


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each row that names somebody with its class, the least row that means the same, and the number of its links."""
    out = []
    for kind, c in variant_classes(spark, folder).items():
        c = cut(c)
        of = c.groupBy("class").agg(F.min("row_id").alias("class_id"), (F.count_distinct("row_id") - 1).alias("links"))
        out.append(c.join(broadcast_if_small(of), "class").select(F.lit(kind).alias("kind"), F.col("row_id").cast("long").alias("row_id"), F.col("class_id").cast("long").alias("class_id"), "links"))
    return functools.reduce(DataFrame.unionByName, out)


QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes}
ORACLES: dict[str, str] = {}
