"""Standing lines of a source: lines that return in many of its texts, and texts without them.

Lines are compared by a template: words without accents, letter case, spacing and marks, with links,
numbers, months and names written with a capital inside the line replaced by a place holder. A line all
in capitals or all in small letters shows no names; it is held against the templates of its source, whose
place holders then stand for one to six words.

A capital at the head of a line may begin a sentence or a name. Such a line is counted twice, under its template
and under its head template, whose first word is a place holder; either makes it a standing line.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.heavy import SourceSets, candidates, short_key
from panelwright.session import broadcast_if_small, cut
from panelwright.sources.tables import table

#: A standing line is in so many rows at least, and in this share of its source's rows with text.
MIN_ROWS = 5
MIN_SHARE = 0.1
#: Error of the summaries as a share of a source's rows; part of the rest is left to lines without letter case.
EPS = 0.02
CASELESS_SHARE = 0.04
#: A head template says more than the standing lines under it if this share of its rows holds another line of it.
VARIES = 0.2

# Months in Spanish, English and Portuguese, without accents.
MONTHS = set(
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "january february march april may june july august september october november december "
    "janeiro fevereiro marco abril maio junho julho setembro outubro novembro dezembro".split()
)
_TOKEN = re.compile(r"(?i:https?://|www\.)\S+|\d+|[^\W\d_]+")
_LINKS = re.compile(r"(?i:https?://|www\.)\S+")
_LINK = re.compile(r"(?i)https?://|www\.")
HOLE = "#"
#: Place holder of a name at the head of a line.
HEAD = "@"


@functools.lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """Small letters without accents."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


@functools.lru_cache(maxsize=400_000)
def _token(word: str) -> tuple[str, str, str]:
    """What a token becomes at the head of a line, inside a line with letter case, and inside one without."""
    if word[0].isdigit() or _LINK.match(word):
        return HOLE, HOLE, HOLE
    f = fold(word)
    inside = HOLE if f in MONTHS else f
    return f, (HOLE if word[0].isupper() else inside), inside


def template(line: str) -> tuple[str, bool]:
    """The line's template, and whether its letter case shows which words are names."""
    if not line.isascii() and not unicodedata.is_normalized("NFC", line):
        line = unicodedata.normalize("NFC", line)
    words = _TOKEN.findall(line)
    if not words:
        return "", False
    # Letter case shows names in a line of both cases; the letters of links say nothing.
    bare = _LINKS.sub(" ", line) if "//" in line or "www." in line or "WWW." in line else line
    cased = not (bare.isupper() or bare.islower())
    k = 1 if cased else 2
    last = _token(words[0])[0]
    out = [last]
    for w in words[1:]:
        w = _token(w)[k]
        if w != HOLE or last != HOLE:
            out.append(w)
        last = w
    return " ".join(out), cased


def head_template(line: str, key: str, cased: bool) -> str | None:
    """The template of a line, known to be ``key``, if its first word is a name; None if it cannot be or nothing is left."""
    if not cased or key.startswith(HOLE):
        return None
    m = _TOKEN.search(line)
    if not m[0][0].isupper():
        return None
    words = key.split(" ")[1:]
    if words and words[0] == HOLE:
        words = words[1:]
    return " ".join([HEAD, *words]) if words else None


def keys_of(text: str) -> set[str]:
    """Keys of a text's lines, head templates among them; lines of nothing but marks and place holders have none."""
    out = set()
    for line in text.split("\n"):
        if line and not line.isspace():
            k, cased = template(line)
            if k and k != HOLE:
                out.add(short_key(k))
                h = head_template(line, k, cased)
                if h:
                    out.add(short_key(h))
    return out


def first_words(keys: set[str]) -> tuple[frozenset[str], frozenset[str]] | None:
    """The words that keys begin with, and those after the name of head templates; None if a key does not show its words."""
    if any(k.startswith("\x02") for k in keys):
        return None
    return frozenset(k.split(" ", 1)[0] for k in keys), frozenset(k.split(" ", 2)[1] for k in keys if k.startswith(HEAD))


def begins(line: str, firsts: tuple[frozenset[str], frozenset[str]] | None) -> bool:
    """Whether a line begins like one of the keys; a quick test before its template is made."""
    if firsts is None or HOLE in firsts[0]:
        return True
    if not line.isascii():
        line = unicodedata.normalize("NFC", line)
    m = _TOKEN.search(line)
    if m is None:
        return False
    if _token(m[0])[0] in firsts[0]:
        return True
    if not firsts[1]:
        return False
    # Without letter case, the words of a name do not show; nor does the case of a line with links at once.
    if line.isupper() or line.islower() or _LINK.search(line):
        return True
    if m[0][0].isupper():
        for x in _TOKEN.finditer(line, m.end()):
            w = _token(x[0])[1]
            if w != HOLE:
                return w in firsts[1]
    return False


def _matcher(keys: set[str]):
    """The templates with place holders that a line without letter case fits: the first that is no head template, and all head templates."""
    holes = sorted(k for k in keys if not k.startswith("\x02") and (k.startswith(HEAD) or HOLE in k.split(" ")))
    if not holes:
        return lambda line_key: (None, ())
    by_first: dict[str, list] = {}
    for k in holes:
        pattern = " ".join(r"\S+(?: \S+){0,5}" if w in (HOLE, HEAD) else re.escape(w) for w in k.split(" "))
        by_first.setdefault(k.split(" ")[0], []).append((re.compile(pattern), k))

    def match(line_key: str) -> tuple[str | None, tuple[str, ...]]:
        first = line_key.split(" ", 1)[0]
        found = next((k for rx, k in [*by_first.get(first, ()), *by_first.get(HOLE, ())] if rx.fullmatch(line_key)), None)
        return found, tuple(k for rx, k in by_first.get(HEAD, ()) if rx.fullmatch(line_key))

    return match


def held(line: str, own: set[str], match) -> tuple[str | None, tuple[str, ...]]:
    """The key of ``own`` that a line carries, and its head templates in ``own``; without letter case, a template with place holders comes first."""
    k, cased = template(line)
    if not k:
        return None, ()
    found, heads = (None, ()) if cased else match(k)
    h = head_template(line, k, cased)
    if h and (h := short_key(h)) in own:
        heads = (h,)
    if found:
        return found, heads
    k = short_key(k)
    return (k if k in own else None), heads


def line_hits(df: DataFrame, row_id: str, source: str, text: str, sets: SourceSets) -> DataFrame:
    """(row_id, source, line_no, key, heads): the lines that carry a key of their source or head templates of it."""
    id_type = df.schema[row_id].dataType.simpleString()
    get = sets.getter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict = {}
        for b in batches:
            ids, src, nos, keys, heads = [], [], [], [], []
            for i, s, t, given in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if not t or t.isspace():
                    continue
                own = get(s, given)
                if not own:
                    continue
                match = matchers.get(s)
                if match is None:
                    if len(matchers) > 500:
                        matchers.clear()
                    match = matchers[s] = (_matcher(own), first_words(own))
                match, firsts = match
                for no, line in enumerate(t.split("\n")):
                    if not line or not begins(line, firsts):
                        continue
                    k, h = held(line, own, match)
                    if k or h:
                        ids.append(i), src.append(s), nos.append(no), keys.append(k), heads.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(src, pa.string()), pa.array(nos, pa.int32()), pa.array(keys, pa.string()), pa.array(heads, pa.list_(pa.string()))], names=["__id", "source", "line_no", "key", "heads"])

    rows = sets.rows(df.select(F.col(row_id).alias("__id"), F.col(source).cast("string").alias("__src"), F.col(text).alias("__text")), "__src")
    hits = rows.select("__id", "__src", "__text", "__keys").mapInArrow(run, f"__id {id_type}, source string, line_no int, key string, heads array<string>")
    return hits.withColumnRenamed("__id", row_id)


def standing_lines(df: DataFrame, row_id: str = "article_row", source: str = "source_id", text: str = "main_text", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """(lines, templates): (row_id, source, line_no, key) of every standing line, and (source, key, n, n_rows).

    Lines are the pieces between "\\n", numbered from 0. Null and blank texts have none and count as no row.
    A row counts once for a line it repeats. A null source is a source of its own. An empty table gives none.
    """
    found = cut(candidates(df, source, text, keys_of, min_share - CASELESS_SHARE, EPS))
    hits = cut(line_hits(df, row_id, source, text, SourceSets(found)))
    totals = broadcast_if_small(found.select(F.col("source").alias("__s"), F.col("key").alias("__k"), "n_rows"))
    of_key = F.col("source").eqNullSafe(F.col("__s")) & (F.col("key") == F.col("__k"))
    often = (F.col("n") >= min_rows) & (F.col("n") >= F.col("n_rows") * min_share)
    # Repeats within a row are rare: distinct rows are counted by partial aggregation before the shuffle.
    counts = hits.where("key is not null").select(row_id, "source", "key").distinct().groupBy("source", "key").agg(F.count("*").alias("n"))
    sure = cut(counts.join(totals, of_key).drop("__s", "__k").where(often))
    # A head template that only repeats standing lines says nothing of their first word; other lines must be among its rows.
    known = broadcast_if_small(sure.select(F.col("source").alias("__s"), F.col("key").alias("__k"), F.lit(0).alias("__other")))
    heads = hits.where(F.size("heads") > 0).join(known, of_key, "left").select(row_id, "source", F.explode("heads").alias("key"), F.coalesce("__other", F.lit(1)).alias("other"))
    heads = heads.groupBy(row_id, "source", "key").agg(F.max("other").alias("other")).groupBy("source", "key").agg(F.count("*").alias("n"), F.sum("other").alias("others"))
    heads = heads.where(F.col("others") >= F.col("n") * VARIES).drop("others").join(totals, of_key).drop("__s", "__k").where(often)
    sure = cut(sure.unionByName(heads))
    few = broadcast_if_small(sure.select(F.col("source").alias("__s"), F.col("key").alias("__k")))
    # A line may carry several keys and is one line: its template comes first.
    keys = F.concat(F.when(F.col("key").isNull(), F.array().cast("array<string>")).otherwise(F.array("key")), "heads")
    each = hits.select(row_id, "source", "line_no", F.posexplode(keys).alias("__at", "key")).join(few, of_key, "left_semi")
    return each.groupBy(row_id, "source", "line_no").agg(F.min_by("key", "__at").alias("key")), sure


def without_standing_lines(df: DataFrame, row_id: str = "article_row", source: str = "source_id", text: str = "main_text") -> DataFrame:
    """(row_id, text): each text without its standing lines; null stays null, other lines keep their order."""
    _, sure = standing_lines(df, row_id, source, text)
    sets = SourceSets(cut(sure.select("source", "key")))
    id_type = df.schema[row_id].dataType.simpleString()
    get = sets.getter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict = {}
        for b in batches:
            out = []
            for s, t, given in zip(*(b.column(k).to_pylist() for k in range(1, 4)), strict=True):
                own = get(s, given)
                if t and own:
                    match = matchers.get(s) or matchers.setdefault(s, _matcher(own))
                    t = "\n".join(x for x in t.split("\n") if not any(held(x, own, match)))
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["__id", "text"])

    rows = sets.rows(df.select(F.col(row_id).alias("__id"), F.col(source).cast("string").alias("__src"), F.col(text).alias("__text")), "__src")
    return rows.select("__id", "__src", "__text", "__keys").mapInArrow(run, f"__id {id_type}, text string").select(F.col("__id").alias(row_id), F.col("text").alias(text))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each standing line of articles.main_text."""
    lines, _ = standing_lines(table(spark, folder, "articles"))
    return lines.select("article_row", "line_no")


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """articles.main_text without standing lines."""
    return without_standing_lines(table(spark, folder, "articles"))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
ORACLES: dict[str, str] = {}
