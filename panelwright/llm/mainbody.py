"""Main body of a web page by line-block distribution, with the furniture of each site taken out.

Markup is stripped and the lengths of lines are summed over a sliding window of neighbouring lines. Where the
curve of these sums surges a block of text begins, where it dives for some lines on end the block ends; blocks
with a fair share of the page's text are its body. Two corrections go with it: the furniture of a site, found from
all its pages as lines that a large share of its different pages hold, has no length in the curve; and inside a
block, lines that are neither running text nor a subheading between two pieces of it are outside the body again.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.heavy import ALL, SourceSets, candidates, short_key
from panelwright.session import broadcast_if_small, cut
from panelwright.sources.tables import table

#: Lines of a window (odd); characters of a window where a block begins, and below which it ends (on a page whose curve
#: stays lower, its highest point and half of that); and the lines on end that must lie below for that.
WINDOW = 3
SURGE_CHARS, DIVE_CHARS = 80, 40
DIVE_LINES = 6
#: A block is of the body if it has this share of the running text of the largest one.
BLOCK_SHARE = 0.25
#: A line is furniture of a site in this share of its different pages, of which there are so many at least.
SITE_SHARE = 0.15
SITE_PAGES = 5
#: A line is furniture anywhere if it is in this share of the pages of two sites with so many pages.
ANY_SHARE = 0.3
ANY_PAGES = 20
ANY_SITES = 2
EPS = 0.02
#: A short line of so many pages, in this share of all pages, is a subheading if it mostly stands between running text.
SUBHEAD_PAGES = 5
SUBHEAD_SHARE = 0.001
BETWEEN_SHARE = 0.6

_TAG = re.compile(r"<[^<>]{1,300}>")
_SENTENCE_END = re.compile(r"""[.!…]['"”’»)\]]*$|[.!?…]['"”’»)\]]+[.]?$""")
_LINK_MARK = re.compile(r"^(?:»|›|→|►|▸|\[|\d{1,2}\. )")
_INNER_END = re.compile(r"""[.!?…]['"”’»)]* \W*\w""")
_SUBHEAD_WORDS = 4


_FIGURES = re.compile(r"\d+")


def _line_key(line: str) -> str:
    if not line.isascii() and not unicodedata.is_normalized("NFKC", line):
        line = unicodedata.normalize("NFKC", line)
    return short_key(" ".join(_FIGURES.sub("#", line.casefold()).split()).strip(" .,:;!-–—|·•*"))


#: Short lines return often; their keys are kept.
_short_line_key = functools.lru_cache(maxsize=300_000)(_line_key)


def line_key(line: str) -> str:
    """A line without letter case, marks at its ends and the figures in it."""
    return _short_line_key(line) if len(line) <= 90 else _line_key(line)


def page_keys(text: str) -> tuple[set[str], set[str]]:
    """Keys of a page's lines, and of its short ones."""
    own, short = set(), set()
    for x in text.split("\n"):
        if x and not x.isspace() and (k := line_key(x)):
            own.add(k)
            if len(x) <= 90 and len(x.split()) <= _SUBHEAD_WORDS + 2:
                short.add(k)
    return own, short


def _plain_line(line: str) -> str:
    return " ".join((_TAG.sub(" ", line) if "<" in line else line).split())


def keyed_lines(text: str, own: set[str]) -> tuple[list[str], list[str]]:
    """Keys of ``own`` in a text, and those of them that stand between two lines of running text."""
    lines = [y for x in text.split("\n") if (y := _plain_line(x))]
    keys = [line_key(x) for x in lines]
    running = [_running(x) and k not in own for x, k in zip(lines, keys, strict=True)]
    found = {k for k in keys if k in own}
    between = {k for a, k, b in zip(running, keys[1:], running[2:], strict=False) if a and b and k in found}
    return list(found), list(between)


_WORDY = re.compile(r"\S*[^\W\d_]\S*")


def _words(s: str) -> int:
    return len(_WORDY.findall(s)) if len(s) < 200 else max(14, s.count(" "))


def _reads_on(s: str) -> bool:
    """Whether a line reads as running text: sentences, list items and quotations, not headlines or labels."""
    if _LINK_MARK.match(s):
        return False
    n = _words(s)
    # Only the end of a line says whether it ends a sentence.
    if n >= 3 and _SENTENCE_END.search(s[-12:]) and not s.endswith(("...", "?»", "?")) and not (s[-1] in "»”\"" and _headline_quote(s)):
        return True
    return n >= 14 and bool(_INNER_END.search(s))


_short_reads_on = functools.lru_cache(maxsize=300_000)(_reads_on)


def _running(s: str) -> bool:
    return _short_reads_on(s) if len(s) <= 90 else _reads_on(s)


def _headline_quote(s: str) -> bool:
    """`The name: «the quotation»` without a full stop after the quotation."""
    return bool(re.search(r"""[:] ?[«"“][^«»"“”]*[»"”]$""", s)) and not s.rstrip("»”\"").endswith((".", "!"))


def _subheading(s: str) -> bool:
    if _LINK_MARK.match(s) or s.startswith(("#", "©", "-", "—", "@")) or any(c in s for c in ":|>/·@©"):
        return False
    w = s.split()
    return 1 <= len(w) <= _SUBHEAD_WORDS or (len(w) <= _SUBHEAD_WORDS + 2 and not s.endswith("?") and all(x[:1].isupper() for x in w[-2:]) and sum(x[:1].islower() for x in w[1:]) <= 2)


def blocks(lengths: list[int]) -> list[tuple[int, int]]:
    """(first, last) line of each block between a surge point and a dive point of the curve of window sums."""
    n, half = len(lengths), WINDOW // 2
    sums = [0] * (n + 1)
    for k in range(n):
        sums[k + 1] = sums[k] + lengths[k]
    curve = [sums[min(n, k + half + 1)] - sums[max(0, k - half)] for k in range(n)]
    surge = min(SURGE_CHARS, max(curve, default=0))
    dive = min(DIVE_CHARS, surge / 2)
    out: list[tuple[int, int]] = []
    start = last = -1
    for k, here in enumerate(curve):
        if start >= 0 and here < dive and k - last > DIVE_LINES:
            out.append((start, last))
            start = -1
        if here and here >= (dive if start >= 0 else surge):
            start, last = (start if start >= 0 else k), k
    return [*out, (start, last)] if start >= 0 else out


def body_lines(text: str, is_furniture, is_subheading) -> tuple[set[int], list[int]]:
    """(numbers of the body's lines, numbers of all non-blank lines) of a page's text."""
    lines = [(i, y) for i, x in enumerate(text.split("\n")) if (y := _plain_line(x))]
    n = len(lines)
    keys = [line_key(x) for _, x in lines]
    known = [is_subheading(k) for k in keys]
    furniture = [is_furniture(k) and not h for k, h in zip(keys, known, strict=True)]
    spans = blocks([0 if f else len(x) for f, (_, x) in zip(furniture, lines, strict=True)])
    near = {k for a, b in spans for k in range(max(0, a - 3), min(n, b + 4))}
    running = [k in near and not furniture[k] and _running(lines[k][1]) for k in range(n)]
    weight = [sum(len(lines[k][1]) for k in range(a, b + 1) if running[k]) for a, b in spans]
    body: set[int] = set()
    for (a, b), total in zip(spans, weight, strict=True):
        if not total or total < BLOCK_SHARE * max(weight):
            continue
        body.update(k for k in range(a, b + 1) if running[k])
        # A subheading stands alone between two pieces of running text, furniture left out of account; one known
        # from other pages, next to one piece.
        seen = [k for k in range(max(0, a - 3), min(n, b + 4)) if not furniture[k]]
        for x, k, y in zip([-1, *seen], seen, [*seen[1:], -1], strict=False):
            before, after = x >= 0 and running[x], y >= 0 and running[y]
            if not running[k] and ((known[k] and (before or after)) or (before and after and _subheading(lines[k][1]))):
                body.add(k)
    return {lines[k][0] for k in body}, [i for i, _ in lines]


def page_hash(url: str) -> str:
    """SQL expression of a page's identity: its url without scheme, www, query, fragment and end slash."""
    return f"xxhash64(regexp_replace(regexp_replace(lower(coalesce({url}, '')), '^[a-z]+://(www[.])?', ''), '[?#].*$|/+$', ''))"


def site_furniture(df: DataFrame, source: str, text: str, url: str) -> DataFrame:
    """(kind, source, key): "site" lines that belong to one site, "any" lines that belong to sites in general,
    and "subhead" lines that stand between running text wherever they come; the last two without a source.

    Pages that come several times (the same url but for scheme, query and fragment) count once.
    """
    base = df.select(F.col(source).cast("string").alias("__src"), F.expr(page_hash(f"`{url}`")).alias("__page"), F.col(text).alias("__text"))
    found = cut(candidates(base, "__src", "__text", page_keys, SITE_SHARE * 0.8, EPS, (SUBHEAD_SHARE, SUBHEAD_SHARE / 2)))
    own, short = ~F.col("source").eqNullSafe(F.lit(ALL)), F.col("source").eqNullSafe(F.lit(ALL))
    # Short lines of all sites are in a two-thousandth of all pages at least: no more of them than two thousand times
    # the short lines of a mean page.
    sets, wide_sets = SourceSets(found.where(own)), SourceSets(found.where(short), None)
    get, get_any = sets.getter(), wide_sets.getter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, page, keys, between = [], [], [], []
            for s, p, t, given in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if t and not t.isspace():
                    all_keys, inner = keyed_lines(t, get(s, given) | get_any(ALL, None))
                    src.append(s), page.append(p), keys.append(all_keys), between.append(inner)
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(page, pa.int64()), pa.array(keys, texts), pa.array(between, texts)], names=["source", "page", "keys", "between"])

    pages = sets.rows(base, "__src").select("__src", "__page", "__text", "__keys").mapInArrow(run, "source string, page long, keys array<string>, between array<string>")
    # The null key counts the pages of the source. Distinct pages are found before counting, in two partial steps.
    one = F.transform("keys", lambda k: F.struct(k.alias("key"), F.array_contains("between", k).alias("inner")))
    each = pages.select("source", "page", F.inline(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(False).alias("inner"))), one)))
    each = each.groupBy("source", "key", "page").agg(F.max("inner").alias("inner"))
    counts = cut(each.groupBy("source", "key").agg(F.count("*").alias("n"), F.count_if("inner").alias("n_inner")))
    totals = counts.where("key is null").select(F.col("source").alias("__s"), F.col("n").alias("n_pages"))
    counts = counts.where("key is not null").join(broadcast_if_small(totals), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    inner = F.col("n_inner") >= BETWEEN_SHARE * F.col("n")
    own = counts.where((F.col("n") >= SITE_PAGES) & (F.col("n") >= SITE_SHARE * F.col("n_pages")) & ~inner).select(F.lit("site").alias("kind"), "source", "key")
    wide = counts.where((F.col("n_pages") >= ANY_PAGES) & (F.col("n") >= ANY_SHARE * F.col("n_pages")) & ~inner)
    wide = wide.groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= ANY_SITES).select(F.lit("any").alias("kind"), F.lit(None).cast("string").alias("source"), "key")
    head = counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_inner").alias("n_inner")).where(inner & (F.col("n") >= SUBHEAD_PAGES))
    head = head.where(~F.col("key").rlike(r"^[\[»#]|^#[.)]")).where(F.size(F.split("key", " ")) <= _SUBHEAD_WORDS + 2).select(F.lit("subhead").alias("kind"), F.lit(None).cast("string").alias("source"), "key")
    return own.unionByName(wide).unionByName(head)


def outside_lines(df: DataFrame, row_id: str = "page_row", source: str = "source_id", text: str = "main_text", url: str = "url") -> DataFrame:
    """(row_id, line_no, in_body): every non-blank line of every text, numbered from 0 with blank lines counted.

    Null and blank texts give no rows. Pages with null url or source take part; a null source is a site of
    its own. A page without running text (a listing) has no body, so all its lines are outside.
    """
    kinds = cut(site_furniture(df, source, text, url))
    own_sets = SourceSets(kinds.where("kind = 'site'").select("source", "key"))
    # These are among the short lines of all sites, or in a third of the pages of two sites: bounded as those are.
    others = SourceSets(kinds.where("kind <> 'site'").select(F.col("kind").alias("source"), "key"), None)
    get, get_any = own_sets.getter(), others.getter()
    id_type = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anywhere, heads = get_any("any", None), get_any("subhead", None)
        for b in batches:
            ids, nos, ins = [], [], []
            for i, s, t, given in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if not t or t.isspace():
                    continue
                own = get(s, given)
                body, every = body_lines(t, lambda k, own=own: k in own or k in anywhere, heads.__contains__)
                for no in every:
                    ids.append(i), nos.append(no), ins.append(no in body)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(nos, pa.int32()), pa.array(ins, pa.bool_())], names=["__id", "line_no", "in_body"])

    rows = own_sets.rows(df.select(F.col(row_id).alias("__id"), F.col(source).cast("string").alias("__src"), F.col(text).alias("__text")), "__src")
    return rows.mapInArrow(run, f"__id {id_type}, line_no int, in_body boolean").withColumnRenamed("__id", row_id)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each non-blank line of sitemap_articles.main_text outside the article's body."""
    return outside_lines(table(spark, folder, "sitemap_articles")).where("not in_body").select("page_row", "line_no")


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
