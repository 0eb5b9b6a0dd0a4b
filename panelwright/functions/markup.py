"""JSON, HTML and feeds: native expressions where they do, Arrow batches with the standard library's parsers where not."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_field(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def tag_text(c: Column, tag: str) -> Column:
    """Text of the first element of a tag, squished; NULL if there is none."""
    got = F.regexp_extract(c, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(got, r"<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def meta_content(c: Column, name: str) -> Column:
    """Content of the first meta element with a name or property, whichever attribute comes first; NULL if none."""
    a = F.regexp_extract(c, rf"""(?is)<meta\b[^>]*?\b(?:name|property)\s*=\s*["']{name}["'][^>]*?\bcontent\s*=\s*(["'])(.*?)\1""", 2)
    b = F.regexp_extract(c, rf"""(?is)<meta\b[^>]*?\bcontent\s*=\s*(["'])(.*?)\1[^>]*?\b(?:name|property)\s*=\s*["']{name}["']""", 2)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def link_href(c: Column, rel: str) -> Column:
    a = F.regexp_extract(c, rf"""(?is)<link\b[^>]*?\brel\s*=\s*["']{rel}["'][^>]*?\bhref\s*=\s*(["'])(.*?)\1""", 2)
    b = F.regexp_extract(c, rf"""(?is)<link\b[^>]*?\bhref\s*=\s*(["'])(.*?)\1[^>]*?\brel\s*=\s*["']{rel}["']""", 2)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def first_of(*columns: Column) -> Column:
    """The first of several values that is not NULL or blank: the precedence of fields."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


# Public schema type names of articles.
ARTICLE_TYPES = frozenset(("article", "newsarticle", "reportagenewsarticle", "blogposting", "opinionnewsarticle"))


def article_json(html: str | None) -> dict | None:
    """The first article-typed item of the JSON-LD blocks of a page, lists and @graph unfolded; broken blocks are passed over."""
    if not html:
        return None
    for block in re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html):
        try:
            todo = [json.loads(block)]
        except ValueError:
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = [*x, *todo]
            elif isinstance(x, dict):
                kinds = x.get("@type")
                if any(str(k).lower() in ARTICLE_TYPES for k in (kinds if isinstance(kinds, list) else [kinds])):
                    return x
                if "@graph" in x:
                    todo = [x["@graph"], *todo]
    return None


class _Blocks(HTMLParser):
    """Text of block elements, with the share of it that stands in links."""

    BLOCKS = frozenset(("article", "main", "section", "div", "td", "body"))
    SKIP = frozenset(("script", "style", "nav", "footer", "aside", "form", "header", "noscript"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = []
        self.done: list[list] = []
        self.skip = self.link = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "a":
            self.link += 1
        elif tag in self.BLOCKS:
            self.stack.append([tag, [], 0, 0])
        elif tag == "p" and self.stack:
            self.stack[-1][3] += 1

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in self.BLOCKS and any(s[0] == tag for s in self.stack):
            while self.stack:
                s = self.stack.pop()
                self.done.append(s)
                if s[0] == tag:
                    break

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not self.skip and self.stack:
            self.stack[-1][1].append(text)
            self.stack[-1][2] += len(text) if self.link else 0


def main_text(html: str | None) -> str | None:
    """Text of the block with the best score: its own length less that in links, and more for paragraphs and article tags."""
    if not html:
        return None
    p = _Blocks()
    p.feed(html)
    p.close()
    best, score = None, 0.0
    for tag, texts, linked, n_par in [*p.done, *reversed(p.stack)]:
        size = sum(map(len, texts))
        s = (size - 2 * linked) * (1.5 if tag in ("article", "main") else 1.0) + 25 * n_par
        if texts and s > score:
            best, score = "\n".join(texts), s
    return best


def author_names(author: object, sep: str = "; ") -> str | None:
    """Names of the authors of an article item, each once and in order, joined; NULL if there is none."""
    names: dict[str, None] = {}
    for a in author if isinstance(author, list) else [author]:
        name = a.get("name") if isinstance(a, dict) else a
        for n in name if isinstance(name, list) else [name]:
            if isinstance(n, str) and n.strip(" "):
                names[n.strip(" ")] = None
    return sep.join(names) or None


def json_ld(df: DataFrame, key: str, html: str, keep: list[str] | None = None, with_main_text: bool = False) -> DataFrame:
    """(key, keep..., headline, published, modified, authors[, main_text]) of the first article item of a page's JSON-LD.

    Rows without such an item, with null or broken pages keep NULLs; every row comes out once.
    """
    keep = keep or []
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [key, *keep]) + ", headline string, published string, modified string, authors string, main_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(article_json(h) or {}, h) for h in b.column(b.num_columns - 1).to_pylist()]
            text = lambda k: pa.array([x.get(k) if isinstance(x.get(k), str) else None for x, _ in rows], pa.string())  # noqa: B023, E731
            out = [text("headline"), text("datePublished"), text("dateModified"), pa.array([author_names(x.get("author")) for x, _ in rows], pa.string())]
            main = pa.array([main_text(h) if with_main_text else None for _, h in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out, main], names=[key, *keep, "headline", "published", "modified", "authors", "main_text"])

    got = df.select(key, *keep, html).mapInArrow(run, schema)
    return got if with_main_text else got.drop("main_text")


def page_fields(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, published, author, canonical, main_text): JSON-LD first, then meta tags, then elements.

    Native expressions take the tags before the page goes through the parser once; only fields come back.
    """
    h = F.col(html)
    native = df.select(
        key, first_of(meta_content(h, "og:title"), tag_text(h, "h1"), tag_text(h, "title")).alias("__title"),
        first_of(meta_content(h, "article:published_time"), F.regexp_extract(h, r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']([^"']+)""", 1)).alias("__date"),
        meta_content(h, "author").alias("__author"), first_of(link_href(h, "canonical"), meta_content(h, "og:url")).alias("canonical"), h.alias("__html"),
    )
    j = json_ld(native, key, "__html", ["__title", "__date", "__author", "canonical"], with_main_text=True)
    return j.select(
        key, first_of(F.col("headline"), F.col("__title")).alias("title"), first_of(F.col("published"), F.col("__date")).alias("published"),
        first_of(F.col("authors"), F.col("__author")).alias("author"), "canonical", "main_text",
    )


def feed_entries(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, kind, entry_no, url, title, date) of RSS, Atom, sitemap and sitemap-index documents; broken ones give none."""
    import xml.etree.ElementTree as ET

    kind = df.schema[key].dataType.simpleString()
    kinds = {"item": "rss", "entry": "atom", "url": "sitemap", "sitemap": "index"}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = lambda t: t.rsplit("}", 1)[-1].lower()
        for p in parts:
            out = []
            for k, x in zip(p[key], p[xml], strict=True):
                try:
                    root = ET.fromstring(x) if x else None
                except ET.ParseError:
                    continue
                n = 0
                for e in root.iter() if root is not None else ():
                    if (what := kinds.get(local(e.tag))) is None:
                        continue
                    got: dict[str, str] = {}
                    for c in e.iter():
                        name, text = local(c.tag), (c.text or "").strip()
                        if name == "link" and c.get("href"):
                            text = c.get("href")
                        if text:
                            got.setdefault(name, text)
                    url = got.get("loc") or got.get("link")
                    if url:
                        out.append((k, what, n, url, got.get("title"), got.get("lastmod") or got.get("publication_date") or got.get("pubdate") or got.get("updated") or got.get("published")))
                        n += 1
            yield pd.DataFrame(out, columns=[key, "kind", "entry_no", "url", "title", "date"])

    return df.select(key, xml).mapInPandas(run, f"`{key}` {kind}, kind string, entry_no int, url string, title string, date string")


def duration_seconds(c: Column) -> Column:
    """Seconds of an ISO-8601 duration of days to seconds; NULL for other texts."""
    g = lambda u: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, rf"(\d+){u}", 1), F.lit("")), F.lit("999999")), F.lit(0)).cast("long")
    return F.when(c.rlike(r"^P(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$"), g("D") * 86400 + g("H") * 3600 + g("M") * 60 + g("S"))


def names_of_ids(rows: DataFrame, key: str, ids: str, sep: str, names: DataFrame, ident: str, name: str, out: str) -> DataFrame:
    """``rows`` with the names of the ids in a delimited cell, in their order, joined by ``", "``; unknown ids fall away."""
    from panelwright.session import broadcast_if_small

    each = rows.select(key, F.posexplode(F.split(ids, sep)).alias("__k", "__id")).withColumn("__id", F.trim("__id"))
    j = each.join(broadcast_if_small(names.select(F.col(ident).cast("string").alias("__id"), F.col(name).alias("__n"))), "__id")
    got = j.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__k", "__n"))).alias("__l"))
    return rows.join(got.select(key, F.array_join(F.transform("__l", lambda x: x["__n"]), ", ").alias(out)), key, "left")


def page_flags(c: Column, patterns: dict[str, str]) -> Column:
    """Array of the names of patterns that are in a page, in their order."""
    return F.filter(F.array(*[F.when(c.rlike("(?is)" + p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())
