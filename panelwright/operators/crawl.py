"""Discoveries, work queues and stable ids of a crawl."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.keys import canonical_url, slug
from panelwright.operators.aggregates import first_seen_unique
from panelwright.operators.windows import best_row


def discovery_url(source: Column, url: Column, folds: dict[str, tuple[str, str]] | None = None) -> Column:
    """Canonical URL of a discovery. ``folds``: for a source, a pattern of paths and the host of their one true form:
    such URLs are ``https``, that host, and the path without an end slash, query and fragment."""
    out = canonical_url(url)
    path = F.regexp_extract(out, r"^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    for name, (pattern, host) in sorted((folds or {}).items()):
        out = F.when((source == name) & path.rlike(f"(?i){pattern}"), F.concat(F.lit(f"https://{host}"), F.regexp_replace(path, "/+$", ""))).otherwise(out)
    return out


def merge_discoveries(
    rows: DataFrame, source: str, url: str, strategy: str, seen: str, priority: dict[str, int], keep: list[str], order: str,
    capture: str | None = None, index: str | None = None, folds: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """One row a source and canonical URL: the fields of the row of the best strategy (the first of equals), all
    strategies, best first and then as they came, first and last time seen, and the number of rows.

    A missing strategy is ``unknown``; one without a priority comes last. ``capture``, a stamp of 14 figures, gives
    the first and last day it was captured; ``index`` the number of distinct indexes that hold it. Rows whose URL
    has no host are left out.
    """
    rank = F.create_map(*[F.lit(x) for kv in sorted(priority.items()) for x in kv])
    d = rows.withColumn("canonical", discovery_url(F.col(source), F.col(url), folds)).where("canonical is not null")
    d = d.withColumn(strategy, F.coalesce(strategy, F.lit("unknown")))
    d = d.withColumn("__p", F.coalesce(F.try_element_at(rank, F.col(strategy)), F.lit(9)))
    first = F.struct("__p", order)
    more = []
    if capture:
        day = F.to_date(F.try_to_timestamp(F.col(capture).cast("string"), F.lit("yyyyMMddHHmmss")))
        more += [F.min(day).alias("first_capture"), F.max(day).alias("last_capture")]
    if index:
        more.append(F.count_distinct(index).alias("n_indexes"))
    return d.groupBy(source, "canonical").agg(
        F.count("*").alias("n_rows"), first_seen_unique(F.col(strategy), first).alias("strategies"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"),
        F.min_by(url, first).alias(url), F.min_by(strategy, first).alias(strategy), *[F.min_by(c, first).alias(c) for c in keep if c != strategy], *more,
    )


def work_queue(found: DataFrame, done: DataFrame, source: str, url: str, order: list, retry_errors: bool = False, refresh_empty: bool = False, limit: int | None = None) -> DataFrame:
    """Found URLs that are not done, best first: without those that ended well, and without failed or empty ones
    unless they are to be tried again. ``done``: (source, url, status int, error, main_text, scrape_timestamp)."""
    last = best_row(done, [source, url], [F.desc("scrape_timestamp")])
    failed = (F.coalesce(F.col("status"), F.lit(0)) != 200) | (F.coalesce(F.trim("error"), F.lit("")) != "")
    empty = ~failed & (F.trim(F.coalesce("main_text", F.lit(""))) == "")
    again = F.lit(False)
    again = again | failed if retry_errors else again
    again = again | empty if refresh_empty else again
    skip = last.where(~again).select(source, url)
    q = best_row(found, [source, url], order).join(skip, [source, url], "left_anti")
    q = q.orderBy(*order)
    return q.limit(limit) if limit is not None else q


def latest_rows(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return best_row(rows, keys, order)


def stable_ids(rows: DataFrame, name: str, second: str, order: str, out: str = "stable_id") -> DataFrame:
    """A slug id for each row: that of ``name``; where rows share it, with ``second`` added, then with a number.

    Rows with one base are settled together in the order of a unique column; a base is a few rows.
    """
    base = F.coalesce(slug(F.col(name)), F.lit("x"))
    d = rows.withColumn("__b", base)
    n = F.count("*").over(Window.partitionBy("__b"))
    wide = F.when(n == 1, F.col("__b")).otherwise(F.concat_ws("-", "__b", slug(F.col(second))))
    d = d.withColumn("__w", wide)
    k = F.row_number().over(Window.partitionBy("__w").orderBy(order))
    return d.withColumn(out, F.when(k == 1, F.col("__w")).otherwise(F.concat_ws("-", "__w", k.cast("string")))).drop("__b", "__w")


def recommend(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    out = None
    for test, label in rules:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def group_lists(df: DataFrame, key: str, value: str, fn, schema: str) -> DataFrame:
    """``fn`` of (key, list of values) in Arrow batches: for procedures over a short list of each key."""
    g = df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(value))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.concat([fn(k, [*v]) for k, v in zip(p[key], p[value], strict=True)] or [pd.DataFrame()])

    return g.mapInPandas(run, schema)


def wordpress_posts(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, post_id, url, slug, title, published, modified) of pages of a posts interface; broken pages give none."""
    kind = "array<struct<id:bigint,link:string,slug:string,date_gmt:string,modified_gmt:string,title:struct<rendered:string>>>"
    p = df.select(key, F.explode(F.from_json(payload, kind)).alias("p"))
    return p.select(key, F.col("p.id").alias("post_id"), F.col("p.link").alias("url"), "p.slug", F.col("p.title.rendered").alias("title"), F.col("p.date_gmt").alias("published"), F.col("p.modified_gmt").alias("modified"))


def news_index_articles(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, url, title, seendate, domain, language, sourcecountry, socialimage) of answers of a news index."""
    kind = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string,socialimage:string>>>"
    return df.select(key, F.explode(F.from_json(payload, kind)["articles"]).alias("a")).select(key, "a.*")


def archive_captures(df: DataFrame, line: str) -> DataFrame:
    """(captured_at, url, mime, status, digest) of lines of an archive's index: key, stamp, url, mime, status, digest."""
    w = F.split(F.trim(line), " ")
    from panelwright.functions.dates import capture_time

    ok = (F.size(w) >= 6) & F.get(w, F.lit(1)).rlike(r"^\d{14}$")
    return df.where(ok).select(capture_time(F.get(w, F.lit(1))).alias("captured_at"), F.get(w, F.lit(2)).alias("url"), F.get(w, F.lit(3)).alias("mime"), F.get(w, F.lit(4)).try_cast("int").alias("status"), F.get(w, F.lit(5)).alias("digest"))


def quota_plan(n_requests: int, cost: int, keys: int, quota: int) -> list[tuple[int, int]]:
    """(key number, requests) for a pool of keys with a quota each, in order; raises if the pool is too small. A plan."""
    each, left, out = quota // cost, n_requests, []
    for k in range(keys):
        if left <= 0:
            break
        out.append((k, min(each, left)))
        left -= each
    if left > 0:
        raise ValueError(f"{left} requests are beyond the quota of {keys} keys")
    return out
