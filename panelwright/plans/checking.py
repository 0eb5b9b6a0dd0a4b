"""Queries of data contracts, sources, sinks and estimates."""

from __future__ import annotations

import os
import re
import sqlite3
import tempfile

from pyspark.sql import functions as F

from panelwright.functions import dates as D
from panelwright.operators import contracts as Q
from panelwright.registry import Registry
from panelwright.session import checkpoint_dir
from panelwright.sources import tables as S
from panelwright.sources.tables import table
from panelwright.stats import effects as R

query = Registry()


def _scratch(spark, name: str) -> str:
    """A folder for what a query writes, in the shared folder of checkpoints."""
    import uuid

    return f"{checkpoint_dir(spark)}/panelwright-{name}-{uuid.uuid4().hex[:8]}"


@query("q1_duplicate_keys", "select fecha, medios, reporter, count(*) as n from attendance group by 1,2,3 having count(*)>1")
def _(spark, d):
    return Q.duplicate_keys(table(spark, d, "attendance"), ["fecha", "medios", "reporter"])


@query("q3_rows_kept", "select count(*) as n from supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    out = Q.require_rows_kept(s, s.join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left"))  # 25 nations
    return out.agg(F.count("*").alias("n"))


@query("q4_no_look_ahead", "select max(fecha) as last_day from attendance")
def _(spark, d):
    return Q.require_before(table(spark, d, "attendance"), "fecha", "2100-01-01").agg(F.max("fecha").alias("last_day"))


@query(
    "q5_missingness",
    "select 'importe' as \"column\", count(*) filter (where estado is not null and importe is null) as null_observed, count(*) filter (where estado is null and importe is not null) as value_unobserved from contracts union all select 'costo', count(*) filter (where estado is not null and costo is null), count(*) filter (where estado is null and costo is not null) from contracts",
)
def _(spark, d):
    return Q.missingness_report(table(spark, d, "contracts"), F.col("estado").isNotNull(), ["importe", "costo"])


@query("q7_domain", "select 'discount' as rule, count(*) filter (where not (l_discount between 0 and 0.05)) as n_broken from lineitem union all select 'quantity', count(*) filter (where not (l_quantity > 0)) from lineitem")
def _(spark, d):
    return Q.domain_report(table(spark, d, "lineitem"), {"discount": F.col("l_discount").between(0, 0.05), "quantity": F.col("l_quantity") > 0})


@query(
    "q8_range_coverage",
    """with t as (select distinct conference_id, source_row from transcript_rows where source_row is not null), r as (select conference_id, min(source_row) as a, max(source_row) as b from t group by 1), c as (select conference_id, unnest(generate_series(a, b)) as source_row from r)
    select c.conference_id, cast(c.source_row as int) as source_row, cast(1 as bigint) as n from c where false union all select coalesce(t.conference_id,c.conference_id), cast(coalesce(t.source_row,c.source_row) as int), 0 from t full join c on t.conference_id=c.conference_id and t.source_row=c.source_row where c.source_row is null""",
)
def _(spark, d):
    t = table(spark, d, "transcript_rows").where("source_row is not null").select("conference_id", "source_row").distinct()
    r = t.groupBy("conference_id").agg(F.min("source_row").alias("a"), F.max("source_row").alias("b"))
    return Q.range_coverage(r, t, "conference_id", "a", "b", "source_row")


@query("q9_orphan_links", "select distinct l_orderkey as o, l_suppkey as s from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus<>'P') or l_suppkey not in (select s_suppkey from supplier where s_suppkey%3<>0)")
def _(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"))
    a = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("o"))
    b = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("s"))
    return Q.orphan_links(links, a, b, "o", "s")


@query("q10_word_conservation", "with t as (select conference_id, source_row, max(word_count) as w from transcript_rows group by 1,2) select sum(w) as by_row, (select sum(s) from (select sum(w) as s from t group by conference_id)) as by_conference from t")
def _(spark, d):
    t = table(spark, d, "transcript_rows").groupBy("conference_id", "source_row").agg(F.max("word_count").alias("w"))
    a, b = t.agg(F.sum("w").alias("by_row")), t.groupBy("conference_id").agg(F.sum("w").alias("s")).agg(F.sum("s").alias("by_conference"))
    return a.join(F.broadcast(b))  # one row each


@query(
    "q11_alias_faults",
    """select 'empty key' as fault, count(*) filter (where alias is null or trim(alias)='') as n from question_aliases union all select 'repeated key', count(*) from (select alias from question_aliases where alias is not null group by 1 having count(*)>1)
    union all select 'unknown status', count(*) filter (where not coalesce(status in ('reviewed','needs_review'),false)) from question_aliases union all select 'id against status', count(*) filter (where (status='reviewed') <> (canonical_id is not null)) from question_aliases""",
)
def _(spark, d):
    return Q.alias_faults(table(spark, d, "question_aliases"), "alias", "status", "canonical_id")


@query("q12_idempotent", "select distinct nullif(trim(regexp_replace(lower(strip_accents(outlet_name)), '[^a-z0-9]+', ' ', 'g')),'') as key from outlet_registry")
def _(spark, d):
    from panelwright.functions.keys import label_key

    names = table(spark, d, "outlet_registry").select(F.col("outlet_name").alias("key")).distinct()
    return Q.require_idempotent(names, lambda x: x.select(label_key(F.col("key")).alias("key")).distinct())


@query("q13_id_changes", "with o as (select outlet_name, outlet_id from outlet_registry), n as (select outlet_name, 1000 + row_number() over (order by outlet_id) as outlet_id from outlet_registry) select o.outlet_name, o.outlet_id as old_id, n.outlet_id as new_id from o join n using (outlet_name) where o.outlet_id<>n.outlet_id")
def _(spark, d):
    from panelwright.operators.panel import dense_numbers

    old = table(spark, d, "outlet_registry").select("outlet_name", "outlet_id")
    new = dense_numbers(old, "outlet_id", "k").select("outlet_name", (F.col("k") + 1000).cast("long").alias("outlet_id"))
    return Q.id_changes(old, new, ["outlet_name"], "outlet_id")


@query("s1_parquet", "select count(*) as n, round(sum(l_extendedprice),2) as total from lineitem")
def _(spark, d):
    return S.parquet(spark, f"{d}/lineitem.parquet").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("s2_pushdown", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '2000-01-01' and l_returnflag='R'")
def _(spark, d):
    return table(spark, d, "lineitem").where((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("s3_csv", "select source_id, source_name, estado from news_sources")
def _(spark, d):
    path = _scratch(spark, "csv")
    table(spark, d, "news_sources").select("source_id", "source_name", "estado").coalesce(1).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return S.text_table(spark, path, "ISO-8859-1")


@query("s4_alias_tsv", "select trim(regexp_replace(alias, '\\s+', ' ', 'g')) as alias, min(canonical_id) as canonical_id, 'reviewed' as status from question_aliases where canonical_id is not null and trim(alias) <> '' group by 1")
def _(spark, d):
    path = _scratch(spark, "tsv")
    t = table(spark, d, "question_aliases").where("canonical_id is not null and trim(alias) <> ''").groupBy(F.trim(F.regexp_replace("alias", r"\s+", " ")).alias("alias")).agg(F.min("canonical_id").alias("canonical_id"))
    t.withColumn("status", F.lit("reviewed")).write.option("header", True).option("sep", "\t").option("quote", "").option("escapeQuotes", False).csv(path)
    return S.alias_table(spark, path)


@query("s5_sheet_header", "select source_id, tz from news_sources")
def _(spark, d):
    t = table(spark, d, "news_sources").select(F.lit(2).alias("a"), F.col("source_id").alias("c0"), F.col("tz").alias("c1"))
    head = spark.createDataFrame([(0, "some title", None), (1, "source_id", "tz")], "a int, c0 string, c1 string")
    return S.sheet_with_header(head.unionByName(t), "a", "c0", "source_id").select("source_id", "tz")


@query("s7_sqlite", "select n_nationkey, n_name from nation")
def _(spark, d):
    # The file lies in the folder that all executors share; it is written by the driver and read in parts.
    base = checkpoint_dir(spark)
    folder = re.sub("^file:/*", "/", base)
    if not os.path.isabs(folder):
        raise RuntimeError(f"{base} is no mounted folder; a SQLite file needs one that all executors can open")
    os.makedirs(folder, exist_ok=True)
    fd, path = tempfile.mkstemp(suffix=".sqlite", dir=folder)
    os.close(fd)
    con = sqlite3.connect(path)
    con.execute("create table nation (n_nationkey integer, n_name text)")
    con.executemany("insert into nation values (?, ?)", [tuple(r) for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect()])
    con.commit()
    con.close()
    return S.sqlite_table(spark, path, "nation", "n_nationkey int, n_name string", "n_nationkey", 4)


@query("s8_json", "select r_regionkey, r_name from region")
def _(spark, d):
    path = _scratch(spark, "json")
    table(spark, d, "region").write.json(path)
    return S.json_lines(spark, path, "r_regionkey int, r_name string")


@query("s9_dated_files", "select fecha, count(*) as n from attendance group by 1")
def _(spark, d):
    path = _scratch(spark, "dated")
    t = table(spark, d, "attendance").select("attendance_row", F.date_format("fecha", "yyyy_MM_dd").alias("day"))
    # One file a day, named by it, as such lists arrive: the date is read from the name and nowhere else.
    folders = S.write_named(t, path, "day", "lista_{}.csv")
    return S.dated_files(spark, folders, form="csv", header=True).groupBy(F.col("file_date").alias("fecha")).agg(F.count("*").alias("n"))


@query("s10_union_by_name", "select source_id, url, title, cast(null as bigint) as wp_post_id from sitemap_articles union all select source_id, url, title, wp_post_id from articles")
def _(spark, d):
    wanted = {"source_id": "string", "url": "string", "title": "string", "wp_post_id": "bigint"}
    return S.union_by_name([table(spark, d, "sitemap_articles"), table(spark, d, "articles")], wanted, {"title": ["headline"]})


@query("s11_completed_parts", "select count(*) as n from nation")
def _(spark, d):
    path = _scratch(spark, "parts")
    table(spark, d, "nation").write.parquet(f"{path}/done")
    table(spark, d, "nation").limit(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/open")
    parts = S.completed_parts(spark, path)
    return spark.read.parquet(*parts).agg(F.count("*").alias("n"))


@query("s12_news_index", "select source_id, url, title, seendate, domain, language, sourcecountry, socialimage from gdelt_urls where source_id is not null")
def _(spark, d):
    from panelwright.operators.crawl import news_index_articles

    t = table(spark, d, "gdelt_urls").where("source_id is not null")
    page = t.select("source_id", (F.col("url_row") % 8).alias("page"), F.struct("url", "title", "seendate", "domain", "language", "sourcecountry", "socialimage").alias("a"))
    answers = page.groupBy("source_id", "page").agg(F.to_json(F.struct(F.collect_list("a").alias("articles"))).alias("payload"))
    return news_index_articles(answers, "source_id", "payload")


@query("s12_posts", "select source_id, wp_post_id as post_id, url, title from articles where wp_post_id is not null and source_id is not null")
def _(spark, d):
    from panelwright.operators.crawl import wordpress_posts

    t = table(spark, d, "articles").where("wp_post_id is not null and source_id is not null")
    post = F.struct(F.col("wp_post_id").alias("id"), F.col("url").alias("link"), F.struct(F.col("title").alias("rendered")).alias("title"))
    pages = t.groupBy("source_id", (F.col("article_row") % 8).alias("page")).agg(F.to_json(F.collect_list(post)).alias("payload"))
    return wordpress_posts(pages, "source_id", "payload").select("source_id", "post_id", "url", "title")


@query("s12_captures", "select url, status, strftime(scrape_timestamp, '%Y-%m-%d %H:%M:%S') as captured_at from sitemap_articles where url not like '% %' and status is not null and scrape_timestamp is not null")
def _(spark, d):
    from panelwright.operators.crawl import archive_captures

    t = table(spark, d, "sitemap_articles").where("url not like '% %' and status is not null and scrape_timestamp is not null")
    line = F.concat_ws(" ", F.lit("key"), F.date_format("scrape_timestamp", "yyyyMMddHHmmss"), "url", F.lit("text/html"), F.col("status").cast("string"), F.lit("DIGEST"))
    return archive_captures(t.select(line.alias("line")), "line").select("url", "status", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"))


@query(
    "s13_quota_plan",
    """with t as (select count(*) as n, cast(ceil(count(*) / 9.0) as bigint) as q from gdelt_urls) select cast(k as int) as key_no, cast(least(q, n - k * q) as int) as n_requests from t, (select unnest(range(10)) as k) where n - k * q > 0""",
)
def _(spark, d):
    from panelwright.operators.crawl import quota_plan

    n = table(spark, d, "gdelt_urls").count()
    return spark.createDataFrame(quota_plan(n, 1, 10, -(-n // 9)), "key_no int, n_requests int")


@query("q6_file_hashes")
def _(spark, d):
    return Q.file_hashes(spark, d, "{nation,region}.parquet")


@query("q2_lookup_contract", "select s_suppkey, n_name from supplier join nation on s_nationkey=n_nationkey")
def _(spark, d):
    from panelwright.operators.joins import lookup

    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return lookup(s, table(spark, d, "nation"), ["n_nationkey"], "inner").select("s_suppkey", "n_name")


@query("s14_cached_lookup", "select distinct estado from contracts where estado is not null and estado not in (select estado from news_sources)")
def _(spark, d):
    cache = table(spark, d, "news_sources").select("estado", F.lit(1).alias("lat")).distinct()
    return S.cached_lookup(table(spark, d, "contracts").select("estado"), cache, ["estado"])[1]


@query("f20_serial_date", "select s_suppkey, cast(date '1899-12-30' + cast(40000 + s_suppkey as int) as date) as day from supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", D.serial_date(40000 + F.col("s_suppkey")).alias("day"))


@query("k2_partitioned_write", "select source_id, count(*) as n from articles where source_id is not null group by 1")
def _(spark, d):
    path = _scratch(spark, "by-source")
    S.write_parquet(table(spark, d, "articles").where("source_id is not null").select("source_id", "article_row"), path, "zstd", ["source_id"])
    return S.parquet(spark, path).groupBy("source_id").agg(F.count("*").alias("n"))


@query("k1_parquet_codecs", "select 'gzip' as codec, count(*) as n, sum(article_row) as total from articles union all select 'zstd', count(*), sum(article_row) from articles")
def _(spark, d):
    out = None
    for codec in ("zstd", "gzip"):
        path = _scratch(spark, codec)
        S.write_parquet(table(spark, d, "articles").select("article_row"), path, codec)
        got = S.parquet(spark, path).agg(F.count("*").alias("n"), F.sum("article_row").alias("total")).select(F.lit(codec).alias("codec"), "n", "total")
        out = got if out is None else out.unionByName(got)
    return out


@query("k3_atomic_replace", "select count(*) as n, max(r_name) as last_name from region")
def _(spark, d):
    # A table is replaced; then a write that fails half-way must leave it as it is.
    path = _scratch(spark, "replace")
    S.replace_table(table(spark, d, "nation").select(F.col("n_name").alias("r_name")), path)
    S.replace_table(table(spark, d, "region").select("r_name"), path)
    broken = table(spark, d, "nation").select(F.when(F.col("n_nationkey") >= 0, F.raise_error(F.lit("stopped"))).cast("string").alias("r_name"))
    try:
        S.replace_table(broken, path)
    except Exception as e:
        if "stopped" not in str(e):
            raise
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.max("r_name").alias("last_name"))


@query(
    "k4_upsert",
    """with o as (select source_id, url, article_row from (select *, row_number() over (partition by source_id, url order by article_row) as k from articles where article_row%2=0) where k=1), n as (select source_id, url, article_row from (select *, row_number() over (partition by source_id, url order by article_row desc) as k from articles where article_row%2=1) where k=1)
    select * from n union all select * from o where not exists (select 1 from n where n.source_id=o.source_id and n.url=o.url)""",
)
def _(spark, d):
    from panelwright.operators.windows import best_row

    t = table(spark, d, "articles").select("source_id", "url", "article_row")
    old = best_row(t.where("article_row % 2 = 0"), ["source_id", "url"], ["article_row"])
    return S.upsert(old, t.where("article_row % 2 = 1"), ["source_id", "url"], [F.desc("article_row")])


@query("k5_insert_or_ignore", "select source_id, url, min(url_row) as url_row from gdelt_urls g where not exists (select 1 from articles a where a.source_id=g.source_id and a.url=g.url) group by 1,2")
def _(spark, d):
    return S.insert_or_ignore(table(spark, d, "articles").select("source_id", "url"), table(spark, d, "gdelt_urls").select("source_id", "url", "url_row"), ["source_id", "url"], ["url_row"])


# ---- estimates -----------------------------------------------------------------------------------------------


def _sample(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy((F.col("o_custkey") % 60).alias("u"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("t")).agg(
        F.avg("o_totalprice").alias("y"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("x"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("z"), F.max((F.col("o_orderkey") % 97 == 0).cast("int")).alias("d")
    )


_SAMPLE = "select o_custkey % 60 as u, date_trunc('quarter', o_orderdate) as t, avg(o_totalprice) as y, avg(cast(o_orderpriority='1-URGENT' as double)) as x from orders group by 1,2"


def _rows(spark, fit, **extra):
    return spark.createDataFrame([(n, round(float(b), 6), round(float(s), 6), fit.n, fit.clusters) for n, b, s in zip(fit.names, fit.beta, fit.se(), strict=True)], "term string, estimate double, se double, n long, clusters long")


@query(
    "r1_one_way",
    f"""with s as ({_SAMPLE}), k as (select * from s where t in (select t from s group by 1 having count(*)>1)), m as (select u, t, y - avg(y) over (partition by t) as y, x - avg(x) over (partition by t) as x from k),
    b as (select sum(x*y)/sum(x*x) as b, sum(x*x) as xx, count(*) as n, count(distinct t) as nt from m), c as (select sum(x*(y-b*x)) as s from m, b group by u), g as (select count(*) as g, sum(s*s) as meat from c)
    select 'x' as term, round(b,6) as estimate, round(sqrt(g.g/(g.g-1.0)*(n-1.0)/(n-1-nt)*meat/(xx*xx)),6) as se, n, g.g as clusters from b, g""",
)
def _(spark, d):
    return _rows(spark, R.fixed_effects(_sample(spark, d), "y", ["x"], ["t"], ["u"]))


def _panel(spark, d):
    """A balanced panel of 12 units and 7 years; every third unit is treated from 1998 on."""
    o = table(spark, d, "orders")
    cell = o.groupBy((F.col("o_custkey") % 12).cast("int").alias("u"), F.year("o_orderdate").alias("t"))
    cell = cell.agg(F.avg("o_totalprice").alias("y"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("x"), F.avg((F.col("o_orderkey") % 3 == 0).cast("double")).alias("z"))
    return cell.withColumn("d", ((F.col("u") % 3 == 0) & (F.col("t") >= 1998)).cast("int"))


_PANEL = """p as (select cast(o_custkey % 12 as int) as u, year(o_orderdate) as t, avg(o_totalprice) as y, avg(cast(o_orderpriority='1-URGENT' as double)) as x, avg(cast(o_orderkey % 3 = 0 as double)) as z from orders group by 1,2)"""
#: Both effects taken out of a balanced panel in closed form.
_BOTH = "m as (select u, t, {} from p)"
_OUT = "{0} - avg({0}) over (partition by u) - avg({0}) over (partition by t) + avg({0}) over () as {0}"
#: Sums and scores of a regression of y on x and z within years, by unit.
_TWO = (
    _PANEL
    + """, m as (select u, t, y - avg(y) over (partition by t) as y, x - avg(x) over (partition by t) as x, z - avg(z) over (partition by t) as z from p),
    a as (select sum(x*x) as a, sum(x*z) as b, sum(z*z) as c, sum(x*y) as d, sum(z*y) as e, count(*) as n, count(distinct t) as nt from m), k as (select *, (c*d-b*e)/(a*c-b*b) as b1, (a*e-b*d)/(a*c-b*b) as b2, a*c-b*b as det from a),
    s as (select sum(x*(y-b1*x-b2*z)) as sx, sum(z*(y-b1*x-b2*z)) as sz from m, k group by u), q as (select count(*) as g, sum(sx*sx) as m11, sum(sx*sz) as m12, sum(sz*sz) as m22 from s), r as (select *, g/(g-1.0)*(n-1.0)/(n-2-nt) as f from k, q)"""
)


@query(
    "r2_two_way",
    f"""with {_PANEL}, {_BOTH.format(', '.join(_OUT.format(c) for c in 'xy'))}, b as (select sum(x*y)/sum(x*x) as b, sum(x*x) as xx, count(*) as n, count(distinct t) as nt from m), c as (select sum(x*(y-b*x)) as s from m, b group by u), g as (select count(*) as g, sum(s*s) as meat from c)
    select 'x' as term, round(b,6) as estimate, round(sqrt(g.g/(g.g-1.0)*(n-1.0)/(n-nt)*meat/(xx*xx)),6) as se, n, g.g as clusters from b, g""",
)
def _(spark, d):
    return _rows(spark, R.fixed_effects(_panel(spark, d), "y", ["x"], ["u", "t"], ["u"]))


@query("r3_singletons", "with e as (select user_id, value from events where event_type='error'), a as (select * from e where user_id in (select user_id from e group by 1 having count(*)>1)) select user_id, count(*) as n from a group by 1")
def _(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("user_id", "value")
    return R.drop_singletons(e, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("r4_collinear")
def _(spark, d):
    t = _sample(spark, d).withColumn("x2", F.col("x") * 2)
    fit = R.fixed_effects(t, "y", ["x", "x2", "z"], ["t"], ["u"])
    return spark.createDataFrame([(n, "kept") for n in fit.names] + [(n, "dropped") for n in fit.dropped], "term string, status string")


@query(
    "r6_two_way_cluster",
    f"""with {_PANEL}, {_BOTH.format(', '.join(_OUT.format(c) for c in 'xy'))}, b as (select sum(x*y)/sum(x*x) as b, sum(x*x) as xx, count(*) as n from m), e as (select u, t, x*(y-b*x) as s from m, b),
    v as (select sum(g/(g-1.0)*q*k) as v from (select count(*) as g, sum(s*s) as q, 1 as k from (select sum(s) as s from e group by u) union all select count(*), sum(s*s), 1 from (select sum(s) as s from e group by t) union all select count(*), sum(s*s), -1 from e))
    select 'x' as term, round(b,6) as estimate, round(sqrt(v/(xx*xx)),6) as se, n, (select least(count(distinct u), count(distinct t)) from e) as clusters from b, v""",
)
def _(spark, d):
    return _rows(spark, R.fixed_effects(_panel(spark, d), "y", ["x"], ["u", "t"], ["u", "t"], nested=True))


@query("r7_wald", f"with {_TWO}, w as (select (m22*d*d - 2*m12*d*e + m11*e*e)/(m11*m22-m12*m12)/f/2 as f, g from r) select round(f, 6) as f, 2 as restrictions, round(power(1 + 2*f/(g-1.0), -(g-1.0)/2), 6) as p from w")
def _(spark, d):
    f, k, p = R.fixed_effects(_panel(spark, d), "y", ["x", "z"], ["t"], ["u"]).wald(["x", "z"])
    return spark.createDataFrame([(round(f, 6), k, round(p, 6))], "f double, restrictions int, p double")


@query("r8_contrast", f"with {_TWO}, h as (select *, (c+b)/det as p, -(a+b)/det as q from r) select round(b1-b2, 6) as estimate, round(sqrt(f*(p*p*m11 + 2*p*q*m12 + q*q*m22)), 6) as se from h")
def _(spark, d):
    b, s = R.fixed_effects(_panel(spark, d), "y", ["x", "z"], ["t"], ["u"]).contrast({"x": 1.0, "z": -1.0})
    return spark.createDataFrame([(round(b, 6), round(s, 6))], "estimate double, se double")


_GROUPS = (
    _PANEL
    + """, m as (select u % 3 as g, u, y - avg(y) over (partition by u % 3, t) as y, x - avg(x) over (partition by u % 3, t) as x from p), b as (select g, sum(x*y)/sum(x*x) as b, sum(x*x) as xx, count(*) as n from m group by 1),
    c as (select m.g, u, sum(x*(y-b*x)) as s from m join b using (g) group by 1,2), q as (select g, sum(s*s) as meat from c group by 1), h as (select count(*) as n, count(distinct u) as g, count(distinct (u % 3, t)) as k from p),
    v as (select b.g, b.b, h.g/(h.g-1.0)*(h.n-1.0)/(h.n-3-h.k)*meat/(xx*xx) as v, h.n, h.g as clusters from b join q using (g), h)"""
)


def _interacted(spark, d):
    t = _panel(spark, d).withColumn("g", F.concat(F.lit("g"), (F.col("u") % 3).cast("string")))
    return R.interacted(t, "y", "x", "g", ["g0", "g1", "g2"], ["t"], ["u"])


@query("r9_interacted", f"with {_GROUPS} select 'x:g' || g as term, round(b, 6) as estimate, round(sqrt(v), 6) as se, n, clusters from v")
def _(spark, d):
    return _rows(spark, _interacted(spark, d))


@query("r9_equal_slopes", f"with {_GROUPS}, w as (select sum(b/v)/sum(1/v) as mean from v), f as (select sum((b-mean)*(b-mean)/v)/2 as f, max(clusters) as g from v, w) select round(f, 6) as f, 2 as restrictions, round(power(1 + 2*f/(g-1.0), -(g-1.0)/2), 6) as p from f")
def _(spark, d):
    f, k, p = _interacted(spark, d).equal(["x:g0", "x:g1", "x:g2"])
    return spark.createDataFrame([(round(f, 6), k, round(p, 6))], "f double, restrictions int, p double")


@query("r9_pairs", f"with {_GROUPS} select 'x:g' || a.g as a, 'x:g' || b.g as b, round(a.b-b.b, 6) as difference, round(sqrt(a.v+b.v), 6) as se from v a join v b on a.g < b.g")
def _(spark, d):
    rows = R.pairwise(_interacted(spark, d), ["x:g0", "x:g1", "x:g2"])
    return spark.createDataFrame([(a, b, round(float(x), 6), round(float(s), 6)) for a, b, x, s, _ in rows], "a string, b string, difference double, se double")


@query("r10_missing_patterns", "select contract_id, coalesce(importe,0) as importe, coalesce(cantidad,0) as cantidad, cast(importe is null as int) as missing_importe from contracts")
def _(spark, d):
    out, _ = R.missing_patterns(table(spark, d, "contracts").select("contract_id", "importe", "cantidad"), ["importe", "cantidad"])
    flag = F.col("missing_importe") if "missing_importe" in out.columns else F.lit(0)
    return out.select("contract_id", "importe", "cantidad", flag.alias("missing_importe"))


@query("r11_holm", "with p as (select p_partkey, (p_partkey%97+1)/1000.0 as p from part), n as (select count(*) as n from p), s as (select p_partkey, p, least(1.0, p*(n - row_number() over (order by p, p_partkey) + 1)) as s, row_number() over (order by p, p_partkey) as k from p, n) select p_partkey, round(max(s) over (order by k rows unbounded preceding),8) as p_holm from s")
def _(spark, d):
    t = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 97 + 1) / 1000.0).alias("p"))
    return R.holm(t, "p", "p_partkey").select("p_partkey", F.round("p_holm", 8).alias("p_holm"))


@query("r12_wild_bootstrap")
def _(spark, d):
    r = R.wild_bootstrap(R.cluster_sums(_sample(spark, d), "y", "x", ["z"], ["t"], "u"), 9_999)
    return spark.createDataFrame([(round(r["beta"], 6), round(r["t"], 6), r["p"], r["draws"])], "beta double, t double, p double, draws int")


#: Effects where all treated rows come last: a unit's mean before, moved as the controls' mean moved.
_EFFECTS = """, e as (select u, t, y - (select avg(y) from p q where q.u = p.u and q.t < {0}) - (select avg(y) from p q where q.u % 3 <> 0 and q.t = p.t) + (select avg(y) from p q where q.u % 3 <> 0 and q.t < {0}) as e from p where u % 3 = 0 and t >= {0})"""


@query("r13_imputation_att", f"with {_PANEL}{_EFFECTS.format(1998)} select count(*) as n, round(avg(e), 3) as att from e")
def _(spark, d):
    return R.att(_panel(spark, d), "y", F.col("d") == 1, "u", "t").withColumn("att", F.round("att", 3))


@query("r14_unit_bootstrap")
def _(spark, d):
    t = _panel(spark, d).withColumn("side", F.col("u") % 3 == 0)
    return R.unit_bootstrap(t, "y", "d", "u", "t", 1_000, stratum="side", controls=["x"])


@query("r15_bands")
def _(spark, d):
    import numpy as np

    fit = R.fixed_effects(_panel(spark, d), "y", ["x", "z"], ["t"], ["u"])
    draws = np.random.default_rng(1).multivariate_normal(fit.beta, fit.vcov, 2000)
    lo, hi, p = R.max_t_bands(fit.beta, draws)
    return spark.createDataFrame([(n, float(a), float(b), p) for n, a, b in zip(fit.names, lo, hi, strict=True)], "term string, low double, high double, joint_p double")


@query(
    "r16_event_study",
    f"with {_PANEL}{_EFFECTS.format(1997)} select case when t < 2000 then 'onset' else 'exit' end as side, cast(case when t < 2000 then t - 1996 else t - 1999 end as int) as horizon, count(*) as n, round(avg(e), 3) as att from e group by 1, 2",
)
def _(spark, d):
    t = _panel(spark, d).withColumn("s", ((F.col("u") % 3 == 0) & F.col("t").between(1997, 1999)).cast("int"))
    return R.event_horizons(t, "y", "s", "u", "t", 10).withColumn("att", F.round("att", 3)).withColumn("horizon", F.col("horizon").cast("int"))


@query(
    "r17_smd",
    "with t as (select cast(c_mktsegment='BUILDING' as int) as f, c_acctbal as a, c_nationkey as b from customer) select 'a' as \"column\", round(avg(a) filter (where f=1),6) as mean_1, round(avg(a) filter (where f=0),6) as mean_0, round((avg(a) filter (where f=1)-avg(a) filter (where f=0))/sqrt((var_samp(a) filter (where f=1)+var_samp(a) filter (where f=0))/2),8) as smd from t union all select 'b', round(avg(b) filter (where f=1),6), round(avg(b) filter (where f=0),6), round((avg(b) filter (where f=1)-avg(b) filter (where f=0))/sqrt((var_samp(b) filter (where f=1)+var_samp(b) filter (where f=0))/2),8) from t",
)
def _(spark, d):
    t = table(spark, d, "customer").select((F.col("c_mktsegment") == "BUILDING").cast("int").alias("f"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"))
    s = R.standardized_differences(t, "f", ["a", "b"])
    return s.select("column", F.round("mean_1", 6).alias("mean_1"), F.round("mean_0", 6).alias("mean_0"), F.round("smd", 8).alias("smd"))


QUERIES, ORACLES = query.queries, query.oracles
