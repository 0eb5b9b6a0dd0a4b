"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.keys import fold_accents, label_key
from panelwright.operators import joins as J
from panelwright.registry import Registry
from panelwright.sources.tables import table

query = Registry()
_KEY = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


@query("j1_one_to_one", "with a as (select o_custkey, count(*) as n_orders from orders group by 1) select c_custkey, n_orders from customer left join a on o_custkey=c_custkey")
def _(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return J.one_to_one(table(spark, d, "customer").select("c_custkey"), a, ["c_custkey"])


@query("j2_lookup", "select s_suppkey, n_name, r_name from supplier left join nation on s_nationkey=n_nationkey left join region on n_regionkey=r_regionkey")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    n = J.lookup(s, table(spark, d, "nation"), ["n_nationkey"])
    return J.lookup(n.withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, d, "region"), ["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query(
    "j3_crosswalk",
    """with f as (select l_partkey, sum(l_quantity) as q from lineitem group by 1), x as (select distinct l_partkey, l_suppkey from lineitem)
    select l_suppkey, round(sum(q), 2) as q from f join x using (l_partkey) group by 1""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("q"))
    return J.through_crosswalk(li, li, "l_partkey", "l_suppkey", ["q"]).withColumn("q", F.round("q", 2))


@query(
    "j4_full_outer",
    """with a as (select fecha as day, count(*) as n_attended from attendance group by 1), q as (select date as day, count(*) as n_rows from transcript_rows group by 1)
    select day, coalesce(n_attended,0) as n_attended, coalesce(n_rows,0) as n_rows from a full join q using (day)""",
)
def _(spark, d):
    a = table(spark, d, "attendance").groupBy(F.col("fecha").alias("day")).agg(F.count("*").alias("n_attended"))
    q = table(spark, d, "transcript_rows").groupBy(F.col("date").alias("day")).agg(F.count("*").alias("n_rows"))
    return J.reduce_join([a, q], ["day"], "full").na.fill(0)


@query("j5_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 150000)")
def _(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("j6_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j9_occurrence", """with a as (select alias_id, alias, row_number() over (partition by alias order by alias_id) as occurrence from question_aliases where alias is not null),
    b as (select attendance_row, medios as alias, row_number() over (partition by medios order by attendance_row) as occurrence from attendance where medios is not null)
    select alias, occurrence, alias_id, attendance_row from a join b using (alias, occurrence)""")
def _(spark, d):
    a = table(spark, d, "question_aliases").where("alias is not null").select("alias_id", "alias")
    b = table(spark, d, "attendance").where("medios is not null").select("attendance_row", F.col("medios").alias("alias"))
    return J.by_occurrence(a, b, "alias", ["alias_id"], ["attendance_row"], "inner")


@query("j10_natural", "select n_nationkey, n_name, r_name from nation join (select r_regionkey as n_regionkey, r_name from region) using (n_regionkey)")
def _(spark, d):
    return J.natural(table(spark, d, "nation"), table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")).select("n_nationkey", "n_name", "r_name")


@query(
    "j11_content_key",
    """select a.attendance_row as first_row, b.attendance_row as second_row from attendance a join attendance b on a.attendance_row < b.attendance_row and a.fecha is not distinct from b.fecha
    and a.sede is not distinct from b.sede and a.medios is not distinct from b.medios and a.reporter is not distinct from b.reporter and a.cargo is not distinct from b.cargo and a.outlet_final is not distinct from b.outlet_final""",
)
def _(spark, d):
    keys = ["fecha", "sede", "medios", "reporter", "cargo", "outlet_final"]
    t = table(spark, d, "attendance").select("attendance_row", *keys)
    j = J.null_safe(t.withColumnRenamed("attendance_row", "first_row"), t.withColumnRenamed("attendance_row", "second_row"), keys)
    return j.where("first_row < second_row").select("first_row", "second_row")


@query(
    "j12_reduce",
    """with a as (select source_id, count(*) as n_articles from articles group by 1), b as (select source_id, count(*) as n_pages from sitemap_articles group by 1), c as (select source_id, count(*) as n_urls from gdelt_urls group by 1)
    select s.source_id, n_articles, n_pages, n_urls from news_sources s left join a using (source_id) left join b using (source_id) left join c using (source_id)""",
)
def _(spark, d):
    parts = [table(spark, d, t).groupBy("source_id").agg(F.count("*").alias(n)) for t, n in (("articles", "n_articles"), ("sitemap_articles", "n_pages"), ("gdelt_urls", "n_urls"))]
    return J.reduce_join([table(spark, d, "news_sources").select("source_id"), *parts], ["source_id"])


@query(
    "j13_unambiguous",
    """with p as (select distinct medios, outlet_final from attendance where medios is not null and outlet_final is not null),
    a as (select medios from p group by 1 having count(*)=1), b as (select outlet_final from p group by 1 having count(*)=1)
    select medios, outlet_final from p where medios in (select medios from a) and outlet_final in (select outlet_final from b)""",
)
def _(spark, d):
    return J.unambiguous_pairs(table(spark, d, "attendance"), "medios", "outlet_final")


@query(
    "j14_fallback",
    f"""with r as (select attendance_row, medios, {_KEY.format('medios')} as key from attendance), x as (select {_KEY.format('alias')} as key, max(canonical_id) as canonical_id from question_aliases where canonical_id is not null group by 1),
    y as (select {_KEY.format('outlet_name')} as key, max(canonical_id) as canonical_id from outlet_registry group by 1)
    select attendance_row, coalesce(x.canonical_id, y.canonical_id) as canonical_id, case when x.canonical_id is not null then 'alias' when y.canonical_id is not null then 'name' end as method from r left join x on x.key=r.key and r.key<>'' left join y on y.key=r.key and r.key<>''""",
)
def _(spark, d):
    rows = table(spark, d, "attendance").select("attendance_row", label_key(F.col("medios")).alias("key"))
    first = table(spark, d, "question_aliases").where("canonical_id is not null").groupBy(label_key(F.col("alias")).alias("key")).agg(F.max("canonical_id").alias("canonical_id"))
    second = table(spark, d, "outlet_registry").groupBy(label_key(F.col("outlet_name")).alias("key")).agg(F.max("canonical_id").alias("canonical_id"))
    return J.with_fallback(rows, first, second, "key", "canonical_id", ("alias", "name")).select("attendance_row", "canonical_id", "method")


@query(
    "j15_preferred_key",
    f"""with k as (select distinct canonical_id from outlet_registry) select attendance_row, coalesce(a.canonical_id, b.canonical_id) as entity from attendance left join k a on a.canonical_id = outlet_final left join k b on b.canonical_id = {_KEY.format('medios')}""",
)
def _(spark, d):
    rows = table(spark, d, "attendance").select("attendance_row", "outlet_final", label_key(F.col("medios")).alias("cleaned"))
    return J.preferred_key(rows, table(spark, d, "outlet_registry"), "outlet_final", "cleaned", "canonical_id", "entity").select("attendance_row", "entity")


@query(
    "j16_dated_links",
    """with r as (select fecha, medios, min(outlet_final) as canonical from attendance group by 1,2), l as (select attendance_row, fecha, medios, lower(medios) as canonical from attendance where medios is not null)
    select attendance_row, case when r.canonical is null then 'absent' when r.canonical = l.canonical then 'ok' else 'differs' end as link_status from l left join r on l.fecha=r.fecha and l.medios=r.medios""",
)
def _(spark, d):
    t = table(spark, d, "attendance")
    roster = t.groupBy("fecha", "medios").agg(F.min("outlet_final").alias("canonical"))
    links = t.where("medios is not null").select("attendance_row", "fecha", "medios", F.lower("medios").alias("canonical"))
    return J.verified_links(links, roster, ["fecha", "medios"], "canonical").select("attendance_row", "link_status")


@query(
    "j17_windows",
    """with w as (select * from (values ('early', date '1995-01-01', date '1997-12-31'), ('late', date '1997-07-01', date '1999-12-31'), ('whole', date '1995-01-01', date '2001-12-31')) t(name, a, b))
    select name as window_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join w on cast(o_orderdate as date) between a and b group by 1""",
)
def _(spark, d):
    w = spark.createDataFrame([("early", "1995-01-01", "1997-12-31"), ("late", "1997-07-01", "1999-12-31"), ("whole", "1995-01-01", "2001-12-31")], "window_name string, a string, b string")
    w = w.select("window_name", F.to_date("a").alias("from_date"), F.to_date("b").alias("to_date"))
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return J.in_windows(o, w, "day").groupBy("window_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "j18_covered",
    """with i as (select source_id, min(cast(scrape_timestamp as date)) as a, min(cast(scrape_timestamp as date)) + 200 as b from articles group by 1), r as (select distinct source_id, cast(scrape_timestamp as date) as day from articles)
    select r.source_id, day, coalesce(day between a and b, false) as covered from r left join i using (source_id)""",
)
def _(spark, d):
    t = table(spark, d, "articles").select("source_id", F.col("scrape_timestamp").cast("date").alias("day"))
    i = t.groupBy("source_id").agg(F.min("day").alias("a")).withColumn("b", F.date_add("a", 200))
    return J.flag_covered(t.distinct(), i, "source_id", "day", "a", "b")


@query(
    "j19_anchors",
    """with t as (select cast(o_orderdate as date) as day, max(case when o_orderkey % 5 = 0 then o_totalprice end) as v from orders group by 1)
    select day, v, last_value(v ignore nulls) over (order by day rows between unbounded preceding and 1 preceding) as prev_value, last_value(case when v is not null then day end ignore nulls) over (order by day rows between unbounded preceding and 1 preceding) as prev_at,
    first_value(v ignore nulls) over (order by day rows between 1 following and unbounded following) as next_value, first_value(case when v is not null then day end ignore nulls) over (order by day rows between 1 following and unbounded following) as next_at from t""",
)
def _(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.max(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice"))).alias("v"))
    return J.nearest_anchors(t.withColumn("g", F.lit(1)), ["g"], "day", "v").drop("g")


@query(
    "j20_lagged_context",
    """with c as (select date as day, min(text) as text from transcript_rows group by 1), r as (select distinct fecha as day from attendance),
    o as (select day, unnest(case when dayofweek(day)=1 then [3,2,1] else [1] end) as k from r)
    select cast(o.day as varchar) as key, string_agg(c.text, '|' order by c.day) as context from o join c on c.day = o.day - cast(k as int) where c.text is not null group by 1""",
)
def _(spark, d):
    c = table(spark, d, "transcript_rows").groupBy(F.col("date").alias("day")).agg(F.min("text").alias("text")).where("text is not null")
    r = table(spark, d, "attendance").select(F.col("fecha").alias("day")).distinct().withColumn("key", F.col("day").cast("string"))
    return J.lagged_context(r, c, "key", "day", "text", "|")


@query(
    "j21_jaro_winkler",
    """with n as (select distinct lower(strip_accents(trim(medios))) as n from attendance where medios is not null and trim(medios) <> ''), p as (select a.n as "left", b.n as "right", jaro_winkler_similarity(a.n, b.n) as s from n a join n b on a.n < b.n)
    select "left", "right", round(s, 6) as similarity from p where s >= 0.97""",
)
def _(spark, d):
    n = table(spark, d, "attendance").select(F.lower(fold_accents(F.trim("medios"))).alias("n")).where("n <> ''")
    return J.fuzzy_pairs(n, "n", 0.97).withColumn("similarity", F.round("similarity", 6))


@query("j22_done", "select g.url_row from gdelt_urls g where not exists (select 1 from articles a where a.url = g.url and a.status = 200)")
def _(spark, d):
    return J.done_anti(table(spark, d, "gdelt_urls").select("url_row", "url"), table(spark, d, "articles"), ["url"], ~F.coalesce(F.col("status") == 200, F.lit(False))).select("url_row")


@query("j23_matching_blocks")
def _(spark, d):
    w = table(spark, d, "articles").where("wp_post_id is not null and main_text is not null").groupBy("source_id", "wp_post_id")
    p = w.agg(F.min("article_row").alias("article_row"), F.min_by("main_text", "article_row").alias("a"), F.max_by("main_text", "article_row").alias("b"))
    return J.matching_blocks(p.select("article_row", F.split("a", "\n").alias("a"), F.split("b", "\n").alias("b")), "article_row", "a", "b")


@query(
    "u12_clusters",
    """with recursive c as (select lower(strip_accents(trim(medios))) as n, count(*) as k from attendance where medios is not null and trim(medios) <> '' group by 1),
    e as materialized (select a.n as a, b.n as b from c a join c b on a.n <> b.n where jaro_winkler_similarity(a.n, b.n) >= 0.97), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
    select a as member, arg_min(b, (-k, b)) as representative from (select a, b from r union select a, a from e) x join c on c.n = x.b group by 1""",
)
def _(spark, d):
    n = table(spark, d, "attendance").select(F.lower(fold_accents(F.trim("medios"))).alias("n")).where("n <> ''")
    members = J.clusters(J.fuzzy_pairs(n, "n", 0.97), "left", "right")
    counts = n.groupBy(F.col("n").alias("member")).agg(F.count("*").alias("n"))
    return members.join(J.representatives(members, counts), "root").select("member", "representative")


QUERIES, ORACLES = query.queries, query.oracles
