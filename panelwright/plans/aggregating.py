"""Queries of aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import aggregates as A
from panelwright.operators.panel import all_or_nothing
from panelwright.registry import Registry
from panelwright.sources.tables import table

query = Registry()


@query(
    "a1_basic",
    """select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity),2) as sum_qty, round(min(l_extendedprice),2) as min_price, round(max(l_extendedprice),2) as max_price,
    round(avg(l_discount),6) as avg_disc, round(stddev_samp(l_quantity),6) as sd_qty, round(median(l_quantity),4) as med_qty from lineitem group by 1,2""",
)
def _(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum(q), 2).alias("sum_qty"), F.round(F.min("l_extendedprice"), 2).alias("min_price"), F.round(F.max("l_extendedprice"), 2).alias("max_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.round(F.stddev_samp(q), 6).alias("sd_qty"), F.round(F.median(q), 4).alias("med_qty"),
    )


@query("a2_sum_or_zero", "select estado, round(coalesce(sum(importe),0),2) as importe from contracts group by 1")
def _(spark, d):
    return table(spark, d, "contracts").groupBy("estado").agg(F.round(A.sum_or_zero(F.col("importe")), 2).alias("importe"))


@query("a3_sum_or_null", "select beneficiario, round(sum(importe),2) as importe from contracts group by 1")
def _(spark, d):
    return table(spark, d, "contracts").groupBy("beneficiario").agg(F.round(A.sum_or_null(F.col("importe")), 2).alias("importe"))


@query("a4_max_or_null", "select folio, max(importe) as importe, max(fecha_contrato) as day from contracts group by 1")
def _(spark, d):
    return table(spark, d, "contracts").groupBy("folio").agg(A.max_or_null(F.col("importe")).alias("importe"), A.max_or_null(F.col("fecha_contrato")).alias("day"))


@query(
    "a5_all_or_nothing",
    """with e as (select estado, count(distinct entidad) as n_expected from contracts where estado is not null group by 1)
    select c.estado, anio_gasto, n_expected, case when count(distinct entidad)=n_expected and count(importe)=count(*) then round(sum(importe),2) end as importe from contracts c join e on c.estado=e.estado group by 1,2,3""",
)
def _(spark, d):
    t = table(spark, d, "contracts").where("estado is not null")
    expected = t.groupBy("estado").agg(F.count_distinct("entidad").alias("n_expected"))
    return all_or_nothing(t, ["estado", "anio_gasto"], "entidad", expected, ["importe"]).withColumn("importe", F.round("importe", 2))


@query("a5_complete_sum", "select o_custkey, case when count(o_totalprice)=10 then round(sum(o_totalprice),2) end as total from orders group by 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(A.sum_if_complete(F.col("o_totalprice"), 10), 2).alias("total"))


@query("a6_distinct", "select fecha, count(distinct medios) as n_medios, count(distinct medios) + max(cast(medios is null as int)) as n_with_null from attendance group by 1")
def _(spark, d):
    return table(spark, d, "attendance").groupBy("fecha").agg(F.count_distinct("medios").alias("n_medios"), A.distinct_with_null(F.col("medios")).alias("n_with_null"))


@query("a7_distinct_where", "select cast(ts as date) as day, count(distinct case when event_type='purchase' then user_id end) as buyers, count(distinct case when value>50 then user_id end) as large from events group by 1")
def _(spark, d):
    t = table(spark, d, "events")
    return t.groupBy(F.col("ts").cast("date").alias("day")).agg(
        A.distinct_where(F.col("user_id"), F.col("event_type") == "purchase").alias("buyers"), A.distinct_where(F.col("user_id"), F.col("value") > 50).alias("large")
    )


@query("a8_conditions", "select user_id, count(*) filter (where event_type='error') as n_errors, bool_or(event_type='signup') as signed_up, bool_and(value > 0) as all_positive from events group by 1")
def _(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(e == "error").alias("n_errors"), F.bool_or(e == "signup").alias("signed_up"), F.bool_and(F.col("value") > 0).alias("all_positive"))


@query("a9_collapse", "select source_id, string_agg(distinct topic, ' | ' order by topic) as topics from articles group by 1")
def _(spark, d):
    return table(spark, d, "articles").groupBy("source_id").agg(A.collapse_unique(F.col("topic")).alias("topics"))


@query(
    "a10_first_seen",
    "with t as (select source_id, topic, min(article_row) as r from articles where topic is not null group by 1,2), s as (select distinct source_id from articles) select source_id, string_agg(topic, ';' order by r) as topics from s left join t using (source_id) group by 1",
)
def _(spark, d):
    return table(spark, d, "articles").groupBy("source_id").agg(A.first_seen_unique(F.col("topic"), F.col("article_row")).alias("topics"))


@query("a11_consensus", "select medios, case when count(distinct outlet_final)=1 then max(outlet_final) end as outlet from attendance group by 1")
def _(spark, d):
    return table(spark, d, "attendance").groupBy("medios").agg(A.consensus(F.col("outlet_final")).alias("outlet"))


@query(
    "a12_conflict",
    """select medios, case when count(distinct case when sede<>'Patio Sur' then sede end)=1 then max(case when sede<>'Patio Sur' then sede end) when count(distinct case when sede<>'Patio Sur' then sede end)>1 then 'conflict' else 'unknown' end as place from attendance group by 1""",
)
def _(spark, d):
    return table(spark, d, "attendance").groupBy("medios").agg(A.category_or_conflict(F.col("sede"), F.col("sede") != "Patio Sur").alias("place"))


@query("a13_any_flag", "select user_id, coalesce(max(case when event_type='purchase' then 1 end),0) as bought from events group by 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(A.any_flag(F.when(F.col("event_type") == "purchase", 1)).alias("bought"))


@query(
    "a14_two_level",
    """with p as (select o_orderpriority as g, o_custkey, sum(case when o_totalprice>100000 then round(o_totalprice) else 0 end) as v, bool_or(o_orderstatus<>'F') as e from orders group by 1,2)
    select g, count(*) filter (where e) as n_eligible, count(*) filter (where v>0) as n_active, sum(v) as total, sum(v)/count(*) filter (where e) as per_eligible, sum(v)/nullif(count(*) filter (where v>0),0) as per_active from p group by 1""",
)
def _(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_custkey", F.when(F.col("o_totalprice") > 100000, F.round("o_totalprice")).otherwise(0).alias("v"), "o_orderstatus")
    # Whole numbers add up exactly in any order, so the ratios can be compared as they are.
    return A.two_level(t, ["o_custkey"], ["g"], "v", F.col("o_orderstatus") != "F")


@query("a15_share", "with t as (select l_returnflag, l_linestatus, sum(l_quantity) as q from lineitem group by 1,2) select l_returnflag, l_linestatus, round(q/sum(q) over (partition by l_returnflag),8) as share from t")
def _(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    return A.share_within(t, ["l_returnflag"], "q").select("l_returnflag", "l_linestatus", F.round("share", 8).alias("share"))


@query(
    "a16_fan_out",
    """with x as (select distinct l_partkey, l_suppkey from lineitem), n as (select l_partkey, count(*) as n from x group by 1), f as (select l_partkey, sum(l_quantity) as q from lineitem group by 1)
    select l_suppkey, round(sum(q/n),4) as q from f join x using (l_partkey) join n using (l_partkey) group by 1""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    f = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return A.fan_out_weighted(f, li, "l_partkey", "l_suppkey", "q").withColumn("q", F.round("q", 4))


@query("a17_total_row", "select case when grouping(o_orderstatus)=1 then 'All' else o_orderstatus end as o_orderstatus, count(*) as n, round(sum(o_totalprice),2) as total from orders group by grouping sets ((o_orderstatus), ())")
def _(spark, d):
    return A.with_total(table(spark, d, "orders"), "o_orderstatus", [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")])


@query(
    "a18_quantiles",
    "select o_orderstatus, round(quantile_cont(o_totalprice,0.01),4) as p1, round(quantile_cont(o_totalprice,0.25),4) as p25, round(quantile_cont(o_totalprice,0.5),4) as p50, round(quantile_cont(o_totalprice,0.99),4) as p99 from orders group by 1",
)
def _(spark, d):
    q = A.quantiles(table(spark, d, "orders"), "o_totalprice", [0.01, 0.25, 0.5, 0.99], ["o_orderstatus"])
    return q.select("o_orderstatus", *[F.round(c, 4).alias(c) for c in ("p1", "p25", "p50", "p99")])


@query(
    "a19_histogram",
    """with b as (select unnest(range(1,9)) as bin_no), c as (select case when value>=0 and value<=10 then 1 when value>10 and value<=120 then cast(ceil((value-10)/20)+1 as int) end as bin_no from events where value <= 150)
    select cast(b.bin_no as int) as bin_no, cast(case when b.bin_no=1 then 0 else 10+20*(b.bin_no-2) end as double) as low, cast(10+20*(b.bin_no-1) as double) as high, count(c.bin_no) as n from b left join (select case when value>=0 and value<=10 then 1 when value>10 and value<=150 then cast(ceil((value-10)/20)+1 as int) end as bin_no from events) c on b.bin_no=c.bin_no group by 1,2,3""",
)
def _(spark, d):
    return A.histogram(table(spark, d, "events"), "value", [0, 10, 30, 50, 70, 90, 110, 130, 150])


@query(
    "a20_classes",
    """with q as (select quantile_cont(c_acctbal,[1/7,2/7,3/7,4/7,5/7,6/7]) as c from customer) select c_custkey, cast(1 + len(list_filter(c, lambda x: c_acctbal > x)) as int) as klass from customer, q""",
)
def _(spark, d):
    return A.quantile_classes(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 7).select("c_custkey", "klass")


@query("a21_crosstab", "select event_type, count(*) filter (where user_id%3=0) as g0, count(*) filter (where user_id%3=1) as g1, count(*) filter (where user_id%3=2) as g2 from events group by 1")
def _(spark, d):
    t = table(spark, d, "events").select("event_type", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("g"))
    return A.crosstab(t, "event_type", "g", ["g0", "g1", "g2"])


@query(
    "a21_chi_square",
    """with c as (select event_type a, user_id%7 b, count(*) n from events group by 1,2), r as (select a, sum(n) nr from c group by 1), k as (select b, sum(n) nc from c group by 1), t as (select sum(n) n from c)
    select round(sum(power(coalesce(c.n,0)-nr*nc/t.n,2)/(nr*nc/t.n)),6) as chi2, cast((count(distinct r.a)-1)*(count(distinct k.b)-1) as bigint) as dof from r cross join k cross join t left join c on c.a=r.a and c.b=k.b""",
)
def _(spark, d):
    t = table(spark, d, "events").select("event_type", (F.col("user_id") % 7).alias("b"))
    return A.chi_square(t, "event_type", "b").withColumn("chi2", F.round("chi2", 6))


@query(
    "a22_correlations",
    """select 'l_quantity' as x, 'l_extendedprice' as y, round(corr(l_quantity,l_extendedprice),8) as r from lineitem union all select 'l_quantity','l_discount',round(corr(l_quantity,l_discount),8) from lineitem
    union all select 'l_extendedprice','l_discount',round(corr(l_extendedprice,l_discount),8) from lineitem""",
)
def _(spark, d):
    return A.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 8))


@query("a23_text_summary", "select topic, count(*) as n_rows, min(nullif(trim(authors),'')) as authors_min, max(nullif(trim(authors),'')) as authors_max from articles group by 1")
def _(spark, d):
    return A.text_summary(table(spark, d, "articles"), ["topic"], ["authors"])


@query(
    "a24_sample_flow",
    """with e as (select *, cast(ts as date) as day from events) select 'all' as stage, count(*) as n_rows, count(distinct user_id) as n_units, count(distinct day) as n_dates, count(*) filter (where event_type='purchase') as n_treated from e
    union all select 'valued', count(*), count(distinct user_id), count(distinct day), count(*) filter (where event_type='purchase') from e where value>20
    union all select 'even', count(*), count(distinct user_id), count(distinct day), count(*) filter (where event_type='purchase') from e where value>20 and user_id%2=0""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    v = e.where("value > 20")
    return A.sample_flow({"all": e, "valued": v, "even": v.where("user_id % 2 = 0")}, "user_id", "day", F.col("event_type") == "purchase")


@query("a25_dedup_counts", "select source_id, count(distinct url) as n_urls, count(*) as n_rows from gdelt_urls group by 1")
def _(spark, d):
    t = table(spark, d, "gdelt_urls").groupBy("source_id", "url").agg(F.count("*").alias("k"))
    return t.groupBy("source_id").agg(F.count("url").alias("n_urls"), F.sum("k").alias("n_rows"))


@query("a26_ratio_of_sums", "select estado, round(case when sum(case when importe is not null and costo>0 then costo end)>0 then sum(case when importe is not null and costo>0 then importe end)/sum(case when importe is not null and costo>0 then costo end) end,8) as ratio from contracts group by 1")
def _(spark, d):
    ok = F.col("importe").isNotNull() & (F.col("costo") > 0)
    return table(spark, d, "contracts").groupBy("estado").agg(F.round(A.ratio_of_sums(F.col("importe"), F.col("costo"), ok), 8).alias("ratio"))


@query("a27_top_share", "with t as (select o_custkey, sum(o_totalprice) as v from orders group by 1), k as (select sum(v) as s from (select v from t order by v desc, o_custkey limit 10)) select round(s,2) as top_sum, round((select sum(v) from t),2) as total, round(s/(select sum(v) from t),8) as share from k")
def _(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return A.top_share(t, "v", "o_custkey").select(F.round("top_sum", 2).alias("top_sum"), F.round("total", 2).alias("total"), F.round("share", 8).alias("share"))


@query("a28_iso_week", "with t as (select cast(o_orderdate as date) as day, max(o_totalprice) as v from orders group by 1) select cast(isoyear(day) as int) as iso_year, cast(weekofyear(day) as int) as iso_week, round(avg(v),4) as mean_value, arg_max(v, day) as last_value from t group by 1,2")
def _(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.max("o_totalprice").alias("v"))
    return A.iso_week_mean(t, "day", "v").withColumn("mean_value", F.round("mean_value", 4))


@query(
    "a29_gini",
    """with t as (select quarter(o_orderdate) as q, o_custkey, sum(o_totalprice) as v from orders group by 1,2), r as (select q, v, row_number() over (partition by q order by v) as k from t)
    select q, count(*) as n, round(2*sum(k*v)/(count(*)*sum(v)) - (count(*)+1)/count(*),8) as gini, round(stddev_samp(v)/avg(v),8) as cv, round(sum(v),2) as total from r group by 1""",
)
def _(spark, d):
    t = table(spark, d, "orders").groupBy(F.quarter("o_orderdate").cast("long").alias("q"), "o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return A.gini(t, ["q"], "v").select("q", "n", F.round("gini", 8).alias("gini"), F.round("cv", 8).alias("cv"), F.round("total", 2).alias("total"))


@query(
    "a30_cohort",
    "with t as (select distinct o_custkey, year(o_orderdate) as y from orders) select o_custkey, y from t where o_custkey in (select o_custkey from t group by 1 having count(*)=(select count(distinct y) from t))",
)
def _(spark, d):
    t = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("y")).distinct()
    return A.balanced_cohort(t, "o_custkey", "y")


QUERIES, ORACLES = query.queries, query.oracles
