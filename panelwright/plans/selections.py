"""Queries of projections, predicates and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.keys import label_key
from panelwright.operators import select as S
from panelwright.registry import Registry
from panelwright.sources.tables import table

query = Registry()


@query("proj_p1_rename", "select s_suppkey as supplier_id, s_name as supplier, s_acctbal as balance from supplier")
def _(spark, d):
    return S.project(table(spark, d, "supplier"), {"s_suppkey": "supplier_id", "s_name": "supplier", "s_acctbal": "balance"})


@query("proj_p2_across", "select c_custkey, c_nationkey * 2 as c_nationkey, round(c_acctbal * 2, 2) as c_acctbal from customer")
def _(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    out = S.across(df, lambda f: S.is_numeric(f) and f.name != "c_custkey", lambda c: c * 2)
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    "proj_p3_interactions",
    """select o_orderkey, case when quarter(o_orderdate)=1 then o_totalprice else 0 end as price_1, case when quarter(o_orderdate)=2 then o_totalprice else 0 end as price_2,
    case when quarter(o_orderdate)=3 then o_totalprice else 0 end as price_3, case when quarter(o_orderdate)=4 then o_totalprice else 0 end as price_4 from orders""",
)
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.quarter("o_orderdate").alias("q"), F.col("o_totalprice").alias("price"))
    return S.interactions(df, "q", [1, 2, 3, 4], "price").drop("q", "price")


@query("proj_p4_between", "select o_orderkey, cast(o_orderdate as date) as day from orders where cast(o_orderdate as date) between date '1996-01-01' and date '1996-03-31'")
def _(spark, d):
    df = table(spark, d, "orders").where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-03-31 23:59:59").cast("timestamp_ntz")))
    return df.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("proj_p5_member", "select attendance_row, coalesce(sede in ('Salón Central','Patio Sur'), false) as known_place from attendance")
def _(spark, d):
    return table(spark, d, "attendance").select("attendance_row", S.is_member(F.col("sede"), ["Salón Central", "Patio Sur"]).alias("known_place"))


@query("proj_p6_detect", "select article_row, regexp_matches(title, '[0-9]+ por ciento') as has_rate from articles")
def _(spark, d):
    return table(spark, d, "articles").select("article_row", F.col("title").rlike("[0-9]+ por ciento").alias("has_rate"))


ROLE_RULES = [("foto|camar", "image"), ("report", "reporter"), ("corresponsal", "correspondent"), ("youtub", "video")]


@query(
    "proj_p7_rule_cascade",
    """select attendance_row, case when k similar to '.*(foto|camar).*' then 'image' when k like '%report%' then 'reporter' when k like '%corresponsal%' then 'correspondent' when k like '%youtub%' then 'video' else 'other' end as role
    from (select attendance_row, trim(regexp_replace(lower(strip_accents(cargo)), '[^a-z0-9]+', ' ', 'g')) as k from attendance)""",
)
def _(spark, d):
    df = table(spark, d, "attendance").select("attendance_row", label_key(F.col("cargo")).alias("k"))
    return df.select("attendance_row", S.first_match(F.col("k"), ROLE_RULES, F.lit("other")).alias("role"))


@query(
    "proj_p7_rule_audit",
    """with t as (select coalesce(trim(regexp_replace(lower(strip_accents(cargo)), '[^a-z0-9]+', ' ', 'g')), '') as k from attendance),
    h as (select regexp_matches(k,'foto|camar') a, regexp_matches(k,'report') b, regexp_matches(k,'corresponsal') c, regexp_matches(k,'youtub') e from t)
    select 1 as rule_no, 'image' as label, count(*) filter (where a) as n_first, count(*) filter (where a) as n_any from h
    union all select 2, 'reporter', count(*) filter (where b and not a), count(*) filter (where b) from h
    union all select 3, 'correspondent', count(*) filter (where c and not a and not b), count(*) filter (where c) from h
    union all select 4, 'video', count(*) filter (where e and not a and not b and not c), count(*) filter (where e) from h""",
)
def _(spark, d):
    return S.rule_audit(table(spark, d, "attendance").select(label_key(F.col("cargo")).alias("k")), "k", ROLE_RULES)


@query(
    "proj_p8_exact_role",
    """select attendance_row, coalesce(nullif(trim(regexp_replace(lower(strip_accents(cargo)), '[^a-z0-9]+', ' ', 'g')), '') in ('reportero','reportera'), false) as is_reporter from attendance""",
)
def _(spark, d):
    return table(spark, d, "attendance").select("attendance_row", S.exact_role(F.col("cargo"), ["reportero", "reportera"]).alias("is_reporter"))


@query("proj_p9_complete", "select contract_id from contracts where cantidad is not null and costo is not null and importe is not null")
def _(spark, d):
    return S.complete_rows(table(spark, d, "contracts"), ["cantidad", "costo", "importe"]).select("contract_id")


@query(
    "proj_p10_informative_dates",
    """with t as (select cast(ts as date) as day, user_id, max(cast(event_type='purchase' as int)) as bought from events group by 1,2)
    select day, user_id, bought from t where day in (select day from t group by 1 having max(bought)=1 and min(bought)=0)""",
)
def _(spark, d):
    t = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "user_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    return S.informative_groups(t, ["day"], "bought")


@query("proj_p11_frequent", "select attendance_row, medios from attendance where medios in (select medios from attendance group by 1 having count(*) > 4)")
def _(spark, d):
    return S.frequent(table(spark, d, "attendance").select("attendance_row", "medios"), "medios", 4)


@query("proj_p12_rare", "select medios, count(distinct fecha) as n_days, count(*) as n_rows, min(source_file) as evidence from attendance where medios is not null group by 1 having count(distinct fecha) <= 2")
def _(spark, d):
    return S.rare_entities(table(spark, d, "attendance"), "medios", "fecha", "source_file", 2)


@query(
    "proj_p13_usable",
    """select page_row from sitemap_articles where date is not null and length(trim(coalesce(main_text,''))) >= 200 and coalesce(trim(error),'') = ''""",
)
def _(spark, d):
    return S.usable_rows(table(spark, d, "sitemap_articles"), "main_text", "date", "error", 200).select("page_row")


@query(
    "proj_p14_support",
    """with recursive e0 as (select distinct user_id, cast(ts as date) as day from events where event_type='error'),
    a as (select * from e0 where user_id in (select user_id from e0 group by 1 having count(*) >= 8)),
    b as (select * from a where day in (select day from a group by 1 having count(*) >= 5)),
    c as (select * from b where user_id in (select user_id from b group by 1 having count(*) >= 8)),
    e as (select * from c where day in (select day from c group by 1 having count(*) >= 5)),
    f as (select * from e where user_id in (select user_id from e group by 1 having count(*) >= 8)),
    g as (select * from f where day in (select day from f group by 1 having count(*) >= 5)) select user_id, day from g""",
)
def _(spark, d):
    t = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    return S.prune_to_support(t, [(["user_id"], 8), (["day"], 5)])


@query(
    "proj_p15_admissible",
    """select url_row, coalesce(regexp_matches(url, '^https?://(www[.])?[^/]+[.]example/') and not regexp_matches(regexp_replace(url, '^[a-zA-Z]+://[^/]+', ''), '/(tag|autor|page)/|[?]page='), false) as admitted from gdelt_urls""",
)
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "gdelt_urls").select("url_row", S.admissible_url(u, ["example"], "^/", r"/(tag|autor|page)/|[?]page=").alias("admitted"))


@query(
    "rules_alias_override",
    """with k as (select trim(regexp_replace(lower(strip_accents(alias)), '[^a-z0-9]+', ' ', 'g')) as key, case when count(distinct canonical_id)=1 then max(canonical_id) end as c from question_aliases where canonical_id is not null group by 1)
    select attendance_row, coalesce(k.c, medios) as outlet from attendance left join k on k.c is not null and k.key <> '' and trim(regexp_replace(lower(strip_accents(medios)), '[^a-z0-9]+', ' ', 'g')) = k.key""",
)
def _(spark, d):
    out = S.apply_aliases(table(spark, d, "attendance").select("attendance_row", "medios"), "medios", table(spark, d, "question_aliases"), "alias", "canonical_id", "outlet")
    return out.select("attendance_row", "outlet")


QUERIES, ORACLES = query.queries, query.oracles
