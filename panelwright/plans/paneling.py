"""Queries of panels, histories, evidence and crawl operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import crawl as C
from panelwright.operators import panel as P
from panelwright.registry import Registry
from panelwright.sources.tables import table

query = Registry()
_DAILY = "select user_id, cast(ts as date) as date, count(*) as n, sum(value) as v from events where event_type='purchase' group by 1,2"


def _purchases(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", F.col("ts").cast("date").alias("date")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


@query("j7_balanced", "select user_id, cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as date) as date from (select distinct user_id from events)")
def _(spark, d):
    return P.balanced_panel(table(spark, d, "events").select("user_id").distinct(), ["user_id"], "2024-01-01", "2024-01-30")


@query(
    "j8_complete",
    f"""with t as ({_DAILY}), s as (select user_id, min(date) a, max(date) b from t group by 1), g as (select user_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as date from s)
    select g.user_id, g.date, coalesce(n,0) as n from g left join t on t.user_id=g.user_id and t.date=g.date""",
)
def _(spark, d):
    return P.complete_calendar(_purchases(spark, d).select("user_id", "date", "n"), ["user_id"], "date", {"n": 0})


@query(
    "d1_weekly_panel",
    "select canonical_id, cast(unnest(generate_series(date '2023-01-04', date '2023-12-31', interval 7 day)) as date) as date from outlet_registry",
)
def _(spark, d):
    return P.balanced_panel(table(spark, d, "outlet_registry").select("canonical_id"), ["canonical_id"], "2023-01-04", "2023-12-31", "7 day")


@query(
    "d2_observed_panel",
    f"""with g as (select user_id, cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as date) as date from (select distinct user_id from events)), t as ({_DAILY}),
    o as (select distinct user_id, cast(ts as date) as date from events), m as (select distinct user_id from t)
    select g.user_id, g.date, m.user_id is not null as source_entity_matched, o.date is not null as source_date_observed, case when m.user_id is not null and o.date is not null then coalesce(n,0) end as n, case when m.user_id is not null and o.date is not null then round(coalesce(v,0),2) end as v
    from g left join t on t.user_id=g.user_id and t.date=g.date left join o on o.user_id=g.user_id and o.date=g.date left join m on m.user_id=g.user_id""",
)
def _(spark, d):
    e = table(spark, d, "events")
    observed = e.select("user_id", F.col("ts").cast("date").alias("date"))
    out = P.observed_panel(e.select("user_id").distinct(), _purchases(spark, d), "user_id", "date", "2024-01-01", "2024-01-30", ["n", "v"], observed)
    return out.withColumn("v", F.round("v", 2))


@query(
    "d2_zero_filled_panel",
    f"""with g as (select user_id, cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as date) as date from (select distinct user_id from events)), t as ({_DAILY}) select g.user_id, g.date, coalesce(n,0) as n from g left join t on t.user_id=g.user_id and t.date=g.date""",
)
def _(spark, d):
    return P.zero_filled_panel(table(spark, d, "events").select("user_id").distinct(), _purchases(spark, d).drop("v"), "user_id", "date", "2024-01-01", "2024-01-30", ["n"])


@query(
    "d3_match_report",
    "with k as (select distinct canonical_id from outlet_registry) select source_file, count(*) as n_rows, count(k.canonical_id) as n_matched, count(distinct outlet_final) as n_keys, count(distinct k.canonical_id) as n_keys_matched from attendance left join k on outlet_final=canonical_id group by 1",
)
def _(spark, d):
    known = table(spark, d, "outlet_registry").select(F.col("canonical_id").alias("outlet_final"))
    return P.match_report(table(spark, d, "attendance"), known, "source_file", "outlet_final")


@query(
    "d4_entity_dimension",
    """with t as (select distinct estado, medio, outlet_id, ciudad, cast(outlet_id as varchar) as m from outlet_registry), g as (select medio, count(distinct outlet_id) as n_members, string_agg(distinct m, ' | ' order by m) as members, nullif(string_agg(distinct ciudad, ' | ' order by ciudad), '') as names,
    case when count(distinct case when lower(estado)<>'unknown' then estado end)=1 then max(estado) when count(distinct case when lower(estado)<>'unknown' then estado end)>1 then 'conflict' else 'unknown' end as category from t group by 1)
    select *, category = 'conflict' as estado_conflict, cast(row_number() over (order by medio nulls first) as int) as entity_number from g""",
)
def _(spark, d):
    return P.entity_dimension(table(spark, d, "outlet_registry"), "medio", "outlet_id", "ciudad", "estado")


@query(
    "d5_history",
    """with w as (select * from (values ('m6', date '2001-02-01', date '2001-07-31'), ('y1', date '2000-08-01', date '2001-07-31'), ('y2', date '1999-08-01', date '2000-07-31')) t(name,a,b)), o as (select o_custkey, cast(o_orderdate as date) as day, round(o_totalprice) as v, o_orderstatus<>'P' as seen from orders where o_orderdate < timestamp '2001-08-01')
    select o_custkey, name as window_name, count(*) filter (where seen) as n_observed, sum(case when seen then v end) as v, sum(case when seen then v end)/nullif(count(*) filter (where seen),0) as v_per_day from o join w on day between a and b group by 1,2""",
)
def _(spark, d):
    w = P.history_windows(spark, "2001-08-01", {"m6": (6, 0), "y1": (12, 0), "y2": (24, 12)})
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.round("o_totalprice").alias("v"), (F.col("o_orderstatus") != "P").alias("seen")).where("day < '2001-08-01'")
    h = P.summarize_history(o, w, "o_custkey", "day", ["v"], "seen", "2001-08-01")
    return h.select("o_custkey", F.col("window").alias("window_name"), "n_observed", "v", "v_per_day")


_BASELINE = """w as (select * from (values ('total', date '2022-01-01', date '2024-06-14'), ('year1', date '2022-01-01', date '2022-12-31'), ('year2', date '2023-01-01', date '2023-12-31'), ('year3', date '2024-01-01', date '2024-06-14'), ('last_year', date '2023-06-15', date '2024-06-14'), ('last_2years', date '2022-06-15', date '2024-06-14')) t(name,a,b))"""


@query(
    "d5_baseline",
    f"""with {_BASELINE}, t as (select coalesce(outlet_final,'none') as e, fecha as day, count(*) as rec, count(*) filter (where cargo is null) as q, count(*) filter (where medios is null) as ass from attendance where fecha < date '2024-06-15' group by 1,2),
    p as (select e, day, strftime(day, '%Y-%m') <> '2023-11' as ao, q < 3 as qo, rec, ass, q from t), m as (select e, day, ao, qo, case when ao then rec end as rec, case when ao then ass end as ass, case when qo then q end as q, case when qo then cast(q > 0 as int) end as asked from p),
    c as (select *, case when ao then greatest(rec + ass, coalesce(asked, 0)) when asked = 1 then 1 end as cor from m)
    select e, name as window_name, sum(case when ao and qo then q end) as common_questions, sum(case when ao and qo then cor end) as common_attendance, sum(case when ao and qo then cast(cor > 0 as int) end) as common_attendance_days, sum(rec) as recorded, sum(cor - coalesce(rec,0) - coalesce(ass,0)) as inferred, sum(cor) as corrected, sum(q) as questions,
    sum(cast(rec > 0 as int)) as attendance_days, sum(asked) as question_days, count(*) filter (where ao) as attendance_observed_days, count(*) filter (where ao and qo) as common_observed_days, round(sum(case when ao and qo then q end) / nullif(sum(case when ao and qo then cor end), 0), 8) as questions_per_attendance
    from c join w on day between a and b group by 1, 2""",
)
def _(spark, d):
    t = table(spark, d, "attendance").where("fecha < '2024-06-15'").groupBy(F.coalesce("outlet_final", F.lit("none")).alias("e"), F.col("fecha").alias("day"))
    t = t.agg(F.count("*").alias("recorded"), F.count_if(F.col("cargo").isNull()).alias("questions"), F.count_if(F.col("medios").isNull()).alias("assumed"))
    yes = F.lit(True)
    t = t.withColumns({"attendance_matched": yes, "attendance_observed": yes, "questions_matched": yes, "questions_observed": F.col("questions") < 3})
    h = P.baseline_history(P.prepare_history_days(t, "day", ("2023-11",)), P.baseline_windows(spark, "2024-06-15", "2022-01-01"), "e", "day", "2024-06-15")
    kept = ["common_questions", "common_attendance", "common_attendance_days", "recorded", "inferred", "corrected", "questions", "attendance_days", "question_days", "attendance_observed_days", "common_observed_days"]
    return h.select("e", F.col("window").alias("window_name"), *kept, F.round("questions_per_attendance", 8).alias("questions_per_attendance"))


@query(
    "d5_contracts",
    f"""with {_BASELINE}, t as (select coalesce(entidad,'none') as e, fecha_contrato as day, sum(coalesce(importe,0)) as importe, count(*) as n, bool_and(importe is not null) as seen from contracts where fecha_contrato < date '2024-06-15' group by 1,2)
    select e, name as window_name, count(*) filter (where seen) as observed_days, sum(case when seen then cast(n > 0 as int) end) as award_days, round(sum(case when seen then importe end), 4) as importe, sum(case when seen then n end) as n from t join w on day between a and b group by 1, 2""",
)
def _(spark, d):
    t = table(spark, d, "contracts").where("fecha_contrato < '2024-06-15'").groupBy(F.coalesce("entidad", F.lit("none")).alias("e"), F.col("fecha_contrato").alias("day"))
    t = t.agg(F.sum(F.coalesce("importe", F.lit(0))).alias("importe"), F.count("*").alias("n"), F.bool_and(F.col("importe").isNotNull()).alias("seen")).withColumn("matched", F.lit(True))
    h = P.contract_history(t, P.baseline_windows(spark, "2024-06-15", "2022-01-01"), "e", "day", ["importe", "n"], "n", "matched", "seen", "2024-06-15")
    return h.select("e", F.col("window").alias("window_name"), "observed_days", "award_days", F.round("importe", 4).alias("importe"), "n")


@query(
    "d6_corrected",
    """with a as (select fecha as day, count(*) as rec from attendance group by 1), q as (select date as day, count(*) filter (where is_question_speaker) as asked from transcript_rows group by 1), j as (select coalesce(a.day,q.day) as day, rec, asked from a full join q on a.day=q.day)
    select day, case when rec is not null and asked is not null then greatest(rec, asked) when rec is not null then rec when asked>0 then 1 end as n from j""",
)
def _(spark, d):
    a = table(spark, d, "attendance").groupBy(F.col("fecha").alias("day")).agg(F.count("*").alias("rec"))
    q = table(spark, d, "transcript_rows").groupBy(F.col("date").alias("day")).agg(F.count_if("is_question_speaker").alias("asked"))
    return a.join(q, "day", "full").select("day", P.corrected_count(F.col("rec"), F.lit(None).cast("long"), F.col("asked")).alias("n"))


@query(
    "d7_participation",
    """with t as (select *, coalesce(outlet_final, 'none') as e from attendance), p as (select distinct e from t), r as (select fecha as day, count(*) as n from attendance group by 1), q as (select distinct e, fecha as day from t where cargo is null), k as (select distinct day from q),
    d as (select coalesce(r.day,k.day) as day, n from r full join k on r.day=k.day), a as (select distinct e, fecha as day from t)
    select p.e as outlet, count(*) as n_days, count(case when q.e is not null or a.e is not null then 1 when coalesce(n,0)>=2 then 0 end) as n_known, sum(case when q.e is not null or a.e is not null then 1 when coalesce(n,0)>=2 then 0 end) as n_present, sum(case when q.e is not null then 1 when k.day is not null then 0 end) as n_asked
    from p cross join d left join q on q.e=p.e and q.day=d.day left join a on a.e=p.e and a.day=d.day left join k on k.day=d.day group by 1""",
)
def _(spark, d):
    t = table(spark, d, "attendance").withColumn("outlet", F.coalesce("outlet_final", F.lit("none")))
    p = P.participation_panel(t, t, t.where("cargo is null"), table(spark, d, "attendance"), "outlet", "fecha", 2)
    return p.groupBy("outlet").agg(F.count("*").alias("n_days"), F.count("present").alias("n_known"), F.sum("present").alias("n_present"), F.sum("asked").alias("n_asked"))


@query(
    "d8_period_change",
    """with t as (select c.c_nationkey as g, cast(o_orderdate as date) as day, case when o_orderstatus='F' then o_totalprice else 0 end as a, o_totalprice as b from orders join customer c on c_custkey=o_custkey)
    select g, round(sum(case when day between date '1995-01-01' and date '1997-12-31' then a end)/nullif(sum(case when day between date '1995-01-01' and date '1997-12-31' then b end),0),8) as ratio_first, round(sum(case when day between date '1998-01-01' and date '2001-12-31' then a end)/nullif(sum(case when day between date '1998-01-01' and date '2001-12-31' then b end),0),8) as ratio_second from t group by 1""",
)
def _(spark, d):
    t = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("g")), "o_custkey")
    t = t.select("g", F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0).alias("a"), F.col("o_totalprice").alias("b"))
    c = P.period_change(t, "g", "day", "a", "b", ("1995-01-01", "1997-12-31"), ("1998-01-01", "2001-12-31"))
    return c.select("g", F.round("ratio_first", 8).alias("ratio_first"), F.round("ratio_second", 8).alias("ratio_second"))


@query(
    "d9_discoveries",
    """with t as (select *, lower(regexp_extract(regexp_replace(trim(url), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)', 1)) || substr(regexp_replace(trim(url), '#.*$', ''), 1 + length(regexp_extract(regexp_replace(trim(url), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)', 1))) as canonical,
    case discovery_strategy when 'news_sitemap' then 1 when 'rss' then 2 else 9 end as p, coalesce(discovery_strategy, 'unknown') as st from sitemap_articles where regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]')), s as (select source_id, canonical, st, min(p*10000000000+page_row) as r from t group by 1,2,3), l as (select source_id, canonical, string_agg(st, ';' order by r) as strategies from s group by 1,2)
    select t.source_id, t.canonical, count(*) as n_rows, max(l.strategies) as strategies, arg_min(page_row, p*10000000000+page_row) as page_row, cast(min(scrape_timestamp) as date) as first_capture, cast(max(scrape_timestamp) as date) as last_capture, count(distinct language) as n_indexes
    from t left join l on l.source_id is not distinct from t.source_id and l.canonical=t.canonical group by 1,2""",
)
def _(spark, d):
    t = table(spark, d, "sitemap_articles").withColumn("stamp", F.date_format("scrape_timestamp", "yyyyMMddHHmmss"))
    m = C.merge_discoveries(t, "source_id", "url", "discovery_strategy", "scrape_timestamp", {"news_sitemap": 1, "rss": 2}, ["page_row"], "page_row", "stamp", "language")
    return m.select("source_id", "canonical", "n_rows", "strategies", "page_row", "first_capture", "last_capture", "n_indexes")


@query(
    "d10_work_queue",
    """with l as (select source_id, url, status, error, main_text from (select *, row_number() over (partition by source_id, url order by scrape_timestamp desc) as k from articles) where k=1), skip as (select source_id, url from l where not (coalesce(status,0)<>200 or coalesce(trim(error),'')<>'')),
    f as (select source_id, url, url_row from (select *, row_number() over (partition by source_id, url order by url_row) as k from gdelt_urls) where k=1) select f.url_row from f left join skip s on s.source_id=f.source_id and s.url=f.url where s.url is null""",
)
def _(spark, d):
    return C.work_queue(table(spark, d, "gdelt_urls"), table(spark, d, "articles"), "source_id", "url", ["url_row"], retry_errors=True).select("url_row")


@query(
    "d11_cumulative",
    """with s as (select wp_post_id as item, source_id as owner, cast(scrape_timestamp as date) as day, length(main_text) as k from articles where wp_post_id is not null), o as (select item, case when count(distinct owner)=1 and count(distinct day)=1 then max(owner) end as owner, max(day) as day, max(k) as k from s group by 1),
    a as (select owner, day, count(*) as n, coalesce(sum(k),0) as k from o where owner is not null group by 1,2), g as (select source_id, cast(unnest(generate_series(date '2024-01-01', date '2024-03-31', interval 1 day)) as date) as day from news_sources)
    select g.source_id as owner, g.day, coalesce(n,0) as n_items, coalesce(k,0) as k from g left join a on a.owner=g.source_id and a.day=g.day""",
)
def _(spark, d):
    s = table(spark, d, "articles").where("wp_post_id is not null").select(F.col("wp_post_id").alias("item"), F.col("source_id").alias("owner"), F.col("scrape_timestamp").cast("date").alias("day"), F.length("main_text").cast("long").alias("k"))
    owners = table(spark, d, "news_sources").select(F.col("source_id").alias("owner"))
    return P.cumulative_daily(s, "item", "owner", "day", ["k"], owners, "2024-01-01", "2024-03-31")


@query(
    "d12_reassemble",
    "select folio, count(*) as n_parts, arg_min(estado, contract_id) filter (where estado is not null) as estado, arg_min(importe, contract_id) filter (where importe is not null) as importe, arg_min(rfcb, contract_id) filter (where rfcb is not null) as rfcb from contracts group by 1",
)
def _(spark, d):
    return P.reassemble(table(spark, d, "contracts"), ["folio"], ["estado", "importe", "rfcb"], ["contract_id"])


@query(
    "d13_trend_panel",
    """with t as (select l_returnflag as term, l_linestatus as batch, cast(date_trunc('month', l_shipdate) as date) as date, sum(l_quantity) as v from lineitem group by 1,2,3), a as (select batch, date, v as av from t where term='A'), s as (select date, sum(v) as sv from t where term='A' group by 1),
    j as (select t.term, t.date, t.batch, t.v, av, sv, row_number() over (partition by t.term, t.date order by t.batch) as k from t left join a on a.batch=t.batch and a.date=t.date left join s on s.date=t.date where term<>'A') select term, date, v, round(case when av>0 then v/av*sv end,6) as "index" from j where k=1""",
)
def _(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("term"), F.col("l_linestatus").alias("batch"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg(F.sum("l_quantity").alias("v"))
    alone = t.where("term = 'A'").groupBy("date").agg(F.sum("v").alias("v"))
    return P.trend_panel(t, "term", "date", "batch", "v", "A", alone).withColumn("index", F.round("index", 6))


@query(
    "d14_evidence",
    """with truth as (select l_orderkey as k, sum(l_quantity) as v from lineitem group by 1), e as (select l_orderkey as k, cast(l_linenumber as varchar) as s, l_quantity as v from lineitem), r as (select s, count(*) as n, avg(cast(abs(e.v-t.v)<=30 as int)) as rate from e join truth t on t.k=e.k group by 1 having count(*)>=50 and avg(cast(abs(e.v-t.v)<=30 as int))>=0.05)
    select k, count(distinct e.s) as n_sources, max(v)-min(v)>30 as conflict, case when not max(v)-min(v)>30 then round(avg(v),6) end as v from e where s in (select s from r) group by 1""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    truth = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    e = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("string").alias("s"), F.col("l_quantity").alias("v"))
    return P.select_evidence(e, ["k"], "s", "v", truth, 30.0, 0.05, 50).withColumn("v", F.round("v", 6))


@query(
    "d15_turn_measures",
    """with t as (select conference_id, source_row, max(word_count) as w, bool_or(is_question_speaker) as q from transcript_rows group by 1,2), l as (select conference_id, source_row, lead(q) over (partition by conference_id order by source_row) = false as answered from t)
    select t.conference_id, sum(w) as n_words, sum(case when q then w end) as words_question, sum(case when not q then w end) as words_response, count(*) filter (where q) as n_questions, count(*) filter (where q and answered) as n_linked, round(cast(count(*) filter (where q and answered) as double)/nullif(count(*) filter (where q),0),8) as linked_share from t join l using (conference_id, source_row) group by 1""",
)
def _(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "transcript_rows").groupBy("conference_id", "source_row").agg(F.max("word_count").alias("n_words"), F.bool_or("is_question_speaker").alias("q"))
    t = t.withColumn("turn_id", F.concat_ws(":", "conference_id", "source_row")).withColumn("role", F.when(F.col("q"), "question").otherwise("response"))
    w = Window.partitionBy("conference_id").orderBy("source_row")
    links = t.withColumn("next_q", F.lead("q").over(w)).where("q and next_q = false").select(F.col("turn_id").alias("question_id"))
    return P.turn_measures(t, links, "conference_id").withColumn("linked_share", F.round("linked_share", 8))


@query(
    "d16_channel_totals",
    """with t as (select l_suppkey as ch, cast(l_shipdate as date) as day, sum(l_quantity) as q, count(*) as n from lineitem group by 1,2), x as (select s_suppkey as ch, s_nationkey as o from supplier) select o, day, round(sum(q),2) as q, cast(sum(n) as bigint) as n, round(sum(q)/sum(n),6) as q_per_item from t join x using (ch) group by 1,2""",
)
def _(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ch"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ch"), F.col("s_nationkey").alias("o"))
    return P.channel_totals(t, x, "ch", "o", "day", ["q"], "n").select("o", "day", F.round("q", 2).alias("q"), "n", F.round("q_per_item", 6).alias("q_per_item"))


QUERIES, ORACLES = query.queries, query.oracles
