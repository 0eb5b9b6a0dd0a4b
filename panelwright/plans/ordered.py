"""Queries of windows, ranks and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import ranking as L
from panelwright.operators import reshape as U
from panelwright.operators import windows as W
from panelwright.registry import Registry
from panelwright.sources.tables import table

query = Registry()

_GRID = "with e as (select user_id, cast(ts as date) as day, count(*) as n, max(cast(event_type='purchase' as int)) as bought, sum(value) as v from events group by 1,2)"


def _daily(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"), F.sum("value").alias("v")
    )


@query("w1_row_number", "select event_id, row_number() over (partition by user_id order by ts, event_id) as row_no from events")
def _(spark, d):
    return W.number_rows(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).select("event_id", "row_no")


@query("w2_lag_any", _GRID + " select user_id, day, coalesce(max(bought) over (partition by user_id order by day rows between 3 preceding and 1 preceding),0) as bought_before from e")
def _(spark, d):
    return W.lag_any(_daily(spark, d), ["user_id"], ["day"], "bought", 3, "bought_before").select("user_id", "day", "bought_before")


@query("w3_difference", _GRID + " select user_id, day, n - lag(n) over w as change, cast(day - last_value(case when bought=1 then day end ignore nulls) over (partition by user_id order by day rows between unbounded preceding and 1 preceding) as int) as days_since from e window w as (partition by user_id order by day)")
def _(spark, d):
    t = W.difference(_daily(spark, d), ["user_id"], ["day"], "n", "change")
    return W.days_since_event(t, ["user_id"], "day", F.col("bought") == 1, "days_since").select("user_id", "day", "change", "days_since")


@query("w4_trailing", _GRID + " select user_id, day, round(avg(n) over (partition by user_id order by day rows between 6 preceding and current row),8) as mean_7 from e")
def _(spark, d):
    return W.trailing_mean(_daily(spark, d), ["user_id"], ["day"], "n", 7, "mean_7").select("user_id", "day", F.round("mean_7", 8).alias("mean_7"))


@query("w5_centered", _GRID + " select user_id, day, case when count(n) over w = 4 then round(avg(n) over w,8) end as mean_4 from e window w as (partition by user_id order by day rows between 1 preceding and 2 following)")
def _(spark, d):
    return W.centered_mean(_daily(spark, d), ["user_id"], ["day"], "n", 1, 2, "mean_4").select("user_id", "day", F.round("mean_4", 8).alias("mean_4"))


@query(
    "w6_spell",
    _GRID + """, f as (select user_id, day, cast(bought=1 and n>=4 as int) as ask, cast(n=1 and bought=0 as int) as unknown from e)
    select user_id, day, case when max(ask) over w = 1 then 1 when max(unknown) over w = 1 then null else 0 end as in_spell from f window w as (partition by user_id order by day rows between 4 preceding and current row)""",
)
def _(spark, d):
    t = _daily(spark, d).select("user_id", "day", ((F.col("bought") == 1) & (F.col("n") >= 4)).cast("int").alias("ask"), ((F.col("n") == 1) & (F.col("bought") == 0)).cast("int").alias("unknown"))
    return W.spell_status(t, ["user_id"], ["day"], "ask", "unknown", 5).select("user_id", "day", "in_spell")


@query(
    "w7_event_labels",
    _GRID + """, s as (select user_id, day, case when n=1 then null when bought=1 then 1 else 0 end as s from e), a as (select *, case when s is not distinct from lag(s) over w and row_number() over w > 1 then 0 else 1 end as new from s window w as (partition by user_id order by day)),
    r as (select *, sum(new) over (partition by user_id order by day rows unbounded preceding) as run from a), p as (select *, row_number() over (partition by user_id, run order by day) as pos, count(*) over (partition by user_id, run) as size from r),
    g as (select user_id, run, max(s) as rs from p group by 1,2), h as (select *, lag(rs) over (partition by user_id order by run) as before, lead(rs) over (partition by user_id order by run) as after from g)
    select p.user_id, p.day, cast(case when s=1 and before=0 and pos<=5 then pos when s=0 and after=1 and size-pos+1<=5 then -(size-pos+1) end as bigint) as onset, cast(case when s=0 and before=1 and pos<=5 then pos when s=1 and after=0 and size-pos+1<=5 then -(size-pos+1) end as bigint) as "exit"
    from p join h using (user_id, run)""",
)
def _(spark, d):
    t = _daily(spark, d).select("user_id", "day", F.when(F.col("n") == 1, F.lit(None)).otherwise(F.col("bought")).cast("int").alias("s"))
    return W.event_labels(t, ["user_id"], ["day"], "s").select("user_id", "day", F.col("onset").cast("long").alias("onset"), F.col("exit").cast("long").alias("exit"))


@query(
    "w8_runs",
    """with t as (select distinct conference_id, source_row, participant_raw from transcript_rows where participant_raw is not null), u as (select conference_id, source_row, min(participant_raw) as label from t group by 1,2),
    a as (select *, case when label is not distinct from lag(label) over w and row_number() over w > 1 then 0 else 1 end as new from u window w as (partition by conference_id order by source_row))
    select conference_id, source_row, cast(sum(new) over (partition by conference_id order by source_row rows unbounded preceding) as bigint) as run_no from a""",
)
def _(spark, d):
    t = table(spark, d, "transcript_rows").where("participant_raw is not null").groupBy("conference_id", "source_row").agg(F.min("participant_raw").alias("label"))
    return W.runs(t, ["conference_id"], ["source_row"], "label").select("conference_id", "source_row", "run_no")


@query(
    "w9_blocks",
    """with u as (select conference_id, source_row, bool_or(is_question_speaker) as q from transcript_rows group by 1,2) select conference_id, source_row, last_value(case when q then source_row end ignore nulls) over (partition by conference_id order by source_row rows between unbounded preceding and current row) as block from u""",
)
def _(spark, d):
    t = table(spark, d, "transcript_rows").groupBy("conference_id", "source_row").agg(F.bool_or("is_question_speaker").alias("q"))
    return W.carry_forward(t, ["conference_id"], ["source_row"], F.when(F.col("q"), F.col("source_row")), "block").select("conference_id", "source_row", "block")


@query(
    "w10_interpolate",
    """with t as (select user_id, cast(ts as date) as day, max(case when event_type='view' then value end) as v from events group by 1,2), a as (select *, last_value(v ignore nulls) over b as pv, last_value(case when v is not null then day end ignore nulls) over b as pa,
    first_value(v ignore nulls) over f as nv, first_value(case when v is not null then day end ignore nulls) over f as na from t window b as (partition by user_id order by day rows between unbounded preceding and 1 preceding), f as (partition by user_id order by day rows between 1 following and unbounded following))
    select user_id, day, round(coalesce(v, pv+(nv-pv)*(day-pa)/(na-pa)),6) as filled, case when v is null then cast(na-pa as int) end as gap_days from a""",
)
def _(spark, d):
    t = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("v"))
    return W.interpolate(t, ["user_id"], "day", "v", "filled").select("user_id", "day", F.round("filled", 6).alias("filled"), "gap_days")


@query(
    "w11_outliers",
    _GRID + """ select user_id, day, coalesce((lead(day) over w - day) <= 4 and (day - lag(day) over w) <= 4 and abs(v-lag(v) over w) >= 100 and abs(v-lead(v) over w) >= 100 and sign(v-lag(v) over w) = sign(v-lead(v) over w), false) as outlier from e window w as (partition by user_id order by day)""",
)
def _(spark, d):
    return W.isolated_outliers(_daily(spark, d), ["user_id"], "day", "v", 100.0).select("user_id", "day", "outlier")


@query("w12_best_row", "select source_id, url, article_row from (select *, row_number() over (partition by source_id, url order by case when status=200 then 0 else 1 end, length(coalesce(main_text,'')) desc, article_row) as k from articles) where k=1")
def _(spark, d):
    order = [F.when(F.col("status") == 200, 0).otherwise(1), F.desc(F.length(F.coalesce("main_text", F.lit("")))), "article_row"]
    return W.best_row(table(spark, d, "articles"), ["source_id", "url"], order).select("source_id", "url", "article_row")


@query("w13_first_of_day", "select event_id, row_number() over (partition by cast(ts as date) order by ts, event_id) = 1 as is_first from events")
def _(spark, d):
    t = table(spark, d, "events").select("event_id", "ts", F.col("ts").cast("date").alias("day"))
    return W.first_and_rest(t, ["day"], ["ts", "event_id"]).select("event_id", "is_first")


@query("w14_time_index", _GRID + " select user_id, day, cast(dense_rank() over (partition by user_id order by day) as int) as t, cast(day - date '2024-01-01' + 1 as int) as day_no from e")
def _(spark, d):
    t = W.time_index(_daily(spark, d), ["user_id"], "day")
    return t.select("user_id", "day", "t", W.day_index(F.col("day"), "2024-01-01").alias("day_no"))


@query("w15_center", _GRID + " select user_id, day, round(n - avg(n) over (partition by day),8) as n_c from e")
def _(spark, d):
    return W.center(_daily(spark, d), ["day"], ["n"]).select("user_id", "day", F.round("n_c", 8).alias("n_c"))


@query(
    "w16_next_turn",
    """with u as (select conference_id, source_row, bool_or(is_question_speaker) as q, max(word_count) as w from transcript_rows group by 1,2)
    select conference_id, source_row, first_value(case when w>3 then source_row end ignore nulls) over (partition by conference_id order by source_row rows between 1 following and unbounded following) as next_row from u""",
)
def _(spark, d):
    t = table(spark, d, "transcript_rows").groupBy("conference_id", "source_row").agg(F.max("word_count").alias("w"))
    return W.next_where(t, ["conference_id"], ["source_row"], F.col("w") > 3, "source_row", "next_row").select("conference_id", "source_row", "next_row")


@query(
    "w17_evenly_spaced",
    "with t as (select distinct fecha as day from attendance), n as (select *, row_number() over (order by day) as k, count(*) over () as m from t) select day from n where k in (select cast(round_even(i*(m-1)/9, 0) as bigint)+1 from (select unnest(range(0,10)) as i, (select max(m) from n) as m))",
)
def _(spark, d):
    return W.evenly_spaced(table(spark, d, "attendance").select(F.col("fecha").alias("day")).distinct(), "day", 10)


@query("w18_eligible", _GRID + ", f as (select user_id, min(case when bought=1 then day end) as f from e group by 1) select user_id, day, coalesce(day >= f, false) as eligible from e join f using (user_id)")
def _(spark, d):
    return W.first_date_eligibility(_daily(spark, d), "user_id", "day", F.col("bought") == 1).select("user_id", "day", "eligible")


@query("l1_sorted", "select page_row, lastmod, title from sitemap_articles")
def _(spark, d):
    return L.sorted_rows(table(spark, d, "sitemap_articles").select("page_row", "lastmod", "title"), [("lastmod", True), ("title", False)], "page_row")


@query("l2_top_ties", "with t as (select medios, count(*) as n from attendance where medios is not null group by 1) select medios, n from (select *, rank() over (order by n desc) as k from t) where k <= 12")
def _(spark, d):
    return L.top_with_ties(table(spark, d, "attendance").where("medios is not null").groupBy("medios").agg(F.count("*").alias("n")), "n", 12)


@query("l3_top", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def _(spark, d):
    return L.top_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25)


@query("l4_top_per_group", "select o_orderpriority, o_orderkey, rank_no from (select *, cast(row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as int) as rank_no from orders) where rank_no <= 10")
def _(spark, d):
    return L.top_per_group(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 10).select("o_orderpriority", "o_orderkey", "rank_no")


_CHANGE = "with t as (select o_custkey, sum(case when year(o_orderdate)>=1998 then o_totalprice else -o_totalprice end) as change from orders group by 1)"


@query(
    "l5_extremes",
    _CHANGE + """ select o_custkey, 'increase' as direction, cast(k as int) as rank_no from (select *, row_number() over (order by change desc, o_custkey) as k from t where change>0) where k<=10
    union all select o_custkey, 'decrease', cast(k as int) from (select *, row_number() over (order by change, o_custkey) as k from t where change<0) where k<=10""",
)
def _(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.year("o_orderdate") >= 1998, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))).alias("change"))
    return L.extremes(t, "change", "o_custkey", 10).select("o_custkey", "direction", "rank_no")


@query("l6_nested", "with c as (select o_custkey from orders group by 1 order by count(*) desc, o_custkey limit 50) select o_orderkey, o_totalprice from orders where o_custkey in (select o_custkey from c) order by o_totalprice desc, o_orderkey limit 10")
def _(spark, d):
    o = table(spark, d, "orders")
    outer = L.top_rows(o.groupBy("o_custkey").agg(F.count("*").alias("n")), "n", "o_custkey", 50)
    return L.nested_top(o, outer, "o_custkey", "o_totalprice", "o_orderkey", 10).select("o_orderkey", "o_totalprice")


@query("l7_queue_head", "select url_row from gdelt_urls order by discovered_at desc nulls last, url_row limit 40")
def _(spark, d):
    return L.head_of_queue(table(spark, d, "gdelt_urls"), [F.desc_nulls_last("discovered_at"), "url_row"], 40).select("url_row")


@query("u1_union_by_name", "select source_id, url, null as title, 'articles' as tbl from articles union all select source_id, url, title, 'pages' from sitemap_articles")
def _(spark, d):
    a = table(spark, d, "articles").select("source_id", "url", F.lit("articles").alias("tbl"))
    b = table(spark, d, "sitemap_articles").select("source_id", "url", "title", F.lit("pages").alias("tbl"))
    return U.union_all([a, b])


@query("u2_distinct_first", "select source_id, url, url_row from (select *, row_number() over (partition by source_id, url order by discovered_at, url_row) as k from gdelt_urls) where k=1")
def _(spark, d):
    return U.distinct_on(table(spark, d, "gdelt_urls"), ["source_id", "url"], ["discovered_at", "url_row"]).select("source_id", "url", "url_row")


@query("u2_distinct_last", "select source_id, url, url_row from (select *, row_number() over (partition by source_id, url order by discovered_at desc nulls first, url_row desc) as k from gdelt_urls) where k=1")
def _(spark, d):
    return U.distinct_on(table(spark, d, "gdelt_urls"), ["source_id", "url"], [F.asc_nulls_last("discovered_at"), "url_row"], "last").select("source_id", "url", "url_row")


@query(
    "u3_set_members",
    "with a as (select distinct fecha as v from attendance), b as (select distinct date as v from transcript_rows) select coalesce(a.v,b.v) as value, a.v is not null as in_a, b.v is not null as in_b from a full join b on a.v=b.v",
)
def _(spark, d):
    return U.set_members(table(spark, d, "attendance").select(F.col("fecha").alias("day")), table(spark, d, "transcript_rows").select(F.col("date").alias("day")), "day")


@query("u4_missing_days", "with t as (select distinct date as day from transcript_rows), c as (select cast(unnest(generate_series((select min(day) from t), (select max(day) from t), interval 1 day)) as date) as day) select day from c where isodow(day) < 6 and day not in (select day from t)")
def _(spark, d):
    return U.missing_business_days(table(spark, d, "transcript_rows").select(F.col("date").alias("day")), "day")


@query("u5_same_rows", "select true as same, false as different")
def _(spark, d):
    from panelwright.operators.contracts import same_rows

    n = table(spark, d, "nation")
    return spark.createDataFrame([(same_rows(n, n.orderBy(F.desc("n_nationkey"))), same_rows(n, n.limit(5)))], "same boolean, different boolean")


@query(
    "u6_wide",
    "select user_id, count(*) filter (where event_type='view') as n_view, count(*) filter (where event_type='click') as n_click, round(sum(value) filter (where event_type='view'),2) as v_view, round(sum(value) filter (where event_type='click'),2) as v_click from events where event_type in ('view','click') group by 1",
)
def _(spark, d):
    t = table(spark, d, "events").where("event_type in ('view','click')").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return U.wide(t, ["user_id"], "event_type", ["n", "v"], ["view", "click"]).na.fill(0, ["n_view", "n_click"])


@query("u7_long", "select l_orderkey, l_linenumber, name, value from (unpivot (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name name value value)")
def _(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return U.long(t, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("u8_split", "select alias_id, part from (select alias_id, trim(regexp_replace(unnest(string_split_regex(alias, '[/,]')), '^\\s+|\\s+$', '', 'g')) as part from question_aliases) where part <> ''")
def _(spark, d):
    return U.split_rows(table(spark, d, "question_aliases").select("alias_id", "alias"), "alias", "[/,]", "part").select("alias_id", "part")


@query("u9_extract", "select article_row, unnest(regexp_extract_all(title, '[0-9]+')) as number from articles")
def _(spark, d):
    return U.extract_rows(table(spark, d, "articles").select("article_row", "title"), "title", "[0-9]+", "number").select("article_row", "number")


@query("u10_dummies", "select event_id, cast(event_type='view' as int) as is_view, cast(event_type='click' as int) as is_click, cast(event_type='error' as int) as is_error from events")
def _(spark, d):
    return U.dummies(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["view", "click", "error"], "is_").drop("event_type")


@query("u11_grid", "select cast(row_number() over (order by w, t, k) as bigint) as grid_no, w as width, t as transform, k as kind from (values (1),(2),(3)) a(w) cross join (values ('asinh'),('log')) b(t) cross join (values (10),(20)) c(k)")
def _(spark, d):
    return U.parameter_grid(spark, {"width": [1, 2, 3], "transform": ["asinh", "log"], "kind": [10, 20]}).select(F.col("grid_no").cast("long").alias("grid_no"), F.col("width").cast("int").alias("width"), "transform", F.col("kind").cast("int").alias("kind"))


@query(
    "u13_assumed",
    """with a as (select distinct fecha, outlet_final, false as assumed from attendance where outlet_final is not null), g as (select distinct fecha from a where outlet_final like 'radio%'), h as (select fecha from a where outlet_final='pool de prensa')
    select * from a union all select fecha, 'pool de prensa', true from g where fecha not in (select fecha from h)""",
)
def _(spark, d):
    a = table(spark, d, "attendance").where("outlet_final is not null").select("fecha", "outlet_final").distinct()
    step = lambda x: U.assumed_rows(x, "outlet_final", "fecha", F.col("outlet_final").like("radio%"), "pool de prensa")
    return step(step(a))


QUERIES, ORACLES = query.queries, query.oracles
