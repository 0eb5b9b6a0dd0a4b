"""Queries of scalar functions: keys, dates, numbers and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import dates as D
from panelwright.functions import keys as K
from panelwright.functions import markup as M
from panelwright.functions import numbers as N
from panelwright.operators import crawl as C
from panelwright.registry import Registry
from panelwright.sources.tables import table

query = Registry()
_KEY = "nullif(trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g')), '')"


@query("f1_panel_key", f"select attendance_row, case when {_KEY.format('medios')} = 'freelance' then 'independiente' else {_KEY.format('medios')} end as key from attendance")
def _(spark, d):
    return table(spark, d, "attendance").select("attendance_row", K.panel_key(F.col("medios"), {"freelance": "independiente"}).alias("key"))


@query("f2_label_key", f"select outlet_id, {_KEY.format('outlet_name')} as key from outlet_registry")
def _(spark, d):
    return table(spark, d, "outlet_registry").select("outlet_id", K.label_key(F.col("outlet_name")).alias("key"))


@query(
    "f3_payee_key",
    r"""with a as (select contract_id, trim(regexp_replace(regexp_replace(lower(strip_accents(beneficiario)), '[.,;:''"()]', '', 'g'), '[^a-z0-9&]+', ' ', 'g')) as k from contracts)
    select contract_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(k, ' s de rl de cv$', ''), ' sapi de cv$', ''), ' sa de cv$', ''), ' sa$', ''), ' sc$', ''), ' ac$', ''), ' cv$', '')), '') as payee from a""",
)
def _(spark, d):
    return table(spark, d, "contracts").select("contract_id", K.payee_key(F.col("beneficiario")).alias("payee"))


@query("f4_name_key", r"select contract_id, nullif(trim(regexp_replace(lower(strip_accents(beneficiario)), '\s+', ' ', 'g')), '') as name from contracts")
def _(spark, d):
    return table(spark, d, "contracts").select("contract_id", K.name_key(F.col("beneficiario")).alias("name"))


@query(
    "f5_channel_token",
    "select url_row, nullif(lower(regexp_replace(regexp_extract(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1), '^@', '')), '') as token from gdelt_urls",
)
def _(spark, d):
    return table(spark, d, "gdelt_urls").select("url_row", K.channel_token(F.col("url")).alias("token"))


@query("f6_canonical_url", "select url_row, case when regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]') then lower(regexp_extract(regexp_replace(trim(url), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)', 1)) || substr(regexp_replace(trim(url), '#.*$', ''), 1 + length(regexp_extract(regexp_replace(trim(url), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)', 1))) end as canonical from gdelt_urls")
def _(spark, d):
    return table(spark, d, "gdelt_urls").select("url_row", K.canonical_url(F.col("url")).alias("canonical"))


@query(
    "f6_without_tracking",
    r"""select page_row, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '([?&])(((utm_[a-z]+|fbclid|gclid|ref|amp)=[^&#]*)&)*((utm_[a-z]+|fbclid|gclid|ref|amp)=[^&#]*)(&|#|$)', '\1\7', 'gi'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+(#|$)', '\1', 'g') as clean from sitemap_articles""",
)
def _(spark, d):
    return table(spark, d, "sitemap_articles").select("page_row", K.without_tracking(F.col("url")).alias("clean"))


@query("f7_slug", "select article_row, nullif(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') as slug from articles")
def _(spark, d):
    return table(spark, d, "articles").select("article_row", K.slug(F.col("title")).alias("slug"))


_SLUG = "nullif(regexp_replace(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"


@query(
    "f8_stable_ids",
    f"""with t as (select outlet_id, coalesce({_SLUG.format('medio')}, 'x') as b, {_SLUG.format('estado')} as s from outlet_registry), w as (select outlet_id, case when count(*) over (partition by b) = 1 then b else concat_ws('-', b, s) end as w from t),
    k as (select *, row_number() over (partition by w order by outlet_id) as k from w) select outlet_id, case when k = 1 then w else w || '-' || k end as stable_id from k""",
)
def _(spark, d):
    return C.stable_ids(table(spark, d, "outlet_registry").select("outlet_id", "medio", "estado"), "medio", "estado", "outlet_id").select("outlet_id", "stable_id")


@query("f9_topic_match", f"select article_row, regexp_matches(coalesce({_KEY.format('title')}, case when title is not null then '' end), '\\b(becas|vacunacion|homicidios)\\b') as on_topic from articles")
def _(spark, d):
    return table(spark, d, "articles").select("article_row", K.matches_any(F.col("title"), ("becas", "vacunacion", "homicidios")).alias("on_topic"))


@query("f10_label_dummies", f"select outlet_id, cast(regexp_matches(coalesce({_KEY.format('outlet_name')},''), '\\btv\\b') as int) as word_tv, cast(contains(coalesce({_KEY.format('outlet_name')},''), 'tele') as int) as any_tele from outlet_registry")
def _(spark, d):
    n = F.col("outlet_name")
    return table(spark, d, "outlet_registry").select("outlet_id", K.label_dummy(n, "tv", True).alias("word_tv"), K.label_dummy(n, "tele", False).alias("any_tele"))


@query(
    "f11_speaker_label",
    r"select conference_id, source_row, min(participant_raw) as label, bool_or(regexp_full_match(regexp_replace(trim(regexp_replace(upper(strip_accents(participant_raw)), '\s+', ' ', 'g')), ':+$', ''), '(PREGUNTA|INTERLOCUTOR)(A|S|AS|ES)?( .*)?')) as unnamed from transcript_rows where participant_raw is not null group by 1,2",
)
def _(spark, d):
    t = table(spark, d, "transcript_rows").where("participant_raw is not null").groupBy("conference_id", "source_row")
    return t.agg(F.min("participant_raw").alias("label"), F.bool_or(K.unnamed_label(F.col("participant_raw"))).alias("unnamed"))


@query("f12_stage_directions", r"select conference_id, source_row, min(trim(regexp_replace(regexp_replace(text, '\([^()\n]*\)|\[[^\[\]\n]*\]', ' ', 'g'), '\s+', ' ', 'g'))) as spoken from transcript_rows group by 1,2")
def _(spark, d):
    return table(spark, d, "transcript_rows").groupBy("conference_id", "source_row").agg(F.min(K.without_stage_directions(F.col("text"))).alias("spoken"))


@query("f13_word_count", r"select doc_id, case when text is not null then cast(len(list_filter(string_split_regex(trim(text, ' '), '[ \t\n\x0B\f\r]+'), x -> x <> '')) as int) end as n_words from documents".replace("x -> x <> ''", "lambda x: x <> ''"))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", K.word_count(F.col("text")).alias("n_words"))


@query(
    "f14_names_text",
    f"""with t as (select accred_id, list_distinct(list_filter(string_split(coalesce({_KEY.format('reporter')},''),' '), lambda w: w<>'')) as n, string_split(coalesce({_KEY.format("reporter || ' ' || coalesce(medios,'')")},''),' ') as x from accreditations)
    select accred_id, len(list_filter(n, lambda w: list_contains(x, w))) > 0 and len(list_filter(n, lambda w: list_contains(x, w))) >= len(n)-1 as named from t""",
)
def _(spark, d):
    return table(spark, d, "accreditations").select("accred_id", K.names_text(F.col("reporter"), F.concat_ws(" ", "reporter", "medios")).alias("named"))


@query(
    "f15_title_case",
    """with t as (select outlet_id, array_to_string(list_transform(string_split(lower(canonical_id), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as s from outlet_registry)
    select outlet_id, array_to_string(list_transform(string_split(s, ' '), lambda w, i: case when w in ('De', 'La') and i > 1 and i < len(string_split(s, ' ')) then lower(w) when w = 'Tv' then 'TV' else w end), ' ') as title from t""",
)
def _(spark, d):
    return table(spark, d, "outlet_registry").select("outlet_id", K.title_case(F.col("canonical_id"), ("de", "la"), {"Tv": "TV"}).alias("title"))


@query("f16_distinct_lines", "select article_row, array_to_string(list_filter(string_split(main_text, chr(10)), lambda x, i: list_position(string_split(main_text, chr(10)), x) = i), chr(10)) as main_text from articles")
def _(spark, d):
    return table(spark, d, "articles").select("article_row", K.distinct_lines(F.col("main_text")).alias("main_text"))


@query("f17_quote_offset", "select article_row, case when length(t)>0 and (length(main_text)-length(replace(main_text,t,'')))/length(t)=1 then cast(instr(main_text,t)-1 as int) end as at from (select *, substr(main_text,11,40) as t from articles)")
def _(spark, d):
    q = F.substring("main_text", 11, 40)
    return table(spark, d, "articles").select("article_row", K.quote_offset(q, F.col("main_text")).cast("int").alias("at"))


@query("f18_fingerprint", "select article_row, sha256(main_text) as digest from articles")
def _(spark, d):
    return table(spark, d, "articles").select("article_row", K.fingerprint(F.col("main_text")).alias("digest"))


@query("f20_mixed_dates", "select page_row, cast(try_cast(date as timestamp) as date) as day from sitemap_articles")
def _(spark, d):
    return table(spark, d, "sitemap_articles").select("page_row", D.mixed_utc_date(F.col("date")).alias("day"))


@query("f21_period_start", "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month, cast(date_trunc('year', o_orderdate) as date) as year, cast(date_trunc('week', o_orderdate) as date) as week from orders")
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", D.period_start(day, "month").alias("month"), D.period_start(day, "year").alias("year"), D.period_start(day, "week").alias("week"))


@query("f22_quarter", "select o_orderkey, year(o_orderdate)::varchar || 'Q' || quarter(o_orderdate)::varchar as q from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.quarter_label(F.col("o_orderdate")).alias("q"))


@query("f23_calendar", "select cast(unnest(generate_series(date '2024-01-03', date '2024-12-31', interval 7 day)) as date) as day")
def _(spark, d):
    return D.calendar(spark, "2024-01-03", "2024-12-31", "7 day", "day")


@query(
    "f24_business_days",
    "with c as (select cast(x as date) as day from (select unnest(generate_series(date '2000-01-03', date '2030-12-31', interval 1 day)) as x)), b as (select day, row_number() over (order by day) as k from c where isodow(day)<6), f as (select distinct fecha from attendance where isodow(fecha)<6) select fecha, b2.day as third_after from f join b b1 on b1.day=fecha join b b2 on b2.k=b1.k+3",
)
def _(spark, d):
    t = table(spark, d, "attendance").select("fecha").distinct().where(D.is_business_day(F.col("fecha")))
    return t.select("fecha", D.business_add(F.col("fecha"), 3).alias("third_after"))


@query("f25_months_before", "select distinct fecha, cast(fecha - interval 6 month as date) as before from attendance")
def _(spark, d):
    return table(spark, d, "attendance").select("fecha").distinct().select("fecha", D.months_before(F.col("fecha"), 6).alias("before"))


@query(
    "f26_url_date",
    "select page_row, try_cast(nullif(regexp_extract(url, '/((19|20)[0-9]{2})[/-]([0-9]{2})[/-]([0-9]{2})([/_.-]|$)', 1),'') || '-' || regexp_extract(url, '/((19|20)[0-9]{2})[/-]([0-9]{2})[/-]([0-9]{2})([/_.-]|$)', 3) || '-' || regexp_extract(url, '/((19|20)[0-9]{2})[/-]([0-9]{2})[/-]([0-9]{2})([/_.-]|$)', 4) as date) as day from sitemap_articles",
)
def _(spark, d):
    return table(spark, d, "sitemap_articles").select("page_row", D.url_date(F.col("url")).alias("day"))


_ES = "(?i)([0-9]{1,2}) de (enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre) de ([0-9]{4})"


@query(
    "f26_spanish_date",
    f"""with t as (select article_row, regexp_extract(date_published, '{_ES}', 1) as d, lower(regexp_extract(date_published, '{_ES}', 2)) as m, regexp_extract(date_published, '{_ES}', 3) as y from articles)
    select article_row, case when d <> '' then try_cast(y || '-' || lpad(cast(list_position(['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'], m) as varchar), 2, '0') || '-' || lpad(d, 2, '0') as date) end as day from t""",
)
def _(spark, d):
    return table(spark, d, "articles").select("article_row", D.spanish_date(F.col("date_published")).alias("day"))


@query(
    "f27_year_near",
    "with t as (select article_row, cast(scrape_timestamp as date) as seen, make_date(year(scrape_timestamp), 11, 5) as a, make_date(year(scrape_timestamp)-1, 11, 5) as b from articles where scrape_timestamp is not null) select article_row, case when a <= seen then a else b end as day from t",
)
def _(spark, d):
    t = table(spark, d, "articles").where("scrape_timestamp is not null")
    return t.select("article_row", D.day_month_near(F.lit(5), F.lit(11), F.col("scrape_timestamp").cast("date")).alias("day"))


@query(
    "f28_date_windows",
    "select cast(row_number() over (order by a) as int) as window_no, a as from_date, least(a + 6, date '2024-01-31') as to_date from (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 7 day)) as date) as a)",
)
def _(spark, d):
    return D.date_windows(spark, "2024-01-01", "2024-01-31", 7)


@query("f30_logs", "select contract_id, round(ln(1+importe),8) as l1, round(asinh(importe),8) as ash from contracts")
def _(spark, d):
    return table(spark, d, "contracts").select("contract_id", F.round(F.log1p("importe"), 8).alias("l1"), F.round(F.asinh("importe"), 8).alias("ash"))


@query("f31_winsorize", "with q as (select quantile_cont(o_totalprice,0.99) as hi, quantile_cont(o_totalprice,0.01) as lo from orders) select o_orderkey, round(greatest(least(o_totalprice,hi),lo),4) as price_w from orders, q")
def _(spark, d):
    t = N.winsorize(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), ["price"], 0.99, 0.01)
    return t.select("o_orderkey", F.round("price_w", 4).alias("price_w"))


@query("f32_zero_safe", "with m as (select min(case when l_discount>0 then l_discount end) as lo from lineitem) select l_orderkey, l_linenumber, round(case when l_discount>0 then ln(l_discount) else ln(lo) end,8) as pooled, round(case when l_discount>0 then ln(l_discount) else -4 end,8) as fixed from lineitem, m")
def _(spark, d):
    t = N.zero_safe_log(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", "pooled")
    return t.select("l_orderkey", "l_linenumber", F.round("pooled", 8).alias("pooled"), F.round(N.log_floor(F.col("l_discount")), 8).alias("fixed"))


@query("f33_negative_safe", "select c_custkey, round(case when c_acctbal>=0 then ln(1+c_acctbal) end,8) as l from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(N.log1p_or_null(F.col("c_acctbal")), 8).alias("l"))


@query(
    "f34_haversine",
    "with t as (select s_suppkey, s_nationkey*3.0-30 as la, s_nationkey*7.0-90 as lo, s_suppkey%60-20.0 as lb, s_suppkey%170-80.0 as lp from supplier) select s_suppkey, round(2*6371.0088*asin(least(1.0,sqrt(power(sin((radians(lb)-radians(la))/2),2)+cos(radians(la))*cos(radians(lb))*power(sin((radians(lp)-radians(lo))/2),2)))),4) as km from t",
)
def _(spark, d):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.round(N.haversine_km(n * 3.0 - 30, n * 7.0 - 90, k % 60 - 20.0, k % 170 - 80.0), 4).alias("km"))


@query("f35_ratios", "select contract_id, round(case when costo>0 then importe/costo end,8) as or_null, round(case when costo>0 then importe/costo when costo is not null then 0 end,8) as or_zero from contracts")
def _(spark, d):
    a, b = F.col("importe"), F.col("costo")
    return table(spark, d, "contracts").select("contract_id", F.round(N.ratio_or_null(a, b), 8).alias("or_null"), F.round(N.ratio_or_zero(a, b), 8).alias("or_zero"))


@query("f36_anchored", "select l_orderkey, l_linenumber, round(case when l_tax>0 then l_discount/l_tax*l_quantity end,8) as idx from lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.anchored_index(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")), 8).alias("idx"))


@query("f37_standardize", "with m as (select avg(c_acctbal) as a, stddev_samp(c_acctbal) as s from customer) select c_custkey, round((c_acctbal-a)/s,8) as z from customer, m")
def _(spark, d):
    return N.standardize(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "z").select("c_custkey", F.round("z", 8).alias("z"))


@query("f38_round", "select o_orderkey, round_even(o_totalprice/7, 3) as r from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.bround(F.col("o_totalprice") / 7, 3).alias("r"))


@query("f40_json_field", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", M.json_field(F.col("props"), "$.k").cast("int").alias("k"))


_HTML = "concat('<html><head><title>', title, '</title><meta property=\"og:title\" content=\"', replace(title, '\"', ''), '\"><link rel=\"canonical\" href=\"', canonical_url, '\"></head><body><nav>x</nav><article><p>', replace(main_text, '\\n', '</p><p>'), '</p></article></body></html>')"


@query("f42_meta_tags", "select page_row, nullif(trim(regexp_replace(replace(title, '\"', ''), '', '')), '') as og, nullif(canonical_url, '') as canonical from sitemap_articles where title is not null and canonical_url is not null and main_text is not null")
def _(spark, d):
    t = table(spark, d, "sitemap_articles").where("title is not null and canonical_url is not null and main_text is not null")
    h = F.expr(_HTML)
    return t.select("page_row", M.meta_content(h, "og:title").alias("og"), M.link_href(h, "canonical").alias("canonical"))


@query(
    "f41_json_ld",
    """select article_row, title as headline, date_published as published, date_modified as modified, nullif(array_to_string(list_distinct_in_order, '; '), '') as authors
    from (select *, list_filter(l, lambda x, i: list_position(l, x) = i) as list_distinct_in_order from (select *, list_filter(list_transform(string_split(authors, ','), lambda x: trim(x, ' ')), lambda x: x <> '') as l from articles))""",
)
def _(spark, d):
    names = F.transform(F.split("authors", ","), lambda x: F.struct(F.lit("Person").alias("@type"), x.alias("name")))
    item = F.struct(F.lit("NewsArticle").alias("@type"), F.col("title").alias("headline"), F.col("date_published").alias("datePublished"), F.col("date_modified").alias("dateModified"), names.alias("author"))
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("WebSite").alias("@type"))).alias("@graph")))
    page = F.concat(F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">'), graph, F.lit('</script><script type="application/ld+json">['), F.to_json(item), F.lit("]</script></html>"))
    return M.json_ld(table(spark, d, "articles").select("article_row", page.alias("html")), "article_row", "html")


@query("f43_page_fields")
def _(spark, d):
    t = table(spark, d, "sitemap_articles").where("title is not null and main_text is not null").select("page_row", F.expr(_HTML.replace("canonical_url", "coalesce(canonical_url, url)")).alias("html"))
    return M.page_fields(t, "page_row", "html").select("page_row", "title", "canonical", F.length("main_text").alias("n_chars"))


@query("f44_feed_entries", "select distinct source_id, 'sitemap' as kind, trim(url) as url from sitemap_articles where trim(url) <> ''")
def _(spark, d):
    one = F.concat(F.lit("<url><loc>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</loc></url>"))
    t = table(spark, d, "sitemap_articles").groupBy("source_id").agg(F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_set(one)), ""), F.lit("</urlset>")).alias("xml"))
    return M.feed_entries(t, "source_id", "xml").select("source_id", "kind", "url")


@query(
    "f45_names_of_ids",
    "with t as (select n_regionkey, string_agg(cast(n_nationkey as varchar), ',' order by n_nationkey) as ids from nation group by 1) select n_regionkey, (select string_agg(n_name, ', ' order by n_nationkey) from nation n where n.n_regionkey=t.n_regionkey and n_nationkey%2=0) as names from t",
)
def _(spark, d):
    n = table(spark, d, "nation")
    t = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: x.cast("string")), ",").alias("ids"))
    return M.names_of_ids(t, "n_regionkey", "ids", ",", n.where("n_nationkey % 2 = 0"), "n_nationkey", "n_name", "names").select("n_regionkey", "names")


@query(
    "f46_page_flags",
    "select page_row, array_to_string(list_filter([case when regexp_matches(main_text,'(?is)suscr[ií]b|newsletter') then 'newsletter' end, case when regexp_matches(main_text,'(?is)cookies') then 'cookies' end, case when regexp_matches(main_text,'(?is)iniciar sesi[oó]n|log in') then 'login' end], lambda x: x is not null), ',') as flags from sitemap_articles where main_text is not null",
)
def _(spark, d):
    flags = M.page_flags(F.col("main_text"), {"newsletter": "suscr[ií]b|newsletter", "cookies": "cookies", "login": "iniciar sesi[oó]n|log in"})
    return table(spark, d, "sitemap_articles").where("main_text is not null").select("page_row", F.array_join(flags, ",").alias("flags"))


@query("f47_recommend", "select page_row, case when status<>200 then 'retry' when main_text is null then 'render' when length(main_text)<400 then 'inspect' else 'keep' end as advice from sitemap_articles")
def _(spark, d):
    rules = [(F.col("status") != 200, "retry"), (F.col("main_text").isNull(), "render"), (F.length("main_text") < 400, "inspect")]
    return table(spark, d, "sitemap_articles").select("page_row", C.recommend(rules, "keep").alias("advice"))


QUERIES, ORACLES = query.queries, query.oracles
