import datetime
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import dates, keys, markup, numbers
from panelwright.operators import aggregates as A
from panelwright.operators import contracts as Q
from panelwright.operators import crawl, joins, panel, reshape, select, windows
from panelwright.plans import joining, selections
from panelwright.sources import tables
from panelwright.stats import effects

D = datetime.date


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "fn,value,want",
    [
        (keys.label_key, "  Él  Ñandú—GROẞ! ", "el nandu gross"), (keys.label_key, "...", None), (keys.label_key, None, None), (keys.channel_token, "https://x.mx/@Handle/?x=1", "handle"),
        (lambda c: keys.channel_token(c, ("videos",)), "https://x.mx/@Handle/videos?x=1", "handle"), (keys.canonical_url, "HTTPS://A.mx/B?q=1#z", "https://a.mx/B?q=1"), (keys.canonical_url, "nothing", None),
        (keys.without_tracking, "http://a.mx/b?utm_source=f&x=1&ref=2#k", "http://a.mx/b?x=1#k"), (keys.without_tracking, "http://a.mx/b?utm_source=f", "http://a.mx/b"), (keys.slug, "¿Qué Pasó, eh?", "que-paso-eh"),
        (keys.word_count, "", 0), (keys.word_count, " a  b ", 2), (keys.distinct_lines, "a\nb\na", "a\nb"), (keys.without_stage_directions, "hola (risas) [x] fin", "hola fin"),
        (keys.unnamed_label, "Interlocutora:", True), (keys.unnamed_label, "MODERADOR", False), (dates.spanish_date, "a 4 de julio de 2022, 09:29", D(2022, 7, 4)), (dates.spanish_date, "31 de febrero de 2022", None),
        (markup.duration_seconds, "PT1H2M3S", 3723), (markup.duration_seconds, "P1DT1S", 86401), (markup.duration_seconds, "x", None), (dates.url_date, "https://a.mx/2023/02/31/x", None),
    ],
)
def test_functions(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_quote_must_stand_once(spark):
    df = spark.createDataFrame([("ab", "xxabyy"), ("ab", "abab"), ("ab", "x"), ("", "x"), (None, "x")], "q string, t string")
    assert [r[0] for r in df.select(keys.quote_offset(F.col("q"), F.col("t"))).collect()] == [2, None, None, None, None]


def test_spell(spark):
    def run(ask, unknown=None):
        unknown = unknown or [0] * len(ask)
        df = spark.createDataFrame([(1, i, a, u) for i, (a, u) in enumerate(zip(ask, unknown, strict=True))], "g int, i int, ask int, unknown int")
        return [r["in_spell"] for r in windows.spell_status(df, ["g"], ["i"], "ask", "unknown", 5).orderBy("i").collect()]

    assert run([1, 0, 0, 0, 0, 0, 0]) == [1, 1, 1, 1, 1, 0, 0]
    assert run([1, 0, 0, 1, 0, 0, 0, 0, 0]) == [1] * 8 + [0]
    assert run([0] * 6, [1, 0, 0, 0, 0, 0]) == [None] * 5 + [0]
    assert run([0, 1, 0], [1, 0, 0]) == [None, 1, 1]


def test_event_labels(spark):
    def run(states, name):
        df = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)], "g int, i int, s int")
        return [r[name] for r in windows.event_labels(df, ["g"], ["i"], "s").orderBy("i").collect()]

    s = [0] * 6 + [1] * 5 + [0] * 6
    assert run(s, "onset") == [None, -5, -4, -3, -2, -1, 1, 2, 3, 4, 5] + [None] * 6
    assert run(s, "exit") == [None] * 6 + [-5, -4, -3, -2, -1, 1, 2, 3, 4, 5, None]
    assert run([0, None, 1], "onset") == [None] * 3


def test_interpolation(spark):
    days = [D(2024, 1, k) for k in (1, 2, 3, 4, 5)]
    df = spark.createDataFrame([(1, d, v) for d, v in zip(days, [10.0, None, None, 40.0, None], strict=True)], "g int, day date, v double")
    got = [(r["f"], r["gap_days"]) for r in windows.interpolate(df, ["g"], "day", "v", "f", 3).orderBy("day").collect()]
    assert got == [(10.0, None), (20.0, 3), (30.0, 3), (40.0, None), (None, None)]


def test_observed_panel_tells_zero_from_unknown(spark):
    people = spark.createDataFrame([("a",), ("b",)], "e string")
    daily = spark.createDataFrame([("a", D(2024, 1, 1), 2.0)], "e string, date date, v double")
    seen = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 2),)], "date date")
    got = {(r["e"], r["date"].day): r["v"] for r in panel.observed_panel(people, daily, "e", "date", "2024-01-01", "2024-01-03", ["v"], seen).collect()}
    assert got == {("a", 1): 2.0, ("a", 2): 0.0, ("a", 3): None, ("b", 1): None, ("b", 2): None, ("b", 3): None}
    with pytest.raises(Q.ContractError):
        panel.balanced_panel(people.unionByName(people), ["e"], "2024-01-01", "2024-01-02")


def test_history_refuses_the_cutoff(spark):
    days = spark.createDataFrame([("a", D(2024, 1, 5), 1.0, True)], "e string, day date, v double, seen boolean")
    w = panel.history_windows(spark, "2024-02-01", {"m": (1, 0)})
    got = panel.summarize_history(days, w, "e", "day", ["v"], "seen", "2024-02-01").first()
    assert (got["n_observed"], got["v"], got["v_per_day"]) == (1, 1.0, 1.0)
    with pytest.raises(Q.ContractError):
        panel.summarize_history(days.withColumn("day", F.lit("2024-02-01").cast("date")), w, "e", "day", ["v"], "seen", "2024-02-01")


def test_aggregates_by_null_policy(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, None)], "g int, v double")
    got = {r["g"]: (r["z"], r["n"], r["c"], r["d"]) for r in df.groupBy("g").agg(A.sum_or_zero(F.col("v")).alias("z"), A.sum_or_null(F.col("v")).alias("n"), A.sum_if_complete(F.col("v"), 2).alias("c"), A.distinct_with_null(F.col("v")).alias("d")).collect()}
    assert got == {1: (0.0, None, None, 1), 2: (3.0, 3.0, None, 2)}


def test_winsorize_and_logs(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "v double")
    got = sorted(r["v_w"] for r in numbers.winsorize(df, ["v"], 0.99, 0.01).collect() if r["v_w"] is not None)
    assert (got[0], got[-1], len(got)) == (1.0, 99.0, 101)
    assert one(spark, 0.0, numbers.log_floor, "double") == -4.0


def test_unambiguous_pairs(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "z"), ("c", "z"), ("d", None), ("e", "w")], "l string, r string")
    assert sorted(map(tuple, joins.unambiguous_pairs(df, "l", "r").collect())) == [("a", "x"), ("e", "w")]


@pytest.mark.parametrize("threshold", [0.97, 0.7])
def test_fuzzy_pairs_are_those_of_all_pairs(spark, threshold):
    rng = np.random.default_rng(5)
    names = {"agecnia lopaslucas", "agencia lopaslucas", "gruo jumilttanza", "grupo jumiltanza", "a", "ab", "ba", "abc", "acb", "abcd", "abdc", "", "ñandú x", "ñandu x"}
    for base in ("el faro de cuzanhuaco", "radio nasal", "la voz", "diario vevilrosa", "canal 22", "la verdad de las regiones del norte y del sur de la patria"):
        for _ in range(40):
            w = list(base)
            for _ in range(rng.integers(1, 4)):
                i = int(rng.integers(0, len(w)))
                how = rng.integers(0, 3)
                if how == 0:
                    del w[i]
                elif how == 1:
                    w.insert(i, "aeiourstz"[rng.integers(0, 9)])
                elif i:
                    w[i - 1], w[i] = w[i], w[i - 1]
            names.add("".join(w))
    got = {(r["left"], r["right"]) for r in joins.fuzzy_pairs(spark.createDataFrame([*((x,) for x in names), (None,)], "n string"), "n", threshold).collect()}
    want = {(a, b) for a in names for b in names if a < b and joins.jaro_winkler(a, b) >= threshold}
    assert got == want
    assert ("agecnia lopaslucas", "agencia lopaslucas") in got


def test_clusters_and_representatives(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "l string, r string")
    m = joins.clusters(links, "l", "r")
    assert sorted(map(tuple, m.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    n = spark.createDataFrame([("a", 1), ("c", 5), ("x", 2), ("y", 2)], "member string, n long")
    assert sorted(map(tuple, joins.representatives(m, n).collect())) == [("a", "c"), ("x", "x")]


def test_discoveries_and_queue(spark):
    rows = [("s", "http://A.mx/1", "cdx", "2025-01-03", "old", 1), ("s", "http://a.mx/1#f", "sitemap", "2025-02-01", "new", 2), ("s", None, "x", "2025-01-01", "z", 3)]
    df = spark.createDataFrame(rows, "source string, url string, strategy string, seen string, title string, k int")
    got = crawl.merge_discoveries(df, "source", "url", "strategy", "seen", {"sitemap": 1}, ["title"], "k").collect()
    assert len(got) == 1 and (got[0]["title"], got[0]["strategies"], got[0]["first_seen"], got[0]["n_rows"]) == ("new", "sitemap;cdx", "2025-01-03", 2)
    # A source's variants of one URL fold into one; the best strategy comes first, whatever came first.
    rows = [("r", "http://r.mx/story/ar123456?v=3#x", "archive", None, "I1", "20250103040506", 1), ("r", "https://www.r.mx/story/ar123456", "official", "2026-01-02", None, None, 2), ("r", "nowhere", "official", None, None, None, 3), ("r", "http://r.mx/b?q=1", None, None, "I1", "bad", 4)]
    df = spark.createDataFrame(rows, "source string, url string, strategy string, lastmod string, ix string, stamp string, k int")
    got = crawl.merge_discoveries(df, "source", "url", "strategy", "lastmod", {"official": 1, "archive": 3}, ["lastmod"], "k", "stamp", "ix", {"r": (r"/(?:ar|op)\d+/?$", "www.r.mx")}).orderBy("canonical").collect()
    assert [r["canonical"] for r in got] == ["http://r.mx/b?q=1", "https://www.r.mx/story/ar123456"]
    assert (got[1]["lastmod"], got[1]["strategy"], got[1]["strategies"], got[1]["first_capture"], got[1]["n_indexes"]) == ("2026-01-02", "official", "official;archive", D(2025, 1, 3), 1)
    assert (got[0]["strategies"], got[0]["first_capture"]) == ("unknown", None)
    done = spark.createDataFrame([("s", "u1", 200, None, "text", 1), ("s", "u2", 500, "x", None, 1), ("s", "u3", 200, None, "", 1)], "source string, url string, status int, error string, main_text string, scrape_timestamp int")
    found = spark.createDataFrame([("s", f"u{k}") for k in (1, 2, 3, 4)], "source string, url string")
    queue = lambda **x: [r["url"] for r in crawl.work_queue(found, done, "source", "url", ["url"], **x).collect()]
    assert queue() == ["u4"] and queue(retry_errors=True) == ["u2", "u4"] and queue(refresh_empty=True) == ["u3", "u4"]


def test_support_and_assumed_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2), ("c", 9)], "u string, t int")
    got = sorted(map(tuple, select.prune_to_support(df, [(["u"], 2), (["t"], 2)]).collect()))
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    r = spark.createDataFrame([("x", D(2024, 1, 1)), ("x", D(2024, 1, 1)), ("t", D(2024, 1, 2)), ("x", D(2024, 1, 2))], "e string, d date")
    step = lambda q: reshape.assumed_rows(q, "e", "d", F.col("e") == "x", "t")
    assert sum(x["assumed"] for x in step(step(r)).collect()) == 1


def test_markup(spark):
    html = """<html><head><title>T</title><meta content="It's" property="og:title"><script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":["NewsArticle"],"headline":"H","author":[{"name":"N"}],"datePublished":"2024-01-02"}]}</script></head>
    <body><nav>menu menu menu</nav><article><p>First text.</p><p>Second text.</p></article><div><a>link link link link link link link</a></div></body></html>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>"), (4, "")], "k int, html string")
    got = {r["k"]: r for r in markup.page_fields(df, "k", "html").collect()}
    assert (got[1]["title"], got[1]["author"], got[1]["published"], got[1]["main_text"]) == ("H", "N", "2024-01-02", "First text.\nSecond text.")
    assert got[2]["title"] is None and len(got) == 4
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="http://a/1"/><updated>2024</updated></entry></feed>'
    assert [tuple(r)[1:] for r in markup.feed_entries(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "k int, x string"), "k", "x").collect()] == [("atom", 0, "http://a/1", "A", "2024")]


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Q.ContractError):
        Q.require_unique(df, ["k"])
    with pytest.raises(Q.ContractError):
        Q.require_true(df, F.col("v") > 2, "v above 2")
    with pytest.raises(Q.ContractError):
        Q.require_idempotent(df, lambda x: x.withColumn("v", F.col("v") + 1))
    assert Q.require_unique(df, ["k", "v"]) is df


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], [F.desc("v")]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, tables.insert_or_ignore(old, new, ["k"], ["v"]).collect())) == [(3, "e")]
    tables.write_parquet(old, str(tmp_path / "t"), "gzip", ["k"])
    assert tables.parquet(spark, str(tmp_path / "t")).count() == 2


def test_fixed_effects_against_dummies(spark):
    rng = np.random.default_rng(3)
    u, t = rng.integers(0, 12, 400), rng.integers(0, 9, 400)
    x, z = rng.normal(size=400), rng.normal(size=400)
    y = 1.5 * x - 0.5 * z + u * 0.3 + t * 0.2 + rng.normal(size=400)
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d), float(e)) for a, b, c, d, e in zip(u, t, x, z, y, strict=True)], "u int, t int, x double, z double, y double")
    fit = effects.fixed_effects(df, "y", ["x", "z"], ["u", "t"], ["u"])
    m = np.c_[x, z, np.eye(12)[u], np.eye(9)[t][:, 1:]]
    b, *_ = np.linalg.lstsq(m, y, rcond=None)
    assert np.allclose(fit.beta, b[:2], atol=1e-6)
    e = y - m @ b
    inv = np.linalg.pinv(m.T @ m)
    s = np.stack([m[u == g].T @ e[u == g] for g in range(12)])
    v = (inv @ (s.T @ s) @ inv)[:2, :2] * 12 / 11 * 399 / (400 - 2 - 8)
    assert np.allclose(fit.vcov, v, rtol=1e-5)
    f, k, p = fit.wald(["x", "z"])
    assert k == 2 and p < 1e-6 and f == pytest.approx(float(fit.beta @ np.linalg.inv(fit.vcov) @ fit.beta) / 2)
    assert effects.fixed_effects(df.withColumn("w", F.col("x") * 3), "y", ["x", "w"], ["t"], ["u"]).dropped == ["w"]


def test_imputation_finds_a_constant_effect(spark):
    rows = [(u, t, float(u + 2 * t + (5 if u >= 6 and t >= 6 else 0)), int(u >= 6 and t >= 6)) for u in range(10) for t in range(10)]
    df = spark.createDataFrame(rows, "u int, t int, y double, d int")
    assert effects.att(df, "y", F.col("d") == 1, "u", "t").first()["att"] == pytest.approx(5, abs=1e-6)
    draws = [r["att"] for r in effects.unit_bootstrap(df, "y", "d", "u", "t", 5).collect() if r["att"] is not None]
    assert draws and all(abs(a - 5) < 1e-6 for a in draws)
    r = effects.wild_bootstrap(effects.cluster_sums(df, "y", "d", [], ["u", "t"], "u"), 199)
    assert 0 < r["p"] <= 1 and r["draws"] == 199


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {r["k"]: r["p_holm"] for r in effects.holm(df, "p", "k").collect()}
    assert got["a"] == pytest.approx(0.03) and got["c"] == pytest.approx(0.06) and got["b"] == pytest.approx(0.06) and got["d"] is None


def test_registered_queries_take_all_ids(spark, data):
    t = tables.table(spark, data, "attendance").where("medios is not null")
    got = [r[0] for r in joining.QUERIES["j16_dated_links"](spark, data).select("attendance_row").collect()]
    assert sorted(got) == sorted(r[0] for r in t.select("attendance_row").collect())
    larger = data.replace("sf0.001", "sf0.01")
    if not os.path.isdir(larger):
        pytest.skip("no test tables here")
    left = {tuple(r) for r in tables.table(spark, larger, "events").where("event_type = 'error'").select("user_id", F.col("ts").cast("date")).collect()}
    size = -1
    while len(left) != size:
        size = len(left)
        for k, least in ((0, 8), (1, 5)):
            n = Counter(x[k] for x in left)
            left = {x for x in left if n[x[k]] >= least}
    assert {tuple(r) for r in selections.QUERIES["proj_p14_support"](spark, larger).select("user_id", "day").collect()} == left != set()


def test_baseline_history(spark):
    w = panel.baseline_windows(spark, "2022-04-18")
    by = {r["window"]: (r["from_date"], r["to_date"]) for r in w.collect()}
    assert by["year1"] == (D(2018, 12, 1), D(2019, 11, 30)) and by["last_year"][0] == D(2021, 4, 18) and by["last_2years"][0] == D(2020, 4, 18) and by["total"] == (D(2018, 12, 1), D(2022, 4, 17))
    assert max(b for _, b in by.values()) == D(2022, 4, 17) and by["year4"] == (D(2021, 12, 1), D(2022, 4, 17)) and "year5" not in by
    dates = [D(2021, 11, 1), D(2022, 4, 15), D(2022, 4, 16), D(2022, 4, 17)]
    rows = [(e, d, e != 2, True, e != 2, d != dates[3], 2.0 if d == dates[1] else 0.0, 0.0, 3.0 if e == 1 else 0.0) for e in (1, 2, 3) for d in dates]
    days = spark.createDataFrame(rows, "e int, day date, attendance_matched boolean, attendance_observed boolean, questions_matched boolean, questions_observed boolean, recorded double, assumed double, questions double")
    p = panel.prepare_history_days(days, "day", ("2021-11",))
    seen = {(r["e"], r["day"]): r for r in p.collect()}
    assert not any(seen[e, dates[0]]["attendance_observed"] for e in (1, 2, 3)) and all(seen[2, d]["recorded"] is None for d in dates) and seen[1, dates[2]]["corrected"] == 1
    got = {r["e"]: r for r in panel.baseline_history(p, w, "e", "day", "2022-04-18").where("window = 'total'").collect()}
    assert (got[1]["questions"], got[1]["recorded"], got[1]["questions_per_attendance"], got[1]["question_day_share"]) == (9, 2, 2.0, 1.0)
    assert (got[2]["questions"], got[2]["attendance_observed_days"], got[3]["questions"]) == (None, 0, 0)
    late = p.unionByName(p.where("e = 1 and day = '2022-04-17'").withColumn("day", F.lit("2022-04-18").cast("date")))
    for bad in (late, p.unionByName(p.limit(1))):
        with pytest.raises(Q.ContractError):
            panel.baseline_history(bad, w, "e", "day", "2022-04-18")


def test_contract_history(spark):
    w = panel.baseline_windows(spark, "2022-04-18")
    rows = [(e, d, e != "none", True, 100.0 if e == "a" else 0.0, 3 if e == "a" else 0) for e in ("a", "b", "none") for d in (D(2021, 11, 1), D(2022, 4, 17))]
    days = spark.createDataFrame(rows, "e string, day date, matched boolean, seen boolean, cost double, n int")
    run = lambda x: panel.contract_history(x, w, "e", "day", ["cost", "n"], "n", "matched", "seen", "2022-04-18")
    got = {r["e"]: r for r in run(days).where("window = 'total'").collect()}
    assert (got["a"]["cost"], got["a"]["n"], got["a"]["award_days"]) == (200, 6, 2) and got["b"]["cost"] == 0 and (got["none"]["cost"], got["none"]["observed_days"]) == (None, 0)
    with pytest.raises(Q.ContractError):
        run(days.unionByName(days.limit(1)))


def test_running_values_and_quantiles(spark):
    from panelwright.operators.ordering import exact_quantiles, numbered, running

    rng = np.random.default_rng(7)
    rows = [(int(k), str(g) if g else None, float(v) if v > 2 else None) for k, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), strict=True))]
    df = spark.createDataFrame(rows, "k long, g string, v double").repartition(7)
    got = sorted(map(tuple, running(df, ["k"], {"s": ("v", "sum"), "m": ("v", "max"), "i": ("k", "sum")}).select("k", "s", "m", "i").collect()))
    v = [x[2] for x in rows]
    assert [x[3] for x in got] == np.cumsum(range(500)).tolist()
    assert np.allclose([x[1] for x in got], np.cumsum([x or 0 for x in v])) and [x[2] for x in got] == np.maximum.accumulate([x if x is not None else -np.inf for x in v]).tolist()
    assert sorted(r["n"] for r in numbered(df, ["k"], "n").collect()) == [*range(1, 501)] and numbered(df.limit(0), ["k"], "n").count() == 0
    q = {r["g"]: (r["a"], r["b"], r["c"]) for r in exact_quantiles(df, "v", {"a": 0.0, "b": 0.37, "c": 1.0}, ["g"]).collect()}
    for g in {r[1] for r in rows}:
        mine = [r[2] for r in rows if r[1] == g and r[2] is not None]
        assert np.allclose(q[g], np.quantile(mine, [0, 0.37, 1]))
    assert exact_quantiles(df, "v", {"b": 0.5}).first()["b"] == pytest.approx(np.quantile([x for x in v if x is not None], 0.5))


def test_imputation_with_controls_weights_and_draws(spark):
    rng = np.random.default_rng(9)
    cells = [(u, t) for u in range(12) for t in range(8)]
    x = rng.normal(size=len(cells))
    d = np.array([int(u >= 8 and t >= 5) for u, t in cells])
    y = np.array([u * 0.5 - t for u, t in cells]) + 2 * x + 3 * d + rng.normal(size=len(cells)) * 0.1
    w = np.array([1 + u % 3 for u, _ in cells])
    df = spark.createDataFrame([(u, t, float(a), float(b), int(c), int(e), u % 2) for (u, t), a, b, c, e in zip(cells, x, y, d, w, strict=True)], "u int, t int, x double, y double, d int, w int, s int")
    m = np.c_[x, np.eye(12)[[u for u, _ in cells]], np.eye(8)[[t for _, t in cells]][:, 1:]]
    for weight in (None, "w"):
        r = np.sqrt(w) if weight else np.ones(len(w))
        b, *_ = np.linalg.lstsq((m * r[:, None])[d == 0], (y * r)[d == 0], rcond=None)
        want = np.average((y - m @ b)[d == 1], weights=r[d == 1] ** 2)
        assert effects.att(df, "y", F.col("d") == 1, "u", "t", controls=["x"], weight=weight).first()["att"] == pytest.approx(want, abs=1e-6)
    few = effects.unit_bootstrap(df, "y", "d", "u", "t", 40, stratum="s", controls=["x"]).collect()
    assert len(few) == 40 and abs(np.mean([r["att"] for r in few if r["att"] is not None]) - 3) < 0.3
    drawn = effects.unit_weights(df, "u", 3, stratum="s").join(df.select("u", "s").distinct(), "u").groupBy("s").agg(F.sum("weight").alias("n"), F.count("*").alias("m")).collect()
    assert all(r["n"] == r["m"] for r in drawn)
    large = effects.unit_bootstrap(df, "y", "d", "u", "t", 2, max_cells=10, done=spark.createDataFrame([(0, 1.5)], "draw int, att double")).collect()
    assert sorted(r["draw"] for r in large) == [0, 1]


def test_equality_of_slopes(spark):
    fit = effects.Fit(["a", "b", "c"], np.array([1.0, 1.0, 4.0]), np.diag([1.0, 2.0, 0.5]), 10, 5, 4, [])
    w = 1 / np.diag(fit.vcov)
    mean = (w @ fit.beta) / w.sum()
    assert fit.equal(["a", "b", "c"])[:2] == (pytest.approx(float(w @ (fit.beta - mean) ** 2) / 2), 2) and fit.equal(["a", "b"])[0] == 0
    assert [p[:2] for p in effects.pairwise(fit, ["a", "b", "c"])] == [("a", "b"), ("a", "c"), ("b", "c")]


def test_windows_meet_facts_by_month(spark):
    f = spark.createDataFrame([(D(2024, 1, 31),), (D(2024, 2, 1),), (None,), (D(2030, 1, 1),)], "day date")
    w = spark.createDataFrame([("a", D(2024, 1, 31), D(2024, 2, 1)), ("b", D(2024, 2, 1), D(2029, 1, 1)), ("empty", D(2024, 3, 1), D(2024, 2, 1)), ("open", None, D(2024, 2, 1))], "name string, from_date date, to_date date")
    assert sorted((r["name"], r["day"].day) for r in joins.in_windows(f, w, "day").collect()) == [("a", 1), ("a", 31), ("b", 1)]


def test_streams_pass_over_repeated_and_late_rows(spark, tmp_path):
    from panelwright.streaming import streams

    batches = [spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (2, 1)], [(1, 3)], [(2, 0), (3, 5)])]
    sink = streams.repeated(streams.latest_state(spark, str(tmp_path / "state"), ["k"], [F.desc("v")]))
    for n, b in enumerate(batches):
        sink(b, n)
    assert sorted(map(tuple, streams.last_version(spark, str(tmp_path / "state")).collect())) == [(1, 3), (2, 0), (3, 5)]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in (1, 2):
        tables.replace_table(spark.createDataFrame([(v,)], "v int"), path)
    with pytest.raises(Exception, match="stopped"):
        tables.replace_table(spark.range(3).select(F.raise_error(F.lit("stopped")).cast("int").alias("v")), path)
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [2]
