"""Entity-by-calendar panels, their histories and treatments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.aggregates import category_or_conflict, collapse_unique
from panelwright.operators.contracts import ContractError, require_unique
from panelwright.operators.ordering import numbered
from panelwright.session import broadcast_if_small


def balanced_panel(dim: DataFrame, ids: list[str], start: str, end: str, step: str = "1 day", date: str = "date") -> DataFrame:
    """Every row of ``dim`` (unique on ``ids``) on every date from ``start`` to ``end``, counted from ``start``.

    The dates are a literal sequence exploded in place: a narrow step without a join.
    """
    if start > end:
        raise ContractError(f"the panel would end at {end}, before its start {start}")
    return require_unique(dim, ids).withColumn(date, F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', INTERVAL {step})")))


def complete_calendar(df: DataFrame, group: list[str], date: str, fill: dict[str, object]) -> DataFrame:
    """Rows of each group on every day between its own first and last, with fill values where there were none."""
    span = df.groupBy(*group).agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    grid = span.select(*group, F.explode(F.sequence("__a", "__b")).alias(date))
    return grid.join(df, [*group, date], "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def observed_panel(entities: DataFrame, daily: DataFrame, entity: str, date: str, start: str, end: str, values: list[str], observed: DataFrame | Column) -> DataFrame:
    """Balanced panel whose values are 0 where the source was observed, and NULL where it was not.

    ``daily``: unique on entity and date. ``observed``: the observed keys (dates, or entities and dates), or a
    condition on the panel. Two columns say why: ``source_entity_matched`` and ``source_date_observed``.
    """
    grid = balanced_panel(entities.select(entity), [entity], start, end, "1 day", date)
    known = require_unique(daily, [entity, date])
    matched = known.select(entity).distinct().withColumn("source_entity_matched", F.lit(True))
    out = grid.join(known, [entity, date], "left").join(broadcast_if_small(matched), entity, "left")
    if isinstance(observed, DataFrame):
        keys = [c for c in observed.columns if c in (entity, date)]
        out = out.join(observed.select(*keys).distinct().withColumn("source_date_observed", F.lit(True)), keys, "left")
    else:
        out = out.withColumn("source_date_observed", observed)
    out = out.na.fill(False, ["source_entity_matched", "source_date_observed"])
    seen = F.col("source_entity_matched") & F.col("source_date_observed")
    return out.withColumns({v: F.when(seen, F.coalesce(F.col(v), F.lit(0))) for v in values})


def zero_filled_panel(entities: DataFrame, daily: DataFrame, entity: str, date: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Balanced panel with 0 wherever there is no value, observed or not."""
    grid = balanced_panel(entities.select(entity), [entity], start, end, "1 day", date)
    return grid.join(require_unique(daily, [entity, date]), [entity, date], "left").withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in values})


def match_report(rows: DataFrame, known: DataFrame, source: str, key: str) -> DataFrame:
    """(source, n_rows, n_matched, n_keys, n_keys_matched) of rows whose key is known."""
    k = known.select(key).dropna().distinct().withColumn("__in", F.lit(True))
    j = rows.join(broadcast_if_small(k), key, "left")
    hit = F.col("__in").isNotNull()
    return j.groupBy(source).agg(F.count("*").alias("n_rows"), F.count_if(hit).alias("n_matched"), F.count_distinct(key).alias("n_keys"), F.count_distinct(F.when(hit, F.col(key))).alias("n_keys_matched"))


def entity_dimension(crosswalk: DataFrame, entity: str, member: str, name: str, category: str, unknown: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """One row an entity: its members and names joined, its category or ``conflict`` with a flag for that, and
    ``entity_number``, dense in the order of the entities (a NULL one first)."""
    informative = F.col(category).isNotNull() & ~F.lower(F.col(category)).isin(*unknown)
    d = crosswalk.groupBy(entity).agg(
        F.count_distinct(member).alias("n_members"), collapse_unique(F.col(member).cast("string")).alias("members"),
        collapse_unique(F.col(name)).alias("names"), category_or_conflict(F.col(category), informative).alias("category"),
    )
    d = d.withColumn(f"{category}_conflict", F.col("category") == "conflict")
    return numbered(d, [entity], "entity_number").withColumn("entity_number", F.col("entity_number").cast("int"))


def baseline_windows(spark: SparkSession, cutoff: str, history_start: str = "2018-12-01") -> DataFrame:
    """(window, from_date, to_date) of a history that ends the day before a cutoff: ``total``, one ``yearK`` from each
    anniversary of its start, ``last_year`` and ``last_2years``, which do not reach before the start. A short list."""
    if history_start >= cutoff:
        raise ContractError(f"the history would begin at {history_start}, not before {cutoff}")
    end, first = F.date_sub(F.to_date(F.lit(cutoff)), 1), F.to_date(F.lit(history_start))
    back = lambda n: F.greatest(first, F.add_months(F.to_date(F.lit(cutoff)), -12 * n))
    k = F.col("k")
    years = F.filter(F.transform(F.sequence(F.lit(0), F.year(end) - F.year(first)), lambda i: F.struct((i + 1).alias("k"), F.add_months(first, i * 12).alias("a"))), lambda x: x["a"] <= end)
    one = spark.range(1)
    y = one.select(F.inline(years)).select(F.concat(F.lit("year"), k.cast("string")).alias("window"), F.col("a").alias("from_date"), F.least(F.date_sub(F.add_months(first, k * 12), 1), end).alias("to_date"))
    rest = F.array(*[F.struct(F.lit(n).alias("window"), a.alias("from_date"), end.alias("to_date")) for n, a in (("total", first), ("last_year", back(1)), ("last_2years", back(2)))])
    return y.unionByName(one.select(F.inline(rest)))


def _by_window(days: DataFrame, windows: DataFrame, key: list[str], date: str, cutoff: str) -> DataFrame:
    """Each day once for every window that holds it. Dates or windows that reach the cutoff, empty or repeated windows,
    and days that are there twice raise."""
    w = [(r["window"], r["from_date"], r["to_date"]) for r in windows.collect()]  # a handful of names
    late = days.agg(F.max(date)).first()[0]
    if (late is not None and str(late)[:10] >= cutoff) or any(str(x[2]) >= cutoff for x in w):
        raise ContractError("a date or a window reaches the cutoff")
    if any(a > b for _, a, b in w) or len({n for n, _, _ in w}) < len(w):
        raise ContractError("a window is empty or named twice")
    require_unique(days, [*key, date])
    each = F.array(*[F.when(F.col(date).between(F.lit(a), F.lit(b)), F.lit(n)) for n, a, b in w])
    return days.withColumn("window", F.explode(F.filter(each, lambda x: x.isNotNull())))


def prepare_history_days(days: DataFrame, date: str, excluded_months: tuple[str, ...] = ()) -> DataFrame:
    """Days (recorded, assumed, questions, and whether either source has the entity and the day) ready to be summed.

    In: ``attendance_matched``, ``attendance_observed``, ``questions_matched``, ``questions_observed``, ``recorded``,
    ``assumed``, ``questions``. What is not observed is NULL, and so is attendance in excluded months (yyyy-MM). Adds
    ``asked`` (0/1), ``corrected`` (at least one attendant where a question is recorded, not one a question),
    ``inferred`` (corrected beyond recorded and assumed) and ``common_observed``.
    """
    seen = lambda a, b: F.coalesce(F.col(a) & F.col(b), F.lit(False))
    d = days.withColumn("attendance_observed", seen("attendance_matched", "attendance_observed") & ~F.date_format(date, "yyyy-MM").isin(*excluded_months) if excluded_months else seen("attendance_matched", "attendance_observed"))
    d = d.withColumn("questions_observed", seen("questions_matched", "questions_observed"))
    d = d.withColumns({c: F.when(F.col("attendance_observed"), F.col(c)) for c in ("recorded", "assumed")} | {"questions": F.when(F.col("questions_observed"), F.col("questions"))})
    d = d.withColumn("asked", F.when(F.col("questions_observed"), (F.col("questions") > 0).cast("int")))
    base = F.col("recorded") + F.col("assumed")
    corrected = F.when(F.col("attendance_observed"), F.when(base.isNotNull(), F.greatest(base, F.coalesce("asked", F.lit(0))))).when(F.col("asked") == 1, F.lit(1))
    d = d.withColumn("corrected", corrected)
    inferred = F.col("corrected") - F.coalesce("recorded", F.lit(0)) - F.coalesce("assumed", F.lit(0))
    return d.withColumn("inferred", inferred).withColumn("common_observed", F.col("attendance_observed") & F.col("questions_observed"))


def baseline_history(days: DataFrame, windows: DataFrame, entity: str, date: str, cutoff: str) -> DataFrame:
    """Per entity and window, of prepared days: sums (NULL of nothing observed), days with attendance and with questions,
    observed days, the same on days that both sources cover, and ratios of these (NULL without a positive denominator)."""
    d = _by_window(days, windows, [entity], date, cutoff)
    both = lambda c: F.sum(F.when(F.col("common_observed"), c))
    some = lambda c: (F.col(c) > 0).cast("int")
    g = d.groupBy(entity, "window").agg(
        both(F.col("questions")).alias("common_questions"), both(F.col("corrected")).alias("common_attendance"), both(F.col("recorded")).alias("common_recorded"),
        both(some("corrected")).alias("common_attendance_days"), both(F.col("asked")).alias("common_question_days"),
        *[F.sum(c).alias(c) for c in ("recorded", "assumed", "inferred", "corrected", "questions")],
        F.sum(some("recorded")).alias("attendance_days"), F.sum("asked").alias("question_days"),
        *[F.count_if(c).alias(f"{c}_days") for c in ("attendance_observed", "questions_observed", "common_observed")],
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return g.withColumns({
        "questions_per_attendance": ratio("common_questions", "common_attendance"), "questions_per_recorded": ratio("common_questions", "common_recorded"),
        "question_day_share": ratio("common_question_days", "common_attendance_days"),
    })


def contract_history(days: DataFrame, windows: DataFrame, entity: str, date: str, measures: list[str], count: str, matched: str, observed: str, cutoff: str) -> DataFrame:
    """Per entity and window: observed days, days with an award (``count`` above 0), and sums of the measures, NULL where
    nothing was observed. To be made once an entity, before it is mapped to the members that share it."""
    seen = F.coalesce(F.col(matched) & F.col(observed), F.lit(False))
    d = days.withColumn("__seen", seen).withColumns({m: F.when(seen, F.col(m)) for m in dict.fromkeys([*measures, count])})
    d = _by_window(d, windows, [entity], date, cutoff)
    return d.groupBy(entity, "window").agg(F.count_if("__seen").alias("observed_days"), F.sum((F.col(count) > 0).cast("int")).alias("award_days"), *[F.sum(m).alias(m) for m in measures])


def history_windows(spark: SparkSession, cutoff: str, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """(window, from_date, to_date): months before a cutoff, (from, to) back; to 0 ends the day before the cutoff."""
    rows = [(k, a, b) for k, (a, b) in spans.items()]
    w = spark.createDataFrame(rows, "window string, a int, b int")
    c = F.to_date(F.lit(cutoff))
    return w.select("window", F.add_months(c, -F.col("a")).alias("from_date"), F.date_sub(F.add_months(c, -F.col("b")), 1).alias("to_date"))


def summarize_history(days: DataFrame, windows: DataFrame, entity: str, date: str, values: list[str], observed: str, cutoff: str) -> DataFrame:
    """Per entity and window: observed days, sums (NULL of nothing), and per-day ratios over observed days.

    Windows are few: they are tested as one literal array, so that facts are read once and not multiplied by a
    join. Dates at or after the cutoff raise.
    """
    w = [(r["window"], r["from_date"], r["to_date"]) for r in windows.collect()]  # a handful of names
    late = days.agg(F.max(date)).first()[0]
    if (late is not None and str(late)[:10] >= cutoff) or any(str(x[2]) >= cutoff for x in w):
        raise ContractError("a date or a window reaches the cutoff")
    each = F.array(*[F.when(F.col(date).between(F.lit(a), F.lit(b)), F.lit(n)) for n, a, b in w])
    hit = days.withColumn("window", F.explode(F.filter(each, lambda x: x.isNotNull())))
    g = hit.groupBy(entity, "window").agg(F.count_if(F.coalesce(F.col(observed), F.lit(False))).alias("n_observed"), *[F.sum(F.when(F.col(observed), F.col(v))).alias(v) for v in values])
    return g.withColumns({f"{v}_per_day": F.when(F.col("n_observed") > 0, F.col(v) / F.col("n_observed")) for v in values})


def corrected_count(recorded: Column, assumed: Column, asked: Column) -> Column:
    """The larger of recorded plus assumed and asked; 1 if only asked; NULL if nothing is known."""
    base = F.coalesce(recorded, F.lit(0)) + F.coalesce(assumed, F.lit(0))
    known = recorded.isNotNull() | assumed.isNotNull()
    return F.when(known & asked.isNotNull(), F.greatest(base, asked)).when(known, base).when(asked > 0, F.lit(1))


def participation_panel(people: DataFrame, present: DataFrame, asked: DataFrame, roster: DataFrame, entity: str, date: str, sparse: int) -> DataFrame:
    """(entity, date, present, asked): 1, 0 or NULL; NULL on dates whose roster has fewer than ``sparse`` rows.

    A question shows presence, whatever the roster says. Dates are all that any of the tables has.
    """
    dates = roster.groupBy(date).agg(F.count("*").alias("__n")).join(asked.select(date).distinct(), date, "full")
    grid = _each_date(people, dates, entity, date)
    p = present.select(entity, date).distinct().withColumn("__p", F.lit(1))
    a = asked.select(entity, date).distinct().withColumn("__a", F.lit(1))
    known = asked.select(date).distinct().withColumn("__k", F.lit(1))
    j = grid.join(p, [entity, date], "left").join(a, [entity, date], "left").join(broadcast_if_small(known), date, "left")
    full = F.coalesce(F.col("__n"), F.lit(0)) >= sparse
    return j.select(
        entity, date,
        F.when(F.col("__a").isNotNull() | F.col("__p").isNotNull(), 1).when(full, 0).alias("present"),
        F.when(F.col("__a").isNotNull(), 1).when(F.col("__k").isNotNull(), 0).alias("asked"),
    )


def _each_date(people: DataFrame, dates: DataFrame, entity: str, date: str) -> DataFrame:
    """People on every date: the dates as one array value of a single row, exploded beside each person."""
    one = dates.agg(F.collect_set(F.struct(date, "__n")).alias("__dates"))  # days of a calendar, some thousands
    return people.select(entity).distinct().join(F.broadcast(one)).select(entity, F.inline("__dates"))


def period_change(df: DataFrame, entity: str, date: str, a: str, b: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """(entity, ratio_first, ratio_second, change): ratios of sums in two periods; NULL without a positive denominator."""
    per = lambda p: F.col(date).between(F.to_date(F.lit(p[0])), F.to_date(F.lit(p[1])))
    ratio = lambda p: F.when(F.sum(F.when(per(p), F.col(b))) > 0, F.sum(F.when(per(p), F.col(a))) / F.sum(F.when(per(p), F.col(b))))
    g = df.groupBy(entity).agg(ratio(first).alias("ratio_first"), ratio(second).alias("ratio_second"))
    return g.withColumn("change", F.col("ratio_second") - F.col("ratio_first"))


def cumulative_daily(snapshots: DataFrame, item: str, owner: str, date: str, counters: list[str], owners: DataFrame, start: str, end: str) -> DataFrame:
    """(owner, date, n_items, counters) of items with cumulative counters seen several times.

    An item counts once, on its date, with the largest of each counter; items with several owners or dates are
    left out. Days without items are 0 in a balanced panel of ``owners``.
    """
    one = snapshots.groupBy(item).agg(
        F.when((F.count_distinct(owner) == 1) & (F.count_distinct(date) == 1), F.max(owner)).alias(owner), F.max(date).alias(date), *[F.max(c).alias(c) for c in counters]
    )
    daily = one.where(F.col(owner).isNotNull()).groupBy(owner, date).agg(F.count("*").alias("n_items"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])
    return zero_filled_panel(owners, daily, owner, date, start, end, ["n_items", *counters])


def reassemble(rows: DataFrame, key: list[str], parts: list[str], order: list[str]) -> DataFrame:
    """One row a key from several partial ones: the first value of each part that is not NULL, in a stated order."""
    o = F.struct(*order)
    return rows.groupBy(*key).agg(F.count("*").alias("n_parts"), *[F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in parts])


def select_evidence(evidence: DataFrame, key: list[str], source: str, value: str, truth: DataFrame, tolerance: float, least_rate: float = 0.95, least_n: int = 50) -> DataFrame:
    """(key, value, n_sources, conflict) from sources that agree with a known series often enough.

    A source is calibrated if at least ``least_rate`` of at least ``least_n`` comparisons lie within the tolerance.
    Calibrated sources that lie apart by more than that are a conflict and give no value.
    """
    t = truth.select(*key, F.col(value).alias("__true"))
    rate = evidence.join(t, key).groupBy(source).agg(F.count("*").alias("n"), F.avg((F.abs(F.col(value) - F.col("__true")) <= tolerance).cast("double")).alias("rate"))
    good = rate.where((F.col("n") >= least_n) & (F.col("rate") >= least_rate)).select(source)
    e = evidence.join(broadcast_if_small(good), source, "left_semi").groupBy(*key)
    e = e.agg(F.count_distinct(source).alias("n_sources"), (F.max(value) - F.min(value) > tolerance).alias("conflict"), F.avg(value).alias("__v"))
    return e.withColumn(value, F.when(~F.col("conflict"), F.col("__v"))).drop("__v")


def turn_measures(turns: DataFrame, links: DataFrame, group: str) -> DataFrame:
    """Per group: words by role, turns, questions, and the share of questions with a linked response."""
    words = turns.groupBy(group).agg(
        F.sum("n_words").alias("n_words"), F.sum(F.when(F.col("role") == "question", F.col("n_words"))).alias("words_question"),
        F.sum(F.when(F.col("role") == "response", F.col("n_words"))).alias("words_response"), F.count_if(F.col("role") == "question").alias("n_questions"),
    )
    linked = turns.where("role = 'question'").join(links.select("question_id").distinct(), F.col("turn_id") == F.col("question_id"), "left_semi").groupBy(group).agg(F.count("*").alias("n_linked"))
    return words.join(linked, group, "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0))).withColumn("linked_share", F.try_divide("n_linked", "n_questions"))


def channel_totals(daily: DataFrame, links: DataFrame, channel: str, outlet: str, date: str, sums: list[str], items: str) -> DataFrame:
    """Sums over all channels of an outlet and day, and each per item (NULL without items)."""
    j = daily.join(broadcast_if_small(links.select(channel, outlet).distinct()), channel)
    g = j.groupBy(outlet, date).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*sums, items]])
    return g.withColumns({f"{c}_per_item": F.when(F.col(items) > 0, F.col(c) / F.col(items)) for c in sums})


def all_or_nothing(df: DataFrame, group: list[str], member: str, expected: DataFrame, values: list[str]) -> DataFrame:
    """Sums of a group only where all of its expected members are there with a value, else NULL.

    ``expected``: (the first columns of the group..., n_expected).
    """
    keys = [c for c in group if c in expected.columns]
    g = df.groupBy(*group).agg(F.count_distinct(member).alias("__m"), *[F.sum(v).alias(v) for v in values], *[F.count(v).alias(f"__n_{v}") for v in values], F.count("*").alias("__rows"))
    g = g.join(broadcast_if_small(expected), keys)
    full = F.col("__m") == F.col("n_expected")
    return g.select(*group, "n_expected", *[F.when(full & (F.col(f"__n_{v}") == F.col("__rows")), F.col(v)).alias(v) for v in values])


def dense_numbers(df: DataFrame, order: str, out: str) -> DataFrame:
    """``out``: 1..n in the order of a unique column."""
    return numbered(df, [order], out)


def trend_panel(batches: DataFrame, term: str, date: str, batch: str, value: str, anchor: str, anchor_alone: DataFrame) -> DataFrame:
    """(term, date, value, index): batches of a relative series on one scale by their common anchor term.

    A term that several batches hold keeps that of the least batch; where the anchor is 0 the index is NULL.
    """
    a = batches.where(F.col(term) == anchor).select(batch, date, F.col(value).alias("__a"))
    alone = anchor_alone.select(date, F.col(value).alias("__alone"))
    j = batches.where(F.col(term) != anchor).join(a, [batch, date], "left").join(alone, date, "left")
    j = j.groupBy(term, date).agg(F.min_by(F.struct(value, "__a", "__alone"), batch).alias("r")).select(term, date, "r.*")
    return j.select(term, date, value, F.when(F.col("__a") > 0, F.col(value) / F.col("__a") * F.col("__alone")).alias("index"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
