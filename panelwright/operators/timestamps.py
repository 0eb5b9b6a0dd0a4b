"""Mixed timestamp writings to one moment in UTC.

Every accepted writing is one alternative of a single regular expression with named groups. The
expression runs once per value: a replacement rewrites the value as its components, which are then
checked against the calendar and assembled by integer day arithmetic. All of it stays in the JVM.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEP = "\u0001"

_TIME = (
    r"(?<h>\d{1,2})(?:[:.hH](?<n>\d{2}))(?:[:.'](?<s>\d{2})(?:[.,]\d+)?)?"
    r"(?: ?(?:hrs?|horas?|uhr)\b\.?| ?h\b\.?)?(?: ?(?<ap>[ap])\.? ?m\b\.?)?"
)
_ZONE = (
    r" ?\(?(?:(?<zz>z|utc|gmt)(?![+\-a-z]| ?[+\-]\d)|(?:utc|gmt)? ?(?<zo>[+\-]\d{1,2}(?::?\d{2})?)"
    r"(?:\[[a-z_/]+\])?|\[?(?<zr>[a-z]+/[a-z_]+(?:/[a-z_]+)?)\]?|(?<za>[a-z]{2,5}))\)?"
)
_WORD = r"\p{L}{3,12}"
#: The writings of a calendar day: year first, day or month first in figures, day before and after the month's name.
_DAYS = "|".join(
    [
        r"(?<ya>\d{4})[-/.](?<ma>\d{1,2})[-/.](?<da>\d{1,2})",
        r"(?<fa>\d{1,2})(?<fs>[-/.])(?<fb>\d{1,2})\k<fs>(?<yf>\d{4}|\d{2})",
        rf"(?<dg>\d{{1,2}})(?:º|°|er|st|nd|rd|th)?\.?[ \-](?:de )?(?<mg>{_WORD})\.?,?[ \-](?:de |del )?(?<yg>\d{{4}})",
        rf"(?<mh>{_WORD})\.? (?<dh>\d{{1,2}})(?:º|st|nd|rd|th)?,? (?:de |del )?(?<yh>\d{{4}})",
    ]
)
_STAMPS = "|".join(
    [
        r"(?<yb>\d{4})(?<mb>\d{2})(?<db>\d{2})(?:[t ]?(?<hb>\d{2})(?<nb>\d{2})(?<sb>\d{2})?(?:\.\d+)?)?",
        r"(?<yc>\d{4})(?<mc>\d{2})(?<dc>\d{2})[t ](?<hc>\d{2}):(?<nc>\d{2})(?::(?<sc>\d{2})(?:\.\d+)?)?",
    ]
)
PATTERN = (
    r"(?i)^(?:(?<es>-?\d{9,10})(?:\.\d+)?|(?<em>\d{13})(?:\.\d+)?|(?<eu>\d{16})|"
    rf"(?:(?:{_STAMPS})|(?:\D*[ ,:])??(?:{_DAYS})"
    rf"(?:(?:t|,? (?:[-–—|·] )?(?:(?:at|às|as|a las|alle|um|à) )?){_TIME})?)(?:{_ZONE})?)$"
)
_PARTS = [
    "${es}", "${em}", "${eu}",
    "${ya}${yb}${yc}${yf}${yg}${yh}", "${ma}${mb}${mc}", "${mg}${mh}", "${da}${db}${dc}${dg}${dh}", "${fa}", "${fb}",
    "${h}${hb}${hc}", "${n}${nb}${nc}", "${s}${sb}${sc}", "${ap}", "${zz}", "${zo}", "${zr}", "${za}",
]
_NAMES = ["es", "em", "eu", "y", "m", "mn", "d", "fa", "fb", "h", "n", "s", "ap", "zz", "zo", "zr", "za"]

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "cet": 60, "cest": 120, "wet": 0, "west": 60, "bst": 60, "brt": -180, "brst": -120, "cot": -300, "art": -180,
}
# The first letters of the months' names in Spanish, English, Portuguese, French, Italian and German.
MONTHS = {
    1: ["ene", "jan", "gen"], 2: ["feb", "fev"], 3: ["mar"], 4: ["abr", "apr", "avr"], 5: ["may", "mai", "mag"],
    6: ["jun", "giu", "juin"], 7: ["jul", "lug", "juil"], 8: ["ago", "aug", "aou"], 9: ["sep", "set"],
    10: ["oct", "out", "okt", "ott"], 11: ["nov"], 12: ["dic", "dec", "dez"],
}


def _zone_known(c: Column) -> Column:
    return c.isin(sorted(available_timezones()))


def _lookup(pairs: dict[str, object], key: Column) -> Column:
    """``pairs[key]`` from a literal map; NULL for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _region(c: Column) -> Column:
    """A region in the letter case of the zone database."""
    return F.when(c.isNotNull(), _lookup({z.lower(): z for z in sorted(available_timezones())}, F.lower(c)))


def _month(word: Column) -> Column:
    w = F.translate(F.lower(word), "éèûüäãç", "eeuuaac")
    pairs = {s: n for n, starts in MONTHS.items() for s in starts}
    return F.when(word.isNotNull(), F.coalesce(_lookup(pairs, F.substring(w, 1, 4)), _lookup(pairs, F.substring(w, 1, 5)), _lookup(pairs, F.substring(w, 1, 3))))


def day_number(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    y, m, d = (c.cast("long") for c in (y, m, d))
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, F.lit(-3)).otherwise(F.lit(9))) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` computed exactly once: a generator keeps later expressions from repeating it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_utc_seconds(df: DataFrame, value: str, out: str = "utc_s", tz: str | None = None, month_first: str | None = None) -> DataFrame:
    """Add ``out``: whole seconds since the epoch of the text column ``value``.

    ``tz`` names a column with the zone of values that state none (null, unknown or no column: UTC);
    ``month_first`` a boolean column for the order of day and month in figures (null: day first).
    NULL comes out for null, empty and unusable texts, dates that do not exist and times out of range.
    A local time that exists twice is its earlier moment; a skipped one takes the offset before the change.
    Columns of ``df`` are kept; the helper columns live in one struct that is dropped.
    """
    box, raw = "__ts_parts", "__ts_parts_raw"
    norm = F.trim(F.regexp_replace(F.col(value), r"[\s   ﻿]+", " "))
    parts = F.split(F.regexp_replace(norm, PATTERN, _SEP.join(_PARTS)), _SEP)
    df = _fixed(df, box, parts)
    g = {n: F.nullif(F.get(F.col(raw), F.lit(i)), F.lit("")) for i, n in enumerate(_NAMES)}
    ok = F.size(F.col(raw)) == len(_NAMES)
    num = lambda n: g[n].cast("long")
    us = F.coalesce(F.col(month_first), F.lit(False)) if month_first else F.lit(False)
    year = F.when(F.length(g["y"]) == 2, num("y") + 2000).otherwise(num("y"))
    month = F.coalesce(num("m"), _month(g["mn"]), F.when(us, num("fa")).otherwise(num("fb"))).cast("long")
    day = F.coalesce(num("d"), F.when(us, num("fb")).otherwise(num("fa")))
    hour = F.when(g["ap"].isNull(), num("h")).otherwise(num("h") % 12 + F.when(F.lower(g["ap"]) == "p", 12).otherwise(0))
    off = F.regexp_replace(g["zo"], ":", "")
    digits = F.substring(off, 2, 4)
    off_min = F.when(F.length(digits) <= 2, digits.cast("long") * 60).otherwise(F.floor(digits.cast("long") / 100) * 60 + digits.cast("long") % 100)
    off_min = F.when(off.startswith("-"), -off_min).otherwise(off_min)
    abbr = F.when(g["za"].isNotNull(), _lookup(ABBREVIATIONS, F.lower(g["za"])))
    df = _fixed(df.withColumnRenamed(box, box + "_raw"), box, F.when(ok, F.struct(
        F.coalesce(num("es"), F.floor(num("em") / 1000), F.floor(num("eu") / 1000000)).cast("long").alias("epoch"),
        year.alias("y"), month.alias("m"), day.alias("d"),
        F.coalesce(hour, F.lit(0)).alias("h"), F.coalesce(num("n"), F.lit(0)).alias("n"), F.coalesce(num("s"), F.lit(0)).alias("s"),
        (g["ap"].isNull() | num("h").between(1, 12)).alias("half"),
        F.when(g["zz"].isNotNull(), F.lit(0)).otherwise(F.coalesce(off_min, abbr)).cast("long").alias("off"),
        _region(g["zr"]).alias("region"),
    )))
    p = F.col(box)
    real = (
        p["y"].between(1, 9999) & p["m"].between(1, 12) & p["d"].between(1, month_days(p["y"], p["m"]))
        & p["h"].between(0, 23) & p["n"].between(0, 59) & p["s"].between(0, 59) & p["half"]
    )
    local = day_number(p["y"], p["m"], p["d"]) * 86400 + p["h"] * 3600 + p["n"] * 60 + p["s"]
    zone = F.coalesce(p["region"], F.when(_zone_known(F.col(tz)), F.col(tz)) if tz else F.lit(None).cast("string"), F.lit("UTC"))
    instant = (
        F.when(p["epoch"].isNotNull(), p["epoch"])
        .when(~F.coalesce(real, F.lit(False)), F.lit(None).cast("long"))
        .when(p["off"].isNotNull(), local - p["off"] * 60)
        .otherwise(F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone)))
    )
    return _fixed(df, out, instant.cast("long")).drop(box, raw)
