"""Keys and normal forms of names, labels, URLs and texts, as Column to Column functions.

NULL in gives NULL out; a value with nothing left in it becomes NULL where the function says so.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and the letters they stand for, from the canonical decomposition."""
    pairs = []
    for k in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(k))[0]
        if base.isascii() and base.isalpha() and base != chr(k):
            pairs.append((chr(k), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_table()


def fold_accents(c: Column) -> Column:
    """Letters without their accents; the sharp s becomes ss. Combining marks fall away."""
    c = F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("SS"))
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}+", "")


def squish(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def label_key(c: Column) -> Column:
    """Small ASCII letters and figures with single spaces; NULL if none are left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(fold_accents(c)), r"[^a-z0-9]+", " ")), F.lit(""))


def panel_key(c: Column, recodes: Mapping[str, str] | None = None) -> Column:
    """``label_key`` with whole keys recoded; keys without a recode stay."""
    key = label_key(c)
    if not recodes:
        return key
    table = F.create_map(*[F.lit(x) for kv in sorted(recodes.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, key), key)


def name_key(c: Column) -> Column:
    """Small letters without accents and with single spaces; punctuation stays. NULL if empty."""
    return F.nullif(squish(F.lower(fold_accents(c))), F.lit(""))


def payee_key(c: Column, suffixes: tuple[str, ...] = ("sa de cv", "s de rl de cv", "sapi de cv", "sa", "sc", "ac", "cv"), generic: tuple[str, ...] = ()) -> Column:
    """A payee's name without punctuation, the legal forms at its end, and generic words anywhere."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), r"[.,;:'\"()]", ""), r"[^a-z0-9&]+", " "))
    for s in sorted(suffixes, key=len, reverse=True):
        key = F.regexp_replace(key, rf" {s}$", "")
    if generic:
        key = F.regexp_replace(key, r"\b(?:" + "|".join(sorted(generic)) + r")\b", " ")
    return F.nullif(squish(key), F.lit(""))


def channel_token(c: Column, tabs: tuple[str, ...] = ()) -> Column:
    """Last part of a URL's path without query, fragment and leading @, in small letters; ``tabs`` are no parts."""
    path = F.regexp_replace(F.regexp_replace(F.trim(c), r"[?#].*$", ""), r"/+$", "")
    # url_decode reads a plus as a space, which a path does not mean.
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    if tabs:
        path = F.regexp_replace(path, "/(?:" + "|".join(sorted(tabs)) + ")$", "")
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"^@", "")), F.lit(""))


def canonical_url(c: Column) -> Column:
    """A URL with scheme and host in small letters and without fragment; the query stays. NULL without host."""
    u = F.regexp_replace(F.trim(c), r"#.*$", "")
    head = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.substr(u, F.length(head) + 1)))


def without_tracking(c: Column, names: tuple[str, ...] = ("utm_[a-z]+", "fbclid", "gclid", "ref", "amp")) -> Column:
    """A URL without the query parameters of the given names."""
    one = "(?:" + "|".join(names) + ")=[^&#]*"
    u = F.regexp_replace(c, rf"(?i)([?&])(?:{one}&)*{one}(?=&|#|$)", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"&{2,}", "&"), r"\?&+", "?")
    return F.regexp_replace(u, r"[?&]+(?=#|$)", "")


def slug(c: Column) -> Column:
    """Words in small ASCII letters joined by hyphens; NULL if none are left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(""))


def title_case(c: Column, small: tuple[str, ...] = (), fixed: Mapping[str, str] | None = None) -> Column:
    """Words with a capital, except ``small`` words inside; whole words of ``fixed`` as given there."""
    s = F.initcap(F.lower(c))
    for w in small:
        s = F.regexp_replace(s, rf"(?<=\s){w.capitalize()}(?=\s)", w)
    for a, b in (fixed or {}).items():
        s = F.regexp_replace(s, rf"(?<![^\s]){a}(?![^\s])", b)
    return s


def word_count(c: Column) -> Column:
    """Words between white space: 0 for an empty text."""
    return F.when(c.isNotNull(), F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")))


def tokens_present(name: Column, text: Column) -> Column:
    """How many words of ``name`` are among the words of ``text``."""
    words = F.split(F.coalesce(label_key(name), F.lit("")), " ")
    return F.size(F.filter(F.array_distinct(words), lambda w: (w != "") & F.array_contains(F.split(F.coalesce(label_key(text), F.lit("")), " "), w)))


def names_text(name: Column, text: Column) -> Column:
    """Whether all words of ``name`` but one at most, and at least one, are in ``text``."""
    n = F.size(F.filter(F.array_distinct(F.split(F.coalesce(label_key(name), F.lit("")), " ")), lambda w: w != ""))
    k = tokens_present(name, text)
    return (k > 0) & (k >= n - 1)


def without_stage_directions(c: Column) -> Column:
    """A text without notes in brackets; empty if it holds nothing else."""
    return squish(F.regexp_replace(c, r"\([^()\n]*\)|\[[^\[\]\n]*\]", " "))


def unnamed_label(c: Column, words: tuple[str, ...] = ("PREGUNTA", "INTERLOCUTOR")) -> Column:
    """Whether a speaker's label is one of the kinds of unnamed speakers, alone or with an addition."""
    s = F.regexp_replace(squish(F.upper(fold_accents(c))), r":+$", "")
    return s.rlike("^(?:" + "|".join(words) + r")(?:A|S|AS|ES)?(?: .*)?$")


def distinct_lines(c: Column) -> Column:
    """A text with each line once, where it stands first."""
    return F.array_join(F.array_distinct(F.split(c, "\n")), "\n")


def quote_offset(quote: Column, text: Column) -> Column:
    """Position from 0 of ``quote`` in ``text`` if it stands there exactly once, else NULL."""
    times = (F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)
    return F.when((F.length(quote) > 0) & (times == 1), F.position(quote, text) - 1)


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def matches_any(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is in the normal form of a text, at word borders; NULL text gives NULL."""
    return F.coalesce(label_key(c), F.when(c.isNotNull(), F.lit(""))).rlike(r"\b(?:" + "|".join(patterns) + r")\b")


def label_dummy(c: Column, label: str, whole_words: bool) -> Column:
    """1 or 0: whether a label is in a text, as a word of its own or anywhere; 0 for NULL."""
    test = F.coalesce(label_key(c), F.lit("")).rlike(rf"\b{label}\b") if whole_words else F.coalesce(label_key(c), F.lit("")).contains(label)
    return test.cast("int")
