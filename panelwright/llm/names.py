"""Names of organisations: clean forms, weighted edit distance, and a symmetric-delete index."""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np

# Words for kinds of media, and their common short forms.
KINDS = (
    "radio television tv canal diario periodico semanario revista noticias noticiero portal agencia grupo frecuencia cronica "
    "voz pregon faro telar brujula cadena sistema red informativo multimedios comunicacion digital"
).split()
SHORT = {
    "r": "radio", "rad": "radio", "ag": "agencia", "agcia": "agencia", "sem": "semanario", "dio": "diario", "d": "de", "per": "periodico", "ptl": "portal",
    "rev": "revista", "frec": "frecuencia", "gpo": "grupo", "c": "canal", "not": "noticias", "cron": "cronica", "s": "san", "pto": "puerto", "va": "villa",
    "multiserv": "multiservicios", "com": "comunicaciones", "op": "operadora", "publ": "publicaciones", "prod": "producciones", "imp": "impulsora",
    "ed": "editora", "cons": "consultoria", "esp": "espectaculares", "enc": "encuestas", "mult": "multimedios", "tv": "tv",
}
LINKS = frozenset("de del la las el los y e d".split())
ARTICLES = frozenset("el la los las".split())
#: What is written before and after a name without belonging to it; top-level domains, also the one reserved for examples.
BEFORE = (
    "www", "http", "https", "corresponsal de", "corresponsalia de", "reportero de", "reportera de", "periodista de", "enviado de", "equipo de", "redaccion de", "redaccion",
    "noticiero nocturno de", "noticiero matutino de", "noticiero vespertino de", "noticiero de", "organizacion", "empresa", "medio", "grupo",
)
AFTER = (
    "turno matutino", "turno vespertino", "turno nocturno", "corresponsalia", "corresponsal", "redaccion", "oficial", "en linea", "online", "on line",
    "noticias", "not", "digital", "multimedia", "multimedios", "mx", "com mx", "com", "example", "of", "web", "tv oficial",
)
_BEFORE = [p.split(" ") for p in BEFORE]
_AFTER = [p.split(" ") for p in AFTER]


@lru_cache(maxsize=200_000)
def plain(s: str) -> str:
    """Small ASCII letters, figures and marks; other characters fall away or lose their accents."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKD", s.replace("ß", "ss"))
    return "".join(c for c in s if c < "\x80" or not unicodedata.combining(c)).lower()


def tokens(s: str) -> list[str]:
    return re.findall(r"[a-z]+|\d+", plain(s))


def expand(words: list[str]) -> list[str]:
    return [SHORT.get(w, w) for w in words]


def rotations(words: list[str]) -> list[list[str]]:
    """The words begun at each of them, as names are turned round; first as they stand."""
    return [words[i:] + words[:i] for i in range(len(words))] if 2 <= len(words) <= 7 else [words]


def compact(words: list[str]) -> str:
    return "".join(words)


def core(words: list[str]) -> str:
    """Compact form without links and articles."""
    return "".join(w for w in words if w not in LINKS)


def _alike(a: str, b: str) -> bool:
    return a == b or (len(b) >= 5 and abs(len(a) - len(b)) <= 1 and weighted_distance(a, b, 1.0) <= 1.0)


def _strip_before(s: str) -> list[str]:
    words = s.split(" ")
    return [" ".join(words[len(p) :]) for p in _BEFORE if len(words) > len(p) and all(_alike(x, y) for x, y in zip(words, p, strict=False))]


def _strip_after(s: str) -> list[str]:
    words = s.split(" ")
    out = [" ".join(words[: -len(p)]) for p in _AFTER if len(words) > len(p) and all(_alike(x, y) for x, y in zip(words[-len(p) :], p, strict=True))]
    if " " not in s:
        out += [s[: -len(p)] for p in ("enlinea", "oficial", "noticias", "digital", "multimedia", "online", "mx", "of", "com") if s.endswith(p) and len(s) > len(p) + 6]
    return [x for x in out if len(x) > 3]


@lru_cache(maxsize=20_000)
def spoken(label: str, places: frozenset[str] = frozenset()) -> list[tuple[str, int]]:
    """(name in plain words, steps of clean-up) of a label as typed: as it stands, turned round at a comma, and
    without what is written around names. The fewest steps come first."""
    s = plain(label)
    s = re.sub(r"https?://|\bwww\.|\.example\b|\.com\b|\.mx\b", " ", s)
    s = re.sub(r"\([^)]*\)?", " ", s)
    # A letter with a dot each is a short name: its dots fall away without a space.
    if re.fullmatch(r"\s*(?:[a-z0-9]\s*[.]\s*)+[a-z0-9]?\s*", s):
        s = re.sub(r"[\s.]", "", s)
    flat = lambda x: " ".join(re.findall(r"[a-z]+|\d+", x))
    found: dict[str, int] = {}
    todo = [(flat(s), 0)]
    if s.count(",") == 1 or s.count(";") == 1:
        a, b = re.split("[,;]", s)
        todo.append((flat(f"{b} {a}"), 1))
        if flat(b) in places or any(flat(b).startswith(p) for p in AFTER):
            todo.append((flat(a), 1))
        # A remark may follow the part that was turned round.
        if " - " in b:
            todo.append((flat(f"{b.split(' - ')[0]} {a}"), 1))
    if " - " in s:
        todo.append((flat(s.split(" - ")[0]), 1))
    while todo:
        x, n = todo.pop(0)
        if len(x) < 3 or found.get(x, 99) <= n or n > 4:
            continue
        found[x] = n
        todo += [(y, n + 1) for y in _strip_before(x) + _strip_after(x)]
        for p in places:
            for end in (f" en {p}", f" oficina {p}", f" de {p}", f" {p}"):
                if x.endswith(end):
                    todo.append((x[: -len(end)], n + 1))
    return sorted(found.items(), key=lambda t: (t[1], -len(t[0])))


#: Letters that sound alike or lie side by side; changing one for the other costs less.
_NEAR = {x for p in ("bv", "cs", "sz", "cz", "ck", "cq", "kq", "gj", "iy", "mn", "xj", "dt", "uo", "ei") for x in (p, p[::-1])}
for _row in ("qwertyuiop", "asdfghjkl", "zxcvbnm"):
    _NEAR |= {x for p in zip(_row, _row[1:], strict=False) for x in (p[0] + p[1], p[1] + p[0])}


def weighted_distance(a: str, b: str, most: float = 3.0) -> float:
    """Damerau-Levenshtein distance (optimal string alignment) with cheap slips: neighbouring or like-sounding
    letters 0.7, exchanged neighbours 0.8, a doubled or undoubled letter 0.7, all else 1. ``most`` + 1 if above.

    Only cells near the diagonal are filled, as every step off it costs 0.7 at least.
    """
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    over = most + 1
    if abs(n - m) > most / 0.7:
        return over
    band = int(most / 0.7 + 1e-9)
    blank = [over] * (m + 1)
    prev2: list[float] = blank
    prev = [0.0, *blank[1:]]
    for j in range(min(m, band)):
        prev[j + 1] = prev[j] + (0.7 if j and b[j] == b[j - 1] else 1.0)
    # An exchange skips a row that may lie above the bound by what it saves against a change.
    stop = most + 0.3
    for i in range(1, n + 1):
        x = a[i - 1]
        y1 = a[i - 2] if i > 1 else ""
        drop = 0.7 if x == y1 else 1.0
        cur = blank[:]
        cur[0] = best = prev[0] + drop
        for j in range(i - band if i > band else 1, (i + band if i + band < m else m) + 1):
            y = b[j - 1]
            c = prev[j - 1]
            if x != y:
                c += 0.7 if x + y in _NEAR else 1.0
                if y1 == y and j > 1 and x == b[j - 2] and prev2[j - 2] + 0.8 < c:
                    c = prev2[j - 2] + 0.8
            d = prev[j] + drop
            if d < c:
                c = d
            d = cur[j - 1] + (0.7 if j > 1 and y == b[j - 2] else 1.0)
            if d < c:
                c = d
            cur[j] = c
            if c < best:
                best = c
        if best > stop:
            return over
        prev2, prev = prev, cur
    return prev[m] if prev[m] <= most else over


def deletes(s: str, d: int) -> list[bytes]:
    """``s`` and what is left of it without up to ``d`` (0 to 2) letters."""
    b = s.encode()
    out = [b]
    n = len(b)
    if d >= 1:
        out += [b[:i] + b[i + 1 :] for i in range(n)]
    if d >= 2:
        out += [b[:i] + b[i + 1 : j] + b[j + 1 :] for i in range(n) for j in range(i + 1, n)]
    return out


class DeleteIndex:
    """Symmetric-delete dictionary: finds all forms within two edits of a word by comparing what both leave over.

    Kept as two sorted arrays (a checksum of each remainder, the number of its form), so that it can be broadcast:
    a form of n letters takes about n * n / 2 entries of eight bytes.
    """

    def __init__(self, forms: list[str], most: int = 2):
        self.forms, self.most = forms, most
        sums, ids = [], []
        for k, f in enumerate(forms):
            own = {zlib.crc32(x) for x in deletes(f, most if len(f) >= 8 else 1)}
            sums.extend(own)
            ids.extend([k] * len(own))
        order = np.argsort(np.array(sums, np.uint32), kind="stable")
        self.sums = np.array(sums, np.uint32)[order]
        self.ids = np.array(ids, np.int32)[order]
        self.by_form = {f: k for k, f in enumerate(forms)}

    @property
    def n_bytes(self) -> int:
        return self.sums.nbytes + self.ids.nbytes

    def near(self, word: str, d: int) -> set[int]:
        """Numbers of forms that may be within ``d`` edits of ``word`` (to be verified)."""
        if not word or not word.isascii():
            return set()
        probe = np.array([zlib.crc32(x) for x in deletes(word, d if len(word) >= 6 else min(d, 1))], np.uint32)
        lo, hi = np.searchsorted(self.sums, probe, "left"), np.searchsorted(self.sums, probe, "right")
        out: set[int] = set()
        for i in np.flatnonzero(hi > lo):
            out.update(self.ids[lo[i] : hi[i]].tolist())
        return out

    def matches(self, word: str, d: int, most: float) -> list[tuple[float, int]]:
        """(weighted distance, form number) of the forms within ``most``, nearest first."""
        if (k := self.by_form.get(word)) is not None:
            return [(0.0, k)]
        found = [(weighted_distance(word, self.forms[k], most), k) for k in self.near(word, d)]
        return sorted(x for x in found if x[0] <= most)
