"""Speaker turns of transcripts.

Each row is split at the labels inside its text; what the rows say of speakers is gathered as the distinct
labels of a conference, which are merged into persons. The order of segments follows from precedence
constraints: the order within a row and of numbered rows (dialogue), time marks, and sound cues (the end of a
recording comes after its start). A time mark that goes against the dialogue is dropped, as few as possible;
cues yield to time marks. A row without a number thereby gets a place among the numbered ones. Places are looked
up from tables of one row for each second of a conference at most, so no conference is collected, however
many rows it holds; segments are then range-partitioned by place, ordered topologically chunk by chunk, and
become runs of one speaker with clean text. Runs are joined across chunks by what little each hands to the next.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.names import deletes, plain, weighted_distance
from panelwright.llm.variants import NICKNAMES
from panelwright.session import broadcast_if_small, cut
from panelwright.sources.tables import table

#: Segments that are ordered and joined at a time.
CHUNK = 5_000
#: Place behind all numbered rows.
END = (1 << 62, 0, 0)

# Fixed patterns: time marks, notes on sound, and fillers.
_TIME = re.compile(r"(\d{1,3}):(\d{2})(?::(\d{2}))?")
_TIME_MARK = re.compile(r"[\[(<]+\s*\d{1,3}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*[\])>]+|(?<![\d:])\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?![\d:])")
_NOTE_WORDS = r"aplausos?|risas?|m[uú]sica|silencio|inaudible|ininteligible|voces(?: al fondo)?|(?:inicia|concluye|termina|corre) (?:el )?(?:video|audio)|suena [^)\]]{0,40}|habla en [^)\]]{0,30}|murmullos?|pausa|abucheos?|gritos?|chiflidos?|toma de protesta|himno[^)\]]{0,30}|crosstalk|laughter|applause"
_NOTE = re.compile(rf"<<[^<>]*>>|\*[^*]{{1,40}}\*|[\[(<]\s*(?:{_NOTE_WORDS})\s*[\])>]", re.I)
_BRACKETS = re.compile(r"\[[^\]]{0,60}\]")
_FILLER = re.compile(r"\b(?:e+h+|e+m+|m{2,}|h?m+h?m+|este|o sea|bueno|pues|digamos|a ver|aja|ah+|uh+)\b|¿no\?", re.I)
_CUE = re.compile(r"\b(?:(?P<start>inicia|corre)|concluye|termina) (?:el )?(?P<what>video|audio)\b", re.I)
#: Fillers as they are taken out of the text: sounds anywhere, words only where marks set them off.
_SOUND = re.compile(r"(?<![\w-])(?:e+h+|e+m+|m{2,}|h?m+h?m+|aj[aá]|ah+|uh+)\b(?:\s*(?:,|…|\.{2,}))?", re.I)
_ASIDE = re.compile(r"(?:(?<=^)|(?<=[.,;:!?…¿¡]\s)|(?<=[.,;:!?…¿¡]))(?:este|o sea|bueno|pues|digamos|a ver)\s*(?:,|…|\.{2,})|,?\s*¿no\?", re.I)
_CONT = re.compile(r"\(\s*(?:cont(?:in[uú]a)?|sigue)\.?\s*\)", re.I)
#: A label inside a text: capitals before a colon or ".-", at its head or after the end of a sentence.
_LABEL = re.compile(
    r"(?:^|(?<=[.!?…»\])>*:\n])|(?<=\s)(?=[—–]))\s*[—–-]?\s*"
    r"(?P<label>[A-ZÁÉÍÓÚÜÑ][A-ZÁÉÍÓÚÜÑ.]+(?:[ ,]+(?:\([^()\n]{2,60}\)|[A-ZÁÉÍÓÚÜÑ0-9.&-]+)){0,10})\s*(?::|\.-|\.—)(?!\d)"
)
_NAMED = re.compile(r"(?:^|(?<=[.!?…»\])>*\n])\s*)[—–-]?\s*(?P<label>(?:[A-ZÁÉÍÓÚÜÑ][\wáéíóúüñ.]*[ ,]*){1,6}(?:\([^()\n]{2,60}\))?)\s*(?::|\.-)(?=\s)")

# Kinds of unnamed speakers and words that begin an office.
UNNAMED = {"pregunta": "pregunta", "preguntas": "pregunta", "interlocutor": "interlocutor", "interlocutores": "interlocutor", "interlocutora": "interlocutora", "interlocutoras": "interlocutora", "moderador": "moderador", "moderadora": "moderador", "moderacion": "moderador", "voz": "voz", "voces": "voz", "periodista": "periodista", "reportero": "reportero", "reportera": "reportera"}
OFFICES = (
    "presidenta presidente secretario secretaria subsecretario subsecretaria director directora coordinador coordinadora titular fiscal vocero vocera "
    "gobernador gobernadora comisionado comisionada procurador procuradora jefe jefa general almirante ministro ministra embajador embajadora alcalde alcaldesa"
).split()
_OFFICE_SHORT = {"pdta": "presidenta", "pdte": "presidente", "pta": "presidenta", "pte": "presidente", "srio": "secretario", "sria": "secretaria", "dir": "director", "coord": "coordinador", "tit": "titular", "subsria": "subsecretaria", "subsrio": "subsecretario"}
#: Given names by which a label in capitals that no row bears is known as a person's.
GIVEN = frozenset(NICKNAMES.values())
_LINKS = frozenset("de del la el los las y e".split())


def clean_label(label: str | None) -> str:
    """A speaker's label without time marks, notes, marks of continuation and punctuation around it."""
    if not label:
        return ""
    s = _CONT.sub(" ", _NOTE.sub(" ", _TIME_MARK.sub(" ", label)))
    s = re.sub(r"\s+", " ", s).strip(" \t:.-—–_*<>[]")
    return s if any(c.isalpha() for c in s) else ""


_LONG_WORD = re.compile(r"[^\W\d_]{8,}")


def has_words(text: str) -> bool:
    """Whether a text holds spoken words beside time marks, notes and fillers."""
    if not any(c in text for c in "[<(*"):
        # A long word of several letters is no filler, and without brackets there are no notes.
        m = _LONG_WORD.search(text)
        if m and len(set(m[0].lower())) >= 4:
            return True
    s = _BRACKETS.sub(" ", _NOTE.sub(" ", _TIME_MARK.sub(" ", text)))
    return any(c.isalnum() for c in _FILLER.sub(" ", plain(s)))


def clean_text(text: str) -> str:
    """Spoken words of a text, paragraph by paragraph, without time marks, notes on sound and fillers."""
    out = []
    for line in text.split("\n"):
        s = _BRACKETS.sub(" ", _NOTE.sub(" ", _TIME_MARK.sub(" ", line)))
        s = " ".join(_ASIDE.sub(" ", _SOUND.sub(" ", s)).split())
        s = re.sub(r"\s+([,.;:!?…])", r"\1", s).lstrip(",;:. ")
        s = re.sub(r"([,;:])[,;:]+", r"\1", s)
        if any(c.isalnum() for c in s):
            out.append(s[:1].upper() + s[1:])
    return "\n".join(out)


def _slip(a: str, b: str, most: float = 2.0) -> bool:
    return a == b or (min(len(a), len(b)) >= 5 and weighted_distance(a, b, most) <= (most if len(b) >= 8 else 1.0))


@lru_cache(maxsize=100_000)
def parse_label(label: str) -> tuple[str, str, tuple[str, ...]]:
    """(kind of an unnamed speaker, office, words of the name) of a cleaned label; each may be empty."""
    kind = office = ""
    name: list[str] = []
    parts = [p for p in re.split(r"[,(]", label) if re.search(r"\w", p)]
    for k, p in enumerate(parts):
        w = [x for x in re.findall(r"[a-z]+|\d+", plain(p))]
        if not w:
            continue
        head = _OFFICE_SHORT.get(w[0], w[0])
        unnamed = UNNAMED.get(head) or next((v for x, v in UNNAMED.items() if len(x) >= 8 and _slip(head, x)), None)
        if k == 0 and unnamed and len(w) <= 2:
            kind = unnamed
            continue
        is_office = head in OFFICES or any(_slip(head, x, 1.0) for x in OFFICES)
        if is_office and not office:
            # An office runs on over its links: FISCAL DEL ESTADO, TITULAR DE LA CONTRALORIA; what follows is a name.
            n = 1
            while n < len(w) and w[n] in _LINKS:
                n += 1
                if n < len(w) and w[n] not in _LINKS:
                    n += 1
            office = " ".join([head, *w[1:n]])
            if not name:
                name = w[n:]
        elif not name and not (kind and k > 1):
            name = [x for x in w if x not in _LINKS]
    return kind, office, tuple(name)


def _same_name(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two names may be one person's: every word of the shorter one is in the longer, but for slips and initials."""
    if len(a) > len(b):
        a, b = b, a
    left = list(b)
    told = False
    for x in a:
        hit = next((y for y in left if _slip(x, y)), None) or next((y for y in left if (len(x) == 1 or len(y) == 1) and x[0] == y[0]), None)
        if hit is None:
            return False
        told = told or (len(x) > 3 and len(hit) > 3)
        left.remove(hit)
    return told


class _Slips:
    """Words and what they belong to; finds what belongs to words that may be slips of one by what both leave over."""

    def __init__(self) -> None:
        self.of: dict[bytes, set[int]] = {}

    @staticmethod
    def _keys(word: str) -> list[bytes]:
        return deletes(word, 0 if len(word) < 5 else 1 if len(word) < 6 else 2)

    def add(self, word: str, owner: int) -> None:
        for k in self._keys(word):
            self.of.setdefault(k, set()).add(owner)

    def near(self, word: str) -> set[int]:
        return {o for k in self._keys(word) for o in self.of.get(k, ())}


def roster(labels: list[tuple[str, int, bool]]) -> dict[str, str | None]:
    """Speaker of each label of a conference. labels: (label, times, whether it stands in the label column).

    Labels of one person come together, whatever parts of name and office they show; an office without a name is
    the person who is shown with it. A label inside a text that names no known speaker, office or kind is none.
    A label is compared only with people who share a word or an office with it but for a slip.
    """
    parsed = {x: parse_label(x) for x, _, _ in labels}
    weight = {x: n for x, n, _ in labels}
    listed = {x for x, _, c in labels if c}
    people: list[dict] = []
    by_word, by_office = _Slips(), _Slips()
    by_head: dict[str, set[int]] = {}
    out: dict[str, str | None] = {}

    def person(name: tuple[str, ...]) -> dict:
        p = {"name": name, "offices": set(), "n": 0, "id": " ".join(name), "no": len(people)}
        people.append(p)
        for w in name:
            if len(w) > 3:
                by_word.add(w, p["no"])
        return p

    def in_office(office: str) -> list[dict]:
        near = (people[k] for k in sorted(by_office.near(office)))
        return [p for p in near if any(_slip(office, o) for o in p["offices"])]

    # The fullest names first; among equally full ones the most frequent.
    order = sorted(parsed, key=lambda x: (x not in listed, -len([w for w in parsed[x][2] if len(w) > 1]), -weight[x], x))
    for x in order:
        kind, office, name = parsed[x]
        if not name or (len(name) == 1 and len(name[0]) == 1):
            continue
        near = sorted({k for w in name if len(w) > 3 for k in by_word.near(w)})
        fits = [people[k] for k in near if _same_name(name, people[k]["name"])]
        if len(fits) > 1 and office:
            fits = [p for p in fits if office in p["offices"] or not p["offices"]] or fits
        if fits:
            best = max(fits, key=lambda p: p["n"])
        elif x in listed:
            best = person(name)
        elif office and (fits := in_office(office)):
            best = max(fits, key=lambda p: p["n"])
        elif kind or (x.isupper() and len(name) >= 2 and (office or name[0] in GIVEN)):
            best = person(name)
        else:
            out[x] = None
            continue
        best["n"] += weight[x]
        if office and office not in best["offices"]:
            best["offices"].add(office)
            by_office.add(office, best["no"])
            by_head.setdefault(office.split(" ")[0], set()).add(best["no"])
        out[x] = best["id"]
    for x in order:
        if x in out:
            continue
        kind, office, _ = parsed[x]
        if office:
            fits = in_office(office) or [people[k] for k in sorted(by_head.get(office.split(" ")[0], ()))]
            out[x] = max(fits, key=lambda p: p["n"])["id"] if fits else f"office {office}"
        elif kind:
            out[x] = f"kind {kind}"
        else:
            out[x] = f"label {x}" if x in listed else None
    return out


def split_text(text: str) -> list[tuple[str | None, str, str]]:
    """(label, words, label as written) of the segments of a text; the first has no label."""
    out: list[tuple[str | None, str, str]] = []
    at, label, head = 0, None, ""
    for m in sorted([*_LABEL.finditer(text), *_NAMED.finditer(text)], key=lambda m: (m.start("label"), -m.end())):
        if m.start("label") < at:
            continue
        x = clean_label(m["label"])
        if not x or len(x) > 120:
            continue
        out.append((label, text[at : m.start("label")].rstrip(" —–-"), head))
        at, label, head = m.end(), x, text[m.start("label") : m.end()]
    out.append((label, text[at:], head))
    return out


def _seconds(text: str) -> int | None:
    m = _TIME_MARK.search(text)
    m = _TIME.search(m[0]) if m else None
    if not m:
        return None
    a, b, c = int(m[1]), int(m[2]), m[3]
    return a * 3600 + b * 60 + int(c) if c else a * 60 + b


def _cue(text: str) -> str | None:
    m = _CUE.search(text)
    return ("+" if m["start"] else "-") + m["what"].lower() if m else None


def longest_chain(marks: list[tuple[int, tuple[int, int]]]) -> list[tuple[int, tuple[int, int]]]:
    """The most (second, place) marks, sorted by second, whose places rise with the seconds: the fewest are dropped."""
    ends: list[tuple[int, int]] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, place) in enumerate(marks):
        n = bisect_left(ends, place)
        before.append(at[n - 1] if n else -1)
        if n == len(ends):
            ends.append(place), at.append(k)
        else:
            ends[n], at[n] = place, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(marks[k])
        k = before[k]
    return out[::-1]


def places(marks: dict[int, tuple[int, int]], cues: dict[str, tuple[int, int]], asks: list[tuple[int | None, str | None]]) -> list[tuple[int, int, int]]:
    """(row, segment, side) for each (second, cue) of what has no number: before (side 0) the first kept mark of a
    later second; without a second behind (side 2) the start or before the end of its recording; else behind all.

    marks: first place of each second; cues: first place of each cue, "+" or "-" and its kind.
    """
    kept = longest_chain(sorted(marks.items()))
    seconds = [t for t, _ in kept]
    out = []
    for t, cue in asks:
        if t is not None:
            k = bisect_right(seconds, t)
            out.append((*kept[k][1], 0) if k < len(kept) else END)
        elif cue and (other := cues.get(("-" if cue[0] == "+" else "+") + cue[1:])):
            out.append((*other, 0 if cue[0] == "+" else 2))
        else:
            out.append(END)
    return out


def topological(keys: list[tuple], edges: list[tuple[int, int]]) -> list[int]:
    """Numbers of the nodes so that every edge leads onwards; of the nodes that are ready the least key comes first."""
    after: list[list[int]] = [[] for _ in keys]
    waits = [0] * len(keys)
    for i, j in edges:
        after[i].append(j)
        waits[j] += 1
    heap = [(keys[i], i) for i in range(len(keys)) if not waits[i]]
    heapq.heapify(heap)
    out = []
    while heap:
        i = heapq.heappop(heap)[1]
        out.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(heap, (keys[j], j))
    return out


def constrained_order(numbered: list[bool], keys: list[tuple], owner: list[int]) -> list[int]:
    """Order of segments with their places as keys (row, segment, side, second, owner, segment number).

    Edges: from each numbered segment to the next; from each segment of a row without number to its next; from the
    last numbered segment before a place to what goes there, and from that to the next numbered one.
    """
    if all(numbered):
        return sorted(range(len(keys)), key=keys.__getitem__)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    known = [i for i in order if numbered[i]]
    spots = [keys[i][:3] for i in known]
    edges = [*zip(known, known[1:], strict=False)]
    last: dict[int, int] = {}
    for i in order:
        if numbered[i]:
            continue
        k = bisect_left(spots, keys[i][:3])
        if k:
            edges.append((known[k - 1], i))
        if k < len(known):
            edges.append((i, known[k]))
        if owner[i] in last:
            edges.append((last[owner[i]], i))
        last[owner[i]] = i
    return topological(keys, edges)


def precedence_order(rows: list[int | None], segs: list[int], times: list[int | None], cues: list[str | None] | None = None, owner: list[int] | None = None) -> list[int]:
    """Order of the segments of a conference under all constraints, held in memory: what the distributed form must give."""
    n = len(rows)
    cues, owner = cues or [None] * n, owner or [*range(n)]
    marks: dict[int, tuple[int, int]] = {}
    starts: dict[str, tuple[int, int]] = {}
    for r, g, t, c in zip(rows, segs, times, cues, strict=True):
        if r is not None:
            for box, x in ((marks, t), (starts, c)):
                if x is not None:
                    box[x] = min(box.get(x, END[:2]), (r, g))
    spots = places(marks, starts, [*zip(times, cues, strict=True)])
    keys = [(r, g, 1, 0, 0, g) if r is not None else (*p, END[0] if t is None else t, o, g) for r, g, t, o, p in zip(rows, segs, times, owner, spots, strict=True)]
    return constrained_order([r is not None for r in rows], keys, owner)


def segments(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """(conference_id, source_row, owner, seg_no, label, listed, words, at_s, cue[, head, text]) of transcript rows.

    Rows that came twice (the same number, or without number the same label and text) count once. seg_no 0 is what
    stands before any label in the text, under the row's own label (listed). A row without spoken words comes out
    only for its time mark or cue, without label. ``owner`` numbers the rows that have no source_row, else 0.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for c, r, o, label, text in zip(p["conference_id"], p["source_row"], p["owner"], p["participant_raw"], p["text"], strict=True):
                if not text:
                    continue
                got = [(x, t, h, has_words(t)) for x, t, h in split_text(text)]
                numbered = r is not None and r == r
                if not any(g[3] for g in got):
                    at, cue = _seconds(text), _cue(text)
                    if at is not None or cue:
                        out.append((c, r, o, 0, "", True, False, at, cue, "", ""))
                    continue
                own = clean_label(label)
                marks = [_seconds(t) for _, t, _, _ in got]
                cues = [_cue(t) for _, t, _, _ in got]
                if not numbered:
                    # The order in the row outweighs its marks; a segment without mark is said at the time of the last one.
                    first = next((m for m in marks if m is not None), None)
                    for k, m in enumerate(marks):
                        first = marks[k] = first if m is None else m if first is None else max(first, m)
                    cues = [next((x for x in cues if x), None)] * len(cues)
                for k, (x, t, h, w) in enumerate(got):
                    out.append((c, r, o, k, own if k == 0 else x, k == 0, w, marks[k], cues[k], h if with_text else "", t if with_text else ""))
            frame = pd.DataFrame(out, columns=["conference_id", "source_row", "owner", "seg_no", "label", "listed", "words", "at_s", "cue", "head", "text"])
            yield frame.astype({"conference_id": "Int64", "source_row": "Int64", "at_s": "Int64"})

    owner = F.when(F.col("source_row").isNull(), F.xxhash64("participant_raw", "text")).otherwise(F.lit(0)).alias("owner")
    once = rows.groupBy("conference_id", "source_row", owner).agg(F.min_by(F.struct("participant_raw", "text"), F.struct("loaded_at", "text", "participant_raw")).alias("r"))
    once = once.select("conference_id", "source_row", "owner", "r.participant_raw", "r.text")
    schema = "conference_id long, source_row long, owner long, seg_no int, label string, listed boolean, words boolean, at_s long, cue string, head string, text string"
    got = once.mapInPandas(run, schema)
    return got if with_text else got.drop("head", "text")


def _speakers(segs: DataFrame) -> DataFrame:
    """(conference_id, label, speaker): the distinct labels of each conference, merged into persons."""
    distinct = segs.where("label <> ''").groupBy("conference_id", "label").agg(F.count("*").alias("n"), F.max("listed").alias("listed"))

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        got = roster([*zip(p["label"], p["n"], p["listed"], strict=True)])
        frame = pd.DataFrame({"label": list(got), "speaker": list(got.values())})
        frame.insert(0, "conference_id", p["conference_id"].iloc[0])
        return frame.astype({"conference_id": "Int64"})

    # A small table that takes long in Python: as many tasks as there are cores, which are not put together again.
    spark = segs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return distinct.repartition(tasks, "conference_id").groupBy("conference_id").applyInPandas(merge, "conference_id long, label string, speaker string")


def _placed(segs: DataFrame) -> DataFrame:
    """``segs`` with p_row, p_seg, side, p_at: the keys that order them within a conference.

    What a conference hands over for this is one row for each second and cue of its marks, whatever its size.
    """
    free = segs.where("source_row is null and (at_s is not null or cue is not null)")
    asks = free.select("conference_id", "at_s", F.when(F.col("at_s").isNull(), F.col("cue")).alias("cue")).distinct()
    asked = cut(asks)
    mine = broadcast_if_small(asked.select(F.col("conference_id").alias("__c")).distinct())
    known = segs.where("source_row is not null").join(mine, F.col("conference_id").eqNullSafe(F.col("__c")), "left_semi")
    first = F.min(F.struct("source_row", "seg_no")).alias("p")
    none = F.lit(None)
    marks = known.where("at_s is not null").groupBy("conference_id", "at_s").agg(first).select("conference_id", "at_s", none.cast("string").alias("cue"), "p.*")
    cues = known.where("cue is not null").groupBy("conference_id", "cue").agg(first).select("conference_id", none.cast("long").alias("at_s"), "cue", "p.*")
    both = marks.unionByName(cues).unionByName(asked.select("*", none.cast("long").alias("source_row"), none.cast("int").alias("seg_no")))

    def look(p: pd.DataFrame) -> pd.DataFrame:
        marks, cues, asks = {}, {}, []
        for t, c, r, g in zip(p["at_s"], p["cue"], p["source_row"], p["seg_no"], strict=True):
            t, c = None if pd.isna(t) else int(t), None if pd.isna(c) else c
            if pd.isna(r):
                asks.append((t, c))
            elif t is not None:
                marks[t] = (int(r), int(g))
            else:
                cues[c] = (int(r), int(g))
        got = places(marks, cues, asks)
        frame = pd.DataFrame([(*a, *x) for a, x in zip(asks, got, strict=True)], columns=["at_s", "cue", "p_row", "p_seg", "side"])
        frame.insert(0, "conference_id", p["conference_id"].iloc[0])
        return frame.astype({"conference_id": "Int64", "at_s": "Int64"})

    found = both.groupBy("conference_id").applyInPandas(look, "conference_id long, at_s long, cue string, p_row long, p_seg int, side int")
    found = found.select(F.col("conference_id").alias("__c"), F.col("at_s").alias("__t"), F.col("cue").alias("__q"), "p_row", "p_seg", "side")
    free = segs.where("source_row is null")
    cue = F.when(F.col("at_s").isNull(), F.col("cue"))
    free = free.join(broadcast_if_small(cut(found)), F.col("conference_id").eqNullSafe(F.col("__c")) & F.col("at_s").eqNullSafe(F.col("__t")) & cue.eqNullSafe(F.col("__q")), "left").drop("__c", "__t", "__q")
    ends = [F.coalesce(F.col(c), F.lit(x)).alias(c) for c, x in zip(("p_row", "p_seg", "side"), END, strict=True)]
    free = free.select(*segs.columns, *ends, F.coalesce("at_s", F.lit(END[0])).alias("p_at"))
    fixed = segs.where("source_row is not null").select("*", F.col("source_row").alias("p_row"), F.col("seg_no").alias("p_seg"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("p_at"))
    return fixed.unionByName(free)


def speaker_turns(rows: DataFrame, chunk: int = CHUNK, with_text: bool = False) -> DataFrame:
    """(conference_id, turn_no, speaker, first_row, last_row[, text]): the longest runs of one speaker, numbered from 1.

    rows: (conference_id, source_row, participant_raw, text, loaded_at). Empty texts, texts of notes and fillers
    only, and empty tables give no turns. Speech before any label is of an unknown speaker. Rows without source_row
    go where time marks or cues put them, else to the end; they give no first_row and last_row. A null
    conference_id is a conference of its own. ``text`` is what was said, without marks, notes and fillers.
    """
    segs = cut(segments(rows, with_text))
    names = cut(_speakers(segs)).select(F.col("conference_id").alias("__c"), F.col("label").alias("__l"), "speaker")
    segs = _placed(segs)
    segs = segs.join(broadcast_if_small(names), F.col("conference_id").eqNullSafe(F.col("__c")) & (F.col("label") == F.col("__l")), "left").drop("__c", "__l")
    # What looked like a label and is none is spoken.
    spoken = F.col("speaker").isNull() & ~F.col("listed")
    segs = segs.withColumn("words", F.col("words") | spoken)
    if with_text:
        segs = segs.withColumn("text", F.when(spoken, F.concat("head", "text")).otherwise(F.col("text")))
    place = ["p_row", "p_seg", "side", "p_at", "owner", "seg_no"]
    wanted = ["conference_id", *place, "source_row", "speaker", "words", *(["text"] if with_text else [])]
    segs = segs.select(*wanted).repartitionByRange("conference_id", *place).sortWithinPartitions("conference_id", *place)

    def runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, no = TaskContext.get().partitionId(), 0
        for p in parts:
            conference = [None if pd.isna(x) else int(x) for x in p["conference_id"]]
            row = [None if pd.isna(x) else int(x) for x in p["source_row"]]
            keys = [*zip(*(p[c].tolist() for c in place), strict=True)]
            owner, speaker, words = p["owner"].tolist(), p["speaker"].tolist(), p["words"].tolist()
            texts = p["text"].tolist() if with_text else None
            out = []
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and end - start < chunk and conference[end] == conference[start]:
                    end += 1
                now, got = None, []
                order = constrained_order([r is not None for r in row[start:end]], keys[start:end], owner[start:end])
                for i in order:
                    i += start
                    if speaker[i] is not None:
                        now = speaker[i]
                    if words[i]:
                        if not got or got[-1][0] != now:
                            got.append([now, None, None, []])
                        if row[i] is not None:
                            got[-1][1] = row[i] if got[-1][1] is None else got[-1][1]
                            got[-1][2] = row[i]
                        if texts and (t := clean_text(texts[i])):
                            got[-1][3].append(t)
                block = (task << 32) + no
                no += 1
                out += [(conference[start], block, k, s, a, b, "\n".join(t), False) for k, (s, a, b, t) in enumerate(got)]
                # The speaker a chunk hands on also counts if no words of them are in it.
                out.append((conference[start], block, len(got), now, None, None, "", True))
                start = end
            frame = pd.DataFrame(out, columns=["conference_id", "block", "k", "speaker", "first_row", "last_row", "text", "tail"])
            yield frame.astype({"conference_id": "Int64", "first_row": "Int64", "last_row": "Int64"})

    got = cut(segs.mapInPandas(runs, "conference_id long, block long, k int, speaker string, first_row long, last_row long, text string, tail boolean"))
    # One row for each chunk from here on: the speaker it takes over, and whose words were last before it.
    ends = got.groupBy("conference_id", "block").agg(
        F.max(F.when(F.col("tail"), F.col("speaker"))).alias("hands_on"),
        F.max_by("speaker", F.when(~F.col("tail"), F.col("k"))).alias("last_said"),
        F.min_by(F.struct("speaker"), F.when(~F.col("tail"), F.col("k"))).alias("first_said"),
        F.max(F.when(~F.col("tail") & (F.col("k") == 1), F.col("speaker"))).alias("second_said"),
        F.count_if(~F.col("tail")).alias("n"),
    )
    w = Window.partitionBy("conference_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("takes", F.coalesce(F.last("hands_on", ignorenulls=True).over(w), F.lit("unknown")))
    ends = ends.withColumn("said_last", F.when(F.col("n") > 0, F.coalesce("last_said", "takes")))
    ends = ends.withColumn("before", F.last("said_last", ignorenulls=True).over(w))
    ends = ends.withColumn("goes_on", F.coalesce((F.col("n") > 0) & (F.coalesce("first_said.speaker", "takes") == F.col("before")), F.lit(False)))
    # Words before the first label of a chunk are of the speaker taken over, and so may be the run behind them.
    ends = ends.withColumn("one", F.coalesce((F.col("n") > 1) & F.col("first_said.speaker").isNull() & (F.col("second_said") == F.col("takes")), F.lit(False)))
    new = F.col("n") - F.col("goes_on").cast("int") - F.col("one").cast("int")
    ends = ends.withColumn("offset", F.coalesce(F.sum(new).over(w), F.lit(0)))
    ends = ends.select("block", "takes", "goes_on", "one", "offset")
    turns = got.where("not tail").join(broadcast_if_small(ends), "block")
    turns = turns.withColumn("turn_no", (F.col("offset") + F.col("k") + F.when(F.col("goes_on"), 0).otherwise(1) - F.when(F.col("one") & (F.col("k") > 0), 1).otherwise(0)).cast("long")).withColumn("speaker", F.coalesce("speaker", "takes"))
    out = [F.min_by("speaker", "block").alias("speaker"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row")]
    if with_text:
        said = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("block", "k", "text"))))
        out.append(F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("text"))
    return turns.groupBy("conference_id", "turn_no").agg(*out)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of each conference with the rows of its first and last words."""
    turns = speaker_turns(table(spark, folder, "transcript_rows"))
    return turns.select("conference_id", F.col("turn_no").cast("int").alias("turn_no"), F.col("first_row").cast("int").alias("first_row"), F.col("last_row").cast("int").alias("last_row"))


def p3_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of each conference with its speaker and what was said, clean."""
    return speaker_turns(table(spark, folder, "transcript_rows"), with_text=True)


QUERIES = {"p3_found": p3_found, "p3_turns": p3_turns}
ORACLES: dict[str, str] = {}
