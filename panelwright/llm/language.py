"""Language of documents and of their paragraphs by hierarchical discrimination.

A linear support vector machine decides the family of a paragraph first (Romance or Germanic); within the
family one machine per pair of languages votes. Features are letter n-grams within words, so the score of a
paragraph is the mean of the scores of its words: those are kept per word, and scoring is a lookup and a
segmented sum. The machines are trained on the driver from a bounded sample of labelled paragraphs, and
once more without the paragraphs whose label the first machines contradict, as labels may be wrong.
"""

from __future__ import annotations

import copy
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.sources.tables import table

FAMILIES = {"romance": ("es", "pt", "fr", "it"), "germanic": ("en", "de")}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
#: Labelled paragraphs of each language in the training sample, and n-grams among the features.
SAMPLE_PER_LANGUAGE = 400
N_FEATURES = 4000
#: Short runs of words taken from each sample paragraph beside the whole, and the steepness of the confidence.
RUNS = 4
SCALE = 6.0
#: Mean square below which a column is not scaled up further.
RARE = 1e-3
#: Lengths of the sample's paragraphs in characters; longer and shorter ones are scored, but not trained on.
SAMPLE_CHARS = (40, 3000)
#: A paragraph makes its document a mixed one if it has so many words and is sure, or has some and is very sure.
MANY_WORDS, SURE = 8, 0.8
SURE_WORDS, VERY_SURE = 4, 0.92
#: How far a written label is believed before its text is read.
TRUST = 0.8
#: Words whose scores a worker keeps; beyond them it starts afresh.
CACHED_WORDS = 1_000_000

# Names of the languages in the languages themselves, in English and in Spanish, and codes.
NAMES = {
    "es": "es spa spanish español espanol castellano",
    "en": "en eng english inglés ingles",
    "pt": "pt por portuguese português portugues portugués",
    "fr": "fr fra fre french français francais francés frances",
    "it": "it ita italian italiano",
    "de": "de deu ger german deutsch alemán aleman",
}
LABELS = {w: code for code, words in NAMES.items() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def label_code(label: Column) -> Column:
    """SQL column: the code of a written language label without its region; NULL for unknown and missing ones."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), first)


# Fixed patterns: what a paragraph holds beside its own words.
_ASIDE = re.compile(r"\b(?:[Ee]+[Hh]+|EH|[Mm]{2,})\b|https?://\S+|www\.\S+|\S+@\S+|[#@]\w+|&\w+;|<+[^<>]*>+|\[[^\]]*\]|\*[^*]*\*|\([^()]*\)|\b\d+\S*")
_SPEAKER = re.compile(r"^\W*[A-ZÁÉÍÓÚÜÑÇÃÕ][A-ZÁÉÍÓÚÜÑÇÃÕ. ]{2,40}:")
_QUOTED = re.compile("«[^»]*»|“[^”]*”|\"[^\"]*\"")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?:;¿¡]")
_STOPS = frozenset(".!?:;")


def has_words(line: str) -> bool:
    return bool(_WORD.search(line))


def _own_words(s: str) -> list[str]:
    tokens = _TOKEN.findall(s)
    upper = sum(w.isupper() for w in tokens) * 2 > sum(w[0].isalpha() for w in tokens)
    out, first = [], True
    for w in tokens:
        if w in _STOPS:
            first = True
        elif w in "¿¡":
            out.append(w)
        elif first or upper or not w[0].isupper():
            out.append(w.lower())
            first = False
    return out


def words_of(line: str) -> list[str]:
    """The words that show a paragraph's language: without names (words with a capital inside a sentence), speaker
    labels, notes in brackets, links and quotations, as long as other words are left."""
    if not line.isascii() and not unicodedata.is_normalized("NFKC", line):
        line = unicodedata.normalize("NFKC", line)
    s = _SPEAKER.sub(" ", _ASIDE.sub(" ", line))
    outside = _own_words(_QUOTED.sub(" ", s)) if "«" in s or '"' in s or "“" in s else []
    if len(outside) >= 4:
        return outside
    return _own_words(s) or _own_words(line)


def _folded(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def grams(w: str) -> set[str]:
    """The word itself and its letter n-grams of two to four, with marks at both ends, also without accents."""
    out: set[str] = set()
    for form in {w} if w.isascii() else {w, _folded(w)}:
        s = f"^{form}$"
        out.add(s)
        for n in (2, 3, 4):
            out.update(s[i : i + n] for i in range(len(s) - n + 1))
    return out


def _svms(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Linear machines with squared hinge loss, one per column of y (+1, -1) and weight (0: takes no part), by
    accelerated gradient steps on all of them at once. x has a last column of ones."""
    d, k = x.shape[1], y.shape[1]
    w = np.zeros((d, k), np.float32)
    v, t = w, 1.0
    u = np.ones(d, np.float32)
    for _ in range(12):  # the largest eigenvalue of the mean outer product
        u = x.T @ (x @ u) / len(x)
        norm = float(np.linalg.norm(u))
        u /= norm
    rate = 1.0 / (2 * norm * float(weight.max()) + reg)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v)) * weight * y
        new = v - rate * (-2 / len(x) * (x.T @ slack) + reg * v)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w[:-1], w[-1]


class LanguageModel:
    """Machines of the families and of the pairs within them, over a list of n-grams."""

    def __init__(self, features: dict[str, int], machines: list[tuple[tuple[str, ...], tuple[str, ...]]], weights: np.ndarray, bias: np.ndarray, scale: float):
        self.features, self.machines, self.weights, self.bias, self.scale = features, machines, weights, bias, scale
        #: Share of each language among all labels.
        self.share = np.full(len(LANGUAGES), 1 / len(LANGUAGES))

    def priors(self) -> dict[str | None, np.ndarray]:
        """Prior probabilities of a document's language by its label's code: labels are mostly right."""
        own = {x: TRUST * np.eye(len(LANGUAGES))[i] + (1 - TRUST) * self.share for i, x in enumerate(LANGUAGES)}
        return own | {None: self.share}

    def word(self, w: str) -> np.ndarray:
        idx = [i for g in grams(w) if (i := self.features.get(g)) is not None]
        return self.weights[idx].sum(axis=0) if idx else np.zeros(self.weights.shape[1], np.float32)

    def probabilities(self, margins: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Probabilities of LANGUAGES for rows of margins (one column per machine); few words make them less sure."""
        few = np.minimum(1, np.sqrt(n_words / 8))[:, None]
        p = 1 / (1 + np.exp(-np.clip(self.scale * few * margins, -30, 30)))
        prob = np.zeros((len(margins), len(LANGUAGES)))
        for f, (name, langs) in enumerate(FAMILIES.items()):
            family = p[:, 0] if f == 0 else 1 - p[:, 0]
            votes = np.zeros((len(margins), len(langs)))
            for k, (a, b) in enumerate(self.machines):
                if k and a[0] in langs and b[0] in langs:
                    votes[:, langs.index(a[0])] += np.log(p[:, k] + 1e-9)
                    votes[:, langs.index(b[0])] += np.log(1 - p[:, k] + 1e-9)
            # Coupling of the pairs: the product of a language's pairwise probabilities, made to sum to one.
            votes = np.exp(votes - votes.max(axis=1, keepdims=True))
            votes /= votes.sum(axis=1, keepdims=True)
            for i, x in enumerate(langs):
                prob[:, LANGUAGES.index(x)] = family * votes[:, i]
        return prob


def _matrix(docs: list[list[str]], features: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(docs), len(features)), np.float32)
    cache: dict[str, list[int]] = {}
    for row, words in zip(x, docs, strict=True):
        for w in words:
            idx = cache.get(w)
            if idx is None:
                idx = cache[w] = [i for g in grams(w) if (i := features.get(g)) is not None]
            row[idx] += 1
        row /= max(1, len(words))
    return x


def train(texts: list[str], labels: list[str], n_features: int = N_FEATURES) -> LanguageModel:
    """Machines from labelled paragraphs and from short runs of their words, as short paragraphs are to be told too.

    What the first machines contradict is left out of the second training.
    """
    docs, langs = [], []
    rng = np.random.default_rng(7)
    for t, y in zip(texts, labels, strict=True):
        w = words_of(t)
        if w:
            docs.append(w)
            langs.append(y)
            for _ in range(RUNS):
                n = int(rng.integers(2, 7))
                at = int(rng.integers(0, max(1, len(w) - n + 1)))
                docs.append(w[at : at + n])
                langs.append(y)
    machines = [(FAMILIES["romance"], FAMILIES["germanic"])] + [((a,), (b,)) for f in FAMILIES.values() for a, b in combinations(f, 2)]
    if not docs:
        # Nothing to learn from: the shares of the labels decide alone.
        return LanguageModel({}, machines, np.zeros((0, len(machines)), np.float32), np.zeros(len(machines)), SCALE)
    seen: dict[str, int] = {}
    known: dict[str, set[str]] = {}
    for d in docs:
        for g in {g for w in set(d) for g in known.setdefault(w, grams(w))}:
            seen[g] = seen.get(g, 0) + 1
    top = sorted(seen, key=lambda g: (-seen[g], g))[:n_features]
    features = {g: i for i, g in enumerate(top)}
    x = _matrix(docs, features)
    # Rare n-grams count as much as common ones: columns are brought to one scale, which goes into the weights.
    scale = 1 / np.sqrt((x * x).mean(axis=0) + RARE)
    scale = (scale / np.sqrt((x * scale * x * scale).sum(axis=1).mean())).astype(np.float32)
    x = np.c_[x * scale, np.ones(len(docs), np.float32)]
    y, size = np.array(langs), np.array([len(d) for d in docs])
    sign = np.stack([np.where(np.isin(y, a), 1, -1) for a, _ in machines], axis=1).astype(np.float32)
    part = np.stack([np.isin(y, a + b) for a, b in machines], axis=1)
    keep = np.ones(len(y), bool)
    for _ in range(2):
        weight = (part & keep[:, None]).astype(np.float32)
        for s in (1, -1):
            pick = (sign == s) & (weight > 0)
            weight /= np.where(pick, np.maximum(1, pick.sum(axis=0)) / (weight > 0).sum(axis=0).clip(1) * 2, 1)
        w, bias = _svms(x, sign, weight)
        model = LanguageModel(features, machines, w * scale[:, None], bias, SCALE)
        prob = model.probabilities(x[:, :-1] @ w + bias, size)
        keep = (np.array(LANGUAGES)[prob.argmax(axis=1)] == y) | (prob.max(axis=1) < 0.6)
    return model


def training_sample(df: DataFrame, text: str, lang: str, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """At most ``per_language`` labelled paragraphs of each language, those of the smallest hashes."""
    lo, hi = SAMPLE_CHARS
    part = df.select(label_code(F.col(lang)).alias("code"), F.explode(F.split(F.col(text), "\n")).alias("part")).where("code is not null")
    part = part.where(F.length("part").between(lo, hi)).withColumn("h", F.xxhash64("part"))
    # Spark keeps only the first rows of each language in every partition before the shuffle.
    rank = F.row_number().over(Window.partitionBy("code").orderBy("h", "part"))
    rows = part.withColumn("rank", rank).where(F.col("rank") <= per_language).orderBy("code", "rank").select("part", "code").collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def paragraphs(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, para_no, lang, confidence, n_words, doc_lang, doc_confidence, mixed, label): paragraphs with words.

    Paragraphs are the pieces between "\\n", numbered from 0 with blank ones counted. Null and empty texts and
    texts without words give no rows. A paragraph too short to be sure takes the likeliest of the
    languages its document surely has. mixed:
    the document has paragraphs of several languages. label: the code of the written label, NULL if unknown.
    """
    key_type = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = f"`{key}` {key_type}, para_no int, lang string, confidence double, n_words int, doc_lang string, doc_confidence double, mixed boolean, label string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = shared.value
        index: dict[str, int] = {}
        table_ = np.zeros((1 << 15, m.weights.shape[1]), np.float32)
        names, priors = np.array(LANGUAGES), m.priors()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                b = batch.slice(start, 2000)
                doc, no, count, ids = [], [], [], []
                if len(index) > CACHED_WORDS:
                    index, table_ = {}, np.zeros((1 << 15, m.weights.shape[1]), np.float32)
                for d, t in enumerate(b.column(1).to_pylist()):
                    if not t:
                        continue
                    for k, line in enumerate(t.split("\n")):
                        if line and has_words(line):
                            words = words_of(line) or ["?"]
                            doc.append(d), no.append(k), count.append(len(words))
                            for w in words:
                                i = index.get(w)
                                if i is None:
                                    i = index[w] = len(index)
                                    if i >= len(table_):
                                        table_ = np.concatenate([table_, np.zeros_like(table_)])
                                    table_[i] = m.word(w)
                                ids.append(i)
                if not doc:
                    continue
                doc_a, n = np.array(doc), np.array(count)
                starts = np.r_[0, np.cumsum(n)[:-1]]
                total = np.add.reduceat(table_[np.array(ids)].astype(np.float64), starts, axis=0)
                prob = m.probabilities(total / n[:, None] + m.bias, n)
                best, conf = prob.argmax(axis=1), prob.max(axis=1)
                # The document: the language that most of its words and, where these are few, its label speak for.
                first = np.r_[0, np.flatnonzero(np.diff(doc_a)) + 1]
                of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc_a)]))
                mass = np.add.reduceat(prob * n[:, None], first, axis=0) / np.add.reduceat(n, first)[:, None]
                label = b.column(2).take(pa.array(doc_a[first])).to_pylist()
                mass *= np.stack([priors[x] for x in label])
                mass /= mass.sum(axis=1, keepdims=True)
                main = mass.argmax(axis=1)
                main_conf = mass.max(axis=1)
                # Sure paragraphs say which languages the document has; the others get the likeliest of those.
                sure = ((n >= MANY_WORDS) & (conf >= SURE)) | ((n >= SURE_WORDS) & (conf >= VERY_SURE))
                has = np.zeros((len(first), len(LANGUAGES)), bool)
                has[np.arange(len(first)), main] = True
                has[of[sure], best[sure]] = True
                best = np.where(has[of], prob, -1.0).argmax(axis=1)
                conf = prob[np.arange(len(best)), best]
                mixed = np.bincount(of, weights=best != main[of]) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(doc_a)), pa.array(no, pa.int32()), pa.array(names[best]), pa.array(conf),
                        pa.array(n.astype(np.int32)), pa.array(names[main[of]]), pa.array(main_conf[of]), pa.array(mixed[of]), b.column(2).take(pa.array(doc_a)),
                    ],
                    names=[key, "para_no", "lang", "confidence", "n_words", "doc_lang", "doc_confidence", "mixed", "label"],
                )

    return df.select(F.col(key), F.col(text), label_code(F.col(lang))).mapInArrow(run, schema)


#: Models of the last training samples, by a digest of the sample: the same sample is trained on once a process.
_MODELS: dict[bytes, LanguageModel] = {}


def trained(texts: list[str], labels: list[str]) -> LanguageModel:
    """The model of a sample; trained anew only if the sample is another than the last ones."""
    h = hashlib.blake2b(digest_size=16)
    for t, c in zip(texts, labels, strict=True):
        h.update(f"{c}\x00{t}\x01".encode("utf-8", "surrogatepass"))
    if h.digest() not in _MODELS:
        while len(_MODELS) > 1:
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[h.digest()] = train(texts, labels)
    return copy.copy(_MODELS[h.digest()])


def languages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on a bounded sample of the labelled rows of ``df`` and label all of its paragraphs."""
    model = trained(*training_sample(df, text, lang))
    counts = dict(df.groupBy(label_code(F.col(lang)).alias("code")).count().collect())  # a row for each language
    n = np.array([counts.get(x, 0) + 1.0 for x in LANGUAGES])
    model.share = n / n.sum()
    return paragraphs(df, model, key, text, lang)


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every paragraph with words of every document, with language and confidence."""
    return languages(table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of documents that mix languages or whose label is missing, unknown or wrong."""
    out = languages(table(spark, folder, "documents"))
    return out.where(F.col("mixed") | F.col("label").isNull() | (F.col("label") != F.col("doc_lang"))).select("doc_id", "para_no", "lang")


QUERIES = {"p10_found": p10_found, "p10_languages": p10_languages}
ORACLES: dict[str, str] = {}
