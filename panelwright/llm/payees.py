"""Payees of contracts to the outlets of a registry that shares no key with them.

Contracts of one payee are first brought together: rows with the same cleaned name or the same tax code are
one payee. Candidate pairs of payees and outlets come from names within two edits of an outlet's own or legal
name and from the date in the tax code; each pair has prior odds from all its attributes. A payee is at most
one outlet and an outlet at most one payee: loopy belief propagation over these one-to-one factors exchanges
messages through joins until they settle, and gives each pair its marginal probability.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.graph import components
from panelwright.llm.names import LINKS, DeleteIndex, compact, core, expand, plain, tokens, weighted_distance
from panelwright.llm.outlets import SHARD_OUTLETS
from panelwright.llm.variants import spelling_links
from panelwright.session import broadcast_if_small, cut, forget
from panelwright.sources.tables import table

#: Marginal probability from which a pair counts as found.
SURE = 0.5
#: Rounds of messages at most, the greatest change at which they have settled, and the round from which they are damped.
MAX_ROUNDS, SETTLED, DAMPED = 100, 1e-4, 12
NAME_MOST = 2.4

# Legal forms of companies as written behind their names, in plain letters without dots.
_FORMS = re.compile(r"\b(?:s\s*a\s*p\s*i|s\s*de\s*r\s*l|s\s*a\s*b|s\s*a|s\s*c|a\s*c|s\s*r\s*l|sapi|sab|sa|sc|ac)\b(?:\s*(?:de|d)?\s*c\s*v\b|\s*(?:de|d)\s*cv\b)?.*$")
_REMARK = re.compile(r"\(.*$|/.*$|\bpor cuenta propia\b.*$|\bantes grupo.*$|\bsuc(?:ursal)?\b.*$")
#: First words of legal names that say nothing of the outlet, and first words of other businesses.
LEGAL_HEADS = frozenset("impulsora operadora editora editorial comunicaciones publicaciones medios multiservicios difusora corporativo promotora servicios informativos grupo".split())
OTHER_HEADS = ("agencia creativa", "producciones", "consultoria", "encuestas", "espectaculares", "imprenta", "despacho", "eventos", "estrategia", "mercadotecnia", "publicidad exterior")
#: The kind of medium that a product is bought from.
PRODUCTS = {
    "television": ("spot tv", "capsula tv", "tiempo aire"), "radio": ("spot 30 s", "patrocinio radio", "tiempo aire", "spot radio"),
    "prensa": ("plana", "media plana", "insercion", "desplegado"), "digital": ("banner", "video en linea", "nota patrocinada"),
}


def payee_words(name: str | None) -> list[str]:
    """Words of a payee's name without its legal form and remarks."""
    if not name:
        return []
    s = re.sub(r"[.,;:&\"'-]", " ", _REMARK.sub(" ", plain(name)))
    s = re.sub(r"\s+", " ", s).strip()
    cut_at = _FORMS.search(s, pos=min(len(s), s.find(" ") + 1 if " " in s else 0))
    # A damaged legal form: single letters at the end.
    s = s[: cut_at.start()] if cut_at and cut_at.start() > 0 else s
    words = re.findall(r"[a-z]+|\d+", s)
    while len(words) > 2 and (len(words[-1]) <= 2 and not words[-1].isdigit() and words[-1] != "tv" or words[-1] in ("de", "s", "rl", "cv", "sapi")):
        words = words[:-1]
    while len(words) > 2 and 3 <= len(words[-1]) <= 5 and weighted_distance(words[-1], "sapi", 1.0) <= 1.0:
        words = words[:-1]
    return expand(words)


def tax_code(code: str | None) -> tuple[str | None, str | None]:
    """(code without its last part, date as yymmdd) of a tax code that looks like one."""
    if not code:
        return None, None
    s = re.sub(r"[^A-Z0-9Ñ&]", "", code.upper())
    m = re.match(r"^([A-Z0-9Ñ&]{3,4}?)(\d{6})", s)
    if not m or sum(c.isdigit() for c in m[1]) > 1:
        return None, None
    return m[1] + m[2], m[2]


class RegistryIndex:
    """Own and legal names of all outlets for lookup within two edits."""

    def __init__(self, outlets: list[tuple[int, str, str | None]]):
        owners: dict[str, set[tuple[int, str]]] = {}
        for oid, name, legal in outlets:
            for kind, text in (("name", name), ("legal", legal)):
                if text:
                    w = payee_words(text) if kind == "legal" else expand(tokens(text))
                    for f in {core(w), compact(w)}:
                        if len(f) >= 4:
                            owners.setdefault(f, set()).add((oid, kind))
        self.owners = {f: sorted(v) for f, v in owners.items()}
        self.index = DeleteIndex(sorted(self.owners))

    def find(self, words: list[str]) -> list[tuple[str, int, int, str, float]]:
        """(form, stage, outlet, "name" or "legal", distance) of the outlets a payee's name may be.

        Stages: 0 the same, 1 within one edit, 2 within two, 3 a name cut short. The first stage that finds any holds for a form.
        """
        out = []
        for f in {core(words), compact(words)}:
            if len(f) < 4:
                continue
            hits = self.index.matches(f, 1, 1.0)
            stage = 0 if hits and not hits[0][0] else 1
            if not hits and len(f) >= 8:
                stage, hits = 2, self.index.matches(f, 2, NAME_MOST)
            if not hits and len(f) >= 12:
                # A name cut short: the forms that begin with it stand side by side in their order.
                stage, forms = 3, self.index.forms
                k = bisect.bisect_left(forms, f)
                while k < len(forms) and forms[k].startswith(f):
                    hits.append((1.5, k))
                    k += 1
            out += [(f, stage, o, kind, d) for d, k in hits for o, kind in self.owners[self.index.forms[k]]]
        return out


def registry_hits(words: DataFrame, registry: DataFrame, shard_outlets: int = SHARD_OUTLETS) -> DataFrame:
    """(words, outlet_id, kind, d): outlets that distinct names (words) may be; registry: (outlet_id, outlet_name, razon_social).

    One dictionary of the outlets' names is broadcast; a registry longer than a dictionary may be has several, one after
    the other, and of their hits those of the first stage that found any are kept.
    """
    spark = words.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = cut(words.repartition(tasks, "words"))
    shards = max(1, -(-registry.count() // shard_outlets))
    found = None
    for k in range(shards):
        part = registry if shards == 1 else registry.where(F.pmod(F.xxhash64("outlet_id"), F.lit(shards)) == k)
        index = spark.sparkContext.broadcast(RegistryIndex([(r.outlet_id, r.outlet_name, r.razon_social) for r in part.collect()]))

        def lookup(parts: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = [(w, *hit) for w in p["words"] for hit in index.value.find(w.split(" "))]
                yield pd.DataFrame(out, columns=["words", "form", "stage", "outlet_id", "kind", "d"]).astype({"stage": "int32", "outlet_id": "int64", "d": "float64"})

        got = words.mapInPandas(lookup, "words string, form string, stage int, outlet_id long, kind string, d double")
        found = cut(got) if found is None else found.unionByName(cut(got))
    if shards > 1:
        first = found.groupBy("words", "form").agg(F.min("stage").alias("stage"))
        found = found.join(first, ["words", "form", "stage"], "left_semi")
    return found.groupBy("words", "outlet_id", "kind").agg(F.min("d").alias("d"))


def payees(contracts: DataFrame) -> DataFrame:
    """(contract_id, payee) and what the row says: name words, tax code, its date, state and product, all cleaned.

    Rows with the same name or tax code share their payee. Rows with neither come out as payees of their own.
    """

    def clean(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            words = [payee_words(x) for x in p["beneficiario"]]
            codes = [tax_code(x) for x in p["rfcb"]]
            yield pd.DataFrame({
                "contract_id": p["contract_id"], "words": [" ".join(w) for w in words], "name": [core(w) or None for w in words],
                "code": [c[0] for c in codes], "day": [c[1] for c in codes],
                "place": [" ".join(tokens(x)) if x else None for x in p["estado"]], "product": [" ".join(tokens(x)) if x else None for x in p["producto"]],
            })

    rows = contracts.select("contract_id", "beneficiario", "rfcb", "estado", "producto")
    rows = cut(rows.mapInPandas(clean, "contract_id long, words string, name string, code string, day string, place string, product string"))
    # Only distinct (name, code) pairs are linked; both kinds of nodes are numbered by their hash.
    node = lambda tag, c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(tag), F.col(c)))
    pairs = rows.select(node("n", "name").alias("a"), node("c", "code").alias("b")).distinct()
    # Slips of a name that no tax code ties to it: joined by their spelling, unless the dates of their codes differ.
    forms = rows.where("name is not null").groupBy("name").agg(F.min("words").alias("w"), F.count("*").alias("n"), F.mode("day", True).alias("mark"))
    forms = cut(forms.select(F.col("name").alias("id"), "name", F.array_except(F.split("w", " "), F.array(*[F.lit(x) for x in sorted(LINKS)])).alias("words"), "n", "mark"))
    slips = spelling_links(forms, word_edits=2, word_jaccard=0.3).select(node("n", "a").alias("a"), node("n", "b").alias("b"))
    roots = cut(components(pairs.dropna().unionByName(slips)))
    rows = rows.withColumn("node", F.coalesce(node("n", "name"), node("c", "code"), F.xxhash64(F.lit("r"), "contract_id")))
    rows = rows.join(roots, F.col("node") == F.col("id"), "left").withColumn("payee", F.coalesce("root", "node"))
    return rows.drop("id", "root", "node")


def prior_odds(kind: Column, distance: Column, day: Column, place: Column, product: Column) -> Column:
    """Logarithm of the prior odds of a pair from how far the names are apart (null: no name in common), whether
    the dates agree (2 same, 1 one figure apart, -1 differ), the states agree (1, -1) and the product fits (1, -1)."""
    name = F.when(kind == "name", F.lit(4.5) - F.lit(1.3) * distance).when(kind == "legal", F.lit(5.0) - F.lit(1.3) * distance).otherwise(F.lit(-4.5))
    date = F.when(day == 2, 5.0).when(day == 1, 2.0).when(day == -1, -3.0).otherwise(0.0)
    state = F.when(place == 1, 1.8).when(place == -1, -2.5).otherwise(0.0)
    fits = F.when(product == 1, 0.5).when(product == -1, -0.5).otherwise(0.0)
    return (name + date + state + fits).cast("double")


def propagate(pairs: DataFrame, left: str, right: str, logit: str) -> DataFrame:
    """``pairs`` (left, right, logit) with ``p``: marginal probability under one-to-one factors on both sides.

    Sum-product messages of a matching: of a pair with odds w, the left factor says 1 / (1 + sum of the other
    pairs' odds there, each times what their right factor says), and the right one likewise. Messages go back and
    forth by aggregation over either side until they change by less than SETTLED, and it is an error if they do not;
    from round DAMPED on each is the mean of the new and the last one, so that they do not swing. A pair that is
    alone on both sides hears nothing and is settled at once. Lineage is cut each round and the last round's state dropped.
    """
    w = F.exp(F.least(F.greatest(F.col(logit), F.lit(-25.0)), F.lit(25.0)))
    pairs = cut(pairs.select(left, right, w.alias("w")))
    many = lambda side: pairs.groupBy(side).agg(F.count("*").alias("m")).where("m > 1").select(side, F.lit(True).alias(f"__{side}"))
    pairs = cut(pairs.join(many(left), left, "left").join(many(right), right, "left").withColumn("linked", F.coalesce(f"__{left}", f"__{right}", F.lit(False))).drop(f"__{left}", f"__{right}"))
    alone = pairs.where("not linked").select(left, right, (F.col("w") / (1 + F.col("w"))).alias("p"))
    state = pairs.where("linked").select(left, right, "w", F.lit(1.0).alias("from_l"), F.lit(1.0).alias("from_r"))
    held = None
    for k in range(MAX_ROUNDS):
        keep = 0.5 if k >= DAMPED else 0.0
        by_l = state.groupBy(left).agg(F.sum(F.col("w") * F.col("from_r")).alias("sum_l"))
        new = state.join(by_l, left)
        new = new.withColumn("new_l", keep * F.col("from_l") + (1 - keep) / (1 + F.greatest(F.lit(0.0), F.col("sum_l") - F.col("w") * F.col("from_r"))))
        by_r = new.groupBy(right).agg(F.sum(F.col("w") * F.col("new_l")).alias("sum_r"))
        new = new.join(by_r, right)
        new = new.withColumn("new_r", keep * F.col("from_r") + (1 - keep) / (1 + F.greatest(F.lit(0.0), F.col("sum_r") - F.col("w") * F.col("new_l"))))
        new = new.withColumn("change", F.greatest(F.abs(F.col("new_l") - F.col("from_l")), F.abs(F.col("new_r") - F.col("from_r"))))
        new = cut(new.select(left, right, "w", F.col("new_l").alias("from_l"), F.col("new_r").alias("from_r"), "change"))
        change = new.agg(F.max("change")).first()[0]
        if held is not None:
            forget(held)
        held, state = new, new.drop("change")
        if change is None or change < SETTLED:
            break
    else:
        raise RuntimeError("messages did not settle")
    odds = F.col("w") * F.col("from_l") * F.col("from_r")
    return state.select(left, right, (odds / (1 + odds)).alias("p")).unionByName(alone)


def payee_matches(contracts: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((contract_id, payee), (payee, outlet_id, p)): payees of contracts and their pairs with outlets."""
    place_of = F.pandas_udf(lambda s: s.map(lambda x: " ".join(tokens(x)) if x else None), "string")
    reg = registry.dropna(subset=["outlet_id", "outlet_name"]).groupBy("outlet_id").agg(F.min(F.struct("outlet_name", "razon_social", "constituida", "estado", "medio")).alias("r")).select("outlet_id", "r.*")
    reg = cut(reg)
    rows = cut(payees(contracts))
    # Names: each distinct cleaned name once.
    names = registry_hits(rows.where("name is not null").select("words").distinct(), reg.select("outlet_id", "outlet_name", "razon_social"))
    # A payee's name counts by how many of its rows bear it: one slip that looks like another outlet weighs little.
    total = rows.groupBy("payee").agg(F.count("*").alias("m"))
    by_name = rows.join(cut(names), "words").groupBy("payee", "outlet_id", "kind").agg(F.count("*").alias("k"), F.min("d").alias("d_min"), F.avg("d").alias("d"))
    by_name = by_name.join(total, "payee").withColumn("d", F.col("d") + F.least(F.lit(2.5), -F.log(F.col("k") / F.col("m")) * 0.6))
    best = by_name.groupBy("payee", "outlet_id").agg(F.min_by(F.struct("kind", "d"), "d").alias("n")).select("payee", "outlet_id", "n.kind", "n.d")
    # Dates: the payees whose code has the day an outlet was founded; legal names only, as other names would have matched.
    facts = rows.groupBy("payee").agg(F.mode("day", True).alias("day"), F.mode("place", True).alias("place"), F.mode("words", True).alias("words"), F.collect_set("product").alias("products"))
    facts = cut(facts)
    r = reg.select("outlet_id", F.date_format("constituida", "yyMMdd").alias("founded"), place_of("estado").alias("state"), F.col("medio").alias("medium"), F.col("razon_social").isNotNull().alias("has_legal"))
    r = broadcast_if_small(cut(r))
    head = F.split("words", " ")[0]
    legal = F.greatest(*[F.levenshtein(head, F.lit(x)) <= 1 for x in sorted(LEGAL_HEADS)]) & ~F.col("words").rlike("^(?:" + "|".join(OTHER_HEADS) + ")")
    by_day = facts.where(legal).join(r.where("founded is not null and not has_legal"), F.col("day") == F.col("founded")).select("payee", "outlet_id")
    pairs = best.join(by_day, ["payee", "outlet_id"], "full").join(facts, "payee").join(r, "outlet_id")
    apart = F.levenshtein("day", "founded")
    day = F.when(F.col("day").isNull() | F.col("founded").isNull(), 0).when(apart == 0, 2).when(apart <= 1, 1).otherwise(-1)
    place = F.when(F.col("place").isNull() | F.col("state").isNull(), 0).when(F.levenshtein("place", "state") <= 2, 1).otherwise(-1)
    # A medium with its own products that sells none of them speaks against it; "otros servicios" says nothing.
    bought = None
    for medium, products in PRODUCTS.items():
        hit = F.arrays_overlap("products", F.array(*[F.lit(x) for x in products]))
        test = F.col("medium") == medium
        value = F.when(hit, 1).otherwise(-1)
        bought = F.when(test, value) if bought is None else bought.when(test, value)
    pairs = pairs.withColumn("logit", prior_odds(F.col("kind"), F.col("d"), day, place, F.coalesce(bought, F.lit(0))))
    # An outlet is paid under its own and under its legal name, each by one payee at most.
    facet = F.col("outlet_id") * 2 + F.when(F.col("kind") == "name", 0).otherwise(1)
    pairs = pairs.select("payee", facet.alias("facet"), "logit")
    found = propagate(pairs, "payee", "facet", "logit")
    return rows.select("contract_id", "payee"), found.select("payee", F.floor(F.col("facet") / 2).cast("long").alias("outlet_id"), "p")


def p7_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Each contract paid to a listed outlet, with the outlet and the confidence of the match."""
    rows, found = payee_matches(table(spark, folder, "contracts"), table(spark, folder, "outlet_registry"))
    best = found.groupBy("payee").agg(F.max_by(F.struct("outlet_id", "p"), F.struct("p", -F.col("outlet_id"))).alias("m")).select("payee", "m.*").where(F.col("p") >= SURE)
    return rows.join(broadcast_if_small(cut(best)), "payee").select(F.col("contract_id").cast("long").alias("contract_id"), F.col("outlet_id").cast("long").alias("outlet_id"), F.col("p").alias("confidence"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each contract whose payee is an outlet of the registry, with that outlet."""
    return p7_matches(spark, folder).select("contract_id", "outlet_id")


QUERIES = {"p7_found": p7_found, "p7_matches": p7_matches}
ORACLES: dict[str, str] = {}

