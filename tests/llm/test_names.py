import random
import string

from pyspark.sql import functions as F

from panelwright.llm import names, outlets, payees, setjoin, variants
from panelwright.operators import graph


def osa(a, b):
    """Plain optimal string alignment distance."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def slips(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s) - 1)
        k = rng.randrange(4)
        s = [s[:i] + s[i + 1 :], s[:i] + rng.choice(string.ascii_lowercase) + s[i:], s[:i] + rng.choice(string.ascii_lowercase) + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :]][k]
    return s


def test_delete_index_finds_all_within_two_edits():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcdeilmnorst", k=rng.randint(8, 14))) for _ in range(300)})
    index = names.DeleteIndex(words)
    for _ in range(300):
        w = slips(rng, rng.choice(words), rng.randint(0, 2))
        near = index.near(w, 2)
        assert {k for k, f in enumerate(words) if osa(w, f) <= 2} <= near


def test_weighted_distance_is_bounded_by_the_plain_one():
    rng = random.Random(9)
    for _ in range(500):
        a = "".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 9)))
        b = slips(rng, a, rng.randint(0, 3)) if len(a) > 4 else a[::-1]
        d = names.weighted_distance(a, b, 9.0)
        assert 0.7 * osa(a, b) - 1e-9 <= d <= osa(a, b) + 1e-9 and d == names.weighted_distance(b, a, 9.0)


def full_distance(a, b):
    """Weighted distance with all cells filled."""
    near = lambda x, y: x + y in names._NEAR
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [0.0] if not i and not j else []
            if i:
                ways.append(d[i - 1][j] + (0.7 if i > 1 and a[i - 1] == a[i - 2] else 1.0))
            if j:
                ways.append(d[i][j - 1] + (0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
            if i and j:
                ways.append(d[i - 1][j - 1] + (0.0 if a[i - 1] == b[j - 1] else 0.7 if near(a[i - 1], b[j - 1]) else 1.0))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                ways.append(d[i - 2][j - 2] + 0.8)
            d[i][j] = min(ways)
    return d[-1][-1]


def test_weighted_distance_near_the_diagonal_is_exact():
    rng = random.Random(10)
    for _ in range(3000):
        a = "".join(rng.choices("abcdes", k=rng.randint(6, 12)))
        b = slips(rng, a, rng.randint(0, 4))
        for most in (1.0, 1.8, 2.0, 2.4, 3.0):
            want = full_distance(a, b)
            assert abs(names.weighted_distance(a, b, most) - (want if want <= most + 1e-9 else most + 1)) < 1e-6 or abs(want - most) < 1e-6


def test_names_that_differ_in_too_many_letters_are_too_far():
    rng = random.Random(11)
    a, b = [], []
    for _ in range(3000):
        x = "".join(rng.choices("abcde1", k=rng.randint(6, 14)))
        a.append(x), b.append(slips(rng, x, rng.randint(0, 4)))
    ok = variants.may_be_alike(a, b)
    assert all(k for x, y, k in zip(a, b, ok, strict=True) if full_distance(x, y) <= (1.0 if min(len(x), len(y)) < 9 else variants.NAME_MOST)) and not ok.all()


REG = [(f"{k} {p}".lower(), f"{k} {p}", s, None, "Altamar") for k, p, s in [("Radio", "Zerquillo", None), ("Portal", "Zerquillo", None), ("El Telar de", "Monteverde", "ETM"), ("Canal 94", "Lumarcolma", None), ("Zaguán", "Claro", None), ("Semanario", "Raberjara", None)]]


def test_labels():
    index = outlets.OutletIndex(REG, {"semanario raberjara": 9.0})
    want = {
        "RADIO  ZERQUILLO": "radio zerquillo", "R. Zerquilo": "radio zerquillo", "Zerquillo, Radio": "radio zerquillo", "zerquillo portal": "portal zerquillo", "www.portalzerquillo.example": "portal zerquillo",
        "Telar de Monteverde": "el telar de monteverde", "E.T.M.": "el telar de monteverde", "equipo de El Telar d Monteverde": "el telar de monteverde", "Canal-94/Lumarcolma": "canal 94 lumarcolma", "Zaguan Claor en Altamar": "zaguán claro",
        "Semanario Rab": "semanario raberjara", "Radio Zerquillo / Canal 94 Lumarcolma": "unmatched", "radio zerquillo y zaguan claro": "unmatched", "pendiente": "unmatched", "": "unmatched", "???": "unmatched", "Diario de Otrolado": "unmatched", "x" * 3000: "unmatched",
    }
    assert {k: index.resolve(k)[0] for k in want} == want
    assert index.resolve(None)[0] == "unmatched"


def reference(spark, shard_outlets=outlets.SHARD_OUTLETS):
    reg = spark.createDataFrame(REG, "canonical_id string, outlet_name string, siglas string, sitio string, estado string")
    known = spark.createDataFrame([("la buena", "radio zerquillo", 1), ("Portal zerquillo", "radio zerquillo", 9)], "label string, canonical_id string, n int")
    return outlets.Outlets(reg, known, spark.createDataFrame([("semanario raberjara", 9)], "canonical_id string, count long"), shard_outlets)


def test_shards_give_what_one_dictionary_gives(spark):
    labels = ["Radio Zerquilo", "La Buena!", "zerquillo portal", "Telar Monteverd", "E.T.M.", "Semanario Rab", "Radio Zerquillo / Canal 94 Lumarcolma", "Canal 94 Lumarcloma", "nada", "Zaguan Claor en Altamar", "", "Portal Zerqillo", "radio zer", "r. zerquillo oficial"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    one, several = reference(spark), reference(spark, 2)
    assert one.shards == 1 and several.shards == 3
    got = sorted(map(tuple, one.resolve(df).collect()), key=str)
    assert got == sorted(map(tuple, several.resolve(df).collect()), key=str) and len(got) == len(labels)
    by = {r[0]: r[1:] for r in got}
    assert by["La Buena!"][0] == "radio zerquillo" and by["zerquillo portal"][0] == "portal zerquillo" and by["Radio Zerquillo / Canal 94 Lumarcolma"][2] is True


def test_labels_on_rows(spark):
    index = reference(spark)
    df = spark.createDataFrame([(1, "Radio Zerquillo", "c"), (1, "Radio Zerquillo", "c"), (2, None, "c"), (3, "nada", "c")], "row_id long, label string, canonical string")
    got = outlets.match_labels(df, index).collect()
    assert len(got) == 4 and {r["row_id"]: r["canonical_id"] for r in got} == {1: "radio zerquillo", 2: None, 3: "unmatched"}
    assert outlets.match_labels(df.limit(0), index).count() == 0


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(3)
    sets = {f"s{i}": set(rng.sample("abcdefghijklmnop", rng.randint(1, 7))) for i in range(120)}
    df = spark.createDataFrame([(k, sorted(v), k.endswith("1")) for k, v in sets.items()] + [("null", None, True), ("empty", [], True)], "id string, grams array<string>, asks boolean")
    for t in (0.3, 0.5, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert {(r["a"], r["b"]) for r in setjoin.similar_sets(df, t).collect()} == want
        some = {p for p in want if p[0].endswith("1") or p[1].endswith("1")}
        assert {(r["a"], r["b"]) for r in setjoin.similar_sets(df, t, asks="asks").collect()} == some


def test_components_against_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 6000 + k) for k in range(50)] + [(3, 3)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {x: find(x) for x in list(root)}
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_persons(spark):
    rows = [
        (1, "LIC. JUAN PÉREZ GODOLMA", "Altamar", "1234", None), (2, "Juan Perez-Godolma", "ALTAMAR", None, None), (3, "Pérez Godolma, Juan", None, "1234", None), (4, "Juan Péres Godolma", "Altamar", "1243", None),
        (5, "J. Pérez", "Altamar", "1234", None), (6, "Juan Pérez Godolma", "San Telmo", "9999", None), (7, "Ana Limverza", "Altamar", "1234", None), (8, None, None, None, None), (9, "", None, None, None), (10, "Juan", None, None, None),
        (11, "Nacho Tirvelga", "Altamar", "5555", None), (12, "Ignacio Tirvelga Sormonte", "Altamar", "5555", None), (13, "x" * 5000 + " y", None, None, None), (2_000, "Juan Perez-Godolma", "ALTAMAR", None, None),
    ] + [(100 + k, f"{g} {a}{b}", "Altamar", f"{k:04d}", None) for k, (g, a, b) in enumerate((g, a, b) for g in ("Juan", "Ana", "Luis", "Nacho") for a in ("Bor", "Cal", "Dur", "Esp", "Fal", "Gor", "Hin") for b in ("timenda", "vesoto", "quirbe", "lampido", "rostu"))]
    df = spark.createDataFrame(rows, "row_id long, name string, place string, tel string, org string")
    got = {r["row_id"]: r["person"] for r in variants.person_classes(df).collect()}
    assert len({got[k] for k in (1, 2, 3, 4, 5, 2_000)}) == 1 and got[6] != got[1] and got[7] != got[1] and got[11] == got[12]
    assert not {8, 9, 10} & set(got) and len({got[k] for k in range(100, 240) if k in got}) == sum(k in got for k in range(100, 240))
    assert variants.person_classes(df.limit(0)).count() == 0


def test_organisations(spark):
    labels = ["El Faro de Gorvecorcuaro", "EL FARO DE GORVECORCUARO", "elfarodegorvecorcuaromx", "Gorvecorcuaro, El Faro de", "El Faro de Gorvecorcuraro", "redacción El Faro de Gorvecorcuaro.", "Portal Gorvecorcuaro", "por su cuenta", "", None, "???", "Radio San Limtenbria", "R. San Limtenbria"]
    df = spark.createDataFrame([(x,) for x in labels * 2], "label string")
    got = {r["label"]: r["org"] for r in variants.organisation_classes(df, frozenset()).collect()}
    assert len({got[x] for x in labels[:6]}) == 1 and got["Portal Gorvecorcuaro"] != got[labels[0]] and got[labels[-1]] == got[labels[-2]]
    assert not {"por su cuenta", "", "???"} & set(got)


def test_messages_of_a_matching(spark):
    """Marginals of small matchings by enumeration: exact where the graph has no circle."""
    from itertools import combinations

    pairs = [(1, 10, 2.0), (1, 11, 0.5), (2, 11, 1.5), (3, 12, -1.0)]
    z, p = 0.0, dict.fromkeys(range(len(pairs)), 0.0)
    for k in range(len(pairs) + 1):
        for c in combinations(range(len(pairs)), k):
            if len({pairs[i][0] for i in c}) == k == len({pairs[i][1] for i in c}):
                w = 2.718281828459045 ** sum(pairs[i][2] for i in c)
                z += w
                for i in c:
                    p[i] += w
    got = {(r["l"], r["r"]): r["p"] for r in payees.propagate(spark.createDataFrame(pairs, "l long, r long, logit double"), "l", "r", "logit").collect()}
    assert all(abs(got[a, b] - p[i] / z) < 1e-3 for i, (a, b, _) in enumerate(pairs))


def test_messages_settle_on_circles(spark):
    pairs = [(a, 10 + b, float((a * b) % 3)) for a in range(6) for b in range(6)] + [(50, 60, 2.0)]
    got = payees.propagate(spark.createDataFrame(pairs, "l long, r long, logit double"), "l", "r", "logit").collect()
    assert len(got) == len(pairs) and all(sum(r["p"] for r in got if r[s] == k) < 1.02 for s in ("l", "r") for k in range(60))
    assert abs(next(r["p"] for r in got if r["l"] == 50) - 1 / (1 + 2.718281828 ** -2)) < 1e-6


def test_registry_shards(spark):
    reg = spark.createDataFrame([(1, "Radio Zerquillo", "Impulsora Valmonte"), (2, "Radio Zerquilla", None), (3, "Canal 9 Lumarcolma", None), (4, "Radio Zerquillo del Norte", None)], "outlet_id long, outlet_name string, razon_social string")
    words = spark.createDataFrame([("radio zerquillo",), ("radio zerqillos",), ("impulsora valmomte",), ("radio zerquillo del n",), ("nada",)], "words string")
    one = sorted(map(tuple, payees.registry_hits(words, reg).collect()))
    assert one == sorted(map(tuple, payees.registry_hits(words, reg, 1).collect())) and ("radio zerquillo del n", 4, "name", 1.5) in one


def test_payees(spark):
    reg = spark.createDataFrame(
        [(1, "Radio Zerquillo", "Impulsora Valmonte S.A. de C.V.", "2001-02-03", "Altamar", "radio"), (2, "Portal Zerquillo", None, "1999-05-06", "San Telmo", "digital"), (3, "Canal 9 Lumarcolma", None, None, None, "television")],
        "outlet_id long, outlet_name string, razon_social string, constituida string, estado string, medio string",
    ).withColumn("constituida", F.to_date("constituida"))
    rows = [
        (1, "RADIO ZERQUILLO, S.A. DE C.V.", None, "Altamar", "spot 30 s"), (2, "Imp. Valmonte SA de CV", "IVA010203AB1", "ALTAMAR", None), (3, "IMPULSORA VALMOMTE S.A.", None, None, None), (4, "Editora Torlunda S.C.", "ETO990506XX1", "San Telmo", "banner"),
        (5, "Agencia Creativa Nirlolma", "ACN990506XX1", "San Telmo", "banner"), (6, "Juan Pérez Gómez", "PEGJ700101AA1", "Altamar", "plana"), (7, None, None, None, None), (8, "", "XXX", None, None), (1, "RADIO ZERQUILLO, S.A. DE C.V.", None, "Altamar", "spot 30 s"), (9, "x" * 3000, None, None, None),
        (10, "Diario de Otrolado S.C.", "DOT800101BB1", "Altamar", "plana"),
    ]
    df = spark.createDataFrame(rows, "contract_id long, beneficiario string, rfcb string, estado string, producto string")
    who, pairs = payees.payee_matches(df, reg)
    best = {r["payee"]: (r["outlet_id"], r["p"]) for r in pairs.orderBy("p").collect()}
    got = {r["contract_id"]: best[r["payee"]][0] for r in who.collect() if best.get(r["payee"], (0, 0))[1] >= payees.SURE}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2}
    assert payees.payee_matches(df.limit(0), reg)[1].count() == 0


def records_of(spark, folder):
    """Persons' records of accreditations, as they are compared."""
    t = spark.read.parquet(f"{folder}/accreditations.parquet").select(F.col("accred_id").alias("row_id"), F.col("reporter").alias("name"), F.col("estado").alias("place"), F.col("tel_final").alias("tel"), F.col("medios").alias("org"))
    rows = [(r["row_id"], " ".join(variants.person_words(r["name"])), " ".join(names.tokens(r["place"])) if r["place"] else None, r["tel"], r["org"]) for r in t.collect()]
    return spark.createDataFrame([r for r in rows if " " in r[1]], "id long, words string, place string, tel string, org string").dropDuplicates(["words", "place", "tel", "org"])


def test_candidates_of_persons_against_all_pairs(spark, data):
    """Every record whose id is divisible by 20 against all: the search finds nine of ten links, and in fact nearly all."""
    pairs, full = variants.person_candidates(records_of(spark, data.replace("sf0.001", "sf0.01")))
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    all_ = [(r["id"], (r["words"], r["place"], r["tel"], r["org"], r["tells"])) for r in full.collect()]
    want = {(min(a, b), max(a, b)) for a, x in all_ if a % 20 == 0 for b, y in all_ if a != b and variants.person_evidence(x, y)[0] >= variants.PERSON_LINK}
    assert want and len(want & found) >= 0.97 * len(want)


def forms_of(spark, folder):
    t = spark.read.parquet(f"{folder}/accreditations.parquet").select("medios").dropna().groupBy("medios").count()
    got: dict = {}
    for label, n in t.collect():
        if not variants.remark(label):
            name, keys, words = variants.name_keys(label, frozenset())
            if name:
                old = got.get(name)
                got[name] = (label, name, words, n + (old[3] if old else 0), None)
    return spark.createDataFrame([*got.values()], "id string, name string, words array<string>, n long, mark string")


def test_candidates_of_organisations_against_all_pairs(spark, data):
    """Every twentieth name against all names."""
    forms, counts, slip = variants.spelling_facts(forms_of(spark, data.replace("sf0.001", "sf0.01")))
    found = {(r["a"], r["b"]) for r in variants.spelling_candidates(forms, counts).collect()}
    all_ = sorted((r["id"], (r["name"], list(r["words"]), list(r["weights"]), r["n"])) for r in forms.collect())
    want = {(min(a, b), max(a, b)) for a, x in all_[::20] for b, y in all_ if a != b and variants.spelling_distance(x, y, slip) is not None}
    assert want and len(want & found) >= 0.95 * len(want)


def test_repeated_rows_do_not_change_classes(spark, data):
    rows = [("El Faro de Gorvecorcuaro", 12), ("El Faro de Gorvecorcuraro", 2), ("El Faro de Gorvecrocuarro", 1), ("Portal Lumbretinta", 3), ("Portal Lumbretinto", 3), ("Zeta", 1), ("EFE", 2), ("Canal 22", 1), ("canal-22", 1), ("radio", 1), ("Radio.", 1)]
    classes = []
    for k in (1, 3, 10):
        df = spark.createDataFrame([(x,) for x, n in rows for _ in range(n * k)], "label string")
        classes.append({r["label"]: r["org"] for r in variants.organisation_classes(df, frozenset()).collect()})
    assert classes[0] == classes[1] == classes[2]
    assert classes[0]["Canal 22"] == classes[0]["canal-22"] and "radio" not in classes[0] and {"Zeta", "EFE"} <= set(classes[0])


def test_a_person_with_most_rows_is_one(spark):
    rows = [(k, "Juana Bormanda Ciltrupe", "Altamar", "1234", f"org {k}") for k in range(60)] + [(100 + k, "Juana Bormanda Ciltrupe", None, None, f"org {k}") for k in range(60)] + [(200 + k, f"Luis {chr(98 + k % 20)}orta{chr(97 + k // 20)} Vela{chr(99 + k % 20)}", "San Telmo", f"{k:04d}", None) for k in range(60)]
    got = {r["row_id"]: r["person"] for r in variants.person_classes(spark.createDataFrame(rows, "row_id long, name string, place string, tel string, org string")).collect()}
    assert len({got[k] for k in range(60)}) == 1 and all(got[k] == got[k + 100] for k in range(60))


def test_pairs_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr(variants, "CLASS_PART", 3)
    rows = [(k, "a") for k in range(11)] + [(50, "b"), (51, "b"), (60, "c")]
    got = sorted((r["id_a"], r["id_b"]) for r in variants.class_pairs(spark.createDataFrame(rows, "i long, g string"), "x", "i", "g").collect())
    assert got == sorted([(a, b) for a in range(11) for b in range(a + 1, 11)] + [(50, 51)])


def test_places_two_exchanges_apart_are_one():
    assert variants._place_evidence("puebla de zaragoza", "pubela de zaragzoa") == 1.0
    assert variants.soft_similarity(["radio", "zerquillo"], [0.1, 5.0], ["radio", "valmonte"], [0.1, 5.0]) < 0.1 < 0.9 < variants.soft_similarity(["radio", "zerquillo"], [0.1, 5.0], ["zerquilo", "radio"], [5.0, 0.1])


def shuffled_rows(df):
    """Rows that the exchanges of a query wrote; the query is run."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            n += node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_sets_that_are_not_similar_are_never_paired_on_disk(spark):
    rows = [(k, [f"own {k} {j}" for j in range(5)] + [f"all {j}" for j in range(5)]) for k in range(200)] + [(900, ["a", "b", "c"]), (901, ["a", "b"])]
    found = setjoin.similar_sets(spark.createDataFrame(rows, "id long, grams array<string>"), 0.5)
    # Each set goes to its first six items on both sides; all pairs were 19,900 rows.
    assert shuffled_rows(found) < 5_000
    assert [(r["a"], r["b"]) for r in found.collect()] == [(900, 901)]


def test_persons_whose_other_words_differ_are_no_candidates(spark):
    given = ("bortaquex", "celvindro", "damzelpan", "filwogrim", "gusyubal", "hulmandor", "janquespi", "korlinfa", "lisgomber", "murdachel")
    rng = random.Random(13)
    rows = [(k, f"{g} ciltrupenda", "altamar", None) for k, g in enumerate(given)] + [(100, "bortaqeux ciltrupenda", "altamar", None), (101, "b ciltrupenda", "altamar", "1234")]
    rows += [(1000 + k, f"{given[k % 10]} {''.join(rng.choices(string.ascii_lowercase, k=9))}", "altamar", None) for k in range(400)]
    records = spark.createDataFrame([(*r, None) for r in rows], "id long, words string, place string, tel string, org string")
    pairs = {(r["a"], r["b"]) for r in variants.person_candidates(records)[0].where("b < 1000").collect()}
    # Of 66 pairs that share the family name and the place.
    assert pairs == {(0, 100), (0, 101), (100, 101)}


def test_what_may_be_a_word_holds_all_alike_words(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abceilmnorstu", k=rng.randint(1, 9))) for _ in range(1500)]
    pairs = [(w, slips(rng, w, rng.randint(1, 3)) if len(w) > 4 else rng.choice(words)) for w in words] + [(w, w[: rng.randint(1, len(w))]) for w in words] + [(a, b) for a, b in zip(words, reversed(words), strict=True)]
    pairs = [p for p in pairs if variants._word_alike(*p) > 0]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert len(pairs) > 1500 and df.where(~variants._may_be_word(F.col("a"), F.col("b"))).count() == 0


def test_names_alike_in_few_words_meet_either_way(spark):
    """A slip may be in the name with the smaller or the greater number, in a rare or a common word."""
    rows = [("z1", "faro gorvecuaro", 9), ("a1", "faro gorveucaro", 1), ("b1", "portal lumbretinta", 1), ("y1", "portal lumbretnita", 9), ("c1", "lumbretinta verde", 2), ("d1", "rumbo ya", 1), ("e1", "rumbo ya", 2)]
    df = spark.createDataFrame([(i, w.replace(" ", ""), w.split(" "), n, None) for i, w, n in rows], "id string, name string, words array<string>, n long, mark string")
    forms, counts, _ = variants.spelling_facts(df)
    got = [(r["a"], r["b"]) for r in variants.spelling_candidates(forms, counts).collect()]
    assert {("a1", "z1"), ("b1", "y1"), ("d1", "e1")} <= set(got) and len(got) == len(set(got)) and all(a < b for a, b in got)
