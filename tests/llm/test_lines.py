from collections import Counter

from panelwright.llm import heavy, mainbody, standing


def test_lossy_counts_miss_nothing():
    import random

    rng = random.Random(4)
    rows = [{f"k{rng.randint(0, 400)}" for _ in range(6)} | ({"hot"} if rng.random() < 0.12 else set()) for _ in range(4000)]
    true = Counter(k for r in rows for k in r)
    parts = [heavy.LossyCounter(0.02) for _ in range(5)]
    for i, r in enumerate(rows):
        parts[i % 5].add(r)
    merged: Counter = Counter()
    for p in parts:
        for k, (n, _) in p.counts.items():
            merged[k] += n
    assert all(true[k] - merged[k] <= 0.02 * len(rows) + 5 for k in true)
    assert merged["hot"] >= (0.1 - 0.02) * len(rows)


def test_template():
    t = lambda s: standing.template(s)[0]
    assert t("Únete a los 63555 suscriptores.") == t("* únete a  los 12 suscriptores!") == "unete a los # suscriptores"
    assert t("Por Ana Galventes") == t("– Por Juan Pérez López .") == "por #"
    assert t("Más en https://a.example/x?y=1") == t("MÁS EN HTTPS://B.EXAMPLE/z") == "mas en #"
    assert t("...") == ""


def brute(rows):
    """Rows and lines by the definition, for lines whose templates show in their letter case."""
    n = Counter(s for _, s, t in rows if t and t.strip())
    seen = Counter((s, k) for _, s, t in rows for k in {standing.template(x)[0] for x in (t or "").split("\n") if x.strip()})
    return sorted((i, k) for i, s, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip() and (v := seen[s, standing.template(x)[0]]) >= 5 and v >= 0.1 * n[s])


def test_standing_lines(spark):
    rows = []
    for i in range(120):
        s = "hot" if i % 3 else f"s{i % 6}"
        body = f"Frase número {chr(97 + i % 26)} con {chr(98 + i % 25)} dentro del texto propio de la nota {'abcdefghij'[i % 10] * (i % 7 + 1)}."
        rows.append((i, s, "\n".join([*(["Última actualización: 8 de mayo de 2022, 23:39 h"] if i % 2 else []), body, "", *(["Comparte esta nota."] if i % 9 == 0 else []), *(["Comparte esta nota."] * 2 if i % 9 == 0 else [])])))
    rows += [(900, "hot", None), (901, "hot", "  \n "), (902, None, "x y z"), (903, "hot", "p" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "article_row long, source_id string, main_text string, line_no string")
    lines, _ = standing.standing_lines(df.drop("line_no"))
    assert sorted((r["article_row"], r["line_no"]) for r in lines.collect()) == brute(rows)
    clean = {r["article_row"]: r["main_text"] for r in standing.without_standing_lines(df).collect()}
    assert clean[900] is None and "Última" not in clean[1] and len(clean) == len(rows)
    assert standing.standing_lines(df.limit(0))[0].count() == 0


def test_lines_without_letter_case_fit_templates(spark):
    rows = [(i, "s", f"Por Ana{chr(97 + i % 20)} Pérez\ncuerpo {i}{chr(97 + i % 20)} a b c d") for i in range(18)] + [(50, "s", "POR JUAN LÓPEZ\nx1 y2"), (51, "s", "por luis gómez\nx1 y2")]
    df = spark.createDataFrame(rows, "article_row long, source_id string, main_text string")
    got = {(r["article_row"], r["line_no"]) for r in standing.standing_lines(df)[0].collect()}
    assert {(50, 0), (51, 0), (0, 0)} <= got


def test_sets_go_by_join_beyond_the_broadcast(spark):
    rows = [(i, f"s{i % 2}", f"Comparte esta nota.\nalgo propio {chr(97 + i)} {chr(98 + i)}") for i in range(20)]
    df = spark.createDataFrame(rows, "article_row long, source_id string, main_text string")
    sets = heavy.SourceSets(spark.createDataFrame([("s0", "comparte esta nota"), ("s1", "comparte esta nota")], "source string, key string"), limit=0)
    assert sets.value is None
    assert standing.line_hits(df, "article_row", "source_id", "main_text", sets).count() == 20


def test_blocks_lie_between_surge_and_dive():
    assert mainbody.blocks([10, 5, 0, 90, 90, 90, 8, 7]) == [(2, 6)]
    # A short interruption stays in, a long one ends the block; a low curve is measured by its highest point.
    assert mainbody.blocks([90] * 3 + [0] * 4 + [90] * 3) == [(0, 9)]
    assert mainbody.blocks([90] * 3 + [0] * 20 + [90] * 3) == [(0, 3), (22, 25)]
    assert mainbody.blocks([20] * 30) == [(1, 29)]
    assert mainbody.blocks([0] * 5) == mainbody.blocks([]) == []


def test_a_sentence_alone_is_no_body():
    page = "\n".join(["Este sitio guarda archivos.", *["menú"] * 20, "La obra de la carretera se terminará a tiempo según el alcalde de la ciudad.", "Los vecinos dijeron que el pago está pendiente desde hace varios meses.", *["pie"] * 20, "Todo queda en la red."])
    assert mainbody.body_lines(page, lambda k: False, lambda k: False)[0] == {21, 22}


PAGE = """Inicio > Política > Título de la nota
Título de la nota
Por Ana Galventes
El alcalde dijo que la obra de la carretera se terminará a tiempo. Los vecinos no lo creen.
El contexto
Los trabajadores recordaron que el pago está pendiente desde hace meses en la ciudad.
TE RECOMENDAMOS: Otra nota sin punto
- Un punto de la lista que termina como una frase.
Tendencias
» Crece la tarifa en otro lugar
#tema uno, tema dos
© 2025 El Diario"""


def test_body():
    body, every = mainbody.body_lines(PAGE, {"tendencias"}.__contains__, frozenset().__contains__)
    assert body == {3, 4, 5, 7} and len(every) == 12
    assert mainbody.body_lines("Nota uno\nNota dos\n¿Quién paga?", lambda k: False, lambda k: False)[0] == set()
    assert mainbody.body_lines("", lambda k: False, lambda k: False) == (set(), [])
    assert mainbody.body_lines("<p>Una frase con marcas de texto dentro.</p>", lambda k: False, lambda k: False)[0] == {0}


def test_pages(spark):
    notice = "Usamos cookies propias para mejorar tu experiencia."
    rows = [(i, "s", f"https://s.example/{i}", f"{notice}\nMenú\nFrase única {'xyzw'[i % 4] * (i + 1)} de la página que termina con punto.\nVolver arriba") for i in range(12)]
    rows += [(20 + i, "s", f"http://s.example/1?x={i}", "Menú\nLa misma página vista otra vez con este texto.\nVolver arriba") for i in range(8)]
    rows += [(90, "s", None, None), (91, None, "u", ""), (92, None, None, "Una página sola sin sitio con una frase entera."), (93, "s", "https://s.example/z", "a b c.\n" * 20_000)]
    df = spark.createDataFrame([(*r, True) for r in rows], "page_row long, source_id string, url string, main_text string, in_body boolean")
    got: dict = {}
    for r in mainbody.outside_lines(df).collect():
        got.setdefault(r["page_row"], {})[r["line_no"]] = r["in_body"]
    assert got[0] == {0: False, 1: False, 2: True, 3: False}
    # A page that was fetched eight times is one page: its text is not furniture.
    assert got[20] == {0: False, 1: True, 2: False}
    assert 90 not in got and 91 not in got and got[92] == {0: True}
    assert mainbody.outside_lines(df.limit(0)).count() == 0


def test_standing_lines_that_begin_with_a_name(spark):
    names = ["Ana", "Luis", "Rosa", "Juan", "Eva", "Raúl", "Inés", "Hugo", "Olga", "Iván", "Sara", "Tito"]
    rows = [(i, "s", f"{x} Pérez, staff writer | January {i + 1}, 2020\nComparte esta nota\n{x} dijo algo {'abcdefghijkl'[i]}") for i, x in enumerate(names)]
    rows += [(20 + i, "s", f"{x.upper()}HUACO, a {i + 1} de noviembre de 2023.-\ncuerpo {'abcdefghijkl'[i]} propio") for i, x in enumerate(names)]
    # All in capitals, and a line that only ends like a standing line.
    rows += [(50, "s", "LOLA LÓPEZ, STAFF WRITER | MAY 2, 2021"), (51, "s", "Escribió esta nota")]
    df = spark.createDataFrame(rows, "article_row long, source_id string, main_text string")
    lines, _ = standing.standing_lines(df)
    want = sorted([(i, k) for i in range(12) for k in (0, 1)] + [(20 + i, 0) for i in range(12)] + [(50, 0)])
    assert sorted((r["article_row"], r["line_no"]) for r in lines.collect()) == want
    clean = {r["article_row"]: r["main_text"] for r in standing.without_standing_lines(df).collect()}
    assert clean[0] == "Ana dijo algo a" and clean[20] == "cuerpo a propio" and clean[50] == "" and clean[51] == "Escribió esta nota"
