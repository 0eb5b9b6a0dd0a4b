import random

import pytest

from panelwright.llm import language, turns

WORDS = {
    "es": "el la los que de se por una con para dijo quien según durante aunque está hasta más también ciudad",
    "pt": "o a os que de não uma com para disse quem segundo durante embora está até mais também cidade são",
    "fr": "le la les que de ne une avec pour dit qui selon pendant bien est jusqu plus aussi ville sont",
    "it": "il la gli che di non una con per detto chi secondo durante anche è fino più ancora città sono",
    "en": "the of and that to was for with said who during although this has been more also town were they",
    "de": "der die und dass zu war für mit sagte wer während obwohl dies hat gewesen mehr auch stadt waren sie",
}


def text(rng, code, n):
    return " ".join(rng.choice(WORDS[code].split()) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(text(rng, c, rng.randint(8, 30)), c) for c in WORDS for _ in range(120)]
    noisy = [(t, rng.choice(list(WORDS)) if rng.random() < 0.1 else c) for t, c in rows]
    return language.train([t for t, _ in noisy], [c for _, c in noisy])


def test_held_out_accuracy(spark, model):
    rng = random.Random(2)
    rows = [(i, text(rng, c, 12), c) for i, c in enumerate(c for c in WORDS for _ in range(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.paragraphs(df, model).collect()}
    assert sum(got[i]["lang"] == c for i, _, c in rows) >= 0.97 * len(rows)
    assert all(0 <= r["confidence"] <= 1 for r in got.values())


def test_mixed_documents_and_edges(spark, model):
    rng = random.Random(3)
    es, de = text(rng, "es", 20), text(rng, "de", 20)
    rows = [(1, f"{es}\n\n{de}\r\n12:30\n📷", "es"), (2, None, None), (3, "", "es"), (4, "123 — 456", "es"), (5, es, "Español"), (6, de, "xx"), (7, es.upper(), "de-DE"), (8, f'{es} "{de}"', "ES"), (9, (es + " ") * 400, "spa"), (5, es, "Español")]
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, doc_lang string, confidence double")
    got = language.paragraphs(df, model).collect()
    by = {(r["doc_id"], r["para_no"]): r for r in got}
    assert [by[1, 0]["lang"], by[1, 2]["lang"], by[1, 0]["mixed"]] == ["es", "de", True] and (1, 3) not in by and (1, 4) not in by
    assert not {2, 3, 4} & {r["doc_id"] for r in got} and sum(r["doc_id"] == 5 for r in got) == 2
    assert by[5, 0]["label"] == "es" and by[6, 0]["label"] is None and by[7, 0]["lang"] == "es" and by[8, 0]["lang"] == "es" and not by[8, 0]["mixed"] and by[9, 0]["lang"] == "es"
    assert language.paragraphs(df.limit(0), model).count() == 0


def test_a_sample_is_trained_on_once(monkeypatch):
    rng = random.Random(4)
    rows = [(text(rng, c, 20), c) for c in WORDS for _ in range(20)]
    texts, labels = [t for t, _ in rows], [c for _, c in rows]
    calls = []
    real = language.train
    monkeypatch.setattr(language, "train", lambda *a: calls.append(1) or real(*a))
    first, second = language.trained(texts, labels), language.trained(texts, labels)
    first.share = "other"
    assert len(calls) == 1 and not isinstance(second.share, str)
    language.trained(texts[1:], labels[1:])
    assert len(calls) == 2


def test_training_sample_is_bounded(spark):
    df = spark.createDataFrame([(f"frase número {i} de una lista de frases que sirven de muestra", "es" if i % 2 else None) for i in range(50)], "text string, lang string")
    assert len(language.training_sample(df, "text", "lang", 7)[0]) == 7


def conference(spark, rows, block=5_000):
    df = spark.createDataFrame([(1, k if r[0] is None else r[0], r[1], r[2], 0) for k, r in enumerate(rows)], "conference_id long, source_row int, participant_raw string, text string, loaded_at int")
    return [(r["turn_no"], r["speaker"].split(" ")[0], r["first_row"], r["last_row"]) for r in turns.speaker_turns(df, block).orderBy("turn_no").collect()]


P, Q = "PRESIDENTA AURELIA BALMORENDES QUIRAZOLA", "PREGUNTA"
ROWS = [
    (None, Q, "¿Hay fecha?"), (None, P, "Sí hay."), (None, "PDTA. A. BALMORENDES:", "[00:01:02] Eh, la habrá."), (None, "VOCES", "(aplausos)"), (None, None, "Sigo yo. (risas)"), (None, Q, "Mmm."),
    (None, "Presidenta Balmorendes (cont.)", "NOTA DEL DÍA: todo en orden."), (None, P, "Gracias. —PREGUNTA: ¿Y ahora?"), (None, "", "Otra cosa."), (None, "PRESIDENTA AURELIA BALOORENDES QUIRAZOLA <00:26:53>", "PREGUNTA : Perdón."), (None, P, ""), (None, P, None), (None, P, "Fin."),
]
WANT = [(1, "kind", 0, 0), (2, "aurelia", 1, 7), (3, "kind", 7, 9), (4, "aurelia", 12, 12)]


@pytest.mark.parametrize("block", [5_000, 4, 3, 1])
def test_turns(spark, block):
    assert conference(spark, ROWS, block) == WANT
    assert conference(spark, [*ROWS, *[(k, *r[1:]) for k, r in enumerate(ROWS)]], block) == WANT


def test_turn_edges(spark):
    assert conference(spark, [(None, None, "Sin etiqueta."), (None, None, "Tampoco.")]) == [(1, "unknown", 0, 1)]
    assert conference(spark, [(None, P, "(aplausos)"), (None, Q, "Eh… este,")]) == []
    assert conference(spark, [(None, P, "palabra " * 50_000)]) == [(1, "aurelia", 0, 0)]


def test_precedence():
    # Time marks order what has no row; the fewest marks against the rows are dropped; cues place what has no mark.
    assert turns.precedence_order([0, 1, None, 2], [0, 0, 0, 0], [10, 20, 25, 30]) == [0, 1, 2, 3]
    assert turns.precedence_order([0, 1, 2], [0, 0, 0], [30, 10, 20]) == [0, 1, 2]
    assert turns.precedence_order([0, 1, 2, None], [0, 0, 0, 0], [99, 10, 20, 15]) == [0, 1, 3, 2]
    assert turns.precedence_order([1, 1, 0], [1, 0, 0], [None, None, None]) == [2, 1, 0]
    assert turns.precedence_order([0, 1, 2, None, None], [0] * 5, [None] * 5, [None, "+video", None, "-video", None]) == [0, 1, 3, 2, 4]
    assert turns.precedence_order([], [], []) == []


def test_longest_chain_is_the_longest():
    rng = random.Random(5)
    for _ in range(200):
        marks = [(t, (rng.randrange(12), 0)) for t in range(rng.randint(0, 9))]
        got = turns.longest_chain(marks)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))
        sets = [[p for k, (_, p) in enumerate(marks) if m >> k & 1] for m in range(1 << len(marks))]
        most = max(len(c) for c in sets if all(x < y for x, y in zip(c, c[1:], strict=False)))
        assert len(got) == most


@pytest.mark.parametrize("chunk", [5_000, 2])
def test_rows_without_number_stand_between_their_marks(spark, chunk):
    rows = [(0, "ANA PEREGRINA", "[00:10] Uno."), (1, "ANA PEREGRINA", "[00:30] Tres."), (None, "ZOILA VENTANAL", "[00:20] Dos."), (None, "ZOILA VENTANAL", "[00:20] Dos.")]
    df = spark.createDataFrame([(1, *r, 0) for r in rows] + [(None, *r, 0) for r in rows], "conference_id long, source_row int, participant_raw string, text string, loaded_at int")
    got = sorted(turns.speaker_turns(df, chunk, with_text=True).where("conference_id = 1").collect(), key=lambda r: r["turn_no"])
    assert [(r["speaker"].split(" ")[0], r["first_row"], r["last_row"], r["text"]) for r in got] == [("ana", 0, 0, "Uno."), ("zoila", None, None, "Dos."), ("ana", 1, 1, "Tres.")]
    assert turns.speaker_turns(df, chunk).where("conference_id is null").count() == 3


def test_distributed_order_is_the_graph_order(spark):
    rng = random.Random(6)
    rows = []
    for c in range(6):
        for k in range(30):
            t = rng.choice([None, None, rng.randrange(60)])
            cue = rng.choice(["", "", "(inicia video)", "(concluye video)"])
            rows.append((c, None if rng.random() < 0.3 else k, f"VOZ{c}{k}LARGA UNO", f"{'' if t is None else f'[00:{t:02d}] '}{cue} palabra{k}", 0))
    df = spark.createDataFrame(rows, "conference_id long, source_row int, participant_raw string, text string, loaded_at int")
    segs = [r.asDict() for r in turns.segments(df, True).collect()]
    got = turns.speaker_turns(df, 7, with_text=True).orderBy("conference_id", "turn_no").collect()
    for c in range(6):
        mine = [s for s in segs if s["conference_id"] == c]
        order = turns.precedence_order(*([s[k] for s in mine] for k in ("source_row", "seg_no", "at_s", "cue", "owner")))
        want = [turns.clean_text(mine[i]["text"]) for i in order if mine[i]["words"]]
        assert [x for r in got if r["conference_id"] == c for x in r["text"].split("\n")] == want


def test_clean_text():
    assert turns.clean_text("[00:01:02] Eh, la habrá *aplausos* en este país, o sea, mañana, ¿no?\n(risas)\nBueno, sí.") == "La habrá en este país, mañana\nSí."


def test_roster_grows_with_its_labels():
    import time

    def took(n):
        rng = random.Random(n)
        labels = [("".join(rng.choices("abcdefghilmnoprstuv", k=9)).upper() + " " + "".join(rng.choices("abcdefghilmnoprstuv", k=10)).upper(), 1, True) for _ in range(n)]
        at = time.process_time()
        assert len(set(turns.roster(labels).values())) > 0.95 * n
        return time.process_time() - at

    took(50)
    assert took(1600) < 12 * max(took(400), 0.05)


def test_labels():
    got = turns.roster([("SECRETARIO DE OBRAS, JUAN LUMBERTO PINVEGA", 3, True), ("Juan Lumberto (secretario de obras)", 1, True), ("SECRETARIO DE OBRAS", 1, True), ("J. Lumberto", 1, True), ("INTERLOCTUOR", 1, True), ("NOTA DEL DÍA", 2, False), ("PREGUNTA (Ana Rosvega, El Faro)", 1, True), ("ANA ROSVEGA, EL FARO", 1, True)])
    assert len({got[k] for k in list(got) if "umberto" in k.lower() or k == "SECRETARIO DE OBRAS"}) == 1 and got["INTERLOCTUOR"] == "kind interlocutor" and got["NOTA DEL DÍA"] is None
    assert got["PREGUNTA (Ana Rosvega, El Faro)"] == got["ANA ROSVEGA, EL FARO"]
