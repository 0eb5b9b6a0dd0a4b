import os
import random

import numpy as np
import pytest

from panelwright.llm import encode, packing

pytestmark = pytest.mark.skipif(not os.path.exists(encode.tokenizer_path()), reason="no vocabulary files")


def test_tree_is_the_whole():
    c = encode.codec(encode.tokenizer_path())
    rng = random.Random(5)
    parts = ["a", "'", "s", " ", "  ", "\n", "\t", "é", "ñ", "1", ".", "'re", "漢", "😀", " ", " ", "\x1c", "\x85", "<|endoftext|>", "word", "\r\n"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert c.encode(s, rng.choice([1, 2, 3, 5, 9])) == c.encoding.encode_ordinary(s)
    for s in ("x" * 5000, " " * 5000, "漢字" * 900, "don't " * 700):
        assert c.encode(s, 100) == c.encoding.encode_ordinary(s)
        assert c.decode(c.encode(s, 100)) == s


def test_ids_agree_with_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [None, "", "Hola, ¿qué tal?", "<|endoftext|> ja", "a\r\n\r\n b", "x" * 40_000, " leading", "líneá"]
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in encode.encode_texts(df, leaf_chars=1000).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert encode.encode_texts(df.limit(0)).count() == 0


def test_repeated_rows_and_counts(spark):
    df = spark.createDataFrame([(1, "uno dos"), (1, "uno dos"), (2, None)], "doc_id long, text string")
    assert encode.encode_texts(df).count() == 3
    assert sorted(r["n_tokens"] for r in encode.count_tokens(df).collect())[0] == 0


def test_vectors_keep_all_limits():
    rng = np.random.default_rng(1)
    size = np.c_[rng.integers(1, 400, 3000), np.ones(3000, int), rng.integers(0, 200, 3000)]
    limit = np.array([512, 6, 300])
    bins = packing.pack_vectors(size, limit)
    for k in range(3):
        assert np.bincount(bins, size[:, k]).max() <= limit[k]
    assert len(packing.pack_vectors(size[:0], limit)) == 0
    ties = np.tile([[256, 1, 0]], (10, 1))
    assert len(set(packing.pack_vectors(ties, np.array([512, 64, 512])))) == 5


def test_every_item_is_in_a_container(spark):
    rows = [(i, int(n)) for i, n in enumerate(np.random.default_rng(2).integers(0, 900, 400))] + [(7, 5), (900, 5000), (None, 3)]
    items = spark.createDataFrame([(k, n, n // 2, "x") for k, n in rows], "doc_id long, n_tokens int, n_loss int, bin_id string")
    caps = spark.createDataFrame([(1, 512), (2, 2048), (2, 2048), (3, None)], "capacity_id int, capacity_tokens int")
    got = packing.pack(items, caps, block_items=64).collect()
    for cap in (512, 2048):
        mine = [r for r in got if r["capacity_tokens"] == cap]
        assert sum(r["n_tokens"] for r in mine) == sum(n for _, n in rows)
        fill: dict = {}
        for r in mine:
            fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + r["n_tokens"]
            assert r["n_parts"] == max(1, -(-next(n for k, n in rows if k == r["doc_id"] and (n + cap - 1) // cap == r["n_parts"] or n == 0 and r["n_parts"] == 1) // cap)) or r["n_parts"] == 1
        assert max(fill.values()) <= cap
        assert len(fill) <= 1.1 * sum(n for _, n in rows) / cap + 6
        assert sum(r["part_no"] == 0 for r in mine) == len(rows)
    assert packing.pack(items.limit(0), caps).count() == 0
    assert packing.pack(items, caps.limit(0)).count() == 0


def plain_packing(size, limit):
    """Dot-product heuristic that scores every item that is left."""
    left = sorted(range(len(size)), key=lambda i: (*(-size[i]), i))
    out, n = np.full(len(size), -1), 0
    while left:
        room = limit.copy()
        while fits := [i for i in left if (size[i] <= room).all()]:
            i = max(fits, key=lambda i: (round(float((size[i] / (limit * limit)) @ room), 12), *size[i], -i))
            out[i], room = n, room - size[i]
            left.remove(i)
        n += 1
    return out


def test_the_bounded_search_is_the_full_one(monkeypatch):
    rng = np.random.default_rng(3)
    size = np.c_[rng.integers(1, 120, 250), np.ones(250, int), np.zeros(250, int)]
    size[:, 2] = size[:, 0] * rng.choice([0, 0.5, 1], 250)
    for limit in (np.array([128, 16, 121]), np.array([128, 3, 121])):
        monkeypatch.setattr(packing, "STEP", 4)
        few = packing.pack_vectors(size, limit)
        monkeypatch.setattr(packing, "STEP", 10_000)
        assert (few == packing.pack_vectors(size, limit)).all() and few.max() == plain_packing(size, limit).max()


def test_loss_limit_holds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(n), int(n * rng.choice([0.2, 0.9, 1.0]))) for i, n in enumerate(rng.integers(1, 513, 600))]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens int, n_loss int")
    got = packing.pack(items, spark.createDataFrame([(1, 512)], "capacity_id int, capacity_tokens int"), loss_share=0.8).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["bin_id"], []).append(r)
    assert sorted(r["doc_id"] for r in got) == [*range(600)] and all(r["n_parts"] == 1 for r in got)
    assert all(len(b) == 1 or sum(r["n_loss"] for r in b) <= 409 for b in by.values())
    assert sum(r["n_loss"] for r in got) == sum(x[2] for x in rows)


def test_decoding_goes_up_the_tree(spark):
    texts = [None, "", "Hola 漢😀 " * 900, "a\r\nb"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in encode.decode_ids(encode.encode_texts(df)).collect()} == {i: x or "" for i, x in enumerate(texts)}
