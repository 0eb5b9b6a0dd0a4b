"""Token ids of whole texts by a public byte-level BPE, as a monoid reduction over halves of a text.

``encode_text`` splits a text in halves down to leaves, encodes the leaves, and joins neighbours. Two
neighbours are joined by encoding anew a window around their border and by keeping all tokens outside
it. The window grows on either side until it meets a place where a character that is no white space is
followed by white space. There the pre-tokenizer always begins a new piece, whatever stands around it,
so the tokens outside the window cannot change: they are those of the whole text.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts up to so many characters are leaves, and so many tokens when they are decoded.
LEAF_CHARS = 2_048
LEAF_TOKENS = 512
#: Characters looked at first on either side of a border; doubled until a stable place is found.
WINDOW_CHARS = 64
#: Characters of text per Arrow batch that is handed on, so that long texts do not pile up.
BATCH_CHARS = 4_000_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a vocabulary file: ``folder``, the folder in PANELWRIGHT_TOKENIZERS, or /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("PANELWRIGHT_TOKENIZERS", "/opt/tokenizers"), name)


# Fixed value: the pre-tokenizer's pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """A byte-level vocabulary with the lengths of its tokens in bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int32)
        for b, i in ranks.items():
            self.n_bytes[i] = len(b)

    def leaf(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: halves are decoded to bytes, as a token may end within a character, and joined up the tree."""

        def half(lo: int, hi: int) -> bytes:
            if hi - lo <= LEAF_TOKENS:
                return self.encoding.decode_bytes(ids[lo:hi])
            mid = (lo + hi) // 2
            return half(lo, mid) + half(mid, hi)

        ids = list(ids)
        return half(0, len(ids)).decode()

    def _tokens_of(self, ids: list[int], n_bytes: int, from_end: bool) -> int:
        """How many tokens at one end of ``ids`` cover exactly ``n_bytes``."""
        done = k = 0
        while done < n_bytes:
            k += 1
            done += int(self.n_bytes[ids[-k] if from_end else ids[k - 1]])
        if done != n_bytes:
            raise AssertionError("a stable place must fall between two tokens")
        return k

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int], window: int = WINDOW_CHARS) -> list[int]:
        """Ids of ``left + right`` from the ids of both."""
        if not left or not right:
            return left_ids + right_ids
        p = _last_break(left, window)
        q = _first_break(right, window)
        middle = self.leaf(left[p:] + right[:q])
        keep = len(left_ids) - self._tokens_of(left_ids, len(left[p:].encode()), True)
        drop = self._tokens_of(right_ids, len(right[:q].encode()), False)
        return left_ids[:keep] + middle + right_ids[drop:]

    def encode(self, text: str | None, leaf_chars: int = LEAF_CHARS) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        if len(text) <= leaf_chars:
            return self.leaf(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left, leaf_chars), right, self.encode(right, leaf_chars))


def _space(c: str) -> bool:
    # Python also counts the four separators U+001C..U+001F as space; the pre-tokenizer does not.
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def _last_break(text: str, window: int) -> int:
    """Last place in ``text`` where white space follows another character; 0, its start, if there is none."""
    hi, n = len(text) - 1, window
    while hi > 0:
        lo = max(0, len(text) - n)
        for i in range(hi, max(lo, 1) - 1, -1):
            if _space(text[i]) and not _space(text[i - 1]):
                return i
        if lo <= 1:
            break
        hi, n = lo - 1, n * 2
    return 0


def _first_break(text: str, window: int) -> int:
    """First place in ``text`` where white space follows another character; its end if there is none."""
    lo, n = 1, window
    while lo < len(text):
        hi = min(len(text), n)
        for i in range(lo, hi):
            if _space(text[i]) and not _space(text[i - 1]):
                return i
        lo, n = max(lo, hi), n * 2
    return len(text)


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(key, ids): the ids of each row's text; one narrow pass without a shuffle.

    Null and empty texts give an empty list; a text that looks like a special token is plain text. Repeated
    rows come out as often as they are there; other columns of ``df`` are not read. The order is kept.
    """
    path = path or tokenizer_path()
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            start = size = 0
            ids: list[list[int]] = []
            for i, t in enumerate(texts):
                ids.append(c.encode(t, leaf_chars))
                size += len(t or "")
                if size >= BATCH_CHARS or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([keys.slice(start, i + 1 - start), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])
                    start, size, ids = i + 1, 0, []

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")


def decode_ids(df: DataFrame, ids: str = "ids", key: str = "doc_id", path: str | None = None, out: str = "text") -> DataFrame:
    """(key, out): the text of each row's ids; null and empty lists give an empty text. One narrow pass."""
    path = path or tokenizer_path()
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, out])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {key_type}, `{out}` string")


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, leaf_chars: int = LEAF_CHARS, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each text (0 for null and empty) in place of the text column."""
    path = path or tokenizer_path()
    kept = [c for c in df.columns if c not in (text, out)]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f", `{out}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n = pa.array([len(c.encode(t, leaf_chars)) for t in b.column(len(kept)).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], n], names=[*kept, out])

    return df.select(*kept, text).mapInArrow(run, schema)
