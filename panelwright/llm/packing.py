"""Filling of containers with whole items under several limits at once.

Items are vectors (tokens, one segment, loss-bearing tokens). Blocks of items, cut at random and of
bounded size, are packed apart from each other by the dot-product heuristic: into the open container goes
the item that fits and whose vector, each part as a share of its limit, has the largest product with the
container's free room. What ends in containers that are not full enough goes round again: it is shuffled
into new blocks, so that only a few containers of the last round stay open. No block, and so no task,
grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.encode import codec, tokenizer_path
from panelwright.session import cut

#: Items of a block. The loss at its border is at most a container or two in several hundred.
BLOCK_ITEMS = 20_000
#: A container filled to this share of its tokens is closed in a round before the last.
FULL = 0.999
ROUNDS = 2
#: Distinct vectors scored at a time, from the largest that fit downwards, until none that follows can score more.
STEP = 128
#: Loss-bearing tokens of a container as a share of its tokens.
LOSS_SHARE = 0.95


def pack_vectors(size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Container numbers, from 0, of items with the vectors ``size`` (n x d) under ``limit`` (d).

    Dot-product heuristic over all distinct vectors that fit: they are scored from the one with the most tokens
    downwards, until the largest parts of those that follow cannot give a higher product. No item may exceed a limit
    by itself. Ties go to the larger vector in lexical order; equal vectors are taken in the order of the rows.
    """
    n, d = size.shape
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    kinds, inverse, counts = np.unique(size, axis=0, return_inverse=True, return_counts=True)
    # Kinds in falling order of tokens, so that those that fit the room for tokens are a tail of the list.
    inverse = len(counts) - 1 - inverse.reshape(-1)
    kinds, counts = kinds[::-1].copy(), counts[::-1].copy()
    members = np.argsort(inverse, kind="stable")
    next_of = np.concatenate([[0], np.cumsum(counts)[:-1]])
    left = counts.copy()
    # The kinds that are left, side by side: their vectors, shares of the limits, and numbers.
    alive = np.arange(len(counts))
    vec, share, have = kinds, kinds / (limit * limit), left
    rising = -vec[:, 0]
    # What a kind or any behind it can have at most, in shares of the limits.
    bound = np.maximum.accumulate(share[::-1], axis=0)[::-1]
    placed = dead = 0
    bin_no = -1
    room = np.zeros(d, kinds.dtype)
    while placed < n:
        lo = int(rising.searchsorted(-room[0])) if bin_no >= 0 else len(alive)
        best = -1
        most = -1.0
        while lo < len(alive) and (best < 0 or bound[lo] @ room > most):
            hi = lo + STEP
            score = share[lo:hi] @ room
            bad = (vec[lo:hi, 1:] > room[1:]).any(axis=1) | (have[lo:hi] <= 0)
            score[bad] = -1.0
            k = int(score.argmax())
            if score[k] > most:
                best, most = lo + k, score[k]
            lo = hi
        if best < 0:
            bin_no += 1
            room = limit.astype(kinds.dtype)
            continue
        k = alive[best]
        out[members[next_of[k]]] = bin_no
        next_of[k] += 1
        have[best] -= 1
        placed += 1
        room = room - vec[best]
        if not have[best]:
            dead += 1
            if dead * 8 > len(alive):
                keep = have > 0
                alive, vec, share, have = alive[keep], vec[keep], share[keep], have[keep]
                rising = -vec[:, 0]
                bound = np.maximum.accumulate(share[::-1], axis=0)[::-1]
                dead = 0
    return out


def measure(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, n_tokens, n_loss): tokens of each text, and those that bear loss.

    The first line of a text of several lines is the prompt, whose tokens bear none. Null and empty: 0, 0.
    """
    path = path or tokenizer_path()
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(path)
        for b in batches:
            n, loss = [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                n.append(len(ids))
                cut = (t or "").find("\n")
                loss.append(len(ids) - (len(c.encode(t[:cut])) if 0 < cut < len(t) - 1 else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(np.maximum(loss, 0), pa.int32())], names=[key, "n_tokens", "n_loss"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {key_type}, n_tokens int, n_loss int")


def pack(
    items: DataFrame,
    capacities: DataFrame,
    key: str = "doc_id",
    max_segments: int | None = None,
    loss_share: float = LOSS_SHARE,
    block_items: int = BLOCK_ITEMS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Each item of ``items`` (key, n_tokens, n_loss) in containers of every row of ``capacities``.

    Columns: capacity_id, capacity_tokens, bin_id, segment_no, the key, part_no, n_parts, n_tokens, n_loss.
    An item longer than the capacity is cut into parts (part_no from 0), whose full ones fill a container
    each; every other item stays whole (n_parts 1). ``max_segments`` limits the items of a container (by
    default an eighth of its tokens), ``loss_share`` its loss-bearing tokens as a share of its tokens. An item
    that bears more loss than that by itself stays whole and fills a container alone; no other container exceeds
    a limit. Items without tokens take a segment and no room. Null keys are kept as items; repeated rows are items
    of their own. An empty input gives no rows. bin_id is unique within a capacity.
    """
    key_type = items.schema[key].dataType
    # The capacities are a short list of settings; the items are never collected.
    caps = sorted({(int(r[0]), int(r[1])) for r in capacities.select("capacity_id", "capacity_tokens").dropna().where("capacity_tokens > 0").collect()})
    schema = T.StructType([
        T.StructField("capacity_id", T.IntegerType()), T.StructField("capacity_tokens", T.IntegerType()), T.StructField("bin_id", T.StringType()),
        T.StructField("segment_no", T.IntegerType()), T.StructField(key, key_type), T.StructField("part_no", T.IntegerType()),
        T.StructField("n_parts", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("n_loss", T.IntegerType()),
        T.StructField("__open", T.BooleanType()), T.StructField("__rid", T.LongType()),
    ])
    # Token counts are made once; the checkpoint also keeps the row numbers the same in every later job.
    items = cut(items)
    n_items = items.count()
    wide = items.select(F.monotonically_increasing_id().alias("__rid"), F.col(key), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_loss", F.lit(0)).alias("n_loss"))
    cap = F.col("capacity_tokens")
    each = F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity_tokens")) for i, c in caps])
    wide = wide.select("*", F.inline(each if caps else F.array().cast("array<struct<capacity_id:int,capacity_tokens:int>>")))
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / cap)).cast("int")
    wide = wide.withColumn("n_parts", n_parts).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    size = F.when(F.col("part_no") + 1 < F.col("n_parts"), cap).otherwise(F.col("n_tokens") - (F.col("n_parts") - 1) * cap).cast("int")
    before = F.greatest(F.lit(0), F.col("n_loss") - (F.col("n_tokens") - F.col("part_no") * cap - size)).cast("int")
    wide = wide.withColumn("__size", size).withColumn("__loss", F.least(size, before))
    wide = wide.select("capacity_id", "capacity_tokens", "__rid", key, "part_no", "n_parts", F.col("__size").alias("n_tokens"), F.col("__loss").alias("n_loss"))
    # An item or part of just the capacity is a container by itself, and so is one that bears too much loss.
    alone = (F.col("n_tokens") == cap) | (F.col("n_loss") > F.greatest(F.lit(1), F.floor(cap * F.lit(loss_share))))
    done = wide.where(alone).select(
        "capacity_id", "capacity_tokens", F.concat_ws("-", "capacity_tokens", F.lit("full"), "__rid", "part_no").alias("bin_id"),
        F.lit(0).alias("segment_no"), key, "part_no", "n_parts", "n_tokens", "n_loss", F.lit(False).alias("__open"),
    )
    wide = wide.where(~alone)

    def packer(round_no: int, last: bool):
        def run(block: pd.DataFrame) -> pd.DataFrame:
            c = int(block["capacity_tokens"].iloc[0])
            block = block.sort_values(["n_tokens", "__rid", "part_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            most = max_segments or max(1, c // 8)
            limit = np.array([c, most, max(1, int(c * loss_share))])
            size = np.stack([block["n_tokens"], np.ones(len(block)), block["n_loss"]], axis=1).astype(np.int64)
            bins = pack_vectors(size, limit)
            filled = np.bincount(bins, weights=size[:, 0], minlength=bins.max() + 1)
            order = np.argsort(bins, kind="stable")
            seg = np.empty(len(block), np.int32)
            starts = np.r_[0, np.flatnonzero(np.diff(bins[order])) + 1]
            seg[order] = np.arange(len(block)) - np.repeat(starts, np.diff(np.r_[starts, len(block)]))
            out = block.assign(segment_no=seg, bin_id=[f"{c}-{round_no}-{block['__block'].iloc[0]}-{b}" for b in bins])
            out["__open"] = (filled[bins] < FULL * c) & (not last)
            return out[[f.name for f in schema]]

        return run

    todo = wide
    n_blocks = max(1, -(-n_items // block_items))
    for r in range(rounds):
        last = r + 1 == rounds or n_blocks == 1
        salt = F.pmod(F.xxhash64("__rid", "part_no", F.lit(r)), F.lit(n_blocks)).cast("int")
        packed = todo.withColumn("__block", salt).groupBy("capacity_id", "__block").applyInPandas(packer(r, last), schema)
        if last:
            closed = packed
        else:
            packed = cut(packed)
            closed = packed.where("not __open")
            todo = packed.where("__open").select("capacity_id", "capacity_tokens", "__rid", key, "part_no", "n_parts", "n_tokens", "n_loss")
            n_open = todo.groupBy("capacity_id").count().agg(F.max("count")).first()[0] or 0
            n_blocks = max(1, -(-n_open // block_items))
        done = done.unionByName(closed.drop("__rid"))
        if last:
            break
    return done.drop("__open")
