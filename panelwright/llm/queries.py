"""Queries of the llm subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import encode, packing
from panelwright.session import cut
from panelwright.sources.tables import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode.encode_texts(table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The text that the token ids of every document decode to: the text itself, empty for null."""
    return encode.decode_ids(p8_ids(spark, folder))


def p9_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, measured in tokens of byte_bpe_50k, in containers of each capacity."""
    items = packing.measure(table(spark, folder, "documents"))
    return packing.pack(items, table(spark, folder, "pack_capacities"))


def p9_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Of each capacity: documents that have all their parts, and containers that break a limit (none may)."""
    bins = cut(p9_bins(spark, folder))
    cap = F.col("capacity_tokens")
    size = bins.groupBy("capacity_id", "capacity_tokens", "bin_id").agg(F.sum("n_tokens").alias("n"), F.sum("n_loss").alias("loss"), F.count("*").alias("m"))
    bad = (F.col("n") > cap) | (F.col("m") > F.greatest(F.lit(1), F.floor(cap / 8))) | ((F.col("m") > 1) & (F.col("loss") > F.floor(cap * packing.LOSS_SHARE)))
    size = size.groupBy("capacity_id", "capacity_tokens").agg(F.count_if(bad).alias("broken"))
    whole = bins.groupBy("capacity_id", "doc_id").agg(F.count("*").alias("m"), F.max("n_parts").alias("parts"), F.sum("n_tokens").alias("n"), F.first("capacity_tokens").alias("c"))
    whole = whole.where((F.col("m") == F.col("parts")) & ((F.col("parts") == 1) | (F.col("n") > F.col("c")))).groupBy("capacity_id").agg(F.count("*").alias("documents"))
    return size.join(whole, "capacity_id").select("capacity_id", "capacity_tokens", "documents", "broken")


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_bins": p9_bins, "p9_limits": p9_limits}
ORACLES: dict[str, str] = {
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p9_limits": "select capacity_id, capacity_tokens, (select count(distinct doc_id) from documents) as documents, 0 as broken from pack_capacities",
}

for _name in ("language", "mainbody", "outlets", "payees", "standing", "turns", "variants"):
    _m = importlib.import_module(f"panelwright.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
