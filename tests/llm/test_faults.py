"""Every query of the subpackage on tables with nulls in all columns, repeated rows, further columns, and no rows."""

import os

import pytest
from pyspark.sql import functions as F

from panelwright.llm.queries import QUERIES

TABLES = ["articles", "sitemap_articles", "gdelt_urls", "transcript_rows", "attendance", "question_aliases", "accreditations", "contracts", "outlet_registry", "news_sources", "pack_capacities", "documents"]
CLASH = ["key", "source", "line_no", "label", "lang_", "words", "id", "root", "n", "a", "b", "p", "row_id", "payee", "block", "speaker", "__id", "__keys", "__src", "confidence", "doc_lang"]


@pytest.fixture(scope="module")
def spoilt(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("spoilt"))
    for t in TABLES:
        df = spark.read.parquet(f"{data}/{t}.parquet")
        holes = df.select(*[F.when(F.pmod(F.xxhash64(F.lit(c), *df.columns), F.lit(6)) > 0, F.col(c)).alias(c) for c in df.columns])
        out = holes.unionByName(holes.limit(5)).withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})
        out.write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_spoilt_tables(spark, spoilt, name):
    assert os.path.isdir(spoilt)
    df = QUERIES[name](spark, spoilt)
    assert len(df.collect()) >= 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
