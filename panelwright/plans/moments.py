"""Queries on mixed timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.timestamps import with_utc_seconds
from panelwright.session import broadcast_if_small
from panelwright.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each usable value of articles.date_published, articles.date_modified and gdelt_urls.seendate as a moment."""
    src = table(spark, folder, "news_sources").select("source_id", "tz", (F.col("locale") == "en-US").alias("us"))
    src = broadcast_if_small(src.dropna(subset=["source_id"]).dropDuplicates(["source_id"]))
    art = table(spark, folder, "articles").select("article_row", "source_id", "date_published", "date_modified")
    art = art.unpivot(["article_row", "source_id"], ["date_published", "date_modified"], "field", "value").withColumnRenamed("article_row", "row_id")
    art = art.where("value is not null").join(src, "source_id", "left").withColumn("tbl", F.lit("articles"))
    gd = table(spark, folder, "gdelt_urls").select(F.col("url_row").alias("row_id"), "source_id", F.lit("seendate").alias("field"), F.col("seendate").alias("value"))
    gd = gd.where("value is not null").join(src, "source_id", "left").withColumn("tz", F.lit("UTC")).withColumn("tbl", F.lit("gdelt_urls"))
    both = art.unionByName(gd)
    out = with_utc_seconds(both, "value", "utc_s", tz="tz", month_first="us")
    return out.where("utc_s is not null").select("tbl", F.col("row_id").cast("long").alias("row_id"), "field", "utc_s")


QUERIES = {"p4_found": p4_found}
ORACLES: dict[str, str] = {}
