"""Queries of the core over a folder's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators.packed import split_packed
from glossmill.plans import dictionary, page, quality, review, streams
from glossmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "candidate").select(F.lit("candidate.gloss").alias("origin"), F.col("cand_id").alias("row_id"), F.col("gloss").alias("text"))
    p = table(spark, folder, "pack_entry").select(F.lit("pack_entry.source_gloss").alias("origin"), F.col("entry_id").alias("row_id"), F.col("source_gloss").alias("text"))
    return split_packed(c.unionByName(p), "text", ["origin", "row_id"])


QUERIES: dict[str, Query] = {"p2_found": p2_found} | dictionary.QUERIES | page.QUERIES | review.QUERIES | quality.QUERIES | streams.QUERIES
ORACLE: dict[str, str] = dictionary.ORACLE | page.ORACLE | review.ORACLE | quality.ORACLE | streams.ORACLE
