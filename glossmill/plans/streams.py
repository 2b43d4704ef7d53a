"""Streams over events, run over what is there, and text nodes; SQL of the batch twins checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.plans import review
from glossmill.sources.html import text_nodes
from glossmill.sources.tables import table
from glossmill.streaming import state


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    s = state.read_table_stream(spark, folder, "events", schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("lemma", F.format_string("w%02d", F.pmod("event_id", F.lit(review.LEMMAS))))


def stream_sm2(spark: SparkSession, folder: str) -> DataFrame:
    answers = _events(spark, folder).where("event_type IN ('purchase', 'error')").withColumn("right", F.col("event_type") == "purchase")
    at = state.new_folder(spark)
    state.run_once(answers, at, "append", state.answer_sink(f"{at}/table"))
    return state.current(spark, f"{at}/table", state.ANSWERED).select("user_id", "lemma", "srs_interval", F.round("srs_ease", 6).alias("srs_ease"), "srs_repetitions", "history")


def stream_exposures(spark: SparkSession, folder: str) -> DataFrame:
    """Users and lemmas with an exposure; which event was first in a stream is not fixed, so only the pairs are told."""
    seen = _events(spark, folder).where("event_type IN ('view', 'click')")
    out = state.run_once(state.first_exposures(seen), state.new_folder(spark), "append")
    return spark.read.parquet(out).select("user_id", "lemma")


def html_text_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Text nodes of the documents read as HTML; most hold one node, waste with tags several or none."""
    return text_nodes(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (stream_sm2, stream_exposures, html_text_nodes)}
ORACLE = {
    "stream_sm2": f"WITH RECURSIVE {review._EV}, {review._FOLD} SELECT user_id, lemma, srs_interval, srs_ease, srs_repetitions, history FROM st",
    "stream_exposures": f"WITH {review._EV} SELECT DISTINCT user_id, lemma FROM ev WHERE event_type IN ('view', 'click')",
}
