"""Streams: answers folded into learning state, exposures once for each key, bursts as sessions, keyed merges.

The batch operators take event order from timestamps; the streams take arrival order inside a key, sorted in each
micro-batch. Watermarks are an addition of this engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.operators import review
from glossmill.operators.lineage import shared_folder


#: Parts of a table that a batch rewrites as a whole.
BUCKETS = 64
ANSWERED = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("lemma", T.StringType()), *[T.StructField(c, t) for c, t in review.STATE], T.StructField("last_reviewed", T.TimestampType()), T.StructField("lifecycle", T.StringType())])


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, see lineage.shared_folder()."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").parquet(folder)


def first_exposures(events: DataFrame) -> DataFrame:
    """The first exposure of each user and lemma to arrive; however late another one comes, it is none.

    The state is a key for each user and lemma, as many as the lexicons of the users have entries.
    """
    return events.dropDuplicates(["user_id", "lemma"]).select("user_id", "lemma", "event_id")


def bursts(events: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Runs of events of a user with gaps under ``gap``, told once they are over."""
    return events.withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Finished versions of a bucketed table and the buckets each has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda x: [s.getPath().getName() for s in fs.listStatus(x)] if fs.exists(x) else []
    out = {}
    for v in names(at):
        inside = names(spark._jvm.org.apache.hadoop.fs.Path(at, v))
        if "_SUCCESS" in inside:
            out[int(v[1:])] = [int(n.split("=")[1]) for n in inside if n.startswith("__bucket=")]
    return out


def current(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """The table bucket_sink wrote: of each bucket (of all, unless some are named) the rows of the newest version that has it."""
    newest = {b: v for v, has in sorted(_versions(spark, path).items()) for b in has}
    wanted = [f"{path}/v{v}/__bucket={b}" for b, v in newest.items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def bucket_sink(path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: ``merge(rows there are, batch)`` for the buckets of keys that the batch touches, all others untouched.

    Each batch writes its buckets as a version of their own and only then counts. A batch that has been written is not
    written again, so a retried batch changes nothing; what it replaces is removed only after it, when no retry can ask
    for it any more. At most BUCKETS numbers reach the driver. Keys of one hash share a bucket.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _versions(spark, path)
        if batch_id in done:
            return
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
        if not touched:
            return
        merged = merge(current(spark, path, schema, touched), batch).select(*schema.names)
        merged.withColumn("__bucket", bucket).write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/v{batch_id}")
        newest = {b: v for v, has in sorted(done.items()) for b in has}
        for v, has in done.items():
            for b in has:
                if newest[b] != v:  # replaced before this batch already
                    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}/__bucket={b}")
                    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write


def answer_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Answers (user_id, lemma, ts, event_id, right) folded into the learning state of their words, see review.fold_answers().

    The state is the table itself; a batch is folded partition by partition in Arrow batches, not key by key.
    """
    fold = lambda old, batch: review.fold_answers(batch, ["user_id", "lemma"], "ts", "event_id", "right", old)
    return bucket_sink(path, ["user_id", "lemma"], fold, ANSWERED)


def run_once(stream: DataFrame, folder: str, mode: str, sink: Callable[[DataFrame, int], None] | None = None) -> str:
    """Runs the stream over what is there and stops; returns the folder of its result."""
    out = f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", out)).start()
    query.awaitTermination()
    return out
