"""Sinks: keyed upsert, pack and fragment files, chunks, exports, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """The base with pending rows put over those of equal keys (null equals null); each side unique in its keys."""
    on = reduce(lambda a, b: a & b, [base[k].eqNullSafe(pending[k]) for k in keys])
    return base.join(pending, on, "left_anti").unionByName(pending)


def write_pack(pack: DataFrame, path: str) -> None:
    """A pack as Parquet, partitioned by language and shard, so that readers of one language prune the rest."""
    pack.write.mode("overwrite").partitionBy("target_lang", "shard").parquet(path)


def write_fragment(rows: DataFrame, path: str) -> None:
    """Entries as JSON lines; absent fields are left out."""
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_chunks(rows: DataFrame, path: str, chunk: str = "chunk_id") -> None:
    """One folder for each chunk; earlier chunks are cleared."""
    rows.write.mode("overwrite").partitionBy(chunk).json(path)


def write_padded_chunks(rows: DataFrame, path: str, chunks: int, chunk: str = "chunk_id") -> None:
    """write_chunks with all of the chunks 0 to ``chunks`` - 1: those without rows are empty folders."""
    write_chunks(rows, path, chunk)
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    for i in range(chunks):
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{chunk}={i}")
        at.getFileSystem(conf).mkdirs(at)


def export_name(base: str, extension: str, at: Column) -> Column:
    """Name of an export: its base, the day, its kind."""
    return F.concat(F.lit(f"{base}-"), F.date_format(at, "yyyy-MM-dd"), F.lit(f".{extension}"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def iso_millis(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def csv_line(columns: list[str], at: str, noun_only: tuple[str, ...] = ()) -> Column:
    """A line with every cell quoted and quotes doubled; nulls are empty cells; the time as ISO with milliseconds."""
    cell = lambda c: F.when(F.col("part_of_speech") == "noun", F.col(c)) if c in noun_only else F.col(c)
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[quoted(cell(c)) for c in columns], quoted(iso_millis(F.col(at))))


def tsv_line(english: str, target: str, gloss: str) -> Column:
    """Target, tab, English with its gloss; tabs and line breaks inside become spaces."""
    flat = lambda x: F.regexp_replace(x, r"\t|\r?\n", " ")
    definition = F.when(F.coalesce(F.col(gloss), F.lit("")) != "", F.concat(F.col(english), F.lit(" - "), F.col(gloss))).otherwise(F.col(english))
    return F.concat_ws("\t", flat(F.coalesce(F.nullif(F.col(target), F.lit("")), F.col(english))), flat(definition))


def size_report(rows: DataFrame, group: str, columns: list[str], warn_bytes: int = 10 << 20) -> DataFrame:
    """Bytes of the texts of each group and whether they pass the warning size."""
    each = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in columns])
    return rows.groupBy(group).agg(F.sum(each.cast("bigint")).alias("raw_bytes"), F.count("*").alias("n_entries")).withColumn("too_large", F.col("raw_bytes") > warn_bytes)
