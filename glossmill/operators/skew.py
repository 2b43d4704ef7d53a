"""Join of rows with their groups that survives a group holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is split when it holds more than this part of all rows, so that fewer groups than its inverse ever are.
PARTS = 1 << 16


def hot_groups(groups: DataFrame, keys: list[str], size: str, hot_rows: int = 100_000) -> DataFrame:
    """``__h`` (hash of the keys) and ``__salts`` (tasks to spread over) of the groups that are large.

    Large is at least ``hot_rows`` rows and at least one in PARTS of all rows: no more than PARTS groups can be, so the
    list has at most PARTS rows of twelve bytes, however many and however long the keys are. The number of salts grows
    with the group, so that no salted part is larger than that bound. Keys of equal hash are salted alike, which
    changes no result.
    """
    floor = F.greatest(F.lit(hot_rows), F.ceil(groups.agg(F.sum(size)).scalar() / PARTS))
    large = groups.select(F.xxhash64(*keys).alias("__h"), F.col(size).alias("__n"), floor.alias("__floor")).where("__n >= __floor")
    return large.groupBy("__h").agg(F.max(F.ceil(F.col("__n") / F.col("__floor")) + 1).cast("int").alias("__salts"))


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], hot: DataFrame, spread: list[str]) -> DataFrame:
    """Inner join on ``keys``; rows of hot groups (see hot_groups) are spread by a hash of ``spread``.

    The group's row is repeated once for each salt. Null keys match nothing. No row is dropped. The list of hot groups
    is the only broadcast and is bounded. The keys must have the same types on both sides.
    """
    hot = F.broadcast(hot.select(F.col("__h").alias("__hot_h"), F.col("__salts")))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(hot, F.xxhash64(*[df[k] for k in keys]) == hot["__hot_h"], "left").drop("__hot_h")

    salt = F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("__salts").cast("bigint")).cast("int")).otherwise(F.lit(0))
    left = marked(rows).withColumn("__salt", salt).drop("__salts")
    right = marked(groups).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: list[str], hot_rows: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (few rows for each key, its row count in ``size``), salted where a group is large."""
    return salted_join(rows, groups.drop(size), keys, hot_groups(groups, keys, size, hot_rows), spread)
