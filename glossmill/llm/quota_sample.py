"""Sample that matches target category proportions: counts, largest-remainder quotas, smallest random keys."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.keys import unit_interval

#: Most categories a plan may have: they are broadcast, and quotas are allotted in one task.
MAX_CATEGORIES = 100_000
#: Cells of the histogram of random keys; only the cell in which a quota ends is ranked.
CELLS = 1 << 14

_OUTER = r"^[\p{Z}\s\x{1c}-\x{1f}\x{85}\x{feff}]+|[\p{Z}\s\x{1c}-\x{1f}\x{85}\x{feff}]+$"


def label(value: Column) -> Column:
    """A category label without regard to letter case and outer white space."""
    return F.lower(F.regexp_replace(value, _OUTER, ""))


def allot(share: list[float], floor: list[int], available: list[int], size: int) -> list[int]:
    """Integer quotas by largest remainder.

    A quota is at least the floor and at most what is available (which wins over the floor). The rest of the size is
    spread in proportion to the shares: a common factor is found by halving so that the bounded quotas add up to the
    size, the fractions are cut, and the units left go to the largest fractions (ties to the earlier category). If all
    bounds together do not allow the size, the nearest sum they allow is taken.
    """
    low = [min(max(0, f), a) for f, a in zip(floor, available)]
    high = [a if s > 0 else b for s, a, b in zip(share, available, low)]
    size = min(max(size, sum(low)), sum(high))
    at = lambda x: [min(max(x * s * size, lo), hi) for s, lo, hi in zip(share, low, high)]
    lo, hi = 0.0, 1.0
    while sum(at(hi)) < size and hi < 1e18:
        hi *= 2
    if abs(sum(at(1.0)) - size) < 1e-6:
        lo = hi = 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) < size else (lo, mid)
    exact = at(hi)
    quota = [min(h, max(b, math.floor(x + 1e-6))) for x, b, h in zip(exact, low, high)]
    rest = sorted(range(len(quota)), key=lambda i: (-(exact[i] - quota[i]), i))
    while sum(quota) < size and any(quota[i] < high[i] for i in rest):
        for i in rest:
            if sum(quota) == size:
                break
            if quota[i] < high[i]:
                quota[i] += 1
    for i in sorted(range(len(quota)), key=lambda i: (exact[i] - quota[i], -i)):
        if sum(quota) > size and quota[i] > low[i]:
            quota[i] -= 1
    return quota


def categorised(df: DataFrame, targets: DataFrame, key: str, number: str, labels: list[str], bounds: tuple[str, str] = ("zipf_lo", "zipf_hi"), cat: str = "cat_id") -> DataFrame:
    """Key and category of each row that belongs to one: ``__id``, ``__cat``.

    A row belongs to a category if each label is equal without regard to case and outer white space and the number
    lies in the band (lower bound included, upper not); a null label belongs nowhere, a null number is 0, NaN lies in
    no band. The categories are few (MAX_CATEGORIES at most, which is checked) and are broadcast.
    """
    found = targets.limit(MAX_CATEGORIES + 1).count()
    if found > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    small = targets.select(F.col(cat).alias("__cat"), F.col(bounds[0]).cast("double").alias("__lo"), F.col(bounds[1]).cast("double").alias("__hi"), *[label(F.col(c)).alias(f"__t{i}") for i, c in enumerate(labels)])
    rows = df.select(F.col(key).alias("__id"), F.coalesce(F.col(number).cast("double"), F.lit(0.0)).alias("__x"), *[label(F.col(c)).alias(f"__l{i}") for i, c in enumerate(labels)])
    on = [F.col(f"__l{i}") == F.col(f"__t{i}") for i in range(len(labels))] + [F.col("__x") >= F.col("__lo"), F.col("__x") < F.col("__hi")]
    return rows.join(F.broadcast(small), on).select("__id", "__cat")


def quota_report(df: DataFrame, targets: DataFrame, key: str, number: str, labels: list[str], cat: str = "cat_id") -> DataFrame:
    """One row for each category: ``cat_id``, ``available``, ``requested``, ``quota``, ``shortfall``.

    ``requested`` is the larger of ``sample_rows`` times ``target_share`` (rounded) and ``min_rows``; ``quota`` is what
    the sample draws, see allot(); ``shortfall`` is what the rows there are lack of the request, 0 if nothing. An empty
    table gives quotas of 0. Nulls in a target count as 0.
    """
    counts = categorised(df, targets, key, number, labels, cat=cat).groupBy("__cat").agg(F.count("*").alias("available"))
    plan = targets.select(F.col(cat).alias("__cat"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col("min_rows").cast("bigint"), F.lit(0)).alias("floor"), F.coalesce(F.col("sample_rows").cast("bigint"), F.lit(0)).alias("size"))
    known = plan.join(counts, "__cat", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    kind = dict(plan.dtypes)["__cat"]

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__cat", kind="stable").reset_index(drop=True)
        size = int(pdf["size"].max()) if len(pdf) else 0
        wanted = [max(int(math.floor(size * s + 0.5)), int(f)) for s, f in zip(pdf["share"], pdf["floor"])]
        got = allot(pdf["share"].tolist(), pdf["floor"].astype(int).tolist(), pdf["available"].astype(int).tolist(), size)
        short = [max(0, w - int(a)) for w, a in zip(wanted, pdf["available"])]
        return pd.DataFrame({"cat_id": pdf["__cat"], "available": pdf["available"], "requested": wanted, "quota": got, "shortfall": short})

    return known.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(quotas, f"cat_id {kind}, available bigint, requested bigint, quota bigint, shortfall bigint")


def quota_sample(df: DataFrame, targets: DataFrame, key: str, number: str, labels: list[str], cat: str = "cat_id", salt: str = "quota-1") -> DataFrame:
    """The sampled rows: ``cat_id`` and the key as ``row_id``; in each category the rows of smallest random key.

    The random key is a salted hash of the row's key (ties by key), so the same rows come out for any partitioning.
    The cut is found in a histogram of CELLS cells for each category, counted before the shuffle: rows below the cell
    in which the quota ends are in, rows of that cell are ranked. So no task ever ranks a whole category, however
    large. Only the histogram's cuts are broadcast, one row for each category.
    """
    rows = categorised(df, targets, key, number, labels, cat=cat).withColumn("__u", unit_interval("__id", salt)).withColumn("__cell", F.floor(F.col("__u") * CELLS).cast("int"))
    quota = quota_report(df, targets, key, number, labels, cat).select(F.col("cat_id").alias("__cat"), "quota")
    cells = rows.groupBy("__cat", "__cell").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__cat").orderBy("__cell"))
    ended = cells.withColumn("__upto", upto).join(F.broadcast(quota), "__cat").where((F.col("__upto") - F.col("__n") < F.col("quota")) & (F.col("__upto") >= F.col("quota")))
    cut = ended.select(F.col("__cat").alias("__c"), F.col("__cell").alias("__last"), (F.col("quota") - F.col("__upto") + F.col("__n")).alias("__left"))
    near = rows.join(F.broadcast(cut), F.col("__cat") == F.col("__c")).where(F.col("__cell") <= F.col("__last"))
    inside = near.where(F.col("__cell") < F.col("__last")).select("__cat", "__id")
    rank = F.row_number().over(Window.partitionBy("__cat").orderBy("__u", "__id"))
    edge = near.where(F.col("__cell") == F.col("__last")).withColumn("__r", rank).where(F.col("__r") <= F.col("__left")).select("__cat", "__id")
    return inside.unionByName(edge).select(F.col("__cat").alias("cat_id"), F.col("__id").alias("row_id"))
