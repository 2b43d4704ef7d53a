"""Top N items within every group by a ranking window, which the optimiser prunes before and after the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int, keep: list[str] | None = None) -> DataFrame:
    """The ``n`` rows of highest score of each group, numbered from 1 in ``rank_no``; all rows if a group has fewer.

    Equal scores (0.0 and -0.0 are equal) go by ``ties`` ascending, texts in code-point order. Rows with a null group,
    a null in the first tie column or a null or NaN score take no part; repeated rows count as rows. ``keep`` names
    the columns to return (all by default); a column called ``rank_no`` is replaced.

    ``row_number() <= n`` makes Catalyst place a WindowGroupLimit on both sides of the shuffle: a task sends at most
    ``n`` rows of a group, so a group of any size costs each reducer no more than n times the number of map tasks.
    """
    kept = [c for c in (keep or df.columns) if c != "rank_no"]
    ready = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    for c in [*groups, *ties[:1]]:
        ready = ready.where(F.col(c).isNotNull())
    need = list(dict.fromkeys([*groups, *ties, *kept]))
    ready = ready.select(*need, *([score] if score not in need else []), F.when(F.col(score) == 0, F.lit(0.0)).otherwise(F.col(score).cast("double")).alias("__score"))
    order = Window.partitionBy(*groups).orderBy(F.desc("__score"), *[F.asc(c) for c in ties])
    return ready.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= n).select(*kept, "rank_no")
