"""Reproducible sample that is stable as data grows: a salted hash of the record key against a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions.keys import unit_interval


def stable_sample(df: DataFrame, key: str, rate: float, salt: str = "sample-1", keep: list[str] | None = None) -> DataFrame:
    """Rows whose key hashes below ``rate``, with the key's place in [0, 1) as ``unit_key``.

    A pure filter: whether a row is in depends on its key, the salt and the rate only, so reruns, other partitionings
    and later batches change nothing for rows that are there, and a sample of a lower rate lies within one of a higher
    rate. All rows of one key are in or out together, ties and repeated rows too. A null key is never in; an empty key
    is a key like others. ``keep`` names the columns to return (all by default); a column called ``unit_key`` is
    replaced. No shuffle, one scan, any key skew.
    """
    if not 0.0 <= rate <= 1.0:
        raise ValueError("rate must lie between 0 and 1")
    u = unit_interval(df[key], salt)
    kept = [df[c] for c in (keep or df.columns) if c != "unit_key"]
    return df.where(u < F.lit(rate)).select(*kept, u.alias("unit_key"))
