"""Reproducible keys: values that depend on content and salt only, never on order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 13 hexadecimal digits are 52 bits, which a double holds without loss.
_DIGITS, _RANGE = 13, float(1 << 52)


def unit_interval(key: Column | str, salt: str) -> Column:
    """The key hashed with a fixed salt onto [0, 1); null for a null key. Evaluated inside the JVM."""
    text = F.concat(F.lit(f"{salt}|"), (F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("bigint") / F.lit(_RANGE)


def unit_interval_sql(key: str, salt: str) -> str:
    """The same key as DuckDB SQL, for oracles."""
    return f"(CAST('0x' || substr(md5('{salt}|' || CAST({key} AS VARCHAR)), 1, {_DIGITS}) AS BIGINT) / {_RANGE})"
