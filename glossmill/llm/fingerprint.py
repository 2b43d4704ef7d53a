"""Duplicates hidden by formatting: commutative multiset fingerprints of normalised field-name and value pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators.lineage import written
from glossmill.operators.skew import join_groups

#: White space and punctuation of any kind; neither counts.
_SILENT = r"[\p{P}\p{Z}\s\x{1c}-\x{1f}\x{85}]+"


def normalised(value: Column) -> Column:
    """The value without white space and punctuation, letter case folded: a sharp s equals ss, as its capital does."""
    folded = F.replace(F.translate(F.lower(value), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, _SILENT, "")


def _fingerprint(pairs: list[tuple[str, Column]], seed: str) -> Column:
    """Sum of the pairs' hashes: the order of the pairs plays no part. The shift leaves room for the sum."""
    room = max(1, (len(pairs) - 1).bit_length())
    return reduce(lambda a, b: a + b, [F.shiftright(F.xxhash64(F.lit(seed), F.lit(name), value), room) for name, value in pairs])


def _records(df: DataFrame, key: str, exact: list[str], folded: list[str]) -> DataFrame:
    """key, exact fields, folded fields (normalised) under internal names, and a fingerprint of 128 bits."""
    named = df.select(df[key].alias("__id"), *[df[c].cast("string").alias(f"__e{i}") for i, c in enumerate(exact)], *[normalised(df[c]).alias(f"__f{i}") for i, c in enumerate(folded)])
    fields = [f"__e{i}" for i in range(len(exact))] + [f"__f{i}" for i in range(len(folded))]
    named = named.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fields]))
    pairs = [(c, F.col(c)) for c in fields if c.startswith("__e")] + [("text", F.col(c)) for c in fields if c.startswith("__f")]
    return named.withColumns({"__p": _fingerprint(pairs, "a"), "__q": _fingerprint(pairs, "b")})


def _same(a: Column, b: Column, exact: int, folded: int) -> Column:
    """Whether two records hold the same fields: the folded ones as multisets, compared by counting, without sorting."""
    ok = reduce(lambda x, y: x & y, [a[f"__e{i}"] == b[f"__e{i}"] for i in range(exact)], F.lit(True))
    if folded == 2:
        f, g = (a["__f0"], a["__f1"]), (b["__f0"], b["__f1"])
        return ok & (((f[0] == g[0]) & (f[1] == g[1])) | ((f[0] == g[1]) & (f[1] == g[0])))
    f, g = F.array(*[a[f"__f{i}"] for i in range(folded)]), F.array(*[b[f"__f{i}"] for i in range(folded)])
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return ok & F.forall(f, lambda v: times(f, v) == times(g, v))


def _names(exact: int, folded: int) -> list[str]:
    return [f"__e{i}" for i in range(exact)] + [f"__f{i}" for i in range(folded)]


def _groups(records: DataFrame, exact: int, folded: int) -> DataFrame:
    """Rows by fingerprint: first id, number of rows, and ``__same``, whether all of them hold the same fields.

    One grouping on the fingerprint. Rows of equal form collapse before the shuffle, so that a record with a third of all
    rows sends one row from each task. The distinct forms of a fingerprint are the orders of its fields, a handful; each
    is compared with the first, field by field and without sorting.
    """
    forms = F.collect_set(F.struct(*_names(exact, folded)))
    got = records.groupBy("__p", "__q").agg(F.min("__id").alias("first_id"), F.count("*").alias("copies"), forms.alias("__all"))
    same = F.forall("__all", lambda x: _same(F.get("__all", F.lit(0)), x, exact, folded))
    return got.select("__p", "__q", "first_id", "copies", same.alias("__same"))


def _parted(records: DataFrame, collided: DataFrame, exact: int, folded: int) -> DataFrame:
    """The forms of fingerprints that different records share, each with the first id and number of rows of its record."""
    fields = _names(exact, folded)
    forms = records.join(collided.select("__p", "__q"), ["__p", "__q"]).groupBy("__p", "__q", *fields).agg(F.min("__id").alias("__own"), F.count("*").alias("__n"))
    met = forms.join(forms.select("__p", "__q", F.struct(*fields).alias("__y"), F.col("__own").alias("__o"), F.col("__n").alias("__m")), ["__p", "__q"])
    met = met.where(_same(F.struct(*fields), F.col("__y"), exact, folded))
    return met.groupBy("__p", "__q", *fields, "__own").agg(F.min("__o").alias("first_id"), F.sum("__m").alias("copies"), F.min(F.struct("__o", "__y")).alias("__x"))


def collapse_formatting(df: DataFrame, key: str, exact: list[str], folded: list[str]) -> DataFrame:
    """One row for each record: ``first_id`` (smallest key) and ``copies`` (rows it had, itself included).

    Two rows are one record if the ``exact`` fields are equal and the ``folded`` ones hold the same texts, in any
    order, but for white space, letter case and punctuation. Rows with a null in any of these fields take no part; a
    text that is empty or all punctuation is the empty text. Repeated keys count as rows, and records that begin with
    the same key are rows of their own. Other columns may have any name and do not reach the result. One shuffle of
    distinct forms; nothing is broadcast. Fingerprints that different records share, should there ever be any, are
    found when their fields are compared and are parted field by field.
    """
    records = _records(df, key, exact, folded)
    groups = written(_groups(records, len(exact), len(folded)))
    whole = groups.where("__same").select("first_id", "copies")
    collided = groups.where("NOT __same")
    if collided.isEmpty():
        return whole
    parted = _parted(records, collided, len(exact), len(folded))
    first = F.col("__x")["__y"] == F.struct(*_names(len(exact), len(folded)))  # one form stands for each record
    return whole.unionByName(parted.where(first).select("first_id", "copies"))


def formatting_copies(df: DataFrame, key: str, exact: list[str], folded: list[str], hot_rows: int = 100_000) -> DataFrame:
    """One row for each row other than the first of its record: ``first_id``, ``copy_id``. Terms as collapse_formatting.

    The fields are verified where they are grouped, so the rows meet their record by fingerprint and id alone, 24 bytes
    each. Records of at least ``hot_rows`` rows are salted over many tasks. Rows that repeat the first key are no copies.
    """
    records = _records(df, key, exact, folded)
    groups = written(_groups(records, len(exact), len(folded)).where("copies > 1"))
    met = join_groups(records.select("__p", "__q", "__id"), groups.where("__same").drop("__same"), ["__p", "__q"], "copies", ["__id"], hot_rows)
    copies = met.where(F.col("__id") != F.col("first_id")).select("first_id", F.col("__id").alias("copy_id"))
    collided = groups.where("NOT __same")
    if collided.isEmpty():
        return copies
    parted = _parted(records, collided, len(exact), len(folded)).where("copies > 1").drop("__own", "__x")
    met = join_groups(records, parted, ["__p", "__q", *_names(len(exact), len(folded))], "copies", ["__id"], hot_rows)
    return copies.unionByName(met.where(F.col("__id") != F.col("first_id")).select("first_id", F.col("__id").alias("copy_id")))
