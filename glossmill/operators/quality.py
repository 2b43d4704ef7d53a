"""Quality of packs: eligibility, validation, verification batches, audits, curation, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.keys import unit_interval
from glossmill.functions.text import trim_all
from glossmill.operators.dictionary import best_by, first_ranked

# Enumerations, bands and curated corrections.
CONTENT = ["noun", "adverb", "adjective", "verb", "expression"]
POS = [*CONTENT, "function"]
CONFIDENCE = ["high", "medium", "low"]
GENDERS = {"es": ["masculine", "feminine"], "fr": ["masculine", "feminine"], "it": ["masculine", "feminine"], "de": ["masculine", "feminine", "neuter"]}
SUBTYPES = ["determiner", "preposition", "conjunction", "pronoun"]
BANDS = {"common": (4.5, 9.0), "mid": (3.5, 4.5), "rare": (2.0, 3.5), "deep": (-1.0, 2.0)}
UNCOMMON = 4.0
FIXES = [("small", "pequeño", None, None), ("native american", "nativo americano", None, None), ("armed conflict", "conflicto armado", None, None), ("your mother", "tu madre", None, None), ("butt", "trasero", "masculine", "traseros"), ("cock", "gallo", "masculine", "gallos"), ("pullet", "pollita", "feminine", "pollitas"), ("old maid", "solterona", None, None), ("billy goat", "macho cabrío", None, None)]


def blank(c: Column) -> Column:
    return c.isNull() | (trim_all(c) == "")


def affix(c: Column) -> Column:
    t = trim_all(c)
    return blank(c) | t.startswith("-") | t.endswith("-")


def violations(pack: DataFrame, key: Column, spanish_only: bool = False) -> DataFrame:
    """One row for each rule an entry breaks: ``entry_id``, ``code``. All rules are told, not only the first.

    ``spanish_only`` is the weaker check of fragments: genders of Spanish nouns only, elements of source_ids unchecked.
    """
    c = F.col
    no = lambda x: ~F.coalesce(x, F.lit(False))
    noun, function = no(c("part_of_speech") != "noun") & c("part_of_speech").isNotNull(), no(c("part_of_speech") != "function") & c("part_of_speech").isNotNull()
    genders = None
    for lang, allowed in GENDERS.items():
        genders = F.when(c("target_lang") == lang, c("gender").isin(allowed)) if genders is None else genders.when(c("target_lang") == lang, c("gender").isin(allowed))
    genders = genders.otherwise(c("gender").isin(GENDERS["es"]))
    gendered = noun & (c("target_lang") == "es") if spanish_only else noun
    rules = {
        "source": blank(c("source")),
        "target": affix(c("target")),
        "gloss": blank(c("source_gloss")),
        "key": no(key == F.lower("source")),
        "pos": no(c("part_of_speech").isin(POS)),
        "confidence": no(c("confidence").isin(CONFIDENCE)),
        "rank": no(c("frequency_rank") > 0),
        "source_ids": no(F.size("source_ids") > 0),
        "source_id": F.lit(False) if spanish_only else F.coalesce(F.exists("source_ids", blank), F.lit(False)),
        "gender": gendered & no(genders),
        "plural": gendered & affix(c("plural")),
        "extra_gender": ~noun & (c("gender").isNotNull() | c("plural").isNotNull()),
        "subtype": function & no(c("function_subtype").isin(SUBTYPES)),
        "extra_subtype": ~function & c("function_subtype").isNotNull(),
    }
    codes = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    return pack.select("entry_id", F.explode(codes).alias("code"))


def duplicates(pack: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one entry holds, with the number and the first and last holder."""
    return pack.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n_holders"), F.min("entry_id").alias("first_holder"), F.max("entry_id").alias("last_holder")).where("n_holders > 1")


def annotate(pack: DataFrame, polysemous: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Eligibility from the part of speech and a list of ambiguous words, as they are or without any final s.

    ``skipped`` (source) stays ineligible whatever the rules say. Adds ``is_eligible`` and ``reason``.
    """
    words = polysemous.select(F.lower("word").alias("__w")).distinct()
    p = pack.withColumn("__s", F.lower("source")).withColumn("__r", F.regexp_replace(F.lower("source"), "s+$", ""))
    a, b = words.select(F.col("__w").alias("__s"), F.lit(True).alias("__p1")), words.select(F.col("__w").alias("__r"), F.lit(True).alias("__p2"))
    p = p.join(a, "__s", "left").join(b, "__r", "left")
    reason = F.when(~F.coalesce(F.col("part_of_speech").isin(CONTENT), F.lit(False)), "function").when(F.coalesce("__p1", "__p2").isNotNull(), "polysemous")
    if skipped is not None:
        p = p.join(skipped.select(F.lower("source").alias("__s"), F.lit(True).alias("__k")).distinct(), "__s", "left")
        reason = F.coalesce(reason, F.when(F.col("__k"), "skipped"))
    return p.withColumn("reason", F.coalesce(reason, F.lit("eligible"))).withColumn("is_eligible", F.col("reason") == "eligible").drop("__s", "__r", "__p1", "__p2", "__k")


def apply_fixes(pack: DataFrame, fixes: DataFrame) -> DataFrame:
    """Curated corrections by source (unique): target, gender and plural where given, confidence high. Adds ``fixed``."""
    f = fixes.select(F.lower("source").alias("__s"), F.col("target").alias("__t"), F.col("gender").alias("__g"), F.col("plural").alias("__p"))
    j = pack.withColumn("__s", F.lower("source")).join(f, "__s", "left")
    hit = F.col("__t").isNotNull()
    return j.withColumns({"fixed": hit, "target": F.coalesce("__t", "target"), "gender": F.coalesce("__g", "gender"), "plural": F.coalesce("__p", "plural"), "confidence": F.when(hit, "high").otherwise(F.col("confidence"))}).drop("__s", "__t", "__g", "__p")


def verify_batch(pack: DataFrame, ledger: DataFrame, group: str, chunks: int, size: int, low: float = 0.0, high: float = 9.0, confidence: str | None = None) -> DataFrame:
    """Eligible entries that are not in the ledger, of highest zipf first, as ``chunk_id`` and ``place``; chunks * size of each group."""
    z = F.coalesce("en_zipf", F.lit(0.0))
    pool = pack.where(F.col("eligible").eqNullSafe(True)).withColumn("zipf", z).where(F.col("zipf").between(low, high))
    if confidence:
        pool = pool.where(F.col("confidence") == confidence)
    pool = pool.join(ledger.select(group, "key").distinct(), [group, "key"], "left_anti")
    ranked = first_ranked(pool, [group], [F.desc("zipf"), F.col("key")], [-F.col("zipf"), F.substring("key", 1, 2)], chunks * size)
    return ranked.withColumnRenamed("rn", "place").withColumn("chunk_id", F.floor((F.col("place") - 1) / size).cast("int"))


def weighted_sample(pack: DataFrame, key: str, weight: Column, n: int, salt: str) -> DataFrame:
    """``n`` rows without replacement, by weight: largest ln(u) / w with u a salted hash of the key in (0, 1)."""
    u = unit_interval(key, salt) + 2.0**-53
    return pack.withColumn("__w", weight).where("__w > 0").withColumn("__k", F.log(u) / F.col("__w")).orderBy(F.desc("__k"), key).limit(n).drop("__w", "__k")


def uniform_sample(pack: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """``n`` rows of smallest salted hash."""
    return pack.withColumn("__u", unit_interval(key, salt)).orderBy("__u", key).limit(n).drop("__u")


def banded_sample(pack: DataFrame, key: str, zipf: Column, per_band: int, salt: str) -> DataFrame:
    """``per_band`` rows of each zipf band (lower bound in, upper out) by salted hash; the rank filter prunes before the shuffle."""
    band = None
    for name, (lo, hi) in BANDS.items():
        band = F.when((zipf >= lo) & (zipf < hi), name) if band is None else band.when((zipf >= lo) & (zipf < hi), name)
    p = pack.withColumn("band", band).where("band IS NOT NULL").withColumn("__u", unit_interval(key, salt))
    return p.withColumn("__r", F.row_number().over(Window.partitionBy("band").orderBy("__u", key))).where(F.col("__r") <= per_band).drop("__u", "__r")


def merge_fragments(base: DataFrame, fragments: DataFrame, keys: list[str], fragment: str, order: str) -> DataFrame:
    """What becomes of each fragment row: ``outcome`` added, existing (in the base) or duplicate (in an earlier row).

    Earlier means a lower fragment, then a lower ``order``. Base and fragment keys are compared exactly.
    """
    first = fragments.groupBy(*keys).agg(F.min(F.struct(fragment, order)).alias("__f"))
    known = base.select(*keys).distinct().withColumn("__b", F.lit(True))
    j = fragments.join(first, keys).join(known, keys, "left")
    return j.withColumn("outcome", F.when(F.col("__b"), "existing").when((F.col(fragment) == F.col(f"__f.{fragment}")) & (F.col(order) == F.col(f"__f.{order}")), "added").otherwise("duplicate")).drop("__f", "__b")


def decide(decisions: DataFrame, pack: DataFrame) -> DataFrame:
    """Review decisions against the pack: ``source``, ``outcome`` curated, skipped or incomplete, and what to write.

    The first decision of a source counts (``decision_no``). A kept entry may take its target from the pack, a fixed one
    must bring its own; nouns need gender and plural, from either side. Sources that the pack lacks are left out.
    """
    t = lambda x: trim_all(F.coalesce(x, F.lit("")))
    first = best_by(decisions.where("source IS NOT NULL AND source <> ''").select("source", "decision_no", "action", F.col("target").alias("dt"), F.col("part_of_speech").alias("dp"), F.col("gender").alias("dg"), F.col("plural").alias("dl")), ["source"], [F.col("decision_no")])
    j = first.join(pack.select(F.col("key").alias("source"), "target", "part_of_speech", "gender", "plural"), "source")
    either = lambda a, b: F.when(t(F.col(a)) != "", t(F.col(a))).otherwise(t(F.col(b)))
    target = F.when((F.col("action") == "keep"), either("dt", "target")).otherwise(t(F.col("dt")))
    j = j.select("source", "action", target.alias("target"), either("dp", "part_of_speech").alias("part_of_speech"), either("dg", "gender").alias("gender"), either("dl", "plural").alias("plural"))
    bad_noun = (F.col("part_of_speech") == "noun") & (~F.col("gender").isin("masculine", "feminine") | (F.col("plural") == ""))
    outcome = F.when(F.col("action") == "skip", "skipped").when((F.col("target") == "") | bad_noun, "incomplete").otherwise("curated")
    return j.withColumn("outcome", outcome)


def curate(pack: DataFrame, curated: DataFrame) -> DataFrame:
    """Pack with curated items promoted to high and eligible; non-nouns lose gender, plural and subtype. Adds ``promoted``."""
    c = curated.select(F.col("source").alias("key"), F.col("target").alias("__t"), F.col("part_of_speech").alias("__p"), F.col("gender").alias("__g"), F.col("plural").alias("__l"))
    j = pack.join(c, "key", "left")
    hit = F.col("__t").isNotNull() & F.col("__p").isin(CONTENT)
    noun = F.col("__p") == "noun"
    new = {"promoted": F.coalesce(hit, F.lit(False)), "target": F.when(hit, F.col("__t")).otherwise(F.col("target")), "gender": F.when(hit, F.when(noun, F.col("__g"))).otherwise(F.col("gender")), "plural": F.when(hit, F.when(noun, F.col("__l"))).otherwise(F.col("plural")), "confidence": F.when(hit, "high").otherwise(F.col("confidence")), "eligible": F.when(hit, True).otherwise(F.col("eligible")), "part_of_speech": F.when(hit, F.col("__p")).otherwise(F.col("part_of_speech"))}
    return j.withColumns(new).drop("__t", "__p", "__g", "__l")


def duplicate_raw_keys(documents: DataFrame, text: str) -> DataFrame:
    """Entry keys that a raw pack document holds more than once, with the line of each; a JSON parser would hide them."""
    lines = documents.select(F.posexplode(F.split(text, "\n")).alias("no", "line"))
    keys = lines.select((F.col("no") + 1).alias("line_no"), F.regexp_extract("line", r'^\s*"([^"]+)"\s*:\s*\{', 1).alias("key")).where("key NOT IN ('', 'entries')")
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line_no")).alias("lines")).where("n > 1").drop("n")
