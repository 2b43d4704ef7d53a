"""One place to start from: builders of packs, the lexicon at reading time, and the quality loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.operators import dictionary, page, quality
from glossmill.operators.lineage import written

annotate_quality, validate_pack, merge_fragments = quality.annotate, quality.violations, quality.merge_fragments
verify_batch, apply_decisions, apply_curation, audit_sample = quality.verify_batch, quality.decide, quality.curate, quality.weighted_sample


def build_dictionary_pack(raw: DataFrame, curated: DataFrame, target_count: int = 50_000, **enrichment) -> DataFrame:
    """Curated rows and the best new dictionary rows up to the target count, ranked on; fails if there are too few.

    ``curated``: target_lang, source, frequency_rank and further columns; ``raw`` and ``enrichment``: see normalise().
    """
    have, language = curated.agg(F.count("*"), F.first("target_lang")).first()
    best = dictionary.best_by(dictionary.normalise(raw, **enrichment), ["source"], [F.col("rank_priority"), F.col("source_order")])
    new = best.withColumn("target_lang", F.lit(language))
    order = [F.col("rank_priority"), F.col("source_order"), F.col("source")]
    added = written(dictionary.append_ranks(curated, new, ["target_lang", "source"], "target_lang", order, max(0, target_count - have)))
    if have + added.count() < target_count:
        raise ValueError(f"fewer than {target_count} entries")
    return curated.unionByName(added.drop("rank_priority", "source_order"), allowMissingColumns=True)


def build_inverted_pack(senses: DataFrame, frequency: DataFrame, english: DataFrame) -> DataFrame:
    """Best target of each English key that the English frequency table (word, zipf) has, ranked by zipf, score, key."""
    best = dictionary.best_by(dictionary.invert(senses, frequency), ["target_lang", "source"], [-F.col("score"), F.col("cand_id")])
    known = best.join(english.where("zipf > 0").select(F.col("word").alias("source"), F.col("zipf").alias("en_zipf")), "source")
    rank = F.row_number().over(Window.partitionBy("target_lang").orderBy(F.desc("en_zipf"), F.desc("score"), "source"))
    return known.withColumn("frequency_rank", rank).withColumn("source_gloss", dictionary.text.short_gloss(F.col("gloss"), F.col("source"), drop_bracketed=False))


def build_tail_shard(candidates: DataFrame, core: DataFrame, english: DataFrame, target_count: int = 100_000) -> DataFrame:
    """Rare keys the core lacks, by zipf, as many as the target count leaves room for, ranked from RANK_OFFSET.

    ``candidates``: target_lang, source, part_of_speech, target, gloss, score, cand_id and, if there are any, tags (those of
    SKIP_TAGS are left out); ``core``: target_lang, key.
    """
    if "tags" in candidates.columns:
        candidates = candidates.where(~F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in dictionary.SKIP_TAGS])), F.lit(False)))
    c = candidates.withColumn("pos", dictionary.source_class(F.col("source"), F.col("part_of_speech"))).where(F.col("pos").isNotNull() & dictionary.tail_target(F.col("target")))
    c = c.join(core.select("target_lang", F.col("key").alias("source")), ["target_lang", "source"], "left_anti")
    c = c.join(english.select(F.col("word").alias("source"), F.col("zipf").alias("en_zipf")), "source", "left").withColumn("en_zipf", F.coalesce("en_zipf", F.lit(0.0))).where(F.col("en_zipf") < dictionary.NICHE_ZIPF)
    best = dictionary.best_by(c, ["target_lang", "source"], [-F.col("score"), F.col("cand_id")])
    room = core.groupBy("target_lang").agg((F.lit(target_count) - F.count("*")).alias("room"))
    best = best.join(room, "target_lang", "left").withColumn("room", F.coalesce("room", F.lit(target_count)))
    ranked = dictionary.first_ranked(best, ["target_lang"], [F.desc("en_zipf"), F.col("source")], [-F.col("en_zipf"), F.substring("source", 1, 2)], F.col("room"))
    return ranked.select("target_lang", "source", F.col("pos").alias("part_of_speech"), "target", dictionary.text.short_gloss(F.col("gloss"), F.col("source"), drop_bracketed=True).alias("source_gloss"), "en_zipf", (F.col("rn") + dictionary.RANK_OFFSET - 1).alias("frequency_rank"), F.lit("low").alias("confidence"))


class Lexicon:
    """Lookup over both shards of one language; the tail is not read unless it is asked for."""

    def __init__(self, core: DataFrame, tail: DataFrame | None = None, language: str = "es"):
        self.core = dictionary.lexicon(core.where(F.col("target_lang") == language))
        self.tail = None if tail is None else dictionary.lexicon(tail.where(F.col("target_lang") == language))

    def entries(self) -> DataFrame:
        """Usable entries of the shards, the core's for keys in both."""
        core = self.core.where(page.usable(self.core)).withColumn("shard", F.lit("core"))
        if self.tail is None:
            return core
        rest = self.tail.join(self.core.select("key"), "key", "left_anti")
        return core.unionByName(rest.where(page.usable(rest, tail=True)).withColumn("shard", F.lit("tail")))

    def lookup(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.entries(), "key", "left")

    def expressions(self) -> DataFrame:
        return self.entries().where("part_of_speech = 'expression'")

    def top(self, n: int) -> DataFrame:
        """The n most frequent entries that are no expressions."""
        return self.core.where("part_of_speech <> 'expression'").orderBy("frequency_rank", "entry_id").limit(n)

    def sample(self, n: int, salt: str, exclude: DataFrame | None = None) -> DataFrame:
        pool = self.core.where("part_of_speech <> 'expression'")
        return quality.uniform_sample(pool if exclude is None else pool.join(exclude, "key", "left_anti"), "entry_id", n, salt)
