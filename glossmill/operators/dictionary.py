"""Dictionary builds: normalise, enrich, deduplicate, rank, invert glosses, tail shard, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import grammar, text

# Part-of-speech tables, priorities, stop words.
POS = {"n": "noun", "pn": "noun", "adj": "adjective", "v": "verb", "adv": "adverb", "phraseologicalUnit": "expression", "proverb": "expression"} | dict.fromkeys(["preposition", "conjunction", "determiner", "pronoun", "article", "interjection", "particle", "postposition", "numeral"], "function")
SUBTYPE = {"preposition": "preposition", "postposition": "preposition", "conjunction": "conjunction", "determiner": "determiner", "article": "determiner", "numeral": "determiner"}
PRIORITY = {"adverb": 0, "noun": 1, "adjective": 2, "expression": 3, "verb": 4, "function": 5}
FUNCTION_WORDS = "the a an and or but nor so yet of to in on at by for with from into onto upon as than then that this these those it its he him his she her hers they them their we us our you your yours i me my mine who whom whose which what when where why how do does did done be is am are was were been being have has had having will would shall should can could may might must not no if because while although though whether etc oneself itself himself herself themselves myself yourself".split()
PHRASE_STOP = "a an the of to and or but with without from into for by at on in as that which who whom whose this these those is are be being been it its their his her your our not no any some such etc eg ie esp especially something someone one type kind form way act person used again also either neither other another sometimes often usually mainly mostly rather very too then thus hence therefore still just only even more most".split()
TAIL_STOP = "a an the of to and or but with from into for by at on in as that which is are be not no any some such etc one someone something".split()
RESTRICTED = ["obsolete", "archaic", "rare", "dated", "historical", "dialectal", "dialect", "regional", "slang", "informal", "colloquial", "vulgar", "derogatory", "offensive", "poetic", "literary", "humorous", "nonstandard"]
SKIP_TAGS = ["obsolete", "archaic", "dated", "historical", "dialectal", "dialect", "regional", "rare", "nonstandard", "proscribed", "misspelling", "eye-dialect", "plural", "Alemannic-German", "Bavarian", "Austrian", "Swiss", "Switzerland", "Liechtenstein", "Low-German", "Rhine-Franconian", "Central-Franconian", "Old-High-German"]
RANK_OFFSET, NICHE_ZIPF = 1_000_000, 5.0


def lookup_map(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def normalise(raw: DataFrame, glosses: DataFrame | None = None, genders: DataFrame | None = None, plurals: DataFrame | None = None, pairs: DataFrame | None = None, provenance: list[str] | None = None, own: str = "freedict") -> DataFrame:
    """Raw dictionary rows to candidates; rows that fail a gate are dropped.

    ``raw``: source, raw_pos, translations array, definitions array, source_order. Enrichment, all optional:
    ``glosses`` (source, gloss), ``genders`` (bare, gender), ``plurals`` (bare, plural) and corroborated ``pairs``
    (source, target), each unique in its keys. A corroborated pair, with or without its article, makes the confidence
    high and appends all ``provenance``. Lookups are plain equi-joins: Catalyst broadcasts what its size statistics
    show to be small and shuffles else.
    """
    r = raw.withColumn("__pos", lookup_map(POS, F.col("raw_pos"))).withColumn("__source", text.clean_source(F.col("source"))).where("__pos IS NOT NULL AND __source IS NOT NULL")
    r = r.withColumn("__target", text.clean_target(F.get("translations", F.lit(0)))).where("__target IS NOT NULL")
    multi = F.col("__source").contains(" ")
    r = r.withColumn("__pos", F.when(multi & (F.col("__pos") != "function"), "expression").otherwise(F.col("__pos")))
    bare = grammar.strip_spanish_article(F.col("__target"))
    r = r.withColumn("__bare", F.lower(bare))
    gloss = F.get(F.filter(F.transform("definitions", text.clean_gloss), lambda x: x.isNotNull()), F.lit(0))
    if glosses is not None:
        r = r.join(glosses.select(F.col("source").alias("__source"), F.col("gloss").alias("__g")), "__source", "left")
        gloss = F.coalesce(text.clean_gloss(F.col("__g")), gloss)
    known_gender = known_plural = None
    if genders is not None:
        r, known_gender = r.join(genders.select(F.col("bare").alias("__bare"), F.col("gender").alias("__kg")), "__bare", "left"), F.col("__kg")
    if plurals is not None:
        r, known_plural = r.join(plurals.select(F.col("bare").alias("__bare"), F.col("plural").alias("__kp")), "__bare", "left"), F.col("__kp")
    sure = F.lit(False)
    if pairs is not None:
        for mark, key in (("__c1", F.col("__bare")), ("__c2", F.lower("__target"))):
            p = pairs.select(F.col("source").alias("__ps"), F.col("target").alias("__pt"), F.lit(True).alias(mark)).distinct()
            r = r.withColumn("__k", key).join(p, (F.col("__source") == F.col("__ps")) & (F.col("__k") == F.col("__pt")), "left").drop("__ps", "__pt", "__k")
        sure = F.coalesce(F.col("__c1"), F.col("__c2"), F.lit(False))
    noun, pos = F.col("__pos") == "noun", F.col("__pos")
    words = F.size(F.split("__source", " "))
    ids = F.when(sure, F.array(*[F.lit(x) for x in [own, *sorted(provenance or [])]])).otherwise(F.array(F.lit(own)))
    out = r.select(
        F.col("__source").alias("source"),
        F.when(noun, bare).otherwise(F.col("__target")).alias("target"),
        pos.alias("part_of_speech"),
        gloss.alias("source_gloss"),
        F.when(sure, "high").otherwise("medium").alias("confidence"),
        ids.alias("source_ids"),
        "source_order",
        (F.when(sure, 0).otherwise(100) + F.when(F.col("raw_pos") == "pn", 40).otherwise(0) + lookup_map(PRIORITY, pos) + F.least(F.lit(3), words - 1)).alias("rank_priority"),
        F.when(noun, grammar.infer_gender(F.col("__target"), known_gender)).alias("gender"),
        F.when(noun, grammar.spanish_plural(F.col("__target"), known_plural)).alias("plural"),
        F.when(pos == "function", F.coalesce(lookup_map(SUBTYPE, F.col("raw_pos")), F.lit("pronoun"))).alias("function_subtype"),
    )
    return out.where("source_gloss IS NOT NULL AND (part_of_speech <> 'noun' OR (gender IS NOT NULL AND plural IS NOT NULL))")


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order: a hash aggregate with map-side combine, so hot keys stay cheap.

    ``order`` are columns ascending; make them unique for a deterministic result.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__b"))
    return best.select(*keys, *[F.col("__b")[c].alias(c) for c in rest]).select(*df.columns)


def first_ranked(df: DataFrame, group: list[str], order: list[Column], cells: list[Column], limit: Column | int) -> DataFrame:
    """The first ``limit`` rows of each group in the order, with their place in ``rn``, without sorting a group in one task.

    ``cells`` are the order's first columns as ascending ones, of which the last may be coarse (a prefix, a number cut
    short): rows of a lower cell come first. They should have few values, as frequencies of two digits have. The rows
    of each cell are counted before the shuffle; the counts' running sum tells with which rank a cell begins, cells
    that begin beyond the limit are left out, and only rows of one cell are ranked with each other. ``order`` must be
    unique for a fixed result. ``limit`` is a number or a column that is constant in a group.
    """
    names = [f"__c{i}" for i in range(len(cells))]
    rows = df.withColumns({n: c for n, c in zip(names, cells)} | {"__limit": limit if isinstance(limit, Column) else F.lit(limit)})
    counts = rows.groupBy(*group, *names).agg(F.count("*").alias("__n"), F.max("__limit").alias("__most"))
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy(*names))
    begun = counts.withColumn("__from", upto - F.col("__n")).where(F.col("__from") < F.col("__most")).select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate([*group, *names])], "__from")
    on = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate([*group, *names])]
    met = rows.join(begun, on)
    place = F.row_number().over(Window.partitionBy(*group, *names).orderBy(*order)) + F.col("__from")
    out = met.withColumn("rn", place.cast("int")).where(F.col("rn") <= F.col("__limit"))
    return out.drop(*names, "__limit", "__from", *[f"__g{i}" for i in range(len(group) + len(names))])


def append_ranks(existing: DataFrame, new: DataFrame, key: list[str], group: str, order: list[Column], limit: int, cells: list[Column] | None = None) -> DataFrame:
    """New rows whose key is not there yet, first ``limit`` in order of each group, ranked on after the group's highest rank.

    ``cells``: see first_ranked(); the order's first column by default.
    """
    top = existing.groupBy(group).agg(F.max("frequency_rank").alias("__top"))
    fresh = new.join(existing.select(*key).distinct(), key, "left_anti")
    ranked = first_ranked(fresh, [group], order, cells or order[:1], limit)
    return ranked.join(top, group, "left").withColumn("frequency_rank", F.coalesce("__top", F.lit(0)) + F.col("rn")).drop("rn", "__top")


def first_of(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the first table, and those of the second whose key the first has not."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def lookup_either(wanted: DataFrame, pack: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """The pack's value for each wanted key as it is written, else for the key in lower case, else null. Both unique in (group, key)."""
    p = pack.select(F.col(group).alias("__g"), F.col(key).alias("__k"), F.col(value).alias("__v"))
    side = lambda n: p.select(*[F.col(c).alias(f"{c}{n}") for c in p.columns])
    j = wanted.join(side(1), (wanted[group] == F.col("__g1")) & (wanted[key] == F.col("__k1")), "left").join(side(2), (wanted[group] == F.col("__g2")) & (F.lower(wanted[key]) == F.col("__k2")), "left")
    return j.withColumn(value, F.when(F.col("__k1").isNotNull(), F.col("__v1")).otherwise(F.col("__v2"))).drop(*[f"{c}{n}" for c in p.columns for n in (1, 2)])


def plain_gender(lang: Column, gender: Column) -> Column:
    """The gender, but neuter only in German: elsewhere it is contamination and no gender."""
    return F.when((gender != "neuter") | (lang == "de"), gender)


def tail_score(frequency: Column, target: Column) -> Column:
    """Frequency (zipf) of the target's first word, less one half for each further word."""
    return F.coalesce(frequency, F.lit(0.0)) - 0.5 * (F.size(text.words_of(target)) - 1)


def gloss_pieces(gloss: Column) -> Column:
    """Array of (piece, n_words): single words and short phrases a gloss offers as keys."""
    base = F.lower(F.trim(F.regexp_replace(F.regexp_replace(gloss, r"\([^)]*\)", ""), r"\[[^\]]*\]", "")))
    parts = F.split(base, r"\s*[;,/]\s*|\s+or\s+")
    bare = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(p), r"^(a|an|the)\s+", ""), r"^to\s+", ""), r"^[ .,;:\"']+|[ .,;:\"']+$", ""))
    sized = F.transform(bare, lambda p: F.struct(F.regexp_replace(p, r"\s+", " ").alias("piece"), F.size(F.split(p, r"\s+")).alias("n_words")))
    blocked = F.array(*[F.lit(w) for w in sorted(set(PHRASE_STOP) | set(FUNCTION_WORDS))])

    def good(x: Column) -> Column:
        p, n, words = x["piece"], x["n_words"], F.split(x["piece"], " ")
        one = (n == 1) & (F.length(p) > 1) & p.rlike(r"^[a-z][a-z'-]*$") & ~p.isin(FUNCTION_WORDS)
        more = n.between(2, 3) & p.rlike(r"^[a-z][a-z' -]*$") & ~F.arrays_overlap(words, blocked) & F.forall(words, lambda w: F.length(w) > 1)
        return (p != "") & (one | more)

    return F.filter(sized, good)


def valid_target(t: Column) -> Column:
    return (t != "") & ~t.rlike(r"\p{Nd}") & ~t.startswith("-") & ~t.endswith("-")


def tail_target(t: Column) -> Column:
    """Whether a target may enter the tail shard."""
    low = F.lower(t)
    return F.length(t).between(2, 40) & ~t.rlike(r"\p{Nd}") & ~t.startswith("-") & ~t.endswith("-") & (F.size(text.words_of(t)) <= 3) & ~t.rlike(r"[.():;/]") & ~low.contains("for example") & ~low.contains("such as") & ~low.contains("e. g") & t.rlike(r"\p{L}")


def source_class(source: Column, pos: Column) -> Column:
    """Part of speech a tail source may have, by its form; null if none. Whether words are real is a join of its own."""
    n = F.size(F.split(source, " "))
    stop = F.array(*[F.lit(w) for w in TAIL_STOP])
    one = (n == 1) & (F.length(source) >= 2) & source.rlike(r"^[a-z][a-z'-]*$") & pos.isin("noun", "verb", "adjective", "adverb")
    return F.when(one, pos).when(n.between(2, 3) & source.rlike(r"^[a-z][a-z' -]*$") & ~F.arrays_overlap(F.split(source, " "), stop), "expression")


def invert(candidates: DataFrame, frequency: DataFrame) -> DataFrame:
    """Keys from glosses with scores: target_lang, source, part_of_speech, target, gender, plural, gloss, score, cand_id.

    ``candidates``: target_lang, part_of_speech, target, gender, plural, gloss, sense_index, restricted, cand_id;
    ``frequency``: target_lang, word, zipf. The score is the lowest positive zipf of the target's words, less 0.4 for each
    earlier sense, 2.0 for restricted use, 0.25 for each further word of the key and 0.8 of the target.
    """
    c = candidates.where(valid_target(F.col("target")) & F.col("part_of_speech").isin("noun", "verb", "adjective", "adverb"))
    c = c.withColumn("__tw", text.words_of(F.col("target"))).where(F.size("__tw") <= 3).where("part_of_speech <> 'noun' OR (gender IS NOT NULL AND plural IS NOT NULL)")
    words = c.select("target_lang", "target", F.explode("__tw").alias("word")).distinct()
    base = words.join(frequency, ["target_lang", "word"], "left").where("zipf > 0").groupBy("target_lang", "target").agg(F.min("zipf").alias("__base"))
    c = c.join(base, ["target_lang", "target"], "left").withColumn("__p", F.explode(gloss_pieces(F.col("gloss"))))
    score = F.coalesce("__base", F.lit(0.0)) - 0.4 * F.col("sense_index") - F.when(F.col("restricted"), 2.0).otherwise(0.0) - 0.25 * (F.col("__p.n_words") - 1) - 0.8 * (F.size("__tw") - 1)
    return c.select("target_lang", F.col("__p.piece").alias("source"), F.when(F.col("__p.n_words") == 1, F.col("part_of_speech")).otherwise("expression").alias("part_of_speech"), "target", "gender", "plural", "gloss", score.alias("score"), "cand_id")


def word_frequency(docs: DataFrame, group: list[str], text_col: str, pattern: str = r"[a-z]+") -> DataFrame:
    """``group``, word, n, zipf: log10 of occurrences per billion words of the group, rounded to 2 places."""
    words = docs.select(*group, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(pattern), 0)).alias("word")).groupBy(*group, "word").agg(F.count("*").alias("n"))
    totals = words.groupBy(*group).agg(F.sum("n").alias("__t"))
    both = words.join(totals, group) if group else words.withColumn("__t", totals.scalar())
    return both.select(*group, "word", "n", F.round(F.log10(F.col("n") * 1e9 / F.col("__t")), 2).alias("zipf"))


def lexicon(pack: DataFrame) -> DataFrame:
    """Pack rows as a keyed lexicon: the row of lowest rank (ties by id) of each language and lower-cased source."""
    keyed = pack.where("target_lang IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL").withColumn("key", F.lower("source"))
    return best_by(keyed, ["target_lang", "key"], [F.col("frequency_rank"), F.col("entry_id")])


def shard_lookup(wanted: DataFrame, core: DataFrame, tail: DataFrame) -> DataFrame:
    """target_lang, key, shard, target, entry_id for each wanted (target_lang, key): core first, else tail, else null."""
    c = core.select("target_lang", "key", F.lit("core").alias("__s1"), F.col("target").alias("__t1"), F.col("entry_id").alias("__e1"))
    t = tail.select("target_lang", "key", F.lit("tail").alias("__s2"), F.col("target").alias("__t2"), F.col("entry_id").alias("__e2"))
    both = wanted.join(c, ["target_lang", "key"], "left").join(t, ["target_lang", "key"], "left")
    return both.select("target_lang", "key", F.coalesce("__s1", "__s2").alias("shard"), F.when(F.col("__s1").isNotNull(), F.col("__t1")).otherwise(F.col("__t2")).alias("target"), F.coalesce("__e1", "__e2").alias("entry_id"))


def strip_generated(pack: DataFrame, generated: str, curated: str) -> DataFrame:
    """Pack without rows an earlier import made: those with the generated id and not the curated one.

    Rows without source ids get the curated id first.
    """
    ids = F.when(F.coalesce(F.size("source_ids"), F.lit(0)) > 0, F.col("source_ids")).otherwise(F.array(F.lit(curated)))
    p = pack.withColumn("source_ids", ids)
    return p.where(~(F.array_contains("source_ids", generated) & ~F.array_contains("source_ids", curated)))


def noun_metadata(records: DataFrame, ordinal: str) -> DataFrame:
    """word, gender, plural of the first noun record of each word; ``records`` has word, pos, gender, plural."""
    nouns = records.where("pos = 'noun' AND trim(word) <> ''").select(F.trim("word").alias("word"), "gender", "plural", F.col(ordinal).alias("__o"))
    return best_by(nouns, ["word"], [F.col("__o")]).drop("__o")
