"""Dictionary queries. The tables stand in for the packs: pack_entry for the core shard, tail_entry for the tail,
candidate for raw dictionary rows, documents for the corpus that frequencies come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import grammar, text
from glossmill.operators import dictionary as d
from glossmill.sources.tables import spread, table

#: Entries that core and tail of a language have together.
TARGET = 100_000
_RAW_POS = {"noun": "n", "verb": "v", "adjective": "adj", "adverb": "adv", "expression": "phraseologicalUnit", "function": "preposition"}


def word_zipf(spark: SparkSession, folder: str) -> DataFrame:
    """Of the documents told to be English in any writing of the tag; null and 'und' are not told and do not count."""
    docs = table(spark, folder, "documents").where(text.language(F.col("lang")) == "en")
    return d.word_frequency(docs, [], "text")


def word_tokens_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return text.tokens(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "token_no", "token", "start", F.col("end").alias("stop"))


def pack_core(spark: SparkSession, folder: str) -> DataFrame:
    return d.lexicon(table(spark, folder, "pack_entry")).select("target_lang", "key", "target", "part_of_speech", "frequency_rank", "entry_id")


def pack_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Tail keys that the core lacks, those of highest zipf, as many as bring a language to TARGET entries, ranked on from RANK_OFFSET."""
    core, tail = d.lexicon(table(spark, folder, "pack_entry")), d.lexicon(table(spark, folder, "tail_entry"))
    fresh = tail.join(core.select("target_lang", "key"), ["target_lang", "key"], "left_anti").withColumn("en_zipf", F.coalesce("en_zipf", F.lit(0.0)))
    room = core.groupBy("target_lang").agg(F.greatest(F.lit(0), TARGET - F.count("*")).alias("room"))
    fresh = fresh.join(room, "target_lang", "left").withColumn("room", F.coalesce("room", F.lit(TARGET)))
    ranked = d.first_ranked(fresh, ["target_lang"], [F.desc("en_zipf"), F.col("key")], [-F.col("en_zipf"), F.substring("key", 1, 2)], F.col("room"))
    return ranked.select("target_lang", "key", "target", (F.col("rn") + d.RANK_OFFSET - 1).alias("frequency_rank"))


def pack_lookup(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "candidate").where("target_lang IS NOT NULL AND source IS NOT NULL").select("target_lang", F.lower("source").alias("key")).distinct()
    return d.shard_lookup(wanted, d.lexicon(table(spark, folder, "pack_entry")), d.lexicon(table(spark, folder, "tail_entry")))


def core_tail_overlap(spark: SparkSession, folder: str) -> DataFrame:
    core, tail = d.lexicon(table(spark, folder, "pack_entry")), d.lexicon(table(spark, folder, "tail_entry"))
    return tail.join(core.select("target_lang", "key"), ["target_lang", "key"], "left_semi").groupBy("target_lang").agg(F.count("*").alias("shared"))


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "candidate").where("target_lang = 'es'")
    return c.select("source", d.lookup_map(_RAW_POS, F.col("part_of_speech")).alias("raw_pos"), F.array("target").alias("translations"), F.array("gloss").alias("definitions"), F.col("cand_id").alias("source_order"))


def dict_normalise(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "pack_entry").where("target_lang = 'es'").select(F.lower("source").alias("source"), F.lower("target").alias("target")).dropna().distinct()
    return d.normalise(_raw(spark, folder), pairs=pairs, provenance=["wiktextract"]).withColumn("source_ids", F.array_join("source_ids", ","))


def dict_best(spark: SparkSession, folder: str) -> DataFrame:
    return d.best_by(dict_normalise(spark, folder), ["source"], [F.col("rank_priority"), F.col("source_order")]).select("source", "target", "part_of_speech", "rank_priority", "source_order")


def dict_rank_append(spark: SparkSession, folder: str) -> DataFrame:
    core = d.lexicon(table(spark, folder, "pack_entry")).where("target_lang = 'es'").select("target_lang", F.col("key").alias("source"), "frequency_rank")
    new = dict_best(spark, folder).withColumn("target_lang", F.lit("es"))
    return d.append_ranks(core, new, ["target_lang", "source"], "target_lang", [F.col("rank_priority"), F.col("source_order"), F.col("source")], 50_000, [F.col("rank_priority"), F.shiftright("source_order", 16)]).select("source", "target", "frequency_rank")


def gloss_pieces(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "candidate").where("gloss IS NOT NULL").select("cand_id", F.explode(d.gloss_pieces(F.col("gloss"))).alias("x"))
    return c.select("cand_id", F.col("x.piece").alias("piece"), F.col("x.n_words").alias("n_words"))


def invert_best(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "candidate")
    frequency = d.word_frequency(c.where("target_lang IS NOT NULL AND target IS NOT NULL"), ["target_lang"], "target", r"\S+").select("target_lang", "word", "zipf")
    rows = c.select("target_lang", "part_of_speech", F.lower("target").alias("target"), "gender", "plural", "gloss", F.pmod("cand_id", F.lit(3)).cast("int").alias("sense_index"), (F.pmod("cand_id", F.lit(10)) == 0).alias("restricted"), "cand_id")
    best = d.best_by(d.invert(rows.where("target_lang IS NOT NULL"), frequency), ["target_lang", "source"], [-F.col("score"), F.col("cand_id")])
    return best.select("target_lang", "source", "part_of_speech", "target", F.round("score", 2).alias("score"), "cand_id")


def tail_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Tail sources by the form gates, with the target whose first word is the most frequent, and nouns with gender and plural.

    A word is real if the corpus or a core key has it. German plurals are looked up, here among the candidates' own.
    """
    c = table(spark, folder, "candidate").where("target_lang IS NOT NULL").select("target_lang", F.lower(F.trim("source")).alias("source"), "part_of_speech", F.trim("target").alias("target"), d.plain_gender(F.col("target_lang"), F.col("gender")).alias("gender"), F.col("plural").alias("given"), "cand_id")
    c = c.withColumn("pos", d.source_class(F.col("source"), F.col("part_of_speech"))).where(F.col("pos").isNotNull() & d.tail_target(F.col("target")))
    c = c.withColumn("plural", F.when(F.col("pos") == "noun", grammar.derived_plural(F.col("target_lang"), F.col("target"), F.col("gender"), F.col("given")))).where("pos <> 'noun' OR (gender IS NOT NULL AND plural <> '')")
    docs = table(spark, folder, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z'-]*"), 0)).alias("word")).distinct()
    core = d.lexicon(table(spark, folder, "pack_entry")).select("target_lang", F.col("key").alias("source"))
    words = c.select("source", F.explode(F.split("source", " ")).alias("word")).distinct()
    unreal = words.join(docs.union(core.select("source")).distinct(), "word", "left_anti").select("source").distinct()
    frequency = d.word_frequency(table(spark, folder, "candidate").where("target_lang IS NOT NULL AND target IS NOT NULL"), ["target_lang"], "target", r"\S+").select("target_lang", "word", "zipf")
    left = c.join(unreal, "source", "left_anti").join(core, ["target_lang", "source"], "left_anti").withColumn("word", F.lower(F.get(text.words_of(F.col("target")), F.lit(0))))
    scored = left.join(frequency, ["target_lang", "word"], "left").withColumn("score", F.round(d.tail_score(F.col("zipf"), F.col("target")), 4))
    return d.best_by(scored, ["target_lang", "source"], [-F.col("score"), F.col("cand_id")]).select("target_lang", "source", "pos", "target", F.when(F.col("pos") == "noun", F.col("gender")).alias("gender"), "plural", "score", "cand_id")


def tail_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the first inversion, and those that only the second one (the tail table) has."""
    first = tail_candidates(spark, folder).select("target_lang", F.col("source").alias("key"), "target", F.lit("first").alias("origin"))
    second = d.lexicon(table(spark, folder, "tail_entry")).select("target_lang", "key", "target", F.lit("second").alias("origin"))
    return d.first_of(first, second, ["target_lang", "key"]).groupBy("target_lang", "origin").agg(F.count("*").alias("n_keys"))


def key_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the tail looked up in the core as they are written, else in lower case."""
    wanted = table(spark, folder, "tail_entry").where("target_lang IS NOT NULL AND source IS NOT NULL").select("target_lang", "source").distinct()
    pack = d.best_by(table(spark, folder, "pack_entry").where("target_lang IS NOT NULL AND source IS NOT NULL").select("target_lang", "source", "entry_id"), ["target_lang", "source"], [F.col("entry_id")])
    return d.lookup_either(wanted, pack, "target_lang", "source", "entry_id").where("entry_id IS NOT NULL")


def _nouns(spark: SparkSession, folder: str) -> DataFrame:
    """Nouns in any writing of the label."""
    return table(spark, folder, "pack_entry").where((F.lower(text.trim_all(F.col("part_of_speech"))) == "noun") & F.col("target").isNotNull() & F.col("target_lang").isNotNull())


def derived_plurals(spark: SparkSession, folder: str) -> DataFrame:
    n = _nouns(spark, folder).where("target_lang <> 'de'")
    return n.select("entry_id", grammar.derived_plural(F.col("target_lang"), F.col("target"), F.col("gender")).alias("plural"))


def spanish_nouns(spark: SparkSession, folder: str) -> DataFrame:
    n = _nouns(spark, folder).where("target_lang = 'es'")
    t = text.clean_text(F.col("target"))
    return n.select("entry_id", grammar.infer_gender(t).alias("gender"), grammar.spanish_plural(t).alias("plural"))


def plural_repairs(spark: SparkSession, folder: str) -> DataFrame:
    n = _nouns(spark, folder).where("target_lang = 'es' AND plural IS NOT NULL").select("entry_id", F.trim("target").alias("target"), F.trim("plural").alias("plural"))
    return n.withColumn("repaired", grammar.fix_spanish_plural(F.col("target"), F.col("plural"))).where("repaired <> plural").select("entry_id", "plural", "repaired")


def article_forms(spark: SparkSession, folder: str) -> DataFrame:
    n = _nouns(spark, folder).where("plural IS NOT NULL AND gender IS NOT NULL")
    each = n.withColumn("kind", F.explode(F.array(F.lit("definite"), F.lit("indefinite"), F.lit("none")))).withColumn("is_plural", F.explode(F.array(F.lit(False), F.lit(True))))
    return each.select("entry_id", "kind", "is_plural", grammar.article_form(F.col("target_lang"), F.col("target"), F.col("plural"), F.col("gender"), F.col("is_plural"), F.col("kind")).alias("display"))


def source_id_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pack_entry").select(F.explode("source_ids").alias("source_id")).groupBy("source_id").agg(F.count("*").alias("n_entries"))


def pos_counts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pack_entry")
    return p.groupBy("target_lang", "part_of_speech").agg(F.count("*").alias("n_entries"), F.count_if(F.coalesce("en_zipf", F.lit(0.0)) >= 5).alias("n_common"), F.max("frequency_rank").alias("max_rank"))


def strip_generated(spark: SparkSession, folder: str) -> DataFrame:
    p = d.strip_generated(table(spark, folder, "pack_entry"), "freedict-es", "curated-core")
    return p.groupBy("target_lang").agg(F.count("*").alias("n_entries"), F.sum(F.size("source_ids")).alias("n_ids"))


QUERIES = {f.__name__: f for f in (word_zipf, word_tokens_offsets, pack_core, pack_tail, pack_lookup, core_tail_overlap, dict_normalise, dict_best, dict_rank_append, gloss_pieces, invert_best, tail_candidates, tail_merged, key_lookup, derived_plurals, spanish_nouns, plural_repairs, article_forms, source_id_counts, pos_counts, strip_generated)}


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def lexicon_sql(name: str) -> str:
    return f"(SELECT * FROM (SELECT *, lower(source) AS key, row_number() OVER (PARTITION BY target_lang, lower(source) ORDER BY frequency_rank, entry_id) AS rn_ FROM {name} WHERE target_lang IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL) WHERE rn_ = 1)"


_WORD = r"[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*"
_CLEAN = lambda x: rf"trim(regexp_replace({x}, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))"
_STRIP = lambda x: rf"regexp_replace({x}, '^(?i:el|la|los|las|un|una|unos|unas)( |$)', '')"
_GENDER = lambda t: rf"CASE WHEN regexp_matches(lower({t}), '^(el|un|los|unos)( |$)') THEN 'masculine' WHEN regexp_matches(lower({t}), '^(la|una|las|unas)( |$)') THEN 'feminine' WHEN regexp_matches(split_part(lower({_STRIP(t)}), ' ', 1), '{grammar.FEMININE}') THEN 'feminine' WHEN regexp_matches(split_part(lower({_STRIP(t)}), ' ', 1), '{grammar.MASCULINE}') THEN 'masculine' END"


def _plural(t: str) -> str:
    bare = _STRIP(t)
    head, rest = f"split_part({bare}, ' ', 1)", f"substr({bare}, length(split_part({bare}, ' ', 1)) + 1)"
    return f"CASE WHEN {bare} <> '' THEN (CASE WHEN {head} LIKE '%z' THEN left({head}, -1) || 'ces' WHEN regexp_matches(lower(right({head}, 1)), '[aeiouáéíóúü]') THEN {head} || 's' ELSE {head} || 'es' END) || {rest} END"


_NORMAL = rf"""
SELECT source, CASE WHEN pos = 'noun' THEN {_STRIP('target')} ELSE target END AS target, pos AS part_of_speech, source_gloss,
  CASE WHEN sure THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN sure THEN 'freedict,wiktextract' ELSE 'freedict' END AS source_ids, source_order,
  CAST((CASE WHEN sure THEN 0 ELSE 100 END) + (CASE pos WHEN 'adverb' THEN 0 WHEN 'noun' THEN 1 WHEN 'adjective' THEN 2 WHEN 'expression' THEN 3 WHEN 'verb' THEN 4 ELSE 5 END) + least(3, length(source) - length(replace(source, ' ', ''))) AS INTEGER) AS rank_priority,
  CASE WHEN pos = 'noun' THEN {_GENDER('target')} END AS gender, CASE WHEN pos = 'noun' THEN {_plural('target')} END AS plural, CASE WHEN pos = 'function' THEN 'preposition' END AS function_subtype
FROM (
  SELECT s AS source, t AS target, CASE WHEN s LIKE '% %' AND part_of_speech <> 'function' THEN 'expression' ELSE part_of_speech END AS pos, g AS source_gloss, cand_id AS source_order,
    EXISTS (SELECT 1 FROM pack_entry p WHERE p.target_lang = 'es' AND lower(p.source) = s AND (lower(p.target) = lower(t) OR lower(p.target) = lower({_STRIP('t')}))) AS sure
  FROM (SELECT cand_id, part_of_speech, lower({_CLEAN('source')}) AS s, {_CLEAN('target')} AS t, trim(regexp_replace({_CLEAN('gloss')}, '^\([^)]{{1,80}}\)\s*', '')) AS g FROM candidate WHERE target_lang = 'es' AND part_of_speech IN ('noun', 'verb', 'adjective', 'adverb', 'expression', 'function'))
  WHERE regexp_matches(s, '^[a-z][a-z'' -]{{0,58}}[a-z]$') AND length(s) - length(replace(s, ' ', '')) <= 3 AND NOT regexp_matches(s, '[^ ]{{25,}}')
    AND length(t) BETWEEN 1 AND 60 AND t NOT LIKE '-%' AND t NOT LIKE '%-' AND regexp_matches(t, '^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ¿¡'' .-]+$') AND NOT regexp_matches(t, '\.{{3}}') AND g <> '' AND g IS NOT NULL)
"""
_NORMALISED = f"(SELECT * FROM ({_NORMAL}) WHERE part_of_speech <> 'noun' OR (gender IS NOT NULL AND plural IS NOT NULL))"
_BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank_priority, source_order) AS rn FROM {_NORMALISED}) WHERE rn = 1)"
_PIECES = rf"""(SELECT cand_id, regexp_replace(p, '\s+', ' ', 'g') AS piece, CAST(len(regexp_split_to_array(p, '\s+')) AS INTEGER) AS n_words FROM (
  SELECT cand_id, regexp_replace(regexp_replace(regexp_replace(trim(q), '^(a|an|the)\s+', ''), '^to\s+', ''), '^[ .,;:"'']+|[ .,;:"'']+$', '', 'g') AS p FROM (
  SELECT cand_id, unnest(regexp_split_to_array(lower(trim(regexp_replace(regexp_replace(gloss, '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g'))), '\s*[;,/]\s*|\s+or\s+')) AS q FROM candidate WHERE gloss IS NOT NULL)) WHERE p <> '')"""
_BLOCKED = "|".join(sorted(set(d.PHRASE_STOP) | set(d.FUNCTION_WORDS)))
_GOOD_PIECES = rf"(SELECT * FROM {_PIECES} WHERE (n_words = 1 AND length(piece) > 1 AND regexp_matches(piece, '^[a-z][a-z''-]*$') AND piece NOT IN {_in(d.FUNCTION_WORDS)}) OR (n_words BETWEEN 2 AND 3 AND regexp_matches(piece, '^[a-z][a-z'' -]*$') AND NOT regexp_matches(' ' || replace(piece, ' ', '  ') || ' ', ' ({_BLOCKED}) ') AND NOT regexp_matches(' ' || replace(piece, ' ', '  ') || ' ', ' . ')))"
_FREQ = r"(SELECT target_lang, word, round(log10(n * 1e9 / sum(n) OVER (PARTITION BY target_lang)), 2) AS zipf FROM (SELECT target_lang, word, count(*) AS n FROM (SELECT target_lang, unnest(regexp_extract_all(lower(target), '\S+')) AS word FROM candidate WHERE target_lang IS NOT NULL AND target IS NOT NULL) GROUP BY ALL))"
_INVERTED = rf"""(SELECT c.target_lang, g.piece AS source, CASE WHEN g.n_words = 1 THEN c.part_of_speech ELSE 'expression' END AS part_of_speech, c.t AS target, c.cand_id,
  coalesce(b.base, 0) - 0.4::DOUBLE * (c.cand_id % 3) - (CASE WHEN c.cand_id % 10 = 0 THEN 2.0::DOUBLE ELSE 0::DOUBLE END) - 0.25::DOUBLE * (g.n_words - 1) - 0.8::DOUBLE * (len(string_split(c.t, ' ')) - 1) AS score
  FROM (SELECT *, lower(target) AS t FROM candidate WHERE target_lang IS NOT NULL AND part_of_speech IN ('noun', 'verb', 'adjective', 'adverb') AND target <> '' AND NOT regexp_matches(target, '\p{{Nd}}') AND target NOT LIKE '-%' AND target NOT LIKE '%-' AND len(string_split(target, ' ')) <= 3 AND (part_of_speech <> 'noun' OR (gender IS NOT NULL AND plural IS NOT NULL))) c
  JOIN {_GOOD_PIECES} g USING (cand_id)
  LEFT JOIN (SELECT target_lang, t, min(zipf) AS base FROM (SELECT DISTINCT target_lang, lower(target) AS t, unnest(string_split(lower(target), ' ')) AS word FROM candidate) JOIN {_FREQ} USING (target_lang, word) WHERE zipf > 0 GROUP BY ALL) b ON b.target_lang = c.target_lang AND b.t = c.t)"""
_NOUNS = "(SELECT * FROM pack_entry WHERE lower(trim(part_of_speech, E' \\t\\n')) = 'noun' AND target IS NOT NULL AND target_lang IS NOT NULL)"
_VOWEL = f"^{grammar.VOWEL}"
_ARTICLE = f"""CASE kind WHEN 'definite' THEN CASE target_lang
  WHEN 'es' THEN CASE WHEN many THEN CASE WHEN fem THEN 'las ' ELSE 'los ' END WHEN fem AND (regexp_matches(w, '^h?[áà]') OR w IN {_in(grammar.STRESSED_A)}) THEN 'el ' WHEN fem THEN 'la ' ELSE 'el ' END
  WHEN 'de' THEN CASE WHEN many OR fem THEN 'die ' WHEN gender = 'neuter' THEN 'das ' ELSE 'der ' END
  WHEN 'fr' THEN CASE WHEN many THEN 'les ' WHEN (w LIKE 'h%' AND w NOT IN {_in(grammar.ASPIRATED_H)}) OR (w NOT LIKE 'h%' AND regexp_matches(w, '{_VOWEL}')) THEN 'l''' WHEN fem THEN 'la ' ELSE 'le ' END
  WHEN 'it' THEN CASE WHEN many THEN CASE WHEN fem THEN 'le ' WHEN vow OR imp THEN 'gli ' ELSE 'i ' END WHEN vow THEN 'l''' WHEN fem THEN 'la ' WHEN imp THEN 'lo ' ELSE 'il ' END ELSE '' END
 WHEN 'indefinite' THEN CASE target_lang
  WHEN 'es' THEN CASE WHEN many THEN CASE WHEN fem THEN 'unas ' ELSE 'unos ' END WHEN fem AND (regexp_matches(w, '^h?[áà]') OR w IN {_in(grammar.STRESSED_A)}) THEN 'un ' WHEN fem THEN 'una ' ELSE 'un ' END
  WHEN 'de' THEN CASE WHEN many THEN '' WHEN fem THEN 'eine ' ELSE 'ein ' END
  WHEN 'fr' THEN CASE WHEN many THEN 'des ' WHEN fem THEN 'une ' ELSE 'un ' END
  WHEN 'it' THEN CASE WHEN many THEN '' WHEN fem THEN CASE WHEN vow THEN 'un''' ELSE 'una ' END WHEN imp THEN 'uno ' ELSE 'un ' END ELSE '' END ELSE '' END"""
_FIRST = r"split_part(trim(regexp_replace(noun, '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g')), ' ', 1)"

ORACLE = {
    "word_zipf": "SELECT word, n, round(log10(n * 1e9 / sum(n) OVER ()), 2) AS zipf FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE split_part(split_part(lower(trim(lang, E' \\t\\n')), '-', 1), '_', 1) = 'en') GROUP BY word)",
    "word_tokens_offsets": f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w, regexp_split_to_array(text, '{_WORD}') AS g FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, unnest(w) AS token, unnest(list_slice(g, 1, len(w))) AS gap, unnest(range(len(w))) AS i FROM t), s AS (SELECT doc_id, CAST(i AS INTEGER) AS token_no, token, CAST(sum(length(token) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS stop FROM r) SELECT doc_id, token_no, token, CAST(stop - length(token) AS INTEGER) AS start, stop FROM s",
    "pack_core": f"SELECT target_lang, key, target, part_of_speech, frequency_rank, entry_id FROM {lexicon_sql('pack_entry')}",
    "pack_tail": f"SELECT target_lang, key, target, CAST(rn + 999999 AS INTEGER) AS frequency_rank FROM (SELECT target_lang, key, target, row_number() OVER (PARTITION BY target_lang ORDER BY coalesce(en_zipf, 0) DESC, key) AS rn FROM {lexicon_sql('tail_entry')} t WHERE NOT EXISTS (SELECT 1 FROM pack_entry p WHERE p.target_lang = t.target_lang AND lower(p.source) = t.key AND p.target IS NOT NULL)) x LEFT JOIN (SELECT target_lang, greatest(0, {TARGET} - count(*)) AS room FROM {lexicon_sql('pack_entry')} GROUP BY target_lang) USING (target_lang) WHERE rn <= coalesce(room, {TARGET})",
    "pack_lookup": f"SELECT w.target_lang, w.key, CASE WHEN c.entry_id IS NOT NULL THEN 'core' WHEN t.entry_id IS NOT NULL THEN 'tail' END AS shard, coalesce(c.target, t.target) AS target, coalesce(c.entry_id, t.entry_id) AS entry_id FROM (SELECT DISTINCT target_lang, lower(source) AS key FROM candidate WHERE target_lang IS NOT NULL AND source IS NOT NULL) w LEFT JOIN {lexicon_sql('pack_entry')} c ON c.target_lang = w.target_lang AND c.key = w.key LEFT JOIN {lexicon_sql('tail_entry')} t ON t.target_lang = w.target_lang AND t.key = w.key",
    "core_tail_overlap": "SELECT target_lang, count(*) AS shared FROM (SELECT target_lang, lower(source) AS k FROM tail_entry WHERE target IS NOT NULL AND source IS NOT NULL AND target_lang IS NOT NULL INTERSECT SELECT target_lang, lower(source) FROM pack_entry WHERE target IS NOT NULL) GROUP BY target_lang",
    "dict_normalise": f"SELECT * FROM {_NORMALISED}",
    "dict_best": f"SELECT source, target, part_of_speech, rank_priority, source_order FROM {_BEST}",
    "dict_rank_append": f"SELECT source, target, rn + (SELECT max(frequency_rank) FROM {lexicon_sql('pack_entry')} WHERE target_lang = 'es') AS frequency_rank FROM (SELECT source, target, row_number() OVER (ORDER BY rank_priority, source_order, source) AS rn FROM {_BEST} WHERE source NOT IN (SELECT lower(source) FROM pack_entry WHERE target_lang = 'es' AND source IS NOT NULL AND target IS NOT NULL)) WHERE rn <= 50000",
    "gloss_pieces": f"SELECT cand_id, piece, n_words FROM {_GOOD_PIECES}",
    "invert_best": f"SELECT target_lang, source, part_of_speech, target, round(score, 2) AS score, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY target_lang, source ORDER BY score DESC, cand_id) AS rn FROM {_INVERTED}) WHERE rn = 1",
    "key_lookup": "WITH p AS (SELECT target_lang, source, min(entry_id) AS entry_id FROM pack_entry WHERE target_lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), w AS (SELECT DISTINCT target_lang, source FROM tail_entry WHERE target_lang IS NOT NULL AND source IS NOT NULL) SELECT w.target_lang, w.source, coalesce(a.entry_id, b.entry_id) AS entry_id FROM w LEFT JOIN p a ON a.target_lang = w.target_lang AND a.source = w.source LEFT JOIN p b ON b.target_lang = w.target_lang AND b.source = lower(w.source) WHERE coalesce(a.entry_id, b.entry_id) IS NOT NULL",
    "derived_plurals": f"""SELECT entry_id, CASE WHEN target NOT LIKE '% %' AND target <> '' THEN CASE target_lang
      WHEN 'es' THEN CASE WHEN regexp_matches(lower(target), '[áéíóú]n$') THEN left(target, -2) || translate(substr(lower(target), length(target) - 1, 1), 'áéíóú', 'aeiou') || 'nes' WHEN lower(target) LIKE '%z' THEN left(target, -1) || 'ces' WHEN regexp_matches(lower(target), '[sx]$') THEN target WHEN regexp_matches(lower(target), '[aeiouáéíóú]$') THEN target || 's' ELSE target || 'es' END
      WHEN 'fr' THEN CASE WHEN regexp_matches(lower(target), '[sxz]$') THEN target WHEN lower(target) LIKE '%al' AND length(target) > 2 THEN left(target, -2) || 'aux' WHEN regexp_matches(lower(target), '(eau|au|eu)$') THEN target || 'x' ELSE target || 's' END
      WHEN 'it' THEN CASE WHEN regexp_matches(lower(target), '[oe]$') THEN left(target, -1) || 'i' WHEN lower(target) LIKE '%a' THEN left(target, -1) || CASE WHEN gender = 'masculine' THEN 'i' ELSE 'e' END ELSE target END END END AS plural FROM {_NOUNS} WHERE target_lang <> 'de'""",
    "spanish_nouns": f"SELECT entry_id, {_GENDER('t')} AS gender, {_plural('t')} AS plural FROM (SELECT entry_id, {_CLEAN('target')} AS t FROM {_NOUNS} WHERE target_lang = 'es')",
    "plural_repairs": rf"""WITH n AS (SELECT entry_id, trim(target) AS t, trim(plural) AS p FROM {_NOUNS} WHERE target_lang = 'es' AND plural IS NOT NULL), a AS (SELECT *, '^(.*?)(\sde\s|\sdel\s|\sde la\s|\sde los\s|\sde las\s)(.*)$' AS k FROM n), b AS (SELECT *, CASE WHEN regexp_matches(t, k) AND regexp_matches(p, k) THEN regexp_extract(p, k, 1) || regexp_extract(t, k, 2) || regexp_extract(t, k, 3) ELSE p END AS q FROM a),
      e AS (SELECT *, CASE WHEN regexp_matches(q, '.[áéíóú][ns]es$') AND NOT regexp_matches(q, '[aeiouáéíóúAEIOUÁÉÍÓÚ][íú][ns]es$') THEN left(q, -4) || translate(substr(q, length(q) - 3, 1), 'áéíóú', 'aeiou') || right(q, 3) ELSE q END AS r FROM b) SELECT entry_id, p AS plural, CASE WHEN t NOT LIKE '% %' AND regexp_matches(t, '(sis|xis)$') THEN t ELSE r END AS repaired FROM e WHERE CASE WHEN t NOT LIKE '% %' AND regexp_matches(t, '(sis|xis)$') THEN t ELSE r END <> p""",
    "article_forms": rf"""WITH e AS (SELECT *, gender = 'feminine' AS fem, unnest(['definite', 'indefinite', 'none']) AS kind FROM {_NOUNS} WHERE plural IS NOT NULL AND gender IS NOT NULL), f AS (SELECT *, unnest([false, true]) AS many FROM e), g AS (SELECT *, CASE WHEN many THEN plural ELSE target END AS noun0 FROM f), h AS (SELECT *, CASE WHEN target_lang = 'de' THEN regexp_extract(noun0, '^\P{{L}}*', 0) || upper(substr(noun0, length(regexp_extract(noun0, '^\P{{L}}*', 0)) + 1, 1)) || substr(noun0, length(regexp_extract(noun0, '^\P{{L}}*', 0)) + 2) ELSE noun0 END AS noun FROM g),
      i AS (SELECT *, lower({_FIRST}) AS w FROM h), j AS (SELECT *, regexp_matches(w, '{_VOWEL}') AND NOT regexp_matches(w, '^i[aeiouàèéìíòóù]') AS vow, regexp_matches(w, '^(z|gn|pn|ps|x|y)|^s[^aeiouàèéìíòóùú]|^i[aeiouàèéìíòóù]') AS imp FROM i) SELECT entry_id, kind, many AS is_plural, ({_ARTICLE}) || noun AS display FROM j""",
    "strip_generated": "SELECT target_lang, count(*) AS n_entries, CAST(sum(len(i)) AS BIGINT) AS n_ids FROM (SELECT target_lang, CASE WHEN len(source_ids) > 0 THEN source_ids ELSE ['curated-core'] END AS i FROM pack_entry) WHERE NOT (list_contains(i, 'freedict-es') AND NOT list_contains(i, 'curated-core')) GROUP BY target_lang",
    "source_id_counts": "SELECT source_id, count(*) AS n_entries FROM (SELECT unnest(source_ids) AS source_id FROM pack_entry) GROUP BY source_id",
    "pos_counts": "SELECT target_lang, part_of_speech, count(*) AS n_entries, count(*) FILTER (coalesce(en_zipf, 0) >= 5) AS n_common, max(frequency_rank) AS max_rank FROM pack_entry GROUP BY target_lang, part_of_speech",
}

_PLURAL = ORACLE["derived_plurals"].split("SELECT entry_id, ")[1].split(" AS plural FROM")[0].replace("CASE target_lang", "CASE target_lang WHEN 'de' THEN given", 1)
_TAIL = rf"""WITH core AS (SELECT DISTINCT target_lang, lower(source) AS key FROM pack_entry WHERE target_lang IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL),
      seen AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS word FROM documents UNION SELECT key FROM core),
      c AS (SELECT target_lang, lower(trim(source)) AS source, part_of_speech AS p, trim(target) AS target, CASE WHEN gender <> 'neuter' OR target_lang = 'de' THEN gender END AS gender, plural AS given, cand_id, len(string_split(lower(trim(source)), ' ')) AS n FROM candidate WHERE target_lang IS NOT NULL),
      k AS (SELECT *, CASE WHEN n = 1 AND length(source) >= 2 AND regexp_matches(source, '^[a-z][a-z''-]*$') AND p IN ('noun', 'verb', 'adjective', 'adverb') THEN p WHEN n BETWEEN 2 AND 3 AND regexp_matches(source, '^[a-z][a-z'' -]*$') AND len(list_intersect(string_split(source, ' '), {d.TAIL_STOP!r})) = 0 THEN 'expression' END AS pos FROM c),
      g0 AS (SELECT *, CASE WHEN pos = 'noun' THEN {_PLURAL} END AS plural FROM k WHERE pos IS NOT NULL AND length(target) BETWEEN 2 AND 40 AND NOT regexp_matches(target, '\p{{Nd}}|^-|-$|[.():;/]') AND len(regexp_split_to_array(target, '\s+')) <= 3 AND regexp_matches(target, '\p{{L}}')),
      g AS (SELECT * FROM g0 WHERE pos <> 'noun' OR (gender IS NOT NULL AND plural <> '')),
      bad AS (SELECT DISTINCT source FROM (SELECT DISTINCT source, unnest(string_split(source, ' ')) AS word FROM g) WHERE word NOT IN (SELECT word FROM seen WHERE word IS NOT NULL)),
      fw AS (SELECT target_lang, unnest(regexp_extract_all(lower(target), '\S+')) AS word FROM candidate WHERE target_lang IS NOT NULL AND target IS NOT NULL), fq AS (SELECT target_lang, word, round(log10(count(*) * 1e9 / sum(count(*)) OVER (PARTITION BY target_lang)), 2) AS zipf FROM fw GROUP BY target_lang, word),
      sc AS (SELECT g.*, round(coalesce(zipf, 0) - 0.5 * (len(regexp_split_to_array(target, '\s+')) - 1), 4) AS score FROM g LEFT JOIN fq ON fq.target_lang = g.target_lang AND fq.word = lower(regexp_split_to_array(target, '\s+')[1])),
      tc AS (SELECT target_lang, source, pos, target, CASE WHEN pos = 'noun' THEN gender END AS gender, plural, score, cand_id FROM sc WHERE source NOT IN (SELECT source FROM bad) AND NOT EXISTS (SELECT 1 FROM core WHERE core.target_lang = sc.target_lang AND core.key = sc.source) QUALIFY row_number() OVER (PARTITION BY target_lang, source ORDER BY score DESC, cand_id) = 1)"""
ORACLE |= {
    "tail_candidates": f"{_TAIL} SELECT * FROM tc",
    "tail_merged": f"{_TAIL}, two AS (SELECT target_lang, key FROM {lexicon_sql('tail_entry')}) SELECT target_lang, 'first' AS origin, count(*) AS n_keys FROM tc GROUP BY target_lang UNION ALL SELECT target_lang, 'second', count(*) FROM two WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.target_lang = two.target_lang AND tc.source = two.key) GROUP BY target_lang",
}
