"""Quality queries over pack_entry and tail_entry; candidate stands in for decisions and reference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.keys import unit_interval_sql
from glossmill.functions.text import trim_all
from glossmill.operators import page
from glossmill.operators import quality as q
from glossmill.operators.dictionary import lexicon
from glossmill.plans.dictionary import lexicon_sql
from glossmill.sources import sinks
from glossmill.sources.tables import table


# Chunks of a batch for verification, entries of a chunk.
CHUNKS, CHUNK = 100, 30


def _pack(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pack_entry")


def validate_pack(spark: SparkSession, folder: str) -> DataFrame:
    return q.violations(_pack(spark, folder), F.col("source"))


def validate_fragment(spark: SparkSession, folder: str) -> DataFrame:
    return q.violations(table(spark, folder, "tail_entry"), F.col("source"), spanish_only=True).groupBy("code").agg(F.count("*").alias("n_entries"))


def duplicate_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return q.duplicates(_pack(spark, folder), ["target_lang", "frequency_rank"])


def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return q.duplicates(_pack(spark, folder).withColumn("key", F.lower("source")), ["target_lang", "key"])


def usable_entries(spark: SparkSession, folder: str) -> DataFrame:
    core, tail = _pack(spark, folder), table(spark, folder, "tail_entry")
    c = core.where(page.usable(core)).select(F.lit("core").alias("shard"), "entry_id")
    return c.unionByName(tail.where(page.usable(tail, tail=True)).select(F.lit("tail").alias("shard"), "entry_id"))


def eligibility_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Entries shown at each level, and function words that may stand alone, by language."""
    p = _pack(spark, folder)
    ok = page.replaceable(F.col("eligible"), F.col("confidence"), F.col("en_zipf"))
    levels = [F.count_if(ok & page.below_ceiling(F.col("en_zipf"), level)).alias(level) for level in page.CEILING]
    alone = (F.col("part_of_speech") == "function") & ~F.col("function_subtype").eqNullSafe("determiner")
    return p.groupBy("target_lang").agg(F.count("*").alias("n_entries"), F.count_if(ok).alias("replaceable"), *levels, F.count_if(alone).alias("standalone_functions"))


def qa_tallies(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes and eligibility; words of several parts of speech in candidate stand in for the ambiguous ones."""
    p = _pack(spark, folder).where("source IS NOT NULL")
    poly = table(spark, folder, "candidate").where("source IS NOT NULL").groupBy(F.lower("source").alias("word")).agg(F.countDistinct("part_of_speech").alias("n")).where("n >= 4")
    fixes = spark.createDataFrame(q.FIXES, "source string, target string, gender string, plural string")
    return q.annotate(q.apply_fixes(p, fixes), poly).groupBy("target_lang").agg(F.count_if("fixed").alias("fixed"), F.count_if("is_eligible").alias("eligible"), F.count_if(F.col("reason") == "function").alias("dropped_function"), F.count_if(F.col("reason") == "polysemous").alias("dropped_polysemous"))


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon(_pack(spark, folder))


def _label(column: str):
    """The label in any writing."""
    return F.lower(trim_all(F.col(column)))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the first batch have been decided."""
    return _pack(spark, folder).where("batch_no = 1 AND source IS NOT NULL").select("target_lang", F.lower("source").alias("key")).distinct()


def verify_batch_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return q.verify_batch(_keyed(spark, folder), _ledger(spark, folder), "target_lang", CHUNKS, CHUNK).select("target_lang", "chunk_id", "place", "key", F.round("zipf", 2).alias("zipf"))


def verify_batch_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Size and range of frequencies of each language's batch and of its queue of chunks."""
    return verify_batch_chunks(spark, folder).groupBy("target_lang").agg(F.count("*").alias("n_keys"), F.countDistinct("chunk_id").alias("n_chunks"), F.min("zipf").alias("lowest"), F.max("zipf").alias("highest"))


def ledger_union_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger with the keys of batch 2 added, then those of low confidence taken out again."""
    both = _ledger(spark, folder).union(_pack(spark, folder).where("batch_no = 2 AND source IS NOT NULL").select("target_lang", F.lower("source").alias("key"))).distinct()
    flagged = _pack(spark, folder).where((_label("confidence") == "low") & F.col("source").isNotNull()).select("target_lang", F.lower("source").alias("key"))
    return both.exceptAll(both.intersect(flagged)).distinct()


def audit_weighted(spark: SparkSession, folder: str) -> DataFrame:
    p = _keyed(spark, folder).where(page.replaceable(F.col("eligible"), F.col("confidence"), F.col("en_zipf")))
    return q.weighted_sample(p, "entry_id", F.pow(F.lit(10.0), F.coalesce("en_zipf", F.lit(0.0))), 400, "audit-7").select("entry_id", "key")


def audit_uncommon(spark: SparkSession, folder: str) -> DataFrame:
    p = _keyed(spark, folder).where(page.replaceable(F.col("eligible"), F.col("confidence"), F.col("en_zipf"))).where(F.coalesce("en_zipf", F.lit(0.0)) < q.UNCOMMON)
    return q.uniform_sample(p, "entry_id", 300, "audit-7").select("entry_id", "key")


def golden_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    p = _keyed(spark, folder).where(F.col("eligible") & (_label("confidence") == "high"))
    return q.banded_sample(p, "entry_id", F.coalesce("en_zipf", F.lit(0.0)), 28, "golden-11").select("band", "entry_id", "key", "target")


def golden_check(spark: SparkSession, folder: str) -> DataFrame:
    """High, eligible entries against the targets that candidate has for their source: ok or what fails."""
    seen = table(spark, folder, "candidate").where("source IS NOT NULL AND target IS NOT NULL").select("target_lang", F.lower("source").alias("key"), F.lower("target").alias("acceptable")).distinct()
    p = _keyed(spark, folder)
    hit = seen.join(p.select("target_lang", "key", F.lower("target").alias("acceptable")), ["target_lang", "key", "acceptable"], "left_semi").select("target_lang", "key", F.lit(True).alias("hit"))
    known = seen.select("target_lang", "key").distinct()
    j = p.join(known, ["target_lang", "key"]).join(hit, ["target_lang", "key"], "left")
    verdict = F.when(~F.col("eligible").eqNullSafe(True), "not eligible").when(~F.col("confidence").eqNullSafe("high"), "not high").when(F.col("hit").isNull(), "wrong target").otherwise("ok")
    return j.groupBy("target_lang", verdict.alias("verdict")).agg(F.count("*").alias("n_entries"))


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of both shards by language, and tail rows that break its rules (low confidence, zipf below 5)."""
    core, tail = _keyed(spark, folder), lexicon(table(spark, folder, "tail_entry"))
    c = core.groupBy("target_lang").agg(F.count("*").alias("core_keys"))
    t = tail.groupBy("target_lang").agg(F.count("*").alias("tail_keys"), F.count_if(~F.col("confidence").eqNullSafe("low") | (F.coalesce("en_zipf", F.lit(0.0)) >= 5)).alias("tail_bad"))
    return c.join(t, "target_lang", "left")


def merge_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Batches after the first merged onto it as fragments: outcomes by batch, and in all (batch null)."""
    p = _pack(spark, folder).where("target_lang IS NOT NULL AND source IS NOT NULL").withColumn("key", F.lower("source"))
    m = q.merge_fragments(p.where("batch_no = 1"), p.where("batch_no > 1").select("target_lang", "key", "batch_no", "entry_id"), ["target_lang", "key"], "batch_no", "entry_id")
    return m.rollup("batch_no").agg(F.count("*").alias("input"), F.count_if(F.col("outcome") == "added").alias("added"), F.count_if(F.col("outcome") == "existing").alias("existing"), F.count_if(F.col("outcome") == "duplicate").alias("duplicate"))


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "candidate").where("target_lang = 'es'")
    action = F.when(F.col("score").isNull() | F.isnan("score"), "skip").when(F.col("score") > 4, "fix").otherwise("keep")
    return c.select(F.lower("source").alias("source"), F.col("cand_id").alias("decision_no"), action.alias("action"), F.when(F.col("score") > 4, F.col("target")).alias("target"), F.lit(None).cast("string").alias("part_of_speech"), "gender", "plural")


def apply_decisions(spark: SparkSession, folder: str) -> DataFrame:
    core = _keyed(spark, folder).where("target_lang = 'es'")
    return q.decide(_decisions(spark, folder), core).select("source", "outcome", "target", "part_of_speech")


def curation_tallies(spark: SparkSession, folder: str) -> DataFrame:
    core = _keyed(spark, folder).where("target_lang = 'es'")
    done = q.decide(_decisions(spark, folder), core).where("outcome = 'curated'")
    return q.curate(core, done).groupBy("confidence").agg(F.count_if("promoted").alias("promoted"), F.count("*").alias("n_entries"), F.count_if(F.col("eligible").eqNullSafe(True)).alias("eligible"))


def pack_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.size_report(_pack(spark, folder).where("target_lang IS NOT NULL"), "target_lang", ["source", "target", "source_gloss", "plural"])


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the pack with licence and number of entries; sources without entries have 0."""
    used = _pack(spark, folder).select(F.explode("source_ids").alias("source_key")).groupBy("source_key").agg(F.count("*").alias("n"))
    return table(spark, folder, "pack_source").join(used, "source_key", "left").select("source_key", "name", "license", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_entries"))


def domain_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Host of each source, its category of care (first pattern that matches) and whether a list of domains blocks it."""
    host = F.regexp_replace(F.lower(F.trim(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1))), r"^www\.", "")
    p = table(spark, folder, "pack_source").select("source_key", host.alias("host"))
    h = F.col("host")
    category = F.when(h.rlike(r"\.(nih|cdc|who)\.gov$|webmd\.com|mayoclinic\.org|medlineplus\.gov"), "medical").when(h.rlike(r"courts\.gov|uscourts\.gov|law\.|legislation\."), "legal").when(h.rlike(r"\.(irs|sec|fdic|federalreserve)\.gov$"), "financial or regulatory").when(h.rlike(r"\.gov$|\.mil$"), "government or military").when(h.rlike(r"chase\.com|bankofamerica\.com|wellsfargo\.com|paypal\.com|stripe\.com"), "banking")
    blocked = F.exists(F.array(F.lit("example.org"), F.lit("invalid")), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))
    return p.select("source_key", "host", category.alias("category"), F.coalesce(blocked, F.lit(False)).alias("blocked"))


QUERIES = {f.__name__: f for f in (validate_pack, validate_fragment, duplicate_ranks, duplicate_keys, usable_entries, eligibility_gates, qa_tallies, verify_batch_chunks, verify_batch_ranges, ledger_union_diff, audit_weighted, audit_uncommon, golden_snapshot, golden_check, coverage, merge_fragments, apply_decisions, curation_tallies, pack_sizes, provenance, domain_policy)}

_TRIM = lambda c: rf"regexp_replace({c}, '^[\s\p{{Z}}\x{{85}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{85}}\x{{FEFF}}]+$', '', 'g')"
_BLANK = lambda c: f"({c} IS NULL OR {_TRIM(c)} = '')"
_AFFIX = lambda c: f"({c} IS NULL OR {_TRIM(c)} = '' OR {_TRIM(c)} LIKE '-%' OR {_TRIM(c)} LIKE '%-')"
_NOUN, _FN = "coalesce(part_of_speech = 'noun', false)", "coalesce(part_of_speech = 'function', false)"


def _rules(spanish: bool) -> str:
    g = f"{_NOUN} AND target_lang = 'es'" if spanish else _NOUN
    rules = {
        "source": _BLANK("source"), "target": _AFFIX("target"), "gloss": _BLANK("source_gloss"), "key": "NOT coalesce(source = lower(source), false)", "pos": "NOT coalesce(part_of_speech IN ('noun', 'adverb', 'adjective', 'verb', 'expression', 'function'), false)",
        "confidence": "NOT coalesce(confidence IN ('high', 'medium', 'low'), false)", "rank": "NOT coalesce(frequency_rank > 0, false)", "source_ids": "NOT coalesce(len(source_ids) > 0, false)", "source_id": "false" if spanish else "coalesce(len(list_filter(source_ids, lambda x: x IS NULL OR trim(x) = '')) > 0, false)",
        "gender": f"{g} AND NOT coalesce(gender IN ('masculine', 'feminine') OR (gender = 'neuter' AND target_lang = 'de'), false)", "plural": f"{g} AND {_AFFIX('plural')}", "extra_gender": f"NOT {_NOUN} AND (gender IS NOT NULL OR plural IS NOT NULL)",
        "subtype": f"{_FN} AND NOT coalesce(function_subtype IN ('determiner', 'preposition', 'conjunction', 'pronoun'), false)", "extra_subtype": f"NOT {_FN} AND function_subtype IS NOT NULL",
    }
    return " UNION ALL ".join(f"SELECT entry_id, '{k}' AS code FROM {'tail_entry' if spanish else 'pack_entry'} WHERE {v}" for k, v in rules.items())


_LEX = lexicon_sql("pack_entry")
_OK = "(eligible AND (coalesce(confidence, '') = 'high' OR coalesce(en_zipf, 0) < 5))"
_STAND = lambda c: f"(trim({c}) <> '' AND trim({c}) NOT LIKE '-%' AND trim({c}) NOT LIKE '%-')"
_USABLE = f"coalesce({_STAND('target')}, false) AND coalesce(part_of_speech <> 'noun' OR (gender IS NOT NULL AND {_STAND('plural')}), false)"
_U = lambda salt: unit_interval_sql("entry_id", salt)
_DEC = f"""de AS (SELECT lower(source) AS source, CASE WHEN score IS NULL OR isnan(score) THEN 'skip' WHEN score > 4 THEN 'fix' ELSE 'keep' END AS action, CASE WHEN score > 4 THEN target END AS dt, gender AS dg, plural AS dl FROM candidate WHERE target_lang = 'es' AND source <> '' QUALIFY row_number() OVER (PARTITION BY lower(source) ORDER BY cand_id) = 1),
 dj AS (SELECT de.source, action, coalesce(nullif({_TRIM('dt')}, ''), CASE WHEN action = 'keep' THEN {_TRIM('l.target')} ELSE '' END) AS target, coalesce({_TRIM('l.part_of_speech')}, '') AS part_of_speech, coalesce(nullif({_TRIM('dg')}, ''), {_TRIM('l.gender')}, '') AS gender, coalesce(nullif({_TRIM('dl')}, ''), {_TRIM('l.plural')}, '') AS plural FROM de JOIN {_LEX} l ON l.key = de.source AND l.target_lang = 'es'),
 dd AS (SELECT *, CASE WHEN action = 'skip' THEN 'skipped' WHEN target = '' OR (part_of_speech = 'noun' AND (gender NOT IN ('masculine', 'feminine') OR plural = '')) THEN 'incomplete' ELSE 'curated' END AS outcome FROM dj)"""
_FIX = " UNION ALL ".join(f"SELECT '{s}' AS s" for s, *_ in q.FIXES)

ORACLE = {
    "validate_pack": _rules(False),
    "validate_fragment": f"SELECT code, count(*) AS n_entries FROM ({_rules(True)}) GROUP BY code",
    "duplicate_ranks": "SELECT target_lang, frequency_rank, count(*) AS n_holders, min(entry_id) AS first_holder, max(entry_id) AS last_holder FROM pack_entry WHERE target_lang IS NOT NULL AND frequency_rank IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "duplicate_keys": "SELECT target_lang, lower(source) AS key, count(*) AS n_holders, min(entry_id) AS first_holder, max(entry_id) AS last_holder FROM pack_entry WHERE target_lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "usable_entries": f"SELECT 'core' AS shard, entry_id FROM pack_entry WHERE confidence IN ('high', 'medium') AND {_USABLE} UNION ALL SELECT 'tail', entry_id FROM tail_entry WHERE {_USABLE}",
    "eligibility_gates": f"SELECT target_lang, count(*) AS n_entries, count(*) FILTER {'(' + _OK + ')'} AS replaceable, count(*) FILTER ({_OK} AND coalesce(en_zipf, 0) < 7.5) AS beginner, count(*) FILTER ({_OK} AND coalesce(en_zipf, 0) < 6) AS intermediate, count(*) FILTER ({_OK} AND coalesce(en_zipf, 0) < 5) AS advanced, count(*) FILTER (part_of_speech = 'function' AND function_subtype IS DISTINCT FROM 'determiner') AS standalone_functions FROM pack_entry GROUP BY target_lang",
    "qa_tallies": f"WITH p AS (SELECT lower(source) AS w FROM candidate WHERE source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT part_of_speech) >= 4), e AS (SELECT target_lang, lower(source) IN ({_FIX}) AS f, coalesce(part_of_speech IN ('noun', 'adverb', 'adjective', 'verb', 'expression'), false) AS c, lower(source) IN (SELECT w FROM p) OR regexp_replace(lower(source), 's+$', '') IN (SELECT w FROM p) AS y FROM pack_entry WHERE source IS NOT NULL) SELECT target_lang, count(*) FILTER (f) AS fixed, count(*) FILTER (c AND NOT y) AS eligible, count(*) FILTER (NOT c) AS dropped_function, count(*) FILTER (c AND y) AS dropped_polysemous FROM e GROUP BY target_lang",
    "verify_batch_chunks": f"SELECT target_lang, CAST(floor((place - 1) / {CHUNK}) AS INTEGER) AS chunk_id, place, key, round(zipf, 2) AS zipf FROM (SELECT target_lang, key, coalesce(en_zipf, 0) AS zipf, CAST(row_number() OVER (PARTITION BY target_lang ORDER BY coalesce(en_zipf, 0) DESC, key) AS INTEGER) AS place FROM {_LEX} l WHERE eligible AND coalesce(en_zipf, 0) BETWEEN 0 AND 9 AND NOT EXISTS (SELECT 1 FROM pack_entry p WHERE p.batch_no = 1 AND p.target_lang = l.target_lang AND lower(p.source) = l.key)) WHERE place <= {CHUNKS * CHUNK}",
    "verify_batch_ranges": f"SELECT target_lang, count(*) AS n_keys, count(DISTINCT chunk_id) AS n_chunks, min(zipf) AS lowest, max(zipf) AS highest FROM (SELECT target_lang, CAST(floor((place - 1) / {CHUNK}) AS INTEGER) AS chunk_id, place, key, round(zipf, 2) AS zipf FROM (SELECT target_lang, key, coalesce(en_zipf, 0) AS zipf, CAST(row_number() OVER (PARTITION BY target_lang ORDER BY coalesce(en_zipf, 0) DESC, key) AS INTEGER) AS place FROM {_LEX} l WHERE eligible AND coalesce(en_zipf, 0) BETWEEN 0 AND 9 AND NOT EXISTS (SELECT 1 FROM pack_entry p WHERE p.batch_no = 1 AND p.target_lang = l.target_lang AND lower(p.source) = l.key)) WHERE place <= {CHUNKS * CHUNK}) GROUP BY target_lang",
    "ledger_union_diff": "SELECT DISTINCT target_lang, lower(source) AS key FROM pack_entry WHERE batch_no IN (1, 2) AND source IS NOT NULL EXCEPT SELECT target_lang, lower(source) FROM pack_entry WHERE lower(trim(confidence, E' \\t\\n')) = 'low' AND source IS NOT NULL",
    "audit_weighted": f"SELECT entry_id, key FROM {_LEX} WHERE {_OK} ORDER BY ln({_U('audit-7')} + pow(2.0, -53)) / pow(10.0, coalesce(en_zipf, 0)) DESC, entry_id LIMIT 400",
    "audit_uncommon": f"SELECT entry_id, key FROM {_LEX} WHERE {_OK} AND coalesce(en_zipf, 0) < 4 ORDER BY {_U('audit-7')}, entry_id LIMIT 300",
    "golden_snapshot": f"SELECT band, entry_id, key, target FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {_U('golden-11')}, entry_id) AS k2 FROM (SELECT *, CASE WHEN z >= 4.5 AND z < 9 THEN 'common' WHEN z >= 3.5 AND z < 4.5 THEN 'mid' WHEN z >= 2 AND z < 3.5 THEN 'rare' WHEN z >= -1 AND z < 2 THEN 'deep' END AS band FROM (SELECT *, coalesce(en_zipf, 0) AS z FROM {_LEX} WHERE eligible AND lower(trim(confidence, E' \\t\\n')) = 'high')) WHERE band IS NOT NULL) WHERE k2 <= 28",
    "golden_check": f"WITH s AS (SELECT DISTINCT target_lang, lower(source) AS key, lower(target) AS t FROM candidate WHERE source IS NOT NULL AND target IS NOT NULL AND target_lang IS NOT NULL), a AS (SELECT target_lang, key, list(t) AS ts FROM s GROUP BY ALL) SELECT target_lang, CASE WHEN NOT coalesce(eligible, false) THEN 'not eligible' WHEN confidence IS DISTINCT FROM 'high' THEN 'not high' WHEN NOT list_contains(ts, lower(target)) THEN 'wrong target' ELSE 'ok' END AS verdict, count(*) AS n_entries FROM {_LEX} JOIN a USING (target_lang, key) GROUP BY ALL",
    "coverage": f"SELECT c.target_lang, core_keys, tail_keys, tail_bad FROM (SELECT target_lang, count(*) AS core_keys FROM {_LEX} GROUP BY 1) c LEFT JOIN (SELECT target_lang, count(*) AS tail_keys, count(*) FILTER (confidence IS DISTINCT FROM 'low' OR coalesce(en_zipf, 0) >= 5) AS tail_bad FROM {lexicon_sql('tail_entry')} GROUP BY 1) t USING (target_lang)",
    "merge_fragments": "WITH p AS (SELECT target_lang, lower(source) AS key, batch_no, entry_id FROM pack_entry WHERE target_lang IS NOT NULL AND source IS NOT NULL), m AS (SELECT batch_no, CASE WHEN (target_lang, key) IN (SELECT (target_lang, key) FROM p WHERE batch_no = 1) THEN 'existing' WHEN row_number() OVER (PARTITION BY target_lang, key ORDER BY batch_no, entry_id) = 1 THEN 'added' ELSE 'duplicate' END AS o FROM p WHERE batch_no > 1) SELECT batch_no, count(*) AS input, count(*) FILTER (o = 'added') AS added, count(*) FILTER (o = 'existing') AS existing, count(*) FILTER (o = 'duplicate') AS duplicate FROM m GROUP BY ROLLUP (batch_no)",
    "apply_decisions": f"WITH {_DEC} SELECT source, outcome, target, part_of_speech FROM dd",
    "curation_tallies": f"WITH {_DEC}, c AS (SELECT l.*, dd.source IS NOT NULL AND dd.part_of_speech IN ('noun', 'adverb', 'adjective', 'verb', 'expression') AS hit FROM (SELECT * FROM {_LEX} WHERE target_lang = 'es') l LEFT JOIN (SELECT * FROM dd WHERE outcome = 'curated') dd ON dd.source = l.key) SELECT CASE WHEN hit THEN 'high' ELSE confidence END AS confidence, count(*) FILTER (hit) AS promoted, count(*) AS n_entries, count(*) FILTER (hit OR eligible) AS eligible FROM c GROUP BY 1",
    "pack_sizes": "SELECT target_lang, CAST(sum(coalesce(strlen(source), 0) + coalesce(strlen(target), 0) + coalesce(strlen(source_gloss), 0) + coalesce(strlen(plural), 0)) AS BIGINT) AS raw_bytes, count(*) AS n_entries, sum(coalesce(strlen(source), 0) + coalesce(strlen(target), 0) + coalesce(strlen(source_gloss), 0) + coalesce(strlen(plural), 0)) > 10485760 AS too_large FROM pack_entry WHERE target_lang IS NOT NULL GROUP BY target_lang",
    "provenance": "SELECT s.source_key, name, license, coalesce(n, 0) AS n_entries FROM pack_source s LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT unnest(source_ids) AS k FROM pack_entry) GROUP BY k) ON k = source_key",
    "domain_policy": r"SELECT source_key, host, CASE WHEN regexp_matches(host, '\.(nih|cdc|who)\.gov$|webmd\.com|mayoclinic\.org|medlineplus\.gov') THEN 'medical' WHEN regexp_matches(host, 'courts\.gov|uscourts\.gov|law\.|legislation\.') THEN 'legal' WHEN regexp_matches(host, '\.(irs|sec|fdic|federalreserve)\.gov$') THEN 'financial or regulatory' WHEN regexp_matches(host, '\.gov$|\.mil$') THEN 'government or military' WHEN regexp_matches(host, 'chase\.com|bankofamerica\.com|wellsfargo\.com|paypal\.com|stripe\.com') THEN 'banking' END AS category, coalesce(host IN ('example.org', 'invalid') OR host LIKE '%.example.org' OR host LIKE '%.invalid', false) AS blocked FROM (SELECT source_key, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)), '^www\.', '') AS host FROM pack_source)",
}
