"""Queries of this subpackage over the folder's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.keys import unit_interval, unit_interval_sql
from glossmill.llm import containers, fingerprint, lookalike, quality, quota_sample, stable_sample, tokens, top_n
from glossmill.sources.tables import table

_FIELDS = {"key": "entry_id", "exact": ["target_lang"], "folded": ["source", "target"]}
_QUOTA = {"key": "entry_id", "number": "en_zipf", "labels": ["confidence", "part_of_speech"]}
RATE = 0.1


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    return stable_sample.stable_sample(table(spark, folder, "pack_entry"), "source", RATE, keep=["entry_id", "target_lang", "source", "batch_no"])


def p1_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the sample by batch: a later batch adds rows and changes none of the earlier counts."""
    taken = stable_sample.stable_sample(table(spark, folder, "pack_entry"), "source", RATE, keep=["batch_no", "source"])
    return taken.groupBy("batch_no").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.formatting_copies(table(spark, folder, "pack_entry"), **_FIELDS)


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.collapse_formatting(table(spark, folder, "pack_entry"), **_FIELDS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    top = top_n.top_n(table(spark, folder, "candidate"), ["target_lang", "source"], "score", ["target", "cand_id"], 3, keep=["target_lang", "source", "cand_id"])
    return top.select("target_lang", "source", "rank_no", "cand_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_report(spark, folder).where(F.col("shortfall") > 0).select("cat_id")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return quota_sample.quota_report(table(spark, folder, "pack_entry"), table(spark, folder, "sample_target"), **_QUOTA)


def p5_requests(spark: SparkSession, folder: str) -> DataFrame:
    """What of the report plain counting gives: available, requested and short rows of each category."""
    return p5_report(spark, folder).select("cat_id", "available", "requested", "shortfall")


def p5_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """The sample held against its report: rows drawn of each category are its quota, of its own rows, each once, of the smallest keys."""
    report, drawn = p5_report(spark, folder), p5_sample(spark, folder).withColumn("u", unit_interval("row_id", "quota-1"))
    rows = quota_sample.categorised(table(spark, folder, "pack_entry"), table(spark, folder, "sample_target"), **_QUOTA).select(F.col("__cat").alias("cat_id"), F.col("__id").alias("row_id"), unit_interval("__id", "quota-1").alias("u"))
    got = drawn.groupBy("cat_id").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_rows"), F.max("u").alias("highest"))
    left = rows.join(drawn.select("row_id"), "row_id", "left_anti").groupBy("cat_id").agg(F.min("u").alias("lowest"))
    own = drawn.select("cat_id", "row_id").join(rows.select("cat_id", "row_id"), ["cat_id", "row_id"]).groupBy("cat_id").agg(F.count("*").alias("n_own"))
    j = report.join(got, "cat_id", "left").join(left, "cat_id", "left").join(own, "cat_id", "left")
    n = F.coalesce("n", F.lit(0))
    right = (n == F.col("quota")) & (n == F.coalesce("n_rows", F.lit(0))) & (n == F.coalesce("n_own", F.lit(0))) & F.coalesce(F.col("highest") <= F.col("lowest"), F.lit(True))
    return j.select("cat_id", right.alias("right"))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quota_sample.quota_sample(table(spark, folder, "pack_entry"), table(spark, folder, "sample_target"), **_QUOTA)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, folder, "tail_entry"), "entry_id", "target_lang", ["source", "target"])


def p6_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.one_form(table(spark, folder, "tail_entry"), ["entry_id", "target_lang"], ["source", "target"])


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of entries that look the same and the number of links of each, without a row for each pair."""
    return lookalike.lookalike_classes(table(spark, folder, "tail_entry"), "entry_id", "target_lang", ["source", "target"])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p6_final(spark: SparkSession, folder: str) -> DataFrame:
    """Forms brought to one form again: how many texts changed, which must be none."""
    again = lookalike.one_form(p6_forms(spark, folder).select("entry_id", F.col("source").alias("s"), F.col("target").alias("t"), "source", "target"), ["entry_id", "s", "t"], ["source", "target"])
    return again.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("s").eqNullSafe(F.col("source")) | ~F.col("t").eqNullSafe(F.col("target"))).alias("n_changed"))


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.roundtrip(table(spark, folder, "documents"), "doc_id", "text").groupBy("same").agg(F.count("*").alias("n_docs"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sizes = tokens.token_counts(docs, "doc_id", "text")
    return containers.fill_all(sizes, "doc_id", "n_tokens", table(spark, folder, "container_spec"), partitions=containers.partitions_for(docs.count()))


def p8_loads(spark: SparkSession, folder: str) -> DataFrame:
    """The filling held against its rules: documents placed, pieces cut without need, containers over capacity, tokens lost."""
    docs, specs = table(spark, folder, "documents"), table(spark, folder, "container_spec")
    placed = p8_containers(spark, folder).withColumn("len", F.col("piece_to") - F.col("piece_from"))
    loads = placed.where("container_id IS NOT NULL").groupBy("spec_id", "container_id").agg(F.sum("len").alias("load")).join(specs, "spec_id")
    over = loads.groupBy("spec_id").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("n_over"), F.sum("load").alias("n_placed"))
    each = placed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("len").alias("n")).join(specs, "spec_id")
    cut = each.groupBy("spec_id").agg(F.count("*").alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("n_cut"))
    total = tokens.token_counts(docs, "doc_id", "text").agg(F.sum("n_tokens")).scalar()
    return specs.select("spec_id").join(over, "spec_id").join(cut, "spec_id").select("spec_id", "n_docs", "n_cut", "n_over", (total - F.col("n_placed")).alias("n_lost"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    kinds = quality.text_kinds(table(spark, folder, "documents"), "doc_id", "text", only=None)
    return kinds.where(F.col("kind") != "prose").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_kinds(table(spark, folder, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_sample, p1_batches, p3_found, p3_records, p4_found, p5_found, p5_report, p5_requests, p5_sample, p5_drawn, p6_found, p6_forms, p6_final, p6_classes, p7_ids, p7_roundtrip, p8_containers, p8_loads, p9_found, p9_statistics)}

_U1 = unit_interval_sql("source", "sample-1")
_FOLD = lambda c: rf"regexp_replace(replace(lower({c}), 'ß', 'ss'), '[\p{{P}}\p{{Z}}\s\x{{85}}]+', '', 'g')"
_RECORDS = f"SELECT entry_id, target_lang, least(a, b) AS x, greatest(a, b) AS y FROM (SELECT entry_id, target_lang, {_FOLD('source')} AS a, {_FOLD('target')} AS b FROM pack_entry WHERE target_lang IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL)"
_LABEL = lambda c: rf"lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_CATEGORISED = f"SELECT t.cat_id, p.entry_id FROM pack_entry p JOIN sample_target t ON {_LABEL('p.confidence')} = {_LABEL('t.confidence')} AND {_LABEL('p.part_of_speech')} = {_LABEL('t.part_of_speech')} AND coalesce(p.en_zipf, 0) >= t.zipf_lo AND coalesce(p.en_zipf, 0) < t.zipf_hi"

_END = r"""[.!?…:;,]["''»”“’)\]]*\s*$"""
_COLUMNS = r"regexp_matches(x, '^[^,;]*[^\s,;][,;][^\s,;][^,;]*[,;]([^ ]|$)') OR regexp_matches(x, '[^\s.!?,] {2,}[^\s,]\S*(?: \S+){0,6} {2,}[^\s,]') OR (regexp_matches(x, '[|│]|\+-|\+=') AND regexp_matches(x, '[|│][^|│]*[|│][^|│]*[|│]|^\s*[+|][-=+|:]{6,}')) OR regexp_matches(x, '\t[^\t]*\t')"
_AMONG = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words))) + ")"
_PER = lambda a, b: f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0::DOUBLE END"
_STATISTICS = rf"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?|[\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g') AS t FROM documents),
 b AS (SELECT doc_id, t, list_filter(string_split(lower(t), chr(10)), lambda x: regexp_matches(x, '[^\s\p{{Z}}\x{{85}}]')) AS ln, regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}]+') AS w FROM a),
 c AS (SELECT doc_id, t, ln, w, list_filter(ln, lambda x: {_COLUMNS}) AS cl, list_filter(ln, lambda x: len(regexp_split_to_array(x, '[^\p{{L}}\p{{M}}]+')) >= 5 AND len(list_filter(regexp_split_to_array(x, '[^\p{{L}}\p{{M}}]+'), lambda y: y IN {_AMONG(quality.CLAUSE)})) > 0) AS se FROM b),
 d AS (SELECT doc_id, length(t) AS chars, len(w) AS nw, length(array_to_string(w, '')) AS inw, length(regexp_replace(t, '[\s\p{{Z}}\x{{85}}]+', '', 'g')) AS ink, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS dig, length(regexp_replace(t, '[^aeiouyAEIOUYàâäáèéêëìíîïòóôöùúûü]+', '', 'g')) AS vow, strlen(t) - length(t) AS fo, len(ln) AS nl,
  len(list_filter(ln, lambda x: regexp_matches(x, '{_END}'))) AS en, len(list_filter(ln, lambda x: regexp_matches(x, '{_END.replace(":;,", "")}'))) AS st, len(list_filter(w, lambda x: x IN {_AMONG(quality.CLAUSE)})) AS cla, len(list_filter(w, lambda x: x IN {_AMONG(quality.LINK)})) AS lin, length(array_to_string(se, '')) AS sec, length(array_to_string(cl, '')) AS coc, length(array_to_string(ln, '')) AS lic, len(cl) AS nc,
  len(regexp_extract_all(t, '[;|•·│]')) AS un, len(regexp_extract_all(t, '[,;|•·│/]')) AS ma, len(regexp_extract_all(t, '[a-z][A-Z]')) AS br, len(list_distinct(w)) AS di, length(t) - length(regexp_replace(t, '<[^<>\n]*>', '', 'g')) AS ta FROM c),
 s AS (SELECT doc_id, CAST(CASE WHEN ink > 0 THEN chars ELSE 0 END AS DOUBLE) AS n_chars, CAST(nw AS DOUBLE) AS n_words, {_PER("inw", "nw")} AS mean_word_len, {_PER("(ink - inw - dig)", "ink")} AS symbol_ratio, {_PER("dig", "ink")} AS digit_ratio, {_PER("vow", "inw")} AS vowel_ratio, {_PER("fo", "ink")} AS foreign_ratio, {_PER("en", "nl")} AS end_punct_share, {_PER("st", "nl")} AS sentence_end_share, {_PER("(cla + lin)", "nw")} AS common_share, {_PER("cla", "nw")} AS clause_share, {_PER("lin", "nw")} AS link_share,
  {_PER("sec", "lic")} AS clause_line_share, {_PER("coc", "lic")} AS column_share, CAST(nc AS DOUBLE) AS column_lines, {_PER("nw", "nl")} AS line_words, {_PER("nw", "nl + un")} AS unit_words, {_PER("ma", "nw")} AS mark_words, {_PER("br", "nw")} AS case_breaks, CAST(di AS DOUBLE) AS distinct_words, {_PER("di", "nw")} AS distinct_share, {_PER("ta", "chars")} AS markup_share FROM d),
 k AS (SELECT *, {quality.kind_case(suffix="")} AS kind FROM s)"""

ORACLE: dict[str, str] = {
    "p1_sample": f"SELECT entry_id, target_lang, source, batch_no, {_U1} AS unit_key FROM pack_entry WHERE {_U1} < {RATE}",
    "p1_batches": f"SELECT batch_no, count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM pack_entry WHERE {_U1} < {RATE} GROUP BY batch_no",
    "p3_found": f"SELECT first_id, entry_id AS copy_id FROM (SELECT entry_id, min(entry_id) OVER (PARTITION BY target_lang, x, y) AS first_id FROM ({_RECORDS})) WHERE entry_id <> first_id",
    "p3_records": f"SELECT min(entry_id) AS first_id, count(*) AS copies FROM ({_RECORDS}) GROUP BY target_lang, x, y",
    "p4_found": "SELECT target_lang, source, rank_no, cand_id FROM (SELECT target_lang, source, cand_id, CAST(row_number() OVER (PARTITION BY target_lang, source ORDER BY CASE WHEN score = 0 THEN 0.0::DOUBLE ELSE score END DESC, target, cand_id) AS INTEGER) AS rank_no FROM candidate WHERE target_lang IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) WHERE rank_no <= 3",
    "p5_requests": f"WITH n AS (SELECT cat_id, count(*) AS n FROM ({_CATEGORISED}) GROUP BY cat_id) SELECT t.cat_id, coalesce(n.n, 0) AS available, greatest(CAST(round(t.sample_rows * t.target_share) AS BIGINT), t.min_rows) AS requested, greatest(0, greatest(CAST(round(t.sample_rows * t.target_share) AS BIGINT), t.min_rows) - coalesce(n.n, 0)) AS shortfall FROM sample_target t LEFT JOIN n USING (cat_id)",
    "p5_drawn": "SELECT cat_id, true AS right FROM sample_target",
    "p6_final": "SELECT count(*) AS n_rows, 0 AS n_changed FROM tail_entry",
    "p7_roundtrip": "SELECT true AS same, count(*) AS n_docs FROM documents",
    "p8_loads": "SELECT spec_id, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_cut, 0 AS n_over, 0 AS n_lost FROM container_spec",
    "p9_statistics": f"{_STATISTICS} SELECT * FROM k",
    "p9_found": f"{_STATISTICS} SELECT doc_id, kind FROM k WHERE kind <> 'prose'",
    "p5_found": f"WITH n AS (SELECT cat_id, count(*) AS n FROM ({_CATEGORISED}) GROUP BY cat_id) SELECT t.cat_id FROM sample_target t LEFT JOIN n USING (cat_id) WHERE coalesce(n.n, 0) < greatest(CAST(round(t.sample_rows * t.target_share) AS BIGINT), t.min_rows)",
}
