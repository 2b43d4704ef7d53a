"""Review queries over events: a user's events on one of 40 lemmas, which event_id gives. view and click are exposures
(click reveals), purchase a right answer, error a wrong one, signup toggles the unknown mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions.keys import unit_interval, unit_interval_sql
from glossmill.operators import review
from glossmill.plans.dictionary import lexicon_sql
from glossmill.operators.dictionary import lexicon
from glossmill.sources import sinks
from glossmill.sources.tables import table

LEMMAS = 40
# Words put in for each level, and how often they count as seen; kinds of marks.
LEVELS, PREPOPULATED = {"beginner": 300, "intermediate": 1500, "advanced": 3000}, 3
MARKS = ("known", "not_known", "unknown", "not_unknown")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("lemma", F.format_string("w%02d", F.pmod("event_id", F.lit(LEMMAS))))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).where("event_type IN ('purchase', 'error')").withColumn("right", F.col("event_type") == "purchase")


def sm2_state(spark: SparkSession, folder: str) -> DataFrame:
    s = review.fold_answers(_answers(spark, folder), ["user_id", "lemma"], "ts", "event_id", "right")
    return s.select("user_id", "lemma", "srs_interval", F.round("srs_ease", 6).alias("srs_ease"), "srs_repetitions", "history", "last_reviewed", "lifecycle")


def lifecycle_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sm2_state(spark, folder).groupBy("lifecycle").agg(F.count("*").alias("n_words"))


def recall_last3(spark: SparkSession, folder: str) -> DataFrame:
    return sm2_state(spark, folder).select("user_id", "lemma", F.round(review.recall_last3(F.col("history")), 6).alias("recall"))


def seen_stats(spark: SparkSession, folder: str) -> DataFrame:
    return review.exposures(events(spark, folder), ["user_id", "lemma"])


def learning_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct lemmas, reveals, reveal rate and words in learning of each user."""
    seen = seen_stats(spark, folder).where("seen_count > 0").groupBy("user_id").agg(F.count("*").alias("n_lemmas"), F.sum("reveals").alias("n_reveals"))
    learning = sm2_state(spark, folder).groupBy("user_id").agg(F.count_if(F.col("lifecycle") != "graduated").alias("n_learning"))
    both = seen.join(learning, "user_id", "left")
    return both.select("user_id", "n_lemmas", "n_reveals", F.round(F.col("n_reveals") / F.col("n_lemmas"), 6).alias("reveal_rate"), F.coalesce("n_learning", F.lit(0).cast("bigint")).alias("n_learning"))


def saved_words(spark: SparkSession, folder: str) -> DataFrame:
    return review.saved_words(events(spark, folder), ["user_id", "lemma"])


def mark_state(spark: SparkSession, folder: str) -> DataFrame:
    """Known and unknown marks. Signups mark here, their props say as what: known, taken back, unknown, taken back."""
    kinds = F.array(*[F.lit(x) for x in MARKS])
    e = events(spark, folder).where("event_type = 'signup'").withColumn("mark", F.get(kinds, F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(4))))
    return review.marks(e, ["user_id", "lemma"])


def learning_state(spark: SparkSession, folder: str) -> DataFrame:
    """All that is kept of a user's word: times and time seen, schedule, lifecycle, marks; a word that was only marked has no more."""
    seen = seen_stats(spark, folder).select("user_id", "lemma", "seen_count", "last_seen")
    answers = sm2_state(spark, folder).select("user_id", "lemma", "srs_interval", "lifecycle")
    both = seen.join(answers, ["user_id", "lemma"], "full").join(mark_state(spark, folder), ["user_id", "lemma"], "full")
    state = F.when(F.col("lifecycle").isNotNull(), F.col("lifecycle")).when((F.col("seen_count") > 0) | F.col("unknown"), "learning").otherwise("unseen")
    return both.select("user_id", "lemma", F.coalesce("seen_count", F.lit(0)).alias("seen_count"), "last_seen", F.coalesce("srs_interval", F.lit(0)).alias("srs_interval"), state.alias("lifecycle"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("unknown", F.lit(False)).alias("unknown"))


def _practiceable(spark: SparkSession, folder: str) -> DataFrame:
    """Words marked unknown, stalest first, that the Spanish core has a target for (lemmas stand for its keys by rank, see _export)."""
    last = sm2_state(spark, folder).select("user_id", "lemma", "srs_interval", "srs_ease", "srs_repetitions", "history", "last_reviewed")
    q = mark_state(spark, folder).where("unknown").join(_ranked_core(spark, folder).where("trim(target) <> ''").select("lemma", "target"), "lemma").join(last, ["user_id", "lemma"], "left")
    stale = F.greatest("unknown_at", F.coalesce("last_reviewed", "unknown_at"))
    return q.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(stale, "unknown_at", F.collate("lemma", "UNICODE"))))


def practiceable_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _practiceable(spark, folder).groupBy("user_id").agg(F.count("*").alias("n_practiceable"))


def practice_graded(spark: SparkSession, folder: str) -> DataFrame:
    """State after a batch of ten is graded; what stands in for the user's grade is that words at odd places were known."""
    b = _practiceable(spark, folder).where("place <= 10")
    new = review.stepped(*[F.col(c) for c in ("srs_interval", "srs_ease", "srs_repetitions", "history")], F.col("place") % 2 == 1)
    return b.select("user_id", "place", "lemma", "target", *[(F.round(c, 6) if k == "srs_ease" else c).alias(k) for k, c in new.items()])


def saved_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Words marked unknown as the list shows them: the latest mark first."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("unknown_at"), F.collate("lemma", "UNICODE")))
    return mark_state(spark, folder).where("unknown").select("user_id", place.alias("place"), "lemma", "unknown_at")


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Saved words, stalest first: by the later of review and save, then save, then lemma; a user has at most 40."""
    last = sm2_state(spark, folder).select("user_id", "lemma", "last_reviewed")
    q = saved_words(spark, folder).join(last, ["user_id", "lemma"], "left").withColumn("stale", F.greatest("saved_at", F.coalesce("last_reviewed", "saved_at")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("stale", "saved_at", F.collate("lemma", "UNICODE")))
    return q.select("user_id", place.alias("place"), "lemma", "saved_at")


def practice_batch(spark: SparkSession, folder: str) -> DataFrame:
    return review_queue(spark, folder).where("place <= 10").select("user_id", "place", "lemma")


def density_after_quiz(spark: SparkSession, folder: str) -> DataFrame:
    quiz = _answers(spark, folder).groupBy("user_id").agg(F.avg(F.col("right").cast("double")).alias("accuracy"))
    both = learning_stats(spark, folder).join(quiz, "user_id")
    new = review.adjusted_density(F.lit(0.15), F.col("accuracy"), F.col("n_lemmas"), F.col("n_reveals"))
    return both.select("user_id", F.round("accuracy", 6).alias("accuracy"), F.round(new, 6).alias("density"))


def active_time(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    a = review.active_time(e, "user_id", F.col("event_type").isin("view", "click"), 100_000.0)
    return a.select("user_id", F.round("visible_s", 3).alias("visible_s"), "reached_at")


def mutation_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of a user's events with gaps under six hours, as a trailing debounce would flush them."""
    s = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_types"), F.max("ts").alias("last_ts"))
    return s.select("user_id", F.col("w.start").alias("started"), "last_ts", "n_events", "n_types")


def throttle_last(spark: SparkSession, folder: str) -> DataFrame:
    """The last value of each user in each hour, as a trailing throttle keeps it."""
    w = table(spark, folder, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return w.select("user_id", "hour", "value")


def setting_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose type differs from the user's event before, in chunks of days as in active_time."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", F.date_trunc("day", "ts").alias("day"))
    tails = e.groupBy("user_id", "day").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("tail"))
    before = tails.select("user_id", "day", F.lag("tail").over(Window.partitionBy("user_id").orderBy("day")).alias("before"))
    prev = F.coalesce(F.lag("event_type").over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")), F.col("before"))
    return e.join(before, ["user_id", "day"]).withColumn("prev", prev).where("prev IS NOT NULL AND prev <> event_type").groupBy("prev", "event_type").agg(F.count("*").alias("n_changes"))


def exposure_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Stored counts overlaid by the dirty keys of the second half of the month: only those keys change."""
    e = events(spark, folder)
    stored = review.exposures(e.where("ts < TIMESTAMP '2024-01-16'"), ["user_id", "lemma"])
    dirty = review.exposures(e.where("ts >= TIMESTAMP '2024-01-16' AND event_type = 'view'"), ["user_id", "lemma"])
    return sinks.upsert(stored, dirty, ["user_id", "lemma"]).select("user_id", "lemma", "seen_count")


def prepopulate(spark: SparkSession, folder: str) -> DataFrame:
    """For each level the words put in with 3 exposures for each user: the most frequent of the Spanish core their state lacks.

    A user's words stand for core keys by rank, see _export; what a user saw, answered or marked is in their state.
    """
    most = max(LEVELS.values())
    ranked = lexicon(table(spark, folder, "pack_entry")).where("target_lang = 'es' AND part_of_speech <> 'expression'").select("key", "frequency_rank", "entry_id").orderBy("frequency_rank", "entry_id").limit(most)
    ranked = ranked.withColumn("rn", F.row_number().over(Window.orderBy("frequency_rank", "entry_id"))).select("rn", "key")
    users = table(spark, folder, "events").select("user_id").where("user_id IS NOT NULL").distinct()
    known = events(spark, folder).select("user_id", "lemma").distinct().join(_ranked_core(spark, folder).select("lemma", "key"), "lemma").join(ranked, "key")
    has = users.join(known.groupBy("user_id").agg(F.collect_set("rn").alias("has")), "user_id", "left").withColumn("has", F.coalesce("has", F.array().cast("array<int>")))
    each = has.select("user_id", "has", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(n).alias("most")) for k, n in LEVELS.items()])).alias("l")).select("user_id", "has", "l.*").withColumn("most", F.least("most", ranked.agg(F.count("*")).scalar().cast("int")))
    free = F.get(F.filter(F.sequence(F.lit(1), F.size("has") + 1), lambda i: ~F.array_contains("has", i)), F.lit(0))
    n = F.col("most") - F.size(F.filter("has", lambda i: i <= F.col("most")))
    counted = each.select("level", "user_id", n.cast("bigint").alias("n_words"), free.alias("rn")).where("n_words > 0")
    return counted.join(F.broadcast(ranked), "rn").select("level", "user_id", "n_words", F.col("key").alias("first_word"), (F.col("n_words") * PREPOPULATED).alias("n_seen"))


def quiz_pool(spark: SparkSession, folder: str) -> DataFrame:
    """For each user the seven lemmas seen last, each with the event that has a context (a click), else its first."""
    v = events(spark, folder).where("event_type IN ('view', 'click')")
    one = v.groupBy("user_id", "lemma").agg(F.min_by(F.struct("event_id", "ts"), F.struct(F.col("event_type") != "click", "ts", "event_id")).alias("x"), F.count("*").alias("n_seen"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("x.ts"), "lemma"))
    return one.withColumn("place", rank).where("place <= 7").select("user_id", "place", "lemma", "x.event_id", "n_seen")


def quiz_format(spark: SparkSession, folder: str) -> DataFrame:
    """Contextual where the sentence was kept (clicks) and holds the word, else reverse from two sightings on, else meaning.

    Whether a kept sentence holds the word is drawn by the event's value here; where it does not, the next format is tried.
    """
    p = quiz_pool(spark, folder).join(table(spark, folder, "events").select("event_id", "event_type", "value"), "event_id")
    wanted = F.when(F.col("event_type") == "click", "contextual").when(F.col("n_seen") >= 2, "reverse").otherwise("meaning")
    return p.select("user_id", "lemma", wanted.alias("format"), review.rendered_format(wanted, F.col("value") >= 5).alias("shown"))


def quiz_words(spark: SparkSession, folder: str) -> DataFrame:
    """Two or three words of each pool in a drawn order; number and order come from a salted hash in place of chance."""
    pool = quiz_pool(spark, folder).withColumn("u", unit_interval(F.concat_ws("|", "user_id", "lemma"), "quiz-1"))
    many = 2 + F.floor(unit_interval(F.col("user_id"), "quiz-2") * 2)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("u", "lemma"))
    return pool.withColumn("asked", place).where(F.col("asked") <= many).select("user_id", "asked", "lemma")


def quiz_options(spark: SparkSession, folder: str) -> DataFrame:
    """The right lemma and three others of the user's pool, filled up from the most frequent Spanish keys, in a drawn order."""
    pool = quiz_pool(spark, folder).select("user_id", "lemma", "place")
    fill = lexicon(table(spark, folder, "pack_entry")).where("target_lang = 'es' AND part_of_speech <> 'expression'").orderBy("frequency_rank", "entry_id").limit(3)
    filled = fill.agg(F.array_sort(F.collect_list(F.struct("frequency_rank", "entry_id", "key")))).scalar()
    got = review.first_k_others(pool, "user_id", "lemma", "place").withColumn("__f", filled)
    four = F.slice(F.array_distinct(F.concat(F.array("lemma"), "others", F.transform("__f", lambda x: x["key"]))), 1, 4)
    drawn = F.transform(four, lambda x: F.struct(F.md5(F.concat_ws("|", F.lit("quiz-3"), F.col("user_id").cast("string"), "lemma", x)).alias("u"), x.alias("x")))
    return got.select("user_id", "lemma", F.array_join(F.transform(F.array_sort(drawn), lambda x: x["x"]), "|").alias("options"))


def _ranked_core(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent entries of the Spanish core under the lemmas of the events: w00 is the first."""
    core = lexicon(table(spark, folder, "pack_entry")).where("target_lang = 'es'").orderBy("frequency_rank", "entry_id").limit(LEMMAS)
    return core.withColumn("lemma", F.format_string("w%02d", F.row_number().over(Window.orderBy("frequency_rank", "entry_id")) - 1))


def _export(spark: SparkSession, folder: str) -> DataFrame:
    """Saved lemmas matched to the Spanish core by rank: w00 is the most frequent entry, w01 the next."""
    return saved_words(spark, folder).join(_ranked_core(spark, folder).select("lemma", "key", "target", "part_of_speech", "source_gloss", "gender", "plural"), "lemma", "left")


def export_csv(spark: SparkSession, folder: str) -> DataFrame:
    e = _export(spark, folder)
    return e.select("user_id", "lemma", sinks.csv_line(["lemma", "target", "part_of_speech", "source_gloss", "gender", "plural"], "saved_at", noun_only=("gender", "plural")).alias("line"))


def export_tsv(spark: SparkSession, folder: str) -> DataFrame:
    e = _export(spark, folder)
    return e.select("user_id", "lemma", sinks.tsv_line("lemma", "target", "source_gloss").alias("line"))


QUERIES = {f.__name__: f for f in (sm2_state, lifecycle_counts, recall_last3, seen_stats, learning_stats, saved_words, review_queue, practice_batch, density_after_quiz, active_time, mutation_sessions, throttle_last, setting_changes, exposure_upsert, prepopulate, mark_state, learning_state, practiceable_counts, practice_graded, saved_latest, quiz_pool, quiz_format, quiz_words, quiz_options, export_csv, export_tsv)}

_EV = f"ev AS (SELECT *, printf('w%02d', event_id % {LEMMAS}) AS lemma FROM events)"
_FOLD = """an AS (SELECT user_id, lemma, ts, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id, lemma ORDER BY ts, event_id) AS k FROM ev WHERE event_type IN ('purchase', 'error')),
 fo AS (SELECT user_id, lemma, ts, k, CAST(1 AS BIGINT) AS i, CASE WHEN ok THEN 2.5::DOUBLE + 0.1::DOUBLE ELSE 2.5::DOUBLE - 0.2::DOUBLE END AS e, CASE WHEN ok THEN 1 ELSE 0 END AS r, CASE WHEN ok THEN '1' ELSE '0' END AS h FROM an WHERE k = 1
 UNION ALL SELECT a.user_id, a.lemma, a.ts, a.k, CASE WHEN NOT ok OR f.r = 0 THEN 1 WHEN f.r = 1 THEN 3 ELSE CAST(floor(f.i * f.e + 0.5) AS BIGINT) END, CASE WHEN ok THEN f.e + 0.1::DOUBLE ELSE greatest(1.3::DOUBLE, f.e - 0.2::DOUBLE) END, CASE WHEN ok THEN f.r + 1 ELSE 0 END, right(f.h || CASE WHEN ok THEN '1' ELSE '0' END, 10) FROM fo f JOIN an a ON a.user_id = f.user_id AND a.lemma = f.lemma AND a.k = f.k + 1),
 st AS (SELECT user_id, lemma, i AS srs_interval, round(e, 6) AS srs_ease, CAST(r AS INTEGER) AS srs_repetitions, h AS history, ts AS last_reviewed, CASE WHEN i >= 21 AND right(h, 3) = '111' THEN 'graduated' WHEN i > 21 THEN 'mature' WHEN i >= 7 THEN 'reviewing' ELSE 'learning' END AS lifecycle FROM fo QUALIFY row_number() OVER (PARTITION BY user_id, lemma ORDER BY k DESC) = 1)"""
_SEEN = "se AS (SELECT user_id, lemma, count(*) FILTER (event_type IN ('view', 'click')) AS seen_count, max(ts) FILTER (event_type IN ('view', 'click')) AS last_seen, count(*) FILTER (event_type = 'click') AS reveals FROM ev GROUP BY user_id, lemma)"
_LEARN = "le AS (SELECT a.user_id, a.n_lemmas, a.n_reveals, round(a.n_reveals / a.n_lemmas, 6) AS reveal_rate, coalesce(b.n, 0) AS n_learning FROM (SELECT user_id, count(*) AS n_lemmas, CAST(sum(reveals) AS BIGINT) AS n_reveals FROM se WHERE seen_count > 0 GROUP BY user_id) a LEFT JOIN (SELECT user_id, count(*) FILTER (lifecycle <> 'graduated') AS n FROM st GROUP BY user_id) b USING (user_id))"
_SAVED = "sv AS (SELECT user_id, lemma, max(ts) AS saved_at FROM ev WHERE event_type = 'signup' GROUP BY user_id, lemma HAVING count(*) % 2 = 1)"
_QUEUE = "qu AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY greatest(saved_at, coalesce(last_reviewed, saved_at)), saved_at, lemma) AS INTEGER) AS place, lemma, saved_at FROM sv LEFT JOIN st USING (user_id, lemma))"
_MARK = "mk AS (SELECT user_id, lemma, ts, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS m, row_number() OVER (PARTITION BY user_id, lemma ORDER BY ts, event_id) AS k FROM ev WHERE event_type = 'signup' AND json_extract_string(props, '$.k') IS NOT NULL), ms AS (SELECT user_id, lemma, kn AND NOT coalesce(kl > kk, false) AS known, un AND NOT coalesce(rl > ul, false) AS unknown, (SELECT min(ts) FROM mk b WHERE b.user_id = a.user_id AND b.lemma = a.lemma AND m = 2 AND k > coalesce(a.rl, 0)) AS unknown_at FROM (SELECT user_id, lemma, bool_or(m = 0) AS kn, max(k) FILTER (m = 0) AS kk, max(k) FILTER (m IN (1, 2)) AS kl, bool_or(m = 2) AS un, max(k) FILTER (m = 2) AS ul, max(k) FILTER (m IN (0, 3)) AS rl FROM mk GROUP BY user_id, lemma) a)"
_STATE = "ls AS (SELECT user_id, lemma, coalesce(seen_count, 0) AS seen_count, last_seen, coalesce(srs_interval, 0) AS srs_interval, CASE WHEN lifecycle IS NOT NULL THEN lifecycle WHEN coalesce(seen_count, 0) > 0 OR coalesce(unknown, false) THEN 'learning' ELSE 'unseen' END AS lifecycle, coalesce(known, false) AS known, coalesce(unknown, false) AS unknown FROM se FULL JOIN st USING (user_id, lemma) FULL JOIN ms USING (user_id, lemma))"
_CORE = f"rc AS (SELECT printf('w%02d', row_number() OVER (ORDER BY frequency_rank, entry_id) - 1) AS lemma, key, target FROM {lexicon_sql('pack_entry')} WHERE target_lang = 'es' ORDER BY frequency_rank, entry_id LIMIT {LEMMAS})"
_PRACTICE = "pq AS (SELECT ms.user_id, ms.lemma, target, srs_interval, srs_ease, srs_repetitions, history, CAST(row_number() OVER (PARTITION BY ms.user_id ORDER BY greatest(unknown_at, coalesce(last_reviewed, unknown_at)), unknown_at, ms.lemma) AS INTEGER) AS place FROM ms JOIN rc USING (lemma) LEFT JOIN st ON st.user_id = ms.user_id AND st.lemma = ms.lemma WHERE unknown AND trim(target) <> '')"
_POOL = "po AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, lemma) AS INTEGER) AS place FROM (SELECT user_id, lemma, event_id, ts, event_type, count(*) OVER (PARTITION BY user_id, lemma) AS n_seen, row_number() OVER (PARTITION BY user_id, lemma ORDER BY event_type <> 'click', ts, event_id) AS k FROM ev WHERE event_type IN ('view', 'click')) WHERE k = 1) WHERE place <= 7)"
_EXP = f"ex AS (SELECT sv.*, c.* EXCLUDE (lemma) FROM sv LEFT JOIN (SELECT printf('w%02d', row_number() OVER (ORDER BY frequency_rank, entry_id) - 1) AS lemma, target, part_of_speech, source_gloss, gender, plural FROM {lexicon_sql('pack_entry')} WHERE target_lang = 'es' ORDER BY frequency_rank, entry_id LIMIT {LEMMAS}) c ON c.lemma = sv.lemma)"
_Q = lambda c: f"'\"' || replace(coalesce({c}, ''), '\"', '\"\"') || '\"'"
_TS = "strftime(saved_at, '%Y-%m-%dT%H:%M:%S.') || substr(strftime(saved_at, '%f'), 1, 3) || 'Z'"

ORACLE = {
    "sm2_state": f"WITH RECURSIVE {_EV}, {_FOLD} SELECT * FROM st",
    "lifecycle_counts": f"WITH RECURSIVE {_EV}, {_FOLD} SELECT lifecycle, count(*) AS n_words FROM st GROUP BY lifecycle",
    "recall_last3": f"WITH RECURSIVE {_EV}, {_FOLD} SELECT user_id, lemma, round(length(replace(right(history, 3), '0', '')) / least(3, length(history)), 6) AS recall FROM st",
    "seen_stats": f"WITH {_EV}, {_SEEN} SELECT * FROM se",
    "learning_stats": f"WITH RECURSIVE {_EV}, {_FOLD}, {_SEEN}, {_LEARN} SELECT * FROM le",
    "saved_words": f"WITH {_EV}, {_SAVED} SELECT * FROM sv",
    "review_queue": f"WITH RECURSIVE {_EV}, {_FOLD}, {_SAVED}, {_QUEUE} SELECT * FROM qu",
    "practice_batch": f"WITH RECURSIVE {_EV}, {_FOLD}, {_SAVED}, {_QUEUE} SELECT user_id, place, lemma FROM qu WHERE place <= 10",
    "density_after_quiz": f"WITH RECURSIVE {_EV}, {_FOLD}, {_SEEN}, {_LEARN}, ac AS (SELECT user_id, avg(CAST(event_type = 'purchase' AS INTEGER)) AS a FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY user_id) SELECT user_id, round(a, 6) AS accuracy, round(CASE WHEN n_lemmas < 20 THEN 0.15::DOUBLE ELSE least(1::DOUBLE, greatest(0::DOUBLE, 0.15::DOUBLE + CASE WHEN a >= 0.8 THEN (CASE WHEN n_reveals / n_lemmas > 0.4 THEN 0::DOUBLE ELSE 0.02::DOUBLE * (a - 0.8::DOUBLE) / 0.2::DOUBLE END) WHEN a < 0.6 THEN -0.02::DOUBLE * (0.6::DOUBLE - a) / 0.6::DOUBLE ELSE 0::DOUBLE END)) END, 6) AS density FROM le JOIN ac USING (user_id)",
    "active_time": "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN coalesce((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6, 0) ELSE 0 END AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM g) SELECT user_id, round(sum(s), 3) AS visible_s, min(ts) FILTER (c >= 100000) AS reached_at FROM r GROUP BY user_id",
    "mutation_sessions": "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS started, max(ts) AS last_ts, count(*) AS n_events, count(DISTINCT event_type) AS n_types FROM c GROUP BY user_id, s",
    "throttle_last": "SELECT user_id, date_trunc('hour', ts) AS hour, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
    "setting_changes": "SELECT prev, event_type, count(*) AS n_changes FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev <> event_type GROUP BY prev, event_type",
    "exposure_upsert": f"WITH {_EV}, s AS (SELECT user_id, lemma, count(*) FILTER (event_type IN ('view', 'click')) AS seen_count FROM ev WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), n AS (SELECT user_id, lemma, count(*) AS seen_count FROM ev WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'view' GROUP BY ALL) SELECT coalesce(n.user_id, s.user_id) AS user_id, coalesce(n.lemma, s.lemma) AS lemma, coalesce(n.seen_count, s.seen_count) AS seen_count FROM s FULL JOIN n ON n.user_id = s.user_id AND n.lemma = s.lemma",
    "prepopulate": f"WITH {_EV}, {_CORE}, tp AS (SELECT key, CAST(row_number() OVER (ORDER BY frequency_rank, entry_id) AS INTEGER) AS rn FROM {lexicon_sql('pack_entry')} WHERE target_lang = 'es' AND part_of_speech <> 'expression' QUALIFY rn <= {max(LEVELS.values())}), lv(level, most) AS (VALUES {', '.join(map(str, LEVELS.items()))}), us AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL), kn AS (SELECT DISTINCT user_id, key FROM ev JOIN rc USING (lemma)) SELECT level, user_id, count(*) AS n_words, arg_min(key, rn) AS first_word, count(*) * {PREPOPULATED} AS n_seen FROM us, tp, lv WHERE rn <= most AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.user_id = us.user_id AND kn.key = tp.key) GROUP BY level, user_id",
    "mark_state": f"WITH {_EV}, {_MARK} SELECT * FROM ms",
    "learning_state": f"WITH RECURSIVE {_EV}, {_FOLD}, {_SEEN}, {_MARK}, {_STATE} SELECT * FROM ls",
    "practiceable_counts": f"WITH RECURSIVE {_EV}, {_FOLD}, {_MARK}, {_CORE}, {_PRACTICE} SELECT user_id, count(*) AS n_practiceable FROM pq GROUP BY user_id",
    "practice_graded": f"WITH RECURSIVE {_EV}, {_FOLD}, {_MARK}, {_CORE}, {_PRACTICE}, x AS (SELECT user_id, place, lemma, target, coalesce(srs_interval, 0) AS i, coalesce(srs_ease, 2.5::DOUBLE) AS e, coalesce(srs_repetitions, 0) AS r, coalesce(history, '') AS h, place % 2 = 1 AS ok FROM pq WHERE place <= 10) SELECT user_id, place, lemma, target, CAST(CASE WHEN NOT ok OR r = 0 THEN 1 WHEN r = 1 THEN 3 ELSE floor(i * e + 0.5) END AS BIGINT) AS srs_interval, round(CASE WHEN ok THEN e + 0.1::DOUBLE ELSE greatest(1.3::DOUBLE, e - 0.2::DOUBLE) END, 6) AS srs_ease, CAST(CASE WHEN ok THEN r + 1 ELSE 0 END AS INTEGER) AS srs_repetitions, right(h || CASE WHEN ok THEN '1' ELSE '0' END, 10) AS history FROM x",
    "saved_latest": f"WITH {_EV}, {_MARK} SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY unknown_at DESC, lemma) AS INTEGER) AS place, lemma, unknown_at FROM ms WHERE unknown",
    "quiz_words": f"WITH {_EV}, {_POOL} SELECT user_id, asked, lemma FROM (SELECT user_id, lemma, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {unit_interval_sql("user_id || '|' || lemma", 'quiz-1')}, lemma) AS INTEGER) AS asked FROM po) WHERE asked <= 2 + floor({unit_interval_sql('user_id', 'quiz-2')} * 2)",
    "quiz_pool": f"WITH {_EV}, {_POOL} SELECT user_id, place, lemma, event_id, n_seen FROM po",
    "quiz_format": f"WITH {_EV}, {_POOL} SELECT user_id, lemma, CASE WHEN event_type = 'click' THEN 'contextual' WHEN n_seen >= 2 THEN 'reverse' ELSE 'meaning' END AS format, CASE WHEN event_type = 'click' THEN (CASE WHEN value >= 5 THEN 'contextual' ELSE 'reverse' END) WHEN n_seen >= 2 THEN 'reverse' ELSE 'meaning' END AS shown FROM po JOIN (SELECT event_id, value FROM events) USING (event_id)",
    "quiz_options": f"WITH {_EV}, {_POOL}, fl AS (SELECT list(key ORDER BY frequency_rank, entry_id) AS f FROM (SELECT * FROM {lexicon_sql('pack_entry')} WHERE target_lang = 'es' AND part_of_speech <> 'expression' ORDER BY frequency_rank, entry_id LIMIT 3)), ot AS (SELECT p.user_id, p.lemma, list(q.lemma ORDER BY q.place) FILTER (q.lemma IS NOT NULL) AS o FROM po p LEFT JOIN po q ON p.user_id = q.user_id AND p.lemma <> q.lemma GROUP BY ALL) SELECT user_id, lemma, (SELECT string_agg(x, '|' ORDER BY md5('quiz-3|' || user_id || '|' || lemma || '|' || x)) FROM (SELECT unnest(list_concat([lemma], list_slice(coalesce(o, []), 1, 3), f)[1:4]) AS x)) AS options FROM ot, fl",
    "export_csv": f"WITH {_EV}, {_SAVED}, {_EXP} SELECT user_id, lemma, {_Q('lemma')} || ',' || {_Q('target')} || ',' || {_Q('part_of_speech')} || ',' || {_Q('source_gloss')} || ',' || {_Q('CASE WHEN part_of_speech = ' + chr(39) + 'noun' + chr(39) + ' THEN gender END')} || ',' || {_Q('CASE WHEN part_of_speech = ' + chr(39) + 'noun' + chr(39) + ' THEN plural END')} || ',' || {_Q(_TS)} AS line FROM ex",
    "export_tsv": rf"WITH {_EV}, {_SAVED}, {_EXP} SELECT user_id, lemma, regexp_replace(coalesce(nullif(target, ''), lemma), '\t|\r?\n', ' ', 'g') || chr(9) || regexp_replace(CASE WHEN coalesce(source_gloss, '') <> '' THEN lemma || ' - ' || source_gloss ELSE lemma END, '\t|\r?\n', ' ', 'g') AS line FROM ex",
}
