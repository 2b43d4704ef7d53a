"""Learning state: spaced repetition, lifecycle, review queues, quizzes, density."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scheduler and lifecycle constants.
MIN_EASE, EASE, UP, DOWN, FIRST, SECOND = 1.3, 2.5, 0.1, 0.2, 1, 3
REVIEWING, MATURE, GRADUATED_AT, WINDOW, RECALL, HISTORY = 7, 21, 21, 3, 0.85, 10

STATE = [("srs_interval", T.LongType()), ("srs_ease", T.DoubleType()), ("srs_repetitions", T.IntegerType()), ("history", T.StringType())]


def step(state: tuple, correct: bool) -> tuple:
    """One graded answer: (interval, ease, repetitions, history) to the next. History is the last ten outcomes as 1 and 0."""
    interval, ease, reps, history = state
    history = (history + ("1" if correct else "0"))[-HISTORY:]
    if not correct:
        return FIRST, max(MIN_EASE, ease - DOWN), 0, history
    interval = FIRST if reps == 0 else SECOND if reps == 1 else int(interval * ease + 0.5)
    return interval, ease + UP, reps + 1, history


def lifecycle(interval: int, history: str) -> str:
    """graduated, mature, reviewing or learning."""
    recent = history[-WINDOW:]
    if interval >= GRADUATED_AT and len(recent) == WINDOW and recent.count("1") / WINDOW >= RECALL:
        return "graduated"
    return "mature" if interval > MATURE else "reviewing" if interval >= REVIEWING else "learning"


def fold_answers(answers: DataFrame, keys: list[str], ts: str, tie: str, correct: str, state: DataFrame | None = None) -> DataFrame:
    """State of each key after all its answers in time order: keys, STATE, ``last_reviewed`` and ``lifecycle``.

    The fold is sequential, so a key stays in one task, but as a stream: rows arrive sorted from a spilling sort and
    one state is held at a time, however many answers a key has. Null keys form a key; null outcomes count as wrong.
    ``state``: what an earlier fold gave; it goes on from there, and keys without answers come out as they are.
    """
    rows = answers.select(*keys, F.col(ts).alias("__ts"), F.col(tie).alias("__tie"), F.coalesce(F.col(correct), F.lit(False)).alias("__ok"), *[F.lit(None).cast(t).alias(c) for c, t in STATE])
    if state is not None:
        kept = state.select(*keys, F.col("last_reviewed").alias("__ts"), F.lit(None).cast(rows.schema["__tie"].dataType).alias("__tie"), F.lit(False).alias("__ok"), *[c for c, _ in STATE])
        rows = rows.unionByName(kept)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("history"), "__ts", "__tie")
    schema = T.StructType([*ordered.select(*keys).schema.fields, *[T.StructField(c, t) for c, t in STATE], T.StructField("last_reviewed", ordered.schema["__ts"].dataType), T.StructField("lifecycle", T.StringType())])
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, last, out, types = None, None, None, [], None

        def flush(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = [*types[:n], pa.int64(), pa.float64(), pa.int32(), pa.string(), types[n], pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)

        def row() -> tuple:
            return (*current, state[0], state[1], state[2], state[3], last, lifecycle(state[0], state[3]))

        for batch in batches:
            types = types or [batch.schema.field(i).type for i in range(n + 1)]
            cols = [c.to_pylist() for c in batch.columns]
            for *key, at, _, ok, interval, ease, reps, history in zip(*cols):
                if key != current:
                    if current is not None:
                        out.append(row())
                    current, state = key, (0, EASE, 0, "")
                state, last = step(state, ok) if history is None else (interval, ease, reps, history), at
            if len(out) > 10_000:
                yield flush(out)
                out = []
        if current is not None:
            out.append(row())
        if out:
            yield flush(out)

    return ordered.mapInArrow(fold, schema)


def recall_last3(history: Column) -> Column:
    """Share of right answers among the last three, null without answers."""
    recent = F.right(history, F.lit(WINDOW))
    return F.length(F.replace(recent, F.lit("0"), F.lit(""))) / F.nullif(F.length(recent), F.lit(0))


def exposures(events: DataFrame, keys: list[str]) -> DataFrame:
    """Times seen, last time seen, reveals, of each key."""
    return events.groupBy(*keys).agg(F.count_if(F.col("event_type").isin("view", "click")).alias("seen_count"), F.max(F.when(F.col("event_type").isin("view", "click"), F.col("ts"))).alias("last_seen"), F.count_if(F.col("event_type") == "click").alias("reveals"))


def saved_words(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys marked unknown now (an odd number of toggles), with the time of the mark."""
    toggles = events.where("event_type = 'signup'").groupBy(*keys).agg(F.count("*").alias("__n"), F.max("ts").alias("saved_at"))
    return toggles.where("__n % 2 = 1").drop("__n")


def marks(events: DataFrame, keys: list[str]) -> DataFrame:
    """What each key is marked as after its marks in time order: ``known``, ``unknown``, ``unknown_at``.

    ``events``: keys, ts, event_id, ``mark`` ('known', 'not_known', 'unknown', 'not_unknown'). A key is known or unknown or
    neither: either mark takes the other back. ``unknown_at`` is when the unknown mark was set, which marking it again does
    not move. Two aggregates with map-side combine, so a key may have any number of marks; other events do not count.
    """
    at = F.struct("ts", "event_id")
    last = lambda *kinds: F.max(F.when(F.col("mark").isin(*kinds), at))
    marked = events.where(F.col("mark").isin("known", "not_known", "unknown", "not_unknown"))
    ends = marked.groupBy(*keys).agg(last("known").alias("__k"), last("not_known", "unknown").alias("__nk"), last("not_unknown", "known").alias("__reset"), last("unknown").alias("__u"))
    after = lambda a, b: F.col(a).isNotNull() & F.coalesce(F.col(a) > F.col(b), F.lit(True))
    first = marked.where("mark = 'unknown'").join(ends.select(*keys, "__reset"), keys).where(F.col("__reset").isNull() | (at > F.col("__reset"))).groupBy(*keys).agg(F.min("ts").alias("unknown_at"))
    return ends.select(*keys, after("__k", "__nk").alias("known"), after("__u", "__reset").alias("unknown")).join(first, keys, "left")


def stepped(interval: Column, ease: Column, repetitions: Column, history: Column, correct: Column) -> dict[str, Column]:
    """The state after one more answer, as step() has it, as columns; null for a key without state counts as a new one."""
    i, e, r, h = F.coalesce(interval, F.lit(0)), F.coalesce(ease, F.lit(EASE)), F.coalesce(repetitions, F.lit(0)), F.coalesce(history, F.lit(""))
    grown = F.when(r == 0, FIRST).when(r == 1, SECOND).otherwise(F.floor(i * e + 0.5))
    return {
        "srs_interval": F.when(correct, grown).otherwise(FIRST).cast("bigint"),
        "srs_ease": F.when(correct, e + UP).otherwise(F.greatest(F.lit(MIN_EASE), e - DOWN)),
        "srs_repetitions": F.when(correct, r + 1).otherwise(0).cast("int"),
        "history": F.right(F.concat(h, F.when(correct, "1").otherwise("0")), F.lit(HISTORY)),
    }


def adjusted_density(density: Column, accuracy: Column, eligible: Column, reveals: Column) -> Column:
    """Density after a quiz: up to 0.02 up from 80 % right on (not with too many reveals), up to 0.02 down below 60 %."""
    up = F.when(reveals / eligible > 0.4, 0.0).otherwise(0.02 * (accuracy - 0.8) / 0.2)
    delta = F.when(accuracy >= 0.8, up).when(accuracy < 0.6, -0.02 * (0.6 - accuracy) / 0.6).otherwise(0.0)
    return F.when(eligible < 20, density).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), density + delta)))


def active_time(events: DataFrame, user: str, visible: Column, threshold_s: float, chunk: str = "day") -> DataFrame:
    """``user``, total visible seconds, and when they first reached the threshold.

    A visible event counts until the user's next event. The running sum is taken in chunks of time: sums of chunks
    first, then inside chunks from the sum before, so no task sorts all events of a user who has very many.
    """
    e = events.select(F.col(user).alias("__u"), "ts", "event_id", visible.alias("__v"), F.date_trunc(chunk, "ts").alias("__c"))
    heads = e.groupBy("__u", "__c").agg(F.min("ts").alias("__head"))
    following = heads.withColumn("__next", F.lead("__head").over(Window.partitionBy("__u").orderBy("__c"))).select("__u", "__c", "__next")
    inside = Window.partitionBy("__u", "__c").orderBy("ts", "event_id")
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    gap = (micros(F.coalesce(F.lead("ts").over(inside), F.col("__next"))) - micros(F.col("ts"))) / 1e6
    e = e.join(following, ["__u", "__c"]).withColumn("__s", F.when(F.col("__v"), F.coalesce(gap, F.lit(0.0))).otherwise(0.0))
    sums = e.groupBy("__u", "__c").agg(F.sum("__s").alias("__t"))
    before = F.sum("__t").over(Window.partitionBy("__u").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    offset = sums.select("__u", "__c", F.coalesce(before, F.lit(0.0)).alias("__o"))
    run = e.join(offset, ["__u", "__c"]).withColumn("__r", F.col("__o") + F.sum("__s").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(F.col("__u").alias(user)).agg(F.sum("__s").alias("visible_s"), F.min(F.when(F.col("__r") >= threshold_s, F.col("ts"))).alias("reached_at"))


def rendered_format(wanted: Column, holds_word: Column, has_target: Column | None = None) -> Column:
    """The quiz format that can be shown: contextual needs a sentence that holds the word, reverse a target, meaning nothing."""
    reverse = F.lit("reverse") if has_target is None else F.when(has_target, "reverse").otherwise("meaning")
    return F.when((wanted == "contextual") & holds_word, wanted).when(wanted.isin("contextual", "reverse"), reverse).otherwise("meaning")


def first_k_others(pool: DataFrame, user: str, item: str, order: str, k: int = 3) -> DataFrame:
    """For each item the first ``k`` other items of its user in the order, as an array ``others``.

    Only the first k + 1 items of a user can be among them, so the list is bounded before the join.
    """
    rank = F.row_number().over(Window.partitionBy(user).orderBy(order, item))
    heads = pool.select(user, item, order).withColumn("__r", rank).where(F.col("__r") <= k + 1)
    lists = heads.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("__r", F.col(item).alias("i")))).alias("__l"))
    return pool.join(lists, user).withColumn("others", F.slice(F.transform(F.filter("__l", lambda x: x["i"] != F.col(item)), lambda x: x["i"]), 1, k)).drop("__l")
