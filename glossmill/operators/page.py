"""Pages: candidates for replacement, their ranking under a density budget, phrase and range selection, rendering."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions import grammar, text
from glossmill.operators.lineage import written
from glossmill.operators.skew import hot_groups, salted_join

# Gates, weights and limits.
MEDIUM_OK_ZIPF = 5.0
CEILING = {"beginner": 7.5, "intermediate": 6.0, "advanced": 5.0}
ALPHA, BETA, GAMMA, MAX_RANK, DAY_MS, MAINTENANCE = 0.4, 0.3, 0.3, 10_000, 86_400_000, 0.1
MIN_NODE_WORDS, MIN_PAGE_WORDS = 3, 100
#: Words of an expression that are looked up at once.
HEAD = 3
#: Rows of the lexicon's side that are broadcast, words and heads of some tens of bytes; more are shuffled.
BROADCAST = 200_000
#: Parts of speech of single words, the first to be tried first.
ORDER = ("function", "noun", "verb", "adjective", "adverb")


def replaceable(eligible: Column, confidence: Column, zipf: Column) -> Column:
    """Exactly eligible, and of high confidence or not too frequent."""
    return eligible.eqNullSafe(True) & ((F.coalesce(confidence, F.lit("")) == "high") | (F.coalesce(zipf, F.lit(0.0)) < MEDIUM_OK_ZIPF))


def below_ceiling(zipf: Column, level: str | None) -> Column:
    return F.coalesce(zipf, F.lit(0.0)) < CEILING[level] if level else F.lit(True)


def standalone(target: Column) -> Column:
    t = F.trim(target)
    return (t != "") & ~t.startswith("-") & ~t.endswith("-")


def usable(entry: DataFrame, tail: bool = False) -> Column:
    """Whether an entry can be shown: confidence (tail entries aside), whole target, nouns with gender and whole plural."""
    sure = F.lit(True) if tail else F.coalesce(entry["confidence"].isin("high", "medium"), F.lit(False))
    noun = entry["part_of_speech"] != "noun"
    return sure & F.coalesce(standalone(entry["target"]), F.lit(False)) & F.coalesce(noun | (entry["gender"].isNotNull() & standalone(entry["plural"])), F.lit(False))


def score(rank: Column, seen: Column, last_seen_ms: Column, interval: Column, known: Column, graduated: Column, now_ms: int) -> Column:
    """0.4 frequency + 0.3 novelty + 0.3 overdue; 0 for known words, a tenth for graduated ones."""
    freq = F.greatest(F.lit(0.0), 1 - rank / F.lit(float(MAX_RANK)))
    late = F.when(interval == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(now_ms) - (last_seen_ms + interval * DAY_MS)) / float(DAY_MS))))
    raw = ALPHA * freq + BETA * (1 / (1 + seen)) + GAMMA * late
    return F.when(known, 0.0).when(graduated, raw * MAINTENANCE).otherwise(raw)


def matches(docs: DataFrame, lexicon: DataFrame, key: str, text_col: str, only: DataFrame | None = None) -> DataFrame:
    """Every place of the texts that the lexicon has: expressions of any length, and words in the forms they are met in.

    ``lexicon``: target_lang, key, part_of_speech, function_subtype, n_words, one row for each language and key. Columns: ``key``,
    target_lang, start, end, lemma, kind, n_words, ``made`` (1 where the word is an inflected form), token, back.
    Expressions have white space only between their words and may overlap here, see greedy_matches(); words with an apostrophe
    or hyphen are no words of the lexicon. ``only``: target_lang and lemma of the words to be told, all by default; which entry a form
    goes to is settled before.

    The texts are scanned once. A token meets the lexicon by itself and by the two and three words that begin with it; the
    rest of a longer expression is compared on the spot, with as many words ahead as the longest one has. The lexicon's
    side is counted first: up to BROADCAST rows are broadcast, beyond it both sides are shuffled, hot words salted.
    """
    expressions = lexicon.where("part_of_speech = 'expression'").select("target_lang", F.col("key").alias("lemma"), F.lit("expression").alias("kind"), "n_words", F.lit(0).alias("made"), F.substring_index("key", " ", HEAD).alias("__head"), F.least("n_words", F.lit(HEAD)).alias("__n"))
    met = surfaces(lexicon) if only is None else surfaces(lexicon).join(only, ["target_lang", "lemma"], "left_semi")
    words = met.select("target_lang", "lemma", "kind", F.lit(1).alias("n_words"), (F.col("surface") != F.col("lemma")).cast("int").alias("made"), F.col("surface").alias("__head"), F.lit(1).alias("__n"))
    heads = written(expressions.unionByName(words))
    size, longest = heads.agg(F.count("*"), F.max("n_words")).first()
    scanned = text.tokens(docs, key, text_col, max(1, (longest or 1) - 1)).withColumn("__low", F.lower("token"))
    grown = [F.struct(F.col("__low").alias("__head"), F.lit(1).alias("__n"))]
    for n in range(2, HEAD + 1):
        grown.append(F.when(F.size("ends") >= n - 1, F.struct(F.concat_ws(" ", "__low", F.substring_index("ahead", " ", n - 1)).alias("__head"), F.lit(n).alias("__n"))))
    each = scanned.select(key, "token", "__low", "start", "end", "ahead", "ends", "back", F.explode(F.array_compact(F.array(*grown))).alias("__g")).select("*", "__g.*").drop("__g")
    if size <= BROADCAST:
        met = each.join(F.broadcast(heads), ["__head", "__n"])
    else:
        met = salted_join(each, heads, ["__head", "__n"], hot_groups(each.groupBy("__head", "__n").agg(F.count("*").alias("n")), ["__head", "__n"], "n"), ["start", key])
    whole = (F.col("n_words") <= HEAD) | F.startswith(F.concat("__low", F.lit(" "), "ahead", F.lit(" ")), F.concat("lemma", F.lit(" ")))
    plain = (F.col("kind") == "expression") | ~F.col("token").rlike("['-]")
    stop = F.when(F.col("n_words") == 1, F.col("end")).otherwise(F.get("ends", F.col("n_words") - 2))
    return met.where(whole & plain).select(key, "target_lang", "start", stop.alias("end"), "lemma", "kind", "n_words", "made", "token", "back")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _from_left(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Positions of the ranges kept from left to right: each starts at or after the end of the one kept before."""

    def one(start, end) -> list[int]:
        out, cursor = [], 0
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
            if a >= cursor:
                out.append(i)
                cursor = b
        return out

    return pd.Series([one(a, b) for a, b in zip(starts, ends)], dtype=object)


def greedy_matches(found: DataFrame, keys: list[str]) -> DataFrame:
    """Expressions kept from left to right, the longest first at each start; one must start at or after the last end.

    ``found``: keys, start, end, lemma, n_words. The expressions of one text and language are kept as one array: acceptance
    depends on what was accepted before.
    """
    order = F.array_sort(F.collect_list(F.struct("start", (-F.col("n_words")).alias("__n"), "lemma", "end")))
    grouped = found.groupBy(*keys).agg(order.alias("__m"))
    kept = F.transform(_from_left(F.col("__m.start"), F.col("__m.end")), lambda i: F.get("__m", i))
    return grouped.select(*keys, F.explode(kept).alias("__x")).select(*keys, "__x.start", "__x.end", "__x.lemma", (-F.col("__x.__n")).alias("n_words"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _accepted(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Positions of the ranges that do not overlap one accepted before."""

    def one(start, end) -> list[int]:
        out, at, to = [], [], []
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
            k = bisect_left(at, b)  # accepted ranges that start before this one ends
            if k == 0 or to[k - 1] <= a:
                at.insert(k, a)
                to.insert(k, b)
                out.append(i)
        return out

    return pd.Series([one(a, b) for a, b in zip(starts, ends)], dtype=object)


def select_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Non-overlapping ranges: by priority, then start, length (longer first), end; empty ranges are left out.

    ``ranges``: keys, start, end, priority and payload columns. Ranges of a text are taken
    in order against those accepted so far, kept sorted, in n log n steps.
    """
    payload = [c for c in ranges.columns if c not in (*keys, "start", "end", "priority")]
    item = F.struct((-F.col("priority")).alias("__p"), "start", (F.col("start") - F.col("end")).alias("__l"), "end", *payload)
    grouped = ranges.where(F.col("end") > F.col("start")).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__r"))
    kept = _accepted(F.col("__r.start"), F.col("__r.end"))
    return grouped.select(*keys, F.explode(F.transform(kept, lambda i: F.get("__r", i))).alias("__x")).select(*keys, "__x.start", "__x.end", (-F.col("__x.__p")).alias("priority"), *[F.col(f"__x.{c}").alias(c) for c in payload])


def surfaces(lexicon: DataFrame) -> DataFrame:
    """target_lang, lemma, kind and the one-word ``surface`` under which a text holds it, each surface once for a language.

    A noun is met in every form whose singular it is, a verb in every form whose infinitive it is, by the rules of
    grammar.py; the other parts of speech as they are. A form that several entries have goes to the part of speech that
    comes first in ORDER. Determiners are met nowhere, and what is a pronoun is no noun. The rules are turned round on the
    lexicon, which is far smaller than the texts, and each surface is put through them again.
    """
    entries = lexicon.where(F.col("part_of_speech").isin(*ORDER) & (F.col("n_words") == 1) & ~((F.col("part_of_speech") == "function") & (F.coalesce("function_subtype", F.lit("")) == "determiner")))
    entries = entries.select("target_lang", F.col("key").alias("lemma"), F.col("part_of_speech").alias("kind"))
    k = F.col("lemma")
    cut = lambda n: grammar.drop_last(k, n)
    add = lambda *ends: [F.concat(k, F.lit(e)) for e in ends]
    irregular = F.filter(F.array(*[F.lit(w) for w in grammar.IRREGULAR]), lambda w: grammar.verb_lemma(w) == k)
    noun = F.filter(F.array(k, *add("s", "es"), F.concat(cut(1), F.lit("ies")), F.concat(cut(2), F.lit("ves"))), lambda w: grammar.singular(w) == k)
    verb = F.filter(F.concat(F.array(k, *add("s", "ing", "ed"), F.concat(cut(1), F.lit("ies")), F.concat(k, F.right(k, F.lit(1)), F.lit("ing"))), irregular), lambda w: grammar.verb_lemma(w) == k)
    met = F.when(F.col("kind") == "noun", noun).when(F.col("kind") == "verb", verb).otherwise(F.array(k))
    each = entries.select("target_lang", "lemma", "kind", F.explode(F.array_distinct(met)).alias("surface"))
    place = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("kind"))
    first = each.groupBy("target_lang", "surface").agg(F.min_by(F.struct("lemma", "kind"), F.struct(place, "lemma")).alias("__x"))
    return first.select("target_lang", "__x.lemma", "__x.kind", "surface").where(~((F.col("kind") == "noun") & (F.col("lemma").isin(grammar.PRONOUNS) | F.col("surface").isin(grammar.PRONOUNS))))


def shown(lexicon: DataFrame, level: str | None = "beginner") -> DataFrame:
    """target_lang and lemma of the entries that may replace a word for a reader of the level."""
    return lexicon.where(replaceable(F.col("eligible"), F.col("confidence"), F.col("en_zipf")) & below_ceiling(F.col("en_zipf"), level)).select("target_lang", F.col("key").alias("lemma"))


def candidates(found: DataFrame, kept: DataFrame, lexicon: DataFrame, key: str, level: str | None = "beginner") -> DataFrame:
    """First replaceable occurrence of each lemma in a text and language: ``key``, target_lang, lemma, start, end, kind.

    ``found``: the words that matches() gives; ``kept``: its greedy expressions; ``lexicon``: target_lang, key, eligible, confidence, en_zipf. Expressions come
    before single words; the first occurrence of an expression reserves its range, and words in a reserved range do not count.
    """
    keys = [key, "target_lang"]
    good = shown(lexicon, level)
    firsts = kept.join(good, ["target_lang", "lemma"]).groupBy(*keys, "lemma").agg(F.min(F.struct("start", "end")).alias("__f"))
    firsts = firsts.select(*keys, "lemma", "__f.start", "__f.end", F.lit("expression").alias("kind"))
    met = found.join(good, ["target_lang", "lemma"]).select(*keys, "lemma", "start", "end", "kind")
    taken = firsts.select(F.col(key).alias("__k"), F.col("target_lang").alias("__l"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    free = met.join(taken, (met[key] == F.col("__k")) & (met["target_lang"] == F.col("__l")) & (F.col("start") < F.col("__e")) & (F.col("end") > F.col("__s")), "left_anti")
    single = free.groupBy(*keys, "lemma").agg(F.min(F.struct("start", "end", "kind")).alias("__f")).select(*keys, "lemma", "__f.start", "__f.end", "__f.kind")
    return firsts.unionByName(single)


def _in_order(score: str) -> list[Column]:
    """Best score first; equal ones as they stand on the page, where expressions are read before words."""
    return [F.desc(score), F.col("kind") != "expression", F.col("start")]


def top_by_density(scored: DataFrame, keys: list[str], density: float) -> DataFrame:
    """The best floor(density * eligible) candidates of each text with a positive score; eligible counts them all. ``scored`` has score, kind, start."""
    counted = scored.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    ranked = counted.where("score > 0").withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*_in_order("score"))))
    return ranked.where(F.col("rn") <= F.floor(F.lit(density) * F.col("n")))


@F.pandas_udf(T.StructType([T.StructField("rendered", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType()))]))
def _pieced(texts: pd.Series, starts: pd.Series, ends: pd.Series, displays: pd.Series) -> pd.DataFrame:
    """Each text put together once from what stands between its ranges and what is shown in them, and where that stands."""
    out = []
    for t, a, b, d in zip(texts, starts, ends, displays):
        if t is None or a is None:
            out.append((t, []))
            continue
        parts, at, to, size = [], [], 0, 0
        for s, e, shown in zip(a.tolist(), b.tolist(), d.tolist()):
            between = t[to:s]
            at.append(size + len(between))
            size += len(between) + len(shown)
            parts += (between, shown)
            to = e
        out.append(("".join([*parts, t[to:]]), at))
    return pd.DataFrame(out, columns=["rendered", "starts"])


def render(docs: DataFrame, chosen: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Texts with the chosen ranges replaced: ``keys``, ``rendered``, ``spans``. Texts without ranges come out as they are.

    ``docs``: keys and the text; ``chosen``: keys, start, end, display; ranges of one text must not overlap. ``spans`` tells for each
    range where it now starts, what it shows and what stood there, in order of place; restore() takes it back.
    """
    grouped = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "display"))).alias("__r"))
    rows = docs.select(*keys, F.col(text_col).alias("__t")).join(grouped, keys, "left")
    rows = rows.withColumn("__p", _pieced(F.col("__t"), F.col("__r.start"), F.col("__r.end"), F.col("__r.display")))
    span = lambda r, i: F.struct(F.get("__p.starts", i).alias("start"), r["display"].alias("display"), F.substring("__t", r["start"] + 1, r["end"] - r["start"]).alias("original"))
    empty = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit("").alias("display"), F.lit("").alias("original"))), lambda x: F.lit(False))
    return rows.select(*keys, F.col("__p.rendered").alias("rendered"), F.coalesce(F.transform("__r", span), empty).alias("spans"))


@F.pandas_udf(T.StringType())
def _taken_back(texts: pd.Series, starts: pd.Series, displays: pd.Series, originals: pd.Series) -> pd.Series:
    out = []
    for t, a, d, o in zip(texts, starts, displays, originals):
        if t is None:
            out.append(None)
            continue
        parts, to = [], 0
        for s, shown, was in zip(a.tolist(), d.tolist(), o.tolist()):
            parts += (t[to:s], was)
            to = s + len(shown)
        out.append("".join([*parts, t[to:]]))
    return pd.Series(out, dtype=object)


def restore(rendered: DataFrame, keys: list[str]) -> DataFrame:
    """The texts that render() was given: ``keys``, ``restored``."""
    return rendered.select(*keys, _taken_back(F.col("rendered"), F.col("spans.start"), F.col("spans.display"), F.col("spans.original")).alias("restored"))


_ENDS = regex.compile(r"[.!?][ \t\n\x0b\f\r]+|\n+")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("sentence", T.StringType())])))
def _sentences(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """What stands at each range, and from the last sentence end before it to the next one after that."""
    out = []
    for t, a, b in zip(texts, starts, ends):
        cuts = [0, *(m.end() for m in _ENDS.finditer(t))]
        rows = []
        for s, e in zip(a.tolist(), b.tolist()):
            k = bisect_right(cuts, s) - 1  # white space after a mark may hold the place: it then belongs to the sentence it ends
            rows.append({"token": t[s:e], "sentence": t[cuts[k] : cuts[k + 1] if k + 1 < len(cuts) else len(t)]})
        out.append(rows)
    return pd.Series(out, dtype=object)


def contexts(docs: DataFrame, ranges: DataFrame, key: str, text_col: str) -> DataFrame:
    """The columns of ``ranges`` but at and end, with ``token`` and its ``context``, see text.sentence_context().

    The ends of a text's sentences are looked for once, however many ranges it has; its ranges come as one array.
    """
    rest = [c for c in ranges.columns if c not in (key, "at", "end")]
    grouped = ranges.groupBy(key, *rest).agg(F.collect_list(F.struct("at", "end")).alias("__r"))
    rows = grouped.join(docs.select(key, F.col(text_col).alias("__t")), key).withColumn("__s", F.explode(_sentences(F.col("__t"), F.col("__r.at"), F.col("__r.end"))))
    return rows.select(key, *rest, F.col("__s.token").alias("token"), text.cut_context(F.col("__s.sentence")).alias("context"))


def retain_ranks(scored: DataFrame, previous: str, keys: list[str]) -> DataFrame:
    """Ranks that survive a refresh: lemmas ranked before keep their order, new ones follow by score, then place on the page.

    ``scored``: keys, lemma, score, kind, start and the rank before in the column ``previous``, null if there was none; lemmas of score 0
    are left out unless ranked before. Lemmas that are no candidates any more lose their place.
    """
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(previous), *_in_order("score"))
    return scored.where((F.col("score") > 0) | F.col(previous).isNotNull()).withColumn("rn", F.row_number().over(order)).drop(previous)


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def label_text(separator: str, *parts: Column) -> Column:
    """The non-empty parts joined: accessible labels by comma, tooltips by line."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def is_dark(colour: Column) -> Column:
    """Whether an rgb() or rgba() colour is dark (luma under one half); null when it is too transparent to tell or no such colour."""
    rgb = r"^rgba?\(\s*(\d+)[,\s]+(\d+)[,\s]+(\d+)(?:[,/\s]+([\d.]+))?\s*\)$"
    part = lambda i: F.regexp_extract(colour, rgb, i)
    alpha = F.when(part(4) == "", 1.0).otherwise(F.try_to_number(part(4), F.lit("9.999")).cast("double"))
    luma = (0.2126 * part(1).try_cast("double") + 0.7152 * part(2).try_cast("double") + 0.0722 * part(3).try_cast("double")) / 255
    return F.when(colour.rlike(rgb) & (F.coalesce(alpha, F.lit(1.0)) > 0.2), luma < 0.5)
