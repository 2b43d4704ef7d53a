"""Per-document text quality statistics, and an ordered rule list learned on labelled documents.

Statistics are Spark expressions over whole texts. Rules are induced by incremental reduced-error pruning
(``train_quality.py``), kept as thresholds in ``quality_rules.json`` and applied as one SQL CASE expression: no Python
runs in a query.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache, reduce
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent words of the five languages. Clause words stand in sentences; link words stand in phrases too.
CLAUSE = (
    "is are was were be been has have had will would could should can may must do does did you it he she they we this that which who what when where why how if so because yet them most people about only before after all again already nobody someone everyone your my his her their its there then than once "
    "es está son era fue hay ha se que qué cuando aunque pero porque si quién nadie no después cada está esta este ya tan como cómo me te "
    "ist sind war wird waren hat haben wer wo weil wenn obwohl niemand es er sie wir ich man noch steht sehr jedes jeden nur will kann gibt "
    "est sont était ont qui que quand bien parce où il elle on nous vous je ne pas si même personne ce cet cette après "
    "è sono era ha hanno che quando perché se chi dove dov'è c'è nessuno questa questo si anche ma ogni così"
).split()
LINK = (
    "the a an not but of to in on at for and or with by from as "
    "el la los las un una de del y o en con por para al "
    "der die das den dem des ein eine einen einem einer und oder von mit in im zu zum zur auf über "
    "le les une du et ou dans avec pour sur par au aux d l "
    "il lo gli i uno di dei della del e nel con per su da al un'"
).split()

#: White space of any kind; a text or line of nothing else is blank.
_BLANK = r"\s\p{Z}\x{85}"
_END = r"[.!?…:;,][\"'»”“’)\]]*\s*$"
_SENTENCE_END = r"[.!?…][\"'»”“’)\]]*\s*$"
#: A line of three or more columns: by tabs, bars, wide spaces, commas and semicolons without a space around, rulers.
_BARS = r"[|│][^|│]*[|│][^|│]*[|│]|^\s*[+|][-=+|:]{6,}"
_WIDE = r"[^\s.!?,] {2,}[^\s,]\S*(?: \S+){0,6} {2,}[^\s,]"
_COMMAS = r"^[^,;]++(?<=\S)[,;][^\s,;][^,;]*+[,;](?! )"


def columns(x: Column) -> Column:
    """Whether a line has three or more columns; plain searches keep the patterns off most lines."""
    return x.rlike(_COMMAS) | (x.contains("  ") & x.rlike(_WIDE)) | ((x.contains("|") | x.contains("│") | x.contains("+-") | x.contains("+=")) & x.rlike(_BARS)) | (x.contains("\t") & x.rlike(r"\t[^\t]*\t"))


STATISTICS = ("n_chars", "n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "vowel_ratio", "foreign_ratio", "end_punct_share", "sentence_end_share", "common_share", "clause_share", "link_share", "clause_line_share", "column_share", "column_lines", "line_words", "unit_words", "mark_words", "case_breaks", "distinct_words", "distinct_share", "markup_share")


#: The counts that each statistic is made of.
_NEEDS = {
    "n_chars": "n_chars __n_ink", "n_words": "n_words", "mean_word_len": "__in_words n_words", "symbol_ratio": "__in_words __digits __n_ink", "digit_ratio": "__digits __n_ink", "vowel_ratio": "__vowels __in_words",
    "foreign_ratio": "__foreign __n_ink", "end_punct_share": "__ends __n_lines", "sentence_end_share": "__stops __n_lines", "common_share": "__clause __link n_words", "clause_share": "__clause n_words",
    "link_share": "__link n_words", "clause_line_share": "__clause_chars __line_chars", "column_share": "__columns __line_chars", "column_lines": "__columns", "line_words": "n_words __n_lines",
    "unit_words": "n_words __n_lines __units", "mark_words": "__marks n_words", "case_breaks": "__breaks n_words", "distinct_words": "distinct_words", "distinct_share": "distinct_words n_words", "markup_share": "__tags n_chars",
}


def _step(df: DataFrame, *columns: Column) -> DataFrame:
    """A projection that a filter on it does not pass.

    A generator of one element stands between, so that the optimiser does not copy the expressions into the filter and
    compute all of them once for the filter and once for the result. (It merges no projections whose costly
    expressions are used more than once, so within the statistics plain ones do.)
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def _words(list_: list[str]) -> str:
    return r"(?<![\p{L}\p{M}'’])(?:" + "|".join(sorted(set(list_))) + r")(?![\p{L}\p{M}'’])"


def with_statistics(df: DataFrame, key: str, text: str, only: tuple[str, ...] = STATISTICS) -> DataFrame:
    """``key`` and the STATISTICS of each row as doubles.

    Whole texts, one scan, no shuffle, no Python. Null, empty and blank texts have 0 throughout. Line ends of any kind
    end a line; blank lines do not count. Repeated rows give rows of their own; other columns do not reach the result.

    n_words: runs of letters and marks. Ratios are to characters other than white space: symbol_ratio counts what is
    no letter, mark or digit, foreign_ratio bytes of UTF-8 beyond one for each character;
    vowel_ratio is to characters in words. Shares of words are to n_words, shares of lines to lines, but
    clause_line_share (lines of five or more words with a clause word) and column_share are weighted by length.
    line_words, unit_words: words to a line, and to a stretch between lines, semicolons, bars and bullets.
    mark_words: commas, semicolons, bars to words. case_breaks: capitals inside words, to words.
    """
    n = lambda c: c.cast("double")
    per = lambda a, b: F.when(b > 0, n(a) / n(b)).otherwise(F.lit(0.0))
    among = lambda words: lambda x: x.isin(sorted(set(words)))
    t = F.coalesce(F.col(text), F.lit(""))
    odd = [t.contains(c) for c in ("\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029")]
    one_end = F.when(reduce(lambda a, b: a | b, odd), F.regexp_replace(t, r"\r\n?|[\x0b\x0c\x85\x{2028}\x{2029}]", "\n")).otherwise(t)
    rows = df.select(F.col(key).alias("__key"), one_end.alias("__t"), F.lower(one_end).alias("__low"))
    rows = rows.select(F.col("__key"), F.col("__t"), F.filter(F.split("__low", "\n"), lambda x: x.rlike(rf"[^{_BLANK}]")).alias("__lines"))
    lines, t = F.col("__lines"), F.col("__t")
    # each line is split once: its parts serve the lines with clause words, and put together they are the words of the text
    rows = rows.select(F.col("__key"), t, lines, F.transform(lines, lambda x: F.split(x, r"[^\p{L}\p{M}]+")).alias("__parts"))
    rows = rows.select(F.col("__key"), t, lines, F.col("__parts"), F.array_remove(F.flatten("__parts"), "").alias("__w"), F.filter(lines, lambda x: x.rlike(_END)).alias("__ended"))
    sized = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + F.length(x))
    sentences = F.zip_with(lines, "__parts", lambda x, w: F.when((F.size(w) >= 5) & F.exists(w, among(CLAUSE)), F.length(x)).otherwise(0))
    counts = {
        "n_chars": F.length("__t"),
        "n_words": F.size("__w"),
        "__in_words": F.length(F.array_join("__w", "")),
        "distinct_words": F.size(F.array_distinct("__w")),
        "__clause": F.size(F.filter("__w", among(CLAUSE))),
        "__link": F.size(F.filter("__w", among(LINK))),
        "__n_ink": F.length(F.regexp_replace(t, rf"[{_BLANK}]+", "")),
        "__digits": F.length(F.regexp_replace(t, r"[^0-9]+", "")),
        "__vowels": F.length(F.regexp_replace(t, r"[^aeiouyAEIOUYàâäáèéêëìíîïòóôöùúûü]+", "")),
        "__foreign": F.octet_length(t) - F.length(t),
        "__units": F.regexp_count(t, F.lit(r"[;|•·│]")),
        "__marks": F.regexp_count(t, F.lit(r"[,;|•·│/]")),
        "__breaks": F.regexp_count(t, F.lit(r"[a-z][A-Z]")),
        "__n_lines": F.size(lines),
        "__ends": F.size("__ended"),
        "__stops": F.size(F.filter("__ended", lambda x: x.rlike(_SENTENCE_END))),
        "__columns": F.filter(lines, columns),
        "__clause_chars": F.aggregate(sentences, F.lit(0), lambda s, x: s + x),
        "__line_chars": sized(lines),
        "__tags": F.when(t.contains("<"), F.length(t) - F.length(F.regexp_replace(t, r"<[^<>\n]*>", ""))).otherwise(0),
    }
    w, ln, all_ink = F.col("n_words"), F.col("__n_lines"), F.col("__n_ink")
    out = {
        "n_chars": n(F.when(all_ink > 0, F.col("n_chars")).otherwise(0)),
        "n_words": n(w),
        "mean_word_len": per(F.col("__in_words"), w),
        "symbol_ratio": per(all_ink - F.col("__in_words") - F.col("__digits"), all_ink),
        "digit_ratio": per(F.col("__digits"), all_ink),
        "vowel_ratio": per(F.col("__vowels"), F.col("__in_words")),
        "foreign_ratio": per(F.col("__foreign"), all_ink),
        "end_punct_share": per(F.col("__ends"), ln),
        "sentence_end_share": per(F.col("__stops"), ln),
        "common_share": per(F.col("__clause") + F.col("__link"), w),
        "clause_share": per(F.col("__clause"), w),
        "link_share": per(F.col("__link"), w),
        "clause_line_share": per(F.col("__clause_chars"), F.col("__line_chars")),
        "column_share": per(sized(F.col("__columns")), F.col("__line_chars")),
        "column_lines": n(F.size("__columns")),
        "line_words": per(w, ln),
        "unit_words": per(w, ln + F.col("__units")),
        "mark_words": per(F.col("__marks"), w),
        "case_breaks": per(F.col("__breaks"), w),
        "distinct_words": n(F.col("distinct_words")),
        "distinct_share": per(F.col("distinct_words"), w),
        "markup_share": per(F.col("__tags"), F.col("n_chars")),
    }
    used = [x for x in counts if any(re.search(rf"\b{x}\b", _NEEDS[c]) for c in only)]
    scalars = rows.select(F.col("__key"), *[counts[x].alias(x) for x in used])
    return scalars.select(F.col("__key").alias(key), *[out[c].alias(c) for c in STATISTICS if c in only])


@lru_cache(1)
def rules() -> list[dict]:
    """The learned rules in order: {"kind": ..., "when": [[statistic, "<=" or ">", threshold], ...]}."""
    return json.loads(resources.files(__package__).joinpath("quality_rules.json").read_text())["rules"]


def kind_case(learned: list[dict] | None = None, suffix: str = "D") -> str:
    """The rule list as a SQL CASE over the statistics; the first rule that holds gives the kind, else 'prose'.

    ``suffix`` marks thresholds as doubles where the dialect has a mark for it.
    """
    parts = ["WHEN " + " AND ".join(f"{s} {op} {x!r}{suffix}" for s, op, x in r["when"]) + f" THEN '{r['kind']}'" for r in (rules() if learned is None else learned)]
    return "CASE WHEN n_chars = 0 THEN NULL " + " ".join(parts) + " ELSE 'prose' END"


def text_kinds(df: DataFrame, key: str, text: str, learned: list[dict] | None = None, only: tuple[str, ...] | None = STATISTICS) -> DataFrame:
    """``key``, the statistics named in ``only`` and ``kind``: 'prose', 'list', 'table' or 'junk'.

    Null for null, empty and blank texts. Statistics that neither ``only`` nor a rule names are not computed.
    """
    learned, only = rules() if learned is None else learned, only or ()
    need = {s for r in learned for s, _, _ in r["when"]} | set(only) | {"n_chars"}
    found = with_statistics(df, key, text, tuple(s for s in STATISTICS if s in need))
    return _step(found, F.col(key), *[F.col(c) for c in STATISTICS if c in only], F.expr(kind_case(learned)).alias("kind"))
