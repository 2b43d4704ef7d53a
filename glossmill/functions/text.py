"""Text expressions evaluated in the JVM: white space, cleaning, tokens with offsets, capitals, sentences, blanks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as scripting languages see it; Java's own class is ASCII only.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same as characters.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LOOK_BACK = 16
WORD = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def language(tag: Column) -> Column:
    """Primary subtag of a language tag, in lower case: 'en' of ' en', 'EN' and 'en-XX'. Null and 'und' (not told) stay, and are no language."""
    return F.split(F.lower(trim_all(tag)), "[-_]")[0]


def clean_text(x: Column) -> Column:
    """Named entities resolved, runs of white space one space, ends trimmed. Null stays null."""
    for entity, char in _ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def words_of(x: Column) -> Column:
    """Words between white space; none of an empty text."""
    return F.filter(F.split(trim_all(x), f"{SPACE}+"), lambda w: w != "")


def has_words(x: Column, n: int) -> Column:
    """Whether words_of() are ``n`` or more; read only as far as that takes."""
    no = f"[^{SPACE[1:]}"
    return x.rlike(f"{SPACE}++".join([no, *[f"{no}++"] * (n - 2), no]) if n > 1 else no)


def clean_source(x: Column) -> Column:
    """Lower-cased key of two or more letters, at most four words of at most 24 characters, else null."""
    s = F.lower(clean_text(x))
    words = F.split(s, " ")
    return F.when(s.rlike(r"^[a-z][a-z' -]{0,58}[a-z]$") & (F.size(words) <= 4) & F.forall(words, lambda w: F.length(w) <= 24), s)


def clean_target(x: Column) -> Column:
    """Target of Spanish letters, at most 60 characters, no affix mark and no markup, else null."""
    t = clean_text(x)
    ok = (F.length(t) > 0) & (F.length(t) <= 60) & ~t.startswith("-") & ~t.endswith("-") & ~t.rlike(r"[,&;()/\\\[\]{}<>_=+*#@|]|\.{3}|…|&[a-z]+;") & t.rlike(r"^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ¿¡' .-]+$")
    return F.when(ok, t)


def clean_gloss(x: Column) -> Column:
    """One leading parenthesis of at most 80 characters dropped; more than 180 characters cut to 177 and three dots."""
    g = F.trim(F.regexp_replace(clean_text(x), r"^\([^)]{1,80}\)\s*", ""))
    return F.when(g != "", F.when(F.length(g) > 180, F.concat(F.rtrim(F.substring(g, 1, 177)), F.lit("..."))).otherwise(g))


def short_gloss(x: Column, fallback: Column, drop_bracketed: bool) -> Column:
    """Brackets (with content or as characters) dropped; more than 120 characters cut to 117 and an ellipsis."""
    g = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\[[^\]]*\]" if drop_bracketed else r"[\[\]]", ""))
    g = F.when(F.length(g) > 120, F.concat(F.rtrim(F.substring(g, 1, 117)), F.lit("…"))).otherwise(g)
    return F.when(g == "", fallback).otherwise(g)


def match_capitals(source: Column, replacement: Column) -> Column:
    """The replacement in the source's capitals: all upper, first letter upper, or as it is."""
    letters = F.regexp_replace(source, r"\P{L}+", "")
    first = F.substring(letters, 1, 1)
    head = F.regexp_extract(replacement, r"^\P{L}*", 0)
    at = F.length(head)
    titled = F.concat(head, F.upper(F.substring(replacement, at + 1, F.lit(1))), F.substring(replacement, at + 2, F.length(replacement)))
    return F.when((letters == "") | ~replacement.rlike(r"\p{L}"), replacement).when(letters == F.upper(letters), F.upper(replacement)).when(first == F.upper(first), titled).otherwise(replacement)


def capitalise_first_letter(x: Column) -> Column:
    head = F.regexp_extract(x, r"^\P{L}*", 0)
    at = F.length(head)
    return F.concat(head, F.upper(F.substring(x, at + 1, F.lit(1))), F.substring(x, at + 2, F.length(x)))


def sentence_context(text: Column, start: Column) -> Column:
    """Sentence that holds the offset (from 0): up to and with the boundary after it, trimmed, cut at 200 to 197 and '…'.

    Boundaries are a mark of .!? with white space after it, and line breaks. Text after the last boundary is taken
    from that boundary on.
    """
    before = F.substring(text, F.lit(1), start)
    cut = F.length(F.regexp_extract(before, r"^(?s:.*)(?:[.!?]\s+|\n+)", 0))
    rest = F.substring(text, cut + 1, F.length(text))
    # a boundary whose white space goes on past the offset belongs to the sentence it ends
    piece = F.regexp_extract(rest, r"^(?s:.*?)(?:[.!?]\s+|\n+)", 0)
    return cut_context(F.when(piece == "", rest).otherwise(piece))


def cut_context(sentence: Column) -> Column:
    """The sentence trimmed, and cut at 200 characters to 197 and '…'."""
    out = trim_all(sentence)
    return F.when(F.length(out) > 200, F.concat(F.substring(out, 1, 197), F.lit("…"))).otherwise(out)


def blank_word(sentence: Column, surface: Column) -> Column:
    """The first whole-word match of the surface form as ___, in any case; null without a match."""
    quoted = F.concat(F.lit(r"(?is)^(.*?)\b\Q"), F.replace(surface, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b(.*)$"))
    part = lambda n: F.call_function("regexp_extract", sentence, quoted, F.lit(n))
    return F.when(F.regexp_like(sentence, quoted), F.concat(part(1), F.lit("___"), part(2)))


def tokens(docs: DataFrame, key: str, text: str, ahead: int = 0) -> DataFrame:
    """One row for each word: ``key``, ``token_no`` from 0, ``token``, ``start``, ``end`` (code points, half-open), ``gap`` before
    it, and ``back``, the LOOK_BACK characters before it (fewer at the start).

    With ``ahead``, also the up to so many words that follow with only white space between (``ahead``, lower case, joined
    by spaces) and their ends (``ends``). Texts without words, empty and null ones give no rows. Offsets come from one
    scan of each text in Arrow batches, so nothing is shuffled and whole texts are read, however long.
    """
    kind = docs.select(key).schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("token_no", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("gap", T.StringType()), T.StructField("back", T.StringType())]
    if ahead:
        fields += [T.StructField("ahead", T.StringType()), T.StructField("ends", T.ArrayType(T.IntegerType()))]
    names = [f.name for f in fields]
    types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(WORD).finditer
        for batch in batches:
            at, cols = [], [[] for _ in names[1:]]

            def done(batch=batch) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)
                at.clear()
                for c in cols:
                    c.clear()
                return out

            for row, x in enumerate(batch.column(1).to_pylist()):
                spans = [m.span() for m in find(x)] if x else []
                if not spans:
                    continue
                n, before = len(spans), [0, *[e for _, e in spans[:-1]]]
                words, gaps = [x[a:b] for a, b in spans], [x[e:a] for e, (a, _) in zip(before, spans)]
                at.extend([row] * n)
                made = [range(n), words, [a for a, _ in spans], [b for _, b in spans], gaps, [x[max(0, a - LOOK_BACK) : a] for a, _ in spans]]
                if ahead:
                    low, run = [w.lower() for w in words], [n] * n  # where the run of words around each one ends
                    for i in range(n - 2, -1, -1):
                        run[i] = run[i + 1] if not gaps[i + 1].strip(SPACES) else i + 1
                    stop = [min(r, i + 1 + ahead) for i, r in enumerate(run)]
                    made += [[" ".join(low[i + 1 : r]) for i, r in enumerate(stop)], [made[3][i + 1 : r] for i, r in enumerate(stop)]]
                for c, v in zip(cols, made):
                    c.extend(v)
                if len(at) > 50_000:
                    yield done()
            if at:
                yield done()

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(scan, T.StructType(fields))
