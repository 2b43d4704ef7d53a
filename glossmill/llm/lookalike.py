"""Visually identical text with different characters: a compiled transducer over grapheme clusters.

The mapping is computed once from rules (Unicode decompositions for widths, ligatures and spaces, deletion of what is
not drawn, composition of accents) and a short table of look-alike letters: a form for every single character that
changes and for every letter with one mark, checked for conflicts. The transducer goes through a text once, takes the
longest cluster at each place (a character with all marks and undrawn characters after it) and writes the form the
mapping has for it. Clusters of more marks go through the same precomputed steps, mark by mark: parts of a character,
rank of a mark, what a letter and a mark compose to. Text without any such cluster passes through untouched.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators.lineage import written
from glossmill.operators.skew import hot_groups, join_groups, salted_join

# Letters of other scripts that are drawn like Latin ones.
LOOKALIKE = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "ϳ": "j", "ϲ": "c", "α": "a", "γ": "y", "ι": "i", "σ": "o", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "ց": "g", "հ": "h", "զ": "q", "ք": "p", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    # Latin and phonetic letters drawn like plain ones
    "ɡ": "g", "ɑ": "a", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴏ": "o", "ᴄ": "c", "ꜱ": "s", "ƅ": "b", "ǀ": "l", "ɩ": "i", "ꞷ": "w", "ℓ": "l", "℮": "e",
    # Coptic
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y",
    # Deseret and Canadian syllables
    "𐐬": "o", "𐐄": "O", "𐐕": "C", "𐐛": "L", "ᖴ": "F", "ᗅ": "A", "ᗞ": "D", "ᒍ": "J", "ᒪ": "L", "ᑭ": "P", "ᑌ": "U", "ᐯ": "V", "᙭": "X",
    # Cherokee and Lisu capitals
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "−": "-", "˗": "-", "⁃": "-", "۔": "-", "’": "'", "‘": "'", "ʼ": "'", "ʻ": "'", "ʹ": "'", "′": "'", "‛": "'", "ˈ": "'", "՚": "'", "“": '"', "”": '"', "″": '"', "‟": '"', "ʺ": '"', "․": ".", "‚": ",", "٫": ",", "׃": ":", "ː": ":", "∶": ":", "⁄": "/", "∕": "/", "∣": "|", "ǃ": "!", "⁎": "*", "∗": "*"}
#: Decompositions under these tags look like what they give; raised, lowered, circled, squared and other forms do not.
_DRAWN_ALIKE = ("wide", "narrow", "noBreak", "font", "compat")
_VISIBLE = "ſƒ"  # these differ from the letters Unicode gives for them


def undrawn(c: str) -> bool:
    """Whether a character leaves no mark: format characters, joiners, variation selectors, fillers."""
    n = ord(c)
    return unicodedata.category(c) == "Cf" or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or 0x180B <= n <= 0x180F or n in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


def _expand(c: str) -> str:
    """The character decomposed as far as the result looks the same, each letter in its one form."""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if c in SIGNS:
        return SIGNS[c]
    if undrawn(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    parts = unicodedata.decomposition(c).split()
    if not parts or c in _VISIBLE or parts[0][0] == "<" and parts[0][1:-1] not in _DRAWN_ALIKE:
        return c
    if parts[0][0] == "<":
        parts = parts[1:]
        if any(chr(int(p, 16)) == " " for p in parts):  # spacing forms of accents
            return c
    return "".join(_expand(chr(int(p, 16))) for p in parts)


def compile_mapping() -> dict[str, str]:
    """Every single character that changes, with its form. Raises if the rules contradict each other."""
    out = {}
    for c in _every():
        form = unicodedata.normalize("NFC", _expand(c))
        if form != c:
            out[c] = form
    for c, form in out.items():
        if any(x in out for x in form):
            raise ValueError(f"conflict: {c!r} gives {form!r}, which changes again")
        if c in LOOKALIKE.values() or c in SIGNS.values():
            raise ValueError(f"conflict: {c!r} is both a form and a source")
    if set(LOOKALIKE) & set(SIGNS):
        raise ValueError("conflict: a character is in both tables")
    return out


def _every() -> Iterator[str]:
    """All characters but syllables and ideographs, which neither change nor decompose here."""
    return (chr(n) for n in range(sys.maxunicode + 1) if not (0xAC00 <= n <= 0xD7A3 or 0xD800 <= n <= 0xDFFF or 0x3400 <= n <= 0x9FFF or 0x20000 <= n <= 0xE0000))


def _class(chars: set[str]) -> str:
    """The characters as runs for a pattern."""
    runs, ends = [], sorted(map(ord, chars))
    for n in ends:
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in runs)


# Places of Hangul letters and syllables, and the numbers of each kind of letter.
_L, _V, _T, _S, _N_L, _N_V, _N_T = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28


class Transducer:
    """One pass over a text, longest cluster first."""

    def __init__(self) -> None:
        changed = compile_mapping()
        self.parts: dict[str, str] = {}  # of characters that change or decompose: starters and marks of their form
        self.rank: dict[str, int] = {}  # of marks; marks of different rank stand in its order
        self.pairs: dict[tuple[str, str], str] = {}  # what a letter and a mark compose to
        for c in _every():
            if k := unicodedata.combining(c):
                self.rank[c] = k
            pieces = unicodedata.normalize("NFD", c)
            form = unicodedata.normalize("NFD", "".join(changed.get(x, x) for x in pieces))
            if form != c:
                self.parts[c] = form
            ends = unicodedata.decomposition(c).split()
            if len(ends) == 2 and ends[0][0] != "<" and unicodedata.is_normalized("NFC", c):
                self.pairs[chr(int(ends[0], 16)), chr(int(ends[1], 16))] = c
        letters = {chr(n) for n in [*range(_V, _V + _N_V), *range(_T + 1, _T + _N_T)]}
        follows = self.rank.keys() | {b for _, b in self.pairs} | letters
        tail = follows | {c for c, form in self.parts.items() if form and form[0] in follows}
        blank = {c for c, form in self.parts.items() if not form}
        # a changed character or any character before marks, with all marks and undrawn characters that follow
        self.cluster = re.compile(f"[{_class(set(changed))}][{_class(tail | blank)}]*|[^{_class(blank)}][{_class(blank)}]*[{_class(tail)}][{_class(tail | blank)}]*")
        self.mapping = dict(changed)
        alike: dict[str, list[str]] = {}
        for c, form in changed.items():
            alike.setdefault(form, []).append(c)
        for (letter, mark), whole in self.pairs.items():
            for c in [letter, *alike.get(letter, ())]:
                self.mapping[c + mark] = self._steps(c + mark)
            if letter in LOOKALIKE.values() and self.mapping[letter + mark] != whole:
                raise ValueError(f"conflict: {letter + mark!r} does not give {whole!r}")
        for cluster, form in self.mapping.items():
            if self._steps(cluster) != form or self._steps(form) != form:
                raise ValueError(f"conflict: {cluster!r} gives {form!r}, which is not final")
        self.longer = lru_cache(1 << 16)(self._steps)

    def _steps(self, cluster: str) -> str:
        """Form of a cluster by the precomputed steps: parts, marks in order of rank, marks composed with their letter."""
        chars = [x for c in cluster for x in self.parts.get(c, c)]
        rank, n, at = self.rank, len(chars), 0
        while at < n:
            if chars[at] in rank:
                to = at
                while to < n and chars[to] in rank:
                    to += 1
                chars[at:to] = sorted(chars[at:to], key=rank.__getitem__)
                at = to
            at += 1
        out: list[str] = []
        letter, last = -1, 0  # place of the letter that marks join, rank of the mark that stands between
        for c in chars:
            k = rank.get(c, 0)
            whole = self._joined(out[letter], c) if letter >= 0 and (last == 0 and letter == len(out) - 1 or 0 < last < k) else None
            if whole:
                out[letter] = whole
                continue
            if k == 0:
                letter = len(out)
            last = k
            out.append(c)
        return "".join(out)

    def _joined(self, a: str, b: str) -> str | None:
        l, v, t, s = ord(a) - _L, ord(b) - _V, ord(b) - _T, ord(a) - _S
        if 0 <= l < _N_L and 0 <= v < _N_V:
            return chr(_S + (l * _N_V + v) * _N_T)
        if 0 <= s < _N_L * _N_V * _N_T and s % _N_T == 0 and 0 < t < _N_T:
            return chr(ord(a) + t)
        return self.pairs.get((a, b))

    def _form(self, m: re.Match) -> str:
        form = self.mapping.get(m[0])
        return self.longer(m[0]) if form is None else form

    def __call__(self, text: str) -> str:
        return text if text.isascii() else self.cluster.sub(self._form, text)


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def one_form(df: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """``keys`` as they are and each of ``texts`` in its one form, under its own name.

    Two texts that differ only in width forms, ligatures, composed or combining accents, kinds of space, undrawn
    characters or look-alike letters, hyphens, apostrophes and quotes come out equal; letter case, accents and hyphen
    against space stay apart, and so does white space that is drawn (its amount). Null gives null, empty and undrawn
    texts give the empty text; ASCII texts are unchanged. Other columns do not reach the result. Arrow batches, no
    shuffle; each text takes time linear in its length.
    """
    schema = df.select(*keys, *texts).schema
    first = len(keys)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = transducer()
        for batch in batches:
            done = [pa.array([None if t is None else one(t) for t in batch.column(i).to_pylist()], pa.string()) for i in range(first, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(first)] + done, names=batch.schema.names)

    return df.select(*keys, *texts).mapInArrow(forms, schema)


def _variants(df: DataFrame, key: str, exact: str, texts: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows with their texts, and the distinct texts: number of rows, class of those that look the same, sizes of the class.

    Distinct texts are counted before they are brought to one form, so each is brought to it once. ``__vid`` numbers
    them and is fixed by the writing; a class is the smallest number in it.
    """
    names = [f"__t{i}" for i in range(len(texts))]
    rows = df.select(F.col(key).alias("__id"), F.col(exact).alias("__x"), *[F.col(t).alias(n) for t, n in zip(texts, names)]).dropna()
    variants = rows.groupBy("__x", *names).agg(F.count("*").alias("__n"), F.min("__id").alias("__least"))
    own = [f"__o{i}" for i in range(len(texts))]
    ready = variants.select("__x", *[F.col(n).alias(o) for n, o in zip(names, own)], "__n", "__least", *names)
    formed = written(one_form(ready, ["__x", *own, "__n", "__least"], names).withColumn("__vid", F.monotonically_increasing_id()))
    classes = formed.groupBy("__x", *names).agg(F.min("__vid").alias("__class"), F.count("*").alias("__variants"), F.sum("__n").alias("__rows"), F.min("__least").alias("__first"))
    met = salted_join(formed, classes, ["__x", *names], hot_groups(classes, ["__x", *names], "__variants"), ["__vid"])
    out = met.select("__vid", "__class", "__variants", "__rows", "__first", "__n", "__x", *[F.col(o).alias(n) for n, o in zip(names, own)])
    return rows, out, names


def lookalike_pairs(df: DataFrame, key: str, exact: str, texts: list[str], hot_rows: int = 100_000) -> DataFrame:
    """All pairs of rows that look the same but differ in their characters: ``entry_id_a`` < ``entry_id_b``.

    Rows with a null in ``exact`` or a text take no part. Classes are compared between distinct variants, so that
    copies of one text meet no other copy of it: the work is in proportion to the pairs that come out. Classes of many
    variants and variants of at least ``hot_rows`` rows are salted. After the rows have met their variant once, only
    numbers are shuffled. For classes and links in place of pairs, see lookalike_classes.
    """
    rows, variants, names = _variants(df, key, exact, texts)
    several = written(variants.where("__variants > 1").select("__vid", "__class", "__variants", "__n", "__x", *names))
    side = lambda p: several.select("__class", F.col("__vid").alias(f"__{p}"), F.col("__n").alias(f"__n{p}"))
    sizes = several.select("__class", "__variants").distinct()
    pairs = salted_join(side("a"), side("b"), ["__class"], hot_groups(sizes, ["__class"], "__variants", hot_rows), ["__a"]).where("__a < __b").drop("__class")
    here = written(join_groups(rows, several.select("__vid", "__n", "__x", *names), ["__x", *names], "__n", ["__id"], hot_rows).select("__vid", "__id"))
    hot = hot_groups(several.select("__vid", "__n"), ["__vid"], "__n", hot_rows)
    one = salted_join(here.select(F.col("__vid").alias("__a"), F.col("__id").alias("__one")), pairs, ["__a"], hot, ["__one"])
    two = salted_join(here.select(F.col("__vid").alias("__b"), F.col("__id").alias("__two")), one, ["__b"], hot, ["__two"])
    return two.where(F.col("__one") != F.col("__two")).select(F.least("__one", "__two").alias("entry_id_a"), F.greatest("__one", "__two").alias("entry_id_b"))


def lookalike_classes(df: DataFrame, key: str, exact: str, texts: list[str], hot_rows: int = 100_000) -> DataFrame:
    """A row for each row without nulls in ``exact`` and the texts: the key, ``class_id`` (smallest key that looks the same), ``n_links``.

    ``n_links`` counts the rows that look the same but differ in their characters: the pairs of lookalike_pairs that
    the row is in, without making them. Repeated keys are rows of their own, and count as such.
    """
    rows, variants, names = _variants(df, key, exact, texts)
    groups = variants.select("__x", *names, "__n", F.col("__first").alias("class_id"), (F.col("__rows") - F.col("__n")).alias("n_links"))
    return join_groups(rows, groups, ["__x", *names], "__n", ["__id"], hot_rows).select(F.col("__id").alias(key), "class_id", "n_links")
