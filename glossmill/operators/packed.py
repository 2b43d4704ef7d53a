"""Several values packed in one field: expectation-maximisation segmentation and Viterbi lattices.

A text is cut into *atoms* at every place that could separate. Quoted spans, bracketed spans and a mark directly
between two digits are atomic: no place inside them is offered. In the lattice over the atoms a value is one atom, or a
run of atoms whose marks are literal. It costs

* an atom: what is known of it, ``(1 - new) * count / values``, plus ``new`` times the probability of its characters;
* a run of any length: ``new`` times the probability of its characters;
* each mark inside a value the probability that this mark is literal, each between values that it separates.

All of this is learned by expectation-maximisation from the whole column: the counts of values (a table that grows
with the data, keyed by a hash, joined and never broadcast), the share of ``new`` values, and how often each mark is
literal. Every mark starts at even odds. Marks that list alternatives share what they learn, so that a rare one
follows the common ones; the marks of ``LEARNED`` have no such company and stay at even odds until the column tells.
What the group learns is drawn to separating as if by a quarter more places: that decides only in a column where no
value ever recurs, which tells nothing of its marks.

Training counts distinct texts, not rows: a text delivered a million times says no more about its marks than once. A
text's own share is taken out of a count before its own places are judged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators.lineage import written
from glossmill.operators.skew import hot_groups, salted_join

# Marks that list alternatives, marks whose role is learned alone, pairs that protect what they enclose.
LISTED = ",;/|•·、；，／｜،؛‖∥¦・‧∙●▪◦⁄∕﹐﹑﹔､"
BREAKS = "\n\r\t\x0b\x0c\x85\u2028\u2029"
LEARNED = "+=&*#~\\<>→↔⇒"
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“”", "‘": "’", "‹": "›", "‚": "‘’", "「": "」", "『": "』", "＂": "＂", "〝": "〞", "'": "'"}
BRACKETS = {"(": ")", "[": "]"}

_CLASS = re.escape(LISTED + BREAKS + LEARNED)
_SPECIAL = re.compile(rf"[{_CLASS}{re.escape(''.join(QUOTES) + ''.join(QUOTES.values()) + '()[]')}]|(?<![\w'’\-])or(?![\w'’\-])", re.IGNORECASE)
#: For the scan: a text without any of these holds one value.
MAYBE_PACKED = rf"(?i)[{_CLASS}]|(?<!\w)or(?!\w)"

#: Class of each mark; the word "or" and all line breaks and tabs are a class each.
CLASSES = {c: i for i, c in enumerate(LISTED)} | dict.fromkeys(BREAKS, len(LISTED)) | {"or": len(LISTED) + 1} | {c: len(LISTED) + 2 + i for i, c in enumerate(LEARNED)}
N_CLASSES = len(LISTED) + 2 + len(LEARNED)
N_LISTED = len(LISTED) + 2  # classes below this number list alternatives
_CHAR = log(1 / 40)  # each character of a new value
_COMPANY = 100.0  # places at which a mark follows its group before its own places outweigh it
_RARELY, _DRAWN = 0.05, 0.25  # marks of the group are drawn to this rate of literal ones as if by a quarter of the places
_LEAST = 1e-9


def places(text: str) -> list[tuple[int, int, int]]:
    """(start, end, class) of each place that could separate, outside atomic spans. Linear in the text."""
    found = [(m.start(), m.end(), m[0]) for m in _SPECIAL.finditer(text)]
    if not found:
        return []
    n, size = len(found), len(text)
    closer: dict[int, int] = {}
    stack: dict[str, list[int]] = {"(": [], "[": []}
    later: dict[str, int] = {}  # the next closing quote of each kind, going from right to left
    for i in range(n - 1, -1, -1):
        s, e, c = found[i]
        if c == "'":
            before, after = s > 0 and text[s - 1].isalnum(), e < size and text[e].isalnum()
            if not before and "'" in later:
                closer[i] = later["'"]
            if not after:
                later["'"] = i
        elif c == "’":
            if not (e < size and text[e].isalnum() and s > 0 and text[s - 1].isalnum()):
                later[c] = i
        elif c == '"':
            pass
        elif c in QUOTES:
            ends = [later[x] for x in QUOTES[c] if x in later]
            if ends:
                closer[i] = min(ends)
            later[c] = i
        else:
            later[c] = i
    for i, (_, _, c) in enumerate(found):
        if c in stack:
            stack[c].append(i)
        elif c in ")]" and stack["(" if c == ")" else "["]:
            closer[stack["(" if c == ")" else "["].pop()] = i
    double = [i for i in range(n) if found[i][2] == '"']
    k, out, i = 0, [], 0
    while i < n:
        s, e, c = found[i]
        if c == '"':
            while k < len(double) and double[k] <= i:
                k += 1
            j = k  # doubled quotes inside a double-quoted span do not close it
            while j + 1 < len(double) and found[double[j]][1] == found[double[j + 1]][0]:
                j += 2
            if j < len(double):
                i, k = double[j] + 1, j + 1
                continue
        elif i in closer:
            i = closer[i] + 1
            continue
        else:
            kind = CLASSES.get(c if len(c) == 1 else "or")
            if kind is not None and not (c not in BREAKS and len(c) == 1 and 0 < s and e < size and text[s - 1].isdigit() and text[e].isdigit()):
                out.append((s, e, kind))
        i += 1
    return out


def unquoted(value: str) -> str:
    """The value without quotes that enclose all of it; doubled double quotes within such become one."""
    if len(value) > 1 and value[0] in QUOTES and value[-1] in QUOTES[value[0]]:
        inner, c = value[1:-1], value[0]
        if c == '"':
            if '"' not in inner.replace('""', ""):
                return inner.replace('""', '"').strip()
        elif c == "'":
            if not re.search(r"(?<!\w)'|'(?!\w)", inner):
                return inner.strip()
        elif not any(x in inner for x in QUOTES[c] + c) or (c == "‘" and not re.search(r"’(?!\w)|‘", inner)):
            return inner.strip()
    return value


def value_hash(value: str) -> int:
    """The same number as xxhash64(value) in Spark."""
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def atoms(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """(trimmed atoms as (start, end), classes between them); marks with nothing between them act as one place."""
    spans, classes, at, kind = [], [], 0, None
    for s, e, c in [*places(text), (len(text), len(text), N_CLASSES)]:
        part = text[at:s].strip()
        if part:
            if spans:
                classes.append(kind)
            first = text.index(part, at)
            spans.append((first, first + len(part)))
            kind = c
        elif kind is not None and c < kind:
            kind = c
        at = e
    return spans, classes


@dataclass
class Model:
    """What is learned but the counts: how often each class of mark is literal, the share of new values, the number of values."""

    literal: list[float] = field(default_factory=lambda: [0.5] * N_CLASSES)
    new: float = 0.5
    values: float = 1.0

    def scores(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of atoms read as one value each, without the probability of their characters, which every reading pays."""
        with np.errstate(divide="ignore"):
            known = np.log(np.maximum(counts, 0.0)) + log(1 - self.new) - log(max(self.values, 1.0)) - lengths * _CHAR
        return np.logaddexp(log(self.new), known)

    def marks(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities that marks are literal, and that they separate."""
        p = np.clip(np.asarray(self.literal)[classes], _LEAST, 1 - _LEAST)
        return np.log(p), np.log1p(-p)


def forward_backward(model: Model, scores: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of equally many atoms, a row each: the probability of each atom to be a value, of each place to separate, and the number of new values.

    ``ended``: weight of all readings up to an atom that end a value there; ``open_``: that have a run open there.
    """
    keep, cut = model.marks(classes)
    m, n = scores.shape
    new = log(model.new)
    start, ended, open_ = (np.empty((m, n)) for _ in range(3))
    start[:, 0], ended[:, 0], open_[:, 0] = 0.0, scores[:, 0], new
    for k in range(1, n):
        start[:, k] = ended[:, k - 1] + cut[:, k - 1]
        run = open_[:, k - 1] + keep[:, k - 1]
        ended[:, k] = np.logaddexp(start[:, k] + scores[:, k], run)
        open_[:, k] = np.logaddexp(start[:, k] + new, run)
    after, running = np.zeros((m, n)), np.zeros((m, n))
    for k in range(n - 2, -1, -1):
        longer = new + keep[:, k + 1] + running[:, k + 2] if k + 2 < n else np.full(m, -np.inf)
        after[:, k] = cut[:, k] + np.logaddexp(scores[:, k + 1] + after[:, k + 1], longer)
        running[:, k] = np.logaddexp(after[:, k], keep[:, k] + running[:, k + 1])
    total = ended[:, -1:]
    own = np.exp(np.minimum(0.0, start + scores + after - total))
    cuts = np.exp(np.minimum(0.0, ended[:, :-1] + after[:, :-1] - total))
    return own, cuts, (own * np.exp(new - scores)).sum(axis=1) + (1.0 + cuts.sum(axis=1) - own.sum(axis=1))


def viterbi(model: Model, scores: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """For texts of equally many atoms, a row each: whether each place separates in the likeliest reading."""
    keep, cut = model.marks(classes)
    m, n = scores.shape
    new = log(model.new)
    ended, open_ = scores[:, 0].copy(), np.full(m, new)
    by_run, opened = np.zeros((m, n), bool), np.zeros((m, n), bool)
    opened[:, 0] = True
    for k in range(1, n):
        start, run = ended + cut[:, k - 1], open_ + keep[:, k - 1]
        by_run[:, k], opened[:, k] = run > start + scores[:, k], start + new >= run
        ended, open_ = np.maximum(start + scores[:, k], run), np.maximum(start + new, run)
    out, inside = np.empty((m, n - 1), bool), np.zeros(m, bool)
    for k in range(n - 1, 0, -1):
        joined = np.where(inside, ~opened[:, k], by_run[:, k])  # with the atom before
        out[:, k - 1], inside = ~joined, joined
    return out


def split(text: str, model: Model, counts: dict[str, float] | None = None) -> list[str]:
    """Values of one text by the likeliest reading."""
    spans, classes = atoms(text)
    if not spans:
        return []
    values = [unquoted(text[a:b]) for a, b in spans]
    scores = model.scores(np.array([[(counts or {}).get(v, 0.0) for v in values]]), np.array([[b - a for a, b in spans]]))
    cuts = viterbi(model, scores, np.array([classes], int).reshape(1, -1))[0]
    out, first = [], 0
    for k in range(len(spans)):
        if k == len(cuts) or cuts[k]:
            out.append(values[k] if first == k else text[spans[first][0] : spans[k][1]])
            first = k + 1
    return [x for x in out if x]


_TYPE = "tid bigint, text string, n bigint, values array<string>, starts array<int>, ends array<int>, classes array<int>, hashes array<bigint>, own array<double>"


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Atoms of distinct texts (text, n). ``tid`` numbers them; it is fixed once the result is written."""
    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        rows = defaultdict(list)
        for text in batch.column(0).to_pylist():
            spans, classes = atoms(text)
            values = [unquoted(text[a:b]) for a, b in spans]
            rows["values"].append(values)
            rows["starts"].append([a for a, _ in spans])
            rows["ends"].append([b for _, b in spans])
            rows["classes"].append(classes)
            rows["hashes"].append([value_hash(v) for v in values])
            rows["own"].append([0.0] * len(values))
        tid = pa.array(range(at, at + batch.num_rows), pa.int64())
        at += batch.num_rows
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([tid, batch.column(0), batch.column(1), *[pa.array(c, pa.list_(t)) for c, t in zip(rows.values(), kinds)]], names=["tid", "text", "n", *rows])


def _expanded(state: DataFrame) -> DataFrame:
    """One row for each atom of the texts: tid, place in the text, hash, length, class of the mark after it, own share."""
    zipped = F.arrays_zip(F.col("hashes").alias("hash"), F.transform("ends", lambda e, i: e - F.get("starts", i)).alias("length"), F.col("classes").alias("class"), F.col("own").alias("own"))
    return state.select("tid", F.posexplode(zipped).alias("no", "x")).select("tid", "no", "x.hash", "x.length", F.coalesce("x.class", F.lit(0)).alias("class"), "x.own")


def _counted(state: DataFrame, known: DataFrame, hot: DataFrame) -> DataFrame:
    """Texts as arrays of their atoms, each with the count of its value but for the text's own share: tid, atoms."""
    rows = _expanded(state)
    counts = rows.select("hash", F.col("own").alias("w")).unionByName(known.select("hash", "w")).groupBy("hash").agg(F.sum("w").alias("w"))
    met = salted_join(rows, counts, ["hash"], hot, ["tid"])
    item = F.struct("no", "hash", "length", "class", (F.col("w") - F.col("own")).alias("count"))
    return met.groupBy("tid").agg(F.array_sort(F.collect_list(item)).alias("atoms"))


def _by_size(batch: pa.RecordBatch, model: Model):
    """Texts of a batch (tid, atoms) in groups of equally many atoms: rows, fields of the atoms as matrices, scores."""
    offsets = batch.column(1).offsets.to_numpy()
    flat = batch.column(1).values
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        at = offsets[rows][:, None] + np.arange(n)
        got = {name: x[at] for name, x in fields.items()}
        yield rows, got, model.scores(got["count"], got["length"])


_STATE = "tid bigint, hashes array<bigint>, starts array<int>, ends array<int>, classes array<int>, own array<double>, cuts array<double>, fresh double, total double"


def _expectations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, got, scores in _by_size(batch, model):
                n = scores.shape[1]
                own, cuts, fresh = forward_backward(model, scores, got["class"][:, :-1])
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]) if x.shape[1] else np.zeros(len(x) + 1), pa.int32()), pa.array(x.ravel(), kind))
                ends = got["length"].astype(np.int32)
                cols = [lists(got["hash"], pa.int64()), lists(np.zeros((len(rows), n), np.int32), pa.int32()), lists(ends, pa.int32()), lists(got["class"][:, :-1], pa.int32()), lists(own, pa.float64()), lists(cuts, pa.float64()), pa.array(fresh), pa.array(1.0 + cuts.sum(axis=1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *cols], names=["tid", "hashes", "starts", "ends", "classes", "own", "cuts", "fresh", "total"])

    return run


def _readings(model: Model):
    """Places that are literal in the likeliest reading, of the texts that have any: tid, literal (place numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, got, scores in _by_size(batch, model):
                cuts = viterbi(model, scores, got["class"][:, :-1])
                some = np.flatnonzero(~cuts.all(axis=1))
                if len(some):
                    literal = [np.flatnonzero(~cuts[i]).astype(np.int32) for i in some]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[some])), pa.array(literal, pa.list_(pa.int32()))], names=["tid", "literal"])

    return run


def _maximised(state: DataFrame, fixed: float) -> Model:
    """The model from the expectations. At most N_CLASSES + 1 sums reach the driver."""
    marks = F.transform("classes", lambda c, i: F.struct(c.alias("class"), F.get("cuts", i).alias("a"), F.lit(1.0).alias("b")))
    both = F.concat(marks, F.array(F.struct(F.lit(-1).alias("class"), F.col("fresh").alias("a"), F.col("total").alias("b"))))
    sums = {r["class"]: (r["a"], r["b"]) for r in state.select(F.explode(both).alias("x")).groupBy("x.class").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b")).collect()}
    fresh, total = sums.pop(-1, (0.0, 0.0))
    seen = [sums.get(c, (0.0, 0.0)) for c in range(N_CLASSES)]
    kept, places_ = sum(b - a for a, b in seen[:N_LISTED]), sum(b for _, b in seen[:N_LISTED])
    group = (kept + _RARELY * (_DRAWN * places_ + 1)) / (places_ + _DRAWN * places_ + 1)
    literal = [(b - a + _COMPANY * (group if c < N_LISTED else 0.5)) / (b + _COMPANY) for c, (a, b) in enumerate(seen)]
    return Model(literal, min(1 - 1e-6, (fresh + 0.5) / (total + 0.5)), fixed + total)


@dataclass
class Fitted:
    """A model, the counts of values that stand alone (``hash``, ``w``), and the last state of the texts it was fitted on."""

    model: Model
    known: DataFrame
    state: DataFrame


def _fit(types: DataFrame, singles: DataFrame, hot: DataFrame, tolerance: float, rounds: int) -> Fitted:
    many = F.size("hashes") > 1
    alone = singles.unionByName(types.where(F.size("hashes") == 1).select(F.get("hashes", F.lit(0)).alias("hash")))
    counted = alone.groupBy("hash").agg(F.count("*").cast("double").alias("w"))
    wanted = types.where(many).select(F.explode("hashes").alias("hash")).distinct()
    total = alone.count()
    # a value that stands alone nowhere is known with 0, so that the join of atoms with counts is an inner one
    known = written(wanted.join(counted, "hash", "left").select("hash", F.coalesce("w", F.lit(0.0)).alias("w")))
    state, model = types.where(many), Model(values=float(max(total, 1)))
    for _ in range(rounds):
        state = written(_counted(state, known, hot).mapInArrow(_expectations(model), _STATE))
        last, model = model, _maximised(state, float(total))
        if max(abs(a - b) for a, b in zip([*last.literal, last.new], [*model.literal, model.new])) < tolerance:
            break
    return Fitted(model, known, state)


def fit(df: DataFrame, text: str, tolerance: float = 0.005, rounds: int = 30) -> tuple[Model, DataFrame]:
    """The model learned from a column, and the counts of its values: ``hash``, ``w``."""
    rows = df.select(F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    types, singles, hot = _prepared(rows)
    got = _fit(types, singles, hot, tolerance, rounds)
    shares = _expanded(got.state).select("hash", F.col("own").alias("w"))
    return got.model, got.known.unionByName(shares).groupBy("hash").agg(F.sum("w").alias("w"))


def _prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct texts with a mark and their atoms, hashes of the distinct texts without one, hot values."""
    packed = F.col("__text").rlike(MAYBE_PACKED)
    types = written(rows.where(packed).groupBy("__text").agg(F.count("*").alias("n")).mapInArrow(_types, _TYPE))
    singles = rows.where(~packed & (F.trim("__text") != "")).select(F.xxhash64(F.trim("__text")).alias("hash")).distinct()
    met = types.where(F.size("hashes") > 1).select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    return types, singles, written(hot_groups(met, ["hash"], "n"))


def split_packed(df: DataFrame, text: str, keys: list[str], tolerance: float = 0.005, rounds: int = 30, model: tuple[Model, DataFrame] | None = None) -> DataFrame:
    """One row for each value of a text that holds two or more: ``keys``, ``value_no`` int from 1, ``value_text``.

    Unless a model is given (see fit()), it is learned from the whole column, in rounds until no parameter moves by
    ``tolerance`` (``rounds`` at most). Null, empty and blank texts and texts of one value give no rows; repeated rows
    give their values each time; an empty table gives an empty result. Other columns of ``df`` do not reach the result
    and may have any name. Texts are processed whole, in time linear in their length, and a value may span any number
    of literal marks. Two values whose 64-bit hashes collide share their counts, which can change a reading where a
    mark is in doubt, and never the text that comes out.

    Distinct texts are analysed once and written to the shared folder; each round shuffles their atoms as numbers. The
    rows meet their text's values in one join, in which a text with very many rows is spread over many tasks.
    """
    rows = df.select(*keys, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    types, singles, hot = _prepared(rows)
    many = types.where(F.size("values") > 1)
    if model is None:
        got = _fit(types, singles, hot, tolerance, rounds)
        learned, known, state = got.model, got.known, got.state
    else:
        learned, state = model[0], many
        wanted = many.select(F.explode("hashes").alias("hash")).distinct()
        known = wanted.join(model[1], "hash", "left").select("hash", F.coalesce("w", F.lit(0.0)).alias("w"))
    literal = _counted(state, known, hot).mapInArrow(_readings(learned), "tid bigint, literal array<int>")
    ends = F.filter(F.transform("values", lambda v, i: i), lambda i: ~F.array_contains("literal", i))
    ended = many.join(literal, "tid", "left").withColumn("__e", F.when(F.col("literal").isNotNull(), ends))
    first = lambda i: F.when(i == 0, 0).otherwise(F.get("__e", i - 1) + 1)
    run = lambda e, i: F.substring("text", F.get("starts", first(i)) + 1, F.get("ends", e) - F.get("starts", first(i)))
    joined = F.transform("__e", lambda e, i: F.when(first(i) == e, F.get("values", e)).otherwise(run(e, i)))
    values = F.filter(F.coalesce(joined, F.col("values")), lambda v: v != "")
    found = ended.select(F.col("text").alias("__text"), values.alias("__values")).where(F.size("__values") > 1)
    met = salted_join(rows.where(F.col("__text").rlike(MAYBE_PACKED)), found, ["__text"], hot_groups(types.withColumnRenamed("text", "__text"), ["__text"], "n"), keys)
    return met.select(*keys, F.posexplode("__values").alias("__no", "value_text")).select(*keys, (F.col("__no") + 1).alias("value_no"), "value_text")
