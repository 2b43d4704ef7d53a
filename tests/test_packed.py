"""Packed fields: rules on small texts, a brute-force splitter, what training learns, odd tables."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossmill.operators import packed
from glossmill.operators.packed import BREAKS, CLASSES, LEARNED, LISTED, N_CLASSES, N_LISTED, Model, fit, forward_backward, split, split_packed, value_hash, viterbi

CASES = [
    ("dog; hound", ["dog", "hound"]),
    ("a , b|c\td\ne", ["a", "b", "c", "d", "e"]),
    ("red OR blue or  green", ["red", "blue", "green"]),
    ("bread and water; well-made: it's fine.", ["bread and water", "well-made: it's fine."]),
    ('"a, b"; "say ""x, y"" now"', ["a, b", 'say "x, y" now']),
    ("«a or b» / 'c, d' / “e;f”", ["a or b", "c, d", "e;f"]),
    ("the 'x, y' part, hill's top", ["the 'x, y' part", "hill's top"]),
    ("(of a, b) wide; page [x, y]", ["(of a, b) wide", "page [x, y]"]),
    ("1/2 net; 2,814 mirrors; 3, 4", ["1/2 net", "2,814 mirrors", "3", "4"]),
    (";; a ;; , b ||", ["a", "b"]),
    ("(a (b, c) d); e", ["(a (b, c) d)", "e"]),
    ('open "quote, x; y', ['open "quote', "x", "y"]),
    ("order, ordinary", ["order", "ordinary"]),
    ("a、b；c，d•e·f", list("abcdef")),
]
#: As training leaves it on a column whose values recur.
TRAINED = Model([0.001] * N_LISTED + [0.5] * len(LEARNED), 0.3, 1e6)


@pytest.mark.parametrize("text,values", CASES)
def test_rules(text, values):
    assert split(text, TRAINED) == values


def test_rules_after_training(spark):
    """The model that a small column of recurring values teaches gives the same values."""
    words = [f"w{i}" for i in range(40)]
    column = [(f"{a}, {b}" if i % 2 else f"{a}; {b}",) for i, a in enumerate(words) for b in words[i % 7 :: 7]] + [(w,) for w in words] + [(t,) for t, _ in CASES]
    df = spark.createDataFrame(column, "t string")
    model, _ = fit(df, "t")
    assert max(model.literal[:N_LISTED]) < 0.2 and model.literal[N_LISTED:] == [0.5] * len(LEARNED)
    got = {}
    for r in split_packed(df, "t", ["t"]).collect():
        got.setdefault(r.t, {})[r.value_no] = r.value_text
    assert all([got[t][n] for n in sorted(got[t])] == v for t, v in CASES)


def test_untrained_model_is_worse():
    """At even odds two values that are known nowhere stay one; training is what parts them."""
    assert split("dog; hound", Model()) == ["dog; hound"]


def brute(t):
    """Splits bare texts (no quotes or brackets) at every listed mark."""
    out, cur = [], ""
    for i, c in enumerate(t):
        digits = 0 < i < len(t) - 1 and t[i - 1].isdigit() and t[i + 1].isdigit()
        if c in BREAKS or (c in LISTED and not digits):
            out.append(cur)
            cur = ""
        else:
            cur += c
    parts = [y for x in [*out, cur] for y in re.split(r"(?<![\w'-])or(?![\w'-])", x)]
    return [x.strip() for x in parts if x.strip()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 ,;/|\n-or", max_size=40))
def test_against_brute_force(t):
    assert split(t, TRAINED) == brute(t)


def readings(scores, keep, cut, new):
    """Every reading of a few atoms: (weight, places that separate)."""
    n = len(scores)
    for bits in range(1 << (n - 1)):
        cuts = [bool(bits >> k & 1) for k in range(n - 1)]
        weight, first = 1.0, 0
        for k in range(n):
            if k == n - 1 or cuts[k]:
                weight *= np.exp(scores[k]) if first == k else new
                first = k + 1
            if k < n - 1:
                weight *= np.exp(cut[k] if cuts[k] else keep[k])
        yield weight, cuts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-3, 6), min_size=1, max_size=6), st.floats(0.05, 0.9), st.data())
def test_lattice_against_all_readings(scores, new, data):
    model = Model(data.draw(st.lists(st.floats(0.05, 0.95), min_size=N_CLASSES, max_size=N_CLASSES)), new)
    classes = np.array([data.draw(st.lists(st.integers(0, N_CLASSES - 1), min_size=len(scores) - 1, max_size=len(scores) - 1))], int).reshape(1, -1)
    scores = np.logaddexp(np.log(new), np.array([scores]))
    keep, cut = model.marks(classes)
    every = list(readings(scores[0], keep[0], cut[0], new))
    total = sum(w for w, _ in every)
    own, cuts, fresh = forward_backward(model, scores, classes)
    for k in range(scores.shape[1]):
        alone = sum(w for w, c in every if (k == 0 or c[k - 1]) and (k == len(c) or c[k]))
        assert own[0, k] == pytest.approx(alone / total)
    for k in range(scores.shape[1] - 1):
        assert cuts[0, k] == pytest.approx(sum(w for w, c in every if c[k]) / total)
    runs = sum(w * sum(1 for i, x in enumerate([*c, True]) if x and i and not c[i - 1]) for w, c in every) / total
    assert fresh[0] == pytest.approx((own * new / np.exp(scores)).sum() + runs)
    best = viterbi(model, scores, classes)[0].tolist()
    assert dict((tuple(c), w) for w, c in every)[tuple(best)] == pytest.approx(max(w for w, _ in every))


def test_learned_marks():
    """A mark of unknown role separates where its sides are known values, and is kept where they are not."""
    counts = {"cat": 1e5, "dog": 1e5}
    assert split("cat + dog", TRAINED, counts) == ["cat", "dog"]
    assert split("xqv + zzw; cat", TRAINED, counts) == ["xqv + zzw", "cat"]
    assert split("a + b = c & d ~ e; cat", TRAINED, counts) == ["a + b = c & d ~ e", "cat"]


def test_literal_marks_are_learned(spark):
    """Of marks alone, one that joins what recurs only together stays literal; one between recurring values separates."""
    joined = [(f"n{i} & m{i}",) for i in range(60)]
    parted = [(f"v{i} = v{(i * 7 + k) % 60}",) for i in range(60) for k in range(4)] + [(f"v{i}",) for i in range(60)]
    df = spark.createDataFrame(joined + parted, "t string")
    model, _ = fit(df, "t")
    assert model.literal[CLASSES["&"]] > 0.5 > 0.2 > model.literal[CLASSES["="]]
    got = {r.t for r in split_packed(df, "t", ["t"]).collect()}
    assert not got & {t for (t,) in joined} and got == {t for (t,) in parted if "=" in t}


def test_long_text():
    t = "; ".join(f"v{i}" for i in range(50_000)) + "(" * 20_000
    assert len(split(t, TRAINED)) == 50_000


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "one", "x"), (5, "a; b", "x"), (5, "a; b", "x"), (None, "c, d", None)]
    df = spark.createDataFrame(rows, "id bigint, text string, value_text string")
    got = sorted((r.id or 0, r.value_no, r.value_text) for r in split_packed(df, "text", ["id"]).collect())
    assert got == [(0, 1, "c"), (0, 2, "d"), (5, 1, "a"), (5, 1, "a"), (5, 2, "b"), (5, 2, "b")]
    assert split_packed(df.where("false"), "text", ["id"]).count() == 0


def test_given_model(spark):
    """A model fitted elsewhere, with its counts, reads other texts; literal marks inside a value of any length stay."""
    taught = spark.createDataFrame([("cat",), ("dog",), ("cat; dog",), ("dog, cat",), ("cat / dog",)], "t string")
    other = spark.createDataFrame([(1, "cat + dog"), (2, "x1 + x2 + x3 + x4 + x5; y"), (3, '"q; r" | s')], "id int, t string")
    got = {}
    for r in split_packed(other, "t", ["id"], model=fit(taught, "t")).collect():
        got.setdefault(r.id, []).append((r.value_no, r.value_text))
    assert {k: [v for _, v in sorted(x)] for k, x in got.items()} == {1: ["cat", "dog"], 2: ["x1 + x2 + x3 + x4 + x5", "y"], 3: ["q; r", "s"]}


def test_hot_text(spark, monkeypatch):
    """A text with nearly all rows is spread; every row gets its values."""
    monkeypatch.setattr(packed, "hot_groups", lambda groups, keys, size, real=packed.hot_groups: real(groups, keys, size, hot_rows=10))
    df = spark.range(500).selectExpr("id", "if(id < 450, 'cat; dog', concat('w', id % 5, ', cat')) AS t")
    got = split_packed(df, "t", ["id"])
    assert got.count() == 1000 and got.where("value_no = 1").select("id").distinct().count() == 500


def test_hash_is_sparks(spark):
    assert value_hash("größe") == spark.sql("SELECT xxhash64('größe') h").first().h
