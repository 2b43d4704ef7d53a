"""Operators on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import os
import random
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossmill.llm import containers, fingerprint, lookalike, quality, quota_sample, stable_sample, tokens, top_n, train_quality


# 1: stable sample


def test_sample_is_stable(spark):
    rows = [(i, f"w{i % 700}", i % 3) for i in range(5000)] + [(9001, None, 0), (9002, "", 0)]
    df = spark.createDataFrame(rows, "id int, source string, unit_key int")
    got = {r.id for r in stable_sample.stable_sample(df, "source", 0.2).collect()}
    again = {r.id for r in stable_sample.stable_sample(df.repartition(7).orderBy(F.desc("id")), "source", 0.2).collect()}
    earlier = {r.id for r in stable_sample.stable_sample(df.where("id < 2500"), "source", 0.2).collect()}
    wider = {r.id for r in stable_sample.stable_sample(df, "source", 0.3).collect()}
    assert got == again and earlier <= got <= wider and 9001 not in got
    assert 0.15 < len(got) / 5000 < 0.25
    assert len({r[1] for r in rows if r[0] in got} & {r[1] for r in rows if r[0] not in got}) == 0
    assert stable_sample.stable_sample(df, "source", 1.0).count() == 5001
    assert stable_sample.stable_sample(df.where("false"), "source", 0.5).count() == 0
    with pytest.raises(ValueError):
        stable_sample.stable_sample(df, "source", 1.5)


# 3: duplicates hidden by formatting


def copies_by_hand(rows):
    def norm(x):
        x = x.upper().lower()
        return "".join(c for c in x if not (unicodedata.category(c)[0] in "PZ" or c.isspace()))

    groups = defaultdict(list)
    for i, lang, s, t in rows:
        if None not in (lang, s, t):
            groups[lang, tuple(sorted((norm(s), norm(t))))].append(i)
    return {min(g): len(g) for g in groups.values()}, sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


def test_formatting_copies(spark):
    rng = random.Random(2)
    base = ["fuß", "Straße", "el niño", "a-b", "", "...", "x y z", "Ünder"]
    dress = [str, str.upper, lambda x: f" {x}! ", lambda x: "-".join(x), lambda x: x.replace(" ", "\t"), lambda x: f"«{x}»"]
    rows = [(i, rng.choice(["de", "es", None]) if i % 9 else "de", rng.choice(dress)(rng.choice(base)) if i % 11 else None, rng.choice(dress)(rng.choice(base))) for i in range(600)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "entry_id int, target_lang string, source string, target string, first_id string, copies int")
    records, copies = copies_by_hand(rows)
    args = ("entry_id", ["target_lang"], ["source", "target"])
    assert {r.first_id: r.copies for r in fingerprint.collapse_formatting(df, *args).collect()} == records
    for hot in (5, 10**6):
        assert sorted((r.first_id, r.copy_id) for r in fingerprint.formatting_copies(df, *args, hot_rows=hot).collect()) == copies
    assert fingerprint.formatting_copies(df.where("false"), *args).count() == 0


def test_field_roles_matter(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "ab", ""), (4, "a", "a"), (5, "b", "b")], "id int, s string, t string")
    assert fingerprint.collapse_formatting(df.withColumn("l", F.lit("x")), "id", ["l"], ["s", "t"]).count() == 4


def test_repeated_keys(spark):
    """A key may stand on several records: each record keeps its own number of copies."""
    df = spark.createDataFrame([(1, "a", "b"), (1, "c", "d"), (2, "A", "b"), (1, "e", "f"), (1, "F.", "e")], "id int, s string, t string").withColumn("l", F.lit("x"))
    got = sorted((r.first_id, r.copies) for r in fingerprint.collapse_formatting(df, "id", ["l"], ["s", "t"]).collect())
    assert got == [(1, 1), (1, 2), (1, 2)]
    assert [(r.first_id, r.copy_id) for r in fingerprint.formatting_copies(df, "id", ["l"], ["s", "t"]).collect()] == [(1, 2)]


def test_colliding_fingerprints(spark, monkeypatch):
    """Records of one fingerprint are parted by their fields."""
    monkeypatch.setattr(fingerprint, "_fingerprint", lambda pairs, seed: F.length(pairs[0][1]).cast("bigint"))
    rows = [(1, "a", "b"), (2, "B", "a"), (3, "c", "d"), (4, "c", "e"), (5, "d", "c."), (6, "a", "b"), (7, "z", "z")]
    df = spark.createDataFrame(rows, "id int, s string, t string").withColumn("l", F.lit("x"))
    assert sorted((r.first_id, r.copies) for r in fingerprint.collapse_formatting(df, "id", ["l"], ["s", "t"]).collect()) == [(1, 3), (3, 2), (4, 1), (7, 1)]
    for hot in (2, 10**6):
        assert sorted((r.first_id, r.copy_id) for r in fingerprint.formatting_copies(df, "id", ["l"], ["s", "t"], hot_rows=hot).collect()) == [(1, 2), (1, 6), (3, 5)]


# 4: top N


def test_top_n(spark):
    nan = float("nan")
    rows = [(1, "a", "x", 2.0), (2, "a", "b", 2.0), (3, "a", "b", 2.0), (4, "a", "z", nan), (5, "a", None, 9.0), (6, "a", "c", None), (7, None, "c", 3.0), (8, "b", "é", 0.0), (9, "b", "z", -0.0), (10, "b", "a", -1.0), (11, "b", "b", -2.0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id int, g string, t string, score double, rank_no int")
    got = sorted((r.g, r.rank_no, r.id) for r in top_n.top_n(df, ["g"], "score", ["t", "id"], 3).collect())
    assert got == [("a", 1, 2), ("a", 2, 3), ("a", 3, 1), ("b", 1, 9), ("b", 2, 8), ("b", 3, 10)]
    assert top_n.top_n(df.where("false"), ["g"], "score", ["t", "id"], 3).count() == 0
    plan = top_n.top_n(df, ["g"], "score", ["t", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


# 5: quotas

TARGET = "cat_id int, zipf_lo double, zipf_hi double, confidence string, part_of_speech string, target_share double, min_rows bigint, sample_rows bigint"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 10), st.integers(0, 80)), min_size=1, max_size=12), st.integers(0, 300))
def test_allot(cats, size):
    total = sum(c[0] for c in cats) or 1
    share, floor, available = [c[0] / total for c in cats], [c[1] for c in cats], [c[2] for c in cats]
    got = quota_sample.allot(share, floor, available, size)
    low = [min(f, a) for f, a in zip(floor, available)]
    high = [a if s > 0 else b for s, a, b in zip(share, available, low)]
    assert all(b <= q <= h for q, b, h in zip(got, low, high))
    assert sum(got) == min(max(size, sum(low)), sum(high))


def test_allot_exact():
    assert quota_sample.allot([0.5, 0.3, 0.2], [0, 0, 0], [100] * 3, 10) == [5, 3, 2]
    assert quota_sample.allot([0.98, 0.02], [0, 3], [100, 100], 10) == [7, 3]
    assert quota_sample.allot([0.5, 0.5], [0, 0], [2, 100], 10) == [2, 8]
    assert quota_sample.allot([1 / 3] * 3, [0] * 3, [100] * 3, 10) == [4, 3, 3]


def test_quota_sample(spark):
    rows = [(i, "High " if i % 2 else "high", "NOUN", 1.0 if i % 3 else None) for i in range(3000)] + [(5000 + i, "low", "verb", 4.0) for i in range(4)] + [(6000, None, "noun", 1.0), (6001, "low", "verb", float("nan"))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "entry_id int, confidence string, part_of_speech string, en_zipf double, cat_id int")
    targets = spark.createDataFrame([(1, 0.0, 2.0, "high", "noun", 0.9, 0, 100), (2, 3.0, 5.0, "low", "verb", 0.1, 2, 100), (3, 5.0, 9.0, "low", "verb", 0.0, 0, 100)], TARGET)
    args = ("entry_id", "en_zipf", ["confidence", "part_of_speech"])
    report = {r.cat_id: (r.available, r.requested, r.quota, r.shortfall) for r in quota_sample.quota_report(df, targets, *args).collect()}
    assert report == {1: (3000, 90, 96, 0), 2: (4, 10, 4, 6), 3: (0, 0, 0, 0)}
    got = [(r.cat_id, r.row_id) for r in quota_sample.quota_sample(df, targets, *args).collect()]
    assert Counter(c for c, _ in got) == {1: 96, 2: 4} and len(set(got)) == 100
    assert sorted(got) == sorted((r.cat_id, r.row_id) for r in quota_sample.quota_sample(df.repartition(9), targets, *args).collect())
    assert quota_sample.quota_sample(df.where("false"), targets, *args).count() == 0
    assert {r.quota for r in quota_sample.quota_report(df.where("false"), targets, *args).collect()} == {0}


# 6: look-alikes


@pytest.mark.parametrize("a,b", [("ｆｏｏ", "foo"), ("о", "o"), ("ό", "ó"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("ﬂo", "flo"), ("ӧ", "ö"), ("o​́", "ó"), ("ậ", "ậ"), ("well‑made", "well-made"), ("K", "K"), ("﻿", ""), ("ｒｏｏｍ＇ｓ", "room's")])
def test_same_look(a, b):
    t = lookalike.transducer()
    assert t(a) == t(b)


@pytest.mark.parametrize("a,b", [("a", "A"), ("e", "é"), ("a-b", "a b"), ("2", "²"), ("l", "1"), ("rn", "m"), ("a  b", "a b"), ("ss", "ß")])
def test_other_look(a, b):
    t = lookalike.transducer()
    assert t(a) != t(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_forms_are_final(s):
    t = lookalike.transducer()
    assert t(t(s)) == t(s) and t(unicodedata.normalize("NFD", s)) == t(unicodedata.normalize("NFC", s))


_changed = lru_cache(lookalike.compile_mapping)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aеоiз1 -ﬁｆḍệїά가각") + ["\u0301", "\u0323", "\u0302", "\u0308", "\u200b", "\u200d", "\u1100", "\u1161", "\u11a8", "\u09c7", "\u09be", "\u0f71", "\u0f73", "\u0344", "\u0338", "\u00a0", "\ufeff"]), max_size=14) | st.text(max_size=20))
def test_against_normalisation(s):
    """The transducer against decomposition, the map of single characters, and composition of the whole text."""
    nfd = unicodedata.normalize("NFD", s)
    changed = _changed()
    assert lookalike.transducer()(s) == (s if s.isascii() else unicodedata.normalize("NFC", "".join(changed.get(c, c) for c in nfd)))


def test_long_marks():
    t = lookalike.transducer()
    assert len(t("a" + "́" * 100_000 + "б" * 100_000)) > 100_000


def test_lookalike_pairs(spark):
    rows = [(1, "es", "foo", "bar"), (2, "es", "fоo", "bar"), (3, "es", "foo", "bar"), (4, "es", "foo", "bаr"), (5, "de", "foo", "bar"), (6, "es", "Foo", "bar"), (7, None, "foo", "bar"), (8, "es", None, "bar"), (9, "es", "fоo", "bar")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "entry_id int, target_lang string, source string, target string, entry_id_a int")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] == "es" and {a[0], b[0]} <= {1, 2, 3, 4, 9} and a[2:] != b[2:])
    for hot in (2, 10**6):
        assert sorted(map(tuple, lookalike.lookalike_pairs(df, "entry_id", "target_lang", ["source", "target"], hot_rows=hot).collect())) == want
    assert lookalike.lookalike_pairs(df.where("false"), "entry_id", "target_lang", ["source", "target"]).count() == 0
    for hot in (2, 10**6):
        got = {r.entry_id: (r.class_id, r.n_links) for r in lookalike.lookalike_classes(df, "entry_id", "target_lang", ["source", "target"], hot_rows=hot).collect()}
        assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (1, 4), 5: (5, 0), 6: (6, 0), 9: (1, 3)}
        assert all(n == sum(k in p for p in want) for k, (_, n) in got.items())
    assert lookalike.lookalike_classes(df.where("false"), "entry_id", "target_lang", ["source", "target"]).count() == 0
    forms = {r.entry_id: r.source for r in lookalike.one_form(df, ["entry_id"], ["source"]).collect()}
    assert forms[2] == "foo" and forms[8] is None


# 7: tokens


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab zZ019'’sStre.-_\n\t  é漢😀\x1c\x85")), max_size=80), st.integers(1, 9))
def test_tree_equals_whole(s, leaf):
    enc = tokens.encoding().encode_ordinary
    assert tokens.encode(s, enc, leaf) == enc(s)


def test_long_texts():
    enc = tokens.encoding()
    for s in ("a" * 60_000, " " * 60_000, "word " * 20_000, "\n" * 50_000 + "x", "漢字" * 20_000):
        ids = tokens.encode(s, enc.encode_ordinary)
        assert ids == enc.encode_ordinary(s) and tokens.decode(ids) == s


def test_token_tables(spark):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> world", 5), (2, "", 5), (3, None, 5), (1, "Hello <|endoftext|> world", 5)], "doc_id bigint, text string, ids int")
    got = [(r.doc_id, r.ids) for r in tokens.encode_corpus(df, "doc_id", "text").collect()]
    assert Counter(k for k, _ in got) == {1: 2, 2: 1, 3: 1} and all(x == [] for k, x in got if k > 1)
    assert 50256 not in got[0][1] and tokens.decode(got[0][1]) == "Hello <|endoftext|> world"
    assert {(r.doc_id, r.n_tokens) for r in tokens.token_counts(df, "doc_id", "text").collect()} == {(1, len(got[0][1])), (2, 0), (3, 0)}
    assert tokens.encode_corpus(df.where("false"), "doc_id", "text").count() == 0


# 8: containers


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=14), st.integers(1, 60))
def test_best_fill(lengths, room):
    counts = Counter(lengths)
    got = containers.best_fill(counts, sorted(counts, reverse=True), room)
    assert all(0 < k <= counts[n] for n, k in got)
    reach = {0}
    for n in lengths:
        reach |= {r + n for r in reach if r + n <= room}
    assert sum(n * k for n, k in got) == max(reach)


def test_fill_all(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 3, 17, 60, 100, 101, 450, None])) for i in range(3000)] + [(7, 60)] * 500
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, n int, container_id int")
    specs = spark.createDataFrame([(1, 100), (2, 64)], "spec_id int, capacity_tokens bigint")
    got = containers.fill_all(df, "doc_id", "n", specs, partitions=3).collect()
    for spec, capacity in ((1, 100), (2, 64)):
        load, pieces = Counter(), Counter()
        for r in got:
            if r.spec_id == spec:
                pieces[r.doc_id] += r.piece_to - r.piece_from
                if r.container_id is None:
                    assert r.piece_to == 0
                else:
                    load[r.container_id] += r.piece_to - r.piece_from
        want = Counter()
        for k, n in rows:
            want[k] += n or 0
        assert +pieces == +want and max(load.values()) <= capacity
        whole = sum(want.values())
        assert len(load) <= 1.12 * whole / capacity + 3
        assert all(r.piece_no == 1 for r in got if r.spec_id == spec and (r.piece_to - r.piece_from) < capacity and r.piece_from == 0)
    assert containers.fill_all(df.where("false"), "doc_id", "n", specs).count() == 0
    with pytest.raises(ValueError):
        containers.fill_all(df, "doc_id", "n", spark.createDataFrame([(1, 0)], "spec_id int, capacity_tokens bigint"))


# 9: quality

KINDS = {
    "prose": "She reached the fence because it was too soft for the lock. What do you call a rain that has no carpet?\n\nNobody could hold the wall that he had pulled.",
    "list": "- nail, dark\n- hammer\n- quiet lamp\n- river\n- old stone\n- bell\n- desk\n- shoe",
    "table": "| source | rank | gloss |\n|---|---|---|\n| dog | 12 | animal |\n| cat | 55 | animal |\n| bell | 7 | thing |",
    "junk": "ggnqnmdcgn;.m fc sc'h dktlx. tddx [rsk.vbz,.h.w bv xwc v'nqz sgvdjzm; ,;kr n.]scx qqczw ksbsxdcx] fqjbgz'xkp",
}


def test_kinds(spark):
    rows = [(k, v, 0.0) for k, v in KINDS.items()] + [("none", None, 0.0), ("empty", "", 0.0), ("blank", " \n\t", 0.0), ("wide", "\u00a0\u3000\n\u2003", 0.0), ("crlf", KINDS["list"].replace("\n", "\r\n"), 0.0), ("soup", "with a on to in with is is it in at and in to in to the for to to with it in a to and", 0.0), ("long", (KINDS["prose"] + "\n") * 3000, 0.0)]
    df = spark.createDataFrame(rows, "id string, text string, kind double")
    got = {r.id: r.kind for r in quality.text_kinds(df, "id", "text").collect()}
    assert got == {k: k for k in KINDS} | {"none": None, "empty": None, "blank": None, "wide": None, "crlf": "list", "soup": "junk", "long": "prose"}
    assert got == {r.id: r.kind for r in quality.text_kinds(df, "id", "text", only=None).collect()}
    assert quality.text_kinds(df.where("false"), "id", "text").count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat is here today.\r\nx y\n\n12 !!"), (2, None)], "id int, text string")
    got = {r.id: r for r in quality.with_statistics(df, "id", "text").collect()}
    r = got[1]
    assert (r.n_words, r.distinct_words, r.line_words) == (7, 7, 7 / 3)
    assert r.sentence_end_share == pytest.approx(2 / 3) and r.clause_share == pytest.approx(1 / 7) and r.mean_word_len == pytest.approx(19 / 7)
    assert r.digit_ratio == pytest.approx(2 / 24) and r.symbol_ratio == pytest.approx(3 / 24)
    assert all(got[2][s] == 0 for s in quality.STATISTICS)


def test_learner():
    rng = np.random.default_rng(5)
    x = {"a": rng.random(900), "b": rng.random(900)}
    kinds = np.where((x["a"] > 0.7) & (x["b"] <= 0.5), "x", "prose").astype(object)
    model = train_quality.Irep(("a", "b")).fit({s: v[:600] for s, v in x.items()}, kinds[:600], ("x",))
    got = train_quality.apply(model, {s: v[600:] for s, v in x.items()})
    assert (got == kinds[600:]).sum() > 290
    kinds = rng.permutation(kinds)  # nothing to learn: the first rule errs on more than half and ends it
    model = train_quality.Irep(("a", "b")).fit(x, kinds, ("x",))
    assert len(model) < 5
    assert train_quality.tightest([("a", "<=", 3.0), ("b", ">", 1.0), ("a", "<=", 2.0)]) == [["a", "<=", 2.0], ["b", ">", 1.0]]


def test_labels():
    """What is judged was not learned from, and every document has one label."""
    learn, judge = (train_quality.labels()[part] for part in ("learn", "judge"))
    assert not learn.keys() & judge.keys() and len(learn) == 3262 and len(judge) == 220


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="the labelled documents are not here")
def test_held_out_accuracy(spark):
    """The rules against the labels of documents they were not learned on."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    judge = train_quality.labels()["judge"]
    got = quality.text_kinds(docs.where(F.col("doc_id").isin(list(judge))), "doc_id", "text", only=None).collect()
    assert len(got) == len(judge) and sum(judge[r.doc_id] == r.kind for r in got) >= 0.98 * len(got)
