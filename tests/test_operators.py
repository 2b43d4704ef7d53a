"""Operators of the core on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from glossmill.functions import grammar, text
from glossmill.operators import dictionary, page, quality, review
from glossmill.operators.skew import join_groups
from glossmill.sources import html, readers, sinks


def column(spark, make, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(make.alias("x")).collect()]


def test_normalise_and_best(spark):
    raw = spark.createDataFrame(
        [("dog", "n", ["perro"], ["a domesticated animal"], 0), ("accurate", "adj", ["preciso"], ["correct in details"], 1), ("about", "preposition", ["sobre"], ["concerning something"], 2), ("to", "particle", ["-ar"], ["infinitive marker"], 3), ("bad/unsafe", "n", ["malo"], ["unsafe"], 4),
         ("number", "v", ["numerar"], ["to count"], 5), ("number", "n", ["número"], ["a count"], 6), ("well", "interjection", ["pues"], ["so"], 7), ("well", "n", ["pozo"], ["a hole"], 8), ("well", "adv", ["bien"], ["good"], 9), ("of course", "adv", ["por supuesto"], ["(formal) yes"], 10), ("nil", "n", None, ["x"], 11), (None, "n", ["x"], ["x"], 12)],
        "source string, raw_pos string, translations array<string>, definitions array<string>, source_order bigint",
    )
    best = {r.source: r for r in dictionary.best_by(dictionary.normalise(raw), ["source"], [F.col("rank_priority"), F.col("source_order")]).collect()}
    assert set(best) == {"dog", "accurate", "about", "number", "well", "of course"}
    assert (best["dog"].gender, best["dog"].plural) == ("masculine", "perros")
    assert best["about"].function_subtype == "preposition" and best["number"].target == "número" and best["number"].plural == "números"
    assert best["well"].part_of_speech == "adverb" and best["of course"].part_of_speech == "expression" and best["of course"].source_gloss == "yes"
    pairs = spark.createDataFrame([("dog", "perro")], "source string, target string")
    sure = dictionary.normalise(raw, pairs=pairs, provenance=["b", "a"]).where("source = 'dog'").first()
    assert sure.confidence == "high" and sure.source_ids == ["freedict", "a", "b"]


@pytest.mark.parametrize("gloss,pieces", [("dog; hound", ["dog", "hound"]), ("big, large", ["big", "large"]), ("to run", ["run"]), ("a house", ["house"]), ("the", []), ("of", []), ("i", []), ("ice cream", ["ice cream"]), ("kind of fish", []), ("why don't you", []), ("(x) hot [y] or cold", ["hot", "cold"])])
def test_gloss_pieces(spark, gloss, pieces):
    got = column(spark, F.transform(dictionary.gloss_pieces(F.col("g")), lambda x: x["piece"]), [(gloss,)], "g string")
    assert got == [pieces]


def test_articles(spark):
    rows = [("es", "agua", "aguas", "feminine", False, "definite", "el agua"), ("es", "agua", "aguas", "feminine", True, "definite", "las aguas"), ("de", "haus", "häuser", "neuter", False, "indefinite", "ein Haus"), ("de", "haus", "häuser", "neuter", True, "indefinite", "Häuser"), ("fr", "homme", "hommes", "masculine", False, "definite", "l'homme"), ("fr", "héros", "héros", "masculine", False, "definite", "le héros"), ("it", "studente", "studenti", "masculine", False, "definite", "lo studente"), ("it", "studente", "studenti", "masculine", True, "definite", "gli studenti"), ("it", "amica", "amiche", "feminine", False, "indefinite", "un'amica"), ("it", "iato", "iati", "masculine", False, "definite", "lo iato"), ("es", "casa", "casas", "feminine", False, None, "casa")]
    df = spark.createDataFrame(rows, "l string, t string, p string, g string, m boolean, k string, want string")
    got = df.select(grammar.article_form(*[F.col(c) for c in "ltpgmk"]).alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_capitals_and_lemmas(spark):
    got = column(spark, text.match_capitals(F.col("a"), F.col("b")), [("The Dog", "el perro"), ("DOG", "perro"), ("dog", "Perro"), ("A", "un"), ("12", "perro"), ("Dog", "¡hola"), ("Dog", "12")], "a string, b string")
    assert got == ["El perro", "PERRO", "Perro", "UN", "perro", "¡Hola", "12"]
    assert column(spark, grammar.singular(F.col("w")), [(w,) for w in ("cities", "knives", "boxes", "cats", "bus", "gas")], "w string") == ["city", "knife", "box", "cat", "bus", "gas"]
    assert column(spark, grammar.verb_lemma(F.col("w")), [(w,) for w in ("went", "running", "makes", "cried", "walked", "see")], "w string") == ["go", "run", "make", "cri", "walk", "see"]


def test_sentences(spark):
    t = "First one. Second here! Third"
    got = column(spark, text.sentence_context(F.lit(t), F.col("at")), [(0,), (12,), (25,)], "at int")
    assert got == ["First one.", "Second here!", "Third"]
    long = column(spark, text.sentence_context(F.lit("x" * 300), F.lit(5)), [(1,)], "a int")[0]
    assert len(long) == 198 and long.endswith("…")
    assert column(spark, text.blank_word(F.col("s"), F.col("w")), [("A cat, a Cat.", "cat"), ("catalog", "cat"), ("a.b c", "a.b"), (None, "x")], "s string, w string") == ["A ___, a Cat.", None, "___ c", None]


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "It's  a well-made, 😀 café"), (2, ""), (3, None), (4, "!!")], "id bigint, text string")
    got = [(r.token, r.start, r.end) for r in text.tokens(docs, "id", "text").orderBy("id", "token_no").collect()]
    assert got == [("It's", 0, 4), ("a", 6, 7), ("well-made", 8, 17), ("café", 21, 25)]


def test_ranges(spark):
    rows = [(1, 0, 2, 0, "an"), (1, 0, 14, 0, "opportunity"), (1, 15, 19, 0, "next"), (2, 0, 12, 1, "noun"), (2, 4, 24, 2, "expression"), (3, 5, 5, 1, "empty")]
    got = page.select_ranges(spark.createDataFrame(rows, "id int, start int, end int, priority int, name string"), ["id"]).collect()
    assert sorted((r.id, r.name) for r in got) == [(1, "next"), (1, "opportunity"), (2, "expression")]


def test_render_and_restore(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "no words"), (3, None)], "id int, text string")
    chosen = spark.createDataFrame([(1, 0, 7, "el gato"), (1, 8, 11, "s")], "id int, start int, end int, display string")
    assert {r.id: r.rendered for r in page.render(docs, chosen, ["id"], "text").collect()} == {1: "el gato s", 2: "no words", 3: None}
    assert {r.id: r.rendered for r in page.render(docs, chosen.where("false"), ["id"], "text").collect()} == {1: "the cat sat", 2: "no words", 3: None}
    assert {r.id: r.restored for r in page.restore(page.render(docs, chosen, ["id"], "text"), ["id"]).collect()} == {1: "the cat sat", 2: "no words", 3: None}


LEXICON = "target_lang string, key string, part_of_speech string, function_subtype string, n_words int"


def phrases(spark, docs, *keys):
    """Matches of expressions, and of other entries given as (key, part of speech)."""
    rows = [("es", k, "expression", None, len(k.split())) if isinstance(k, str) else ("es", *k, *[None] * (3 - len(k)), 1) for k in keys]
    return page.matches(docs, spark.createDataFrame(rows, LEXICON), "id", "text")


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "Of course, of course not"), (2, "of, course"), (3, "alternating series test is")], "id int, text string")
    found = phrases(spark, docs, "of course", "alternating series", "alternating series test")
    got = page.greedy_matches(found, ["id"]).collect()
    assert sorted((r.id, r.start, r.lemma) for r in got) == [(1, 0, "of course"), (1, 11, "of course"), (3, 0, "alternating series test")]


def test_word_matches(spark, monkeypatch):
    """Forms go to the part of speech that comes first; determiners and pronouns are met nowhere; any join gives the same."""
    docs = spark.createDataFrame([(1, "Every dogs walked, the well-made dog walks about it. Glasses")], "id int, text string")
    entries = [("every", "function", "determiner"), ("dog", "noun"), ("walk", "verb"), ("walk", "noun"), ("about", "function", "preposition"), ("it", "noun"), ("glass", "noun"), ("the", "function", "determiner")]
    for most in (0, 10**6):
        monkeypatch.setattr(page, "BROADCAST", most)
        got = sorted((r.start, r.lemma, r.kind, r.made) for r in phrases(spark, docs, *entries).collect())
        assert got == [(6, "dog", "noun", 1), (11, "walk", "verb", 1), (33, "dog", "noun", 0), (37, "walk", "noun", 1), (43, "about", "function", 0), (53, "glass", "noun", 1)]


def test_scheduler(spark):
    rows = [("a", i, i, ok) for i, ok in enumerate([True, True, True, False, True])] + [("b", 0, 0, True), ("b", 0, 1, None), (None, 0, 0, True)]
    got = {r.k: r for r in review.fold_answers(spark.createDataFrame(rows, "k string, ts bigint, id bigint, ok boolean"), ["k"], "ts", "id", "ok").collect()}
    assert (got["a"].srs_interval, round(got["a"].srs_ease, 6), got["a"].srs_repetitions, got["a"].history) == (1, 2.7, 1, "11101")
    assert got["b"].srs_repetitions == 0 and got[None].srs_repetitions == 1
    assert review.lifecycle(21, "0111") == "graduated" and review.lifecycle(22, "0101") == "mature" and review.lifecycle(7, "1") == "reviewing" and review.lifecycle(1, "") == "learning"


def test_density(spark):
    rows = [(0.5, 1.0, 19, 0), (0.5, 1.0, 20, 0), (0.5, 1.0, 20, 9), (0.5, 0.3, 20, 0), (0.5, 0.7, 20, 0), (0.005, 0.0, 20, 0)]
    got = column(spark, review.adjusted_density(*[F.col(c) for c in "daer"]), rows, "d double, a double, e int, r int")
    assert [round(x, 6) for x in got] == [0.5, 0.52, 0.5, 0.49, 0.5, 0.0]


def test_skewed_join_keeps_all(spark):
    rows = spark.range(5000).selectExpr("id", "if(id < 4000, 'hot', concat('k', id % 7)) AS k")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = join_groups(rows, groups, ["k"], "n", ["id"], hot_rows=1000)
    assert got.count() == 5000 and got.where("k = 'hot'").select("first").distinct().count() == 1


def test_upsert(spark):
    base, new = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int"), spark.createDataFrame([("b", 9), (None, 8), ("c", 7)], "k string, v int")
    assert sorted((r.k or "", r.v) for r in sinks.upsert(base, new, ["k"]).collect()) == [("", 8), ("a", 1), ("b", 9), ("c", 7)]


def test_violations(spark):
    schema = "entry_id int, target_lang string, source string, target string, part_of_speech string, source_gloss string, frequency_rank bigint, confidence string, source_ids array<string>, gender string, plural string, function_subtype string"
    good = (1, "es", "dog", "perro", "noun", "animal", 5, "high", ["a"], "masculine", "perros", None)
    bad = (2, "es", "Dog", "-ar", "verb", " ", 0, "sure", [], "masculine", None, "pronoun")
    got = {(r.entry_id, r.code) for r in quality.violations(spark.createDataFrame([good, bad], schema), F.col("source")).collect()}
    assert got == {(2, c) for c in ("key", "target", "gloss", "rank", "confidence", "source_ids", "extra_gender", "extra_subtype")}


def test_html():
    page_html = "<html lang=es><body><p>One <b>two<p>three<script>no</script><div lang='de'>nein</div><div class='x CodeMirror'>no</div><input>four<p lang='en-GB'>five</body></html>"
    assert html.nodes(page_html) == ["One ", "two", "three", "four", "five"]
    assert html.nodes("") == [] and html.nodes("plain & <3 text") != []
    assert html.nodes("<p data-own>x</p>y", frozenset({"data-own"})) == ["y"]


def test_readers(spark, tmp_path):
    (tmp_path / "d.tei").write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><entry><form><orth>dog</orth></form><gramGrp><pos>n</pos></gramGrp><sense><cit type="trans"><quote>perro</quote></cit><sense><def>an <b>animal</b></def></sense></sense></entry><entry><form><orth>x</orth></form></entry><entry><form><orth>cat</orth></form><gramGrp><pos>n</pos></gramGrp><cit type="trans"><quote>gato</quote></cit></entry></body></text></TEI>')
    got = readers.read_tei(spark, str(tmp_path / "d.tei")).orderBy("source_order").collect()
    assert [(r.source, r.translations, r.definitions, r.source_order) for r in got] == [("dog", ["perro"], ["an animal"], 0), ("cat", ["gato"], [], 2)]
    (tmp_path / "w.jsonl").write_text('{"word":"Hund","pos":"noun","tags":["masculine"],"forms":[{"form":"Hunde","tags":["plural"]}],"senses":[{"glosses":["dog; hound"]},{"glosses":["x"],"form_of":[{"word":"y"}]}]}\n\nbad\n')
    records = readers.read_jsonl(spark, str(tmp_path / "w.jsonl"), readers.WIKT, strict=False)
    senses = readers.wikt_senses(records).collect()
    assert [(r.target, r.gender, r.plural, r.gloss, r.sense_index) for r in senses] == [("Hund", "masculine", "Hunde", "dog; hound", 0)]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "w.jsonl"), readers.WIKT, strict=True).collect()
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), readers.WIKT, strict=True).count() == 0
    (tmp_path / "p.json").write_text('{"version":"1","sourceLanguage":"en","targetLanguage":"es","entries":{"dog":{"source":"dog","target":"perro","partOfSpeech":"noun","frequencyRank":1,"sourceIds":["a"]}}}')
    assert readers.read_pack(spark, str(tmp_path / "p.json"), "es").first().target == "perro"
    with pytest.raises(Exception):
        readers.read_pack(spark, str(tmp_path / "p.json"), "de").collect()
    assert readers.read_fragment(spark, str(tmp_path / "p.json")).first().key == "dog"
    (tmp_path / "words").write_text("Dog\n dog \n\ncat\n")
    assert sorted(r.word for r in readers.read_words(spark, str(tmp_path / "words")).collect()) == ["cat", "dog"]
    (tmp_path / "r.json").write_text('{"result":{"decisions":[{"source":"dog","action":"keep"}]}}')
    assert readers.read_result(spark, str(tmp_path / "r.json"), "struct<source:string,action:string>").first().action == "keep"


def test_translations(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"word":"dog","pos":"noun","senses":[{"glosses":["animal"],"translations":[{"code":"de","word":"Hund"},{"lang_code":"fr","word":"chien"}]}],"translations":[{"code":"de","word":"Hund","tags":["masculine"]},{"code":"ru","word":"x"},{"code":"es","word":"-"}]}\n')
    got = readers.picked_translations(readers.read_jsonl(spark, str(tmp_path / "e.jsonl"), readers.WIKT, strict=False)).collect()
    assert sorted(((r.code, r.target, r.tags, r.gloss) for r in got), key=str) == [("de", "Hund", ["masculine"], "animal"), ("fr", "chien", None, "animal")]


def test_state_and_settings(spark):
    s = readers.with_state_defaults(spark.createDataFrame([("a", None)], "lemma string, seenCount bigint")).first()
    assert (s.seenCount, s.srsEaseFactor, s.lifecycleState, s.recallHistory) == (0, 2.5, "unseen", [])
    stored = spark.createDataFrame([(1, 0.3, "xx"), (2, None, "de")], "user_id int, density double, targetLanguage string")
    patch = spark.createDataFrame([(2, 0.9), (3, 0.1)], "user_id int, density double")
    got = {r.user_id: (r.density, r.targetLanguage, r.quizzesEnabled) for r in readers.merged_settings(stored, patch).collect()}
    assert got == {1: (0.3, "es", True), 2: (0.9, "de", True), 3: (0.1, "es", True)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([('say "x"', "a\tb", "noun", "g,h", "m", "p", None), ("w", None, None, None, None, None, None)], "lemma string, target string, part_of_speech string, source_gloss string, gender string, plural string, saved_at timestamp")
    csv = [r[0] for r in df.select(sinks.csv_line(["lemma", "target", "gender"], "saved_at", noun_only=("gender",))).collect()]
    assert csv == ['"say ""x""","a\tb","m",""', '"w","","",""']
    assert [r[0] for r in df.select(sinks.tsv_line("lemma", "target", "source_gloss")).collect()] == ['a b\tsay "x" - g,h', "w\tw"]
    sinks.write_chunks(df.selectExpr("lemma", "0 AS chunk_id"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2


def test_weighted_sample_prefers_weight(spark):
    df = spark.range(2000).selectExpr("id", "if(id < 200, 100.0D, 1.0D) AS w")
    got = quality.weighted_sample(df, "id", F.col("w"), 200, "s")
    assert got.count() == 200 and got.where("id < 200").count() > 120 and math.isfinite(got.count())


def test_api(spark):
    from glossmill import api

    schema = "entry_id int, target_lang string, source string, target string, part_of_speech string, confidence string, gender string, plural string, frequency_rank bigint"
    core = spark.createDataFrame([(1, "es", "Dog", "perro", "noun", "high", "masculine", "perros", 2), (2, "es", "go", "ir", "verb", "low", None, None, 1), (3, "es", "by the way", "por cierto", "expression", "high", None, None, 3)], schema)
    tail = spark.createDataFrame([(9, "es", "dog", "can", "noun", "low", "masculine", "canes", 1_000_001), (10, "es", "zax", "zax", "verb", "low", None, None, 1_000_002)], schema)
    both, alone = api.Lexicon(core, tail), api.Lexicon(core)
    assert {(r.key, r.shard) for r in both.entries().collect()} == {("dog", "core"), ("by the way", "core"), ("zax", "tail")}
    assert alone.entries().count() == 2 and both.expressions().count() == 1
    assert [r.key for r in both.top(1).collect()] == ["go"] and both.sample(5, "s").count() == 2
    raw = spark.createDataFrame([("cat", "n", ["gato"], ["animal"], 0), ("dog", "n", ["perro"], ["animal"], 1)], "source string, raw_pos string, translations array<string>, definitions array<string>, source_order bigint")
    pack = api.build_dictionary_pack(raw, core.withColumn("source", F.lower("source")), target_count=4)
    assert pack.where("source = 'cat'").first().frequency_rank == 4
    with pytest.raises(ValueError):
        api.build_dictionary_pack(raw, core.withColumn("source", F.lower("source")), target_count=9)
    senses = spark.createDataFrame([("de", "noun", "Hund", "masculine", "Hunde", "dog; hound", 0, False, 1), ("de", "verb", "laufen", None, None, "to run", 0, False, 2), ("de", "noun", "Ding", None, None, "thing", 0, False, 3)], "target_lang string, part_of_speech string, target string, gender string, plural string, gloss string, sense_index int, restricted boolean, cand_id int")
    freq = spark.createDataFrame([("de", "Hund", 4.0)], "target_lang string, word string, zipf double")
    english = spark.createDataFrame([("dog", 5.0), ("run", 6.0), ("hound", 0.0)], "word string, zipf double")
    assert [(r.source, r.frequency_rank) for r in api.build_inverted_pack(senses, freq, english).orderBy("frequency_rank").collect()] == [("run", 1), ("dog", 2)]
    cands = spark.createDataFrame([("es", "zax", "verb", "zaxar", "g [x] y", 1.0, 1), ("es", "zax", "verb", "zaxir", "g", 2.0, 2), ("es", "dog", "noun", "can", "g", 1.0, 3), ("es", "run", "verb", "correr", "g", 1.0, 4)], "target_lang string, source string, part_of_speech string, target string, gloss string, score double, cand_id int")
    shard = api.build_tail_shard(cands, both.core, english).collect()
    assert [(r.source, r.target, r.frequency_rank) for r in shard] == [("zax", "zaxir", 1_000_000)]


def test_small_functions(spark):
    assert column(spark, page.is_dark(F.col("c")), [("rgb(0, 0, 0)",), ("rgba(255,255,255,0.9)",), ("rgba(0,0,0,0.1)",), ("red",), (None,)], "c string") == [True, False, None, None, None]
    assert column(spark, page.percent(F.col("x")), [(0.155,), (0.0,)], "x double") == ["16%", "0%"]
    assert column(spark, page.label_text(", ", F.col("a"), F.col("b")), [("x", ""), (None, "y")], "a string, b string") == ["x", "y"]
    raw = '{\n"entries": {\n "dog": {\n },\n "cat": {\n },\n "dog": {\n }}}'
    assert [(r.key, r.lines) for r in quality.duplicate_raw_keys(spark.createDataFrame([(raw,)], "t string"), "t").collect()] == [("dog", [3, 7])]
    nouns = spark.createDataFrame([("Hund", "noun", "m", "Hunde", 2), ("Hund", "noun", "f", "x", 3), ("gehen", "verb", None, None, 1)], "word string, pos string, gender string, plural string, o int")
    assert [(r.word, r.plural) for r in dictionary.noun_metadata(nouns, "o").collect()] == [("Hund", "Hunde")]


def test_bucket_sink(spark, tmp_path):
    """Only the buckets a batch touches are rewritten; a retried batch changes nothing."""
    from pyspark.sql import types as T

    from glossmill.streaming import state

    path, schema = f"file://{tmp_path}/table", T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    write = state.bucket_sink(path, ["k"], lambda old, new: sinks.upsert(old, new, ["k"]), schema)
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    write(rows(*[(f"k{i}", i) for i in range(300)]), 0)
    write(rows(("k7", 70), ("new", 1), (None, 2)), 1)
    write(rows(("k7", 71)), 1)
    write(rows(), 2)
    write(rows(("k7", 72)), 3)
    got = {r.k: r.v for r in state.current(spark, path, schema).collect()}
    assert got == {f"k{i}": i for i in range(300)} | {"k7": 72, "new": 1, None: 2}
    assert len(state._versions(spark, path)[1]) <= 3 and len(state._versions(spark, path)[0]) < state.BUCKETS


def test_fold_goes_on(spark):
    """Answers folded in two parts give the state of all at once."""
    rows = [(f"k{i % 7}", i, i, i % 3 > 0) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, ts bigint, id bigint, ok boolean")
    once = review.fold_answers(df, ["k"], "ts", "id", "ok")
    first = review.fold_answers(df.where("ts < 31 OR k = 'k2'"), ["k"], "ts", "id", "ok")
    again = review.fold_answers(df.where("ts >= 31 AND k <> 'k2'"), ["k"], "ts", "id", "ok", first)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_first_ranked(spark):
    """Places as one sort of the group gives them, whatever the cells; limits by number and by column."""
    df = spark.range(400).selectExpr("if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) AS g", "cast(id % 5 AS double) AS z", "concat(char(97 + cast(id % 11 AS int)), id) AS k")
    rows = df.collect()
    for limit in (37, F.when(F.col("g") == "a", 5).otherwise(60)):
        got = {(r.g, r.k): r.rn for r in dictionary.first_ranked(df, ["g"], [F.desc("z"), F.col("k")], [-F.col("z"), F.substring("k", 1, 1)], limit).collect()}
        most = {"a": 5, "b": 60, None: 60} if not isinstance(limit, int) else dict.fromkeys(("a", "b", None), 37)
        want = {(g, r.k): i for g in most for i, r in enumerate(sorted((r for r in rows if r.g == g), key=lambda r: (-r.z, r.k)), 1) if i <= most[g]}
        assert got == want
    assert dictionary.first_ranked(df.where("false"), ["g"], [F.col("k")], [F.col("z")], 3).count() == 0


def test_marks(spark):
    rows = [("a", 1, "unknown"), ("a", 2, "unknown"), ("b", 1, "unknown"), ("b", 2, "known"), ("c", 1, "known"), ("c", 2, "unknown"), ("d", 1, "unknown"), ("d", 2, "not_unknown"), ("d", 3, "unknown"), ("e", 1, "known"), ("e", 2, "not_known"), ("f", 1, None)]
    df = spark.createDataFrame([(k, t, t, m) for k, t, m in rows], "k string, ts int, event_id int, mark string")
    got = {r.k: (r.known, r.unknown, r.unknown_at) for r in review.marks(df, ["k"]).collect()}
    assert got == {"a": (False, True, 1), "b": (True, False, None), "c": (False, True, 2), "d": (False, True, 3), "e": (False, False, None)}


def test_stepped_is_step(spark):
    states = [((0, 2.5, 0, ""), True), ((1, 2.6, 1, "1"), True), ((3, 2.7, 2, "11"), True), ((8, 1.35, 3, "1111111111"), False)]
    df = spark.createDataFrame([(*s, ok) for s, ok in states], "i bigint, e double, r int, h string, ok boolean")
    new = review.stepped(*[F.col(c) for c in "ierh"], F.col("ok"))
    assert [tuple(r) for r in df.select(*new.values()).collect()] == [review.step(s, ok) for s, ok in states]


def test_sink_names(spark, tmp_path):
    assert column(spark, sinks.export_name("words", "csv", F.col("t").cast("timestamp")), [("2024-05-06 07:08:09",), (None,)], "t string") == ["words-2024-05-06.csv", None]
    sinks.write_padded_chunks(spark.createDataFrame([(1, "x")], "chunk_id int, key string"), f"{tmp_path}/c", 3)
    assert sorted(p.name for p in (tmp_path / "c").glob("chunk_id=*")) == ["chunk_id=0", "chunk_id=1", "chunk_id=2"]


def test_lookup_either(spark):
    pack = spark.createDataFrame([("es", "Polish", 1), ("es", "polish", 2), ("es", "cat", 3)], "l string, k string, v int")
    wanted = spark.createDataFrame([("es", "Polish"), ("es", "POLISH"), ("es", "Cat"), ("de", "cat")], "l string, k string")
    assert {(r.l, r.k): r.v for r in dictionary.lookup_either(wanted, pack, "l", "k", "v").collect()} == {("es", "Polish"): 1, ("es", "POLISH"): 2, ("es", "Cat"): 3, ("de", "cat"): None}


def test_bursts(spark, tmp_path):
    """Runs of a user's events are told once the watermark has passed them."""
    from glossmill.streaming import state

    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:00:01"), (1, "2024-01-01 10:09:00"), (2, "2024-01-01 10:00:30"), (3, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "user_id bigint, t string").selectExpr("user_id", "cast(t AS timestamp) AS ts")
    for part, at in (("user_id < 3", "a"), ("user_id = 3", "b")):  # the second file moves the watermark
        df.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{at}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = state.run_once(state.bursts(stream, "5 minutes", "1 hour"), f"file://{tmp_path}/run", "append")
    got = sorted((r.user_id, r.n_events) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
