"""Readers: packs, JSON lines, TEI dictionaries, word lists, archives, state and settings."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "source string, target string, partOfSpeech string, sourceGloss string, frequencyRank bigint, confidence string, sourceIds array<string>, eligible boolean, enZipf double, gender string, plural string, functionSubtype string"
PACK = f"version string, sourceLanguage string, targetLanguage string, displayName string, sources map<string, struct<name:string,url:string,license:string,version:string,fetchedAt:string,notes:string>>, entries map<string, struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in ENTRY.split(', ')))}>>"
WIKT = "word string, pos string, tags array<string>, forms array<struct<form:string,tags:array<string>>>, senses array<struct<glosses:array<string>,tags:array<string>,form_of:array<struct<word:string>>,alt_of:array<struct<word:string>>,translations:array<struct<code:string,lang_code:string,word:string,tags:array<string>>>>>, head_templates array<struct<args:map<string,string>>>, translations array<struct<code:string,lang_code:string,word:string,tags:array<string>>>"
#: Defaults of a learner's state and of the settings.
STATE = {"seenCount": ("bigint", 0), "lastSeenAt": ("bigint", 0), "lastReviewedAt": ("bigint", 0), "srsInterval": ("bigint", 0), "srsEaseFactor": ("double", 2.5), "srsRepetitions": ("int", 0), "lifecycleState": ("string", "unseen"), "selfMarkedKnown": ("boolean", False), "selfMarkedUnknown": ("boolean", False), "selfMarkedUnknownAt": ("bigint", 0)}
SETTINGS = {"onboarded": False, "targetLanguage": "es", "density": 0.05, "replacementsEnabled": True, "quizzesEnabled": True, "aggressiveMode": False}
LANGUAGES = [("es", "Spanish", "Español", ["masculine", "feminine"]), ("de", "German", "Deutsch", ["masculine", "feminine", "neuter"]), ("fr", "French", "Français", ["masculine", "feminine"]), ("it", "Italian", "Italiano", ["masculine", "feminine"])]


def read_pack(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Entries of a pack document, one row each with its ``key``. Reading fails if the metadata name other languages."""
    doc = spark.read.schema(PACK).option("multiLine", True).json(path)
    ok = (F.col("sourceLanguage") == "en") & (F.col("targetLanguage") == language)
    checked = F.when(F.coalesce(ok, F.lit(False)), F.col("entries")).otherwise(F.raise_error(F.lit(f"not a pack from en to {language}")))
    return doc.select(F.explode(checked).alias("key", "e")).select("key", "e.*", F.lit(language).alias("targetLanguage"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool) -> DataFrame:
    """JSON lines; blank lines are skipped. ``strict``: a bad line fails the read; else it is skipped. Missing: empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a list, trimmed and lower-cased."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def read_fragment(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a fragment document: under "entries", or the document itself as a map."""
    raw = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    entries = F.coalesce(F.variant_get("v", "$.entries", "variant"), F.col("v"))
    kind = f"map<string, struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in ENTRY.split(', ')))}>>"
    return raw.select(F.explode(F.from_json(F.to_json(entries), kind)).alias("key", "e")).select("key", "e.*")


def read_result(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Decisions of a workflow file: under "result", or at the root."""
    raw = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    root = F.coalesce(F.variant_get("v", "$.result", "variant"), F.col("v"))
    return raw.select(F.posexplode(F.from_json(F.to_json(root), f"decisions array<{kind}>")["decisions"]).alias("decision_no", "d")).select("decision_no", "d.*")


TEI_SCHEMA = "source string, raw_pos string, translations array<string>, definitions array<string>, source_order bigint"


def _text(node) -> str:
    return " ".join("".join(node.itertext()).replace("\xa0", " ").split())


def tei_entries(content: bytes) -> Iterator[dict]:
    """Entries of a TEI document with headword, part of speech and a translation; the order counts all entries."""
    order = -1
    for _, el in ElementTree.iterparse(io.BytesIO(content)):
        if el.tag.rpartition("}")[2] != "entry":
            continue
        order += 1
        ns = el.tag[: -len("entry")]
        orth, pos = el.find(f".//{ns}form/{ns}orth"), el.find(f".//{ns}gramGrp/{ns}pos")
        found = [x for c in el.iter(f"{ns}cit") if c.get("type") == "trans" for x in map(_text, c.iter(f"{ns}quote")) if x]
        defs = [x for x in map(_text, el.iter(f"{ns}def")) if x]
        word, kind = _text(orth) if orth is not None else "", _text(pos) if pos is not None else ""
        if word and kind and found:
            yield {"source": word, "raw_pos": kind, "translations": found, "definitions": defs, "source_order": order}
        el.clear()


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """Raw dictionary rows of TEI files, plain or in a tar archive (any compression); each file is parsed as a stream."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                if ".tar" in name:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        members = [tar.extractfile(m).read() for m in tar if m.isfile() and m.name.endswith((".tei", ".xml"))]
                else:
                    members = [content]
                for member in members:
                    rows: list[dict] = []
                    for row in tei_entries(member):
                        rows.append(row)
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, TEI_SCHEMA)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def gender_of(tags: Column, senses: Column, heads: Column) -> Column:
    """Gender of a dictionary record from its tags, its senses' tags and its head's first argument; masculine first."""
    everything = F.array_union(F.coalesce(tags, F.array()), F.flatten(F.transform(F.coalesce(senses, F.array()), lambda s: F.coalesce(s["tags"], F.array()))))
    nonempty = lambda x: F.nullif(F.coalesce(x, F.lit("")), F.lit(""))
    letters = F.transform(F.coalesce(heads, F.array()), lambda h: F.substring(F.coalesce(nonempty(h["args"]["1"]), nonempty(h["args"]["g"]), h["args"]["2"], F.lit("")), 1, 1))
    has = lambda word, letter: F.array_contains(everything, word) | F.array_contains(letters, letter)
    return F.when(has("masculine", "m"), "masculine").when(has("feminine", "f"), "feminine").when(has("neuter", "n"), "neuter")


def plural_of(forms: Column) -> Column:
    """The first form tagged plural and not singular that is a whole word."""
    good = lambda f: F.array_contains(f["tags"], "plural") & ~F.array_contains(f["tags"], "singular") & ~F.trim(F.coalesce(f["form"], F.lit(""))).rlike("^$|^—$|^-|-$")
    return F.get(F.transform(F.filter(F.coalesce(forms, F.array()), good), lambda f: F.trim(f["form"])), F.lit(0))


def record_key(records: DataFrame) -> Column:
    """A key of the record's content, the same for any split of the files; records of equal content share it."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in records.columns])))


def wikt_senses(records: DataFrame) -> DataFrame:
    """One row for each gloss of a record's senses that are no inflected forms: inputs of ``dictionary.invert``."""
    pos = F.create_map(*[F.lit(x) for p in (("noun", "noun"), ("verb", "verb"), ("adj", "adjective"), ("adv", "adverb")) for x in p])[F.col("pos")]
    from glossmill.operators.dictionary import RESTRICTED

    r = records.select(record_key(records).alias("cand_id"), pos.alias("part_of_speech"), F.trim("word").alias("target"), gender_of(F.col("tags"), F.col("senses"), F.col("head_templates")).alias("gender"), plural_of(F.col("forms")).alias("plural"), F.posexplode("senses").alias("sense_index", "s")).where("part_of_speech IS NOT NULL")
    tags = F.coalesce(F.col("s.tags"), F.array())
    inflected = (F.coalesce(F.size("s.form_of"), F.lit(0)) > 0) | (F.coalesce(F.size("s.alt_of"), F.lit(0)) > 0) | F.arrays_overlap(tags, F.array(F.lit("form-of"), F.lit("alt-of"), F.lit("inflection-of")))
    return r.where(~inflected).select("cand_id", "part_of_speech", "target", "gender", "plural", "sense_index", F.arrays_overlap(tags, F.array(*[F.lit(x) for x in RESTRICTED])).alias("restricted"), F.explode("s.glosses").alias("gloss"))


def picked_translations(records: DataFrame, codes: tuple[str, ...] = ("de", "fr", "it", "es")) -> DataFrame:
    """Word, part of speech, first gloss and the translations into the wanted languages, the first of each (code, word).

    Records of equal content give their translations once.
    """
    every = F.concat(F.coalesce("translations", F.array()), F.flatten(F.transform(F.coalesce("senses", F.array()), lambda s: F.coalesce(s["translations"], F.array()))))
    numbered = records.withColumn("rec", record_key(records))  # before the rows multiply
    r = numbered.select("rec", "word", "pos", F.col("senses")[0]["glosses"][0].alias("gloss"), F.posexplode_outer(every).alias("no", "t"))
    code, target = F.coalesce("t.code", "t.lang_code"), F.trim("t.word")
    kept = r.withColumns({"code": code, "target": target}).where(F.col("code").isin(*codes) & ~F.col("target").isin("", "-", "—"))
    return kept.groupBy("rec", "code", "target").agg(F.min_by(F.struct("word", "pos", "gloss", F.col("t.tags").alias("tags"), "no"), "no").alias("x")).select("x.word", "x.pos", "x.gloss", "code", "target", "x.tags")


def with_state_defaults(state: DataFrame) -> DataFrame:
    """Learner state with absent or null fields at their defaults; the history is an array, empty unless one."""
    cols = {n: (F.coalesce(F.col(n).cast(t), F.lit(d).cast(t)) if n in state.columns else F.lit(d).cast(t)) for n, (t, d) in STATE.items()}
    history = F.coalesce(F.col("recallHistory"), F.array().cast("array<boolean>")) if "recallHistory" in state.columns else F.array().cast("array<boolean>")
    return state.withColumns(cols | {"recallHistory": history})


def merged_settings(stored: DataFrame, patch: DataFrame | None = None, key: str = "user_id") -> DataFrame:
    """Settings of each user: the patch over what is stored over the defaults. Unknown target languages become 'es'."""
    out = stored.select(key, *[F.col(c).alias(f"__s_{c}") for c in SETTINGS if c in stored.columns])
    if patch is not None:
        out = out.join(patch.select(key, *[F.col(c).alias(f"__p_{c}") for c in SETTINGS if c in patch.columns]), key, "full")
    have = set(out.columns)
    cols = {c: F.coalesce(*[F.col(p) for p in (f"__p_{c}", f"__s_{c}") if p in have], F.lit(d)) for c, d in SETTINGS.items()}
    cols["targetLanguage"] = F.when(cols["targetLanguage"].isin(*[x[0] for x in LANGUAGES]), cols["targetLanguage"]).otherwise("es")
    return out.select(key, *[v.alias(c) for c, v in cols.items()])
