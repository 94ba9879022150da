"""The pipeline's stages on the smallest tables, each held against what its operator must do to its own input."""

import collections
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomdex.llm import bpe, jaccard, language, mixing, suffixes
from loomdex.llm import textkit as tk

from .test_operators import brute_components, brute_cut


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(tk.stored(stage(spark, tables[-1], sf_dir), name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "suffix_dedup", "source_mixing", "byte_bpe"]
    assert all(t.columns == columns for t in tables[:-1])
    raw, lang, one, cut, mix, out = [t.toPandas() for t in tables]
    assert len(lang) > 0.98 * len(raw)
    want = brute_components(list(zip(lang.doc_id, lang.text)))
    assert set(one.doc_id) == {i for i, (_, c) in want.items() if c == i}
    gone = brute_cut(list(zip(one.doc_id, one.text)), suffixes.SHORT)
    for i, t in zip(cut.doc_id, cut.text):
        n, removed, _, digest = gone[i]
        assert len(t.encode()) <= n - removed
        if not removed:
            assert hashlib.sha256(t.encode()).hexdigest() == digest
    words = lambda df: collections.Counter({i: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in g) for i, g in df.groupby("doc_id").text})
    taken = {r.doc_id: r.taken for r in mixing.mix(tables[3]).collect()}
    got = words(mix)
    assert all(got[i] == n for i, n in taken.items())
    assert (mix.n_chars == mix.text.str.len()).all() and len(out) == len(mix)
    import public_tokenizers

    enc = bpe.load(public_tokenizers.path(bpe.VOCABULARY))
    assert sorted(out.ids_sha256) == sorted(hashlib.sha256(x).hexdigest() for x in enc.encode_batch(mix.text.tolist()))
    assert np.all(out.n_tokens > 0)


def test_edges(spark, sf_dir):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "hello the world of words " * 30, "en", None, 1), (3, "hello the world of words " * 30, "en", None, 1), (None, "text without an id and the like", "fr", "b", 3)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, taken string")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            d = tk.stored(stage(spark, d, sf_dir), name)
    assert d.count() == 0


def test_clashing_columns_and_repeated_rows(spark, sf_dir):
    """Columns named like the operators' own go through every stage; rows equal in all columns are each mixed for themselves."""
    names = ["score", "lang_pred", "near__", "band", "kept", "n_removed", "th", "cut", "begin", "row", "id__", "size", "component_id", "key"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").limit(30)
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.col("doc_id") * 100 + k)
    docs = tk.stored(docs.union(docs.limit(3)), "docs")
    same = lambda d: all(r[n] == r.doc_id * 100 + k for r in d.collect() for k, n in enumerate(names))
    for stage in (language.stage, jaccard.stage, suffixes.stage, mixing.stage):
        got = tk.stored(stage(spark, docs, sf_dir), "got")
        assert got.columns == docs.columns and same(got) and got.count()
    sizes = {}
    for r in mixing.mix(docs).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.taken
    words = {}
    for r in mixing.stage(spark, docs, sf_dir).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert sum(words.values()) == sum(sizes.values())


def test_language_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(100))
    strange = [
        "Это предложение написано по русски и не должно быть принято. " * 5,
        "Tämä on suomenkielinen teksti, jota kukaan ei ole opettanut tälle mallille, ja siksi sen pitäisi hylätä. " * 3,
        "def run(batch): return pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string()) if x else None " * 4,
        noise,
    ]
    extra = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(strange)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language.stage(spark, docs.union(extra), "").select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**9]
    known = {r.doc_id for r in docs.where("text rlike '[a-z]'").select("doc_id").collect()}
    assert len(known & kept) >= 0.99 * len(known)


def test_rows_without_or_with_shared_doc_ids(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(n))
    a, b, c, passage = text(60), text(60), text(60), text(90)
    rows = [(None, a), (None, b), (None, b), (1, b), (2, c), (2, text(50)), (2, c), (5, c), (None, ""), (None, text(40) + " " + passage + text(40)), (None, text(40) + " " + passage + text(40))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3).cache()
    got = sorted(((r.doc_id, r.text) for r in jaccard.stage(spark, docs, "").collect()), key=str)
    assert got == sorted({rows[i] for i in (0, 3, 4, 5, 8, 9, 10)}, key=str)
    cut = [r for r in suffixes.stage(spark, docs, "").collect()]
    assert len(cut) == len(rows) and not [r for r in cut if passage in r.text]
    assert {r.text for r in mixing.stage(spark, docs.where("doc_id is null").limit(1), "").collect()}


def test_suffix_stage_keeps_replacement_characters(spark):
    shared = "é" + "x" * 20 + "ü" * 250
    rows = [(1, "\ufffd one \ufffd " + "日" + shared + "語 end"), (2, "two \ufffd" + "月" + shared + "誠 fin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.stage(spark, docs, "").collect()}
    # 日, 月 differ in the last byte of three; 語, 誠 share two bytes: characters that a cut splits go, others stay
    assert got[1].startswith("\ufffd one \ufffd ") and got[2].startswith("two \ufffd")
    assert "x" not in got[1] + got[2] and got[1].endswith(" end") and got[2].endswith(" fin")
