"""Language identification by hyperdimensional profiles.

Every letter has a pseudorandom vector of +1 and -1. A trigram's vector binds
(multiplies) its letters' vectors, each permuted by its place; a text's vector
bundles (adds) its trigrams' vectors, and a language's prototype bundles the
texts of that language. A text gets the language whose prototype has the
largest cosine with the text's vector; the mean of all prototypes is taken off
each first, so that what all languages share does not count.

Null texts and texts without a letter get ``und`` and score 0. Extra columns
are ignored; an empty table gives an empty result; without any labelled row
every text is ``und``. Texts are read whole; memory is bounded by one Arrow
batch slice plus its distinct trigrams. Ties go to the first language by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

DIMS = 512
ALPHABET = 512
#: Distinct trigrams that a task counts before it hands them on.
HELD = 1 << 19
_LETTERS = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (ALPHABET, DIMS), dtype=np.int8) * 2 - 1
#: The permutation of a letter's place is a rotation of its vector.
_PLACES = tuple(np.ascontiguousarray(np.roll(_LETTERS, place, axis=1)) for place in range(3))


def symbol(cp: int) -> int:
    """0 for all that is no letter, small letters below U+0100 by value, others hashed."""
    ch = chr(cp)
    if not ch.isalpha():
        return 0
    low = ord(ch.lower()[0])
    return low if low < 0x100 else 256 + (low * 2654435761 >> 7) % 256


_TABLE: list[np.ndarray] = []


def symbols(cps: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter(map(symbol, range(0x3000)), np.uint16, 0x3000))
    if len(cps) and cps.max() >= 0x3000:
        codes, where = np.unique(cps, return_inverse=True)
        return np.fromiter(map(symbol, codes.tolist()), np.uint16, len(codes))[where]
    return _TABLE[0][cps]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of the letters of a text (runs of other characters count as one space) and counts."""
    s = symbols(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate(([0], s, [0])).astype(np.int32)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    return np.unique((s[:-2] * ALPHABET + s[1:-1]) * ALPHABET + s[2:], return_counts=True)


def vectors(codes: np.ndarray) -> np.ndarray:
    a, b, c = codes // (ALPHABET * ALPHABET), codes // ALPHABET % ALPHABET, codes % ALPHABET
    return (_PLACES[0][a] * _PLACES[1][b] * _PLACES[2][c]).astype(np.float32)


def prototypes(docs: DataFrame, text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """One bundled vector per label. Trigram counts meet per (label, trigram); the driver gets labels x DIMS numbers."""

    def count(batches):
        got: dict[str, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            labels = np.asarray(batch.column(1).to_pylist(), object)
            for a, b in tk.slices(tk.string_buffer(batch.column(0))[1], 1 << 20):
                parts: dict[str, list] = {}
                for lab, t in zip(labels[a:b], batch.column(0).slice(a, b - a).to_pylist()):
                    if t:
                        parts.setdefault(lab, []).append(trigrams(t))
                for lab, some in parts.items():
                    if lab in got:
                        held -= len(got[lab][0])
                        some.append(tuple(got[lab]))
                    codes, where = np.unique(np.concatenate([p[0] for p in some]), return_inverse=True)
                    got[lab] = [codes.astype(np.int64), np.rint(np.bincount(where, np.concatenate([p[1] for p in some]), len(codes))).astype(np.int64)]
                    held += len(codes)
                if held > HELD:
                    yield from tables(got)
                    got, held = {}, 0
        yield from tables(got)

    def tables(got):
        for lab, (codes, counts) in got.items():
            if len(codes):
                yield pa.RecordBatch.from_arrays([pa.array([lab] * len(codes)), pa.array(codes), pa.array(counts)], ["label", "code", "n"])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.asarray(batch.column(0).to_pylist(), object)
            codes, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a in range(0, len(codes), 8192):
                v = vectors(codes[a : a + 8192]).astype(np.float64) * n[a : a + 8192, None]
                for lab in set(labels[a : a + 8192]):
                    sums[lab] = sums.get(lab, 0) + v[labels[a : a + 8192] == lab].sum(0)
        for lab, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lab] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(np.rint(v).astype(np.int64))], ["label", "dim", "v"])

    rows = docs.select(F.col(text).alias("text"), F.col(label).alias("label")).where("text is not null and label is not null")
    counts = rows.mapInArrow(count, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    dims = counts.mapInArrow(bundle, "label string, dim int, v long").groupBy("label", "dim").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in dims.collect():
        out.setdefault(r.label, np.zeros(DIMS))[r.dim] = r.v
    return dict(sorted(out.items()))


def centred(protos: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = list(protos)
    unit = np.array([v / max(np.linalg.norm(v), 1e-9) for v in protos.values()]).reshape(len(names), DIMS)
    mean = unit.mean(0) if len(names) > 1 else np.zeros(DIMS)
    m = unit - mean
    return names, np.vstack([m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9), mean[None]]).astype(np.float32)


def predict_text(texts: list[str | None], names: list[str], matrix: np.ndarray, unit: np.ndarray) -> tuple[list[str], list[float], list[float], list[int]]:
    """Language, score, cosine with that language's prototype as it is, and number of trigrams of each text.

    matrix: centred prototypes, then what was taken off them; unit: prototypes of length 1. The centred cosines of a text
    cannot all be negative, so only the other cosine tells whether any of the languages fits."""
    grams = [trigrams(t) if t else (np.zeros(0, np.int64), None) for t in texts]
    lang, score, near, size = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0] * len(texts)
    full = [i for i, (codes, _) in enumerate(grams) if len(codes)] if names else []
    for a in range(0, len(full), 128):
        part = full[a : a + 128]
        codes, where = np.unique(np.concatenate([grams[i][0] for i in part]), return_inverse=True)
        v, at = vectors(codes), 0
        for i in part:
            n = len(grams[i][0])
            d = grams[i][1].astype(np.float32) @ v[where[at : at + n]]
            at += n
            d /= max(np.linalg.norm(d), 1e-9)
            whole = d.copy()
            d -= matrix[-1]
            cos = matrix[:-1] @ d / max(float(np.linalg.norm(d)), 1e-9)
            k = int(np.argmax(cos))
            lang[i], score[i] = names[k], float(min(1.0, max(0.0, cos[k])))
            near[i], size[i] = float(unit[k] @ whole), int(grams[i][1].sum())
    return lang, score, near, size


def identify(docs: DataFrame, protos: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the kept columns, lang_pred, score, near__ and grams__ (see ``predict_text``) of every row."""
    names, matrix = centred(protos)
    unit = np.array([v / max(np.linalg.norm(v), 1e-9) for v in protos.values()], np.float32).reshape(len(names), DIMS)

    def run(batch):
        lang, score, near, size = predict_text(batch.column(0).to_pylist(), names, matrix, unit)
        rest = batch.columns[first:]
        return pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.float64()), pa.array(size, pa.int64())], [*batch.schema.names[first:], "lang_pred", "score", "near__", "grams__"])

    first = 0 if text in keep else 1  # a kept text crosses to Python once
    src = docs.select(text, key, *[c for c in keep if c != text])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[first:])
    return tk.per_batch(src, run, f"{fields}, lang_pred string, score double, near__ double, grams__ long", limit=1 << 20, text=text)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.only(tk.table(spark, sf_dir, "documents"), doc_id="bigint", text="string", lang="string")
    protos = prototypes(docs.where(~tk.held_out("doc_id")))
    return identify(docs, protos).select("doc_id", tk.held_out("doc_id").alias("held_out"), "lang_pred", "score")


#: Share of a language's own training texts below the cut, of one band of length (in trigrams); a band of fewer texts than
#: ``ENOUGH`` takes the cut of all languages' texts of that length, and none if those are too few as well.
REJECT, BANDS, ENOUGH = 0.001, (64, 256, 1024), 100


def cuts(found: DataFrame, names: list[str]) -> DataFrame:
    """(lang_pred, band, cut): the least cosine with its prototype that a text of the language and length may have.

    Learned from training texts (rows of ``identify`` with lang) that get their own label."""
    own = found.where((F.col("lang") == F.col("lang_pred")) & (F.col("grams__") > 0)).withColumn("band", band())
    low = [F.percentile_approx("near__", REJECT, 100_000).alias("cut"), F.count("*").alias("n")]
    every = {r.band: r.cut for r in own.groupBy("band").agg(*low).collect() if r.n >= ENOUGH}
    each = {(r.lang_pred, r.band): r.cut for r in own.groupBy("lang_pred", "band").agg(*low).collect() if r.n >= ENOUGH}
    rows = [(name, b, float(each.get((name, b), every.get(b, -1.0)))) for name in names for b in range(len(BANDS) + 1)]
    return found.sparkSession.createDataFrame(rows, "lang_pred string, band int, cut double")


def band() -> F.Column:
    return sum(((F.col("grams__") >= b).cast("int") for b in BANDS), F.lit(0))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is in a learned language; learns from the rows of ``docs`` with a lang.

    A text goes if it has no letter or is further from the prototype of its language than all but ``REJECT`` of that
    language's training texts of like length. Texts of a few letters tell little, so their cut is low."""
    train = tk.only(docs, doc_id="bigint", text="string", lang="string").where(~tk.held_out("doc_id"))
    protos = prototypes(train)
    # figures only: texts are scored again below, which costs less memory and disk than to store them
    told = tk.stored(identify(train, protos, keep=("lang",)).select("lang", "lang_pred", "near__", "grams__"), "told")
    own = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("row__"))
    found = identify(own, protos, key="row__", keep=("text",))
    kept = found.where("lang_pred <> 'und'").withColumn("band", band()).join(F.broadcast(cuts(told, list(protos))), ["lang_pred", "band"])
    tk.discard(told)
    return kept.where("near__ >= cut - 1e-6").select(*[(F.col("text") if c == "text" else F.col("row__").getField(c)).alias(c) for c in docs.columns])
