"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text has five rates in whole numbers: symbols, repeated lines and repeated
three-word windows per 1000 words or lines, and mean word length (tested on
both sides). A sketch of a rate is a map from bin to count; bins are log-linear
(32 to each power of two, so a quantile is within 1/32 of the true one), and
sketches merge by adding counts, which Spark does before its shuffle. The
sketches of a language's sources merge into the language's and the corpus's. A
language's distribution is its own sketch with the corpus's merged in at the
weight of ``PRIOR`` texts, a source's is its own with its language's merged in at
that weight: one law for groups of every size, in which a group counts the more
the larger it is. A threshold lies ``SPREAD`` times the distance from median to upper (lower) quartile beyond that quartile, at least
``SLACK`` beyond the median. A text is kept if it passes the two fixed base
rules and no rate is beyond its group's threshold.

Null texts have no words and are not kept; texts of any length are read whole.
A null lang or source is a group of its own. Ties at a threshold are kept.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True
PRIOR, SPREAD = 200, 4
#: rate -> least distance of its threshold from the median
SLACK = {"symbol_rate": 60, "line_rate": 150, "repeat_rate": 150, "long_words": 250}
RATES = ("symbol_rate", "line_rate", "repeat_rate", "word_length")


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each row."""
    data, offsets = tk.string_buffer(batch.column(0))
    rows = len(offsets) - 1
    words = tk.Words(data, offsets, lower=False)
    n_words = np.diff(words.first)
    lead = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~tk.WHITE[data])))
    sym = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    per_row = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    gram, whole = words.grams(3)
    repeat = np.zeros(rows, np.int64)
    if whole.any():
        row = np.repeat(np.arange(rows), n_words)
        at = np.flatnonzero(whole)
        key = tk.mix(gram[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.zeros(len(row) + 3, np.int64)
        w = at[order[twice]]
        hit[w] = 1
        covered = hit.copy()
        covered[1:] |= hit[:-1]
        covered[2:] |= hit[:-2]
        repeat = np.bincount(row[np.flatnonzero(covered[: len(row)])], minlength=rows)
    dup, lines = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i, t in enumerate(batch.column(0).to_pylist()):
        if t:
            full = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            lines[i], dup[i] = len(full), len(full) - len(set(full))
    cols = [n_words, per_row(lead), per_row(sym), dup, repeat, lines]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], *[pa.array(np.asarray(c, np.int64)) for c in cols]], [*batch.schema.names[1:], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])


def features(docs: DataFrame) -> DataFrame:
    src = docs.select("text", "doc_id", "lang", "source")
    m = tk.per_batch(src, measure, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    per = lambda a, b, unit: F.expr(f"case when {b} > 0 then ({unit} * {a}) div {b} else 0 end")
    m = m.withColumns({"symbol_rate": per("n_symbols", "n_words", 1000), "line_rate": per("n_dup_lines", "n_lines", 1000), "repeat_rate": per("n_repeat_words", "n_words", 1000), "word_length": per("word_chars", "n_words", 100)})
    return m.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def bin_of(v: Column) -> Column:
    """Bin of a whole number: itself below 64, then 32 bins to a power of two."""
    power = F.length(F.conv(v, 10, 2)) - 6
    return F.when(v < 64, v).otherwise(power * 32 + F.floor(v / F.pow(F.lit(2.0), power))).cast("int")


def top_of(b: int) -> int:
    """The largest value in a bin."""
    if b < 64:
        return b
    power = (b - 32) // 32
    return ((b - power * 32 + 1) << power) - 1


def sketches(feats: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): the mergeable sketch of each rate in each group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bin_of(F.col(r)).alias("bin")) for r in RATES])).alias("x")
    return feats.where("n_words >= 50").select("lang", "source", pairs).groupBy("lang", "source", F.col("x.rate").alias("rate"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"))


Sketch = dict[str, dict[int, float]]


def merged(own: Sketch, prior: Sketch) -> Sketch:
    """``own`` with the distribution of ``prior`` merged in as ``PRIOR`` texts; the prior where there is nothing of its own."""
    out = {}
    for rate in RATES:
        mine, base = own.get(rate, {}), prior.get(rate, {})
        each = PRIOR / (sum(base.values()) or 1)
        out[rate] = {b: mine.get(b, 0) + each * base.get(b, 0) for b in sorted(mine.keys() | base.keys())}
    return out


def quantile(sketch: dict[int, float], q: float) -> int:
    # a hair less, as the weights of a merged sketch are rounded
    need, seen = q * sum(sketch.values()) * (1 - 1e-9), 0.0
    for b in sorted(sketch):
        seen += sketch[b]
        if seen >= need:
            return top_of(b)
    return 0


def limits(sketch: Sketch) -> dict[str, int]:
    out = {}
    for rate in RATES:
        s = sketch.get(rate, {})
        lo, mid, hi = (quantile(s, q) for q in (0.25, 0.5, 0.75))
        if rate == "word_length":
            out["word_length_low"] = min(lo - SPREAD * (mid - lo), mid - SLACK["long_words"])
            out["word_length_high"] = max(hi + SPREAD * (hi - mid), mid + SLACK["long_words"])
        else:
            out[rate] = max(hi + SPREAD * (hi - mid), mid + SLACK[rate])
    return out


LIMITS = ("symbol_rate", "line_rate", "repeat_rate", "word_length_low", "word_length_high")


def thresholds(feats: DataFrame) -> DataFrame:
    """One row per (lang, source): its limits. A sketch has at most a few hundred bins, so it is one value of a row, and each row of a
    source is joined with its language's and the corpus's and solved by itself."""
    # rows become few: written once, read for three levels
    sk = tk.stored(sketches(feats), "sketches")
    bins = lambda name: F.collect_list(F.struct("rate", "bin", "n")).alias(name)
    by_lang = sk.groupBy("lang", "rate", "bin").agg(F.sum("n").alias("n"))
    corpus = by_lang.groupBy("rate", "bin").agg(F.sum("n").alias("n")).agg(bins("corpus"))
    langs = by_lang.groupBy("lang").agg(bins("language")).withColumnRenamed("lang", "l_lang")
    own = sk.groupBy("lang", "source").agg(bins("own"))
    rows = own.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(corpus), F.lit(True), "left")

    def sketch(cell) -> Sketch:
        out: Sketch = {}
        for x in cell:
            out.setdefault(x["rate"], {})[x["bin"]] = x["n"]
        return out

    def solve(batches):
        for b in batches:
            cols = [b["own"].to_pylist(), b["language"].to_pylist(), b["corpus"].to_pylist()]
            found = [limits(merged(sketch(o), merged(sketch(lang), sketch(c)))) for o, lang, c in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b["lang"], b["source"], *[pa.array([f[x] for f in found], pa.int64()) for x in LIMITS]], ["lang", "source", *[f"max_{x}" for x in LIMITS]])

    return rows.select("lang", "source", "own", "language", "corpus").mapInArrow(solve, "lang string, source string, " + ", ".join(f"max_{x} long" for x in LIMITS))


def judged(docs: DataFrame) -> DataFrame:
    """Features, base_failed and kept of every row."""
    feats = tk.stored(features(docs), "quality")
    t = thresholds(feats).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    j = feats.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    fine = F.lit(True)
    for x in LIMITS:
        col = F.col(x.removesuffix("_low").removesuffix("_high"))
        beyond = col < F.col(f"max_{x}") if x.endswith("_low") else col > F.col(f"max_{x}")
        fine = fine & ~F.coalesce(beyond, F.lit(False))
    return j.withColumn("kept", ~F.col("base_failed") & fine)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.only(tk.table(spark, sf_dir, "documents"), doc_id="bigint", text="string", lang="string", source="string")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
