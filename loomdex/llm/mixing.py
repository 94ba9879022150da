"""Mixing sources to target weights.

The words of a source are laid end to end and packed into blocks of ``BLOCK``
words. The mix is a row of slots, one block each, cut into output shards; each
shard draws how many of its slots go to each source from a multinomial, without
replacement of slots over the whole mix, so that a source gets its target to
within a block; draws run down a seeded tree of shard ranges inside the tasks. The j-th slot of a source takes the block that a pseudorandom
permutation (a keyed Feistel network, walked until it falls in range) gives for
j; a slot beyond the last block starts another permutation, so no block comes
twice before every block came once. Blocks meet the documents by index.

Laying end to end needs a running sum: documents of a source go to buckets by
hash (as many as its size asks for), sums run inside a bucket, and a second
running sum over the buckets gives each its place. No task gets a whole source.

Null texts and texts without words have size 0 and take 0. A null source comes
last. Empty tables give empty results; extra columns are ignored. Equal input
gives equal output: order is by hash of doc_id and doc_id; rows that repeat a
doc_id are told apart by their text.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor, lgamma, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk

BLOCK = 64
SHARD_SLOTS = 4096
BUCKET_WORDS = 1 << 20
#: Shards of a task that fills slots, and the most such tasks.
TASK_SHARDS, MOST_TASKS = 8, 20_000
#: Bytes of text that are cut into words at once.
SLICE = 1 << 20
WEIGHTS = (5, 2, 1)
SHARE, MOST = Fraction(3, 2), 2
SEED = 11
ROUND = tk.mix(np.arange(1, 7, dtype=np.uint64))


def count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = tk.Words(*tk.string_buffer(batch.column(0)), lower=False, hashed=False)
    return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(words.first).astype(np.int64))], [*batch.schema.names[1:], "size"])


def sizes(docs: DataFrame) -> DataFrame:
    row = F.col("row") if "row" in docs.columns else F.lit(None).cast("long").alias("row")
    src = docs.select("text", "doc_id", "source", F.xxhash64("text").alias("th"), row)
    return tk.per_batch(src, count_words, "doc_id long, source string, th long, row long, size long", SLICE)


def targets(source_sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, most=MOST) -> dict[str | None, Fraction]:
    """Water filling: what a source cannot take (more than ``most`` times its size) is shared by weight again."""
    order = sorted(source_sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, out, open_ = share * sum(size.values()), {}, list(size)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * size[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def draws(wanted: list[int], shard: int, shards: int, lo: int = 0, hi: int | None = None, seed: int = SEED):
    """(shard, slots of each source before it, slots of each source in it) of the shards lo..hi.

    Counts are multinomial, drawn without replacement over the whole mix: a binary tree of shard ranges halves the counts
    of each range by a draw whose seed is the range, so a task draws those of its own shards and no others."""
    hi = shards if hi is None else hi
    todo = [(0, shards, np.zeros(len(wanted), np.int64), np.array(wanted, np.int64))] if lo < hi else []
    while todo:
        a, b, before, counts = todo.pop()
        if b - a == 1:
            yield a, before, counts
            continue
        mid = (a + b) // 2
        left = split(np.random.Generator(np.random.PCG64([seed, a, b])), counts, (mid - a) * shard)
        if b > lo and mid < hi:
            todo.append((mid, b, before + left, counts - left))
        if a < hi and mid > lo:
            todo.append((a, mid, before, left))


def split(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of n slots, drawn without replacement, are of each source."""
    # marginals one by one: the generator's own multivariate draw holds every slot in memory
    rest, need, out = int(counts.sum()), n, np.zeros(len(counts), np.int64)
    for k, c in enumerate(counts.tolist()):
        rest -= c
        out[k] = min(c, need) if rest == 0 else hypergeometric(rng, c, rest, need)
        need -= int(out[k])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn of good + bad: numpy's draw, and beyond its range the same law by rejection from a ratio of uniforms."""
    if good == 0 or n == 0:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    mean = n * (good / total)
    spread = sqrt(max(0.0, (total - n) * n * (good / total) * (bad / total) / (total - 1)) + 0.5)
    width = 1.7155277699214135 * spread + 0.8989161620588988  # constants of the rejection: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)
    mode = min(high, max(low, int((n + 1) * ((good + 1) / (total + 2)))))
    weight = lambda x: lgamma(x + 1) + lgamma(good - x + 1) + lgamma(n - x + 1) + lgamma(bad - n + x + 1)
    top = weight(mode)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= x <= high and 2 * log(u) <= top - weight(x):
            return x


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of j (0 <= j < n) under the pseudorandom permutation of 0..n-1 that ``key`` names."""
    j, n, key = (np.asarray(x).astype(np.uint64) for x in (j, n, key))
    half = np.maximum((np.ceil(np.log2(np.maximum(n.astype(np.float64), 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x, sel):
        left, right = x >> half[sel], x & mask[sel]
        for r in range(6):
            left, right = right, left ^ (tk.mix(right + key[sel] * np.uint64(0x9E3779B97F4A7C15) + ROUND[r]) & mask[sel])
        return (left << half[sel]) | right

    out, todo = j.copy(), np.arange(len(j))
    while len(todo):
        out[todo] = once(out[todo], todo)
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, row (as given, if it is), source, size, source_size, target, begin (place of its first word in its source),
    uses: how often each block that touches the document is taken, and taken."""
    spark = docs.sparkSession
    sized = tk.stored(sizes(docs), "sizes")
    totals = [(r.source, int(r.n or 0)) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]  # a row per source
    aims = targets(totals)
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    n_blocks = [-(-n // block) for _, n in order]
    wanted = []
    for (s, n), nb in zip(order, n_blocks):
        # the last block of a source may be short: slots are counted in full blocks' worth of words
        per = Fraction(n, nb) if nb else Fraction(1)
        wanted.append(min(MOST * nb, round(aims[s] / per)))
    shards = -(-sum(wanted) // shard)
    src = pd.DataFrame({"k": range(len(order)), "name": [s for s, _ in order], "source_size": [n for _, n in order], "target": [float(aims[s]) for s, _ in order], "buckets": [max(1, -(-n // BUCKET_WORDS)) for _, n in order]})
    sources = F.broadcast(spark.createDataFrame([tuple(r) for r in src.astype(object).itertuples(index=False)], "k int, name string, source_size long, target double, buckets long"))
    plan = spark.range(0, shards, 1, max(1, min(-(-shards // TASK_SHARDS), MOST_TASKS)))

    def fill(batches):
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()  # shards of a batch follow each other
                for _, before, counts in draws(wanted, shard, shards, int(ids[0]), int(ids[-1]) + 1, seed):
                    for k, (first, n, blocks) in enumerate(zip(before.tolist(), counts.tolist(), n_blocks)):
                        if n:
                            j = np.arange(first, first + n)
                            idx = permuted(j % blocks, np.full(n, blocks), np.full(n, seed * 1000003 + k * 8191) + j // blocks)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(idx)], ["k", "block"])
        tk.trim()

    slots = plan.mapInArrow(fill, "k int, block long").groupBy("k", "block").agg(F.count("*").alias("times"))
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("name"))).withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("h", "buckets"))
    inside = placed.withColumn("within", F.sum("size").over(W.partitionBy("k", "bucket").orderBy("h", "doc_id", "size", "th", "row").rowsBetween(W.unboundedPreceding, -1)))
    tops = placed.groupBy("k", "bucket").agg(F.sum("size").alias("words"))
    tops = tops.withColumn("base", F.sum("words").over(W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    laid = inside.join(tops.drop("words"), ["k", "bucket"]).withColumn("begin", F.coalesce("base", F.lit(0)) + F.coalesce("within", F.lit(0)))
    laid = laid.withColumn("own", F.monotonically_increasing_id())
    laid = tk.stored(laid.select("own", "row", "doc_id", "source", "size", "source_size", "target", "k", "begin"), "laid")
    touch = laid.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    # Spark takes the size of what a range of shard numbers turns into for the range's own, so it would broadcast the slots
    hit = touch.join(slots.hint("merge"), ["k", "block"])
    words = F.expr(f"least(begin + size, (block + 1) * {block}) - greatest(begin, block * {block})")
    used = hit.groupBy("own").agg(F.sum(words * F.col("times")).alias("taken"), F.collect_list(F.struct("block", "times")).alias("uses"))
    return laid.join(used, "own", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("own", "k")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: each gives a row of its words that are taken, and one more of those that are taken again.

    Runs of taken words keep the white space between them; runs are joined by one space. Documents without words go.
    Rows have a number of their own, so rows that repeat a doc_id or all their columns are mixed each for itself, and
    keep their other columns, whatever they are called."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.struct(*rest).alias("row__"), F.monotonically_increasing_id().alias("row"))
    own = tk.stored(own, "rows")
    used = mix(own.drop("row__")).where("taken > 0").select("row", "begin", F.transform("uses", lambda u: u.block).alias("b__"), F.transform("uses", lambda u: u.times).alias("t__"))
    src = own.join(used, "row").select("text", "begin", "b__", "t__", "row__")

    def run(batch):
        data, offsets = tk.string_buffer(batch.column(0))
        words = tk.Words(data, offsets, lower=False, hashed=False)
        row, texts = [], []
        for i, (begin, blocks, times) in enumerate(zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)])):
            a, b = words.first[i], words.first[i + 1]
            block = (begin + np.arange(b - a)) // BLOCK
            often = np.zeros(int(block[-1] - block[0]) + 1, np.int64)
            often[np.array(blocks) - block[0]] = times
            often = often[block - block[0]]
            for c in range(1, int(often.max()) + 1):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], (often >= c).astype(np.int8), [0]))))
                parts = [data[words.start[a + x] : words.end[a + y - 1]].tobytes().decode() for x, y in zip(edge[::2], edge[1::2])]
                row.append(i)
                texts.append(" ".join(parts))
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(4).take(at), pa.array(texts, pa.string())], ["row__", "text"])

    out = tk.per_batch(src, run, f"row__ {src.schema['row__'].dataType.simpleString()}, text string", SLICE)
    put = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[(put[c] if c in put else F.col("row__").getField(c)).alias(c) for c in docs.columns])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.only(tk.table(spark, sf_dir, "documents"), doc_id="bigint", text="string", source="string")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
