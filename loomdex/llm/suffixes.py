"""Removal of repeated passages by a blockwise suffix array with a difference cover.

A byte goes if a ``WINDOW``-byte string that covers it also starts elsewhere in
the corpus, in the same text or another. Texts are UTF-8 bytes, and strings do
not cross texts.

1. Suffixes are dealt into buckets: that of a suffix is the least 32-byte gram
   (by hash) among its first 400 bytes (the window), so equal 400-byte prefixes
   share a bucket. Neighbouring suffixes mostly share one; they form a run, and
   a run with the 399 bytes after it is a context. Only hashes and places are
   shuffled.
2. Contexts of a bucket that are equal are counted before the shuffle; all
   bytes of a context that occurs twice go. Buckets with one context end here.
3. The suffixes of the other buckets are sorted, a block of buckets at a time.
   Places are counted from the bucket's gram, so equal suffixes have equal
   residues. Those in a difference cover modulo ``PERIOD`` are the sample; their
   names to depth 384 (192) come from sorting 64-byte blocks and doubling. A suffix
   is sorted by its first 8 bytes, the name at its next sample place (at most 7
   bytes on), and two more names for the rest of the window: long ties cost no more
   than short ones. Suffixes next to each other that are equal to depth 400
   repeat.
4. A bucket of over ``HOT`` contexts is cut finer first: suffixes go by what all
   windows of 32 neighbouring places have in common, so that no task gets an
   unbounded bucket, and equal pieces are dropped but for one.

The window is a parameter. The query's further column counts the bytes covered by repeated strings of ``SHORT`` bytes:
a passage of 50 words may be shorter than 400 bytes. As what repeats over 400 bytes repeats over ``SHORT``, the longer
window is then searched in the shorter one's spans only. The pipeline's stage cuts by ``SHORT``.

Null, empty and short texts lose nothing. Repeated rows are copies of each
other, so all their long texts go. Extra columns are ignored; an empty table
gives an empty result. Texts of any length are read in pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk

WINDOW, SHORT, GRAM = 400, 256, 32
PIECE = 1 << 20
PERIOD = 64
#: Every difference modulo 64 is a multiple of 8 less a number under 8, so it is one of two members of this cover.
COVER = np.array(sorted({*range(8), *range(7, 64, 8)}))
HOT, STEP = 2000, 32
BLOCK_BYTES = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(97))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        n = PIECE + WINDOW + 1

        def table(base):
            out = np.ones(n, np.uint64)
            done, step = 1, base
            while done < n:
                m = min(done, n - done)
                out[done : done + m] = out[:m] * np.uint64(step)
                step = step * step % 2**64
                done += m
            return out

        _POWERS.extend((table(_BASE), table(pow(_BASE, -1, 2**64))))
    return _POWERS[0], _POWERS[1]


def runs_of(data: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """key, context hash, start, length (in windows) and gram place (from the start) of each run of a piece."""
    n = len(data)
    if n < window:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    up, down = powers()
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64, out=prefix[1:])
    gram = tk.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    # order by hash, then by place: the low 21 bits hold the place
    low = np.uint64((1 << 21) - 1)
    m = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width, size = window - GRAM + 1, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    start = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
    length = np.diff(np.append(start, len(m)))
    place = (m[start] & low).astype(np.int64)
    end = start + length + window - 1
    ctx = tk.mix((prefix[end] - prefix[start]) * down[start] + (length * 1024 + place - start).astype(np.uint64))
    return gram[place], ctx, start, length, place - start


#: Rows are told apart by doc_id, which may be null, and text hash.
SAME_ROW = "doc_id <=> id__ and th = th__"


def runs(docs: DataFrame, window: int) -> DataFrame:
    """(key, ctx, doc_id, th, s, n, g) of all runs of ``docs`` (doc_id, text, and cut if only its ranges are searched); th tells rows of one doc_id apart."""

    def run(batches):
        for batch in batches:
            data, offsets = tk.string_buffer(batch.column(0))
            cuts = batch.column(3).to_pylist() if batch.num_columns > 3 else None
            parts, held = [], 0
            for i in range(batch.num_rows):
                at, end = int(offsets[i]), int(offsets[i + 1])
                for a, b in [(at, end)] if cuts is None else [(at + x, at + y) for x, y in merged(cuts[i])]:
                    for p in range(a, max(a, b - window + 1), PIECE):
                        key, ctx, s, n, g = runs_of(data[p : min(b, p + PIECE + window - 1)], window)
                        if len(key):
                            parts.append((i, key, ctx, s + (p - at), n, g))
                            held += len(key)
                if held > 1 << 16:
                    yield table(batch, parts)
                    parts, held = [], 0
            if parts:
                yield table(batch, parts)
        tk.trim()

    def table(batch, parts):
        row = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        key, ctx, s, n, g = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ctx.astype(np.int64)), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(s.astype(np.int64)), pa.array(n.astype(np.int16)), pa.array(g.astype(np.int16))], ["key", "ctx", "doc_id", "th", "s", "n", "g"])

    src = docs.select("text", "doc_id", F.xxhash64("text").alias("th"), *[c for c in docs.columns if c == "cut"])
    return src.where(f"octet_length(text) >= {window}").mapInArrow(run, "key long, ctx long, doc_id long, th long, s long, n short, g short")


def merged(cut: list[dict]) -> list[tuple[int, int]]:
    """The ranges a..b that the cuts cover together."""
    out: list[list[int]] = []
    for a, b in sorted((c["a"], c["b"]) for c in cut):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contexts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of the wanted contexts, (key, cnt, doc_id, th, s, n, g, bytes); hot ones cut finer."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "cnt", "s", "n", "g", "hot")).alias("w"))
    src = docs.select("text", "doc_id", F.xxhash64("text").alias("th"))
    lists = lists.select(F.col("doc_id").alias("id__"), F.col("th").alias("th__"), "w")
    src = src.join(lists, F.expr(SAME_ROW)).select("text", "doc_id", "th", "w")

    def run(batches):
        for batch in batches:
            data, offsets = tk.string_buffer(batch.column(0))
            out: list[tuple] = []
            held = 0
            for i, (doc, th, want) in enumerate(zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)])):
                at = int(offsets[i])
                for x in want:
                    a, n, g = at + x["s"], x["n"], x["g"]
                    if not x["hot"]:
                        out.append((x["key"], x["cnt"], doc, th, x["s"], n, g, data[a : a + n + window - 1].tobytes()))
                        held += n + window
                    else:
                        j = 0
                        while j < n:  # places g - j of one range of STEP
                            r = (g - j) // STEP
                            last = g - r * STEP  # the range ends here, whether or not the run goes so far
                            j1 = min(n, last + 1)
                            core = data[a + last : a + last - STEP + 1 + window].tobytes()
                            key = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=(x["key"] % 2**64).to_bytes(8, "little") + bytes([r & 255])).digest(), "little", signed=True)
                            out.append((key, x["cnt"], doc, th, x["s"] + j, j1 - j, g - j, data[a + j : a + j1 + window - 1].tobytes()))
                            held += j1 - j + window
                            j = j1
                    if held > 4 << 20:
                        yield batch_of(out)
                        out, held = [], 0
            if out:
                yield batch_of(out)
        tk.trim()

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "cnt", "doc_id", "th", "s", "n", "g", "bytes"])

    return src.mapInArrow(run, "key long, cnt long, doc_id long, th long, s long, n short, g short, bytes binary")


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Rank of each row of the columns in their lexicographic order; equal rows have equal ranks."""
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        change[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(change)
    return out


def repeated(texts: list[bytes], n: np.ndarray, g: np.ndarray, key: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each context: which of its windows equal a window of another (or the same) context of the block."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.frombuffer(b"".join(texts) + bytes(64 + window), np.uint8)
    first = np.concatenate(([0], np.cumsum(size)))
    total = int(first[-1])
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    ctx = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    place = np.arange(total, dtype=np.int32) - first.astype(np.int32)[ctx]
    # residues count from the gram of the bucket, so that equal windows have equal ones
    residue = ((place - g.astype(np.int32)[ctx]) % PERIOD).astype(np.int8)
    inside = np.zeros(PERIOD, bool)
    inside[COVER] = True
    step = np.array([next(d for d in range(PERIOD) if inside[(r + d) % PERIOD]) for r in range(PERIOD)])

    def word(at):
        return np.ascontiguousarray(words[at]).view(">u8").ravel().astype(np.uint64)

    # names of the sample: of blocks of 64, doubled, then to as many whole blocks as fit after the way to a sample place
    sample = np.flatnonzero(inside[residue] & (place + 64 <= size[ctx]))
    slot = np.full(total + window + 1, len(sample), np.int32)
    slot[sample] = np.arange(len(sample))
    end = first[ctx[sample]] + size[ctx[sample]]
    del ctx, place, residue

    def doubled(names, depth, more, more_depth):
        right = sample + depth
        ok = right + more_depth <= end
        return np.where(ok, 0, -1 - np.arange(len(sample))), np.append(more, -1)[np.where(ok, slot[np.minimum(right, total)], len(sample))], names

    name = {64: _dense([word(sample + 8 * i) for i in range(8)])}
    deep, most = 64, (window - 8) // 64 * 64
    while deep < most:
        more = max(d for d in name if d <= most - deep)
        cut, right, left = doubled(name[deep], deep, name[more], more)
        deep += more
        name[deep] = _dense([left, right, cut])
    names = name[deep]
    count = n.astype(np.int64)
    which = np.repeat(np.arange(len(texts)), count)
    j = np.arange(int(count.sum())) - np.concatenate(([0], np.cumsum(count)[:-1]))[which]
    at = first[which] + j
    k = step[(j - g[which]) % PERIOD]
    late = window - 64 - 7
    late = late + step[(j + late - g[which]) % PERIOD]  # 64 bytes from there on reach into the last 8
    columns = [key[which], g[which] - j, word(at), names[slot[at + k]], name[64][slot[at + late]], word(at + window - 8)]
    order = np.lexsort(columns[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for c in columns:
        s = c[order]
        same &= s[1:] == s[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    flag = np.zeros(len(order), bool)
    flag[order] = twice
    return np.split(flag, np.cumsum(count)[:-1])


def marks(cuts: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, a, b): bytes of the contexts that repeat."""
    ready = cuts.repartition("key").sortWithinPartitions("key")

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for row in zip(*cols):
                if held and row[0] != held[-1][0] and size > BLOCK_BYTES:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield from solve(held)
        held = []
        tk.trim()

    def solve(rows):
        # pieces of a bucket that are equal: one stands for all, and all repeat
        by: dict[tuple, list[int]] = {}
        seen: set[tuple] = set()  # rows equal in doc_id and text each bring the contexts of one
        for i, r in enumerate(rows):
            if (r[0], *r[2:5]) not in seen:
                seen.add((r[0], *r[2:5]))
                by.setdefault((r[0], r[6], r[5], r[7]), []).append(i)
        heads = [v[0] for v in by.values()]
        out: list[tuple] = []
        for v in by.values():
            if len(v) > 1:
                for i in v:
                    if rows[i][1] == 1:
                        out.append((rows[i][2], rows[i][3], rows[i][4], rows[i][4] + rows[i][5] + window - 1))
        keys = np.array([rows[i][0] for i in heads], np.int64)
        lone = np.ones(len(keys), bool)
        lone[1:] &= keys[1:] != keys[:-1]
        lone[:-1] &= keys[1:] != keys[:-1]
        heads, keys = [h for h, x in zip(heads, lone) if not x], keys[~lone]
        if heads:
            flags = repeated([rows[i][7] for i in heads], np.array([rows[i][5] for i in heads]), np.array([rows[i][6] for i in heads]), keys, window)
            for i, f in zip(heads, flags):
                if f.any() and rows[i][1] == 1 and len(by[(rows[i][0], rows[i][6], rows[i][5], rows[i][7])]) == 1:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], f.astype(np.int8), [0]))))
                    out.extend((rows[i][2], rows[i][3], rows[i][4] + int(x), rows[i][4] + int(y) + window - 1) for x, y in zip(edge[::2], edge[1::2]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "th", "a", "b"])

    return ready.mapInArrow(run, "doc_id long, th long, a long, b long")


def spans(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, cut): the byte ranges that repeat over the window, of each text that has any (ranges may overlap); ``docs`` as in ``runs``."""
    all_runs = tk.stored(runs(docs, window), "runs")
    groups = all_runs.groupBy("key", "ctx", "n").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "th", "s", "g")).alias("r"))
    groups = groups.withColumn("ways", F.count("*").over(W.partitionBy("key"))).where("cnt > 1 or ways > 1")
    groups = tk.stored(groups, "groups")
    whole = all_runs.join(groups.where("cnt > 1").select("key", "ctx", "n"), ["key", "ctx", "n"]).select("doc_id", "th", F.col("s").alias("a"), F.expr(f"s + n + {window - 1}").alias("b"))
    whole = tk.stored(whole, "whole")
    tk.discard(all_runs)
    wanted = groups.where("ways > 1").select("key", "cnt", F.col("r.doc_id").alias("doc_id"), F.col("r.th").alias("th"), F.col("r.s").alias("s"), "n", F.col("r.g").alias("g"), (F.col("ways") > HOT).alias("hot"))
    part = tk.stored(marks(contexts(docs, wanted, window), window), "marks")
    tk.discard(groups)
    found = tk.stored(whole.unionByName(part).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("cut")), "cut")
    tk.discard(whole, part)
    return found


def with_spans(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` with what ``spans`` found in each row's text as ``cut``; ``how`` is left or inner."""
    gone = found.select(F.col("doc_id").alias("id__"), F.col("th").alias("th__"), "cut")
    return docs.withColumn("th", F.xxhash64("text")).join(gone, F.expr(SAME_ROW), how).drop("th", "id__", "th__")


def whole_characters(text: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Marks of bytes to remove, extended to all bytes of the UTF-8 characters they are in."""
    first = (text & 0xC0) != 0x80
    first[:1] = True
    start = np.flatnonzero(first)
    return np.repeat(np.logical_or.reduceat(out, start), np.diff(np.append(start, len(text))))


def covered(cut: list[dict] | None, size: int) -> np.ndarray:
    """Which of ``size`` bytes the ranges cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, [c["a"] for c in cut or ()], 1)
    np.add.at(edge, [c["b"] for c in cut or ()], -1)
    return np.cumsum(edge[:-1]) > 0


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text), and n_shared: bytes in repeated strings of ``SHORT`` bytes."""
    short = spans(docs, SHORT)
    some = tk.stored(with_spans(docs, short.where(f"aggregate(cut, 0L, (n, c) -> n + c.b - c.a) >= {WINDOW}"), "inner"), "some")
    long = spans(some, WINDOW)
    tk.discard(some)
    found = short.join(long.select(F.col("doc_id").alias("id__"), F.col("th").alias("th__"), F.col("cut").alias("long")), F.expr(SAME_ROW), "left").select("doc_id", "th", F.struct("cut", "long").alias("cut"))
    both = with_spans(docs, found, "left").select("text", "doc_id", "cut.long", "cut.cut")

    def run(batch):
        data, offsets = tk.string_buffer(batch.column(0))
        out = []
        for i, (cut, also) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            text = data[offsets[i] : offsets[i + 1]]
            gone = covered(cut, len(text))
            kept = text[~gone] if cut else text
            out.append((len(text), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept.tobytes()).hexdigest(), int(covered(also, len(text)).sum()) if also else 0))
        cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(1), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])

    return tk.per_batch(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures(tk.only(tk.table(spark, sf_dir, "documents"), doc_id="bigint", text="string"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its bytes in repeated strings of ``SHORT`` bytes; a character cut in two goes with them.

    Rows keep all their other columns, whatever they are called."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("row__"))
    src = with_spans(own, spans(own.select("doc_id", "text"), SHORT), "left").select("text", "cut", "row__")

    def run(batch):
        data, offsets = tk.string_buffer(batch.column(0))
        out: list[bytes | None] = []
        for i, cut in enumerate(batch.column(1).to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            out.append(text[~whole_characters(text, covered(cut, len(text)))].tobytes() if cut else text.tobytes() if batch.column(0)[i].is_valid else None)
        return pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.binary())], ["row__", "kept__"])

    out = tk.per_batch(src, run, f"row__ {src.schema['row__'].dataType.simpleString()}, kept__ binary").withColumn("kept__", F.col("kept__").cast("string"))
    put = {"text": F.col("kept__")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.char_length("kept__").cast(docs.schema["n_chars"].dataType)
    return out.select(*[(put[c] if c in put else F.col("row__").getField(c)).alias(c) for c in docs.columns])
