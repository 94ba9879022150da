"""Periodic runs of words in a text, by Kolpakov and Kucherov.

A run is a stretch of words with smallest period q, at least ``2 * q`` and
``LEAST`` words long, that no neighbouring word extends keeping the period.

1. LZ factorisation: a factor is a new word, or the longest piece from there on
   that begins earlier too. A suffix automaton over words, whose states keep
   where their strings first end, gives each factor and its earlier place.
2. Main's algorithm: for each end b of a factor, runs that touch b and end in
   the next factor reach back at most twice the last factor and once the next.
   Four tables of longest common extensions (Z functions of both sides and of
   one against the other) give every period that holds on both sides of b.
3. Runs strictly inside a factor are those of its earlier place, moved.

Before that, places where no run can be are left out: each place of a run is in
six consecutive words that occur again in the same run, so stretches covered by
repeated groups of six words, looked for again inside the stretches, hold all
runs. The groups are compared by hash, where equal hashes of unequal groups only
leave a place in; the steps above compare words.

A text is one row and one task's work: memory is in proportion to its longest
stretch of repeated words, time to its words. Nothing is shuffled.

Null and empty texts and those of white space have no words, no runs and the
empty collapsed text. A null doc_id stays null and its text is taken as it is.
Equal rows give equal results each. Empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

LEAST = 12
#: Words of a group; half of ``LEAST`` at most, else short periods could be missed.
GROUP = 6
#: Rounds of looking for repeated groups, and text bytes whose words are held at a time.
ROUNDS, SLICE = 3, 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_MUL = tk.U64(0x9E3779B97F4A7C15)


def common_prefixes(y: list[int]) -> list[int]:
    """For each place, how far y from there on agrees with y (0 at place 0)."""
    n = len(y)
    z = [0] * n
    a = b = 0
    for i in range(1, n):
        k = min(b - i, z[i - a]) if i < b else 0
        while i + k < n and y[k] == y[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def automaton(x: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of the suffix automaton, and where the strings of each state end first."""
    step: list[dict[int, int]] = [{}]
    link, longest, ends = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(x):
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        ends.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                ends.append(ends[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step, ends


def factors(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of the factors; a new word has length 1 and no earlier start (-1)."""
    step, ends = automaton(x)
    out, i, n = [], 0, len(x)
    while i < n:
        state = k = 0
        source = -1
        while i + k < n:
            state = step[state][x[i + k]]
            if ends[state] - k >= i:
                break
            source = ends[state] - k
            k += 1
        out.append((i, max(k, 1), source))
        i += max(k, 1)
    return out


def touching(x: list[int], b: int, last: int, following: int, least: int):
    """(start, end, period) of runs that touch b and end in the ``following`` words, periods that are no smallest ones included."""
    lo, hi = max(0, b - 2 * last - following - 1), min(len(x), b + following + 1)
    left, right = x[lo:b], x[b:hi]
    back = left[::-1]
    nl, nr = len(left), len(right)
    ahead, behind = common_prefixes(right), common_prefixes(back)
    over = common_prefixes([*right, -1, *left, *right])
    under = common_prefixes([*back, -1, *right[::-1], *back])
    for q in range(1, max(nl, nr) + 1):
        if q <= nr:
            s, p = under[nl + 1 + nr - q], ahead[q] if q < nr else 0
            if s + p >= q and s + p + q >= least and b + q + p <= b + following and (b - s > lo or lo == 0):
                yield b - s, b + q + p, q
        if q <= nl:
            s, p = behind[q] if q < nl else 0, over[nr + 1 + nl - q]
            if s + p >= q and s + p + q >= least and p <= following and (b - q - s > lo or lo == 0):
                yield b - q - s, b + p, q


def runs(x: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of x, by start and period. Letters are not negative."""
    parts = factors(x)
    found: dict[int, dict[int, int]] = {}
    for j in range(1, len(parts) + 1):
        last = parts[j - 1][1]
        b, size, source = parts[j] if j < len(parts) else (len(x), 0, -1)
        if 2 * (last + size) - 2 >= least:
            for s, e, q in touching(x, b, last, size, least):
                at = found.setdefault(s, {})
                at[e] = min(q, at.get(e, q))
        if source >= 0 and size >= least + 2:
            for s in range(source + 1, source + size - least):
                for e, q in found.get(s, {}).items():
                    if e < source + size:
                        found.setdefault(s + b - source, {})[e + b - source] = q
    return sorted((s, e - s, q) for s, at in found.items() for e, q in at.items())


def stretches(ids: np.ndarray, row: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(first, last + 1) of the stretches of one row that hold all its runs."""
    at, part = np.arange(len(ids)), row
    for _ in range(ROUNDS):
        m = len(at) - GROUP + 1
        if m < 2:
            return []
        h = tk.mix(part[:m].astype(np.uint64) * _MUL)
        for k in range(GROUP):
            h = (h ^ ids[at[k : m + k]].astype(np.uint64)) * _MUL
        whole = np.flatnonzero(part[:m] == part[GROUP - 1 :])
        h = tk.mix(h[whole])
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        change = np.zeros(len(at) + 1, np.int64)
        np.add.at(change, whole[again], 1)
        np.add.at(change, whole[again] + GROUP, -1)
        covered = np.cumsum(change[:-1]) > 0
        if not covered.any():
            return []
        at, part = at[covered], part[covered]
        begins = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])])
        stretch = np.cumsum(begins) - 1
        long = np.bincount(stretch)[stretch] >= least
        kept = at[long]
        done = len(kept) == len(ids)
        at, part = kept, stretch[long]
        if done or not len(at):
            break
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats."""
    if not found:
        return words
    gone = bytearray(len(words))
    for s, n, q in found:
        gone[s + q : s + n] = b"\1" * (n - q)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def find_runs(docs: DataFrame, prepare=None, least: int = LEAST) -> DataFrame:
    """doc_id, number of words, runs by start and period, and the text without what runs repeat, of each row.

    ``prepare(doc_id, words)`` may change the words first."""
    if least < 2 * GROUP:
        raise ValueError(f"runs of under {2 * GROUP} words are not looked for")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_ids = batch.column(0).to_pylist()
        data, offsets = tk.string_buffer(batch.column(1))
        numbers: dict[bytes, int] = {}
        texts, counts, ids = [], [], []
        for k, doc_id in enumerate(doc_ids):
            words = data[offsets[k] : offsets[k + 1]].tobytes().split()
            if prepare:
                words = prepare(doc_id, words)
            texts.append(words)
            counts.append(len(words))
            ids.extend([numbers.setdefault(w, len(numbers)) for w in words])
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        number = np.array(ids, np.int64)
        row = np.repeat(np.arange(len(texts)), counts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for a, b in stretches(number, row, least):
            k = int(row[a])
            found[k] += [(s + a - int(first[k]), n, q) for s, n, q in runs(ids[a:b], least)]
        flat = np.array([x for each in found for x in each], np.int64).reshape(-1, 3)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]),
        )
        collapsed = pa.array([b" ".join(kept(w, r)).decode("utf-8", "replace") for w, r in zip(texts, found, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), lists, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return tk.per_batch(tk.only(docs, doc_id="long", text="string"), scan, SCHEMA, SLICE)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Makes the end of one text in ten periodic, by checksum of its doc_id, as the query's contract has it."""
    if doc_id is None or not words:
        return words
    g, r = divmod(zlib.crc32(b"%d" % doc_id), 10)
    if r:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents: how many, the longest, and digests of all runs and of the collapsed text."""
    found = find_runs(tk.table(spark, sf_dir, "documents"), planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.withColumn("longest", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
