"""Exact Jaccard self-join of documents on 5-word shingles, size-aware: heavy and light sets.

A document's set holds its distinct 5-word shingles (64-bit hashes of words
with A-Z in small letters); a text of fewer words is one shingle, a text
without words has none. Two documents link if 100 * |A and B| >= 75 * |A or B|,
that is if they share at least ceil(3 (|A| + |B|) / 7) shingles.

1. Documents with equal sets form a class; only classes go on.
2. Shingles are put in one global order, rare ones first: by the count that a
   mergeable summary (Misra-Gries, ``COUNTERS`` to a task, over all documents)
   holds of them, 0 for all others, then by hash. Any order gives the same
   links; a good one gives short lists.
3. Light sets (size up to a boundary) enumerate all subsets of two shingles
   within their prefix of |A| - ceil(3|A|/4) + 2; two light sets that link share
   such a subset. Heavy sets, and light ones near the boundary in size, put
   each shingle of their prefix of |A| - ceil(3|A|/4) + 1 into an inverted list;
   a heavy set that links with any set meets it in such a list. The boundary has
   the least cost by the counts of sizes: subsets enumerated against lists read,
   whose mean length is measured on one ``SHARE``-th of all shingles.
4. Of lists with the same classes one is kept. A list first gives each class with the least one of its band of sizes: as
   many pairs as members. Links among those give components. Lists that still hold several components are scanned
   inside a task, pair by pair between components, the largest one's members never among themselves: first for pairs that
   would join what is not joined yet, and after these are verified for all pairs of different components. No link
   between components is lost; long lists are cut into blocks, so that no task holds more than two.
5. A pair goes no further if the parities of its shingles in bins (at least four to a shingle) differ in more bins than two sets that link can
   differ in shingles: a proof, not an estimate, made in few bins first, for all but the first pairs before they become rows,
   and then, once for each pair, in more bins. Large sets fill few bins so evenly that parities in them prove nothing; for
   these the first proof is by counts (modulo 16) of the shingles of a bin, whose differences are as well no more than those of the sets.
   What is left is verified on whole sets of 64-bit shingles.

Null and empty texts have size 0 and are linked with nothing. Documents of
equal text, repeated rows included, are in one component; documents without a
doc_id take part like others. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components

K = 5
#: Counters of a task's summary; shingles of the broadcast order, at most; least count to be in it; share of all shingles whose counts are exact.
COUNTERS, FREQUENT, FREQUENT_FROM, SHARE = 1 << 16, 1_000_000, 4, 256
MOST_BOUNDARY = 40
#: Bytes of text whose shingles are made at once: the arrays of a step stay in a core's cache.
SLICE = 1 << 18
#: Shingles that a summary takes at once.
COUNTED = 1 << 19
#: Lower bits that a table of the hashes of frequent shingles leaves out: it answers for most others without a search.
MARK = np.uint64(42)
#: Fewest bins to a shingle for parities, and binary logarithm of the fewest and the most bins. With d the difference of two
#: sets over their size, 2 bins rule a pair out from d of about 0.34, 4 bins from 0.31; sets that link have at most 0.29.
PER, LEVELS = 2, (9, 15)
#: The same for the parities that members of lists carry: sets of up to 1024 shingles have no wider ones.
NARROW = (PER, 11)
#: Sets of more shingles than this have counts instead of those (from 3/4 of it on both, as partners may be larger): at most so
#: many shingles to a bin, and binary logarithm of the fewest and the most bins.
COARSE, IN_BIN, COUNT_LEVELS = 2048, 8, (9, 13)
#: Rows of a block of a long list; a list up to SHORT long is scanned without joining what it finds.
ROWS, SHORT = 4096, 24
#: Pairs that a task remembers, so as to give each once however many lists have it.
REMEMBERED = 1 << 17
#: Most classes whose names are broadcast to find their texts; beyond it texts and names meet in a shuffle.
BROADCAST = 500_000


class Sets:
    """Distinct shingles of the rows of a slice, by row and then by hash."""

    def __init__(self, col: pa.Array):
        data, offsets = tk.string_buffer(col)
        words = tk.Words(data, offsets)
        n_words = np.diff(words.first)
        gram, whole = words.grams(K)
        row = np.repeat(np.arange(words.rows), n_words)
        h, r = gram[whole], row[: len(gram)][whole]
        few = np.flatnonzero((n_words > 0) & (n_words < K))
        if len(few):
            extra = np.empty(len(few), np.uint64)
            for i, f in enumerate(few):
                w = words.hash[words.first[f] : words.first[f + 1]]
                extra[i] = np.uint64((int((w * tk._SHINGLE[: len(w)]).sum(dtype=np.uint64)) + len(w) * 0x632BE59BD9B4E019) % 2**64)
            h, r = np.concatenate((h, tk.mix(extra))), np.concatenate((r, few))
        if len(few):
            order = np.argsort(r, kind="stable")
            h, r = h[order], r[order]
        edge = np.searchsorted(r, np.arange(words.rows + 1)).tolist()
        for x, y in zip(edge, edge[1:]):
            h[x:y].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        self.hash, self.row = h[fresh], r[fresh]
        self.size = np.bincount(self.row, minlength=words.rows).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        add = np.concatenate(([np.uint64(0)], np.cumsum(tk.mix(self.hash), dtype=np.uint64)))
        add2 = np.concatenate(([np.uint64(0)], np.cumsum(tk.mix(self.hash ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)))
        self.h1 = add[self.first[1:]] - add[self.first[:-1]]
        self.h2 = add2[self.first[1:]] - add2[self.first[:-1]]
        self.cls = tk.mix(self.h1 + tk.mix(self.h2 + self.size.astype(np.uint64))).astype(np.int64)


    def parities(self) -> list[bytes]:
        """Of each row, in 2 ** levels() bins by hash: whether an odd number of its shingles is there."""
        out: list[bytes] = [b""] * len(self.size)
        level = levels(self.size)
        for e in np.unique(level).tolist():
            bins, rows = 1 << e, np.flatnonzero(level == e)
            for a in range(0, len(rows), max(1, (1 << 21) >> e)):
                some = rows[a : a + max(1, (1 << 21) >> e)]
                size = self.size[some]
                at = np.repeat(self.first[some] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
                where = np.repeat(np.arange(len(some)) * bins, size) + (self.hash[at] & np.uint64(bins - 1)).astype(np.int64)
                odd = np.bincount(where, minlength=len(some) * bins) & 1
                for r, x in zip(some.tolist(), np.packbits(odd.astype(np.uint8).reshape(len(some), bins), axis=1)):
                    out[r] = x.tobytes()
        return out

    def counts(self) -> list[bytes]:
        """Of each row that is large enough, in 2 ** count_levels() bins by hash: how many of its shingles are there, modulo 16."""
        out: list[bytes] = [b""] * len(self.size)
        large = np.flatnonzero(counted_too(self.size))
        for r, e in zip(large.tolist(), count_levels(self.size[large]).tolist()):
            c = np.bincount((self.hash[self.first[r] : self.first[r + 1]] & np.uint64((1 << e) - 1)).astype(np.int64), minlength=1 << e) & 15
            out[r] = (c[::2] | c[1::2] << 4).astype(np.uint8).tobytes()
        return out


def counted_too(n: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes have counts."""
    return 4 * n > 3 * COARSE


def count_levels(n: np.ndarray) -> np.ndarray:
    """Binary logarithm of the bins of counts."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / IN_BIN)).astype(np.int64), *COUNT_LEVELS)


def levels(n: np.ndarray, per: int = PER, most: int = LEVELS[1]) -> np.ndarray:
    """Binary logarithm of the bins for sets of these sizes: at least ``per`` to a shingle, within bounds."""
    return np.clip(np.ceil(np.log2(np.maximum(per * n, 1))).astype(np.int64), LEVELS[0], most)


def narrow_widths(n: np.ndarray) -> np.ndarray:
    """Bytes of parities that list members carry: none beyond ``COARSE``."""
    return np.where(n > COARSE, 0, 1 << levels(n, *NARROW) - 3)


def narrowed(raw: list[bytes], n: np.ndarray) -> list[bytes]:
    """Parities folded to the width that list members carry."""
    fold = lambda x, w: x if len(x) <= w else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, w), axis=0).tobytes()
    return [fold(x, w) if w else b"" for x, w in zip(raw, narrow_widths(n).tolist())]


class Parities:
    """Parities of sets, compared pair by pair; the wider one of a pair is folded to the other's width."""

    def __init__(self, raw: list[bytes], n: np.ndarray, *width: int):
        self.raw, self.n, self.level = raw, n, levels(n, *width)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets of level e and of the next one, in 2 ** e bins, and where each set is in it."""
        if e not in self.tables:
            own, next_ = np.flatnonzero(self.level == e), np.flatnonzero(self.level == e + 1)
            read = lambda rows: np.frombuffer(b"".join([self.raw[r] for r in rows.tolist()]), np.uint64)
            wide = read(next_).reshape(len(next_), 2, (1 << e) // 64)
            place = np.zeros(len(self.n), np.int64)
            place[own], place[next_] = np.arange(len(own)), len(own) + np.arange(len(next_))
            self.tables[e] = np.concatenate((read(own).reshape(len(own), (1 << e) // 64), wide[:, 0] ^ wide[:, 1])), place
        return self.tables[e]

    def may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the sets x and y (no smaller, up to 4/3 as large) can link: |A or B| - |A and B| <= (|A| + |B|) / 7."""
        ok = np.zeros(len(x), bool)
        for e in np.unique(self.level[x]).tolist():
            bits, place = self.table(e)
            here, step = np.flatnonzero(self.level[x] == e), max(1, (1 << 24) >> e)
            for a in range(0, len(here), step):
                p = here[a : a + step]
                differ = np.bitwise_count(bits[place[x[p]]] ^ bits[place[y[p]]]).sum(1, dtype=np.int64)
                ok[p] = 7 * differ <= self.n[x[p]] + self.n[y[p]]
        return ok


class Counts:
    """Counts of sets in bins, compared pair by pair; the wider ones of a pair are folded to the other's width."""

    def __init__(self, raw: list[bytes], n: np.ndarray):
        self.raw, self.n, self.level = raw, n, np.where(counted_too(n), count_levels(n), -1)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets of level e and of the next one, in 2 ** e bins, and where each set is in it."""
        if e not in self.tables:
            own, next_ = np.flatnonzero(self.level == e), np.flatnonzero(self.level == e + 1)
            wide = self._read(next_, e + 1).reshape(len(next_), 2, 1 << e)
            place = np.zeros(len(self.n), np.int64)
            place[own], place[next_] = np.arange(len(own)), len(own) + np.arange(len(next_))
            self.tables[e] = np.concatenate((self._read(own, e), (wide[:, 0] + wide[:, 1]) & 15)), place
        return self.tables[e]

    def _read(self, rows: np.ndarray, e: int) -> np.ndarray:
        packed = np.frombuffer(b"".join([self.raw[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), (1 << e) // 2)
        return np.stack((packed & 15, packed >> 4), 2).reshape(len(rows), 1 << e)

    def may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """As of ``Parities``: sets differ in no fewer shingles than their counts do, also around modulo 16."""
        ok = np.zeros(len(x), bool)
        for e in np.unique(self.level[x]).tolist():
            counts, place = self.table(e)
            here, step = np.flatnonzero(self.level[x] == e), max(1, (1 << 20) >> e)
            for a in range(0, len(here), step):
                p = here[a : a + step]
                up = (counts[place[x[p]]] - counts[place[y[p]]]) & 15
                differ = np.minimum(up, 16 - up).sum(1, dtype=np.int64)
                ok[p] = 7 * differ <= self.n[x[p]] + self.n[y[p]]
        return ok


class Carried:
    """What members of lists carry of their sets: parities in few bins, or counts, compared pair by pair."""

    def __init__(self, raw: list[bytes], n: np.ndarray):
        width = narrow_widths(n)
        self.n, self.parities = n, Parities([x[:w] for x, w in zip(raw, width.tolist())], n, *NARROW)
        self.parities.level[width == 0] = -1
        self.counts = Counts([x[w:] for x, w in zip(raw, width.tolist())], n)

    def may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """As of ``Parities``."""
        ok, large = np.zeros(len(x), bool), self.n[y] > COARSE
        ok[large] = self.counts.may_link(x[large], y[large])
        ok[~large] = self.parities.may_link(x[~large], y[~large])
        return ok


def described(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash), n, c (class), h1, h2, bits (parities) and counts of each row."""

    def run(batch):
        s = Sets(batch.column(0))
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(s.size), pa.array(s.cls), pa.array(s.h1.astype(np.int64)), pa.array(s.h2.astype(np.int64)), pa.array(s.parities(), pa.binary()), pa.array(s.counts(), pa.binary())], ["doc_id", "th", "n", "c", "h1", "h2", "bits", "counts"])

    return tk.per_batch(docs.select("text", "doc_id", F.xxhash64("text").alias("th")), run, "doc_id long, th long, n long, c long, h1 long, h2 long, bits binary, counts binary", SLICE)


def with_narrow(classes: DataFrame) -> DataFrame:
    """(rep, th, n, c, h1, h2, bits) of classes with what ``Carried`` reads as ``narrow``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                narrow = narrowed(batch.column(6).to_pylist(), batch.column(2).to_numpy())
                narrow = [x + y for x, y in zip(narrow, batch.column(7).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(narrow, pa.binary())], [*batch.schema.names[:7], "narrow"])

    return classes.select("rep", "th", "n", "c", "h1", "h2", "bits", "counts").mapInArrow(run, "rep long, th long, n long, c long, h1 long, h2 long, bits binary, narrow binary")


class Summary:
    """Misra-Gries counters of shingles: a count is too low by at most all shingles seen / ``COUNTERS``."""

    def __init__(self):
        self.hash, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        if not len(h):
            return
        h, n = np.concatenate((self.hash, h)), np.concatenate((self.n, n))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        h, n = h[first], np.add.reduceat(n, first)
        if len(h) > COUNTERS:
            n -= np.partition(n, len(n) - COUNTERS - 1)[len(n) - COUNTERS - 1]
            h, n = h[n > 0], n[n > 0]
        self.hash, self.n = h, n


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Frequent shingles by hash, the rank of each (1 is the least frequent), and the mean length of the others' lists."""

    def run(batches):
        seen, held = Summary(), []
        for batch in batches:
            offsets = tk.string_buffer(batch.column(0))[1]
            for a, b in tk.slices(offsets, SLICE):
                held.append(Sets(batch.column(0).slice(a, b - a)).hash)
                if sum(map(len, held)) > COUNTED:
                    yield count(seen, held)
                    held = []
        if held:
            yield count(seen, held)
        some = seen.n > 1
        yield rows(seen.hash[some], seen.n[some], False)
        tk.trim()

    def count(seen, held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        seen.add(h, n)
        part = h % np.uint64(SHARE) == 0
        return rows(h[part], n[part], True)

    def rows(h, n, exact):
        return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.full(len(h), exact))], ["h", "n", "exact"])

    counts = tk.stored(docs.select("text").mapInArrow(run, "h long, n long, exact boolean").groupBy("h", "exact").agg(F.sum("n").alias("n")), "counts")
    top = counts.where(f"not exact and n >= {FREQUENT_FROM}").orderBy(F.desc("n"), "h").limit(FREQUENT).select("h", "n").toPandas()
    h, n = top["h"].to_numpy(np.int64).astype(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    others = counts.where("exact").join(counts.where(f"not exact and n >= {FREQUENT_FROM}").select("h"), "h", "left_anti")
    r = others.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    tk.discard(counts)
    return h[order], n[order], float(r.nn) / float(r.n) if r.n else 1.0


def counted(h: np.ndarray, heavy: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shingles that are in ``heavy`` (hash, count and ``marked`` hashes), and their counts."""
    may = np.flatnonzero(heavy[2][h >> MARK])
    at = np.minimum(np.searchsorted(heavy[0], h[may]), max(0, len(heavy[0]) - 1))
    hit = np.flatnonzero(heavy[0][at] == h[may]) if len(may) else may
    return may[hit], heavy[1][at[hit]]


def marked(h: np.ndarray) -> np.ndarray:
    """Which upper bits some of the hashes have."""
    out = np.zeros(1 << 64 - int(MARK), bool)
    out[h >> MARK] = True
    return out


def need(n: np.ndarray) -> np.ndarray:
    """Least overlap with any set that links: with one of 3/4 the size."""
    return -(-3 * n // 4)


def need_as_smaller(n: np.ndarray) -> np.ndarray:
    """Least overlap with a set at least as large that links."""
    return -(-6 * n // 7)


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest size of light sets: where enumerating subsets costs no more than reading lists of this mean length."""
    best, cost = 1, None
    for x in range(1, MOST_BOUNDARY + 1):
        total = 0.0
        for n, count in sizes.items():
            if n <= x:
                p = n - -(-3 * n // 4) + 2
                total += count * p * (p - 1) / 2
            if n >= 0.75 * (x + 1):
                total += count * (n - -(-3 * n // 4) + 1) * list_length
        if cost is None or total < cost:
            best, cost = x, total
    return best


def keys(docs: DataFrame, frequent_hash: np.ndarray, frequent_n: np.ndarray, light: int) -> DataFrame:
    """(key, c, n, idx): inverted lists and subsets. idx: the key is also in the shorter prefix of the smaller set of a pair."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frequent_hash, frequent_n))

    def run(batches):
        heavy = (*shared.value, marked(shared.value[0]))
        seen: set[int] = set()
        for batch in batches:
            offsets = tk.string_buffer(batch.column(0))[1]
            for a, b in tk.slices(offsets, SLICE):
                out = emit(Sets(batch.column(0).slice(a, b - a)), heavy, seen)
                if len(out):
                    yield out
        tk.trim()

    def emit(s: Sets, heavy: tuple[np.ndarray, np.ndarray, np.ndarray], seen: set[int]):
        new = np.zeros(len(s.size), bool)
        for i, c in enumerate(s.cls.tolist()):
            if s.size[i] > 1 and c not in seen:
                seen.add(c)
                new[i] = True
        # rows keep their places, shingles within a row are in the global order: by hash, as they are, and then those with counts
        found, count = counted(s.hash, heavy)
        late = np.zeros(len(s.hash), bool)
        late[found] = True
        end = found[np.lexsort((count, s.row[found]))]
        h = np.empty_like(s.hash)
        ahead = np.cumsum(late) - late  # with counts before each shingle
        ahead -= np.append(ahead, len(found))[s.first[:-1]][s.row]
        at = np.flatnonzero(~late)
        h[at - ahead[at]] = s.hash[at]
        behind = np.bincount(s.row[found], minlength=len(s.size))
        h[s.first[1:][s.row[end]] - behind[s.row[end]] + np.arange(len(end)) - (np.cumsum(behind) - behind)[s.row[end]]] = s.hash[end]
        place = np.arange(len(h)) - s.first[s.row]
        n = s.size
        single = new & (n >= 0.75 * (light + 1))
        take = single[s.row] & (place < (n - need(n) + 1)[s.row])
        r = s.row[take]
        parts = [(h[take], r, place[take] < (n - need_as_smaller(n) + 1)[r])]
        small = np.flatnonzero(new & (n <= light))
        if len(small):
            p, q = (n - need(n) + 2)[small], (n - need_as_smaller(n) + 2)[small]
            for j in range(1, int(p.max())):
                rows = small[p > j]
                inner = q[p > j] > j
                y = h[s.first[rows] + j]
                for i in range(j):
                    parts.append((tk.mix(h[s.first[rows] + i] + tk.mix(y)), rows, inner))
        key, r, idx = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(s.cls[r]), pa.array(n[r].astype(np.int32)), pa.array(idx)], ["key", "c", "n", "idx"])

    return docs.select("text").mapInArrow(run, "key long, c long, n int, idx boolean")


def lists_of(rows: DataFrame) -> DataFrame:
    """The rows (key, c, n, idx) of lists with at least two classes, once each."""
    ready = rows.repartition("key").sortWithinPartitions("key", "c")

    def run(batches):
        held = None  # the last row: its neighbour is in the next batch
        for batch in batches:
            if batch.num_rows:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                if held is not None:
                    cols = [np.concatenate(([h], x)) for h, x in zip(held[0], cols)]
                yield from emit(cols, held is not None and held[1], False)
                key, c = cols[0], cols[1]
                last = int(np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (c[1:] != c[:-1]))))[-1])
                before = key[last - 1] == key[-1] if last else held is not None and held[1]
                held = ([key[-1], c[-1], cols[2][-1], cols[3][last:].any()], bool(before))
        if held is not None:
            yield from emit([np.array([x]) for x in held[0]], held[1], True)
        tk.trim()

    def emit(cols, before, end):
        """``before``: the row before the first one has its key. The last class waits unless it is the ``end``."""
        key, c, n, idx = cols
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (c[1:] != c[:-1]))))
        key, c, n, idx = key[first], c[first], n[first], np.logical_or.reduceat(idx, first)
        shared = np.zeros(len(key), bool)
        shared[0] = before
        same = key[1:] == key[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        if not end:
            shared[-1] = False
        if shared.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(c[shared]), pa.array(n[shared].astype(np.int32)), pa.array(idx[shared].astype(bool))], ["key", "c", "n", "idx"])

    return ready.mapInArrow(run, "key long, c long, n int, idx boolean")


def wider(n: np.ndarray) -> pa.Array:
    """Whether sets of these sizes have wider parities than members of lists carry."""
    return pa.array(levels(n) > NARROW[1])


def possible(pairs: DataFrame, reps: DataFrame, bits: str) -> DataFrame:
    """The pairs (a, b, wide) of classes, smaller one first, that the column ``bits`` allows to link; wide: a has wider parities."""
    kind = Carried if bits == "narrow" else Parities

    def run(batches):
        for batch in batches:
            k = batch.num_rows
            if k:
                sets = kind(batch.column(2).to_pylist() + batch.column(3).to_pylist(), np.concatenate([batch.column(i).to_numpy() for i in (4, 5)]))
                keep = sets.may_link(np.arange(k), k + np.arange(k))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), wider(sets.n[:k])], ["a", "b", "wide"]).filter(pa.array(keep))
        tk.trim()

    x = pairs.join(reps.select(F.col("c").alias("a"), F.col(bits).alias("x"), F.col("n").alias("m")), "a").join(reps.select(F.col("c").alias("b"), F.col(bits).alias("y"), F.col("n").alias("n")), "b")
    return x.select("a", "b", "x", "y", "m", "n").mapInArrow(run, "a long, b long, wide boolean")


def tested(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of the stored table ``pairs`` that the wide parities allow; only sets of pairs that have any are moved."""
    wide = pairs.where("wide")
    ids = wide.select(F.col("a").alias("c")).union(wide.select("b")).distinct()
    some = reps.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "c", "left_semi")
    return tk.stored(possible(wide, some, "bits").union(pairs.where("not wide")).select("a", "b"), "pairs")


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, of stored pairs."""
    wanted = tk.stored(reps.join(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct(), "c").select("c", F.col("rep").alias("id__"), "th"), "wanted")
    few = wanted.count() <= BROADCAST
    names = F.broadcast(wanted) if few else wanted
    # rows without an id are told apart by text alone; one of each text is enough
    ided, bare = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).where("doc_id is not null"), docs.select("text", F.xxhash64("text").alias("th")).where("doc_id is null")
    texts = ided.join(names.where("id__ is not null").withColumnRenamed("id__", "doc_id"), ["doc_id", "th"]).select("text", "c")
    texts = texts.union(bare.join(names.where("id__ is null").select("c", "th"), "th").select("text", "c").dropDuplicates(["c"]))
    sets = tk.stored(shingle_sets(texts).dropDuplicates(["c"]), "sets")

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            if any(keep):
                m = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(m), batch.column(1).filter(m)], ["a", "b"])
        tk.trim()

    x = pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("set").alias("y")), "b")
    found = tk.stored(x.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct(), "links")
    tk.discard(wanted, sets)
    return found


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(c, set) of each row (text, c) whose text is of the class c: rows that share a doc_id need not be."""

    def run(batch):
        s = Sets(batch.column(0))
        out = pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), pa.array(s.hash.astype(np.int64)))], ["c", "set"])
        return out.filter(pa.array(s.cls == batch.column(1).to_numpy()))

    return tk.per_batch(docs.select("text", "c"), run, "c long, set array<long>", SLICE)


def across(lists: DataFrame, comp: DataFrame, reps: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b, wide) of classes in a list and in different components that may link; unless ``every``, only as many as join what may be joined.

    The members of a list's largest component meet all others, not each other. A list of more than ``ROWS`` others, or
    of the largest component's, is cut into blocks by hash; each two blocks that must meet are a group of their own."""
    owned = lists.select("key", "c", "n", "idx").join(comp.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    parts = owned.groupBy("key", "component").agg(F.count("*").alias("k"))
    several = parts.groupBy("key").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("all")).where("top.k < all")
    several = several.select("key", F.col("top.component").alias("main"), F.expr(f"cast(ceil(top.k / {ROWS}) as int) as nm"), F.expr(f"cast(ceil((all - top.k) / {ROWS}) as int) as nr"))
    rows = owned.join(several, "key").withColumn("own", F.col("component") == F.col("main")).withColumn("block", F.pmod(F.xxhash64("c"), F.when(F.col("own"), F.col("nm")).otherwise(F.col("nr"))).cast("int"))
    rows = rows.join(reps.select("c", F.col("narrow").alias("bits")), "c")
    with_rest = "transform(sequence(0, nr - 1), r -> named_struct('kind', 0, 'i', block, 'j', r))"
    with_own = "transform(sequence(0, nm - 1), m -> named_struct('kind', 0, 'i', m, 'j', block))"
    others = "transform(filter(sequence(0, nr - 1), r -> r <> block), r -> named_struct('kind', 1, 'i', least(block, r), 'j', greatest(block, r)))"
    rows = rows.select("key", "c", "n", "idx", "component", "own", "block", "bits", F.explode(F.expr(f"if(own, {with_rest}, concat({with_own}, {others}))")).alias("g"))
    rows = rows.select("key", "g.kind", "g.i", "g.j", "c", "n", "idx", "component", "own", "block", "bits").repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "n", "c")

    def run(batches):
        held: list[pa.RecordBatch] = []
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
            cut = np.flatnonzero((g[:, 1:] != g[:, :-1]).any(0)) + 1
            if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(4)):
                yield from solve(held, seen)
                held = []
            if len(cut):
                yield from solve([*held, batch.slice(0, int(cut[-1]))], seen)
                held = []
                batch = batch.slice(int(cut[-1]))
            held.append(batch)
        if held:
            yield from solve(held, seen)
        tk.trim()

    def solve(held, seen):
        t = pa.Table.from_batches(held).combine_chunks()
        key, kind, i, j, c, n, idx, comp_, own, block = (t.column(k).to_numpy() for k in range(10))
        n = n.astype(np.int64)
        sets = Carried(t.column(10).to_pylist(), n)
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        size = np.diff(np.append(start, len(key)))

        def pairs_ok(x, y):
            """Of rows x < y of one group: in order of size, may be linked by size, component and place, and do not meet in another group."""
            ok = (comp_[x] != comp_[y]) & idx[x] & (4 * n[x] >= 3 * n[y])
            mixed = own[x] != own[y]
            rest = ~own[x] & ~own[y]
            return ok & np.where(kind[x] == 0, mixed | (rest & (i[x] == 0)), block[x] != block[y])

        # short lists: all their pairs at once, a few rows apart at a time
        short = size <= SHORT
        member, end = np.repeat(short, size), np.repeat(start + size, size)
        at = np.flatnonzero(member)
        out = []
        for step in range(1, int(size[short].max()) if short.any() else 1):
            x = at[at + step < end[at]]
            y = x + step
            ok = pairs_ok(x, y)
            x, y = x[ok], y[ok]
            ok = sets.may_link(x, y)
            out.append((x[ok], y[ok]))
        for s, m in zip(start[~short].tolist(), size[~short].tolist()):
            label = comp_[s : s + m].copy()
            for x in range(s, s + m - 1):
                top = s + int(np.searchsorted(3 * n[s : s + m], 4 * n[x], "right"))
                y = np.arange(x + 1, top)
                y = y[pairs_ok(np.full(len(y), x), y) & (every | (label[y - s] != label[x - s]))]
                y = y[sets.may_link(np.full(len(y), x), y)]
                if len(y) and not every:
                    joined_, where = np.unique(label[y - s], return_index=True)
                    y = y[where]
                    label[np.isin(label, joined_)] = label[x - s]
                if len(y):
                    out.append((np.full(len(y), x), y))
        if out:
            x, y = (np.concatenate(v) for v in zip(*out))
            new = []
            for at, pair in enumerate(zip(c[x].tolist(), c[y].tolist())):
                if pair not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(pair)
                    new.append(at)
            x, y = x[new], y[new]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(c[x]), pa.array(c[y]), wider(n[x])], ["a", "b", "wide"])

    return rows.mapInArrow(run, "a long, b long, wide boolean").distinct()


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    told = tk.stored(described(docs), "told")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    classes = told.where("n > 0").groupBy("n", "h1", "h2", "c").agg(first, F.min("bits").alias("bits"), F.min("counts").alias("counts"))
    reps = tk.stored(with_narrow(classes.select("n", "h1", "h2", "c", F.col("first.doc_id").alias("rep"), "first.th", "bits", "counts")), "reps")
    late, rank, length = frequent(docs)
    hist = {int(r.n): int(r.k) for r in reps.where(f"n <= {2 * MOST_BOUNDARY}").groupBy("n").agg(F.count("*").alias("k")).collect()}
    raw = tk.stored(lists_of(keys(docs, late, rank, boundary(hist, length))), "raw")
    # lists of the same classes give the same pairs: one of them is enough
    heads = raw.groupBy("key").agg(F.bit_xor(F.xxhash64("c", "idx")).alias("same"), F.count("*").alias("len")).groupBy("same", "len").agg(F.min("key").alias("key")).select("key")
    lists = tk.stored(raw.join(heads, "key").withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")), "lists")
    tk.discard(raw)
    least = lists.groupBy("key", "band").agg(F.min(F.struct("n", "c")).alias("least"))
    star = lists.join(least, ["key", "band"]).where("least.c <> c").select(F.col("least.c").alias("a"), F.col("c").alias("b")).distinct()
    done = tk.stored(possible(star, reps, "narrow"), "near")
    used = [lists, done, tested(done, reps)]
    links = verified(docs, reps, used[-1])
    comp = components(links)
    for every in (False, True):
        near = tk.stored(across(lists, comp, reps, every).join(done, ["a", "b"], "left_anti"), "near")
        pairs = tested(near, reps)
        if pairs.limit(1).count():
            used.append(links)
            links = tk.stored(links.union(verified(docs, reps, pairs)), "links")
            comp = components(links)
        used += [near, pairs]
        done = done.union(near)
    tk.discard(*used, links)
    # components name classes; a component's least doc_id is its name
    by_class = reps.join(comp.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    names = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = by_class.join(names, "component").select("n", "h1", "h2", "component_id")
    out = told.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(tk.only(tk.table(spark, sf_dir, "documents"), doc_id="bigint", text="string"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component, that with the least doc_id; documents without words stay.

    Rows are told apart by doc_id and text, so different texts that share a doc_id or have none are documents of their
    own; rows equal in both are one. A row without a doc_id stays if its component has no row with one."""
    row = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = docs.select(row.alias("row__"), F.col("doc_id").cast("bigint").alias("id__"), F.col("text").cast("string").alias("text"))
    found = joined(rows.select(F.col("row__").alias("doc_id"), "text")).select(F.col("doc_id").alias("row__"), "component_id").distinct()
    first = F.min(F.struct(F.col("id__").isNull().alias("none"), "id__", "row__")).alias("first")
    kept = found.join(rows.select("row__", "id__").distinct(), "row__").groupBy("component_id").agg(first).select("first.row__")
    return docs.withColumn("row__", row).join(kept, "row__").dropDuplicates(["row__"]).select(*docs.columns)
