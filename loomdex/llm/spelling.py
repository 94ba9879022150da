"""Spelling variants: words one edit apart, grouped under the frequent form.

Two words are near if one code point inserted, deleted or replaced makes one of
the other. A near pair agrees on the first half of the word looked up (the error
is behind it) or on the rest (the error is in the first half). So the words go
to groups twice: by their first ``HEAD`` code points, which any first half
holds, and by their last ``TAIL``. A task takes whole groups, sorted, in blocks.
For each block it builds a minimal acyclic automaton of the words (of the
reversed words for the second kind) that numbers them by their order, matches
half of each word exactly and completes it with exactly one error; the number
that the path adds up to gives the count of the word found. A pair that the
first kind finds is not counted by the second, so links need no shuffle: a row
per word and kind has the number of near words and the most frequent of them.

A group of over ``hot`` words is cut: words of each length look for errors in a
hole of known place only, agreeing before and behind it, and keys hold both
sides. While a group is too large its hole is halved, to the hole's second half
and to its first, where the pair must not be of the other kind. A hole of one
code point leaves no more words than the alphabet allows. So no group grows with
the vocabulary, and no pair is lost or counted twice.

Forms have at least ``RATIO`` times the count of the word, so chains of forms
have at most as many links as the largest count has digits; roots are found by
doubling along them.

Null and empty texts have no words. A null doc_id is written as nothing before
the colon of the key that is hashed. Equal rows count each. Empty tables give
empty results; extra columns are ignored. A text is cut between words where it
is longer than ``PIECE`` code points.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

#: Letters are A-Z, a-z and U+00C0 to U+00FF; words have at least 7 and occur at least twice.
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
LETTERS = "A-Za-zÀ-ÿ"
RUN, GAP = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), re.compile(f"[^{LETTERS}]")
#: One distinct run of a document in so many loses a code point, by checksum (the query's contract).
SPOILT = 31
HEAD, TAIL = LEAST_LETTERS // 2, LEAST_LETTERS - LEAST_LETTERS // 2
#: Words of a group, of a block and of a task; text taken at a time; distinct words a task counts before it gives them on.
HOT, BLOCK, TASK_WORDS = 8192, 16_384, 32_768
PIECE, HELD = 1 << 20, 200_000
#: Runs of more bytes are hashed one by one.
SHORT = 64
_ZERO = [bytes(n) for n in range(SHORT + 1)]
_NOTHING = [zlib.crc32(z) for z in _ZERO]


def pieces(text: str):
    a = 0
    while a < len(text):
        b = a + PIECE
        gap = GAP.search(text, b) if b < len(text) else None
        b = gap.start() if gap else len(text)
        yield text[a:b]
        a = b


def spoilt_counts(doc_ids: list, texts: list[str | None]) -> dict[str, int]:
    """Counts of the words of some texts, after the deletions of the query's contract."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    at, flat = [], []
    for text in texts:
        before = len(flat)
        for piece in pieces(text or ""):
            flat.extend(map(number.__getitem__, RUN.findall(piece)))
        at.append(len(flat) - before)
    if not flat:
        return {}
    low = [r.encode().lower() for r in number]
    words = [b.decode() for b in low]
    n_bytes, n_points = np.array([len(b) for b in low]), np.array([len(w) for w in words])
    checksum = np.array([zlib.crc32(b) for b in low], np.uint32)
    prefix = [zlib.crc32(b"%d:" % i if i is not None else b":") for i in doc_ids]
    sizes, size_of = np.unique(np.minimum(n_bytes, SHORT), return_inverse=True)
    # crc32(a + b) is crc32(b) with what crc32(a) becomes over len(b) zero bytes
    moved = np.array([[zlib.crc32(_ZERO[s], p) ^ _NOTHING[s] for s in sizes.tolist()] for p in prefix], np.uint32)
    ids, doc = np.array(flat, np.int64), np.repeat(np.arange(len(texts)), at)
    h = moved[doc, size_of[ids]] ^ checksum[ids]
    for k in np.flatnonzero(n_bytes[ids] > SHORT):
        h[k] = zlib.crc32(low[ids[k]], prefix[doc[k]])
    hit = h % SPOILT == 0
    out: dict[str, int] = {}
    for k, n in enumerate(np.bincount(ids[~hit], minlength=len(words)).tolist()):
        if n:
            out[words[k]] = out.get(words[k], 0) + n
    at_point = h[hit].astype(np.int64) % n_points[ids[hit]]
    pairs, counts = np.unique(np.stack([ids[hit], at_point]), axis=1, return_counts=True)
    for (k, p), n in zip(pairs.T.tolist(), counts.tolist(), strict=True):
        if n_points[k] > LEAST_LETTERS:
            w = words[k][:p] + words[k][p + 1 :]
            out[w] = out.get(w, 0) + n
    return out


def word_counts(docs: DataFrame, count=spoilt_counts) -> DataFrame:
    """word and n of all texts; ``count(doc_ids, texts)`` counts some of them."""

    def rows(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            offsets = tk.string_buffer(batch.column(1))[1]
            for a, b in tk.slices(offsets, PIECE * 2):
                for w, n in count(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist()).items():
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    parts = tk.only(docs, doc_id="long", text="string").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """Minimal acyclic automaton of sorted words; the skips of a path add up to the word's number."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[str, list]] = []
        root: list = [False]
        before = ""
        for w in words:
            same, most = 0, min(len(w), len(before))
            while same < most and w[same] == before[same]:
                same += 1
            self._close(path, same, root, known)
            for c in w[same:]:
                path.append((c, [False]))
            (path[-1][1] if path else root)[0] = True
            before = w
        self._close(path, 0, root, known)
        self.root = self._state(root, known)

    def _close(self, path: list, keep: int, root: list, known: dict) -> None:
        while len(path) > keep:
            c, node = path.pop()
            (path[-1][1] if path else root).append((c, self._state(node, known)))

    def _state(self, node: list, known: dict) -> int:
        key = tuple(node)
        at = known.get(key)
        if at is None:
            at = known[key] = len(self.edges)
            n, edges = int(node[0]), {}
            for c, child in node[1:]:
                edges[c] = (child, n)
                n += self._size[child]
            self.edges.append(edges)
            self.final.append(node[0])
            self._size.append(n)
        return at

    def number(self, state: int, rest: str, n: int) -> int:
        """Number of the word that ``rest`` completes from a state reached with n; -1 if there is none."""
        edges = self.edges
        for c in rest:
            e = edges[state].get(c)
            if e is None:
                return -1
            state = e[0]
            n += e[1]
        return n if self.final[state] else -1

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first ``exact`` letters and have exactly one error behind them."""
        found, state, n = set(), self.root, 0
        for c in word[:exact]:
            e = self.edges[state].get(c)
            if e is None:
                return found
            state, n = e[0], n + e[1]
        for p in range(exact, len(word) + 1):
            here, rest, behind = word[p : p + 1], word[p:], word[p + 1 :]
            if here:
                found.add(self.number(state, behind, n))
            for c, (child, skip) in self.edges[state].items():
                if c != here:
                    found.add(self.number(child, rest, n + skip))
                    if here:
                        found.add(self.number(child, behind, n + skip))
            e = self.edges[state].get(here)
            if e is None:
                break
            state, n = e[0], n + e[1]
        found.discard(-1)
        return found


#: Rows of groups: ``head`` and ``tail`` code points agree, the first ``unlike`` must not (0: any), asked: the word is looked up here.
GROUPS = "key string, word string, n long, head int, tail int, unlike int, asked boolean"
FOUND = "word string, n long, n_near long, best_n long, best string"


def look_up(words: list[str], n: list[int], head: list[int], tail: list[int], unlike: list[int], asked: list[bool]) -> list[tuple]:
    """A row of ``FOUND`` for each word asked of a block of groups."""
    out = []
    counts = dict(zip(words, n, strict=True))
    for back in (False, True):
        rows = [k for k in range(len(words)) if (tail[k] > head[k]) == back]
        if not rows:
            continue
        turned = sorted({words[k][::-1] if back else words[k] for k in rows})
        machine = Automaton(turned)
        for k in rows:
            if not asked[k]:
                continue
            w, h, t, u = words[k], head[k], tail[k], unlike[k]
            near = 0
            best_n, best = 0, None
            for number in machine.near(w[::-1] if back else w, t if back else h):
                v = turned[number][::-1] if back else turned[number]
                if (back and v[:h] != w[:h]) or (not back and t and v[-t:] != w[-t:]) or (u and v[:u] == w[:u]):
                    continue
                near += 1
                c = counts[v]
                if c > best_n or c == best_n and v < best:
                    best_n, best = c, v
            out.append((w, n[k], near, best_n if near else None, best))
    return out


def look_up_groups(groups: DataFrame, tasks: int, block: int = BLOCK) -> DataFrame:
    def answer(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        found = look_up(*[t.column(c).to_pylist() for c in ("word", "n", "head", "tail", "unlike", "asked")])
        cols = list(zip(*found, strict=True)) if found else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (0, 4) else pa.int64()) for k, c in enumerate(cols)], ["word", "n", "n_near", "best_n", "best"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            keys = batch.column(0)
            codes = keys.dictionary_encode()
            edges = np.flatnonzero(np.diff(np.asarray(codes.indices))) + 1
            starts = [0, *edges.tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                key = keys[a].as_py()
                if size >= block and key != last:
                    yield answer(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, last = size + b - a, key
        if held:
            yield answer(held)
        tk.trim()

    return groups.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def _keyed(df: DataFrame) -> DataFrame:
    """Rows of holes with keys: the length looked up, the hole's place and what stands on both sides of it."""
    key = F.concat_ws("|", "size", "head", "tail", "unlike", F.expr("left(word, head)"), F.expr("right(word, tail)"))
    return df.select(key.alias("key"), "word", "n", "head", "tail", "unlike", "asked", "size")


def _split(rows: DataFrame, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of groups of at most ``hot`` words, rows of larger ones, and the keys of these."""
    counts = rows.groupBy("key").agg(F.count("*").alias("_in")).where(F.col("_in") > hot).select("key")
    counts = tk.stored(counts, "spelling-hot")
    return rows.join(counts, "key", "left_anti"), rows.join(counts, "key", "left_semi"), counts


def groups(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows of groups (``GROUPS``) that between them hold each near pair once in each direction."""
    half = F.floor(F.length("word") / 2).cast("int")
    none = F.lit(0)
    kinds = F.array(
        F.struct(F.concat(F.lit("<"), F.expr(f"left(word, {HEAD})")).alias("key"), half.alias("head"), none.alias("tail"), none.alias("unlike")),
        F.struct(F.concat(F.lit(">"), F.expr(f"right(word, {TAIL})")).alias("key"), none.alias("head"), (F.length("word") - half).alias("tail"), half.alias("unlike")),
    )
    rows = words.select("word", "n", F.explode(kinds).alias("g")).select("g.key", "word", "n", "g.head", "g.tail", "g.unlike", F.lit(True).alias("asked"))
    cold, large, keys = _split(rows, hot)
    out = [cold]
    if keys.isEmpty():
        return cold
    # words of one length look for holes; words up to one letter shorter or longer may fill them
    size = F.explode(F.sequence(F.greatest(F.lit(LEAST_LETTERS), F.length("word") - 1), F.length("word") + 1))
    large = large.select("word", "n", (F.col("tail") > 0).alias("back"), size.alias("size"))
    first = F.floor(F.col("size") / 2).cast("int")
    large = large.select("word", "n", "size", F.when(F.col("back"), 0).otherwise(first).alias("head"), F.when(F.col("back"), F.col("size") - first).otherwise(0).alias("tail"), F.when(F.col("back"), first).otherwise(0).alias("unlike"), (F.col("size") == F.length("word")).alias("asked"))
    while True:
        large = tk.stored(_keyed(large), "spelling-holes")
        cold, hotter, keys = _split(large, hot)
        out.append(cold.drop("size"))
        hole = F.col("size") - F.col("head") - F.col("tail")
        if keys.isEmpty():
            break
        out.append(hotter.where(hole <= 1).drop("size"))
        up = F.floor(hole / 2).cast("int")
        halves = F.array(
            F.struct((F.col("head") + up).alias("head"), F.col("tail").alias("tail"), F.col("unlike").alias("unlike")),
            F.struct(F.col("head").alias("head"), (F.col("tail") + hole - up).alias("tail"), (F.col("head") + up).alias("unlike")),
        )
        large = hotter.where(hole > 1).withColumn("g", F.explode(halves)).select("word", "n", "size", "g.head", "g.tail", "g.unlike", "asked")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def variants(words: DataFrame, hot: int = HOT, block: int = BLOCK, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for a table of distinct words and counts."""
    spark = words.sparkSession
    words = tk.stored(words.select("word", "n"), "spelling-words")
    size, most = words.agg(F.count("*"), F.max("n")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // TASK_WORDS))
    found = look_up_groups(groups(words, hot), tasks, block)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))))
    near = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    formed = -F.col("best.n") >= ratio * F.col("n")
    near = near.select("word", "n", "n_near", F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n"))
    near = tk.stored(near, "spelling-near")
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    hops, reach = len(str(most or 1)), 1
    while reach < hops:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = tk.stored(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        reach *= 2
    out = near.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with their near words and forms."""
    counts = word_counts(tk.table(spark, sf_dir, "documents"))
    return variants(counts.where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT)))
