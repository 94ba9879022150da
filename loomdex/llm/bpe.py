"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens of a batch lie end to end in one linked list that no merge
crosses. Each merge rank has a bucket of list positions; a bitmap of three
levels of 64-bit words says which buckets hold something, and find-first-set on
each level gives the least rank. All positions of that bucket merge together:
entries whose pair has changed since are stale and skipped, and where two pairs
overlap the left one wins, as in one-at-a-time merging. Merging a bucket at
once is exact if no pair that contains the new token has a smaller rank; ranks
for which the table says otherwise merge one position per pre-token at a time.
A batch costs one step per bucket taken, so very long pre-tokens cost no more
per byte than short ones.

Encodings of text segments (a space and what follows up to the next space) are
memoised up to ``MEMO`` entries, for one task. Null and empty texts have no
tokens. Texts are read whole. Repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty result. A byte without a
rank in the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

MEMO = 150_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class RankQueue:
    """Buckets of positions by rank; a bitmap hierarchy finds the least rank that has any."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [positions]
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        else:
            bucket.append(positions)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        if len(ranks) == 1:
            self.push(int(ranks[0]), positions)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cut.tolist(), len(ranks)]
        for a, b, r in zip(edges, edges[1:], ranks[[0, *cut.tolist()]].tolist()):
            self.push(r, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        a = (b << 6) + (self.mid[b] & -self.mid[b]).bit_length() - 1
        rank = (a << 6) + (self.low[a] & -self.low[a]).bit_length() - 1
        self.low[a] &= self.low[a] - 1
        if not self.low[a]:
            self.mid[b] &= self.mid[b] - 1
            if not self.mid[b]:
                self.top &= self.top - 1
        got = self.buckets.pop(rank)
        return rank, got[0] if len(got) == 1 else np.concatenate(got)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.single = np.full(256, -1, np.int64)
        for b in range(256):
            self.single[b] = ranks.get(bytes([b]), -1)
        keys, vals = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    vals.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_key = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array(vals, np.int64)[order], -1)
        parts = np.stack([self.pair_key[:-1] // self.size, self.pair_key[:-1] % self.size])
        merged = np.isin(parts, np.array([r for t, r in ranks.items() if len(t) > 1], np.int64))
        self.unsafe = set(np.unique(parts[merged & (parts > self.pair_rank[None, :-1])]).tolist())
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lens)[:-1]))
        self.memo: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tok = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(tok)
        if n and tok.min() < 0:
            raise ValueError("a byte has no rank in this vocabulary")
        ends = np.cumsum(lens)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int64), lens)
        nxt = np.arange(1, n + 1, dtype=np.int64)
        nxt[ends[lens > 0] - 1] = n
        prv = np.arange(-1, n - 1, dtype=np.int64)
        prv[(ends - lens)[lens > 0]] = n
        nxt, prv, tok = np.append(nxt, n), np.append(prv, n), np.append(tok, 0)
        rank = np.full(n + 1, -1, np.int64)
        alive = np.ones(n + 1, bool)
        at = np.flatnonzero(nxt[:n] < n)
        rank[at] = self.rank_of(tok[at], tok[at + 1])
        queue = RankQueue(self.size)
        at = at[rank[at] >= 0]
        queue.push_all(rank[at], at)
        while (got := queue.pop()) is not None:
            r, p = got
            p = p[alive[p] & (rank[p] == r)]
            if len(p) > 1:
                p = np.unique(p)
                if r in self.unsafe:
                    first = np.append(True, piece[p[1:]] != piece[p[:-1]])
                    if not first.all():
                        queue.push(r, p[~first])
                        p = p[first]
                else:
                    chained = nxt[p[:-1]] == p[1:]
                    if chained.any():
                        i = np.arange(len(p))
                        head = np.maximum.accumulate(np.where(np.append(True, ~chained), i, 0))
                        p = p[(i - head) % 2 == 0]
            if not len(p):
                continue
            q = nxt[p]
            after = nxt[q]
            tok[p] = r
            alive[q] = False
            nxt[p] = after
            prv[after] = p
            back = prv[p]
            touched = np.concatenate((p, back[(back < n) & (back >= 0)]))
            if len(p) > 1:
                touched = np.unique(touched)
            right = nxt[touched]
            new = np.where(right < n, self.rank_of(tok[touched], tok[right]), -1)
            rank[touched] = new
            ok = new >= 0
            queue.push_all(new[ok], touched[ok])
        left = np.flatnonzero(alive[:n])
        ids = tok[left].astype("<u4").tobytes()
        counts = np.bincount(piece[left], minlength=len(pieces)) * 4
        edge = np.concatenate(([0], np.cumsum(counts))).tolist()
        return [ids[a:b] for a, b in zip(edge, edge[1:])]

    _BLANKS = regex.compile(r" \s|\s | \Z|\A ")

    def segments(self, text: str) -> list[str]:
        """Parts that no pre-token crosses: cut before a single space that stands between two non-spaces."""
        if self._BLANKS.search(text):
            return self.pattern.findall(text)
        parts = text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        cut = [self.segments(t) for t in texts]
        missing = list({s for part in cut for s in part}.difference(memo))
        if missing:
            found = [self.pattern.findall(s) for s in missing]
            distinct = {p: i for i, p in enumerate({p for f in found for p in f})}
            ids = self.encode_pieces([p.encode() for p in distinct])
            for s, f in zip(missing, found):
                memo[s] = ids[distinct[f[0]]] if len(f) == 1 else b"".join([ids[distinct[p]] for p in f])
        return [b"".join(map(memo.__getitem__, part)) for part in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids).astype(np.int64)
        lens = self.lens[ids]
        shift = self.starts[ids] - (np.cumsum(lens) - lens)
        return self.blob[np.repeat(shift, lens) + np.arange(int(lens.sum()))].tobytes()


@lru_cache(maxsize=4)
def load(path: str, pattern: str = public_tokenizers.PATTERN) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encoded(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), digest: bool = True) -> DataFrame:
    """key, kept columns, ids (array of int) and decoded text bytes; with ``digest`` their count and hashes only.

    ``path`` is where each executor finds the vocabulary; by default the installed public one."""
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"

    def run(batch):
        bpe = load(path or public_tokenizers.path(VOCABULARY))
        rows = bpe.encode_batch([t or "" for t in batch.column(0).to_pylist()])
        ids = [np.frombuffer(r, "<u4") for r in rows]
        back = [bpe.decode(i) for i in ids]
        if digest:
            cols = [pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        else:
            cols, names = [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(back, pa.binary())], ["ids", "decoded"]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], *names])

    src = docs.select(F.col(text).cast("string").alias("text__"), key, *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return tk.per_batch(src, run, f"{fields}, {out}", text="text__", limit=2 << 20, end=lambda: load(path or public_tokenizers.path(VOCABULARY)).memo.clear())


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(tk.only(tk.table(spark, sf_dir, "documents"), doc_id="bigint", text="string"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: every row of ``docs`` encoded and decoded again."""
    return encoded(tk.only(docs, doc_id="bigint", text="string"))
