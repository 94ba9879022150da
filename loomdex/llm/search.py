"""Exact top-k search: BM25 over an inverted index with block-max WAND pruning.

Terms are runs of ASCII letters (A-Z in small letters), digits and non-ASCII
characters. The score of a document is the sum over the query's terms of
qtf * ln(1 + (N - n + 0.5) / (n + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl));
N, n and avgdl are those of the whole corpus. A shard is a partition of the
documents. It is indexed a segment at a time: documents of a segment are ordered
by their most frequent term, so that those of a language come together, and cut
into blocks of ``BLOCK`` documents with inverted lists and the greatest impact
of each term. The bound of a query for a document is its exact score by the
corpus's most frequent terms, which one matrix product gives for all queries
and documents of the block, and the sum of its other terms' greatest impacts in
the block; the lists of those are read only if some document's bound reaches
the query's k-th score so far. Each shard gives its k best for each query, and those of all
shards are merged.

Scores are rounded to 6 places; ties go to the least doc_id, also at the k-th
place. Documents without a term of the query are no results, so queries without
terms (null or empty texts) have none, and few matches give fewer than k.
Queries are taken ``QUERIES`` at a time: what is broadcast is bounded by that
many queries of at most ``TERMS`` distinct terms together. Repeated rows
are results of their own; a doc_id that is repeated among the queries is one
query per row, told apart by nothing, so such rows are merged by doc_id to the
first by text. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk

K1, B, TOP = 1.2, 0.75, 10
BLOCK, SEGMENT = 512, 8 << 20
#: Terms in at least this share of all documents are scored densely, the first so many by frequency.
DENSE_FROM, DENSE = 0.05, 256
#: Each block of queries reads and splits all texts again, so blocks are as large as what is broadcast may be.
QUERIES, TERMS = 16_384, 4_000_000
#: All ASCII bytes but letters and digits stand between terms.
BETWEEN = np.ones(256, bool)
BETWEEN[128:] = False
BETWEEN[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False


def terms(col: pa.Array) -> tk.Words:
    return tk.Words(*tk.string_buffer(col), between=BETWEEN)


class Queries:
    """Queries as rows of (term, weight); terms by place in the sorted vocabulary."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        w = terms(pa.array([t or "" for t in texts], pa.large_string()))
        row = np.repeat(np.arange(w.rows), np.diff(w.first))
        self.vocab, at = np.unique(w.hash, return_inverse=True)
        key, count = np.unique(row.astype(np.int64) * max(1, len(self.vocab)) + at, return_counts=True)
        self.term, self.qtf = key % max(1, len(self.vocab)), count.astype(float)
        q = key // max(1, len(self.vocab))
        full = np.unique(q)
        self.ids = np.array(ids, np.int64)[full]
        self.first = np.append(np.searchsorted(q, full), len(q))
        self.weigh(np.ones(len(self.vocab)))

    def weigh(self, idf: np.ndarray, share: np.ndarray | None = None) -> None:
        """Weights by idf; terms whose share of documents is large go to a dense matrix (queries by terms)."""
        self.weight = self.qtf * idf[self.term]
        share = np.zeros(len(self.vocab)) if share is None else share
        self.dense = np.sort(np.argsort(-share, kind="stable")[:DENSE])
        self.dense = self.dense[share[self.dense] >= DENSE_FROM]
        column = np.full(len(self.vocab), -1, np.int64)
        column[self.dense] = np.arange(len(self.dense))
        self.column = column
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        mine = column[self.term] >= 0
        self.matrix = np.zeros((len(self.ids), len(self.dense)))
        self.matrix[row[mine], column[self.term[mine]]] = self.weight[mine]
        # what is left is sparse
        self.weight, self.term = self.weight[~mine], self.term[~mine]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(row[~mine], minlength=len(self.ids)))))


def postings(col: pa.Array, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and tf of each posting in the vocabulary, by row and term, and the lengths of all rows."""
    w = terms(col)
    length = np.diff(w.first)
    if not len(vocab) or not len(w.hash):
        return (np.zeros(0, np.int64),) * 3 + (length,)
    row = np.repeat(np.arange(w.rows), length)
    at = np.minimum(np.searchsorted(vocab, w.hash), len(vocab) - 1)
    hit = vocab[at] == w.hash
    key, tf = np.unique(row[hit] * len(vocab) + at[hit], return_counts=True)
    return key // len(vocab), key % len(vocab), tf, length


def statistics(docs: DataFrame, vocab: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Documents, mean length, and documents with each term of the vocabulary; over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        v = shared.value
        df = np.zeros(len(v) + 2, np.int64)
        for batch in batches:
            offsets = tk.string_buffer(batch.column(0))[1]
            for a, b in tk.slices(offsets):
                _, term, _, length = postings(batch.column(0).slice(a, b - a), v)
                df[:-2] += np.bincount(term, minlength=len(v))[: len(v)]
                df[-2] += len(length)
                df[-1] += int(length.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], ["at", "n"])

    found = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocab) + 2, np.int64)
    df[found["at"].to_numpy()] = found["n"].to_numpy()
    return int(df[-2]), df[-1] / max(1, df[-2]), df[:-2]


class Best:
    """The k best (score, doc_id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.doc = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, q: int, score: np.ndarray, doc: np.ndarray) -> None:
        s, d = np.concatenate((self.score[q], score)), np.concatenate((self.doc[q], doc))
        order = np.lexsort((d, -s))[: self.k]
        self.score[q], self.doc[q] = s[order], d[order]


def search_segment(col: pa.Array, ids: np.ndarray, q: Queries, mean: float, best: Best) -> tuple[int, int]:
    """Indexes the rows block by block and searches them; counts (query, block) pairs scored and all."""
    parts = [(a, postings(col.slice(a, b - a), q.vocab)) for a, b in tk.slices(tk.string_buffer(col)[1], 2 << 20)]
    row, term, tf, length = (np.concatenate([x[k] + a if k == 0 else x[k] for a, x in parts] or [np.zeros(0, np.int64)]) for k in range(4))
    rows = len(length)
    if not len(row) or not len(q.ids):
        return 0, 0
    top = np.lexsort((term, tf, row))
    last = np.append(row[top][1:] != row[top][:-1], True)
    sign = np.full(rows, -1)
    sign[row[top][last]] = term[top][last]
    order = np.argsort(sign, kind="stable")
    place = np.empty(rows, np.int64)
    place[order] = np.arange(rows)
    doc = ids[order]
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
    pos = place[row]
    by = np.lexsort((pos, term, pos // BLOCK))
    pos, term, impact = pos[by], term[by], impact[by]
    edge = np.searchsorted(pos // BLOCK, np.arange(-(-rows // BLOCK) + 1))
    slot = np.full(len(q.vocab), -1, np.int64)
    peak = np.zeros(len(q.vocab))
    some = np.diff(q.first) > 0
    scored = seen = 0
    for b, (x, y) in enumerate(zip(edge, edge[1:])):
        if x == y:
            continue
        t, i, p = term[x:y], impact[x:y], pos[x:y] - b * BLOCK
        width = min(BLOCK, rows - b * BLOCK)
        often = q.column[t] >= 0
        table = np.zeros((len(q.dense), width))
        table[q.column[t[often]], p[often]] = i[often]
        exact = q.matrix @ table
        t, i, p = t[~often], i[~often], p[~often]
        bound = np.zeros(len(q.ids))
        if len(t):
            start = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1))
            own = t[start]
            size = np.diff(np.append(start, len(t)))
            peak[own] = np.maximum.reduceat(i, start)
            slot[own] = np.arange(len(own))
            if some.any():
                bound[some] = np.add.reduceat(q.weight * peak[q.term], q.first[:-1][some])
        least = best.score[:, -1] - 2e-6
        alive = np.flatnonzero(exact.max(1) + bound >= np.maximum(least, 1e-9))
        seen += len(bound)
        for k in alive.tolist():
            score = exact[k]
            if bound[k]:
                a, z = q.first[k], q.first[k + 1]
                s = slot[q.term[a:z]]
                has = s >= 0
                s, w = s[has], q.weight[a:z][has]
                n = size[s]
                at = np.repeat(start[s] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                score = score + np.bincount(p[at], i[at] * np.repeat(w, n), width)
            score = np.round(score, 6)
            good = np.flatnonzero((score > 0) & (score >= best.score[k, -1]))
            if len(good):
                best.offer(k, score[good], doc[b * BLOCK + good])
        scored += len(alive)
        if len(t):
            peak[own] = 0
            slot[own] = -1
    return scored, seen


def search_block(docs: DataFrame, q: Queries, k: int = TOP) -> DataFrame:
    """(query_id, doc_id, score): the k best of each query."""
    n, mean, df = statistics(docs, q.vocab)
    q.weigh(np.log(1 + (n - df + 0.5) / (df + 0.5)), df / max(1, n))
    shared = docs.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        q = shared.value
        best = Best(len(q.ids), k)
        held, size = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            search_segment(t.column(0), t.column(1).to_numpy(), q, mean, best)

        for batch in batches:
            offsets = tk.string_buffer(batch.column(0))[1]
            for a, b in tk.slices(offsets):
                held.append(batch.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
                if size > SEGMENT:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        r, c = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[r]), pa.array(best.doc[r, c]), pa.array(best.score[r, c])], ["query_id", "doc_id", "score"])

    found = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id")).mapInArrow(run, "query_id long, doc_id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, doc_id, score for all queries (doc_id, text) against all docs (doc_id, text), in blocks of queries."""
    queries = queries.where("text is not null and doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    out, ids, texts, size = [], [], [], 0

    def block():
        return tk.stored(search_block(docs, Queries(ids, texts), k), "hits")

    for r in queries.orderBy("doc_id").toLocalIterator():
        ids.append(r.doc_id)
        texts.append(r.text)
        size += len(r.text)
        if len(ids) >= QUERIES or size > 8 * TERMS:
            out.append(block())
            ids, texts, size = [], [], 0
    if ids or not out:
        out.append(block())
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.only(tk.table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return top_k(docs, docs.where("doc_id % 100 = 0"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT d.doc_id, coalesce(sum(p.tf), 0) AS dl FROM documents d LEFT JOIN postings p USING (doc_id) GROUP BY d.doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(dl) / count(*) AS avgdl FROM lengths),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (
  SELECT q.doc_id AS query_id, p.doc_id AS doc_id,
    round(sum(q.tf * ln(1 + (c.n_docs - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / c.avgdl))), 6) AS score
  FROM postings q JOIN freq f USING (term) JOIN postings p ON p.term = q.term JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN corpus c
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, p.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
