"""All queries of the engine by name, and DuckDB SQL for the same results.

A query takes (spark, sf_dir) and runs over whole tables; a limit is there only
where it is the feature. ``@query(sql)`` registers the function below it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables as T
from .functions import paths as P
from .functions import text as X
from .functions import vectors as V
from .operators import clustering as C
from .operators import library as L
from .operators import pages as PG
from .operators import proposals as PR
from .operators import retrieval as R
from .operators import taxonomy as G
from .operators.fulltext import TextIndex
from .operators.vector_index import VectorIndex
from .plans.session import fingerprint, shared_dir
from .service import REFRESHED, Library
from .storage import Change
from .streaming import stability as ST

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

PHRASE = "to the"
TAGS = ("fr", "src3")


def query(sql: str | None = None):
    def keep(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return keep


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return T.embeddings(spark, sf_dir).where(F.col("vec_id") == vec_id).first().v


def _tagged(spark, sf_dir) -> DataFrame:
    return T.embeddings(spark, sf_dir).join(T.documents(spark, sf_dir).select("doc_id", "tags"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "v", "tags")


# ---- vector search -------------------------------------------------------------------------------------------------

_COS = "round(1 - (1 - list_dot_product(a.v, q.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(q.v, q.v)))) / 2, 6)"
_SCORED = f"scored AS (SELECT a.vec_id, {_COS} AS score FROM vecs a, (SELECT v FROM vecs WHERE vec_id = 0) q)"
_TAGGED = "tagged AS (SELECT s.vec_id, s.score, d.lang, d.source FROM scored s JOIN documents d ON d.doc_id = s.vec_id)"


@query(f"{T.with_sql('vecs')}, {_SCORED} SELECT vec_id, score FROM scored ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return R.vector_top_k(T.embeddings(spark, sf_dir), _vector(spark, sf_dir)).select("vec_id", "score")


@query(f"{T.with_sql('vecs')}, {_SCORED} SELECT vec_id, score FROM scored WHERE score >= 0.6 ORDER BY score DESC, vec_id LIMIT 25")
def vector_topk_threshold(spark, sf_dir):
    return R.vector_top_k(T.embeddings(spark, sf_dir), _vector(spark, sf_dir), k=25, threshold=0.6).select("vec_id", "score")


@query(f"{T.with_sql('vecs')}, {_SCORED}, {_TAGGED} SELECT vec_id, score FROM tagged WHERE lang IN {TAGS} OR source IN {TAGS} ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_tags(spark, sf_dir):
    return R.vector_top_k(_tagged(spark, sf_dir), _vector(spark, sf_dir), tags=TAGS).select("vec_id", "score")


@query(f"{T.with_sql('vecs')}, {_SCORED}, {_TAGGED}, first AS (SELECT * FROM tagged ORDER BY score DESC, vec_id LIMIT 30) SELECT vec_id, score FROM first WHERE lang IN {TAGS} OR source IN {TAGS} ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_tags_compat(spark, sf_dir):
    return R.vector_top_k(_tagged(spark, sf_dir), _vector(spark, sf_dir), tags=TAGS, compat=True).select("vec_id", "score")


_EACH = f"each AS (SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS score FROM vecs a, (SELECT vec_id, v FROM vecs WHERE vec_id < 5) q), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM each)"


def _each(spark, sf_dir):
    v = T.embeddings(spark, sf_dir)
    return R.vector_top_k_each(v.select("vec_id", "v"), v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))


@query(f"{T.with_sql('vecs')}, {_EACH} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10")
def vector_multi_query_topk(spark, sf_dir):
    return _each(spark, sf_dir)


@query(f"{T.with_sql('vecs')}, {_EACH} SELECT vec_id, max(score) AS score, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY CAST(query_id AS VARCHAR)) AS queries FROM ranked WHERE rank <= 10 GROUP BY vec_id")
def search_pack_dedupe(spark, sf_dir):
    return R.dedupe_queries(_each(spark, sf_dir))


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings")
def embedding_validity(spark, sf_dir):
    return T.embeddings(spark, sf_dir).select("vec_id", V.valid(F.col("v"), 64).alias("valid"))


# ---- full text -----------------------------------------------------------------------------------------------------

_FTS = """toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS t FROM documents),
measured AS (SELECT doc_id, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'to' AND t[i + 1] = 'the')) AS tf FROM toks),
corpus AS (SELECT count(*) AS n_rows, avg(dl) AS avgdl, count(*) FILTER (WHERE tf > 0) AS df FROM measured),
hits AS (SELECT m.doc_id, round(-(CASE WHEN ln((c.n_rows - c.df + 0.5) / (c.df + 0.5)) <= 0 THEN 1e-6 ELSE ln((c.n_rows - c.df + 0.5) / (c.df + 0.5)) END
  * (m.tf * 2.2 / (m.tf + 1.2 * (0.25 + 0.75 * m.dl / c.avgdl)))), 6) AS bm25_rank FROM measured m, corpus c WHERE m.tf > 0)"""


def _index(spark, sf_dir, name: str, rows) -> TextIndex:
    """The index of a table, built where there is none of these files yet in the shared folder; ``rows()``: key, text."""
    index = TextIndex(spark, f"{shared_dir(spark)}/loomdex-index/{name}-{fingerprint(spark, f'{sf_dir}/documents.parquet')}")
    if not index.store.latest().number:
        index.put(rows())
    return index


def _fts(spark, sf_dir):
    hits = _index(spark, sf_dir, "documents", lambda: T.documents(spark, sf_dir).select(F.col("doc_id").alias("key"), "text")).search(PHRASE)
    return hits.withColumnRenamed("key", "doc_id")


@query(f"WITH {_FTS} SELECT doc_id, bm25_rank FROM hits ORDER BY bm25_rank, doc_id LIMIT 30")
def fts_phrase_bm25(spark, sf_dir):
    return _fts(spark, sf_dir).orderBy("bm25_rank", "doc_id").limit(30).select("doc_id", "bm25_rank")


@query(f"WITH {_FTS} SELECT doc_id, bm25_rank FROM hits")
def fts_phrase_all(spark, sf_dir):
    """The phrase over every document, no cut."""
    return _fts(spark, sf_dir).select("doc_id", "bm25_rank")


@query(f"WITH {_FTS} SELECT h.doc_id, h.bm25_rank FROM hits h JOIN documents d USING (doc_id) WHERE d.source IN ('src1', 'src2', 'src3', 'src4') ORDER BY bm25_rank, doc_id LIMIT 10")
def fts_phrase_tags(spark, sf_dir):
    tagged = L.by_tag(T.documents(spark, sf_dir).select("doc_id", "tags"), "src1", "src2", "src3", "src4")
    return _fts(spark, sf_dir).join(tagged, "doc_id").orderBy("bm25_rank", "doc_id").limit(10).select("doc_id", "bm25_rank")


@query(f"WITH {_FTS} SELECT doc_id, round(abs(bm25_rank) / (1 + abs(bm25_rank)), 6) AS score FROM hits")
def fts_score_normalised(spark, sf_dir):
    return _fts(spark, sf_dir).select("doc_id", "score")


_CHANGED = "now AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'To the point, ' || text || ' to the end' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 3 UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations)"


@query(f"WITH {_CHANGED}, {_FTS.replace('FROM documents)', 'FROM now)')} SELECT doc_id, bm25_rank FROM hits")
def fts_after_changes(spark, sf_dir):
    """An index that saw updates, deletions and inserts as further segments, and then a compaction of all but the last."""
    d = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    index = TextIndex(spark, f"{shared_dir(spark)}/loomdex-index/changed-{uuid.uuid4().hex}")
    index.put(d)
    index.put(d.where("key % 7 = 0").withColumn("text", F.concat(F.lit("To the point, "), "text", F.lit(" to the end"))))
    index.remove(d.where("key % 5 = 3").select("key"))
    index.compact()
    more = T.read(spark, sf_dir, "conversations")
    index.put(more.select((1000000 + F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("key"), "text"))
    return index.search(PHRASE).select(F.col("key").alias("doc_id"), "bm25_rank")


_HYBRID = f"""{T.SQL['vecs']}, {_SCORED}, {_FTS},
vec_hits AS (SELECT vec_id AS doc_id, score FROM scored ORDER BY score DESC, vec_id LIMIT 200),
text_hits AS (SELECT doc_id, round(abs(bm25_rank) / (1 + abs(bm25_rank)), 6) AS score FROM hits ORDER BY bm25_rank, doc_id LIMIT 30),
merged AS (SELECT coalesce(v.doc_id, f.doc_id) AS doc_id,
  round(CASE WHEN v.score IS NOT NULL AND f.score IS NOT NULL THEN least(1.0, greatest(v.score, f.score) * CAST(1.05 AS DOUBLE)) ELSE coalesce(v.score, f.score) END, 6) AS score,
  CASE WHEN v.score IS NOT NULL AND f.score IS NOT NULL THEN 'hybrid' WHEN v.score IS NOT NULL THEN 'vector' ELSE 'fts' END AS match_type
  FROM vec_hits v FULL JOIN text_hits f ON v.doc_id = f.doc_id)"""


def _hybrid(spark, sf_dir):
    vec = R.vector_top_k(T.embeddings(spark, sf_dir), _vector(spark, sf_dir), k=200).select(F.col("vec_id").alias("doc_id"), "score")
    text = _fts(spark, sf_dir).orderBy("bm25_rank", "doc_id").limit(30).select("doc_id", "score")
    return R.hybrid_merge(vec, text, "doc_id")


@query(f"WITH {_HYBRID} SELECT doc_id, score, match_type FROM merged")
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(
    f"WITH {_HYBRID}, dims AS (SELECT label, unnest(range(1, 65)) AS i, v FROM vecs), cent AS (SELECT label, i, avg(v[i]) AS x FROM dims GROUP BY label, i), "
    "cv AS (SELECT label, list(x ORDER BY i) AS v FROM cent GROUP BY label), "
    "cl AS (SELECT a.label, round(1 - (1 - list_dot_product(a.v, q.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(q.v, q.v)))) / 2, 6) AS score FROM cv a, (SELECT v FROM vecs WHERE vec_id = 0) q ORDER BY score DESC, label LIMIT 5) "
    "SELECT doc_id, score, match_type FROM merged UNION ALL SELECT -1 - label, score, 'cluster' FROM cl"
)
def hybrid_with_clusters(spark, sf_dir):
    v = T.embeddings(spark, sf_dir)
    centres = C.mean_vectors(v, v.select("vec_id", F.col("label").alias("cluster_id"))).select(F.col("cluster_id").alias("vec_id"), F.col("c").alias("v"))
    best = R.vector_top_k(centres, _vector(spark, sf_dir), k=5).select((-1 - F.col("vec_id")).cast("long").alias("doc_id"), "score", F.lit("cluster").alias("match_type"))
    return _hybrid(spark, sf_dir).unionByName(best)


_CHUNK_HITS = f"""ctoks AS (SELECT chunk_id, doc_id, page, chunk_index, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda t: t <> '') AS t FROM chunks),
cmeasured AS (SELECT chunk_id, doc_id, page, chunk_index, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'to' AND t[i + 1] = 'the')) AS tf FROM ctoks),
ccorpus AS (SELECT count(*) AS n_rows, avg(dl) AS avgdl, count(*) FILTER (WHERE tf > 0) AS df FROM cmeasured),
cranked AS (SELECT m.*, round(-(CASE WHEN ln((c.n_rows - c.df + 0.5) / (c.df + 0.5)) <= 0 THEN 1e-6 ELSE ln((c.n_rows - c.df + 0.5) / (c.df + 0.5)) END * (m.tf * 2.2 / (m.tf + 1.2 * (0.25 + 0.75 * m.dl / c.avgdl)))), 6) AS r FROM cmeasured m, ccorpus c WHERE m.tf > 0),
ctext AS (SELECT doc_id, page, chunk_index, round(abs(r) / (1 + abs(r)), 6) AS score FROM cranked ORDER BY r, doc_id, page, chunk_index LIMIT 30),
cfirst AS (SELECT doc_id, page, min(chunk_index) AS chunk_index FROM chunks GROUP BY doc_id, page),
cvec AS (SELECT c.doc_id, c.page, c.chunk_index, s.score FROM (SELECT vec_id, score FROM scored ORDER BY score DESC, vec_id LIMIT 200) s JOIN cfirst c ON c.doc_id = s.vec_id),
cmerged AS (SELECT coalesce(v.doc_id, f.doc_id) AS doc_id, coalesce(v.page, f.page) AS page, coalesce(v.chunk_index, f.chunk_index) AS chunk_index,
  round(CASE WHEN v.score IS NOT NULL AND f.score IS NOT NULL THEN least(1.0, greatest(v.score, f.score) * CAST(1.05 AS DOUBLE)) ELSE coalesce(v.score, f.score) END, 6) AS score,
  CASE WHEN v.score IS NOT NULL AND f.score IS NOT NULL THEN 'hybrid' WHEN v.score IS NOT NULL THEN 'vector' ELSE 'fts' END AS match_type
  FROM cvec v FULL JOIN ctext f ON v.doc_id = f.doc_id AND v.page = f.page AND v.chunk_index = f.chunk_index),
cbest AS (SELECT * FROM cmerged ORDER BY score DESC, doc_id, page, chunk_index LIMIT 10)"""
_AROUND = """o AS (SELECT doc_id, page, chunk_index, content, length(content) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY page, chunk_index) AS o FROM chunks WHERE doc_id IN (SELECT doc_id FROM cbest)),
ot AS (SELECT o.* FROM o JOIN cbest USING (doc_id, page, chunk_index)),
ob AS (SELECT * FROM (SELECT t.doc_id, t.o AS t, n.o, n.len, t.len + sum(n.len) OVER w + row_number() OVER w AS cum FROM ot t JOIN o n ON n.doc_id = t.doc_id AND n.o < t.o AND n.o >= t.o - 20 WINDOW w AS (PARTITION BY t.doc_id, t.o ORDER BY n.o DESC)) WHERE cum <= 1.2 * 700),
obs AS (SELECT t.doc_id, t.o AS t, coalesce(min(ob.o), t.o) AS lo, coalesce(max(ob.cum), t.len) AS total FROM ot t LEFT JOIN ob ON ob.doc_id = t.doc_id AND ob.t = t.o GROUP BY t.doc_id, t.o, t.len),
oa AS (SELECT * FROM (SELECT b.doc_id, b.t, n.o, b.total + sum(n.len) OVER w + row_number() OVER w AS cum FROM obs b JOIN o n ON n.doc_id = b.doc_id AND n.o > b.t AND n.o <= b.t + 20 WINDOW w AS (PARTITION BY b.doc_id, b.t ORDER BY n.o)) WHERE cum <= 1.2 * 700),
oas AS (SELECT b.doc_id, b.t, b.lo, coalesce(max(oa.o), b.t) AS hi FROM obs b LEFT JOIN oa ON oa.doc_id = b.doc_id AND oa.t = b.t GROUP BY b.doc_id, b.t, b.lo),
expanded AS (SELECT s.doc_id, ot.page, ot.chunk_index, string_agg(n.content, chr(10) ORDER BY n.o) AS content FROM oas s JOIN o n ON n.doc_id = s.doc_id AND n.o BETWEEN s.lo AND s.hi JOIN ot ON ot.doc_id = s.doc_id AND ot.o = s.t GROUP BY s.doc_id, ot.page, ot.chunk_index)"""


@query(f"{T.with_sql('docs', 'chunks', 'vecs')}, {_SCORED}, {_CHUNK_HITS}, {_AROUND} SELECT CAST(b.doc_id AS VARCHAR) || '-' || CAST(b.chunk_index AS VARCHAR) AS chunk_id, b.doc_id, d.title, b.page, b.score, b.match_type, md5(e.content) AS content_md5, b.chunk_index AS place FROM cbest b JOIN docs d USING (doc_id) JOIN expanded e USING (doc_id, page, chunk_index)")
def search_results(spark, sf_dir):
    """Hybrid search over chunks to its end: lists merged by document, page and chunk, cut, expanded, projected."""
    c = T.chunks(spark, sf_dir)
    hits = _index(spark, sf_dir, "chunks", lambda: c.select(F.col("chunk_id").alias("key"), F.col("content").alias("text"))).search(PHRASE)
    ids = F.split("key", "-")
    text = hits.select(ids[0].cast("long").alias("doc_id"), F.lit(1).alias("page"), ids[1].cast("int").alias("chunk_index"), "bm25_rank", "score").orderBy("bm25_rank", *R.CHUNK).limit(30)
    first = c.groupBy("doc_id", "page").agg(F.min("chunk_index").alias("chunk_index"))
    vec = R.vector_top_k(T.embeddings(spark, sf_dir), _vector(spark, sf_dir), k=200).select(F.col("vec_id").alias("doc_id"), "score").join(first, "doc_id")
    best = R.final_results(R.hybrid_merge(vec, text, R.CHUNK), c, T.documents(spark, sf_dir), 10, 700)
    shown = R.project(best, 700, verbose=True)
    return shown.select("chunk_id", "doc_id", "title", "page", "score", "match_type", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), F.col("diagnostics.chunk_index").alias("place"))


_NEAREST = "nearest AS (SELECT q.vec_id AS query_id, a.vec_id, {0} AS score FROM vecs a, (SELECT vec_id, v FROM vecs WHERE vec_id % 100 = 0) q), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM nearest)".format(_COS)


def _vector_index(spark, sf_dir) -> tuple[VectorIndex, DataFrame]:
    v = T.embeddings(spark, sf_dir)
    index = VectorIndex(spark, f"{shared_dir(spark)}/loomdex-index/vectors-{fingerprint(spark, f'{sf_dir}/embeddings.parquet')}")
    if not index.store.latest().number:
        index.build(v.select("vec_id", "v", "label"))
    return index, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


@query(f"{T.with_sql('vecs')}, {_NEAREST} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM best WHERE rank <= 10")
def vector_index_exact(spark, sf_dir):
    index, q = _vector_index(spark, sf_dir)
    return index.search(q, exact=True)


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, sf_dir):
    """Queries through the cells, and whether they find at least nine in ten of what all vectors give (equal scores count)."""
    index, q = _vector_index(spark, sf_dir)
    last = index.search(q, exact=True).groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("n"))
    found = index.search(q).join(last, "query_id").where("score >= last")
    n = q.agg(F.count("*").alias("n_queries")).join(last.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")), F.lit(True))
    return n.join(found.agg(F.count("*").alias("hits")), F.lit(True)).select("n_queries", (10 * F.col("hits") >= 9 * F.col("all")).alias("enough"))


# ---- context, pages, documents -------------------------------------------------------------------------------------

_CTX = f"""{T.with_sql('chunks')}, c AS (SELECT doc_id, chunk_index AS i, length(content) AS len FROM chunks),
t AS (SELECT doc_id, i AS t_index, len AS t_len FROM c WHERE i = 3),
b0 AS (SELECT t.doc_id, t_index, t_len, c.i, c.len, row_number() OVER w AS rn, sum(c.len) OVER w AS s FROM t JOIN c ON c.doc_id = t.doc_id AND c.i < t_index WINDOW w AS (PARTITION BY t.doc_id ORDER BY c.i DESC)),
b AS (SELECT doc_id, min(i) AS start_index, max(t_len + s + rn) AS cum FROM b0 WHERE rn <= 20 AND t_len + s + rn <= 1.2 * 900 GROUP BY doc_id),
tb AS (SELECT t.doc_id, t_index, coalesce(start_index, t_index) AS start_index, coalesce(cum, t_len) AS total FROM t LEFT JOIN b USING (doc_id)),
a0 AS (SELECT tb.doc_id, c.i, total + sum(c.len) OVER w + row_number() OVER w AS cum, row_number() OVER w AS rn FROM tb JOIN c ON c.doc_id = tb.doc_id AND c.i > t_index WINDOW w AS (PARTITION BY tb.doc_id ORDER BY c.i)),
a AS (SELECT doc_id, max(i) AS end_index, max(cum) AS cum FROM a0 WHERE rn <= 20 AND cum <= 1.2 * 900 GROUP BY doc_id)"""


def _targets(spark, sf_dir):
    c = T.chunks(spark, sf_dir)
    return c, c.where("chunk_index = 3").select("doc_id", F.col("chunk_index").alias("t_index"))


@query(f"{_CTX} SELECT doc_id, t_index, start_index, CAST(total AS BIGINT) AS n_chars FROM tb")
def context_before(spark, sf_dir):
    return R.expand_context(*_targets(spark, sf_dir), 900, both=False)


@query(f"{_CTX} SELECT doc_id, t_index, start_index, coalesce(end_index, t_index) AS end_index, CAST(coalesce(cum, total) AS BIGINT) AS n_chars FROM tb LEFT JOIN a USING (doc_id)")
def context_both(spark, sf_dir):
    return R.expand_context(*_targets(spark, sf_dir), 900)


@query(f"{T.with_sql('chunks')} SELECT doc_id, page, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS text_md5 FROM chunks GROUP BY doc_id, page")
def page_reassembly(spark, sf_dir):
    return L.page_text(T.chunks(spark, sf_dir)).select("doc_id", "page", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(f"{T.with_sql('chunks')} SELECT chunk_id, page, chunk_index FROM chunks WHERE doc_id = 8 AND page = 1 ORDER BY page, chunk_index")
def doc_chunks_ordered(spark, sf_dir):
    return L.chunks_of(T.chunks(spark, sf_dir), 8, 1).select("chunk_id", "page", "chunk_index")


@query(f"{T.with_sql('chunks')} SELECT chunk_id, CAST(doc_id AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, chunk_index) - 1 AS VARCHAR) AS record_id FROM chunks")
def chunk_record_ids(spark, sf_dir):
    c = T.chunks(spark, sf_dir)
    return L.number_chunks(c.withColumnRenamed("chunk_id", "old_id")).select(F.col("old_id").alias("chunk_id"), F.col("chunk_id").alias("record_id"))


@query(f"{T.with_sql('docs')} SELECT doc_id, path FROM docs WHERE lang = 'de' OR source = 'src7'")
def documents_by_tag(spark, sf_dir):
    return L.by_tag(T.documents(spark, sf_dir), "de", "src7").select("doc_id", "path")


@query(f"{T.with_sql('docs')} SELECT doc_id FROM docs WHERE contains(lower(title), 'the') OR starts_with(id, 'the') ORDER BY size_bytes DESC, id LIMIT 1")
def document_lookup(spark, sf_dir):
    return L.lookup(T.documents(spark, sf_dir), "the", newest="size_bytes").select("doc_id")


@query(f"{T.with_sql('docs')} SELECT id, title, 1 AS page_count, lang || ',' || source AS tags, 'txt' AS file_type FROM docs")
def document_summary(spark, sf_dir):
    d = T.documents(spark, sf_dir)
    return d.select("id", "title", F.lit(1).alias("page_count"), F.array_join("tags", ",").alias("tags"), P.file_type(F.col("path")).alias("file_type"))


@query(f"{T.with_sql('docs')} SELECT doc_id, size_bytes, CAST(row_number() OVER (ORDER BY (doc_id * 7919) % 1000 DESC, id) AS INTEGER) AS place FROM docs WHERE source = 'src5'")
def documents_newest_first(spark, sf_dir):
    d = T.documents(spark, sf_dir).withColumn("added_at", F.timestamp_seconds(F.col("doc_id") * 7919 % 1000))
    return L.newest_first(L.by_tag(d, "src5")).select("doc_id", "size_bytes", "place")


@query(f"{T.with_sql('docs')} SELECT doc_id, title FROM docs WHERE path = '/src0/en/20.txt' OR doc_id = 17")
def scan_by_key(spark, sf_dir):
    return T.documents(spark, sf_dir).where("path = '/src0/en/20.txt' or doc_id = 17").select("doc_id", "title")


# ---- library -------------------------------------------------------------------------------------------------------


@query(f"{T.with_sql('chunks')} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings) AS embeddings")
def library_stats(spark, sf_dir):
    return L.stats(T.documents(spark, sf_dir), T.chunks(spark, sf_dir), T.embeddings(spark, sf_dir))


@query(f"{T.with_sql('chunks')} SELECT d.doc_id, count(c.chunk_id) AS n_chunks FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY d.doc_id")
def chunks_per_document(spark, sf_dir):
    return L.chunks_per_document(T.documents(spark, sf_dir), T.chunks(spark, sf_dir))


@query(f"{T.with_sql('chunks')} SELECT chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_chunks(spark, sf_dir):
    return L.orphans(T.chunks(spark, sf_dir), T.read(spark, sf_dir, "labels"), "doc_id", "doc_id").select("chunk_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def orphan_embeddings(spark, sf_dir):
    return L.orphans(T.embeddings(spark, sf_dir), T.documents(spark, sf_dir).where("lang <> 'en'"), "vec_id", "doc_id").select("vec_id")


@query(f"{T.with_sql('chunks')} SELECT (SELECT count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS orphan_chunks, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)) AS orphan_embeddings")
def orphan_counts(spark, sf_dir):
    lab = T.read(spark, sf_dir, "labels")
    a = L.orphans(T.chunks(spark, sf_dir), lab, "doc_id", "doc_id").agg(F.count("*").alias("orphan_chunks"))
    return a.join(L.orphans(T.embeddings(spark, sf_dir), lab, "vec_id", "doc_id").agg(F.count("*").alias("orphan_embeddings")), F.lit(True))


@query(f"{T.with_sql('chunks')} SELECT (SELECT count(*) FROM documents WHERE source <> 'src2') AS documents, (SELECT count(*) FROM chunks c JOIN documents d USING (doc_id) WHERE d.source <> 'src2') AS chunks")
def delete_cascade(spark, sf_dir):
    d, c = T.documents(spark, sf_dir), T.chunks(spark, sf_dir)
    left = L.delete_documents({"documents": d, "chunks": c}, d.where("source = 'src2'").select("doc_id"))
    return L.stats(left["documents"], left["chunks"], None).drop("embeddings")


@query("SELECT vec_id, round(CASE WHEN vec_id % 10 = 0 THEN -CAST(embedding[1] AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END, 6) AS first FROM embeddings UNION ALL SELECT 1000000, 0.5")
def upsert_embeddings(spark, sf_dir):
    old = T.embeddings(spark, sf_dir).select("vec_id", "v")
    new = old.where("vec_id % 10 = 0").select("vec_id", F.transform("v", lambda x: -x).alias("v")).unionByName(spark.range(1).select(F.lit(1000000).cast("long").alias("vec_id"), F.array(F.lit(0.5)).alias("v")))
    return G.upsert(old, new, ["vec_id"]).select("vec_id", F.round(F.col("v")[0], 6).alias("first"))


@query(f"{T.with_sql('docs')} SELECT doc_id, title, path, CASE WHEN source = 'src1' THEN size_bytes * 2 ELSE size_bytes END AS size_bytes FROM docs")
def refresh_document(spark, sf_dir):
    d = T.documents(spark, sf_dir).select("doc_id", "title", "path", "size_bytes", "source")
    return L.refresh(d, d.where("source = 'src1'").select("doc_id", (F.col("size_bytes") * 2).alias("size_bytes"))).drop("source")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'none' ELSE '1' END AS pages, CASE WHEN source = 'src1' THEN 'new' WHEN doc_id % 3 = 0 THEN NULL ELSE 'old' END AS chunker, CASE WHEN source = 'src1' THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 0 THEN NULL ELSE '1' END AS version, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS author, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS nested FROM documents")
def refresh_metadata(spark, sf_dir):
    """A refresh sets pages to null and two fields of nested metadata; other fields of it stay, documents not refreshed too."""
    d = T.read(spark, sf_dir, "documents")
    chunker = lambda name, v: F.struct(F.lit(name).alias("id"), v.alias("version"))
    old = F.to_json(F.struct(chunker("old", F.lit(1).cast("long")).alias("chunker"), F.col("source").alias("author"), F.struct(F.array(F.lit("x"), F.col("lang")).alias("list")).alias("deep")))
    docs = d.select("doc_id", F.lit(1).alias("page_count"), F.when(F.col("doc_id") % 3 != 0, old).alias("metadata"))
    new = d.where("source = 'src1'").select("doc_id", F.lit(None).cast("int").alias("page_count"), F.to_json(F.struct(chunker("new", F.col("doc_id")).alias("chunker"), F.lit("no").alias("author"))).alias("metadata"))
    at = lambda path: F.get_json_object("metadata", path)
    return L.refresh(docs, new, REFRESHED).select("doc_id", F.coalesce(F.col("page_count").cast("string"), F.lit("none")).alias("pages"), at("$.chunker.id").alias("chunker"), at("$.chunker.version").alias("version"), at("$.author").alias("author"), at("$.deep.list[1]").alias("nested"))


@query("WITH l AS (SELECT doc_id, lang, source, CASE WHEN source = 'src1' THEN 'fresh' || chr(10) || text ELSE text END AS text FROM documents WHERE source <> 'src2'), c AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS c FROM l) SELECT l.doc_id, CASE WHEN l.source = 'src3' THEN 'tagged' ELSE l.lang || ',' || l.source END AS tags, CAST(octet_length(encode(l.text)) AS BIGINT) AS size_bytes, CAST(len(c.c) AS BIGINT) AS n_chunks, md5(array_to_string(c.c, chr(10))) AS text_md5 FROM l JOIN c USING (doc_id)")
def library_changes(spark, sf_dir):
    """All documents added to a library, then three writers on one version of it: one refreshes documents, one sets tags of others,
    one removes others. None of the changes is lost."""
    d = T.documents(spark, sf_dir)
    lib = Library(spark, f"{shared_dir(spark)}/loomdex-library/{uuid.uuid4().hex}")

    def tables(rows):
        docs = rows.select("id", "title", "path", F.lit(None).cast("timestamp").alias("added_at"), F.lit(1).alias("page_count"), F.octet_length("text").cast("long").alias("size_bytes"), "tags", F.lit("txt").alias("file_type"), F.lit(None).cast("string").alias("metadata"), F.lit("sha256").alias("source_hash_algorithm"), F.sha2("text", 256).alias("source_hash"))
        lines = rows.select("id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")).where("content <> ''")
        chunks = lines.select(F.concat_ws("-", "id", "chunk_index").alias("id"), F.col("id").alias("doc_id"), F.lit(1).alias("page"), "chunk_index", "content", F.col("content").alias("embedding_content"))
        return docs, chunks, spark.createDataFrame([], "chunk_id string, embedding array<float>")

    lib.replace_documents(*tables(d))
    base = lib.store.latest()
    tags, gone = Change(lib.store, base), Change(lib.store, base)
    old = tags.rows("documents", d.where("source = 'src3'").select("id"))
    tags.put("documents", old.withColumn("tags", F.array(F.lit("tagged"))))
    for name in ("documents", "chunks"):
        gone.remove(name, d.where("source = 'src2'").select("id"))
    lib.replace_documents(*tables(d.where("source = 'src1'").withColumn("text", F.concat(F.lit("fresh\n"), "text"))), mode="refresh")
    tags.commit()
    gone.commit()
    text = L.page_text(lib.table("chunks"), "\n").select(F.col("doc_id").alias("id"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))
    n = lib.table("chunks").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    out = lib.table("documents").join(n, "id").join(text, "id")
    return out.select(F.col("id").cast("long").alias("doc_id"), F.array_join("tags", ",").alias("tags"), "size_bytes", "n_chunks", "text_md5")


@query("SELECT doc_id, CASE WHEN doc_id = 3 THEN 'x,y' ELSE lang || ',' || source END AS tags FROM documents")
def update_tags(spark, sf_dir):
    return L.set_tags(T.documents(spark, sf_dir), 3, ["x", "y"]).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query(f"{T.with_sql('docs')} SELECT doc_id, path AS old_path, '/new/3.txt' AS new_path, true AS changed FROM docs WHERE doc_id = 3")
def relocate_document(spark, sf_dir):
    return L.relocate(T.documents(spark, sf_dir), 3, "/new/3.txt")[1]


@query(f"{T.with_sql('chunks')}, t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(CASE WHEN doc_id % 7 = 0 THEN 'again ' || content ELSE content END), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM chunks) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY term")
def postings_maintenance(spark, sf_dir):
    c = T.chunks(spark, sf_dir)
    new = c.withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("again "), "content")).otherwise(F.col("content")))
    index = L.maintain_postings(L.postings(c), new, c.where("doc_id % 7 = 0").select("doc_id").distinct())
    return index.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"{T.with_sql('chunks')}, last AS (SELECT doc_id, max(chunk_index) AS last FROM chunks GROUP BY doc_id) SELECT c.conv_id AS doc_id, c.turn AS seq, CAST(coalesce(last + 1, 0) + row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS INTEGER) AS chunk_index FROM conversations c LEFT JOIN last l ON l.doc_id = c.conv_id")
def append_chunks(spark, sf_dir):
    more = T.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return L.append_after(T.chunks(spark, sf_dir), more).select("doc_id", "seq", F.col("chunk_index").cast("int").alias("chunk_index"))


# synthetic identities: by doc_id, some missing, some malformed, some changed
_IDENT = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'sha256' END AS algorithm, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'XYZ' ELSE sha256(text) END AS digest"
_ISSUE = "CASE WHEN doc_id % 17 = 0 THEN 'unreadable' WHEN doc_id % 11 = 0 THEN 'identity_missing' WHEN doc_id % 13 = 0 THEN 'identity_invalid' WHEN doc_id % 19 = 0 THEN 'hash_mismatch' WHEN doc_id % 23 = 0 THEN 'size_mismatch' ELSE 'ok' END"
_CHUNKER = "CASE WHEN doc_id % 5 = 0 THEN 'missing_metadata' WHEN doc_id % 7 = 0 THEN 'id_version_mismatch' WHEN doc_id % 3 = 0 THEN 'config_mismatch' ELSE 'ok' END"
_IDENTITY = "CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'invalid' ELSE 'valid' END"


def _identities(spark, sf_dir):
    d = T.documents(spark, sf_dir)
    m = lambda n: F.col("doc_id") % n == 0
    sha = F.sha2("text", 256)
    stored = d.select("doc_id", F.when(~m(11), "sha256").alias("algorithm"), F.when(m(11), None).when(m(13), "XYZ").otherwise(sha).alias("digest"), "size_bytes")
    now = d.where(~m(17)).select("doc_id", F.when(m(19), F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(sha).alias("digest"), (F.col("size_bytes") + F.when(m(23), 1).otherwise(0)).alias("size_bytes"))
    return stored, now


def _chunkers(spark, sf_dir):
    m = lambda n: F.col("doc_id") % n == 0
    meta = F.when(m(5), F.lit(None)).when(m(7), F.lit('{"id":"x","version":1,"config":{"unit":"chars","chunkSize":2000,"chunkOverlap":200}}')).when(m(3), F.lit('{"id":"txt","version":1,"config":{"unit":"chars","chunkSize":1000,"chunkOverlap":200}}')).otherwise(F.lit('{"id":"txt","version":1,"config":{"unit":"chars","chunkSize":2000,"chunkOverlap":200}}'))
    return T.documents(spark, sf_dir).select("doc_id", L.assess_chunker(meta, "txt", 1, 2000, 200).alias("chunker"))


@query(f"SELECT doc_id, {_IDENTITY} AS status FROM documents")
def source_identity_status(spark, sf_dir):
    s, _ = _identities(spark, sf_dir)
    return s.select("doc_id", L.identity_status(F.col("algorithm"), F.col("digest")).alias("status"))


@query(f"SELECT doc_id, {_ISSUE} AS issue FROM documents")
def source_identity_audit(spark, sf_dir):
    return L.audit_sources(*_identities(spark, sf_dir))


@query(f"SELECT doc_id, {_CHUNKER} AS chunker FROM documents")
def chunker_assessment(spark, sf_dir):
    return _chunkers(spark, sf_dir)


_PLAN = f"""WITH d AS (SELECT doc_id, {_ISSUE} AS issue, {_IDENTITY} AS ident, {_CHUNKER} AS chunker, doc_id % 29 = 0 AS stale FROM documents),
p AS (SELECT doc_id, CASE WHEN issue IN ('hash_mismatch', 'size_mismatch') THEN 'source_changed' WHEN ident = 'invalid' THEN 'identity_invalid' WHEN ident = 'missing' THEN 'identity_missing' WHEN stale THEN 'visuals_stale' WHEN chunker <> 'ok' THEN chunker END AS r FROM d)"""


def _plan(spark, sf_dir):
    s, now = _identities(spark, sf_dir)
    audit = L.audit_sources(s, now).join(s.select("doc_id", L.identity_status(F.col("algorithm"), F.col("digest")).alias("identity")), "doc_id")
    return L.rechunk_plan(audit.join(_chunkers(spark, sf_dir), "doc_id").withColumn("visuals_stale", F.col("doc_id") % 29 == 0), include_missing=True)


@query(f"{_PLAN} SELECT doc_id, r IS NOT NULL AS include, coalesce(r, 'up_to_date') AS reason FROM p")
def rechunk_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"{_PLAN} SELECT coalesce(r, 'up_to_date') AS reason, count(*) AS n FROM p GROUP BY 1")
def rechunk_totals(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT {_ISSUE} AS issue, count(*) AS n FROM documents GROUP BY 1")
def source_health(spark, sf_dir):
    return L.audit_sources(*_identities(spark, sf_dir)).groupBy("issue").agg(F.count("*").alias("n"))


@query(f"SELECT 3 AS checks, CAST((SELECT count(*) > 0 FROM documents WHERE {_ISSUE} <> 'ok') AS INTEGER) + CAST((SELECT count(*) > 0 FROM documents WHERE {_CHUNKER} <> 'ok') AS INTEGER) AS failed, false AS healthy")
def health_rollup(spark, sf_dir):
    a = L.audit_sources(*_identities(spark, sf_dir)).agg(F.lit("sources").alias("name"), F.every(F.col("issue") == "ok").alias("ok"))
    b = _chunkers(spark, sf_dir).agg(F.lit("chunker").alias("name"), F.every(F.col("chunker") == "ok").alias("ok"))
    c = T.documents(spark, sf_dir).agg(F.lit("documents").alias("name"), (F.count("*") > 0).alias("ok"))
    return L.health(a.unionByName(b).unionByName(c)).select(F.col("checks").cast("int").alias("checks"), F.col("failed").cast("int").alias("failed"), "healthy")


_PATHS = "found AS (SELECT path FROM docs WHERE doc_id % 3 = 0 UNION SELECT path FROM docs WHERE doc_id % 5 = 0), gone AS (SELECT path FROM docs WHERE lang = 'es')"


def _selection(spark, sf_dir):
    d = T.documents(spark, sf_dir)
    return d.where("doc_id % 3 = 0").select("path").unionByName(d.where("doc_id % 5 = 0").select("path")), d.where("lang = 'es'").select("path"), d.where("doc_id % 2 = 0").select("path")


@query(f"{T.with_sql('docs')}, {_PATHS} SELECT path FROM found EXCEPT SELECT path FROM gone")
def discovery_selection(spark, sf_dir):
    found, gone, _ = _selection(spark, sf_dir)
    return L.select_paths(found, gone)


@query(f"{T.with_sql('docs')}, {_PATHS} SELECT path FROM found EXCEPT (SELECT path FROM gone UNION SELECT path FROM docs WHERE doc_id % 2 = 0)")
def skip_existing(spark, sf_dir):
    return L.select_paths(*_selection(spark, sf_dir))


@query(f"{T.with_sql('docs')}, {_PATHS} SELECT path FROM (SELECT path FROM found EXCEPT SELECT path FROM gone) ORDER BY path LIMIT 20")
def discovery_sample(spark, sf_dir):
    found, gone, _ = _selection(spark, sf_dir)
    return L.select_paths(found, gone).orderBy("path").limit(20)


@query(f"{T.with_sql('docs')}, {_PATHS} SELECT (SELECT count(*) FROM found) AS discovered, (SELECT count(*) FROM gone) AS excluded, (SELECT count(*) FROM (SELECT path FROM found EXCEPT SELECT path FROM gone)) AS selected")
def selection_counts(spark, sf_dir):
    found, gone, _ = _selection(spark, sf_dir)
    return L.selection_counts(found, gone, L.select_paths(found, gone))


@query(f"{T.with_sql('chunks')}, i AS (SELECT doc_id, chunk_index AS seq, md5(content) AS hash, length(content) AS n FROM chunks), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hash ORDER BY seq) AS k FROM i WHERE n <= 300), g AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM f WHERE k = 1) SELECT doc_id, seq FROM g WHERE k <= 2")
def image_dedupe_cap(spark, sf_dir):
    i = T.chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").alias("seq"), F.md5(F.encode("content", "UTF-8")).alias("hash"), F.char_length("content").alias("byte_size"))
    return L.cap_images(i, 300, 2).select("doc_id", "seq")


# ---- taxonomy ------------------------------------------------------------------------------------------------------

_UP = """up AS (SELECT concept_id AS start, broader_id AS id FROM hierarchy UNION SELECT u.start, h.broader_id FROM up u JOIN hierarchy h ON h.concept_id = u.id)"""


@query(f"{T.with_sql('hierarchy')} SELECT DISTINCT broader_id AS id FROM hierarchy WHERE concept_id = 'n0'")
def concept_broader(spark, sf_dir):
    return G.broader(T.hierarchy(spark, sf_dir), "n0")


@query(f"{T.with_sql('hierarchy')} SELECT DISTINCT concept_id AS id FROM hierarchy WHERE broader_id = 'r1'")
def concept_narrower(spark, sf_dir):
    return G.narrower(T.hierarchy(spark, sf_dir), "r1")


@query("WITH r AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS a, 'n' || CAST((n_nationkey * 7 + 1) % 25 AS VARCHAR) AS b FROM nation), s AS (SELECT a, b FROM r UNION SELECT b, a FROM r) SELECT DISTINCT b AS id FROM s WHERE a = 'n1'")
def concept_related(spark, sf_dir):
    r = T.read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("concept_id"), F.concat(F.lit("n"), ((F.col("n_nationkey") * 7 + 1) % 25).cast("int").cast("string")).alias("related_id"), F.lit("related").alias("relation_type"))
    return G.related(r, "n1")


@query(f"{T.with_sql('hierarchy', recursive=True)}, {_UP} SELECT start, id FROM up")
def concept_ancestors(spark, sf_dir):
    e = T.hierarchy(spark, sf_dir)
    return G.closure(e, e.select(F.col("concept_id").alias("id")).distinct()).select("start", "id")


@query(f"{T.with_sql('hierarchy', recursive=True)}, {_UP} SELECT id AS start, start AS id FROM up")
def concept_descendants(spark, sf_dir):
    e = T.hierarchy(spark, sf_dir)
    return G.closure(e, e.select(F.col("broader_id").alias("id")).distinct(), up=False).select("start", "id")


@query(f"{T.with_sql('concepts', 'hierarchy', recursive=True)}, ids AS (SELECT id FROM concepts UNION SELECT concept_id FROM hierarchy UNION SELECT broader_id FROM hierarchy), tree AS (SELECT id, id AS path, 1 AS depth FROM ids WHERE id NOT IN (SELECT concept_id FROM hierarchy) UNION ALL SELECT h.concept_id, t.path || ' > ' || h.concept_id, t.depth + 1 FROM tree t JOIN (SELECT DISTINCT * FROM hierarchy) h ON h.broader_id = t.id) SELECT id, path, depth FROM tree")
def concept_tree_paths(spark, sf_dir):
    return G.tree_paths(T.hierarchy(spark, sf_dir), T.concepts(spark, sf_dir))


@query(f"{T.with_sql('concepts')} SELECT id FROM concepts WHERE contains(low, 'gion') OR contains(definition, 'gion')")
def concept_text_search(spark, sf_dir):
    return G.search_text(T.concepts(spark, sf_dir), "GION").select("id")


@query(f"{T.with_sql('concepts')}, l AS (SELECT id, CASE WHEN CAST(substring(id, 2) AS INTEGER) % 2 = 1 THEN low ELSE upper(low) END AS label FROM concepts) SELECT id, label, CAST(row_number() OVER (ORDER BY label, id) AS INTEGER) AS place FROM l")
def concepts_by_label(spark, sf_dir):
    """By code points, so capitals come before small letters."""
    c = T.concepts(spark, sf_dir)
    c = c.withColumn("pref_label", F.when(F.substring("id", 2, 9).cast("int") % 2 == 1, F.lower("pref_label")).otherwise(F.upper("pref_label")))
    return G.by_label(c).select("id", F.col("pref_label").alias("label"), "place")


@query(f"{T.with_sql('vecs')}, {_SCORED}, c AS (SELECT 'n' || CAST(vec_id AS VARCHAR) AS id, score FROM scored WHERE vec_id < 25 ORDER BY score DESC, id LIMIT 10) SELECT id, score FROM c WHERE score >= 0.45")
def concept_vector_search(spark, sf_dir):
    c = T.embeddings(spark, sf_dir).where("vec_id < 25").select(F.concat(F.lit("n"), "vec_id").alias("id"), "v")
    return G.search_vector(c, _vector(spark, sf_dir), threshold=0.45, k=5).select("id", "score")


def _assigned(spark, sf_dir):
    return T.read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("n"), (F.col("doc_id") % 25).cast("string")).alias("concept_id"), F.col("quality").cast("double").alias("confidence"), F.lit("llm").alias("source"))


@query("SELECT doc_id, 'n' || CAST(doc_id % 25 AS VARCHAR) AS concept_id, CASE WHEN toxic = 1 THEN 0.5 ELSE CAST(quality AS DOUBLE) END AS confidence, CASE WHEN toxic = 1 THEN 'manual' ELSE 'llm' END AS source FROM labels")
def assignment_upsert(spark, sf_dir):
    new = T.read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.concat(F.lit("n"), (F.col("doc_id") % 25).cast("string")).alias("concept_id"), F.lit(0.5).alias("confidence"), F.lit("manual").alias("source"))
    return G.upsert(_assigned(spark, sf_dir), new, ["doc_id", "concept_id"])


@query("SELECT 'n' || CAST(doc_id % 25 AS VARCHAR) AS concept_id, count(*) AS n FROM labels WHERE doc_id % 4 <> 0 GROUP BY 1")
def assignment_reads(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    return G.remove(a, a.where("doc_id % 4 = 0").select("doc_id", "concept_id"), ["doc_id", "concept_id"]).groupBy("concept_id").agg(F.count("*").alias("n"))


@query(f"{T.with_sql('concepts')} SELECT id, definition FROM concepts UNION ALL SELECT 'thing', 'extra'")
def seed_insert_if_absent(spark, sf_dir):
    c = T.concepts(spark, sf_dir).select("id", "definition")
    return G.insert_absent(c, spark.createDataFrame([("r0", "extra"), ("thing", "extra"), ("n3", "extra")], "id string, definition string"), ["id"])


@query(f"{T.with_sql('concepts')} SELECT id, CASE WHEN id = 'r2' THEN 'changed' ELSE definition END AS definition FROM concepts")
def concept_update(spark, sf_dir):
    return G.update_concept(T.concepts(spark, sf_dir), "r2", definition="changed", pref_label=None).select("id", "definition")


_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_PROPOSED = f"""{T.with_sql('vecs', recursive=True)}, c AS (SELECT 'c' || CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS label, v FROM vecs WHERE vec_id % 10 = 0),
p AS (SELECT row_number() OVER (ORDER BY ord) AS place, * FROM (SELECT 'p' || CAST(vec_id // 2 AS VARCHAR) AS id, CAST(label AS VARCHAR) AS label, v, vec_id AS ord FROM vecs WHERE vec_id % 10 <> 0 UNION ALL SELECT 'p' || CAST(vec_id // 2 AS VARCHAR), CAST(label AS VARCHAR), v, vec_id + 1000000000 FROM vecs WHERE vec_id % 5 = 1)),
near AS MATERIALIZED (SELECT a.place, -1 AS q, b.id AS met, a.label = b.label AS same, round((1 + {_COSINE}) / 2, 6) AS s FROM p a, c b UNION ALL SELECT a.place, b.place, b.id, a.label = b.label, round((1 + {_COSINE}) / 2, 6) FROM p a JOIN p b ON b.place < a.place),
work AS MATERIALIZED (SELECT p.place, p.id, list({{'q': q, 'met': met, 'same': same}} ORDER BY s DESC, q, met) FILTER (s >= 0.65) AS partners FROM p LEFT JOIN near ON near.place = p.place GROUP BY p.place, p.id),
one AS (SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS matched, CAST([] AS BIGINT[]) AS places, CAST([] AS VARCHAR[]) AS ids
 UNION ALL SELECT place, id, reason, CASE WHEN reason = 'duplicate' THEN best.met END, CASE WHEN reason = 'novel' THEN list_append(places, place) ELSE places END, CASE WHEN reason = 'novel' THEN list_append(ids, id) ELSE ids END
 FROM (SELECT *, CASE WHEN list_contains(ids, id) THEN 'id_taken' WHEN best.same THEN 'duplicate' ELSE 'novel' END AS reason FROM (SELECT w.place, w.id, o.places, o.ids, list_filter(w.partners, lambda x: x.q = -1 OR list_contains(o.places, x.q))[1] AS best FROM one o JOIN work w ON w.place = o.place + 1)))"""


@query(f"{_PROPOSED} SELECT place, id, reason = 'novel' AS accepted, reason, matched FROM one WHERE place > 0")
def concept_proposals(spark, sf_dir):
    """All vectors as proposals one after the other, a tenth of them as concepts, some proposed again at the end; the SQL goes one by one."""
    v = T.embeddings(spark, sf_dir).select("vec_id", F.col("label").cast("string").alias("label"), F.lit(None).cast("string").alias("definition"), "v")
    old = v.where("vec_id % 10 = 0").select(F.concat(F.lit("c"), "vec_id").alias("id"), "label", "definition", "v")
    named = v.select(F.concat(F.lit("p"), F.expr("vec_id div 2")).alias("id"), "label", "definition", "v", F.col("vec_id").alias("ord"))
    again = named.where("ord % 5 = 1").withColumn("ord", F.col("ord") + 1000000000)
    return PR.accept(named.where("ord % 10 <> 0").unionByName(again), old, threshold=0.65)


@query(f"{T.with_sql('vecs')}, s AS (SELECT a.vec_id, b.vec_id AS other, round((1 + {_COSINE}) / 2, 6) AS score FROM vecs a, vecs b WHERE a.vec_id % 20 <> 0 AND b.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rank FROM s WHERE score >= 0.5) SELECT vec_id, CAST(rank AS INTEGER) AS rank, other AS concept_id, score FROM r WHERE rank <= 5")
def concept_context(spark, sf_dir):
    """Five concepts at most (a twentieth of the vectors) for each document (all other vectors)."""
    v = T.embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "v")
    return PR.context(v.where("id % 20 <> 0"), v.where("id % 20 = 0")).withColumnRenamed("id", "vec_id")


@query("WITH c AS (SELECT source || '/' || lang AS cluster_id, doc_id, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents), t AS (SELECT cluster_id, count(*) AS chunk_count, string_agg('[Chunk ' || CAST(n AS VARCHAR) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY n) FILTER (n <= 600) AS prompt FROM c GROUP BY cluster_id) SELECT cluster_id, chunk_count, md5(left(prompt, 6000)) AS prompt_md5, CAST(NULL AS VARCHAR) AS summary FROM t UNION ALL SELECT 'none', 0, NULL, 'Empty cluster with no documents.'")
def cluster_summary_prompts(spark, sf_dir):
    d = T.documents(spark, sf_dir).select(F.concat_ws("/", "source", "lang").alias("cluster_id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    clusters = d.select("cluster_id").unionByName(spark.createDataFrame([("none",)], "cluster_id string"))
    return PR.summary_prompts(clusters, d).select("cluster_id", "chunk_count", F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"), "summary")


# ---- clustering ----------------------------------------------------------------------------------------------------

_CENT = "cent AS (SELECT CAST(vec_id AS INTEGER) AS cluster_id, v AS c FROM vecs WHERE vec_id < 8)"
_NEAR = f"{T.with_sql('vecs')}, {_CENT}, near AS (SELECT a.vec_id, cluster_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - c[i]) * (a.v[i] - c[i])))) AS d FROM vecs a, cent), asg AS (SELECT vec_id, cluster_id, round(round(d, 9), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), cluster_id) AS k FROM near) WHERE k = 1)"


def _centroids(spark, sf_dir):
    return T.embeddings(spark, sf_dir).where("vec_id < 8").select(F.col("vec_id").cast("int").alias("cluster_id"), F.col("v").alias("c"))


def _asg(spark, sf_dir):
    v = T.embeddings(spark, sf_dir)
    return v, _centroids(spark, sf_dir), C.assign(v, _centroids(spark, sf_dir))


@query(f"{_NEAR} SELECT * FROM asg")
def kmeans_assign_step(spark, sf_dir):
    return _asg(spark, sf_dir)[2]


@query(f"{_NEAR}, x AS (SELECT cluster_id, unnest(range(0, 64)) AS dim, v FROM asg JOIN vecs USING (vec_id)) SELECT cluster_id, CAST(dim AS INTEGER) AS dim, round(avg(v[dim + 1]), 6) + 0.0 AS mean FROM x GROUP BY cluster_id, dim")
def kmeans_update_step(spark, sf_dir):
    v, _, a = _asg(spark, sf_dir)
    return C.means(v, a).select("cluster_id", "dim", (F.round("mean", 6) + 0.0).alias("mean"))


@query(f"{_NEAR} SELECT cent.cluster_id, count(asg.vec_id) AS n FROM cent LEFT JOIN asg ON asg.cluster_id = cent.cluster_id GROUP BY cent.cluster_id")
def cluster_sizes(spark, sf_dir):
    _, c, a = _asg(spark, sf_dir)
    return C.sizes(a, c)


@query(f"{_NEAR}, e AS (SELECT vec_id, cluster_id, exp(-(d - min(d) OVER (PARTITION BY vec_id)) / 0.5) AS e FROM near), p AS (SELECT vec_id, cluster_id, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability FROM e) SELECT * FROM p WHERE probability >= 0.01")
def softmax_membership(spark, sf_dir):
    return C.memberships(T.embeddings(spark, sf_dir), _centroids(spark, sf_dir))


@query(f"{_NEAR}, r AS (SELECT count(*) AS n, sum(d * d) AS rss FROM asg JOIN near USING (vec_id, cluster_id)) SELECT round(n * ln((rss + 1e-10) / n) + (8 * 64 + 7) * ln(n), 4) AS bic FROM r")
def bic_score(spark, sf_dir):
    v, c, a = _asg(spark, sf_dir)
    return C.residual(v, c, a).select(F.round(C.bic(F.col("n"), F.col("rss"), 8, 64), 4).alias("bic"))


@query(f"{T.with_sql('vecs')}, cl AS (SELECT vec_id AS cluster_id, v AS a FROM vecs WHERE vec_id < 6), co AS (SELECT vec_id, v AS b FROM vecs WHERE vec_id >= 6 AND vec_id < 60), s AS (SELECT cluster_id, vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS confidence FROM cl, co), k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, vec_id) AS r FROM s WHERE confidence >= 0.25) SELECT CAST(cl.cluster_id AS INTEGER) AS cluster_id, 'c' || CAST(k.vec_id AS VARCHAR) AS concept_id, confidence, CASE WHEN k.vec_id IS NULL THEN 'Summary of ' || CAST(cl.cluster_id AS VARCHAR) END AS suggested_label FROM cl LEFT JOIN k ON k.cluster_id = cl.cluster_id AND k.r = 1")
def cluster_concept_match(spark, sf_dir):
    v = T.embeddings(spark, sf_dir)
    cl = v.where("vec_id < 6").select(F.col("vec_id").cast("int").alias("cluster_id"), F.col("v").alias("centroid"), F.concat(F.lit("Summary of "), "vec_id", F.lit(". More")).alias("summary"))
    co = v.where("vec_id >= 6 and vec_id < 60").select(F.concat(F.lit("c"), "vec_id").alias("concept_id"), F.col("vec_id").alias("ordinal"), "v")
    return C.concept_match(cl, co, 0.25)


# ---- text ----------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')) AS word, generate_subscripts(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), 1) AS pos FROM documents), f AS (SELECT * FROM w WHERE length(word) >= 4 AND word NOT IN ({_STOP}) AND NOT regexp_full_match(word, '[0-9]+')), c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM f GROUP BY doc_id, word), s AS (SELECT *, round(n * (CASE WHEN CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY doc_id) > 0.1 THEN 0.5 ELSE 1.0 END) * least(length(word) / 8.0, 1.5), 6) AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM s) SELECT doc_id, CAST(rank AS INTEGER) AS rank, word AS keyword, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 5")
def content_keywords(spark, sf_dir):
    return X.keywords(T.read(spark, sf_dir, "documents"), "doc_id", "text")


_TAG = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"SELECT p_partkey, {_TAG.format('p_name')} AS tag FROM part")
def normalise_tags(spark, sf_dir):
    return T.read(spark, sf_dir, "part").select("p_partkey", X.normal_tag(F.col("p_name")).alias("tag"))


@query(f"WITH p AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(regexp_replace(p_name || ' (x) the 2024 ' || p_type, '\\([^)]*\\)', ' ', 'g')), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w) AND NOT regexp_full_match(w, '[0-9]+')) AS w FROM part), u AS (SELECT p_partkey, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p), t AS (SELECT p_partkey, {_TAG.format('x')} AS t, min(i) AS i FROM u GROUP BY 1, 2 HAVING length({_TAG.format('x')}) >= 3 OR true), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS r FROM t WHERE length(t) >= 3) SELECT p_partkey, string_agg(t, ',' ORDER BY i) AS tags FROM k WHERE r <= 3 GROUP BY p_partkey")
def filename_tags(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(X.filename_tags(F.concat("p_name", F.lit(" (x) the 2024_"), "p_type", F.lit(".PDF"))), ",").alias("tags"))


@query(f"{T.with_sql('docs')} SELECT doc_id, source || ',' || lang AS tags FROM docs")
def path_tags(spark, sf_dir):
    return T.documents(spark, sf_dir).select("doc_id", F.array_join(X.path_tags(F.concat(F.lit("/Users/12/.git/Downloads"), "path")), ",").alias("tags"))


@query("SELECT p_partkey, list_aggregate(list_transform(string_split(CASE WHEN p_partkey % 3 = 1 THEN p_name || 'x' ELSE p_name END, ' '), lambda w: CASE WHEN w = upper(w) AND length(w) <= 4 THEN w WHEN length(w) <= 2 THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), 'string_agg', ' ') AS title FROM part")
def clean_title(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    dashed, kind = F.replace("p_name", F.lit(" "), F.lit("_-")), F.col("p_partkey") % 3
    inside, before = F.concat(dashed, F.lit("(Vol. 3)x.md")), F.concat(F.lit("(ISBN 12-3)"), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit(".EPUB"))
    name = F.when(kind == 1, inside).when(kind == 2, before).otherwise(F.concat(dashed, F.lit(" (2nd edition).pdf")))
    return p.select("p_partkey", X.clean_title(name).alias("title"))


@query("SELECT doc_id, 'Smith' AS author FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 2 = 1")
def filename_author(spark, sf_dir):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(" - Smith.pdf"))).otherwise(F.concat("source", F.lit(".pdf")))
    return T.read(spark, sf_dir, "documents").select("doc_id", X.author(name).alias("author"))


@query("WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 500)) AS i FROM documents) SELECT doc_id, CAST(i // 500 AS INTEGER) AS idx, md5(trim(substring(text, i + 1, 500), ' ')) AS piece FROM d WHERE length(text) > 0")
def hard_split_chunks(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.hard_split(F.col("text"), 500)).alias("idx", "p")).select("doc_id", "idx", F.md5(F.encode("p", "UTF-8")).alias("piece"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[^.!?]+[.!?]+["'')\\]]*\\s*|[^.!?]+$')) AS n_sentences FROM documents""")
def sentence_split(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text || '  ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || 'end ', chr(13), ''), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM documents")
def plain_text_normalise(spark, sf_dir):
    t = F.concat(F.lit("﻿\x00"), "text", F.lit("  \r\n\n\n\nend "))
    return T.read(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(X.plain(t), "UTF-8")).alias("text_md5"))


_CLOSED = r"regexp_replace({0}, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g')"


@query(f"SELECT doc_id, md5({_CLOSED.format(_CLOSED.format('text'))}) AS text_md5 FROM documents")
def dehyphenate(spark, sf_dir):
    """Every document with line breaks put into its words, and closed again with its own."""
    d = T.read(spark, sf_dir, "documents")
    broken = F.regexp_replace("text", "([A-Za-z])([A-Za-z])", "$1-\n$2")
    return d.select("doc_id", F.md5(F.encode(X.dehyphenate(X.dehyphenate(broken)), "UTF-8")).alias("text_md5"))


@query(f"SELECT doc_id, md5({_CLOSED.format('text')}) AS text_md5 FROM documents")
def dehyphenate_all(spark, sf_dir):
    """Every document with its own line breaks inside words closed."""
    return T.read(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(X.dehyphenate(F.col("text")), "UTF-8")).alias("text_md5"))


# pages of a document: its lines in threes, with a running head and a page number
_CLEAN = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, i // 3 AS page, 'Quarterly  Report' || chr(10) || string_agg(line, chr(10) ORDER BY i) || chr(10) || 'Page ' || CAST(i // 3 AS VARCHAR) || ' of 9' AS text FROM l GROUP BY doc_id, i // 3),
x AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
n AS (SELECT *, lower(trim(regexp_replace(replace(replace(raw, chr(0), ''), chr(160), ' '), '\s+', ' ', 'g'))) AS line FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS down, count(*) OVER (PARTITION BY doc_id, page) AS n FROM n WHERE line <> ''),
e AS (SELECT *, CASE WHEN n <= 5 THEN up <= 1 OR down <= 2 ELSE up <= 3 OR down <= 3 END AS edge FROM f),
k AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY doc_id),
r AS (SELECT e.doc_id, e.line FROM e JOIN k USING (doc_id) WHERE edge AND length(e.line) <= 120 GROUP BY e.doc_id, e.line, k.pages HAVING count(DISTINCT page) >= greatest(2, ceil(k.pages / 2.0))),
g AS (SELECT e.doc_id, e.page, e.pos FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND r.line = e.line WHERE (edge AND r.line IS NOT NULL) OR ((up = 1 OR down = 1) AND regexp_full_match(trim(raw), '(?i)(page\s*)?\d+(\s*(/|of)\s*\d+)?'))),
s AS (SELECT n.doc_id, n.page, string_agg(n.raw, chr(10) ORDER BY n.pos) AS text FROM n LEFT JOIN g USING (doc_id, page, pos) WHERE g.pos IS NULL GROUP BY n.doc_id, n.page)"""
_RUNNING = f"{_CLEAN} SELECT e.doc_id, e.line, count(DISTINCT page) AS n_pages FROM e JOIN k USING (doc_id) WHERE edge AND length(e.line) <= 120 GROUP BY e.doc_id, e.line, k.pages HAVING count(DISTINCT page) >= greatest(2, ceil(k.pages / 2.0))"
_NUMBERS = _CLEAN + r" SELECT doc_id, CAST(page AS BIGINT) AS page, regexp_extract(line, '^page (\d+) of', 1) AS number FROM e WHERE down = 1 AND regexp_full_match(line, '(page\s*)?\d+(\s*(/|of)\s*\d+)?')"


def _pages(spark, sf_dir):
    l = T.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    p = l.groupBy("doc_id", F.floor(F.col("i") / 3).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n").alias("body"))
    return p.select("doc_id", "page", F.concat(F.lit("Quarterly  Report\n"), "body", F.lit("\nPage "), "page", F.lit(" of 9")).alias("text"))


@query(_RUNNING)
def repeated_edge_lines(spark, sf_dir):
    return X.repeated_edge_lines(_pages(spark, sf_dir))


@query(_RUNNING)
def repeated_edge_lines_all(spark, sf_dir):
    """Every repeated edge line of every source."""
    return X.repeated_edge_lines(_pages(spark, sf_dir))


@query(_NUMBERS)
def page_number_lines_all(spark, sf_dir):
    """Page numbers of every source."""
    e = X.edge_lines(_pages(spark, sf_dir)).where(X.is_page_number(F.col("line")) & (F.col("down") == 1))
    return e.select("doc_id", "page", F.regexp_extract("line", r"^page (\d+) of", 1).alias("number"))


@query(_NUMBERS)
def page_number_lines(spark, sf_dir):
    e = X.edge_lines(_pages(spark, sf_dir)).where(X.is_page_number(F.col("line")) & (F.col("down") == 1))
    return e.select("doc_id", "page", F.regexp_extract("line", r"^page (\d+) of", 1).alias("number"))


@query(f"{_CLEAN} SELECT p.doc_id, CAST(p.page AS BIGINT) AS page, md5(coalesce(s.text, '')) AS text_md5 FROM p LEFT JOIN s USING (doc_id, page)")
def pages_cleaned(spark, sf_dir):
    """Pages of all documents without running lines and page numbers."""
    return PG.clean_pages(_pages(spark, sf_dir)).select("doc_id", "page", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query()
def page_chunks(spark, sf_dir):
    """The whole chain of paged documents: cleaned, titles marked, paragraphs joined, cut. No SQL: packing is sequential."""
    return PG.page_chunks(_pages(spark, sf_dir), 800, 80)


@query("SELECT doc_id, doc_id % 5 = 0 AS binary FROM documents")
def binary_text_flag(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", X.looks_binary(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\x00"), "text")).otherwise(F.col("text"))).alias("binary"))


@query("SELECT doc_id, regexp_matches(text, '(^|\\n)(#{1,6}\\s|[-*+]\\s|\\d+\\.\\s|```|\\|[^\\n]+\\|)|\\[[^\\n]+\\]\\([^\\n]+\\)') AS markdown FROM documents")
def markdown_sniff(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", X.looks_like_markdown(F.col("text")).alias("markdown"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'docx' WHEN 2 THEN 'odt' WHEN 3 THEN 'odt' WHEN 4 THEN 'txt' ELSE 'pdf' END AS file_type FROM documents")
def file_type_from_path(spark, sf_dir):
    ext = F.element_at(X.words_in((".md", ".DOCX", ".odt", ".fodt", ".txt", ".bin")), (F.col("doc_id") % 6 + 1).cast("int"))
    return T.read(spark, sf_dir, "documents").select("doc_id", P.file_type(F.concat("source", ext)).alias("file_type"))


@query(f"{T.with_sql('docs')} SELECT doc_id, substring(sha256(path), 1, 12) AS id FROM docs")
def document_id_hash(spark, sf_dir):
    return T.documents(spark, sf_dir).select("doc_id", P.document_id(F.col("path")).alias("id"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents")
def source_fingerprint(spark, sf_dir):
    return T.documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), "size_bytes")


@query(
    "WITH v AS (SELECT p_partkey, p_partkey % 5 AS u, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size + (p_partkey % 4) / 4.0 END AS x FROM part) "
    "SELECT p_partkey, coalesce(CASE WHEN x > 0 AND u < 4 THEN CAST(floor(CAST(x AS DOUBLE) * ([1, 1024, 1048576, 1073741824])[u + 1]) AS BIGINT) END, -1) AS bytes, "
    "coalesce(CASE WHEN x > 0 AND u < 3 THEN CAST(floor(CAST(x AS DOUBLE) * ([1, 1000, 60000])[u + 1]) AS BIGINT) END, -1) AS ms FROM v"
)
def size_parse(spark, sf_dir):
    """Numbers with every unit in any case and blanks around them; other units and nothing at all are no sizes."""
    k = F.col("p_partkey")
    number = F.when(k % 11 == 0, "0").otherwise(F.concat(F.col("p_size").cast("string"), F.element_at(X.words_in(("", ".25", ".5", ".75")), (k % 4 + 1).cast("int"))))
    unit = lambda *v: F.concat(number, F.element_at(X.words_in(v), (k % 5 + 1).cast("int")))
    none = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    p = T.read(spark, sf_dir, "part")
    return p.select("p_partkey", none(P.size_bytes(unit("b", " KB", "mb ", "  Gb", "tb"))).alias("bytes"), none(P.duration_ms(unit("ms", " S", "m ", "h", ""))).alias("ms"))


@query("SELECT p_partkey, CASE WHEN p_size + 3 <= 50 THEN CAST(p_size AS VARCHAR) || ',' || CAST(p_size + 1 AS VARCHAR) || ',' || CAST(p_size + 2 AS VARCHAR) || ',' || CAST(p_size + 3 AS VARCHAR) END AS pages FROM part")
def page_selector(spark, sf_dir):
    s = F.col("p_size")
    sel = F.concat((s + 3).cast("string"), F.lit("-"), s.cast("string"), F.lit(", "), (s + 1).cast("string"))
    return T.read(spark, sf_dir, "part").select("p_partkey", F.array_join(P.pages_of(sel, F.lit(50)), ",").alias("pages"))


_OCTETS = ((0, 10, 100, 127, 169, 172, 192, 192, 192, 198, 198, 203, 224, 240, 255, 8), (1, 2, 64, 3, 254, 16, 0, 0, 168, 18, 51, 0, 5, 6, 255, 8), (4, 5, 6, 7, 8, 9, 0, 2, 10, 11, 100, 113, 12, 13, 255, 8))


@query(
    f"WITH i AS (SELECT c_custkey, ({list(_OCTETS[0])})[c_custkey % 16 + 1] AS a, CASE WHEN c_custkey // 16 % 3 = 1 THEN c_custkey * 37 % 256 ELSE ({list(_OCTETS[1])})[c_custkey % 16 + 1] END AS b, "
    f"CASE WHEN c_custkey // 48 % 2 = 1 THEN c_custkey * 11 % 256 ELSE ({list(_OCTETS[2])})[c_custkey % 16 + 1] END AS c FROM customer) "
    "SELECT c_custkey, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)))) "
    "OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113) AS private FROM i"
)
def private_address(spark, sf_dir):
    """Addresses in each network that is not public, and beside it."""
    k = F.col("c_custkey")
    at = lambda row: F.element_at(F.array(*map(F.lit, _OCTETS[row])), (k % 16 + 1).cast("int"))
    b = F.when(F.floor(k / 16) % 3 == 1, k * 37 % 256).otherwise(at(1))
    c = F.when(F.floor(k / 48) % 2 == 1, k * 11 % 256).otherwise(at(2))
    return T.read(spark, sf_dir, "customer").select("c_custkey", P.is_private_ipv4(F.concat_ws(".", at(0), b, c, k % 256)).alias("private"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'txt' WHEN 3 THEN 'odt' ELSE 'markdown' END AS file_type FROM documents")
def download_type(spark, sf_dir):
    pick = lambda *v: F.element_at(X.words_in(v), (F.col("doc_id") % 5 + 1).cast("int"))
    u = pick("http://h/x", "http://h/a.MD?x=1", "http://h/n.txt", "http://h/d.fodt", "http://h/y")
    m = pick("application/pdf", "text/plain", "application/octet-stream", "text/xml", "text/plain; charset=utf-8")
    return T.read(spark, sf_dir, "documents").select("doc_id", P.download_type(u, m, F.lit("# Title\ntext")).alias("file_type"))


@query("SELECT doc_id, doc_id % 4 <> 0 AS safe FROM documents")
def safe_document_id(spark, sf_dir):
    i = F.when(F.col("doc_id") % 4 == 0, F.element_at(X.words_in(("a/b", "con.txt", "x.", "a:b")), (F.col("doc_id") % 4 + 1 + (F.col("doc_id") / 4).cast("int") % 4).cast("int"))).otherwise(F.concat("source", F.lit("-"), "doc_id"))
    return T.read(spark, sf_dir, "documents").select("doc_id", P.safe_id(i).alias("safe"))


@query("SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS n FROM documents")
def llm_json_repair(spark, sf_dir):
    raw = F.concat(F.lit("Here:\n```json\n{lang: '"), "lang", F.lit("', 'tags': ['a','b',], n: "), "doc_id", F.lit(",}\n```"))
    j = F.from_json(X.json_repair(raw), "lang string, tags array<string>, n long")
    return T.read(spark, sf_dir, "documents").select("doc_id", j["lang"].alias("lang"), j["n"].cast("string").alias("n"))


@query("SELECT n_nationkey, n_nationkey % 4 = 0 AS valid FROM nation")
def proposed_concept_validation(spark, sf_dir):
    c = F.element_at(X.words_in(("programming/type-systems", "cooking/pasta", "design/a-b-c-d-e", "meta/New")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return T.read(spark, sf_dir, "nation").select("n_nationkey", X.valid_concept(c, F.col("n_name")).alias("valid"))


@query("SELECT doc_id, md5('Document: ' || substring(text, 1, 60) || chr(10) || 'Section: S ' || lang || chr(10) || 'Page: 2' || chr(10) || '# S ' || lang || chr(10) || text) AS text_md5 FROM documents")
def embedding_text(spark, sf_dir):
    body = F.concat(F.lit("# S "), "lang", F.lit("\n"), "text")
    t = X.embedding_text(F.col("title"), X.heading_of(body), F.lit(2), body)
    return T.documents(spark, sf_dir).select("doc_id", F.md5(F.encode(t, "UTF-8")).alias("text_md5"))


@query("SELECT doc_id, trim(regexp_replace(substring(text, 1, 200), '\\s+', ' ', 'g'), ' ') || '...' AS summary FROM documents")
def heuristic_summary(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", X.summary_of(F.col("text")).alias("summary"))


@query("SELECT doc_id, lang || ',' || source AS tags FROM documents")
def merge_tags(spark, sf_dir):
    t = X.merge_tags(10, F.array("lang", "source"), F.array("source", F.lit("x")), F.array("lang"))
    return T.read(spark, sf_dir, "documents").select("doc_id", F.array_join(t, ",").alias("tags"))


@query("SELECT doc_id, 2 AS n, lang AS first FROM documents")
def stdin_queries(spark, sf_dir):
    q = X.stdin_queries(F.concat(F.lit("# note\n\n  "), "lang", F.lit(" \n#x\n"), "source", F.lit("\n")))
    return T.read(spark, sf_dir, "documents").select("doc_id", F.size(q).alias("n"), q[0].alias("first"))


@query("SELECT conv_id, turn, to_json({'ok': true, 'command': role, 'result': {'turn': turn}}) AS line FROM conversations")
def result_envelope(spark, sf_dir):
    from .service import envelope_column

    return T.read(spark, sf_dir, "conversations").select("conv_id", "turn", envelope_column(F.col("role"), F.struct("turn")).alias("line"))


# ---- event counts: an extension, batch form of the streaming job ----------------------------------------------------


_SIGHTED = "s AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, doc_id % 3 <> 0 AS twice, doc_id % 5 = 0 AS other FROM documents)"


@query(f"WITH {_SIGHTED} SELECT path, 'stable' AS status, size_bytes, 5 AS minutes FROM s WHERE twice AND NOT other UNION ALL SELECT path, 'changed', size_bytes + 1, 5 FROM s WHERE twice AND other UNION ALL SELECT path, 'unconfirmed', size_bytes + 1, 0 FROM s WHERE twice AND other UNION ALL SELECT path, 'unconfirmed', size_bytes, 0 FROM s WHERE NOT twice")
def settled_sightings(spark, sf_dir):
    """Each document sighted once or twice, some with other content the second time, then a clock that lets the timers run: a stream
    over a table of sightings, with its outcomes as a table."""
    at = f"{shared_dir(spark)}/loomdex-steps/sightings-{uuid.uuid4().hex}"
    d = T.documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("path"), "size_bytes", F.sha2("text", 256).alias("digest"), F.expr("timestamp_seconds(1700000000)").alias("at"))
    other = F.col("doc_id") % 5 == 0
    again = d.where("doc_id % 3 <> 0").withColumns({"size_bytes": F.col("size_bytes") + other.cast("int"), "digest": F.when(other, F.sha2("digest", 256)).otherwise(F.col("digest")), "at": F.expr("at + interval 5 minutes")})
    clock = spark.range(1).select(F.lit("clock").alias("path"), F.lit(0).cast("long").alias("size_bytes"), F.lit("").alias("digest"), F.expr("timestamp_seconds(1700000000) + interval 1 hour").alias("at"))
    d.drop("doc_id").unionByName(again.drop("doc_id")).unionByName(clock).write.parquet(f"{at}/seen")
    own = spark.newSession()
    own.conf.set(*ST.STORE)
    outcome = ST.settled(ST.sighting_stream(own, f"{at}/seen"))
    outcome.writeStream.format("parquet").option("path", f"{at}/outcome").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    minutes = F.expr("cast((unix_millis(last) - unix_millis(first)) div 60000 as int)").alias("minutes")
    return spark.read.schema(outcome.schema).parquet(f"{at}/outcome").select("path", "status", "size_bytes", minutes)


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def chunk_texts(spark, sf_dir):
    """The chunker over whole documents: (doc_id, chunk_index, content)."""
    from .operators.chunking import chunked

    return chunked(T.read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 2000, 200)
