"""Vector, full-text and hybrid search, context expansion and result merging."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V


def vector_top_k(vectors: DataFrame, query, k: int = 10, threshold: float = 0.0, tags=None, compat: bool = False) -> DataFrame:
    """The k vectors nearest to ``query`` by cosine: vec_id, score, rank-free.

    Filters apply before the cut. ``compat`` cuts to 3 k first where tags are asked for, as an approximate index would,
    so that fewer than k rows may come. A top-k is one TakeOrderedAndProject: each task sends k rows.
    """
    scored = vectors.withColumn("score", F.round(V.score_of_distance(V.cosine_distance(F.col("v"), V.literal(query))), 6)).where("score is not null")
    order = [F.desc("score"), "vec_id"]
    if compat and tags:
        scored = scored.orderBy(*order).limit(3 * k)
    if tags:
        scored = scored.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if threshold > 0:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(*order).limit(k)


def vector_top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of each of a few given queries (query_id, q): a bounded side, so it is broadcast."""
    scored = vectors.join(F.broadcast(queries), F.lit(True)).withColumn("score", F.round(V.score_of_distance(V.cosine_distance(F.col("v"), F.col("q"))), 6))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def tokens(col):
    """Runs of ASCII letters and digits in small letters."""
    return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda t: t != "")


def spaced(col):
    """The tokens of a text, each between single blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " ")), F.lit(" "))


def phrase_frequency(col, phrase: str):
    """How often the words of ``phrase`` stand one after another."""
    words = [w for w in re.split("[^a-z0-9]+", phrase.lower()) if w]
    return F.regexp_count(spaced(col), F.lit(f"(?= {' '.join(words)} )")) if words else F.lit(0)


K1, B = 1.2, 0.75


def fts_phrase(rows: DataFrame, text: str, phrase: str) -> DataFrame:
    """Rows that hold the phrase, with ``bm25_rank`` (the more negative the better) and ``score``.

    The phrase counts as one term. Corpus figures are one aggregate that combines before its shuffle, joined as one row.
    """
    measured = rows.withColumn("tf", phrase_frequency(F.col(text), phrase)).withColumn("dl", F.regexp_count(spaced(F.col(text)), F.lit("[a-z0-9]+")))
    corpus = measured.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl"), F.count(F.when(F.col("tf") > 0, 1)).alias("df"))
    idf = F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = measured.where("tf > 0").join(F.broadcast(corpus), F.lit(True))
    hit = hit.withColumn("bm25_rank", F.round(-(idf * gain), 6))
    return hit.withColumn("score", F.round(V.score_of_rank(F.col("bm25_rank")), 6)).drop("n_rows", "avgdl", "df")


def hybrid_merge(vector_hits: DataFrame, text_hits: DataFrame, key: str | list[str], boost: float = 1.05) -> DataFrame:
    """Full outer join of two hit lists (key, score): hits of both get the larger score times ``boost``, at most 1."""
    keys = [key] if isinstance(key, str) else key
    a = vector_hits.select(*keys, F.col("score").alias("vs"))
    b = text_hits.select(*keys, F.col("score").alias("fs"))
    both = F.col("vs").isNotNull() & F.col("fs").isNotNull()
    score = F.when(both, F.least(F.lit(1.0), F.greatest("vs", "fs") * boost)).otherwise(F.coalesce("vs", "fs"))
    kind = F.when(both, "hybrid").when(F.col("vs").isNotNull(), "vector").otherwise("fts")
    return a.join(b, keys, "full").select(*keys, F.round(score, 6).alias("score"), kind.alias("match_type"))


CHUNK = ["doc_id", "page", "chunk_index"]


def final_results(merged: DataFrame, chunks: DataFrame, documents: DataFrame, limit: int = 10, expand_chars: int = 0) -> DataFrame:
    """The best ``limit`` chunks (``CHUNK``, score, match_type): title, content, and the text around each.

    Scores descend, ties go by document, page and chunk. ``expanded`` joins the chunks around the hit that fit in
    ``expand_chars`` (500 if 0). The cut comes before the joins, so these have ``limit`` rows on one side."""
    best = merged.orderBy(F.desc("score"), *CHUNK).limit(limit)
    hit = F.broadcast(best).join(chunks.select("chunk_id", *CHUNK, "content"), CHUNK)
    hit = hit.join(documents.select("doc_id", "title"), "doc_id")
    around = expand_context(chunks, best.select("doc_id", "page", F.col("chunk_index").alias("t_index")), expand_chars or 500, text=True)
    around = around.select("doc_id", "page", F.col("t_index").alias("chunk_index"), F.col("text").alias("expanded"))
    return hit.join(around, CHUNK).select("chunk_id", "doc_id", "title", "page", "chunk_index", "score", "match_type", "content", "expanded")


def project(results: DataFrame, expand_chars: int = 0, verbose: bool = False, content: bool = True) -> DataFrame:
    """What a search shows of its final results: the text around a hit in place of its own if that was asked for; place and kind of
    score in ``diagnostics`` if ``verbose``; no text at all for a handle (``content`` false)."""
    shown = [F.coalesce("expanded", "content").alias("content") if expand_chars > 0 else F.col("content")] if content else []
    more = [F.struct("chunk_index", F.col("score").alias("raw_score"), F.col("match_type").alias("score_type")).alias("diagnostics")] if verbose else []
    return results.select("chunk_id", "doc_id", "title", "page", "score", "match_type", *shown, *more)


def dedupe_queries(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per vec_id: its best score and the sorted set of queries that found it."""
    out = hits.groupBy("vec_id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set(F.col("query_id").cast("string"))), ",").alias("queries"))
    return out.orderBy(F.desc("score"), "vec_id").limit(max(1, limit)) if limit is not None else out


def expand_context(chunks: DataFrame, targets: DataFrame, max_chars: int, most: int = 20, both: bool = True, text: bool = False) -> DataFrame:
    """The chunks around each target (doc_id, t_index, and page if it has one) that fit: start and end index and length of the
    joined text, and with ``text`` that text.

    Neighbours join with one newline, up to 1.2 * max_chars, the side before first, ``most`` on each side, each side up to the first
    that breaks the limit. A band join: chunks are numbered in their document and fall in bands of ``most``; a target meets its
    own band and the two beside it, so three bands at most and not its document.
    """
    paged = "page" in targets.columns
    place = ["page"] if paged else []
    c = chunks.join(targets.select("doc_id").distinct(), "doc_id", "left_semi")
    c = c.select("doc_id", *place, F.col("chunk_index").alias("i"), F.coalesce(F.char_length("content"), F.lit(0)).cast("long").alias("len"), *([F.col("content")] if text else []))
    c = c.withColumn("o", F.row_number().over(W.partitionBy("doc_id").orderBy(*place, "i"))).withColumn("band", F.floor(F.col("o") / most))
    t = targets.select("doc_id", *place, F.col("t_index").alias("i")).distinct().join(c.select("doc_id", *place, "i", F.col("o").alias("t_o"), F.col("band").alias("t_band")), ["doc_id", *place, "i"]).withColumnRenamed("i", "t_index")
    near = t.withColumn("band", F.explode(F.array(F.col("t_band") - 1, "t_band", F.col("t_band") + 1))).join(c.drop(*place), ["doc_id", "band"]).withColumn("d", F.col("o") - F.col("t_o")).where(F.abs("d") <= most)
    if not both:
        near = near.where("d <= 0")
    one = F.struct("d", "i", "len", *(["content"] if text else []))
    got = near.groupBy("doc_id", *place, "t_index").agg(F.array_sort(F.collect_list(one)).alias("n"))
    limit = F.lit(1.2 * max_chars)
    side = lambda ok: F.filter("n", lambda x: ok(x["d"]))
    own = F.element_at(side(lambda d: d == 0), 1)
    # state: length, last index taken, how many taken, whether the side is still open
    shape = "struct<total: bigint, at: int, n: int, on: boolean>"

    def grow(state, x):
        fits = state["on"] & (state["total"] + x["len"] + 1 <= limit)
        yes = F.struct(state["total"] + x["len"] + 1, x["i"].cast("int"), state["n"] + 1, F.lit(True)).cast(shape)
        return F.when(fits, yes).otherwise(F.struct(state["total"], state["at"], state["n"], F.lit(False)).cast(shape))

    def start(total):
        return F.struct(total, F.col("t_index").cast("int"), F.lit(0), F.lit(True)).cast(shape)

    got = got.withColumn("b", F.aggregate(F.reverse(side(lambda d: d < 0)), start(own["len"]), grow))
    if not both:
        return got.select("doc_id", *place, "t_index", F.col("b.at").alias("start_index"), F.col("b.total").alias("n_chars"))
    got = got.withColumn("a", F.aggregate(side(lambda d: d > 0), start(F.col("b.total")), grow))
    whole = [F.array_join(F.transform(side(lambda d: (d >= -F.col("b.n")) & (d <= F.col("a.n"))), lambda x: x["content"]), "\n").alias("text")] if text else []
    return got.select("doc_id", *place, "t_index", F.col("b.at").alias("start_index"), F.col("a.at").alias("end_index"), F.col("a.total").alias("n_chars"), *whole)
