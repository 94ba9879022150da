"""The engine's functions for SQL: ``register(spark)`` makes them known to a session.

Expressions are SQL functions, which Spark inlines into the plan. The chunker is a table function over rows of one document:

    SELECT * FROM doc_chunks(TABLE(sections) PARTITION BY (doc_id) ORDER BY (section), 2000, 200, 'text')

takes columns doc_id and text, joins the texts of a document in order by an empty line, and gives doc_id, chunk_index, content. With a
constant text it needs no table: ``SELECT * FROM docs, LATERAL text_chunks(docs.text, 2000, 200, 'markdown')``.
Null texts have no chunks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import chunking as K

EXPRESSIONS = {
    "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "cosine_score(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN size(a) = size(b) THEN (1 + try_divide(dot(a, b), sqrt(dot(a, a)) * sqrt(dot(b, b)))) / 2 ELSE 0.5D END",
    "rank_score(r DOUBLE) RETURNS DOUBLE": "abs(r) / (1 + abs(r))",
    "normal_tag(t STRING) RETURNS STRING": "regexp_replace(regexp_replace(regexp_replace(lower(t), '[^a-z0-9-]', '-'), '-+', '-'), '^-|-$', '')",
    "document_id(path STRING) RETURNS STRING": "left(sha2(path, 256), 12)",
}


@F.udtf(returnType="doc_id string, chunk_index int, content string")
class DocumentChunks:
    """Chunks of the rows of a partition, which is one document. Its texts are held until the last row has come."""

    def __init__(self):
        self._doc, self._texts, self._how = None, [], None

    def eval(self, row, size: int, overlap: int, kind: str):
        self._doc, self._how = row["doc_id"], (size, overlap, kind)
        if row["text"]:
            self._texts.append(row["text"])

    def terminate(self):
        if self._texts:
            size, overlap, kind = self._how
            K.check(size, overlap)
            for i, content in enumerate(K.KINDS[kind]("\n\n".join(self._texts), size, overlap)):
                yield str(self._doc), i, content


@F.udtf(returnType="chunk_index int, content string", useArrow=True)
class TextChunks:
    def eval(self, text: str, size: int, overlap: int, kind: str):
        K.check(size, overlap)
        yield from enumerate(K.KINDS[kind](text, size, overlap)) if text else ()


def register(spark: SparkSession) -> None:
    for name, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {body}")
    spark.udtf.register("doc_chunks", DocumentChunks)
    spark.udtf.register("text_chunks", TextChunks)
