"""Texts are read once for as many queries as may be broadcast."""

from loomdex.llm import search


def test_few_blocks_of_queries(spark, monkeypatch):
    sizes = []

    def block(docs, q, k):
        sizes.append(len(q.ids))
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")

    monkeypatch.setattr(search, "search_block", block)
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('a b', id) as text")
    assert search.top_k(docs, docs).count() == 0
    assert sizes == [9000]
