"""The functions that SQL may use give what the DataFrame functions give."""

import pytest

from loomdex import sql
from loomdex.operators import chunking as K


@pytest.fixture(scope="module")
def registered(spark):
    sql.register(spark)
    sql.register(spark)  # a second time replaces the first
    words = "Some words stand here. " * 40
    rows = [("a", 1, words), ("a", 0, "# Title\n\nfirst"), ("b", 0, None), ("c", 0, "x" * 65), ("d", 0, "")]
    spark.createDataFrame(rows, "doc_id string, section int, text string").repartition(3).createOrReplaceTempView("sections")
    return {"a": "# Title\n\nfirst\n\n" + words, "c": "x" * 65}


@pytest.mark.parametrize("kind", ["text", "markdown"])
def test_chunks_of_documents(spark, registered, kind):
    got = spark.sql(f"SELECT * FROM doc_chunks(TABLE(sections) PARTITION BY (doc_id) ORDER BY (section), 100, 20, '{kind}')").collect()
    want = {(d, i, c) for d, t in registered.items() for i, c in enumerate(K.KINDS[kind](t, 100, 20))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_chunks_of_a_text_beside_its_row(spark, registered):
    got = spark.sql("SELECT s.doc_id, c.chunk_index, c.content FROM sections s, LATERAL text_chunks(s.text, 30, 0, 'text') c WHERE s.doc_id <> 'a'").collect()
    assert {tuple(r) for r in got} == {("c", i, x) for i, x in enumerate(["x" * 30, "x" * 30, "x" * 5])}


def test_expressions(spark, registered):
    r = spark.sql("SELECT cosine_score(array(1D, 0D), array(2D, 0D)), cosine_score(array(1D), array(1D, 2D)), cosine_score(array(0D), array(1D)), rank_score(-3D), normal_tag('A b!!c-'), document_id('/x'), dot(array(1D, 2D), array(3D, 4D))").first()
    assert tuple(r) == (1.0, 0.5, None, 0.75, "a-b-c", spark.sql("SELECT left(sha2('/x', 256), 12)").first()[0], 11.0)
