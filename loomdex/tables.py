"""The knowledge-base tables as views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        F.substring("text", 1, 60).alias("title"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.array("lang", "source").alias("tags"),
        "text",
        "lang",
        "source",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each document (lines), in order from 0; empty ones are not kept."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return d.where("content <> ''").select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", F.lit(1).alias("page"), "chunk_index", "content")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.initcap(F.lower("r_name")).alias("pref_label"), F.array(F.lower("r_name")).alias("alt_labels"), F.lit("region").alias("definition"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.initcap(F.lower("n_name")).alias("pref_label"), F.array(F.lower("n_name")).alias("alt_labels"), F.lit("nation").alias("definition"))
    return r.unionByName(n)


#: Edges besides nation -> region: a second parent, a cycle and a chain of 40.
EXTRA_EDGES = (("r0", "world"), ("r1", "world"), ("r2", "world"), ("world", "thing"), ("n0", "r1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), *((f"d{i}", f"d{i + 1}") for i in range(1, 40)))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("concept_id"), F.concat(F.lit("r"), "n_regionkey").alias("broader_id"))
    return n.unionByName(spark.createDataFrame(list(EXTRA_EDGES), "concept_id string, broader_id string"))


#: The same tables for the oracle, as common table expressions.
SQL = {
    "docs": r"docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, substring(text, 1, 60) AS title, '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, text, lang, source FROM documents)",
    "chunks": r"pieces AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), chunks AS (SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(i - 1 AS VARCHAR) AS chunk_id, doc_id, 1 AS page, CAST(i - 1 AS INTEGER) AS chunk_index, p[i] AS content FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM pieces) WHERE p[i] <> '')",
    "vecs": r"vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)",
    "concepts": r"concepts AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, lower(r_name) AS low, r_name AS name, 'region' AS definition FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), lower(n_name), n_name, 'nation' FROM nation)",
    "hierarchy": "hierarchy AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS concept_id, 'r' || CAST(n_regionkey AS VARCHAR) AS broader_id FROM nation UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EXTRA_EDGES) + ") AS t(concept_id, broader_id))",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(SQL[n] for n in names)
