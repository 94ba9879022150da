"""Every query with SQL, held against DuckDB on the smallest tables."""

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomdex import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        kind = df[k].dtype.kind
        if kind == "f":
            df[k] = [None if pd.isna(x) else repr(round(float(x), 5) + 0.0) for x in df[k]]
        else:
            df[k] = ["NULL" if x is None or not isinstance(x, (list, np.ndarray)) and pd.isna(x) else str(x) for x in df[k]]
    return df.fillna("NULL").sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, sf_dir, name):
    ours, theirs = plain(catalog.queries()[name](spark, sf_dir).toPandas()), plain(duck.sql(catalog.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    assert (ours.values == theirs.values).all()


def test_filters_and_columns_reach_the_scan(spark, sf_dir, capsys):
    catalog.queries()["documents_by_tag"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan


def test_whole_tables_against_brute_force(spark, sf_dir):
    docs = dict(pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "text"]].values.tolist())
    run = lambda name: catalog.queries()[name](spark, sf_dir).collect()
    toks = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in docs.items()}
    tf = {i: sum(a == "to" and b == "the" for a, b in zip(t, t[1:])) for i, t in toks.items()}
    mean, df = sum(map(len, toks.values())) / len(toks), sum(n > 0 for n in tf.values())
    idf = max(np.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
    got = {r.doc_id: r.bm25_rank for r in run("fts_phrase_all")}
    assert got.keys() == {i for i, n in tf.items() if n}
    assert all(abs(x + idf * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean))) < 2e-6 for i, x in got.items())
    want = {i: hashlib.md5(re.sub(r"([A-Za-z])-\n([A-Za-z])", r"\1\2", t).encode()).hexdigest() for i, t in docs.items()}
    assert {r.doc_id: r.text_md5 for r in run("dehyphenate_all")} == want
    pages = {i: -(-len(t.split("\n")) // 3) for i, t in docs.items()}
    lines = run("repeated_edge_lines_all")
    assert {r.doc_id: r.n_pages for r in lines if r.line == "quarterly report"} == {i: n for i, n in pages.items() if n >= 2}
    assert sorted((r.doc_id, r.page, int(r.number)) for r in run("page_number_lines_all")) == [(i, k, k) for i in sorted(pages) for k in range(pages[i])]
