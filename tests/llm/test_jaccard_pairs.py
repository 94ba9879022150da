"""Pairs that lists give: large sets that only share a passage are none, and a pair of many lists is a row once a task."""

import numpy as np
import pytest
from loomdex.llm import jaccard as J
from pyspark.sql.classic.dataframe import DataFrame


@pytest.fixture
def rows_made(monkeypatch):
    """Of each call of ``across``: rows that its tasks make, and different pairs among them."""
    seen, plain, distinct = [], J.across, DataFrame.distinct

    def across(*args):
        made = []
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "distinct", lambda df: made.append(df) or distinct(df))
            out = plain(*args)
        seen.append((made[-1].count(), out.count()))
        return out

    monkeypatch.setattr(J, "across", across)
    return seen


def text(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))


def test_large_sets_that_share_a_passage_are_no_pairs(spark, rows_made, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT_FROM", 10**9)  # as in a large table, the passage is not known to be frequent
    rng = np.random.default_rng(3)
    passage = text(rng, 200)
    docs = [(i, f"{text(rng, 2900)} {passage} {text(rng, 100 * i)}") for i in range(16)]
    docs += [(100 + i, t + " and one more") for i, t in docs[:4]]
    got = {r.doc_id: r.component_id for r in J.joined(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i, _ in docs}
    assert [made for made, _ in rows_made] == [0, 0]


def test_a_pair_of_many_lists_is_a_row_once_a_task(spark, rows_made, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT_FROM", 10**9)
    rng = np.random.default_rng(4)
    lines = [text(rng, 40) for _ in range(60)]
    docs = [(i, "\n".join(x for x in lines if rng.random() < 0.86)) for i in range(14)]
    J.joined(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).count()
    made, pairs = rows_made[-1]
    assert 0 < made <= int(spark.conf.get("spark.sql.shuffle.partitions")) * pairs


def test_what_lists_carry_rules_no_link_out():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(np.exp(rng.uniform(np.log(700), np.log(30000))))
        m = int(min(4 * n // 3, n * rng.uniform(1, 4 / 3)))
        both = -(-3 * (n + m) // 7)
        if both > n:
            continue
        a = rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
        b = np.concatenate((a[:both], rng.integers(0, 2**64 - 1, m - both, dtype=np.uint64)))
        size, raw = np.array([n, m]), []
        for h in (a, b):
            s = J.Sets.__new__(J.Sets)
            s.hash, s.size, s.first = h, np.array([len(h)]), np.array([0, len(h)])
            raw.append(J.narrowed(s.parities(), s.size)[0] + s.counts()[0])
        assert J.Carried(raw, size).may_link(np.array([0]), np.array([1]))[0]
