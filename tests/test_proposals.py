"""Joins of vectors and proposals of concepts, held against going through all one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.operators import proposals as PR
from loomdex.operators.similarity import similar

ROW = "id string, label string, definition string, v array<double>"


def score(a, b):
    a, b = np.array(a), np.array(b)
    return round(float((1 + a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) / 2), 6)


def cloud(r, n, dims=6, heaps=4):
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(heaps)]
    # a third of all in the first heap
    return [[x + r.gauss(0, 0.4) for x in centres[0 if i % 3 == 0 else r.randrange(heaps)]] for i in range(n)]


def test_similar_is_exact_in_cells_and_blocks(spark):
    r = random.Random(5)
    a, b = cloud(r, 150), cloud(r, 130)
    b[7], b[8], a[3] = a[2], a[2], [-x for x in a[2]]
    table = lambda v: spark.createDataFrame([*enumerate(v), (-1, None), (-2, [0.0] * 6), (-3, [float("nan")] * 6)], "id int, v array<double>")
    for t in (0.2, 0.75, 0.97):
        want = {(i, j): score(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if score(x, y) >= t}
        got = similar(table(a), table(b), t, cells=7, block=20).collect()
        assert len(got) == len(want)
        assert all(abs(x.score - want[x.left_id, x.right_id]) < 2e-6 for x in got)
    top = similar(table(a), table(b), 0.6, top=3, cells=7, block=20).collect()
    for i, x in enumerate(a):
        best = sorted((-score(x, y), j) for j, y in enumerate(b) if score(x, y) >= 0.6)[:3]
        assert sorted(p.right_id for p in top if p.left_id == i) == sorted(j for _, j in best)
    assert similar(table(a).limit(0), table(b), 0.5).count() == 0 and similar(table(a), table(b).limit(0), 0.5).count() == 0
    with pytest.raises(ValueError, match="3 and 6"):
        similar(table(a), spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, v array<double>"), 0.5)


def one_by_one(proposals, concepts, threshold, same):
    """The plain way: each proposal against all that is there when its turn comes."""
    there = [(-1, *c) for c in sorted(concepts)]
    out = []
    for place, (i, label, definition, v, _) in enumerate(sorted(proposals, key=lambda p: (p[4], p[0] or "", p[1] or "", p[2] or "")), 1):
        near = sorted([(-score(v, w), at, j, lab) for at, j, lab, _, w in there if v and w and score(v, w) >= threshold])
        if not i or not label:
            reason = "invalid"
        elif any(j == i for _, j, *_ in there):
            reason = "id_taken"
        elif near and same(label, near[0][3]):
            reason = "duplicate"
        else:
            reason = "novel"
            there.append((place, i, label, definition, v))
        out.append((place, i, reason == "novel", reason, near[0][2] if reason == "duplicate" else None))
    return out


@pytest.mark.parametrize("seed", [1])
def test_acceptance_is_that_of_one_after_the_other(spark, seed):
    r = random.Random(seed)
    vectors = cloud(r, 60, dims=4, heaps=5)
    kinds = [(f"p{r.randrange(45)}", f"L{r.randrange(4)}", r.choice([None, "d", ""]), v) for v in vectors]
    # copies, among them one kind that is a third of all
    rows = [(*(kinds[0] if r.random() < 0.33 else r.choice(kinds)), k) for k in range(130)]
    rows += [(None, "L1", None, vectors[0], 200), ("p9", "", None, vectors[1], 201), ("q1", "L1", None, None, 202), ("q2", "L1", None, None, 203)]
    concepts = [(f"c{k}", f"L{k % 4}", None, v) for k, v in enumerate(cloud(r, 6, dims=4, heaps=5))] + [("p3", "other", None, vectors[5])]
    got = PR.accept(spark.createDataFrame(rows, f"{ROW}, ord int"), spark.createDataFrame(concepts, ROW), threshold=0.8)
    assert sorted(map(tuple, got.collect())) == one_by_one(rows, concepts, 0.8, lambda a, b: a == b)


def test_an_injected_judge(spark):
    rows = [("a", "Cats", None, [1.0, 0.0], 1), ("b", "Felines", None, [1.0, 0.1], 2), ("d", "Dogs", None, [0.0, 1.0], 3), ("e", "Hounds", None, [0.1, 1.0], 4)]
    judge = lambda p, c: F.contains(F.lit("Felines=Cats"), F.concat(p["label"], F.lit("="), c["label"]))
    got = PR.accept(spark.createDataFrame(rows, f"{ROW}, ord int"), spark.createDataFrame([], ROW), judge)
    assert {x.id: (x.reason, x.matched) for x in got.collect()} == {"a": ("novel", None), "b": ("duplicate", "a"), "d": ("novel", None), "e": ("novel", None)}
    none = PR.accept(spark.createDataFrame([], f"{ROW}, ord int"), spark.createDataFrame([], ROW))
    assert none.count() == 0 and none.columns == ["place", "id", "accepted", "reason", "matched"]


def test_prompts(spark):
    chunks = spark.createDataFrame([(1, k, "ab" if k else None) for k in range(900)] + [(2, 0, "x" * 9000)], "cluster_id int, seq int, content string")
    got = {x.cluster_id: x for x in PR.summary_prompts(spark.createDataFrame([(1,), (2,), (3,)], "cluster_id int"), chunks).collect()}
    text = "\n\n".join(f"[Chunk {k + 1}]\n" + ("ab" if k else "") for k in range(900))
    assert got[1].prompt == text[:6000] and got[1].chunk_count == 900 and got[2].prompt == ("[Chunk 1]\n" + "x" * 9000)[:6000]
    assert got[3].summary == PR.NO_CHUNKS and got[3].prompt is None and got[3].chunk_count == 0
    two = PR.summary_prompts(spark.createDataFrame([(1,)], "cluster_id int"), chunks, max_chunks=2).first()
    assert two.prompt == "[Chunk 1]\n\n\n[Chunk 2]\nab" and two.chunk_count == 900
