"""What proposals cost: partners are those better than the best concept, and batches decide as one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import proposals as PR
from loomdex.operators import similarity as S

from .test_proposals import ROW, cloud, one_by_one, score


def rows_of(seed, n):
    r = random.Random(seed)
    v = cloud(r, n, dims=4, heaps=3)
    rows = [(f"p{k // 2}", f"L{r.randrange(3)}", None, v[k], k) for k in range(n)]
    rows += [(*rows[k][:4], 1000 + k) for k in range(0, n, 5)]
    return rows, [(f"c{k}", f"L{k % 3}", None, w) for k, w in enumerate(cloud(random.Random(seed), n // 10, dims=4, heaps=3))]


def test_partners_are_those_better_than_the_best_concept(spark, monkeypatch):
    seen, stored = {}, PR.stored

    def counted(df, name="step"):
        out = stored(df, name)
        if name == "partners":
            seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(PR, "stored", counted)
    rows, concepts = rows_of(3, 300)
    got = PR.accept(spark.createDataFrame(rows, f"{ROW}, ord int"), spark.createDataFrame(concepts, ROW), threshold=0.2)
    assert sorted(map(tuple, got.collect())) == one_by_one(rows, concepts, 0.2, lambda a, b: a == b)
    # over 30,000 pairs reach the threshold
    assert 0 < seen["partners"] < 300 * 25


def test_batches_decide_as_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(PR, "RATIO", 0)
    rows, concepts = rows_of(4, 60)
    rows += [(None, "L1", None, rows[0][3], 2000), ("q1", "L1", None, None, 2001)]
    got = PR.accept(spark.createDataFrame(rows, f"{ROW}, ord int"), spark.createDataFrame(concepts, ROW), threshold=0.8, batch=40)
    assert sorted(map(tuple, got.collect())) == one_by_one(rows, concepts, 0.8, lambda a, b: a == b)


@pytest.mark.parametrize("block", [7, 1000])
def test_improving_pairs(spark, block):
    r = random.Random(6)
    v = cloud(r, 50)
    rows = [(k, v[k], r.choice([None, 0.5, 0.9]), r.choice([k, 60])) for k in range(50)]
    rows[9] = (9, rows[8][1], 1.0, 60)
    got = S.improving(spark.createDataFrame(rows, "id long, v array<double>, least double, last long"), 0.7, block=block).collect()
    want = {(i, j): score(a, b) for i, a, least, last in rows for j, b, _, _ in rows if i != j and j < last and score(a, b) >= 0.7 and (least is None or score(a, b) > least)}
    assert len(got) == len(want) and all(abs(want[x.id, x.other] - x.score) < 2e-6 for x in got)


def test_blocks_are_large_where_there_are_many_rows(spark):
    rows = spark.range(6000).select("id", F.array(*[F.randn(k) for k in range(8)]).alias("v"))
    moved = S.similar(rows, rows, 0.99, top=1)
    assert moved.count() == 6000
    assert S._block(6000) == S.LEAST_BLOCK and S._block(600_000) == S.BLOCK and S._block(80_000) == 5000
