"""Exact joins of vectors by cosine, in cells and blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Centres of cells (they travel with the tasks); rows of a block on either side, and how many blocks a small table is cut into.
CELLS, BLOCK, LEAST_BLOCK, BLOCKS = 128, 32_768, 2048, 16
#: Rows of one matrix product.
ROWS = 128


def similar(left: DataFrame, right: DataFrame, threshold: float, top: int | None = None, cells: int = CELLS, block: int | None = None) -> DataFrame:
    """(left_id, right_id, score) of all pairs whose score, (1 + cosine) / 2 to six places, reaches ``threshold``; inputs have (id, v).

    Each right vector lies in the cell of its nearest centre; a left vector meets a cell only if the triangle inequality of
    angles allows a partner there, so no pair is lost. Cells of many rows are cut into blocks on both sides by a hash, and a
    pair of blocks is one matrix product in one task: a hot cell is many tasks of the same size. What the cells do not rule out
    is compared, at worst every pair, but only pairs that reach the threshold become rows; with ``top`` a block gives the
    best ``top`` of each left row (ties by id), and so does the whole. A row travels once for each block it meets, so blocks are
    as large as a task may hold (``BLOCK``), and smaller only where a table has too few rows for ``BLOCKS`` of them.
    Vectors that are null, hold a null or a number that is not finite, or have no length take no part. Sizes must agree (ValueError).
    """
    left, right = (_fit(df.select("id", F.col("v").cast("array<double>").alias("v"))) for df in (left, right))
    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["id"]
    out = f"left_id {kinds[0]}, right_id {kinds[1]}, score double"
    spark = left.sparkSession
    n_left, n_right = _sizes(left, right)
    block = block or _block(max(n_left, n_right))
    # no more cells than blocks: where angles rule nothing out, a left vector is sent no more often than blocks ask for
    cells = min(cells, -(-n_right // block)) or 1
    picked = right.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").collect()
    if not picked:
        return spark.createDataFrame([], out)
    centres = _unit(np.array([r.v for r in picked]))
    reach = np.arccos(np.clip(2 * (threshold - 1e-6) - 1, -1, 1))

    def settle(batches):
        for b in batches:
            if b.num_rows:
                cos = _unit(_matrix(b["v"])) @ centres.T
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(cos.argmax(1).astype("int32")), pa.array(np.arccos(np.clip(cos.max(1), -1, 1)))], ["id", "v", "cell", "angle"])

    homes = right.mapInArrow(settle, f"id {kinds[1]}, v array<double>, cell int, angle double")
    facts = homes.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
    radius = np.full(len(centres), -np.inf)
    for r in facts:
        radius[r.cell] = r.radius

    def met(batch):
        angle = np.arccos(np.clip(_unit(_matrix(batch["v"])) @ centres.T, -1, 1))
        return np.nonzero(angle <= radius + reach + 1e-6)

    def count(batches):
        for b in batches:
            if b.num_rows:
                n = np.bincount(met(b)[1], minlength=len(centres))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype="int32")), pa.array(n)], ["cell", "n"])

    def visit(batches):
        for b in batches:
            if b.num_rows:
                row, cell = met(b)
                for at in range(0, len(row), 4096):
                    rows = pa.array(row[at : at + 4096])
                    yield pa.RecordBatch.from_arrays([b["id"].take(rows), b["v"].take(rows), pa.array(cell[at : at + 4096].astype("int32"))], ["id", "v", "cell"])

    guests = left.mapInArrow(visit, f"id {kinds[0]}, v array<double>, cell int")
    split = {r.cell: [-(-r.n // block), 0] for r in facts}
    for r in left.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 0").collect():
        split[r.cell][1] = -(-r.n // block)
    sizes = spark.createDataFrame([(c, b, a) for c, (b, a) in split.items() if a], "cell int, right_blocks int, left_blocks int")
    mine = F.pmod(F.xxhash64("id"), F.col("left_blocks")).cast("int")
    theirs = F.pmod(F.xxhash64("id"), F.col("right_blocks")).cast("int")
    none = lambda k, c: F.lit(None).cast(kinds[k]).alias(c)
    # a block of each side under the name of the pair
    sides = guests.join(F.broadcast(sizes), "cell").select("cell", mine.alias("a"), _span("right_blocks").alias("b"), F.lit(0).alias("side"), F.col("id").alias("left_id"), none(1, "right_id"), "v")
    sides = sides.unionByName(homes.join(F.broadcast(sizes), "cell").select("cell", _span("left_blocks").alias("a"), theirs.alias("b"), F.lit(1).alias("side"), none(0, "left_id"), F.col("id").alias("right_id"), "v"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        x, y = (rows.filter(pa.array(rows["side"].to_numpy() == k)) for k in (0, 1))
        if not len(x) or not len(y):
            return
        # the order among equals is that of the ids
        y = y.sort_by("right_id")
        ids = x["left_id"].combine_chunks(), y["right_id"].combine_chunks()
        here, there = (_unit(_matrix(t["v"])) for t in (x, y))
        near = there.astype("float32").T.copy()
        slack = _slack(here)
        for at in range(0, len(x), ROWS):
            # single precision says which pairs may do, double precision which do
            rough = here[at : at + ROWS].astype("float32") @ near
            least = np.full((len(rough), 1), _cosine(threshold) - slack, "float32")
            if top and rough.shape[1] > top:
                kth = rough.max(1) if top == 1 else np.partition(rough, -top, axis=1)[:, -top]
                least = np.maximum(least, kth[:, None] - np.float32(2 * slack + 4e-6))
            i, j = _places(rough >= least)
            score = _score(here, there, at + i, j)
            keep = np.flatnonzero(score >= threshold)
            if top:
                keep = keep[np.lexsort((j[keep], -score[keep], i[keep]))]
                first = np.searchsorted(i[keep], i[keep])
                keep = keep[np.arange(len(keep)) - first < top]
            if len(keep):
                yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(at + i[keep])), ids[1].take(pa.array(j[keep])), pa.array(score[keep])], ["left_id", "right_id", "score"])

    pairs = sides.groupBy("cell", "a", "b").applyInArrow(meet, out)
    if not top:
        return pairs
    return pairs.withColumn("n", F.row_number().over(W.partitionBy("left_id").orderBy(F.desc("score"), "right_id"))).where(F.col("n") <= top).drop("n")


def improving(rows: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(id, other, score) of the pairs of rows (id, v, least, last; ids are numbers) whose score reaches ``threshold`` and, if there is
    one, exceeds ``least`` of the first, where the second's id is under ``last`` of the first.

    Blocks by a hash of the id meet in pairs, each pair once for both directions; scores and vectors without part are those of ``similar``."""
    rows = _fit(rows.select("id", F.col("v").cast("array<double>").alias("v"), "least", "last"))
    kind = dict(rows.dtypes)["id"]
    n = _sizes(rows)[0]
    blocks = max(1, -(-n // (block or _block(n))))
    mine, other = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sides = rows.withColumn("mine", mine).withColumn("other", other)
    sides = sides.select(F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "v", "least", "last")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table["side"].to_numpy()
        a, b = (table["a"][0].as_py(), table["b"][0].as_py())
        x = table.filter(pa.array(side == 0))
        y = x if a == b else table.filter(pa.array(side == 1))
        if not len(x) or not len(y):
            return
        here, there = (_unit(_matrix(t["v"])) for t in (x, y))
        near = there.astype("float32").T.copy()
        slack = _slack(here)
        least_x, least_y = (t["least"].to_numpy(zero_copy_only=False).astype(float) for t in (x, y))
        asked_x, asked_y = (np.fmax(_cosine(threshold), np.nan_to_num(_cosine(v), nan=-2)).astype("float32") - np.float32(slack) for v in (least_x, least_y))
        ids, last = [t["id"].to_numpy() for t in (x, y)], [t["last"].to_numpy() for t in (x, y)]
        for at in range(0, len(x), ROWS):
            rough = here[at : at + ROWS].astype("float32") @ near
            may = rough >= asked_x[at : at + ROWS, None]
            if a != b:
                may |= rough >= asked_y
            i, j = _places(may)
            score = _score(here, there, at + i, j)
            i += at
            fine = (score >= threshold) & (ids[0][i] != ids[1][j])
            ways = [(ids[0][i], ids[1][j], fine & ~(score <= least_x[i]) & (ids[1][j] < last[0][i]))]
            if a != b:
                ways.append((ids[1][j], ids[0][i], fine & ~(score <= least_y[j]) & (ids[0][i] < last[1][j])))
            for one, two, keep in ways:
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(one[keep]), pa.array(two[keep]), pa.array(score[keep])], ["id", "other", "score"])

    return sides.groupBy("a", "b").applyInArrow(meet, f"id {kind}, other {kind}, score double")


def _fit(rows: DataFrame) -> DataFrame:
    return rows.where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def _sizes(*tables: DataFrame) -> list[int]:
    """Rows of each table; an error if vectors differ in size."""
    each = [t.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first() for t in tables]
    seen = [s for r in each for s in (r.low, r.high) if s is not None]
    if len(set(seen)) > 1:
        raise ValueError(f"vectors of {min(seen)} and {max(seen)} numbers")
    return [r.n for r in each]


def _block(rows: int) -> int:
    return min(BLOCK, max(LEAST_BLOCK, -(-rows // BLOCKS)))


def _span(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _cosine(score):
    """The least cosine that rounds to a score."""
    return 2 * (score - 5e-7) - 1


def _slack(unit: np.ndarray) -> float:
    """More than single precision may be wrong by in a product of two such vectors."""
    return 1e-6 + 1.2e-7 * (unit.shape[1] + 8)


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # of a flat array, as few hits in a large one are found so in half the time
    return np.divmod(np.flatnonzero(hit), hit.shape[1])


def _score(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", left[i[k : k + 65536]], right[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
    return np.round((1 + (np.concatenate(parts) if parts else np.zeros(0))) / 2, 6)


def _matrix(vectors) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    # by the greatest number first, so that squares neither overflow nor vanish
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)
