"""Shards by a hierarchical weighted hash tree: region, rack, shard.

A key takes part in a race. Every region sends out draws of its own; the time
between two of them is exponential with the region's weight as rate, so the
first draw comes from a region in proportion to its weight. A draw descends: a
rack of the region, then a shard of the rack, each by a weighted hash draw
(least ``-ln(u) / weight`` of the children). Weights of racks and regions are
what their shards are provisioned for; a shard accepts a draw with the
probability weight / provision, and the key goes to the first draw accepted in
any region. All u are hashes of key, node and number of the draw.

The draws of one region do not depend on another's weights, and those that
reach one shard do not depend on what other shards accept. So

* a shard whose weight rises takes keys and none move between other shards;
* one whose weight falls, or that goes, gives its keys to others and no more;
* a new rack or region disturbs only keys that its own shards take, or, as a
  rack is provisioned inside a region, keys of that region.

``grown(n)`` builds trees of n equal shards: racks of 4, regions of 2 racks,
each region provisioned whole from its first shard on, so going from n to n + 1
shards moves keys to shard n only, for every n.

Slots number the rows of a shard from 0 without gaps, in order of a hash bucket
and then of doc_id, size and checksum. Rows go to buckets by a hash of all three,
sums run inside a bucket, and the buckets' totals give each its first slot: no
task gets a whole shard. Equal rows are counted before they are dealt and
written out again afterwards, many of them in blocks, so one key that holds a
third of all rows is spread over tasks (its shard holds them: the law says so).

A null doc_id is a key of its own, as is each text of a doc_id: the id's digits.
A null text counts no bytes: size 8, checksum 0, as the empty text. Empty tables
give empty results; extra columns of the table are ignored by the query and kept
by ``place``, which takes the names of its results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk

SHARDS = 24
RACK_SHARDS, REGION_RACKS = 4, 2
#: Rows of a bucket that are numbered together, the least number of buckets of a shard, and copies of a row written by one task.
BUCKET_ROWS, LEAST_BUCKETS, COPIES = 65_536, 16, 65_536
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
STEP = tk.U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Shard:
    id: int
    weight: float = 1.0
    #: What the shard may grow to; its own weight if not given.
    provision: float | None = None

    @property
    def most(self) -> float:
        return self.weight if self.provision is None else self.provision


@dataclass(frozen=True)
class Node:
    """A rack of shards or a region of racks; ``name`` must stay, as draws are made by it."""

    name: int
    children: tuple[Node | Shard, ...]

    @property
    def most(self) -> float:
        return sum(c.most for c in self.children)


Tree = tuple[Node, ...]


def grown(n: int, rack: int = RACK_SHARDS, region: int = REGION_RACKS) -> Tree:
    """Shards 0 to n - 1 of weight 1 in regions that fill one after the other."""
    width = rack * region
    return tuple(
        Node(r, tuple(Node(k, tuple(Shard(s, float(s < n), 1.0) for s in range(r * width + k * rack, r * width + (k + 1) * rack))) for k in range(region)))
        for r in range(-(-n // width))
    )


def uniform(keys: np.ndarray, *salt: int | np.ndarray) -> np.ndarray:
    """One number over 0 and up to 1 for each key, by hash of the key and the salt."""
    h = keys
    for s in salt:
        h = tk.mix(h + STEP * (np.atleast_1d(np.asarray(s, np.uint64)) + tk.U64(1)))
    return ((h >> tk.U64(11)).astype(np.float64) + 1) * 2.0**-53


def descend(keys: np.ndarray, node: Node, path: tuple[int, ...], draw: np.ndarray) -> np.ndarray:
    """Shard that each key's draw ends at, or -1 where the shard does not accept it."""
    out = np.full(len(keys), -1, np.int64)
    live = [c for c in node.children if c.most > 0]
    if not live or not len(keys):
        return out
    names = [c.id if isinstance(c, Shard) else c.name for c in live]
    clocks = np.stack([-np.log(uniform(keys, *path, n, draw)) / c.most for c, n in zip(live, names, strict=True)])
    chosen = clocks.argmin(axis=0)
    for i, (child, name) in enumerate(zip(live, names, strict=True)):
        at = np.flatnonzero(chosen == i)
        if isinstance(child, Shard):
            taken = child.weight >= child.most
            out[at] = child.id if taken else np.where(uniform(keys[at], *path, name, draw[at], 1) * child.most <= child.weight, child.id, -1)
        else:
            out[at] = descend(keys[at], child, (*path, name), draw[at])
    return out


def choose(keys: np.ndarray, tree: Tree) -> np.ndarray:
    """Shard of each 64-bit key."""
    if not any(s.weight > 0 for region in tree for rack in region.children for s in rack.children):
        raise ValueError("no shard of the tree has a weight")
    best, won = np.full(len(keys), np.inf), np.full(len(keys), -1, np.int64)
    # regions that accept every draw come first: their times cut the others' draws short
    for region in sorted(tree, key=lambda r: any(s.weight < s.most for k in r.children for s in k.children)):
        if region.most <= 0 or not any(s.weight > 0 for k in region.children for s in k.children):
            continue
        at, time, draw = np.arange(len(keys)), np.zeros(len(keys)), 0
        while len(at):
            numbers = np.full(len(at), draw, np.uint64)
            time = time - np.log(uniform(keys[at], region.name, numbers)) / region.most
            early = time < best[at]
            at, time, numbers = at[early], time[early], numbers[early]
            shard = descend(keys[at], region, (region.name,), numbers)
            hit = shard >= 0
            best[at[hit]], won[at[hit]] = time[hit], shard[hit]
            at, time, draw = at[~hit], time[~hit], draw + 1
    return won


def place(docs: DataFrame, tree: Tree, key: str = "doc_id", to: str = "shard") -> DataFrame:
    """The table with the shard of each row's key; no shuffle."""

    @F.pandas_udf("int")
    def shard_of(hashes: pd.Series) -> pd.Series:
        return pd.Series(choose(hashes.to_numpy().view(np.uint64), tree).astype(np.int32))

    return docs.withColumn(to, shard_of(F.xxhash64(F.col(f"`{key}`").cast("string"))))


def slots(rows: DataFrame, n_rows: int, shard: str = "shard", bucket_rows: int = BUCKET_ROWS, copies: int = COPIES) -> DataFrame:
    """``rows`` (a shard and columns that order it) with ``slot``, from 0 in each shard without gaps."""
    names = rows.columns
    order = [c for c in names if c != shard]
    buckets = max(LEAST_BUCKETS, -(-n_rows // bucket_rows))
    counted = rows.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counted = tk.stored(counted, "shard-rows")
    inside = W.partitionBy(shard, "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = counted.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_all"))
    first = totals.select(shard, "_bucket", (F.sum("_all").over(whole) - F.col("_all")).alias("_first"))
    placed = counted.withColumn("_at", F.sum("_n").over(inside) - F.col("_n")).join(first, [shard, "_bucket"])
    placed = placed.select(*names, "_n", (F.col("_at") + F.col("_first")).alias("_from"))
    each = F.explode(F.sequence("_from", F.col("_from") + F.col("_n") - 1)).alias("slot")
    if (counted.agg(F.max("_n")).first()[0] or 0) <= copies:
        return placed.select(*names, each)
    blocks = placed.where(F.col("_n") > copies).withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / copies))))
    left = F.col("_n") - F.col("_block") * copies
    blocks = blocks.repartition("_from", "_block").select(*names, F.least(F.lit(copies).cast("long"), left).alias("_n"), (F.col("_from") + F.col("_block") * copies).alias("_from"))
    return placed.where(F.col("_n") <= copies).select(*names, each).unionByName(blocks.select(*names, each))


def op11_weighted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law ``key``, and where each goes with one shard more."""
    docs = tk.only(tk.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = place(place(rows, grown(SHARDS)), grown(SHARDS + 1), to="grown_shard")
    # grown_shard follows from doc_id as shard does; it is carried along
    out = slots(placed, docs.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
