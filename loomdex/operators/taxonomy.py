"""A concept graph as edge tables: neighbours, closures, trees, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.session import stored
from .library import numbered


def broader(edges: DataFrame, concept: str) -> DataFrame:
    return edges.where(F.col("concept_id") == concept).select(F.col("broader_id").alias("id")).distinct()


def narrower(edges: DataFrame, concept: str) -> DataFrame:
    return edges.where(F.col("broader_id") == concept).select(F.col("concept_id").alias("id")).distinct()


def symmetric(relations: DataFrame) -> DataFrame:
    """Each relation both ways, once."""
    back = relations.select(F.col("related_id").alias("concept_id"), F.col("concept_id").alias("related_id"), "relation_type")
    return relations.select("concept_id", "related_id", "relation_type").unionByName(back).distinct()


def related(relations: DataFrame, concept: str) -> DataFrame:
    return symmetric(relations).where(F.col("concept_id") == concept).select(F.col("related_id").alias("id")).distinct()


def closure(edges: DataFrame, start: DataFrame, up: bool = True, checkpoint=None) -> DataFrame:
    """(start, id, depth): all concepts reached from each start concept, and the fewest steps to them.

    Paths are doubled: a round joins pairs that one round found nearest with all pairs known, so a chain of n steps takes
    log2(n) rounds, each written once. Cycles end, as no pair gets nearer, and a start on a cycle reaches itself.
    ``checkpoint`` (DataFrame -> DataFrame) cuts the lineage of a round; the default writes to the shared folder.
    """
    a, b = ("concept_id", "broader_id") if up else ("broader_id", "concept_id")
    cut = checkpoint or (lambda df: stored(df, "closure"))
    pairs = cut(edges.select(F.col(a).alias("start"), F.col(b).alias("id")).where("start is not null and id is not null").distinct().withColumn("depth", F.lit(1)))
    known, reach = _pairs(pairs), 1
    while known[0]:
        # the longest paths known go on; shorter ones did when they were the longest
        onward = pairs.select(F.col("start").alias("id"), F.col("id").alias("further"), F.col("depth").alias("more"))
        longer = pairs.where(F.col("depth") == reach).join(onward, "id").select("start", F.col("further").alias("id"), (F.col("depth") + F.col("more")).alias("depth"))
        pairs = cut(pairs.unionByName(longer).groupBy("start", "id").agg(F.min("depth").alias("depth")))
        found = _pairs(pairs)
        if found == known:
            break
        known, reach = found, 2 * reach
    return pairs.join(start.select(F.col("id").alias("start")).distinct(), "start", "left_semi").select("start", "id", "depth")


def _pairs(pairs: DataFrame) -> tuple[int, int]:
    n, steps = pairs.agg(F.count("*"), F.sum("depth")).first()
    return n, steps or 0


def tree_paths(edges: DataFrame, concepts: DataFrame, separator: str = " > ", checkpoint=None) -> DataFrame:
    """(id, path, depth) of every concept under every chain of parents from a root, however deep; a concept of two parents comes
    twice. A chain has no concept twice, so cycles end; concepts that no root leads to have no path.

    Chains are doubled like pairs in ``closure``: those of the longest length known go on with all known."""
    cut = checkpoint or (lambda df: stored(df, "tree"))
    child = edges.select(F.col("concept_id").alias("child"), F.col("broader_id").alias("parent")).where("child is not null and parent is not null").distinct()
    ids = concepts.select("id").union(child.select("child")).union(child.select("parent")).distinct()
    roots = ids.join(child, ids.id == child.child, "left_anti").select("id")
    chains = cut(child.where("child <> parent").select(F.col("parent").alias("top"), F.col("child").alias("id"), F.array("child").alias("trail")))
    reach, longest = 1, not chains.isEmpty()
    while longest:
        onward = chains.select(F.col("top").alias("id"), F.col("id").alias("further"), F.col("trail").alias("more"))
        longer = chains.where(F.size("trail") == reach).join(onward, "id").where(~F.arrays_overlap(F.concat(F.array("top"), "trail"), "more"))
        longer = cut(longer.select("top", F.col("further").alias("id"), F.concat("trail", "more").alias("trail")))
        chains, reach = chains.unionByName(longer), 2 * reach
        longest = not longer.where(F.size("trail") == reach).isEmpty()
    whole = roots.select("id", F.array("id").alias("trail")).unionByName(chains.join(roots.select(F.col("id").alias("top")), "top").select("id", F.concat(F.array("top"), "trail").alias("trail")))
    return whole.select("id", F.array_join("trail", separator).alias("path"), F.size("trail").alias("depth"))


def by_label(concepts: DataFrame) -> DataFrame:
    """Concepts in order of their label's code points, with their ``place``."""
    return numbered(concepts, F.asc("pref_label"), F.asc("id"))


def search_text(concepts: DataFrame, query: str) -> DataFrame:
    """Concepts whose label, other label or definition holds the query, whatever the case."""
    q = query.lower()
    return concepts.where(F.contains(F.lower("pref_label"), F.lit(q)) | F.exists("alt_labels", lambda x: F.contains(F.lower(x), F.lit(q))) | F.contains(F.lower(F.coalesce("definition", F.lit(""))), F.lit(q)))


def search_vector(concepts: DataFrame, query, threshold: float = 0.85, k: int = 5, compat: bool = True) -> DataFrame:
    """Nearest concepts (id, v): the best 2 k, of which those that reach the threshold stay; cut to k unless ``compat``."""
    best = concepts.withColumn("score", F.round(V.score_of_distance(V.cosine_distance(F.col("v"), V.literal(query))), 6)).orderBy(F.desc("score"), "id").limit(2 * k).where(F.col("score") >= threshold)
    return best if compat else best.orderBy(F.desc("score"), "id").limit(k)


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and the rows of ``new`` whose key it does not have; of several with one key, one."""
    return table.unionByName(new.dropDuplicates(keys).join(table, keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of its keys."""
    return table.join(new, keys, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone, keys, "left_anti").select(*table.columns)


def update_concept(concepts: DataFrame, concept: str, **fields) -> DataFrame:
    """Sets the given fields of one concept; None leaves a field as it is."""
    allowed = {"pref_label", "alt_labels", "definition"}
    if unknown := set(fields) - allowed:
        raise ValueError(f"not a field of a concept: {', '.join(sorted(unknown))}")
    here = F.col("id") == concept
    put = {k: F.when(here, F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).otherwise(F.col(k)) for k, v in fields.items() if v is not None}
    return concepts.withColumns(put) if put else concepts


def load_taxonomy(spark, path: str) -> dict[str, DataFrame]:
    """Tables concepts, concept_hierarchy and concept_relations of a taxonomy JSON file."""
    shape = "concepts array<struct<id: string, prefLabel: string, altLabels: array<string>, definition: string>>, hierarchy array<struct<conceptId: string, broaderId: string>>, relations array<struct<conceptId: string, relatedId: string, relationType: string>>"
    doc = spark.read.schema(shape).json(path, multiLine=True)
    c = doc.select(F.explode("concepts").alias("c")).select("c.id", F.col("c.prefLabel").alias("pref_label"), F.coalesce("c.altLabels", F.array().cast("array<string>")).alias("alt_labels"), "c.definition")
    h = doc.select(F.explode("hierarchy").alias("h")).select(F.col("h.conceptId").alias("concept_id"), F.col("h.broaderId").alias("broader_id"))
    r = doc.select(F.explode_outer("relations").alias("r")).where("r is not null").select(F.col("r.conceptId").alias("concept_id"), F.col("r.relatedId").alias("related_id"), F.coalesce("r.relationType", F.lit("related")).alias("relation_type"))
    return {"concepts": c.dropDuplicates(["id"]), "concept_hierarchy": h.distinct(), "concept_relations": symmetric(r)}
