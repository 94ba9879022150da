"""Concepts that a model proposes: which are new to a taxonomy, and what the model is shown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import stored
from .library import numbered
from .similarity import improving, similar

#: The least score of a candidate for the judge; characters of a document and of a prompt that are shown, the
#: least score and the number of concepts of its context; the summary of no chunks.
CANDIDATE, SHOWN, CONTEXT, CONTEXT_K, PROMPT = 0.75, 2000, 0.5, 5, 6000
NO_CHUNKS = "Empty cluster with no documents."
#: Proposals that are decided together: so many, and so many for each concept that is there.
BATCH, RATIO = 8192, 16


def proposal_text(label: Column, definition: Column) -> Column:
    """What is embedded of a proposal."""
    return F.when(F.length(definition) > 0, F.concat(label, F.lit(": "), definition)).otherwise(label)


def same_label(proposal: Column, concept: Column) -> Column:
    """A judge that needs no model: the labels agree but for case and outer blanks."""
    return F.lower(F.trim(proposal["label"])) == F.lower(F.trim(concept["label"]))


def accept(proposals: DataFrame, concepts: DataFrame, judge: Callable[[Column, Column], Column] = same_label, threshold: float = CANDIDATE, batch: int = BATCH) -> DataFrame:
    """(place, id, accepted, reason, matched) of each proposal, as if they were decided one after the other.

    ``proposals`` (id, label, definition, v, ord) go by ``ord`` (ties by id, label, definition), ``concepts`` (id, label, definition,
    v) are there. A proposal meets the concept most like it, or the proposal accepted before it, if the score reaches
    ``threshold`` (ties: concepts by id, then proposals by place); ``judge`` (two structs of id, label, definition -> boolean column,
    which may be a pandas UDF) says whether the two are the same. reason: novel, duplicate (``matched`` is the id it met),
    id_taken (its id is that of a concept or of a proposal accepted before), invalid (no id or label: never accepted). A judge
    that gives null finds no duplicate; a null vector meets nothing.

    Only the best that is there is met, so of two proposals only those count as partners whose score exceeds that of the best concept
    there: about n / c of them for each of n proposals among c concepts alike, not a share of n. Proposals go in batches of ``batch``
    and ``RATIO`` more for each that is there, and what a batch accepts is there for the next.
    """
    numbers = numbered(proposals.select("id", "label", "definition", F.col("v").cast("array<double>").alias("v"), "ord"), F.asc("ord"), F.asc("id"), F.asc("label"), F.asc("definition"))
    key = F.sha2(F.to_json(F.struct("id", "label", "definition", "v")), 256)
    rows = stored(numbers.withColumn("key", key), "proposals")
    there = numbered(concepts.select("id", "label", "definition", F.col("v").cast("array<double>").alias("v")), F.asc("id"))
    # before all places, in the order of ids
    there = stored(there.withColumn("since", F.col("place").cast("long") - (1 << 40)).drop("place"), "there")
    n, done, out = rows.agg(F.max("place")).first()[0] or 0, 0, None
    while out is None or done < n:
        upto = min(n, done + batch + RATIO * there.count())
        part = rows.where((F.col("place") > done) & (F.col("place") <= upto))
        decided = stored(_accepted(part, there, judge, threshold), "batch")
        out = decided if out is None else out.unionByName(decided)
        if upto < n:
            more = part.join(decided.where("accepted").select("place"), "place").select("id", "label", "definition", "v", F.col("place").cast("long").alias("since"))
            there = stored(there.unionByName(more), "there")
        done = upto
    return out


def _accepted(rows: DataFrame, there: DataFrame, judge, threshold: float) -> DataFrame:
    """What ``accept`` gives for rows whose places come after all that is ``there``.

    Copies (same id, label, definition, vector) are one class with many places, so they cost no pairs. In each round a class is
    decided at its next place as soon as the best partner that may be there is known to be there or not; after a refusal it moves
    on to the first place that a better partner can have changed. The class of least place can always be decided, so rounds end;
    there are as many as the longest chain of proposals that wait for each other. Each round is written once.
    """
    valid = rows.where("length(id) > 0 and length(label) > 0")
    classes = stored(valid.groupBy("key").agg(F.min("place").cast("long").alias("cls"), F.max("place").cast("long").alias("last"), *[F.first(c).alias(c) for c in ("id", "label", "definition", "v")]), "classes")
    members = stored(valid.select("place", "key").join(classes.select("key", "cls"), "key").select("cls", F.col("place").cast("long").alias("place")), "members")

    # of those that are there from the start only the best can be met
    nearest = similar(classes.select(F.col("cls").alias("id"), "v"), there.select(F.col("since").alias("id"), "v"), threshold, top=1)
    nearest = stored(nearest.toDF("cls", "since", "score"), "nearest")
    old = nearest.join(there.select("since", F.col("id").alias("met")), "since").select("cls", F.lit(None).cast("long").alias("other"), "met", "since", "score")
    # a class can meet only one that has a place before its last
    new = improving(classes.join(nearest, "cls", "left").select(F.col("cls").alias("id"), "v", F.col("score").alias("least"), "last"), threshold)
    # two classes of one id never meet: the id alone decides between them
    names = classes.select("cls", F.col("id").alias("name"))
    new = stored(new.toDF("cls", "other", "score"), "better").join(names.toDF("cls", "a"), "cls").join(names.toDF("other", "met"), "other").where("a <> met")
    edges = stored(old.unionByName(new.select("cls", "other", "met", F.lit(None).cast("long").alias("since"), "score")), "partners")

    taken = classes.join(there.select("id").distinct(), "id", "left_semi").select("cls")
    state = stored(classes.join(taken, "cls", "left_anti").select("cls", "id", F.col("cls").alias("next"), F.lit(None).cast("long").alias("at")), "state")
    log = []
    while not state.where("next is not null").isEmpty():
        state, decided = _round(state, edges, members, classes, there, judge)
        log.append(decided)
    spark = rows.sparkSession
    decided = log[0] if log else spark.createDataFrame([], "cls long, low long, high long, new boolean, matched string")
    for more in log[1:]:
        decided = decided.unionByName(more)
    own = members.join(decided, "cls", "left").where("low is null or place between low and coalesce(high, 9223372036854775807)")
    own = own.select("place", "new", "matched", F.lit(True).alias("seen"))
    first = state.where("at is not null").groupBy("id").agg(F.min("at").alias("at")).unionByName(there.select("id", F.lit(-1).cast("long").alias("at")).distinct())
    first = first.groupBy("id").agg(F.min("at").alias("at"))
    out = rows.select(F.col("place").cast("long").alias("place"), "id", (F.coalesce(F.length("id") > 0, F.lit(False)) & F.coalesce(F.length("label") > 0, F.lit(False))).alias("fine"))
    out = out.join(first, "id", "left").join(own, "place", "left")
    reason = F.when(~F.col("fine"), "invalid").when(F.col("at") < F.col("place"), "id_taken").when(F.col("new"), "novel").otherwise("duplicate")
    out = out.withColumn("reason", reason)
    return out.select("place", "id", (F.col("reason") == "novel").alias("accepted"), "reason", F.when(F.col("reason") == "duplicate", F.col("matched")).alias("matched"))


def _round(state: DataFrame, edges: DataFrame, members: DataFrame, classes: DataFrame, there: DataFrame, judge) -> tuple[DataFrame, DataFrame]:
    """The state after a round, and what it decided: (cls, low, high, new, matched), for places low to high (null: all further ones)."""
    open_ = state.where("next is not null")
    first = open_.groupBy("id").agg(F.min("next").alias("next"))
    ready = open_.join(first, ["id", "next"], "left_semi").select("cls", "id", "next")
    others = state.select(F.col("cls").alias("other"), F.col("next").alias("o_next"), F.col("at").alias("o_at")).where("o_next is not null or o_at is not null")
    met = ready.join(edges, "cls").join(others, "other", "left").where("other is null or o_next is not null or o_at is not null")
    here = F.col("other").isNull() | (F.col("o_at") < F.col("next"))
    place = F.coalesce("o_at", "since")
    best = F.min(F.when(here, F.struct((-F.col("score")).alias("s"), place.alias("p"), "met", "other"))).alias("best")
    unsure = F.min(F.when(F.col("o_next") < F.col("next"), F.struct((-F.col("score")).alias("s"), F.col("o_next").alias("p")))).alias("unsure")
    known = ready.join(met.groupBy("cls").agg(best, unsure), "cls", "left")
    # a partner still open may yet come before the best one that is there
    known = known.where("unsure is null or (best is not null and (unsure.s > best.s or (unsure.s = best.s and unsure.p > best.p)))").select("cls", "id", "next", "best")
    mine = classes.select("cls", "label", "definition")
    facing = known.where("best is not null").join(mine, "cls")
    theirs = there.select(F.lit(None).cast("long").alias("o"), "id", "label", "definition").unionByName(classes.select(F.col("cls").alias("o"), "id", "label", "definition"))
    theirs = theirs.dropDuplicates(["o", "id"]).select("o", F.col("id").alias("o_id"), F.struct("id", "label", "definition").alias("theirs"))
    facing = facing.join(theirs, F.col("best.other").eqNullSafe(F.col("o")) & (F.col("best.met") == F.col("o_id")), "left")
    judged = facing.select("cls", "id", "next", "best", F.coalesce(judge(F.struct("id", "label", "definition"), F.col("theirs")), F.lit(False)).alias("same"))
    judged = stored(judged.unionByName(known.where("best is null").select("cls", "id", "next", "best", F.lit(False).alias("same"))), "judged")

    refused = judged.where("same")
    # the first place at which a better partner may be there
    better = refused.select("cls", "next", "best").join(edges.where("other is not null"), "cls").where(-F.col("score") < F.col("best.s")).join(others, "other")
    change = better.groupBy("cls").agg(F.min(F.coalesce("o_at", "o_next")).alias("high"))
    onward = change.join(members, "cls").where("place > high").groupBy("cls").agg(F.min("place").alias("onward"))
    refused = refused.join(change, "cls", "left").join(onward, "cls", "left")
    done = refused.select("cls", "id", "next", F.when(F.col("onward").isNotNull(), F.col("high")).alias("high"), "onward", F.lit(False).alias("new"), F.col("best.met").alias("matched"))
    fresh = judged.where("not same").select("cls", "id", "next", F.col("next").alias("high"), F.lit(None).cast("long").alias("onward"), F.lit(True).alias("new"), F.lit(None).cast("string").alias("matched"))
    done = stored(done.unionByName(fresh), "decided")
    ids = done.where("new").select("id", F.lit(True).alias("gone"))
    # an accepted class closes its id
    after = state.join(done.select("cls", F.col("next").alias("was"), "onward", "new"), "cls", "left").join(ids, "id", "left")
    following = F.when(F.col("gone"), None).when(F.col("was").isNotNull(), F.col("onward")).otherwise(F.col("next"))
    after = after.select("cls", "id", following.alias("next"), F.when(F.col("new"), F.col("was")).otherwise(F.col("at")).alias("at"))
    return stored(after, "state"), done.select("cls", F.col("next").alias("low"), "high", "new", "matched")


def context(documents: DataFrame, concepts: DataFrame, threshold: float = CONTEXT, k: int = CONTEXT_K) -> DataFrame:
    """(id, rank, concept_id, score): the concepts a document (id, v: the vector of its first ``SHOWN`` characters) is shown with."""
    best = similar(documents, concepts, threshold, top=k)
    rank = F.row_number().over(W.partitionBy("left_id").orderBy(F.desc("score"), "right_id"))
    return best.select(F.col("left_id").alias("id"), rank.alias("rank"), F.col("right_id").alias("concept_id"), "score")


def summary_prompts(clusters: DataFrame, chunks: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """(cluster_id, chunk_count, prompt, summary) of each cluster: its chunks (cluster_id, seq, content) in order, numbered, to ``PROMPT``
    characters. A cluster without chunks has no prompt but its summary.

    A chunk takes 10 characters at least, so no more than ``PROMPT`` / 10 of a cluster are brought together, however many it has."""
    most = min(PROMPT // 10, max_chunks if max_chunks is not None else PROMPT)
    n = F.row_number().over(W.partitionBy("cluster_id").orderBy("seq"))
    shown = chunks.select("cluster_id", "seq", F.substring(F.coalesce("content", F.lit("")), 1, PROMPT).alias("content")).withColumn("n", n).where(F.col("n") <= most)
    part = F.struct("n", F.concat(F.lit("[Chunk "), F.col("n").cast("string"), F.lit("]\n"), F.col("content")).alias("t"))
    text = shown.groupBy("cluster_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n"), 1, PROMPT).alias("prompt"))
    counts = chunks.groupBy("cluster_id").agg(F.count("*").alias("n"))
    out = clusters.select("cluster_id").distinct().join(counts, "cluster_id", "left").join(text, "cluster_id", "left")
    return out.select("cluster_id", F.coalesce("n", F.lit(0).cast("long")).alias("chunk_count"), "prompt", F.when(F.col("n").isNull(), NO_CHUNKS).alias("summary"))
