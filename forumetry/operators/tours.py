"""Trees of answers in reading order: depth and place of every comment from ids of parents alone.

A thread is walked along its Euler tour, in which a comment is entered, then its answers in their order, then it is left. Each step of the tour
knows the step behind it; jumps along the steps double each round, so a tour of n steps takes log n joins however deep or broad the tree is. What
is summed up to the tour's end gives both: comments entered from here on tell the place, steps down less steps up the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumetry.operators.store import checkpointed


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `at`, which grows in the order of the columns, and `part`, the range partition; at + 1 is next within a partition."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(sorted_.select("*", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")))


def followers(placed: DataFrame, group: list[str]) -> DataFrame:
    """(at, next) of the rows of `numbered` that have a next row in their group. No group is gathered: neighbours meet by their number, and those on
    both sides of a partition's end, one row a partition, by a window of their own."""
    inside = placed.select((F.col("at") - 1).alias("at"), *(F.col(g).alias(f"_{g}") for g in group), F.col("at").alias("next"))
    first = F.min_by(F.struct(*group, "at"), "at").alias("first")
    ends = placed.groupBy("part").agg(first, F.max("at").alias("last"))
    ends = ends.withColumn("behind", F.lead("first").over(Window.orderBy("part"))).where("behind IS NOT NULL")
    across = ends.select(F.col("last").alias("at"), *(F.col(f"behind.{g}").alias(f"_{g}") for g in group), F.col("behind.at").alias("next"))
    met = placed.select("at", *group).join(inside.unionByName(across), "at")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    for s in same:
        met = met.where(s)
    return met.select("at", "next")


def summed_to_end(steps: DataFrame, sums: list[str]) -> DataFrame:
    """steps (step, next, sums...) with each sum taken over the step and all behind it; `next` stays null for steps whose way ends, and isn't for those
    that run into a circle."""
    steps = checkpointed(steps)
    rounds, n = 0, steps.count()
    while (1 << rounds) <= n and not steps.where("next IS NOT NULL").isEmpty():
        far = steps.select(F.col("step").alias("next"), F.col("next").alias("_far"), *(F.col(c).alias(f"_{c}") for c in sums))
        more = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]
        steps = checkpointed(steps.join(far, "next", "left").select("step", F.col("_far").alias("next"), *more))
        rounds += 1
    return steps


def reading_order(edges: DataFrame) -> DataFrame:
    """(thread, comment_id, depth, place) of edges (thread, comment_id, parent_comment_id, ord): each comment before its answers, these in the order of
    ord, then comment_id; place counts from 0 in each thread.

    A comment whose parent isn't in its thread begins a tree at depth 0. Null ords come first. Of rows with equal ids in a thread the one of least
    ord counts; rows without an id are left out. Comments on a circle of parents, or below one, have neither depth nor place.
    """
    known = edges.where("comment_id IS NOT NULL").select(F.coalesce("thread", F.lit("")).alias("thread"), "comment_id", F.col("parent_comment_id").alias("parent"), "ord")
    known = known.groupBy("thread", "comment_id").agg(F.min(F.struct("ord", "parent")).alias("v")).select("thread", "comment_id", "v.parent", "v.ord")
    known = checkpointed(known)
    ids = known.select("thread", F.col("comment_id").alias("parent"), F.lit(True).alias("there"))
    known = known.join(ids, ["thread", "parent"], "left").withColumn("parent", F.when(F.col("there"), F.col("parent")))
    placed = numbered(known.select("thread", "comment_id", "parent", "ord"), ["thread", "parent", "ord", "comment_id"])
    own = placed.select("thread", F.col("comment_id").alias("parent"), F.col("at").alias("up"))
    families = placed.where("parent IS NOT NULL").groupBy("thread", "parent").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    families = checkpointed(families.join(own, ["thread", "parent"]).select("up", "first", "last"))
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    nodes = placed.select("at").join(followers(placed, ["thread", "parent"]), "at", "left")
    nodes = nodes.join(families.select(F.col("up").alias("at"), "first"), "at", "left").join(families.select(F.col("last").alias("at"), "up"), "at", "left")
    down = F.struct(enter("at").alias("step"), F.coalesce(enter("first"), leave("at")).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("levels"))
    up = F.struct(leave("at").alias("step"), F.coalesce(enter("next"), leave("up")).alias("next"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("levels"))
    steps = summed_to_end(nodes.select(F.explode(F.array(down, up)).alias("s")).select("s.*"), ["entered", "levels"])
    ranked = steps.where("next IS NULL AND step % 2 = 0").select((F.col("step") / 2).cast("long").alias("at"), "entered", "levels")
    found = checkpointed(placed.select("thread", "comment_id", "at").join(ranked, "at", "left"))
    totals = found.groupBy("thread").agg(F.max("entered").alias("total"))
    # one row a thread: Spark broadcasts them while they are few, and splits a thread that is too large otherwise
    met = found.join(totals, "thread")
    return met.select("thread", "comment_id", (-F.col("levels")).alias("depth"), (F.col("total") - F.col("entered")).alias("place"))
