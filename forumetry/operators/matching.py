"""Two views of one post: matched by the beginnings of their texts and by time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumetry.functions.text import canonical_post_text, let
from forumetry.operators.store import checkpointed

#: Characters of a beginning that must be equal, at most (lengths are bits of a long), and seconds between both views.
BLOCK, SECONDS = 60, 3600
#: Characters of a text that are looked at first, and characters at the end of what they make that the rest of the text might change, at most.
FIRST, EDGE = 400, 20


def beginning(text: Column) -> Column:
    """The first BLOCK characters of the canonical text. They mostly come from the first few of a long text: only what stands at the cut (half a fold
    mark, icon, handle or run of blanks) may read otherwise in the whole. If less than that is sure, the whole text is read."""
    sure = lambda t: (F.char_length(text) <= FIRST) | (F.char_length(t) >= BLOCK + EDGE)
    return let(canonical_post_text(F.left(text, F.lit(FIRST))), lambda t: F.left(F.when(sure(t), t).otherwise(canonical_post_text(text)), F.lit(BLOCK)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (t, left, right, part), each with the lengths of the texts before it in its partition that it begins with, as bits: of left
    texts, of right ones, itself included. What begins a text is on a stack, so only that is kept."""
    stack: list[tuple[str, int, int]] = []
    for batch in batches:
        masks: tuple[list[int], list[int]] = ([], [])
        for t, *sides in zip(*(batch[c].to_pylist() for c in ("t", "left", "right")), strict=True):
            while stack and not t.startswith(stack[-1][0]):
                stack.pop()
            before = stack[-1][1:] if stack else (0, 0)
            own = [mask | (side << (len(t) - 1)) for mask, side in zip(before, sides, strict=True)]
            stack.append((t, *own))
            for made, mask in zip(masks, own, strict=True):
                made.append(mask)
        yield pa.RecordBatch.from_arrays([batch["t"], *(pa.array(m, pa.int64()) for m in masks), batch["part"]], names=["t", "of_left", "of_right", "part"])


def beginnings(texts: DataFrame) -> DataFrame:
    """(t, of_left, of_right) of distinct texts (t, left 0 or 1, right 0 or 1) of BLOCK characters at most: bit k - 1 is set if the first k characters
    of t, or all of it, are a left text, or a right one.

    Texts are sorted over range partitions, where all that begin with a text follow it. What begins a text but lies in an earlier partition also
    begins the first text of its own partition, so only these few are looked up.
    """
    sorted_ = texts.repartitionByRange("t").sortWithinPartitions("t").withColumn("part", F.spark_partition_id())
    found = checkpointed(sorted_.mapInArrow(_scan, "t string, of_left long, of_right long, part int"))
    firsts = found.groupBy("part").agg(F.min("t").alias("t"))
    cut = firsts.select("part", F.explode(F.sequence(F.lit(1), F.char_length("t"))).alias("k"), "t").select("part", F.expr("left(t, k)").alias("t"), "k")
    # at most BLOCK rows a partition
    bit = lambda c: F.bit_or(F.expr(f"shiftleft(CAST({c} AS BIGINT), k - 1)")).alias(c)
    known = texts.join(F.broadcast(cut), "t").groupBy("part", "k").agg(F.first("t").alias("begin"), bit("left"), bit("right"))
    carried = known.groupBy("part").agg(F.collect_list(F.struct("begin", "left", "right")).alias("carried"))
    met = found.join(F.broadcast(carried), "part", "left")

    def with_carried(mask: str, side: str) -> Column:
        own = F.filter(F.coalesce("carried", F.array().cast(carried.schema["carried"].dataType)), lambda z: F.col("t").startswith(z["begin"]))
        return F.aggregate(own, F.col(mask), lambda a, z: a.bitwiseOR(z[side]))

    return met.select("t", with_carried("of_left", "left").alias("of_left"), with_carried("of_right", "right").alias("of_right"))


def match_posts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) from frames (id, text, at): each left post that matches any right one, with the one of least id.

    Texts match if one of them begins with the first 60 characters of the other, or with all of it if it is shorter. (Equal beginnings of 80
    characters are a case of that.) If both have a time, they must be an hour apart at most. Empty texts match nothing.

    A text meets the texts that begin it, which `beginnings` finds: mostly itself alone. Posts are reduced to one row a beginning and second,
    the right ones to their least id, before they meet; both are dealt by beginning and hour, right ones also to the hours beside their own, and
    a window of times finds the least id. No pairs are made: a beginning that a third of all posts share is spread over its hours, and each of
    these has 3 * 3600 right rows at most.
    """
    shaped = lambda df: df.select("id", beginning(F.col("text")).alias("t"), F.unix_timestamp(F.col("at").cast("timestamp")).alias("s")).where("t <> ''")
    a, b = checkpointed(shaped(left)), checkpointed(shaped(right))  # beginnings only: texts are read once
    asked, least = a.select("t", "s").distinct(), checkpointed(b.groupBy("t", "s").agg(F.min("id").alias("id")))
    sides = asked.select("t", F.lit(1).alias("left"), F.lit(0).alias("right")).unionByName(least.select("t", F.lit(0).alias("left"), F.lit(1).alias("right")))
    masks = checkpointed(beginnings(checkpointed(sides.groupBy("t").agg(F.max("left").alias("left"), F.max("right").alias("right")))))

    def begun(df: DataFrame, mask: str, side: int, longest: int) -> DataFrame:
        """A row for each text that begins one of df, up to `longest` characters fewer than it has."""
        lengths = F.filter(F.sequence(F.lit(1), F.char_length("t") - longest), lambda k: F.getbit(F.col(mask), k - 1) == 1)
        some = df.join(masks.select("t", mask).where(f"{mask} <> 0"), "t").where(F.char_length("t") > longest)
        return some.withColumn("k", F.explode(lengths)).select(*df.columns, F.lit(side).alias("side"), F.expr("left(t, k)").alias("key"))

    own = lambda df, side: df.select("*", F.lit(side).alias("side"), F.col("t").alias("key"))
    # side 0: the right text begins the left one, or is equal; side 1: the left text is the shorter one
    lefts = checkpointed(begun(asked, "of_right", 0, 0).unionByName(own(asked, 1)))
    rights = own(least, 0).unionByName(begun(least, "of_left", 1, 1))
    by = ["side", "key"]
    least = checkpointed(rights.groupBy(*by, "s").agg(F.min("id").alias("id")))
    timed, hour = least.where("s IS NOT NULL"), F.floor(F.col("s") / SECONDS)
    near = timed.withColumn("hour", F.explode(F.array(hour - 1, hour, hour + 1)))
    times = lefts.where("s IS NOT NULL").select(*by, "s").distinct().withColumn("hour", hour)
    none = F.lit(None).cast(near.schema["id"].dataType)
    both = near.select(*by, "hour", "s", "id", F.lit(False).alias("asks")).unionByName(times.select(*by, "hour", "s", none.alias("id"), F.lit(True).alias("asks")))
    span = Window.partitionBy(*by, "hour").orderBy("s").rangeBetween(-SECONDS, SECONDS)
    close = both.withColumn("found", F.min("id").over(span)).where("asks AND found IS NOT NULL").select(*by, "s", "found")
    # without a time on one side, only the texts count
    untimed = least.where("s IS NULL").select(*by, F.col("id").alias("untimed"))
    any_ = least.groupBy(*by).agg(F.min("id").alias("any"))
    met = lefts.join(close, [*by, "s"], "left").join(untimed, by, "left").join(any_, by, "left")
    best = F.when(F.col("s").isNull(), F.col("any")).otherwise(F.least("found", "untimed"))
    found = checkpointed(met.groupBy("t", "s").agg(F.min(best).alias("right_id")).where("right_id IS NOT NULL"))
    same = (a["t"] == found["t"]) & a["s"].eqNullSafe(found["s"])
    return a.join(found, same).groupBy(F.col("id").alias("left_id")).agg(F.min("right_id").alias("right_id"))
