"""Passes over one source merged as they come: each micro-batch of snapshots is folded into states that can be merged further.

What merging keeps of a post, comment or medium is a least or greatest struct: the value behind what decides about it (its place, the length of a
text). Such states are merged by minima and maxima, in any order, and folding one twice changes nothing, so a batch that is run again does no
harm. A batch reads and writes the buckets of the posts that it has, not what was merged before. The flat tables are made from the states when they
are asked for, and equal those of all snapshots merged at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

from forumetry.operators import merge, store
from forumetry.operators.normalize import shaped
from forumetry.schemas import KEYS, MANIFEST, TABLES

COUNTS = ("reactions", "shares", "comments_count", "views", "forwards", "reply_count")
FLAGS = ("is_propagation", "has_media")
_POST = MANIFEST["posts"].dataType.elementType
_COMMENT, _MEDIUM = _POST["comments"].dataType.elementType, _POST["media_refs"].dataType.elementType
_PLACE = StructType([StructField("run", StringType()), StructField("p", IntegerType()), StructField("c", IntegerType())])


def _at() -> Column:
    return F.struct(F.col("run_id").alias("run"), F.col("_p").alias("p"), F.col("_c").alias("c"))


@dataclass(frozen=True)
class Rule:
    """How a field is merged: the state of one row, its type, and whether the least or the greatest state counts."""

    state: Callable[[], Column]
    kind: DataType
    greatest: bool = False

    def merged(self, c: str) -> Column:
        return (F.max if self.greatest else F.min)(c).alias(c)


def _by(c: str, kind: DataType, *before: tuple[Callable[[Column], Column], DataType], filled: bool = False, greatest: bool = False) -> Rule:
    """The value of the row for which `before`, then its place, is least or greatest; with `filled` only of rows that have one."""
    fields = [StructField(f"k{n}", t) for n, (_, t) in enumerate(before)] + [StructField("at", _PLACE), StructField("v", kind)]

    def state() -> Column:
        made = F.struct(*(f(F.col(c)).alias(f"k{n}") for n, (f, _) in enumerate(before)), _at().alias("at"), F.col(c).alias("v"))
        return F.when(F.col(c).cast("string") != "", made) if filled else made

    return Rule(state, StructType(fields), greatest)


def _size(c: Column) -> Column:
    return -F.length(F.coalesce(c, F.lit("")))


def _rules(kind: StructType, same: tuple[str, ...], first: tuple[str, ...], counts: tuple[str, ...]) -> dict[str, Rule]:
    """Fields that the first row, the first row with a value, the longest text, the best author or the last collector decides, and the greatest counts."""
    return {
        **{c: _by(c, kind[c].dataType) for c in same},
        **{c: _by(c, kind[c].dataType, filled=True) for c in first},
        "message": _by("message", StringType(), (_size, IntegerType())),
        "author": _by("author", kind["author"].dataType, (lambda a: a.isNull(), BooleanType()), (lambda a: _size(a["name"]), IntegerType())),
        **{c: _by(c, kind[c].dataType, filled=True, greatest=True) for c in merge.LAST},
        **{c: Rule(lambda c=c: F.col(c), LongType(), True) for c in counts},
    }


RULES = {
    "merged_posts": _rules(_POST, ("platform", "source_id"), merge.FIRST, COUNTS)
    | {c: Rule(lambda c=c: F.coalesce(c, F.lit(False)), BooleanType(), True) for c in FLAGS}
    | {"begun": Rule(_at, _PLACE), "ended": Rule(_at, _PLACE, True)},
    "merged_comments": _rules(_COMMENT, ("platform", "parent_post_id"), merge.FIRST_OF_COMMENTS, ("reactions", "depth")),
    "merged_media": {"first": Rule(_at, _PLACE), "m": _by("m", _MEDIUM, greatest=True)},
}
#: Keys of the states: `of_source` says which runs go together.
OWN = {"merged_posts": ["of_source", "post_id"], "merged_comments": ["of_source", "_post", "comment_id"], "merged_media": ["of_source", "post_id", "media_id"]}
HEADS = "merged_runs"
for _name, _own in OWN.items():
    KEYS[_name] = _own
    TABLES[_name] = StructType([*(StructField(k, StringType()) for k in _own), *(StructField(c, r.kind) for c, r in RULES[_name].items())])
KEYS[HEADS] = ["of_source", "of_run"]
TABLES[HEADS] = StructType([StructField("of_source", StringType()), StructField("of_run", StringType()), *(f for f in MANIFEST.fields if f.name not in ("posts", "run_id"))])


def states(manifests: DataFrame) -> dict[str, DataFrame]:
    """States of the posts, comments and media of snapshots, one row a key."""
    of = F.to_json(merge.merge_key(manifests)).alias("of_source")
    posts = manifests.select(of, "run_id", F.posexplode("posts").alias("_p", "post")).select("of_source", "run_id", "_p", F.lit(-1).alias("_c"), "post.*")
    comments = posts.drop("_c").select("of_source", "run_id", "_p", F.col("post_id").alias("_post"), F.posexplode("comments").alias("_c", "c")).select("of_source", "run_id", "_p", "_post", "_c", "c.*")
    media = posts.drop("_c").select("of_source", "run_id", "_p", "post_id", F.posexplode("media_refs").alias("_c", "m")).withColumn("media_id", F.col("m.media_id"))
    rows = {"merged_posts": posts, "merged_comments": comments, "merged_media": media}
    return {name: df.select(*OWN[name], *(r.state().cast(r.kind).alias(c) for c, r in RULES[name].items())).transform(folded, name) for name, df in rows.items()}


def folded(some: DataFrame, name: str) -> DataFrame:
    """States of equal keys as one."""
    return some.groupBy(*OWN[name]).agg(*(r.merged(c) for c, r in RULES[name].items()))


def fold(manifests: DataFrame, root: str) -> None:
    """Folds snapshots into the states below root."""
    kept = store.checkpointed(manifests)
    for name, new in states(kept).items():
        new = store.checkpointed(new)
        old = store.load_beside(new, root, name).join(new.select(*OWN[name]), OWN[name], "left_semi")
        store.upsert(folded(old.unionByName(new), name), root, name)
    # last: a run is only seen when its posts are in
    heads = kept.withColumns({"of_source": F.to_json(merge.merge_key(kept)), "of_run": F.col("run_id")})
    store.upsert(shaped(heads, HEADS), root, HEADS)


def ingest_merged(spark: SparkSession, landing: str, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads manifests below `landing` (a folder a run) as they come and folds them into the states below `root`."""
    stream = spark.readStream.schema(MANIFEST).option("multiLine", True).json(f"{landing.rstrip('/')}/*/manifest.json")
    writer = stream.writeStream.foreachBatch(lambda manifests, epoch: fold(manifests, root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def merged_so_far(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The eight tables of all runs that go together with run_id, merged in the order of their ids, as run_id."""
    heads = store.checkpointed(store.load(spark, root, HEADS))
    of = heads.where(F.col("of_run") == run_id).select("of_source").first()
    if of is None:
        raise ValueError(f"no snapshot of {run_id}")
    own = lambda df: df.where(F.col("of_source") == of.of_source)
    at = own(heads).withColumn("_run", F.col("of_run")).drop("of_source", "of_run")
    runs = sorted(r._run for r in at.select("_run").collect())  # one short row a run
    value = lambda name: [(F.col(c)["v"] if "v" in getattr(r.kind, "names", ()) else F.col(c)).alias(c) for c, r in RULES[name].items()]
    t = {name: own(store.load(spark, root, name)) for name in OWN}
    posts = t["merged_posts"].select("post_id", *value("merged_posts"))
    posts = posts.withColumn("occurrences", F.when(F.col("begun") != F.col("ended"), 2).otherwise(1)).drop("begun", "ended")
    comments = t["merged_comments"].select("_post", "comment_id", *value("merged_comments")).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("reactions", "depth")})
    media = t["merged_media"].select("post_id", "media_id", *value("merged_media"))
    return merge.tables_of_merged(at, posts, comments, media, runs, run_id, MANIFEST)
