"""Operator 6, chat formatting: reply trees as conversations.

`paths` enumerates root-to-leaf paths of reply trees by iterative self-joins: jumps to ancestors are joined with themselves, twice as far each
round, and every leaf then collects its ancestors by joining them from the farthest jumps to the nearest, so depth d takes log d rounds. The
branches of each tree are ranked by score; with `best`, texts are only gathered for the chosen ones. `formatted` writes each chosen path as one
conversation with its loss mask, and `parsed` reads turns and masked text back from that alone.

The template marks a turn as START role MIDDLE text END. Inside roles and texts the escape mark and the first characters of every control
string are replaced by the escape mark and a letter, so no control string of this or of another common template survives in a text, and the
replacement can be undone.

Cases: a null text or role is empty; a null score ranks last; equal scores rank by the path's node ids; a node whose parent does not exist is a
root; nodes without an id are left out; nodes with equal id in one tree keep the least (text, role); cycles have no root and so no path; trees
without rows give no conversation; long texts and long conversations are written whole, by joining their turns once; other columns are not read.
The conversations of the query are chains, each of one branch, so there ranking has nothing to choose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumetry.llm.common import saved, table

#: Fixed values of the template. A control string of a common template begins with < or [.
START, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
LEARNED = "assistant"


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, path array<struct<node, role, text, score>>) of every leaf of nodes (tree, node, parent, role, text, score); with `best`, of
    the leaves of that many best branches of each tree."""
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")).alias("key")  # null trees are equal here
    known = nodes.where("node IS NOT NULL").select(
        key, "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score")
    )
    known = known.groupBy("key", "node").agg(F.min(F.struct("text", "role", "parent", "score", "tree")).alias("v"))
    known = saved(known.select("key", "node", "v.tree", "v.parent", "v.role", "v.text", "v.score"), "reply-nodes")
    ids = known.select("key", F.col("node").alias("parent"))
    up = known.where("parent IS NOT NULL").select("key", "node", "parent").join(ids, ["key", "parent"], "left_semi")
    up = saved(up.select("key", "node", F.col("parent").alias("up")), "reply-parents")
    leaves = known.select("key", "node").join(up.select("key", F.col("up").alias("node")), ["key", "node"], "left_anti")
    largest = known.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    # jumps[k]: from a node to its ancestor 2 ** k steps up, by joining the jumps before with themselves
    jumps = []
    while 1 << len(jumps) < largest and not up.isEmpty():
        jumps.append(up)
        far = up.select("key", F.col("node").alias("up"), F.col("up").alias("far"))
        up = saved(up.join(far, ["key", "up"]).select("key", "node", F.col("far").alias("up")), "reply-jumps")
    # what can go up further than its tree is large hangs from a cycle
    steps = leaves.join(up, ["key", "node"], "left_anti").select("key", F.col("node").alias("leaf"), "node", F.lit(0).alias("above"))
    for k in reversed(range(len(jumps))):
        steps = saved(steps, "reply-steps")
        further = steps.join(jumps[k], ["key", "node"]).select("key", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        steps = steps.unionByName(further)
    if best is not None:
        steps = saved(steps, "reply-steps")
        of_leaf = _gathered(steps, known.select("key", "node", "score"), F.struct("node", "score"))
        chosen = ranked(of_leaf, "key").where(F.col("branch") <= best).select("key", "leaf")
        steps = steps.join(saved(chosen, "chosen-leaves"), ["key", "leaf"], "left_semi")
    found = _gathered(steps, known, F.struct("node", "role", "text", "score"))
    return saved(found.select("tree", "leaf", "path") if "tree" in found.columns else found, "reply-paths")


def _gathered(steps: DataFrame, known: DataFrame, turn: Column) -> DataFrame:
    """The turns of every leaf's path, from the root on."""
    item = F.struct((-F.col("above")).alias("at"), turn.alias("turn"))
    tree = [F.first("tree").alias("tree")] if "tree" in known.columns else []
    found = steps.join(known, ["key", "node"]).groupBy("key", "leaf").agg(*tree, F.array_sort(F.collect_list(item)).alias("path"))
    return found.withColumn("path", F.col("path.turn"))


def ranked(found: DataFrame, tree: str = "tree") -> DataFrame:
    """found with `score`, the mean of a path's scores, and `branch`, its rank within the tree from 1: best mean first, then by node ids."""
    scores = F.filter(F.col("path.score"), lambda x: x.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
    order = Window.partitionBy(tree).orderBy(F.col("score").desc_nulls_last(), F.col("path.node"))
    return found.withColumn("score", mean).withColumn("branch", F.row_number().over(order))


#: Turns whose sizes are added up at once: an array that a fold appends to is copied at each step.
FOLD = 128


def before(sizes: Column) -> Column:
    """The sum of all sizes before each one."""
    none = F.array().cast("array<bigint>")

    def step(state: Column, size: Column) -> Column:
        return F.struct((state["at"] + size).alias("at"), F.concat(state["sums"], F.array(state["at"])).alias("sums"))

    def piece(state: Column, k: Column) -> Column:
        done = F.aggregate(F.slice(sizes, k * FOLD + 1, F.lit(FOLD)), F.struct(state["at"].alias("at"), none.alias("sums")), step)
        return F.struct(done["at"].alias("at"), F.concat(state["sums"], F.array(done["sums"])).alias("sums"))

    pieces = F.sequence(F.lit(0), F.floor(F.greatest(F.size(sizes) - 1, F.lit(0)) / FOLD).cast("int"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("sums"))
    return F.aggregate(pieces, start, piece, lambda state: F.flatten(state["sums"]))


def formatted(chosen: DataFrame) -> DataFrame:
    """chosen with `formatted` and `loss`, the mask: array<struct<start, length>> of code points, start counted from 0."""
    turns = F.transform("path", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text")))
    head = F.col("_head")
    made = chosen.withColumn("_turns", turns)
    made = made.withColumn("_head", F.transform("_turns", lambda x: (F.char_length(x["role"]) + len(START + MIDDLE)).cast("bigint")))
    made = made.withColumn("_size", F.transform("_turns", lambda x: F.char_length(x["text"]).cast("bigint")))
    made = made.withColumn("_at", before(F.zip_with(head, "_size", lambda a, b: a + b + len(END))))
    spans = F.transform("_turns", lambda x, k: F.struct((F.get("_at", k) + F.get(head, k)).alias("start"), F.get("_size", k).alias("length"), x["role"].alias("role")))
    spans = F.transform(F.filter(spans, lambda x: x["role"] == LEARNED), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    written = F.array_join(F.transform("_turns", lambda x: F.concat(F.lit(START), x["role"], F.lit(MIDDLE), x["text"], F.lit(END))), "")
    return made.withColumns({"formatted": written, "loss": spans}).drop("_turns", "_head", "_size", "_at")


def parsed(written: DataFrame) -> DataFrame:
    """written with `turns`, array<struct<role, text>>, and `learned`, array<string>, both read from `formatted` and `loss` alone."""
    pieces = F.filter(F.split("formatted", F.lit("\\Q" + END + "\\E"), -1), lambda x: x.startswith(START))
    middle = F.lit(MIDDLE)
    turns = F.transform(pieces, lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(START) + 1)), MIDDLE, 1)).alias("role"), unescape(F.substr(x, F.locate(MIDDLE, x) + F.char_length(middle))).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return written.withColumns({"turns": turns, "learned": learned})


def turn_nodes(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each turn replies to the turn before it. Rows with equal (conv_id, turn) follow each other."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    written = saved(formatted(paths(turn_nodes(rows), best=1)).select(F.col("tree").alias("conv_id"), "formatted", "loss"), "conversations")
    read = parsed(written)
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"),
        digest(learned).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = rf"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM r),
     e AS (SELECT *, length(regexp_replace(role, '[\\<\[]', '..', 'g')) + length(regexp_replace(text, '[\\<\[]', '..', 'g')) + {len(START + MIDDLE + END)} AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = '{LEARNED}'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
