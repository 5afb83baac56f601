"""Operator 5, benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions alone.

A text's set is its five-word shingles, or its whole sequence of words if it has fewer; words are runs of letters, marks and digits in lower
case. An item is contained in a document that has at least `share` of the item's set. An item's sketch is the MinHash of its set: the q - r + 1
least hashes, where q is its size and r the least number of shingles that must be shared. A document that contains the item lacks q - r of its
shingles at most, so it has at least one of the sketch: nothing is lost, however long the document. Items are partitioned by size, by powers of
two. A document meets only the partitions whose items may fit into its set, and only those of its hashes count that are no greater than the
greatest sketch hash of these partitions. What meets is verified on the shingles themselves. Sketches and item shingles are broadcast up to
FEW_ROWS rows; beyond that they are joined by shuffles, in which a hash that a third of all documents have is one large partition of the document
side alone. Adaptive execution splits that into many tasks, each of which gets the few item rows of the hash.

Items of fewer than five words are only found as whole documents.

Cases: texts of any length are read whole; null and empty texts have empty sets, which neither contain nor are contained; repeated rows of equal doc_id and text are one document, of
equal item_id and text one item; null ids are ids like others; empty tables give no rows; columns other than ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.llm.common import keyed, of_keys, saved, small, table

#: Words of a shingle, and the share of an item's shingles that a document must have.
WORDS, SHARE = 5, 0.8
#: Rows of sketches or item shingles that are broadcast at most; beyond that they are joined by shuffles.
FEW_ROWS = 1_000_000


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row: bound to a lambda's variable, it isn't copied into each place that reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def hash_set(text: Column) -> Column:
    """Hashes of a text's set."""

    def windows(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))))
        return F.when(F.size(w) >= WORDS, each).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))

    return F.array_distinct(let(F.transform(word_list(text), lambda w: F.xxhash64(w)), windows))


def shingle_set(text: Column) -> Column:
    """A text's set."""

    def windows(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - WORDS + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, WORDS), " "))
        return F.when(F.size(w) >= WORDS, each).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(let(word_list(text), windows))


def sketches(items: DataFrame, share: float) -> DataFrame:
    """(item_id, text_key, size, need, part, hash) of the items' sketches; part p holds sizes from 2 ** p on."""
    sized = saved(items.select("item_id", "text_key", hash_set(F.col("text")).alias("hashes")), "benchmark-hashes").withColumn("size", F.size("hashes")).where("size > 0")
    sized = sized.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("size") * share - 1e-9).cast("int"))).withColumn("part", F.floor(F.log2("size")).cast("int"))
    least = F.slice(F.array_sort("hashes"), F.lit(1), F.col("size") - F.col("need") + 1)
    return sized.select("item_id", "text_key", "size", "need", "part", F.explode(least).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, key, item_id, n_item, n_shared) of every document (doc_id, key, text) and item (item_id, text) that it contains."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")).dropDuplicates(["item_id", "text_key"])
    items = saved(items, "benchmark-items")
    sketch = saved(sketches(items, share), "benchmark-sketches")
    # a row a power of two of item sizes: least size a document needs, greatest hash of a sketch
    parts = sketch.groupBy("part").agg(F.min("need").alias("need"), F.max("hash").alias("most")).collect()
    empty = F.array().cast("array<long>")

    def low(hashes: Column) -> Column:
        limit = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *(F.when(F.size(hashes) >= p.need, F.lit(p.most)) for p in parts))
        return let(limit, lambda most: F.coalesce(F.filter(hashes, lambda h: h <= most), empty))

    met = docs.select("doc_id", "key", F.explode(let(hash_set(F.col("text")), low)).alias("hash"))
    met = met.join(small(sketch.select("item_id", "text_key", "hash"), FEW_ROWS), "hash")
    candidates = saved(met.groupBy("doc_id", "key", "item_id", "text_key").agg(F.count("*").alias("n")).drop("n"), "benchmark-candidates")
    # verified on the shingles themselves, of the documents and items that met
    near = of_keys(docs, saved(candidates.select("doc_id", "key").distinct(), "benchmark-documents"), "left_semi")
    members = F.explode(shingle_set(F.col("text"))).alias("shingle")
    own = saved(items.select("item_id", "text_key", members), "benchmark-shingles")
    needs = sketch.groupBy("item_id", "text_key").agg(F.first("size").alias("n_item"), F.first("need").alias("need"))
    shared = near.dropDuplicates(["doc_id", "key"]).select("doc_id", "key", members).join(small(own, FEW_ROWS), "shingle").groupBy("doc_id", "key", "item_id", "text_key").agg(F.count("*").alias("n_shared"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc_id", "key", "item_id", "text_key")]
    shared = shared.alias("s").join(candidates.alias("c"), same[0] & same[1] & same[2] & same[3], "left_semi")
    found = shared.alias("s").join(small(saved(needs, "benchmark-sizes"), FEW_ROWS).alias("c"), same[2] & same[3]).where("n_shared >= need")
    return found.select("s.doc_id", "s.key", "s.item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(keyed(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that contain no benchmark item, with all their columns. Null and empty texts and null ids stay, repeated rows
    all stay or all go, and without items everything stays."""
    found = contained(keyed(docs), table(spark, sf_dir, "benchmark"))
    return of_keys(docs, saved(found.select("doc_id", "key").distinct(), "contaminated"), "left_anti")


_SETS = r"""
    SELECT DISTINCT {id}, text, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
    FROM (SELECT {id}, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM {table})
"""
ORACLE_SQL = f"""
WITH d AS ({_SETS.format(id="doc_id", table="documents")}),
     b AS ({_SETS.format(id="item_id", table="benchmark")}),
     n AS (SELECT item_id, text, count(*) AS n_item FROM b GROUP BY ALL),
     s AS (SELECT d.doc_id, d.text AS doc, b.item_id, b.text AS item, count(*) AS n_shared FROM d JOIN b USING (shingle) GROUP BY ALL)
SELECT s.doc_id, s.item_id, n.n_item, s.n_shared
FROM s JOIN n ON n.item_id IS NOT DISTINCT FROM s.item_id AND n.text = s.item
WHERE s.n_shared >= greatest(1, ceil(n.n_item * 0.8 - 1e-9))
"""
