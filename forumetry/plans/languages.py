"""Queries over languages: profiles learnt from the posts of known language, and every post's language by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.operators import languages, summaries
from forumetry.plans.common import items_of_documents, with_
from forumetry.sources.adapters import table


def _profiles(spark: SparkSession, sf_dir: str) -> languages.Profiles:
    return languages.learn(table(spark, sf_dir, "documents").select("text", F.col("lang").alias("language")))


def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gram, language, weight) of all profiles."""
    learnt = _profiles(spark, sf_dir)
    pairs = F.posexplode("weights").alias("place", "weight")
    names = F.array(*map(F.lit, learnt.languages)) if learnt.languages else F.array().cast("array<string>")
    return learnt.table.select("gram", pairs).select("gram", F.get(names, "place").alias("language"), "weight")


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.detect(items_of_documents(spark, sf_dir), _profiles(spark, sf_dir))


def language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.language_mix(language_detect(spark, sf_dir))


_STEPS = {
    "words": r"""
        SELECT lang, word, count(*) AS n
        FROM (SELECT lang, unnest(regexp_extract_all(lower(message), '[\p{L}\p{M}'']{1,32}')) AS word FROM posts WHERE lang IS NOT NULL)
        GROUP BY ALL""",
    "grams": """
        SELECT lang, gram, sum(n)::BIGINT AS n
        FROM (SELECT lang, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS gram FROM words)
        GROUP BY ALL""",
    "totals": "SELECT lang, sum(n)::BIGINT AS total FROM grams GROUP BY lang",
    "chosen": """
        SELECT DISTINCT gram
        FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM grams)
        WHERE place <= 1000""",
    "profiles": """
        SELECT c.gram, t.lang AS language,
               round(1000 * ln((coalesce(g.n, 0) + 0.5) / (t.total + 0.5 * (SELECT count(*) FROM chosen))))::BIGINT AS weight
        FROM chosen c CROSS JOIN totals t LEFT JOIN grams g ON g.gram = c.gram AND g.lang = t.lang""",
    "item_grams": r"""
        SELECT item_type, item_id, gram, count(*) AS n
        FROM (SELECT item_type, item_id, unnest(list_transform(range(1, length(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS gram
              FROM (SELECT item_type, item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}'']{1,32}')) AS word FROM post_items))
        GROUP BY ALL""",
    "totals_of_items": """
        SELECT item_type, item_id, sum(n) AS n, coalesce(sum(n) FILTER (gram IN (SELECT gram FROM chosen)), 0) AS known
        FROM item_grams GROUP BY ALL""",
    "item_scores": """
        SELECT item_type, item_id, language, sum(n * weight)::BIGINT AS score FROM item_grams JOIN profiles USING (gram) GROUP BY ALL""",
    "best": """
        SELECT item_type, item_id, arg_min(language, (-score, language)) AS language, max(score) AS top FROM item_scores GROUP BY ALL""",
    "shares": """
        SELECT item_type, item_id, any_value(b.language) AS language, round(1 / sum(exp((score - top) / 1000)), 4) AS confidence
        FROM item_scores JOIN best b USING (item_type, item_id) GROUP BY ALL""",
    "rules": """
        SELECT item_type, item_id,
               CASE WHEN trim(text) = '' THEN 'unknown|0.0|empty'
                    WHEN regexp_matches(lower(text), '[іїєґ]') THEN 'uk|0.72|heuristic-script'
                    WHEN regexp_matches(lower(text), '[ыэёъ]') THEN 'ru|0.72|heuristic-script'
                    WHEN regexp_matches(lower(text), '[а-я]') THEN 'ru|0.58|heuristic-cyrillic'
                    WHEN list_has_any(regexp_extract_all(lower(text), '[a-zA-Z'']+'), ['the', 'and', 'with', 'that', 'this', 'from', 'will'])
                        THEN 'en|0.6|heuristic-lexicon'
                    WHEN regexp_matches(lower(text), '[a-z]') THEN 'en|0.45|heuristic-latin'
                    ELSE 'unknown|0.2|heuristic-fallback' END AS rule
        FROM post_items""",
    "detected": """
        SELECT item_type, item_id,
               CASE WHEN known > 0 AND known >= 0.5 * n THEN s.language ELSE split_part(rule, '|', 1) END AS language,
               CASE WHEN known > 0 AND known >= 0.5 * n THEN confidence ELSE split_part(rule, '|', 2)::DOUBLE END AS confidence,
               CASE WHEN known > 0 AND known >= 0.5 * n THEN 'profile' ELSE split_part(rule, '|', 3) END AS method
        FROM rules LEFT JOIN totals_of_items USING (item_type, item_id) LEFT JOIN shares s USING (item_type, item_id)""",
}

QUERIES = {"language_profiles": language_profiles, "language_detect": language_detect, "language_mix": language_mix}
ORACLE_SQL = {
    "language_profiles": with_("SELECT * FROM profiles", "post_items", **_STEPS),
    "language_detect": with_("SELECT * FROM detected", "post_items", **_STEPS),
    "language_mix": with_("SELECT item_type, language, count(*) AS n FROM detected GROUP BY ALL", "post_items", **_STEPS),
}
