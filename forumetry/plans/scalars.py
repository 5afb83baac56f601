"""Queries of the scalar functions, over whole tables, and of sequences of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumetry.functions import text, times, urls
from forumetry.operators import matching, normalize
from forumetry.plans.common import with_
from forumetry.sources.adapters import posts, table
from forumetry.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name, query, sql, *needs, **more):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = with_(sql, *needs, **more)


_documents = lambda spark, sf: table(spark, sf, "documents")
_add("stable_ids", lambda spark, sf: _documents(spark, sf).select("doc_id", text.stable_id(F.col("source"), F.col("doc_id").cast("string"), F.col("lang")).alias("id")), "SELECT doc_id, sha1(concat_ws('::', source, doc_id, lang)) AS id FROM documents")
_add("text_hashes", lambda spark, sf: _documents(spark, sf).select("doc_id", text.text_hash(F.col("text")).alias("h")), "SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents")
_add("excerpts", lambda spark, sf: _documents(spark, sf).select("doc_id", text.excerpt(F.col("text")).alias("short"), text.excerpt(F.col("text"), 280).alias("long")), "SELECT doc_id, left(coalesce(text, ''), 220) AS short, left(coalesce(text, ''), 280) AS long FROM documents")
_add(
    "slugs", lambda spark, sf: _documents(spark, sf).select("doc_id", text.slug(F.col("text")).alias("slug")),
    "SELECT doc_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS s FROM documents)",
)
_add(
    "compact_numbers", lambda spark, sf: _documents(spark, sf).select("doc_id", text.compact_number(F.concat((F.col("doc_id") % 1000).cast("string"), F.lit("."), (F.col("doc_id") % 10).cast("string"), F.element_at(F.array(*map(F.lit, ("K", "m", "B", "", " views"))), (F.col("doc_id") % 5 + 1).cast("int")))).alias("n")),
    "SELECT doc_id, CAST(trunc(CAST(concat(doc_id % 1000, '.', doc_id % 10) AS DOUBLE) * [1e3, 1e6, 1e9, 1, 1][doc_id % 5 + 1]) AS BIGINT) AS n FROM documents",
)
_add(
    "metric_counts", lambda spark, sf: _documents(spark, sf).select("doc_id", text.metric_count(F.concat("doc_id", F.when(F.col("doc_id") % 2 == 0, " more").otherwise(" comments"))).alias("n"), text.comment_counter(F.concat("doc_id", F.when(F.col("doc_id") % 3 == 0, " comments").otherwise(" shares"))).alias("c")),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id * 1000000 ELSE doc_id END AS n, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END AS c FROM documents",
)
#: Links with a port, a blank value, a repeated key, a blank in a value, and keys that don't count.
_LINK = lambda host: F.concat(F.lit(host), "source", F.lit("/posts//?x=1&id=&id="), F.col("doc_id") % 7, F.lit("&fbid=&story_fbid="), "doc_id", F.lit("&comment_id=a%20b&utm=2#top"))
_add(
    "permalink_normalize", lambda spark, sf: _documents(spark, sf).select("doc_id", urls.normal_permalink(_LINK("HTTPS://Example.org:8080/")).alias("of_comment"), urls.normal_permalink(_LINK("http://example.org/"), urls.POST_KEYS).alias("of_post")),
    """SELECT doc_id, concat('https://Example.org:8080/', source, '/posts?story_fbid=', doc_id, '&id=', doc_id % 7, '&comment_id=a+b&fbid=') AS of_comment,
              concat('http://example.org/', source, '/posts?story_fbid=', doc_id, '&id=', doc_id % 7, '&fbid=') AS of_post FROM documents""",
)
_PAGE_PATH = r"regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]+(/[^?#]*)?', 1), '/+$', '')"
_add(
    "url_ids", lambda spark, sf: table(spark, sf, "pages").select("page_id", F.regexp_replace(urls.part(F.col("url"), "PATH"), "/+$", "").alias("path"), urls.path_part(F.col("url"), -1).alias("last"), urls.media_id(F.concat(F.lit("https://example.org/videos/x/"), "page_id")).alias("media")),
    f"SELECT page_id, coalesce({_PAGE_PATH}, '') AS path, nullif(regexp_extract({_PAGE_PATH}, '([^/]+)$', 1), '') AS last, CAST(page_id AS VARCHAR) AS media FROM pages",
)
_add(
    "date_range_filter", lambda spark, sf: table(spark, sf, "events").where(times.in_range(times.iso(F.col("ts").cast("timestamp")), "2024-01-05", "2024-02-10")).groupBy("event_type").agg(F.count("*").alias("n")),
    "SELECT event_type, count(*) AS n FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-02-10 23:59:59' GROUP BY 1",
)
_NOW = "2026-03-24T12:00:00+00:00"
_add(
    "timestamp_parse",
    lambda spark, sf: _documents(spark, sf).select("doc_id", times.iso(times.posted(F.element_at(F.array(F.concat((F.col("doc_id") % 59).cast("string"), F.lit("m")), F.concat((F.col("doc_id") % 23).cast("string"), F.lit(" h")), F.lit("Yesterday at 10:30 AM"), F.concat(F.lit("March "), (F.col("doc_id") % 28 + 1).cast("string")), F.concat((F.col("doc_id") % 28 + 1).cast("string"), F.lit(" березня 2025 р. о 07:05"))), (F.col("doc_id") % 5 + 1).cast("int")), F.lit(_NOW).cast("timestamp"))).alias("at")),
    """SELECT doc_id, strftime(CASE doc_id % 5 WHEN 0 THEN TIMESTAMP '2026-03-24 12:00:00' - to_minutes(CAST(doc_id % 59 AS BIGINT)) WHEN 1 THEN TIMESTAMP '2026-03-24 12:00:00' - to_hours(CAST(doc_id % 23 AS BIGINT)) WHEN 2 THEN TIMESTAMP '2026-03-23 10:30:00'
         WHEN 3 THEN make_timestamp(2026, 3, doc_id % 28 + 1, 0, 0, 0.0) ELSE make_timestamp(2025, 3, doc_id % 28 + 1, 7, 5, 0.0) END, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM documents""",
)
_add("usernames", lambda spark, sf: _documents(spark, sf).select("doc_id", text.username(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("@"), F.upper("source"))).otherwise(F.concat(F.lit("https://x.com/"), F.col("source"), F.lit("/status/1")))).alias("name")), "SELECT doc_id, lower(source) AS name FROM documents")
_add(
    "keyword_tokens", lambda spark, sf: _documents(spark, sf).select("lang", F.explode(text.keyword_tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n")),
    r"""SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_'']+')) AS token FROM documents)
        WHERE length(token) > 2 AND token NOT IN ('the','and','that','with','this','from','для','это','как','что','але','про','если','they','have') GROUP BY ALL""",
)
_add(
    "mobile_groups", lambda spark, sf: normalize.header_groups(table(spark, sf, "events").withColumn("line", F.concat("event_type", (F.col("event_id") % 2).cast("string"))), "user_id", "event_id", "line", F.col("event_type") == "view").select("event_id", "user_id", "group"),
    """SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS "group" FROM (
         SELECT *, lag(line) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT *, concat(event_type, event_id % 2) AS line FROM events)) WHERE before IS DISTINCT FROM line""",
)
#: Left offsets of a page's items: three times the length of each word.
_nested = lambda spark, sf: normalize.nesting(_documents(spark, sf).select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w) * 3).alias("xs")))
# An item's parent is the last one before it of those that lie over 5 further left than the item and than all items between them. So the open
# items are kept as a list, and the fold's list of open items of each position gives depth and parent.
_add(
    "nesting_depth", lambda spark, sf: _nested(spark, sf).select("doc_id", F.array_join("depths", ",").alias("depths"), F.array_join("parents", ",").alias("parents")),
    """SELECT d.doc_id, string_agg(depth, ',' ORDER BY i) AS depths, string_agg(parent, ',' ORDER BY i) AS parents
       FROM documents d JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id WHERE text IS NOT NULL GROUP BY d.doc_id""",
    recursive=True,
    w="SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w) * 3) AS x FROM documents WHERE text IS NOT NULL)",
    n="""SELECT doc_id, i, x, [{'x': x, 'i': i}] AS open, 0 AS depth, -1 AS parent FROM w WHERE i = 1
         UNION ALL SELECT w.doc_id, w.i, w.x, list_append(list_filter(n.open, lambda o: o.x + 5 < w.x), {'x': w.x, 'i': w.i}), len(list_filter(n.open, lambda o: o.x + 5 < w.x)),
                coalesce(list_last(list_filter(n.open, lambda o: o.x + 5 < w.x)).i - 1, -1)
         FROM n JOIN w ON w.doc_id = n.doc_id AND w.i = n.i + 1""",
)


def _fuzzy(spark, sf):
    d = _documents(spark, sf)
    views = F.array(F.concat(F.lit("See more "), F.col("text")), F.left("text", F.lit(40)), F.concat(F.lit("@someone says\n"), F.col("text"), F.lit("… See more")), F.concat("text", F.lit(" and more of it")))
    at = F.timestamp_seconds(F.col("doc_id") * 600)
    seen = d.select(F.col("doc_id").alias("id"), F.get(views, (F.col("doc_id") % 4).cast("int")).alias("text"), F.when(F.col("doc_id") % 9 != 0, at).alias("at"))
    return matching.match_posts(seen, d.select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 7 != 0, at).alias("at")))


_CANONICAL = r"trim(regexp_replace(regexp_replace(replace(lower({0}), 'see more', ''), '(?m)^@\S.*$', '', 'g'), '\s+', ' ', 'g'))"
_add(
    "fuzzy_post_match", _fuzzy,
    """SELECT l.id AS left_id, min(r.id) AS right_id FROM l JOIN r ON l.t <> '' AND r.t <> '' AND coalesce(abs(l.sec - r.sec) <= 3600, true)
         AND (left(l.t, 80) = left(r.t, 80) OR starts_with(l.t, left(r.t, 60)) OR starts_with(r.t, left(l.t, 60))) GROUP BY 1""",
    l=f"""SELECT id, {_CANONICAL.format("text")} AS t, sec FROM (SELECT doc_id AS id, CASE WHEN doc_id % 9 <> 0 THEN doc_id * 600 END AS sec,
         CASE doc_id % 4 WHEN 0 THEN 'See more ' || text WHEN 1 THEN left(text, 40) WHEN 2 THEN '@someone says' || chr(10) || text || '… See more' ELSE text || ' and more of it' END AS text FROM documents)""",
    r=f"SELECT doc_id AS id, {_CANONICAL.format('text')} AS t, CASE WHEN doc_id % 7 <> 0 THEN doc_id * 600 END AS sec FROM documents",
)
_add(
    "safe_ints", lambda spark, sf: _documents(spark, sf).select("doc_id", text.safe_int(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "x").otherwise(" "))).alias("n")),
    "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS n FROM documents",
)
_add(
    "event_windows", lambda spark, sf: ingest.event_counts(table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")).select(times.iso(F.col("start")).alias("start"), "event_type", "n", "total"),
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
)
