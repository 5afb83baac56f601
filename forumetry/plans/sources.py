"""Queries of the mappers: payloads and scraped items made of the test tables, against what they say in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumetry.operators import summaries, threads
from forumetry.plans.common import with_
from forumetry.sources import payloads, webitems
from forumetry.sources.adapters import comments, posts, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name, query, sql, *needs, **more):
    QUERIES[name] = query
    ORACLE_SQL[name] = with_(sql, *needs, **more)


_documents = lambda spark, sf: table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
_id = lambda: F.col("doc_id").cast("string")
_every = lambda k, value, other=None: F.when(F.col("doc_id") % k == 0, value).otherwise(F.lit(other))
_json = lambda **c: F.to_json(F.struct(*(v.alias(k) for k, v in c.items()))).alias("payload")
_struct = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))


def _graph(spark, sf):
    count = lambda n: _struct(summary=_struct(total_count=n))
    d = _documents(spark, sf).select(_json(
        id=F.concat(F.lit("1_"), _id()), message=F.col("text"), created_time=F.lit("t"), status_type=_every(3, F.lit("shared_story")), parent_id=_every(7, F.concat(F.lit("9_"), _id())), reactions=count(F.col("doc_id") % 50), comments=count(F.col("doc_id") % 11), shares=_every(2, _struct(count=F.col("doc_id"))),
        attachments=_every(5, _struct(data=F.array(_struct(media_type=F.lit("photo"), target=_struct(id=_id(), url=F.concat(F.lit("https://f/"), _id())))))), **{"from": _every(4, _struct(id=F.col("source"), name=F.lit("N")))},
    ))
    p = payloads.graph_posts(d, "1")
    return p.select("post_id", "message", "reactions", "shares", "comments_count", "is_propagation", "propagation_kind", "origin_post_id", "origin_external_id", "origin_permalink", "has_media", F.col("author.author_id").alias("author_id"), F.size("media_refs").cast("long").alias("n_media"))


_add(
    "map_graph_posts", _graph,
    """SELECT concat('1_', doc_id) AS post_id, coalesce(text, '') AS message, doc_id % 50 AS reactions, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS shares, doc_id % 11 AS comments_count, s AS is_propagation, CASE WHEN s THEN 'share' END AS propagation_kind,
              CASE WHEN doc_id % 7 = 0 THEN concat('9_', doc_id) WHEN s AND doc_id % 5 = 0 THEN concat('facebook:origin:', doc_id) END AS origin_post_id, CASE WHEN doc_id % 7 = 0 THEN concat('9_', doc_id) WHEN s AND doc_id % 5 = 0 THEN CAST(doc_id AS VARCHAR) END AS origin_external_id,
              CASE WHEN s AND doc_id % 5 = 0 THEN concat('https://f/', doc_id) END AS origin_permalink, doc_id % 5 = 0 AS has_media, CASE WHEN doc_id % 4 = 0 THEN source ELSE concat('1_', doc_id) END AS author_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS n_media
       FROM (SELECT *, doc_id % 3 = 0 OR doc_id % 7 = 0 AS s FROM documents)""",
)


def _tweets(spark, sf):
    """Pages of twenty posts with the users and media that they name."""
    d = _documents(spark, sf)
    tweet = F.to_json(_struct(
        id=_id(), text=F.col("text"), created_at=F.lit("t"), author_id=F.col("source"), referenced_tweets=_every(3, F.array(_struct(type=F.lit("replied_to"), id=F.lit("1")), _struct(type=F.when(F.col("doc_id") % 2 == 0, "quoted").otherwise("retweeted"), id=_id()))),
        public_metrics=_struct(like_count=F.col("doc_id") % 9, retweet_count=F.col("doc_id") % 5, reply_count=F.col("doc_id") % 7, quote_count=F.col("doc_id") % 4, impression_count=_every(2, F.col("n_chars"))), attachments=_every(4, _struct(media_keys=F.array(F.concat(F.lit("m"), _id())))),
    ))
    users = F.array_distinct(F.collect_list(_struct(id=F.col("source"), name=F.when(F.length("source") % 2 == 0, F.concat(F.lit("N "), "source")), username=F.lower("source"))))
    media = F.collect_list(_every(4, _struct(media_key=F.concat(F.lit("m"), _id()), type=F.lit("photo"), url=F.concat(F.lit("u/"), _id()))))
    pages = d.groupBy(F.floor(F.col("doc_id") / 20).alias("page")).agg(F.collect_list(tweet).alias("data"), users.alias("users"), media.alias("media"))
    landed = webitems.tweet_pages(pages.select(F.to_json(_struct(data=F.col("data"), includes=_struct(users=F.col("users"), media=F.col("media")))).alias("payload")))
    p = webitems.with_includes(payloads.tweet_posts(landed, "acc"), landed)
    first = F.get("media_refs", F.lit(0))
    return p.select("post_id", "message", "reactions", "shares", "comments_count", "forwards", "views", "propagation_kind", "origin_post_id", F.col("author.name").alias("name"), F.col("author.profile_url").alias("url"), first["media_id"].alias("media_id"), first["url"].alias("media_url"))


_add(
    "map_tweets", _tweets,
    """SELECT concat('x:acc:', doc_id) AS post_id, coalesce(text, '') AS message, doc_id % 9 AS reactions, doc_id % 5 AS shares, doc_id % 7 AS comments_count, doc_id % 4 AS forwards, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS views,
              CASE WHEN doc_id % 6 = 0 THEN 'quote' WHEN doc_id % 3 = 0 THEN 'repost' END AS propagation_kind, CASE WHEN doc_id % 3 = 0 THEN concat('x:origin:', doc_id) END AS origin_post_id, CASE WHEN length(source) % 2 = 0 THEN 'N ' || source ELSE lower(source) END AS name,
              'https://x.com/' || lower(source) AS url, CASE WHEN doc_id % 4 = 0 THEN concat('x:acc:', doc_id, ':media:1') END AS media_id, CASE WHEN doc_id % 4 = 0 THEN 'u/' || doc_id END AS media_url FROM documents""",
)


def _telegram(spark, sf):
    fwd = F.when(F.col("doc_id") % 3 == 0, _struct(peer_id=F.lit("55"), channel_post=F.col("doc_id"), from_name=F.lit(None).cast("string"))).when(F.col("doc_id") % 3 == 1, _struct(peer_id=F.lit(None).cast("string"), channel_post=F.lit(None).cast("long"), from_name=F.col("source")))
    return _documents(spark, sf).select(_json(
        id=F.col("doc_id"), date=F.col("doc_id") + 1_700_000_000, message=F.col("text"), views=F.col("n_chars"), forwards=F.col("doc_id") % 5, action=_every(10, F.lit("pinned")), media=_every(4, F.lit("MessageMediaPhoto")), replies=_every(2, _struct(replies=F.col("doc_id") % 6)),
        reactions=F.create_map(F.lit("a"), F.col("doc_id") % 3, F.lit("b"), F.col("doc_id") % 4), fwd_from=fwd,
    ))


_add(
    "map_telegram_messages", lambda spark, sf: payloads.telegram_messages(_telegram(spark, sf), "c", "n").select("post_id", "created_at", "message", "permalink", "reactions", "comments_count", "views", "forwards", "is_propagation", "origin_post_id", "has_media", "media_type"),
    """SELECT concat('telegram:c:', doc_id) AS post_id, strftime(make_timestamp((doc_id + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS created_at, coalesce(text, '') AS message, concat('https://t.me/n/', doc_id) AS permalink, doc_id % 3 + doc_id % 4 AS reactions,
              CASE WHEN doc_id % 2 = 0 THEN doc_id % 6 ELSE 0 END AS comments_count, n_chars AS views, doc_id % 5 AS forwards, doc_id % 3 < 2 AS is_propagation, CASE doc_id % 3 WHEN 0 THEN concat('telegram:55:', doc_id) WHEN 1 THEN concat('telegram:origin:', source) END AS origin_post_id,
              doc_id % 4 = 0 AS has_media, CASE WHEN doc_id % 4 = 0 THEN 'photo' END AS media_type FROM documents WHERE doc_id % 10 <> 0""",
)
_add("map_service_messages", lambda spark, sf: payloads.service_messages(_telegram(spark, sf)), "SELECT count(*) AS filtered_service_message_count FROM documents WHERE doc_id % 10 = 0")


def _turns(spark, sf):
    """Turns of conversations as items of threads: each answers the turn before it, every fourth one that comes behind it."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("c"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    to = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("s"), (F.col("turn") + 1).cast("string"))).when(F.col("turn") > 0, F.concat(F.lit("s"), (F.col("turn") - 1).cast("string")))
    return c.select(F.concat(F.lit("p:"), "c").alias("post_id"), F.col("turn").alias("pos"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("status_id"), to.alias("reply_to_status_id"), F.lit("t").alias("created_at"), "text", F.lit(None).cast("string").alias("permalink"), F.concat(F.col("turn").cast("string"), F.lit("K")).alias("like_count"), F.col("role").alias("author_username"), F.lit("N").alias("author_name"), F.lit("s1").alias("main_status_id"), F.lit("s2").alias("origin_status_id"))


_SHOWN = ("comment_id", "parent_post_id", "parent_comment_id", "depth", "reactions", "message")


def _replies_sql(who: str, gone: str = "") -> str:
    """A chain that breaks at every fourth turn, which answers nothing that came before, and at items that are none."""
    kept = f"turn NOT IN ({gone})" if gone else "true"
    return f"""SELECT concat('p:', conv_id, ':comment:s', turn) AS comment_id, concat('p:', conv_id) AS parent_post_id, CASE WHEN d > 0 THEN concat('p:', conv_id, ':comment:s', turn - 1) END AS parent_comment_id, CAST(d AS BIGINT) AS depth, turn * 1000 AS reactions, coalesce(text, '') AS message
        FROM (SELECT *, turn - max(CASE WHEN fresh THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM
          (SELECT *, turn % 4 = 3 OR coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -9) <> turn - 1 AS fresh FROM conversations WHERE {kept}))"""


_add("map_x_replies", lambda spark, sf: webitems.web_replies(_turns(spark, sf), "x").select(*_SHOWN), _replies_sql("x", "1, 2"))
_add("map_threads_replies", lambda spark, sf: webitems.web_replies(_turns(spark, sf), "threads").select(*_SHOWN), _replies_sql("threads"))
_add("map_instagram_replies", lambda spark, sf: webitems.instagram_replies(_turns(spark, sf).withColumnsRenamed({"status_id": "comment_id", "reply_to_status_id": "reply_to_comment_id"})).select(*_SHOWN), _replies_sql("instagram"))


def _timeline(spark, sf, platform):
    d = _documents(spark, sf)
    kind = F.when(F.col("doc_id") % 3 == 0, "quote").when(F.col("doc_id") % 3 == 1, "repost").otherwise("")
    items = d.select(_id().alias("status_id"), F.lit("t").alias("created_at"), "text", F.concat(F.lit("l/"), _id()).alias("permalink"), F.concat((F.col("doc_id") % 9).cast("string"), F.lit(".5K")).alias("like_count"), (F.col("doc_id") % 5).cast("string").alias("repost_count"), (F.col("doc_id") % 7).cast("string").alias("reply_count"), F.when(F.col("doc_id") % 2 == 0, "12 views").otherwise("").alias("view_count"), (F.col("doc_id") % 4 == 0).alias("has_media"), F.lit("photo").alias("media_type"), kind.alias("propagation_kind"), F.when(kind != "", _id()).alias("origin_status_id"), _every(2, F.concat(F.lit("https://x.com/some/status/"), _id())).alias("origin_permalink"), F.when(F.col("doc_id") % 6 == 0, "Other").when(F.col("doc_id") % 6 == 1, "@Acc").otherwise("").alias("author_username"), F.lit("").alias("author_name"))
    made = webitems.timeline(items, platform, "acc", "Name")
    return made.select("post_id", "message", "reactions", "shares", "comments_count", "views", "forwards", "is_propagation", "propagation_kind", "origin_post_id", F.col("author.author_id").alias("author_id"), F.col("author.profile_url").alias("url"))


def _timeline_sql(platform: str) -> str:
    flat = platform == "instagram"
    views = {"x": "CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 0 END", "threads": "CASE WHEN doc_id % 2 = 0 THEN 12 END", "instagram": "NULL"}[platform]
    forwards = "CASE WHEN k = 'quote' THEN 1 END" if platform == "threads" else "NULL"
    origin = {"x": "CASE WHEN k IS NOT NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'x:some:' ELSE 'x:origin:' END || doc_id END", "threads": "'threads:origin:' || CASE WHEN k IS NOT NULL THEN doc_id END", "instagram": "CAST(NULL AS VARCHAR)"}[platform]
    before, behind = webitems.PROFILES[platform].split("{}")
    return f"""SELECT concat('{platform}:acc:', doc_id) AS post_id, coalesce(text, '') AS message, doc_id % 9 * 1000 + 500 AS reactions, {"0" if flat else "doc_id % 5"} AS shares, doc_id % 7 AS comments_count, CAST({views} AS BIGINT) AS views, CAST({forwards} AS BIGINT) AS forwards,
               {"false" if flat else "k IS NOT NULL"} AS is_propagation, {"CAST(NULL AS VARCHAR)" if flat else "k"} AS propagation_kind, {origin} AS origin_post_id, a AS author_id, '{before}' || a || '{behind}' AS url
        FROM (SELECT *, ['quote', 'repost', NULL][doc_id % 3 + 1] AS k, CASE doc_id % 6 WHEN 0 THEN 'Other' WHEN 1 THEN '@Acc' ELSE 'acc' END AS a FROM documents) {"WHERE doc_id % 6 <> 0" if platform == "x" else ""}"""


for _platform in ("x", "threads", "instagram"):
    _add(f"map_{_platform}_timeline", lambda spark, sf, p=_platform: _timeline(spark, sf, p), _timeline_sql(_platform))


def _channel(spark, sf):
    d = _documents(spark, sf)
    link = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://t.me/s/chan/"), _id(), F.lit("?q=1")))
    items = d.select(_id().alias("message_id"), F.lit("t").alias("created_at"), "text", F.lit("l").alias("permalink"), F.lit("1.5K").alias("views"), F.concat((F.col("doc_id") % 5).cast("string"), F.lit(" comments")).alias("reply_text"), F.lit(False).alias("has_media"), F.lit(None).cast("string").alias("media_type"), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("a"), F.col("doc_id") % 3)).otherwise(F.create_map().cast("map<string,bigint>")).alias("reactions"), F.lit(None).cast("string").alias("forwarded_from_name"), link.alias("forwarded_permalink"), F.when(F.col("doc_id") % 4 == 1, "77").alias("forwarded_message_id"))
    return webitems.channel_messages(items, "c", "Name").select("post_id", "reactions", "comments_count", "views", "is_propagation", "origin_post_id", "origin_external_id", "origin_permalink", "reaction_breakdown_json")


_add(
    "map_channel_messages", _channel,
    """SELECT concat('telegram:c:', doc_id) AS post_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 ELSE 0 END AS reactions, doc_id % 5 AS comments_count, 1500::BIGINT AS views, doc_id % 4 < 2 AS is_propagation, CASE doc_id % 4 WHEN 0 THEN concat('telegram:chan:', doc_id) WHEN 1 THEN 'telegram:origin:77' END AS origin_post_id,
              CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN '77' END AS origin_external_id, CASE WHEN doc_id % 4 = 0 THEN concat('https://t.me/s/chan/', doc_id) END AS origin_permalink, CASE WHEN doc_id % 2 = 0 THEN concat('{"a":', doc_id % 3, '}') END AS reaction_breakdown_json FROM documents""",
)


def _queue(spark, sf):
    """A bot's queue: a conversation's first turn is a channel post, the others answer each other in its discussion; those of every fifth conversation
    come before their post."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("c"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    number = F.col("c") * 1000 + F.col("turn")
    chat = lambda i, kind: _struct(id=F.lit(i), type=F.lit(kind))
    post = c.where("turn = 0").select(_json(update_id=F.when(F.col("c") % 5 == 0, number + 500).otherwise(number), channel_post=_struct(message_id=F.col("c") * 1000, date=F.lit(1_700_000_000), caption=F.col("text"), chat=chat("ch", "channel"))))
    said = c.where("turn > 0").select(_json(update_id=number, message=_struct(message_id=number, date=number + 1_700_000_000, text=F.col("text"), is_automatic_forward=F.col("turn") % 7 == 6, message_thread_id=F.col("c") * 1000, reply_to_message=_struct(message_id=number - 1), chat=chat("d", "supergroup"), **{"from": _struct(id=F.col("role"), first_name=F.lit("F"))})))
    return post.unionByName(said)


_add(
    "map_bot_comments", lambda spark, sf: webitems.bot_comments(_queue(spark, sf), "ch", "d").select("comment_id", "parent_post_id", "parent_comment_id", "depth", "message", F.col("author.author_id").alias("author_id")),
    """SELECT concat('telegram:ch:', conv_id * 1000, ':comment:', conv_id * 1000 + turn) AS comment_id, concat('telegram:ch:', conv_id * 1000) AS parent_post_id, CASE WHEN d > 0 THEN concat('telegram:ch:', conv_id * 1000, ':comment:', conv_id * 1000 + turn - 1) END AS parent_comment_id,
              CAST(d AS BIGINT) AS depth, coalesce(text, '') AS message, role AS author_id
       FROM (SELECT *, turn - max(CASE WHEN fresh THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM
         (SELECT *, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -9) <> turn - 1 AS fresh FROM conversations WHERE turn > 0 AND turn % 7 <> 6 AND conv_id % 5 <> 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)))""",
)

# Threads
_add(
    "thread_limits", lambda spark, sf: _documents(spark, sf).select("doc_id", threads.scan_limit(F.lit(20), F.col("n_chars")).alias("scan"), threads.article_limit(F.col("doc_id") % 150, F.col("doc_id") % 2 == 0).alias("articles"), threads.retry_needed(F.col("doc_id") % 40, F.col("doc_id") % 6).alias("again")),
    """SELECT doc_id, greatest(60, least(n_chars * 2, 1000), 100) AS scan, CASE WHEN doc_id % 150 >= 80 THEN CASE WHEN doc_id % 2 = 0 THEN 420 ELSE 280 END WHEN doc_id % 150 >= 30 THEN CASE WHEN doc_id % 2 = 0 THEN 320 ELSE 240 END WHEN doc_id % 2 = 0 THEN 320 ELSE 220 END AS articles,
              doc_id % 6 = 0 OR (doc_id % 40 >= 20 AND doc_id % 6 < greatest(3, doc_id % 40 // 6)) AS again FROM documents""",
)


def _attached(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    own = c.where("turn = 0").select(F.concat(F.lit("l/"), "conv_id").alias("permalink"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("m"), "conv_id")).alias("message_id"), F.concat(F.lit("p:"), "conv_id").alias("post_id"))
    names = F.when(F.col("turn") == 1, F.concat(F.lit("l/"), "conv_id")).when(F.col("turn") == 2, F.concat(F.lit("l/"), "conv_id", F.lit("/1")))
    said = c.where("turn > 0").select(F.concat(F.lit("l/"), "conv_id", F.lit("/"), "turn").alias("permalink"), F.when(F.col("turn") == 3, F.concat(F.lit("m"), "conv_id")).alias("message_id"), names.alias("parent_permalink"), F.col("turn").alias("ord"))
    return threads.attached(said, own).select("permalink", "post_id")


_add(
    "thread_attach", _attached,
    """SELECT concat('l/', c.conv_id, '/', c.turn) AS permalink, concat('p:', c.conv_id) AS post_id FROM conversations c JOIN (SELECT conv_id FROM conversations WHERE turn = 0) USING (conv_id)
       WHERE c.turn IN (1, 2) AND (c.turn = 1 OR c.conv_id IN (SELECT conv_id FROM conversations WHERE turn = 1)) OR c.turn = 3 AND c.conv_id % 2 = 0""",
)
_add(
    "thread_scans_united",
    lambda spark, sf: threads.united(table(spark, sf, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.lit("direct").alias("scan")), table(spark, sf, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.lit("broad").alias("scan"))),
    "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'direct' ELSE 'broad' END AS scan FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0",
)
_add(
    "parents_first", lambda spark, sf: threads.parents_first(comments(spark, sf)).select("comment_id", "parent_post_id", "rank"),
    "SELECT comment_id, parent_post_id, CAST(row_number() OVER (PARTITION BY parent_post_id ORDER BY d, created_at, comment_id) AS INT) AS rank FROM comments JOIN (SELECT comment_id, depth AS d FROM comments) USING (comment_id)", "comments",
)

# What each platform's report begins with
_RUN = lambda spark: spark.range(1).select(F.lit(True).alias("discussion_linked"), F.lit(4).cast("long").alias("filtered_service_message_count"))
_REACTIONS = """(SELECT string_agg(concat(reaction, '=', n), ',' ORDER BY n DESC, reaction) FROM (SELECT j.key AS reaction, CAST(sum(coalesce(CAST(j.value AS BIGINT), 0)) AS BIGINT) AS n FROM (SELECT reaction_breakdown_json AS r FROM posts UNION ALL SELECT reaction_breakdown_json FROM comments) x, json_each(CASE WHEN json_valid(x.r) THEN x.r END) j GROUP BY 1)) AS reactions"""
_MORE = {"telegram": "true AS discussion_linked, 4::BIGINT AS filtered_service_message_count,", "instagram": "(SELECT count(*) FROM comments) AS total_comments_extracted, count(*) FILTER (lower(media_type) = 'reel') AS reels_count,", "x": "", "threads": ""}
for _platform, _summed in summaries.SUMMED.items():
    _add(
        f"{_platform}_summary", lambda spark, sf, p=_platform: summaries.platform_summary(p, posts(spark, sf), comments(spark, sf), _RUN(spark)).withColumn("reactions", F.array_join(F.transform("reactions", lambda x: F.concat_ws("=", x["reaction"], x["n"].cast("string"))), ",")),
        f"SELECT {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {name}' for name, c in _summed.items())}, {_MORE[_platform]} {_REACTIONS} FROM posts", "comments",
    )
