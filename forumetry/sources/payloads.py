"""Payloads of the platforms as posts and comments of the snapshot schema: one projection a platform over landed JSON.

Payloads are landed as JSON text by whatever collects them; `payload` is that text. All functions give (post columns of the snapshot schema)
or (comment columns), so their results can be united by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumetry.functions import times, urls
from forumetry.functions.text import or_empty, username
from forumetry.operators.normalize import or_null
from forumetry.schemas import MANIFEST

POST = MANIFEST["posts"].dataType.elementType
COMMENT = POST["comments"].dataType.elementType


def _rows(df: DataFrame, kind, **columns: Column) -> DataFrame:
    zero = {"reactions", "shares", "comments_count", "depth"} & set(kind.names)
    flags = {"is_propagation", "has_media"} & set(kind.names)
    value = lambda f: columns.get(f.name, F.lit(None)).cast(f.dataType)
    return df.select(*((F.coalesce(value(f), F.lit(0)) if f.name in zero else F.coalesce(value(f), F.lit(False)) if f.name in flags else value(f)).alias(f.name) for f in kind.fields))


def _author(author_id: Column, name: Column | None = None, url: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(author_id.cast("string").alias("author_id"), (none if name is None else name).alias("name"), (none if url is None else url).alias("profile_url"))


def _parsed(raw: DataFrame, ddl: str) -> DataFrame:
    return raw.withColumn("j", F.from_json("payload", ddl)).select("*", "j.*")


def _sum_of(breakdown: Column) -> Column:
    return F.aggregate(F.map_values(breakdown), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


_SUMMARY = "STRUCT<summary: STRUCT<total_count: BIGINT>>"
_GRAPH = f"""id STRING, message STRING, created_time STRING, permalink_url STRING, status_type STRING, parent_id STRING, shares STRUCT<count: BIGINT>, reactions {_SUMMARY}, comments {_SUMMARY},
    `from` STRUCT<id: STRING, name: STRING, link: STRING>, attachments STRUCT<data: ARRAY<STRUCT<media_type: STRING, title: STRING, url: STRING, target: STRUCT<id: STRING, url: STRING>>>>"""


def graph_posts(raw: DataFrame, source_id: str) -> DataFrame:
    """Posts of the page API. A post is a re-share if its status says so or it has a parent; an origin id with an underscore is native."""
    p = _parsed(raw, _GRAPH)
    parent, first = or_null("parent_id"), F.try_element_at("attachments.data", F.lit(1))
    shared = F.lower(or_empty(F.col("status_type"))).contains("shared") | parent.isNotNull()
    origin = F.coalesce(parent, or_null(first["target"]["id"]))
    native = F.when(origin.contains("_"), origin).when(origin.isNotNull(), F.concat(F.lit("facebook:origin:"), origin))
    media = F.transform(F.coalesce("attachments.data", F.array().cast("array<struct<media_type:string,title:string,url:string,target:struct<id:string,url:string>>>")), lambda x, i: F.struct(F.concat("id", F.lit(":media:"), i).alias("media_id"), F.col("id").alias("owner_post_id"), x["media_type"].alias("media_type"), x["title"].alias("title"), x["url"].alias("url"), F.lit(None).cast("string").alias("preview_url")))
    return _rows(
        p, POST, post_id=F.col("id"), platform=F.lit("facebook"), source_id=F.lit(source_id), created_at=F.col("created_time"), message=F.col("message"), permalink=F.col("permalink_url"),
        reactions=F.col("reactions.summary.total_count"), shares=F.col("shares.count"), comments_count=F.col("comments.summary.total_count"), is_propagation=shared, propagation_kind=F.when(shared, "share"),
        origin_post_id=F.when(shared, native), origin_external_id=F.when(shared, origin), origin_permalink=F.when(shared, first["target"]["url"]), has_media=F.size(media) > 0, media_type=first["media_type"], media_refs=media,
        source_collector=F.lit("meta_api"), author=_author(F.coalesce("from.id", "id"), F.col("from.name"), F.col("from.link")),
    )


def graph_comments(raw: DataFrame) -> DataFrame:
    """Comments of the page API, whose pages were landed with their post and parent. Their depth is that of their page."""
    c = _parsed(raw, "id STRING, message STRING, created_time STRING, permalink_url STRING, like_count BIGINT, `from` STRUCT<id: STRING, name: STRING>")
    return _rows(c, COMMENT, comment_id=F.col("id"), platform=F.lit("facebook"), parent_post_id=F.col("post_id"), parent_comment_id=F.col("parent_id"), depth=F.col("page_depth"), created_at=F.col("created_time"), message=F.col("message"), permalink=F.col("permalink_url"), reactions=F.col("like_count"), source_collector=F.lit("meta_api"), author=_author(F.col("from.id"), F.col("from.name")))


def graph_comment_trees(raw: DataFrame) -> DataFrame:
    """Comments of the page API with `place`, from landed comments (payload, post_id, parent_id, ord): what a reader who follows each comment's answers
    before the next comment would get. Depths follow from the parents' ids; ord is a comment's place among its parent's answers."""
    from forumetry.operators.tours import reading_order

    own = raw.select(F.col("post_id").alias("thread"), F.get_json_object("payload", "$.id").alias("comment_id"), F.col("parent_id").alias("parent_comment_id"), "ord")
    placed = reading_order(own).select(F.col("thread").alias("parent_post_id"), "comment_id", F.col("depth").alias("_depth"), "place")
    comments = graph_comments(raw.withColumn("page_depth", F.lit(0)))
    met = comments.join(placed, ["parent_post_id", "comment_id"]).withColumn("depth", F.col("_depth"))
    return met.select(*comments.columns, "place")


_TWEET = """id STRING, text STRING, created_at STRING, author_id STRING, conversation_id STRING, referenced_tweets ARRAY<STRUCT<type: STRING, id: STRING>>, attachments STRUCT<media_keys: ARRAY<STRING>>,
    public_metrics STRUCT<like_count: BIGINT, retweet_count: BIGINT, reply_count: BIGINT, quote_count: BIGINT, bookmark_count: BIGINT, impression_count: BIGINT>, organic_metrics STRUCT<impression_count: BIGINT>, non_public_metrics STRUCT<impression_count: BIGINT>"""


def _reference(kinds: tuple[str, ...]) -> Column:
    return F.try_element_at(F.filter("referenced_tweets", lambda r: r["type"].isin(*kinds)), F.lit(1))


def _metrics() -> tuple[Column, Column]:
    pairs = {"like": "like_count", "repost": "retweet_count", "reply": "reply_count", "quote": "quote_count", "bookmark": "bookmark_count"}
    breakdown = F.to_json(F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*(F.coalesce(f"public_metrics.{c}", F.lit(0)) for c in pairs.values()))))
    return breakdown, F.coalesce("public_metrics.impression_count", "organic_metrics.impression_count", "non_public_metrics.impression_count")


def tweet_posts(raw: DataFrame, source: str) -> DataFrame:
    """Timeline posts: shares are re-posts, forwards are quotes; the first quoted or re-posted reference makes a re-share."""
    p = _parsed(raw, _TWEET)
    of, (breakdown, views) = _reference(("quoted", "retweeted")), _metrics()
    name, own = username(F.lit(source)), F.concat(F.lit(f"x:{source}:"), F.col("id"))
    return _rows(
        p, POST, post_id=own, platform=F.lit("x"), source_id=F.lit(source), created_at=F.col("created_at"), message=F.col("text"), permalink=F.concat(F.lit("https://x.com/"), name, F.lit("/status/"), F.col("id")), reactions=F.col("public_metrics.like_count"),
        shares=F.col("public_metrics.retweet_count"), comments_count=F.col("public_metrics.reply_count"), forwards=F.col("public_metrics.quote_count"), reply_count=F.col("public_metrics.reply_count"), views=views, reaction_breakdown_json=breakdown,
        is_propagation=of.isNotNull(), propagation_kind=F.when(of["type"] == "quoted", "quote").when(of["type"] == "retweeted", "repost"), origin_external_id=of["id"], origin_post_id=F.when(of.isNotNull(), F.concat(F.lit("x:origin:"), of["id"])),
        has_media=F.coalesce(F.size("attachments.media_keys") > 0, F.lit(False)), source_collector=F.lit("x_api"), author=_author(F.col("author_id")),
    )


def tweet_replies(raw: DataFrame, source: str) -> DataFrame:
    """Replies of conversations: rows that reply to something, but aren't their conversation's root. Depths come from `comment_depths`."""
    c = _parsed(raw, _TWEET)
    to, (breakdown, _) = _reference(("replied_to",)), _metrics()
    root = F.concat(F.lit(f"x:{source}:"), F.col("conversation_id"))
    kept = c.where(to.isNotNull() & (F.col("id") != F.col("conversation_id")))
    parent = F.when(to["id"] != F.col("conversation_id"), F.concat(root, F.lit(":comment:"), to["id"]))
    return _rows(kept, COMMENT, comment_id=F.concat(root, F.lit(":comment:"), F.col("id")), platform=F.lit("x"), parent_post_id=root, parent_comment_id=parent, reply_to_message_id=to["id"], thread_root_post_id=root, created_at=F.col("created_at"), message=F.col("text"), permalink=F.concat(F.lit("https://x.com/i/web/status/"), F.col("id")), reactions=F.col("public_metrics.like_count"), reaction_breakdown_json=breakdown, source_collector=F.lit("x_api"), author=_author(F.col("author_id")))


_TELEGRAM = """id BIGINT, date BIGINT, message STRING, views BIGINT, forwards BIGINT, action STRING, media STRING, replies STRUCT<replies: BIGINT>, reactions MAP<STRING, BIGINT>, sender STRUCT<id: STRING, name: STRING>,
    reply_to_msg_id BIGINT, reply_to_top_id BIGINT, fwd_from STRUCT<peer_id: STRING, channel_post: BIGINT, from_name: STRING>"""


def _media_kind(media: Column) -> Column:
    low = F.lower(or_empty(media))
    return F.when(low.contains("photo"), "photo").when(low.contains("video"), "video").when(low.contains("document"), "document").when(low.contains("webpage"), "link").when(low != "", "media")


def telegram_messages(raw: DataFrame, chat: str, name: str) -> DataFrame:
    """Channel messages without service messages. A forward with peer and message has a native origin."""
    p = _parsed(raw, _TELEGRAM).where(or_null("action").isNull())
    fwd = F.col("fwd_from")
    origin = F.when(fwd["peer_id"].isNotNull() & fwd["channel_post"].isNotNull(), F.concat_ws(":", F.lit("telegram"), fwd["peer_id"], fwd["channel_post"].cast("string"))).when(fwd.isNotNull(), F.concat(F.lit("telegram:origin:"), F.coalesce(fwd["peer_id"], fwd["from_name"], F.lit("unknown"))))
    replies = F.coalesce("replies.replies", F.lit(0))
    return _rows(
        p, POST, post_id=F.concat_ws(":", F.lit("telegram"), F.lit(chat), F.col("id").cast("string")), platform=F.lit("telegram"), source_id=F.lit(chat), created_at=times.iso(F.timestamp_seconds("date")), message=F.col("message"),
        permalink=F.concat(F.lit(f"https://t.me/{name}/"), F.col("id")), reactions=_sum_of(F.col("reactions")), comments_count=replies, reply_count=replies, views=F.col("views"), forwards=F.col("forwards"), shares=F.col("forwards"), is_propagation=fwd.isNotNull(),
        propagation_kind=F.when(fwd.isNotNull(), "forward"), origin_post_id=origin, origin_external_id=fwd["channel_post"].cast("string"), has_media=or_null("media").isNotNull(), media_type=_media_kind(F.col("media")), reaction_breakdown_json=F.to_json("reactions"),
        source_collector=F.lit("telegram_mtproto"), author=_author(F.coalesce("sender.id", F.lit(chat)), F.col("sender.name")),
    )


def service_messages(raw: DataFrame) -> DataFrame:
    """One row: how many messages are service messages, which the posts leave out."""
    return _parsed(raw, _TELEGRAM).agg(F.count_if(or_null("action").isNotNull()).alias("filtered_service_message_count"))


def telegram_thread(raw: DataFrame, chat: str, root: int, post_id: str) -> DataFrame:
    """The messages of a discussion chat that belong to one thread: answers to its root, or below it."""
    c = _parsed(raw, _TELEGRAM).where(or_null("action").isNull() & ((F.col("reply_to_msg_id") == root) | (F.col("reply_to_top_id") == root)))
    own = lambda x: F.concat_ws(":", F.lit("telegram"), F.lit(chat), x.cast("string"))
    parent = F.when(F.col("reply_to_msg_id") != root, own(F.col("reply_to_msg_id")))
    return _rows(c, COMMENT, comment_id=own(F.col("id")), platform=F.lit("telegram"), parent_post_id=F.lit(post_id), thread_root_post_id=F.lit(post_id), parent_comment_id=parent, reply_to_message_id=F.col("reply_to_msg_id").cast("string"), created_at=times.iso(F.timestamp_seconds("date")), message=F.col("message"), reactions=_sum_of(F.col("reactions")), reaction_breakdown_json=F.to_json("reactions"), source_collector=F.lit("telegram_mtproto"), author=_author(F.col("sender.id"), F.col("sender.name")))


def bot_updates(raw: DataFrame, chat: str) -> DataFrame:
    """Channel posts of a bot's update queue, of whatever kind the update is; messages that the channel forwarded by itself are left out."""
    message = "STRUCT<message_id: BIGINT, date: BIGINT, text: STRING, caption: STRING, is_automatic_forward: BOOLEAN, forward_origin: STRUCT<chat_id: STRING, message_id: BIGINT>>"
    p = _parsed(raw, ", ".join(["update_id BIGINT", *(f"{k} {message}" for k in ("channel_post", "edited_channel_post", "message", "edited_message"))]))
    p = p.select(F.coalesce("channel_post", "edited_channel_post", "message", "edited_message").alias("m")).where("m IS NOT NULL AND NOT coalesce(m.is_automatic_forward, false)")
    fwd = F.col("m.forward_origin")
    return _rows(p, POST, post_id=F.concat_ws(":", F.lit("telegram"), F.lit(chat), F.col("m.message_id").cast("string")), platform=F.lit("telegram"), source_id=F.lit(chat), created_at=times.iso(F.timestamp_seconds("m.date")), message=F.coalesce("m.text", "m.caption"), is_propagation=fwd.isNotNull(), propagation_kind=F.when(fwd.isNotNull(), "forward"), origin_post_id=F.concat_ws(":", F.lit("telegram"), fwd["chat_id"], fwd["message_id"].cast("string")), source_collector=F.lit("telegram_bot_api"))


def threads_posts(raw: DataFrame, source: str) -> DataFrame:
    p = _parsed(raw, "id STRING, text STRING, timestamp STRING, permalink STRING, media_type STRING, username STRING, is_quote_post BOOLEAN, has_replies BOOLEAN, reposted_post STRUCT<id: STRING>, quoted_post STRUCT<id: STRING>, like_count BIGINT, views BIGINT")
    repost, quote = F.col("reposted_post").isNotNull(), F.coalesce("is_quote_post", F.lit(False))
    origin = F.coalesce("reposted_post.id", "quoted_post.id")
    return _rows(p, POST, post_id=F.concat(F.lit(f"threads:{source}:"), F.col("id")), platform=F.lit("threads"), source_id=F.lit(source), created_at=F.col("timestamp"), message=F.col("text"), permalink=F.col("permalink"), reactions=F.col("like_count"), shares=repost.cast("long"), comments_count=F.coalesce("has_replies", F.lit(False)).cast("long"), views=or_null(F.col("views").cast("string")).cast("long"), is_propagation=repost | quote, propagation_kind=F.when(repost, "repost").when(quote, "quote"), origin_external_id=origin, origin_post_id=F.when(origin.isNotNull(), F.concat(F.lit("threads:origin:"), origin)), media_type=F.lower("media_type"), has_media=F.lower(or_empty(F.col("media_type"))).isin("image", "video", "carousel_album"), source_collector=F.lit("threads_api"), author=_author(F.col("username"), F.col("username")))


_IG_COMMENT = "id STRING, text STRING, timestamp STRING, username STRING, like_count BIGINT"
_IG = f"""id STRING, caption STRING, timestamp STRING, permalink STRING, media_type STRING, media_url STRING, thumbnail_url STRING, like_count BIGINT, comments_count BIGINT, username STRING,
    children STRUCT<data: ARRAY<STRUCT<id: STRING, media_type: STRING, media_url: STRING>>>, comments STRUCT<data: ARRAY<STRUCT<{_IG_COMMENT.replace(" STRING", ": STRING").replace(" BIGINT", ": BIGINT")}, replies: STRUCT<data: ARRAY<STRUCT<{_IG_COMMENT.replace(" STRING", ": STRING").replace(" BIGINT", ": BIGINT")}>>>>>>"""


def instagram_posts(raw: DataFrame, source: str) -> DataFrame:
    """Posts with their own medium first and the children of a carousel from the second on."""
    p = _parsed(raw, _IG)
    own = F.concat(F.lit(f"instagram:{source}:"), F.col("id"))
    ref = lambda k, kind, url: F.struct(F.concat(own, F.lit(":media:"), k.cast("string")).alias("media_id"), own.alias("owner_post_id"), F.lower(kind).alias("media_type"), F.lit(None).cast("string").alias("title"), url.alias("url"), F.lit(None).cast("string").alias("preview_url"))
    children = F.transform(F.coalesce("children.data", F.array().cast("array<struct<id:string,media_type:string,media_url:string>>")), lambda x, i: ref(i + 2, x["media_type"], x["media_url"]))
    return _rows(p, POST, post_id=own, platform=F.lit("instagram"), source_id=F.lit(source), created_at=F.col("timestamp"), message=F.col("caption"), permalink=F.col("permalink"), reactions=F.col("like_count"), comments_count=F.col("comments_count"), media_type=F.lower("media_type"), has_media=F.lit(True), media_refs=F.concat(F.array(ref(F.lit(1), F.col("media_type"), F.col("media_url"))), children), source_collector=F.lit("instagram_graph_api"), author=_author(F.col("username"), F.col("username")))


def instagram_comments(raw: DataFrame, source: str) -> DataFrame:
    """Comments and their replies, two levels."""
    p = _parsed(raw, _IG).select(F.concat(F.lit(f"instagram:{source}:"), F.col("id")).alias("post"), F.explode("comments.data").alias("c"))
    top = p.select("post", "c.id", "c.text", "c.timestamp", "c.username", "c.like_count", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"))
    low = p.select("post", F.col("c.id").alias("parent"), F.explode("c.replies.data").alias("r")).select("post", "r.id", "r.text", "r.timestamp", "r.username", "r.like_count", "parent", F.lit(1).alias("level"))
    every, own = top.unionByName(low), lambda x: F.concat(F.col("post"), F.lit(":comment:"), x)
    return _rows(every, COMMENT, comment_id=own(F.col("id")), platform=F.lit("instagram"), parent_post_id=F.col("post"), parent_comment_id=own(F.col("parent")), depth=F.col("level"), created_at=F.col("timestamp"), message=F.col("text"), reactions=F.col("like_count"), source_collector=F.lit("instagram_graph_api"), author=_author(F.col("username"), F.col("username")))


def web_posts(rows: DataFrame, platform: str, source: str) -> DataFrame:
    """Posts of a scraped timeline (permalink, author, text, published_hint, likes, replies, reposts, views as labels). Posts of other authors are
    dropped, ids come from the permalink, and of rows with equal permalinks the first (by `pos`) stays."""
    from forumetry.functions.text import compact_number, stable_id

    kept = rows.where(username(F.col("author")) == username(F.lit(source)))
    url = urls.normal_permalink(F.col("permalink"), urls.POST_KEYS)
    first = kept.withColumn("_url", url).groupBy("_url").agg(F.min_by(F.struct(*kept.columns), "pos").alias("r")).select("_url", "r.*")
    ident = F.coalesce(urls.message_id(F.col("permalink")), urls.path_part(F.col("permalink"), -1), stable_id(F.lit(source), F.col("_url")))
    number = lambda c: compact_number(F.col(c))
    return _rows(first, POST, post_id=F.concat(F.lit(f"{platform}:{source}:"), ident), platform=F.lit(platform), source_id=F.lit(source), created_at=F.col("published_hint"), message=F.col("text"), permalink=F.col("_url"), reactions=number("likes"), comments_count=number("replies"), shares=number("reposts"), views=F.nullif(number("views"), F.lit(0)), source_collector=F.lit(f"{platform}_web"), author=_author(F.col("author"), F.col("author")))


def with_comment_counts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """posts whose comments_count is at least the number of extracted comments."""
    n = comments.groupBy(F.col("parent_post_id").alias("post_id")).agg(F.count("*").alias("_n"))
    return posts.join(n, "post_id", "left").withColumn("comments_count", F.greatest("comments_count", F.coalesce("_n", F.lit(0)))).drop("_n").select(*posts.columns)
