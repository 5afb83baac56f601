"""Scraped items of web timelines and threads, and queues of a bot, as posts and comments of the snapshot schema.

All take rows (JSON-free), and give columns of the snapshot schema, so that their results can be united by name. Labels are read as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumetry.functions import urls
from forumetry.functions.pagetext import discussion_count
from forumetry.functions.text import compact_number, or_empty, username
from forumetry.operators.normalize import comment_depths, or_null
from forumetry.sources.payloads import COMMENT, POST, _author, _rows

#: Where each platform shows a profile.
PROFILES = {"x": "https://x.com/{}", "threads": "https://www.threads.net/@{}", "instagram": "https://www.instagram.com/{}/"}


def profile(platform: str, name: Column) -> Column:
    before, behind = PROFILES[platform].split("{}")
    return F.when(or_null(name).isNotNull(), F.concat(F.lit(before), name, F.lit(behind)))


def threaded(items: DataFrame, comment_id: Column) -> DataFrame:
    """items (post_id, pos, native_id, reply_to, ...), those without native_id left out, with comment_id, parent_comment_id and depth.

    An answer's parent is the item that it replies to, if that is of the same post and came before it; else the post itself, and the depth is 0.
    Of items with equal ids of a post the first counts as parent."""
    own = items.where(or_null("native_id").isNotNull()).withColumn("comment_id", comment_id)
    first = own.groupBy("post_id", F.col("native_id").alias("reply_to")).agg(F.min("pos").alias("_pos"), F.min("comment_id").alias("_id"))
    met = own.join(first, ["post_id", "reply_to"], "left").withColumn("parent_comment_id", F.when(F.col("_pos") < F.col("pos"), F.col("_id"))).drop("_pos", "_id")
    one = met.groupBy("comment_id").agg(F.min_by("parent_comment_id", "pos").alias("parent_comment_id"))
    depths = comment_depths(one).withColumnRenamed("tree_depth", "depth")
    return met.join(depths, "comment_id")


def _comment(platform: str, items: DataFrame, url: Column | None = None, **more: Column) -> DataFrame:
    author = _author(F.col("author_username"), F.col("author_name"), profile(platform, F.col("author_username")))
    shared = {"comment_id": F.col("comment_id"), "platform": F.lit(platform), "parent_post_id": F.col("post_id"), "parent_comment_id": F.col("parent_comment_id"), "thread_root_post_id": F.col("post_id")}
    said = {"created_at": F.col("created_at"), "message": F.col("text"), "permalink": F.col("permalink") if url is None else url, "reactions": compact_number(F.col("like_count")), "depth": F.col("depth")}
    return _rows(items, COMMENT, **(shared | said | {"source_collector": F.lit(f"{platform}_web"), "author": author} | more))


def native(post_id: Column) -> Column:
    """The number at the end of a post's id; the id itself without one."""
    return F.coalesce(F.nullif(F.regexp_extract(post_id, r":(\d+)$", 1), F.lit("")), post_id)


def web_replies(items: DataFrame, platform: str) -> DataFrame:
    """Comments from the replies of posts (post_id, pos, status_id, reply_to_status_id, created_at, text, permalink, like_count, author_username,
    author_name, and for x also main_status_id and origin_status_id, the post's own and what it re-shares, which are no replies)."""
    to = F.coalesce(or_null("reply_to_status_id"), native(F.col("post_id")))
    shaped = items.withColumns({"native_id": F.col("status_id"), "reply_to": to})
    if platform == "x":
        main = F.coalesce(or_null("main_status_id"), native(F.col("post_id")))
        shaped = shaped.where((F.col("status_id") != main) & (F.col("status_id") != or_empty(F.col("origin_status_id"))))
    made = threaded(shaped, F.concat_ws(":", "post_id", F.lit("comment"), "status_id"))
    return _comment(platform, made, reply_to_message_id=F.col("reply_to"))


def instagram_replies(items: DataFrame) -> DataFrame:
    """Comments of posts (post_id, pos, comment_id, reply_to_comment_id, created_at, text, like_count, author_username, author_name)."""
    shaped = items.withColumnsRenamed({"comment_id": "native_id", "reply_to_comment_id": "reply_to"})
    made = threaded(shaped, F.concat_ws(":", "post_id", F.lit("comment"), "native_id"))
    return _comment("instagram", made, url=F.lit(None), reply_to_message_id=or_null("reply_to"))


def timeline(items: DataFrame, platform: str, source: str, name: str) -> DataFrame:
    """Posts of a web timeline (status_id, created_at, text, permalink, like_count, repost_count, reply_count, view_count, has_media, media_type,
    propagation_kind, origin_status_id, origin_permalink, author_username, author_name). On x, posts of other authors go."""
    number = lambda c: compact_number(F.col(c))
    kind, external = or_null("propagation_kind"), or_null("origin_status_id")
    made = {
        "post_id": F.concat(F.lit(f"{platform}:{source}:"), F.col("status_id")), "platform": F.lit(platform), "source_id": F.lit(source), "created_at": F.col("created_at"), "message": F.col("text"),
        "permalink": F.col("permalink"), "reactions": number("like_count"), "has_media": F.col("has_media"), "media_type": F.col("media_type"), "source_collector": F.lit(f"{platform}_web"),
        "author": _author(F.coalesce(or_null("author_username"), F.lit(source)), F.coalesce(or_null("author_name"), F.lit(name)), F.coalesce(profile(platform, F.col("author_username")), profile(platform, F.lit(source)))),
        "comments_count": number("reply_count"),
    }
    if platform == "instagram":
        return _rows(items, POST, **made)
    made |= {
        "shares": number("repost_count"), "reply_count": number("reply_count"), "is_propagation": kind.isNotNull(), "propagation_kind": kind, "origin_external_id": external,
        "origin_permalink": or_null("origin_permalink"),
    }
    if platform == "threads":
        return _rows(items, POST, **made | {"views": F.nullif(number("view_count"), F.lit(0)), "forwards": F.when(kind == "quote", 1), "origin_post_id": F.concat(F.lit("threads:origin:"), external)})
    own = (username(F.col("author_username")) == "") | (username(F.col("author_username")) == username(F.lit(source)))
    link = F.coalesce(or_null("origin_permalink"), F.concat(F.lit("https://x.com/i/status/"), external))
    counts = {"reply_count": "reply_count", "retweet_count": "repost_count", "like_count": "like_count", "view_count": "view_count"}
    breakdown = F.to_json(F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*map(number, counts.values()))))
    return _rows(items.where(own), POST, **made | {"views": number("view_count"), "origin_permalink": link, "origin_post_id": urls.status_origin(external, link), "reaction_breakdown_json": breakdown})


def channel_messages(items: DataFrame, source: str, name: str, url: str | None = None) -> DataFrame:
    """Posts of a channel's web preview (message_id, created_at, text, permalink, views, reply_text, has_media, media_type, reactions map, and of a
    forward forwarded_from_name, forwarded_permalink, forwarded_message_id)."""
    link = F.when(or_null("forwarded_permalink").isNotNull(), urls.normal_permalink(F.col("forwarded_permalink"), ()))
    origin = urls.forward_origin(link, F.col("forwarded_message_id"))
    forwarded = F.coalesce(or_null("forwarded_from_name"), or_null("forwarded_permalink"), or_null("forwarded_message_id")).isNotNull()
    total = F.aggregate(F.map_values("reactions"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return _rows(
        items, POST, post_id=F.concat_ws(":", F.lit("telegram"), F.lit(source), "message_id"), platform=F.lit("telegram"), source_id=F.lit(source), created_at=F.col("created_at"), message=F.col("text"), permalink=F.col("permalink"),
        reactions=total, comments_count=discussion_count(F.col("reply_text")), views=compact_number(F.col("views")), is_propagation=forwarded, propagation_kind=F.when(forwarded, "forward"), origin_post_id=origin["id"],
        origin_external_id=origin["external"], origin_permalink=link, has_media=F.col("has_media"), media_type=F.col("media_type"), reaction_breakdown_json=F.when(F.size("reactions") > 0, F.to_json("reactions")),
        source_collector=F.lit("telegram_web"), author=_author(F.lit(source), F.lit(name), F.lit(url)),
    )


_MESSAGE = """STRUCT<message_id: BIGINT, date: BIGINT, text: STRING, caption: STRING, is_automatic_forward: BOOLEAN, message_thread_id: BIGINT, forward_from_message_id: BIGINT,
    chat: STRUCT<id: STRING, type: STRING>, reply_to_message: STRUCT<message_id: BIGINT>, `from`: STRUCT<id: STRING, username: STRING, first_name: STRING>>"""
_KINDS = ("channel_post", "edited_channel_post", "message", "edited_message")


def bot_messages(raw: DataFrame, source: str, discussion: str) -> tuple[DataFrame, DataFrame]:
    """Posts (thread, ord, post_id, date) of the source and messages (thread, ord, m) of its discussion chat in a bot's update queue (payload). Messages
    that the channel forwarded by itself, and those of no thread, are none."""
    p = raw.select(F.from_json("payload", ", ".join(["update_id BIGINT", *(f"{k} {_MESSAGE}" for k in _KINDS)])).alias("u"))
    p = p.select(F.col("u.update_id").alias("ord"), F.coalesce(*(f"u.{k}" for k in _KINDS)).alias("m")).where("m IS NOT NULL")
    posts = p.where((F.col("m.chat.id") == source) & (F.col("m.chat.type") == "channel"))
    ident = F.concat_ws(":", F.lit("telegram"), F.lit(source), F.col("m.message_id").cast("string"))
    said = p.where((F.col("m.chat.id") == discussion) & ~F.coalesce("m.is_automatic_forward", F.lit(False)))
    said = said.select(F.coalesce("m.message_thread_id", "m.reply_to_message.message_id").alias("thread"), "ord", "m").where("thread IS NOT NULL")
    return posts.select(F.col("m.message_id").alias("thread"), "ord", ident.alias("post_id"), F.col("m.date").alias("date")), said


def bot_comments(raw: DataFrame, source: str, discussion: str) -> DataFrame:
    """Comments in a bot's update queue (payload): messages of the discussion chat whose thread is a post of the source that came before them."""
    from forumetry.functions.times import iso
    from forumetry.operators.threads import arrived_comments

    posts, said = bot_messages(raw, source, discussion)
    met = arrived_comments(posts, said)
    reply = F.col("m.reply_to_message.message_id")
    items = met.select("post_id", F.col("ord").alias("pos"), F.col("m.message_id").cast("string").alias("native_id"), reply.cast("string").alias("reply_to"), "m")
    made = threaded(items, F.concat_ws(":", "post_id", F.lit("comment"), "native_id"))
    who = F.col("m.from")
    return _rows(
        made, COMMENT, comment_id=F.col("comment_id"), platform=F.lit("telegram"), parent_post_id=F.col("post_id"), parent_comment_id=F.col("parent_comment_id"), reply_to_message_id=F.col("reply_to"), thread_root_post_id=F.col("post_id"),
        created_at=iso(F.timestamp_seconds("m.date")), message=F.coalesce("m.text", "m.caption"), depth=F.col("depth"), source_collector=F.lit("telegram_bot_api"), author=_author(who["id"], F.coalesce(who["first_name"], who["username"])),
    )


_PAGE = """data ARRAY<STRING>, includes STRUCT<users: ARRAY<STRUCT<id: STRING, name: STRING, username: STRING>>, media: ARRAY<STRUCT<media_key: STRING, type: STRING, url: STRING, preview_image_url: STRING>>>"""


def tweet_pages(pages: DataFrame) -> DataFrame:
    """(payload, users, media) of the posts in landed pages (payload): each post as JSON, with its page's users and media by their keys. So authors
    and media are looked up without a join."""
    none = lambda kind: F.array().cast(kind)
    users = F.coalesce("p.includes.users", none("array<struct<id:string,name:string,username:string>>"))
    media = F.coalesce("p.includes.media", none("array<struct<media_key:string,type:string,url:string,preview_image_url:string>>"))

    def by(items: Column, key: str) -> Column:
        """A map by key; of items with equal keys the last."""
        known = F.filter(items, lambda x: x[key].isNotNull())
        keys = F.array_distinct(F.transform(known, lambda x: x[key]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(known, lambda x: x[key] == k), -1)))

    return pages.select(F.from_json("payload", _PAGE).alias("p")).select(F.explode("p.data").alias("payload"), by(users, "id").alias("users"), by(media, "media_key").alias("media"))


def with_includes(posts: DataFrame, pages: DataFrame) -> DataFrame:
    """posts of an account, as `tweet_posts` gives them from pages (payload, users, media), with authors' names and media from what the pages include: of a post that
    several pages have, from one of them."""
    of = pages.select(F.get_json_object("payload", "$.id").alias("_id"), F.from_json(F.get_json_object("payload", "$.attachments.media_keys"), "array<string>").alias("_keys"), "users", "media", F.get_json_object("payload", "$.author_id").alias("_author"))
    # of pages that overlap, one row a post
    row = F.struct("_keys", "users", "media", "_author")
    of = of.groupBy("_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("v")).select("_id", "v.*")
    met = posts.withColumn("_id", F.element_at(F.split("post_id", ":"), -1)).join(of, "_id")
    user = F.try_element_at("users", F.col("_author"))
    ref = lambda key, k: F.struct(F.concat("post_id", F.lit(":media:"), (k + 1).cast("string")).alias("media_id"), F.col("post_id").alias("owner_post_id"), F.try_element_at("media", key)["type"].alias("media_type"), F.lit(None).cast("string").alias("title"), F.try_element_at("media", key)["url"].alias("url"), F.try_element_at("media", key)["preview_image_url"].alias("preview_url"))
    refs = F.transform(F.coalesce("_keys", F.array().cast("array<string>")), ref)
    author = F.when(F.col("_author").isNotNull(), _author(F.col("_author"), F.coalesce(user["name"], user["username"]), F.concat(F.lit("https://x.com/"), user["username"])))
    return met.withColumns({"media_refs": refs, "author": author}).select(*posts.columns)
