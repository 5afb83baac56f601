"""Items of scraped pages as posts and comments: the mobile timeline, comments of two passes as one list, views of one post as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumetry.functions import pagetext, times, urls
from forumetry.functions.text import clean_mobile_text, let, metric_count, or_empty, stripped
from forumetry.operators.merge import longest
from forumetry.operators.normalize import or_null

OTHERS = r"(?iU)\band (\d+) others\b"


def mobile_timeline(items: DataFrame, now: Column) -> DataFrame:
    """(page_id, group, post_id, published_hint, created_at, message, reactions, comments_count) of the posts in the items (page_id, page_name,
    pos, text) of mobile timelines.

    Buttons go, and items that repeat the one before. Posts begin behind `Posts` or at the first header and end at the end marker. A header
    opens a group, whose first item of 20 characters that is neither a header nor a number is the message; groups without one are no posts.
    The order of a page's items is its own, so windows are by page.
    """
    by = Window.partitionBy("page_id").orderBy("pos")
    text = F.col("text")
    kept = items.withColumn("text", clean_mobile_text(text)).where((text != "") & ~text.isin(*pagetext.MOBILE))
    kept = kept.withColumn("_before", F.lag("text").over(by)).where(~F.col("_before").eqNullSafe(text)).drop("_before")
    kept = kept.withColumn("_header", pagetext.mobile_header(text, F.col("page_name")))
    kept = kept.withColumn("_open", F.max(F.col("_header") | (text == "Posts")).over(by)).where(F.col("_open") & (text != "Posts"))
    kept = kept.withColumn("_ended", F.max(pagetext.mobile_end(text)).over(by)).where(~F.col("_ended"))
    kept = kept.withColumn("group", F.sum(F.col("_header").cast("long")).over(by)).where("group > 0")
    number = F.when(text.rlike(r"^\p{Nd}+$"), text.try_cast("long"))
    others = F.nullif(F.regexp_extract("text", OTHERS, 1), F.lit("")).try_cast("long")
    says = ~F.col("_header") & number.isNull() & ~text.rlike(r"^.+ and \p{Nd}+ others$") & (F.length("text") >= pagetext.MEANINGFUL)
    first = lambda value, when: F.min_by(value, F.when(when, F.col("pos")))
    grouped = kept.groupBy("page_id", "group").agg(
        first(text, F.col("_header")).alias("header"), first(text, says).alias("said"), first(others, others.isNotNull()).alias("others"),
        F.min(F.when(others.isNotNull(), F.col("pos"))).alias("at"), first(number, number.isNotNull() & ~F.col("_header")).alias("number"),
        F.array_sort(F.collect_list(F.when(number.isNotNull(), F.struct("pos", number.alias("n"))))).alias("numbers"),
    )
    behind = F.filter("numbers", lambda x: x["pos"] > F.col("at"))
    hint, message = pagetext.mobile_hint(F.col("header")), stripped(F.regexp_replace("said", r"(?U)\s+See more$", ""))
    made = grouped.select(
        "page_id", "group", hint.alias("published_hint"), message.alias("message"), F.coalesce(F.col("others") + 1, "number", F.lit(0)).alias("reactions"),
        F.coalesce(F.get(behind, F.lit(1))["n"], F.lit(0)).alias("comments_count"),
    )
    made = made.where(F.length("message") >= pagetext.MEANINGFUL)
    return made.withColumns({"post_id": F.sha1(F.concat_ws("::", "page_id", "published_hint", "message")), "created_at": times.iso(times.posted_in(F.col("published_hint"), now))})


def comment_score(c: Column) -> Column:
    """How complete an extracted comment is."""
    has = lambda name, points: F.when(or_empty(c[name]) != "", points).otherwise(0)
    said = F.length(clean_mobile_text(F.coalesce(or_null(c["text"]), c["raw_text"])))
    return said + has("author_name", 50) + has("published_hint", 25) + has("permalink", 25) + has("dom_parent_key", 5)


EXTRACTED = ("text", "raw_text", "author_name", "published_hint", "permalink", "dom_parent_key")


def merged_extractions(comments: DataFrame, limit: int = 0) -> DataFrame:
    """One row a comment of the comments (post_id, pass, pos, text, raw_text, author_name, published_hint, permalink, dom_parent_key) that several
    passes over a page found, the first passes first; `pos` is then the place among a post's comments, and with a limit only so many stay.

    Comments are one by their permalink, or else by the first 200 characters of what they say. A more complete one takes the place of what was
    there before, and keeps its text, author, time and link where it has none of its own. The rows of one comment are folded in their order; a
    page shows a few of each at most.
    """
    link = urls.normal_permalink(F.col("permalink"))
    said = clean_mobile_text(F.coalesce(or_null(F.col("text")), F.col("raw_text")))
    key = F.when(link != "", F.concat(F.lit("permalink:"), link)).otherwise(F.concat(F.lit("text:"), F.left(said, F.lit(200))))
    shaped = comments.select("post_id", key.alias("key"), F.struct("pass", "pos").alias("at"), F.struct("text", "raw_text", "author_name", "published_hint", F.when(link != "", link).otherwise(F.col("permalink")).alias("permalink"), "dom_parent_key").alias("c"))

    def better(old: Column, new: Column) -> Column:
        kept = {c: F.coalesce(or_null(new[c]), old[c]) for c in ("text", "author_name", "published_hint", "permalink")}
        both = F.struct(*(kept.get(c, new[c]).alias(c) for c in EXTRACTED))
        return F.when(comment_score(new) > comment_score(old), both).otherwise(old)

    listed = shaped.groupBy("post_id", "key").agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("found"))
    merged = F.aggregate(F.slice(F.col("found.c"), F.lit(2), F.size("found")), F.get(F.col("found.c"), F.lit(0)), better)
    place = F.row_number().over(Window.partitionBy("post_id").orderBy("first"))
    placed = listed.select("post_id", F.get("found", F.lit(0))["at"].alias("first"), merged.alias("c")).select("post_id", place.alias("pos"), "c.*")
    return placed.where(F.col("pos") <= limit) if limit > 0 else placed


def merged_views(views: DataFrame) -> DataFrame:
    """One row a post of views (post_key, ord, post_id, created_at, permalink, message, reactions, shares, comments_count, raw_path, comments): the
    first set time, link and path, the longest message, the greatest counts, and of comments with one id the first."""
    first_set = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("ord"))).alias(c)
    own = views.groupBy("post_key").agg(
        F.min_by("post_id", "ord").alias("post_id"), *map(first_set, ("created_at", "permalink", "raw_path")), longest("message"), *(F.max(c).alias(c) for c in ("reactions", "shares", "comments_count"))
    )
    each = views.select("post_key", F.col("ord").alias("o"), F.posexplode("comments").alias("p", "c"))
    distinct = each.groupBy("post_key", F.col("c.comment_id").alias("id")).agg(F.min_by("c", F.struct("o", "p")).alias("c"), F.min(F.struct("o", "p")).alias("at"))
    lists = distinct.groupBy("post_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("comments"), F.count("*").alias("_n"))
    both = own.join(lists, "post_key", "left")
    none = F.array().cast(views.schema["comments"].dataType)
    return both.withColumns({"comments_count": F.greatest("comments_count", F.coalesce("_n", F.lit(0))), "comments": F.coalesce("comments", none)}).drop("_n")


def candidates(raw: DataFrame) -> DataFrame:
    """Posts that a timeline names, (source_id, pos, permalink, detail_url, published_hint, text, reactions, comments_count, shares): the first of each
    normal permalink, labels read as numbers. Those without a permalink go."""
    link = urls.normal_permalink(F.col("permalink"), urls.POST_KEYS)
    named = raw.withColumn("permalink", link).where("permalink <> ''")
    first = named.groupBy("source_id", "permalink").agg(F.min_by(F.struct(*(c for c in named.columns if c not in ("source_id", "permalink"))), "pos").alias("r"))
    one = first.select("source_id", "permalink", "r.*")
    return one.select(
        "source_id", "pos", "permalink", F.coalesce(or_null("detail_url"), "permalink").alias("detail_url"), stripped(or_empty(F.col("published_hint"))).alias("published_hint"), stripped(or_empty(F.col("text"))).alias("text"),
        *(metric_count(F.col(f"{c}_text")).alias(c) for c in ("reactions", "comments", "shares")),
    ).withColumnRenamed("comments", "comments_count")


def page_comments(payload: DataFrame, now: Column) -> DataFrame:
    """(comment_id, parent_post_id, parent_comment_id, created_at, message, permalink, author_name, depth) of pages' comments, payload (post_id,
    comments array<struct<text, raw_text, author_name, published_hint, permalink, nesting_x>>, in the order of the page).

    Authors and times are read from the text where the page doesn't name them; comments of fewer than three characters go, and what is nested
    below them goes below the one before. Answers are told by how far left a comment lies. A row is a page and holds its list, so nothing is
    shuffled; rows of comments come out of it once their parents are known.
    """
    from forumetry.operators.normalize import nesting

    raw = lambda c: F.coalesce(or_null(c["raw_text"]), or_null(c["text"]), F.lit(""))

    def named(c: Column, raw: Column) -> Column:
        author = pagetext.comment_author(c["author_name"], raw, now)
        hint = F.coalesce(or_null(c["published_hint"]), pagetext.comment_hint(raw))
        return let(F.struct(author.alias("author"), hint.alias("hint")), lambda n: told(c, F.coalesce(or_null(c["text"]), raw), n["author"], n["hint"]))

    def told(c: Column, said: Column, author: Column, hint: Column) -> Column:
        at = times.iso(times.posted_in(hint, now)).alias("created_at")
        return let(pagetext.comment_text(said, author, hint, now), lambda m: F.struct(F.coalesce(c["nesting_x"], F.lit(0)).alias("x"), own(c, m).alias("comment_id"), at, m.alias("message"), c["permalink"].alias("permalink"), author.alias("author_name")))

    own = lambda c, message: F.sha1(F.concat_ws("::", "post_id", F.coalesce(or_null(c["permalink"]), F.left(message, F.lit(160)))))
    made = F.transform("comments", lambda c: let(raw(c), lambda r: named(c, r)))
    listed = payload.select("post_id", F.filter(made, lambda c: F.length(c["message"]) >= 3).alias("list")).withColumn("xs", F.col("list.x"))
    parent = lambda k: let(F.get("parents", k), lambda p: F.when(p >= 0, F.get("list", p)["comment_id"]))
    rows = F.transform("list", lambda c, k: F.struct(c.alias("c"), parent(k).alias("parent"), F.get("depths", k).cast("long").alias("depth")))
    one = nesting(listed).select("post_id", F.explode(rows).alias("r"))
    return one.select("r.c.comment_id", F.col("post_id").alias("parent_post_id"), F.col("r.parent").alias("parent_comment_id"), "r.c.created_at", "r.c.message", "r.c.permalink", "r.c.author_name", "r.depth")


def page_details(pages: DataFrame, now: Column) -> DataFrame:
    """Posts from their own pages: (page_id, page_name, source_url, candidate struct<permalink, detail_url, text, published_hint, published_at,
    reactions, comments_count, shares, shared_permalink>, payload struct<post_permalink, post_text, body_text, meta_title, meta_description,
    published_hint, published_at, shared_permalink, reply_text>, html) as post columns, and `login_wall`.

    Times, links and texts come from the first place that has them, counts are the greatest that any place shows.
    """
    c, p = (lambda name: F.col(f"candidate.{name}")), (lambda name: F.col(f"payload.{name}"))
    detail = urls.localised(F.coalesce(or_null(c("detail_url")), c("permalink")))
    hint = F.coalesce(or_null(p("published_hint")), or_null(c("published_hint")), pagetext.body_hint(p("body_text"), F.col("page_name")))
    made = pages.withColumns({"_hint": hint, "_link": urls.post_permalink(p("post_permalink"), c("permalink"), detail)})
    at = F.coalesce(or_null(c("published_at")), or_null(p("published_at")), times.published_in_page(F.col("html"), [detail, p("post_permalink")], now), times.iso(times.posted_in(F.col("_hint"), now)))
    own = pagetext.post_text(F.coalesce(or_null(p("post_text")), or_empty(c("text"))), F.col("_hint"))
    made = made.withColumn("_own", own)
    text = F.when(pagetext.meaningful(F.col("_own")), F.col("_own")).otherwise(pagetext.body_text(p("body_text"), p("meta_description"), F.col("page_name")))
    made = made.withColumn("_text", text)
    said = F.lower(F.concat_ws(" ", "_text", *(or_null(p(x)) for x in ("body_text", "meta_title", "meta_description", "reply_text"))))
    made = made.withColumn("_shared", F.contains(said, F.lit("shared")))
    origin = F.when(F.col("_shared"), F.coalesce(or_null(p("shared_permalink")), or_null("_link")))
    external = urls.numeric_media_id(origin)
    return made.select(
        F.sha1(F.concat_ws("::", "page_id", "_link")).alias("post_id"), F.lit("facebook").alias("platform"), F.col("page_id").alias("source_id"), at.alias("created_at"), F.col("_text").alias("message"), F.col("_link").alias("permalink"),
        F.greatest(F.coalesce(c("reactions"), F.lit(0)), pagetext.reaction_count(p("meta_title"))).alias("reactions"), F.coalesce(c("shares"), F.lit(0)).alias("shares"),
        F.greatest(F.coalesce(c("comments_count"), F.lit(0)), pagetext.visible_comments(p("body_text"), p("meta_description"), p("meta_title"))).alias("comments_count"),
        F.col("_shared").alias("is_propagation"), F.when(F.col("_shared"), "share").alias("propagation_kind"), origin.alias("origin_permalink"), external.alias("origin_external_id"),
        urls.shared_origin(F.col("page_id"), F.concat(F.lit("facebook:origin:"), external), origin, F.col("source_url")).alias("origin_post_id"), pagetext.login_wall(p("body_text")).alias("login_wall"),
    )
