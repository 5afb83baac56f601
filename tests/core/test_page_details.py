from datetime import datetime

from pyspark.sql import functions as F

from forumetry.operators import pages

CANDIDATE = "candidate struct<permalink string, detail_url string, text string, published_hint string, published_at string, reactions bigint, comments_count bigint, shares bigint, shared_permalink string>"
PAYLOAD = "payload struct<post_permalink string, post_text string, body_text string, meta_title string, meta_description string, published_hint string, published_at string, shared_permalink string, reply_text string>"
NOW = datetime(2026, 4, 10, 12)


def details(spark, candidate, payload, html=""):
    c = {k: None for k in "permalink detail_url text published_hint published_at reactions comments_count shares shared_permalink".split()} | candidate
    p = {k: None for k in "post_permalink post_text body_text meta_title meta_description published_hint published_at shared_permalink reply_text".split()} | payload
    df = spark.createDataFrame([("pg", "Page", "https://www.facebook.com/pg", c, p, html)], f"page_id string, page_name string, source_url string, {CANDIDATE}, {PAYLOAD}, html string")
    return pages.page_details(df, F.lit(NOW).cast("timestamp")).first()


LINK = "https://www.facebook.com/pg/posts/77?__cft__=x"


def test_times_come_from_the_first_place_that_has_one(spark):
    given = {"permalink": LINK, "published_at": "2026-01-01T00:00:00+00:00", "published_hint": "2h"}
    assert details(spark, given, {"published_at": "2026-02-02T00:00:00+00:00"}).created_at == "2026-01-01T00:00:00+00:00"
    assert details(spark, {"permalink": LINK}, {"published_at": "2026-02-02T00:00:00+00:00", "published_hint": "2h"}).created_at == "2026-02-02T00:00:00+00:00"
    assert details(spark, {"permalink": LINK, "published_hint": "2h"}, {}, '"publish_time":1770000000,"story_name"').created_at == "2026-02-02T02:40:00+00:00"
    assert details(spark, {"permalink": LINK, "published_hint": "2h"}, {}).created_at == "2026-04-10T10:00:00+00:00"
    assert details(spark, {"permalink": LINK}, {}).created_at is None


def test_texts_counts_and_links(spark):
    row = details(
        spark, {"permalink": LINK, "text": "short", "reactions": 3, "comments_count": 2, "shares": 4},
        {"post_text": "A text of this post that is long enough to mean something", "meta_title": "1.2K reactions · 40 comments", "body_text": ""},
    )
    assert row.message.startswith("A text of this post") and (row.reactions, row.comments_count, row.shares) == (1200, 40, 4)
    assert row.permalink == "https://www.facebook.com/pg/posts/77" and row.platform == "facebook" and row.source_id == "pg" and not row.login_wall
    less = details(spark, {"permalink": LINK, "reactions": 3000}, {"meta_title": "12 reactions"})
    assert less.reactions == 3000 and less.comments_count == 0
    assert row.post_id == less.post_id != details(spark, {"permalink": LINK.replace("77", "78")}, {}).post_id


def test_shares_are_told_by_their_words(spark):
    origin = "https://www.facebook.com/reel/123456"
    row = details(spark, {"permalink": LINK}, {"body_text": "Somebody SHARED a reel.", "shared_permalink": origin})
    assert row.is_propagation and row.propagation_kind == "share" and row.origin_permalink == origin and row.origin_external_id == "123456"
    own = details(spark, {"permalink": LINK}, {"meta_description": "shared a memory"})
    assert own.is_propagation and own.origin_permalink == own.permalink
    none = details(spark, {"permalink": LINK}, {"body_text": "Nothing of the kind", "shared_permalink": origin})
    assert not none.is_propagation and none.propagation_kind is None and none.origin_permalink is None and none.origin_post_id is None


def test_pages_that_ask_to_log_in(spark):
    assert details(spark, {"permalink": LINK}, {"body_text": "Log In\nForgot Account?\nCreate new account"}).login_wall


def test_comments_of_a_page_stay_in_its_row(spark):
    at = lambda x, said, name="Anna Kovalenko": (said, None, name, "2h", None, x)
    kind = "post_id string, comments array<struct<text:string, raw_text:string, author_name:string, published_hint:string, permalink:string, nesting_x:int>>"
    payload = spark.createDataFrame([("p", [at(300, "the first"), at(350, "no"), at(400, "an answer"), at(None, "Anna Kovalenko\nthe last\n2h\nLike")]), ("q", []), ("r", None)], kind)
    made = pages.page_comments(payload, F.lit("2026-03-24T12:00:00+00:00").cast("timestamp"))
    rows = {r.message: r for r in made.collect()}
    assert set(rows) == {"the first", "an answer", "the last"} and [rows[m].depth for m in ("the first", "an answer", "the last")] == [0, 1, 0]
    assert rows["an answer"].parent_comment_id == rows["the first"].comment_id and rows["the last"].parent_comment_id is None
    assert {r.author_name for r in rows.values()} == {"Anna Kovalenko"} and rows["the last"].created_at == "2026-03-24T10:00:00+00:00"
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
