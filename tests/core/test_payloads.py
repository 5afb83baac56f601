import json

from forumetry.operators.normalize import comment_depths
from forumetry.sources import payloads


def landed(spark, *objects, **columns):
    return spark.createDataFrame([(json.dumps(o), *columns.values()) for o in objects], ", ".join(["payload string", *(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in columns.items())]))


def test_graph(spark):
    own = {"id": "1_2", "message": "hi", "created_time": "t", "reactions": {"summary": {"total_count": 3}}, "comments": {"summary": {"total_count": 2}}, "from": {"id": "u", "name": "U"}}
    shared = {"id": "1_3", "parent_id": "9_9", "attachments": {"data": [{"media_type": "photo", "target": {"id": "77", "url": "https://f/77"}}]}}
    status = {"id": "1_4", "status_type": "shared_story", "attachments": {"data": [{"target": {"id": "77"}}]}}
    a, b, c = sorted(payloads.graph_posts(landed(spark, own, shared, status), "1").collect(), key=lambda r: r.post_id)
    assert (a.reactions, a.shares, a.comments_count, a.is_propagation, a.author.author_id) == (3, 0, 2, False, "u")
    assert (b.is_propagation, b.origin_post_id, b.propagation_kind, b.has_media, b.media_refs[0].media_id, b.author.author_id) == (True, "9_9", "share", True, "1_3:media:0", "1_3")
    assert c.origin_post_id == "facebook:origin:77"
    (d,) = payloads.graph_comments(landed(spark, {"id": "c", "message": "x", "like_count": 4}, post_id="1_2", parent_id="p", page_depth=1)).collect()
    assert (d.comment_id, d.parent_comment_id, d.depth, d.reactions) == ("c", "p", 1, 4)


def test_tweets(spark):
    post = {"id": "10", "text": "t", "public_metrics": {"like_count": 5, "retweet_count": 2, "reply_count": 3, "quote_count": 1}, "referenced_tweets": [{"type": "replied_to", "id": "1"}, {"type": "quoted", "id": "8"}], "non_public_metrics": {"impression_count": 90}}
    (p,) = payloads.tweet_posts(landed(spark, post), "acc").collect()
    assert (p.post_id, p.shares, p.forwards, p.views, p.propagation_kind, p.origin_post_id, json.loads(p.reaction_breakdown_json)["like"]) == ("x:acc:10", 2, 1, 90, "quote", "x:origin:8", 5)
    replies = [{"id": "10", "conversation_id": "10", "text": "root"}, {"id": "11", "conversation_id": "10", "referenced_tweets": [{"type": "replied_to", "id": "10"}]}, {"id": "12", "conversation_id": "10", "referenced_tweets": [{"type": "replied_to", "id": "11"}]}, {"id": "13", "conversation_id": "10"}]
    got = payloads.tweet_replies(landed(spark, *replies), "acc")
    assert {r.comment_id: r.tree_depth for r in comment_depths(got).collect()} == {"x:acc:10:comment:11": 0, "x:acc:10:comment:12": 1}


def test_telegram(spark):
    rows = [{"id": 1, "date": 1774353600, "message": "m", "reactions": {"👍": 3, "❤": 2}, "media": "MessageMediaPhoto"}, {"id": 2, "action": "pinned"}, {"id": 3, "fwd_from": {"peer_id": "55", "channel_post": 6}}, {"id": 4, "fwd_from": {"from_name": "N"}}]
    got = {r.post_id: r for r in payloads.telegram_messages(landed(spark, *rows), "c", "name").collect()}
    assert sorted(got) == ["telegram:c:1", "telegram:c:3", "telegram:c:4"] and got["telegram:c:1"].reactions == 5 and got["telegram:c:1"].media_type == "photo" and got["telegram:c:1"].created_at == "2026-03-24T12:00:00+00:00"
    assert got["telegram:c:3"].origin_post_id == "telegram:55:6" and got["telegram:c:4"].origin_post_id == "telegram:origin:N"
    assert payloads.service_messages(landed(spark, *rows)).first()[0] == 1
    thread = [{"id": 5, "reply_to_msg_id": 1}, {"id": 6, "reply_to_msg_id": 5, "reply_to_top_id": 1}, {"id": 7, "reply_to_msg_id": 2}]
    assert {(r.comment_id, r.parent_comment_id) for r in payloads.telegram_thread(landed(spark, *thread), "d", 1, "p").collect()} == {("telegram:d:5", None), ("telegram:d:6", "telegram:d:5")}
    updates = [{"update_id": 1, "channel_post": {"message_id": 8, "text": "a"}}, {"update_id": 2, "edited_channel_post": {"message_id": 9, "caption": "b"}}, {"update_id": 3, "message": {"message_id": 10, "is_automatic_forward": True}}, {"update_id": 4}]
    assert sorted((r.post_id, r.message) for r in payloads.bot_updates(landed(spark, *updates), "c").collect()) == [("telegram:c:8", "a"), ("telegram:c:9", "b")]


def test_threads_and_instagram(spark):
    rows = [{"id": "1", "text": "a", "has_replies": True}, {"id": "2", "reposted_post": {"id": "7"}}, {"id": "3", "is_quote_post": True, "quoted_post": {"id": "8"}}]
    got = {r.post_id[-1]: r for r in payloads.threads_posts(landed(spark, *rows), "s").collect()}
    assert (got["1"].comments_count, got["2"].shares, got["2"].propagation_kind, got["3"].propagation_kind, got["3"].origin_post_id) == (1, 1, "repost", "quote", "threads:origin:8")
    post = {"id": "9", "media_type": "CAROUSEL_ALBUM", "children": {"data": [{"id": "x", "media_type": "IMAGE", "media_url": "u"}]}, "comments": {"data": [{"id": "c1", "text": "t", "replies": {"data": [{"id": "c2", "text": "r"}]}}]}}
    (p,) = payloads.instagram_posts(landed(spark, post), "s").collect()
    assert [m.media_id for m in p.media_refs] == ["instagram:s:9:media:1", "instagram:s:9:media:2"]
    assert sorted((r.comment_id, r.depth) for r in payloads.instagram_comments(landed(spark, post), "s").collect()) == [("instagram:s:9:comment:c1", 0), ("instagram:s:9:comment:c2", 1)]


def test_web_posts(spark):
    rows = spark.createDataFrame([(0, "https://x.com/Acc/status/5?s=1", "@ACC", "t", "h", "1.2K", "3", "", "10 views"), (1, "https://x.com/Acc/status/5", "acc", "later", "h", "", "", "", ""), (2, "https://x.com/o/status/6", "other", "t", "h", "", "", "", "")], "pos int, permalink string, author string, text string, published_hint string, likes string, replies string, reposts string, views string")
    (p,) = payloads.web_posts(rows, "x", "@acc").collect()
    assert (p.message, p.reactions, p.comments_count, p.views) == ("t", 1200, 3, 10)
    counted = payloads.with_comment_counts(payloads.web_posts(rows, "x", "@acc"), spark.createDataFrame([(p.post_id,)] * 5, "parent_post_id string"))
    assert counted.first().comments_count == 5
