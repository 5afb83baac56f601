import json
from datetime import datetime, timedelta

import pytest

from forumetry.operators.threads import arrived_comments
from forumetry.sources import updates
from forumetry.streaming import attach


def land(folder, *numbers, body=None):
    folder.mkdir(exist_ok=True)
    page = {"result": [{"update_id": n} | (body(n) if body else {}) for n in numbers]}
    (folder / f"updates-{min(numbers)}-{max(numbers)}.json").write_text(json.dumps(page))


@pytest.fixture
def stateful(spark):
    was = spark.conf.get(attach.STATE_STORE[0], None)
    attach.keep_state(spark)
    yield spark
    spark.conf.unset(attach.STATE_STORE[0]) if was is None else spark.conf.set(attach.STATE_STORE[0], was)


def drain(df, out, checkpoint):
    query = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return query


def test_pages_as_a_batch(spark, tmp_path):
    updates.register(spark)
    folder = tmp_path / "pages"
    read = lambda: sorted(r.update_id for r in spark.read.format("updates").load(str(folder)).collect())
    assert read() == []
    land(folder, 5, 6, 8)
    land(folder, 6, 8, 9)  # comes again, with one more
    land(folder, 20)
    assert read() == [5, 6, 8, 9, 20]
    updates.LandedPages(str(folder)).acknowledge(9)
    assert read() == [9, 20]
    updates.LandedPages(str(folder)).acknowledge(3)  # never back
    assert updates.LandedPages(str(folder)).bounds() == (9, 21)


def test_stopping_and_starting_loses_and_repeats_nothing(spark, tmp_path):
    updates.register(spark)
    folder, out, state = tmp_path / "pages", tmp_path / "out", tmp_path / "checkpoint"
    stream = lambda: spark.readStream.format("updates").option("consume", "true").load(str(folder))
    got = lambda at=out: sorted(r.update_id for r in spark.read.parquet(str(at)).collect())
    land(folder, 1, 2, 3)
    drain(stream(), out, state)
    assert got() == [1, 2, 3]
    land(folder, 3, 4)
    land(folder, 5, 6, 7)
    drain(stream(), out, state)
    drain(stream(), out, state)  # nothing new
    assert got() == [1, 2, 3, 4, 5, 6, 7]
    # what whole batches delivered is acknowledged at the latest by the next run; a stream without a checkpoint begins behind it
    begin, end = updates.LandedPages(str(folder)).bounds()
    assert 4 <= begin <= end == 8
    land(folder, 8)
    drain(stream(), tmp_path / "other", tmp_path / "fresh")
    assert got(tmp_path / "other") == list(range(begin, 9))


def test_a_queue_of_ones_own(spark, tmp_path):
    class Numbers:
        def bounds(self):
            return 10, 15

        def spans(self, start, end):
            return [updates.Span(k, k + 1) for k in range(start, end)]

        def fetch(self, span):
            yield span.start, json.dumps({"update_id": span.start})

        def acknowledge(self, end):
            raise AssertionError("not asked for")

    updates.register(spark, "numbers", lambda options: Numbers())
    df = spark.read.format("numbers").load()
    assert df.rdd.getNumPartitions() == 5 and sorted(r.update_id for r in df.collect()) == [10, 11, 12, 13, 14]
    drain(spark.readStream.format("numbers").load(), tmp_path / "out", tmp_path / "checkpoint")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


ROWS = [
    ("a", 1, "post-a", None), ("a", 2, None, "after"), ("b", 3, None, "before its post"), ("b", 5, "post-b", None), ("b", 6, None, "after"), ("c", 7, None, "no post"),
    ("a", 8, None, "much later"), ("a", 9, "post-a", None), ("d", 12, None, "waits"), ("d", 11, "post-d", None), (None, 1, None, "no thread"), ("a", None, None, "no place"),
]
START = datetime(2026, 1, 1)


def events(spark, rows, minute=0):
    return spark.createDataFrame([(t, n, START + timedelta(minutes=minute + (n or 0)), p, b) for t, n, p, b in rows], attach.EVENTS)


def batch(spark, rows):
    df = events(spark, rows)
    posts, comments = df.where("post_id IS NOT NULL").select("thread", "ord", "post_id"), df.where("post_id IS NULL").select("thread", "ord", "body")
    return sorted((r.thread, r.ord, r.post_id, r.body) for r in arrived_comments(posts, comments).collect())


@pytest.mark.parametrize("per_batch", [3, 100])
def test_comments_wait_for_posts_across_restarts(stateful, tmp_path, per_batch):
    spark, landed = stateful, tmp_path / "events"
    stream = lambda: attach.attached(spark.readStream.schema(attach.EVENTS).json(str(landed)), timedelta(hours=1))
    for at in range(0, len(ROWS), per_batch):
        events(spark, ROWS[at : at + per_batch]).coalesce(1).write.mode("append").json(str(landed))
        drain(stream(), tmp_path / "out", tmp_path / "checkpoint")
    got = sorted(tuple(r) for r in spark.read.schema(attach.ATTACHED).parquet(str(tmp_path / "out")).collect())
    assert got == batch(spark, ROWS)


def test_comments_that_do_not_wait_are_dropped_with_their_batch(stateful, tmp_path):
    spark, landed = stateful, tmp_path / "events"
    stream = lambda: attach.attached(spark.readStream.schema(attach.EVENTS).json(str(landed)))
    for rows in ([("d", 12, None, "too early"), ("e", 2, None, "same batch"), ("e", 1, "post-e", None)], [("d", 11, "post-d", None)], [("d", 13, None, "in time")]):
        events(spark, rows).coalesce(1).write.mode("append").json(str(landed))
        drain(stream(), tmp_path / "out", tmp_path / "checkpoint")
    assert sorted(r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["in time", "same batch"]


def test_waiting_ends(stateful, tmp_path):
    spark, landed = stateful, tmp_path / "events"
    stream = lambda: attach.attached(spark.readStream.schema(attach.EVENTS).json(str(landed)), timedelta(minutes=30))
    steps = [([("d", 12, None, "waits too long"), ("f", 14, None, "waits")], 0), ([("x", 1, "post-x", None)], 42.5), ([("d", 11, "post-d", None), ("f", 13, "post-f", None)], 20)]
    for rows, minute in steps:  # the second step's time is 30 minutes behind d's comment, not behind f's
        events(spark, rows, minute).coalesce(1).write.mode("append").json(str(landed))
        drain(stream(), tmp_path / "out", tmp_path / "checkpoint")
    assert [r.body for r in spark.read.schema(attach.ATTACHED).parquet(str(tmp_path / "out")).collect()] == ["waits"]


def test_updates_of_a_bot_on_a_stream(stateful, tmp_path):
    spark = stateful
    updates.register(spark)
    folder = tmp_path / "pages"
    chat = lambda n, kind: {"id": "ch" if kind == "channel" else "d", "type": kind}

    def body(n):
        if n % 10 == 0:
            return {"channel_post": {"message_id": n, "chat": chat(n, "channel"), "date": n, "text": f"post {n}"}}
        return {"message": {"message_id": n, "chat": chat(n, "supergroup"), "message_thread_id": n // 10 * 10, "date": n, "text": f"said {n}"}}

    stream = lambda: attach.attached(attach.bot_events(spark.readStream.format("updates").load(str(folder)), "ch", "d"), timedelta(hours=1))
    for numbers in ([10, 11], [12, 20, 21, 31], [32, 40], [41, 42]):
        land(folder, *numbers, body=body)
        drain(stream(), tmp_path / "out", tmp_path / "checkpoint")
    got = sorted((r.ord, r.post_id) for r in spark.read.schema(attach.ATTACHED).parquet(str(tmp_path / "out")).collect())
    assert got == [(n, f"telegram:ch:{n // 10 * 10}") for n in (11, 12, 21, 41, 42)]
