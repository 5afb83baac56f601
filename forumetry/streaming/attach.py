"""Comments of a stream that wait for their thread's post: keyed state across batches and restarts.

A post is known from the batch that brings it on. A comment is attached if its thread's post has a smaller ordinal, however their rows are spread
over tasks and batches. One whose post isn't known yet waits until the stream's time has gone on by as much as it is told to, and is then dropped;
without waiting it is dropped with its batch. Time is that of the events, so a stream that is run again decides alike. State lives in the
checkpoint: a stream that is stopped between a comment and its post goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a stream needs to keep such state.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENTS = "thread STRING, ord BIGINT, at TIMESTAMP, post_id STRING, body STRING"
ATTACHED = "thread STRING, ord BIGINT, post_id STRING, body STRING"


class Attach(StatefulProcessor):
    """Per thread: the post of least ordinal, and the comments that came before any post."""

    def __init__(self, waits: bool):
        self.waits = waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.post = handle.getValueState("post", "ord BIGINT, post_id STRING")
        self.waiting = handle.getListState("waiting", "ord BIGINT, at BIGINT, body STRING")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.post.get() if self.post.exists() else None
        first, times = known, set()
        for row in rows:
            if row.post_id is not None:
                first = min(first or (row.ord, row.post_id), (row.ord, row.post_id))
            else:
                # not attached before all of the batch's posts were seen
                self.waiting.appendValue((row.ord, row.ms, row.body))
                times.add(row.ms)
        if first is None:
            if not self.waits:
                self.waiting.clear()
            for ms in times if self.waits else ():
                self.handle.registerTimer(ms)
            return
        if first != known:
            self.post.update(tuple(first))
        for ord_, _, body in self.waiting.get() if self.waiting.exists() else ():
            if first[0] < ord_:
                yield Row(thread=key[0], ord=ord_, post_id=first[1], body=body)
        self.waiting.clear()
        for timer in list(self.handle.listTimers()) if self.waits else ():
            self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = expiredTimerInfo.getExpiryTimeInMs()
        left = [w for w in (self.waiting.get() if self.waiting.exists() else ()) if w[1] > over]
        self.waiting.put([tuple(w) for w in left]) if left else self.waiting.clear()
        return iter(())

    def close(self) -> None:
        pass


def attached(events: DataFrame, wait: timedelta = timedelta(0)) -> DataFrame:
    """(thread, ord, post_id, body) of the comments in a stream of EVENTS that have a post; rows with a post_id are posts. The order of a thread is
    that of `ord`; `at` is an event's time. A comment waits for its post until some event is later by more than `wait`; posts that come later than
    that after events which are so much younger are late themselves. Rows without thread, ord or (where comments wait) time are left out."""
    spark = events.sparkSession
    if spark.conf.get(STATE_STORE[0], "") != STATE_STORE[1]:
        raise ValueError(f"keyed state needs {STATE_STORE[0]}={STATE_STORE[1]}")
    known = events.where("thread IS NOT NULL AND ord IS NOT NULL")
    waits = wait > timedelta(0)
    if waits:
        known = known.where("at IS NOT NULL").withWatermark("at", f"{wait // timedelta(milliseconds=1)} milliseconds")
    known = known.select("thread", "ord", "at", "post_id", "body", F.coalesce(F.unix_millis("at"), F.lit(0)).alias("ms"))
    return known.groupBy("thread").transformWithState(Attach(waits), ATTACHED, "append", "eventTime" if waits else "none")


def bot_events(updates: DataFrame, source: str, discussion: str) -> DataFrame:
    """EVENTS of a bot's updates (update_id, payload): posts of the source's channel, and messages of its discussion chat as comments."""
    from forumetry.sources.webitems import bot_messages

    posts, said = bot_messages(updates, source, discussion)
    body = F.to_json("m")
    thread, none = F.col("thread").cast("string").alias("thread"), F.lit(None).cast("string")
    as_posts = posts.select(thread, "ord", F.timestamp_seconds("date").alias("at"), "post_id", none.alias("body"))
    as_comments = said.select(thread, "ord", F.timestamp_seconds("m.date").alias("at"), none.alias("post_id"), body.alias("body"))
    return as_posts.unionByName(as_comments)


def keep_state(spark: SparkSession) -> None:
    """Sets the state store that `attached` needs, for a session of one's own."""
    spark.conf.set(*STATE_STORE)
