"""Queues of numbered updates as a Spark data source: read in partitions, as a batch or a stream, and acknowledged by offset.

An offset is the number of the next update. A stream keeps it in its checkpoint, so what a stopped stream has read is neither lost nor read again;
the queue itself is told only what whole batches have delivered. Without a checkpoint, reading begins where the queue was last acknowledged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "update_id BIGINT, payload STRING"


@dataclass
class Span(InputPartition):
    """The updates from `start` on, before `end`; `page` says where they are, if the queue has pages."""

    start: int
    end: int
    page: str | None = None


class Queue(Protocol):
    """What a source of updates has to offer. Updates have whole numbers that only grow."""

    def bounds(self) -> tuple[int, int]:
        """The first update that isn't acknowledged, and the number behind the last one."""

    def spans(self, start: int, end: int) -> Sequence[Span]:
        """Spans that hold each update from start to end once; each becomes a task."""

    def fetch(self, span: Span) -> Iterator[tuple[int, str]]:
        """(number, payload) of a span's updates."""

    def acknowledge(self, end: int) -> None:
        """All updates before `end` were delivered."""


class LandedPages:
    """A queue over a folder of landed pages, named PREFIX-FIRST-LAST.json after their updates' numbers, in any store that Arrow knows.

    A page holds an answer of the update API: {"result": [{"update_id": ..., ...}, ...]}, all updates that there were from its first to its last.
    Of pages that overlap, each update is read from the one that begins first. Only names are listed to plan; pages are read by tasks. What was
    acknowledged is kept in the file `acknowledged`.
    """

    MARK = "acknowledged"

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def _pages(self) -> list[Span]:
        fs, at = self._open()
        named = ((re.search(r"-(\d+)-(\d+)\.json$", x.base_name), x.path) for x in fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True)))
        pages = sorted((int(m[1]), -int(m[2]), path) for m, path in named if m)
        out, covered = [], 0
        for first, last, path in pages:
            if -last + 1 > covered:
                out.append(Span(max(first, covered), -last + 1, path))
                covered = -last + 1
        return out

    def bounds(self) -> tuple[int, int]:
        fs, at = self._open()
        mark = f"{at}/{self.MARK}"
        done = 0
        if fs.get_file_info(mark).type == pyarrow.fs.FileType.File:
            with fs.open_input_stream(mark) as f:
                done = int(f.read())
        pages = self._pages()
        return max(done, pages[0].start if pages else 0), max([done, *(p.end for p in pages)])

    def spans(self, start: int, end: int) -> list[Span]:
        cut = (Span(max(start, p.start), min(end, p.end), p.page) for p in self._pages())
        return [p for p in cut if p.start < p.end]

    def fetch(self, span: Span) -> Iterator[tuple[int, str]]:
        fs, _ = self._open()
        with fs.open_input_stream(span.page) as f:
            updates = json.loads(f.read()).get("result") or []
        seen = set()
        for update in updates:
            number = int(update.get("update_id") or 0)
            if span.start <= number < span.end and number not in seen:
                seen.add(number)
                yield number, json.dumps(update, ensure_ascii=False)

    def acknowledge(self, end: int) -> None:
        if end > self.bounds()[0]:
            fs, at = self._open()
            with fs.open_output_stream(f"{at}/{self.MARK}.next") as f:
                f.write(str(end).encode())
            fs.move(f"{at}/{self.MARK}.next", f"{at}/{self.MARK}")


class _Batch(DataSourceReader):
    def __init__(self, queue: Queue):
        self.queue = queue

    def partitions(self) -> Sequence[Span]:
        return self.queue.spans(*self.queue.bounds()) or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple[int, str]]:
        return self.queue.fetch(partition) if partition.start < partition.end else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, queue: Queue, consume: bool):
        self.queue, self.consume = queue, consume

    def initialOffset(self) -> dict:
        return {"next": self.queue.bounds()[0]}

    def latestOffset(self) -> dict:
        return {"next": self.queue.bounds()[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[Span]:
        return list(self.queue.spans(start["next"], end["next"]))

    def read(self, partition: Span) -> Iterator[tuple[int, str]]:
        return self.queue.fetch(partition)

    def commit(self, end: dict) -> None:
        if self.consume:
            self.queue.acknowledge(end["next"])


def register(spark: SparkSession, name: str = "updates", queue: Callable[[dict], Queue] = lambda options: LandedPages(options["path"])) -> None:
    """Makes `name` a format of spark.read and spark.readStream, over the queue that is made of a reader's options: by default pages below `path`.
    With the option consume=true a stream acknowledges what it has delivered."""

    class Updates(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Batch(queue(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(queue(self.options), str(self.options.get("consume", "false")).lower() == "true")

    spark.dataSource.register(Updates)
