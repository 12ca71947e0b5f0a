"""A data source that pushes rows to a service in batches: `df.write.format("quillstone_push").options(...)`.

Each task sends its rows in batches through a client.  A batch that fails is tried
again after a growing pause; one that the service refuses (no permission, bad
credentials) isn't.  Three refused batches in a row open the breaker: the task fails, and
the write is aborted instead of wearing the service down.  Pushes replace rows by
their id, so a task that is run again does no harm.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a message says when the service refuses for good.
REFUSALS = ("401", "403", "invalid credentials", "access denied")
#: Failed ids that a task tells the driver of.
TOLD = 100


class BreakerOpen(RuntimeError):
    """Several batches in a row were refused."""


@dataclass
class Outcome(WriterCommitMessage):
    """A task's batches: rows pushed and failed, tries, and some failed ids with their message."""

    pushed: int = 0
    failed: int = 0
    tries: int = 0
    told: list[tuple[str, str]] = field(default_factory=list)


def refused(message: str) -> bool:
    return any(x in message.lower() for x in REFUSALS)


def send(rows: list[dict], push: Callable[[list[dict]], None], retries: int, pause: float, outcome: Outcome, wait: Callable[[float], None] = time.sleep) -> str | None:
    """Push a batch; None if it went through, else the last message."""
    message = None
    for attempt in range(1, retries + 1):
        outcome.tries += 1
        try:
            push(rows)
            return None
        except Exception as e:
            message = str(e).strip() or type(e).__name__
        if refused(message) or attempt == retries:
            break
        wait(pause * attempt)
    return message


def push_rows(batches: Iterator[pa.RecordBatch], push: Callable[[list[dict]], None], id_col: str, batch_rows: int = 20, retries: int = 3, pause: float = 0.5, breaker: int = 3,
              wait: Callable[[float], None] = time.sleep) -> Outcome:
    """Push all rows, batch by batch; raises BreakerOpen after `breaker` refused batches in a row."""
    out, in_a_row = Outcome(), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, batch_rows):
            rows = batch.slice(lo, batch_rows).to_pylist()
            message = send(rows, push, retries, pause, out, wait)
            if message is None:
                out.pushed += len(rows)
                in_a_row = 0
                continue
            out.failed += len(rows)
            out.told += [(str(r[id_col]), message) for r in rows[:TOLD - len(out.told)]]
            in_a_row = in_a_row + 1 if refused(message) else 0
            if in_a_row >= breaker:
                raise BreakerOpen(f"{breaker} batches in a row were refused: {message}")
    return out


class PushWriter(DataSourceArrowWriter):
    """Options: client (module:factory; the factory gets the options and returns a function of a list of rows), id, batch, retries, pause, breaker, strict, done."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Outcome:
        o = self.options
        module, _, factory = o["client"].partition(":")
        push = getattr(importlib.import_module(module), factory)(o)
        return push_rows(iterator, push, o.get("id", "id"), int(o.get("batch", 20)), int(o.get("retries", 3)), float(o.get("pause", 0.5)), int(o.get("breaker", 3)))

    def commit(self, messages: list[Outcome | None]) -> None:
        """All tasks are done: with strict=true failed rows make the write fail; else `done` (module:function) is told the totals."""
        total = Outcome()
        for m in messages:
            if m is not None:
                total.pushed, total.failed, total.tries = total.pushed + m.pushed, total.failed + m.failed, total.tries + m.tries
                total.told += m.told[:TOLD - len(total.told)]
        if total.failed and self.options.get("strict", "false") == "true":
            raise RuntimeError(f"{total.failed} rows weren't pushed: {total.told[:3]}")
        self.tell("committed", total)

    def abort(self, messages: list[Outcome | None]) -> None:
        self.tell("aborted", Outcome(pushed=sum(m.pushed for m in messages if m is not None)))

    def tell(self, how: str, total: Outcome) -> None:
        if "done" in self.options:
            module, _, name = self.options["done"].partition(":")
            getattr(importlib.import_module(module), name)(self.options, how, total)


class PushSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillstone_push"

    def writer(self, schema: StructType, overwrite: bool) -> PushWriter:
        return PushWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PushSource)
