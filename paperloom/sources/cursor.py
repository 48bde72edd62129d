"""A service's change feed as a streaming source: the opaque cursor is the offset, and a page is a micro-batch."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import NamedTuple, Protocol

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

PAGE_SIZE, PAGES_A_RUN = 100, 100
CHANGE = "sequence long, entity_type string, entity_id string, version long, content_hash string"


class Page(NamedTuple):
    """Changes as tuples of ``CHANGE``, the cursor after them, whether more follow, and a snapshot's id where one is read."""

    changes: list[tuple]
    next_cursor: str
    has_more: bool
    snapshot_id: str | None = None


class Transport(Protocol):
    """What reads the service.  The same cursor gives the same page until it is acknowledged."""

    def pull(self, cursor: str | None, limit: int) -> Page: ...

    def acknowledge(self, cursor: str) -> None: ...


class PageLimitExceeded(RuntimeError):
    """A run has pulled as many pages as it may and more follow."""


class SnapshotChanged(RuntimeError):
    """A page belongs to another snapshot than the pages before it."""


class _Reader(SimpleDataSourceStreamReader):
    """Offsets are {cursor, snapshot}; a page is at most ``PAGE_SIZE`` changes, so it may pass through the driver."""

    def __init__(self, transport: Transport, pages_a_run: int):
        self.transport, self.left = transport, pages_a_run
        self.more = True

    def initialOffset(self) -> dict:
        return {"cursor": None, "snapshot": None}

    def _pull(self, start: dict) -> Page:
        page = self.transport.pull(start["cursor"], PAGE_SIZE)
        if start["snapshot"] is not None and page.snapshot_id != start["snapshot"]:
            raise SnapshotChanged(f"{page.snapshot_id} after {start['snapshot']}")
        if not page.next_cursor:
            raise ValueError("a page needs a next cursor")
        return page

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not self.more:
            return iter(()), start
        if self.left <= 0:
            raise PageLimitExceeded("more pages follow")
        page = self._pull(start)
        self.left -= 1
        self.more = page.has_more
        return iter(page.changes), {"cursor": page.next_cursor, "snapshot": page.snapshot_id}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        page = self._pull(start)
        if page.next_cursor != end["cursor"]:
            raise ValueError("the page after this cursor is another one now")
        return iter(page.changes)

    def commit(self, end: dict) -> None:
        if end["cursor"] is not None:
            self.transport.acknowledge(end["cursor"])


class ChangeFeed(DataSource):
    """``spark.dataSource.register(ChangeFeed)``, then ``readStream.format("change_feed")``.

    Options: transport, "module:class" of a ``Transport`` that takes the
    options; pages_a_run (100), after which a feed with more pages fails.
    """

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return CHANGE

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        module, _, name = self.options["transport"].partition(":")
        transport = getattr(importlib.import_module(module), name)(dict(self.options))
        return _Reader(transport, int(self.options.get("pages_a_run", PAGES_A_RUN)))
