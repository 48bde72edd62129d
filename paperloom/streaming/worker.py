"""One pass of an exchange with a service: pull and acknowledge pages, rebuild where the cursor has expired, send and settle a batch."""

from __future__ import annotations

from typing import NamedTuple, Protocol

from pyspark.sql import Row

from ..operators.settle import OUTCOME, REMOTE, Exchanged
from ..sources.cursor import PAGE_SIZE, PAGES_A_RUN, Page, PageLimitExceeded, SnapshotChanged

WITH_ORDER = f"{REMOTE}, at long"


class CursorExpired(Exception):
    """The service no longer has the changes after a cursor."""


class TransportFailed(Exception):
    """The service could not be reached or refused; ``code`` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


class Transport(Protocol):
    """The service.  Pages hold at most ``limit`` changes, as tuples of ``REMOTE``; a snapshot's pages have one id."""

    def pull(self, cursor: str | None, limit: int) -> Page: ...

    def snapshot(self, cursor: str | None, limit: int) -> tuple[Page, str]: ...

    def acknowledge(self, cursor: str) -> None: ...

    def push(self, operations: list[Row]) -> list[tuple]: ...


class Report(NamedTuple):
    pulled: int = 0
    pushed: int = 0
    rebuilt: bool = False
    deferred: str | None = None


def _frame(kept: Exchanged, changes: list[tuple], first: int = 1):
    return kept.store.spark.createDataFrame([(*c, first + k) for k, c in enumerate(changes)], WITH_ORDER)


def _pull(kept: Exchanged, transport: Transport, owner: str, now: int) -> int:
    cursor, pulled = kept.store.manifest()["facts"].get("acknowledged_cursor"), 0
    for _ in range(PAGES_A_RUN):
        page = transport.pull(cursor, PAGE_SIZE)
        kept.receive(_frame(kept, page.changes), page.next_cursor, now, owner)
        pulled += len(page.changes)
        transport.acknowledge(page.next_cursor)
        kept.acknowledge()
        if not page.has_more:
            return pulled
        cursor = page.next_cursor
    raise PageLimitExceeded("more pages follow")


def _rebuild(kept: Exchanged, transport: Transport, owner: str, now: int) -> None:
    """All pages of one snapshot, staged apart, then swapped in at once."""
    cursor, snapshot, staged, first = None, None, None, 1
    for _ in range(PAGES_A_RUN):
        page, resume = transport.snapshot(cursor, PAGE_SIZE)
        if snapshot not in (None, page.snapshot_id):
            raise SnapshotChanged(f"{page.snapshot_id} after {snapshot}")
        snapshot = page.snapshot_id
        own = _frame(kept, page.changes, first)
        staged = own if staged is None else staged.union(own)
        first += len(page.changes)
        if not page.has_more:
            kept.rebuild(staged, resume, now, owner)
            transport.acknowledge(resume)
            kept.acknowledge()
            return
        cursor = page.next_cursor
    raise PageLimitExceeded("more pages follow")


def run_once(kept: Exchanged, transport: Transport, owner: str, now: int, new_batch: str) -> Report:
    """One bounded pass.  Each step is a commit, so a pass that ends anywhere goes on from there the next time.

    A page that was received but not acknowledged comes again and changes
    nothing; a batch that was sent without an answer is sent again as it was.
    """
    pulled, rebuilt = 0, False
    try:
        pulled = _pull(kept, transport, owner, now)
    except CursorExpired:
        _rebuild(kept, transport, owner, now)
        rebuilt = True
    except TransportFailed as e:
        return Report(deferred=e.code)
    batch = kept.prepare(owner, now, new_batch).collect()  # at most 100 operations
    if not batch:
        return Report(pulled, 0, rebuilt)
    name = batch[0]["batch_id"]
    try:
        outcomes = transport.push(batch)
    except TransportFailed as e:
        kept.retry(name, e.code, now)
        return Report(pulled, 0, rebuilt, e.code)
    kept.settle(name, kept.store.spark.createDataFrame(outcomes, OUTCOME), now)
    return Report(pulled, len(outcomes), rebuilt)
