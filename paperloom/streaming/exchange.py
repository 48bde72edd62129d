"""Remote changes and the local queue as one keyed state: what each change does to the baseline and to open operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ("entity_type", "entity_id")
#: side is local (an operation: operation_id, base_version, base_hash, content_hash of its payload) or remote (kind, version, content_hash);
#: at orders the rows of an entity over both sides.
INPUT = "entity_type string, entity_id string, at long, side string, operation_id string, kind string, version long, base_version long, base_hash string, content_hash string"
#: What was there before: a row with the baseline (version, content_hash; side remote), and one for each open operation, latest last (side local).
INITIAL = INPUT
OUTPUT = "entity_type string, entity_id string, at long, outcome string, decision string, operation_id string, reason string, base_known boolean"
_BASE = "version long, content_hash string"
_OPEN = "at long, operation_id string, base_version long, base_hash string, content_hash string"


def _maybe(value):
    return None if pd.isna(value) else value


class Exchange(StatefulProcessor):
    """State of an entity: the remote baseline, and its operations that are not settled, in order.

    A remote change below the baseline's version, or the same, is ignored; the
    same version with another hash is corrupt.  Any other is applied: if the
    latest open operation has its hash, that is settled; else it conflicts,
    and stays open, so that the next change meets it again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", _BASE)
        self.open = handle.getListState("open", _OPEN)

    def _load(self) -> tuple[tuple | None, list[tuple]]:
        return (tuple(self.base.get()) if self.base.exists() else None), ([tuple(x) for x in self.open.get()] if self.open.exists() else [])

    def _store(self, base: tuple | None, waiting: list[tuple]) -> None:
        if base:
            self.base.update(base)
        if waiting:
            self.open.put(waiting)
        else:
            self.open.clear()

    @staticmethod
    def _operation(r) -> tuple:
        version = _maybe(r.base_version)
        return int(r.at), r.operation_id, None if version is None else int(version), _maybe(r.base_hash), _maybe(r.content_hash)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        base, waiting = self._load()
        for r in initialState.sort_values("at").itertuples():
            if r.side == "remote":
                base = int(r.version), r.content_hash
            else:
                waiting.append(self._operation(r))
        self._store(base, waiting)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base, waiting = self._load()
        out = []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():  # a micro-batch's rows of one entity
            if r.side == "local":
                waiting.append(self._operation(r))
                continue
            version, decision, operation, reason, known = int(r.version), None, None, None, None
            if base and base[0] > version or base == (version, r.content_hash):
                outcome = "ignored"
            elif base and base[0] == version:
                outcome = "corrupt"
            else:
                outcome = "applied"
                if waiting:
                    last = waiting[-1]
                    operation = last[1]
                    if last[4] == r.content_hash:
                        decision = "settle"
                        waiting.pop()
                    else:
                        decision = "conflict"
                        reason = "tombstoneDivergence" if r.kind == "delete" else "divergentContent"
                        known = base is not None and base == last[2:4]
                base = version, r.content_hash
            out.append((*key, int(r.at), outcome, decision, operation, reason, known))
        self._store(base, waiting)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def received(events: DataFrame, initial: DataFrame | None = None, output_mode: str = "append") -> DataFrame:
    """A row for each remote change of a stream or table of ``INPUT``, with what it does; local rows have none.

    initial (``INITIAL``) is a snapshot: the baselines and open operations
    before the first row.  Within a micro-batch an entity's rows are taken in
    order of ``at``; a later micro-batch comes after, whatever its ``at``.
    Streams need the RocksDB state store.
    """
    assert events.sparkSession.streams is not None  # the session's stream manager keeps the state's stores, of a table too
    start = None if initial is None else initial.groupBy(*KEY)
    return events.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=Exchange(), outputStructType=OUTPUT, outputMode=output_mode, timeMode="None", initialState=start
    )


def snapshot(baselines: DataFrame, queue: DataFrame, *key: str) -> DataFrame:
    """``INITIAL`` rows of a stored baseline and a queue (operation_id, created_at, state, payload_hash, base_version, base_hash)."""
    fields = [f.split() for f in INITIAL.split(", ")]

    def shaped(df: DataFrame, **given) -> DataFrame:
        return df.select([given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])

    kind, entity = key or KEY
    own = {"entity_type": F.col(kind), "entity_id": F.col(entity)}
    base = shaped(baselines, **own, at=F.lit(0), side=F.lit("remote"), version=F.col("version"), content_hash=F.col("content_hash"))
    open_ = shaped(
        queue.where("state <> 'settled'"), **own, at=F.col("created_at"), side=F.lit("local"), operation_id=F.col("operation_id"),
        base_version=F.col("base_version"), base_hash=F.col("base_hash"), content_hash=F.col("payload_hash"),
    )
    return base.union(open_)
