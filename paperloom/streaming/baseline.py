"""The remote baseline as a stream: each key's highest version, updated by ordered micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "entity_id long, version long, content_hash string, applied long, ignored long, corrupt long"


def _apply(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version, content_hash, applied, ignored, corrupt = state.get if state.exists else (0, None, 0, 0, 0)
    rows = pd.concat(list(frames)).sort_values("sequence")
    for v, h in zip(rows["version"].tolist(), rows["content_hash"].tolist(), strict=True):
        if v > version:
            version, content_hash, applied = v, h, applied + 1
        elif v == version and h != content_hash:
            corrupt += 1
        else:
            ignored += 1
    state.update((version, content_hash, applied, ignored, corrupt))
    yield pd.DataFrame([(key[0], version, content_hash, applied, ignored, corrupt)], columns=[f.split()[0] for f in OUT.split(", ")])


def baseline_stream(changes: DataFrame) -> DataFrame:
    """The baseline of each key after each micro-batch, in update mode.

    changes: entity_id long, sequence, version long, content_hash; order
    within a micro-batch is by sequence, and lateness is by version alone, so
    no watermark is needed.  State is one row a key.
    """
    return (
        changes.select("entity_id", "sequence", "version", "content_hash")
        .groupBy("entity_id")
        .applyInPandasWithState(
            _apply,
            OUT,
            "version long, content_hash string, applied long, ignored long, corrupt long",
            "update",
            GroupStateTimeout.NoTimeout,
        )
    )
