"""The states of report files over a stream of sightings, with what each file was last processed as kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Columns of a sighting: product_id is the matched product (null: none), n_docs what its text gave.
SIGHTING = "relative_path string, source_sha1 string, n_docs int, product_id string, seen_at timestamp"


def judged(processed: str, sha1: str, product_id: str | None, n_docs: int) -> str:
    """A sighting's state, given the digest the file was processed with (empty: never)."""
    if processed:
        return "skipped_unchanged" if processed == sha1 else "changed"
    if product_id is None or pd.isna(product_id):
        return "unmatched"
    return "success" if n_docs else "extract_failed"


def report_stream(sightings: DataFrame, absent_ms: int = 7 * 24 * 3600 * 1000, late: str = "1 hour") -> DataFrame:
    """(relative_path, seen_at, status) of each sighting, in order of seen_at within a file; and `vanished` once a file isn't seen for `absent_ms`.

    A file is processed when it first succeeds; a changed one is told of and keeps its
    processed digest until it vanishes.  State is one digest and one time a file, kept in
    the state store, so a stream that starts again from its checkpoint goes on.
    """
    def step(key: tuple[str], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        processed, last = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"relative_path": [key[0]], "seen_at": [pd.Timestamp(last, unit="ms")], "status": ["vanished"]})
            return
        seen = pd.concat(list(rows)).sort_values(["seen_at", "source_sha1"], kind="stable")
        told = []
        for r in seen.itertuples(index=False):
            status = judged(processed, r.source_sha1, r.product_id, int(r.n_docs or 0))
            processed = r.source_sha1 if status == "success" else processed
            told.append(status)
        last = max(last, int(seen["seen_at"].iloc[-1].timestamp() * 1000))
        state.update((processed, last))
        state.setTimeoutTimestamp(max(last + absent_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"relative_path": key[0], "seen_at": seen["seen_at"].to_numpy(), "status": told})

    return sightings.withWatermark("seen_at", late).groupBy("relative_path").applyInPandasWithState(
        step, "relative_path string, seen_at timestamp, status string", "processed_sha1 string, last_seen_ms long", "append", GroupStateTimeout.EventTimeTimeout)
