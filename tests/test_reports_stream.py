"""Report states over a stream: the same states as the batch operator, state across restarts, files that vanish."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from quillstone.operators import sourcing
from quillstone.streaming import reports

START = datetime(2024, 1, 1)


def sighting(path: str, sha: str, day: int, n: int = 3, product: str | None = "p"):
    return path, sha, n, product, START + timedelta(days=day)


class Replay:
    """Writes sightings as files and runs the stream over what is new."""

    def __init__(self, spark, tmp_path):
        self.spark, self.base, self.n = spark, tmp_path, 0

    def run(self, rows, absent_days: int = 7) -> list[tuple]:
        self.n += 1
        self.spark.createDataFrame(rows, reports.SIGHTING).coalesce(1).write.parquet(f"{self.base}/in/{self.n}")
        source = self.spark.readStream.schema(reports.SIGHTING).option("recursiveFileLookup", True).parquet(f"{self.base}/in")
        out = reports.report_stream(source, absent_days * 24 * 3600 * 1000)
        query = out.writeStream.format("parquet").option("path", f"{self.base}/out").option("checkpointLocation", f"{self.base}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        seen = self.spark.read.schema("relative_path string, seen_at timestamp, status string").parquet(f"{self.base}/out").collect()
        return sorted((r["relative_path"], r["status"]) for r in seen)


@pytest.fixture
def replay(spark, tmp_path):
    return Replay(spark, tmp_path)


def test_states_agree_with_the_batch_operator(spark, replay):
    first = [sighting("a", "1", 0), sighting("b", "1", 0, product=None), sighting("c", "1", 0, n=0), sighting("d", "1", 0)]
    assert replay.run(first) == [("a", "success"), ("b", "unmatched"), ("c", "extract_failed"), ("d", "success")]
    second = [sighting("a", "1", 1), sighting("b", "1", 1), sighting("c", "2", 1, n=0), sighting("d", "2", 1), sighting("e", "9", 1)]
    got = replay.run(second)
    kept = spark.createDataFrame([("a", "1"), ("d", "1")], "relative_path string, processed_sha1 string")
    files = spark.createDataFrame([(p, s, n) for p, s, n, _, _ in second], "relative_path string, source_sha1 string, n_docs int")
    matched = spark.createDataFrame([(p, m) for p, _, _, m, _ in second if m], "relative_path string, product_id string")
    want = sorted((r["relative_path"], r["status"]) for r in sourcing.report_states(files, kept, matched).collect())
    assert want == [("a", "skipped_unchanged"), ("b", "success"), ("c", "extract_failed"), ("d", "changed"), ("e", "success")]
    assert got == sorted([("a", "success"), ("b", "unmatched"), ("c", "extract_failed"), ("d", "success"), *want])


def test_sightings_of_one_batch_follow_their_times(replay):
    rows = [sighting("a", "2", 2), sighting("a", "1", 0), sighting("a", "1", 1), sighting("a", "1", 3)]
    assert replay.run(rows) == [("a", "changed"), ("a", "skipped_unchanged"), ("a", "skipped_unchanged"), ("a", "success")]


def test_a_file_that_is_not_seen_vanishes_and_starts_anew(replay):
    replay.run([sighting("a", "1", 0), sighting("b", "1", 0)])
    replay.run([sighting("b", "1", 9)])
    got = replay.run([sighting("b", "1", 10)])  # the watermark has passed a's week
    assert ("a", "vanished") in got and ("b", "vanished") not in got
    assert got.count(("b", "skipped_unchanged")) == 2
    assert ("a", "success") in replay.run([sighting("a", "2", 11)])
    assert replay.run([sighting("b", "1", 11)]).count(("a", "success")) == 2
