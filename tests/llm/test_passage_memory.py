"""Tasks of the passage steps take a bounded amount of text at once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import bytesops, packing, passages, suffix_dedup

SPEC = passages.Spec(False, 50, 16)


class Table:
    """Stands for DataFrames of which only the task's function is wanted."""

    def drop(self, *names):
        return self

    def select(self, *names):
        return self

    def join(self, *others):
        return self


@pytest.mark.parametrize("step", ["seeds", "gather"])
def test_a_large_arrow_batch_is_combined_in_parts(monkeypatch, step):
    emits, sizes, combined, table = [], [], passages.combined, Table()
    monkeypatch.setattr(passages, "arrow_map", lambda df, f, schema: emits.append(f))
    monkeypatch.setattr(passages, "returned", lambda dealt, judge: table)
    monkeypatch.setattr(passages, "combined", lambda e, data, *rest: sizes.append(len(data)) or combined(e, data, *rest))
    how = passages.Judge(SPEC, True, suffix_dedup.resolve, 1 << 17)
    draw = random.Random(5)
    texts = ["".join(draw.choices("abcdefghij ", k=100_000)) for _ in range(40)]
    columns = {"rank": pa.array(np.arange(40)), "th": pa.array(np.arange(40)), "text": pa.array(texts)}
    if step == "seeds":
        passages.seeds(table, 4, how)
    else:
        passages.gather(table, table, 4, how)
        columns["ask"] = pa.array([np.array([0, 1], "<u4").tobytes() if i else b"" for i in range(40)], pa.binary())
        # The piece that begins at 0 is asked for.
    rows = sum(b.num_rows for b in emits[0](iter([pa.RecordBatch.from_pydict(columns)])))
    assert rows > 0 and sum(sizes) == 4_000_000
    assert max(sizes) <= passages.BATCH * 3 // 2


def test_joined_rows_let_go_of_their_batches():
    row = {"rank": [np.array([7], "<i8").tobytes()], "th": [np.array([8], "<i8").tobytes()], "doc": [np.zeros(3, "<u4").tobytes()], "known": [False], "size": [b""], "blob": [b""],
           "lo": [np.array([1, 2, 3], "<u4").tobytes()]}
    held = [pa.RecordBatch.from_pydict(row)] * 2
    got = passages.unpacked(passages.drained(held), {"lo": "<u4"})
    assert held == [] and got["lo"].tolist() == [1, 2, 3, 1, 2, 3] and got["rank"].tolist() == [7] * 6


def test_another_operator_s_task_drops_the_packing_codec():
    runs = []

    class Frame:
        def mapInArrow(self, run, schema):
            runs.append(run)

    def other(rows):
        yield from rows

    packing.codec(packing.TOKENIZER, packing.PATTERN)
    assert packing.codec.cache_info().currsize == 1
    bytesops.arrow_map(Frame(), other, "")
    list(runs[0](iter([])))
    assert packing.codec.cache_info().currsize == 0
