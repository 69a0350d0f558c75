"""Batch borders inside an anchor lose no link."""

import pyarrow as pa
import pytest

from plumewatch.llm import simhash


@pytest.mark.parametrize("rows", (1, 2, 3))
def test_anchor_cut_by_batch_borders(rows):
    h, x = 8, 9
    whole = pa.RecordBatch.from_arrays(
        [pa.array([5, 5, 5], pa.int64()), pa.array([0, 0, 0], pa.int32()), pa.array([0, 1, 1], pa.int8()),
         pa.array([h, h, x], pa.int64())], names=["key", "chunk", "role", "print"])
    cut = [whole.slice(at, rows) for at in range(0, 3, rows)]
    found = [p for b in simhash._compare(cut) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert {frozenset(p) for p in found} == {frozenset((h, x))}
