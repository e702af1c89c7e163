"""Memory that tasks give back."""

import numpy as np
import pyarrow as pa
import pytest

from pagetables.llm.common import released


def _resident() -> float:
    with open("/proc/self/status") as status:
        return next(int(line.split()[1]) / 1024 for line in status if line.startswith("VmRSS"))


def test_a_task_gives_its_memory_back():
    """Small blocks stay with the allocator, below one that is still in use, unless they are released."""
    kept = []

    def run(batches):
        for batch in batches:
            blocks = [np.ones(2000) for _ in range(10_000)]  # 160 MB in blocks of 16 KB
            kept.append(np.ones(2000))
            blocks.clear()
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    before = _resident()
    plain = list(run(iter([batch])))
    stays = _resident() - before
    if stays < 50:
        pytest.skip("this allocator gives memory back by itself")
    assert list(released(run)(iter([batch]))) == plain
    assert _resident() - before < 50
