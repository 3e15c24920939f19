"""Search over many queries: a task's memory is that of its numbers."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from prosemill.operators import vectors


def test_best_of_many_queries_in_small_memory():
    rng = np.random.default_rng(3)
    q, x = rng.integers(-3, 4, (6000, 4)).astype(float), rng.integers(-3, 4, (1500, 4)).astype(float)
    qids, ids = np.arange(6000), rng.permutation(1500)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 500]), pa.array(list(x[i : i + 500]))], names=["id", "vec"]) for i in (0, 500, 1000)]
    tracemalloc.start()
    out = vectors._best(SimpleNamespace(value=(qids, q)), 10, True)(iter(batches))
    got = {}
    for batch in out:
        for i, v, s in zip(*(c.to_numpy() for c in batch.columns), strict=True):
            if i < 60:
                got.setdefault(int(i), []).append((-s, int(v)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20
    for i in range(60):
        assert got[i] == sorted((-float(x[j] @ q[i]), int(ids[j])) for j in range(1500) if ids[j] != i)[:10]
