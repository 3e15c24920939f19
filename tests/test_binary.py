"""Files of ids: splits at odd borders, windows over them, pruning, and writes against a sequential writer."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.sources import binary


@pytest.mark.parametrize("dtype,n,split,options", [("<u2", 10_001, 777, {"block": 100}), ("<u4", 10_001, 1_000_000, {"block": 4096}), ("<u2", 5, 2, {"block": 1}), ("<u2", 0, 9, {})])
def test_blocks(spark, tmp_path, dtype, n, split, options):
    ids = (np.arange(n) * 7919 % 60_000).astype(dtype)
    ids.tofile(tmp_path / "t.bin")
    d = binary.read_ids(spark, str(tmp_path / "t.bin"), dtype, splitBytes=split, **options)
    rows = d.orderBy("start").collect()
    assert sum((r.ids for r in rows), []) == ids.tolist()
    if n > 10:
        assert d.rdd.getNumPartitions() == -(-n // max(options["block"], split // ids.itemsize // options["block"] * options["block"]))
        few = d.where("start >= 4321 and start < 6000")
        assert sorted(r.start for r in few.collect()) == [s for s in range(0, n, options["block"]) if 4321 <= s < 6000]
        assert few.rdd.getNumPartitions() <= 1 + 1700 * ids.itemsize // split + 1


@pytest.mark.parametrize("n,window,stride", [(5000, 64, 64), (5000, 64, 10), (65, 64, 64), (64, 64, 64), (129, 64, 64)])
def test_windows_over_splits(spark, tmp_path, n, window, stride):
    ids = (np.arange(n) * 31 % 50_000).astype("<u2")
    ids.tofile(tmp_path / "t.bin")
    got = binary.read_ids(spark, "file://" + str(tmp_path / "t.bin"), window=window, stride=stride, splitBytes=300).orderBy("start").collect()
    starts = list(range(0, n - window, stride))
    assert [r.start for r in got] == starts
    assert all(r.x == ids[s : s + window].tolist() and r.y == ids[s + 1 : s + window + 1].tolist() for r, s in zip(got, starts, strict=True))


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    n = 2_600_000_000
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(2 * n)
        f.seek(2 * (n - 3))
        f.write(np.array([7, 8, 9], "<u2").tobytes())
    d = binary.read_ids(spark, str(tmp_path / "big.bin"))
    assert d.rdd.getNumPartitions() == -(-2 * n // (128 << 20))
    tail = d.where(F.col("start") >= n - 70_000)
    assert tail.rdd.getNumPartitions() == 1 and [x for r in tail.orderBy("start").collect() for x in r.ids][-3:] == [7, 8, 9]


def test_bad_files(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"123")
    for path in ("odd.bin", "none.bin"):
        with pytest.raises(Exception, match="whole number|FileNotFound|none.bin"):
            binary.read_ids(spark, str(tmp_path / path)).count()


def table(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 30))
        rows.append((i, f"c{i // 3}", rng.integers(0, 50_000, k).tolist() if i % 11 else None, [int(x) for x in rng.integers(0, 2, k)] if i % 11 else None, "payload"))
    return rows, spark.createDataFrame(rows, "o long, c string, t array<int>, m array<int>, p string").repartition(7)


@pytest.mark.parametrize("key", [None, "c"])
def test_files_equal_a_sequential_writer(spark, tmp_path, key):
    rows, d = table(spark, 900)
    meta = binary.write_ids(d, str(tmp_path / "out"), "t", "o", 0.1, 50_257, mask="m", key=key, eot_id=0)
    flat, masks = [x for r in rows for x in r[2] or []], [x for r in rows for x in r[3] or []]
    if key:
        b = len(rows) - int(len(rows) * 0.1)
        while b < len(rows) and rows[b - 1][1] == rows[b][1]:
            b += 1
        border = sum(len(r[2] or []) for r in rows[:b])
    else:
        border = len(flat) - int(len(flat) * 0.1)
    for name, values, kind in (("ids", flat, "<u2"), ("mask", masks, "u1")):
        for split, part in (("train", values[:border]), ("val", values[border:])):
            assert (tmp_path / "out" / f"{split}_{name}.bin").read_bytes() == np.array(part, kind).tobytes()
    assert meta == {"vocab_size": 50_257, "dtype": "uint16", "train_tokens": border, "val_tokens": len(flat) - border, "eot_id": 0}
    assert json.loads((tmp_path / "out" / "meta.json").read_text()) == meta
    again = binary.read_ids(spark, str(tmp_path / "out" / "train_ids.bin"), splitBytes=500, block=32)
    assert [x for r in again.orderBy("start").collect() for x in r.ids] == flat[:border]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    _, d = table(spark, 200)
    bad = d.withColumn("t", F.when(F.col("o") == 150, F.array(F.lit(70_000))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="beyond"):
        binary.write_ids(bad, str(tmp_path / "out"), "t", "o", 0.1, 50_257)
    assert os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="holes"):
        spark.createDataFrame([(0, [1]), (2, [2])], "offset long, ids array<int>").write.format("ids").mode("overwrite").options(border=9).save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []
    assert binary.write_ids(d.where("o < 0"), str(tmp_path / "out"), "t", "o", 0.1, 70_000)["dtype"] == "uint32"
