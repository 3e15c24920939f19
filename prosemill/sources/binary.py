"""Files of ids, one number after the other: read in byte ranges, written by every task at its own place.

The data source ``ids`` reads blocks, or windows and the same one id later, of files of any size, and writes
train and val files of ids and loss masks with one meta.json.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .staging import ship

#: Bytes of a split and ids of a block, unless the options say otherwise.
SPLIT_BYTES, BLOCK = 128 << 20, 1 << 16


def dtype_for(vocab_size: int) -> str:
    """Two bytes an id up to 65,535 ids, else four; little-endian."""
    return "<u2" if vocab_size <= 65_535 else "<u4"


def _files(path: str):
    """The file system of a path or URI, and its files in order of name: itself, or those of the folder."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))
    info = files.get_file_info(at)
    if info.type == fs.FileType.File:
        return files, [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f for f in files.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return files, sorted((f.path, f.size) for f in found)


def _local(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: ids are written to places of one file, which this store can't do")
    return unquote(parts.path) if parts.scheme else path


@dataclass
class Split(InputPartition):
    path: str
    first: int  # ids; rows that start in first .. last - 1 are the split's
    last: int
    total: int


class IdsReader(DataSourceReader):
    """Rows start at multiples of the stride; a split gives those that start in it, reading on beyond its end where a row does."""

    def __init__(self, options):
        self.path, self.dtype = options["path"], np.dtype(options.get("dtype", "<u2"))
        self.window = int(options.get("window", 0))
        self.stride = int(options.get("stride", self.window or options.get("block", BLOCK)))
        size = max(self.dtype.itemsize, int(options.get("splitbytes", SPLIT_BYTES)))
        self.step = max(1, size // self.dtype.itemsize // self.stride) * self.stride
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("start",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif getattr(f, "attribute", None) == ("start",) and isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def partitions(self) -> list[Split]:
        out = []
        for path, size in _files(self.path)[1]:
            if size % self.dtype.itemsize:
                raise ValueError(f"{path}: {size} bytes are no whole number of {self.dtype} ids")
            n = size // self.dtype.itemsize
            # the last window starts where its target still has its last id
            ends = n - self.window if self.window else n
            last = min(ends, ends if self.high is None else self.high)
            first = -(-self.low // self.stride) * self.stride
            begin = first // self.step * self.step
            out += [Split(path, max(at, first), min(at + self.step, last), n) for at in range(begin, max(last, begin), self.step) if max(at, first) < min(at + self.step, last)]
        return out

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:  # there are no rows
            return
        files, width, item = _files(split.path)[0], self.window + 1 if self.window else self.stride, self.dtype.itemsize
        rows_at_once = max(1, (1 << 20) // width)
        kind = pa.list_(pa.int64())
        with files.open_input_file(split.path) as f:
            starts = range(split.first, split.last, self.stride)
            for k in range(0, len(starts), rows_at_once):
                some = starts[k : k + rows_at_once]
                ids = np.frombuffer(f.read_at(min(some[-1] + width, split.total) * item - some[0] * item, some[0] * item), self.dtype).astype(np.int64)
                cut = lambda off, n: pa.array([ids[s - some[0] + off : s - some[0] + off + n] for s in some], kind)  # noqa: B023, E731
                cols = [cut(0, self.window), cut(1, self.window)] if self.window else [cut(0, self.stride)]
                names = ["x", "y"] if self.window else ["ids"]
                yield pa.RecordBatch.from_arrays([pa.array([split.path] * len(some)), pa.array(list(some), pa.int64()), *cols], names=["path", "start", *names])


@dataclass
class Written(WriterCommitMessage):
    counts: dict  # file -> (ids, the end of the last one)


class IdsWriter(DataSourceArrowWriter):
    """Rows (offset, ids[, mask]): a task writes each at its place in a hidden file, which commit gives its name.

    The ids before ``border`` go to train, the rest to val; a row may be cut. A task that runs twice writes the same bytes again. commit()
    refuses files with holes; whatever fails, abort() leaves nothing. The folder must be on a file system where tasks write to places of one file.
    """

    def __init__(self, options, schema):
        self.folder, self.border = _local(options["path"]), int(options["border"])
        self.dtype, self.masked = options.get("dtype", "<u2"), "mask" in schema.names
        self.order = [schema.names.index(c) for c in ("offset", "ids", *["mask"] * self.masked)]
        self.meta, self.tag = json.loads(options.get("meta", "{}")), uuid.uuid4().hex
        os.makedirs(self.folder, exist_ok=True)
        for name in self.names():
            with open(self.hidden(name), "wb"):
                pass

    def names(self) -> list[str]:
        return [f"{split}_{kind}.bin" for split in ("train", "val") for kind in ("ids", *["mask"] * self.masked)]

    def hidden(self, name: str) -> str:
        return f"{self.folder}/.{name}.{self.tag}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        kinds = {"ids": np.dtype(self.dtype), "mask": np.dtype("u1")}
        files, counts = {n: os.open(self.hidden(n), os.O_WRONLY) for n in self.names()}, dict.fromkeys(self.names(), (0, 0))
        try:
            for batch in iterator:
                columns = [batch.column(i) for i in self.order]
                for row in range(batch.num_rows):
                    offset = columns[0][row].as_py()
                    for kind, column in zip(("ids", "mask"), columns[1:], strict=False):
                        values = np.asarray(column[row].values, np.int64)
                        if len(values) and not 0 <= values.min() <= values.max() <= np.iinfo(kinds[kind]).max:
                            raise ValueError(f"{kind} beyond {kinds[kind]}")
                        cut = min(max(self.border - offset, 0), len(values))
                        for split, at, part in (("train", offset, values[:cut]), ("val", offset + cut - self.border, values[cut:])):
                            if len(part):
                                name = f"{split}_{kind}.bin"
                                raw, put = part.astype(kinds[kind]).tobytes(), at * kinds[kind].itemsize
                                while raw:
                                    done = os.pwrite(files[name], raw, put)
                                    raw, put = raw[done:], put + done
                                n, end = counts[name]
                                counts[name] = n + len(part), max(end, at + len(part))
        finally:
            for f in files.values():
                os.close(f)
        return Written(counts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        try:
            totals = {}
            for name in self.names():
                n = sum(m.counts[name][0] for m in messages if m)
                if n != max((m.counts[name][1] for m in messages if m), default=0):
                    raise ValueError(f"{name}: the offsets leave holes, or overlap")
                totals[name] = n
            meta = {"dtype": np.dtype(self.dtype).name, "train_tokens": totals["train_ids.bin"], "val_tokens": totals["val_ids.bin"]} | self.meta
            with open(self.hidden("meta.json"), "w") as f:
                json.dump(meta, f, indent=2)
        except Exception:
            self.abort(messages)
            raise
        for name in [*self.names(), "meta.json"]:
            os.replace(self.hidden(name), f"{self.folder}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for name in [*self.names(), "meta.json"]:
            if os.path.exists(self.hidden(name)):
                os.remove(self.hidden(name))


class Ids(DataSource):
    """format("ids"): option path; dtype (<u2), splitBytes, and block, or window and stride, to read; border and meta to write."""

    @classmethod
    def name(cls) -> str:
        return "ids"

    def schema(self) -> str:
        return "path string, start bigint, x array<bigint>, y array<bigint>" if int(self.options.get("window", 0)) else "path string, start bigint, ids array<bigint>"

    def reader(self, schema) -> IdsReader:
        return IdsReader(self.options)

    def writer(self, schema, overwrite: bool) -> IdsWriter:
        return IdsWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; conditions on ``start`` then prune splits."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Ids)


def read_ids(spark: SparkSession, path: str, dtype: str = "<u2", **options) -> DataFrame:
    """SRC9: path, start, ids of at most ``block`` ids; or with ``window`` x and y, y one id later, each ``stride`` ids (ARR1, ARR2)."""
    register(spark)
    return spark.read.format("ids").options(dtype=dtype, **{k: str(v) for k, v in options.items()}).load(path)


def write_ids(df: DataFrame, folder: str, ids: str, order: str, share: float, vocab_size: int, mask: str | None = None, key: str | None = None, **meta) -> dict:
    """SNK4, SNK5, SNK6: train and val files of the ids of all rows in order, of their masks too if there are any, and meta.json; returns its content.

    val is the last int(total * share) ids, cutting a row; or, with ``key``, the last int(rows * share) rows but for a run of one key over the border, which stays in train. A null array is empty.
    """
    from ..operators.corpus import Ordered, context_safe_split

    register(df.sparkSession)
    if key:
        df = context_safe_split(df, key, order, share)
    columns = [F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"), *([F.coalesce(F.col(mask), F.array().cast("array<int>")).alias("mask")] if mask else [])]
    stream = Ordered(df.select(F.col(order).alias("o"), *columns, *(["is_val"] if key else [])), F.size("ids"), "o")
    total = stream.total()
    rows = stream.offsets()
    border = rows.where("is_val").agg(F.coalesce(F.min("offset"), F.lit(total))).first()[0] if key else total - int(total * share)
    out = rows.select("offset", "ids", *(["mask"] if mask else []))
    out.write.format("ids").mode("overwrite").options(border=border, dtype=dtype_for(vocab_size), meta=json.dumps({"vocab_size": vocab_size} | meta)).save(folder)
    with open(f"{_local(folder)}/meta.json") as f:
        return json.load(f)
