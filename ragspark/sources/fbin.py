"""Vector files as a Spark data source (SRC1-5).

Layout: ``int32 n, int32 d`` then ``n * d`` values (float32 for ``.fbin``;
int32 or int64 ids for ``.ibin``, the width detected from the file size).

``spark.read.format("fbin").load(path_or_glob)``
    partitions are row ranges (``rowsPerPartition``); each task seeks to its
    range and yields Arrow batches - no task reads a whole file.  Comparisons of
    the row number with constants are pushed down: only the ranges that can hold
    such rows are planned and read.  Several
    files are concatenated in numeric-suffix order with a running row number;
    differing dimensions fail at planning.  ``limit`` keeps the first rows and
    fails if the files hold fewer.
``df.write.format("fbin").option("rowsPerFile", n).save(dir)``
    rows must carry ``file_no`` (id range); each file is written by one task
    with the header patched at the end.

Paths are POSIX paths on a filesystem every executor mounts.
"""

from __future__ import annotations

import glob as _glob
import os
import re
import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)
from pyspark.sql.types import StructType

FLOAT_SCHEMA = "vec_id bigint, embedding array<float>"
ID_SCHEMA = "row_id bigint, ids array<bigint>"


def _files(path: str) -> list[str]:
    paths = sorted(_glob.glob(path)) if any(ch in path for ch in "*?[") else \
        (sorted(_glob.glob(os.path.join(path, "*.?bin"))) if os.path.isdir(path) else [path])

    def key(p):
        nums = re.findall(r"(\d+)", os.path.basename(p))
        return (int(nums[-1]) if nums else -1, p)
    return sorted(paths, key=key)


def _header(path: str) -> tuple[int, int, int]:
    with open(path, "rb") as f:
        n, d = np.fromfile(f, dtype=np.int32, count=2)
    size = os.path.getsize(path)
    width = (size - 8) // max(1, int(n) * int(d)) if n and d else 4
    return int(n), int(d), int(width)


class _Range(InputPartition):
    def __init__(self, path, start, end, offset, dim, width):
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.offset, self.dim, self.width = path, start, end, offset, dim, width


class FbinReader(DataSourceReader):
    def __init__(self, options, ids: bool):
        self.options = options
        self.ids = ids
        self.first, self.last = 0, (1 << 63) - 1         # row numbers that the filters leave

    def pushFilters(self, filters):
        """Narrows the row range by the filters on the row number; others are Spark's."""
        name = ("row_id",) if self.ids else ("vec_id",)
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != name:
                yield f
            elif isinstance(f, In) and all(isinstance(v, int) for v in value) and value:
                self.first, self.last = max(self.first, min(value)), min(self.last, max(value))
                yield f                                  # the rows between are Spark's to drop
            elif not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, value), min(self.last, value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self):
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        per = int(self.options.get("rowsPerPartition", 1 << 20))
        limit = self.options.get("limit")
        limit = int(limit) if limit is not None else None
        heads = [(p, *_header(p)) for p in files]
        dims = {d for _, _, d, _ in heads}
        if len(dims) > 1:
            raise ValueError(f"vector files differ in dimension: {sorted(dims)}")
        total = sum(n for _, n, _, _ in heads)
        if limit is not None and total < limit:
            raise ValueError(f"requested {limit} rows but the files hold {total}")
        parts, offset = [], 0
        for path, n, d, width in heads:
            take = n if limit is None else max(0, min(n, limit - offset))
            low, high = max(0, self.first - offset), min(take, self.last - offset + 1)
            for s in range(low - low % per, high, per):
                parts.append(_Range(path, max(low, s), min(high, s + per), offset, d, width))
            offset += n
        return parts or [_Range(files[0], 0, 0, 0, heads[0][2], heads[0][3])]

    def read(self, partition):
        p = partition
        dtype = np.float32 if not self.ids else (np.int64 if p.width == 8 else np.int32)
        step = max(1, (8 << 20) // max(1, p.dim * 4))
        with open(p.path, "rb") as f:
            for s in range(p.start, p.end, step):
                e = min(p.end, s + step)
                f.seek(8 + p.width * p.dim * s)
                vals = np.fromfile(f, dtype=dtype, count=(e - s) * p.dim)
                if self.ids:
                    vals = vals.astype(np.int64)
                offsets = pa.array(np.arange(0, (e - s + 1) * p.dim, p.dim, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(vals))
                ids = pa.array(np.arange(p.offset + s, p.offset + e, dtype=np.int64))
                names = ["row_id", "ids"] if self.ids else ["vec_id", "embedding"]
                yield pa.RecordBatch.from_arrays([ids, lists], names=names)


class _Written(WriterCommitMessage):
    def __init__(self, folder, files):
        self.folder, self.files = folder, files


class FbinWriter(DataSourceArrowWriter):
    """Each task writes into a staging folder of its own; only the files of
    committed tasks are moved to their numbered names, so a retried or
    speculative task leaves nothing behind.  Overwriting removes the numbered
    files that were there; option ``skipExisting`` keeps them instead."""

    def __init__(self, options, schema: StructType, ids: bool, overwrite: bool = False):
        self.path = options["path"]
        self.ids, self.overwrite = ids, overwrite
        self.vec = schema.fieldNames()[1] if len(schema.fieldNames()) > 1 else schema.fieldNames()[0]
        self.prefix = options.get("prefix", "base")
        self.skip = options.get("skipExisting", "false").lower() == "true"

    def _name(self, number: int) -> str:
        return f"{self.prefix}{number}.{'ibin' if self.ids else 'fbin'}"

    def write(self, iterator):
        folder = os.path.join(self.path, "_staging", uuid.uuid4().hex)
        os.makedirs(folder, exist_ok=True)
        done, cur, fh, n, dim = [], None, None, 0, None
        dtype = np.int64 if self.ids else np.float32

        def close():
            if fh is not None:
                fh.seek(0)
                np.array([n, dim or 0], dtype=np.int32).tofile(fh)
                fh.close()
                done.append(self._name(cur))
        for batch in iterator:
            fnos = batch.column("file_no").to_numpy(zero_copy_only=False)
            vec = batch.column(self.vec)
            for fno in np.unique(fnos):
                sel = np.nonzero(fnos == fno)[0]
                if fno != cur:
                    close()
                    cur, n = int(fno), 0
                    fh = open(os.path.join(folder, self._name(cur)), "wb")
                    np.zeros(2, dtype=np.int32).tofile(fh)
                sub = vec.take(pa.array(sel))
                mat = sub.flatten().to_numpy(zero_copy_only=False).astype(dtype)
                dim = len(mat) // max(1, len(sel))
                mat.tofile(fh)
                n += len(sel)
        close()
        return _Written(folder, done)

    def commit(self, messages):
        numbered = re.compile(re.escape(self.prefix) + r"\d+\." + ("ibin" if self.ids else "fbin"))
        if self.overwrite and not self.skip and os.path.isdir(self.path):
            for f in os.listdir(self.path):
                if numbered.fullmatch(f):
                    os.remove(os.path.join(self.path, f))
        for m in filter(None, messages):
            for f in m.files:
                target = os.path.join(self.path, f)
                if not (self.skip and os.path.exists(target)):
                    os.replace(os.path.join(m.folder, f), target)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        shutil.rmtree(os.path.join(self.path, "_staging"), ignore_errors=True)


class FbinDataSource(DataSource):
    """Float32 vector files."""

    ids = False

    @classmethod
    def name(cls):
        return "fbin"

    def schema(self):
        return ID_SCHEMA if self.ids else FLOAT_SCHEMA

    def reader(self, schema):
        return FbinReader(self.options, self.ids)

    def writer(self, schema, overwrite):
        return FbinWriter(self.options, schema, self.ids, overwrite)


class IbinDataSource(FbinDataSource):
    """Id files (int32 or int64 payload)."""

    ids = True

    @classmethod
    def name(cls):
        return "ibin"


def register(spark) -> None:
    spark.dataSource.register(FbinDataSource)
    spark.dataSource.register(IbinDataSource)


def write_vectors(df, path: str, vec: str, id_col: str, rows_per_file: int = 1 << 24, ids: bool = False,
                  prefix: str = "base", skip_existing: bool = False) -> None:
    """SRC5: numbered files of ``rows_per_file`` consecutive ids each; rows are
    routed by id range and each file is written whole by one task, in id order.

    A row's id is its position in the files, so ids must be 0..n-1, each once;
    other ids are an error, not renumbered.  ``skip_existing`` keeps numbered
    files that are there already; else all of them are replaced."""
    from pyspark.sql import functions as F
    register(df.sparkSession)
    got = df.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("a"), F.max(id_col).alias("b"),
                 F.count_distinct(F.col(id_col)).alias("d")).first()
    if got["n"] and (got["a"], got["b"], got["d"]) != (0, got["n"] - 1, got["n"]):
        raise ValueError(f"ids must be 0..{got['n'] - 1}, each once; got {got['d']} from {got['a']} to {got['b']}")
    nfiles_hint = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    out = (df.select(id_col, vec).withColumn("file_no", F.floor(F.col(id_col) / F.lit(rows_per_file)).cast("bigint"))
           .repartition(int(nfiles_hint), "file_no").sortWithinPartitions("file_no", id_col)
           .select("file_no", vec))
    out.write.format("ibin" if ids else "fbin").option("prefix", prefix).option("skipExisting", str(skip_existing).lower()).mode("overwrite").save(path)
