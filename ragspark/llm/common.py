"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions.ranks import snapshot
from ragspark.session import prepare

__all__ = ["table", "ready", "snapshot", "per_batch", "learns", "held_out", "lean", "slices", "cut_words"]


def ready(spark: SparkSession) -> SparkSession:
    """Checkpoint folder, package on the executors, and small Arrow batches:
    texts are kilobytes each, so a batch of 1,000 rows is a few megabytes."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """Lift a record-batch function to a ``mapInArrow`` iterator."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)
    return run


def held_out(id_col: str, mod: int):
    """crc32 of the id's decimal text divisible by ``mod``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == 0, F.lit(False))


def learns(id_col: str, mod: int):
    """Rows that a model may learn from: a non-null id that is not held out."""
    return F.col(id_col).isNotNull() & ~held_out(id_col, mod)


def lean(run):
    """A batch function whose worker takes Arrow memory from the C allocator and,
    when a task ends, gives freed memory back: workers outlive stages, and what a
    stage has freed should not count against the next one."""
    @functools.wraps(run)
    def task(*args):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(*args)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # only the GNU library has it
            if trim is not None:
                trim(0)
    return task


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """First and last row (exclusive) of slices of a column of texts, of about ``most`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(size):
        end = int(np.searchsorted(size, (size[start - 1] if start else 0) + most)) + 1
        yield start, min(end, len(size))
        start = end


def cut_words(texts: pa.Array, change: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a column of texts: (distinct words, the place among them of
    each word in the order of the texts, where each text's words begin and the
    last text's end).  Texts are cut at spaces after ``change`` (256 bytes) has
    replaced their bytes, and hold no empty word; a null text has none."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.binary()), b""), b"", b" ")     # a space ends each word
    n = len(ended)
    ends = np.frombuffer(ended.buffers()[1], np.int32, n + 1, 4 * ended.offset) if n else np.zeros(1, np.int32)
    data = ended.buffers()[2].to_pybytes()[ends[0]:ends[-1]].translate(change) if n else b""
    edges = np.concatenate(([0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1))
    first = np.searchsorted(edges, ends - ends[0])
    keep = np.diff(edges) > 1
    found = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
    found = found.filter(pa.array(keep)).dictionary_encode()
    before = np.concatenate(([0], np.cumsum(keep)))
    words = found.dictionary.buffers()[2].to_pybytes().split(b" ")[:len(found.dictionary)] if len(found) else []
    return words, found.indices.to_numpy(), before[first]
