"""Output folders for sinks: always below the shared ``spark.checkpoint.dir``
(never a machine-local temp folder on a cluster); a fresh folder per call."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ragspark.session import ensure_checkpoint_dir


def new_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ragspark-out/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """POSIX path for Python-side file I/O (strips a file: scheme)."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path
