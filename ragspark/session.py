"""SparkSession construction and the checkpoint folder.

On a cluster the session is built by the platform and ``spark.checkpoint.dir``
names a shared folder; we only read it.  Tests and the local bench build their
own session and get a fresh scratch folder when nothing is configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    # 10 MB is the stock auto-broadcast limit; our explicit broadcasts are
    # guarded by ragspark.functions.sizing instead.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "ragspark", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED = "ragspark.pyfiles.shipped"


def ship_package(spark: SparkSession) -> None:
    """Make the package importable on every executor's Python workers
    (``addPyFile`` of a zip, once per session): the Arrow / pandas kernels
    refer to functions of this package."""
    if spark.conf.get(_SHIPPED, "false") == "true":
        return
    import zipfile
    import ragspark
    pkg = os.path.dirname(os.path.abspath(ragspark.__file__))
    ckpt = ensure_checkpoint_dir(spark)
    base = ckpt[len("file:"):] if ckpt.startswith("file:") else ckpt
    if "://" in base or not os.path.isdir(base):
        base = tempfile.mkdtemp(prefix="ragspark-code-")
    target = os.path.join(base, f"ragspark-code-{os.getpid()}")
    os.makedirs(target, exist_ok=True)
    zpath = os.path.join(target, "ragspark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(zpath)
    spark.conf.set(_SHIPPED, "true")


def prepare(spark: SparkSession) -> str:
    """Checkpoint folder + package on the executors; returns the folder."""
    ckpt = ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")     # row ranges of the vector file source
    ship_package(spark)
    return ckpt


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a scratch one only when
    the session names none (local tests).  Off a local master that is an error:
    a machine-local folder would not be seen by other executors."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="ragspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch
