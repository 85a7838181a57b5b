"""Model / index / device catalog (SRC13) as small DataFrames.

``load_json`` reads catalog files in the reference's JSON layout
(``{name, memory_gb, tp_size, tput_ceiling: {device: [{input, output,
values: {"ngpu=N": x}}]}, slo: {...}}``) and flattens them with explode +
regexp; the built-in tables below carry the same values so plans that only
need a lookup do not depend on files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference's configuration files).
# index: ntotal, nlist, d, M, msub, ksub, search slo ms
INDEXES = [
    ("wikiall", 87555327, 262144, 768, 384, 2, 16, 150),
    ("orcas1k", 128448962, 1048576, 1024, 512, 2, 16, 200),
    ("orcas2k", 128448962, 1048576, 2048, 1024, 2, 16, 300),
]
# device memory GB
GPUS = [("H100", 79.2), ("L40S", 48.0)]
# model key, model name, weights memory GB, tensor-parallel size
MODELS = [
    ("llama8b", "meta-llama/Llama-3.1-8B", 19.85, 1),
    ("qwen32b", "Qwen/Qwen3-32B", 37.73, 2),
    ("llama70b", "meta-llama/Llama-3.1-70B", 40.0, 4),
]
# model, kind, device, input, output, ngpu, value
#   kind tput = generation rate ceiling (req/s); kind slo = prefill objective (s)
MODEL_PERF = [
    ("llama8b", "tput", "L40S", 512, 256, 8, 68.0),
    ("llama8b", "tput", "L40S", 1024, 128, 8, 56.2),
    ("llama8b", "tput", "L40S", 1024, 256, 8, 41.23),
    ("llama8b", "tput", "L40S", 1024, 256, 6, 30.38),
    ("llama8b", "tput", "L40S", 1024, 256, 4, 20.24),
    ("llama8b", "tput", "L40S", 1024, 512, 8, 23.12),
    ("llama8b", "tput", "L40S", 2048, 256, 8, 22.07),
    ("llama8b", "slo", "L40S", 512, 256, 8, 0.187),
    ("llama8b", "slo", "L40S", 1024, 128, 8, 0.213),
    ("llama8b", "slo", "L40S", 1024, 256, 8, 0.217),
    ("llama8b", "slo", "L40S", 1024, 256, 6, 0.201),
    ("llama8b", "slo", "L40S", 1024, 256, 4, 0.211),
    ("llama8b", "slo", "L40S", 1024, 512, 8, 0.172),
    ("llama8b", "slo", "L40S", 2048, 256, 8, 0.255),
    ("qwen32b", "tput", "H100", 1024, 256, 8, 38.83),
    ("qwen32b", "tput", "H100", 1024, 256, 6, 27.91),
    ("qwen32b", "tput", "H100", 1024, 256, 4, 18.91),
    ("qwen32b", "tput", "L40S", 1024, 256, 8, 6.97),
    ("qwen32b", "tput", "L40S", 1024, 256, 6, 5.14),
    ("qwen32b", "tput", "L40S", 1024, 256, 4, 3.45),
    ("qwen32b", "slo", "H100", 1024, 256, 8, 0.191),
    ("qwen32b", "slo", "H100", 1024, 256, 6, 0.192),
    ("qwen32b", "slo", "H100", 1024, 256, 4, 0.223),
    ("qwen32b", "slo", "L40S", 1024, 256, 8, 0.355),
    ("qwen32b", "slo", "L40S", 1024, 256, 6, 0.363),
    ("qwen32b", "slo", "L40S", 1024, 256, 4, 0.529),
    ("llama70b", "tput", "H100", 1024, 256, 4, 8.0),
    ("llama70b", "tput", "H100", 1024, 256, 8, 17.34),
    ("llama70b", "tput", "H100", 1024, 128, 8, 22.27),
    ("llama70b", "tput", "H100", 1024, 512, 8, 12.32),
    ("llama70b", "tput", "H100", 512, 256, 8, 24.97),
    ("llama70b", "tput", "H100", 2048, 256, 8, 10.07),
    ("llama70b", "tput", "L40S", 1024, 256, 8, 2.3),
    ("llama70b", "slo", "H100", 1024, 256, 8, 0.311),
    ("llama70b", "slo", "H100", 1024, 128, 8, 0.523),
    ("llama70b", "slo", "H100", 1024, 512, 8, 0.225),
    ("llama70b", "slo", "H100", 512, 256, 8, 0.196),
    ("llama70b", "slo", "H100", 2048, 256, 8, 0.688),
    ("llama70b", "slo", "L40S", 1024, 256, 8, 0.95),
]

PERF_SCHEMA = "model string, kind string, device string, input int, output int, ngpu int, value double"


def model_perf(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_PERF, PERF_SCHEMA)


def indexes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDEXES, "index string, ntotal bigint, nlist int, d int, m int, "
                                          "msub int, ksub int, slo_ms int")


def gpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GPUS, "device string, mem_gb double")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, name string, memory_gb double, tp_size int")


def values_sql(rows, cols: str) -> str:
    """The same fixed rows as a SQL VALUES list (oracle side)."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({cols})"


_ENTRY = T.ArrayType(T.StructType([
    T.StructField("input", T.IntegerType()), T.StructField("output", T.IntegerType()),
    T.StructField("values", T.MapType(T.StringType(), T.DoubleType()))]))
MODEL_FILE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("memory_gb", T.DoubleType()),
    T.StructField("tp_size", T.IntegerType()),
    T.StructField("tput_ceiling", T.MapType(T.StringType(), _ENTRY)),
    T.StructField("slo", T.MapType(T.StringType(), _ENTRY))])


def load_json(spark: SparkSession, models_glob: str) -> tuple[DataFrame, DataFrame]:
    """Model files -> (models, model_perf).  The model is the file's stem, or the
    folder's ``model=`` where the files lie in such folders."""
    raw = spark.read.text(models_glob, wholetext=True)
    own = F.col("model") if "model" in raw.columns else F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    raw = raw.select(F.from_json("value", MODEL_FILE_SCHEMA).alias("j"), own.alias("model")).select("model", "j.*")
    mods = raw.select("model", "name", "memory_gb", "tp_size")
    parts = []
    for kind, col in (("tput", "tput_ceiling"), ("slo", "slo")):
        e = (raw.select("model", F.explode(col).alias("device", "entries"))
             .select("model", "device", F.explode("entries").alias("e"))
             .select("model", "device", "e.input", "e.output", F.explode("e.values").alias("k", "value"))
             .select("model", F.lit(kind).alias("kind"), "device", "input", "output",
                     F.regexp_extract("k", r"ngpu=(\d+)", 1).cast("int").alias("ngpu"), "value"))
        parts.append(e)
    return mods, parts[0].unionByName(parts[1])


def load_index_json(spark: SparkSession, path: str) -> DataFrame:
    """Index file ``{name: {ntotal, nlist, d, M, msub, ksub, slo}}`` -> rows."""
    inner = T.StructType([T.StructField(n, T.LongType()) for n in
                          ("ntotal", "nlist", "d", "M", "msub", "ksub", "slo")])
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", T.MapType(T.StringType(), inner)).alias("m"))
    return (parsed.select(F.explode("m").alias("index", "c"))
            .select("index", "c.ntotal", F.col("c.nlist").cast("int").alias("nlist"),
                    F.col("c.d").cast("int").alias("d"), F.col("c.M").cast("int").alias("m"),
                    F.col("c.msub").cast("int").alias("msub"), F.col("c.ksub").cast("int").alias("ksub"),
                    F.col("c.slo").cast("int").alias("slo_ms")))


def load_device_json(spark: SparkSession, path: str) -> DataFrame:
    """Device file ``{name: GB}`` -> (device, mem_gb)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,double>")).alias("device", "mem_gb"))
