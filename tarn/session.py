"""Session and table access shared by the engine."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tarn", cores: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    n = cores or os.cpu_count() or 2
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What can be set as spark.tarn.<name>, with the values taken otherwise.
DEFAULTS = {"top_k": 5, "seeds": 20, "expanded": 50, "rerank": True, "requests": 60, "request_seconds": 60, "embed_batch": 20, "embed_gap": 6.5, "chunk_lines": 300, "chunk_overlap": 30}


def settings(spark: SparkSession) -> dict:
    """The session's settings, of the types of DEFAULTS."""
    out = {}
    for name, usual in DEFAULTS.items():
        given = spark.conf.get(f"spark.tarn.{name}", None)
        out[name] = usual if given is None else given.lower() == "true" if isinstance(usual, bool) else type(usual)(given)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores where a scan has fewer splits than that (a small table in one row group); large tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *keys) if df.rdd.getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir). Only a local session may go without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tarn-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Write a step to the shared folder and read it again: it is computed once and survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
