"""Tables that change: each save is a new folder, and the newest that Spark has committed is the table.

A crash leaves an uncommitted folder that no reader sees; the version before is kept for readers under way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in any store that Spark reads."""
    fs, path = _at(spark, pattern)
    return sorted(f.getPath().toString() for f in fs.globStatus(path) or [])


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = _at(spark, path)
    fs.delete(hadoop, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file."""
    fs, hadoop = _at(spark, path)
    out = fs.create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()


def committed(spark: SparkSession, base: str) -> list[str]:
    """Folders of the versions that are whole, oldest first."""
    return [p.rsplit("/", 1)[0] for p in listed(spark, f"{base}/v*/_SUCCESS")]


def _next(spark: SparkSession, base: str) -> int:
    tried = listed(spark, f"{base}/v*")
    return int(tried[-1].rsplit("/v", 1)[1]) + 1 if tried else 1


def read(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest version, None before the first."""
    found = committed(spark, base)
    return spark.read.parquet(found[-1]) if found else None


def save(df: DataFrame, base: str) -> DataFrame:
    spark = df.sparkSession
    before = committed(spark, base)
    path = f"{base}/v{_next(spark, base):09d}"
    df.write.parquet(path)
    for old in before[:-1]:
        delete(spark, old)
    return spark.read.parquet(path)


def buckets(spark: SparkSession, base: str) -> dict[int, str]:
    """The newest folder of each bucket of a bucketed table."""
    out = {}
    for version in committed(spark, base):
        out |= {int(p.rsplit("=", 1)[1]): p for p in listed(spark, f"{version}/_bucket=*")}
    return out


def save_buckets(df: DataFrame, base: str) -> None:
    """Replaces the buckets (column _bucket) that df has, and leaves the others as they are."""
    spark = df.sparkSession
    before = buckets(spark, base)
    df.write.partitionBy("_bucket").parquet(f"{base}/v{_next(spark, base):09d}")
    # folders that were superseded before this save have no readers any more
    live = set(before.values()) | set(buckets(spark, base).values())
    for p in listed(spark, f"{base}/v*/_bucket=*"):
        if p not in live:
            delete(spark, p)
