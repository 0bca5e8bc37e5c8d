"""Snapshots, caches and stored tables that change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(files: DataFrame) -> DataFrame:
    """(file_path, hash) of files (path, content)."""
    return files.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("hash"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, change): added, modified or deleted; unchanged files are left out."""
    x = old.select("file_path", F.col("hash").alias("_old")).join(new.select("file_path", F.col("hash").alias("_new")), "file_path", "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return x.select("file_path", change.alias("change")).where("change IS NOT NULL")


def upsert_latest(stored: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Stored and new rows, the last by seq of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return stored.unionByName(new).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cache_split(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached value, misses)"""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")


def through_cache(wanted: DataFrame, cache: DataFrame, key: str, compute, value: str = "value") -> DataFrame:
    """(key, value) of all wanted keys; ``compute`` gets the misses only."""
    hits, misses = cache_split(wanted.select(key).distinct(), cache, key)
    return hits.select(key, value).unionByName(compute(misses).select(key, value))


def delete_by_path(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def replace_partitions(rows: DataFrame, path: str, by: str = "repo_id") -> None:
    """Overwrites only the partitions (one a repository) that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
