"""Stores: cells by stream and day, windows by fingerprint, metrics, reservoirs, chunks."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVOIR_VERSION = 1


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a session on one machine gets a folder of its own; a cluster is refused.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-stratolab-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells (.., stream, date) as Parquet partitioned by both."""
    cells.write.mode("append").partitionBy("stream", "date").parquet(path)


def read_cells(spark: SparkSession, path: str, stream: str, first: str, last: str) -> DataFrame:
    """One stream's days; the other partitions are not opened."""
    return spark.read.parquet(path).where((F.col("stream") == stream) & F.col("date").between(first, last))


def fingerprint(config: dict) -> str:
    """Sixteen hex digits of the canonical JSON's SHA-256: key order does not matter."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def fingerprint_of(config) -> F.Column:
    """The same of a map<string,string> column: sixteen hex digits of its JSON in order of keys."""
    return F.substring(F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config)))), 256), 1, 16)


def write_windows(windows: DataFrame, root: str, fp: str) -> None:
    """Windows (valid_time, kind, accepted, reason, ..) under their fingerprint, kind and date.

    Rejected windows keep their row and lose their values. Days written before
    under the same fingerprint are replaced whole.
    """
    meta = {"valid_time", "kind", "accepted", "reason"}
    values = [c for c in windows.columns if c not in meta]
    kept = windows.select(
        "valid_time", "kind", "accepted", "reason", *[F.when(F.col("accepted"), F.col(c)).alias(c) for c in values],
        F.lit(fp).alias("fingerprint"), F.to_date("valid_time").alias("date"),
    )
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint", "kind", "date").parquet(root)


def read_windows(spark: SparkSession, root: str, fp: str) -> DataFrame:
    """Only windows of this fingerprint; stale ones are never read."""
    return spark.read.parquet(root).where(F.col("fingerprint") == fp)


def bytes_per_window(frames: int, channels: int, height: int, width: int, item: int = 4) -> int:
    return frames * channels * height * width * item


def projected_bytes(windows: DataFrame, per_window: int) -> DataFrame:
    return windows.agg(F.count("*").alias("windows"), (F.count("*") * per_window).alias("bytes"))


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    metrics.select("name", "value").write.mode(mode).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, value double").json(path)


def load_channel_stats(spark: SparkSession, path: str, channels: list[str]) -> DataFrame:
    """Statistics from one JSON document {channel: {mean, std, ..}}; `_meta` is skipped, a missing key or channel refused."""
    kind = "map<string,struct<mean:double,std:double,min:double,max:double,count:bigint,source:string>>"
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", kind)).alias("channel", "s")).where("channel != '_meta'").select("channel", "s.*")
    bad = parsed.where("mean is null or std is null or min is null or max is null").select("channel")
    lacking = spark.createDataFrame([(c,) for c in channels], "channel string").join(parsed, "channel", "left_anti")
    wrong = sorted(r.channel for r in bad.unionByName(lacking).collect())  # at most one row a channel
    if wrong:
        raise ValueError(f"statistics lack {wrong}")
    return parsed


def save_reservoir(records: DataFrame, path: str, capacity: int) -> None:
    """Header and records, in time order, as JSON lines."""
    spark = records.sparkSession
    spark.createDataFrame([(RESERVOIR_VERSION, capacity)], "version int, capacity int").coalesce(1).write.mode("overwrite").json(f"{path}/header")
    records.sort("t_s").coalesce(1).write.mode("overwrite").json(f"{path}/records")  # at most `capacity` rows


def load_reservoir(spark: SparkSession, path: str, capacity: int) -> DataFrame:
    head = spark.read.schema("version int, capacity int").json(f"{path}/header").first()
    if head.version != RESERVOIR_VERSION:
        raise ValueError(f"reservoir version {head.version} is not {RESERVOIR_VERSION}")
    if head.capacity != capacity:
        raise ValueError(f"reservoir capacity {head.capacity} is not {capacity}")
    return spark.read.schema("t_s long, score double, reservoir_key double").json(f"{path}/records")


def write_chunks(chunks: DataFrame, path: str, *, model: str, dims: int, corpus_label: str, force: bool = False) -> None:
    """Chunks with a one-row table of where they come from; an existing store is refused without force."""
    spark = chunks.sparkSession
    mode = "overwrite" if force else "errorifexists"
    chunks.write.mode(mode).parquet(f"{path}/chunks")
    count = spark.read.parquet(f"{path}/chunks").count()
    meta = spark.createDataFrame([(model, dims, corpus_label, count)], "model string, dims int, corpus_label string, count long")
    meta.coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def read_chunks(spark: SparkSession, path: str, *, model: str, dims: int) -> DataFrame:
    """Chunks of a store built by the same model and width; others are refused."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if (meta.model, meta.dims) != (model, dims):
        raise ValueError(f"store is of {meta.model} with {meta.dims} dimensions")
    return spark.read.parquet(f"{path}/chunks")


def cap_json(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("cap_json", F.to_json("alert"))


def cap_xml(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("cap_xml", F.to_xml("alert", {"rowTag": "alert"}))
