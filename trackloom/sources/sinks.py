"""Sinks: keyed tables, scoped metrics, checkpoints, manifests, bundle files.

The writer's tables are merged on read (``store``). Manifests and evaluation rows, which come run by run,
are partitioned by run: an upsert overwrites the partitions of a batch alone (dynamic partition
overwrite); one writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.readers import artifacts
from trackloom.sources.store import Store, Table

SCOPES = ("run_total", "processing_record", "writer_record")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def filesystem(spark: SparkSession, path: str):
    """(file system, path) as Hadoop objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _touched(batch: DataFrame, path: str, partition: str) -> DataFrame | None:
    """Old rows of the partitions that ``batch`` has; partition values are few, one per run, so the old rows stay where they are."""
    spark = batch.sparkSession
    if not exists(spark, path):
        return None
    old = spark.read.schema(batch.schema).parquet(path)
    return old.join(F.broadcast(batch.select(partition).distinct()), partition, "left_semi")


def overwrite(df: DataFrame, path: str, partition: str = "run_id") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def merged(old: DataFrame | None, batch: DataFrame, keys: list[str], order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Last row per key by ``order`` (the batch beats the old rows); ``keep_first`` columns keep the first value."""
    new = batch.withColumn("_gen", F.lit(1))
    rows = new if old is None else old.withColumn("_gen", F.lit(0)).unionByName(new, allowMissingColumns=True)
    seq = F.struct("_gen", order)
    cols = [c for c in batch.columns if c not in keys]
    best = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*[c for c in cols if c not in keep_first]), seq).alias("_last"), *[F.min_by(c, seq).alias(c) for c in keep_first]
    )
    return best.select(*keys, "_last.*", *keep_first).select(*batch.columns)


def upsert(batch: DataFrame, path: str, keys: list[str], order: str, keep_first: tuple[str, ...] = (), partition: str = "run_id") -> None:
    overwrite(merged(_touched(batch, path, partition), batch, keys, order, keep_first), path, partition)


def metric_scope(labels: str = "labels_json"):
    return F.coalesce(F.get_json_object(labels, "$.scope"), F.lit(""))


def merged_metrics(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Unscoped rows add up, a batch's once; scoped rows are replaced by the newest of their key."""
    rows = batch if old is None else old.unionByName(batch)
    scoped = metric_scope().isin(*SCOPES)
    key = ["run_id", "service_name", "metric_name", "_labels"]
    canonical = rows.filter(scoped).withColumn("_labels", F.to_json(F.parse_json("labels_json")))
    newest = canonical.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct("ts", "seq")).alias("_r")).select("_r.*")
    return rows.filter(~scoped).unionByName(newest.select(*rows.columns))


def checkpoints(records: DataFrame) -> DataFrame:
    """Last offset per group, topic, partition and run of a batch."""
    return records.groupBy("consumer_group", "topic_name", "partition_id", "run_id").agg(F.max("offset").alias("last_committed_offset"), F.max("updated_at").alias("updated_at"))


MANIFEST_URI = "concat('/artifacts/runs/', run_id, '/manifests/segments.parquet')"

#: The tables that the writer's stream keeps, merged on read.
TABLES = {
    "tracks": Table(
        "run_id string, track_id bigint, artist_id bigint, genre string, subset string, source_audio_uri string, validation_status string, duration_s double, manifest_uri string, checksum string, created_at timestamp, seq string",
        ("run_id", "track_id"), ("seq",), ("created_at",), digests=("checksum",), follows={"manifest_uri": MANIFEST_URI, "created_at": "try_to_timestamp(seq)"},
    ),
    "features": Table(
        "ts timestamp, run_id string, track_id bigint, segment_idx bigint, artifact_uri string, checksum string, manifest_uri string, rms double, silent_flag boolean, mel_bins bigint, mel_frames bigint, processing_ms double, created_at timestamp, seq string",
        ("run_id", "track_id", "segment_idx"), ("seq",), ("ts", "created_at"), digests=("checksum",),
        follows={"manifest_uri": MANIFEST_URI, "artifact_uri": "concat('/artifacts/runs/', run_id, '/segments/', track_id, '/', segment_idx, '.wav')", "created_at": "try_to_timestamp(seq)"},
    ),
    "metrics": Table(
        "event_id string, ts timestamp, run_id string, service_name string, metric_name string, metric_value double, labels_json string, unit string, seq string, metric_key string",
        ("run_id", "metric_key"), ("ts", "seq"), arrival=False, hot="get_json_object(labels_json, '$.scope') = 'run_total'",
        follows={"metric_key": "concat_ws(char(31), service_name, metric_name, labels_json)"},
    ),
    "checkpoints": Table("consumer_group string, topic_name string, partition_id int, run_id string, last_committed_offset bigint, updated_at timestamp", ("run_id", "consumer_group", "topic_name", "partition_id"), ("last_committed_offset", "updated_at"), arrival=False),
    "quarantine": Table(
        "topic string, partition int, offset bigint, value string, event_type string, run_id string, trace_id string, track_id bigint, segment_idx int, reasons string, failure_class string, retryable boolean",
        ("run_id", "topic", "partition", "offset", "value"),
    ),
}


def store(spark: SparkSession, root: str, **settings: int) -> Store:
    return Store(spark, root, TABLES, **settings)


def scoped_key(labels: Column) -> Column:
    """Key of a scoped metric; ``labels`` as JSON with sorted keys and without spaces."""
    return F.concat_ws("\x1f", "service_name", "metric_name", labels)


def keyed_metrics(rows: DataFrame) -> DataFrame:
    """``metric_key``: what a scoped metric replaces, and an event's id where rows add up."""
    scoped = scoped_key(F.to_json(F.parse_json("labels_json")))
    return rows.withColumn("metric_key", F.when(metric_scope().isin(*SCOPES), scoped).otherwise(F.col("event_id").cast("string")))


def filled(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with all columns of a table, null where they have none."""
    fields = rows.sparkSession.createDataFrame([], TABLES[name].schema).schema
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def merge_manifest(batch: DataFrame, path: str) -> None:
    """Old and new manifest rows, the last of each key, in key order inside a file; a run's files split its keys."""
    keys = ["run_id", "track_id", "segment_idx"]
    out = merged(_touched(batch, path, "run_id"), batch, keys, "artifact_uri")
    overwrite(out.repartitionByRange(*keys).sortWithinPartitions(*keys), path)


def purge_run(spark: SparkSession, path: str, run_id: str) -> bool:
    """Delete a run's partition of one table; True if it was there. Tables of a ``store`` go by ``Store.purge``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run_id}")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_csv(df: DataFrame, path: str, columns: list[str], compression: str = "none") -> None:
    """CSV in a fixed column order; nulls and empty texts are empty fields."""
    df.select(*columns).write.mode("overwrite").option("compression", compression).option("header", "true").option("nullValue", "").option("emptyValue", "").option("lineSep", "\n").csv(path)


def write_splits(rows: DataFrame, path: str, schema: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> None:
    """A Parquet folder per split with a fixed schema; empty splits have the schema too."""
    fields = rows.sparkSession.createDataFrame([], schema).schema
    rows = rows.persist()  # read once per split
    fixed = rows.select("split", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields if f.name != "split"])
    for s in splits:
        fixed.filter(F.col("split") == s).select(*[f.name for f in fields]).write.mode("overwrite").parquet(f"{path}/{s}")
    rows.unpersist()


def json_document(df: DataFrame) -> DataFrame:
    """Rows as JSON objects with sorted keys: one ``value`` column."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_document(df).coalesce(1).write.mode("overwrite").text(path)


def publish(spark: SparkSession, root: str, name: str, build: Callable[[str], None]) -> str:
    """Build in ``root/_staging/name``, then put it in the place of ``root/name`` by renames.

    The old version stays aside until the new one stands.
    """
    if not name or "/" in name or name.startswith((".", "_")):
        raise ValueError(f"not a plain name: {name!r}")
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")
    fs = path(name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staging, old = path(f"_staging/{name}"), path(f"_staging/{name}.old")
    for p in (staging, old):
        fs.delete(p, True)
    fs.mkdirs(staging.getParent())
    build(f"{root}/_staging/{name}")
    if fs.exists(path(name)):
        fs.rename(path(name), old)
    if not fs.rename(staging, path(name)):
        raise OSError(f"could not publish {name}")
    fs.delete(old, True)
    return f"{root}/{name}"


def publish_topic(events: DataFrame, path: str) -> None:
    """Records with their place (``topic, partition, offset, key, value``) appended to a folder, as a topic's reader gives them."""
    events.select("topic", "partition", "offset", "key", "value").write.mode("append").option("compression", "zstd").parquet(path)


def moved(spark: SparkSession, source: str, path: str) -> None:
    """Files of a folder go to another one by renames, so that nothing is written again; the folder's name becomes a part of theirs."""
    fs, old = filesystem(spark, source)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs.mkdirs(new)
    if not fs.exists(old):
        return
    for f in fs.listStatus(old):
        name = f.getPath().getName()
        if not name.startswith(("_", ".")) and not fs.rename(f.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new, f"{old.getName().replace('=', '-')}-{name}")):
            raise OSError(f"could not move {name}")


def dropped(spark: SparkSession, path: str) -> None:
    """A folder that nothing reads any more goes, before what follows needs its space."""
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def publish_records(events: DataFrame, path: str) -> None:
    """Records (``key``, ``value``) appended to a folder; a topic sink takes the same two columns."""
    events.select("key", "value").write.mode("overwrite").parquet(path)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files of a bundle with size and digest, by path."""
    return artifacts(spark, root).orderBy("path")
