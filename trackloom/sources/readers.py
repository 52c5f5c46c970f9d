"""Sources: metadata CSV, manifests, artifacts, event records, state documents, stats lines."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import scalars

MANIFEST_COLUMNS = ("run_id", "track_id", "segment_idx", "artifact_uri", "checksum", "manifest_uri", "sample_rate", "duration_s", "is_last_segment")


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Flattened names of a CSV with three header rows; only two lines come to the driver."""
    first = [next(csv.reader([r[0]])) for r in spark.read.text(path).limit(2).collect()]
    if len(first) < 2 or len(first[0]) != len(first[1]):
        raise ValueError("header rows differ in width")
    names, category = ["track_id"], ""
    for i, (top, low) in enumerate(zip(*first)):
        category = top.strip() or category
        if i:
            low = low.strip() or f"_unnamed_{i}"
            names.append(f"{category}.{low}" if category else low)
    return names


def metadata_csv(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """All columns as text, empty text as null; header rows are told by their first column.

    ``header`` names the file that begins with the header rows, if ``path`` is several files.
    """
    names = header_names(spark, header or path)
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.schema(schema).option("nullValue", "").csv(path)
    return rows.filter(F.col("`track_id`").rlike("^\\s*\\d+\\s*$"))


def select_metadata(raw: DataFrame) -> DataFrame:
    """Typed metadata columns, found by lower-cased name; an error lists what is missing."""
    by_name = {c.lower(): c for c in raw.columns}
    wanted = {"track_id": ("track_id", "bigint"), "artist_id": ("artist.id", "bigint"), "subset": ("set.subset", "string"), "genre": ("track.genre_top", "string"), "declared_duration_s": ("track.duration", "double")}
    missing = [n for n, _ in wanted.values() if n not in by_name]
    if missing:
        raise ValueError(f"missing metadata columns: {', '.join(missing)}")
    return raw.select(*[F.trim(F.col(f"`{by_name[n]}`")).try_cast(t).alias(c) for c, (n, t) in wanted.items()])


def subset_rows(meta: DataFrame, subset: str, allow: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a subset with a genre, by track; then the allow list (empty: all) and the first n."""
    rows = meta.filter((F.col("subset") == subset) & F.col("genre").isNotNull() & (F.col("genre") != ""))
    if allow:
        ids = meta.sparkSession.createDataFrame([(i,) for i in allow], "track_id bigint")
        rows = rows.join(F.broadcast(ids), "track_id", "left_semi")
    rows = rows.orderBy("track_id")
    return rows.limit(limit) if limit else rows


def require_positive_duration(meta: DataFrame, column: str = "declared_duration_s") -> DataFrame:
    """``meta``; raises with up to five ids where the duration is null or not positive."""
    bad = [r[0] for r in meta.filter(F.col(column).isNull() | (F.col(column) <= 0)).select("track_id").limit(5).collect()]
    if bad:
        raise ValueError(f"tracks without a positive duration: {bad}")
    return meta


def manifest(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    missing = set(MANIFEST_COLUMNS) - set(df.columns)
    if missing:
        raise ValueError(f"manifest lacks {', '.join(sorted(missing))}")
    return df


def _fields(spark: SparkSession, path: str) -> set[str] | None | str:
    """Columns of the Parquet files at a path, None where there is none, or the error of a footer that cannot be read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    files = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().endswith(".parquet")] if fs.getFileStatus(p).isDirectory() else [p]
    names = None
    for file in files:
        try:
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
        except Py4JJavaError as error:
            return str(error.java_exception.getMessage())
        own = {f.getName() for f in reader.getFooter().getFileMetaData().getSchema().getFields()}
        reader.close()
        names = own if names is None else names & own
    return names


def manifest_scan(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the manifests that can be read, an anomaly row for each that cannot): missing, unreadable, or without a needed column.

    A manifest is one path a run; footers are looked at in parallel, rows are read by Spark from the good ones alone.
    """
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda path: _fields(spark, path), paths))
    bad, good = [], []
    for path, fields in zip(paths, found):
        if fields is None:
            bad.append((path, "segment_manifest_missing", None))
        elif isinstance(fields, str):
            bad.append((path, "segment_manifest_unreadable", fields))
        elif lacking := sorted(set(MANIFEST_NEEDED) - fields):
            bad.append((path, "segment_manifest_schema_invalid", ",".join(lacking)))
        else:
            good.append(path)
    schema = "run_id string, track_id bigint, segment_idx bigint, artifact_uri string, checksum string"
    named = F.col("_metadata.file_path").alias("manifest_file")
    rows = spark.read.option("mergeSchema", "true").parquet(*good).select(*MANIFEST_NEEDED, named) if good else spark.createDataFrame([], schema + ", manifest_file string")
    kinds = {"track_id": "bigint", "segment_idx": "bigint"}
    rows = rows.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})
    return rows, spark.createDataFrame(bad, "manifest_uri string, anomaly_type string, detail string")


MANIFEST_NEEDED = ("run_id", "track_id", "segment_idx", "artifact_uri", "checksum")


def manifest_rows(rows: DataFrame, run_id: str, bucket: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, anomalies): rows of another run, or with a URI that is not their own."""
    key = (F.col("run_id"), F.col("track_id"), F.col("segment_idx"))
    problem = (
        F.when(~F.col("run_id").eqNullSafe(F.lit(run_id)), "manifest_run_id_mismatch")
        .when(F.col("track_id").isNull() | F.col("segment_idx").isNull(), "manifest_key_missing")
        .when(~scalars.segment_uri_ok(F.col("artifact_uri"), *key, bucket), "manifest_uri_invalid")
    )
    marked = rows.withColumn("anomaly_type", problem)
    return marked.filter("anomaly_type is null").drop("anomaly_type"), marked.filter("anomaly_type is not null")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, checksum`` of files below a folder, digested where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), scalars.sha256_ref(F.col("content")).alias("checksum"))


def file_names(spark: SparkSession, root: str) -> DataFrame:
    """Relative paths of files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "path")


def records(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Event records as JSON lines, one column ``value``."""
    return (spark.readStream if streaming else spark.read).text(path)


RECORD = "topic string, partition int, offset bigint, key string, value string"


def topic_records(spark: SparkSession, path: str, streaming: bool = False, files: int | None = None) -> DataFrame:
    """Event records with their place in a topic, as ``kafka_records`` gives them; ``files`` in one trigger."""
    reader = (spark.readStream if streaming else spark.read).schema(RECORD)
    return (reader.option("maxFilesPerTrigger", files) if streaming and files else reader).parquet(path)


def kafka_records(spark: SparkSession, servers: str, topics: list[str], streaming: bool = True) -> DataFrame:
    """Event records of topics; needs the Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    df = reader.option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    return df.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset")


def run_snapshot(run_id: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """The rows of one run from each table; an error if no table has any."""
    out = {k: t.filter(F.col("run_id") == run_id) for k, t in tables.items()}
    some = reduce(DataFrame.union, [t.select("run_id").limit(1) for t in out.values()])
    if some.isEmpty():
        raise LookupError(f"run not found: {run_id}")
    return out


STATE = "run_id string, segments array<struct<track_id: bigint, segment_idx: int, silent_flag: boolean>>"


def processing_state(spark: SparkSession, path: str) -> DataFrame:
    """State documents, one a line, exploded to ``run_id, track_id, segment_idx, silent_flag``; rows of bad type are an error."""
    docs = spark.read.schema(STATE).json(path)
    rows = docs.select("run_id", F.explode("segments").alias("s")).select("run_id", "s.*")
    good = F.col("track_id").isNotNull() & F.col("segment_idx").isNotNull() & F.col("silent_flag").isNotNull()
    return rows.filter(F.assert_true(good, "state row of a wrong type").isNull())


def state_summary(state: DataFrame) -> DataFrame:
    return state.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if("silent_flag").alias("silent_segments"), F.avg(F.when(F.col("silent_flag"), 1.0).otherwise(0.0)).alias("silent_ratio")
    )


SERVICES = ("ingestion", "processing", "writer", "review", "kafka", "timescaledb", "grafana", "minio")


def resource_samples(lines: DataFrame, services: tuple[str, ...] = SERVICES) -> DataFrame:
    """Container stats lines (``value``): service, cpu percent, memory MiB; a BOM and blank lines are skipped."""
    text = F.trim(F.regexp_replace("value", "^\\uFEFF", ""))
    rows = lines.select(text.alias("t")).filter("t != ''")
    rows = rows.select(F.from_json("t", "Name string, Container string, CPUPerc string, MemUsage string").alias("j")).select("j.*")
    return rows.select(
        scalars.service_name(F.coalesce("Name", "Container"), services).alias("service"), scalars.percent(F.col("CPUPerc")).alias("cpu_percent"), scalars.memory_mb(F.col("MemUsage")).alias("memory_mb")
    )
