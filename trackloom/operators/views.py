"""Run and track views: projections, aggregations and joins over the domain tables.

Every function takes DataFrames and returns one, without an action, so it serves batch
queries and micro-batches alike. Aggregations keep ``run_id`` among their keys, so that a
predicate on it reaches the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in ``order``; partial aggregation before the shuffle.

    Name enough columns in ``order`` to settle ties.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def ratio(flag: Column) -> Column:
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


def feature_summary(features: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments_persisted"),
        F.avg("rms").alias("avg_rms"),
        F.avg("processing_ms").alias("avg_processing_ms"),
        F.sum(F.when(F.col("silent_flag"), 1).otherwise(0)).alias("silent_segments"),
        ratio(F.col("silent_flag")).alias("silent_ratio"),
    )


def latest_metric_ts(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("run_id", "service_name", "metric_name").agg(F.max("ts").alias("latest_ts"))


def label(name: str, column: str = "labels_json") -> Column:
    """A label as text, or null."""
    return F.get_json_object(column, f"$.{name}")


def number_label(name: str, kind: str, column: str = "labels_json") -> Column:
    """A label as a number, only if JSON holds a whole number there (``"7"`` does not count)."""
    value = F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", kind))


def metric_events(metrics: DataFrame) -> DataFrame:
    """Scope, status, topic, failure class, partition and offset out of the labels."""
    failed = F.col("metric_name").isin("feature_errors", "write_failures")
    return metrics.withColumns(
        {
            "metric_scope": F.coalesce(label("scope"), F.lit("event")),
            "metric_status": F.coalesce(label("status"), F.when(failed, "error").otherwise("ok")),
            "topic_name": label("topic"),
            "failure_class": label("failure_class"),
            "kafka_partition": number_label("partition", "int"),
            "kafka_offset": number_label("offset", "bigint"),
        }
    )


def run_total_metrics(events: DataFrame) -> DataFrame:
    """Newest run-total row per run, service and metric; ties by ``event_id`` where it exists."""
    order = ["ts", *[c for c in ("event_id",) if c in events.columns], "metric_value"]
    rows = events.filter("metric_scope = 'run_total'").select("run_id", "service_name", "metric_name", "metric_value", "unit", *order[:-1])
    return latest_by(rows, ["run_id", "service_name", "metric_name"], order)


def run_validation(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("run_id", "validation_status").agg(F.count(F.lit(1)).alias("track_count"))


def run_ids(*tables: DataFrame) -> DataFrame:
    """Distinct runs over tables; each side is made distinct before the union."""
    return reduce(DataFrame.union, [t.select("run_id").distinct() for t in tables]).distinct()


def activity(tracks: DataFrame, features: DataFrame, metrics: DataFrame) -> DataFrame:
    """All observation times: union of the three tables."""
    return (
        tracks.select("run_id", F.col("created_at").alias("observed_at"))
        .unionAll(features.select("run_id", "ts"))
        .unionAll(metrics.select("run_id", "ts"))
    )


def activity_window(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"))


RUN_TOTALS = (
    ("tracks_total", "ingestion", "tracks_total"),
    ("segments_total", "ingestion", "segments_total"),
    ("validation_failures", "ingestion", "validation_failures"),
    ("artifact_write_ms", "ingestion", "artifact_write_ms"),
    ("reported_silent_ratio", "processing", "silent_ratio"),
)


def run_totals(totals: DataFrame) -> DataFrame:
    """Run-total rows turned into one row per run."""
    pick = lambda s, m: F.max(F.when((F.col("service_name") == s) & (F.col("metric_name") == m), F.col("metric_value")))
    return totals.groupBy("run_id").agg(*[pick(s, m).alias(c) for c, s, m in RUN_TOTALS])


def error_summary(metrics: DataFrame) -> DataFrame:
    is_ = lambda s, m: (F.col("service_name") == s) & (F.col("metric_name") == m)
    return metrics.groupBy("run_id").agg(
        F.count_if(is_("processing", "feature_errors")).alias("processing_error_count"),
        F.count_if(is_("writer", "write_failures")).alias("writer_error_count"),
    )


def run_summary(tracks: DataFrame, features: DataFrame, metrics: DataFrame) -> DataFrame:
    """The 15-column run summary; every side is one row per run before it is joined."""
    ids = run_ids(tracks, features, metrics)
    totals = run_totals(run_total_metrics(metric_events(metrics)))
    parts = [activity_window(activity(tracks, features, metrics)), totals, feature_summary(features), error_summary(metrics)]
    out = reduce(lambda a, b: a.join(b, "run_id", "left"), parts, ids)
    zero = lambda c, z: F.coalesce(c, F.lit(z))
    failures, total = zero("validation_failures", 0.0), zero("tracks_total", 0.0)
    processing, writer = zero("processing_error_count", 0), zero("writer_error_count", 0)
    return out.select(
        "run_id",
        "first_seen_at",
        "last_seen_at",
        total.alias("tracks_total"),
        zero("segments_total", 0.0).alias("segments_total"),
        failures.alias("validation_failures"),
        zero("artifact_write_ms", 0.0).alias("artifact_write_ms"),
        zero("segments_persisted", 0).alias("segments_persisted"),
        "avg_rms",
        "avg_processing_ms",
        F.coalesce("reported_silent_ratio", "silent_ratio", F.lit(0.0)).alias("silent_ratio"),
        processing.alias("processing_error_count"),
        writer.alias("writer_error_count"),
        (failures + processing + writer).alias("total_error_events"),
        F.when(total > 0, failures / total).otherwise(0.0).alias("error_rate"),
    )


def track_summary(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """Each track with the sums of its segments; tracks without segments stay."""
    sums = feature_summary(features, ("run_id", "track_id"))
    out = tracks.join(sums, ["run_id", "track_id"], "left")
    return out.withColumns(
        {
            "segments_persisted": F.coalesce("segments_persisted", F.lit(0)),
            "silent_segments": F.coalesce("silent_segments", F.lit(0)),
        }
    ).withColumn("track_state", track_state())


def track_state() -> Column:
    return F.when(F.col("segments_persisted") > 0, "persisted").otherwise("metadata_only")


def run_state() -> Column:
    """State of a run-summary row; the first that fits."""
    clean = (F.col("processing_error_count") == 0) & (F.col("writer_error_count") == 0)
    done = (F.col("segments_persisted") > 0) & clean
    return (
        F.when(done & (F.col("validation_failures") == 0), "persisted")
        .when(done, "mixed")
        .when((F.col("validation_failures") > 0) & (F.col("tracks_total") > 0), "metadata_only")
        .when(~clean, "errors")
        .otherwise("empty")
    )


def pipeline_stages(summary: DataFrame) -> DataFrame:
    """Five stage values per run, from the summary with ``has_outcomes, manifest_exists, state_error``."""
    signals = ("tracks_total", "segments_total", "validation_failures", "segments_persisted", "total_error_events")
    seen = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in signals])
    errors = (F.col("processing_error_count") > 0) | (F.col("writer_error_count") > 0)
    out = summary.withColumns(
        {
            "metadata": F.when(seen, "ready").otherwise("empty"),
            "validation": F.when(~seen, "empty").when(F.col("validation_failures") > 0, "degraded").when(F.col("has_outcomes"), "ready").otherwise("unknown"),
            "features": F.when(errors, "failed").when(F.col("segments_persisted") > 0, "ready").otherwise("empty"),
            "artifacts": F.when(F.col("segments_persisted") <= 0, "empty")
            .when(F.col("state_error").isNotNull(), "degraded")
            .when(F.col("manifest_exists"), "ready")
            .otherwise("degraded"),
        }
    )
    values = F.array_distinct(F.array("metadata", "validation", "features", "artifacts"))
    review = (
        F.when(values == F.array(F.lit("empty")), "empty")
        .when(values == F.array(F.lit("ready")), "ready")
        .when(F.array_contains(values, "unknown"), "unknown")
        .otherwise("degraded")
    )
    return out.withColumn("review", review).select("run_id", "metadata", "validation", "features", "artifacts", "review")


# ---------------------------------------------------------------- paging and top rows


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with ``total_count`` and ``has_more``; a page past the end has no rows.

    The total is a scalar of its own, not a window over all rows in one task.
    """
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total_count") > offset + limit)


def by_recency() -> list[Column]:
    return [F.col("last_seen_at").desc_nulls_last(), F.col("run_id").desc()]


def recent_runs(summary: DataFrame, n: int = 20) -> DataFrame:
    return summary.orderBy(*by_recency()).limit(n)


def pinned_runs(summary: DataFrame, pinned: list[str]) -> DataFrame:
    """Runs of a given list, in its order (``pos``)."""
    spark = summary.sparkSession
    wanted = spark.createDataFrame([(p, i) for i, p in enumerate(pinned)], "run_id string, pos int")
    return summary.join(F.broadcast(wanted), "run_id").orderBy("pos", *by_recency())


# ---------------------------------------------------------------- panels


def series(df: DataFrame, interval: str, metric: Column, value: Column, start=None, stop=None) -> DataFrame:
    """``time, metric, value`` per tumbling bucket; the time range is pushed to the scan."""
    if start is not None:
        df = df.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(stop)))
    bucket = F.window(F.col("ts").cast("timestamp"), interval)
    return df.groupBy(bucket.alias("_w"), metric.alias("metric")).agg(value.alias("value")).select(
        F.col("_w.start").cast("timestamp_ntz").alias("time"), "metric", "value"
    )


def bar(summary: DataFrame, value: Column, keep: Column | None = None) -> DataFrame:
    rows = summary if keep is None else summary.filter(keep)
    return recent_runs(rows).select(F.col("run_id").alias("metric"), value.alias("value"))


def percent(c: Column) -> Column:
    return F.round(c * 100, 2)


def writer_expectation(tracks: DataFrame, features: DataFrame, totals: int = 4, per_segment: int = 2) -> DataFrame:
    """Records that a writer must have seen per run, by topic and together."""
    t = tracks.groupBy("run_id").agg(F.count(F.lit(1)).alias("metadata_records"))
    f = features.groupBy("run_id").agg(F.count(F.lit(1)).alias("feature_records"))
    out = t.join(f, "run_id", "full_outer").fillna(0, ["metadata_records", "feature_records"])
    out = out.withColumn("metric_records", F.lit(totals) + per_segment * F.col("feature_records"))
    return out.withColumn("expected_records", F.col("metadata_records") + F.col("feature_records") + F.col("metric_records"))


def ingestion_totals(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """Four run-total metric rows per run."""
    t = tracks.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("double").alias("tracks_total"),
        F.count_if(F.col("validation_status") != "validated").cast("double").alias("validation_failures"),
    )
    f = features.groupBy("run_id").agg(F.count(F.lit(1)).cast("double").alias("segments_total"), F.round(F.sum("processing_ms"), 3).alias("artifact_write_ms"))
    both = t.join(f, "run_id", "left").fillna(0.0)
    stack = "stack(4, 'tracks_total', tracks_total, 'segments_total', segments_total, 'validation_failures', validation_failures, 'artifact_write_ms', artifact_write_ms)"
    return both.selectExpr("run_id", f"{stack} as (metric_name, metric_value)")


def silent_ratio(features: DataFrame) -> DataFrame:
    """Silent share over distinct segments; ``conflicts`` counts segments with both flags."""
    each = features.groupBy("run_id", "track_id", "segment_idx").agg(F.min("silent_flag").alias("low"), F.max("silent_flag").alias("high"))
    return each.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("segments"), ratio(F.col("high")).alias("silent_ratio"), F.count_if(F.col("low") != F.col("high")).alias("conflicts")
    )


def run_observation(tracks: DataFrame, features: DataFrame, metrics: DataFrame) -> DataFrame:
    """Counts and activity span per run, as an evaluation wants them."""
    t = tracks.groupBy("run_id").agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("validation_status") == "validated").alias("validated"))
    f = features.groupBy("run_id").agg(F.count(F.lit(1)).alias("segments"))
    w = metrics.filter("service_name = 'writer' and metric_name = 'write_ms'").groupBy("run_id").agg(F.count(F.lit(1)).alias("writer_records"))
    span = activity_window(activity(tracks, features, metrics)).select("run_id", activity_span_ms("first_seen_at", "last_seen_at").alias("activity_span_ms"))
    out = reduce(lambda a, b: a.join(b, "run_id", "left"), [t, f, w, span], run_ids(tracks, features, metrics))
    return out.fillna(0, ["tracks", "validated", "segments", "writer_records"])


def activity_span_ms(first: str, last: str) -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return F.greatest((micros(last) - micros(first)) / 1000.0, F.lit(0.0))
