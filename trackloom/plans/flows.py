"""Registered queries of whole flows: event production, processing streams, sinks, bundles, snapshot gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import scalars
from trackloom.operators import bundle as bundles
from trackloom.operators import contract, reconcile
from trackloom.plans import domain, queries
from trackloom.plans.domain import with_tables
from trackloom.plans.queries import ALL3, FE, GATE_SQL, MF, METRIC_DEDUPE, M, T, query, r6, summary_of
from trackloom.plans.roundtrips import BYTES_SQL, PLACES_SQL, ROCKS, STATE_PROVIDER, as_wav, persisted, shared, stored_state, track_events
from trackloom.sources import readers, sinks
from trackloom.streaming import pipelines, stages, state

AT = "2026-04-02T00:00:11Z"
#: One state store a partition for both sides of a join of streams, in place of four; needs RocksDB.
JOIN_STATE = "spark.sql.streaming.join.stateFormatVersion"


# ---------------------------------------------------------------- sinks


@query("snk_metrics", METRIC_DEDUPE)
def _(s, d):
    """Three batches into a stored table, one delivered twice, one again by another writer; then compaction."""
    tables = sinks.store(s, shared(s, "metrics"))
    m = sinks.filled(sinks.keyed_metrics(M(s, d).withColumn("seq", F.lpad(F.col("event_id").cast("string"), 20, "0"))), "metrics")
    for k, writer, n in ((0, "a", 0), (1, "a", 1), (1, "a", 1), (2, "a", 2), (0, "b", 0)):
        tables.commit({"metrics": m.filter(F.col("event_id").cast("bigint") % 3 == k)}, writer, n)
        if n == 1:
            tables.compact("metrics")
    names = ("event_id", "run_id", "metric_name", "metric_value")
    return tables.read("metrics", columns=names).withColumn("event_id", F.col("event_id").cast("bigint"))


@query("snk_upsert_features", with_tables("features") + """ SELECT run_id, track_id, segment_idx, min(ts) AS ts, arg_max(rms, (ts, processing_ms, rms)) AS rms FROM features GROUP BY ALL""")
def _(s, d):
    """Three batches in order of time, the second one delivered twice; compacted after the second and read merged after the third."""
    tables = sinks.store(s, shared(s, "features"))
    ms = lambda c: F.format_string("%020.6f", c)
    f = FE(s, d).withColumn("seq", F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), ms("processing_ms"), ms(F.col("rms") + 1_000_000)))
    year = F.year("ts")
    for low, high, n in ((0, 1996, 0), (1996, 1999, 1), (1996, 1999, 1), (1999, 9999, 2)):
        if tables.commit({"features": sinks.filled(f.filter((year >= low) & (year < high)), "features")}, "a", n) and n == 1:
            tables.compact("features")
    names = ("run_id", "track_id", "segment_idx", "ts", "rms")
    return tables.read("features", columns=names).select("run_id", "track_id", F.col("segment_idx").cast("int").alias("segment_idx"), F.col("ts").cast("timestamp_ntz").alias("ts"), "rms")


@query("snk_upsert_tracks", with_tables("tracks") + " SELECT run_id, track_id, CASE WHEN track_id % 3 = 1 THEN upper(genre) || '!' ELSE genre END AS genre, created_at FROM tracks")
def _(s, d):
    """Tracks in three batches; a third of them come again with another genre and a later time, and keep their first time."""
    tables = sinks.store(s, shared(s, "tracks"))
    t = T(s, d).withColumn("seq", F.lit("1"))
    again = t.filter("track_id % 3 = 1").withColumns({"seq": F.lit("2"), "genre": F.concat(F.upper("genre"), F.lit("!")), "created_at": F.col("created_at") + F.expr("interval 1 day")})
    for n, part in enumerate((t.filter("track_id % 2 = 0"), t.filter("track_id % 2 = 1"), again)):
        tables.commit({"tracks": sinks.filled(part, "tracks")}, "a", n)
    return tables.read("tracks", columns=("run_id", "track_id", "genre", "created_at")).select("run_id", "track_id", "genre", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("snk_envelopes", with_tables("tracks") + """ SELECT CAST(track_id AS VARCHAR) AS key, 'audio.metadata:v1:' || run_id || ':' || track_id AS idempotency_key, artist_id,
  'event_id,event_type,event_version,idempotency_key,payload,produced_at,run_id,source_service,trace_id' AS fields,
  'artist_id,checksum,duration_s,genre,manifest_uri,run_id,source_audio_uri,subset,track_id,validation_status' AS payload_fields, 0 AS spaces FROM tracks""")
def _(s, d):
    """Records as published: keyed by track, compact, with sorted keys."""
    path = shared(s, "published")
    sinks.publish_records(track_events(s, d), path)
    out = s.read.parquet(path)
    text = lambda f: F.get_json_object("value", f"$.{f}")
    names = lambda c: F.array_join(F.json_object_keys(c), ",")
    return out.select(
        "key", text("idempotency_key").alias("idempotency_key"), text("payload.artist_id").cast("long").alias("artist_id"), names(F.col("value")).alias("fields"),
        names(text("payload")).alias("payload_fields"), F.regexp_count("value", F.lit('[:,] ')).alias("spaces"),
    )


# ---------------------------------------------------------------- ingestion and processing


@query("st_ingest_events", with_tables("tracks", "manifest") + """, rd AS (SELECT * FROM manifest WHERE segment_idx < 100)
  SELECT 'audio.metadata' AS event_type, run_id, '' AS metric_name, count(*) AS events, CAST(0 AS DOUBLE) AS total FROM tracks GROUP BY ALL
  UNION ALL SELECT 'audio.segment.ready', run_id, '', count(*), 0 FROM rd GROUP BY ALL
  UNION ALL SELECT 'system.metrics', run_id, 'tracks_total', 1, count(*) FROM tracks GROUP BY ALL
  UNION ALL SELECT 'system.metrics', run_id, 'validation_failures', 1, count(*) FILTER (WHERE validation_status <> 'validated') FROM tracks GROUP BY ALL
  UNION ALL SELECT 'system.metrics', run_id, 'segments_total', 1, (SELECT count(*) FROM rd WHERE rd.run_id = r.run_id) FROM (SELECT DISTINCT run_id FROM tracks) r""")
def _(s, d):
    path = shared(s, "ingested")
    sinks.publish_records(stages.ingestion_events(T(s, d), MF(s, d).filter("segment_idx < 100"), F.lit(AT)), path)
    rows = contract.valid(contract.checked(s.read.parquet(path).select("value")))
    field = lambda f: F.get_json_object("payload", f"$.{f}")
    out = rows.groupBy("event_type", "run_id", F.coalesce(field("metric_name"), F.lit("")).alias("metric_name"))
    return out.agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(field("metric_value").cast("double")), F.lit(0.0)).alias("total"))


def turns(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(segment events, artifacts): every conversation turn is a segment, some of them silence; some
    artifacts are absent, changed, or no audio."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sound = as_wav(F.when(F.col("turn") % 4 == 2, F.unhex(F.repeat(F.lit("80"), 96_000))).otherwise(text))
    c = domain.table(s, d, "conversations").select("conv_id", "turn", F.when((F.col("conv_id") % 10 == 5) & (F.col("turn") == 0), text).otherwise(sound).alias("content"))
    run, track, idx = F.concat(F.lit("run-"), (F.col("conv_id") % 5).cast("string")), F.col("conv_id"), F.col("turn").cast("int")
    c = c.select(
        run.alias("run_id"), track.alias("track_id"), idx.alias("segment_idx"), scalars.segment_uri(run, track, idx).alias("artifact_uri"), "content",
        scalars.sha256_ref(F.col("content")).alias("checksum"), F.lit(32000).alias("sample_rate"), F.lit(3.0).alias("duration_s"), F.lit(False).alias("is_last_segment"),
    )
    changed = F.when((F.col("track_id") % 10 == 4) & (F.col("segment_idx") == 1), F.concat("content", F.unhex(F.lit("00")))).otherwise(F.col("content"))
    artifacts = c.filter("not (track_id % 10 = 3 and segment_idx = 0)").select("artifact_uri", changed.alias("content"))
    return contract.envelopes(c, "audio.segment.ready", "ingestion", F.lit(AT), F.concat_ws("/", track_text(), "segment_idx")), artifacts


def track_text():
    return F.col("track_id").cast("string")


INGEST_SQL = BYTES_SQL.format(text="text", table="(SELECT {'c': conv_id, 't': turn} AS doc_id, text FROM conversations)") + """, t AS (
  SELECT conv_id, turn, 'run-' || (conv_id % 5) AS run_id, turn % 4 = 2 AS quiet, CASE WHEN conv_id % 10 = 3 AND turn = 0 THEN 'artifact_missing' WHEN conv_id % 10 = 4 AND turn = 1 THEN 'checksum_mismatch'
    WHEN conv_id % 10 = 5 AND turn = 0 OR coalesce(text, '') = '' AND turn % 4 <> 2 THEN 'decode_error' END AS failure_class, level
  FROM conversations LEFT JOIN r ON r.doc_id = {'c': conv_id, 't': turn}
)"""


@query("st_ingest", INGEST_SQL + """ SELECT 'feature' AS kind, run_id, conv_id AS track_id, CAST(turn AS INTEGER) AS segment_idx, CASE WHEN failure_class IS NULL THEN CASE WHEN quiet THEN -60.0 ELSE round(20 * log10(level), 3) END END AS value, failure_class FROM t
  UNION ALL SELECT 'silent_ratio', run_id, -1, -1, round(avg(CASE WHEN quiet THEN 1.0 ELSE 0.0 END), 6), NULL FROM t WHERE failure_class IS NULL GROUP BY run_id""")
def _(s, d):
    """A stream of segment events in two triggers, the second one with all of the first again: feature events, each
    once, failures by class, and each run's last silent ratio."""
    s.conf.set(STATE_PROVIDER, ROCKS)
    events, artifacts = turns(s, d)
    src, out, stored = shared(s, "ready"), shared(s, "processed"), shared(s, "artifacts")
    artifacts.write.parquet(stored)
    for part in (events.filter(F.xxhash64("value") % 2 == 0), events):
        part.select("value").write.mode("append").text(src)
        stages.ingest(readers.records(s, src, streaming=True), s.read.parquet(stored), out, f"{out}-cp", F.lit(AT)).awaitTermination()
    made = s.read.parquet(f"{out}/events").select("value", "batch_id")
    made = contract.valid(contract.checked(made)).drop("value")
    field = lambda f: F.get_json_object("payload", f"$.{f}")
    nothing = F.lit(None).cast("string").alias("failure_class")
    rows = made.filter("event_type = 'audio.features'").select(
        F.lit("feature").alias("kind"), "run_id", field("track_id").cast("long").alias("track_id"), field("segment_idx").cast("int").alias("segment_idx"), F.round(field("rms").cast("double"), 3).alias("value"), nothing
    )
    failed = s.read.parquet(f"{out}/failures").drop("batch_id").distinct().select(F.lit("feature").alias("kind"), "run_id", "track_id", "segment_idx", F.lit(None).cast("double").alias("value"), "failure_class")
    last = made.filter(field("metric_name") == "silent_ratio").groupBy("run_id").agg(F.max_by(field("metric_value").cast("double"), "batch_id").alias("value"))
    ratio = last.select(F.lit("silent_ratio").alias("kind"), "run_id", F.lit(-1).cast("long").alias("track_id"), F.lit(-1).alias("segment_idx"), F.round("value", 6).alias("value"), nothing)
    return rows.unionByName(failed).unionByName(ratio)


@query("st_vector_state", queries.SQL["agg_vector_welford"].replace("SELECT label, CAST(bin AS INTEGER) AS bin, count(*) AS count", "SELECT CAST(label AS VARCHAR) AS run_id, CAST(bin AS INTEGER) AS bin, count(*) AS count").replace(" round(var_samp(x), 6) AS variance, round(stddev_samp(x), 6) AS std,", "").replace("GROUP BY ALL", "WHERE label IS NOT NULL GROUP BY label, bin"))
def _(s, d):
    """Embeddings through keyed state, every vector delivered twice."""
    s.conf.set(STATE_PROVIDER, ROCKS)
    src, out = shared(s, "vectors"), shared(s, "moments")
    v = domain.table(s, d, "embeddings").filter("label is not null").select(F.col("label").cast("string").alias("run_id"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    v.write.parquet(src)
    v.write.mode("append").parquet(src)
    stream = state.vector_state(s.readStream.schema(v.schema).parquet(src), shards=4)
    stream.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).option("checkpointLocation", f"{src}-cp").trigger(availableNow=True).start().awaitTermination()
    return r6(stages.merged_moments(s.read.parquet(out)), "mean", "m2").select("run_id", "bin", "count", "mean", "m2")


# ---------------------------------------------------------------- bundles


BUNDLE_SQL = f"""{GATE_SQL}, it AS (
  SELECT 'run-summary.json' AS path, count(*) AS row_count FROM summary UNION ALL SELECT 'quality-verdict.json', count(*) FROM vd UNION ALL SELECT 'accepted-tracks.csv', count(*) FROM ac
  UNION ALL SELECT 'rejected-tracks.csv', count(*) FROM jd WHERE rejection_reason IS NOT NULL UNION ALL SELECT 'accepted-segments.csv', count(*) FROM sg UNION ALL SELECT 'rejected-segments.csv', count(*) FROM rj
  UNION ALL SELECT 'anomaly-summary.json', count(*) FROM (SELECT DISTINCT run_id, severity, anomaly_type FROM aa) UNION ALL SELECT 'label-map.json', count(*) FROM lb UNION ALL SELECT 'dataset-card.md', count(*) FROM vd
  UNION ALL SELECT 'splits/split-manifest.json', count(DISTINCT run_id) FROM rw UNION ALL SELECT 'splits/' || v || '.parquet', (SELECT count(*) FROM rw WHERE split = v) FROM (VALUES ('train'), ('validation'), ('test')) t(v)
  UNION ALL SELECT 'stats/normalization-stats.json', count(DISTINCT run_id) FROM rw WHERE split = 'train')"""


def written_bundle(s: SparkSession, d: str) -> str:
    paths: list[str] = []
    stored = queries.stored(s, paths)
    seen = FE(s, d).groupBy("run_id").agg(F.date_format(F.max("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"))
    path = bundles.write(queries.bundle(s, d, stored=stored, wanted=queries.MEASURES), stored(summary_of(s, d), "summary"), seen, shared(s, "datasets"), "build")
    for p in paths:  # tables that the bundle was made of
        sinks.dropped(s, p)
    return path


@query("ds_bundle", BUNDLE_SQL + """, g AS (SELECT run_id, strftime(max(ts)::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS generated_at FROM features GROUP BY 1)
  SELECT run_id, generated_at, path, row_count, true AS digested FROM it, g JOIN (SELECT run_id FROM summary) USING (run_id)""")
def _(s, d):
    rows = bundles.manifest(s, written_bundle(s, d))
    return rows.select("run_id", "generated_at", "path", "row_count", F.col("sha256").rlike("^[0-9a-f]{64}$").alias("digested"))


@query("ds_bundle_check", with_tables("tracks") + """ SELECT 'whole' AS bundle, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unexpected, CAST(0 AS BIGINT) AS listed_wrong, CAST(0 AS BIGINT) AS runs_apart, true AS ok
  UNION ALL SELECT 'damaged', 1, 1, 0, (SELECT count(DISTINCT run_id) FROM tracks) - 1, false""")
def _(s, d):
    """A bundle as written; then without one item, with a foreign one, and with the verdict of one run only."""
    path = written_bundle(s, d)
    whole = bundles.checked(s, path).withColumn("bundle", F.lit("whole"))
    kept = shared(s, "check")
    whole.write.parquet(kept)
    s.read.text(f"{path}/label-map.json").write.text(f"{path}/extra.json")
    fs = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/label-map.json")
    fs.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(fs, True)
    verdicts = [r[0] for r in s.read.text(f"{path}/quality-verdict.json").orderBy("value").limit(1).collect()]
    s.createDataFrame([(v,) for v in verdicts], "value string").write.mode("overwrite").text(f"{path}/quality-verdict.json")
    damaged = bundles.checked(s, path).withColumn("bundle", F.lit("damaged"))
    return s.read.parquet(kept).unionByName(damaged)


# ---------------------------------------------------------------- snapshot gates


@query("gate_writer_snapshot", ALL3 + PLACES_SQL + """, f AS (SELECT DISTINCT run_id, track_id, segment_idx FROM features), e AS (
  SELECT 'tracks' AS check_name, count(*) AS expected, count(*) AS observed FROM tracks UNION ALL SELECT 'features', count(*), count(*) FILTER (WHERE run_id <> 'run-2') FROM f
  UNION ALL SELECT 'tracks upserted twice', 0, 0 UNION ALL SELECT 'features upserted twice', 0, 0), mm AS (SELECT *, coalesce(json_extract_string(labels_json, '$.scope'), '') AS sc FROM metrics), p AS (
  SELECT run_id, service_name, metric_name, labels_json FROM mm WHERE sc = '' UNION ALL SELECT DISTINCT run_id, service_name, metric_name, labels_json FROM mm WHERE sc <> ''), z AS (
  SELECT 'shape/' || service_name || '/' || metric_name AS check_name, count(*) AS n FROM p GROUP BY 1
  UNION ALL SELECT 'rows_upserted', count(*) FROM places UNION ALL SELECT 'rows_upserted other than 1', 0
  UNION ALL SELECT 'topic/' || service_name || '/' || json_extract_string(labels_json, '$.topic'), count(*) FROM p WHERE json_extract_string(labels_json, '$.topic') IS NOT NULL GROUP BY 1)
  SELECT *, expected = observed AS ok FROM (FROM e UNION ALL SELECT check_name, n, n FROM z)""")
def _(s, d):
    """What the writer's stream stored against what its events imply; a run's features are purged on the way."""
    tables = sinks.store(s, persisted(s, d))
    kept = tables.read("features").filter("run_id <> 'run-2'")  # rows that the gate must miss
    stored = [tables.read("tracks"), kept, tables.read("metrics").filter("metric_name <> 'rows_upserted'")]
    m = sinks.merged_metrics(None, M(s, d).withColumn("seq", F.col("event_id")))
    keys = FE(s, d).select("run_id", "track_id", "segment_idx").distinct()
    expected, observed = reconcile.sink_counts(T(s, d), keys, m), reconcile.sink_counts(*stored)
    # every record that was stored says that it made one row
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
    upserted = tables.read("metrics").filter("metric_name = 'rows_upserted'")
    records = T(s, d).select("run_id").unionAll(keys.select("run_id")).unionAll(M(s, d).select("run_id"))
    expected = expected.unionByName(one("rows_upserted", records)).unionByName(one("rows_upserted other than 1", records.limit(0)))
    observed = observed.unionByName(one("rows_upserted", upserted)).unionByName(one("rows_upserted other than 1", upserted.filter("metric_value <> 1")))
    return reconcile.counts_agree(expected, observed)


@query("gate_baseline", with_tables("features") + """, k AS (SELECT run_id, track_id, segment_idx, bool_or(silent_flag) AS s FROM features GROUP BY ALL), r AS (SELECT run_id, count(*) AS segments, avg(CASE WHEN s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio FROM k GROUP BY 1)
  SELECT run_id, segments, segments AS state_segments, round(ratio, 6) AS sink_ratio, round(ratio, 6) AS state_ratio, round(ratio + CASE run_id WHEN 'run-3' THEN 0.01 ELSE 0 END, 6) AS metric_ratio, run_id <> 'run-3' AS ok FROM r""")
def _(s, d):
    """The ratio in the sink, in state documents and as a metric; one run's metric is off by a hundredth."""
    state = readers.state_summary(stored_state(s, d))
    path = shared(s, "ratios")
    off = F.when(F.col("run_id") == "run-3", 0.01).otherwise(0.0)
    told = state.select("run_id", F.lit("processing").alias("service_name"), F.lit("silent_ratio").alias("metric_name"), (F.col("silent_ratio") + off).alias("metric_value"))
    told = told.withColumns({"labels_json": F.lit(stages.RUN_TOTAL), "ts": F.lit(AT), "seq": F.lit("0"), "event_id": F.col("run_id")})
    tables = sinks.store(s, path)
    tables.commit({"metrics": sinks.filled(sinks.keyed_metrics(told), "metrics")}, "a", 0)
    return r6(reconcile.ratios_agree(FE(s, d), state, tables.read("metrics")), "sink_ratio", "state_ratio", "metric_ratio")


@query("gate_metric_stream", with_tables("features") + """, k AS (SELECT run_id, track_id, segment_idx, bool_or(silent_flag) AS s FROM features GROUP BY ALL), a AS (SELECT run_id, count(*) AS n, avg(CASE WHEN s THEN 1.0 ELSE 0.0 END) AS ratio,
    count(*) FILTER (WHERE track_id % 20 = 3) AS missing, count(*) FILTER (WHERE track_id % 20 = 7) AS unit, count(*) FILTER (WHERE track_id % 20 = 9) AS labels, count(*) FILTER (WHERE track_id % 20 = 11) AS differs, count(*) FILTER (WHERE track_id % 20 = 13) AS alone FROM k GROUP BY 1)
  SELECT run_id, n - alone + alone AS events, n - missing - alone AS matched, missing AS without_metric, alone AS without_feature, unit AS bad_unit, labels AS bad_labels, differs AS other_value, round(ratio, 6) AS silent_ratio,
    round(ratio + CASE run_id WHEN 'run-3' THEN 0.01 ELSE 0 END, 6) AS told_ratio, missing + alone + unit + labels + differs = 0 AND run_id <> 'run-3' AS ok FROM a""")
def _(s, d):
    """Feature events and processing metrics as two streams, joined where they agree in segment and time. Some metrics are
    missing, of another unit, label or value, some have no feature, and one run's last ratio is off."""
    s.conf.set(STATE_PROVIDER, ROCKS)
    s.conf.set(JOIN_STATE, 3)
    root, out = shared(s, "metric-stream"), shared(s, "joined")
    names = ["run_id", "track_id", "segment_idx"]
    # by a number of partitions, which adaptive plans leave: few bytes a row, much work
    dealt = domain.measured(s, d).repartition(4 * s.sparkContext.defaultParallelism, *names)
    rows = domain.described(dealt.groupBy(*names).agg(F.max("silent_flag").alias("silent_flag"), F.max("processing_ms").alias("processing_ms")))
    rows = rows.withColumns({"manifest_uri": F.lit(None).cast("string"), "rms": F.lit(-3.0), "mel_bins": F.lit(128), "mel_frames": F.lit(300)})
    case = F.col("track_id") % 20
    true = rows.groupBy("run_id").agg(F.avg(F.when(F.col("silent_flag"), 1.0).otherwise(0.0)).alias("silent_ratio"))
    told = true.withColumn("silent_ratio", F.col("silent_ratio") + F.when(F.col("run_id") == "run-3", 0.01).otherwise(0.0))
    made = contract.checked(stages.processing_events(rows.withColumn("processing_ms", F.when(case == 11, F.col("processing_ms") + 1).otherwise(F.col("processing_ms"))), told, F.lit(AT)).select("value"))
    label = lambda f: F.get_json_object("labels_json", f"$.{f}").cast("bigint")
    metrics = contract.routed(made, "system.metrics").withColumns({"track_id": label("track_id"), "segment_idx": label("segment_idx").cast("int")})
    metrics.write.parquet(f"{root}/metrics")  # checked once: the stream's side and the last ratios are read from it
    m = s.read.schema(metrics.schema).parquet(f"{root}/metrics")
    case = F.col("track_id") % 20
    timings = m.filter("metric_name = 'processing_ms'").filter(case != 3).withColumns(
        {"unit": F.when(case == 7, "s").otherwise(F.col("unit")), "labels_json": F.when(case == 9, F.regexp_replace("labels_json", '"status":"ok"', '"status":"error"')).otherwise(F.col("labels_json")), "ts": F.to_timestamp("ts")}
    )
    sides = (
        ("features", rows.filter(F.col("track_id") % 20 != 13).select(F.to_timestamp(F.lit(AT)).alias("ts"), *names, "processing_ms")),
        ("timings", timings.select("ts", *names, "metric_value", "labels_json", "unit", "service_name")),
    )
    for name, side in sides:
        side.write.parquet(f"{root}/{name}")
    later = F.to_timestamp(F.lit(AT)) + F.expr("interval 1 hour")  # a last event of each stream moves the watermarks
    for turn in range(2):
        streams = [s.readStream.schema(side.schema).parquet(f"{root}/{name}") for name, side in sides]
        joined = pipelines.timed_features(*streams)
        joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{root}-cp").trigger(availableNow=True).start().awaitTermination()
        if not turn:
            for name, side in sides:
                first = s.read.schema(side.schema).parquet(f"{root}/{name}").limit(1)
                first.withColumns({"ts": later, "run_id": F.lit("end"), "track_id": F.lit(-1).cast("bigint")}).write.mode("append").parquet(f"{root}/{name}")
    got = s.read.parquet(out).withColumn("run_id", F.coalesce("run_id", "m_run_id")).filter("run_id <> 'end'")
    both = F.col("f_ts").isNotNull() & F.col("m_ts").isNotNull()
    status = F.get_json_object("labels_json", "$.status") != "ok"
    sums = got.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(both).alias("matched"), F.count_if(F.col("m_ts").isNull()).alias("without_metric"), F.count_if(F.col("f_ts").isNull()).alias("without_feature"),
        F.count_if(F.col("unit") != "ms").alias("bad_unit"), F.count_if(status).alias("bad_labels"), F.count_if(both & (F.abs(F.col("feature_ms") - F.col("metric_value")) > 1e-6)).alias("other_value"),
    )
    last = m.filter("metric_name = 'silent_ratio'").select("run_id", F.col("metric_value").alias("told_ratio"))
    out = r6(sums.join(true, "run_id").join(last, "run_id"), "silent_ratio", "told_ratio")
    bad = sum((F.col(c) for c in ("without_metric", "without_feature", "bad_unit", "bad_labels", "other_value")), F.lit(0))
    return out.withColumn("ok", (bad == 0) & (F.abs(F.col("silent_ratio") - F.col("told_ratio")) < 1e-6))
