"""More registered queries: contract rules one by one, files written and read, audio, streams.

Files go to the shared folder (``spark.checkpoint.dir``); what they hold is derived from the
driver's tables.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import scalars
from trackloom.operators import contract, dataset, reconcile, segments, stats, views
from trackloom.plans import domain, queries
from trackloom.plans.domain import with_tables
from trackloom.plans.queries import ALL3, FE, GATE_SQL, MF, SUMMARY_SQL, M, T, bundle, query, r6, summary_of
from trackloom.sources import readers, sinks
from trackloom.streaming import pipelines, state


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; a local one only where none is set and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- contract rules, one by one


def metric_events(s: SparkSession, d: str) -> DataFrame:
    rows = M(s, d).withColumn("ts", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    kinds = [contract.envelopes(rows.filter(F.col("service_name") == v), "system.metrics", v, F.col("ts"), F.col("event_id").cast("string"), offset=F.col("event_id")) for v in ("ingestion", "processing", "writer")]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2])


def track_events(s: SparkSession, d: str) -> DataFrame:
    at = F.lit("2026-04-02T00:00:11Z")
    return contract.envelopes(T(s, d), "audio.metadata", "ingestion", at, F.col("track_id").cast("string"), offset=F.col("track_id"))


def feature_events(s: SparkSession, d: str) -> DataFrame:
    # the texts of a segment follow from its key: they are made after its last row is found, so none of them is sorted
    last = F.max(F.struct("ts", "processing_ms", "rms", "silent_flag", "mel_bins", "mel_frames")).alias("_last")
    rows = domain.measured(s, d).groupBy("run_id", "track_id", "segment_idx").agg(last, F.min("ts").alias("ts"))
    f = domain.described(rows.select("run_id", "track_id", "segment_idx", "_last.processing_ms", "_last.rms", "_last.silent_flag", "_last.mel_bins", "_last.mel_frames", "ts"))
    f = f.withColumn("ts", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    place = F.col("track_id") * 100 + F.col("segment_idx")
    return contract.envelopes(f, "audio.features", "processing", F.col("ts"), F.concat_ws("/", F.col("track_id").cast("string"), F.col("segment_idx").cast("string")), offset=place)


def segment_events(s: SparkSession, d: str) -> DataFrame:
    m = MF(s, d).filter("segment_idx < 100")
    return contract.envelopes(m, "audio.segment.ready", "ingestion", F.lit("2026-04-02T00:00:11Z"), F.concat_ws("/", F.col("track_id").cast("string"), F.col("segment_idx").cast("string")))


def judged(events: DataFrame, pattern: str, text: str, rule: str) -> DataFrame:
    """Every seventh event is damaged by a replacement; ``ok`` says whether the rule passed."""
    event = F.get_json_object("value", "$.event_id")
    n = F.regexp_extract(event, "^(\\d+)", 1).cast("long")
    rows = events.select(event.alias("event"), n.alias("n"), F.when(n % 7 == 0, F.regexp_replace("value", pattern, text)).otherwise(F.col("value")).alias("value"))
    return contract.checked(rows).select("event", (~F.array_contains("reasons", rule)).alias("ok"))


METRIC_OK = "SELECT CAST(event_id AS VARCHAR) AS event, event_id % 7 <> 0 AS ok FROM events"
for _name, _pattern, _text, _rule in (
    ("val_fields", '"trace_id":', '"trace":', "fields"),
    ("val_version_type", '"event_version":"v1"', '"event_version":"v2"', "version"),
    ("val_run_scope", '"trace_id":"run/', '"trace_id":"run', "trace_id"),
    ("val_utc", '"produced_at":"([^"]*)Z"', '"produced_at":"$1+07:00"', "produced_at"),
    ("val_source", '"source_service":"[a-z]+"', '"source_service":"review"', "source_service"),
    ("val_run_match", '("payload":.*"run_id":")run-', "$1ran-", "run_mismatch"),
    ("val_payload_metrics", '"unit":"[a-z]+"', '"unit":""', "payload"),
    ("val_strict_types", '"metric_value":([-0-9.E]+)', '"metric_value":"$1"', "payload"),
    ("val_finite", '"metric_value":([-0-9.E]+)', '"metric_value":NaN', "not_json_object"),
    ("val_idempotency", '"idempotency_key":"', '"idempotency_key":"x', "idempotency_key"),
):

    def _metric_rule(s, d, pattern=_pattern, text=_text, rule=_rule):
        return judged(metric_events(s, d), pattern, text, rule)

    query(_name, METRIC_OK)(_metric_rule)


@query("val_payload_metadata", with_tables("tracks") + " SELECT CAST(track_id AS VARCHAR) AS event, track_id % 7 <> 0 AS ok FROM tracks")
def _(s, d):
    return judged(track_events(s, d), '"subset":"small"', '"subset":"large"', "payload")


@query("val_payload_features", with_tables("features") + " SELECT DISTINCT track_id || '/' || segment_idx AS event, track_id % 7 <> 0 AS ok FROM features")
def _(s, d):
    return judged(feature_events(s, d), '"mel_bins":128', '"mel_bins":0', "payload")


@query("val_payload_segment", with_tables("manifest") + " SELECT track_id || '/' || segment_idx AS event, track_id % 7 <> 0 AS ok FROM manifest WHERE segment_idx < 100")
def _(s, d):
    return judged(segment_events(s, d), '"sample_rate":32000', '"sample_rate":true', "payload")


@query("val_context", with_tables("features") + " SELECT track_id, segment_idx, run_id FROM (SELECT DISTINCT run_id, track_id, segment_idx FROM features) WHERE track_id % 7 = 0")
def _(s, d):
    rows = feature_events(s, d).withColumn("value", F.when(F.regexp_extract(F.get_json_object("value", "$.event_id"), "^(\\d+)", 1).cast("long") % 7 == 0, F.regexp_replace("value", '"v1"', '"v0"')).otherwise(F.col("value")))
    return contract.quarantined(contract.checked(rows)).select("track_id", "segment_idx", "run_id")


@query("prj_envelope", with_tables("tracks") + " SELECT 'audio.metadata:v1:' || run_id || ':' || track_id AS idempotency_key, 'run/' || run_id || '/track/' || track_id AS trace_id, artist_id FROM tracks")
def _(s, d):
    rows = contract.routed(contract.checked(track_events(s, d)), "audio.metadata")
    return rows.select("idempotency_key", "trace_id", "artist_id")


@query("prj_segment_ready", with_tables("manifest") + " SELECT run_id, track_id, segment_idx, artifact_uri, 32000 AS sample_rate, false AS is_last_segment FROM manifest WHERE segment_idx < 100")
def _(s, d):
    rows = contract.routed(contract.checked(segment_events(s, d)), "audio.segment.ready")
    return rows.select("run_id", "track_id", F.col("segment_idx").cast("int").alias("segment_idx"), "artifact_uri", F.col("sample_rate").cast("int").alias("sample_rate"), "is_last_segment")


# ---------------------------------------------------------------- functions and projections


@query("fn_json_text", with_tables("metrics") + " SELECT event_id, json_extract_string(labels_json, '$.status') AS status FROM metrics")
def _(s, d):
    return M(s, d).select("event_id", views.label("status").alias("status"))


@query("fn_json_typeof", with_tables("metrics") + " SELECT event_id, coalesce(json_type(labels_json, '$.partition') IN ('UBIGINT', 'BIGINT'), false) AS is_number FROM metrics")
def _(s, d):
    return M(s, d).select("event_id", views.number_label("partition", "int").isNotNull().alias("is_number"))


@query("fn_json_has_key", with_tables("metrics") + " SELECT event_id, list_contains(json_keys(labels_json), 'topic') AS has_topic FROM metrics")
def _(s, d):
    return M(s, d).select("event_id", scalars.has_key(F.col("labels_json"), "topic").alias("has_topic"))


@query("fn_sha256", "SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS digest FROM documents")
def _(s, d):
    return domain.table(s, d, "documents").select("doc_id", scalars.sha256_ref(F.coalesce("text", F.lit(""))).alias("digest"))


queries.QUERIES["fn_artifact_uri"], queries.SQL["fn_artifact_uri"] = queries.QUERIES["fn_uris"], queries.SQL["fn_uris"]


@query("fn_parse_uri", """SELECT page_id, split_part(split_part(url, '://', 2), '?', 1) AS raw, NOT regexp_matches(url, '[?#]') AND regexp_matches(url, '://[^/?#]+/.') AS valid FROM pages""")
def _(s, d):
    p = domain.table(s, d, "pages")
    uri = F.concat(F.lit("s3://"), F.element_at(F.split("url", "://"), 2))
    return p.select("page_id", F.element_at(F.split(F.element_at(F.split("url", "://"), 2), "\\?"), 1).alias("raw"), scalars.parse_uri(uri)["valid"].alias("valid"))


@query("fn_round_pct", with_tables("features") + " SELECT run_id, round(avg(CASE WHEN silent_flag THEN 1.0 ELSE 0.0 END) * 100, 2) AS pct FROM features GROUP BY 1")
def _(s, d):
    return FE(s, d).groupBy("run_id").agg(views.percent(views.ratio(F.col("silent_flag"))).alias("pct"))


@query("fn_memory_mb", "SELECT p_partkey, p_size / 1024.0::DOUBLE AS kib, p_size * 1000000 / 1048576.0::DOUBLE AS mb FROM (SELECT p_partkey, p_partkey % 50 + 1 AS p_size FROM part)")
def _(s, d):
    p = domain.table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 50 + 1).cast("string").alias("n"))
    return p.select("p_partkey", scalars.memory_mb(F.concat("n", F.lit("KiB / 1GiB"))).alias("kib"), scalars.memory_mb(F.concat("n", F.lit("MB / 1GiB"))).alias("mb"))


@query("fn_percent", "SELECT event_id, value AS pct FROM events")
def _(s, d):
    return domain.table(s, d, "events").select("event_id", scalars.percent(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("% "))).alias("pct"))


@query("fn_service_name", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'writer' ELSE 'app_' || event_type END AS service FROM events")
def _(s, d):
    e = domain.table(s, d, "events")
    name = F.when(F.col("event_id") % 2 == 0, "App-Writer-1").otherwise(F.concat(F.lit("app_"), "event_type"))
    return e.select("event_id", scalars.service_name(name, readers.SERVICES).alias("service"))


@query("fn_safe_ratio", "SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_totalprice / (o_custkey % 3) ELSE 0.0 END AS ratio FROM orders")
def _(s, d):
    return domain.table(s, d, "orders").select("o_orderkey", scalars.safe_ratio(F.col("o_totalprice"), F.col("o_custkey") % 3).alias("ratio"))


@query("fn_coalesce_chain", ALL3 + SUMMARY_SQL + " SELECT run_id, silent_ratio FROM summary")
def _(s, d):
    return summary_of(s, d).select("run_id", "silent_ratio")


@query("prj_effective_duration", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 1 THEN 1.5::DOUBLE WHEN o_totalprice > 0 THEN o_totalprice END AS duration FROM orders")
def _(s, d):
    measured = F.when(F.col("o_custkey") % 2 == 1, 1.5).otherwise(0.0)
    return domain.table(s, d, "orders").select("o_orderkey", scalars.effective_duration(measured, F.col("o_totalprice")).alias("duration"))


@query("prj_features_payload", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -60.0 ELSE -value END AS rms FROM events")
def _(s, d):
    db = F.when(F.col("event_id") % 5 == 0, float("-inf")).otherwise(-F.col("value"))
    return domain.table(s, d, "events").select("event_id", scalars.finite_or_floor(db).alias("rms"))


@query("chk_segment_audio", with_tables("manifest") + " SELECT run_id, track_id, segment_idx, track_id % 5 <> 0 AND track_id % 7 <> 0 AS ok FROM manifest")
def _(s, d):
    """Every fifth track has another rate, every seventh a segment that is a sample too short and more."""
    m = MF(s, d).withColumns({"sample_rate": F.when(F.col("track_id") % 5 == 0, 44100).otherwise(F.col("sample_rate")), "duration_s": F.when(F.col("track_id") % 7 == 0, 3.0 - 1.5 / 32000).otherwise(3.0 - 0.5 / 32000)})
    ok = (F.col("sample_rate") == segments.RATE) & ~(F.abs(F.col("duration_s") - segments.SIZE_S) > 1.0 / segments.RATE)
    return m.select("run_id", "track_id", "segment_idx", ok.alias("ok"))


@query("flt_segment_uri", with_tables("features") + " SELECT run_id, count(*) FILTER (WHERE track_id % 9 <> 4) AS good, count(*) FILTER (WHERE track_id % 9 = 4) AS bad FROM features GROUP BY 1")
def _(s, d):
    """URIs of every ninth track belong to the next segment, to a parent folder, or are null."""
    n = F.col("segment_idx") % 3
    other = F.when(n == 0, scalars.segment_uri(F.col("run_id"), F.col("track_id"), F.col("segment_idx") + 1)).when(n == 1, F.concat(F.lit("/artifacts/../"), F.col("run_id")))
    uri = F.when(F.col("track_id") % 9 == 4, other).otherwise(F.col("artifact_uri"))
    ok = scalars.segment_uri_ok(uri, F.col("run_id"), F.col("track_id"), F.col("segment_idx"))
    return FE(s, d).groupBy("run_id").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


@query("flt_manifest_uri", with_tables("tracks") + " SELECT run_id, count(*) AS good FROM tracks WHERE track_id % 4 <> 1 GROUP BY 1")
def _(s, d):
    """Every fourth track names the manifest of another run."""
    uri = F.when(F.col("track_id") % 4 == 1, scalars.manifest_uri(F.concat("run_id", F.lit("x")))).otherwise(F.col("manifest_uri"))
    return T(s, d).filter(uri == scalars.manifest_uri(F.col("run_id"))).groupBy("run_id").agg(F.count(F.lit(1)).alias("good"))


@query("flt_uri_prefix", with_tables("features") + " SELECT run_id, count(*) AS rows FROM features WHERE segment_idx <> 3 GROUP BY 1")
def _(s, d):
    uri = scalars.segment_uri(F.when(F.col("segment_idx") == 3, "other").otherwise(F.col("run_id")), F.col("track_id"), F.col("segment_idx"), bucket="b")
    return FE(s, d).filter(scalars.has_uri_prefix(uri, F.col("run_id"), "b")).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))


@query("flt_allowlist", with_tables("tracks") + " SELECT track_id FROM tracks WHERE track_id IN (1, 2, 3, 5, 8, 13)")
def _(s, d):
    return readers.subset_rows(T(s, d), "small", allow=[1, 2, 3, 5, 8, 13]).select("track_id")


@query("chk_positive_duration", with_tables("tracks") + """ SELECT track_id, '' AS error FROM tracks UNION ALL SELECT -1, 'tracks without a positive duration: [' || min(track_id) || ']' FROM tracks
  UNION ALL SELECT -1, 'tracks without a positive duration: [' || max(track_id) || ']' FROM tracks""")
def _(s, d):
    """All tracks pass; with a duration of 0, or none, for one of them the check raises and names it."""
    t = T(s, d)
    ends = t.agg(F.min("track_id").alias("low"), F.max("track_id").alias("high")).first()
    out = readers.require_positive_duration(t, "duration_s").select("track_id", F.lit("").alias("error"))
    for one, value in ((ends["low"], F.lit(0.0)), (ends["high"], F.lit(None).cast("double"))):
        try:
            readers.require_positive_duration(t.withColumn("duration_s", F.when(F.col("track_id") == one, value).otherwise(F.col("duration_s"))), "duration_s")
        except ValueError as error:
            out = out.unionAll(s.range(1).select(F.lit(-1).cast("bigint"), F.lit(str(error))))
    return out


@query("prj_metric_labels", with_tables("metrics") + " SELECT event_id, '{\"status\":\"' || coalesce(json_extract_string(labels_json, '$.status'), 'ok') || '\"' || coalesce(',\"topic\":\"' || json_extract_string(labels_json, '$.topic') || '\"', '') || '}' AS labels FROM metrics")
def _(s, d):
    e = views.metric_events(M(s, d).filter("true"))
    status = F.coalesce(views.label("status"), F.lit("ok"))
    return e.select("event_id", F.to_json(F.struct(status.alias("status"), F.col("topic_name").alias("topic"))).alias("labels"))


def metric_pairs(df: DataFrame, *pairs: tuple[str, Column]) -> DataFrame:
    """Several metric rows from each row."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric_name"), v.cast("double").alias("metric_value")) for n, v in pairs])
    return df.withColumn("_m", F.explode(rows)).select("run_id", "track_id", "segment_idx", "_m.*")


@query("prj_processing_metrics", with_tables("features") + " SELECT run_id, track_id, segment_idx, 'processing_ms' AS metric_name, processing_ms AS metric_value FROM features UNION ALL SELECT run_id, track_id, segment_idx, 'silent', CASE WHEN silent_flag THEN 1.0 ELSE 0.0 END FROM features")
def _(s, d):
    return metric_pairs(FE(s, d), ("processing_ms", F.col("processing_ms")), ("silent", F.col("silent_flag").cast("int")))


@query("prj_writer_metrics", with_tables("features") + " SELECT run_id, track_id, segment_idx, 'write_ms' AS metric_name, processing_ms AS metric_value FROM features UNION ALL SELECT run_id, track_id, segment_idx, 'rows_upserted', 1.0 FROM features")
def _(s, d):
    return metric_pairs(FE(s, d), ("write_ms", F.col("processing_ms")), ("rows_upserted", F.lit(1)))


@query("prj_snapshot_manifest_uri", with_tables("tracks") + " SELECT run_id, min(manifest_uri) AS manifest_uri FROM tracks GROUP BY 1")
def _(s, d):
    t = T(s, d).groupBy("run_id").agg(F.min_by("manifest_uri", "track_id").alias("t"))
    f = FE(s, d).groupBy("run_id").agg(F.min_by("manifest_uri", F.struct("track_id", "segment_idx")).alias("f"))
    return t.join(f, "run_id", "left").select("run_id", F.coalesce("t", "f", scalars.manifest_uri(F.col("run_id"))).alias("manifest_uri"))


@query("prj_scaling", ALL3 + """, a AS (SELECT run_id, count(*) AS n, round(quantile_cont(processing_ms, 0.95), 9) AS p95 FROM features GROUP BY 1), b AS (SELECT run_id, round(avg(metric_value), 9) AS cpu FROM metrics GROUP BY 1)
  SELECT run_id, n AS segments, p95, cpu FROM a LEFT JOIN b USING (run_id)""")
def _(s, d):
    f = FE(s, d)
    a = f.groupBy("run_id").agg(F.count(F.lit(1)).alias("segments")).join(stats.percentiles(f, ["run_id"], "processing_ms", {"p95": 0.95}), "run_id")
    return a.withColumn("p95", F.round("p95", 9)).join(M(s, d).groupBy("run_id").agg(F.round(F.avg("metric_value"), 9).alias("cpu")), "run_id", "left")


@query("srt_checkpoints", queries.SQL["snk_checkpoint"] + " ORDER BY topic_name, partition_id, run_id")
def _(s, d):
    return queries.QUERIES["snk_checkpoint"](s, d).orderBy("topic_name", "partition_id", "run_id")


@query("srt_deterministic", f"{GATE_SQL} SELECT * FROM rj ORDER BY track_id, segment_idx, source")
def _(s, d):
    rows = bundle(s, d).rejected
    return rows.repartitionByRange("track_id", "segment_idx", "source").sortWithinPartitions("track_id", "segment_idx", "source")


@query("jn_feature_artifact", with_tables("manifest") + """ SELECT f.run_id, f.track_id, f.segment_idx, f.processing_ms, CASE WHEN m.run_id IS NULL THEN 'artifact_missing' WHEN m.checksum <> f.checksum THEN 'checksum_mismatch' ELSE 'ok' END AS artifact
  FROM features f LEFT JOIN manifest m ON f.artifact_uri = m.artifact_uri AND m.segment_idx < 100""")
def _(s, d):
    stored = MF(s, d).filter("segment_idx < 100").select("artifact_uri", F.col("checksum").alias("stored"))
    out = FE(s, d).join(stored, "artifact_uri", "left")
    state = F.when(F.col("stored").isNull(), "artifact_missing").when(F.col("stored") != F.col("checksum"), "checksum_mismatch").otherwise("ok")
    return out.select("run_id", "track_id", "segment_idx", "processing_ms", state.alias("artifact"))


@query("prj_segment_items", with_tables("manifest") + """ SELECT f.run_id, f.track_id, f.segment_idx, f.processing_ms, '/media' || f.artifact_uri AS media, m.run_id IS NOT NULL AS artifact_exists
  FROM features f LEFT JOIN manifest m ON f.artifact_uri = m.artifact_uri AND m.segment_idx < 100""")
def _(s, d):
    stored = MF(s, d).filter("segment_idx < 100").select("artifact_uri", F.lit(True).alias("e"))
    return FE(s, d).join(stored, "artifact_uri", "left").select("run_id", "track_id", "segment_idx", "processing_ms", F.concat(F.lit("/media"), "artifact_uri").alias("media"), F.col("e").isNotNull().alias("artifact_exists"))


# ---------------------------------------------------------------- files written and read


@query("src_header_csv", with_tables("tracks") + " SELECT CAST(track_id AS VARCHAR) AS track_id, CAST(artist_id AS VARCHAR) AS artist, genre FROM tracks")
def _(s, d):
    path = shared(s, "csv")
    line = F.concat_ws(",", F.col("track_id").cast("string"), F.col("artist_id").cast("string"), "subset", "genre", F.lit("1.5"))
    head = s.createDataFrame([(0, ",artist,set,track,track"), (1, ",id,subset,genre_top,duration"), (2, "track_id,,,,")], "n int, value string")
    head.coalesce(1).sortWithinPartitions("n").select("value").write.text(f"{path}/0")
    rows = T(s, d).select(line.alias("value"))
    rows.write.text(f"{path}/1")
    raw = readers.metadata_csv(s, f"{path}/*", header=f"{path}/0")
    return raw.select("track_id", F.col("`artist.id`").alias("artist"), F.col("`track.genre_top`").alias("genre"))


@query("prj_metadata", with_tables("tracks") + " SELECT track_id, artist_id, subset, genre, CAST(1.5 AS DOUBLE) AS declared_duration_s FROM tracks")
def _(s, d):
    raw = T(s, d).select(F.col("track_id").cast("string"), F.col("artist_id").cast("string").alias("Artist.id"), F.col("subset").alias("set.subset"), F.concat(F.lit(" "), "genre").alias("track.genre_top"), F.lit("1.5").alias("track.duration"))
    return readers.select_metadata(raw)


MANIFEST_SQL = with_tables("manifest") + " SELECT run_id, track_id, segment_idx, checksum FROM manifest"


def stored_manifest(s: SparkSession, d: str) -> str:
    path = shared(s, "manifest")
    sinks.merge_manifest(MF(s, d).select(*readers.MANIFEST_COLUMNS), path)
    return path


@query("src_manifest", MANIFEST_SQL)
def _(s, d):
    return readers.manifest(s, stored_manifest(s, d)).select("run_id", "track_id", "segment_idx", "checksum")


@query("snk_manifest_merge", with_tables("manifest") + """ SELECT run_id, track_id, segment_idx, CASE WHEN run_id = 'run-1' AND track_id % 2 = 0 THEN 'new' ELSE checksum END AS checksum FROM manifest
  UNION ALL SELECT run_id, track_id, segment_idx + 1000, 'new' FROM manifest WHERE run_id = 'run-1' AND track_id % 2 = 0""")
def _(s, d):
    """A second batch that changes rows of one run and adds some."""
    path = stored_manifest(s, d)
    some = MF(s, d).select(*readers.MANIFEST_COLUMNS).filter("run_id = 'run-1' and track_id % 2 = 0").withColumn("checksum", F.lit("new"))
    sinks.merge_manifest(some.unionByName(some.withColumn("segment_idx", F.col("segment_idx") + 1000)), path)
    return s.read.parquet(path).select("run_id", "track_id", "segment_idx", "checksum")


@query("src_manifest_rows", with_tables("manifest") + """ SELECT CASE WHEN track_id % 19 = 3 THEN 'manifest_run_id_mismatch' WHEN segment_idx >= 100 THEN 'manifest_uri_invalid' ELSE 'good' END AS kind, count(*) AS rows FROM manifest WHERE run_id IN ('run-1', 'run-2') GROUP BY 1
  UNION ALL SELECT * FROM (VALUES ('segment_manifest_unreadable', 1), ('segment_manifest_schema_invalid', 1), ('segment_manifest_missing', 1))""")
def _(s, d):
    """A manifest for each run: two good ones with bad rows in them, one cut short, one without digests, one that is not there."""
    root = shared(s, "manifests")
    path = lambda run: f"{root}/run_id={run}"
    m = MF(s, d).withColumn("run", F.col("run_id")).withColumn("run_id", F.when(F.col("track_id") % 19 == 3, "elsewhere").otherwise(F.col("run_id")))
    for n in (1, 2, 3, 4):
        rows = m.filter(F.col("run") == f"run-{n}").drop("run", *(["checksum"] if n == 4 else []))
        rows.write.parquet(f"{path(f'run-{n}')}/manifest")
    fs, p = sinks.filesystem(s, f"{path('run-3')}/manifest")
    for status in fs.listStatus(p):
        if status.getPath().getName().endswith(".parquet"):
            out = fs.create(status.getPath(), True)
            out.write(b"PAR1")
            out.close()
    rows, broken = readers.manifest_scan(s, [f"{path(f'run-{n}')}/manifest" for n in range(1, 6)])
    run = F.regexp_extract("manifest_file", "run_id(?:=|%3D)(run-\\d)", 1)
    kinds = broken.select(F.col("anomaly_type").alias("kind"))
    for n in (1, 2):
        good, bad = readers.manifest_rows(rows.filter(run == f"run-{n}"), f"run-{n}")
        kinds = kinds.unionAll(good.select(F.lit("good").alias("kind"))).unionAll(bad.select("anomaly_type"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


@query("set_manifest_concat", with_tables("manifest") + " SELECT run_id, count(*) AS rows FROM manifest GROUP BY 1")
def _(s, d):
    m = MF(s, d)
    both = m.filter("track_id % 2 = 0").withColumn("segment_idx", F.col("segment_idx").cast("long")).unionByName(m.filter("track_id % 2 = 1").drop("duration_s"), allowMissingColumns=True)
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))


@query("snk_purge_run", ALL3 + """, k AS (SELECT DISTINCT run_id, track_id, segment_idx FROM features), c AS (SELECT 'tracks' AS table_name, run_id FROM tracks UNION ALL SELECT 'features', run_id FROM k UNION ALL SELECT 'metrics', run_id FROM metrics
  UNION ALL SELECT DISTINCT 'checkpoints', run_id FROM tracks UNION ALL SELECT 'quarantine', run_id FROM metrics WHERE event_id % 10 = 0)
  SELECT table_name, run_id, count(*) AS rows FROM c WHERE run_id <> 'run-2' GROUP BY ALL UNION ALL SELECT 'tracks', 'run-2', count(*) FROM tracks WHERE run_id = 'run-2' AND track_id % 2 = 0""")
def _(s, d):
    """A run goes from five tables at one moment; some of its tracks come again afterwards. Half of the tables are compacted."""
    tables = sinks.store(s, shared(s, "purged"))
    t, m = T(s, d).withColumn("seq", F.lit("1")), M(s, d)
    checkpoints = t.select(F.lit("g").alias("consumer_group"), F.lit("audio.metadata").alias("topic"), F.lit(0).alias("partition"), "run_id", F.col("track_id").alias("offset"), F.col("created_at").alias("updated_at"))
    ledger = sinks.checkpoints(checkpoints.withColumnsRenamed({"topic": "topic_name", "partition": "partition_id"}))
    bad = m.filter("event_id % 10 = 0").select("run_id", F.lit("system.metrics").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.lit("{}").alias("value"))
    unscoped = m.withColumns({"labels_json": F.lit("{}"), "seq": F.lit("1")})
    parts = {"tracks": t, "features": FE(s, d).withColumn("seq", F.lit("1")), "metrics": sinks.keyed_metrics(unscoped), "checkpoints": ledger, "quarantine": bad}
    tables.commit({n: sinks.filled(p, n) for n, p in parts.items()}, "load", 0)
    tables.purge("run-2")
    tables.compact("features")
    tables.commit({"tracks": sinks.filled(t.filter("run_id = 'run-2' and track_id % 2 = 0"), "tracks")}, "load", 1)
    tables.compact("tracks")
    state = tables.state()
    found = [tables.read(n, state=state, columns=("run_id",)).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "run_id", "rows") for n in parts]
    return reduce(DataFrame.unionAll, found)


@query("snk_csv", with_tables("tracks") + " SELECT track_id, genre, duration_s FROM tracks")
def _(s, d):
    path = shared(s, "csv")
    sinks.write_csv(T(s, d), path, ["track_id", "genre", "duration_s"])
    return s.read.option("header", "true").schema("track_id long, genre string, duration_s double").csv(path)


@query("snk_split_parquet", f"{GATE_SQL} SELECT split, count(*) AS rows FROM rw GROUP BY 1")
def _(s, d):
    path = shared(s, "splits")
    sinks.write_splits(bundle(s, d, stored=queries.stored(s), wanted=("rms", "silent_flag")).rows, path, "run_id string, track_id long, segment_idx long, label_id long, genre string, rms double, silent_flag boolean")
    parts = [s.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("rows")).withColumn("split", F.lit(n)) for n in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("rows > 0")


@query("snk_json_docs", ALL3 + SUMMARY_SQL + " SELECT run_id, CAST(segments_persisted AS VARCHAR) AS segments FROM summary")
def _(s, d):
    path = shared(s, "json")
    sinks.write_json(summary_of(s, d), path)
    return s.read.text(path).select(F.get_json_object("value", "$.run_id").alias("run_id"), F.get_json_object("value", "$.segments_persisted").alias("segments"))


@query("ds_split_manifest", f"{GATE_SQL} SELECT run_id, CAST(count(*) AS VARCHAR) AS segments, 'by_artist_id' AS split_type FROM rw GROUP BY 1")
def _(s, d):
    b = bundle(s, d)
    kinds = b.splits.groupBy("run_id").agg(F.first("split_type").alias("split_type"))
    counts = dataset.split_counts(b.rows).groupBy("run_id").agg(F.sum("segments").alias("segments"), F.sort_array(F.collect_list(F.struct("split", "artists", "tracks"))).alias("splits"))
    doc = sinks.json_document(counts.join(kinds, "run_id").withColumn("seed_policy", F.lit("sha256(run_id:group)")))
    return doc.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("run_id", "segments", "split_type")])


@query("snk_atomic_publish", with_tables("tracks") + " SELECT run_id, count(*) AS rows FROM tracks GROUP BY 1")
def _(s, d):
    root = shared(s, "bundles")
    t = T(s, d)
    for rows in (t.limit(1), t):
        path = sinks.publish(s, root, "bundle", lambda p, rows=rows: rows.write.parquet(p))
    return s.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))


def stored_segments(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Each conversation turn as a segment file row: (folder of the table, its descriptors)."""
    path = shared(s, "segments")
    c = domain.table(s, d, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    c.withColumn("checksum", scalars.sha256_ref(F.col("content"))).write.parquet(path)
    return path, s.read.parquet(path).select("conv_id", "turn", "checksum")


TURN_SQL = "SELECT conv_id, turn, 'sha256:' || sha256(coalesce(text, '')) AS checksum FROM conversations"


@query("snk_segments", TURN_SQL)
def _(s, d):
    return stored_segments(s, d)[1]


@query("gate_artifact_verify", """SELECT CAST(conv_id % 5 AS BIGINT) AS part, count(*) AS artifacts, count(*) FILTER (WHERE turn % 6 = 1) AS mismatches, count(*) FILTER (WHERE turn % 6 = 4) AS missing FROM conversations GROUP BY 1""")
def _(s, d):
    """Digests of what is stored against the descriptors: some contents changed after they were described, some are gone."""
    path, described = stored_segments(s, d)
    there = shared(s, "changed")
    turn = F.col("turn") % 6
    s.read.parquet(path).filter(turn != 4).select("conv_id", "turn", F.when(turn == 1, F.concat("content", F.unhex(F.lit("2A")))).otherwise(F.col("content")).alias("content")).write.parquet(there)
    seen = s.read.parquet(there).select("conv_id", "turn", scalars.sha256_ref(F.col("content")).alias("seen"))
    both = described.join(seen, ["conv_id", "turn"], "left")
    return both.groupBy((F.col("conv_id") % 5).alias("part")).agg(F.count(F.lit(1)).alias("artifacts"), F.count_if(F.col("seen") != F.col("checksum")).alias("mismatches"), F.count_if(F.col("seen").isNull()).alias("missing"))


def named_files(s: SparkSession, d: str) -> str:
    """Customers as text, a file for each nation; a line is a key and a name, by key."""
    path = shared(s, "files")
    c = domain.table(s, d, "customer").select("c_nationkey", "c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("value"))
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    return path


FILE_SQL = """SELECT CAST(c_nationkey AS VARCHAR) AS name, CAST(sum(strlen(line)) AS BIGINT) AS size, 'sha256:' || sha256(string_agg(line, '' ORDER BY c_custkey)) AS checksum, count(*) AS row_count
  FROM (SELECT *, c_custkey || ',' || c_name || chr(10) AS line FROM customer) GROUP BY c_nationkey"""


@query("src_artifacts", f"SELECT name, size, checksum FROM ({FILE_SQL})")
def _(s, d):
    return readers.artifacts(s, named_files(s, d)).select(F.regexp_extract("path", "c_nationkey=(\\d+)", 1).alias("name"), "size", "checksum")


@query("snk_file_inventory", f"SELECT * FROM ({FILE_SQL}) ORDER BY name")
def _(s, d):
    path = named_files(s, d)
    name = F.regexp_extract("path", "c_nationkey=(\\d+)", 1)
    rows = s.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("row_count"))
    out = sinks.inventory(s, path).select(name.alias("name"), "size", "checksum")
    return out.join(rows.select(name.alias("name"), "row_count"), "name", "left").orderBy("name")


@query("set_bundle_files", with_tables("tracks", "features") + """, w AS (SELECT run_id FROM features UNION SELECT 'run-none'), f AS (SELECT DISTINCT run_id FROM tracks WHERE run_id <> 'run-2' UNION SELECT 'other')
  SELECT (SELECT count(*) FROM (FROM w EXCEPT FROM f)) AS missing, (SELECT count(*) FROM (FROM f EXCEPT FROM w)) AS unexpected""")
def _(s, d):
    """Folders that a bundle has against those that the runs want; one is purged and one is foreign."""
    path = shared(s, "bundle")
    sinks.overwrite(T(s, d), path)
    sinks.purge_run(s, path, "run-2")
    sinks.overwrite(T(s, d).limit(1).withColumn("run_id", F.lit("other")), path)
    found = readers.file_names(s, path).select(F.regexp_extract("path", "run_id=([^/]+)/", 1).alias("run_id")).distinct()
    want = FE(s, d).select("run_id").union(s.createDataFrame([("run-none",)], "run_id string")).distinct()
    return reconcile.key_set_equal(want, found, ["run_id"]).select(F.col("only_left").alias("missing"), F.col("only_right").alias("unexpected"))


@query("src_envelopes", with_tables("metrics") + """ SELECT CASE WHEN event_id % 11 = 2 THEN '' ELSE run_id END AS run_id, CASE event_id % 11 WHEN 2 THEN 'not_json_object' WHEN 3 THEN 'version' WHEN 5 THEN 'run_id;trace_id;run_mismatch' ELSE '' END AS reasons, count(*) AS events
  FROM (SELECT event_id, CASE WHEN event_id % 11 = 5 THEN '..' ELSE run_id END AS run_id FROM metrics) GROUP BY ALL""")
def _(s, d):
    """Records as read: most valid, some cut short, of another version, or with a run that is no safe name."""
    path = shared(s, "events")
    n = F.get_json_object("value", "$.event_id").cast("bigint") % 11
    value = F.when(n == 2, F.substring("value", 1, 40)).when(n == 3, F.regexp_replace("value", '"event_version":"v1"', '"event_version":"v2"'))
    value = value.when(n == 5, F.regexp_replace("value", '"run_id":"[^"]*","source', '"run_id":"..","source')).otherwise(F.col("value"))
    metric_events(s, d).select(value.alias("value")).write.text(path)
    rows = contract.checked(readers.records(s, path))
    return rows.groupBy(F.coalesce("run_id", F.lit("")).alias("run_id"), F.array_join("reasons", ";").alias("reasons")).agg(F.count(F.lit(1)).alias("events"))


@query("src_run_snapshot", with_tables("tracks", "features") + " SELECT (SELECT count(*) FROM tracks WHERE run_id = 'run-3') AS tracks, (SELECT count(*) FROM features WHERE run_id = 'run-3') AS features")
def _(s, d):
    snap = readers.run_snapshot("run-3", tracks=T(s, d), features=FE(s, d))
    a, b = (snap[n].agg(F.count(F.lit(1)).alias(n)) for n in ("tracks", "features"))
    return a.crossJoin(F.broadcast(b))


STATE_SQL = with_tables("features") + """, k AS (SELECT run_id, track_id, segment_idx, bool_or(silent_flag) AS silent_flag FROM features GROUP BY ALL)
  SELECT run_id, count(*) AS segments, count(*) FILTER (WHERE silent_flag) AS silent_segments, round(avg(CASE WHEN silent_flag THEN 1.0 ELSE 0.0 END), 6) AS silent_ratio FROM k GROUP BY 1"""


def state_documents(features: DataFrame) -> DataFrame:
    """(run_id, segments): one document per track of a run."""
    k = features.groupBy("run_id", "track_id", "segment_idx").agg(F.max("silent_flag").alias("silent_flag"))
    return k.groupBy("run_id", "track_id").agg(F.collect_list(F.struct("track_id", "segment_idx", "silent_flag")).alias("segments")).select("run_id", "segments")


def stored_state(s: SparkSession, d: str) -> DataFrame:
    """State documents written and read again."""
    path = shared(s, "state")
    state_documents(FE(s, d)).select(F.to_json(F.struct("run_id", "segments")).alias("value")).write.text(path)
    return readers.processing_state(s, path)


@query("src_processing_state", STATE_SQL)
def _(s, d):
    return r6(readers.state_summary(stored_state(s, d)), "silent_ratio")


queries.QUERIES["agg_state_summary"], queries.SQL["agg_state_summary"] = queries.QUERIES["src_processing_state"], STATE_SQL


def stats_lines(s: SparkSession, d: str) -> DataFrame:
    e = domain.table(s, d, "events")
    doc = F.to_json(F.struct(F.concat(F.lit("app-"), F.when(F.col("event_type") == "view", "writer").otherwise("kafka"), F.lit("-1")).alias("Name"), F.concat(F.col("value").cast("string"), F.lit("%")).alias("CPUPerc"), F.concat((F.col("event_id") % 100).cast("string"), F.lit("MiB / 31GiB")).alias("MemUsage")))
    return e.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("﻿"), doc)).otherwise(doc).alias("value"))


@query("src_resource_samples", "SELECT CASE event_type WHEN 'view' THEN 'writer' ELSE 'kafka' END AS service, value AS cpu_percent, CAST(event_id % 100 AS DOUBLE) AS memory_mb FROM events")
def _(s, d):
    return readers.resource_samples(stats_lines(s, d))


@query("agg_resources", """SELECT CASE event_type WHEN 'view' THEN 'writer' ELSE 'kafka' END AS service, count(*) AS samples, round(avg(value), 6) AS cpu_mean, max(value) AS cpu_max, CAST(max(event_id % 100) AS DOUBLE) AS memory_max FROM events GROUP BY 1""")
def _(s, d):
    rows = readers.resource_samples(stats_lines(s, d))
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("cpu_percent"), 6).alias("cpu_mean"), F.max("cpu_percent").alias("cpu_max"), F.max("memory_mb").alias("memory_max"))


@query("snk_eval_upsert", "SELECT label AS scenario, CAST(count(*) AS BIGINT) AS samples FROM embeddings GROUP BY 1")
def _(s, d):
    path = shared(s, "eval")
    rows = domain.table(s, d, "embeddings").groupBy(F.col("label").alias("scenario")).agg(F.count(F.lit(1)).alias("samples"))
    rows = rows.withColumns({"run_id": F.lit("eval"), "seq": F.lit(0)})
    for batch in (rows.withColumn("samples", F.lit(0).cast("long")), rows.withColumn("seq", F.lit(1))):
        sinks.upsert(batch, path, ["scenario", "run_id"], "seq")
    return s.read.parquet(path).select("scenario", "samples")


# ---------------------------------------------------------------- audio out of the documents


def as_wav(data: Column, channels: int = 1) -> Column:
    """Bytes as 8-bit PCM at 32 kHz, with a WAV header, by built-in functions."""
    n = F.octet_length(data)
    little = lambda c: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))
    two = f"{channels:02X}00"
    rate = (32000 * channels).to_bytes(4, "little").hex()
    head = F.unhex(F.lit(f"57415645666D742010000000" + "0100" + two + "007D0000" + rate + two + "0800" + "64617461"))
    return F.concat(F.unhex(F.lit("52494646")), little(n + 36), head, little(n), data)


STRETCH = 3 * 32000


def stretches(s: SparkSession, d: str) -> DataFrame:
    """Documents' bytes cut into segments of three seconds, one after the other: ``doc_id, segment_idx, data``."""
    docs = domain.table(s, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    cut = segments.windows(docs.withColumn("n", F.octet_length("bytes")), "n", STRETCH, STRETCH, 0)
    return cut.select("doc_id", "segment_idx", F.substring(F.col("bytes"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("data"))


def audio(s: SparkSession, d: str) -> DataFrame:
    return segments.features(stretches(s, d).select("doc_id", "segment_idx", as_wav(F.col("data")).alias("content")))


#: Bytes of the documents by segment, out of code points in their order, and their level.
BYTES_SQL = """WITH u AS (SELECT doc_id, list_transform(string_split({text}, ''), lambda c: unicode(c)) AS cs FROM {table}), c AS (SELECT doc_id, unnest(cs) AS p, generate_subscripts(cs, 1) AS k FROM u), l AS (
  SELECT doc_id, k, CASE WHEN p < 128 THEN [p] WHEN p < 2048 THEN [192 + (p >> 6), 128 + (p & 63)] WHEN p < 65536 THEN [224 + (p >> 12), 128 + ((p >> 6) & 63), 128 + (p & 63)]
    ELSE [240 + (p >> 18), 128 + ((p >> 12) & 63), 128 + ((p >> 6) & 63), 128 + (p & 63)] END AS bs FROM c WHERE p >= 0 AND p IS NOT NULL
), x AS (SELECT doc_id, k, unnest(bs) AS b, generate_subscripts(bs, 1) AS j FROM l), o AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS i FROM x), r AS (
  SELECT doc_id, CAST(i // 96000 AS INTEGER) AS segment_idx, sqrt(avg(((b - 128) / 128.0::DOUBLE) * ((b - 128) / 128.0::DOUBLE))) AS level, count(*) AS n FROM o GROUP BY ALL)"""
LEVEL_SQL = BYTES_SQL.format(text="coalesce(text, '')", table="documents")


@query("ft_pipeline", LEVEL_SQL + " SELECT doc_id, segment_idx, round(20 * log10(level), 3) AS rms, false AS silent_flag, 128 AS mel_bins, 300 AS mel_frames, 32000 AS sample_rate, NULL::VARCHAR AS error FROM r")
def _(s, d):
    return audio(s, d).select("doc_id", "segment_idx", F.round("rms", 3).alias("rms"), "silent_flag", "mel_bins", "mel_frames", "sample_rate", "error")


@query("ft_shape", "SELECT CAST(sum((strlen(text) + 95999) // 96000) AS BIGINT) AS shaped FROM documents WHERE text <> ''")
def _(s, d):
    return audio(s, d).filter("mel_bins = 128 and mel_frames = 300 and duration_s > 0").agg(F.count(F.lit(1)).alias("shaped"))


@query("seg_decode", "SELECT doc_id, strlen(text) / 32000.0::DOUBLE AS duration_s FROM documents WHERE text <> ''")
def _(s, d):
    return audio(s, d).groupBy("doc_id").agg((F.sum(F.round(F.col("duration_s") * 32000)) / 32000).alias("duration_s"))


@query("ft_rms", LEVEL_SQL + " SELECT doc_id, segment_idx, round(20 * log10(level), 3) AS rms FROM r")
def _(s, d):
    return audio(s, d).select("doc_id", "segment_idx", F.round("rms", 3).alias("rms"))


@query("seg_mono", LEVEL_SQL + " SELECT doc_id, segment_idx, round(20 * log10(level / 2), 3) AS rms FROM r")
def _(s, d):
    """Two channels, the second one silent: their mean has half the level."""
    both = F.unhex(F.regexp_replace(F.hex("data"), "(..)", "$180"))
    rows = stretches(s, d).select("doc_id", "segment_idx", as_wav(both, channels=2).alias("content"))
    return segments.features(rows).select("doc_id", "segment_idx", F.round("rms", 3).alias("rms"))


@query("ft_log_mel")
def _(s, d):
    """Mean of the mel bins' means, and the strongest bin; a plain transform holds them in the tests."""
    a = audio(s, d)
    return a.select("doc_id", "segment_idx", F.round(F.aggregate("mel_means", F.lit(0.0), lambda x, y: x + y) / F.size("mel_means"), 3).alias("mel_mean"), F.array_position("mel_means", F.array_max("mel_means")).alias("peak"))


@query("ft_silence", "SELECT doc_id % 10 = 0 AS silent_flag, CAST(sum(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE (strlen(text) + 95999) // 96000 END) AS BIGINT) AS segments FROM documents WHERE text <> '' GROUP BY 1")
def _(s, d):
    """Every tenth document is three seconds of silence instead."""
    first = F.col("segment_idx") == 0
    quiet = F.unhex(F.repeat(F.lit("80"), STRETCH))
    rows = stretches(s, d).filter((F.col("doc_id") % 10 != 0) | first)
    rows = rows.select("doc_id", "segment_idx", as_wav(F.when(F.col("doc_id") % 10 == 0, quiet).otherwise(F.col("data"))).alias("content"))
    return segments.features(rows).groupBy("silent_flag").agg(F.count(F.lit(1)).alias("segments"))


@query("seg_encode", """WITH n AS (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents), f AS (SELECT *, CASE WHEN n >= 96000 THEN (n - 96000) // 48000 + 1 ELSE 0 END AS f FROM n)
  SELECT doc_id, CASE WHEN doc_id % 9 IN (4, 5) THEN 0 ELSE f + CASE WHEN n - f * 48000 > 32000 THEN 1 ELSE 0 END END AS segments, CASE WHEN doc_id % 9 IN (4, 5) THEN 1 ELSE 0 END AS errors
  FROM f WHERE doc_id % 9 IN (4, 5) OR f + CASE WHEN n - f * 48000 > 32000 THEN 1 ELSE 0 END > 0""")
def _(s, d):
    docs = domain.table(s, d, "documents").select("doc_id", as_wav(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    damaged = F.when(F.col("doc_id") % 9 == 4, F.substring("content", 1, 20)).when(F.col("doc_id") % 9 == 5, F.lit(None)).otherwise(F.col("content"))
    cut = segments.cut_segments(docs.withColumn("content", damaged))
    return cut.groupBy("doc_id").agg(F.count_if(F.col("cut_error").isNull()).alias("segments"), F.count_if(F.col("cut_error").isNotNull()).alias("errors"))


# ---------------------------------------------------------------- streams


def written_events(s: SparkSession, rows: DataFrame) -> str:
    path = shared(s, "stream")
    rows.select("value").write.text(path)
    return path


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def placed(events: DataFrame, topic: str) -> DataFrame:
    """Records of a topic with two partitions; offsets ascend and may have gaps, as those of a topic do."""
    n = F.col("offset")
    return events.select(F.lit(topic).alias("topic"), (n % 2).cast("int").alias("partition"), n.cast("bigint").alias("offset"), F.col("key").cast("string").alias("key"), "value")


def run_events(s: SparkSession, d: str, waves: int = 1) -> str:
    """Records of tracks, features and metrics in a folder; in several ``waves``, a folder ``wave=<n>`` each, by track or event."""
    made = [placed(track_events(s, d), "audio.metadata"), placed(feature_events(s, d), "audio.features"), placed(metric_events(s, d), "system.metrics")]
    rows = made[0].unionAll(made[1]).unionAll(made[2])
    path = shared(s, "topic")
    if waves == 1:
        sinks.publish_topic(rows, path)
    else:  # all waves in one pass over the events
        wave = F.floor(F.col("offset") / 1000) % waves
        rows.select("topic", "partition", "offset", "key", "value", wave.alias("wave")).write.option("compression", "zstd").partitionBy("wave").parquet(path)
    return path


def persisted(s: SparkSession, d: str, times: int = 1) -> str:
    """Events of tracks, features and metrics through the writer query, ``times`` times over."""
    src, out = run_events(s, d), shared(s, "written")
    for k in range(times):
        pipelines.writer(readers.topic_records(s, src, streaming=True), out, f"{out}/_cp{k}").awaitTermination()
    sinks.dropped(s, src)
    return out


#: Records of each topic with their place, as ``run_events`` publishes them.
PLACES_SQL = """, places AS (SELECT 'audio.metadata' AS topic, track_id AS n, run_id FROM tracks UNION ALL SELECT DISTINCT 'audio.features', track_id * 100 + segment_idx, run_id FROM features UNION ALL SELECT 'system.metrics', event_id, run_id FROM metrics)"""
WRITTEN_SQL = ALL3 + PLACES_SQL + """, mm AS (SELECT *, coalesce(json_extract_string(labels_json, '$.scope'), '') AS sc FROM metrics), counts AS (
  SELECT 'tracks' AS table_name, count(*) AS rows FROM tracks UNION ALL SELECT 'features', count(*) FROM (SELECT DISTINCT run_id, track_id, segment_idx FROM features)
  UNION ALL SELECT 'metrics', (SELECT count(*) FROM mm WHERE sc = '') + (SELECT count(*) FROM (SELECT DISTINCT run_id, service_name, metric_name, labels_json FROM mm WHERE sc <> '')) + (SELECT count(*) FROM places)
  UNION ALL SELECT 'checkpoints', count(*) FROM (SELECT DISTINCT topic, n % 2, run_id FROM places) UNION ALL SELECT 'quarantine', 0)"""
COUNTS_SQL = WRITTEN_SQL + " FROM counts"


def table_counts(s: SparkSession, out: str) -> DataFrame:
    tables = sinks.store(s, out)
    state = tables.state()
    parts = [tables.read(n, state=state, columns=("run_id",)).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in sinks.TABLES]
    return reduce(DataFrame.unionAll, parts)


@query("st_writer", WRITTEN_SQL + """, c AS (SELECT topic || '/' || n % 2 || '/' || run_id AS table_name, max(n) AS rows FROM places GROUP BY topic, n % 2, run_id) FROM counts UNION ALL FROM c""")
def _(s, d):
    """Rows of each table after the stream, and the offset ledger that the same commits hold."""
    out = persisted(s, d)
    ledger = sinks.store(s, out).read("checkpoints")
    return table_counts(s, out).unionByName(ledger.select(F.concat_ws("/", "topic_name", "partition_id", "run_id").alias("table_name"), F.col("last_committed_offset").alias("rows")))


@query("gate_replay", WRITTEN_SQL + " SELECT table_name, rows AS before, rows + CASE table_name WHEN 'tracks' THEN 1 ELSE 0 END AS after, table_name <> 'tracks' AS ok FROM counts")
def _(s, d):
    """Counts before and after a replay; the replay of tracks is given one row too many."""
    src, out, kept = run_events(s, d), shared(s, "written"), shared(s, "counts")
    for k in range(2):
        pipelines.writer(readers.topic_records(s, src, streaming=True), out, f"{out}/_cp{k}").awaitTermination()
        if not k:
            table_counts(s, out).write.parquet(kept)
    sinks.dropped(s, src)
    once, twice = s.read.parquet(kept), table_counts(s, out)
    more = twice.withColumn("rows", F.when(F.col("table_name") == "tracks", F.col("rows") + 1).otherwise(F.col("rows")))
    return reconcile.replay_changes(once, more, ["table_name"], "rows", []).select("table_name", "before", "after", "ok")


@query("st_replay_snapshot", WRITTEN_SQL + """ FROM counts UNION ALL SELECT 'state/' || run_id, count(*) FROM (SELECT DISTINCT run_id, track_id, segment_idx FROM features) GROUP BY run_id
  UNION ALL SELECT 'offset/' || topic || '/' || n % 2 || '/' || run_id, max(n) FROM places GROUP BY topic, n % 2, run_id""")
def _(s, d):
    """Stored rows, segments in the state documents, and the stream's last offsets by topic, partition and run, after two deliveries."""
    out = persisted(s, d, times=2)
    state = readers.state_summary(stored_state(s, d)).select(F.concat(F.lit("state/"), "run_id").alias("table_name"), F.col("segments").alias("rows"))
    last = sinks.store(s, out).read("checkpoints").select(F.concat_ws("/", F.lit("offset"), "topic_name", "partition_id", "run_id").alias("table_name"), F.col("last_committed_offset").alias("rows"))
    return table_counts(s, out).unionByName(state).unionByName(last)


@query("st_idempotent_replay", WRITTEN_SQL + """ FROM counts UNION ALL SELECT 'class ' || event_id % 4, count(*) * CASE event_id % 4 WHEN 2 THEN 2 ELSE 1 END FROM events GROUP BY event_id % 4
  UNION ALL SELECT 'keys held', count(*) FILTER (WHERE event_id % 4 IN (2, 3)) FROM events""")
def _(s, d):
    """Rows of each table after two deliveries of all records by two queries; and second deliveries before a watermark:
    of class 1 they come within it and go, of class 2 beyond it, when the keys have left the state, and pass. Class 3 moves the watermark."""
    s.conf.set(STATE_PROVIDER, ROCKS)
    counts = table_counts(s, persisted(s, d, times=2))
    src, out = shared(s, "deliveries"), shared(s, "once")
    e = domain.table(s, d, "events").select(F.col("event_id").cast("string").alias("idempotency_key"), (F.col("event_id") % 4).alias("class"), "event_id")
    waves = (("class != 3", 0, 300), ("class = 1", 300, 200), ("class = 3", 86_400, 200), ("class = 2", 86_700, 100))
    for which, start, span in waves:
        at = F.timestamp_seconds(F.lit(1_767_225_600 + start) + F.col("event_id") % span)
        wave = e.filter(which).select("idempotency_key", "class", at.alias("received_at"))
        wave.write.mode("append").parquet(src)
        once = pipelines.deduplicated(s.readStream.schema(wave.schema).parquet(src), "received_at")
        once.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{src}-cp").trigger(availableNow=True).start().awaitTermination()
    passed = s.read.parquet(out).groupBy(F.concat(F.lit("class "), F.col("class").cast("string")).alias("table_name")).agg(F.count(F.lit(1)).alias("rows"))
    held = s.read.format("statestore").load(f"{src}-cp").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("keys held").alias("table_name"), "rows")
    return counts.unionByName(passed).unionByName(held)


def one_batch(stream: DataFrame, write, checkpoint: str) -> None:
    """One batch of a stream with timers or expiring state: such a stream always has another batch, so it has no end to wait for."""
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()


@query("st_processed_segments", with_tables("features") + """, k AS (SELECT run_id, track_id, segment_idx, bool_or(silent_flag) AS silent FROM features GROUP BY ALL)
  SELECT run_id, CAST(count(*) AS BIGINT) AS segments, round(avg(CASE WHEN silent THEN 1.0 ELSE 0.0 END), 6) AS silent_ratio, count(*) FILTER (WHERE track_id % 50 = 7) AS conflicts FROM k GROUP BY 1""")
def _(s, d):
    """Keyed state that begins with half of the tracks from state documents; the stream brings all segments, then some with another flag."""
    s.conf.set(STATE_PROVIDER, ROCKS)
    src, out = shared(s, "in"), shared(s, "updates")
    f = FE(s, d).groupBy("run_id", "track_id", "segment_idx").agg(F.max("silent_flag").alias("silent_flag"))
    documents = shared(s, "documents")
    sinks.json_document(state_documents(f.filter("track_id % 2 = 0"))).write.text(documents)
    for rows in (f, f.filter("track_id % 50 = 7").withColumn("silent_flag", ~F.col("silent_flag"))):
        rows.write.mode("append").parquet(src)
        stream = pipelines.segment_state(s.readStream.schema(f.schema).parquet(src), 4, readers.processing_state(s, documents), ttl_ms=86_400_000)
        one_batch(stream, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch_id={i}"), f"{src}-cp")
    return r6(pipelines.ratios(s.read.parquet(out)), "silent_ratio").select("run_id", "segments", "silent_ratio", "conflicts")


@query("st_retry", """WITH t AS (SELECT conv_id AS track_id, CAST(turn AS INTEGER) AS segment_idx, conv_id % 4 AS kind FROM conversations WHERE turn = 0), a AS (SELECT *, unnest(range(1, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 1 END)) AS attempt FROM t)
  SELECT track_id, segment_idx, 'waits' AS kind, CAST(attempt AS INTEGER) AS attempt, CAST(least(20 * 2 ** (attempt - 1), 100) AS BIGINT) AS wait_ms FROM a
  UNION ALL SELECT track_id, segment_idx, CASE WHEN kind < 2 THEN 'done' ELSE 'given_up' END, CAST(CASE kind WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 1 END AS INTEGER), -1 FROM t""")
def _(s, d):
    """First turns whose artifact is not there: of some it appears before the second attempt, of some before the fourth, of
    some never; every fourth has damaged content, which no attempt mends. Attempts go round by a folder of failures."""
    s.conf.set(STATE_PROVIDER, ROCKS)
    feed, out, there = shared(s, "failures"), shared(s, "retries"), shared(s, "artifacts")
    t = domain.table(s, d, "conversations").filter("turn = 0").select(
        F.lit("run-0").alias("run_id"), F.col("conv_id").alias("track_id"), F.col("turn").cast("int").alias("segment_idx"), F.lit(1).alias("attempt"),
        F.when(F.col("conv_id") % 4 == 3, "decode_error").otherwise("artifact_missing").alias("failure_class"),
    )
    t.write.parquet(feed)
    keys = ["run_id", "track_id", "segment_idx"]

    def attempt(df: DataFrame, i: int) -> None:
        """What is due is looked up among the artifacts there are now; what fails again goes back to the feed."""
        rows = df.persist()
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={i}")
        due = rows.filter("kind = 'again'").select(*keys, "attempt").join(s.read.schema("track_id bigint").parquet(there).withColumn("_there", F.lit(True)), "track_id", "left")
        due.filter("_there").select(*keys, F.lit("done").alias("kind"), "attempt").write.mode("overwrite").parquet(f"{out}-done/batch_id={i}")
        due.filter("_there is null").select(*keys, "attempt", F.lit("artifact_missing").alias("failure_class")).write.mode("append").parquet(feed)
        rows.unpersist()

    come = {0: t.filter("track_id % 4 = 0"), 2: t.filter("track_id % 4 = 1")}
    t.limit(0).select("track_id").write.parquet(there)
    for k in range(5):
        if k in come:
            come[k].select("track_id").write.mode("append").parquet(there)
        failed = s.readStream.schema(t.schema).parquet(feed)
        for _ in range(2):  # rows that wait, then, when their time has come, their timers
            due = state.retries(failed, contract.RETRYABLE, base_ms=20, cap_ms=100, most=5)
            one_batch(due, attempt, f"{feed}-cp")
            time.sleep(0.15)
    rows = s.read.parquet(out).filter("kind != 'again'").select("track_id", "segment_idx", "kind", "attempt", F.coalesce("wait_ms", F.lit(-1).cast("bigint")).alias("wait_ms"))
    return rows.unionByName(s.read.parquet(f"{out}-done").select("track_id", "segment_idx", "kind", "attempt", F.lit(-1).cast("bigint").alias("wait_ms")))


@query("st_checkpoint_progress", ALL3 + PLACES_SQL + """ SELECT topic AS topic_name, CAST(n % 2 AS INTEGER) AS partition_id, run_id, coalesce(max(n) FILTER (WHERE n // 1000 % 2 = 0), -1) AS before, max(n) AS after,
  max(n) > coalesce(max(n) FILTER (WHERE n // 1000 % 2 = 0), -1) AS advanced FROM places GROUP BY topic, n % 2, run_id""")
def _(s, d):
    """The offset ledger after two triggers of the stream, against that after the first."""
    src, out = run_events(s, d, waves=2), shared(s, "written")
    tables, seen = sinks.store(s, out), []
    live = f"{src}/live"
    for k in range(2):
        sinks.moved(s, f"{src}/wave={k}", live)
        pipelines.writer(readers.topic_records(s, live, streaming=True), out, f"{out}/_cp").awaitTermination()
        seen.append(tables.read("checkpoints"))
    moved = pipelines.progress(*seen)
    return moved.select("topic_name", "partition_id", "run_id", F.coalesce("before", F.lit(-1).cast("bigint")).alias("before"), "after", "advanced")


@query("gate_dashboard", ALL3 + SUMMARY_SQL + """, e AS (SELECT *, row_number() OVER (ORDER BY silent_ratio, run_id) AS low, row_number() OVER (ORDER BY silent_ratio DESC, run_id) AS high FROM summary WHERE segments_persisted > 0),
  c AS (SELECT a.run_id AS quiet_run, b.run_id AS loud_run, a.avg_rms < b.avg_rms AS level FROM e a, e b WHERE a.high = 1 AND b.low = 1)
  SELECT count(*) AS rows, 'rate' AS check_name, count(*) FILTER (WHERE NOT (error_rate BETWEEN 0 AND 1)) AS failures, count(*) FILTER (WHERE NOT (error_rate BETWEEN 0 AND 1)) = 0 AS ok FROM summary
  UNION ALL SELECT count(*), 'segments', count(*) FILTER (WHERE segments_persisted < 3), count(*) FILTER (WHERE segments_persisted < 3) = 0 FROM summary
  UNION ALL SELECT count(*), 'errors', count(*) FILTER (WHERE processing_error_count + writer_error_count > 0), count(*) FILTER (WHERE processing_error_count + writer_error_count > 0) = 0 FROM summary
  UNION ALL SELECT 2, 'quieter/' || quiet_run || '/' || loud_run, CASE WHEN level THEN 0 ELSE 1 END, level FROM c""")
def _(s, d):
    """Rules of each run, and one across runs: the run with the largest silent share has a lower mean level than that with the least."""
    summary = queries.stored(s)(summary_of(s, d), "summary")
    rules = {"rate": "error_rate between 0 and 1", "segments": "segments_persisted >= 3", "errors": "processing_error_count + writer_error_count = 0"}
    return reconcile.checks(summary, rules).unionByName(reconcile.silent_is_quieter(summary))
