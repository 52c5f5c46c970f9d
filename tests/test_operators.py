"""Golden facts and invariants of the operators, on small tables made here."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.functions import scalars
from trackloom.operators import contract, dataset, reconcile, segments, stats, views
from trackloom.sources import readers, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("seconds, n", [(1.01, 1), (3.0, 2), (4.49, 2), (4.51, 3), (29.95, 19), (30.6, 20), (0.5, 0)])
def test_windows_by_duration(spark, seconds, n):
    df = spark.createDataFrame([(1, int(seconds * 32000))], "track_id long, n long")
    rows = segments.windows(df, "n").orderBy("segment_idx").collect()
    assert len(rows) == n
    assert [r["is_last"] for r in rows] == [False] * (n - 1) + [True] * (n > 0)
    assert all(r["stop"] - r["start"] + r["padding"] == 96000 for r in rows)


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in (3, 1, 2)], "k string, v double")
    got = {r["k"]: r for r in stats.distribution(df, ["k"], "v").collect()}
    assert (got["a"]["p50"], got["a"]["p95"]) == (2.5, 3.85)
    assert (got["b"]["p50"], got["b"]["p95"], got["b"]["mean"]) == (2.0, 2.9, 2.0)


@pytest.mark.parametrize("text, digest", [('{"scope":"run_total"}', "ca4675c0903ea4a0"), ('{"topic":"audio.features","status":"ok"}', "50cf5d1890b0b079")])
def test_labels_digest(spark, text, digest):
    assert one(spark, scalars.labels_digest(F.lit(text))) == digest


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 100])
def test_hash_split_sizes(spark, n):
    groups = spark.createDataFrame([("r", i) for i in range(n)], "run_id string, group_key long")
    got = {r["split"]: r["count"] for r in dataset.hash_split(groups).groupBy("split").count().collect()}
    tenth = max(1, n // 10)
    want = {1: {"train": 1}, 2: {"train": 1, "test": 1}}.get(n, {"train": n - 2 * tenth, "validation": tenth, "test": tenth})
    assert got == want


def test_group_split_keeps_artists_together(spark):
    rows = [("r", t, t % 7, "g", 1) for t in range(60)]
    accepted = spark.createDataFrame(rows, "run_id string, track_id long, artist_id long, genre string, accepted_segments long")
    split = dataset.group_split(accepted)
    assert split.groupBy("artist_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r["split_unit"] for r in split.collect()} == {"artist_id"}
    some_null = accepted.withColumn("artist_id", F.when(F.col("track_id") > 0, F.col("artist_id")))
    assert {r["split_unit"] for r in dataset.group_split(some_null).collect()} == {"track_id"}


def test_verdict_is_monotone(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    anomalies = spark.createDataFrame([("a", "x", "blocking"), ("a", "y", "warning"), ("b", "y", "warning")], "run_id string, anomaly_type string, severity string")
    got = {r["run_id"]: r["verdict"] for r in dataset.quality_verdict(anomalies, runs).collect()}
    assert got == {"a": "fail", "b": "pass_with_warnings", "c": "pass"}


def metric_event(**change):
    payload = {"ts": "2026-04-02T00:00:11Z", "run_id": "demo-run", "service_name": "writer", "metric_name": "write_ms", "metric_value": 12.5, "labels_json": {"topic": "audio.features", "status": "ok"}, "unit": "ms"}
    payload |= change.pop("payload", {})
    e = {
        "event_id": "1", "event_type": "system.metrics", "event_version": "v1", "trace_id": "run/demo-run/service/writer", "run_id": "demo-run", "produced_at": "2026-04-02T00:00:11Z",
        "source_service": "writer", "idempotency_key": "system.metrics:v1:demo-run:writer:write_ms:2026-04-02T00:00:11Z:50cf5d1890b0b079", "payload": payload,
    }
    e |= change
    return json.dumps({k: v for k, v in e.items() if v is not None})


def segment_event(**payload):
    p = {"run_id": "r1", "track_id": 2, "segment_idx": 0, "artifact_uri": "/a", "checksum": "sha256:0", "sample_rate": 32000, "duration_s": 3.0, "is_last_segment": False}
    p |= payload
    return json.dumps({"event_id": "1", "event_type": "audio.segment.ready", "event_version": "v1", "trace_id": "run/r1/track/2", "run_id": "r1", "produced_at": "2026-04-02T00:00:11+00:00", "source_service": "ingestion", "idempotency_key": "audio.segment.ready:v1:r1:2:0", "payload": p})


@pytest.mark.parametrize(
    "text, reason",
    [
        (metric_event(), ""),
        (segment_event(), ""),
        (metric_event(trace_id=None), "fields;trace_id"),
        (metric_event(event_version="v2"), "version"),
        (metric_event(extra=1), "fields"),
        (metric_event(source_service="processing"), "source_service"),
        (metric_event(produced_at="2026-04-02T07:00:11+07:00"), "produced_at"),
        (metric_event(payload={"metric_value": "12.5"}), "payload"),
        (metric_event(payload={"unit": ""}), "payload"),
        (metric_event(idempotency_key="x"), "idempotency_key"),
        (metric_event(event_type="audio.other"), "event_type;source_service;payload;idempotency_key"),
        (segment_event(segment_idx="0"), "payload"),
        (segment_event(segment_idx=0.5), "payload"),
        (segment_event(duration_s=0), "payload"),
        (segment_event(sample_rate=True), "payload"),
        ('{"a": NaN}', "not_json_object"),
        ("[1]", "not_json_object"),
    ],
)
def test_contract(spark, text, reason):
    df = spark.createDataFrame([(text,)], "value string")
    got = contract.checked(df).select(F.array_join("reasons", ";")).first()[0]
    assert got == reason


def test_features_sink_keeps_first_times(spark, tmp_path):
    tables = sinks.store(spark, str(tmp_path / "s"))
    schema = "run_id string, track_id long, segment_idx int, rms double, ts timestamp, created_at timestamp, seq string"
    t = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
    first = spark.createDataFrame([("r", 1, 0, -1.0, t[0], t[0], "1"), ("q", 1, 0, -5.0, t[0], t[0], "1")], schema)
    second = spark.createDataFrame([("r", 1, 0, -2.0, t[1], t[1], "2"), ("r", 1, 1, -3.0, t[1], t[1], "2")], schema)
    for n, batch in ((0, first), (1, second), (1, second), (2, second)):
        tables.commit({"features": sinks.filled(batch, "features")}, "w", n)
    rows = {(r["run_id"], r["segment_idx"]): r for r in tables.read("features").collect()}
    assert len(rows) == 3 and rows["r", 0]["rms"] == -2.0 and rows["r", 0]["ts"] == t[0] and rows["q", 0]["rms"] == -5.0


def test_metrics_sink_scopes(spark, tmp_path):
    tables = sinks.store(spark, str(tmp_path / "s"))
    schema = "event_id string, run_id string, service_name string, metric_name string, metric_value double, labels_json string, ts timestamp, seq string"
    t = [dt.datetime(2026, 1, d) for d in (1, 2)]
    a = spark.createDataFrame([("1", "r", "processing", "silent_ratio", 0.1, '{"scope":"run_total"}', t[0], "1"), ("2", "r", "processing", "processing_ms", 5.0, "{}", t[0], "1")], schema)
    b = spark.createDataFrame([("3", "r", "processing", "silent_ratio", 0.2, '{ "scope": "run_total"}', t[1], "2"), ("4", "r", "processing", "processing_ms", 6.0, "{}", t[1], "2")], schema)
    for n, batch in enumerate((b, a, b)):  # the older one comes after the newer one
        tables.commit({"metrics": sinks.filled(sinks.keyed_metrics(batch), "metrics")}, "w", n)
    got = sorted((r["metric_name"], r["metric_value"]) for r in tables.read("metrics").collect())
    assert got == [("processing_ms", 5.0), ("processing_ms", 6.0), ("silent_ratio", 0.2)]


def test_header_csv(spark, tmp_path):
    p = tmp_path / "tracks.csv"
    p.write_text(",artist,set,track,track\n,id,subset,genre_top,duration\ntrack_id,,,,\n2,1,small,Hip-Hop,29.95\n666,99,small,Experimental,30.60\n7,3,small,,1.0\n8,4,large,Rock,2.0\n")
    raw = readers.metadata_csv(spark, str(p))
    assert raw.columns == ["track_id", "artist.id", "set.subset", "track.genre_top", "track.duration"]
    meta = readers.select_metadata(raw)
    assert [r["track_id"] for r in readers.subset_rows(meta, "small").collect()] == [2, 666]
    assert [r["track_id"] for r in readers.subset_rows(meta, "small", allow=[666]).collect()] == [666]
    with pytest.raises(ValueError, match="missing metadata columns: set.subset"):
        readers.select_metadata(raw.drop("`set.subset`") if "`set.subset`" in raw.columns else raw.select("track_id", "`artist.id`", "`track.genre_top`", "`track.duration`"))


def test_resource_samples(spark):
    lines = ["﻿" + json.dumps({"Name": "app-processing-1", "Container": "c", "CPUPerc": "3.99%", "MemUsage": "397.5MiB / 31.23GiB"}), "", json.dumps({"Name": "other", "CPUPerc": "1%", "MemUsage": "1GiB / 2GiB"})]
    got = readers.resource_samples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("processing", 3.99, 397.5), ("other", 1.0, 1024.0)]


def test_publish_replaces(spark, tmp_path):
    root = str(tmp_path)
    for n in (3, 5):
        sinks.publish(spark, root, "run-1", lambda p, n=n: spark.range(n).write.parquet(p))
    assert spark.read.parquet(f"{root}/run-1").count() == 5
    with pytest.raises(ValueError):
        sinks.publish(spark, root, "../x", lambda p: None)


def tone(seconds, hz, amplitude):
    return amplitude * np.sin(2 * np.pi * hz * np.arange(int(seconds * 32000)) / 32000)


def test_segment_features(spark):
    wavs = {1: tone(6, 440, 0.55), 2: np.concatenate([np.zeros(96000), tone(3, 660, 0.35)])}
    df = spark.createDataFrame([(k, bytearray(segments.encode_pcm(v))) for k, v in wavs.items()], "track_id long, content binary")
    cut = segments.cut_segments(df)
    got = segments.features(cut.drop("checksum")).orderBy("track_id", "segment_idx").collect()
    by = {k: [r for r in got if r["track_id"] == k] for k in (1, 2)}
    assert [len(v) for v in by.values()] == [4, 4]
    assert all((r["mel_bins"], r["mel_frames"]) == (128, 300) and r["error"] is None for r in got)
    assert not any(r["silent_flag"] for r in by[1]) and [r["silent_flag"] for r in by[2]] == [True, False, False, False]
    assert sum(r["rms"] for r in by[1]) / 4 == pytest.approx(-8.956, abs=0.01)
    assert by[2][0]["rms"] == -60.0
    bad = segments.features(spark.createDataFrame([(1, bytearray(b"x"))], "track_id long, content binary")).first()
    assert bad["error"] and bad["rms"] is None


def test_mel_peak_of_a_tone():
    mel = segments.log_mel(tone(3, 1000, 0.5)).mean(axis=1)
    peak = int(np.argmax(mel))
    filters = segments.mel_filters()
    at_1000 = int(np.argmax(filters[:, round(1000 / (32000 / 1024))]))
    assert abs(peak - at_1000) <= 1 and math.isfinite(mel.min())


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=20), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=20))
@settings(max_examples=5, deadline=None)
def test_expected_observed_finds_all(spark, a, b):
    e, o = (spark.createDataFrame(sorted({k: (k, v) for k, v in x}.values()) or [], "k int, v int") for x in (a, b))
    got = {(r["k"], r["problem"]) for r in reconcile.expected_observed(e, o, ["k"]).collect()}
    x, y = dict(a), dict(b)
    want = {(k, "missing") for k in x.keys() - y.keys()} | {(k, "unexpected") for k in y.keys() - x.keys()} | {(k, "differs") for k in x.keys() & y.keys() if x[k] != y[k]}
    assert got == want


def test_page_past_the_end_keeps_its_total(spark):
    df = spark.range(7)
    assert views.page(df, [F.col("id")], 3, 6).first()["total_count"] == 7
    assert views.page(df, [F.col("id")], 3, 3).first()["has_more"] is True


def test_work_of_one_run_is_split(spark, tmp_path):
    """A run's manifest goes to several tasks; state documents grow with the tracks."""
    from trackloom.plans import roundtrips

    rows = spark.range(3000).selectExpr("'run-1' as run_id", "id div 3 as track_id", "id % 3 as segment_idx", "concat('u', id) as artifact_uri")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.merge_manifest(rows, str(tmp_path / "m"))
        sinks.merge_manifest(rows, str(tmp_path / "m"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "m" / "run_id=run-1").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3000
    docs = roundtrips.state_documents(rows.withColumn("silent_flag", F.lit(True))).collect()
    assert len(docs) == 1000 and all(len(r["segments"]) == 3 for r in docs)
