"""Whole flows against stated results: events, features of segments, vector state, bundles, percentiles."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import bundle, contract, dataset, reconcile, segments, stats
from trackloom.plans import roundtrips
from trackloom.sources import readers
from trackloom.streaming import stages, state

TRACKS = "run_id string, track_id long, artist_id long, genre string, subset string, source_audio_uri string, validation_status string, duration_s double, manifest_uri string, checksum string"
READY = "run_id string, track_id long, segment_idx int, artifact_uri string, checksum string, sample_rate int, duration_s double, is_last_segment boolean"


def wav(samples, channels=1):
    data = np.asarray(samples, np.uint8).tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, 32000, 32000 * channels, channels, 8) + b"data" + struct.pack("<I", len(data)) + data


def test_ingestion_events(spark):
    t = spark.createDataFrame([("r", 1, 7, "rock", "small", "u1", "validated", 3.5, None, None), ("r", 2, 7, "jazz", "small", "u2", "silent", 2.0, "m", "c"), ("q", 3, 7, "rock", "small", "u3", "validated", 1.0, None, None)], TRACKS)
    r = spark.createDataFrame([("r", 1, i, f"/a/{i}", "sha256:x", 32000, 3.0, i == 1) for i in range(2)], READY)
    rows = stages.ingestion_events(t, r, F.lit("2026-04-02T00:00:11Z"))
    values = [json.loads(x["value"]) for x in rows.collect()]
    assert all(list(v) == sorted(v) and list(v["payload"]) == sorted(v["payload"]) for v in values)
    assert contract.checked(rows.select("value")).filter("size(reasons) > 0").count() == 0
    totals = {(v["run_id"], v["payload"]["metric_name"]): v["payload"]["metric_value"] for v in values if v["event_type"] == "system.metrics"}
    assert totals == {("r", "tracks_total"): 2, ("r", "segments_total"): 2, ("r", "validation_failures"): 1, ("q", "tracks_total"): 1, ("q", "segments_total"): 0, ("q", "validation_failures"): 0}
    assert stages.ingestion_events(t.limit(0), r.limit(0), F.lit("2026-04-02T00:00:11Z")).count() == 0


def test_features_of_segments(spark):
    tone = (128 + 100 * np.sin(np.arange(96000) / 20)).astype(int)
    content = {0: wav(tone), 1: wav(np.full(96000, 128)), 2: b"no audio", 3: None, 4: wav(tone)}
    files = spark.createDataFrame([(f"/a/{k}", bytearray(v)) for k, v in content.items() if v is not None], "artifact_uri string, content binary")
    ready = spark.createDataFrame([("r", 1, k, f"/a/{k}", "sha256:" + ("0" if k == 4 else hashlib.sha256(v or b"").hexdigest()), 32000, 3.0, False) for k, v in content.items()], READY).withColumn("manifest_uri", F.lit(None).cast("string"))
    good, bad = stages.features_of_segments(ready, files)
    got = {r["segment_idx"]: r for r in good.collect()}
    assert set(got) == {0, 1} and got[1]["silent_flag"] and got[1]["rms"] == -60 and not got[0]["silent_flag"]
    x = (tone - 128) / 128
    assert got[0]["rms"] == pytest.approx(20 * np.log10(np.sqrt(np.mean(x * x))), abs=1e-6)
    assert {(r["segment_idx"], r["failure_class"]) for r in bad.collect()} == {(2, "decode_error"), (3, "artifact_missing"), (4, "checksum_mismatch")}
    flags = spark.range(1).select(*[contract.is_retryable(F.lit(c)).alias(c) for c in ("artifact_missing", "checksum_mismatch", "payload_validation_error")]).first()
    assert flags[:] == (True, True, False)


def test_log_mel_is_a_plain_transform():
    """One frame by the definition of the transform: Hann window, 1024 bins, slaney triangles."""
    r = np.random.default_rng(3)
    x = r.normal(0, 0.3, 40_000)
    got = segments.log_mel(x)
    assert got.shape == (128, 300) and (got[:, 126:] == 0).all()  # 40,000 samples are 126 frames
    k = 57
    padded = np.concatenate([x[512:0:-1], x, x[-2:-514:-1]])
    frame = padded[k * 320 : k * 320 + 1024] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1024) / 1024))
    n = np.arange(1024)
    power = np.array([abs(np.sum(frame * np.exp(-2j * np.pi * f * n / 1024))) ** 2 for f in range(513)])
    assert np.allclose(got[:, k], np.log(segments.mel_filters() @ power + 1e-9))


def test_two_channels_become_their_mean(spark):
    a, b = np.arange(50, 60), np.arange(200, 210)
    mono, rate = segments.decode_pcm(wav(np.stack([a, b], axis=1).ravel(), 2))
    assert rate == 32000 and np.allclose(mono, ((a - 128) / 128 + (b - 128) / 128) / 2)
    row = spark.createDataFrame([(bytearray(b"ab"),)], "d binary").select(roundtrips.as_wav(F.col("d")).alias("one"), roundtrips.as_wav(F.col("d"), 2).alias("two")).first()
    assert bytes(row["one"]) == wav(list(b"ab")) and bytes(row["two"]) == wav(list(b"ab"), 2)


def test_segments_cover_whole_texts(spark, tmp_path):
    rows = [(1, "a" * 250_000), (None, "b"), (2, None), (3, ""), (4, "é" * 60_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = roundtrips.stretches(spark, str(tmp_path)).select("doc_id", "segment_idx", F.octet_length("data").alias("n")).collect()
    assert sorted(map(str, ((r["doc_id"], r["segment_idx"], r["n"]) for r in got))) == sorted(map(str, [(1, 0, 96000), (1, 1, 96000), (1, 2, 58000), (None, 0, 1), (4, 0, 96000), (4, 1, 24000)]))


def test_vector_state_counts_an_id_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = np.random.default_rng(1)
    vectors = {("a", i): r.normal(5, 2, 3).tolist() for i in range(20)} | {("b", 1): [1.0, 2.0, 3.0]}
    df = spark.createDataFrame([(*k, v) for k, v in vectors.items()] * 2, "run_id string, id long, vector array<double>")
    src = str(tmp_path / "in")
    df.write.parquet(src)
    seen = []
    stream = state.vector_state(spark.readStream.schema(df.schema).parquet(src), shards=3)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda d, i: seen.extend(d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x["run_id"], x["bin"]): x for x in stages.merged_moments(spark.createDataFrame(seen, "run_id string, shard int, count long, mean array<double>, m2 array<double>")).collect()}
    for run in "ab":
        m = np.array([v for (k, _), v in vectors.items() if k == run])
        for b in range(3):
            x = got[run, b]
            assert (x["count"], x["mean"], x["m2"]) == (len(m), pytest.approx(m[:, b].mean()), pytest.approx(((m[:, b] - m[:, b].mean()) ** 2).sum(), abs=1e-9))


def test_percentiles(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANGES", 4)
    r = np.random.default_rng(2)
    data = {"a": r.normal(0, 1, 101).tolist(), None: [3.0] * 40 + [4.0] * 41, "one": [7.0], "two": [1.0, 2.0], "tail": (10.0 ** r.integers(0, 9, 60)).tolist()}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    points = {"p0": 0.0, "p30": 0.3, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {x["k"]: x for x in stats.percentiles(df, ["k"], "v", points).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert [got[k][n] for n in points] == pytest.approx(np.percentile(vs, [100 * p for p in points.values()]).tolist())
    whole = {x["k"]: x for x in stats.distribution(df, ["k"], "v").collect()}
    assert whole["none"]["count"] == 0 and whole["none"]["p50"] is None and whole[None]["p95"] == 4
    assert stats.percentiles(df.limit(0), ["k"], "v", points).count() == 0


def test_bundle_is_written_listed_and_checked(spark, tmp_path):
    tracks = spark.createDataFrame([("r", i, i % 3, "rock" if i % 2 else "jazz", "small", "silent" if i == 5 else "validated", 2) for i in range(6)], "run_id string, track_id long, artist_id long, genre string, subset string, validation_status string, segments_persisted long")
    feats = spark.createDataFrame([("r", i, k, f"/a/{i}/{k}", "c", "m", -3.0, False, 128, 300, 1.0) for i in range(6) for k in range(2)], "run_id string, track_id long, segment_idx long, artifact_uri string, checksum string, manifest_uri string, rms double, silent_flag boolean, mel_bins int, mel_frames int, processing_ms double")
    summary = spark.createDataFrame([("r", 1, 0, 0, 0.0, 12)], "run_id string, validation_failures long, processing_error_count long, writer_error_count long, silent_ratio double, segments_persisted long")
    b = dataset.Bundle(tracks, feats, feats.select("run_id", "track_id", "segment_idx", "artifact_uri", "checksum", "manifest_uri"), summary)
    seen = spark.createDataFrame([("r", "2026-01-01T00:00:00Z")], "run_id string, generated_at string")
    paths = [bundle.write(b, summary, seen, str(tmp_path / name), "build") for name in ("x", "y")]
    one, two = ({r["path"]: (r["row_count"], r["sha256"]) for r in bundle.manifest(spark, p).collect()} for p in paths)
    assert set(one) == set(bundle.LISTED) and {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()}
    assert one["accepted-tracks.csv"][0] == 5 and one["rejected-tracks.csv"][0] == 1 and one["accepted-segments.csv"][0] == 10 and one["rejected-segments.csv"][0] == 2
    assert sum(one[f"splits/{s}.parquet"][0] for s in ("train", "validation", "test")) == 10
    assert bundle.checked(spark, paths[0]).first()[:] == (0, 0, 0, 0, True)
    spark.range(1).write.parquet(paths[0] + "/foreign")
    assert bundle.checked(spark, paths[0]).first()[:] == (0, 1, 0, 0, False)


def test_quoted_headers_and_gates(spark, tmp_path):
    (tmp_path / "h.csv").write_text(',"artist, main",set\n,id,subset\ntrack_id,,\n7,3,small\n')
    got = readers.metadata_csv(spark, str(tmp_path / "h.csv"))
    assert got.columns == ["track_id", "artist, main.id", "set.subset"] and got.count() == 1
    e = spark.createDataFrame([("a", 1), ("b", 2)], "check_name string, n long")
    o = spark.createDataFrame([("a", 1), ("c", 2)], "check_name string, n long")
    assert {tuple(r) for r in reconcile.counts_agree(e, o).collect()} == {("a", 1, 1, True), ("b", 2, 0, False), ("c", 0, 2, False)}


def test_envelope_of_labels_alone(spark):
    """A payload with nothing but labels, and none at all, are JSON all the same."""
    rows = spark.createDataFrame([('{"scope":"x"}',), (None,)], "labels_json string")
    made = contract.envelopes(rows, "system.metrics", "writer", F.lit("2026-04-02T00:00:11Z"), F.lit("1")).filter("value is not null")
    assert all(set(json.loads(r["value"])["payload"]) <= {"labels_json"} for r in made.collect())
    body = F.to_json(F.struct(F.lit(None).cast("string").alias("x")))
    assert spark.range(1).select(body).first()[0] == "{}"
