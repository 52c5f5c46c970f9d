"""Findings of a review of size: contract checks, order of bytes in a statement."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.operators import bundle, contract, dataset, segments
from trackloom.plans import domain, flows, queries, roundtrips
from trackloom.sources import sinks, store
from trackloom.streaming import pipelines

SF = "/root/testdata/sf0.001"


def test_checks_are_generated_code(spark):
    """A lambda would take the rules out of it; names and types of a payload are told once."""
    plan = contract.checked(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    assert plan.count("schemaOfVariant") == 1


def test_checks_are_compiled(spark):
    """The JVM leaves a method of more than 8,000 bytes to its interpreter."""
    records = spark.range(1).selectExpr("'t' as topic", "0 as partition", "id as offset", "'k' as key", "string(rand()) as value")
    frame = contract.checked(records)._jdf.queryExecution()
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(frame, "codegen"))
    assert sizes and max(map(int, sizes)) < 8000


def test_feature_events_shuffle_no_texts(spark):
    plan = roundtrips.feature_events(spark, SF)._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if re.search(r"\bSort(Aggregate)?\b", line)]
    assert sorts and not any("artifact_uri" in line or "sha2" in line for line in sorts)


PAYLOAD = '{"labels_json":%s,"metric_name":"m","metric_value":1.5,"run_id":"r","service_name":"writer","ts":"2026-04-02T00:00:11Z"%s}'


@pytest.mark.parametrize(
    ("labels", "more", "ok"),
    [
        ("{}", "", True),
        ('{"a":{"b":[1]},"x>, metric_name: STRING":1,"l\\nm":2}', "", True),
        ('{"a":1}', ',"lz":{"b":1}', False),
        ('{"a":1}', ',"unit":null', False),
        ('{"a":1}', ',"unit":""', False),
        ("[]", "", False),
    ],
)
def test_payload_shape(spark, labels, more, ok):
    value = '{"event_id":"1","event_type":"system.metrics","event_version":"v1","payload":%s}' % (PAYLOAD % (labels, more))
    got = contract.checked(spark.createDataFrame([(value,)], "value string")).select(F.array_contains("reasons", "payload")).first()[0]
    assert got is not ok


def test_levels_follow_the_order_of_bytes():
    """Long texts whose halves differ: numbers of bytes must not depend on the order in which DuckDB hands rows on."""
    con = duckdb.connect()
    con.execute("SET threads = 8")
    con.execute("CREATE TABLE documents AS SELECT n AS doc_id, repeat('a', 96000) || repeat('é', 48000) || repeat('~', 50000) AS text FROM range(120) t(n)")
    got = con.execute(roundtrips.LEVEL_SQL + " SELECT segment_idx, min(level), max(level), min(n), max(n) FROM r GROUP BY 1 ORDER BY 1").fetchall()
    level = lambda s: float(np.sqrt(np.mean(((np.frombuffer(s.encode(), np.uint8) - 128.0) / 128) ** 2)))
    assert [r[3:] for r in got] == [(96000, 96000), (96000, 96000), (50000, 50000)]
    for row, text in zip(got, ("a" * 96000, "é" * 48000, "~" * 50000)):
        assert row[1:3] == pytest.approx((level(text),) * 2, abs=1e-12)


def test_features_come_in_small_batches(spark, monkeypatch):
    """Rows of a large Arrow batch are not held all at once."""
    taken = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema: taken.append(f))
    segments.features(spark.createDataFrame([], "n int, content binary"))
    wav = segments.encode_pcm(np.zeros(3200, np.float32))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int32()), pa.array([wav] * 199 + [None], pa.binary())], ["n", "content"])
    got = list(taken[0](iter([batch])))
    assert max(b.num_rows for b in got) <= segments.OUT_ROWS
    assert [n for b in got for n in b.column(0).to_pylist()] == list(range(200))
    assert [e is None for b in got for e in b.column("error").to_pylist()] == [True] * 199 + [False]


def test_stored_tables_hold_wanted_columns_alone(spark):
    """Texts that were compared are not written; the counts that rest on the tables stay."""
    held = {}
    keep = lambda df, name: held.setdefault(name, df)
    b = queries.bundle(spark, SF, stored=keep, wanted=("rms",))
    assert "rms" in b.rows.columns and b.rejected.columns == [*dataset.KEY, "reason", "source"]
    assert {c for df in held.values() for c in df.columns} & {"artifact_uri", "checksum", "manifest_uri", "source_audio_uri"} == set()
    whole = queries.bundle(spark, SF)
    assert {"artifact_uri", "checksum", "manifest_uri"} <= set(whole.rows.columns) and "artifact_uri" in whole.rejected.columns


def test_metric_stream_checks_once_and_keeps_one_store(spark, monkeypatch, tmp_path):
    """Checked metrics are read from where they were written; both sides of the join share a state store."""
    seen = []
    monkeypatch.setattr(flows, "shared", lambda s, name: seen.append(f"{tmp_path}/{name}") or seen[-1])
    out = queries.QUERIES["gate_metric_stream"](spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 5 and "schemaOfVariant" not in plan
    stores = tmp_path / "metric-stream-cp" / "state" / "0" / "0"
    assert stores.exists() and not any("keyToNumValues" in p.name or "keyWithIndexToValue" in p.name for p in stores.iterdir())


def test_waves_are_written_in_one_pass(spark, monkeypatch, tmp_path):
    """One write makes the folders of all waves."""
    monkeypatch.setattr(roundtrips, "shared", lambda s, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(roundtrips, "feature_events", lambda s, d: roundtrips.track_events(s, d).limit(0))
    path = roundtrips.run_events(spark, SF, waves=2)
    got = {r["wave"]: r["n"] for r in spark.read.parquet(path).groupBy("wave").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got[0] > 0 and sum(got.values()) == roundtrips.track_events(spark, SF).count() + roundtrips.metric_events(spark, SF).count()


def test_old_manifest_rows_stay_where_they_are(spark, tmp_path):
    """Runs of a batch are few: they go to the old rows, which a shuffle by run would gather in a task a run."""
    path = str(tmp_path / "m")
    rows = spark.range(200).select(F.concat(F.lit("run-"), (F.col("id") % 2).cast("string")).alias("run_id"), F.col("id").alias("track_id"), F.lit(0).alias("segment_idx"), F.lit("a").alias("artifact_uri"), F.lit("c").alias("checksum"))
    sinks.merge_manifest(rows, path)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        touched = sinks._touched(rows.filter("run_id = 'run-1'"), path, "run_id")
        plan = touched._jdf.queryExecution().executedPlan().toString()
        assert touched.count() == 100 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    sinks.merge_manifest(rows.filter("run_id = 'run-1'").withColumn("checksum", F.lit("new")), path)
    assert {(r["checksum"], r["count"]) for r in spark.read.parquet(path).groupBy("checksum").count().collect()} == {("c", 100), ("new", 100)}


def test_texts_are_made_after_rows_meet(spark):
    """No shuffle, sort or join of features and manifest holds their texts; they are compared all the same."""
    b = queries.bundle(spark, SF, wanted=())
    for df, below in ((b.reasons, "Window"), (b.unmatched, "Join")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "/segments/" in plan and plan.rindex("/segments/") < plan.index(below) and "sha2(" not in plan[plan.index(below) :]


def test_texts_made_late_equal_given_ones(spark):
    """Tables that come with their texts give the same reasons and rejected rows."""
    late = queries.bundle(spark, SF)
    whole = dataset.Bundle(late.tracks, domain.features(spark, SF), domain.manifest(spark, SF), late.run_summary)
    names = [*dataset.KEY, "n_rows", "reason", *dataset.COMPARED, "m_manifest_uri"]
    for got, want in ((late.reasons.select(names), whole.reasons.select(names)), (late.unmatched, whole.unmatched), (late.rejected, whole.rejected)):
        rows = [sorted(map(str, df.collect())) for df in (got, want)]
        assert rows[0] and rows[0] == rows[1]
    assert late.reasons.filter("reason like '%manifest_row_missing%'").count() == late.reasons.filter("m_manifest_uri is null").count() > 0


#: Damages to records: pattern, replacement.
DAMAGES = (
    ("", ""), ('"rms":[-0-9.E]+', '"rms":"NaN"'), ('"rms":[-0-9.E]+', '"rms":NaN'), ('"rms":[-0-9.E]+', '"rms":-3'), ('"rms":[-0-9.E]+', '"rms":1e999'), ('"rms":[-0-9.E]+', '"rms":"-Infinity"'), ('"metric_value":[-0-9.E]+', '"metric_value":"7.0"'),
    ('"track_id":', '"track_id":1,"track_id":'), ('"track_id":[0-9]+', '"track_id":9223372036854775808'), ('"track_id":([0-9]+)', '"track_id":$1.0'), ('"track_id":([0-9]+)', '"track_id":"$1"'), ('"labels_json":\\{', '"labels_json":{"a":1,"a":2,'),
    ('"labels_json":\\{[^}]*\\}', '"labels_json":5'), ('"labels_json":\\{[^}]*\\}', '"labels_json":[1]'), ('"labels_json":\\{[^}]*\\}', '"labels_json":"{}"'), ('"labels_json":\\{[^}]*\\},', ""), ('"labels_json":\\{[^}]*\\}', '"labels_json":{"a":1.50,"b":null}'),
    ("^", " "), ("$", " "), ("$", "x"), ("^(.*)$", "[$1]"), (":", ": "), ('"payload":\\{.*?\\},"produced', '"payload":{},"produced'), ('"payload":\\{.*?\\},"produced', '"produced'), ('"trace_id":"[^"]*"', '"trace_id":null'), (',"trace_id":"[^"]*"', ""),
    ('"event_id":"([^"]*)"', '"event_id":7'), ('"event_id":"', '"event_id":"\\\\u0041'), ('"event_id":"', '"event_id":"\\\\"payload\\\\":{'), ('"event_version":"v1"', '"event_version":"v2"'), ('"run_id":"run-', '"run_id":"ran-'), ('"source_service":"', '"source_service":"x'),
    ('"idempotency_key":"', '"idempotency_key":"x'), ('"produced_at":"([^"]*)Z"', '"produced_at":"$1+07:00"'), ('"ts":"([^"]*)Z"', '"ts":"$1+00:00"'), ('"ts":"([^"]*)"', '"ts":"soon"'), ('"mel_bins":128', '"mel_bins":0'), ('"mel_frames":[0-9]+', '"mel_frames":true'),
    ('"silent_flag":(true|false)', '"silent_flag":"$1"'), ('"unit":"[a-z]+"', '"unit":""'), ('"unit":"[a-z]+"', '"unit":null'), ('"subset":"small"', '"subset":"large"'), ('"subset":"small",', ""), ('"duration_s":[0-9.E]+', '"duration_s":-1.0'), ('"genre":', '"gender":'),
    ('"event_type":"audio.features"', '"event_type":"audio.segment.ready"'), ('"event_type":"[^"]*"', '"event_type":"other"'), ('"payload":\\{', '"payload":{"a":1,'), ('"event_id"', '"event_ix"'),
)


def test_plain_records_are_judged_as_by_the_rules(spark, tmp_path):
    """A record in the text of ``envelopes`` is told by its typed values; whatever is damaged gets what the rules one by one give."""
    events = [f(spark, SF).select("value").limit(3) for f in (roundtrips.track_events, roundtrips.feature_events, roundtrips.metric_events, roundtrips.segment_events)]
    rows = events[0].unionAll(events[1]).unionAll(events[2]).unionAll(events[3]).collect()
    text = F.lit(None).cast("string")
    for k, (pattern, new) in enumerate(DAMAGES):
        text = F.when(F.col("k") == k, F.regexp_replace("value", pattern, new)).otherwise(text)
    spark.createDataFrame([(n, k, r[0]) for n, r in enumerate(rows) for k in range(len(DAMAGES))], "n int, k int, value string").withColumn("value", text).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    got = contract.checked(raw).select("n", "k", *contract.FIELDS, "reasons")
    want = contract.judged(raw.withColumn("_text", F.col("value")), None).select("n", "k", *contract.FIELDS, F.col("_reasons").alias("reasons"))
    a, b = ({(r["n"], r["k"]): r[2:] for r in df.collect()} for df in (got, want))
    assert {key: a[key] for key in a if a[key] != b[key]} == {} and len(a) == len(rows) * len(DAMAGES)
    plain = {(r["n"], r["k"]) for r in contract.as_written(raw, None, "value").filter("_plain").collect()}
    assert plain >= {(n, 0) for n in range(len(rows))} and all(not a[key][-1] for key in plain)
    assert 5 < len({k for _, k in plain}) and sum(bool(r[-1]) for r in a.values()) > len(a) / 4


def test_bundle_texts_are_made_where_they_are_written(spark):
    """Tables that a bundle is made of hold no text that follows from a key; its items have all of them."""
    held = {}
    b = queries.bundle(spark, SF, stored=lambda df, name: held.setdefault(name, df), wanted=queries.MEASURES)
    items, whole = bundle._items(b, b.run_summary), queries.bundle(spark, SF)
    assert {"reasons", "judged", "rows", "unmatched"} <= set(held) and not {c for df in held.values() for c in df.columns} & set(dataset.COMPARED)
    for name, want in (("accepted-segments.csv", whole.segments), ("rejected-segments.csv", whole.rejected)):
        rows = [sorted(map(str, df.select(items[name].columns).collect())) for df in (items[name], want)]
        assert rows[0] and rows[0] == rows[1] and "artifact_uri" in items[name].columns
    sums = [sorted(map(str, df.collect())) for df in (items["dataset-card.md"], bundle._items(whole, b.run_summary)["dataset-card.md"])]
    assert sums[0] == sums[1]


def test_damaged_bundle_is_told_and_its_tables_go(spark, monkeypatch, tmp_path):
    """CSV items are gzip, read as they are; the tables that a bundle was made of do not stay."""
    names = iter(range(100))
    monkeypatch.setattr(roundtrips, "shared", lambda s, name: f"{tmp_path}/{name}-{next(names)}")
    monkeypatch.setattr(flows, "shared", roundtrips.shared)
    got = {r["bundle"]: r for r in queries.QUERIES["ds_bundle_check"](spark, SF).collect()}
    assert got["whole"]["ok"] and (got["damaged"]["missing"], got["damaged"]["unexpected"], got["damaged"]["ok"]) == (1, 1, False)
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"datasets", "check"}
    csv = next(tmp_path.glob("datasets-*/build/accepted-segments.csv"))
    assert [p for p in csv.iterdir() if p.name.endswith(".csv.gz")] and not [p for p in csv.iterdir() if p.name.endswith(".csv")]


def test_texts_that_follow_are_not_shuffled(spark, tmp_path):
    """A text that equals its expression goes as a flag; other texts and nulls stay what they are, and all are stored."""
    table = sinks.TABLES["features"]
    rows = [("r", 1, 0, "/artifacts/runs/r/segments/1/0.wav", "/artifacts/runs/r/manifests/segments.parquet"), ("r", 1, 1, "/other", None), ("r", 2, 0, None, "x")]
    df = spark.createDataFrame(rows, "run_id string, track_id long, segment_idx long, artifact_uri string, manifest_uri string").withColumns({"seq": F.lit("2026-01-01T00:00:00Z"), "created_at": F.timestamp_seconds(F.lit(7) * F.col("track_id"))})
    lean = store.without_followers(df, table.follows)
    assert [r["artifact_uri"] for r in lean.orderBy("track_id", "segment_idx").collect()] == [None, "/other", None]
    assert sorted(map(str, store.with_followers(lean, table.follows).select(df.columns).collect())) == sorted(map(str, df.collect()))
    tables = sinks.store(spark, str(tmp_path))
    assert tables.commit({"features": sinks.filled(df, "features")}, "w", 0)
    assert sorted(map(str, tables.read("features", columns=tuple(df.columns)).collect())) == sorted(map(str, df.collect()))
    files = tables.state().files["features"]
    assert sum(f["rows"] for f in files) == 3 and {f["bucket"] for f in files} == {r[0] for r in df.select(F.pmod(F.xxhash64(*table.keys), F.lit(store.BUCKETS))).collect()}


def test_a_batch_keeps_typed_fields(spark, tmp_path):
    """What a batch keeps of good records are fields by their types, with the same values as their texts."""
    events = roundtrips.feature_events(spark, SF).limit(50).unionAll(roundtrips.metric_events(spark, SF).limit(50)).select("value")
    loose = events.filter("value like '%audio.features%'").limit(5).withColumn("value", F.concat(F.lit(" "), "value"))
    events.unionAll(loose).unionAll(events.limit(1).select(F.lit("broken").alias("value"))).write.parquet(f"{tmp_path}/batch")
    batch = pipelines.positioned(spark.read.parquet(f"{tmp_path}/batch"))
    tables = sinks.store(spark, f"{tmp_path}/out")
    with pipelines.kept(contract.checked(batch, typed=True), tables, "w/0") as rows:
        assert "payload" not in rows.columns and rows.filter("size(reasons) > 0").count() == 1
        for topic in ("audio.features", "system.metrics"):
            got = contract.routed(rows, topic)
            want = contract.routed(contract.checked(batch), topic).select(*[c for c in got.columns if c not in ("event_id", "trace_id")])
            assert want.count() >= 50 and sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_files_of_folders_with_equal_names_move(spark, tmp_path):
    """Waves written in one pass have files of the same names; both end in one folder, and nothing is written again."""
    spark.range(10).selectExpr("id", "id % 2 as wave").coalesce(1).write.partitionBy("wave").parquet(f"{tmp_path}/t")
    for k in range(2):
        sinks.moved(spark, f"{tmp_path}/t/wave={k}", f"{tmp_path}/live")
        assert spark.read.parquet(f"{tmp_path}/live").count() == 5 * (k + 1)
    assert not list((tmp_path / "t").glob("wave=*/*.parquet"))


def test_records_go_after_their_last_delivery(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(roundtrips, "shared", lambda s, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(roundtrips, "feature_events", lambda s, d: roundtrips.track_events(s, d).limit(0))
    out = roundtrips.persisted(spark, SF, times=2)
    assert not (tmp_path / "topic").exists() and sinks.store(spark, out).read("tracks").count() == domain.tracks(spark, SF).count()
