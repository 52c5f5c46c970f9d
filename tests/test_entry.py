"""Registered queries against DuckDB on the driver's smallest tables, and the entry contract."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
NAMES = ["agg_run_summary", "prj_metric_events", "agg_distribution", "agg_quality_verdict", "win_hash_split", "val_contract", "seg_windows", "jn_expected_observed", "agg_vector_welford", "srt_runs_page"]
NAMES += [
    "src_header_csv", "src_manifest", "src_artifacts", "src_processing_state", "src_resource_samples", "snk_manifest_merge", "snk_metrics", "snk_csv", "snk_json_docs", "snk_file_inventory", "snk_envelopes",
    "snk_purge_run", "val_topic_route", "val_failure_class", "val_strict_types", "prj_audio_path", "flt_subset", "chk_segment_audio", "prj_scaling", "agg_latency_entry", "agg_mel_bin_means", "agg_numeric_stats",
    "jn_run_summary", "jn_feature_artifact", "jn_replay_diff", "set_bundle_files", "set_segment_equality", "win_dup_features", "win_metric_dedupe", "win_latest_feature", "top_latest_artifact", "ts_rms",
    "fn_parse_uri", "fn_labels_digest", "seg_mono", "ft_rms", "ft_pipeline", "ft_silence", "st_ingest_events", "st_ingest", "st_checkpoint_progress", "st_failure_metrics", "ds_bundle", "gate_baseline", "gate_segment_reasons", "gate_artifact_verify",
    "snk_upsert_features", "snk_upsert_tracks", "st_writer", "st_retry", "st_processed_segments", "st_idempotent_replay", "src_manifest_rows", "src_envelopes", "gate_metric_stream", "gate_dashboard", "flt_segment_uri", "seg_encode",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_part(tmp_path, pipeline):
    """Both llm folders may be absent, with or without corpus_pipeline.py."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "trackloom", tmp_path / "trackloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q), set(s) <= set(q))"
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, *rest = run.stdout.split()
    assert int(n) > 190 and rest == ["False", "False", "True"]
