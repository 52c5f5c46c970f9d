"""Quality gates and dataset building: reasons, anomalies, verdicts, labels, splits.

Everything is keyed by ``run_id``, so one job serves many runs. A snapshot is three tables:
tracks (with their segment counts), features and the manifest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format.
MEL_BINS, MEL_FRAMES = 128, 300
SUBSET = "small"
HIGH_SILENT_RATIO = 0.95
KEY = ["run_id", "track_id", "segment_idx"]
#: What a segment has beside its key, and what a judged track has.
SEGMENT = ("artifact_uri", "checksum", "manifest_uri", "rms", "silent_flag", "mel_bins", "mel_frames", "processing_ms")
TRACK = ("run_id", "track_id", "artist_id", "genre", "subset", "validation_status", "segments_persisted", "accepted_segments", "rejection_reason")

COMPARED = ("artifact_uri", "checksum", "manifest_uri")

#: Adds the texts of features; adds those of manifest rows, whose own columns bear the prefix.
Described = Callable[[DataFrame], DataFrame]
Listed = Callable[[DataFrame, str], DataFrame]

#: reason -> (anomaly type, severity); a reason that is absent raises no anomaly by itself.
ANOMALIES = {
    "duplicate_audio_features_key": ("duplicate_audio_features_key", "blocking"),
    "track_metadata_missing": ("feature_without_track_metadata", "blocking"),
    "track_not_validated": ("feature_for_rejected_track", "blocking"),
    "unexpected_mel_shape": ("unexpected_mel_shape", "blocking"),
    "manifest_row_missing": ("manifest_row_missing", "blocking"),
    "artifact_uri_mismatch": ("artifact_uri_mismatch", "blocking"),
    "checksum_mismatch": ("checksum_mismatch", "blocking"),
    "manifest_uri_mismatch": ("manifest_uri_mismatch", "warning"),
    "missing_audio_features_row": ("manifest_segment_missing_features", "blocking"),
}


def as_is(rows: DataFrame, prefix: str = "") -> DataFrame:
    return rows


def join_reasons(*reasons: Column) -> Column:
    """Sorted distinct non-null reasons, joined by ``;``."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons)))), ";")


def first_manifest_rows(manifest: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(the first row of each key, further rows as anomalies with their count)."""
    best = manifest.groupBy(*KEY).agg(
        F.min_by(F.struct(*[c for c in manifest.columns if c not in KEY]), F.col(order)).alias("_m"), F.count(F.lit(1)).alias("_n")
    )
    rows = best.select(*KEY, "_m.*")
    return rows, best.filter("_n > 1").select(*KEY, (F.col("_n") - 1).alias("extra_rows"))


def manifest_required(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """Per run: does it need a manifest (features exist, or a validated track has segments)?"""
    f = features.groupBy("run_id").agg(F.lit(True).alias("has_features"))
    t = tracks.groupBy("run_id").agg(F.bool_or((F.col("validation_status") == "validated") & (F.col("segments_persisted") > 0)).alias("has_segments"))
    return t.join(f, "run_id", "full_outer").select("run_id", (F.coalesce("has_features", F.lit(False)) | F.coalesce("has_segments", F.lit(False))).alias("manifest_required"))


def beside_manifest(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """Features with ``n_rows`` of their key, ``listed`` and the columns of their manifest row as ``m_...`` (null without one)."""
    # counted in the shuffle and order by key that the join with the manifest takes as well
    counted = features.withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    m = manifest.select(*KEY, *[F.col(c).alias(f"m_{c}") for c in manifest.columns if c not in KEY], F.lit(True).alias("listed"))
    return counted.join(m, KEY, "left")


def artifact_flags(pairs: DataFrame) -> DataFrame:
    """Features beside their manifest row: one flag per comparison (null-safe)."""
    listed = F.col("listed").isNotNull()
    differ = lambda c: listed & ~F.col(c).eqNullSafe(F.col(f"m_{c}"))
    flags = {"manifest_row_missing": ~listed} | {f"{c}_mismatch": differ(c) for c in COMPARED}
    return pairs.withColumns(flags).drop("listed", *[c for c in pairs.columns if c.startswith("m_") and c != "m_manifest_uri"])


def segment_reasons(tracks: DataFrame, features: DataFrame, manifest: DataFrame, described: Described = as_is, listed: Listed = as_is) -> DataFrame:
    """Every feature row with ``reason`` (empty: accepted) and the pieces behind it.

    Features and manifest may come without the texts that follow from their other columns: ``described``
    adds a feature's, ``listed`` those of its manifest row, after both have met, so that no shuffle or sort holds them.
    """
    pairs = listed(described(beside_manifest(features, manifest)), "m_")
    status = tracks.select("run_id", "track_id", F.col("validation_status").alias("t_status"), F.col("genre").alias("t_genre"))
    flags = artifact_flags(pairs).join(status, ["run_id", "track_id"], "left")
    when = lambda c, r: F.when(c, F.lit(r))
    status_bad = F.when(F.col("t_status") != "validated", F.concat(F.lit("track_validation_status="), F.col("t_status")))
    return flags.withColumn(
        "reason",
        join_reasons(
            when(F.col("n_rows") > 1, "duplicate_audio_features_key"),
            when(F.col("t_status").isNull(), "track_metadata_missing"),
            status_bad,
            when((F.col("mel_bins") != MEL_BINS) | (F.col("mel_frames") != MEL_FRAMES), "unexpected_mel_shape"),
            *[when(F.col(c), c) for c in ("manifest_row_missing", "artifact_uri_mismatch", "checksum_mismatch", "manifest_uri_mismatch")],
        ),
    )


def unmatched_manifest(features: DataFrame, manifest: DataFrame, listed: Listed = as_is, stored: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Manifest rows that no feature row has: rejected segments."""
    rows = stored(manifest.join(features.select(*KEY), KEY, "left_anti"), "unmatched")
    return listed(rows, "").select(*KEY, "artifact_uri", F.lit("missing_audio_features_row").alias("reason"))


def rejected_segments(reasons: DataFrame, unmatched: DataFrame) -> DataFrame:
    names = [c for c in (*KEY, "artifact_uri", "reason") if c in reasons.columns]
    bad = reasons.filter("reason != ''").select(*names, F.lit("audio_features").alias("source"))
    return bad.unionByName(unmatched.select(*names, F.lit("segment_manifest").alias("source")))


def anomaly_rows(rejected: DataFrame) -> DataFrame:
    """One row per failed check of a rejected segment, with its type and severity."""
    spark = rejected.sparkSession
    kinds = spark.createDataFrame([(r, *v) for r, v in ANOMALIES.items()], "one string, anomaly_type string, severity string")
    rows = rejected.select(*KEY, F.explode(F.split("reason", ";")).alias("one"))
    rows = rows.withColumn("one", F.when(F.col("one").startswith("track_validation_status="), "track_not_validated").otherwise(F.col("one")))
    return rows.join(F.broadcast(kinds), "one").select(*KEY, "anomaly_type", "severity")


def run_anomalies(summary: DataFrame) -> DataFrame:
    """Warnings that the run summary gives."""
    kinds = (
        ("track_validation_failures", F.col("validation_failures") > 0),
        ("processing_errors_present", F.col("processing_error_count") > 0),
        ("writer_errors_present", F.col("writer_error_count") > 0),
        ("high_silent_ratio", (F.col("silent_ratio") >= HIGH_SILENT_RATIO) & (F.col("segments_persisted") > 0)),
    )
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]))
    return summary.select("run_id", F.explode(found).alias("anomaly_type"), F.lit("warning").alias("severity"))


def anomaly_summary(rows: DataFrame, examples: int = 5) -> DataFrame:
    """Count and first examples per run, severity and type; examples are ranked before they are collected."""
    keys = ["run_id", "severity", "anomaly_type"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("track_id", "segment_idx"))
    first = rows.withColumn("_r", rank).filter(F.col("_r") <= examples)
    text = F.concat_ws("/", F.col("track_id").cast("string"), F.col("segment_idx").cast("string"))
    lists = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", text.alias("e")))).alias("_l"))
    return counts.join(lists.select(*keys, F.array_join(F.transform("_l", lambda x: x["e"]), ",").alias("examples")), keys)


def quality_verdict(anomalies: DataFrame, runs: DataFrame) -> DataFrame:
    """``fail`` on any blocking anomaly, ``pass_with_warnings`` on any warning, else ``pass``."""
    sums = anomalies.groupBy("run_id").agg(
        F.count_if(F.col("severity") == "blocking").alias("blocking"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.array_join(F.array_sort(F.collect_set("anomaly_type")), ";").alias("reasons"),
    )
    out = runs.select("run_id").distinct().join(sums, "run_id", "left").fillna(0, ["blocking", "warnings"]).fillna("", ["reasons"])
    return out.withColumn("verdict", F.when(F.col("blocking") > 0, "fail").when(F.col("warnings") > 0, "pass_with_warnings").otherwise("pass"))


def accepted_by_track(reasons: DataFrame) -> DataFrame:
    return reasons.filter("reason = ''").groupBy("run_id", "track_id").agg(F.count(F.lit(1)).alias("accepted_segments"))


def track_reasons(tracks: DataFrame, reasons: DataFrame) -> DataFrame:
    """Tracks with ``rejection_reason`` (null: accepted); ``tracks`` has ``segments_persisted``."""
    out = tracks.join(accepted_by_track(reasons), ["run_id", "track_id"], "left").fillna(0, ["accepted_segments"])
    reason = (
        F.when(~F.col("subset").eqNullSafe(F.lit(SUBSET)), f"subset_not_{SUBSET}")
        .when(F.col("validation_status") != "validated", F.concat(F.lit("validation_status="), "validation_status"))
        .when((F.col("accepted_segments") <= 0) & (F.col("segments_persisted") <= 0), "validated_without_persisted_segments")
        .when(F.col("accepted_segments") <= 0, "validated_without_accepted_segments")
    )
    return out.withColumn("rejection_reason", reason)


def accepted_tracks(judged: DataFrame) -> DataFrame:
    return judged.filter("rejection_reason is null")


def no_accepted(judged: DataFrame) -> DataFrame:
    """Blocking anomaly of runs that have tracks and none accepted."""
    none = judged.groupBy("run_id").agg(F.count_if(F.col("rejection_reason").isNull()).alias("n")).filter("n = 0")
    return none.select("run_id", F.lit("no_accepted_dataset_tracks").alias("anomaly_type"), F.lit("blocking").alias("severity"))


def label_map(accepted: DataFrame) -> DataFrame:
    """Genres of a run with dense ids from 0 in code point order, tracks and segments."""
    sums = accepted.groupBy("run_id", "genre").agg(F.count(F.lit(1)).alias("track_count"), F.sum("accepted_segments").alias("segment_count"))
    return sums.withColumn("label_id", F.dense_rank().over(Window.partitionBy("run_id").orderBy("genre")) - 1)


def accepted_segments(reasons: DataFrame, accepted: DataFrame, labels: DataFrame) -> DataFrame:
    """Accepted rows of accepted tracks with genre and label id, and those of ``SEGMENT`` that ``reasons`` has."""
    t = accepted.select("run_id", "track_id", "genre", "artist_id").join(labels.select("run_id", "genre", "label_id"), ["run_id", "genre"])
    rows = reasons.filter("reason = ''")
    if "manifest_uri" in rows.columns:
        rows = rows.withColumn("manifest_uri", F.coalesce("m_manifest_uri", "manifest_uri"))
    return rows.select(*KEY, *[c for c in SEGMENT if c in rows.columns]).join(t, ["run_id", "track_id"])


def hash_split(groups: DataFrame, key: str = "group_key") -> DataFrame:
    """Adds ``split`` to the groups of each run, ordered by a hash of run and key.

    One group: train; two: train and test; else a tenth (one at least) each for validation
    and test, from the end of the order. Positions come from counts by leading hash digits
    plus a rank inside one such bucket, so a run with very many groups is not one task.
    """
    g = groups.withColumn("_h", F.sha2(F.concat_ws(":", "run_id", F.col(key).cast("string")), 256)).withColumn("_b", F.substring("_h", 1, 3))
    buckets = g.groupBy("run_id", "_b").agg(F.count(F.lit(1)).alias("_n"))  # 4096 a run at most
    w = Window.partitionBy("run_id").orderBy("_b")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy("run_id"))
    buckets = buckets.select("run_id", "_b", before.alias("_before"), total.alias("n_groups"))
    rank = F.row_number().over(Window.partitionBy("run_id", "_b").orderBy("_h", key))
    out = g.withColumn("_r", rank).join(buckets, ["run_id", "_b"]).withColumn("position", F.col("_before") + F.col("_r"))
    n, p = F.col("n_groups"), F.col("position")
    tenth = F.greatest(F.lit(1), F.floor(n * F.lit(0.1)))
    split = (
        F.when(n == 1, "train")
        .when(n == 2, F.when(p == 1, "train").otherwise("test"))
        .when(p <= n - 2 * tenth, "train")
        .when(p <= n - tenth, "validation")
        .otherwise("test")
    )
    return out.withColumn("split", split).drop("_h", "_b", "_r", "_before")


def group_split(accepted: DataFrame) -> DataFrame:
    """Split of each accepted track: by artist when every track of the run has one, else by track."""
    unit = accepted.groupBy("run_id").agg(F.min(F.col("artist_id").isNotNull()).alias("by_artist"))
    t = accepted.join(unit, "run_id").withColumn("group_key", F.when(F.col("by_artist"), F.col("artist_id")).otherwise(F.col("track_id")))
    groups = hash_split(t.select("run_id", "group_key").distinct())
    unit_name = F.when(F.col("by_artist"), "artist_id").otherwise("track_id")
    kind = F.when(F.col("n_groups") < 3, F.concat(F.lit("degraded_"), unit_name)).otherwise(F.concat(F.lit("by_"), unit_name))
    return t.join(groups, ["run_id", "group_key"]).select(
        "run_id", "track_id", "artist_id", "group_key", "split", unit_name.alias("split_unit"), kind.alias("split_type")
    )


def split_rows(segments: DataFrame, splits: DataFrame) -> DataFrame:
    return segments.join(splits.select("run_id", "track_id", "split", "split_unit"), ["run_id", "track_id"])


def split_counts(rows: DataFrame) -> DataFrame:
    """Artists, tracks and segments per run and split; empty splits have a row of zeros."""
    spark = rows.sparkSession
    names = spark.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    every = rows.select("run_id").distinct().crossJoin(F.broadcast(names))
    sums = rows.groupBy("run_id", "split").agg(
        F.countDistinct("artist_id").alias("artists"), F.countDistinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("segments")
    )
    return every.join(sums, ["run_id", "split"], "left").fillna(0, ["artists", "tracks", "segments"])


def label_distribution(rows: DataFrame, by_split: bool = False) -> DataFrame:
    keys = ["run_id", *(["split"] if by_split else []), "label_id", "genre"]
    return rows.groupBy(*keys).agg(F.countDistinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("segments"))


def normalization(rows: DataFrame) -> DataFrame:
    """Statistics of the train split only, a row per run."""
    cols = ("rms", "processing_ms", "mel_bins", "mel_frames")
    stats = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return rows.filter("split = 'train'").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.countDistinct("track_id").alias("tracks"),
        F.count_if("silent_flag").alias("silent_segments"),
        F.avg(F.when(F.col("silent_flag"), 1.0).otherwise(0.0)).alias("silent_ratio"),
        *stats,
    )


def bundle_summary(judged: DataFrame, accepted_rows: DataFrame, rejected: DataFrame, labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    sides = [
        judged.groupBy("run_id").agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("rejection_reason").isNull()).alias("accepted_tracks")),
        n(accepted_rows, "accepted_segments"),
        n(rejected, "rejected_segments"),
        n(labels, "labels"),
    ]
    out = reduce(lambda a, b: a.join(b, "run_id", "left"), sides, verdicts.select("run_id", "verdict"))
    counts = ["tracks", "accepted_tracks", "accepted_segments", "rejected_segments", "labels"]
    return out.fillna(0, counts).withColumn("rejected_tracks", F.col("tracks") - F.col("accepted_tracks"))


class Bundle:
    """All tables of a dataset build, declared once and evaluated where they are used.

    ``stored`` (table, name to the table written and read again) cuts the plan at the tables that
    many others rest on; give it where more than one of them is wanted. ``wanted`` names the columns of
    ``SEGMENT`` that are asked for: stored tables hold these alone, beside keys and reasons, and texts that
    were compared go no further. Without it all tables have all columns. ``described`` and ``listed`` add texts
    that features and manifest come without (see ``segment_reasons``).
    """

    def __init__(
        self, tracks: DataFrame, features: DataFrame, manifest: DataFrame, summary: DataFrame, stored: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, wanted: tuple[str, ...] | None = None,
        described: Described = as_is, listed: Listed = as_is,
    ):
        self.tracks, self.features, self.manifest, self.run_summary, self._stored, self.wanted = tracks, features, manifest, summary, stored, wanted
        self._described, self._listed = described, listed

    @cached_property
    def reasons(self) -> DataFrame:
        rows = segment_reasons(self.tracks, self.features, self.manifest, self._described, self._listed)
        if self.wanted is not None:
            rows = rows.select(*KEY, "reason", *self.wanted, *(["m_manifest_uri"] if "manifest_uri" in self.wanted else []))
        return self._stored(rows, "reasons")

    @cached_property
    def unmatched(self) -> DataFrame:
        return unmatched_manifest(self.features, self.manifest, self._listed, self._stored)

    def texts(self, rows: DataFrame) -> DataFrame:
        """Feature rows with their texts: those that tables were kept without are made anew."""
        return rows if set(COMPARED[:2]) <= set(rows.columns) else self._described(rows)

    @cached_property
    def rejected(self) -> DataFrame:
        return rejected_segments(self.reasons, self.unmatched)

    @cached_property
    def judged(self) -> DataFrame:
        rows = track_reasons(self.tracks, self.reasons)
        return self._stored(rows if self.wanted is None else rows.select(*TRACK), "judged")

    @cached_property
    def accepted(self) -> DataFrame:
        return accepted_tracks(self.judged)

    @cached_property
    def labels(self) -> DataFrame:
        return label_map(self.accepted)

    @cached_property
    def segments(self) -> DataFrame:
        return accepted_segments(self.reasons, self.accepted, self.labels)

    @cached_property
    def splits(self) -> DataFrame:
        return group_split(self.accepted)

    @cached_property
    def rows(self) -> DataFrame:
        return self._stored(split_rows(self.segments, self.splits), "rows")

    @cached_property
    def every_anomaly(self) -> DataFrame:
        return anomaly_rows(self.rejected).unionByName(run_anomalies(self.run_summary), allowMissingColumns=True).unionByName(no_accepted(self.judged), allowMissingColumns=True)

    @cached_property
    def anomalies(self) -> DataFrame:
        return self.every_anomaly.select("run_id", "anomaly_type", "severity")

    @cached_property
    def verdicts(self) -> DataFrame:
        return quality_verdict(self.anomalies, self.tracks)

    @cached_property
    def summary(self) -> DataFrame:
        return bundle_summary(self.judged, self.segments, self.rejected, self.labels, self.verdicts)
