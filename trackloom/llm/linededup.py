"""Line dedup: drop lines whose normalised form occurs in many documents.

Lines are exploded with their positions, normalised, hashed to 128 bits, counted by
distinct document per hash; lines whose hash reaches the threshold go, and the rest
are put together again by position. Only hashes and positions are shuffled for the
count; text moves once, when the positions to drop come back to their documents.

Defined results: a null or empty text is one empty line; empty keys never reach
``least_chars`` and so stay. Rows that repeat a ``doc_id`` count as one document but
each row is cleaned by itself; null ids are one document together. A text that loses
all lines becomes empty. Extra columns are kept by ``without_common_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import SPACES, ascii_lower, numbered, take, written

MIN_DOCS = 10
MIN_CHARS = 1
#: Up to so many common hashes (16 bytes each) are broadcast; more are joined by shuffle,
#: where adaptive execution splits the partition of a line found everywhere.
BROADCAST_HASHES = 250_000


def _key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def _hash128(*cols: Column) -> list[Column]:
    return [F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)]


def common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(every line as row key, position and key hash; hashes found in ``min_docs`` documents).

    ``docs`` has the columns ``_id``, ``_text`` and the row key ``_r1``, ``_r2``.
    """
    keys = docs.withColumn("_keys", F.transform(F.split("_text", "\n"), _key))
    lines = keys.select("_id", "_r1", "_r2", F.posexplode("_keys").alias("_pos", "_key"))
    lines = lines.filter(F.length("_key") >= min_chars)
    lines = lines.select("_id", "_r1", "_r2", "_pos", *[h.alias(n) for h, n in zip(_hash128(F.col("_key")), ("_h1", "_h2"))])
    # One row per (line, document) first, so that a line in very many documents is
    # summed up before it meets in one task.
    seen = lines.select("_h1", "_h2", F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_d"), F.col("_id").isNull().alias("_n"))
    common = (
        seen.distinct()
        .groupBy("_h1", "_h2")
        .count()
        .filter(F.col("count") >= min_docs)
        .select("_h1", "_h2")
    )
    return lines, common


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id", row: Column | None = None) -> DataFrame:
    """Per input row: ``_id``, ``_row``, ``n_lines``, ``n_dropped`` and the ``kept`` text."""
    packed = docs
    df = take(packed, _id=doc_id, _text=text) if row is None else packed.select(F.col("_id"), F.col("_text"), row.alias("_row"))
    df = df.withColumn("_text", F.coalesce(F.col("_text").cast("string"), F.lit("")))
    r1, r2 = _hash128(F.col("_id"), F.col("_text"))
    df = df.withColumns({"_r1": r1, "_r2": r2})
    lines, common = common_lines(df.select("_id", "_text", "_r1", "_r2"), min_docs, min_chars)
    common = written(common, "common-lines")
    if common.count() <= BROADCAST_HASHES:
        common = F.broadcast(common)
    gone = (
        lines.join(common, ["_h1", "_h2"], "left_semi")
        .groupBy("_r1", "_r2")
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    df = df.join(gone, ["_r1", "_r2"], "left").withColumn("_lines", F.split("_text", "\n"))
    df = df.withColumn(
        "_stay",
        F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>"))),
    )
    df = df.withColumns(
        {
            "n_lines": F.size("_lines").cast("long"),
            "n_dropped": (F.size("_lines") - F.size("_stay")).cast("long"),
            "kept": F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
                F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")
            ),
        }
    )
    return df.select(*(["_row"] if row is not None else []), "_id", "n_lines", "n_dropped", "kept")


def without_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the common lines taken out of the text; all columns stay."""
    names = docs.columns
    flat = docs.toDF(*[f"_k{i}" for i in range(len(names))])
    flat = flat.withColumns({"_id": numbered(names, doc_id), "_text": numbered(names, text)})
    row = F.struct(*[f"_k{i}" for i, n in enumerate(names) if n != text])
    out = dropped_lines(flat, min_docs, min_chars, row=row)
    return out.select(*[(F.col("kept") if n == text else F.col(f"_row._k{i}")).alias(n) for i, n in enumerate(names)])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of query op3."""
    return dropped_lines(docs).select(
        F.col("_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )
