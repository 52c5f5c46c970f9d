"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the ASCII controls tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def position(names: list[str], wanted: str) -> int | None:
    """Place of a column: the first exact match, else the first by letter case, else None."""
    same = [i for i, n in enumerate(names) if n == wanted] or [i for i, n in enumerate(names) if n.lower() == wanted.lower()]
    return same[0] if same else None


def numbered(names: list[str], wanted: str) -> Column:
    """The column ``wanted`` of a frame whose columns are renamed to ``_k0, _k1, ...``; absent: null strings."""
    at = position(names, wanted)
    return F.lit(None).cast("string") if at is None else F.col(f"_k{at}")


def take(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns of ``df`` under new names: ``take(df, _id="doc_id")``.

    Columns are found by position after a rename, so extra columns whose names
    clash (also by letter case) do no harm; the first exact match wins, then the
    first match by letter case. A column that is absent becomes null strings.
    """
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    out = []
    for new, old in wanted.items():
        at = position(names, old)
        col = F.lit(None).cast("string") if at is None else F.col(f"_c{at}")
        out.append(col.alias(new))
    return flat.select(*out)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does the same on all-ASCII strings, faster."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, LOWER)
    )


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null or blank texts."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def release_memory() -> None:
    """Give what is free back to the system: a Python worker waits for its next task with all it holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Only where the setting is absent and all runs on one machine, as in tests, a temporary
    folder is chosen and set as checkpoint directory; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    ensure_checkpoint(spark, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint(spark: SparkSession, root: str | None = None) -> None:
    """Make ``DataFrame.checkpoint`` usable, without moving a folder that is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root or shared_dir(spark, "ckpt"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
