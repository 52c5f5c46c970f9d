"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a fixed shuffled order and queued up to ``passes`` times. An
entry's virtual finish time is the source's cumulative words up to its end, divided by the
source's target. The mix is the global order of finish times (ties by source, round and
shuffle order), truncated at the total budget of words: the entries whose running sum stays
within it are taken, whole. A source then has its target but for about one document.

Running sums are made in two levels: inside a source over buckets of the shuffle key, and over
the whole mix over ranges of finish times. Sources are served side by side, so equal ranges of
time hold about equally many words, whatever the source. What one task sees alone is one row
per source (ranks and targets), and one row per ``ROWS_PER_BUCKET`` documents. Only
DataFrame operations are used.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of
its own, ordered last; null or repeated ``doc_id`` rows are separate rows; rows without id are
shuffled by their texts, rows of one id by size and text. An empty table gives an empty result.
Extra columns are ignored here and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import position, take, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
ROWS_PER_BUCKET = 4096
BROADCAST_SOURCES = 20_000
WORD = "[^\\x20\\x09-\\x0D]+"


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 of the id, or of the text without one: the same at every run and in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = PASSES) -> DataFrame:
    """Per source (``_src``): rows, words, weight and target words.

    Targets split ``share`` of all words by weight; none exceeds ``most`` times its
    source, and what is over goes to the others by weight. With the sources ordered by
    the level at which they fill up, the final level is the largest of the levels
    reached when all before are full.
    """
    per = sizes.groupBy("_src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("_src").asc_nulls_last()))
    per = per.withColumn("_rank", rank).withColumn(
        "weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") - 1) % len(weights))
    )
    per = per.withColumn("_cap", most * F.col("source_size").cast("double"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("_level", level)
    top = F.max("_level").over(every)
    return per.withColumn("target", F.least(F.col("_cap"), top * F.col("weight"))).select(
        "_src", "_rows", "source_size", "weight", "target"
    )


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """``_id, _src, size, _row`` and the columns that fix the order inside a source.

    ``_row`` is the column ``row``, or a number that holds once the result is written.
    """
    df = take(docs, _id=doc_id, _src=source, _text=text, _row=row or "")
    text_ = F.col("_text").cast("string")
    return df.select(
        "_id",
        F.col("_src").cast("string").alias("_src"),
        F.coalesce(F.regexp_count(text_, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        shuffle_key(F.col("_id"), text_).alias("_key"),
        F.xxhash64(text_).alias("_text_hash"),
        (F.col("_row") if row else F.monotonically_increasing_id()).alias("_row"),
    )


ORDER = ["_key", "size", "_text_hash", "_row"]


def queued(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``sizes`` with the target columns and ``_start``: words of the source before the row."""
    if targets.count() <= BROADCAST_SOURCES:  # bounded by the check; else a shuffle join
        targets = F.broadcast(targets)
    rows = sizes.join(targets, sizes["_src"].eqNullSafe(targets["_src"])).drop(targets["_src"])
    n = F.ceil(F.col("_rows") / ROWS_PER_BUCKET)
    rows = rows.withColumn("_bucket", F.floor(F.shiftright("_key", 30) * n / F.lit(1 << 30)).cast("long"))
    parts = rows.groupBy("_src", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("_src").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_src", "_bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(parts, rows["_src"].eqNullSafe(parts["_s"]) & (rows["_bucket"] == parts["_b"]))
    return rows.withColumn("_start", F.col("_offset") + F.col("_cum")).drop("_s", "_b", "_offset", "_cum", "_bucket")


def entries(rows: DataFrame, passes: int = PASSES) -> DataFrame:
    """Every ``round`` of every row of ``queued`` that has words, with its ``virtual_finish``."""
    finish = (F.col("round") * F.col("source_size") + F.col("_start") + F.col("size")) / F.col("target")
    out = rows.filter("size > 0").withColumn("round", F.explode(F.array(*[F.lit(k) for k in range(passes)])))
    return out.withColumn("virtual_finish", finish)


def taken_entries(queue: DataFrame, budget: int, rows: int) -> DataFrame:
    """The entries that come first by virtual finish, as far as their words fit into ``budget``.

    A range is a stretch of finish times. Up to time 1 all sources together are served
    their targets, so ``rows / ROWS_PER_BUCKET`` ranges up to there hold about as many rows each.
    """
    ranges = max(1, -(-rows // ROWS_PER_BUCKET))
    queue = queue.withColumn("_range", F.floor(F.col("virtual_finish") * ranges).cast("long"))
    sums = queue.groupBy("_range").agg(F.sum("size").alias("_words"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).filter(F.col("_before") < budget).drop("_words")
    inside = Window.partitionBy("_range").orderBy("virtual_finish", F.col("_src").asc_nulls_last(), "round", *ORDER)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    ordered = queue.join(sums, "_range").withColumn("_end", F.col("_before") + F.sum("size").over(inside))
    return ordered.filter(F.col("_end") <= budget)


def mix(sizes: DataFrame, budget: int | None = None, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(queue, taken entries) of the written ``sizes``; ``budget`` in words, if below the targets' sum."""
    facts = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("rows")).first()
    full = int(min(SHARE, passes) * facts["words"])
    queue = written(queued(sizes, source_targets(sizes, most=passes)), "queue")
    return queue, taken_entries(entries(queue, passes), full if budget is None else min(budget, full), facts["rows"])


def mixed(docs: DataFrame, budget: int | None = None, passes: int = PASSES, **names: str) -> DataFrame:
    """Entries of the mix in its order: ``_id, source, round, size, virtual_finish``, range-sorted."""
    _, taken = mix(written(sized(docs, **names), "mix"), budget, passes)
    out = taken.select("_id", F.col("_src").alias("source"), "round", "size", "virtual_finish", "_end")
    return out.repartitionByRange("_end").sortWithinPartitions("_end").drop("_end")


def mixed_documents(docs: DataFrame, budget: int | None = None, passes: int = PASSES, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole, once per round; all columns stay."""
    names = docs.columns
    flat = docs.toDF(*[f"_k{i}" for i in range(len(names))]).withColumn("_row", F.monotonically_increasing_id())
    flat = written(flat, "rows")
    at = [f"_k{position(names, n)}" for n in (text, source, doc_id)]
    _, taken = mix(written(sized(flat, *at, row="_row"), "mix"), budget, passes)
    rounds = taken.groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    out = flat.join(rounds, "_row").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(names)])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of query op7."""
    queue, taken = mix(written(sized(docs), "mix"))
    words = taken.groupBy("_row").agg(F.sum("size").alias("_taken"))
    return queue.join(words, "_row", "left").select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")
    )
