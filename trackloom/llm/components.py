"""Connected components of an edge table: forests inside tasks, then least labels in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import written
from trackloom.session import ship_package

MOST_ROUNDS = 60
#: Edges that a task turns into a forest; a task takes more edges in stretches of so many.
EDGES_PER_TASK = 500_000
#: Share of all vertices from which on a label is salted, and over how many salts.
HOT_SHARE = 1 / 1000
SALTS = 32


def forests(edges: DataFrame, tasks: int) -> DataFrame:
    """Fewer edges with the same components: in each task a star per tree, to its least vertex."""
    kind = edges.schema["a"].dataType.simpleString()

    def stars(up: dict) -> list[tuple]:
        pairs = []
        for v in up:
            root = v
            while up[root] != root:
                root = up[root]
            if root != v:
                pairs.append((v, root))
        return pairs

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        n, types = 0, None

        def root(x):
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def out() -> Iterator[pa.RecordBatch]:
            pairs = stars(up)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, types) for c in zip(*pairs)], ["a", "b"])

        for batch in batches:
            types = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            n += batch.num_rows
            if n >= EDGES_PER_TASK:
                yield from out()
                up.clear()
                n = 0
        yield from out()

    ship_package(edges.sparkSession)
    return edges.select("a", "b").coalesce(tasks).mapInArrow(shrink, f"a {kind}, b {kind}")


def _jumped(near: DataFrame, labels: DataFrame) -> DataFrame:
    """``near`` (``v, _old, label``) with the label of its label where that is less."""
    many = labels.count() * HOT_SHARE
    hot = labels.groupBy("label").count().filter(F.col("count") > many).select("label", F.lit(True).alias("_hot"))  # at most 1 / HOT_SHARE rows
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    jump = labels.select(F.col("v").alias("label"), F.col("label").alias("_next")).join(F.broadcast(hot), "label", "left")
    jump = jump.select("label", "_next", F.explode(salts).alias("_salt"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)
    return near.join(F.broadcast(hot), "label", "left").withColumn("_salt", salt).join(jump, ["label", "_salt"]).select("v", "_old", F.least("label", "_next").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(``v``, ``label``): the least vertex of its component, for each vertex of (``a``, ``b``).

    Edges are first replaced by forests of bounded stretches of them. Then a round takes the
    least label around each vertex and the label's own label: joins and summed shuffles,
    written to the shared folder round by round. Labels of more than a set share of all vertices, of which
    there are few, are salted where vertices meet their label's label, so a giant component is no hot key. Rounds grow with the logarithm of what
    diameter is left.
    """
    edges = written(edges.select("a", "b"), "cc-all")
    alone = edges.filter("a = b").select(F.col("a").alias("v"), F.col("a").alias("label")).distinct()
    few = forests(edges.filter("a != b"), max(1, -(-edges.count() // EDGES_PER_TASK)))
    few = written(few, "cc-forest")
    both = written(few.union(few.select("b", "a")).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "cc")
    for _ in range(MOST_ROUNDS):
        around = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("_near"))
        near = labels.join(around, "v").select("v", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        new = written(_jumped(near, labels), "cc")
        changed = new.filter("label != _old").limit(1).count()
        labels = new.select("v", "label")
        if not changed:
            return labels.union(alone.join(labels, "v", "left_anti"))
    raise RuntimeError("components did not settle")
