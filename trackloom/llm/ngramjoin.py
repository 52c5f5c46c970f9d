"""N-gram Jaccard join: documents whose sets of word n-grams are alike.

1. Texts with the same words are one *text* from here on; each has MinHash values.
2. Bands of MinHash values that two texts share bring them into one bucket. A pair whose
   similarity is at the threshold shares a band but for a chance below 1e-6.
3. Inside a bucket pairs are compared a few MinHash values at a time. A pair is dropped as
   soon as the posterior probability that it reaches the threshold falls below the
   tolerance (uniform prior: the probability is a binomial sum).
4. Texts joined by what is left form groups. Inside a group all pairs are pruned the same
   way, and what survives is verified exactly on the whole n-gram sets. Only sums per
   text and a spanning forest of the verified links leave the task.
5. Components of verified links are the classes.

Large buckets and groups are dealt into blocks by a hash, and each pair of blocks is a tile
in a task of its own: no pair rows are written, no group meets in one task, and every pair
is compared. Blocks are bounded by rows and by bytes, so a tile of long texts fits a worker. N-gram sets are made again from the texts of grouped documents instead of
being stored for all.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a text of fewer words than
n has one n-gram, all its words; a text without words links to nothing, not to its like
either. Null texts are such texts. Rows that repeat an id are rows of their own. A class is
named by its least ``doc_id`` (null if all are null). Extra columns are ignored by ``classes`` and
kept by ``one_of_each_class``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import hashing
from trackloom.llm.common import numbered, shared_dir, take, written
from trackloom.llm.components import components
from trackloom.session import ship_package

N = 5
THRESHOLD = 0.8
#: Values in a band, and bands: at similarity 0.8 all bands differ with chance 4e-7.
ROWS, BANDS = 4, 28
VALUES = ROWS * BANDS
#: A pair is dropped when it reaches the threshold with less probability than this.
TOLERANCE = 1e-6
STEP = 8
#: Texts in a block of a tile, and bytes of them where texts are there themselves; a tile has two blocks.
BLOCK = 512
BLOCK_BYTES = 8 << 20
_A = (hashing.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * hashing.MULT)) | np.uint64(1)


def least_matches(threshold: float = THRESHOLD, values: int = VALUES, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches a pair needs to stay), every ``STEP`` values.

    With a uniform prior and m of n values equal, the similarity is Beta(m+1, n-m+1), and
    it reaches t with probability P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(STEP, values + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def gram_sets(texts: pa.Array, n: int = N) -> tuple[list[np.ndarray], np.ndarray]:
    """(sorted distinct n-gram hashes of each text, 16-byte key of its words; n.b. no words: no grams)."""
    w = hashing.Words(texts)
    grams, doc = hashing.ngrams(w.hash, w.at, tuple(range(n)))
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    count = np.diff(w.at)
    place = np.arange(len(w.hash)) - np.repeat(w.at[:-1], count)
    value = hashing.mix(w.hash ^ (place.astype(np.uint64) * hashing.MULT))
    both = np.zeros((len(texts), 2), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        both[some, 0] = hashing.mix(np.add.reduceat(value, w.at[some]) + count[some].astype(np.uint64))
        both[some, 1] = hashing.mix(np.add.reduceat(hashing.mix(value + np.uint64(77)), w.at[some]))
    sets = []
    for k in range(len(texts)):
        s = grams[cuts[k] : cuts[k + 1]]
        if not len(s) and count[k]:
            s = both[k, :1]
        sets.append(np.unique(s))
    return sets, both


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a set, cut to 16 bits."""
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(grams), 4096):
        least = np.minimum(least, ((grams[at : at + 4096, None] * _A) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return least.astype(np.uint16)


def text_hash() -> list[Column]:
    text = F.coalesce("_text", F.lit(""))
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7), text).alias("_h2")]


def signed(docs: DataFrame) -> DataFrame:
    """(``_id``, ``_text``) to ``_id``, a hash ``_h1, _h2`` of the text as it is, ``_rid`` (16-byte key of
    its words; null without words) and ``_sig``."""
    ship_package(docs.sparkSession)
    docs = docs.select("_id", "_text", *text_hash())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in hashing.slices(batch.column(1)):
                sets, keys = gram_sets(batch.column(1).slice(a, b - a))
                rid = pa.array([k.tobytes() if len(s) else None for k, s in zip(keys, sets)], pa.binary())
                sig = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in (0, 2, 3)], rid, sig], ["_id", "_h1", "_h2", "_rid", "_sig"])

    return docs.mapInArrow(sign, f"_id {docs.schema['_id'].dataType.simpleString()}, _h1 long, _h2 long, _rid binary, _sig binary")


def surviving(sig: np.ndarray, one: int, others: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Those of ``others`` that stay beside ``one`` to the last value."""
    same = np.zeros(len(others), np.int64)
    done = 0
    for n, m in needs:
        same += (sig[others, done:n] == sig[one, done:n]).sum(axis=1)
        stay = same >= m
        others, same, done = others[stay], same[stay], n
        if not len(others):
            break
    return others


class Forest:
    """Union-find over the rows of a tile; ``edges`` are the unions that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, one: int, others) -> None:
        for other in others:
            a, b = self.root(one), self.root(int(other))
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.edges.append((one, int(other)))


def _partners(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows to compare it with): rows of the other block, or later rows of a lone one.

    ``block`` is 0 or 1 by row, in order; all 0 where a tile is one block with itself.
    """
    n = len(block)
    rest = np.arange(n)
    first_other = int(np.searchsorted(block, 1))
    if first_other == n:
        for i in range(n - 1):
            yield i, rest[i + 1 :]
    else:
        for i in range(first_other):
            yield i, rest[first_other:]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal ``_tile`` of batches sorted by it, as tables."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        tile = batch.column("_tile").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for a, b in zip(cuts, cuts[1:]):
            if waiting and waiting[-1].column("_tile")[-1] != batch.column("_tile")[a]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def tiled(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Rows of groups dealt into tiles: adds ``_tile`` (a hash) and ``_side`` (0 or 1).

    A group of at most ``BLOCK`` rows is one tile. A larger one has enough blocks, and each
    pair of blocks (a block with itself too) is a tile; each row goes to one tile per block.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("_rid"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    rows = rows.withColumn("_other", other)
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    return rows.withColumns(
        {"_tile": F.concat_ws("/", F.hex(F.col(group)), low, high), "_side": (F.col("_block") > F.col("_other")).cast("int")}
    ).drop("_blocks", "_block", "_other", group, size)


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("_tile").sortWithinPartitions("_tile", "_side", "_rid")


EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def likely_edges(sigs: DataFrame) -> DataFrame:
    """A spanning forest, tile by tile, of the pairs that share a band and survive pruning.

    A pair counts in the tile of the first band that it shares, so the forests of later bands
    do not repeat the links of a large group.
    """
    needs = least_matches()
    size = 2 * ROWS
    keys = [F.xxhash64(F.lit(k), F.substring("_sig", k * size + 1, size)) for k in range(BANDS)]
    bands = sigs.select("_rid", F.posexplode(F.array(*keys)).alias("_k", "_band"))
    shared = bands.groupBy("_band").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    members = written(bands.join(shared, "_band"), "buckets")
    tiles = tiled(members, "_band", "_n").join(sigs, "_rid")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            rid = table.column("_rid").to_pylist()
            sig = np.frombuffer(b"".join(table.column("_sig").to_pylist()), np.uint16).reshape(-1, VALUES)
            forest, band = Forest(len(rid)), table.column("_k")[0].as_py()
            for one, others in _partners(table.column("_side").to_numpy()):
                others = surviving(sig, one, others, needs)
                if band and len(others):
                    before = sig[others, : band * ROWS] == sig[one, : band * ROWS]
                    others = others[~before.reshape(len(others), band, ROWS).all(axis=2).any(axis=1)]
                forest.join(one, others)
            a, b = ([rid[e[k]] for e in forest.edges] for k in (0, 1))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=EDGES)

    return _by_tile(tiles).mapInArrow(prune, "a binary, b binary")


def verified(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (``a``, ``b``, ``links``) from tiles of likely groups.

    ``b`` set: an edge of a spanning forest of verified links. ``b`` null: ``links`` more
    documents are linked to ``a``. ``groups``: (``_rid``, ``label``); ``texts``: (``_rid``, ``_text``, ``_copies``).
    """
    needs = least_matches()
    long = groups.join(texts.select("_rid", F.octet_length("_text").alias("_bytes")), "_rid").groupBy("label")
    by_bytes = F.ceil(F.sum("_bytes") * (BLOCK / BLOCK_BYTES)).cast("long")
    sizes = long.agg(F.greatest(F.count(F.lit(1)), by_bytes).alias("_n"))
    tiles = tiled(groups.join(sizes, "label"), "label", "_n").join(texts, "_rid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            rid, copies = table.column("_rid").to_pylist(), table.column("_copies").to_numpy()
            sets = []
            column = pa.concat_arrays(table.column("_text").chunks)
            for a, b in hashing.slices(column):
                sets += gram_sets(column.slice(a, b - a))[0]
            sig = np.stack([signature(s) for s in sets])
            count = np.array([len(s) for s in sets])
            values, number = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.concatenate([[0], np.cumsum(count)])
            mark = np.zeros(len(values), np.int64)
            forest, links = Forest(len(rid)), np.zeros(len(rid), np.int64)
            for one, others in _partners(table.column("_side").to_numpy()):
                others = surviving(sig, one, others, needs)
                if not len(others):
                    continue
                own = number[start[one] : start[one + 1]]
                mark[own] = 1
                size = count[others]
                ends = np.cumsum(size)
                where = np.arange(ends[-1]) + np.repeat(start[others] - (ends - size), size)
                both = np.add.reduceat(mark[number[where]], ends - size)
                mark[own] = 0
                linked = others[both >= THRESHOLD * (count[one] + size - both) - 1e-9]
                links[one] += copies[linked].sum()
                links[linked] += copies[one]
                forest.join(one, linked)
            some = np.flatnonzero(links)
            a = [rid[e[0]] for e in forest.edges] + [rid[i] for i in some]
            b = [rid[e[1]] for e in forest.edges] + [None] * len(some)
            n = [0] * len(forest.edges) + links[some].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "links"])

    return _by_tile(tiles).mapInArrow(verify, "a binary, b binary, links long")


def linked_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents ``_id, _h1, _h2, _rid``; linked texts ``_rid, label, links``) of (``_id``, ``_text``)."""
    spark = docs.sparkSession
    all_sigs = written(signed(docs), "signatures")
    whole = all_sigs.filter("_rid is not null")
    copies = whole.groupBy("_rid").agg(F.count(F.lit(1)).alias("_copies"), F.first("_sig").alias("_sig"))
    sigs = written(copies, "texts")
    groups = components(likely_edges(sigs.select("_rid", "_sig"))).select(F.col("v").alias("_rid"), "label")
    groups = written(groups, "groups")
    # One text of each grouped key: a row's key is made again only where its id is wanted.
    wanted = all_sigs.join(groups.select("_rid"), "_rid", "left_semi").groupBy("_rid").agg(F.min(F.col("_id")).alias("_id"))
    wanted = wanted.filter("_id is not null")
    near = docs.join(wanted.select("_id").distinct(), "_id", "left_semi")
    nulls = docs.filter("_id is null")
    texts = keyed_texts(near.union(nulls)).join(groups.select("_rid"), "_rid", "left_semi")
    texts = texts.groupBy("_rid").agg(F.first("_text").alias("_text")).join(sigs.select("_rid", "_copies"), "_rid")
    texts = written(texts, "grouped-texts")
    path = shared_dir(spark, "links")
    verified(groups, texts).write.parquet(path)
    found = spark.read.schema("a binary, b binary, links long").parquet(path)
    classes = components(found.filter("b is not null")).select(F.col("v").alias("_rid"), "label")
    links = found.filter("b is null").groupBy(F.col("a").alias("_rid")).agg(F.sum("links").alias("links"))
    return all_sigs.drop("_sig"), classes.join(links, "_rid")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(``_rid``, ``_text``): the key of the words beside each text."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in hashing.slices(batch.column(0)):
                part = batch.column(0).slice(a, b - a)
                sets, keys = gram_sets(part)
                rid = [k.tobytes() if len(s) else None for k, s in zip(keys, sets)]
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.binary()), part], ["_rid", "_text"])

    return docs.select("_text").mapInArrow(key, "_rid binary, _text string")


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents ``_id, _h1, _h2, _rid``; per text ``_rid, _label, class_id, n_links, _first``)."""
    ids, linked = linked_texts(docs)
    texts = ids.filter("_rid is not null").groupBy("_rid").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
    linked = linked.withColumnRenamed("label", "_label")
    texts = texts.join(linked, "_rid", "left").withColumn("_label", F.coalesce("_label", "_rid"))
    names = texts.filter("links is not null").groupBy("_label").agg(F.min("_first").alias("_least"))
    texts = texts.join(names, "_label", "left")
    return ids, texts.select(
        "_rid",
        "_label",
        "_first",
        F.coalesce("_least", "_first").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"),
    )


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: ``doc_id, class_id, n_links`` (other documents at the threshold or above)."""
    df = take(docs, _id=doc_id, _text=text).withColumn("_text", F.col("_text").cast("string"))
    ids, texts = _classed(df)
    out = ids.join(texts, "_rid", "left")
    alone = F.col("_label").isNull()
    return out.select(
        F.col("_id").alias("doc_id"),
        F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def one_of_each_class(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document of least id, all columns.

    Documents without words are classes of their own and all stay. Where the row that
    stays is repeated, one of its repeats stays.
    """
    names = docs.columns
    flat = docs.toDF(*[f"_k{i}" for i in range(len(names))])
    flat = flat.withColumns({"_id": numbered(names, doc_id), "_text": numbered(names, text)})
    flat = flat.withColumn("_text", F.col("_text").cast("string")).withColumns(dict(zip(("_h1", "_h2"), text_hash())))
    ids, texts = _classed(flat.select("_id", "_text"))
    best = texts.groupBy("_label").agg(F.min(F.struct(F.col("_first").isNull().alias("n"), "_first", "_rid")).alias("_best"))
    keep = best.select(F.col("_best._rid").alias("_r"), F.col("_best._first").alias("_f"))
    rows = ids.groupBy("_id", "_rid").agg(F.min(F.struct("_h1", "_h2")).alias("_h"), F.count(F.lit(1)).alias("_n"))
    worded = rows.join(keep, (rows["_rid"] == keep["_r"]) & rows["_id"].eqNullSafe(keep["_f"]))
    worded = worded.select(F.col("_id").alias("_i"), F.col("_h._h1").alias("_g1"), F.col("_h._h2").alias("_g2"), (F.col("_n") > 1).alias("_again"))
    blank = ids.filter("_rid is null").select(F.col("_id").alias("_i"), F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"), F.lit(False).alias("_again"))
    rows = worded.unionByName(blank.distinct())
    kept = flat.join(rows, flat["_id"].eqNullSafe(F.col("_i")) & (flat["_h1"] == F.col("_g1")) & (flat["_h2"] == F.col("_g2")))
    single = kept.filter("not _again")
    again = kept.filter("_again").dropDuplicates(["_id", "_h1", "_h2"])
    return single.unionByName(again).select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(names)])


def digest(docs: DataFrame) -> DataFrame:
    """Query op6."""
    return classes(docs)
