"""LM scoring: log probability of whole texts by online logistic context mixing of their bits.

A text is its words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered) with one space between them, then one
end. ``score`` is the log10 of the probability that the bit mixing of ``bitmix`` gives this row of
bytes, context by context across words; ``bits_per_byte`` is its share of the text's bytes.

Steps: (1) windows of seven bytes are counted over all texts, those of texts held out with
count zero, summed in each task and then in shards by their hash; (2) contexts of two to five bytes
that hold more than a set share of all distinct windows are found, length by length, and windows are
dealt anew by the last two bytes of context, or as many more as it takes to leave a heavy one, so
that no context makes a large shard; counts after the lowest order and after heavy contexts, at most
256**2 rows and 256 for each heavy context, go to every task; (3) each shard learns mixer weights online over all its windows; shards are merged by exact
sums; (4) each distinct window is scored once; (5) documents add up their windows: frequent ones
from a broadcast table of fixed size, all others by a shuffle join. Word counts for the base
score take the same road without (2) to (4). The number of shards follows the bytes of the
input, nothing is cut or sampled, and shuffles hold distinct windows of a task, not places.

Scores do not depend on partitioning: shards learn in the order of their keys, and everything
summed across tasks is a whole number or a decimal.

Defined results: a null or empty text is the end alone; a null ``doc_id`` is not held out;
repeated rows count and are scored each; without training documents counts are zero and
the mixer is neutral; extra columns are ignored. Words go by 64-bit hashes: among a thousand
million distinct words the odds that any two share one are below 3 %.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import bitmix, hashing
from trackloom.llm.common import release_memory, take, written
from trackloom.llm.lookup import Lookup, frequent
from trackloom.session import ship_package

#: Rows of the broadcast tables.
TOP_WORDS = 200_000
TOP_WINDOWS = 2_000_000
#: Bytes of text for each shard of windows and words.
BYTES_PER_SHARD = 16 << 20
#: Distinct keys that a worker sums up before it sends them on.
KEYS_IN_HAND = 800_000
STRETCH = 1 << 19  # bytes of text at once
END_HASH = np.uint64(0x656E64206F662074)
#: Logarithms are summed as whole numbers of these parts.
SCORE_UNIT = 10**7
BASE_UNIT = 10**10
SHARDS = "shard long, n long, keys binary, counts binary"
VALUES = "key long, count long, value long"


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


# ---------------------------------------------------------------- what is counted


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words and ends in order, number of them in each text)."""
    w = hashing.Words(texts)
    n = np.diff(w.at)
    at = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(at[-1], END_HASH)
    out[np.arange(len(w.hash)) + np.repeat(np.arange(len(n)), n)] = w.hash
    return out, n + 1


def split(keys: np.ndarray, counts: np.ndarray, place: np.ndarray, shards: int) -> pa.RecordBatch:
    """Keys in order with their counts, a row for each shard that ``place`` deals them to."""
    shard = ((place >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(shard, kind="stable")  # keys stay in order inside a shard
    keys, counts, shard = keys[order], counts[order], shard[order]
    cuts = np.append(bitmix.firsts(shard), len(keys))
    spans = list(zip(cuts[:-1], cuts[1:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(shard[a]) for a, _ in spans], pa.int64()),
            pa.array([int(b - a) for a, b in spans], pa.int64()),
            pa.array([bitmix.packed_keys(keys[a:b]) for a, b in spans], pa.binary()),
            pa.array([bitmix.packed(counts[a:b]) for a, b in spans], pa.binary()),
        ],
        ["shard", "n", "keys", "counts"],
    )


def gathered(parts: DataFrame, result: Callable, schema: str) -> DataFrame:
    """``result(shard, keys, counts)`` of each shard of ``split`` rows: its distinct keys in order, with their sums."""

    def gather(key, table):
        tally = bitmix.Tally()
        for n, keys, counts in zip(*(table[c].to_pylist() for c in ("n", "keys", "counts"))):
            tally.merge(bitmix.unpacked_keys(keys, n), bitmix.unpacked(counts, n))
            tally.full()
        out = pa.Table.from_batches([result(key[0].as_py(), *tally.totals())])
        del tally, table
        release_memory()
        return out

    return parts.groupBy("shard").applyInArrow(gather, schema)


def counted(docs: DataFrame, keys_of: Callable, shards: int, result: Callable, schema: str) -> DataFrame:
    """``gathered`` keys of all rows, dealt by their hash, with their counts over rows with ``_learn``.

    ``docs`` holds ``_learn`` and ``_text``; keys of other rows are there with what is counted, or 0.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = bitmix.Tally(KEYS_IN_HAND)

        def rows() -> pa.RecordBatch:
            keys, counts = tally.totals()
            return split(keys, counts, hashing.mix(keys), shards)

        for batch in batches:
            learn = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in hashing.slices(batch.column(1), STRETCH):
                keys, size = keys_of(batch.column(1).slice(a, b - a))
                taken = np.repeat(learn[a:b], size)
                tally.add(keys[taken], 1)
                tally.add(keys[~taken], 0)
                if tally.full():
                    yield rows()
                    tally = bitmix.Tally(KEYS_IN_HAND)
        yield rows()
        del tally
        release_memory()

    return gathered(docs.select("_learn", "_text").mapInArrow(send, SHARDS), result, schema)


def packed_shard(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A shard as one row."""
    data = [[shard], [len(keys)], [bitmix.packed_keys(keys)], [bitmix.packed(counts)]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "n", "keys", "counts"])


def word_rows(_: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows (``key``, ``count``, ``value``): log10 of each word's count plus one, in parts of ``BASE_UNIT``."""
    return _rows(keys, counts, np.rint(np.log10(counts + 1.0) * BASE_UNIT).astype(np.int64))


def _rows(keys: np.ndarray, counts: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64()), pa.array(value)], ["key", "count", "value"])


def _arrays(n: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return bitmix.unpacked_keys(keys, n), bitmix.unpacked(counts, n)


def _each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("n", "keys", "counts"))):
            yield _arrays(*row)


# ---------------------------------------------------------------- the model


def _sums(shards: DataFrame, fold: Callable) -> DataFrame:
    """Sums by (``order``, ``key``) of what ``fold(keys, counts)`` gives for each shard: (order, keys, numbers)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _each_shard(batches):
            for order, values, n in fold(keys, counts):
                some, at = np.unique(values, return_inverse=True)
                total = np.bincount(at, n, len(some)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), order, np.int32)), pa.array(some.view(np.int64)), pa.array(total)], ["order", "key", "count"])
        release_memory()

    return shards.mapInArrow(each, "order int, key long, count long").groupBy("order", "key").agg(F.sum("count").alias("count"))


def deal_of(shards: DataFrame, share: float = bitmix.HEAVY_SHARE) -> bitmix.Deal:
    """The heavy contexts, from two bytes on; longer ones only inside heavy shorter ones. At most 1 / ``share`` of each length."""
    n = shards.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy: dict[int, np.ndarray] = {}
    for order in range(bitmix.LOW + 1, bitmix.MOST):
        so_far = bitmix.Deal(dict(heavy))

        def fold(keys, counts, order=order, so_far=so_far):
            return [(order, bitmix.context(keys[so_far.depth(keys) == order], order), None)]

        got = _sums(shards, fold).filter(F.col("count") > n * share).select("key").toArrow()
        heavy[order] = np.sort(got["key"].to_numpy().astype(np.uint64))
        if not len(heavy[order]):
            break
    return bitmix.Deal(heavy)


def dealt(parts: DataFrame, deal: bitmix.Deal, shards: int) -> DataFrame:
    """Windows in shards of ``deal``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _each_shard(batches):
            yield split(keys, counts, deal.place(keys), shards)
        release_memory()

    return gathered(parts.mapInArrow(send, SHARDS), packed_shard, SHARDS)


def shared_counts(shards: DataFrame, deal: bitmix.Deal) -> bitmix.Shared:
    """Counts after contexts of the lowest order and after heavy ones, over all windows."""

    def fold(keys, counts):
        depth = deal.depth(keys)
        for order in range(1, bitmix.MOST):
            far = depth > order
            if far.any():
                yield order, bitmix.suffix(keys[far], order), counts[far]

    got = _sums(shards, fold).toArrow().sort_by([("order", "ascending"), ("key", "ascending")])
    order, key, count = (got[c].to_numpy() for c in ("order", "key", "count"))
    rows = {k: (key[order == k].astype(np.uint64), count[order == k]) for k in range(1, bitmix.MOST)}
    return bitmix.Shared(deal, rows)


def mixer_of(shards: DataFrame, known: Broadcast) -> bitmix.Mixer:
    """The mixer learned online from all windows, shard by shard, and merged by sums."""

    def learn(key, table):
        mixer = bitmix.Mixer()
        for keys, counts in _each_shard(table.to_batches()):
            for _, block in bitmix.blocks(keys, counts, known.value):
                block.learn(mixer)
                del block
            release_memory()
        flat = np.concatenate([[mixer.bytes], (mixer.weights * mixer.bytes).ravel(), mixer.seen.ravel()])
        some = np.flatnonzero(flat)
        return pa.table({"cell": pa.array(some, pa.int64()), "value": pa.array(flat[some], pa.float64())})

    cells = shards.groupBy("shard").applyInArrow(learn, "cell long, value double")
    blank = bitmix.Mixer()
    flat = np.zeros(1 + blank.weights.size + blank.seen.size)
    exact = F.sum(F.col("value").cast("decimal(28,6)")).cast("double")
    for r in cells.groupBy("cell").agg(exact.alias("value")).collect():  # as many rows as a mixer has numbers
        flat[r["cell"]] = r["value"]
    if not flat[0]:
        return blank
    weights, seen = np.split(flat[1:], [blank.weights.size])
    return bitmix.Mixer(weights=(weights / flat[0]).reshape(blank.weights.shape), seen=seen.reshape(blank.seen.shape), bytes=int(flat[0]))


def window_scores(shards: DataFrame, known: Broadcast, mixer: bitmix.Mixer) -> DataFrame:
    """(``key``, ``count``, ``value``): each window's log10 probability, in parts of ``SCORE_UNIT``."""
    scorer = bitmix.Scorer(mixer)

    def score(key, table):
        out = []
        for keys, counts in _each_shard(table.to_batches()):
            value = np.zeros(len(keys))
            for at, block in bitmix.blocks(keys, counts, known.value):
                value[at] = block.log10_probabilities(scorer)
            out.append(_rows(keys, counts, np.rint(value * SCORE_UNIT).astype(np.int64)))
            release_memory()
        return pa.Table.from_batches(out)

    return shards.groupBy("shard").applyInArrow(score, VALUES)


# ---------------------------------------------------------------- documents


def added(docs: DataFrame, words: Broadcast, windows: Broadcast) -> DataFrame:
    """Per row of ``docs``: sums over what the tables hold, and the keys of all else."""
    names = ["n_tokens", "n_bytes", "known", "base", "score", "rest_words", "rest_windows"]

    def sums(keys: np.ndarray, size: np.ndarray, table: Lookup) -> list[np.ndarray]:
        found, known, value = table.find(keys)
        at = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(size)), size)[~found]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(size)))]).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[~found].view(np.int64)))
        return [np.add.reduceat(known.astype(np.int64), at), np.add.reduceat(value, at), rest]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            for a, b in hashing.slices(text, STRETCH):
                part = text.slice(a, b - a)
                keys, n = word_keys(part)
                known, base, rest_words = sums(keys, n, words.value)
                keys, size = bitmix.windows(part)
                _, score, rest_windows = sums(keys, size, windows.value)
                numbers = [n, np.diff(hashing.text_bytes(part)[1]), known, base, score]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(a, b - a) for c in batch.columns[:-1]], *map(pa.array, numbers), rest_words, rest_windows], [*batch.schema.names[:-1], *names]
                )
        release_memory()

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    kinds = ["long"] * 5 + ["array<long>"] * 2
    return docs.mapInArrow(add, head + ", " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _rest(parts: DataFrame, column: str, rows: DataFrame, name: str) -> DataFrame:
    """Per ``_row``: sums over the keys in ``column`` that the broadcast table did not hold."""
    return parts.select("_row", F.explode(column).alias("key")).join(rows, "key").groupBy("_row").agg(
        F.count_if(F.col("count") > 0).alias(f"_{name}_known"), F.sum("value").alias(f"_{name}")
    )


def scored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``."""
    spark = docs.sparkSession
    ship_package(spark)
    df = take(docs, _id=doc_id, _text=text)
    df = df.select("_id", held_out("_id").alias("_held"), F.col("_text").cast("string").alias("_text"))
    size = df.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = size // BYTES_PER_SHARD + 1
    learned = df.select((~F.col("_held")).alias("_learn"), "_text")

    words = written(counted(learned, word_keys, shards, word_rows, VALUES), "words")
    facts = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count_if(F.col("count") > 0).alias("v")).first()

    table = written(counted(learned, bitmix.windows, shards, packed_shard, SHARDS), "windows")
    deal = deal_of(table)
    known = spark.sparkContext.broadcast(shared_counts(table, deal))
    table = written(dealt(table, deal, shards), "dealt-windows")
    windows = written(window_scores(table, known, mixer_of(table, known)), "window-scores")

    top = [spark.sparkContext.broadcast(frequent(rows, most)) for rows, most in ((words, TOP_WORDS), (windows, TOP_WINDOWS))]
    parts = written(added(df.select(F.monotonically_increasing_id().alias("_row"), "_id", "_held", "_text"), *top), "parts")
    rests = _rest(parts, "rest_words", words, "base").join(_rest(parts, "rest_windows", windows, "score"), "_row", "full")
    out = parts.drop("rest_words", "rest_windows").join(rests, "_row", "left").fillna(0, ["_base", "_base_known", "_score"])
    base = (F.col("base") + F.col("_base")) / F.lit(float(BASE_UNIT)) - F.col("n_tokens") * float(np.log10(facts["n"] + facts["v"] + 1))
    score = (F.col("score") + F.col("_score")) / F.lit(float(SCORE_UNIT))
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("_base_known")).alias("n_known"),
        F.lit(facts["n"]).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
        (-score * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of query op10."""
    return scored(docs)
