"""Alignment of two tokenizers' ids over whole documents, in Arrow tables.

A text with one space before it is encoded by a byte-level BPE (A) and by a piece model with
byte fallback (B). Byte offsets where tokens of both end cut a document into groups; a link is
a pair of an A and a B token of one group. Links are counted by the documents that hold them.

Steps: (1) per stretch of documents, the lists of ids are flattened with their parent indices,
byte lengths are summed up segment by segment to token ends, an Acero hash join on (document,
end) finds the ends of both, a second one on the group gives the links, and ``Table.group_by``
the distinct pairs of each document; (2) ``Table.group_by`` counts pairs in each task and Spark
adds these partial counts; (3) documents add up the counts of their links: frequent pairs from
a broadcast table of at most ``TOP_PAIRS`` pairs, all others by a shuffle join. An A id's
highest count is one row per id, at most the vocabulary.

Encoding goes by units, stretches that begin with a space or line end after a character that is
no white space. Neither tokenizer has a token over such a place, so a text's ids are its
units' ids in order, and units that recur are encoded once in a worker.

Defined results: null and empty texts, and texts whose tokens of A or B do not give back the
text with its space, have no tokens: all numbers 0 and an empty string for the hash. Repeated
rows are documents of their own. Null ids pass through, an empty table gives no rows, extra
columns are ignored. Special tokens inside a text are plain text.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import hashing
from trackloom.llm.common import release_memory, take, written
from trackloom.llm.lookup import Lookup, frequent
from trackloom.llm.tokens import default_path
from trackloom.session import ship_package

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOP_PAIRS = 2_000_000
#: Bytes of text that are aligned at once.
STRETCH = 1 << 20
CACHE_UNITS = 1_000_000
#: Distinct pairs that a task holds before it sends its partial counts.
PAIRS_IN_HAND = 2_000_000
SHIFT = 1 << 16  # a pair is A's id times this, plus B's id
#: From a space or line end to the next one that follows no white space.
UNIT = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
ANY_SPACE = re.compile(r"\s")
OTHER_SPACE = re.compile(r"[^\S \n]")
PLAIN = re.compile(r"[\n -~\xa1-ɏ]*")


class Tokenizers:
    """Both tokenizers with a cache of units.

    A unit is known by its text without the one space that it begins with; ``odd`` texts
    hold other white space, and what holds them is cut by the pattern ``UNIT``.
    """

    _loaded: dict[tuple[str, str], "Tokenizers"] = {}

    def __init__(self, bytes_path: str, pieces_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._a = Tokenizer.from_file(bytes_path)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_file=pieces_path)
        self.bytes_a = self._bytes_of_a()
        self.bytes_b = [self._bytes_of_b(self._b.id_to_piece(i)) for i in range(self._b.get_piece_size())]
        self.sizes_a, self.sizes_b = (pa.array([len(x) for x in t], pa.int64()) for t in (self.bytes_a, self.bytes_b))
        self._fast = self._ranks()
        self._before = len(self._b.encode("x"))
        self._clear()

    @classmethod
    def load(cls, bytes_path: str | None = None, pieces_path: str | None = None) -> "Tokenizers":
        key = bytes_path or default_path(BYTE_BPE), pieces_path or default_path(PIECES)
        if key not in cls._loaded:
            cls._loaded[key] = cls(*key)
        return cls._loaded[key]

    def _clear(self) -> None:
        #: By text of a unit without its space: ids of A and of B as bytes, None where they must be asked of ``_runs``.
        self._ids: tuple[dict[str, bytes | None], dict[str, bytes | None]] = {}, {}
        #: By whole text of a unit with other white space; None where it does not come back from its tokens.
        self._runs: dict[str, tuple[bytes, bytes] | None] = {}

    def _bytes_of_a(self) -> list[bytes]:
        """Bytes of each id of A: printable bytes stand for themselves, all others for 256 and on, in order."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
        out = []
        for i in range(self._a.get_vocab_size()):
            token = self._a.id_to_token(i) or ""
            out.append(bytes(byte_of.get(c, 0) for c in token) if token else b"")
        return out

    @staticmethod
    def _bytes_of_b(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _ranks(self):
        """The same vocabulary with a faster loop, for texts of ASCII and Latin letters."""
        import public_tokenizers
        import tiktoken

        special = set(self._a.get_added_tokens_decoder())
        ranks = {t: i for i, t in enumerate(self.bytes_a) if t and i not in special}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _a_ids(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text):
            return self._fast.encode_ordinary(text)
        return self._a.encode(text, add_special_tokens=False).ids

    def _b_ids(self, text: str) -> list[int]:
        """Ids of a stretch of a text: B puts a space before the word that is cut off again."""
        return self._b.encode("x" + text, num_threads=1)[self._before :]

    def _learn(self, units: list[str], keys: list[str]) -> None:
        """Cache the ids of ``units``, many to a call: the ends of units are ends of tokens."""
        for at in range(0, len(units), 1000):
            part = units[at : at + 1000]
            text = "".join(part)
            raw = text.encode()
            stops = np.cumsum(list(map(len, part)) if len(raw) == len(text) else [len(u.encode()) for u in part])
            sides = (self._a_ids(text), self.bytes_a, self.sizes_a), (self._b_ids(text), self.bytes_b, self.sizes_b)
            if len(part) > 1 and any(b"".join(map(tokens.__getitem__, ids)) != raw for ids, tokens, _ in sides):
                for unit, key in zip(part, keys[at : at + 1000]):
                    self._learn_one(unit, key)
                continue
            for (ids, _, sizes), known in zip(sides, self._ids):
                packed = array("I", ids).tobytes()
                ends_ = np.cumsum(sizes.to_numpy()[ids])
                cuts = np.concatenate([[0], 4 * np.searchsorted(ends_, stops) + 4]).tolist()
                known.update(zip(keys[at : at + 1000], map(packed.__getitem__, map(slice, cuts, cuts[1:]))))

    def _both(self, unit: str) -> tuple[bytes, bytes] | None:
        a, b, raw = self._a_ids(unit), self._b_ids(unit), unit.encode()
        if b"".join(self.bytes_a[i] for i in a) != raw or b"".join(self.bytes_b[i] for i in b) != raw:
            return None
        return array("I", a).tobytes(), array("I", b).tobytes()

    def _learn_one(self, unit: str, key: str) -> None:
        got = self._runs[unit] = self._both(unit)
        for known, ids in zip(self._ids, got or (None, None)):
            known[key] = ids

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Little-endian 32-bit ids of each text by A and by B; none where the text does not come back."""
        if len(self._ids[0]) + len(self._runs) > CACHE_UNITS:
            self._clear()
        split = [(t or "").replace("\n", " \n").split(" ") for t in texts]
        a, b = self._ids
        new = set().union(*split).difference(a)
        odd = {p for p in new if not p or p == "\n" or OTHER_SPACE.search(p)}
        a.update(dict.fromkeys(odd))
        new = list(new - odd)
        self._learn([p if p[0] == "\n" else " " + p for p in new], new)
        out_a, out_b = [], []
        for text, parts in zip(texts, split):
            try:
                ids = b"".join(map(a.__getitem__, parts)), b"".join(map(b.__getitem__, parts))
            except TypeError:  # stretches of white space, or a unit that does not come back
                ids = self._by_runs(text) if text else (b"", b"")
            out_a.append(ids[0])
            out_b.append(ids[1])
        return out_a, out_b

    def _by_runs(self, text: str) -> tuple[bytes, bytes]:
        out = []
        for unit in UNIT.findall(" " + text):
            key = unit if unit[0] == "\n" else unit[1:]
            if unit[1:] and not ANY_SPACE.search(unit, 1) and self._ids[0][key] is not None:
                out.append((self._ids[0][key], self._ids[1][key]))
                continue
            if unit not in self._runs:
                self._runs[unit] = self._both(unit)
            if self._runs[unit] is None:
                return b"", b""
            out.append(self._runs[unit])
        return b"".join(x[0] for x in out), b"".join(x[1] for x in out)


# ---------------------------------------------------------------- one stretch of documents


def lists(ids: list[bytes]) -> pa.ListArray:
    """Ids of each document as one Arrow list."""
    cuts = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))


def ends(ids: pa.ListArray, sizes: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(id, document, end in bytes inside the document) of each token."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(pc.take(sizes, flat))
    before = np.concatenate([[0], total.to_numpy(zero_copy_only=False)])[ids.offsets.to_numpy()[:-1]]
    return flat, doc, pc.subtract(total, pc.take(pa.array(before), doc))


def keyed(doc: pa.Array, end: pa.Array, name: str) -> pa.Table:
    """Tokens by document and end, which share one 64-bit key."""
    key = pc.bit_wise_or(pc.shift_left(doc.cast(pa.int64()), pa.scalar(40, pa.int64())), end)
    return pa.table({"key": key, name: pa.array(np.arange(len(key)))})


def groups_of(n: int, last: np.ndarray) -> np.ndarray:
    """Group number of each of ``n`` tokens, where those at ``last`` end a group."""
    closes = np.zeros(n, np.int64)
    closes[last] = 1
    return np.cumsum(closes) - closes


def joined(ids: pa.Array, group: np.ndarray, n: int) -> pa.Array:
    """The decimal ids of each of ``n`` groups with commas between."""
    cuts = np.searchsorted(group, np.arange(n + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), ids.cast(pa.string())), ",")


def aligned(ids_a: pa.ListArray, ids_b: pa.ListArray, sizes_a: pa.Array, sizes_b: pa.Array) -> dict[str, pa.Array]:
    """Per document: numbers of tokens, groups and links, distinct pairs with how often each is linked, and groups as text."""
    n = len(ids_a)
    a, doc_a, end_a = ends(ids_a, sizes_a)
    b, doc_b, end_b = ends(ids_b, sizes_b)
    both = keyed(doc_a, end_a, "a").join(keyed(doc_b, end_b, "b"), "key", join_type="inner", use_threads=False)
    last = np.sort(both["a"].to_numpy())
    group_a, group_b = groups_of(len(a), last), groups_of(len(b), both["b"].to_numpy())
    doc = doc_a.to_numpy()[last].astype(np.int64)  # of each group
    left = pa.table({"group": pa.array(group_a), "a": pc.multiply(a, SHIFT)})
    links = left.join(pa.table({"group": pa.array(group_b), "b": b}), "group", join_type="inner", use_threads=False)
    of = pc.take(pa.array(doc << 32), links["group"])
    key = pc.add(pc.add(of, links["a"]), links["b"])
    pairs = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")]).sort_by("key")
    key, times = pairs["key"].to_numpy(), pairs["count_all"].to_numpy()
    cuts = np.searchsorted(key >> 32, np.arange(n + 1)).astype(np.int32)
    some = np.cumsum(np.concatenate([[0], times]))
    text = pc.binary_join_element_wise(joined(a, group_a, len(doc)), joined(b, group_b, len(doc)), "|")
    at = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return {
        "n_a": pc.list_value_length(ids_a).cast(pa.int64()),
        "n_b": pc.list_value_length(ids_b).cast(pa.int64()),
        "n_groups": pa.array(np.diff(at).astype(np.int64)),
        "n_links": pa.array(np.diff(some[cuts])),
        "groups": pc.binary_join(pa.ListArray.from_arrays(pa.array(at), text), ";"),
        "pairs": pa.ListArray.from_arrays(pa.array(cuts), pa.array((key & 0xFFFFFFFF).astype(np.int32))),
        "times": pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32))),
    }


# ---------------------------------------------------------------- Spark

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def alignments(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", paths: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and the
    distinct linked ``pairs`` (A's id times 2**16, plus B's id) with the ``times`` of each."""
    ship_package(docs.sparkSession)
    df = take(docs, _id=doc_id, _text=text).withColumn("_text", F.col("_text").cast("string"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers.load(*paths)
        for batch in batches:
            for x, y in hashing.slices(batch.column(1), STRETCH):
                a, b = tokenizers.encode(batch.column(1).slice(x, y - x).to_pylist())
                got = aligned(lists(a), lists(b), tokenizers.sizes_a, tokenizers.sizes_b)
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"].to_pylist()]
                columns = [batch.column(0).slice(x, y - x), *(got[c] for c in NUMBERS), pa.array(digest, pa.string()), got["pairs"], got["times"]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *NUMBERS, "groups_sha256", "pairs", "times"])
            release_memory()

    kind = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(align, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups_sha256 string, pairs array<int>, times array<int>")


def pair_counts(parts: DataFrame) -> DataFrame:
    """(``key``, ``count``, ``best``): how many rows of ``parts`` hold each pair, and whether no pair of its A id has more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def total() -> pa.Table:
            return pa.concat_tables(held).group_by("key", use_threads=False).aggregate([("count", "sum")]).rename_columns(["key", "count"])

        for batch in batches:
            key = pc.list_flatten(batch.column(0)).cast(pa.int64())
            held.append(pa.table({"key": key, "count": pa.array(np.ones(len(key), np.int64))}))
            rows += len(key)
            if rows > 2 * PAIRS_IN_HAND:
                held = [total()]
                rows = len(held[0])
                if rows > PAIRS_IN_HAND:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held, rows = [], 0
        if held:
            yield from total().to_batches(max_chunksize=100_000)
        release_memory()

    counts = parts.select("pairs").mapInArrow(partial, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
    counts = written(counts, "pair-counts")
    a = F.floor(F.col("key") / SHIFT)
    most = counts.groupBy(a.alias("_a")).agg(F.max("count").alias("_most"))  # at most A's vocabulary
    rated = counts.join(F.broadcast(most), a == F.col("_a"))
    return rated.select("key", "count", (F.col("count") == F.col("_most")).alias("best"))


def added(parts: DataFrame, top: Broadcast) -> DataFrame:
    """Per row of ``parts``: sums over the pairs that the table holds, and all other pairs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Lookup = top.value
        for batch in batches:
            pairs, times = (batch.column(batch.num_columns - k) for k in (2, 1))
            n = batch.num_rows
            doc = pc.list_parent_indices(pairs).to_numpy()
            key, often = pc.list_flatten(pairs).to_numpy().astype(np.int64), pc.list_flatten(times).to_numpy().astype(np.int64)
            found, best, count = table.find(key.view(np.uint64))
            total, good = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, doc, often * count)
            np.add.at(good, doc, often * best)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(doc[~found], minlength=n))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[~found])) for x in (key, often)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(good), pa.array(total), *rest], [*batch.schema.names[:-2], "_best", "_sum", "_keys", "_times"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields[:-2])
    return parts.mapInArrow(add, head + ", _best long, _sum long, _keys array<long>, _times array<long>")


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", paths: tuple[str | None, str | None] = (None, None), most: int = TOP_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row."""
    spark = docs.sparkSession
    parts = written(alignments(docs, text, doc_id, paths), "alignments")
    counts = pair_counts(parts)
    table = counts.select("key", "count", F.col("count").alias("value"), F.col("best").cast("byte").alias("flag"))
    top = spark.sparkContext.broadcast(frequent(table, most, "flag"))
    row = F.monotonically_increasing_id().alias("_row")
    sums = added(parts.select(row, "doc_id", *NUMBERS, "groups_sha256", "pairs", "times"), top)
    sums = written(sums, "alignment-sums")
    rest = sums.filter(F.size("_keys") > 0).select("_row", F.explode(F.arrays_zip("_keys", "_times")).alias("_p"))
    rest = rest.select("_row", F.col("_p._keys").alias("key"), F.col("_p._times").alias("_n")).join(counts, "key")
    rest = rest.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("_n")).otherwise(0)).alias("_best_rest"), F.sum(F.col("_n") * F.col("count")).alias("_sum_rest")
    )
    out = sums.join(rest, "_row", "left").fillna(0, ["_best_rest", "_sum_rest"])
    return out.select(
        "doc_id", *NUMBERS, (F.col("_best") + F.col("_best_rest")).alias("n_best"), (F.col("_sum") + F.col("_sum_rest")).alias("count_sum"), "groups_sha256"
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of query op13."""
    return counted(docs)
