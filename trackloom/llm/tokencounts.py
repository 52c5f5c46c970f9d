"""Delta-maintained token counts by source, language and tokenizer version.

A batch of events becomes signed deltas (documents, tokens) summed per key and is
committed under its batch id. Totals are maintained: every ``FOLD_EVERY`` batches the deltas
since the last snapshot are added to it and the sums committed as the next one, so totals
are read from one snapshot and fewer than ``FOLD_EVERY`` batches, however long the ledger is.

Idempotence: a batch's rows are written to a folder of a name of its own and entered in a numbered
log; what decides is a small file named after the batch id, created only if it is not there. Of
two drivers that bring one batch, one creates the file and the other's entry counts for
nothing, as does the folder of a job that was cut off. A snapshot bears the number of the last log
entry that it holds. So a commit looks at its own batch's file and at the entries since the last
snapshot, not at the batches before; ``vacuum`` deletes the rows and entries that snapshots have taken
over, and only the small files named after batches stay.

Events have ``doc_id, source, lang, version, op, n_tokens, old_tokens, n_docs``: ``insert`` adds the
document, ``delete`` takes it away with ``n_tokens`` as counted before, ``revise`` changes
its count from ``old_tokens`` to ``n_tokens``; ``n_docs`` (one where it is null or absent) says how many
documents an event stands for, with their tokens summed. Defined results: null counts are 0, an
unknown or null ``op`` changes nothing, null sources, languages and versions are keys of
their own, repeated events count each time (one event, one row), an empty batch commits
no rows. Extra columns are ignored. ``digest`` deletes copies by id: rows that repeat an id and its
text are one document more each, and stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import shared_dir, take
from trackloom.llm.tokens import WordTokenizer, default_path
from trackloom.session import ship_package

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"
#: Batches since the last snapshot from which on a commit makes the next one.
FOLD_EVERY = 16


def deltas(events: DataFrame) -> DataFrame:
    """Signed deltas of a batch per key."""
    df = take(
        events, source="source", lang="lang", tokenizer_version="version", _op="op", _new="n_tokens", _old="old_tokens", _docs="n_docs"
    )
    docs = F.coalesce(F.col("_docs").cast("long"), F.lit(1))
    new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("_new", "_old"))
    by_op = lambda i, d, r: F.when(F.col("_op") == "insert", i).when(F.col("_op") == "delete", d).when(F.col("_op") == "revise", r).otherwise(0)
    return (
        df.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS])
        .agg(
            F.sum(by_op(docs, -docs, F.lit(0)).cast("long")).alias("d_docs"),
            F.sum(by_op(new, -new, new - old).cast("long")).alias("d_tokens"),
        )
        .filter("d_docs != 0 or d_tokens != 0")
    )


class TokenLedger:
    """Committed batches of deltas and snapshots under one folder (any file system that Spark writes).

    ``data`` holds folders of rows, ``log`` a numbered file per entry (batch id and folder), ``commits`` a file
    per batch (the folder that counts), ``snapshots`` a file per snapshot under the number of its last entry.
    """

    def __init__(self, spark: SparkSession, root: str, fold_every: int = FOLD_EVERY):
        self.spark, self.root, self.fold_every = spark, root.rstrip("/"), fold_every

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _lines(self, path: str) -> list[str]:
        """Lines of a commit file; none where it is absent or its writer was cut off."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return text.split("\n")[:-1] if text.endswith("\n.\n") else []

    def _claim(self, path: str, lines: list[str]) -> bool:
        """Create a commit file; False if another one was first. Half-written files are replaced."""
        fs, p = self._fs(path)
        if fs.exists(p) and not self._lines(path):
            fs.delete(p, False)
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as error:
            if not fs.exists(p):
                raise error
            return False
        stream.write(("\n".join([*lines, "."]) + "\n").encode())
        stream.close()
        return True

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _written(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{name}")
        return name

    def _drop(self, name: str) -> None:
        fs, p = self._fs(f"data/{name}")
        fs.delete(p, True)

    def batches(self) -> list[str]:
        """Ids of all committed batches, for reports; an id is a plain name such as ``2024-05-01T00``."""
        return [n for n in self._names("commits") if self._lines(f"commits/{n}")]

    def _snapshot(self) -> tuple[int, str | None]:
        """(number of the last log entry that the last snapshot holds, the snapshot's folder)."""
        for name in reversed(self._names("snapshots")):
            if lines := self._lines(f"snapshots/{name}"):
                return int(name), lines[0]
        return 0, None

    def _entries(self, after: int) -> list[tuple[int, str, str]]:
        """(number, batch id, folder) of the log from ``after`` on."""
        out = []
        while lines := self._lines(f"log/{after + 1:012d}"):
            after += 1
            out.append((after, *lines[:2]))
        return out

    def _counting(self, entries: list[tuple[int, str, str]]) -> list[str]:
        """Folders of the entries that count: what the batch's file names, or else the batch's first entry."""
        out, seen = [], set()
        for _, batch, name in entries:
            decided = self._lines(f"commits/{batch}")
            if decided[:1] == [name] or (not decided and batch not in seen):
                out.append(name)
            seen.add(batch)
        return out

    def committed(self, batch_id: str) -> bool:
        return bool(self._lines(f"commits/{batch_id}")) or any(b == batch_id for _, b, _ in self._entries(self._snapshot()[0]))

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        if not batch_id or "/" in batch_id or batch_id[0] in "._":
            raise ValueError(f"not a plain batch id: {batch_id!r}")
        if self.committed(batch_id):
            return False
        name = self._written(deltas(events))
        number = self._snapshot()[0]
        while True:
            number = max([number, *(n for n, _, _ in self._entries(number))]) + 1
            if self._claim(f"log/{number:012d}", [batch_id, name]):
                break
        if not self._claim(f"commits/{batch_id}", [name]) and self._lines(f"commits/{batch_id}")[:1] != [name]:
            self._drop(name)
            return False
        if number - self._snapshot()[0] >= self.fold_every:
            self.fold()
        return True

    def _sums(self, names: list[str]) -> DataFrame:
        """Deltas of a snapshot and later batches, added up per key."""
        if not names:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.root}/data/{n}" for n in names])
        return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    def fold(self) -> bool:
        """Add the deltas since the last snapshot to it; False if there are none or another driver did."""
        number, held = self._snapshot()
        entries = self._entries(number)
        if not entries:
            return False
        for _, batch, name in entries:  # a writer that was cut off before it decided: its first entry counts for good
            self._claim(f"commits/{batch}", [name])
        later = self._counting(entries)
        name = self._written(self._sums([*([held] if held else []), *later]).filter("d_docs != 0 or d_tokens != 0"))
        if not self._claim(f"snapshots/{entries[-1][0]:012d}", [name]):
            self._drop(name)
            return False
        return True

    def vacuum(self) -> int:
        """Delete rows, log entries and snapshots that the last snapshot but one has taken over; number of folders that went."""
        kept = [n for n in self._names("snapshots") if self._lines(f"snapshots/{n}")][-2:]
        if len(kept) < 2:
            return 0
        gone = 0
        for folder, last in (("log", kept[0]), ("snapshots", kept[0])):
            for n in self._names(folder):
                if n > last or n in kept and folder == "snapshots":
                    continue
                lines = self._lines(f"{folder}/{n}")
                if lines:
                    self._drop(lines[-2])  # the last line is a mark
                    gone += 1
                fs, p = self._fs(f"{folder}/{n}")
                fs.delete(p, False)
        return gone

    def totals(self) -> DataFrame:
        """Current documents and tokens per key; keys whose documents are all gone drop out."""
        number, held = self._snapshot()
        sums = self._sums([*([held] if held else []), *self._counting(self._entries(number))])
        return sums.select(*KEYS, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens")).filter("n_docs != 0 or n_tokens != 0")


def with_counts(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` and ``n_tokens``: the tokenizer's exact count of the whole text (null: 0).

    The column ``text`` itself is not passed on.
    """
    ship_package(docs.sparkSession)
    path = path or default_path()
    names = [c for c in docs.columns if c != text]
    src = docs.select(text, *names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.load(path)
        for batch in batches:
            counts: list[int] = []
            for at in range(0, batch.num_rows, 512):
                counts += tokenizer.counts(batch.column(0).slice(at, 512).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], [*batch.schema.names[1:], "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(count, f"{fields}, n_tokens long")


def estimate(text: Column) -> Column:
    """The count given at ingestion, before the tokenizer has run: four bytes a token."""
    return F.ceil(F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) / 4).cast("long")


def copies(counted: DataFrame) -> DataFrame:
    """Delete events of all documents but those of the least id among equal texts (``_h1, _h2``).

    Texts are counted per id, then per source and language, before they meet by text, so a text that
    very many documents share is a few rows where it meets.
    """
    text, key = ["_h1", "_h2"], ["source", "lang", "version"]
    per_id = counted.groupBy(*text, *key, "doc_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_tokens").alias("_t"))
    least = F.min(F.struct(F.col("doc_id").cast("string").isNull().alias("null_id"), "doc_id", F.col("_n").alias("n"), F.col("_t").alias("t")))
    per_key = per_id.groupBy(*text, *key).agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"), least.alias("_least"))
    first = per_key.groupBy(*text).agg(F.min(F.struct("_least.null_id", "_least.doc_id")).alias("_first"))
    stays = F.col("_least.doc_id").eqNullSafe(F.col("_first.doc_id"))
    gone = lambda n, least: F.col(n) - F.when(stays, F.col(f"_least.{least}")).otherwise(0)
    out = per_key.join(first, text).select(*key, F.lit("delete").alias("op"), gone("_n", "n").alias("n_docs"), gone("_t", "t").alias("n_tokens"))
    return out.filter("n_docs > 0")


def digest(docs: DataFrame, version: str = "word_bpe_49k") -> DataFrame:
    """Query op1: a life of the corpus in three batches, one of them delivered twice.

    ``load`` inserts every document with its estimated count, ``exact`` revises every count
    to the tokenizer's, ``copies`` deletes every document whose text another one of lower
    id has (null texts are copies of each other).
    """
    spark = docs.sparkSession
    ledger = TokenLedger(spark, shared_dir(spark, "token-ledger"))
    df = take(docs, doc_id="doc_id", source="source", lang="lang", text="text")
    df = df.withColumns({"version": F.lit(version), "old_tokens": estimate(F.col("text"))})
    load = df.select("doc_id", "source", "lang", "version", F.lit("insert").alias("op"), F.col("old_tokens").alias("n_tokens"), F.lit(0).alias("old_tokens"))
    ledger.commit("load", load)
    body = F.coalesce(F.col("text").cast("string"), F.lit("\x00"))
    counted = with_counts(df.withColumns({"_h1": F.xxhash64(body), "_h2": F.xxhash64(F.lit(7), body)}))
    path = shared_dir(spark, "token-counts")
    counted.write.parquet(path)
    counted = spark.read.parquet(path)
    revise = counted.withColumn("op", F.lit("revise"))
    ledger.commit("exact", revise)
    ledger.commit("copies", copies(counted))
    ledger.commit("exact", revise)  # delivered again: no effect
    return ledger.totals()
