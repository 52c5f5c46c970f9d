"""Structure repair of conversations by a square-root checkpointed dynamic program.

A conversation's rows go by turn. Edits keep a row, give it the role that is due, delete it, or insert
an empty turn, so that the initials of the roles read ``(s?(ua)+)?`` at least cost; of all cheapest
lists of edits the least in ASCII is taken.

A conversation of n rows is cut into blocks of about sqrt(n) rows (at least ``LEAST_BLOCK``).
(1) Each block gives the costs from each state before it to each state after it; (2) from the
last block to the first these give the vector of costs still to come at each block's end, the
checkpoints, and nothing else of the backward pass is stored; (3) each block recomputes its
vectors from its checkpoint and walks forward from each state that it may begin in; (4) the
blocks' ends are chained from the first one on, which picks one walk of each block. Steps 1
and 3 run on all blocks side by side, steps 2 and 4 hold some numbers of each block of one
conversation, so a conversation may be longer than what one task could hold.

Rows get their places by one range sort without their texts, and a place's number inside a
conversation from counts per (conversation, partition). What repairs the texts is a stream: rows
of a conversation in order, with the edits of a block right before its first row.

Defined results: nulls of role and text are one space; a null ``conv_id`` is a conversation of its
own; null turns come first; rows of equal turn go by the MD5 of role and text; a role counts by
its first character, and other than s, u, a it cannot stay; of equal rows all but the first are
duplicates; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trackloom.llm.common import take, written
from trackloom.session import ship_package

LEAST_BLOCK = 64
BLANK = r"\A[\x20\x09-\x0D]*\z"
ENDS_WELL = r"[.!?][\x20\x09-\x0D]*\z"
#: A row's code: its fault picks the word, its role (s, u, a or another) the letter.
CODES = {"none": "suax", "truncated": "SUAX", "blank": "1234", "duplicate": "5678"}
ROLE = {c: "suax"[k] for word in CODES.values() for k, c in enumerate(word)}
FAULT = {c: fault for fault, word in CODES.items() for c in word}
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant.
AFTER_ROLE = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after the turn that is due, which an inserted or reroled turn is.
AFTER_DUE = (2, 2, 3, 2)
DUE = ("user", "user", "assistant", "user")
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Costs still to come behind the last row: nothing is open, or what is inserted to close it.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
SALTS = 8

Costs = tuple[float, ...]


# ---------------------------------------------------------------- one row, one block


@lru_cache(maxsize=1 << 16)
def back(code: str, after: Costs) -> tuple[Costs, float]:
    """Costs before a row from those after it, as (costs above the least, the least)."""
    out = []
    for state in range(4):
        best = DELETE + after[state]
        if FAULT[code] in ("none", "truncated"):
            more = TRUNCATED if FAULT[code] == "truncated" else 0
            kept = AFTER_ROLE[state].get(ROLE[code])
            best = min(best, RETYPE + more + after[AFTER_DUE[state]], math.inf if kept is None else more + after[kept])
        out.append(best)
    user, assistant = min(out[2], INSERT + out[3]), min(out[3], INSERT + out[2])
    out = [min(out[0], INSERT + user), min(out[1], INSERT + user), user, assistant]
    least = min(out)
    return tuple(x - least for x in out), least


@lru_cache(maxsize=1 << 16)
def tight(code: str, state: int, after: Costs) -> tuple[str, int]:
    """(edits at a row, state behind it): of the tight ones the least in ASCII, D before I before K before R."""
    now, least = back(code, after)
    edits = ""
    while True:
        left = now[state] + least
        if left == DELETE + after[state]:
            return edits + "D", state
        if now[state] == INSERT + now[AFTER_DUE[state]]:
            edits, state = edits + "I", AFTER_DUE[state]
            continue
        more = TRUNCATED if FAULT[code] == "truncated" else 0
        kept = AFTER_ROLE[state].get(ROLE[code])
        if kept is not None and left == more + after[kept]:
            return edits + "K", kept
        return edits + "R", AFTER_DUE[state]


def through(codes: str) -> list[int]:
    """Costs of a block from each state before it (rows of four) to each state after it."""
    columns = []
    for goal in range(4):
        at, total = tuple(0.0 if s == goal else math.inf for s in range(4)), 0.0
        for code in reversed(codes):
            at, least = back(code, at)
            total += least
        columns.append([total + x for x in at])
    return [FAR if math.isinf(columns[g][s]) else int(columns[g][s]) for s in range(4) for g in range(4)]


def checkpoints(blocks: list[list[int]]) -> tuple[list[Costs], int]:
    """(costs above the least at each block's end, cost of all) from the blocks' ``through``."""
    at, total, out = tuple(map(float, END)), 0, []
    for costs in reversed(blocks):
        out.append(at)
        now = [min(costs[4 * s + g] + at[g] for g in range(4)) for s in range(4)]
        least = min(now)
        at, total = tuple(float(x - least) for x in now), total + int(least)
    return out[::-1], total + int(at[0])


def walks(codes: str, end: Costs, last: bool) -> tuple[list[int], list[str]]:
    """(state behind the block, edits) for each state before it; its vectors are made again from its end."""
    after = [end]
    for code in reversed(codes):
        after.append(back(code, after[-1])[0])
    after.pop()
    exits, edits = [], []
    for state in range(4):
        parts = []
        for code, costs in zip(codes, reversed(after)):
            part, state = tight(code, state, costs)
            parts.append(part)
        while last and state not in (0, 3):
            parts.append("I")
            state = AFTER_DUE[state]
        exits.append(state)
        edits.append("".join(parts))
    return exits, edits


# ---------------------------------------------------------------- Spark


def _row(df: DataFrame) -> DataFrame:
    """``_key`` (a string, never null), ``_conv``, ``_turn``, ``_role``, ``_text`` of each row."""
    df = take(df, _conv="conv_id", _turn="turn", _role="role", _text="text")
    key = F.coalesce(F.concat(F.lit("="), F.col("_conv").cast("string")), F.lit(""))
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("_role", "_text")}
    return df.select(key.alias("_key"), "_conv", "_turn", space["_role"].alias("_role"), space["_text"].alias("_text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the contract's damage, by CRC-32 of ``conv_id:turn`` modulo 20 (nulls: one space)."""
    rows = _row(conversations)
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("_conv", "_turn")]
    rows = rows.withColumn("_case", F.crc32(F.concat(words[0], F.lit(":"), words[1])) % 20).filter("_case != 0")
    text = F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    role = F.when(F.col("_case") == 4, "user").otherwise(F.col("_role"))
    copies = F.explode(F.when(F.col("_case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = rows.withColumn("_copy", copies)
    return rows.select(F.col("_conv").alias("conv_id"), F.col("_turn").alias("turn"), role.alias("role"), text.alias("text"))


def _marked(rows: DataFrame) -> DataFrame:
    """``_row`` with the hash of role and text."""
    return _row(rows).withColumn("_hash", F.md5(F.concat("_role", F.lit("\0"), "_text")))


def placed(rows: DataFrame) -> DataFrame:
    """Rows without texts, as written: ``_key, _turn, _hash, _role`` (s, u, a, x), ``_fault``, and their ``_place`` in order."""
    first = F.substring("_role", 1, 1)
    fault = F.when(F.col("_text").rlike(BLANK), "blank").when(~F.col("_text").rlike(ENDS_WELL), "truncated").otherwise("none")
    small = _marked(rows).select("_key", "_turn", "_hash", F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("_role"), fault.alias("_fault"))
    small = small.withColumn("_salt", F.monotonically_increasing_id() % 64)  # equal rows may go to several ranges
    order = ["_key", F.col("_turn").asc_nulls_first(), "_hash"]
    small = small.repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    return written(small.withColumn("_place", F.monotonically_increasing_id()).drop("_salt"), "turns")


def coded(rows: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """``placed`` rows with ``_code`` and the ``_block`` of their conversation."""
    rows = rows.withColumn("_part", F.shiftright("_place", 33))
    parts = rows.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_m"), F.min("_place").alias("_first"))
    by_part = Window.partitionBy("_key").orderBy("_part")  # one row for each partition that a conversation reaches into
    parts = parts.withColumn("_before", F.sum("_m").over(by_part) - F.col("_m")).withColumn("_n", F.sum("_m").over(Window.partitionBy("_key")))
    repeats = rows.groupBy("_key", "_hash").agg(F.min("_place").alias("_own"), F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    repeats = repeats.select("_key", "_hash", "_own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = rows.join(parts, ["_key", "_part"]).withColumn("_salt", (F.col("_place") % SALTS).cast("int"))
    rows = rows.join(repeats, ["_key", "_hash", "_salt"], "left")
    fault = F.when((F.col("_fault") != "blank") & (F.col("_place") > F.col("_own")), "duplicate").otherwise(F.col("_fault"))
    code = F.lit(None).cast("string")
    for name, word in CODES.items():
        code = F.when(fault == name, F.translate("_role", "suax", word)).otherwise(code)
    size = F.greatest(F.ceil(F.sqrt("_n")), F.lit(least_block))
    block = F.floor((F.col("_before") + F.col("_place") - F.col("_first")) / size)
    return rows.select("_key", block.cast("long").alias("_block"), "_place", "_turn", "_hash", code.alias("_code"))


def _mapped(df: DataFrame, f, names: list[str], schema: str) -> DataFrame:
    """``f`` of each row's ``names`` columns, a row of ``schema``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [f(*row) for row in zip(*(batch.column(n).to_pylist() for n in names))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(arrow.types)], arrow.names)

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    return df.mapInArrow(each, kind)


def _block_costs(key, block, codes, turn, digest):
    roles = [ROLE[c] for c in codes]
    counts = [sum(FAULT[c] == f for c in codes) for f in ("blank", "duplicate", "truncated")]
    return key, block, codes, turn, digest, through(codes), *counts, sum(a + b not in LEGAL for a, b in zip(roles, roles[1:])), roles[0] + roles[-1]


def _ends(key, blocks):
    at, cost = checkpoints([b["_through"] for b in blocks])
    illegal = sum(a["_edges"][1] + b["_edges"][0] not in LEGAL for a, b in zip(blocks, blocks[1:]))
    return key, cost, illegal, [int(x) for c in at for x in (min(v, FAR) for v in c)]


def _walked(key, block, codes, turn, digest, end, last):
    exits, edits = walks(codes, tuple(map(float, end)), last)
    return key, block, turn, digest, exits, edits


def _chained(key, blocks):
    state, out = 0, []
    for b in blocks:
        out.append(state)
        state = b["_exits"][state]
    return key, out


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    """Blocks of each conversation in order: about the square root of its rows."""
    return df.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_block", *columns))).alias("_blocks"))


def repairs(rows: DataFrame, least_block: int = LEAST_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(report of each conversation, edits of each block) of any table of conversations.

    Report: ``_key, blank, duplicate, truncated, illegal, cost, gaps``. Edits: ``_key, _block, _turn, _hash``
    of the block's first row, ``_edits``.
    """
    ship_package(rows.sparkSession)
    order = placed(rows)
    turn = order.schema["_turn"].dataType.simpleString()
    codes = coded(order, least_block).groupBy("_key", "_block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", "_code"))), lambda r: r["_code"]), "").alias("_codes"),
        F.min_by(F.struct("_turn", "_hash"), "_place").alias("_head"),
    )
    head = [F.col("_head._turn").cast("string").alias("_turn"), F.col("_head._hash").alias("_hash")]
    blocks = written(_mapped(
        codes.select("_key", "_block", "_codes", *head), _block_costs, ["_key", "_block", "_codes", "_turn", "_hash"],
        "_key string, _block long, _codes string, _turn string, _hash string, _through array<long>, blank long, duplicate long, truncated long, _illegal long, _edges string",
    ), "blocks")
    ends = written(_mapped(_listed(blocks, "_through", "_edges"), _ends, ["_key", "_blocks"], "_key string, cost long, _between long, _ends array<long>"), "ends")
    n = F.size("_ends") / 4
    each = ends.select("_key", n.cast("long").alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("_block"), "_ends")
    each = each.select("_key", "_block", (F.col("_block") + 1 == F.col("_n")).alias("_last"), F.slice("_ends", (4 * F.col("_block") + 1).cast("int"), F.lit(4)).alias("_end"))
    walked = written(_mapped(
        blocks.join(each, ["_key", "_block"]).select("_key", "_block", "_codes", "_turn", "_hash", "_end", "_last"), _walked,
        ["_key", "_block", "_codes", "_turn", "_hash", "_end", "_last"], "_key string, _block long, _turn string, _hash string, _exits array<long>, _walks array<string>",
    ), "walks")
    begun = _mapped(_listed(walked, "_exits"), _chained, ["_key", "_blocks"], "_key string, _states array<long>")
    begun = begun.select("_key", F.posexplode("_states").alias("_block", "_state")).withColumn("_block", F.col("_block").cast("long"))
    edits = walked.join(begun, ["_key", "_block"]).select(
        "_key", "_block", F.col("_turn").cast(turn).alias("_turn"), "_hash", F.col("_walks")[F.col("_state").cast("int")].alias("_edits")
    )
    turns = order.groupBy("_key", "_turn").agg(F.lit(1).alias("_one"))
    gaps = turns.groupBy("_key").agg((F.max("_turn").cast("long") - F.min("_turn").cast("long") + 1 - F.count("_turn")).alias("_gaps"))
    report = blocks.groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "_illegal")])
    report = report.join(ends.select("_key", "cost", "_between"), "_key").join(gaps, "_key")
    return report.select("_key", F.coalesce("_gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("_illegal") + F.col("_between")).alias("illegal"), "cost"), edits


STREAM = ("_key", "_flag", "_edits", "_role", "_text")
PART = re.compile("I*[DKR]|I+$")


def _stream(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of a conversation one after the other, each block's edits before its first row."""
    text = _marked(rows).select("_key", "_turn", "_hash", F.lit(1).alias("_flag"), F.lit(-1).cast("long").alias("_block"), F.lit(None).cast("string").alias("_edits"), "_role", "_text")
    blank = F.lit(None).cast("string")
    marks = edits.select("_key", "_turn", "_hash", F.lit(0).alias("_flag"), "_block", "_edits", blank.alias("_role"), blank.alias("_text"))
    order = ["_key", F.col("_turn").asc_nulls_first(), "_hash", "_flag", "_block"]
    return text.unionByName(marks).repartition("_key").sortWithinPartitions(*order).select(*STREAM)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(key, edit, role, text) of every edit; role and text are None where a row is deleted."""
    now, state, parts = None, 0, deque()

    def insert(n: int) -> Iterator[tuple[str, str, str | None, str | None]]:
        nonlocal state
        for _ in range(n):
            yield now, "I", DUE[state], ""
            state = AFTER_DUE[state]

    for batch in batches:
        for key, flag, edits, role, text in zip(*(batch.column(c).to_pylist() for c in range(len(STREAM)))):
            if key != now:
                yield from insert(sum(map(len, parts)))  # what follows the last row
                now, state, parts = key, 0, deque()
            if not flag:
                parts.extend(PART.findall(edits))
                continue
            part = parts.popleft()
            yield from insert(len(part) - 1)
            if part[-1] == "D":
                yield now, "D", None, None
                continue
            if part[-1] == "R":
                role, state = DUE[state], AFTER_DUE[state]
            else:
                state = AFTER_ROLE[state][role[:1]]
            yield now, part[-1], role, text
    yield from insert(sum(map(len, parts)))


def repaired(rows: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """The turns that repaired conversations have: ``conv`` (``=`` and its id, or empty), ``place``, ``edit``, ``role``, ``text``."""
    _, edits = repairs(rows, least_block)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, place = [], None, 0
        for key, edit, role, text in _repaired(batches):
            now, place = (now, place + 1) if key == now else (key, 0)
            if edit != "D":
                held.append((key, place, edit, role, text))
            if len(held) == 1000:
                yield batch_of(held)
                held = []
        yield batch_of(held)

    def batch_of(held: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], ["conv", "place", "edit", "role", "text"])

    return _stream(rows, edits).mapInArrow(emit, "conv string, place long, edit string, role string, text string")


def audits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``_key, audit, repaired_sha256``: a hash runs over a conversation in order, so one task reads its rows, one at a time."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, held = None, [], None, []

        def close() -> None:
            if now is not None:
                held.append((now, "".join(audit), digest.hexdigest()))

        for key, edit, role, text in _repaired(batches):
            if key != now:
                close()
                now, audit, digest, start = key, [], hashlib.sha256(), ""
                if len(held) > 1000:
                    yield batch_of(held)
                    held = []
            audit.append(edit)
            if edit != "D":
                digest.update(f"{start}{role}:{text}".encode())
                start = "\n"
        close()
        yield batch_of(held)

    def batch_of(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], pa.string()) for k in range(3)], ["_key", "audit", "repaired_sha256"])

    return _stream(rows, edits).mapInArrow(emit, "_key string, audit string, repaired_sha256 string")


def digest(conversations: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """The contract's columns of query op12."""
    rows = damaged(conversations)
    report, edits = repairs(rows, least_block)
    everyone = _row(conversations).groupBy("_key").agg(F.first("_conv").alias("conv_id"))
    out = everyone.join(report, "_key", "left").join(audits(rows, edits), "_key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def filled(name: str, value) -> Column:
        return F.coalesce(F.col(name), F.lit(value)).alias(name)

    return out.select("conv_id", *[filled(c, 0).cast("long").alias(c) for c in numbers], filled("audit", ""), filled("repaired_sha256", hashlib.sha256(b"").hexdigest()))
