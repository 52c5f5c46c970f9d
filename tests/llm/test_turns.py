"""Structure repair of conversations against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.llm import oracles, turns

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def made(seed, convs):
    r = random.Random(seed)
    out = []
    for c in range(convs):
        roles = ["user", "assistant", "system", "tool", "", None, "User", "amanuensis"] if c % 3 else ["user", "assistant"]
        weights = [8, 8, 2, 1, 1, 1, 1, 1][: len(roles)]
        for turn in range(r.choice([1, 2, 3, 5, 8, 13])):
            text = r.choice(["Yes.", "No", "Why? ", "  \n", "", None, "Well!\t", "so\u0085", "ok. ", f"word {turn}.", "x" * 2000 + "."])
            out.append((c if c % 11 else None, turn * r.choice([1, 1, 1, 2]) if r.random() > 0.05 else None, r.choices(roles, weights)[0], text))
    return out


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            yield from [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)


def cheapest(rows):
    """(cost, edits, repaired turns) by a search that always goes on from the cheapest, least edits."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, at, last, kept = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            return cost, edits, kept
        if (at, last) in done:
            continue
        done.add((at, last))
        role = due[last]
        name = {"u": "user", "a": "assistant"}[role]
        heapq.heappush(queue, (cost + 2, edits + "I", at, role, (*kept, f"{name}:")))
        if at < len(rows):
            fault, own, text = rows[at]
            heapq.heappush(queue, (cost + 3, edits + "D", at + 1, last, kept))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(queue, (cost + 2 + more, edits + "R", at + 1, role, (*kept, f"{name}:{text}")))
                if own[:1] == role or (own[:1] == "s" and not last):
                    heapq.heappush(queue, (cost + more, edits + "K", at + 1, own[:1], (*kept, f"{own}:{text}")))


def plain_rows(rows):
    convs = {r[0]: [] for r in rows}
    for r in damaged(rows):
        convs[r[0]].append(r)
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{r[2]}\0{r[3]}".encode()).hexdigest()))
        seen, counts, marked = set(), defaultdict(int), []
        for _, _, role, text in some:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "none" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            marked.append((fault, role, text))
        known = [r[1] for r in some if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, kept = cheapest(marked)
        yield conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("least_block", [1, 3, turns.LEAST_BLOCK])
def test_rows_equal_a_plain_search(spark, least_block):
    rows = made(least_block, 80)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(7).alias(n) for n in ("TEXT", "Turn", "_key", "_block", "cost", "_conv")])
    got = turns.digest(df, least_block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_rows(rows)))


def test_the_sql_says_the_same():
    con, rows = duckdb.connect(), made(5, 60)
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(str, con.execute(oracles.TURN_REPAIR).fetchall())) == sorted(map(str, plain_rows(rows)))


@pytest.mark.parametrize("block", [1, 2, 5, 50])
def test_blocks_give_the_least_of_the_cheapest_edits(block):
    r = random.Random(block)
    for _ in range(150):
        codes = "".join(r.choice("sSuuuuUaaaaAxX1234678") for _ in range(r.randint(1, 24)))
        rows = [(turns.FAULT[c], turns.ROLE[c], "t") for c in codes]
        parts = [codes[i : i + block] for i in range(0, len(codes), block)]
        ends, cost = turns.checkpoints([turns.through(p) for p in parts])
        state, audit = 0, ""
        for k, (p, end) in enumerate(zip(parts, ends), 1):
            exits, edits = turns.walks(p, end, k == len(parts))
            state, audit = exits[state], audit + edits[state]
        assert (cost, audit) == cheapest(rows)[:2]


def test_one_long_conversation_over_many_partitions(spark):
    """Long against the blocks and the range partitions; half of its rows are equal."""
    r = random.Random(9)
    rows = [(5, t, "user" if t % 2 else "assistant", "Same." if t % 4 < 2 else f"Turn {r.random()}" + "." * (t % 3)) for t in range(4000)] + [(6, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: tuple(r) for r in turns.digest(df).collect()}
    assert got == {r[0]: r for r in plain_rows(rows)}
    turns_of = turns.repaired(turns.damaged(df)).filter("conv = '=5'").orderBy("place").collect()
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns_of).encode()).hexdigest() == got[5][-1]
    assert re.fullmatch("s?(ua)+", "".join(t.role[0] for t in turns_of))


def test_no_rows_and_rows_that_all_go(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.digest(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = turns.digest(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
