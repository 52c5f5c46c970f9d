"""Cross-tokenizer alignment against plain loops over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import crosstokens, lookup
from trackloom.llm.tokens import default_path

SCHEMA = "doc_id long, text string"
PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", " \n", "a", "foo", "Ünï", "é", "中文", "🙂", "'s", "'ll", "1234", "!!", "<s>", "</s>", "<unk>", "<|endoftext|>", "▁", "<0x0A>", "́", "ǆ", "\x00", "ﬁ", "İ", "​", "don't", "a.b", "__init__"]
FIXED = [None, "", " ", "\n", " a", "a ", "x  y", "x\n\ny", "\n\nfoo", " \nfoo", "a \nfoo", "foo\t bar", "the cat sat", "the cat sat", "word " * 3000]


def made(n):
    r = random.Random(3)
    texts = FIXED + ["".join(r.choice(PARTS) for _ in range(r.randint(1, 14))) for _ in range(n)]
    return [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, "the cat sat")]


def plain_ids(text, tools=[]):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not tools:
        a = Tokenizer.from_file(default_path(crosstokens.BYTE_BPE))
        a.encode_special_tokens = True
        tools += [a, SentencePieceProcessor(model_file=default_path(crosstokens.PIECES))]
    t = crosstokens.Tokenizers.load()
    if not text:
        return [], []
    a, b, raw = tools[0].encode(" " + text, add_special_tokens=False).ids, tools[1].encode(text), (" " + text).encode()
    same = b"".join(t.bytes_a[i] for i in a) == raw == b"".join(t.bytes_b[i] for i in b)
    return (a, b) if same else ([], [])


def plain_groups(text):
    t = crosstokens.Tokenizers.load()
    a, b = plain_ids(text)
    ends = [np.cumsum([len(table[i]) for i in ids], dtype=int) for ids, table in ((a, t.bytes_a), (b, t.bytes_b))]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, before = [], 0
    for cut in cuts:
        groups.append(tuple([i for i, e in zip(ids, at) if before < e <= cut] for ids, at in zip((a, b), ends)))
        before = cut
    return len(a), len(b), groups


def test_units_give_the_ids_of_whole_texts():
    texts = [t for _, t in made(4000)]
    a, b = crosstokens.Tokenizers.load().encode(texts)
    for text, x, y in zip(texts, a, b):
        assert (np.frombuffer(x, "<u4").tolist(), np.frombuffer(y, "<u4").tolist()) == plain_ids(text), repr(text)


def plain_rows(rows):
    docs = [(i, *plain_groups(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for *_, groups in docs]
    count = Counter(pair for one in links for pair in one)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for (i, n_a, n_b, groups), one in zip(docs, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        yield (
            i, n_a, n_b, len(groups), sum(one.values()), sum(n for p, n in one.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in one.items()),
            hashlib.sha256(text.encode()).hexdigest() if n_a else "",
        )


@pytest.mark.parametrize("most", [crosstokens.TOP_PAIRS, 40, 0])
def test_rows_equal_a_plain_loop(spark, most):
    rows = made(150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(7).alias(n) for n in ("TEXT", "_id", "pairs", "key", "n_a")])
    got = crosstokens.counted(df, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_rows(rows)))


def test_partial_counts_in_many_pieces(spark, monkeypatch):
    rows = made(60)
    parts = crosstokens.alignments(spark.createDataFrame(rows, SCHEMA))
    whole = {tuple(r) for r in crosstokens.pair_counts(parts).collect()}
    monkeypatch.setattr(crosstokens, "PAIRS_IN_HAND", 5)
    assert {tuple(r) for r in crosstokens.pair_counts(parts).collect()} == whole


def test_no_rows(spark):
    assert crosstokens.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_table_holds_every_key():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 2_000_000, dtype=np.int64).view(np.uint64)
    keys = np.unique(np.concatenate([keys, np.arange(1000, dtype=np.uint64)]))
    values = np.arange(len(keys)) - 1000
    table = lookup.Lookup(keys, (values % 3 == 0).astype(int), values)
    found, counted, value = table.find(keys)
    assert found.all() and (value == values).all() and (counted == (values % 3 == 0)).all()
    found, _, value = table.find(keys + np.uint64(1 << 62))
    absent = ~np.isin(keys + np.uint64(1 << 62), keys)
    assert not found[absent].any() and not value[absent].any()
