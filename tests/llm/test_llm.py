"""The training-data operators against brute force, on small tables made here."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.llm import bitmix, components, hashing, linededup, lmscore, media, mixing, mjpeg, ngramjoin, packing, quality, tokencounts, tokens, toxicity, urlgraph

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"
rnd = random.Random(5)
VOCAB = ["".join(rnd.choice("abcdefgéü") for _ in range(rnd.randint(1, 7))) for _ in range(400)] + ["the", "of", "and", "is"] * 30


def prose(n, r=rnd):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def near(text, r=rnd, share=0.01):
    return " ".join(w if r.random() > share else r.choice(VOCAB) for w in text.split())


def make_docs():
    out = [(i, prose(rnd.randint(5, 200)), rnd.choice(["en", "de", None]), f"s{i % 4}", 0) for i in range(60)]
    base = [o[1] for o in out[:6]]
    out += [(100 + i, near(base[i % 6]), "en", "s0", 0) for i in range(30)]
    out += [(200 + i, base[0], "en", None, 0) for i in range(5)]
    line = "Shared Line of Words"
    out += [(300 + i, f"{prose(12)}\n {line if i % 2 else line.upper()}\t\n{prose(8)}", "en", "s1", 0) for i in range(12)]
    out += [(400, None, None, None, None), (401, "", "en", "s2", 0), (402, " \n\t\n", "en", "s2", 0), (403, "one two", "en", "s2", 0), (None, "no id here", "en", "s3", 0), (404, "x" * 70000 + " " + prose(3000), "en", "s3", 0)]
    out += [out[0], (405, "the " * 300, "en", "s1", 0), (406, "Ünï <|endoftext|> don't 'S “q”… 1234\x0b\x1c  ǅ", "en", "s1", 0)]
    return out


ROWS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3, "n_chars", "source")
    # extra columns whose names clash with the operators' own and with each other
    return df.select("*", *[F.lit(7).alias(n) for n in ("TEXT", "Size", "size", "_id", "_text", "label", "h")]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


DIGESTS = {
    "op1": tokencounts.digest, "op3": linededup.digest, "op4": media.digest, "op5": packing.digest, "op6": ngramjoin.digest, "op7": mixing.digest,
    "op8": quality.digest, "op10": lmscore.digest,
}


@pytest.mark.parametrize("name", DIGESTS)
def test_empty_table(none, name):
    assert DIGESTS[name](none).count() == 0


def words(text):
    return re.findall(WORD, text or "")


def az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# ---------------------------------------------------------------- op1, op5: tokens


def plain_ids(text):
    from tokenizers import Tokenizer

    t = plain_ids.__dict__.setdefault("t", Tokenizer.from_file(tokens.default_path()))
    return t.encode(text or "", add_special_tokens=False).ids


def test_cached_ids_are_the_tokenizers(docs):
    texts = [r[1] for r in ROWS] + ["İstanbul ΣΑΣ. a.b c., x́ ́y <|ENDOFTEXT|>. ﻿ É.\nÉ", "ﬁ ǆ ß. ẞ a' 's."]
    got = tokens.WordTokenizer.load().ids(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [plain_ids(t) for t in texts]


def test_packing_places_every_id_once(docs):
    rows = packing.packed(docs).collect()
    ids = Counter()
    want = Counter(tuple([*plain_ids(r[1]), 2]) for r in ROWS)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert len(r["ids"]) == 4 * r["length"]
    for (_, n), parts in by_doc.items():
        parts.sort(key=lambda r: (r["start"], r["sequence_id"]))
        whole = np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist()
        copies = len(whole) // n
        if copies == 1:
            ids[tuple(whole)] += 1
        else:  # repeated rows of one id: their pieces cannot be told apart, their ids can
            assert Counter(whole) == Counter({k: v * copies for k, v in Counter(next(w for w in want if len(w) == n and set(w) == set(whole))).items()})
            ids[next(w for w in want if len(w) == n and set(w) == set(whole))] += copies
    assert ids == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    d = {(r["doc_id"], r["start"], r["length"]): r["ids_crc32"] for r in packing.digest(docs).collect()}
    assert all(zlib.crc32(r["ids"]) == d[r["doc_id"], r["start"], r["length"]] for r in rows if r["doc_id"] != 0)


@pytest.mark.parametrize("seed", range(20))
def test_closest_fill_is_the_best(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 60): r.randint(1, 4) for _ in range(r.randint(1, 6))}
    cap = r.randint(1, 120)
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * j for s in sums for j in range(n + 1)}
    got = packing.closest_fill(counts, cap)
    assert all(n <= counts[k] for k, n in got.items())
    assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= cap)


def test_ledger(spark, tmp_path):
    ledger = tokencounts.TokenLedger(spark, str(tmp_path / "ledger"))
    schema = "doc_id long, source string, lang string, version string, op string, n_tokens long, old_tokens long"
    e = lambda *rows: spark.createDataFrame(rows, schema)
    assert ledger.totals().count() == 0
    first = e((1, "a", "en", "v", "insert", 10, None), (2, "a", "en", "v", "insert", 5, None), (3, None, "en", "v", "insert", None, None), (9, "a", "en", "v", "other", 5, 1))
    assert ledger.commit("b1", first) and not ledger.commit("b1", first)
    assert ledger.commit("b2", e((1, "a", "en", "v", "revise", 12, 10), (2, "a", "en", "v", "delete", 5, None)))
    assert ledger.commit("b3", e())
    got = {(r["source"], r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    assert got == {("a", 1, 12), (None, 1, 0)}
    assert ledger.batches() == ["b1", "b2", "b3"]
    with pytest.raises(ValueError):
        ledger.commit("../x", first)


def test_ledger_keeps_totals_in_snapshots(spark, tmp_path, monkeypatch):
    schema = "source string, lang string, version string, op string, n_tokens long, n_docs long"
    one = lambda n: spark.createDataFrame([("a", "en", "v", "insert", n, None), ("b", None, "v", "insert", 2 * n, 2)], schema)
    root = str(tmp_path / "ledger")
    ledger = tokencounts.TokenLedger(spark, root, fold_every=3)
    for k in range(7):
        assert ledger.commit(f"b{k}", one(k))
    assert ledger._snapshot()[0] == 6 and [b for _, b, _ in ledger._entries(6)] == ["b6"]
    want = {("a", 7, 21), ("b", 14, 42)}
    assert {(r["source"], r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()} == want
    assert ledger.fold() and not ledger.fold() and not ledger.commit("b3", one(50))
    # a second driver that saw the batch uncommitted loses the race and leaves nothing behind
    slow = tokencounts.TokenLedger(spark, root)
    monkeypatch.setattr(slow, "committed", lambda batch_id: False)
    assert not slow.commit("b5", one(50))
    # a commit file that was cut off counts for nothing and is replaced
    (tmp_path / "ledger/commits/b7").write_text("half")
    assert "b7" not in ledger.batches() and ledger.commit("b7", spark.createDataFrame([], schema))
    assert {(r["source"], r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()} == want
    assert len(list((tmp_path / "ledger/data").iterdir())) == 8 + 3
    # a driver that was lost between its log entry and its decision: the entry counts, once
    name = ledger._written(tokencounts.deltas(one(1)))
    number = max(n for n, _, _ in ledger._entries(7)) + 1
    assert ledger._claim(f"log/{number:012d}", ["b8", name]) and not ledger.commit("b8", one(1))
    assert ledger._claim(f"log/{number + 1:012d}", ["b8", ledger._written(tokencounts.deltas(one(1)))])
    want = {("a", 8, 22), ("b", 16, 44)}
    for _ in range(2):
        assert {(r["source"], r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()} == want
        ledger.fold()


def test_ledger_reads_what_is_new_and_vacuums(spark, tmp_path, monkeypatch):
    """A commit opens its own batch's file and the entries since the last snapshot, however many batches there were."""
    schema = "source string, lang string, version string, op string, n_tokens long"
    one = spark.createDataFrame([("a", "en", "v", "insert", 3)], schema)
    ledger = tokencounts.TokenLedger(spark, str(tmp_path / "ledger"), fold_every=3)
    opened, lines = [], ledger._lines
    monkeypatch.setattr(ledger, "_lines", lambda path: opened.append(path) or lines(path))
    counts = []
    for k in range(13):
        opened.clear()
        assert ledger.commit(f"b{k}", one)
        counts.append(len(opened))
    assert max(counts[-3:]) <= max(counts[3:6]) + 2
    assert ledger.vacuum() > 10 and ledger.vacuum() == 0
    assert len(list((tmp_path / "ledger/data").iterdir())) <= 7 and not ledger.commit("b2", one)
    assert [r[:] for r in ledger.totals().collect()] == [("a", "en", "v", 13, 39)]


def test_token_counts_of_the_query(docs):
    want = Counter()
    seen = set()
    for i, text, lang, source, _ in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        first = next(r[0] for r in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)) if r[1] == text)
        if i == first:
            want[source, lang, "docs"] += 1
            want[source, lang, "tokens"] += len(plain_ids(text))
        seen.add(text)
    got = Counter()
    for r in tokencounts.digest(docs).collect():
        got[r["source"], r["lang"], "docs"] += r["n_docs"]
        got[r["source"], r["lang"], "tokens"] += r["n_tokens"]
    assert got == +want


# ---------------------------------------------------------------- op2: urls


def test_urls_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?y", "http://example.net", "https://x.example.org/fr/1#t", "http://notexample.net/en/", "nothing", None, "http://b.example.com/de/", "http://b.example.com/d"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = [tuple(r)[1:] for r in urlgraph.filtered(df).orderBy("page_id").select("page_id", "host", "path", "rule", "verdict").collect()]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "", None, "allow"), ("x.example.org", "/fr/1", "org/fr/", "allow"),
        ("notexample.net", "/en/", "net/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.example.com", "/de/", "example.com/de/", "block"), ("b.example.com", "/d", None, "allow"),
    ]
    assert urlgraph.filtered(df.limit(0)).count() == 0


def test_link_graph(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/p">' for h in hosts)
    pages = [(1, "http://bad.net/", ""), (2, "http://farm.com/", link("bad.net", "bad.net", "deep.com")), (3, "http://deep.com/", link("farm.com")), (4, "http://good.org/fr/", link("friend.com")), (5, "http://friend.com/", link("bad.net", "good.org"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlgraph.filtered(df).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    edges = {("farm.com", "bad.net"): 2, ("farm.com", "deep.com"): 1, ("deep.com", "farm.com"): 1, ("good.org", "friend.com"): 1, ("friend.com", "bad.net"): 1, ("friend.com", "good.org"): 1}
    for walk, seed in (("trust", "good.org"), ("distrust", "bad.net")):
        arcs = edges if walk == "trust" else {(b, a): w for (a, b), w in edges.items()}
        out = Counter()
        for (a, _), w in arcs.items():
            out[a] += w
        score = {seed: 1.0}
        for _ in range(urlgraph.ROUNDS):
            new = Counter({seed: 1 - urlgraph.DAMPING})
            for (a, b), w in arcs.items():
                new[b] += urlgraph.DAMPING * score.get(a, 0) * w / out[a]
            score = new
        assert all(r[walk] == pytest.approx(score.get(r["host"], 0.0), abs=urlgraph.TOLERANCE) for r in got.values())


def test_link_graph_over_ports_users_clashes_and_long_pages(spark):
    rows = [
        (1, "http://bad.net:8080/", None), (2, "http://farm.com/", "x" * 300_000 + '<a href="http://bad.net:8080/p"><img src=http://u:pw@friend.com/i>'),
        (3, "http://u:pw@friend.com/", ""), (3, "http://u:pw@friend.com/", ""), (None, "http://farm.com/q", ""),
    ]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = plain.select("*", *[F.lit("z").alias(c) for c in ("URL", "host", "_host", "score", "verdict", "_id")])
    rules = (("block", "bad.net:8080", "/"),)
    got = Counter((r["page_id"], r["host"], r["verdict"]) for r in urlgraph.filtered(df, rules).collect())
    assert got == {(1, "bad.net:8080", "block"): 1, (2, "farm.com", "block"): 1, (3, "u:pw@friend.com", "allow"): 2, (None, "farm.com", "block"): 1}
    edges = urlgraph.host_edges(plain.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("_host"), F.col("html").alias("_html")))
    assert {tuple(r) for r in edges.collect()} == {("farm.com", "bad.net:8080", 1.0), ("farm.com", "u:pw@friend.com", 1.0), ("farm.com", "friend.com", 1.0)}  # reads as an address too


# ---------------------------------------------------------------- op3, op7, op8


def test_line_dedup(docs):
    keys = Counter()
    for i in {r[0] for r in ROWS}:
        keys.update({k for r in ROWS if r[0] == i for k in (az(x.strip(" \t\n\x0b\x0c\r")) for x in (r[1] or "").split("\n"))})
    want = Counter()
    for i, text, *_ in ROWS:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (k := az(x.strip(" \t\n\x0b\x0c\r"))) or keys[k] < 10]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in linededup.digest(docs).collect()) == want
    assert sum(v for k, v in want.items() if k[2]) == 12


def mix_key(row):
    return int(hashlib.md5(str(row[0] if row[0] is not None else row[1] or "").encode()).hexdigest()[:15], 16), len(words(row[1])), row[1] or ""


def plain_mix(rows):
    """(targets, sources in order, entries taken: finish, source, round, key, id, words) in plain loops."""
    size = Counter()
    for _, text, _, source, _ in rows:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:  # reshare until none is above
        w = sum(weight[s] for s in order if s not in full)
        over = [s for s in order if s not in full and left * weight[s] / w > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            full.add(s)
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: left * weight[s] / w for s in order if s not in full}
    queue = []
    for s in order:  # every source in its shuffled order, twice; then all by virtual finish
        done = 0
        for round_ in range(2):
            for row in sorted((r for r in rows if r[3] == s), key=mix_key):
                n = len(words(row[1]))
                done += n
                if n:
                    queue.append((done / target[s], order.index(s), round_, mix_key(row), row[0], n))
    left, taken = int(1.5 * sum(size.values())), []
    for e in sorted(queue, key=lambda e: e[:4]):
        left -= e[5]
        if left < 0:
            break
        taken.append(e)
    return target, order, taken


def test_mixing(docs):
    rows = mixing.digest(docs).collect()
    size = Counter()
    for _, text, _, source, _ in ROWS:
        size[source] += len(words(text))
    key = mix_key
    target, order, entries_taken = plain_mix(ROWS)
    taken = Counter()
    for e in entries_taken:
        taken[e[3]] += e[5]
    same = Counter(key(r) for r in ROWS)
    want, got = Counter(), Counter()
    for r in ROWS:
        want[r[0], len(words(r[1])), size[r[3]]] += taken[key(r)] / same[key(r)]
    for r in rows:
        got[r["doc_id"], r["size"], r["source_size"]] += r["taken"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v} and len(rows) == len(ROWS)
    assert all(r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(next(target[s] for s in order if size[s] == r["source_size"])) for r in rows)
    for s in order:  # near the target: short by less than a document, over by what others in service leave
        near_ = sum(e[5] for e in entries_taken if order[e[1]] == s)
        assert -max(len(words(r[1])) for r in ROWS if r[3] == s) < near_ - target[s] < max(len(words(r[1])) for r in ROWS)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.digest(docs.repartition(5)).collect()), key=str)
    entries = mixing.mixed(docs).collect()
    assert [(e["virtual_finish"], e["_id"], e["round"], e["size"]) for e in entries] == [(e[0], e[4], e[2], e[5]) for e in entries_taken]
    half = mixing.mixed(docs, budget=2000).collect()
    assert half == entries[: len(half)] and 2000 - entries[len(half)]["size"] < sum(e["size"] for e in half) <= 2000
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    assert Counter((r[0], r[1]) for r in texts.collect()) == Counter((e[4], t) for e in entries_taken for t in [next(r[1] for r in ROWS if key(r) == e[3])])


def test_quality_counts(docs):
    want = Counter()
    for i, text, *_ in ROWS:
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        bad = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), bad] += 1
    got = quality.digest(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got) > 20


def plain_broken(text, rules):
    """Names of the rules that a text breaks, by plain counts."""
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    shares = {
        "mean_word_length": (sum(map(len, w)), len(w)), "symbol_ratio": (len(re.findall(r"[#*$%&|<>]", text)), len(w)), "shout_ratio": (text.count("!!"), len(w)),
        "stop_word_ratio": (sum(az(x) in quality.STOP_WORDS for x in w), len(w)), "dup_line_ratio": (len(lines) - len(set(lines)), len(lines)),
        "bullet_line_ratio": (sum(bool(re.match(r"[ \t]*[-*•][ \t]", x)) for x in lines), len(lines)), "ellipsis_line_ratio": (sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*\Z", x)) for x in lines), len(lines)),
    }
    out = []
    for r in rules:
        a, b = shares[r.metric]
        if b and len(w) >= r.words_from and (r.bytes_a_char is None or len(text.encode()) <= r.bytes_a_char * len(text)):
            if (r.least is not None and a / b < r.least) or (r.most is not None and a / b > r.most):
                out.append(r.name)
    return out


def test_quality_verdicts_by_plain_rules(spark):
    r = random.Random(11)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    some = lambda n, more=(): " ".join(r.choice(more) if more and r.random() < 0.3 else r.choice(plain) for _ in range(n))
    texts = [some(n, m) for n in (12, 60, 99, 100, 101, 300) for m in ((), ("the", "OF"), ("#", "||", "$$$"), ("wow!!", "hey!!!!"), ("x" * 60,), ("слово", "дом", "и"))]
    texts += ["\n".join(f"{mark} {some(6)}{end}" for _ in range(12)) for mark in ("-", " * ", "•", "") for end in ("", "...", "… ")] + ["\n".join([some(12)] * 5 + [some(12)]), None, ""]
    got = quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("_id", "reasons", "base_failed", "kept").collect()
    want = {i: plain_broken(t, quality.RULES) for i, t in enumerate(texts)}
    assert {x["_id"]: x["reasons"] for x in got} == want
    assert all(x["kept"] == (not x["base_failed"] and not want[x["_id"]]) for x in got)
    assert {name for names in want.values() for name in names} == {rule.name for rule in quality.RULES}


# ---------------------------------------------------------------- op4: media


def test_avi_round_trip_and_clips(spark, docs):
    payloads = [media.payload_of(b) for b in (b"", b"a" * 192, bytes(range(256)) * 6, random.Random(1).randbytes(1920))]
    files = mjpeg.write(payloads)
    assert [luma[..., 0, 0].tobytes() for _, luma in mjpeg.read(files)] == payloads
    shots = bytes([20] * 192 * 30 + [200] * 192 * 20 + [90] * 192 * 10)
    df = spark.createDataFrame([(1, bytearray(mjpeg.write([shots])[0])), (2, bytearray(b"junk")), (3, None)], "media_id long, content binary")
    got = [tuple(r) for r in media.clips(df).orderBy("media_id", "clip").collect()]
    assert got == [(1, 0, 0, 30, 0.0, 1.2), (1, 1, 30, 20, 1.2, 2.0), (1, 2, 50, 10, 2.0, 2.4)]
    rows = media.digest(docs).collect()
    want = Counter((i, len((t or "").encode()), hashlib.sha256(media.payload_of((t or "").encode())).hexdigest()) for i, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"]) for r in rows) == want
    by_text = {}
    for r in rows:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["tail_crc32"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_jpeg_with_detail_is_decoded():
    """A block with AC coefficients, coded here by the tables' own rules."""
    codes = {"dc": mjpeg._codes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12))), "ac": mjpeg._codes([0, 2, 1] + [0] * 13, [0x01, 0x00, 0x03])}
    bits = ""

    def put(code):
        nonlocal bits
        bits += format(code[0], f"0{code[1]}b")

    put(codes["dc"][3])
    bits += "101"  # DC 5
    put(codes["ac"][0x03])
    bits += "110"  # AC 6 at the first place
    put(codes["ac"][0x01])
    bits += "0"  # AC -1 at the second
    put(codes["ac"][0x00])
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + mjpeg._segment(0xDB, bytes([0] + [4] * 64)) + mjpeg._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    head += mjpeg._segment(0xC4, bytes([0, 0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7 + list(range(12)))) + mjpeg._segment(0xC4, bytes([16, 0, 2, 1] + [0] * 13 + [1, 0, 3])) + mjpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    h = mjpeg.parse_header(head)
    got = mjpeg.decode_luma(np.frombuffer(head + scan, np.uint8), np.array([len(head)]), np.array([len(scan)]), h)[0, 0, 0]
    x = np.arange(8)
    c = lambda k: np.cos((2 * x + 1) * k * np.pi / 16) * (0.5 if k else np.sqrt(1 / 8))
    want = 4 * (5 * np.outer(c(0), c(0)) + 6 * np.outer(c(0), c(1)) - np.outer(c(1), c(0))) + 128
    assert np.abs(got - want).max() <= 0.51


def plain_jpeg(blocks, restart=0, tables=True, width=None):
    """A one-component frame of 8x8 blocks (DC, AC at the second place), coded with the tables of annex K.3."""
    dc = mjpeg._codes(mjpeg.K3_DC_LUMA, list(range(12)))
    ac = mjpeg._codes(mjpeg.K3_AC_LUMA, mjpeg._all_symbols(mjpeg.K3_AC_LUMA_SHORT))
    amount = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    code = lambda c: format(c[0], f"0{c[1]}b")
    scan, bits, last = b"", "", 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    for i, (d, a) in enumerate(blocks):
        if restart and i and i % restart == 0:
            scan += flush(bits) + bytes([0xFF, 0xD0 + (i // restart - 1) % 8])
            bits, last = "", 0
        bits += code(dc[abs(d - last).bit_length()]) + amount(d - last)
        last = d
        if a:
            bits += code(ac[abs(a).bit_length()]) + amount(a)
        bits += code(ac[0])
    scan += flush(bits)
    w = width or 8 * len(blocks)
    out = b"\xff\xd8" + mjpeg._segment(0xDB, bytes([0] + [8] * 64)) + mjpeg._segment(0xC0, struct.pack(">BHHB", 8, 8 * (8 * len(blocks) // w), w, 1) + bytes([1, 0x11, 0]))
    if tables:
        out += mjpeg._segment(0xC4, bytes([0, *mjpeg.K3_DC_LUMA, *range(12)])) + mjpeg._segment(0xC4, bytes([16, *mjpeg.K3_AC_LUMA, *mjpeg._all_symbols(mjpeg.K3_AC_LUMA_SHORT)]))
    if restart:
        out += mjpeg._segment(0xDD, struct.pack(">H", restart))
    return out + mjpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_default_tables_and_restart_intervals():
    assert len(set(mjpeg.K3_AC_LUMA_SHORT)) == 37 == sum(mjpeg.K3_AC_LUMA[:-1]) and len(set(mjpeg.K3_AC_CHROMA_SHORT)) == 43 == sum(mjpeg.K3_AC_CHROMA[:-1])
    r = random.Random(2)
    blocks = [(r.randint(-120, 120), r.randint(-20, 20)) for _ in range(28)]
    flat = [(d, 0) for d, _ in blocks]

    def luma(jpeg):
        h = mjpeg.parse_header(jpeg)
        return mjpeg.decode_luma(np.frombuffer(jpeg * 2, np.uint8), np.array([h.size, h.size + len(jpeg)]), np.array([len(jpeg) - h.size - 2] * 2), h)

    for some in (blocks, flat):
        whole = luma(plain_jpeg(some, width=56))
        assert whole.shape[:3] == (2, 4, 7)
        assert (whole[0, :, :, 0, 0].ravel() == luma(plain_jpeg(some))[1, 0, :, 0, 0]).all()
        for restart, tables in ((0, False), (1, True), (3, False), (7, True), (27, True), (28, False), (100, True)):
            assert (luma(plain_jpeg(some, restart, tables, width=56)) == whole).all()
    assert (luma(plain_jpeg(flat, width=56))[0, :, :, 0, 0].ravel() == [min(255, max(0, d + 128)) for d, _ in flat]).all()


def test_avi_without_index_and_in_several_riffs():
    body = random.Random(1).randbytes(192 * 7)
    (whole,) = mjpeg.write([body])
    at = whole.index(b"idx1")
    cut = bytearray(whole[:at])
    cut[4:8] = struct.pack("<I", at - 8)
    assert mjpeg.read([bytes(cut)])[0][1][..., 0, 0].tobytes() == body
    movi = whole[whole.index(b"movi") + 4 : at]
    more = b"RIFF" + struct.pack("<I", len(movi) + 16) + b"AVIX" + b"LIST" + struct.pack("<I", len(movi) + 4) + b"movi" + movi
    assert mjpeg.read([whole + more])[0][1][..., 0, 0].tobytes() == body * 2


def test_damaged_media_have_no_clips(spark):
    r = random.Random(9)
    good = mjpeg.write([bytes([30] * 192 * 3)])[0], mjpeg._riff(b"".join(mjpeg._chunk(b"00dc", plain_jpeg([(5, 3)] * 16, 4, width=32)) for _ in range(3)), b"", 3)
    bad = []
    for k in range(1500):
        data = bytearray(good[k % 2])
        for _ in range(r.randint(1, 4)):
            data[r.randrange(len(data))] = r.randrange(256)
        if k % 5 == 0:
            del data[r.randrange(len(data)) :]
        bad.append(bytes(data))
    read = failed = 0
    for data in bad:
        try:
            mjpeg.read([data])
            read += 1
        except mjpeg.BadMedia:
            failed += 1
    assert read > 100 and failed > 100
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate([*good, *bad[:200]])], "media_id long, content binary")
    assert {r["media_id"] for r in media.clips(df).collect()} >= {0, 1}


# ---------------------------------------------------------------- op6: near duplicates


def brute_classes(rows):
    sets = []
    for _, t, *_ in rows:
        w = words(az(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links, up = Counter(), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(i)
    return links, members


@pytest.mark.parametrize("block", [512, 7, "bytes"])
def test_ngram_join(docs, block, monkeypatch):
    if block == "bytes":  # blocks of a few texts by their bytes
        monkeypatch.setattr(ngramjoin, "BLOCK_BYTES", 3000)
    else:  # small blocks: groups span several tiles
        monkeypatch.setattr(ngramjoin, "BLOCK", block)
    got = Counter(map(tuple, ngramjoin.classes(docs).collect()))
    links, members = brute_classes(ROWS)
    want = Counter()
    for m in members.values():
        ids = [ROWS[i][0] for i in m if ROWS[i][0] is not None]
        for i in m:
            want[ROWS[i][0], min(ids) if ids else None, links[i]] += 1
    assert got == want
    if block == 512:
        kept = ngramjoin.one_of_each_class(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len(members)


def test_pruning_needs():
    needs = ngramjoin.least_matches()
    assert needs[-1][0] == ngramjoin.VALUES and all(m <= 0.8 * n for n, m in needs)
    p = 1.0  # a pair at the threshold passes every step but for about the tolerance
    for n, m in needs:
        p -= sum(ngramjoin.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
    assert p > 1 - 1e-3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["v"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}


# ---------------------------------------------------------------- op9, op10


def test_toxicity(spark):
    r = random.Random(3)
    bad = ["idiot", "scumbag", "dreadful"]
    rows, labels = [], []
    for i in range(1200):
        w = prose(r.randint(5, 60), r).split()
        toxic = i % 6 == 0
        if toxic:
            w.insert(r.randint(0, len(w)), r.choice(bad) + r.choice(["", ".", "!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "idiot"), (5002, "you idiot")]
    labels += [(5000, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("TEXT"), F.lit(1).alias("score"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.digest(docs, lab).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(1200))
    right = sum(got[i]["predicted"] == labels[i][1] for i in held) / len(held)
    assert right > 0.97
    assert got[5002]["predicted"] == 1 and got[5001]["predicted"] == 0 and got[5000]["score"] == got[5001]["score"]
    flipped = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, y in labels if i is not None], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.digest(docs, flipped).collect()}
    assert all(again[k] == got[k]["score"] for k in again)  # held-out labels teach nothing
    nothing = toxicity.digest(docs, lab.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert toxicity.digest(docs.limit(0), lab).count() == 0


def test_toxicity_sample_is_bounded_by_rows(spark):
    """An id on very many rows, very long texts and clashing names: at most ``rows`` rows, one an id."""
    rows = [(7, f"copy {i}") for i in range(5000)] + [(i, "word " * (50_000 if i == 8 else 3)) for i in range(60)] + [(9, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("*", F.lit(3).alias("DOC_ID"), F.lit("x").alias("_text"), F.lit(1).alias("_key"))
    lab = spark.createDataFrame([(i, i % 2, 1) for i in range(60)] + [(7, 0, 0)], "doc_id long, toxic int, Toxic int")
    for most in (100, 10):
        got = toxicity.training_sample(docs, lab, F.lit(True), most).collect()
        assert len(got) == min(most, 60) and len({x["_key"] for x in got}) == len(got)
    texts = {x["_key"]: x["_text"] for x in toxicity.training_sample(docs, lab, F.lit(True), 100).collect()}
    least = min([t for i, t in rows if i == 7], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert texts[hashlib.md5(b"7").hexdigest()] == least
    assert toxicity.digest(docs, lab).count() == len(rows)


def test_toxicity_by_plain_ftrl(spark):
    """Scores of a plain FTRL loop, coordinate by coordinate, over named features."""
    r = random.Random(11)
    rows = [(i, prose(r.randint(0, 25), r) + (" you dreadful fool" if i % 4 == 0 else "")) for i in range(120)] + [(500, None), (501, "Fool, dreadful!")]
    labels = [(i, int(i % 4 == 0)) for i in range(120)] + [(3, 1), (3, 0), (7, None)]  # 3: toxic, as one row says so
    schema = "doc_id long, text string", "doc_id long, toxic int"
    got = {x["doc_id"]: x["score"] for x in toxicity.digest(spark.createDataFrame(rows, schema[0]), spark.createDataFrame(labels, schema[1])).collect()}

    def named(text):
        w = re.findall(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", az(text or ""))
        out = {(p, w[i], w[i + p] if p else "") for p in range(4) for i in range(len(w) - p)}
        return out | {("stem", n, x.encode()[:n]) for x in w for n in toxicity.STEMS if len(x.encode()) >= n}

    def slots(text):
        return np.unique(toxicity.features(pa.array([text], pa.string()))[0]).tolist()

    truth = {}
    for i, y in labels:
        if y is not None:
            truth[i] = max(y, truth.get(i, 0))
    texts = dict(rows)
    assert all(abs(len(named(t)) - len(slots(t))) <= 1 for t in texts.values())  # one feature a slot, but for a rare collision
    learn = sorted((i for i in truth if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    z, n = Counter(), Counter()

    def weight(k):
        if k == "b":
            return -z[k] / (1 + n[k] ** 0.5)
        return 0.0 if abs(z[k]) <= 10 else -(z[k] - np.sign(z[k]) * 10) / (1 + n[k] ** 0.5 + 0.1)

    def chance(text):
        return 1 / (1 + np.exp(-sum(map(weight, ["b", *slots(text)]))))

    for _ in range(4):
        for i in learn:
            g = (toxicity.POSITIVE_WEIGHT if truth[i] else 1.0) * (chance(texts[i]) - truth[i])
            step = {k: weight(k) for k in ["b", *slots(texts[i])]}
            for k, w in step.items():
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) * w
                n[k] += g * g
    assert all(got[i] == pytest.approx(chance(t), abs=1e-5) for i, t in rows)
    assert got[500] == pytest.approx(1 / (1 + np.exp(-weight("b")))) and got[501] > 0.5


def held7(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("top", [200_000, 50])
def test_lm_base_score(docs, top, monkeypatch):
    monkeypatch.setattr(lmscore, "TOP_WORDS", top)  # 50: most words go by the join
    toks = [[*words(az(t or "")), None] for _, t, *_ in ROWS]
    c = Counter(w for (i, *_), ws in zip(ROWS, toks) if not held7(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held7(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for (i, *_), ws in zip(ROWS, toks))
    rows = lmscore.digest(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == want
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in rows)


def plain_windows(text):
    data = b"\xff" * 6 + " ".join(words(az(text or ""))).encode() + b"\xff"
    return [data[i - 6 : i + 1] for i in range(6, len(data))]


class PlainCounts:
    """Bit counts by context in dictionaries, one text and one byte after the other."""

    def __init__(self, texts):
        self.n = Counter()
        for t in texts:
            for w in plain_windows(t):
                for order in range(1, 7):
                    self.n[w[-1 - order : -1], None] += 1
                    for k in range(1, 9):
                        self.n[w[-1 - order : -1], k, w[-1] >> (8 - k)] += 1

    def pair(self, ctx, byte, k):
        """(on the side of the byte's bit k, on the other side) in a context."""
        before = self.n[ctx, k, byte >> (8 - k)] if k else self.n[ctx, None]
        own = self.n[ctx, k + 1, byte >> (7 - k)]
        return own, before - own


def plain_bit(counts, mixer, scorer, w, k, out=0):
    """(bit, node, log odds by order, gate) from the dictionaries."""
    byte, x, level = w[-1], [], {}
    bit = byte >> (7 - k) & 1
    for order in range(1, 7):
        own, other = counts.pair(w[-1 - order : -1], byte, k)
        own = max(own - out, 0)
        x.append((2 * bit - 1) * np.log((own + 0.3) / (other + 0.3)))
        level[order] = min(7, int(np.log2(own + other + 1)))
    return bit, ((1 << k) | byte >> (8 - k)) & 255, x, level[6] * 8 + level[3]


@pytest.mark.parametrize("top", [2_000_000, 300])
def test_lm_score_by_plain_mixing(docs, top, monkeypatch):
    """Every text's score, bit by bit, with the learned mixer and counts kept in dictionaries."""
    monkeypatch.setattr(lmscore, "TOP_WINDOWS", top)  # 300: most windows go by the join
    monkeypatch.setattr(lmscore, "BYTES_PER_SHARD", 40_000)  # several shards
    deal = lmscore.deal_of
    monkeypatch.setattr(lmscore, "deal_of", lambda shards: deal(shards, 1 / 200))  # heavy contexts of several lengths
    kept, learn = [], lmscore.mixer_of
    monkeypatch.setattr(lmscore, "mixer_of", lambda *a: kept.append(learn(*a)) or kept[-1])
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lmscore.digest(docs).collect())
    counts = PlainCounts(r[1] for r in ROWS if not held7(r[0]))
    mixer, scorer, known = kept[0], bitmix.Scorer(kept[0]), {}
    assert mixer.bytes == sum(len(plain_windows(r[1])) for r in ROWS if not held7(r[0]))

    def value(w):
        if w not in known:
            total = 0.0
            for k in range(8):
                bit, node, x, gate = plain_bit(counts, mixer, scorer, w, k)
                z = sum(mixer.weights[i][gate] * x[i] for i in range(6))
                z = (z + scorer.refine[node, min(max(int(np.rint(z * 2)) + 16, 0), 32)]) / 2
                z = min(max(z if bit else -z, -16), 16)
                total -= np.log1p(np.exp(-z))
            known[w] = total / np.log(10)
        return known[w]

    want = sorted((str(i), len(words(t)) + 1, sum(map(value, plain_windows(t)))) for i, t, *_ in ROWS)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    # single precision: a log odds at the edge of a bucket of the last table may fall to either side
    assert np.median([abs(g[2] - w[2]) / abs(w[2]) for g, w in zip(got, want)]) < 1e-4
    assert all(g[2] == pytest.approx(w[2], rel=2e-3) for g, w in zip(got, want))
    if top > 300:
        again = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lmscore.digest(docs.repartition(7)).collect())
        assert again == got  # to the last digit, whatever the partitions


def test_no_context_makes_a_large_shard(spark):
    """Half of all windows share a context of three bytes; they are dealt by longer ones."""
    r = random.Random(3)
    texts = ["".join(f"{r.choice('abcdefgh')}{r.choice('abcdefgh')}{r.choice('abcdefgh')}the{chr(r.randint(97, 122))} " for _ in range(60)) for _ in range(80)]
    learned = spark.createDataFrame([(True, t) for t in texts], "_learn boolean, _text string").repartition(4)
    parts = lmscore.counted(learned, bitmix.windows, 6, lmscore.packed_shard, lmscore.SHARDS).cache()
    keys, _ = np.unique(np.concatenate([bitmix.unpacked_keys(x.keys, x.n) for x in parts.collect()]), return_counts=True)
    deal = lmscore.deal_of(parts, 1 / 100)
    assert int.from_bytes(b"he") not in deal.heavy[2] or int.from_bytes(b"the") in deal.heavy[3]
    for order, some in deal.heavy.items():
        assert len(some) <= 100
        values, n = np.unique(bitmix.context(keys, order), return_counts=True)
        inside = deal.depth(keys) > order
        assert set(some.tolist()) == set(values[n > len(keys) / 100].tolist()) & set(bitmix.context(keys[inside], order).tolist())
    _, met = np.unique(deal.place(keys), return_counts=True)
    light = deal.depth(keys) < 6
    assert np.unique(deal.place(keys[light]), return_counts=True)[1].max() <= len(keys) / 100 and met.max() < len(keys) / 10
    again = lmscore.dealt(parts, deal, 6).collect()
    assert sorted(np.concatenate([bitmix.unpacked_keys(x.keys, x.n) for x in again]).tolist()) == keys.tolist()


def test_lm_scores_see_word_order(spark):
    r = random.Random(8)
    poem = "of arms and the man he sang who forced by fate first came from the shores of troy".split()
    rows = [(i, " ".join(poem)) for i in range(40)] + [(100 + i, prose(60, r)) for i in range(60)]
    mixed_up = [(1000, " ".join(poem)), (1001, " ".join(sorted(poem)))]
    got = {x["doc_id"]: x for x in lmscore.digest(spark.createDataFrame(rows + mixed_up, "doc_id long, text string")).collect()}
    assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])
    assert got[1000]["score"] > got[1001]["score"] + 5


def _shard(texts, held=()):
    tally = bitmix.Tally()
    tally.add(bitmix.windows(pa.array(texts))[0], 1)
    tally.add(bitmix.windows(pa.array(list(held), pa.string()))[0], 0)
    keys, counts = tally.totals()
    return keys, counts, _shared(keys, counts)


def _shared(keys, counts, share=1 / 200):
    """Contexts with more than ``share`` of the windows are heavy, and counts after them are known."""
    heavy = {}
    for order in range(2, 6):
        some, n = np.unique(bitmix.context(keys, order), return_counts=True)
        heavy[order] = some[n > share * len(keys)]
    deal, rows = bitmix.Deal(heavy), {}
    depth = deal.depth(keys)
    for order in range(1, 6):
        some, at = np.unique(bitmix.suffix(keys[depth > order], order), return_inverse=True)
        rows[order] = some, np.bincount(at, counts[depth > order], len(some)).astype(np.int64)
    return bitmix.Shared(deal, rows)


def test_windows_and_keys():
    texts = ["Ab  cd\n e", None, "", " \t", "x", "  é É z  ", "  lead"]
    w, n = bitmix.windows(pa.array(texts))
    want = [[int.from_bytes(x) for x in plain_windows(t)] for t in texts]
    assert w.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
    keys, counts, _ = _shard(texts * 3)
    assert (bitmix.unpacked_keys(bitmix.packed_keys(keys), len(keys)) == keys).all()
    big = np.array([0, 254, 1 << 40, 70_000])
    assert (bitmix.unpacked(bitmix.packed(big), 4) == big).all()
    assert dict(zip(keys.tolist(), counts.tolist())) == Counter(sum(want, []) * 3)
    table = lmscore.Lookup(keys, counts, np.arange(len(keys)))
    found, known, value = table.find(np.append(keys, [np.uint64(0), np.uint64(5)]))
    assert not found[-2:].any() and found[:-2].all() and (value[:-2] == np.arange(len(keys))).all() and (known == found).all()


def test_bit_probabilities_add_up():
    """Over all bytes that may follow a context, the probabilities add up to one."""
    r = np.random.default_rng(1)
    texts = [" ".join("".join(map(chr, r.integers(97, 101, r.integers(1, 6)))) for _ in range(30)) for _ in range(60)]
    keys, counts, _ = _shard(texts)
    context = keys[len(keys) // 2] & ~np.uint64(255)
    every = np.sort(np.append(keys, np.setdiff1d(context | np.arange(256, dtype=np.uint64), keys)))
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, keys)] = counts
    low, mixer = _shared(every, n), bitmix.Mixer()
    shards = list(bitmix.blocks(every, n, low))
    for _, block in shards:
        block.learn(mixer)
    p = np.zeros(len(every))
    for at, block in shards:
        p[at] = 10 ** block.log10_probabilities(bitmix.Scorer(mixer))
    mine = (every & ~np.uint64(255)) == context
    assert mine.sum() == 256 and p[mine].sum() == pytest.approx(1, abs=1e-5)


def test_bit_counts_are_exact(monkeypatch):
    """No caps, slots or collisions: the counts of every bit are those of the dictionaries."""
    texts = [" ".join(rnd.choice(VOCAB) for _ in range(50)) for _ in range(40)] + ["the of " * 40_000]
    monkeypatch.setattr(bitmix, "BLOCK", 300)
    keys, counts, low = _shard(texts, ["never seen zebra"])
    assert len(low.deal.heavy[2]) > 5 and len(np.unique(low.deal.depth(keys))) > 2
    plain = PlainCounts(texts)
    assert counts.max() > 30_000 and plain.n[b"e", None] > 40_000
    seen = 0
    for at, block in bitmix.blocks(keys, counts, low):
        seen += len(at)
        for j in range(0, len(at), 7):
            w = int(keys[at[j]]).to_bytes(7)
            for i, order in enumerate(bitmix.ORDERS):
                own, other = block.sides[i]
                for k in range(8):
                    assert (own[k][block.at[i][j]], other[k][block.at[i][j]]) == plain.pair(w[-1 - order : -1], w[-1], k)
    assert seen == len(keys)


def test_mixer_learns_as_a_plain_loop():
    """Weights after one online pass, each window left out of the counts that it sees."""
    texts = [prose(12, random.Random(4)), prose(9, random.Random(6))]
    keys, counts, low = _shard(texts)
    mixer = bitmix.Mixer()
    for _, block in bitmix.blocks(keys, counts, low):
        block.learn(mixer)
    assert len(keys) < bitmix.CHUNK  # one step a bit
    plain, weights, squares = PlainCounts(texts), np.full((6, 64), 0.3), np.full((6, 64), 1e-4)
    for k in range(8):
        pull, total = np.zeros((6, 64)), np.zeros(64)
        for key, n in zip(keys, counts):
            bit, _, x, gate = plain_bit(plain, None, None, int(key).to_bytes(7), k, 1)
            z = sum(weights[i][gate] * x[i] for i in range(6))
            total[gate] += n
            pull[:, gate] += n * (bit - 1 / (1 + np.exp(-z))) * np.array(x)
        g = pull / (total + 1e-9)
        squares += g * g
        weights += bitmix.RATE * g / np.sqrt(squares)
    assert np.allclose(mixer.weights, weights, atol=1e-4) and mixer.bytes == counts.sum()
    assert mixer.seen.sum() == 8 * counts.sum()


def test_word_hashes():
    texts = ["Ab  cd", None, "", "ab\tCD\n", "x" * 5000 + " é"]
    w = hashing.Words(pa.array(texts))
    assert w.at.tolist() == [0, 2, 2, 2, 4, 6]
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and len(set(w.hash.tolist())) == 4
    g, doc = hashing.ngrams(w.hash, w.at, (0, 1))
    assert doc.tolist() == [0, 3, 4] and g[0] == g[1] != g[2]


def test_verdict_is_free_of_the_number_of_hosts(spark):
    """A mostly blocked host blocks its unjudged page, among 3,000 as among three."""
    df = spark.range(9_000).selectExpr("id as page_id", "concat('http://h', id div 3, '.net', if(id % 3 = 0, '', '/')) as url", "cast(null as string) as html")
    for n in (9, 9_000):
        got = urlgraph.filtered(df.filter(f"page_id < {n}")).filter("rule is null").groupBy("verdict").count().collect()
        assert [tuple(r) for r in got] == [("block", n // 3)]


# ---------------------------------------------------------------- the pipeline


def plain_kept(text):
    """Quality rules of a text, counted by hand."""
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    if len(w) < 10 or 100 * len(hit) > 20 * len(w):
        return False
    n, m = len(w), len(lines)
    share = lambda pattern: sum(bool(re.search(pattern, x)) for x in lines) / m
    stop = sum(az(x) in quality.STOP_WORDS for x in w) / n if n >= 100 and len(text.encode()) <= 1.5 * len(text) else 1
    return (
        1.5 <= sum(map(len, w)) / n <= 20 and len(re.findall(r"[#*$%&|<>]", text)) / n <= 0.25 and text.count("!!") / n <= 0.25 and stop >= 0.01
        and (m - len(set(lines))) / m <= 0.5 and share(r"^[ \t]*[-*•][ \t]") <= 0.9 and share(r"(\.\.\.|…)[ \t\r]*$") <= 0.5
    )


def plain_dedup(rows):
    strip = lambda x: az(x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, text, *_ in rows:
        for k in {strip(x) for x in (text or "").split("\n")} - {""}:
            seen.setdefault(k, set()).add(i)
    out = []
    for i, text, *rest in rows:
        out.append((i, "\n".join(x for x in (text or "").split("\n") if len(seen.get(strip(x), ())) < 10), *rest))
    return out


def plain_distinct(rows):
    """Of each class the row of least id; rows without words are classes of their own (repeats once)."""
    _, members = brute_classes(rows)
    best = [min((rows[i] for i in m), key=lambda r: (r[0] is None, r[0] or 0)) for m in members.values()]
    worded = [r for r in best if words(r[1])]
    return worded + [r for r in rows if not words(r[1])]


def test_pipeline_by_plain_loops(spark, tmp_path):
    import corpus_pipeline

    more = [(500 + i, prose(14) + "\nCookies help us deliver our pages. \n" + prose(14), "en", f"s{i % 3}", 0) for i in range(11)]
    more += [(520 + i, " !! ".join(prose(30).split()), "de", "s1", 0) for i in range(2)] + [(530, None, "en", None, None), (None, prose(40), None, None, None)]
    rows = ROWS + more
    extra = [F.lit(9).alias(c) for c in ("size", "label", "_row", "_text", "kept", "h", "round")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *extra)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = df.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "source_mix", "packing"]
    pick = lambda d: Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in d.collect())
    mine = lambda rs: Counter((i, t, lang, s) for i, t, lang, s, _ in rs)

    def step(name, want):
        out = stages[name](spark, spark.read.parquet(str(tmp_path / "now")) if (tmp_path / "now").exists() else docs, str(tmp_path))
        assert out.columns == columns
        assert pick(out) == mine(want)
        out.write.mode("overwrite").parquet(str(tmp_path / "next"))
        spark.read.parquet(str(tmp_path / "next")).write.mode("overwrite").parquet(str(tmp_path / "now"))
        return want

    kept = step("quality_rules", [r for r in rows if plain_kept(r[1])])
    assert 0 < len(kept) < len(rows) - 5
    lines = step("line_dedup", plain_dedup(kept))
    assert sum("Cookies" in (r[1] or "") for r in lines) == 0
    one = step("near_duplicates", plain_distinct(lines))
    assert len(one) < len(lines)
    taken = plain_mix(one)[2]
    by_key = {mix_key(r): r for r in one}
    final = step("source_mix", [by_key[e[3]] for e in taken])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    placed, lengths = Counter(), Counter()
    for r in pieces:
        placed[r["doc_id"]] += r["length"]
        lengths[r["sequence_id"]] += r["length"]
    want = Counter()
    for r in final:
        want[r[0]] += len(plain_ids(r[1])) + 1
    assert placed == want and max(lengths.values()) <= 4096
    assert all(zlib.crc32(np.array([*plain_ids(r[1]), 2], "<u4").tobytes()) in {p["ids_crc32"] for p in pieces if p["doc_id"] == r[0]} for r in final if len(plain_ids(r[1])) < 200)


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline

    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
