"""Secret scans: patterns against plain matching, the field against plain sums over all paths."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.llm import secretcrf as crf
from trackloom.llm.common import take

SCHEMA = "doc_id long, text string"
r = random.Random(4)
WORDS = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(300)] + ["über", "naïve", "日本", "the", "a"]


def prose(n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def random_of(letters, n):
    return "".join(r.choice(letters) for _ in range(n))


HEX, BASE62 = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
FORMS = [
    lambda: f'token = "{random_of(HEX, 40)}"', lambda: f"password={random_of(HEX, 18)}", lambda: "AKIA" + random_of("ABCDEFGHIJ234567", 16), lambda: random_of(HEX, 64),
    lambda: f"API_KEY: '{random_of(BASE62, 24)}'", lambda: "token=token:abcdefgh1", lambda: "secret = short", lambda: "AKIA1234", lambda: "ſecret=abcdefghij toKen=abcdefghij",
    lambda: f"card {random_of('0123456789', 16)}", lambda: "10.20.30.40 and 2024-05-06 07:08:09", lambda: "x-passwd:" + "z" * 900,
]


def made():
    rows = [(i, prose(r.randint(5, 60)) + " " + (FORMS[i % len(FORMS)]() if i % 3 else "") + " " + prose(r.randint(3, 30))) for i in range(600)]
    return rows + [(900, None), (901, ""), (902, " \n"), (None, FORMS[0]()), rows[1], (903, prose(20000) + FORMS[0]())]


ROWS = made()


def plain_base(text):
    kinds = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    out = []
    for k, (name, pattern) in enumerate(kinds.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2] if k == 0 else m[0]) >= (8, 16, 32)[k]:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(7).alias(n) for n in ("TEXT", "_id", "kind", "key", "spans")]).cache()


def test_base_equals_plain_patterns_and_stays(docs):
    got = crf.digest(docs).collect()
    assert len(got) == len(ROWS)
    text = dict(ROWS)
    for row in got:
        base = plain_base(text[row["doc_id"]])
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = row["spans"].split(",") if row["spans"] else []
        assert [s for s in spans if not s.startswith("crf")] == base
        places = [(int(s.split(":")[1]), crf.KINDS.index(s.split(":")[0])) for s in spans]
        assert places == sorted(places)


def test_new_forms_are_found_and_clean_texts_left_alone(docs, spark):
    field = crf.fit(take(docs, _text="text"))
    new = [f"{prose(20)} {form} {prose(20)}" for _ in range(20) for form in (f"passphrase '{random_of(BASE62, 30)}'", f"Bearer {random_of(HEX, 30)} ok", f"ghp_{random_of(BASE62, 28)}")]
    clean = [prose(200) + f" {random_of('0123456789', 16)} " + prose(20) for _ in range(60)]
    spans = crf.found(pa.array(new + clean, pa.large_string()), field)
    assert sum(any(k == 3 for k, _, _ in s) for s in spans[:60]) >= 54
    assert not any(spans[60:])


def test_the_sample_does_not_depend_on_partitions(docs):
    text = take(docs, _text="text")
    one, two = ({(x["kind"], x["key"]) for x in crf.training_sample(text.repartition(n), 40).collect()} for n in (1, 7))
    assert one == two
    assert max(sum(k == kind for k, _ in one) for kind in (1, 2, 3)) <= 40


def test_nothing_to_learn_adds_nothing(spark):
    assert crf.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    got = crf.digest(spark.createDataFrame([(1, "just words"), (2, None)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "") for i in (1, 2)]


def all_paths(field, scores):
    for tags in itertools.product(range(3), repeat=len(scores)):
        total = field.first[tags[0]] + sum(scores[t, k] for t, k in enumerate(tags)) + sum(field.steps[a, b] for a, b in zip(tags, tags[1:]))
        yield tags, total


def random_field(g):
    return crf.Field(np.zeros((2, 2), np.float32), g.normal(size=(3, 3)), g.normal(size=3))


def test_gradients_equal_sums_over_all_paths():
    g = np.random.default_rng(0)
    field = random_field(g)
    scores, length = g.normal(size=(3, 5, 3)), np.array([5, 3, 1])
    tags = g.integers(0, 3, (3, 5))
    by_score, by_step, by_first = crf.gradients(field, scores, length, tags)
    want = [np.zeros((3, 5, 3)), np.zeros((3, 3)), np.zeros(3)]
    for k, n in enumerate(length):
        paths = list(all_paths(field, scores[k, :n]))
        share = np.exp([t for _, t in paths])
        share /= share.sum()
        for path, p in [*((x, p) for (x, _), p in zip(paths, share)), (tuple(tags[k, :n]), -1.0)]:
            want[2][path[0]] += p
            for t, tag in enumerate(path):
                want[0][k, t, tag] += p
            for a, b in zip(path, path[1:]):
                want[1][a, b] += p
    for x, y in zip((by_score, by_step, by_first), want):
        np.testing.assert_allclose(x, y, atol=1e-9)


def test_cut_decoding_is_viterbi():
    g = np.random.default_rng(1)
    for k in range(200):
        field = random_field(g)
        sizes = g.integers(0, 8, 4)
        at = np.concatenate([[0], np.cumsum(sizes)])
        scores = g.normal(size=(at[-1], 3)) * 3 - np.array([0, 1, 1]) * (k % 5)
        scores[:, 0] = 0
        got = crf.best_tags(field, scores, at)
        for a, b in zip(at, at[1:]):
            if b > a:
                assert tuple(got[a:b]) == max(all_paths(field, scores[a:b]), key=lambda p: p[1])[0]
