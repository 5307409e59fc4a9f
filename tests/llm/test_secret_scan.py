"""Secret scans: base spans against the plain patterns, Viterbi against all sequences, held-out secrets that no pattern knows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepsake.llm import secret_scan
from keepsake.llm.secret_scan import Field, base_spans, report, spans, tagged, train

PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}
WORDS = "the of and river stone walks slowly under old bridge token of love secret garden password for api".split()


def secret(rng, kind):
    return "".join(rng.choice("0123456789abcdef" if kind == "hex" else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40 if kind == "hex" else 32))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) * (rng.random() < 0.1) for _ in range(n))


def texts(seed, n, form):
    rng = random.Random(seed)
    return [f"{prose(rng, rng.randint(5, 60))} {form.format(secret(rng, rng.choice(['hex', 'mixed'])))} {prose(rng, rng.randint(5, 60))}" for _ in range(n)]


EDGES = [None, "", " \n\t ", "token=", "token = short", 'TOKEN: "abc.def=="', "api_key='x/y+z-12' apikey=123456", "AKIA" + "A" * 15, "AKIA" + "Z9" * 9 + "é token=ſecret12", "ſecret: abcdefgh Key", "é\U0001f600 secret=abcdef0123456789abcdef0123", "a" * 5000, "f" * 23 + " " + "f" * 24, "x" * 30_000 + " password=hunter22", "token=AKIA" + "Q" * 16 + " passwd : : x", "secretsecret=secret=secretsecret"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [*EDGES, EDGES[5], *texts(2, 40, 'token = "{}"'), *texts(3, 20, "password: {}"), *(prose(rng, rng.randint(0, 80)) for _ in range(150))]
    df = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(rows)], "doc_id long, text string")
    return df.select("*", *(F.lit("clash").alias(c) for c in ("spans", "t", "u", "h", "n", "lang", "kind"))).repartition(4)


@pytest.fixture(scope="module")
def field(docs):
    return train(docs)


def plain(text):
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(PLAIN.values()) for m in p.finditer(text) if ok(m)]
    return [f"{list(PLAIN)[k]}:{a}:{z}" for a, k, z in sorted(found)]


def test_base_spans(docs, field):
    rows = report(spans(docs, field)).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) > 150
    for r in rows:
        want = plain(r.text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in PLAIN)
        assert [x for x in r.spans.split(",") if x and not x.startswith("crf")] == want
        starts = [int(x.split(":")[1]) for x in r.spans.split(",") if x]
        assert starts == sorted(starts) and r.n_crf == r.spans.count("crf:")
    assert report(spans(docs, field)).count() == docs.count()


def test_base_spans_of_random_texts():
    rng = random.Random(8)
    parts = ["token", "TOKEN", "api_key", "apikey", "passwd", '"', "'", " ", "=", ":", "AKIA", "ABC123", "abc", "0123456789abcdef" * 2, "é", ".", "\n", "secret"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        assert [f"{k}:{a}:{z}" for a, z, k, _, _ in base_spans(text)] == plain(text)
        assert [f"{k}:{a}:{z}" for a, z, k, _, _ in secret_scan._bases(pa.array([text]))[0]] == plain(text)


@pytest.mark.parametrize("form", ["bearer <{}>", 'key = "{}";', "access code '{}' (old)"])
def test_finds_secrets_that_no_pattern_knows(field, form):
    held = texts(99, 60, form)
    held = [t for t in held if not plain(t)]
    right = 0
    for t, found in zip(held, tagged(pa.array(held), field)):
        want = max(re.finditer("[A-Za-z0-9]+", t), key=lambda m: m.end() - m.start()).span()
        right += found == [want]
    assert len(held) > 10 and right >= 0.9 * len(held)


def test_leaves_clean_texts_alone(field):
    rng = random.Random(77)
    clean = [prose(rng, 60) for _ in range(200)]
    assert sum(map(bool, tagged(pa.array(clean), field))) <= 2


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(4)
    for k in range(60):
        field = Field(np.zeros((1, 12), np.float32), np.zeros((1, 3)), rng.normal(0, 1.5, (3, 3)))
        sizes = rng.integers(1, 7, 4)
        doc = np.repeat(np.arange(4), sizes)
        scores = rng.normal(0, 3, (len(doc), 3)) + (np.array([4.0, 0, 0]) if k % 2 else 0)
        got = field.tags(scores, doc)
        for d in range(4):
            at = np.flatnonzero(doc == d)
            worth = lambda y: sum(scores[a, t] for a, t in zip(at, y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            assert abs(worth(tuple(got[at])) - max(worth(y) for y in itertools.product(range(3), repeat=len(at)))) < 1e-6


def test_features_stay_inside_their_texts():
    """A text's tags do not depend on the texts beside it, and offsets count code points."""
    some = ["é token", "", "\U0001f600 ab12cd", "x"]
    starts, ends, doc, own, file, s, e = secret_scan._parsed(pa.array(some))
    assert [some[d][a:z] for d, a, z in zip(doc, s, e)] == ["é", "token", "\U0001f600", "ab12cd", "x"]
    for k, t in enumerate(some):
        alone = secret_scan._parsed(pa.array([t]))
        assert (alone[3] == own[doc == k]).all() and (alone[4][0] == file[k]).all()


def test_nothing_to_learn_and_empty(spark, docs):
    clean = spark.createDataFrame([(1, "only words"), (2, None)], "doc_id long, text string")
    assert {r.spans for r in report(spans(clean, train(clean))).collect()} == {""}
    assert report(spans(docs.limit(0), train(docs.limit(0)))).count() == 0


def test_long_run_of_odd_tokens(field):
    """Thousands of tokens that may be secret: the same as a plain walk."""
    rng = random.Random(5)
    text = " ".join(rng.choice(["<{}>", "{}", "token {}", '"{}"']).format(secret(rng, "mixed")) for _ in range(3000))
    _, _, doc, own, file, _, _ = secret_scan._parsed(pa.array([text]))
    scores = field.scores(own, doc, file)
    best = scores[0]
    for x in scores[1:]:
        best = (best[:, None] + field.move).max(0) + x
    tags = field.tags(scores, doc)
    worth = scores[np.arange(len(tags)), tags].sum() + field.move[tags[:-1], tags[1:]].sum()
    assert len(tags) > 5000 and abs(worth - best.max()) < 1e-3 * len(tags) ** 0.5 and (tags > 0).any()
