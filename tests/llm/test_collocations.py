"""Collocations against brute force, and the filters that count them."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import collocations
from keepsake.llm.collocations import Keys, packed, phrases, ranked, summed, unpacked

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(7)
    words = "new york old town the a of by river Ärger ﬁn".split()
    out = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ". ", "\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    return [*out, ("New York NEW york", "en"), ("New York NEW york", "en"), (None, "en"), ("", None), (" \t . ", "de"), ("x " * 5000, "xx"), ("one\x0btwo\x0cone\x00 two", "en"), ("alone", "zz")]


def brute(rows, least, longest, most):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in counts.items() if len(p[1]) >= 2 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(q[0] == lang and len(q[1]) > len(p) and b >= a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q, b in cand.items()):
            continue
        score, k = min((1000 * a * sizes[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], sizes[lang]))
    return sorted((lang, r, p.decode(), -a, l, rr, n, -s) for lang, ps in out.items() for r, (s, a, p, l, rr, n) in enumerate(sorted(ps)[:most], 1))


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(k if k % 5 else None, t, lang, "s", 0) for k, (t, lang) in enumerate(texts())], COLUMNS)
    return df.select("*", *(F.lit("clash").alias(c) for c in ("ids", "a", "l", "r", "n", "word", "phrase", "score", "rank", "t", "cut", "c"))).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least,most,dictionary", [(4, 2000, 1000), (4, 7, 0), (2, 50, 1000)])
def test_is_brute_force(docs, least, most, dictionary):
    assert got(ranked(phrases(docs, least=least, dictionary=dictionary), most)) == brute(texts(), least, 5, most)


def test_small_filters_and_bitmaps_change_nothing(docs, monkeypatch):
    """A full bitmap lets everything through; filters that are sent early are merged."""
    want = brute(texts(), 3, 5, 2000)
    monkeypatch.setattr(collocations, "HELD", 1)
    monkeypatch.setattr(collocations, "_bitmap", lambda grams: (np.full(1 << 12, 255, np.uint8), 15))
    assert got(ranked(phrases(docs, least=3))) == want


def test_empty(docs):
    assert ranked(phrases(docs.limit(0))).count() == 0


@pytest.mark.parametrize("most,n", [(1, 2), (300, 5), (5000, 5), (1 << 20, 5), ((1 << 31) - 1, 5), ((1 << 31) - 1, 2)])
@pytest.mark.parametrize("lead", [5, 13])
def test_filters_lose_nothing(most, n, lead):
    rng = np.random.default_rng(most + n)
    keys = Keys(n, most)
    runs = rng.integers(1, most + 1, 3000).astype(np.int32)
    at = rng.integers(0, 3000 - n, 4000)
    columns, c = summed(keys.of(runs, at), rng.choice([1, 254, 255, 256, 1 << 40], 4000))
    block = (columns[0] >> np.uint64(64 - lead)).astype(int)
    back = [unpacked(packed([x[block == b] for x in columns], c[block == b], lead), lead, int(b)) for b in np.unique(block)]
    whole = [np.concatenate(x) for x in zip(*(b[0] for b in back))]
    assert all((x == y).all() for x, y in zip(whole, columns)) and (np.concatenate([b[1] for b in back]) == c).all()
    assert {tuple(x) for x in keys.numbers(whole)} == {tuple(runs[k : k + n]) for k in at}
