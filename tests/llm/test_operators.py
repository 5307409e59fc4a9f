"""The training-data operators on small fixtures: against brute force, with edge cases."""

import base64
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepsake.llm import fingerprints, hilbert_search, mixing, ngram_join, pii, sentencepiece_codec, sharding, token_counts, toxicity, warc
from keepsake.llm.common import scratch, span_hashes, text_bytes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside.
CLASHES = ("digest", "size", "rep", "doc", "score", "h", "g", "key", "t", "times", "target", "ids", "decoded", "nxt", "b", "shard", "positive", "features", "_n")


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x)


def edge_texts():
    rng = random.Random(5)
    base = " ".join(rng.choice("alpha beta gamma delta rho tau phi chi psi omega".split()) + str(rng.randint(0, 99)) for _ in range(160))
    near = base.replace(base.split()[40], "CHANGED", 1)
    far = " ".join(rng.sample(base.split(), 160))
    return [base, base, near, far, None, "", "   \n\t ", "one", "one two three", "One Two Three", "one two three four five", "a" * 20_000, "x " * 6000, "été İ ﬁn \U0001f600 ok", base + " tail", near + " tail"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", ["b", "a", None, "\U0001f600", "￮"][k % 5], len(t or "")) for k, t in enumerate(edge_texts())]
    rows.append(rows[1])  # a repeated row
    df = spark.createDataFrame(rows, COLUMNS)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES)).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(text, width):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(texts, width, percent):
    sets = {k: shingles(t, width) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
            links[a] += 1
            links[b] += 1
    return {k: (len(sets[k]), find(k), links[k]) for k in sets}


def joined(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(df, **options).collect()}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_ngram_join_is_brute_force(spark, docs, width, percent):
    texts = dict(enumerate(edge_texts()))
    got = joined(docs, width=width, percent=percent)
    assert got == brute_components(texts, width, percent)


def test_ngram_join_on_a_chain_of_edits(spark, monkeypatch):
    """Neighbours link, the ends don't: one component through many links; unlinked copies share keys with it."""
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = {}
    for k in range(60):
        if k:
            words[rng.randrange(150)] = f"n{k}"
        texts[k * 7 % 61] = " ".join(words)
    for k in range(100, 130):
        texts[k] = " ".join(w if rng.random() > 0.06 else f"z{rng.random()}" for w in words)
    texts[200], texts[201] = texts[0].upper(), texts[0].replace(" ", "  ")  # other texts, the same set
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert joined(df) == brute_components(texts, 4, 85)
    for name in ("CHUNK_POINTS", "CHUNK_SETS"):
        monkeypatch.setattr(ngram_join, name, 7)
    assert joined(df) == brute_components(texts, 4, 85)


def test_group_keys_always_meet():
    rng, bands = np.random.default_rng(3), ngram_join.Bands(85)
    for size in (1, 2, 5, 7, 12, 20, 33, 64, 150, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            b = a.copy()
            while True:
                c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 2**63, dtype=np.uint64)))
                i = len(np.intersect1d(a, c))
                if 100 * i < 85 * (len(a) + len(c) - i):
                    break
                b = c
            assert set(bands.keys(a).tolist()) & set(bands.keys(b).tolist())


def test_tree_finds_what_links_alone_would():
    """The tree met with itself loses no linked pair, with sides or without; overlaps are exact both ways."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 400, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(400) < 0.04, rng.integers(0, 2**62, 400, dtype=np.uint64), base)) for _ in range(90)]
    sets += [np.unique(rng.integers(0, 2**62, int(rng.integers(1, 900)), dtype=np.uint64)) for _ in range(60)]
    upto = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    side = np.arange(len(sets)) % 2
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    n = np.diff(upto)
    want = {(i, j) for i, j in zip(*np.triu_indices(len(sets), 1), strict=True) if 100 * both[i, j] >= 85 * (n[i] + n[j] - both[i, j])}
    assert len(want) > 100
    flat = np.concatenate(sets)
    for s in (None, side):
        found = [(min(p), max(p)) for x, y in ngram_join.linked(flat, upto, s, 85) for p in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == {p for p in want if s is None or s[p[0]] != s[p[1]]}
    for x, y in (np.triu_indices(len(sets), 1), (np.array([3, 100]), np.array([7, 140]))):
        assert (ngram_join.overlaps(flat, upto, x, y) == both[x, y]).all()


def test_near_duplicates_dropped(spark, docs, empty):
    out = ngram_join.near_duplicates_dropped(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    want = brute_components(dict(enumerate(edge_texts())), 5, 80)
    assert set(ids) == {k for k, (n, c, _) in want.items() if n == 0 or c == k}
    assert ngram_join.near_duplicates_dropped(empty).count() == 0


def test_word_spans():
    raw, at = text_bytes(pa.array(["ab c", None, "", " d", "e"]))
    begins, ends, first = word_spans(raw, at)
    assert [bytes(raw[a:b]) for a, b in zip(begins, ends)] == [b"ab", b"c", b"d", b"e"]
    assert first.tolist() == [0, 2, 2, 2, 3, 4]
    h = span_hashes(raw, np.array([0, 3]), np.array([2, 4]))
    assert h[0] != h[1]


def test_sentencepiece_is_the_library(spark, docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    out = {r["doc_id"]: r for r in sentencepiece_codec.with_digests(sentencepiece_codec.encode_decode(docs.select("doc_id", "text"))).collect()}
    for k, t in enumerate(edge_texts()):
        ids = model.encode(t or "")
        assert out[k]["n_tokens"] == len(ids)
        assert out[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[k]["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_decode(empty).count() == 0
    kept = sentencepiece_codec.encode_decode(docs)
    assert {"ids", "decoded", "digest"} <= set(kept.columns) and kept.count() == len(edge_texts()) + 1


def test_sentencepiece_on_long_stretches():
    """Without blanks to cut at: windows that agree, windows of a period, and one after the other."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    table, rng = sentencepiece_codec.prefix_table(sentencepiece_codec.default_model()), random.Random(6)
    texts = ["a" * 6000, "abc" * 2000, "=" * 3000 + "-" * 3000, "".join(rng.choice("ab") for _ in range(5000)), base64.b64encode(rng.randbytes(9000)).decode(), "中é" * 1500, "x" * 1025]
    texts.append("".join(rng.choice(table.pieces[259:12000]).replace("▁", "") for _ in range(2000)))
    ids, upto = table.encode(texts)
    for k, t in enumerate(texts):
        assert ids[upto[k] : upto[k + 1]].tolist() == model.encode(t)


def test_sentencepiece_on_random_pieces():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    table, rng = sentencepiece_codec.prefix_table(sentencepiece_codec.default_model()), random.Random(4)
    texts = ["".join(rng.choice(table.pieces[259:12000]) for _ in range(rng.randint(1, 9))).replace("▁", " ") for _ in range(3000)]
    texts += ["".join(rng.choice("abcdeé st\n\t\x00\U0001f600中.-=") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    ids, upto = table.encode(texts)
    back = table.decode(ids, upto)
    for k, t in enumerate(texts):
        want = model.encode(t)
        assert ids[upto[k] : upto[k + 1]].tolist() == want and back[k] == model.decode(want)


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    for dim, n in ((64, 3000), (8, 2000)):
        x = rng.standard_normal((n, dim))
        rows = [(k, v.tolist()) for k, v in enumerate(x)]
        odd = [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [None] * dim), (n + 4, [1.0])]
        found = hilbert_search.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).toPandas()
        hits = total = 0
        for q in range(0, n, 100):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            mine = found[found.query_id == q].sort_values("rank")
            assert mine["rank"].tolist() == list(range(1, 11)) and (mine.score.diff().dropna() >= 0).all()
            assert np.allclose(mine.score, d[mine.vec_id])
            hits += len(set(mine.vec_id) & set(np.argsort(d)[:10].tolist()))
            total += 10
        assert hits / total >= 0.9


def test_nearest_neighbours_prune_clusters(spark):
    """On clustered vectors small windows compare under a tenth of the rows and still find the neighbours."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((80, 32))
    x = (centres[rng.integers(0, 80, 6000)] + 0.05 * rng.standard_normal((6000, 32))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("score", F.lit("clash"))
    found = hilbert_search.search(df, curves=3, window=0.01, ranges=200).toPandas()
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(found[found.query_id == q].vec_id) & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 >= 0.9
    assert found.drop_duplicates("query_id").compared.mean() < 600


def test_nearest_neighbours_ties_and_few(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])]
    got = hilbert_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 2), (0, 2, 3)]
    assert hilbert_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: 1 + k % 3 for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > 3 * sizes[s] + 1e-9}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark, docs, empty):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randint(0, 300), "en", rng.choice([None, "￮", "\U0001f600", "aa", "b", "tiny"] if k % 40 else ["zz"]), 1) for k in range(3000)]
    rows = [r for r in rows if r[3] != "tiny" or r[0] % 30 == 0]
    df = spark.createDataFrame(rows, COLUMNS)
    out = mixing.plan(df).toPandas()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want = brute_targets(sizes)
    largest = max(len(r[1].split()) for r in rows)
    for s, part in out.groupby(out.source.fillna("null")):
        s = None if s == "null" else s
        assert part["size"].sum() == sizes[s] == part.source_size.iloc[0]
        assert part.target.iloc[0] == pytest.approx(want[s])
        assert abs((part["size"] * part.times).sum() - want[s]) <= largest
    assert out.times.max() <= 3
    again = mixing.plan(df.repartition(7)).toPandas()
    assert dict(zip(out.doc_id, out.times)) == dict(zip(again.doc_id, again.times))
    assert mixing.plan(empty).count() == 0
    twice = spark.createDataFrame([(k % 500, "w " * 50, "en", "ab"[k % 2], 1) for k in range(1000)], COLUMNS)
    assert sorted(mixing.mix(twice).collect()) == sorted(mixing.mix(twice.repartition(5)).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {r["doc_id"]: r["times"] for r in mixing.plan(docs).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.filter("doc_id <> 1").groupBy("doc_id").count().collect()} == {k: v for k, v in times.items() if v and k != 1}


def test_fingerprints(spark, docs, empty):
    out = fingerprints.fingerprints(docs).toPandas()
    order = sorted([(k, t or "") for k, t in enumerate(edge_texts())] + [(1, edge_texts()[1])], key=lambda r: r[0])
    texts = [t for _, t in order]
    for i, (k, t) in enumerate(order):
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[(i + 1) % len(texts)][:q]
        mine = out[out.doc_id == k]
        assert hashlib.sha256(edited.encode()).hexdigest() in set(mine.edited_sha256)
        assert set(mine.n_chars) == {len(t)}
    name = out.drop_duplicates("doc_id").set_index("doc_id").fingerprint
    assert name[0] == name[1] and name[4] == name[5] == name[6] and name[8] == name[9] and name[0] != name[2]
    assert set(out.near_edited) | set(out.near_next) <= {0.0, 1.0}
    assert out[out.doc_id == 0].near_next.iloc[0] == 1.0
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprints_fold_unicode(spark):
    pairs = [("Été  ﬁn", "été fin"), ("STRASSE", "straße"), (" a b\n", "A b")]
    df = spark.createDataFrame([(k, t) for p in pairs for k, t in enumerate(p)], "k int, t string")
    got = [r["c"] for r in df.select(fingerprints.canonical(F.col("t")).alias("c")).collect()]
    assert all(a == b for a, b in zip(got[::2], got[1::2]))


def test_next_texts_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    ids = random.Random(1).sample(range(100_000), 300)
    df = spark.createDataFrame([(k, f"t{k}", "") for k in ids], "doc_id long, text string, tie string").repartition(6)
    for name, few in (("CUTS", 128), ("CUTS", 7), ("PARTS", 3)):
        monkeypatch.setattr(fingerprints, name, few)
        got = {r["doc_id"]: r["next_text"] for r in fingerprints.next_rows(df, ["text"]).collect()}
        ids.sort()
        assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}
    odd = [(None, "b", "2"), (None, "a", "1"), (5, "d", "2"), (5, "c", "1"), (2**62, "e", "1"), (-(2**62), "z", "1")]
    got = {r["text"]: r["next_text"] for r in fingerprints.next_rows(spark.createDataFrame(odd, "doc_id long, text string, tie string"), ["text"]).collect()}
    assert got == {"a": "b", "b": "z", "z": "c", "c": "d", "d": "e", "e": "a"}


def test_a_colliding_bucket_is_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest128", lambda c: F.lit("0" * 32))
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "A ")], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    assert f[0] == f[2] != f[1]


def test_an_edited_text_collides_with_a_text(spark, monkeypatch):
    """Document 1's edited text falls into the bucket of document 3, whose text is another: both are told apart. Document 5's edited text is document 7's text."""
    plain = fingerprints.digest128
    monkeypatch.setattr(fingerprints, "digest128", lambda c: F.when(c.isin("abcx", "other"), F.lit("f" * 32)).otherwise(plain(c)))
    texts = ["abcd", "xyz", "other", "pqrs", "tuv", "pqrt"]
    df = spark.createDataFrame([(2 * k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    assert out[1]["edited_fingerprint"].startswith("f" * 32) and out[5]["fingerprint"].startswith("f" * 32)
    assert out[1]["edited_fingerprint"] != out[5]["fingerprint"]
    assert out[7]["edited_fingerprint"] == out[11]["fingerprint"]
    assert out[3]["near_edited"] == 1.0 and out[1]["near_edited"] == 0.0


def test_token_counts(spark, docs, empty):
    texts = dict(enumerate(edge_texts()))
    enc, _ = token_counts.encoder(token_counts.default_ranks())
    for rule in token_counts.RULES:
        table = token_counts.counts_by_section(token_counts.section_counts(docs, fields=("source", "text"), joint=" ", rule=rule)).toPandas()
        sources = {r["doc_id"]: r["source"] for r in docs.collect()}
        for k, t in texts.items():
            mine = table[table.doc_id == k]
            whole = f"{sources[k] or ''} {t or ''}"
            assert mine.n_tokens.sum() == pytest.approx(len(enc.encode_ordinary(whole)) * (2 if k == 1 else 1))
            assert mine.n_bytes.sum() == len(whole.encode()) * (2 if k == 1 else 1)
    assert token_counts.section_counts(empty).count() == 0


def test_token_counts_of_each_section(spark, docs):
    """Every section's count, by walking the characters."""
    enc, _ = token_counts.encoder(token_counts.default_ranks())
    table = token_counts.counts_by_section(token_counts.section_counts(docs.filter("doc_id <> 1"), fields=("source", "text"), joint=" ", rule="most")).toPandas()
    for r in docs.filter("doc_id <> 1").collect():
        whole = f"{r['source'] or ''} {r['text'] or ''}"
        cut = len(r["source"] or "") + 1
        section, k = [], 0
        for i, c in enumerate(whole):  # the section of each character: fields, then lines
            if i == cut or i and whole[i - 1] == "\n":
                k += 1
            section.append(k)
        want = [0] * ((section[-1] if section else 0) + 1 + (cut == len(whole)))
        begin = -1
        for t in enc.encode_ordinary(whole):
            own = [0] * len(want)
            for byte in enc.decode_single_token_bytes(t):
                if byte & 0xC0 != 0x80:
                    begin += 1
                    own[section[begin]] += 1
            want[own.index(max(own)) if max(own) else section[begin]] += 1
        mine = table[table.doc_id == r["doc_id"]].sort_values("section")
        assert mine.n_tokens.tolist() == want and mine.n_chars.sum() == len(whole)


def test_token_rules():
    sizes, ends = np.array([3, 4, 2]), np.array([4, 9])  # tokens 0-3, 3-7, 7-9; sections 0-4, 4-9
    assert token_counts.attributed(sizes, ends, "most")[0].tolist() == [1, 2]
    assert token_counts.attributed(sizes, ends, "start")[0].tolist() == [2, 1]
    assert token_counts.attributed(sizes, ends, "split")[0].tolist() == [1.25, 1.75]
    assert token_counts.attributed(np.array([4]), np.array([2, 4]), "most")[0].tolist() == [1, 0]
    assert token_counts.attributed(sizes, ends, "most")[1].tolist() == [1, 1]


def test_toxicity_held_out(spark, docs, empty):
    rng = random.Random(8)
    insults = ["clod", "oaf", "twit"]
    rows, labels = [], []
    for k in range(3000):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))]
        toxic = rng.random() < 0.12
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(insults))
        rows.append((k, " ".join(words), "en", "s", 1))
        if rng.random() < 0.6:
            labels.append((k, 1, int(toxic)))
    df, lab = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    out = toxicity.scored(df, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).join(lab, "doc_id").filter("held").toPandas()
    hit = out.score >= 0.3
    assert (hit & (out.toxic == 1)).sum() >= 0.95 * (out.toxic == 1).sum()
    assert (hit & (out.toxic == 0)).sum() <= 0.03 * (out.toxic == 0).sum()
    assert out.score.between(0, 1).all()
    got = toxicity.scored(docs, model)
    assert got.count() == len(edge_texts()) + 1 and got.filter("score is null").count() == 0
    bare = toxicity.train(empty, lab.limit(0))
    assert toxicity.scored(docs.select("doc_id", "text"), bare).agg(F.max("score")).first()[0] < 0.01


def test_shards(spark, docs, empty):
    rng = random.Random(3)
    rows = [(k, "hot" if k % 3 == 0 else f"t{rng.randint(0, 400)}", "en", "s", 1) for k in range(2000)]
    out = sharding.shard(spark.createDataFrame(rows, COLUMNS)).toPandas()
    counts = out.groupby("shard").size()
    assert len(counts) == 16 and counts.max() - counts.min() <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    split = out.groupby("group_id").shard.nunique()
    assert (split > 1).sum() <= 16
    small = sharding.shard(docs).toPandas()
    assert len(small) == len(edge_texts()) + 1
    import zlib

    texts = edge_texts()
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for _, r in small.iterrows())
    assert sharding.shard(empty).count() == 0


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    tricky = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\n"
    html = ["<html>a</html>", "<html>a</html>", tricky, "", None, "x" * 200_000, "\n", "\r\n", "é \u0085", tricky, "no end\r"]
    rows = [(k * 3, f"http://e.x/{k}\r\nX: y", h) for k, h in enumerate(html)]
    path = scratch(spark, "warc")
    warc.write(warc.records(spark.createDataFrame(rows, PAGES)), path)
    chunks = warc.read_chunks(spark, path, chunk=1000)
    got = {r["page_id"]: r for r in warc.page_table(chunks).collect()}
    best = {}
    for k, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), k)
    assert len(got) == len(rows)
    for k, _, h in rows:
        raw = (h or "").encode()
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if best[h or ""] == k else ("revisit", best[h or ""]))
    table = chunks.filter("kind = 'response'").toPandas()
    assert table.data.map(len).max() <= 1000
    for _, part in table.groupby("record_id"):
        part = part.sort_values("chunk_no")
        raw = b"".join(map(bytes, part["data"]))
        last = part.iloc[-1]
        assert last["last"] and last.bytes_so_far == len(raw) and last.sha1_so_far == base64.b32encode(hashlib.sha1(raw).digest()).decode() == last.stated_digest


def test_warc_segments(spark):
    """Payloads over a segment go on in continuations: no line is longer, line ends or not, and copies refer to the whole."""
    html = ["x" * 5000, "x" * 5000, "é\n" * 1500, "y" * 1000, "y" * 1001, ""]
    df = spark.createDataFrame([(k, f"http://e.x/{k}", h) for k, h in enumerate(html)], PAGES).withColumn("sha1", F.lit("clash")).withColumn("kind", F.lit("clash"))
    path = scratch(spark, "warc")
    warc.write(warc.records(df), path, segment=1000)
    lines = spark.read.option("lineSep", "\n").text(path)
    assert lines.agg(F.max(F.octet_length("value"))).first()[0] <= 1001
    assert lines.filter("value like 'WARC-Segment-Origin-ID%'").count() == 4 + 4 + 1
    got = {r["page_id"]: r for r in warc.page_table(warc.read_chunks(spark, path, chunk=300, with_data=False)).collect()}
    for k, h in enumerate(html):
        raw = h.encode()
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert got[k]["refers_to"] == (1 if k == 0 else None)
    data = warc.read_chunks(spark, path, chunk=300).filter("kind = 'response'").toPandas()
    whole = {b"".join(map(bytes, p.sort_values("chunk_no")["data"])).decode() for _, p in data.groupby("record_id")}
    assert whole == set(html) and data.data.map(len).max() <= 300


def test_warc_edges(spark):
    path = scratch(spark, "warc")
    rows = [(None, None, "a"), (None, None, "a"), (1, "u", "a"), (1, "u", "b"), (2, "u", "c")]
    warc.write(warc.records(spark.createDataFrame(rows, PAGES), least=5), path)
    got = warc.page_table(warc.read_chunks(spark, path)).collect()
    assert sorted((r["page_id"] or -1, r["record_type"]) for r in got) == [(-1, "response"), (1, "response"), (1, "response"), (2, "response")]
    none = scratch(spark, "warc")
    warc.write(warc.records(spark.createDataFrame([], PAGES)), none)
    assert warc.read_chunks(spark, none).count() == 0


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def pii_texts():
    rng = random.Random(6)
    fixed = ["a@b.c@d.e", "a@b.c_x@y.z", "x@y", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (736) 555-0100 and +44", "\U0001f600 me@ex.am.ple, 10.0.0.1", "9" * 30_000, "4111111111111111 4111111111111111", "a" * 30_000 + "@b.c", "++1 2345678", "1.2.3.4a@b.c-d@e.f"]
    return fixed + ["".join(rng.choice("ab1.2@-+ (9)_\né") for _ in range(rng.randint(0, 80))) for _ in range(400)]


def test_pii_base_is_brute_force(spark, docs, empty):
    texts = dict(enumerate(pii_texts()))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("terms", F.lit(1))
    out = {r["doc_id"]: r for r in pii.report(pii.spans(df)).collect()}
    for k, t in texts.items():
        want = brute_spans(t)
        assert out[k]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest(), t
        assert [out[k][f"n_{kind}"] for kind, _ in KINDS] == [sum(a == kind for a, _, _ in want) for kind, _ in KINDS]
    assert pii.report(pii.spans(docs)).count() == len(edge_texts()) + 1
    assert pii.report(pii.spans(empty)).count() == 0
    same = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert same == dict(enumerate(edge_texts()))


def test_pii_long_texts(spark):
    """A log of numbers and addresses of a megabyte is found and masked as by brute force, in linear time."""
    text = " ".join(f"10.0.{k % 256}.{k % 199} {k} a{k}@b.cd" if k % 3 else f"{k}.{k} +49 30 {1000000 + k}" for k in range(40_000))
    df = spark.createDataFrame([(0, text), (1, "x")], "doc_id long, text string")
    out = pii.report(pii.spans(df)).filter("doc_id = 0").first()
    want = brute_spans(text)
    assert out["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
    cuts = sorted((a, b, k) for k, a, b in want)
    pieces, at = [], 0
    for a, b, k in cuts:
        if a >= at:
            pieces += [text[at:a], pii.MASKS[k]]
        at = max(at, b)
    assert pii.sanitised(df).filter("doc_id = 0").first()["text"] == "".join(pieces) + text[at:]


def test_pii_terms(spark):
    """A rare name beside an address in several texts goes; common words beside it stay; texts without an address stay as they are."""
    rng = random.Random(2)
    filler = lambda: " ".join(f"w{rng.randint(0, 50)}" for _ in range(30))
    rows = [(k, f"{filler()} the Zebulon zeb@ex.org the {filler()}") for k in range(5)]
    rows += [(k, f"the {filler()} the") for k in range(5, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    for k, t in rows:
        if k < 5:
            assert "zeb" not in out[k].lower() and "[EMAIL]" in out[k] and " the " in out[k]
        else:
            assert out[k] == t


def brute_terms(texts, support=2, generalise=0.85, remove=0.95):
    """The texts with e-mail addresses and the terms that go with them masked: counts over whole distinct texts, each address at the narrowest level of enough texts, terms only beyond chance. No near copies."""
    words = {t: {w.lower() for w in re.findall(r"[^\W_]+", t)} for t in set(texts)}
    mails = {t: {m[0].lower() for m in re.finditer(r"[\w.]+@[\w.]+\w", t)} for t in words}
    levels = lambda m: (m, "part:" + m.split("@")[1], "kind")
    count = lambda k, e: sum(any(levels(m)[k] == e for m in mails[t]) for t in words)
    held = {t: {next((e for k, e in enumerate(levels(m)) if count(k, e) >= support), None) for m in mails[t]} - {None} for t in words}
    size = {e: sum(e in held[t] for t in words) for e in set().union(*held.values())}
    size = {e: n for e, n in size.items() if n >= support}
    beside = {t: {w.lower() for w in re.findall(r"[^\W_]+", re.sub(r"[\w.]+@[\w.]+\w", " ", t))} for t in words}
    most = max((n * np.exp((1 - generalise) * np.log(len(words) / n)) for n in size.values() if n < len(words)), default=0)
    own = {w: sum(w in beside[t] and bool(mails[t]) for t in words) for w in set().union(*words.values())}
    nats = np.log(max(1, sum(support <= n <= most + 1 for n in own.values()))) + pii.SURE
    mask = {t: {} for t in words}
    for e, n in size.items():
        of_e, ic = [t for t in words if e in held[t]], np.log(len(words) / n)
        for w in set().union(*(beside[t] for t in of_e)) if ic > 0 else ():
            both, all_ = sum(w in beside[t] for t in of_e), sum(w in x for x in words.values())
            share = 1 - np.log(all_ / both) / ic
            if both >= support and share >= generalise and both * np.log(len(words) * both / (all_ * n)) >= nats:
                for t in of_e:
                    mask[t][w] = mask[t].get(w, False) or share >= remove

    def swap(t, m):
        w = m[0]
        if "@" in w or w.lower() not in mask[t]:
            return "[EMAIL]" if "@" in w else w
        return "[REMOVED]" if mask[t][w.lower()] else "[NUMBER]" if w.isdigit() else "[CODE]" if re.search("[0-9]", w) else "[NAME]" if w[0].isupper() else "[WORD]"

    return [re.sub(r"[\w.]+@[\w.]+\w|[^\W_]+", lambda m, t=t: swap(t, m), t) for t in texts]


def test_pii_terms_of_whole_texts(spark):
    """Names in the header, far from the address, short ones, those in some of the texts only, and all their repetitions go."""
    rng = random.Random(8)
    filler = lambda n: " ".join(f"w{rng.randint(0, 50)}" for _ in range(n))
    texts = [f"Quimby {filler(40)} zeb@ex.org {filler(40)} Yq {'Tarkov' if k % 2 else ''} {filler(40)} quimby, QUIMBY" for k in range(6)]
    texts += [f"{filler(60)} bo@ex.org x" + " Vandal" * (k < 3) for k in range(5)]
    texts += [filler(60) + (" Tarkov" if k < 2 else " Vandal" if k < 5 else "") for k in range(400)]
    texts += texts[:3]
    texts += [f"{filler(50)} Globex {filler(9)} user{k}@corp.net" for k in range(4)]
    texts += [f"{filler(50)} helpdesk {filler(9)} only{k}@lone{k}.de" + " mmm" * (k == 1) for k in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert [out[k] for k in range(len(texts))] == brute_terms(texts)
    assert all("Globex" not in out[k] and "helpdesk" not in out[k + 4] for k in range(414, 418)) and "mmm" in out[419]
    assert all("quimby" not in out[k].lower() and "Yq" not in out[k] for k in range(6)) and out[11 + 3] == texts[11 + 3]


def test_pii_near_copies_are_no_evidence(spark):
    """Two texts that share 800 addresses and 8,000 words lose the addresses only; it takes no words times addresses."""
    rng = random.Random(12)
    shared = " ".join(f"Word{k} a{k}@b{k}.cd" if k < 800 else f"Word{k}" for k in range(8000))
    texts = [f"{shared} first version", f"{shared} second, another"] + [" ".join(f"w{rng.randint(0, 50)}" for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert time.time() - began < 60 and out[0] == re.sub(r"a\d+@b\d+\.cd", "[EMAIL]", texts[0]) and out[1].endswith("second, another")


def test_pii_entities_of_the_same_texts_meet_words_once(spark):
    """Four texts of other words share 400 addresses and a name: the name goes."""
    rng = random.Random(13)
    mails = lambda: " ".join(f"u{rng.randint(0, 10**15)} a{k}@b{k}.cd" for k in range(400))
    texts = [f"{mails()} Quimby" for _ in range(4)] + [" ".join(f"w{rng.randint(0, 50)}" for _ in range(40)) for _ in range(300)]
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all("Quimby" not in out[k] and re.findall(r"\bu\d+", out[k]) == re.findall(r"\bu\d+", texts[k]) for k in range(4))


def test_clashing_names_in_stages(spark, sf):
    """Columns of the names that stages use inside stay as they are."""
    import corpus_pipeline

    names = ["_cuts", "_gone", "_mark", "_mix_n", "_mix_s", "_mix_h", "_mix_k", "_toxicity", "_id", "_digest", "digest"]
    rows = [(k, f"text number {k} with a@b{k}.cd and words " + "tail " * (k % 4), "en", f"s{k % 3}", 5, *(f"{n}{k}" for n in names)) for k in range(60)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        found = out.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names), name


def test_repeated_ids_lose_no_other_text(spark):
    """Id 2 has two texts; only the one that is a copy of 1's goes."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text of some words"), (None, "a b c d e f g")]
    out = ngram_join.near_duplicates_dropped(spark.createDataFrame(rows, "doc_id long, text string"))
    left = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert (1, rows[0][1]) in left and (2, rows[2][1]) in left and (0, rows[3][1]) in left


@pytest.mark.parametrize("texts", ["other", "same"])
def test_mixing_rows_without_ids(spark, texts):
    """A third of the rows have no id, of one source all: each source comes near its target, a mix agrees with its plan and with itself."""
    rows = [(None if k % 3 == 0 else k, f"w{k if texts == 'other' else 0} " + "x " * (k % 7), "abc"[k % 3]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).checkpoint()
    plan = mixing.plan(df)
    by = {r.source: r for r in plan.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()}
    assert all(abs(r.taken - r.target) <= 4 * r.most for r in by.values()), by
    count = lambda: sorted(map(tuple, mixing.mix(df, weights=(1, 2, 3), share=1.0, most=3).groupBy("source").count().collect()))
    assert count() == count() == sorted(map(tuple, plan.groupBy("source").agg(F.sum("times")).collect()))


def test_nearest_neighbours_among_copies(spark):
    """A third of all rows is one vector: of its copies the smallest ids are nearest."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 8)).astype(np.float32)
    x[::3] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    found = hilbert_search.search(spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<float>")).toPandas()
    for q in range(0, 1500, 300):
        mine = found[found.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == [v for v in range(0, 36, 3) if v != q][:10] and (mine.score == 0).all()


def test_count_bound_never_loses_overlap():
    """The bound is at least the overlap, also where one group holds more than a byte can count."""
    rng = np.random.default_rng(6)
    a = np.unique(np.concatenate([rng.integers(0, 2**60, 700).astype(np.uint64), rng.integers(0, 2**50, 900).astype(np.uint64) * np.uint64(ngram_join.AXES)]))
    b = np.unique(np.concatenate([a[::2], rng.integers(0, 2**60, 500).astype(np.uint64)]))
    ca, cb = ngram_join.counts_of(a), ngram_join.counts_of(b)
    above = [len(x) - c.sum(dtype=np.int64) for x, c in ((a, ca), (b, cb))]
    assert min(above) > 0
    assert np.minimum(ca, cb).sum(dtype=np.int64) + min(above) >= len(np.intersect1d(a, b))
