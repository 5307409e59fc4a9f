"""Clusters over several chunks in the n-gram join: parted before their sets are sent, with no link lost."""

import random

import numpy as np

from keepsake.llm import ngram_join
from keepsake.llm.common import mix


def shingles(text, width):
    w = text.split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def test_a_set_is_not_sent_to_documents_that_only_share_a_passage(spark, monkeypatch):
    """Long documents with a passage in common pass the counts over 256 axes; before, each one's set went to every chunk of them."""
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage, bodies = text(300), [text(6000) for _ in range(12)]
    rows = [(k, " ".join(b + passage)) for k, b in enumerate(bodies)]
    for k in range(3):  # near copies, some of them beyond the threshold
        for j, n in enumerate((5, 60, 400)):
            b = list(bodies[k])
            for at in rng.sample(range(6000), n):
                b[at] = "changed"
            rows.append((100 + 10 * k + j, " ".join(b + passage)))
    sent, worked = [], ngram_join._worked
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", 20_000)
    monkeypatch.setattr(ngram_join, "_worked", lambda df, group, *rest: (sent.append(df.select("doc").count()) if group == "root" else None, worked(df, group, *rest))[1])
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=2, percent=70).collect()}
    sets = {k: shingles(t, 2) for k, t in rows}
    links = {k: {j for j in sets if j != k and 100 * len(sets[k] & sets[j]) >= 70 * len(sets[k] | sets[j])} for k in sets}
    root = {k: min(links[k] | {k} | {x for j in links[k] for x in links[j]}) for k in sets}
    assert got == {k: (root[k], len(links[k])) for k in sets} and any(links.values()) and not all(links.values())
    assert sum(sent) <= 2 * len(rows)


def test_finer_points_bound_every_overlap(spark):
    """Summed minima at a common level are never under the overlap, and every pair that can link has a common level."""
    rng = np.random.default_rng(1)
    base = mix(rng.integers(0, 2**62, 3000).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[: rng.integers(0, 3000)], mix(rng.integers(0, 2**62, n).astype(np.uint64))])) for n in (0, 1, 7, 9, 100, 255, 256, 300, 2000, 2040, 2060, 2600)]
    rows = [(1, k, [int(x) for x in s.view(np.int64)]) for k, s in enumerate(sets)]
    for percent in (50, 85):
        at = {}
        for r in ngram_join._finer(spark.createDataFrame(rows, "root long, doc long, shingles array<long>"), percent).collect():
            at.setdefault(r.doc, {})[r.level] = (np.frombuffer(bytes(r.counts), np.uint8).astype(np.int64), r.above)
        for a in range(len(sets)):
            for b in range(a):
                common, both = set(at[a]) & set(at[b]), len(np.intersect1d(sets[a], sets[b]))
                small, big = sorted((len(sets[a]), len(sets[b])))
                assert percent * big > 100 * small or common
                for level in common:
                    (ca, ra), (cb, rb) = at[a][level], at[b][level]
                    assert len(ca) == len(cb) and np.minimum(ca, cb).sum() + min(ra, rb) >= both
