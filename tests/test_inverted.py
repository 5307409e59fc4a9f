"""The stored index against the scan of all texts, and what a search reads of it."""

import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import inverted, retrieval
from keepsake.operators.inverted import build, opened

WEIGHTS = {"header": 2.0, "text": 1.0, "keywords": 0.5}
SCHEMA = "id long, header string, text string, keywords string, lang string"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["the"] * 40 + ["Ünder", "x", "o'clock"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    rows = [(k, rng.choice([None, line(3)]), line(60 if k % 3 else 8), rng.choice([None, "", line(5)]), rng.choice(["en", "de", None])) for k in range(900)]
    rows += [(1000, None, None, None, "en"), (1001, "", "the " * 2000, None, "en"), (1002, "w1 w1 w1", "w1", "w1", "de")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def index(chunks):
    return build(chunks, "id", WEIGHTS, ["lang"], block=16, folders=8)


def best(scored, k):
    return [(r.doc, round(r.score, 6)) for r in retrieval.top(scored, k, 6).collect()]


@pytest.mark.parametrize("query", ["the w1", "w1 w2 nowhere", "THE the o'clock", "ünder w7 w8 w9 w10", "the", "w59"])
@pytest.mark.parametrize("k", [1, 10, 2000])
def test_same_scores_as_the_scan(chunks, index, query, k):
    want = best(retrieval.bm25(chunks, query, "id", WEIGHTS), k)
    got = best(index.search(query, k), k)
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6) and len(got) == len(want)
    firm = {d for d, s in want if s > want[-1][1] + 1e-5}
    assert firm <= {d for d, _ in got}


@pytest.mark.parametrize("where", ["lang = 'en'", "lang is null", "lang = 'xx'"])
def test_filters_come_first(chunks, index, where):
    want = best(retrieval.bm25(chunks.filter(where), "the w1 w2", "id", WEIGHTS), 10)
    assert [s for _, s in best(index.search("the w1 w2", 10, F.expr(where)), 10)] == pytest.approx([s for _, s in want], abs=2e-6)


def test_nothing_to_find(index):
    assert index.search("", 5).count() == 0 and index.search("x y z", 5).count() == 0 and index.search("nowhere else", 5).count() == 0


def test_only_the_terms_folders_are_opened(spark, index):
    some = index.of(["w1", "the"])
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(term" in plan
    assert {r.term for r in some.select("term").distinct().collect()} == {"w1", "the"}
    folders = {f.split("folder=")[1].split("/")[0] for f in (r[0] for r in some.select(F.input_file_name()).distinct().collect())}
    assert len(folders) <= 2 < index.blocks.select("folder").distinct().count()


def test_a_common_term_is_many_bounded_blocks(index):
    n = index.of(["the"]).agg(F.count("*"), F.max("n"), F.sum("n")).first()
    assert n[0] > 20 and n[1] <= 64 and n[2] > 600
    order = index.of(["the"]).select(F.col("postings.doc").alias("d")).filter(F.array_sort("d") != F.col("d"))
    assert order.count() == 0


def test_blocks_under_the_threshold_are_left_out(index, monkeypatch):
    """Of the slots with the term, those whose bound is under the k-th score found first are not opened."""
    seen = []
    whole = inverted.InvertedIndex._postings
    monkeypatch.setattr(inverted.InvertedIndex, "_postings", staticmethod(lambda blocks: seen.append(blocks) or whole(blocks)))
    index.search("w1", 1).collect()
    assert len(seen) == 2 and seen[1].count() < 0.5 * index.of(["w1"]).count()


def test_terms(chunks, index):
    want = {r.term: (r.total, r.docs) for r in retrieval.postings(chunks, "id", ["text"]).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("docs")).collect()}
    got = {r.term: (r.total, r.docs) for r in build(chunks, "id", {"text": 1.0}).terms().collect()}
    assert got == want


def test_kept_until_the_table_changes(spark, chunks, tmp_path):
    path = str(tmp_path / "chunks.parquet")
    chunks.limit(50).write.parquet(path)
    first = opened(spark, path, "id", {"text": 1.0})
    assert opened(spark, path, "id", {"text": 1.0}) is first and first.count == 50
    chunks.filter("id >= 1000").write.mode("append").parquet(path)
    again = opened(spark, path, "id", {"text": 1.0})
    assert again is not first and again.count == 53 and opened(spark, path, "id", {"text": 1.0}) is again


def test_words_are_counted_in_bounded_slices():
    """A batch of two million words: what numpy holds beside it stays small (before, with the batch counted at once: hundreds of MB)."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([0] * 200), pa.array([[f"w{(k * j) % 997}" for j in range(10_000)] for k in range(200)])], names=["doc", "lane", "w_0"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in inverted.counted(iter([batch]), [1.0], [5.0], 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 200 * 997 - 996 and peak < 64e6  # doc 0 has one word


def test_a_pool_is_sent_to_the_texts(spark, chunks):
    """Before, all texts were shuffled to meet the pool's few rows."""
    pool = chunks.filter("id < 1003").select(F.col("id").alias("doc")).repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = retrieval.reranked(pool, chunks.select(F.col("id").alias("doc"), "text"), lambda ts: [float(len(t or "")) for t in ts], 3)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert [r.doc for r in out.collect()][0] == 1001
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty(chunks):
    none = build(chunks.limit(0), "id", WEIGHTS, ["lang"])
    assert none.search("the w1", 3).count() == 0 and none.terms().count() == 0
