import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "pii", "source_mix", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf).cache()
        assert out.columns == docs.columns
        assert out.select("doc_id").exceptAll(kept.select("doc_id")).distinct().join(kept, "doc_id", "left_anti").count() == 0
        if name == "pii":
            assert out.count() == kept.count()
            assert out.filter(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count() == 0
        kept = out
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert last.count() == kept.count() and last.filter("n_tokens <> size(ids)").count() == 0


def test_a_worker_holds_little_of_a_batch():
    """A batch of 4 MB, as workers get them: numpy's arrays over its words stay under 20 MB."""
    from keepsake.llm import toxicity

    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 99_999, 500))) for _ in range(1400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1400)), pa.array([False] * 1400), pa.array(texts)], names=["row", "positive", "text"])
    tracemalloc.start()
    found = sum(b.num_rows for b in toxicity._feature_rows(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 1400 and most < 20e6
