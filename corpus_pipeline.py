"""The corpus pipeline: documents in, token ids out, by five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet in the shared
folder and hands the reread table to the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import mixing, ngram_join, pii, sentencepiece_codec, toxicity
from keepsake.llm.common import stored, table, unused

#: Documents that score this much are rejected.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. Null and empty texts are scored like any other, by what they lack, and stay; rows that repeat an id are judged each by its text."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "_toxicity")
    return toxicity.scored(docs, model, score=score).filter(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose sets of five-word shingles are linked by a Jaccard similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return ngram_join.near_duplicates_dropped(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are masked in the text; no document goes."""
    return pii.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it, none to three times. A null text has size 0 and goes along with its hash; a null source is a source; rows that repeat an id are taken or left together."""
    return mixing.mix(docs, weights=(1, 2, 3), share=1.0, most=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digest of the text that they decode to. A null or empty text has no ids; rows that repeat are encoded each."""
    encoded = sentencepiece_codec.encode_decode(docs.select("doc_id", "source", "lang", "text"))
    return encoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("source_mix", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can't express the trained and iterative stages; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
