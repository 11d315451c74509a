"""The corpus pipeline: from all documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes each result as Parquet in the shared folder and reads it for the next.

1. toxicity: documents that the classifier rejects go.
2. n-gram Jaccard join: of each group of near copies (eight tenths of their shingles of five words in common) the
   document with the smallest id stays.
3. suffix-array dedup: strings of 400 bytes and passages of 50 words that occur elsewhere too are taken out of the texts.
4. benchmark decontamination: documents that share ten words in a row with a benchmark item (or hold a whole shorter
   item) go.
5. packing: the rest is cut and packed into sequences of 2048 ids.

Defined results: a null text is empty, scores the classifier's intercept, is no copy of another and is packed as its end id;
of repeated rows one stays; a null id is an id like any other and ranks last among copies; an id with two labels counts by
the larger one; without labels of both classes toxicity rejects nothing unless all labels are 1; an empty benchmark rejects
nothing; empty documents give no pieces; further columns are carried up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm.core import shared_table
from parley.llm.decontaminate import decontaminate
from parley.llm.nearjoin import CORPUS, keep_one
from parley.llm.pack import pack_documents
from parley.llm.substrings import strip_repeats
from parley.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, rule=CORPUS)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return strip_repeats(docs)


def winnowing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("suffix_array", suffix_array), ("winnowing", winnowing), ("packing", packing)]

#: the classifier and the packing heuristic have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs)
    return docs
