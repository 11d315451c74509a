"""Bounded samples of labelled documents, and code points of texts: shared by the trained classifiers."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.core import crc_mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 0) -> DataFrame:
    """Rows (id, text, y) of at most ``most`` labelled ids of each class that are not held out.

    Ids are taken in the order of a hash, so the sample is the same in every run and unrelated to the order of the data.
    An id with several labels takes the largest; null labels and ids do not count; repeated documents all belong. The ids
    (at most 2 * most) are the only thing that is broadcast.
    """
    spark = docs.sparkSession
    y = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (crc_mod(F.col(doc_id), folds) != held_out)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    there = docs.select(F.col(doc_id).alias("_id")).distinct()
    y = y.join(there, "_id", "left_semi")
    picked = [r for c in (0, 1) for r in y.where(F.col("y") == c).orderBy(F.xxhash64("_id"), "_id").limit(most).collect()]
    ids = spark.createDataFrame([(r["_id"], r["y"]) for r in picked], f"_id {docs.schema[doc_id].dataType.simpleString()}, y int")
    return docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "_id").select(F.col("_id").alias("id"), "text", "y")


_SIMPLE = np.arange(0x3000, dtype=np.uint32)
for _i in range(0x3000):
    _c = chr(_i).lower()
    if len(_c) == 1:
        _SIMPLE[_i] = ord(_c)


def code_points(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points) of UTF-8 texts."""
    starts = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    kind = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode(kind, "surrogatepass"), np.uint32)
    if lower:
        codes = np.where(codes < 0x3000, _SIMPLE[np.minimum(codes, 0x2FFF)], codes)
    return codes, starts[offsets]


def rows_of(offsets: np.ndarray, n: int) -> np.ndarray:
    """Row of each of n positions."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
