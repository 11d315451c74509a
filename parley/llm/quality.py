"""Quality: supervised subword embeddings.

Every word, every character n-gram inside a word (with its borders) and every word 2-gram of a word and itself (all of them
one feature) is hashed to one of 2**BITS learned vectors. A document is the average of its vectors; a softmax over two labels
reads it. Vectors and softmax are trained by stochastic gradient descent on the softmax's loss in numpy, one document a step,
with one rate for the vectors (``VECTOR_RATE``, as each is a small share of an average) and one for the softmax, on at most
``SAMPLE`` labelled ids of each class (the only bound). Scoring reads whole texts; as average and softmax are linear up to the end, each vector is
scored once and a document is the mean of its features' scores.

Defined results: a text without words scores the learned intercept; without labels of both classes the share of label 1
(0.5 without any) is every score; repeated rows score alike; other columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.core import NOT_SPACE, append_result, crc_mod, free_name, mix, per_row, slices, tidy, tune, word_hashes, words_of
from parley.llm.labelled import code_points, labelled_sample, rows_of, sigmoid

BITS = 17
DIM = 12
ORDERS = (2, 3, 4)
SAMPLE = 1500
EPOCHS = 6
RATE, VECTOR_RATE = 0.6, 18.0
PARTS = 12
THRESHOLD = 0.3

RESULT = T.StructType([T.StructField("score", T.DoubleType())])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all words, inner n-grams and immediate repetitions, repeated as often as they occur."""
    starts, ends, row = words_of(data, offsets, NOT_SPACE)
    words = word_hashes(data, starts, ends, lower=False)
    shift = np.uint64(64 - BITS)
    rows, out = [row], [words >> shift]
    again = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1])) if len(words) > 1 else np.zeros(0, np.int64)
    rows.append(row[again])
    out.append(np.full(len(again), 1, np.uint64))
    codes, cut = code_points(data, offsets)
    at = rows_of(cut, len(codes))
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    plain = np.where(space, np.uint32(32), codes).astype(np.uint64)
    inner = np.append(0, np.cumsum(space))
    h = plain
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + plain[n - 1 :] if len(h) > 1 else h[:0]
        if n in ORDERS and len(h):
            # white space only at the ends, and all within one text
            ok = (at[: len(h)] == at[n - 1 :]) & (inner[n - 1 : n - 1 + len(h)] == inner[1 : 1 + len(h)]) & ~(space[: len(h)] & space[n - 1 :])
            rows.append(at[: len(h)][ok])
            out.append(mix(h[ok] ^ np.uint64(n << 57)) >> shift)
    return np.concatenate(rows), np.concatenate(out).astype(np.int64)


class Model:
    def __init__(self, worth: np.ndarray, bias: float):
        self.worth, self.bias = worth, bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, f = features(data, offsets)
        count = per_row(row, n)
        return sigmoid(self.bias + per_row(row, n, self.worth[f]) / np.maximum(count, 1))


def sampled_features(sample: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, distinct features, shares) of each sampled text."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(1)):
                row, f = features(data, offsets)
                keys, count = np.unique(row.astype(np.int64) << 32 | f, return_counts=True)
                cut = np.searchsorted(keys >> 32, np.arange(hi - lo + 1))
                f, count = (keys & 0xFFFFFFFF).astype(np.int32), count.astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.string()), b.column(2).slice(lo, hi - lo), pa.array([f[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary()), pa.array([count[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary())], ["id", "y", "f", "c"])

    rows = sample.repartition(PARTS, "id").mapInArrow(tidy(run), "id string, y int, f binary, c binary").collect()
    rows.sort(key=lambda r: (r["id"], r["y"], r["f"]))
    out = []
    for r in rows:
        c = np.frombuffer(r["c"], np.float32)
        if len(c):
            out.append((r["y"], np.frombuffer(r["f"], np.int32), c / c.sum()))
    return out


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], prior: float, seed: int = 7) -> Model:
    """Vectors and softmax by gradient steps of one document each, the rate falling to nothing."""
    rng = np.random.default_rng(seed)
    vector = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    share = np.mean([y for y, _, _ in examples])
    weight = (np.float32((1 - prior) / (1 - share)), np.float32(prior / share))
    steps, t = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            y, f, c = examples[i]
            left = 1 - t / steps
            rate = np.float32(RATE * left)
            t += 1
            rows = vector[f]
            hidden = c @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= weight[y]
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * p * np.float32(0.1)
            vector[f] = rows - np.float32(VECTOR_RATE * left) * np.outer(c, back)
    return Model(vector @ (out[1] - out[0]).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    tune(docs.sparkSession)
    examples = sampled_features(labelled_sample(docs, labels, label, sample, doc_id, text))
    classes = {y for y, _, _ in examples}
    if len(classes) < 2:
        share = float(classes.pop()) if classes else 0.5
        return Model(np.zeros(1 << BITS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    return train(examples, 0.5)


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(docs.columns, "_quality")

    def make():
        return lambda data, offsets: [shared.value.score(data, offsets)]

    return append_result(docs, text, make, RESULT, name, keep_text), name


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored, name = score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep_text=False)
    score = F.col(name)["score"]
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
