"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its lower-cased character n-grams (``ORDERS``), hashed to 2**BITS features. Each feature is scaled by
the logarithm of its smoothed rate in toxic over its rate in clean training texts, and a logistic regression is trained on
the scaled features. Only the ``FEATURES`` most telling ones are kept. Training uses at most ``SAMPLE`` ids of each class
(the only bound; scoring reads all texts whole).

Counting runs on the executors over the sample, in a fixed number of parts; what reaches the driver is two count vectors
a part and then the kept features of each sampled text, both bounded.

Defined results: a null or empty text has no features and scores the intercept; without labels of both classes the
share of label 1 (0 without any labels) is every score; repeated rows score alike; other columns are carried along; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.core import append_result, crc_mod, free, free_name, mix, slices, tidy, tune
from parley.llm.labelled import code_points, labelled_sample, rows_of, sigmoid

ORDERS = (3, 4, 5, 6)
BITS = 19
FEATURES = 1 << 14
SAMPLE = 3000
PARTS = 12
ALPHA = 1.0
L2 = 2e-3
STEPS = 150
THRESHOLD = 0.5

RESULT = T.StructType([T.StructField("score", T.DoubleType())])


def features(data: np.ndarray, offsets: np.ndarray, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each text; with ``slot`` only those that have a slot, as slots."""
    codes, cut = code_points(data, offsets, lower=True)
    row = rows_of(cut, len(codes))
    keys = []
    h = codes.astype(np.uint64)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :] if len(h) > 1 else h[:0]
        if n in ORDERS and len(h):
            f = (mix(h ^ np.uint64(n << 56)) >> np.uint64(64 - BITS)).astype(np.int64)
            ok = row[: len(h)] == row[n - 1 :]
            if slot is not None:
                f = slot[f]
                ok &= f >= 0
            keys.append(row[: len(h)][ok].astype(np.int64) << 32 | f[ok])
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return keys >> 32, keys & 0xFFFFFFFF


class Model:
    def __init__(self, slot: np.ndarray, weight: np.ndarray, bias: float):
        self.slot, self.weight, self.bias = slot, weight, bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, f = features(data, offsets, self.slot)
        return sigmoid(self.bias + np.bincount(row, self.weight[f], len(offsets) - 1))


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts that hold each feature, by class, and texts of each class."""

    def run(batches):
        total = np.zeros((2, 1 << BITS), np.int32)
        n = np.zeros(2, np.int64)
        for b in batches:
            y = np.array(b.column(2).to_pylist(), int)
            n += np.bincount(y, minlength=2)
            for lo, hi, data, offsets in slices(b.column(1)):
                row, f = features(data, offsets)
                for c in (0, 1):
                    total[c] += np.bincount(f[y[lo:hi][row] == c], minlength=1 << BITS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64()))], ["c", "n"])

    total, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for r in sample.repartition(PARTS, "id").mapInArrow(tidy(run), "c binary, n array<long>").toLocalIterator():
        total += np.frombuffer(r["c"], np.int32).reshape(2, -1)
        n += np.array(r["n"])
    return total, n


def _kept_features(sample: DataFrame, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shared = sample.sparkSession.sparkContext.broadcast(slot)

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(1)):
                row, f = features(data, offsets, shared.value)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                f = f.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([b.column(2).slice(lo, hi - lo), pa.array([f[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary()), b.column(0).slice(lo, hi - lo).cast(pa.string())], ["y", "f", "id"])

    rows = sample.repartition(PARTS, "id").mapInArrow(tidy(run), "y int, f binary, id string").collect()
    rows.sort(key=lambda r: (r["id"], r["y"], r["f"]))
    f = [np.frombuffer(r["f"], np.uint16) for r in rows]
    return np.array([r["y"] for r in rows], float), np.repeat(np.arange(len(f)), [len(x) for x in f]), np.concatenate(f).astype(np.int64) if f else np.zeros(0, np.int64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    tune(docs.sparkSession)
    drawn = labelled_sample(docs, labels, label, sample, doc_id, text)
    count, n = _counts(drawn)
    none = np.full(1 << BITS, -1, np.int32)
    if not n.all():
        share = n[1] / max(1, n.sum())
        return Model(none, np.zeros(1), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rate = (count + ALPHA) / (n[:, None] + 2 * ALPHA)
    ratio = np.log(rate[1] / rate[0])
    # most telling: the log-count ratio times the square root of how many texts show it
    worth = np.abs(ratio) * np.sqrt(count.sum(0)) * (count.sum(0) >= 3)
    kept = np.sort(np.argsort(-worth, kind="stable")[:FEATURES])
    kept = kept[worth[kept] > 0]
    slot = none.copy()
    slot[kept] = np.arange(len(kept))
    y, row, f = _kept_features(drawn, slot)
    weights = train(y, row, f, ratio[kept], prior_of(labels, label, doc_id))
    del y, row, f, count
    free(docs.sparkSession)
    return Model(slot, *weights)


def prior_of(labels: DataFrame, label: str, doc_id: str) -> float:
    """Share of label 1 among all training ids."""
    y = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (crc_mod(F.col(doc_id), 5) != 0)).groupBy(doc_id).agg(F.max(F.col(label).cast("double")).alias("y"))
    return y.agg(F.avg("y")).first()[0] or 0.0


def train(y: np.ndarray, row: np.ndarray, f: np.ndarray, ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence; classes weigh as in all labels. Returns (weights, intercept)."""
    n = len(y)
    share = y.mean()
    # toxic texts weigh somewhat more than they occur, for the rare class is the one sought
    aim = max(prior, 0.5)
    weight = np.where(y == 1, aim / max(share, 1e-9), (1 - aim) / max(1 - share, 1e-9)) / n
    w, bias = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    value = ratio[f]
    for t in range(1, STEPS + 1):
        z = bias + np.bincount(row, value * w[f], n)
        g = (sigmoid(z) - y) * weight
        gw = np.bincount(f, value * g[row], len(w)) + L2 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.05 * (1 - t / (STEPS + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w * ratio, float(bias)


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """docs with a struct that holds the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(docs.columns, "_toxicity")

    def make():
        return lambda data, offsets: [shared.value.score(data, offsets)]

    return append_result(docs, text, make, RESULT, name, keep_text), name


def drop_toxic(docs: DataFrame, training: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, all columns kept."""
    scored, name = score_documents(docs, fit(training, labels), text)
    return scored.where(F.col(name)["score"] < THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, name = score_documents(docs, model, keep_text=False)
    score = F.col(name)["score"]
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
