"""Importance resampling of documents towards a target distribution.

1. Features are all runs of 1 to ``ORDER`` consecutive words, each in the bucket that its bytes' crc32 names. Every task adds
   up one array of ``BUCKETS`` counts over whole texts and sends that; documents and target are counted the same way.
2. A bucket's gain is the log ratio of its smoothed shares in the target and in the documents, in thousandths. A document's
   weight is the floored mean of gains over its features, read from the array, which goes to all tasks.
3. A document's score is its weight and a Gumbel number of its id's digest, so the highest scores are a draw without
   replacement by weight. Scores are integers: a histogram of them, summed from the top, gives the rank before each score and
   the score at which the draw ends. The histogram has one row for a score, whatever the input: gains lie within 1000 times
   the logarithm of the counts and Gumbel numbers of 32 bits within -3200 and 22900.
4. Documents of at least ``MIN_WORDS`` words that reach the last score are numbered by id within their score; the others are
   not drawn and not sorted. The random part spreads the documents, copies too, over thousands of scores, so no score holds
   a large share of the rows.

Defined results: a null text has no words and no features, and weight 0; a null id is hashed as the empty text and ranks
behind the ids of its score; repeated rows are documents of their own and rank side by side; an empty target or a target
without words has no counts, so that rare buckets gain most; an empty table gives no rows; other columns are carried along
by ``resample``.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.core import ALNUM, LOWER, per_row, shared_checkpoint, slices, take_rows, tidy, tune, words_of

BUCKETS = 10_000
ORDER = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
LONG = 64  #: bytes of a word up to which all words step together

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _TABLE[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def crc_states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The crc32 registers ``state`` after the bytes of each word; the crc32 is the register's complement."""
    size = np.minimum(ends - starts, LONG + 1).astype(np.uint8)
    order = np.argsort(LONG + 1 - size, kind="stable")
    at, now = starts[order], state[order]
    active = np.cumsum(np.bincount(size, minlength=LONG + 2)[::-1])[::-1]  # words of at least so many bytes
    for j in range(LONG):
        n = active[j + 1]
        if not n:
            break
        now[:n] = _step(now[:n], data[at[:n] + j])
    out = np.empty_like(now)
    out[order] = now
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, its row, words of each row)."""
    starts, ends, row = words_of(data, offsets, ALNUM)
    data = LOWER[data]
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    found, rows = [], []
    for k in range(order):
        if k:
            # runs of k words go on with a space and the next word, within their row
            state, first = state[:-1], row[: len(row) - k]
            inside = first == row[k:]
            state = crc_states(data, starts[k:], ends[k:], _step(state, np.uint32(0x20)))
        else:
            inside, first = np.ones(len(row), bool), row
            state = crc_states(data, starts, ends, state)
        found.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)[inside])
        rows.append(first[inside])
    return np.concatenate(found), np.concatenate(rows), per_row(row, len(offsets) - 1)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                counts += np.bincount(feature_buckets(data, offsets, buckets, order)[0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    tune(docs.sparkSession)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    n, total, aim = len(have), int(have.sum()), int(want.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (total + n)) / float((s + 1) * (aim + n)))) for s, t in zip(have.tolist(), want.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", order: int = ORDER) -> DataFrame:
    """``docs``, but for the text, with n_words, n_features and weight; docs has no columns of these names."""
    names = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)

    def run(batches):
        for b in batches:
            kept = [b.column(b.schema.get_field_index(n)) for n in names]
            for lo, hi, data, offsets in slices(b.column(b.schema.get_field_index(text))):
                bucket, row, words = feature_buckets(data, offsets, len(gain), order)
                n = per_row(row, hi - lo)
                # sums of integers below 2**53 in doubles are exact
                total = per_row(row, hi - lo, gain[bucket].astype(np.float64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in kept), pa.array(words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], [*names, "n_words", "n_features", "weight"])

    return docs.mapInArrow(tidy(run), f"{kinds}, n_words long, n_features long, weight long")


def draw(scored: DataFrame, drawn: int, doc_id: str = "doc_id") -> DataFrame:
    """``scored`` (doc_id, eligible, score, ...) with ``rank``: 1, 2, ... of the ``drawn`` highest scores among eligible rows."""
    histogram = sorted(((r["score"], r["n"]) for r in scored.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    above, before = 0, []
    for score, n in histogram:
        if above >= drawn:
            break
        before.append((score, above))
        above += n
    last = before[-1][0] if before else None
    reaches = F.col("eligible") & (F.col("score") >= last) if before else F.lit(False)
    offsets = scored.sparkSession.createDataFrame(before, "score long, _before long")
    rest = [c for c in scored.columns if c not in (doc_id, "score", "eligible")]
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col(doc_id).asc_nulls_last(), *rest)) + F.col("_before")
    top = scored.where(reaches).join(F.broadcast(offsets), "score").withColumn("rank", place.cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.select(*scored.columns, "rank").unionByName(scored.where(~reaches).withColumn("rank", F.lit(None).cast("long")))


def importance_sample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """(k1, k2, doc_id, n_words, n_features, weight, score, rank), a row for each of ``docs``; k1 and k2 tell its id and text;
    ``percent`` of the documents long enough have a rank. target: a table with a column of the text's name."""
    tune(docs.sparkSession)
    gain = gains(bucket_counts(docs, text, buckets, order), bucket_counts(target, text, buckets, order))
    plain = docs.select(F.xxhash64(doc_id, text).alias("k1"), F.hash(doc_id, text).alias("k2"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    chance = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weigh(plain, gain, "_text", order).withColumns({"score": F.col("weight") + chance, "eligible": F.col("n_words") >= min_words})
    scored = shared_checkpoint(scored)
    n = scored.where("eligible").count()
    return draw(scored, percent * n // 100).drop("eligible")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that are drawn; the target's text has the same column name."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    d, t = inner[doc_id], inner[text]
    chosen = importance_sample(plain, target.select(F.col(text).alias(t)), d, t, **kw)
    times = chosen.groupBy("k1", "k2").agg(F.count("rank").alias("times"), F.count(F.lit(1)).alias("many")).where("times > 0")
    return take_rows(plain.withColumns({"k1": F.xxhash64(d, t), "k2": F.hash(d, t)}), times).select(*(F.col(n).alias(c) for c, n in inner.items()))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance_sample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def brute(docs: list[tuple], target: list[str], percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> dict:
    """Plain restatement for tests: {doc_id: (n_features, weight, score, rank)}; ids are unlike."""
    import hashlib
    import re
    from collections import Counter

    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def features(t):
        w = words(t)
        return [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out, order = {}, []
    for d, x in docs:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[d] = [len(f), weight, score, None]
        if len(words(x)) >= min_words:
            order.append((-score, d is None, d or 0, d))
    for i, (*_, d) in enumerate(sorted(order)[: percent * len(order) // 100]):
        out[d][3] = i + 1
    return {d: tuple(v) for d, v in out.items()}
