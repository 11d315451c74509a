"""Mixing sources to target weights by systematic sampling.

1. Every document's size (its words) is counted once; sources get their totals by an aggregation.
2. Sources, in the order of their code points, weigh as ``WEIGHTS`` repeat and share all sizes. A target stops at ``MOST``
   times its source's size; what is above is shared out again by weight until none is above. That is one level for all:
   target = min(MOST * size, weight * level), found by a few aggregations over the table of sources.
3. A document of a source is expected target / source size times, in whole units of 2**-32. Expected copies are summed up
   before each document within its source, one random offset of the source is added, and the document is emitted once for
   each whole number that its own share crosses. Documents stand in the order of size, so the words taken miss the target
   by about the largest document of the source at most; equal sizes stand in the order of a hash.

Prefix sums are distributed (``running_sums``): rows are dealt by range of the whole order, every task sums up its range,
and only one total a task goes through the driver. The order holds size, hash and id beside the source, so a source with a
third of all rows is many ranges.

Defined results: a null text has no words, a document without words may be emitted and takes none; a null source is a
source of its own, the last one; a source without words has target 0; a null id is hashed as the empty text; repeated rows
are documents of their own, which of them are emitted is undefined as they are alike; an empty table gives no rows; other
columns are carried along by ``mixed``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.core import join_back, shared_checkpoint, take_rows, tidy, tune

WEIGHTS = (5, 2, 1)
SHARE = 1.0  #: of all words, what the mix is to hold
MOST = 3  #: copies of a document
SEED = 13
WORDS = r"[^\x20\x09-\x0D]+"
ONE = 1 << 32  #: units of a whole copy
WRAP = 1 << 62  #: prefix sums count modulo this, a multiple of ONE


def running_sums(rows: DataFrame, order: list[str], value: str, before: str) -> DataFrame:
    """``rows`` in one global order with the sum, modulo WRAP, of the long ``value`` of all rows before each; written to the
    shared folder."""
    at = rows.columns.index(value)

    def run(batches):
        total, part = np.uint64(0), TaskContext.get().partitionId()
        for b in batches:
            sums = np.cumsum(np.append(total, b.column(at).to_numpy(zero_copy_only=False).astype(np.uint64)), dtype=np.uint64)
            total = sums[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((sums[:-1] & np.uint64(WRAP - 1)).astype(np.int64)), pa.array(np.full(len(b), part, np.int32))], [*b.schema.names, before, "_part"])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    summed = shared_checkpoint(dealt.mapInArrow(tidy(run), f"{types}, {before} long, _part int"))
    sums, offset, totals = {}, 0, summed.groupBy("_part").agg(F.sum(F.col(value).cast("decimal(20,0)")).alias("s")).collect()  # one row a task
    for r in sorted(totals):
        sums[r["_part"]], offset = offset % WRAP, offset + int(r["s"] or 0)
    offsets = rows.sparkSession.createDataFrame(list(sums.items()), "_part int, _offset long")
    return summed.join(F.broadcast(offsets), "_part").withColumn(before, F.pmod(F.col(before) + F.col("_offset"), F.lit(WRAP))).select(*rows.columns, before)


def level(sources: DataFrame, share: float, most: int) -> float:
    """Words for a weight of one: least(most * source_size, weight * level) over (source_size, weight) sums up to ``share`` of
    all sizes."""
    size, weight = F.col("source_size"), F.col("weight")
    total, weights = sources.agg(F.sum(size), F.sum(weight)).first()
    total = (total or 0) * share
    at, capped = total / weights if weights else 0.0, -1
    while True:
        full = weight * F.lit(float(at)) > most * size
        n, held, rest = sources.agg(F.count_if(full), F.sum(F.when(full, most * size)), F.sum(F.when(~full, weight))).first()
        if n == capped or not rest:
            return at
        at, capped = (total - (held or 0)) / rest, n


def fraction(text: str) -> int:
    """A number below ONE from the digest of a text."""
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(k1, k2, doc_id, source, size, source_size, target, copies), a row for each of ``docs``; k1 and k2 tell its id, source and text."""
    tune(docs.sparkSession)
    # null sorts behind every name
    key = F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))
    slim = docs.select(F.xxhash64(doc_id, source, text).alias("k1"), F.hash(doc_id, source, text).alias("k2"), F.col(doc_id).alias("doc_id"), key.alias("key"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long").alias("size"))
    slim = shared_checkpoint(slim)
    sources = slim.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = running_sums(sources.withColumn("one", F.lit(1).cast("long")), ["key"], "one", "place").drop("one")
    sources = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int")).cast("long"))
    sources = shared_checkpoint(sources)
    target = F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.lit(float(level(sources, share, most))))
    expected = F.least(F.floor(F.coalesce(target / F.nullif("source_size", F.lit(0)), F.lit(0.0)) * ONE), F.lit(most * ONE))
    sources = sources.withColumns({"target": target, "expected": expected}).withColumn("sum", F.pmod(F.col("n").cast("decimal(19,0)") * F.col("expected").cast("decimal(19,0)"), F.lit(WRAP)).cast("long"))
    sources = running_sums(sources, ["key"], "sum", "start")
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "key"), 256), 1, 8), 16, 10).cast("long")
    sources = shared_checkpoint(sources.select("key", F.col("n").alias("many"), "place", "source_size", "target", "expected", F.pmod(offset - F.col("start"), F.lit(ONE)).alias("shift")))
    rows = join_back(slim, sources, ["key"], slim.count(), "many").drop("many")
    order = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long")
    rows = running_sums(rows.withColumn("h", order), ["place", "size", "h", "doc_id", "k1"], "expected", "before")
    copies = F.shiftright(F.pmod(F.col("before") + F.col("shift"), F.lit(ONE)) + F.col("expected"), 32)
    return rows.select("k1", "k2", "doc_id", F.when(F.col("key") != "1", F.expr("substring(key, 2)")).alias("source"), "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is emitted."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    names = [inner[c] for c in (doc_id, source, text)]
    chosen = mix_sources(plain, names[0], names[2], names[1], **kw)
    times = chosen.groupBy("k1", "k2").agg(F.sum("copies").alias("times"), F.count(F.lit(1)).alias("many")).where("times > 0")
    return take_rows(plain.withColumns({"k1": F.xxhash64(*names), "k2": F.hash(*names)}), times).select(*(F.col(n).alias(c) for c, n in inner.items()))


def op13_systematic_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def brute(docs: list[tuple], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> dict:
    """Plain restatement for tests: {doc_id: (size, source_size, target, copies)} of (doc_id, text, source)."""
    import re
    from fractions import Fraction

    sized = [(d, len(re.findall(WORDS, t or "")), "1" if s is None else "0" + s) for d, t, s in docs]
    names = sorted({k for _, _, k in sized}, key=lambda k: k.encode())
    size = {k: sum(n for _, n, x in sized if x == k) for k in names}
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    goal, capped = Fraction(share) * sum(size.values()), set()
    while True:
        rest = sum(weight[k] for k in names if k not in capped)
        at = (goal - sum(most * size[k] for k in capped)) / rest if rest else Fraction(0)
        more = {k for k in names if k not in capped and weight[k] * at > most * size[k]}
        if not more:
            break
        capped |= more
    out = {}
    for k in names:
        target = float(most * size[k] if k in capped else weight[k] * at)
        step = min(int(target / size[k] * ONE), most * ONE) if size[k] else 0
        sum_ = fraction(f"{seed}:{k}")
        for d, n, _ in sorted((r for r in sized if r[2] == k), key=lambda r: (r[1], int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16))):
            out[d] = (n, size[k], target, (sum_ + step) // ONE - sum_ // ONE)
            sum_ += step
    return out
