"""Substring dedup by hashing lines: of equal units all but the earliest go, offsets of what stays are the original ones.

A unit is a line, cut further behind closing marks (. ! ?), so that a passage inside a longer line is found too; with
``sentences=False`` whole lines. It is normalised to its words in lower case; the digest is two 64-bit hashes of these. Units
under ``min_words`` words always stay; by default there are none, so a repeated line goes whole, whatever its sentences are.

First only digests are counted (a sum with map-side combination); those met once, nearly all, are done: a broadcast key
filter of the others keeps their places back, so they are never shuffled. What passes is grouped by the whole digest, again
with map-side combination, for the earliest place: smallest id, then smallest offset. A join marks the rest; the places of
very frequent digests stay where they are and get the earliest place by broadcast (``core.join_back``). Texts are shuffled only where something goes. No group is gathered.

Defined results: a null or empty text has no units; ids equal in value and text are one document, so both rows stay as
they are; a null id ranks last; ties go to the smaller text key; other columns are carried along; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.core import INVERSE, NOT_SPACE, as_struct, free, free_name, join_back, key_filter, passing, prefix_sums, shared_table, slices, span_hashes, text_buffers, tidy, tune, word_hashes, words_of
from parley.llm.substrings import BASE2, INVERSE2

MIN_WORDS = 1
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in ".!?"]] = True


def units_of(data: np.ndarray, offsets: np.ndarray, sentences: bool = True) -> dict[str, np.ndarray]:
    """row, first byte, end byte (in the text), words and two digests of every unit."""
    starts, ends, row = words_of(data, offsets, NOT_SPACE)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return {"row": z, "a": z, "z": z, "n": z, "d1": z, "d2": z}
    h = word_hashes(data, starts, ends)
    feeds = np.append(0, np.cumsum(data == 10))
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (feeds[starts[1:]] > feeds[ends[:-1]])
    if sentences:
        new[1:] |= _CLOSE[data[ends[:-1] - 1]]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))
    r = row[first]
    d1 = span_hashes(prefix_sums(h), first, last, INVERSE)
    d2 = span_hashes(prefix_sums(h, BASE2), first, last, INVERSE2)
    return {"row": r, "a": starts[first] - offsets[r], "z": ends[last - 1] - offsets[r], "n": last - first, "d1": d1.view(np.int64), "d2": d2.view(np.int64)}


def _digests(keyed: DataFrame, min_words: int, sentences: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                u = units_of(data, offsets, sentences)
                yield pa.RecordBatch.from_arrays([pa.array(u["d1"][u["n"] >= min_words])], ["d1"])

    return keyed.select("text").mapInArrow(tidy(run), "d1 long")


def _places(keyed: DataFrame, doc_id: str, min_words: int, sentences: bool, wanted) -> DataFrame:
    """Digests and places of the units whose digest may be in the broadcast filter."""

    def run(batches):
        for b in batches:
            k1, k2 = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(b.column(0)):
                u = units_of(data, offsets, sentences)
                use = np.flatnonzero(u["n"] >= min_words)
                use = use[wanted.value.might(u["d1"][use])]
                r = lo + u["row"][use]
                yield pa.RecordBatch.from_arrays([pa.array(u["d1"][use]), pa.array(u["d2"][use]), b.column(3).take(pa.array(r)), pa.array(k1[r]), pa.array(k2[r], pa.int32()), pa.array(u["a"][use], pa.int32()), pa.array(u["z"][use], pa.int32())], ["d1", "d2", "id", "k1", "k2", "a", "z"])

    kind = keyed.schema[doc_id].dataType
    schema = T.StructType([T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("id", kind), T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType()), T.StructField("a", T.IntegerType()), T.StructField("z", T.IntegerType())])
    return keyed.select("text", "k1", "k2", doc_id).mapInArrow(tidy(run), schema)


RESULT = T.StructType([T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_starts", T.ArrayType(T.IntegerType())), T.StructField("removed_ends", T.ArrayType(T.IntegerType())), T.StructField("kept_starts", T.ArrayType(T.IntegerType())), T.StructField("kept_ends", T.ArrayType(T.IntegerType())), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])


def dedup_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, sentences: bool = True) -> tuple[DataFrame, str]:
    """docs without ``text`` and with a struct: units, removed ones, byte offsets of removed and kept units in the original
    text, and the text without the removed ones."""
    spark = docs.sparkSession
    tune(spark)
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    i, t = inner[doc_id], inner[text]
    keyed = plain.select(*(F.col(c) for c in plain.columns if c != t), F.coalesce(F.col(t), F.lit("")).alias("text")).withColumns({"k1": F.xxhash64(i, "text"), "k2": F.hash(i, "text")})
    several = shared_table(_digests(keyed, min_words, sentences).groupBy("d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1"))
    places = shared_table(_places(keyed, i, min_words, sentences, key_filter(several, "d1", several.count())))
    ranked = places.select("d1", "d2", F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2", "a").alias("rank"), "z")
    earliest = shared_table(ranked.groupBy("d1", "d2").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    lost = join_back(ranked, earliest, ["d1", "d2"], places.count())
    gone = shared_table(lost.where("rank != first").groupBy("rank.k1", "rank.k2").agg(F.sort_array(F.collect_set(F.struct("rank.a", "z"))).alias("gone")))
    del ranked, earliest, places, lost
    free(spark)
    there = key_filter(gone, "k1", gone.count())
    name = free_name(docs.columns, "_units")
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [f for f in keyed.schema if f.name not in ("k1", "k2", "text")]
    arrow = to_arrow_schema(T.StructType([T.StructField(name, RESULT)])).field(0).type
    fields = pa.struct([arrow.field(k) for k in range(arrow.num_fields)])
    names = [f.name for f in others]

    def rows(b, gone):
        data, offsets = text_buffers(b.column(b.schema.get_field_index("text")))
        raw = data.tobytes()
        u = units_of(data, offsets, sentences)
        cut = np.searchsorted(u["row"], np.arange(len(b) + 1))
        out = [[] for _ in RESULT]
        for k, spans in enumerate(gone):
            body = raw[offsets[k] : offsets[k + 1]]
            lost = {s["a"]: s["z"] for s in spans or []}
            starts, ends = list(lost), list(lost.values())
            rest = b"".join([body[x:y] for x, y in zip([0, *ends], [*starts, len(body)], strict=True)])
            own = [(a, z) for a, z in zip(u["a"][cut[k] : cut[k + 1]].tolist(), u["z"][cut[k] : cut[k + 1]].tolist(), strict=True) if a not in lost]
            row = (int(cut[k + 1] - cut[k]), len(lost), starts, ends, [a for a, _ in own], [z for _, z in own], hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace"))
            for values, v in zip(out, row, strict=True):
                values.append(v)
        return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), as_struct(out, fields)], [*names, name])

    def touched(batches):
        for b in batches:
            yield rows(b, b.column(b.schema.get_field_index("gone")).to_pylist())

    def untouched(batches):
        for b in batches:
            b = b.filter(pa.array(~there.value.might(b.column(b.schema.get_field_index("k1")).to_numpy(zero_copy_only=False))))
            yield rows(b, [None] * len(b))

    schema = T.StructType([*others, T.StructField(name, RESULT)])
    joined = passing(keyed, "k1", there).join(gone, ["k1", "k2"], "left").drop("k1", "k2")
    result = joined.mapInArrow(tidy(touched), schema).unionByName(keyed.drop("k2").mapInArrow(tidy(untouched), schema))
    back = {n: c for c, n in inner.items()}
    return result.select(*(F.col(n).alias(back[n]) for n in names), name), name


def op3_line_hashing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done, name = dedup_units(docs)
    return done.select("doc_id", f"`{name}`.*").withColumnRenamed("kept", "text")


def brute(docs: list[tuple], min_words: int = MIN_WORDS) -> dict:
    """Plain restatement for tests: {doc_id: (units, kept text)}; ids are unlike and not null."""
    import re

    seen, out = set(), {}
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    for d, t in sorted(docs):
        t, n, rest, at = t or "", 0, [], 0
        units: list[list[int]] = []
        for line in re.finditer(r"[^\n]+", t):
            open_ = False
            for w in re.finditer(r"[^\x20\x09-\x0D]+", line[0]):
                a, z = line.start() + w.start(), line.start() + w.end()
                if open_:
                    units[-1][1], units[-1][2] = z, units[-1][2] + 1
                else:
                    units.append([a, z, 1])
                open_ = w[0][-1] not in ".!?"
        for a, z, words in units:
            key = tuple(re.findall(r"[^\x20\x09-\x0D]+", low(t[a:z])))
            if words >= min_words and key in seen:
                rest.append(t[at:a])
                at = z
            seen.add(key) if words >= min_words else None
        out[d] = (len(units), "".join(rest) + t[at:])
    return out
