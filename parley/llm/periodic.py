"""Periodic runs of words: repeated k-grams mask the words that can't be in one, Main and Lorentz find the runs in what is left.

A run is a stretch of words with smallest period q, of at least ``LEAST`` words and two periods, that neither neighbour extends.
Its last word but q still repeats q words on, so the stretch holds k-grams that occur again q words later, for
k = LEAST - q at most periods of LEAST / 2 and q above: the least of these overlaps is half of LEAST. Every word of a run lies in
a k-gram that its text repeats; other words are masked.

What stays are segments. Main and Lorentz split each in halves over and over: a run that crosses a split and has period q
repeats the words at the split q words ahead or behind, so the common stretches forward and backward of two places q apart tell
it. All splits of a level, of all segments of many texts, are one numpy step; the common stretches are read from ranks of
stretches of 1, 2, 4, ... words (equal ranks: equal words, no hashes in between). Twice the period is found as well; of the
runs at one place the smallest period stays.

A text is worked through by one task, in slices of bounded bytes; nothing is shuffled. Words are known by 64-bit hashes.

Defined results: a null text has no words and no runs, its collapsed text is empty; repeated rows are judged alike; a text
without runs is its words joined by one space; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.core import NOT_SPACE, append_result, free_name, gram_hashes, grams_inside, list_array, mix, per_row, slices, tidy, tune, word_hashes, words_of

LEAST = 12

RESULT = T.StructType([T.StructField("n_words", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "lengths", "periods")), T.StructField("collapsed", T.StringType())])


def segments(words: np.ndarray, row: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of words that repeated k-grams of their own text cover."""
    k = -(-least // 2)
    at = np.flatnonzero(grams_inside(row, k))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = mix(gram_hashes(words, k)[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
    at = at[pd.Series(grams).duplicated(keep=False).to_numpy()]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    inside = np.cumsum(cover[:-1]) > 0
    first, last = inside.copy(), inside.copy()
    new = row[1:] != row[:-1]
    first[1:] &= ~inside[:-1] | new
    last[:-1] &= ~inside[1:] | new
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


class Ranks:
    """Names of the stretches of 1, 2, 4, ... symbols at every place; places where none fits have names of their own."""

    def __init__(self, codes: np.ndarray, longest: int):
        n = len(codes)
        none = -1 - np.arange(n + 1)
        self.of = [np.append(codes.astype(np.int64), none[-1])]
        while 2 << (len(self.of) - 1) <= longest:
            size, last = 1 << (len(self.of) - 1), self.of[-1]
            m = n + 1 - 2 * size
            if m <= 0:
                break
            names = none.copy()
            names[:m] = pd.factorize(last[:m] * (n + 1) + last[size : size + m])[0]
            # a stretch that leaves its segment holds a border, whose name is unlike all others
            self.of.append(names)
        self.table = np.stack(self.of)

    def same(self, k: np.ndarray | int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = i >= 0
        return ok & (self.table[k, np.maximum(i, 0)] == self.table[k, np.maximum(j, 0)])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            out += np.where(self.same(k, i + out, j + out), 1 << k, 0)
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i equal those before j."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            out += np.where(self.same(k, i - out - (1 << k), j - out - (1 << k)), 1 << k, 0)
        return out


def runs_of(words: np.ndarray, row: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; positions among the words of all rows."""
    none = np.zeros(0, np.int64)
    seg, stop = segments(words, row, least)
    if not len(seg):
        return none, none, none
    # the segments one after the other, each with a border of its own before and behind
    size = stop - seg
    at = np.append(0, np.cumsum(size + 1))[:-1] + 1
    source = np.repeat(seg - at, size) + (place := np.repeat(at - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum()))
    n = int(at[-1] + size[-1]) + 1
    codes = np.arange(n, dtype=np.int64)
    codes[place] = n + pd.factorize(words[source])[0]
    codes = pd.factorize(codes)[0]
    origin = np.zeros(n, np.int64)
    origin[place] = source
    ranks = Ranks(codes, int(size.max()))
    left, right = at, at + size
    found = []
    while True:
        wide = right - left >= least
        left, right = left[wide], right[wide]
        if not len(left):
            break
        middle = (left + right) // 2
        for reach, ahead in ((right - middle, True), (middle - left, False)):
            q = np.arange(reach.sum()) - np.repeat(np.append(0, np.cumsum(reach))[:-1], reach) + 1
            i = np.repeat(middle, reach) - (0 if ahead else q)
            j = i + q
            # of a run, the common stretch on one side is half of what both must come to
            need = np.maximum(q, least - q)
            k = np.minimum(np.log2((need + 1) // 2).astype(np.int64), len(ranks.of) - 1)
            half = np.left_shift(1, k)
            some = np.flatnonzero(ranks.same(k, i, j) | ranks.same(k, i - half, j - half))
            i, j, q, need = i[some], j[some], q[some], need[some]
            back, on = ranks.backward(i, j), ranks.forward(i, j)
            run = back + on >= need
            found.append(np.stack([i[run] - back[run], j[run] + on[run], q[run]]))
        left, right = np.concatenate([left, middle]), np.concatenate([middle, right])
    start, end, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    start, end, q = start[first], end[first], q[first]
    start, end = origin[start], origin[end - 1] + 1
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Text of each of n rows: its words joined by one space."""
    size = ends - starts
    later = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    at = np.cumsum(size + later) - size
    out = np.full(int(size.sum() + later.sum()), 0x20, np.uint8)
    total = int(size.sum())
    step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + step] = data[np.repeat(starts, size) + step]
    offsets = np.append(0, np.cumsum(per_row(row, n, (size + later).astype(np.float64)))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST, keep_text: bool = True) -> tuple[DataFrame, str]:
    """(``docs`` with a struct column, its name): n_words, the runs (starts, lengths, periods; by start, then period) and the
    text without the words that some run holds after its first period."""

    def make():
        def f(data, offsets):
            n = len(offsets) - 1
            a, z, row = words_of(data, offsets, NOT_SPACE)
            start, end, q = runs_of(word_hashes(data, a, z, lower=False), row, least)
            count, first = per_row(row, n), np.searchsorted(row, np.arange(n))
            gone = np.zeros(len(row) + 1, np.int64)
            np.add.at(gone, start + q, 1)
            np.add.at(gone, end, -1)
            kept = np.cumsum(gone[:-1]) == 0
            owner = row[start]
            lists = [list_array(v, owner, n, pa.int64()) for v in (start - first[owner], end - start, q)]
            return [pa.array(count), *lists, joined(data, a[kept], z[kept], row[kept], n)]

        return f

    name = free_name(docs.columns, "_runs")
    return append_result(docs, text, make, RESULT, name, keep_text), name


def plant_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) in which texts of some ids repeat a stretch of their words to the end, by the crc32 of the id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("h"))

    def run(batches):
        for b in batches:
            ids, h = b.column(0), b.column(2).to_numpy()
            for lo, hi, data, offsets in slices(b.column(1)):
                n = hi - lo
                a, z, row = words_of(data, offsets, NOT_SPACE)
                count, first = per_row(row, n), np.searchsorted(row, np.arange(n))
                some = (h[lo:hi] % 10 == 0) & (count > 0)
                own = some[row]
                a, z, row = a[own], z[own], row[own]
                i = np.flatnonzero(own) - first[row]
                g = h[lo:hi] // 10
                start = g % np.maximum(count, 1)
                period = 1 + (count - start) // (3 + g % 8)
                i = np.where(i >= start[row], start[row] + (i - start[row]) % period[row], i)
                # places among the planted rows' own words
                word = np.searchsorted(row, row) + i
                texts = joined(data, a[word], z[word], row, n).cast(pa.string())
                whole = b.column(1).slice(lo, n)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), pa.compute.if_else(pa.array(some), texts, whole.cast(pa.string()))], ["doc_id", "text"])

    tune(docs.sparkSession)
    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text string")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, name = collapse_runs(plant_repeats(docs), keep_text=False)
    run = F.arrays_zip(*(F.col(f"{name}.{c}").alias(c) for c in ("starts", "lengths", "periods")))
    rows = found.select("doc_id", F.col(f"{name}.collapsed").alias("collapsed"), run.alias("runs"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["lengths"].alias("l"), (-r["starts"]).alias("s"), (-r["periods"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["starts"], r["lengths"], r["periods"])), "\n")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"), "collapsed")
    period = -F.col("r.p")
    return rows.select("doc_id", "n_runs", (-F.col("r.s")).alias("start"), F.col("r.l").alias("length"), period.alias("period"), F.expr("(1000 * r.l) div (-r.p)").alias("exponent_milli"), F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def planted(doc_id, text: str | None) -> list[str]:
    """Words of a text as ``plant_repeats`` leaves them, restated plainly for tests."""
    import re
    import zlib

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def brute(w: list[str], least: int = LEAST) -> tuple[list[tuple[int, int, int]], list[str]]:
    """Plain restatement for tests: ([(start, length, period)], kept words), by every period."""
    best: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    runs = sorted((a, z - a, q) for (a, z), q in best.items())
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return runs, [x for i, x in enumerate(w) if i not in gone]
