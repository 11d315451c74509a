"""Benchmark decontamination by winnowing.

Of every window of ``WINDOW`` words the smallest hash of its ``K``-word grams (the rightmost on ties) is the fingerprint.
A document window and an item window with the same words choose the same fingerprint, so each shared span of WINDOW
words or more has a fingerprint in common: none is missed. Document fingerprints are looked up among those of the items,
and each hit is extended to its windows, which are compared whole.

The items are read in blocks of at most ``BLOCK_BYTES`` of text; one block is held by a task at a time, its size checked
before it is sent. More items mean more blocks in turn over the same documents, never a larger broadcast. Documents are
not shuffled at all.

Defined results: a null text has no words; an item with null id or without words is ignored; repeated item rows count
once; documents are judged row by row, repeated rows alike; an empty benchmark hits nothing; an empty documents table
gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.core import ALNUM, Lookup, append_result, free_name, gram_hashes, grams_inside, list_array, per_row, shared_checkpoint, text_buffers, tune, word_hashes, words_of

WINDOW = 10
K = 5
BLOCK_BYTES = 8 << 20
CHAIN = 4  #: blocks in one chain of operators; then the state is written to the shared folder

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def fingerprints(grams: np.ndarray, inside: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, gram position) that each window chooses; only windows within one text are to be used (``inside``)."""
    width, n = window - k + 1, len(inside)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        right = grams[j : j + n] <= best
        best[right] = grams[j : j + n][right]
        at[right] = np.flatnonzero(right) + j
    return best, at


class Windows:
    """Window hashes of one length with the items that hold them."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        pairs = np.unique(np.rec.fromarrays([hashes, items], names="h,i"))
        self.lookup = Lookup(pairs.h)
        self.first = np.searchsorted(pairs.h, self.lookup.keys)
        self.count = np.diff(np.append(self.first, len(pairs)))
        self.items = np.asarray(pairs.i)

    def owners(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into key, item) for all items of each key."""
        n = self.count[key]
        at = np.repeat(np.arange(len(key)), n)
        return at, self.items[np.repeat(self.first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


class Index:
    """Fingerprints and windows of a block of items."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW, k: int = K):
        self.ids, self.window, self.k = np.array(ids, object), window, k
        data, offsets = text_buffers(pa.array(texts, pa.large_string()))
        starts, ends, row = words_of(data, offsets, ALNUM)
        words, count = word_hashes(data, starts, ends), per_row(row, len(ids))
        inside = grams_inside(row, window)
        chosen, _ = fingerprints(gram_hashes(words, k), inside, window, k) if len(inside) else (np.zeros(0, np.uint64), None)
        self.chosen = Lookup(chosen[inside])
        self.long = Windows(gram_hashes(words, window, 1)[inside], row[: len(inside)][inside])
        self.short = {}
        for m in sorted({int(c) for c in count if 0 < c < window}):
            first = np.flatnonzero((count[row] == m) & np.append(True, row[1:] != row[:-1])) if len(row) else []
            self.short[m] = Windows(gram_hashes(words, m, 1)[first], row[first])

    def scan(self, words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words are hit, rows of the (row, item) pairs, items of them)."""
        hit = np.zeros(len(words) + 1, np.int64)
        pairs = []

        def take(at, key, length, windows):
            np.add.at(hit, at, 1)
            np.add.at(hit, at + length, -1)
            seen = np.unique(row[at] * (len(windows.lookup.keys) + 1) + key)
            r, key = np.divmod(seen, len(windows.lookup.keys) + 1)
            at, item = windows.owners(key)
            pairs.append(r[at] * len(self.ids) + item)

        inside = grams_inside(row, self.window)
        if len(inside) and len(self.chosen.keys):
            grams = gram_hashes(words, self.k)
            # a window can only hit where one of its grams is a fingerprint of an item
            near = np.zeros(len(grams) + 1, np.int64)
            found, _ = self.chosen.find(grams)
            lo = np.maximum(found - (self.window - self.k), 0)
            np.add.at(near, lo, 1)
            np.add.at(near, found + 1, -1)
            todo = np.flatnonzero((np.cumsum(near)[: len(inside)] > 0) & inside)
            if len(todo):
                best = np.min(grams[todo[:, None] + np.arange(self.window - self.k + 1)], axis=1)
                todo = todo[self.chosen.find(best)[0]]
            if len(todo):
                whole = gram_hashes_at(words, todo, self.window)
                at, key = self.long.lookup.find(whole)
                if len(at):
                    take(todo[at], key, self.window, self.long)
        for m, windows in self.short.items():
            inside = grams_inside(row, m)
            at, key = windows.lookup.find(gram_hashes(words, m, 1))
            ok = inside[at]
            if ok.any():
                take(at[ok], key[ok], m, windows)
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return np.cumsum(hit[:-1]) > 0, *np.divmod(pairs, max(1, len(self.ids)))


def gram_hashes_at(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """As gram_hashes(words, k, 1)[at], for few positions."""
    return gram_hashes(words[at[:, None] + np.arange(k)].T, k, 1)[0] if len(at) else np.zeros(0, np.uint64)


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items in blocks of bounded size, by a hash of their texts (equal texts share a block). A block's size is summed
    before it is fetched, and one that is too large is parted again; only a single text can be larger."""
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).distinct()
    size = F.sum(F.octet_length("text") + F.octet_length("id") + 64)

    def parted(rows: DataFrame, total: int, depth: int):
        if total <= block_bytes:
            yield rows
            return
        parts = -(-total // max(1, block_bytes // 2))
        part = F.pmod(F.xxhash64("text", F.lit(depth)), F.lit(parts))
        for r in rows.groupBy(part.alias("k")).agg(size.alias("size"), (F.min("text") == F.max("text")).alias("one")).orderBy("k").collect():
            some = rows.where(part == r["k"])
            if r["one"]:
                yield some
            else:
                yield from parted(some, r["size"], depth + 1)

    for rows in parted(items, items.agg(size).first()[0] or 0, 0):
        got = rows.collect()
        if got:
            yield [r.id for r in got], [r.text for r in got]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", name: str | None = None, keep_text: bool = True, window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """docs with a struct of n_words, maximal hit spans [starts, ends) in words, and the items hit (as strings)."""
    spark = docs.sparkSession
    tune(spark)
    name = name or free_name(docs.columns, "_contamination")
    out, used, n = docs, None, 0
    it = blocks_of(benchmark, item_id, item_text, block_bytes)
    block = next(it, None)
    while True:
        following = next(it, None) if block is not None else None
        shipped = spark.sparkContext.broadcast(block or ([], []))
        last = following is None
        state = free_name(out.columns, name)

        def make(shipped=shipped):
            index = Index(*shipped.value, window, k)

            def scan(data, offsets):
                n = len(offsets) - 1
                starts, ends, row = words_of(data, offsets, ALNUM)
                hit, r, item = index.scan(word_hashes(data, starts, ends), row, n)
                edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]])) if len(hit) else np.zeros(1, int)
                first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
                begins = hit & (edge[:-1].astype(bool) | first) if len(hit) else hit
                last_of = np.concatenate([first[1:], [True]]) if len(row) else first
                stops = hit & (edge[1:].astype(bool) | last_of) if len(hit) else hit
                base = np.searchsorted(row, np.arange(n))
                b, e = np.flatnonzero(begins), np.flatnonzero(stops)
                return [per_row(row, n), list_array((b - base[row[b]]).astype(np.int32), row[b], n, pa.int32()), list_array((e + 1 - base[row[e]]).astype(np.int32), row[e], n, pa.int32()), list_array(index.ids[item].astype(object) if len(item) else [], r, n, pa.string())]

            return scan

        out = append_result(out, text, make, RESULT, state, keep_text or not last)
        out = out if used is None else merge_states(out, used, state, name)
        used = state if used is None else name
        if used != name:
            out, used = out.withColumnRenamed(used, name), name
        n += 1
        if not last and n % CHAIN == 0:
            out = shared_checkpoint(out)
        block = following
        if last:
            return out, name


def merge_states(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """The spans of two blocks united, the items added."""
    spans = F.array_sort(F.concat(F.arrays_zip(F.col(a)["starts"].alias("s"), F.col(a)["ends"].alias("e")), F.arrays_zip(F.col(b)["starts"].alias("s"), F.col(b)["ends"].alias("e"))))
    kind = "array<struct<s:int,e:int>>"

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] >= x["s"]), joined).otherwise(F.concat(done, F.array(x)))

    spans = F.aggregate(spans.cast(kind), F.array().cast(kind), add)
    merged = F.struct(F.col(a)["n_words"].alias("n_words"), spans["s"].alias("starts"), spans["e"].alias("ends"), F.array_union(F.col(a)["items"], F.col(b)["items"]).alias("items"))
    keep = [c for c in df.columns if c not in (a, b)]
    return df.select(*(F.col(f"`{c}`") for c in keep), merged.alias(name))


def n_hit(result: Column) -> Column:
    return F.aggregate(F.zip_with(result["starts"], result["ends"], lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any benchmark window, all columns kept."""
    marked, name = mark_contamination(docs, benchmark, text, **options)
    return marked.where(F.size(F.col(name)["starts"]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked, name = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    r = F.col(name)
    ids = F.array_join(F.array_sort(F.array_distinct(r["items"])), ",")
    return marked.select("doc_id", r["n_words"].alias("n_words"), n_hit(r).alias("n_hit"), F.size(F.array_distinct(r["items"])).cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size(r["starts"]) > 0).alias("contaminated"))


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """Plain restatement for tests: {doc_id: (n_words, n_hit, sorted items)}."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    grams: dict[tuple, set] = {}
    for i, t in items:
        w = low(t)
        if i is not None and w:
            m = min(window, len(w))
            for j in range(len(w) - m + 1):
                grams.setdefault(tuple(w[j : j + m]), set()).add(str(i))
    lengths = {len(g) for g in grams}
    out = {}
    for d, t in docs:
        w, hit, got = low(t), set(), set()
        for m in lengths:
            for j in range(len(w) - m + 1):
                if (g := tuple(w[j : j + m])) in grams:
                    hit.update(range(j, j + m))
                    got |= grams[g]
        out[d] = (len(w), len(hit), sorted(got))
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
