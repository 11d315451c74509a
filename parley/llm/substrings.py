"""Repeated substrings by suffix arrays: everything covered by a string of ``Unit.length`` symbols that also starts elsewhere.

A symbol is a byte (``BYTES``: 400 of them, op5's contract) or a word (``WORDS``: 50, by a 32-bit hash in lower case; two unlike
words share one with odds of one in four billion). Several units are treated in one go.

1. A window (length symbols) is known by the smallest hash of its grams, which depends on its symbols alone, so equal windows
   always share it. Neighbouring windows with the same smallest hash form a run; a text has about one run for every 140
   bytes. First hashes are counted, with map-side sums.
2. A hash seen in one run only cannot have a repeated window (unless the run repeats within itself, which is noticed); only
   the others are shuffled with their places. Runs that are equal as a whole are counted, and one of them stands for all.
3. The distinct runs of a hash are laid out together. They are cut into phrases where a gram's hash says so; a phrase is read
   on to the end of the gram behind it, so no phrase begins another one and the order of phrases is that of what they
   hold. The suffix array of the phrases is built by grouping (``gsaca``). It gives the order of the suffixes at every
   symbol: by what stands before the first cut, then by the rank of the cut. Neighbours in this order that agree for
   ``length`` symbols (by the least common prefix between their ranks) are repeated windows.
4. A window without a cut has nothing to be ranked by; such windows are compared by two 64-bit hashes.

A task lays out at most ``HOT_BYTES`` of runs of one hash. Larger groups (a passage in very many different settings) go
another exact way: the digests of all their windows are counted by an aggregation, so no group is ever gathered. Texts are
shuffled only where they have something to compare or to lose, as broadcast key filters tell.

Defined results: a null text is empty; texts under ``length`` symbols lose nothing; repeated rows are copies of each other, so
both lose what they share; a null id is an id like any other; other columns are carried along; an empty table gives no
rows. All occurrences go, the first one too.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.core import BASE, INVERSE, NOT_SPACE, as_struct, free, free_name, key_filter, mix, passing, powers, prefix_sums, shared_table, slices, text_buffers, tidy, tune, word_hashes, words_of
from parley.llm.gsaca import common_prefixes, suffix_array

LAYOUT_BYTES = 1 << 18
HOT_BYTES = 4 << 20

BASE2 = 0xC2B2AE3D27D4EB4F
INVERSE2 = pow(BASE2, -1, 1 << 64)


@dataclass(frozen=True)
class Unit:
    """What a symbol is, and how many make a string that must not occur twice; ``gram`` of them tell windows apart, phrases
    have some 2**phrase_bits and are cut by ``anchor`` of them."""

    words: bool = False
    length: int = 400
    gram: int = 128
    phrase_bits: int = 5
    anchor: int = 8

    def __post_init__(self):
        if not 0 < self.gram <= self.length or not 0 < self.anchor <= self.length:
            raise ValueError(f"no windows by {self}")

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u4") if self.words else np.dtype(np.uint8)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, offsets) of UTF-8 texts."""
        if not self.words:
            return data, offsets
        starts, ends, row = words_of(data, offsets, NOT_SPACE)
        return (word_hashes(data, starts, ends) >> np.uint64(32)).astype(self.kind), np.searchsorted(row, np.arange(len(offsets)))


BYTES = Unit()
WORDS = Unit(True, 50, 16, 3, 2)


def window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(v)
    if n < width:
        return v[:0]
    pad = -n % width
    block = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def gram_hashes(data: np.ndarray, k: int, base: int = BASE, inverse: int = INVERSE) -> np.ndarray:
    """Hash of the k symbols at each position (len - k + 1 of them)."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data.astype(np.uint64) + np.uint64(1), base)
    return mix((sums[k:] - sums[:-k]) * powers(len(data), inverse)[: len(data) - k + 1])


def span_digest(sums: np.ndarray, inverse: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums), inverse)[starts] ^ (ends - starts).astype(np.uint64))


def windows_of(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of windows of each text, where each window starts)."""
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    return count, np.repeat(offsets[:-1] - np.append(0, np.cumsum(count))[:-1], count) + np.arange(count.sum())


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows with one smallest hash: row, hash, two digests, first window in the row, windows, whether it may repeat itself."""
    h = gram_hashes(data, gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    low = window_min(key, length - gram + 1)
    count, at = windows_of(offsets, length)
    row = np.repeat(np.arange(len(offsets) - 1), count)
    if not len(at):
        z = np.zeros(0, np.int64)
        return {"row": z, "h": z.astype(np.uint64), "d1": z, "d2": z, "s": z, "n": z, "own": z.astype(bool)}
    place = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    move = np.append(True, place[1:] != place[:-1])
    step = np.flatnonzero(move)  # first windows with a new place of the smallest gram
    value = h[place[step]]
    new = np.append(True, (value[1:] != value[:-1]) | (row[step][1:] != row[step][:-1]))
    first = step[new]
    n = np.diff(np.append(first, len(at)))
    own = np.diff(np.append(np.flatnonzero(new), len(step))) > 1
    wide = data.astype(np.uint64) + np.uint64(1)
    s1, s2 = prefix_sums(wide), prefix_sums(wide, BASE2)
    a, z = at[first], at[first] + n + length - 1
    return {"row": row[first], "h": value[new], "d1": span_digest(s1, INVERSE, a, z).view(np.int64), "d2": span_digest(s2, INVERSE2, a, z).view(np.int64), "s": at[first] - offsets[row[first]], "n": n, "own": own}


# ---------------------------------------------------------------------------------------------- windows of one layout


def agreeing(data: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols from a and from b on are equal, up to ``most``; the first ``least`` are known to be."""
    out = np.minimum(least, most)
    live = np.flatnonzero(out < most)
    while len(live):
        live = live[data[a[live] + out[live]] == data[b[live] + out[live]]]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


class Least:
    """Smallest value of any stretch, from tables over stretches of 1, 2, 4 ... values."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 << (len(self.tables) - 1) <= len(values):
            half = 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(self.tables[-1][:-half], self.tables[-1][half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of values[lo:hi], hi above lo."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), self.tables[0].dtype)
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.tables[k][lo[m]], self.tables[k][hi[m] - (1 << k)])
        return out


class Cuts:
    """The suffix array at the cuts of a layout: rank of each cut, and common prefixes (up to length) of array neighbours."""

    def __init__(self, data: np.ndarray, end_of: np.ndarray, unit: Unit):
        grams = gram_hashes(data, unit.anchor)
        cuts = np.flatnonzero(grams >> np.uint64(64 - unit.phrase_bits) == 0)
        self.cuts = cuts = cuts[cuts + unit.anchor <= end_of[cuts]]
        if not len(cuts):
            return
        end = end_of[cuts]
        stop = np.minimum(np.append(cuts[1:], len(data)) + unit.anchor, end)
        raw, size = data.tobytes(), data.itemsize
        phrases = [raw[a:z] for a, z in zip((cuts * size).tolist(), (stop * size).tolist(), strict=True)]
        symbol = {p: i for i, p in enumerate(sorted(set(phrases)))}
        text = [symbol[p] for p in phrases]
        order = suffix_array(text)
        shared = np.array(common_prefixes(text, order), np.int64)
        order = np.array(order)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        # whole phrases agree first, then symbols are looked at; a text's end ends all
        a, b = order[1:], order[:-1]
        reach = np.append(cuts, len(data))
        most = np.minimum(unit.length, np.minimum(end[a] - cuts[a], end[b] - cuts[b]))
        self.common = np.concatenate([[0], agreeing(data, cuts[a], cuts[b], reach[a + shared[1:]] - cuts[a], most), [0]])
        self.best = np.maximum(self.common[:-1], self.common[1:])[self.rank]
        self.least = Least(self.common)


def repeated_windows(texts: list[bytes], weight: np.ndarray, unit: Unit = BYTES) -> list[np.ndarray]:
    """For each text the windows that occur twice or more among all texts, each text counted ``weight`` times."""
    length = unit.length
    data = np.frombuffer(b"".join(texts), unit.kind)
    size = np.array([len(t) for t in texts]) // data.itemsize
    offsets = np.append(0, np.cumsum(size))
    count, at = windows_of(offsets, length)
    sums = prefix_sums(data.astype(np.uint64) + np.uint64(1))
    array = Cuts(data, np.repeat(offsets[1:], size), unit)
    hit = np.zeros(len(at), bool)
    k = np.searchsorted(array.cuts, at)
    cut = np.append(array.cuts, len(data))[k]
    ranked = cut + unit.anchor <= at + length
    some = np.flatnonzero(ranked)
    some = some[array.best[k[some]] >= (at + length - cut)[some]] if len(some) else some
    if len(some):
        before, rank = span_digest(sums, INVERSE, at[some], cut[some]), array.rank[k[some]]
        order = np.lexsort((rank, before))
        some, before, rank = some[order], before[order], rank[order]
        pair = np.flatnonzero(before[1:] == before[:-1])
        pair = pair[array.least(rank[pair] + 1, rank[pair + 1] + 1) >= (at + length - cut)[some[pair]]] if len(pair) else pair
        hit[some[pair]] = hit[some[pair + 1]] = True
    rest = np.flatnonzero(~ranked)
    if len(rest):
        s2 = prefix_sums(data.astype(np.uint64) + np.uint64(1), BASE2)
        one, two = span_digest(sums, INVERSE, at[rest], at[rest] + length), span_digest(s2, INVERSE2, at[rest], at[rest] + length)
        order = np.lexsort((two, one))
        same = np.flatnonzero((one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]))
        hit[rest[order[same]]] = hit[rest[order[same + 1]]] = True
    found = at[hit]
    cut = np.searchsorted(found, offsets)
    return [np.arange(n) if w > 1 else found[a:z] - o for n, w, a, z, o in zip(count, weight, cut, cut[1:], offsets)]


def intervals(windows: np.ndarray) -> tuple[list[int], list[int]]:
    """(first window, number of windows) of the maximal runs of consecutive windows."""
    if not len(windows):
        return [], []
    gap = np.flatnonzero(np.diff(windows) > 1)
    a = windows[np.append(0, gap + 1)]
    z = windows[np.append(gap, len(windows) - 1)]
    return a.tolist(), (z - a + 1).tolist()


# ---------------------------------------------------------------------------------------------------- over a cluster


RUN = "h long, d1 long, d2 long, k1 long, k2 int, s int, n int, own boolean"


def unit_of(h: int, units: tuple[Unit, ...]) -> int:
    """The top bits of a run's hash tell its unit, so runs of unlike units never meet."""
    return (h & ((1 << 64) - 1)) >> 62


def _runs(keyed: DataFrame, units: tuple[Unit, ...], wanted=None) -> DataFrame:
    """Runs of every text in every unit; only those whose hash may be in the broadcast filter, if one is given."""

    def run(batches):
        for b in batches:
            k1, k2 = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(b.column(0)):
                for u, unit in enumerate(units):
                    r = runs_of(*unit.read(data, offsets), unit.length, unit.gram)
                    h = (r["h"] >> np.uint64(2) | np.uint64(u << 62)).view(np.int64)
                    m = np.flatnonzero(wanted.value.might(h)) if wanted is not None else np.arange(len(h))
                    yield pa.RecordBatch.from_arrays([pa.array(h[m]), pa.array(r["d1"][m]), pa.array(r["d2"][m]), pa.array(k1[lo:hi][r["row"][m]]), pa.array(k2[lo:hi][r["row"][m]], pa.int32()), pa.array(r["s"][m], pa.int32()), pa.array(r["n"][m], pa.int32()), pa.array(r["own"][m])], ["h", "d1", "d2", "k1", "k2", "s", "n", "own"])

    return keyed.select("text", "k1", "k2").mapInArrow(tidy(run), RUN)


def _pieces(keyed: DataFrame, wanted: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """The symbols of the wanted runs (h, c, k1, k2, s, n)."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "c", "s", "n")).alias("runs"))
    joined = keyed.join(lists, ["k1", "k2"]).select("text", "k1", "k2", "runs")

    def run(batches):
        for b in batches:
            row = 0
            keys, lists = b.column(1).to_pylist(), b.column(2).to_pylist()
            runs = b.column(3).to_pylist()
            for lo, hi, data, offsets in slices(b.column(0)):
                out = {"h": [], "c": [], "k1": [], "k2": [], "s": [], "piece": []}
                read = [None] * len(units)
                for row in range(lo, hi):
                    for r in runs[row]:
                        u = unit_of(r["h"], units)
                        if read[u] is None:
                            symbols, cut = units[u].read(data, offsets)
                            read[u] = symbols.tobytes(), (cut * symbols.itemsize).tolist(), symbols.itemsize
                        raw, cut, size = read[u]
                        a = cut[row - lo] + r["s"] * size
                        for name, v in (("h", r["h"]), ("c", r["c"]), ("k1", keys[row]), ("k2", lists[row]), ("s", r["s"]), ("piece", raw[a : a + (r["n"] + units[u].length - 1) * size])):
                            out[name].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["h"], pa.int64()), pa.array(out["c"], pa.int64()), pa.array(out["k1"], pa.int64()), pa.array(out["k2"], pa.int32()), pa.array(out["s"], pa.int32()), pa.array(out["piece"], pa.binary())], list(out))

    # repeated rows have the same keys and symbols: what they say twice is said once in the end
    return joined.mapInArrow(tidy(run), "h long, c long, k1 long, k2 int, s int, piece binary")


def _compare(pieces: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Repeated windows among the distinct runs of each hash: (k1, k2, u, s, n). Runs of a hash stand together."""

    def emit(u, held):
        found = repeated_windows([x[4] for x in held], np.array([x[0] for x in held], np.int64), units[u])
        out = {"k1": [], "k2": [], "u": [], "s": [], "n": []}
        for (c, k1, k2, s, _), w in zip(held, found, strict=True):
            if c == 1:
                for a, n in zip(*intervals(w), strict=True):
                    out["k1"].append(k1), out["k2"].append(k2), out["u"].append(u), out["s"].append(s + a), out["n"].append(n)
        return pa.RecordBatch.from_arrays([pa.array(out["k1"], pa.int64()), *(pa.array(out[c], pa.int32()) for c in ("k2", "u", "s", "n"))], list(out))

    def run(batches):
        held, size, last, before = [], 0, None, None
        for b in batches:
            for h, c, k1, k2, s, piece in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if held and h != last and (size >= LAYOUT_BYTES or unit_of(h, units) != unit_of(last, units)):
                    yield emit(unit_of(last, units), held)
                    held, size = [], 0
                # a row that occurs twice sends its runs twice
                if (h, k1, k2, s) != before:
                    held.append((c, k1, k2, s, piece))
                    size += len(piece)
                last, before = h, (h, k1, k2, s)
        if held:
            yield emit(unit_of(last, units), held)

    return pieces.repartition("h").sortWithinPartitions("h", "k1", "k2", "s").mapInArrow(tidy(run), "k1 long, k2 int, u int, s int, n int")


def _count_windows(pieces: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """The same for groups too large to lay out: window digests are counted, nothing is gathered."""

    def run(batches):
        for b in batches:
            for h, c, k1, k2, s, piece in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                u = unit_of(h, units)
                d = np.frombuffer(piece, units[u].kind)
                one, two = gram_hashes(d, units[u].length), gram_hashes(d, units[u].length, BASE2, INVERSE2)
                n = len(one)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, c)), pa.array(np.full(n, k1)), pa.array(np.full(n, k2, np.int32)), pa.array(np.full(n, u, np.int32)), pa.array((s + np.arange(n)).astype(np.int32))], ["w1", "w2", "c", "k1", "k2", "u", "s"])

    windows = pieces.dropDuplicates(["h", "k1", "k2", "s"]).mapInArrow(tidy(run), "w1 long, w2 long, c long, k1 long, k2 int, u int, s int")
    twice = windows.groupBy("u", "w1", "w2").agg(F.sum("c").alias("total")).where("total > 1").select("u", "w1", "w2")
    return windows.where("c = 1").join(twice, ["u", "w1", "w2"]).select("k1", "k2", "u", "s", F.lit(1).alias("n"))


def repeated_spans(docs: DataFrame, doc_id: str, text: str, units: tuple[Unit, ...] = (BYTES,), hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents with keys k1, k2 and the text as ``text``; first windows and numbers of windows that are repeated, by unit)."""
    if not 0 < len(units) <= 4:
        raise ValueError("one to four units")
    tune(docs.sparkSession)
    keyed = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.coalesce(F.col(text), F.lit("")).alias(text)).withColumns({"k1": F.xxhash64(doc_id, text), "k2": F.hash(doc_id, text)}).withColumnRenamed(text, "text")
    counts = _runs(keyed, units).groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.max("own").alias("self"))
    kept = shared_table(counts.where("m > 1 or self").select("h", F.expr("lo != hi or self").alias("several")))
    runs = _runs(keyed, units, key_filter(kept, "h", kept.count())).drop("own")
    runs = shared_table(runs.join(kept, "h"))
    free(docs.sparkSession)
    unit = F.shiftrightunsigned("h", 62).cast("int").alias("u")
    whole = runs.where(~F.col("several")).select("k1", "k2", unit, "s", "n")
    mixed = runs.where("several")
    distinct = shared_table(mixed.groupBy("h", "d1", "d2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "s", "n")).alias("r")).select("h", "d1", "d2", "c", "r.*"))
    copies = mixed.join(distinct.where("c > 1").select("h", "d1", "d2"), ["h", "d1", "d2"]).select("k1", "k2", unit, "s", "n")
    # of a run in one copy no window but those found below can be repeated
    sizes = distinct.groupBy("h").agg(F.sum((F.col("n") + _by_unit(units, lambda u: u.length)) * _by_unit(units, lambda u: u.kind.itemsize)).alias("bytes"))
    hot = sizes.where(F.col("bytes") > hot_bytes).select("h")
    held = passing(keyed.select("text", "k1", "k2"), "k1", key_filter(distinct, "k1", distinct.agg(F.approx_count_distinct("k1")).first()[0]))
    if hot.isEmpty():
        found = _compare(_pieces(held, distinct, units), units)
    else:
        found = _compare(_pieces(held, distinct.join(hot, "h", "left_anti"), units), units).unionByName(_count_windows(_pieces(held, distinct.join(hot, "h", "left_semi"), units), units))
    return keyed, whole.unionByName(copies).unionByName(found)


def _by_unit(units: tuple[Unit, ...], of):
    u = F.shiftrightunsigned("h", 62)
    out = F.lit(of(units[0]))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(u == k, F.lit(of(unit))).otherwise(out)
    return out


_SPANS = T.ArrayType(T.IntegerType())
RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("starts", _SPANS), T.StructField("ends", _SPANS), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("word_starts", _SPANS), T.StructField("word_ends", _SPANS), T.StructField("n_words", T.LongType())])


def merged(a: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (start, end) made one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(a):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def judged(raw: bytes, spans: list[dict], units: tuple[Unit, ...], cut: tuple[Unit, ...], with_text: bool) -> tuple:
    """One row of RESULT: what goes by the units of ``cut``, and the passages (byte spans, words) by units of words."""
    lost, passages, words = [], [], 0
    by_unit: dict[int, list] = {}
    for r in spans:
        by_unit.setdefault(r["u"], []).append((r["s"], r["s"] + r["n"] + units[r["u"]].length - 1))
    for u, found in by_unit.items():
        found = merged(found)
        if units[u].words:
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = words_of(data, np.array([0, len(raw)]), NOT_SPACE)
            words += sum(z - a for a, z in found)
            found = [(int(starts[a]), int(ends[z - 1])) for a, z in found]
            passages += found
        if units[u] in cut:
            lost += found
    lost, passages = merged(lost), merged(passages)
    rest = b"".join([raw[x:y] for x, y in zip([0, *(z for _, z in lost)], [*(a for a, _ in lost), len(raw)], strict=True)])
    return (len(raw), len(raw) - len(rest), [a for a, _ in lost], [z for _, z in lost], hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None, [a for a, _ in passages], [z for _, z in passages], words)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", units: tuple[Unit, ...] = (BYTES,), cut: tuple[Unit, ...] | None = None, hot_bytes: int = HOT_BYTES, with_text: bool = True) -> tuple[DataFrame, str]:
    """docs without ``text`` and with a struct: bytes, removed bytes and spans, digest and text of the rest, and the passages
    that units of words found. Only the units of ``cut`` (all, if not given) remove anything.

    The digest is of the exact rest; the text leaves out what a cut through a character leaves of it.
    """
    cut = units if cut is None else cut
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    keyed, spans = repeated_spans(plain, inner[doc_id], inner[text], units, hot_bytes)
    lists = shared_table(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("u", "s", "n")).alias("spans")))
    del spans
    free(docs.sparkSession)
    there = key_filter(lists, "k1", lists.count())
    name = free_name(docs.columns, "_repeats")
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [f for f in keyed.schema if f.name not in ("k1", "k2", "text")]
    arrow = to_arrow_schema(T.StructType([T.StructField(name, RESULT)])).field(0).type
    fields = pa.struct([arrow.field(i) for i in range(arrow.num_fields)])
    names = [f.name for f in others]

    def rows(b, spans):
        data, offsets = text_buffers(b.column(b.schema.get_field_index("text")))
        raw, at = data.tobytes(), offsets.tolist()
        out = [[] for _ in RESULT]
        for i in range(len(b)):
            for column, v in zip(out, judged(raw[at[i] : at[i + 1]], spans[i] or [], units, cut, with_text), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), as_struct(out, fields)], [*names, name])

    def touched(batches):
        for b in batches:
            yield rows(b, b.column(b.schema.get_field_index("spans")).to_pylist())

    def untouched(batches):
        for b in batches:
            b = b.filter(pa.array(~there.value.might(b.column(b.schema.get_field_index("k1")).to_numpy(zero_copy_only=False))))
            yield rows(b, [None] * len(b))

    schema = T.StructType([*others, T.StructField(name, RESULT)])
    found = passing(keyed, "k1", there).join(lists, ["k1", "k2"], "left").drop("k1", "k2").mapInArrow(tidy(touched), schema)
    result = found.unionByName(keyed.drop("k2").mapInArrow(tidy(untouched), schema))
    back = {n: c for c, n in inner.items()}
    return result.select(*(F.col(n).alias(back[n]) for n in names), name), name


def strip_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", units: tuple[Unit, ...] = (BYTES, WORDS)) -> DataFrame:
    """The documents with what repeats in any unit taken out of their texts (and n_chars set anew where texts change)."""
    done, name = remove_repeats(docs, doc_id, text, units)
    r = F.col(name)
    new = {c: F.col(f"`{c}`") for c in docs.columns if c != text}
    if n_chars in new:
        new[n_chars] = F.when(r["n_removed"] > 0, F.char_length(r["kept"]).cast(docs.schema[n_chars].dataType)).otherwise(new[n_chars])
    new[text] = r["kept"]
    return done.select(*(new[c].alias(c) for c in docs.columns))


def op5_suffix_array(spark, sf_dir: str) -> DataFrame:
    """The contract's columns by bytes, and beside them the passages of 50 words or more that occur elsewhere too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done, name = remove_repeats(docs, units=(BYTES, WORDS), cut=(BYTES,), with_text=False)
    r = F.col(name)
    return done.select("doc_id", r["n_bytes"].alias("n_bytes"), r["n_removed"].alias("n_removed"), F.size(r["starts"]).cast("long").alias("n_spans"), r["kept_sha256"].alias("kept_sha256"), F.size(r["word_starts"]).cast("long").alias("n_passages"), r["n_words"].alias("n_passage_words"))


def brute(docs: list[tuple], length: int = BYTES.length) -> list[tuple]:
    """Plain restatement for tests: [(doc_id, n_bytes, n_removed, n_spans, sha256)] in the order of docs."""
    raw = [(t or "").encode() for _, t in docs]
    seen: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            k = hashlib.blake2b(b[i : i + length], digest_size=16).digest()
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (d, _), b in zip(docs, raw, strict=True):
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def brute_words(docs: list[tuple], length: int = WORDS.length) -> list[list[tuple[int, int]]]:
    """Plain restatement for tests: the byte spans of each document's passages of ``length`` words that start twice."""
    import re

    low = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = [[(m.start(), m.end(), low(m[0])) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in docs]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - length + 1):
            k = tuple(x[2] for x in w[i : i + length])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        hit = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(x[2] for x in w[i : i + length])] > 1:
                hit.update(range(i, i + length))
        runs = [k for k in sorted(hit) if k - 1 not in hit]
        out.append([(w[a][0], w[next(k for k in range(a, len(w) + 1) if k not in hit) - 1][1]) for a in runs])
    return out
