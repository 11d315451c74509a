"""Shared pieces of the text operators: Arrow plumbing, word and window hashes, shared-folder checkpoints.

All per-row work runs in ``mapInArrow`` over the string buffers themselves: no Python string is made for a text unless an
operator needs one. A slice of rows holds about ``SLICE_BYTES`` of text (one row at least), so memory follows the longest
document and not the batch.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import ready as tune
from parley.session import shared_dir

SLICE_BYTES = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; Spark removes it when nothing refers to it any more, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_TABLES: list[str] = []


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark) -> int:
    """Delete the shared tables made so far, once the results that read them are stored; how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_TABLES)
    while _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def free(spark) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more; they else stay until the driver's JVM
    happens to collect its garbage. The driver's own free memory goes back too."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another libc keeps no such arenas
        pass


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow; the worker, which lives on, gives its free memory back at the end of a task."""

    def tidied(batches):
        yield from run(batches)
        _trim()

    return tidied


HOT = 1000  #: keys whose rows are not dealt by key, at most


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, size: str = "n") -> DataFrame:
    """``rows`` joined with their ``groups`` (one for each key, ``size`` rows of ``total``). A group of more than one in ``HOT``
    of all rows is joined by broadcast, so its rows stay where they are; there are never more than ``HOT`` such groups."""
    most = total / HOT
    hot, cold = F.broadcast(groups.where(F.col(size) > most)), groups.where(F.col(size) <= most)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def take_rows(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (k1, k2, ...), each as often as ``wanted`` (k1, k2, times, many) asks for; ``many`` rows have the key and
    are alike, and ``times`` counts for all of them."""
    again = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_copy")
    one = keyed.join(wanted.where("many = 1"), ["k1", "k2"])
    same = keyed.join(wanted.where("many > 1"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return one.unionByName(same).select("*", again).drop("times", "many", "_copy", "k1", "k2")


class KeyFilter:
    """A table of bits over 64-bit keys: says no only to keys that were not put in. Broadcast; at most 2**MOST bits.

    It only spares shuffles: what passes is joined exactly, so a table too small for the keys costs time, not results."""

    MOST = 28

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> np.ndarray:
        return mix(keys.view(U64) ^ U64(0x8A5CD789635D2DFF)) >> U64(64 - bits)

    def might(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots(np.ascontiguousarray(keys), self.bits)
        return (self.table[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


def key_filter(keys: DataFrame, column: str, n: int):
    """Broadcast KeyFilter of a long column of some ``n`` keys. Each task fills its own stretch of the table."""
    bits = min(KeyFilter.MOST, max(16, int(n * 16).bit_length()))
    part = 16  # bits of a stretch

    def spread(batches):
        for b in batches:
            k = b.column(0)
            at = KeyFilter.slots(k.filter(k.is_valid()).to_numpy(), bits)
            at = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(part)).astype(np.int32)), pa.array((at & U64((1 << part) - 1)).astype(np.int32))], ["p", "at"])

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            p, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(p, kind="stable")
            p, at = p[order], at[order]
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else []
            for a, z in zip(first, [*first[1:], len(p)]):
                held.setdefault(int(p[a]), np.zeros(1 << part, bool))[at[a:z]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in held.values()], pa.binary())], ["p", "bits"])

    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in keys.select(column).mapInArrow(tidy(spread), "p int, at int").repartition("p").mapInArrow(tidy(fill), "p int, bits binary").toLocalIterator():
        table[r["p"] << (part - 3) : (r["p"] + 1) << (part - 3)] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(KeyFilter(bits, table))


def passing(df: DataFrame, column: str, shared, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose long ``column`` may be (``inside``) or can't be among the keys of the broadcast filter."""
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.might(b.column(at).to_numpy(zero_copy_only=False)) == inside))

    return df.mapInArrow(tidy(run), df.schema)


def crc_mod(column, n: int):
    """crc32 of the id's decimal text modulo ``n``; a null id counts as remainder of the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def crc_mod_py(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


# ---------------------------------------------------------------------------------------------------- Arrow plumbing


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (one row at least): (first row, last row + 1, bytes, offsets)."""
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def as_struct(columns: list[pa.Array], fields: pa.StructType) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type) for c, f in zip(columns, fields, strict=True)], fields=list(fields))


def free_name(taken, wanted: str = "_out") -> str:
    while wanted.lower() in {x.lower() for x in taken}:
        wanted += "_"
    return wanted


def append_result(df: DataFrame, text: str, make: Callable[[], Callable], result: T.StructType, name: str, keep_text: bool = True) -> DataFrame:
    """``df`` with a struct column ``name``.

    ``make()`` runs once in each task and returns ``f(bytes, offsets) -> list of columns`` for a slice of rows. The struct
    keeps the results apart from whatever other columns ``df`` has, so clashing names do no harm. With keep_text=False the
    text is not sent back to the JVM.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    tune(df.sparkSession)
    kept = [f for f in df.schema if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField(name, result)])
    arrow = to_arrow_schema(T.StructType([T.StructField(name, result)])).field(0).type
    fields = pa.struct([arrow.field(i) for i in range(arrow.num_fields)])
    names = [f.name for f in kept]

    def run(batches):
        f = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            for row, end, data, offsets in slices(batch.column(batch.schema.get_field_index(text))):
                out = as_struct(f(data, offsets), fields)
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), out], [*names, name])

    return df.mapInArrow(tidy(run), schema)


def list_array(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """Lists by row: ``values[i]`` belongs to row ``owner[i]``; owner is ascending."""
    ends = np.searchsorted(owner, np.arange(n + 1), "left").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


# ------------------------------------------------------------------------------------------------------------ hashes


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n + 1, U64)
    out[0] = 1
    out[1:] = U64(base)
    return np.cumprod(out, dtype=U64)


def powers(n: int, base: int = BASE) -> np.ndarray:
    return _powers(1 << max(16, int(n).bit_length()), base)[: n + 1]


def prefix_sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64, a leading zero first."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * powers(len(values), base)[: len(values)], dtype=U64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    """64-bit hash of each span, independent of where it stands; lengths count."""
    h = (sums[ends] - sums[starts]) * powers(len(sums), inverse)[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words: not white space / letters and digits as the decontamination contract names them
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes in ``inside``; runs end with their row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = w.copy()
    starts[1:] &= ~w[:-1] | first[1:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hashes(prefix_sums((LOWER[data] if lower else data).astype(U64) + U64(1)), starts, ends)


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, U64(seed * 2 + 1))
    for j in range(k):
        h = (h ^ words[j : j + n]) * U64(BASE)
        h ^= h >> U64(29)
    return mix(h)


def grams_inside(row: np.ndarray, k: int) -> np.ndarray:
    """Which of the len - k + 1 grams lie within one row."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 : k - 1 + n] if n > 0 else np.zeros(0, bool)


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(row, weights, n) if len(row) else np.zeros(n)
    return out if weights is not None else out.astype(np.int64)


class Lookup:
    """Membership of 64-bit hashes in a fixed set: a bit table first, binary search for what passes."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.unique(hashes)
        self.bits = max(12, int(np.ceil(np.log2(len(self.keys) + 1))) + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.keys >> U64(64 - self.bits)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, indexes into keys) of the members."""
        at = np.flatnonzero(self.table[(h >> U64(64 - self.bits)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == h[at] if len(at) else np.zeros(0, bool)
        return at[ok], k[ok]
