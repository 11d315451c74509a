"""Packing by vector bin packing.

An example demands tokens, one segment and its loss-bearing tokens (the last ones of its tokens: as many as a column of
the table says, without one all). A sequence holds at most ``Limits``. One sequence is open at a time; of the pooled examples that fit it, the one with
the greatest dot product of demand and what is left (each in shares of its limit, weighted by the pool's mean demand) is
placed next. When none fits, the largest is cut so as to fill the sequence. A sequence that closes with tokens left is cut
into lengths that are powers of two, which need no padding, so nothing is ever padded.

Each task packs its own rows through a pool of ``POOL`` examples (fewer, if they are very long): no shuffle, and a lost task
is simply redone with the same ids. The pool is emptied by what was counted into it, so a task's sequences follow from its
rows alone. Long documents give full sequences first and pool the rest.

Defined results: a null or empty text is its end id alone; repeated rows are packed once each; an empty table gives no
piece; a null id is carried along; a null, negative or too large number of loss-bearing tokens is none, none or all; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.core import slices, tidy, tune
from parley.llm.tokens import SLICE, default_vocabulary, encoder

END_ID = 1
POOL = 384
POOL_IDS = 8 << 20  #: ids of pooled examples that a task holds


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Packer:
    """Takes examples one by one; ``pieces`` collects (example, start, length, sequence, offset)."""

    def __init__(self, limits: Limits, first_sequence: int = 0):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = limits
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.sequence = first_sequence
        self.key, self.start = [], []
        self.size, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open: list[tuple] = []  # of the open sequence: (example, start, length)
        self.left = self.cap.copy()
        self.pieces: list[tuple] = []

    def add(self, examples: list[tuple[object, int, int]]) -> None:
        """examples: (key, tokens, loss-bearing tokens at the end)."""
        key, start, size, loss = list(self.key), list(self.start), self.size.tolist(), self.loss.tolist()
        for k, n, l in examples:
            at = 0
            # full sequences of the long ones; the loss limit may ask for shorter pieces
            while n - at > self.limits.tokens:
                take = self._longest(n - at, min(l, n - at), self.cap)
                self._close([(k, at, take)])
                at += take
            if n > at:
                key.append(k), start.append(at), size.append(n - at), loss.append(min(l, n - at))
        self.key, self.start, self.size, self.loss = key, start, np.array(size, np.int64), np.array(loss, np.int64)
        self._fill()

    def _longest(self, size: int, loss: int, left: np.ndarray) -> int:
        """The longest head of an example that fits: loss-bearing tokens come last."""
        return int(min(size, left[0], size - loss + left[2]))

    def _fill(self) -> None:
        n = len(self.size)
        alive = np.ones(n, bool)
        demand = np.stack([self.size, np.ones(n, np.int64), self.loss], 1) / self.cap if n else np.zeros((0, 3))
        weight = demand.mean(0) if n else None
        todo = n
        while todo:
            left = self.left / self.cap
            score = np.where(alive & (demand <= left + 1e-12).all(1), demand @ (weight * left), -1.0)
            best = int(score.argmax())
            if score[best] >= 0:
                self._place(best, int(self.size[best]))
                alive[best] = False
                todo -= 1
            else:
                best = int(np.where(alive, self.size, -1).argmax())
                take = self._longest(int(self.size[best]), int(self.loss[best]), self.left) if self.left[1] >= 1 else 0
                if take > 0:
                    self._place(best, take)
                    self.start[best] += take
                    self.size[best] -= take
                    self.loss[best] = min(self.loss[best], self.size[best])
                    demand[best] = [self.size[best] / self.cap[0], 1 / self.cap[1], self.loss[best] / self.cap[2]]
                self._end()
                continue
            if self.left[0] < 1 or self.left[1] < 1:
                self._end()
        self.key, self.start, self.size, self.loss = [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _place(self, i: int, take: int) -> None:
        self.open.append((self.key[i], self.start[i], take))
        self.left -= [take, 1, max(0, take - (self.size[i] - self.loss[i]))]

    def _end(self) -> None:
        if self.open:
            self._close(self.open)
        self.open, self.left = [], self.cap.copy()

    def _close(self, parts: list[tuple]) -> None:
        total = sum(p[2] for p in parts)
        room = [total] if total == self.limits.tokens else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        at, size = 0, room.pop(0)
        for k, start, n in parts:
            while n:
                take = min(n, size - at)
                self.pieces.append((k, start, take, self.sequence, at))
                start, n, at = start + take, n - take, at + take
                if at == size:
                    self.sequence += 1
                    at, size = 0, room.pop(0) if room else 0

    def finish(self) -> None:
        self._end()

    def taken(self) -> list[tuple]:
        out, self.pieces = self.pieces, []
        return out


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits(), vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False, loss: str | None = None) -> DataFrame:
    """Pieces of the documents' ids in gapless sequences; with_ids adds the ids themselves."""
    tune(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    tail = np.array([end_id], np.uint16).tobytes()

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        packer = Packer(limits, (context.partitionId() if context else 0) << 36)
        code = encoder(path)
        held: dict[int, tuple] = {}  # examples with ids still to be placed: (id, ids)
        pending: list[tuple] = []
        count = held_ids = 0

        def flush():
            rows = packer.taken()
            out = {n: [] for n in arrow.names}
            for k, start, n, sequence, offset in rows:
                d, raw = held[k]
                ids = np.frombuffer(raw, np.uint16)[start : start + n].astype("<u4")
                for name, v in zip(arrow.names, (d, start, n, zlib.crc32(ids.tobytes()), len(raw) // 2, sequence, offset, ids.astype(np.int32) if with_ids else None), strict=False):
                    out[name].append(v)
            waiting = {p[0] for p in packer.open} | {p[0] for p in pending}
            for k in [k for k in held if k not in waiting]:
                del held[k]
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            keys = batch.column(batch.schema.get_field_index("id")).to_pylist()
            bearing = batch.column(batch.schema.get_field_index("loss")).to_pylist() if loss else None
            for row, end, data, offsets in slices(column, SLICE):
                for i, raw in enumerate(code.encode(data, offsets), row):
                    raw += tail
                    n = len(raw) // 2
                    held[count] = (keys[i], raw)
                    pending.append((count, n, min(n, max(0, bearing[i] or 0)) if loss else n))
                    count += 1
                    held_ids += n
                    if len(pending) >= POOL or held_ids >= POOL_IDS:
                        packer.add(pending)
                        pending, held_ids = [], 0
                        yield flush()
        packer.add(pending)
        packer.finish()
        yield flush()

    columns = [F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), *([F.col(f"`{loss}`").cast("long").alias("loss")] if loss else [])]
    return docs.select(*columns).mapInArrow(tidy(run), schema)


def op2_vector_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
