"""Topic changes and parts of bounded size.

Lines are dealt by meeting once, with their words, and sorted; whole meetings then pass through numpy, many in a batch. A
meeting is assumed to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import wordlists as W


def bag_of_words(lines: DataFrame) -> DataFrame:
    """(meeting_id, line, word, n)."""
    return lines.select("meeting_id", "line", F.explode(X.topic_words(F.col("text"))).alias("word")).groupBy("meeting_id", "line", "word").agg(F.count(F.lit(1)).alias("n"))


def _meeting_of(column: pa.ChunkedArray) -> np.ndarray:
    """Number of each row's meeting within a table whose rows are sorted by meeting."""
    codes = pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)


def _whole_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where meetings end, of batches sorted by meeting (the first column)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        last = _meeting_of(pa.chunked_array([b.column(0)]))
        cut = int(np.searchsorted(last, last[-1]))
        if cut or len(held) > 1 and held[-2].column(0)[-1] != b.column(0)[0]:
            held[-1:] = [b.slice(0, cut)] if cut else []
            yield pa.Table.from_batches(held)
            held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _similarity(meeting: np.ndarray, line: np.ndarray, words: pa.ChunkedArray, window: int) -> np.ndarray:
    """Cosine of the words of the ``window`` lines before and behind the gap at each line, 1 at line 0; rows are sorted."""
    n = len(line)
    out = np.where(line == 0, 1.0, 0.0)
    lists = words.combine_chunks()
    if not n or not len(lists.flatten()):
        return out
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    encoded = lists.flatten().dictionary_encode()
    code, types = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(encoded.dictionary)
    bag, count = np.unique(np.repeat(np.arange(n), size) * types + code, return_counts=True)
    owner, code = bag // types, bag % types
    span = int(line.max()) - int(line.min()) + 2 * window + 2
    place = meeting * span + (line - line.min() + window)
    gaps, sides, terms, times = [], [], [], []
    for ahead in range(1 - window, window + 1):
        at = np.searchsorted(place, place[owner] + ahead)
        there = np.flatnonzero(place[np.minimum(at, n - 1)] == place[owner] + ahead)
        gaps.append(at[there]), terms.append(code[there]), times.append(count[there]), sides.append(np.full(len(there), ahead > 0))
    gap, before, times = np.concatenate(gaps), np.concatenate(sides), np.concatenate(times).astype(float)
    keys, inverse = np.unique(gap * types + np.concatenate(terms), return_inverse=True)
    b, a = np.bincount(inverse, times * before, len(keys)), np.bincount(inverse, times * ~before, len(keys))
    row = keys // types
    whole = np.sqrt(np.bincount(row, b * b, n)) * np.sqrt(np.bincount(row, a * a, n))
    dot = np.bincount(row, a * b, n)
    return np.where(line == 0, 1.0, np.divide(dot, whole, out=np.zeros(n), where=whole > 0))


def _sorted(lines: DataFrame, *more) -> DataFrame:
    """Lines with their topic words, meetings whole and in order in each task."""
    rows = lines.select("meeting_id", "line", *more, X.topic_words(F.col("text")).alias("words"))
    return rows.repartition("meeting_id").sortWithinPartitions("meeting_id", "line")


def gap_similarity(lines: DataFrame, window: int = W.WINDOW_LINES) -> DataFrame:
    """(meeting_id, gap, similarity): cosine of the words of the ``window`` lines before and behind each gap.

    Gap g lies before line g; gap 0 counts 1, a gap with no words on one side 0.
    """

    def run(batches):
        for t in _whole_meetings(batches):
            s = _similarity(_meeting_of(t.column(0)), t.column(1).to_numpy().astype(np.int64), t.column(2), window)
            yield from pa.table({"meeting_id": t.column(0), "gap": t.column(1), "similarity": pa.array(s)}).to_batches()

    kinds = {c: lines.schema[c].dataType.simpleString() for c in ("meeting_id", "line")}
    return _sorted(lines).mapInArrow(run, f"meeting_id {kinds['meeting_id']}, gap {kinds['line']}, similarity double")


def running_tokens(lines: DataFrame) -> DataFrame:
    """(meeting_id, line, tokens, total): estimates and their running sum."""
    w = Window.partitionBy("meeting_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("meeting_id", "line", X.token_estimate(F.col("text")).alias("tokens")).withColumn("total", F.sum("tokens").over(w))


def _cuts(total: np.ndarray, similarity: np.ndarray, most: int, least: float) -> list[int]:
    """Edges of the parts of one meeting; ``total`` are running sums with a leading 0."""
    n = len(similarity)
    edges = [0]
    while edges[-1] < n and total[n] - total[edges[-1]] > most:
        a = edges[-1]
        end = min(int(np.searchsorted(total, total[a] + most, "right")), n)  # cuts that fit are below
        full = max(a + 1, int(np.searchsorted(total, total[a] + least, "left")))
        if full < end:
            edges.append(end - 1 - int(similarity[full:end][::-1].argmin()))
        else:
            edges.append(end - 1 if end - 1 > a else a + 1)
    return edges if edges[-1] == n and n else [*edges, n]


def topic_parts(lines: DataFrame, max_tokens: int = W.PART_TOKENS, min_fill: float = W.MIN_FILL) -> DataFrame:
    """(meeting_id, part, first_line, end_line): parts within the budget, cut where topics change.

    While the rest is over budget, the next cut is the gap of least similarity (the later on ties) among those that leave a
    part between min_fill and all of the budget; failing that the last that fits; failing that one line. Lines are counted
    from the meeting's first.
    """

    def run(batches):
        for t in _whole_meetings(batches):
            meeting = _meeting_of(t.column(0))
            similarity = _similarity(meeting, t.column(1).to_numpy().astype(np.int64), t.column(3), W.WINDOW_LINES)
            tokens = pc.fill_null(t.column(2), 0).to_numpy().astype(np.int64)
            first = np.flatnonzero(np.append(True, meeting[1:] != meeting[:-1]))
            rows, part, start, end = [], [], [], []
            for a, z in zip(first.tolist(), [*first[1:].tolist(), len(meeting)], strict=True):
                edges = _cuts(np.append(0, np.cumsum(tokens[a:z])), similarity[a:z], max_tokens, min_fill * max_tokens)
                rows += [a] * (len(edges) - 1)
                part += range(len(edges) - 1)
                start += edges[:-1]
                end += edges[1:]
            ids = t.column(0).combine_chunks().take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int32()) for x in (part, start, end))], ["meeting_id", "part", "first_line", "end_line"])

    kind = lines.schema["meeting_id"].dataType.simpleString()
    return _sorted(lines, X.token_estimate(F.col("text")).alias("tokens")).mapInArrow(run, f"meeting_id {kind}, part int, first_line int, end_line int")
