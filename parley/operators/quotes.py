"""Quotes looked up in what a meeting said, exactly or nearly.

The normalised undoubted lines of a meeting, joined by spaces, are its text; a quote is found where it reads best, at
``QUOTE_SCORE`` percent or more, earliest on ties. No row holds a meeting's text: it is cut into parts of ``PART`` characters
(and as many more as its longest quote has, so that a place lies whole in the part where it begins). Quotes and lines are
shuffled once, by meeting; parts meet quotes in batches of ``BATCH``, and a batch carries all that is known of its quotes, so
that nothing is joined back:

1. Exact places are found first; most quotes end there.
2. What is left goes by a seed index of the parts (``similarity.near_places_at_once``): a quote that lacks at most d characters, with
   as many foreign ones between, is cut into 2d + 1 pieces, one of which must stand there whole. So short strings of the
   quote are looked up among the part's, and only windows near enough of them are scored.
3. Over parts, the best score wins. A part knows where its lines begin, so a place comes with its line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import wordlists as W
from parley.functions.similarity import near_places_at_once

PART = 1 << 14
BATCH = 64
#: characters of texts times quotes that are looked up in one pass
AT_ONCE = 1 << 22


def quote_index(lines: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(meeting_id, line, start, speaker, n, offset): undoubted lines with words, normalised, and where each begins in the text
    that they make joined by spaces."""
    rows = lines.join(doubtful, ["meeting_id", "line"], "left_anti").withColumn("n", X.norm(F.col("text"))).where("n != ''")
    before = F.sum(F.length("n") + 1).over(Window.partitionBy("meeting_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("meeting_id", F.col("line").cast("int").alias("line"), "start", F.col("label").alias("speaker"), "n", F.coalesce(before, F.lit(0)).cast("int").alias("offset"))


def text_parts(index: DataFrame, longest: DataFrame, part: int = PART) -> DataFrame:
    """(meeting_id, part, base, text, first, last, lines): stretches of the text from every multiple of ``part`` on, each with
    what the longest quote (meeting_id, longest) needs behind it, and the lines (at, line, start, speaker) in it; meetings
    without quotes have none."""
    size = F.length("n") + 1
    rows = index.join(longest, "meeting_id").select("meeting_id", "longest", "offset", "line", "start", "speaker", F.concat("n", F.lit(" ")).alias("t"), F.max(F.col("offset") + size).over(Window.partitionBy("meeting_id")).alias("total"))
    # a very long line is cut as well
    cut = F.sequence(F.lit(0), F.length("t") - 1, F.lit(part))
    rows = rows.withColumn("c", F.explode(cut)).select("meeting_id", "longest", "total", "line", "start", "speaker", (F.col("offset") + F.col("c")).alias("at"), F.expr(f"substring(t, c + 1, {part})").alias("t"))
    low = F.greatest(F.lit(0), F.floor((F.col("at") - F.col("longest")) / part))
    rows = rows.withColumn("part", F.explode(F.sequence(low, F.floor((F.col("at") + F.length("t") - 1) / part))))
    pieces = F.array_sort(F.collect_list(F.struct("at", "t", "line", "start", "speaker")))
    made = rows.groupBy("meeting_id", "part").agg(F.min("at").alias("base"), pieces.alias("p"), F.first("total").alias("total"))
    made = made.withColumns({"text": F.array_join("p.t", ""), "lines": F.arrays_zip("p.at", "p.line", "p.start", "p.speaker")})
    last = F.col("base") + F.length("text") >= F.col("total")
    return made.select("meeting_id", "part", "base", F.when(last, F.rtrim("text")).otherwise(F.col("text")).alias("text"), (F.col("base") == 0).alias("first"), last.alias("last"), "lines")


def _batched(rows: DataFrame, batch: int) -> DataFrame:
    """(meeting_id, _b, asked): a meeting's quotes with all their columns, some at a time; rows without a quote are left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy("meeting_id"))
    columns = [c for c in rows.columns if c != "meeting_id"]
    # behind the window, so that q isn't made twice
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("q"), F.ceil(n / batch))).where("q != ''")
    return rows.groupBy("meeting_id", "_b").agg(F.collect_list(F.struct(*columns)).alias("asked"))


FOUND = "array<struct<lost:double,pos:int,piece:int>>"


def _some(sizes: list[int]) -> list[list[int]]:
    """Numbers of rows, in order, together of at most ``AT_ONCE`` or single; those of size 0 are left out."""
    out, held = [], AT_ONCE
    for r, size in enumerate(sizes):
        if size:
            if held + size > AT_ONCE:
                out.append([])
                held = 0
            out[-1].append(r)
            held += size
    return out


def _look(least: float | None):
    """Where each quote stands in its part: 100 less its score, place and number of the piece there; null if it isn't found."""
    @F.arrow_udf(FOUND)
    def look(text: pa.Array, first: pa.Array, last: pa.Array, ats: pa.Array, qs: pa.Array) -> pa.Array:
        texts, asked = text.to_pylist(), qs.to_pylist()
        places = [[t.find(q) for q in x] for t, x in zip(texts, asked, strict=True)]
        scores = [[100.0] * len(x) for x in asked]
        if least is not None:
            left = [[i for i, p in enumerate(x) if p < 0] for x in places]
            for some in _some([len(t) * len(x) for t, x in zip(texts, left, strict=True)]):
                near = near_places_at_once([texts[r] for r in some], [[asked[r][i] for i in left[r]] for r in some], [first[r].as_py() for r in some], [last[r].as_py() for r in some], least)
                for r, found in zip(some, near, strict=True):
                    for i, (score, p) in zip(left[r], found, strict=True):
                        scores[r][i], places[r][i] = score, p
        lost, pos, piece, ends = [], [], [], [0]
        for at, p, score in zip(ats.to_pylist(), places, scores, strict=True):
            piece.append(np.searchsorted(np.array(at, np.int64) - at[0], np.array(p, np.int64), "right") - 1)
            lost += score
            pos += p
            ends.append(len(pos))
        pos, piece = np.array(pos, np.int32), np.concatenate([np.zeros(0, np.int64), *piece]).astype(np.int32)
        fields = [pa.array(100.0 - np.array(lost, float)), pa.array(pos), pa.array(piece)]
        found = pa.StructArray.from_arrays(fields, ["lost", "pos", "piece"], mask=pa.array(pos < 0))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    return look


def first_holding(least: float | None):
    """UDF: for each quote the number of the first text, of the row's, that holds it exactly or in a window that reaches ``least``
    percent, or null. Empty quotes, and those longer than the text by more than three, stand nowhere."""

    @F.arrow_udf("array<int>")
    def holding(texts: pa.Array, quotes: pa.Array) -> pa.Array:
        texts, asked = [x or [] for x in texts.to_pylist()], quotes.to_pylist()
        out = [[None] * len(qs) for qs in asked]
        left = [[i for i, q in enumerate(qs) if q] for qs in asked]
        for k in range(max(map(len, texts), default=0)):
            tried = [[]] * len(texts)
            for r, x in enumerate(texts):
                if k < len(x) and left[r]:
                    t, qs, missed = x[k], asked[r], []
                    for i in left[r]:
                        if qs[i] in t:
                            out[r][i] = k
                        else:
                            missed.append(i)
                    left[r] = missed
                    tried[r] = [i for i in missed if len(qs[i]) <= len(t) + 3]
            if least is None:
                continue
            for some in _some([len(x[k]) * len(m) if m else 0 for x, m in zip(texts, tried, strict=True)]):
                yes = [True] * len(some)
                near = near_places_at_once([texts[r][k] for r in some], [[asked[r][i] for i in tried[r]] for r in some], yes, yes, least)
                for r, places in zip(some, near, strict=True):
                    there = {i for i, (_, place) in zip(tried[r], places, strict=True) if place >= 0}
                    for i in there:
                        out[r][i] = k
                    left[r] = [i for i in left[r] if i not in there]
        return pa.array(out, pa.list_(pa.int32()))

    return holding


def _found(rows: DataFrame, longest: DataFrame, index: DataFrame, exact_only: bool, least: float, part: int, batch: int) -> DataFrame:
    """rows (meeting_id, q, ...) with pos, line, start and speaker; only those that are found. longest: as ``text_parts`` has it."""
    tried = text_parts(index, longest, part).join(_batched(rows, batch), "meeting_id")
    tried = tried.withColumn("found", _look(None if exact_only else least)("text", "first", "last", "lines.at", "asked.q"))

    def placed(x):
        line = F.get("lines", x["piece"])
        return F.when(x.isNotNull(), F.struct(x["lost"].alias("lost"), (F.col("base") + x["pos"]).cast("int").alias("pos"), line["line"].alias("line"), line["start"].alias("start"), line["speaker"].alias("speaker")))

    each = tried.select("meeting_id", "_b", "asked", F.transform("found", placed).alias("found")).groupBy("meeting_id", "_b").agg(F.first("asked").alias("asked"), F.collect_list("found").alias("f"))
    # the least lost, the earliest place on ties
    best = F.reduce(F.slice("f", 2, F.size("f")), F.get("f", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: F.least(a, b)))
    out = each.select("meeting_id", F.explode(F.arrays_zip("asked", best.alias("found"))).alias("x")).where("x.found is not null")
    return out.select("meeting_id", "x.asked.*", *(F.col(f"x.found.{c}").alias(c) for c in ("pos", "line", "start", "speaker")))


def places(asked: DataFrame, index: DataFrame, exact_only: bool = False, least: float = W.QUOTE_SCORE, part: int = PART, batch: int = BATCH) -> DataFrame:
    """(meeting_id, q, pos) of the distinct normalised quotes (meeting_id, q) that are found."""
    longest = asked.groupBy("meeting_id").agg(F.max(F.length("q")).alias("longest"))
    return _found(asked, longest, index, exact_only, least, part, batch).select("meeting_id", "q", "pos")


def at_lines(found: DataFrame, index: DataFrame, part: int = PART) -> DataFrame:
    """found (meeting_id, pos, ...) with the line, start and speaker at each position; lines meet positions in stretches of the
    text."""
    end = F.col("offset") + F.length("n")
    rows = index.select("meeting_id", "line", "start", "speaker", F.col("offset").alias("_from"), end.alias("_to"), F.explode(F.sequence(F.floor(F.col("offset") / part), F.floor(end / part))).alias("_p"))
    return found.withColumn("_p", F.floor(F.col("pos") / part)).join(rows, ["meeting_id", "_p"]).where("pos BETWEEN _from AND _to").drop("_p", "_from", "_to")


def find_quotes(quotes: DataFrame, index: DataFrame, labels: DataFrame, exact_only: bool = False) -> DataFrame:
    """quotes (meeting_id, quote) with pos, line, start, speaker and the bare quote; only those that are found. Of labels
    (meeting_id, keys), a copied one in front of a quote is left out."""
    # normalising makes a quote no longer than its lower case
    longest = quotes.groupBy("meeting_id").agg(F.max(F.length(F.lower("quote"))).alias("longest"))
    bare = X.without_label(F.col("quote"), F.col("keys"))
    rows = quotes.join(labels.select("meeting_id", "keys"), "meeting_id", "left").select("meeting_id", "quote", bare.alias("bare")).withColumn("q", X.norm(F.col("bare")))
    found = _found(rows, longest, index, exact_only, W.QUOTE_SCORE, PART, BATCH)
    return found.select("meeting_id", "quote", "pos", "line", "start", "speaker", F.trim("bare").alias("bare"))
