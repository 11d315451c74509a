"""A run against a gold transcript: words, voices, speakers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as X
from parley.operators.turns import BUCKET_S, near_pairs

GOLD_REACH = 0.5


def gold_speakers(words: DataFrame, gold: DataFrame, key: list[str], reach: float = GOLD_REACH) -> DataFrame:
    """words with gold: the speaker of the gold word that shares most time, or of the nearest closer than ``reach``.

    gold: meeting_id, start, end, speaker. Of equal ones the earliest gold word counts.
    """
    pairs = near_pairs(words.select("meeting_id", *(k for k in key if k != "meeting_id"), "start", "end"), gold.select("meeting_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("speaker").alias("_g")), reach, BUCKET_S)
    score = F.least("end", "_e") - F.greatest("start", "_s")
    pairs = pairs.withColumn("_score", score).where(F.col("_score") > -reach)
    best = pairs.groupBy(*key).agg(F.max_by("_g", F.struct("_score", (-F.col("_s")).alias("s"), (-F.col("_e")).alias("e"))).alias("gold"))
    return words.join(best, key, "left")


def pair_counts(words: DataFrame) -> DataFrame:
    """(meeting_id, speaker, gold, n)."""
    return words.where("speaker is not null and gold is not null").groupBy("meeting_id", "speaker", "gold").agg(F.count(F.lit(1)).alias("n"))


def cheapest_columns(cost: np.ndarray) -> np.ndarray:
    """A column of its own for each row (no more rows than columns) at the least total cost: shortest augmenting paths over
    reduced costs, cubic in all."""
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for r in range(n):
        length, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, total = r, -1, 0.0
        while True:
            step = total + cost[row] - row_price[row] - column_price
            better = ~done & (step < length - 1e-12)
            length[better], came[better] = step[better], column
            column = int(np.where(done, np.inf, length).argmin())
            total = length[column]
            done[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
        # prices after the path, so that reduced costs stay at least 0
        seen = done.copy()
        seen[column] = False
        row_price[r] += total
        row_price[owner[seen]] += total - length[seen]
        column_price[seen] -= total - length[seen]
        while column >= 0:
            before = came[column]
            owner[column] = r if before < 0 else owner[before]
            column = before
    out = np.empty(n, int)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def best_mapping(counts: pd.DataFrame) -> list[tuple[str, str, int]]:
    """One-to-one mapping of speakers to gold speakers with the most words in common; of equally good ones the first in the
    order of names, speaker by speaker of the shorter side."""
    return mapped_pairs(list(zip(counts["speaker"], counts["gold"], counts["n"], strict=True)))


def mapped_pairs(counts: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """``best_mapping`` of (speaker, gold, n)."""
    ours, theirs = sorted({s for s, _, _ in counts}), sorted({g for _, g, _ in counts})
    row, column = {s: i for i, s in enumerate(ours)}, {g: i for i, g in enumerate(theirs)}
    table = np.zeros((len(ours), len(theirs)))
    for s, g, n in counts:
        table[row[s], column[g]] += n
    swap = len(ours) > len(theirs)
    gain = table.T if swap else table
    few, many = (theirs, ours) if swap else (ours, theirs)
    best = lambda g: g[np.arange(len(g)), cheapest_columns(-g)].sum() if len(g) else 0.0
    left, chosen = list(range(len(many))), []
    for i in range(len(few)):
        # the first partner with which the rest still comes to as much
        rest = best(gain[i:][:, left])
        for k in left:
            others = [x for x in left if x != k]
            if gain[i, k] + best(gain[i + 1 :][:, others]) >= rest - 1e-6:
                break
        chosen.append(k)
        left.remove(k)
    rows = [(few[i], many[k], gain[i, k]) for i, k in enumerate(chosen)]
    return [((b, a) if swap else (a, b)) + (int(n) if float(n).is_integer() else n,) for a, b, n in rows]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("speaker", T.StringType()), T.StructField("gold", T.StringType()), T.StructField("n", T.LongType())])))
def mapped(counts: pd.Series) -> pd.Series:
    return pd.Series([mapped_pairs([(x["speaker"], x["gold"], x["n"]) for x in c]) for c in counts], dtype=object)


def speaker_mapping(counts: DataFrame) -> DataFrame:
    """(meeting_id, speaker, gold, n): few speakers a meeting, so a meeting's counts are one row, and many meetings a batch."""
    said = counts.groupBy("meeting_id").agg(F.collect_list(F.struct("speaker", "gold", F.col("n").cast("double").alias("n"))).alias("c"))
    return said.select("meeting_id", F.explode(mapped("c")).alias("x")).select("meeting_id", "x.*")


def right_speaker(counts: DataFrame) -> DataFrame:
    """(meeting_id, right_speaker): share of the words whose speaker is right under the best mapping."""
    right = speaker_mapping(counts).groupBy("meeting_id").agg(F.sum("n").alias("right"))
    return counts.groupBy("meeting_id").agg(F.sum("n").alias("all")).join(right, "meeting_id").select("meeting_id", (F.col("right") / F.col("all")).alias("right_speaker"))


def _banded(x: np.ndarray, y: np.ndarray, reach: int, error: int) -> int:
    """Least cost of turning x into y by ways that stay within ``reach`` diagonals of the table: ``error`` for another word,
    one more for a word lost or added."""
    far, gap, width = 1 << 50, error + 1, 2 * reach + 1
    step = np.arange(width) * gap
    # cell k of row i stands for column i + k - reach
    shifted = np.full(len(x) + len(y) + width + 1, -1)
    shifted[reach : reach + len(y)] = y
    first = np.arange(width) - reach
    row = np.where(first >= 0, first * gap, far)
    lost = np.empty_like(row)
    for i, w in enumerate(x):
        other = row + error * (shifted[i : i + width] != w)
        np.add(row[1:], gap, out=lost[:-1])
        lost[-1] = far
        np.minimum(other, lost, out=other)
        other -= step
        np.minimum.accumulate(other, out=row)
        row += step
    return int(row[len(y) - len(x) + reach])


#: diagonals beside the main ones that are tried first
REACH = 160


def edit_counts(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Words of a that b says otherwise, lost ones and added ones: the fewest in all, of equally few as many of the first kind
    as can be. Work grows with the length times the errors: the table is filled near its diagonal, further from it only
    where the errors found don't fit in."""
    code: dict[str, int] = {}
    x, y = (np.array([code.setdefault(w, len(code)) for w in t], int) for t in (a, b))
    # what both begin and end with costs nothing
    short = min(len(x), len(y))
    same = int(np.argmin(np.append(x[:short] == y[:short], False)))
    x, y, short = x[same:], y[same:], short - same
    same = int(np.argmin(np.append(x[::-1][:short] == y[::-1][:short], False)))
    x, y = x[: len(x) - same], y[: len(y) - same]
    n, m = len(x), len(y)
    error = n + m + 1
    # up to so wide a row costs little more than a narrow one, and the table is filled once
    reach = min(max(n, m), abs(n - m) + REACH)
    while True:
        errors, gaps = divmod(_banded(x, y, reach, error), error)
        if errors <= reach or reach >= max(n, m):
            lost = (gaps + n - m) // 2
            return errors - gaps, lost, gaps - lost
        reach = min(2 * reach, errors)


def word_errors(pairs: DataFrame) -> DataFrame:
    """(meeting_id, substitutions, deletions, insertions, errors, words, wer) from (meeting_id, gold, heard): both texts
    normalised with apostrophes kept; a missing text has no words, wer is null without gold words."""
    @F.pandas_udf("substitutions long, deletions long, insertions long")
    def counts(gold: pd.Series, heard: pd.Series) -> pd.DataFrame:
        rows = [edit_counts((g or "").split(), (h or "").split()) for g, h in zip(gold, heard, strict=True)]
        return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions"])

    rows = pairs.select("meeting_id", *(X.norm_apostrophe(F.trim(F.coalesce(c, F.lit("")))).alias(c) for c in ("gold", "heard")))
    rows = rows.select("meeting_id", counts("gold", "heard").alias("c"), F.size(F.filter(F.split("gold", " "), lambda w: w != "")).alias("words"))
    rows = rows.select("meeting_id", "c.*", "words").withColumn("errors", F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    return rows.select("meeting_id", "substitutions", "deletions", "insertions", "errors", "words", (F.col("errors") / F.nullif(F.col("words"), F.lit(0))).alias("wer"))


#: microseconds of a meeting that are swept in one go: a day
SWEEP_US = 86_400_000_000
_SWEPT = ("n", "scored", "missed", "false", "both")


def _turn_rows(turns: DataFrame, gold: bool, half: int) -> DataFrame:
    """(meeting_id, sweep, gold, speaker, a, b): turns in microseconds, one row for each sweep that they or their collars touch."""
    us = lambda c: F.round(F.col(c).cast("double") * 1e6).cast("long")
    rows = turns.where("speaker is not null").select("meeting_id", F.lit(gold).alias("gold"), F.col("speaker").cast("string").alias("speaker"), us("start").alias("a"), us("end").alias("b"))
    sweep = lambda c: F.floor((c - F.pmod(c, F.lit(SWEEP_US))) / SWEEP_US)
    low, high = (F.coalesce(c, F.lit(0)) for c in (F.least("a", "b") - half, F.greatest("a", "b") + half - 1))
    return rows.withColumn("sweep", F.explode(F.sequence(sweep(low), sweep(F.greatest(low, high)))))


def _unions(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that touch or overlap made one, in order."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    apart = a[1:] > b[:-1]
    return a[np.append(True, apart)[: len(a)]], b[np.append(apart, True)[: len(b)]]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for every place from low to high, row by row."""
    n = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def sweep_turns(group: np.ndarray, gold: np.ndarray, speaker: np.ndarray, a: np.ndarray, b: np.ndarray, half: int, skip_overlap: bool) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """Turns of many groups (0, 1, ...) at once, times within 0..SWEEP_US once they are cut: sums a group (scored, missed, false,
    both), and (group, our speaker, gold speaker, n) of the pairs that share scored time."""
    span = SWEEP_US + 1
    groups = int(group[-1]) + 1 if len(group) else 0
    cut = lambda x: np.clip(x, 0, SWEEP_US)
    # a voice's turns are one where they touch; one line of time for all voices, then one for all groups
    real = cut(b) > cut(a)
    names = int(speaker.max()) + 1 if len(speaker) else 1
    voice, of = np.unique((2 * group[real] + gold[real]) * names + speaker[real], return_inverse=True)
    va, vb = _unions(cut(a[real]) + of * span, cut(b[real]) + of * span)
    of = va // span
    side_of, who = np.divmod(voice[of], names)
    place, theirs = side_of // 2 * span, side_of % 2 == 1
    va, vb = va - of * span + place, vb - of * span + place
    side = {}
    for name, mine in (("gold", theirs), ("ours", ~theirs)):
        order = np.flatnonzero(mine)[np.argsort(va[mine], kind="stable")]
        side[name] = va[order], vb[order], who[order]
    marks = np.concatenate([a[gold == 1], b[gold == 1]])
    at = np.concatenate([group[gold == 1]] * 2) * span
    low, high = cut(marks - half), cut(marks + half)
    side["collar"] = (at + low)[high > low], (at + high)[high > low], None

    times = np.unique(np.concatenate([x for s in side.values() for x in s[:2]]))
    where = lambda t: np.searchsorted(times, t)
    open_ = {k: np.cumsum(np.bincount(where(x), minlength=len(times)) - np.bincount(where(y), minlength=len(times))) for k, (x, y, _) in side.items()}
    g, o = open_["gold"], open_["ours"]
    scored = (open_["collar"] == 0) & (g + o > 0) & ((g <= 1) | (not skip_overlap))
    length = np.where(scored, np.diff(times, append=times[-1:]), 0)
    # below 2^53, so sums of doubles are exact
    total = lambda n: np.bincount(times // span, weights=n * length, minlength=groups).astype(np.int64)
    sums = {"scored": total(g), "missed": total(np.maximum(g - o, 0)), "false": total(np.maximum(o - g, 0)), "both": total(np.minimum(g, o))}

    # two voices meet where the later one begins
    (ga, gb, gs), (oa, ob, os_) = side["gold"], side["ours"]
    i, j = _ranges(np.searchsorted(ga, oa, "left"), np.searchsorted(ga, ob, "left"))
    k, m = _ranges(np.searchsorted(oa, ga, "right"), np.searchsorted(oa, gb, "left"))
    x, y = np.concatenate([i, m]), np.concatenate([j, k])
    before = np.append(0, np.cumsum(length))
    n = before[where(np.minimum(ob[x], gb[y]))] - before[where(np.maximum(oa[x], ga[y]))]
    x, y, n = x[n > 0], y[n > 0], n[n > 0]
    pair, of = np.unique((oa[x] // span * names + os_[x]) * names + gs[y], return_inverse=True)
    n = np.bincount(of, weights=n, minlength=len(pair)).astype(np.int64)
    return sums, (pair // names // names, pair // names % names, pair % names, n)


def _swept(half: int, skip_overlap: bool):
    """Rows in order of meeting and sweep to sums and shared times; a sweep may reach over several batches."""
    def swept(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(pieces).combine_chunks()
        meeting = t["meeting_id"].combine_chunks().dictionary_encode()
        sweep = t["sweep"].to_numpy()
        code = meeting.indices.fill_null(-1).to_numpy()
        begins = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (sweep[1:] != sweep[:-1])))
        group = np.zeros(len(sweep), np.int64)
        group[begins[1:]] = 1
        group = np.cumsum(group)
        names = t["speaker"].combine_chunks().dictionary_encode()
        # without a begin or an end a turn is no more than its mark
        ends = [pc.coalesce(t[c], t[d]).fill_null(-(1 << 60)).to_numpy() - sweep * SWEEP_US for c, d in (("a", "b"), ("b", "a"))]
        sums, (g, speaker, gold, n) = sweep_turns(group, t["gold"].to_numpy().astype(np.int64), names.indices.to_numpy().astype(np.int64), *ends, half, skip_overlap)
        rows = np.concatenate([begins, begins[g]])
        none, zero = pa.nulls(len(begins), pa.string()), np.zeros(len(g), np.int64)
        said = [pa.concat_arrays([none, names.dictionary.take(pa.array(x))]) for x in (speaker, gold)]
        numbers = [pa.array(np.concatenate([np.zeros(len(begins), np.int64), n]))] + [pa.array(np.concatenate([sums[k], zero])) for k in _SWEPT[1:]]
        return pa.RecordBatch.from_arrays([t["meeting_id"].combine_chunks().take(pa.array(rows)), *said, *numbers], ["meeting_id", "speaker", "gold", *_SWEPT])

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = lambda batch, i: (batch["meeting_id"][i].as_py(), batch["sweep"][i].as_py())
        for batch in batches:
            if not batch.num_rows:
                continue
            last = key(batch, batch.num_rows - 1)
            if key(batch, 0) == last:
                begin = 0
            else:
                sweep, code = batch["sweep"].to_numpy(), batch["meeting_id"].dictionary_encode().indices.fill_null(-1).to_numpy()
                begin = int(np.flatnonzero((sweep != sweep[-1]) | (code != code[-1]))[-1]) + 1
            if begin or held and key(held[-1], held[-1].num_rows - 1) != last:
                yield swept(held + ([batch.slice(0, begin)] if begin else []))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield swept(held)

    return run


def diarization_errors(gold: DataFrame, ours: DataFrame, collar: float = 0.0, skip_overlap: bool = False) -> DataFrame:
    """(meeting_id, missed_s, false_s, confused_s, error_s, scored_s, der) of turns (meeting_id, start, end, speaker): missed,
    false and confused speech over gold speech, in whole microseconds until the last step.

    A sweep over the borders of all turns counts who speaks, a day of a meeting at a time and many meetings in a batch of numpy;
    a turn is shuffled once. ``collar`` seconds around each gold border, half on each side, aren't scored, with
    ``skip_overlap`` nor is what several gold speakers say at once. Speakers are mapped one to one with the most shared
    time. Turns without a speaker don't count; der is null where no gold speech is scored."""
    half = round(collar * 1e6 / 2)
    rows = _turn_rows(gold, True, half).unionByName(_turn_rows(ours, False, 0))
    kept = T.StructType([rows.schema["meeting_id"], T.StructField("speaker", T.StringType()), T.StructField("gold", T.StringType()), *(T.StructField(k, T.LongType()) for k in _SWEPT)])
    swept = rows.repartition("meeting_id", "sweep").sortWithinPartitions("meeting_id", "sweep").mapInArrow(_swept(half, skip_overlap), kept)
    swept = swept.groupBy("meeting_id", "speaker", "gold").agg(*(F.sum(k).alias(k) for k in _SWEPT))
    shared = F.collect_list(F.when(F.col("speaker").isNotNull(), F.struct("speaker", "gold", F.col("n").cast("double").alias("n"))))
    rows = swept.groupBy("meeting_id").agg(shared.alias("c"), *(F.sum(k).alias(k) for k in _SWEPT[1:])).withColumn("m", mapped("c"))
    rows = rows.withColumn("right", F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    wrong = {"missed_s": F.col("missed"), "false_s": F.col("false"), "confused_s": F.col("both") - F.col("right"), "error_s": F.col("missed") + F.col("false") + F.col("both") - F.col("right"), "scored_s": F.col("scored")}
    return rows.select("meeting_id", *((c / 1e6).alias(k) for k, c in wrong.items()), (wrong["error_s"] / F.nullif(F.col("scored"), F.lit(0))).alias("der"))


def averages(scores: DataFrame) -> DataFrame:
    """Means of all numeric columns over the meetings."""
    numeric = [f.name for f in scores.schema if f.name != "meeting_id" and f.dataType.typeName() in ("double", "float", "long", "integer")]
    return scores.agg(*(F.avg(c).alias(c) for c in numeric), F.count(F.lit(1)).alias("meetings"))


def most_frequent(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The key, its most frequent value (on ties the one that comes first by ``order``) and how often it occurs (n)."""
    counts = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), "_o", value, "n")).alias("b"))
    return best.select(*key, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def score_runs(gold_words: DataFrame, gold_turns: DataFrame, lines: DataFrame, our_turns: DataFrame, speakers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a meeting: wer, der_strict, der, right_speaker, speakers_found, speakers_true, named and named_correct.

    gold_words: meeting_id, start, end, speaker, word; gold_turns and our_turns: meeting_id, start, end, speaker; lines:
    meeting_id, line, text, speaker, words; speakers and evidence as a run has them. A name counts as correct if the line in
    which a speaker introduced themself was mostly said by the gold speaker that they stand for; names that come from
    elsewhere can't be checked this way and count as named only.
    """
    gold_text = gold_words.groupBy("meeting_id").agg(X.ordered_join("start", "word").alias("gold"))
    wer = word_errors(gold_text.join(lines.groupBy("meeting_id").agg(X.ordered_join("line", "text").alias("heard")), "meeting_id")).select("meeting_id", "wer")
    strict = diarization_errors(gold_turns, our_turns, 0.0, False).select("meeting_id", F.col("der").alias("der_strict"))
    usual = diarization_errors(gold_turns, our_turns, 0.25, True).select("meeting_id", "der")
    words = lines.select("meeting_id", "line", "speaker", F.posexplode("words").alias("pos", "w")).select("meeting_id", "line", "pos", "speaker", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    heard = gold_speakers(words, gold_words, ["meeting_id", "line", "pos"])
    counts = pair_counts(heard)
    found = speakers.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("speakers_found"), F.count_if(F.col("name") != "").alias("named"))
    true = gold_turns.groupBy("meeting_id").agg(F.countDistinct("speaker").alias("speakers_true"))
    said = most_frequent(heard.where("gold is not null"), ["meeting_id", "line"], "gold", "pos").select("meeting_id", "line", F.col("gold").alias("said_by"))
    selves = evidence.where("accepted and kind = 'self'").select("meeting_id", "speaker", "line", "ord", X.norm(F.col("name")).alias("k"))
    shown = speakers.where("name != ''").select("meeting_id", "speaker", X.norm(F.col("name")).alias("k")).join(selves, ["meeting_id", "speaker", "k"]).groupBy("meeting_id", "speaker").agg(F.min_by("line", "ord").alias("line"))
    shown = shown.join(said, ["meeting_id", "line"], "left").join(speaker_mapping(counts).select("meeting_id", "speaker", F.col("gold").alias("stands_for")), ["meeting_id", "speaker"], "left")
    correct = shown.groupBy("meeting_id").agg(F.count_if(F.col("said_by") == F.col("stands_for")).alias("named_correct"))
    out = wer
    for part in (strict, usual, right_speaker(counts), found, true, correct):
        out = out.join(part, "meeting_id", "left")
    return out.na.fill(0, ["speakers_found", "speakers_true", "named", "named_correct"])
