"""Scores against gold, held against plain tables of all pairs."""

import random

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from parley.operators import evaluate, turns


def swept(gold: pd.DataFrame, ours: pd.DataFrame, collar: float = 0.0, skip_overlap: bool = False) -> tuple[float, float]:
    """(error seconds, scored seconds) of turns (start, end, speaker): missed, false and confused speech over gold speech.

    The collar takes ``collar`` seconds around each gold boundary, half on each side, out of scoring. Speakers are mapped one
    to one with the most shared time.
    """
    marks = np.unique(np.concatenate([gold["start"], gold["end"]]).astype(float))
    edges = np.unique(np.concatenate([marks, ours["start"], ours["end"], marks - collar / 2, marks + collar / 2]).astype(float))
    if len(edges) < 2:
        return 0.0, 0.0
    size, mid = np.diff(edges), (edges[1:] + edges[:-1]) / 2

    def voices(turns: pd.DataFrame) -> tuple[list, np.ndarray]:
        """Speakers, and in which stretches between edges each of them speaks."""
        names = sorted(set(turns["speaker"]))
        row = {n: i for i, n in enumerate(names)}
        steps = np.zeros((len(names), len(edges)))
        at = [row[n] for n in turns["speaker"]]
        good = np.array(turns["end"], float) > np.array(turns["start"], float)
        np.add.at(steps, (at, np.searchsorted(edges, turns["start"])), good)
        np.add.at(steps, (at, np.searchsorted(edges, turns["end"])), -1.0 * good)
        return names, np.cumsum(steps, 1)[:, :-1] > 0.5

    (theirs, g), (mine, o) = voices(gold), voices(ours)
    scored = np.ones(len(mid), bool)
    if collar and len(marks):
        k = np.searchsorted(marks, mid)
        gap = np.minimum(np.abs(mid - marks[np.maximum(k - 1, 0)]), np.abs(mid - marks[np.minimum(k, len(marks) - 1)]))
        scored &= ~(gap < collar / 2)
    if skip_overlap:
        scored &= g.sum(0) <= 1
    size, g, o = size[scored], g[:, scored], o[:, scored]
    shared = (o * size) @ g.T
    pairs = [(mine[i], theirs[j], shared[i, j]) for i, j in zip(*np.nonzero(shared), strict=True)]
    mapping = evaluate.best_mapping(pd.DataFrame(pairs, columns=["speaker", "gold", "n"])) if pairs else []
    right = np.zeros(len(size))
    for x, y, _ in mapping:
        right += o[mine.index(x)] & g[theirs.index(y)]
    return float((size * (np.maximum(g.sum(0), o.sum(0)) - right)).sum()), float((size * g.sum(0)).sum())


def table(a, b):
    """(errors, lost and added words) by the whole table."""
    row = [(j, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, i)]
        for j, y in enumerate(b, 1):
            ways = [(row[j][0] + 1, row[j][1] + 1), (new[-1][0] + 1, new[-1][1] + 1), (row[j - 1][0] + (x != y), row[j - 1][1])]
            new.append(min(ways))
        row = new
    return row[-1]


def test_errors_are_told_apart():
    dice = random.Random(3)
    for _ in range(300):
        a = [dice.choice("abcd") for _ in range(dice.randrange(60))]
        b = list(a) if dice.random() < 0.5 else [dice.choice("abcd") for _ in range(dice.randrange(60))]
        for _ in range(dice.randrange(8)):
            at = dice.randrange(len(b) + 1)
            b[at : at + dice.randrange(3)] = dice.choices("abcd", k=dice.randrange(3))
        other, lost, added = evaluate.edit_counts(a, b)
        assert (other + lost + added, lost + added) == table(a, b) and lost - added == len(a) - len(b)


def test_sweep_of_turns(spark):
    dice = random.Random(5)
    turn = lambda m, who: (m, start := round(dice.uniform(0, 1300), 3), round(start + dice.choice([0, 0.2, 5, 90, 700]), 3), dice.choice(who))
    gold = [turn(m, "ABC") for m in range(6) for _ in range(dice.randrange(1, 14))]
    ours = [turn(m, "wxyz") for m in range(1, 7) for _ in range(dice.randrange(1, 14))]
    kind = "meeting_id long, start double, end double, speaker string"
    frames = [spark.createDataFrame(x, kind) for x in (gold + [(9, 1.0, 2.0, None)], ours)]
    plain = [pd.DataFrame(x, columns=["meeting_id", "start", "end", "speaker"]) for x in (gold, ours)]
    for collar, skip in ((0.0, False), (0.25, True), (4.0, False)):
        got = {r["meeting_id"]: r for r in evaluate.diarization_errors(*frames, collar, skip).collect()}
        assert set(got) == set(range(7))
        for m in range(7):
            wrong, total = swept(*(x[x["meeting_id"] == m] for x in plain), collar, skip)
            r = got[m]
            assert abs(r["error_s"] - wrong) < 1e-5 and abs(r["scored_s"] - total) < 1e-5 and (r["der"] is None) == (total < 1e-9)
            assert abs(r["missed_s"] + r["false_s"] + r["confused_s"] - r["error_s"]) < 1e-5


def test_turns_are_shuffled_once_and_sweeps_reach_over_batches(spark):
    dice = random.Random(8)
    turn = lambda m, who: (m, start := round(dice.uniform(86300, 86500) if dice.random() < 0.5 else dice.uniform(0, 4000), 3), round(start + dice.choice([0, 0.2, 5, 90, 3600]), 3), dice.choice(who))
    gold = [turn(m, "ABC") for m in range(5) for _ in range(30)]
    ours = [turn(m, "wxyz") for m in range(5) for _ in range(30)]
    kind = "meeting_id long, start double, end double, speaker string"
    frames = [spark.createDataFrame(x, kind) for x in (gold + [(7, None, None, "A")], ours)]
    plain = [pd.DataFrame(x, columns=["meeting_id", "start", "end", "speaker"]) for x in (gold, ours)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        for collar, skip in ((0.0, False), (0.25, True)):
            out = evaluate.diarization_errors(*frames, collar, skip)
            got = {r["meeting_id"]: r for r in out.collect()}
            assert set(got) == {*range(5), 7} and got[7]["scored_s"] == 0 and got[7]["der"] is None
            for m in range(5):
                wrong, total = swept(*(x[x["meeting_id"] == m] for x in plain), collar, skip)
                assert abs(got[m]["error_s"] - wrong) < 1e-5 and abs(got[m]["scored_s"] - total) < 1e-5
    finally:
        spark.conf.set(key, before)
    # nothing is joined, and an hour's turn isn't cut into parts of ten minutes
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    hour = spark.createDataFrame([(1, 100.0, 3700.0, "A")], kind)
    assert evaluate._turn_rows(hour, True, 125_000).count() == 1


def test_gold_words_are_dealt_out_by_length_and_not_by_half_minutes(spark):
    day = 86400.0
    gold = spark.createDataFrame([(1, 0.0, day, "A"), (1, day, 2 * day, "B"), (1, 2 * day + 400, 2 * day + 401, "C")], "meeting_id long, start double, end double, speaker string")
    words = spark.createDataFrame([(1, 0, 10.0, 11.0), (1, 1, day - 5, day + 9), (1, 2, 2 * day + 100, 2 * day + 101), (1, 3, 0.0, 3 * day), (1, 4, 5 * day, 6 * day)], "meeting_id long, line int, start double, end double")
    assert {r["line"]: r["gold"] for r in evaluate.gold_speakers(words, gold, ["meeting_id", "line"], 900.0).collect()} == {0: "A", 1: "B", 2: "B", 3: "A", 4: None}
    pairs = turns.near_pairs(words, gold.select("meeting_id", F.col("start").alias("_s"), F.col("end").alias("_e")), 900.0, 30.0)
    plan = pairs._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "_b" in plan
    # thousands of half minutes, but few meetings of a word and a gold word
    assert pairs.count() <= 15


def test_word_errors_fill_the_table_once(monkeypatch):
    calls, banded = [], evaluate._banded
    monkeypatch.setattr(evaluate, "_banded", lambda *a: calls.append(len(a[0])) or banded(*a))
    words = [f"w{i % 61}" for i in range(400)]
    heard = words[80:160] + [w + "x" for w in words[160:240]] + words[240:320] * 2
    evaluate.edit_counts(words, heard)
    assert len(calls) == 1
    calls.clear()
    assert evaluate.edit_counts(words, words[:200] + ["y"] + words[201:]) == (1, 0, 0) and calls == [1]


def test_speakers_of_many_meetings_are_mapped_in_a_batch(spark):
    rows = [(m, s, g, (m * 7 + i * j) % 5 + 1) for m in range(40) for i, s in enumerate("AB") for j, g in enumerate("xyz")]
    counts = spark.createDataFrame(rows, "meeting_id long, speaker string, gold string, n long")
    out = evaluate.speaker_mapping(counts)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    want = {(m, *x) for m in range(40) for x in evaluate.best_mapping(pd.DataFrame([r[1:] for r in rows if r[0] == m], columns=["speaker", "gold", "n"]))}
    assert {tuple(r) for r in out.collect()} == want
