"""Periodic runs, importance resampling and mixing against their plain restatements, and their defined edge cases."""

import hashlib
import random

import numpy as np
import pytest

from parley.llm import importance, mixing, periodic

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string"
EDGE = [(-1, "", "a"), (-2, None, None), (-3, " \n\t ", "a"), (-4, "x", None), (-5, "word " * 3000, "b"), (-6, "é" * 5000, "b"), (-7, "The the THE " * 40, "ä")]


@pytest.fixture(scope="module")
def sample(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


# ------------------------------------------------------------------------------------------------------ periodic runs


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        rows = []
        for _ in range(rng.randint(1, 4)):
            n, kind = rng.randint(0, 120), rng.random()
            w = [rng.choice("ab" if kind < 0.5 else "abcdefgh") for _ in range(n)]
            if kind > 0.7 and n:
                w = (w[: rng.randint(1, 20)] * n)[:n]
                w[rng.randrange(n)] = "z"
            rows.append(["a"] * n if kind < 0.1 else w)
        words = np.array([ord(x) for w in rows for x in w], np.uint64)
        row = np.array([i for i, w in enumerate(rows) for _ in w], np.int64)
        for least in (12, 5):
            got = [(a, z - a, q) for a, z, q in zip(*(x.tolist() for x in periodic.runs_of(words, row, least)), strict=True)]
            first = np.cumsum([0, *map(len, rows)]).tolist()
            assert got == [(a + first[i], n, q) for i, w in enumerate(rows) for a, n, q in periodic.brute(w, least)[0]]


def test_words_outside_repeated_grams_are_masked():
    words = np.arange(100, dtype=np.uint64)
    words[40:70] = words[10:40]
    start, end = periodic.segments(words, np.zeros(100, np.int64))
    assert start.tolist() == [10] and end.tolist() == [70]
    assert not len(periodic.segments(words, np.arange(100) // 30)[0])  # repeated in other texts only


def test_one_word_repeated_very_often():
    start, end, q = periodic.runs_of(np.full(60_000, 7, np.uint64), np.zeros(60_000, np.int64))
    assert (start.tolist(), end.tolist(), q.tolist()) == ([0], [60_000], [1])


def digests(doc_id, text):
    runs, kept = periodic.brute(periodic.planted(doc_id, text))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_query_of_runs_matches_brute_force(spark, sample, tmp_path):
    rows = [r for r in [*sample, *EDGE, sample[0], (None, "a b " * 30, None)] if len((r[1] or "").split()) < 2500 or r[0] == -5]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(r["n_runs"] > 0 for r in got) > 10
    want = {d: digests(d, t) for d, t, _ in rows}
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in got)


def test_collapsed_texts_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "go on " * 9 + "then", "x", 5), (2, None, "y", 6)], "doc_id long, text string, _runs string, starts int")
    done, name = periodic.collapse_runs(d)
    assert name == "_runs_"
    one, two = sorted(done.collect(), key=lambda r: r["doc_id"])
    assert one[name]["collapsed"] == "go on then" and (one["_runs"], one["starts"]) == ("x", 5)
    assert (one[name]["starts"], one[name]["lengths"], one[name]["periods"], one[name]["n_words"]) == ([0], [18], [2], 19)
    assert two[name]["collapsed"] == "" and two[name]["starts"] == []
    assert periodic.collapse_runs(d.limit(0))[0].count() == 0


# ---------------------------------------------------------------------------------------------- importance resampling


def test_crc_of_words_of_any_length():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.choice([1, 5, 60, 64, 65, 66, 300]))) for _ in range(80)).encode()
    data = np.frombuffer(text, np.uint8)
    got, rows, words = importance.feature_buckets(data, np.array([0, len(data)]), 2**31)
    import zlib

    w = text.decode().split()
    assert words.tolist() == [80] and got.tolist() == [zlib.crc32(x.encode()) % 2**31 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def test_resampling_matches_brute_force(spark, sample):
    target = [(r["text"],) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for aims in ([*target, (None,), ("",)], []):
        rows = [*sample, *EDGE, (None, "n " * 30, None)]
        want = importance.brute([r[:2] for r in rows], [t for t, in aims])
        d, t = spark.createDataFrame(rows, DOC).repartition(5), spark.createDataFrame(aims, "text string")
        got = importance.importance_sample(d, t).collect()
        assert len(got) == len(rows)
        assert all((r["n_features"], r["weight"], r["score"], r["rank"]) == want[r["doc_id"]] for r in got)
        drawn = importance.resample(d, t)
        assert drawn.columns == d.columns and sorted(r["doc_id"] for r in drawn.where("doc_id is not null").collect()) == sorted(k for k, v in want.items() if v[3] and k is not None)


def test_ties_of_scores_go_to_smaller_ids(spark):
    scored = spark.createDataFrame([(i, i % 5 != 0, (i * 7) % 3) for i in range(40)], "doc_id long, eligible boolean, score long")
    order = sorted((-(i * 7 % 3), i) for i in range(40) if i % 5)
    for drawn in (0, 1, 13, 32):
        got = {r["doc_id"]: r["rank"] for r in importance.draw(scored, drawn).collect()}
        assert len(got) == 40 and {d: k for d, k in got.items() if k} == {i: k + 1 for k, (_, i) in enumerate(order[:drawn])}


def test_repeated_rows_rank_side_by_side(spark):
    rows = [(1, "a b " * 20)] * 6 + [(i, f"w{i} " * 25) for i in range(2, 12)]
    d, t = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")
    got = importance.importance_sample(d, t, percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 17))
    mine = sorted(r["rank"] for r in got if r["doc_id"] == 1)
    assert mine == list(range(mine[0], mine[0] + 6))
    few = importance.importance_sample(d, t, percent=50).where("rank is not null").count()
    clash = d.selectExpr("*", "1 AS score", "2 AS rank", "3 AS k1", "4 AS times")
    assert importance.resample(clash, t, percent=50).count() == few == 8


# -------------------------------------------------------------------------------------------------------- mixing


def test_mixing_matches_brute_force(spark, sample):
    rows = [*sample, *EDGE, (None, "n " * 30, "src1")]
    for kw in ({}, {"weights": (1, 0, 9), "share": 0.5, "most": 2, "seed": 4}):
        want = mixing.brute(rows, **kw)
        got = mixing.mix_sources(spark.createDataFrame(rows, DOC).repartition(7), **kw).collect()
        assert len(got) == len(rows)
        for r in got:
            size, whole, target, copies = want[r["doc_id"]]
            assert (r["size"], r["source_size"], r["copies"]) == (size, whole, copies) and abs(r["target"] - target) < 1e-6 * (1 + target)


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    # a source with a third of all rows, and small ones that stop at three times their words
    rows = [(i, "w " * rng.choice([1, 5, 80, 400]), "big" if i % 3 == 0 else f"s{i % 40}" if i % 10 else "tiny") for i in range(3000)]
    rows += [(5000 + i, "w " * 7, "a few") for i in range(3)]
    d = spark.createDataFrame(rows, DOC)
    first = mixing.mix_sources(d).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.mix_sources(d.repartition(9)).collect()))
    by = {}
    for r in first:
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["copies"] * r["size"]
        s[1] = max(s[1], r["size"])
        assert 0 <= r["copies"] <= 3
    assert all(abs(taken - target) <= 2 * largest for taken, largest, target, _ in by.values())
    assert by["a few"][0] == 3 * by["a few"][3] and abs(sum(s[2] for s in by.values()) - sum(s[3] for s in by.values())) < 1e-3


def test_emitted_rows(spark):
    rows = [(i % 5 if i < 20 else i, "a b c", "one" if i < 30 else "two", i) for i in range(36)] + [(99, None, None, 0)]
    d = spark.createDataFrame(rows, DOC + ", k1 int").selectExpr("*", "7 AS copies", "8 AS times")
    out = mixing.mixed(d)
    took = sum(r["copies"] for r in mixing.mix_sources(d).collect())
    assert out.columns == d.columns and out.count() == took > 0
    assert all(r["copies"] == 7 and r["times"] == 8 for r in out.collect())
    assert mixing.mixed(d.limit(0)).count() == 0 and mixing.mix_sources(d.limit(0)).count() == 0


def test_prefix_sums_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "(id * 7919) % 5000 AS o", "id % 11 AS v")
    got = sorted(mixing.running_sums(rows, ["o", "id"], "v", "s").collect(), key=lambda r: r["o"])
    assert [r["s"] for r in got] == [0, *np.cumsum([r["v"] for r in got])[:-1].tolist()]
