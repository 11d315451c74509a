"""Each text operator against its plain restatement, and its defined edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import core, decontaminate, gsaca, langid, langmodel, lines, nearjoin, pack, quality, substrings, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOC).repartition(parts)


@pytest.fixture(scope="module")
def sample(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


EDGE = [(None, None), (-1, ""), (-2, None), (-3, " \n\t "), (-4, "x"), (-5, "word " * 3000), (-6, "é" * 5000)]


# ------------------------------------------------------------------------------------------------ decontamination


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_decontamination_matches_brute_force(spark, sample, block):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900 + i, " ".join(t.split()[3 : 3 + i % 12 + 1])) for i, (_, t) in enumerate(sample[:30])] + [(None, "x y"), (5, None), (5, items[0][1])]
    rows = [*sample, *EDGE, sample[0]]
    want = decontaminate.brute(rows, items)
    marked, name = decontaminate.mark_contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    got = marked.select("doc_id", f"{name}.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], sum(r["ends"]) - sum(r["starts"]), sorted(set(r["items"]))) == want[r["doc_id"]]
        assert all(a < b for a, b in zip(r["starts"], r["ends"]))


def test_decontamination_of_nothing_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 7, "q")], "doc_id long, text string, n_words int, _contamination string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(d, b).collect() == d.collect()
    assert decontaminate.decontaminate(d.limit(0), b).columns == d.columns


def test_winnowing_keeps_a_fingerprint_of_every_shared_window():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 400).astype(np.uint64)
    grams = core.gram_hashes(words, 5)
    inside = np.ones(391, bool)
    chosen, at = decontaminate.fingerprints(grams, inside, 10, 5)
    assert all(i <= a <= i + 5 for i, a in enumerate(at)) and (chosen == [grams[i : i + 6].min() for i in range(391)]).all()


# -------------------------------------------------------------------------------------------------------- packing


def test_token_ids_are_those_of_the_library(sample):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    odd = ["", " ", "a   b", "a\n  b", "a \n b", "x  ", "x\n ", "<|endoftext|> a", "<|endoftext|> a <|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext|", "<|endoftext|>"] + ["".join(rng.choice(["a", "b", " ", " ", "\n", "\t", "'s", "1", "é", "à", "　", "\x85"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts = odd + [t for _, t in sample[:40]]
    got = tokens.encoder(tokens.default_vocabulary()).encode(*core.text_buffers(pa.array(texts)))
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("limits", [pack.Limits(), pack.Limits(256, 5, 100)])
def test_packing_is_an_exact_round_trip(spark, sample, limits):
    rows = [*sample[:80], *[(d, t) for d, t in EDGE if d is not None]]
    code = tokens.encoder(tokens.default_vocabulary())
    whole = {d: [*np.frombuffer(x, np.uint16).tolist(), 1] for (d, _), x in zip(rows, code.encode(*core.text_buffers(pa.array([t for _, t in rows]))))}
    pieces = pack.pack_documents(docs_of(spark, rows), limits=limits, with_ids=True).collect()
    for d, ids in whole.items():
        mine = sorted((p for p in pieces if p["doc_id"] == d), key=lambda p: p["start"])
        assert [i for p in mine for i in p["ids"]] == ids
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and p["doc_tokens"] == len(ids) for p in mine)
    by: dict = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    for s in by.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == limits.tokens or at & (at - 1) == 0
        assert len(s) <= limits.segments and at <= limits.tokens


def test_packing_keeps_the_loss_limit_and_prefers_whole_examples():
    p = pack.Packer(pack.Limits(100, 4, 30))
    p.add([(0, 60, 20), (1, 40, 10), (2, 90, 30), (3, 10, 0), (4, 500, 40)])
    p.finish()
    loss = {0: 20, 1: 10, 2: 30, 3: 0, 4: 40}
    size = {0: 60, 1: 40, 2: 90, 3: 10, 4: 500}
    seq: dict = {}
    for k, start, n, s, _ in p.pieces:
        seq[s] = seq.get(s, 0) + max(0, start + n - max(start, size[k] - loss[k]))
    assert max(seq.values()) <= 30
    assert {k for k, _, _, s, _ in p.pieces if s in {x[3] for x in p.pieces if x[0] == 0}} >= {0, 1}


def test_packing_reads_loss_bearing_tokens_and_ignores_batches(spark, sample):
    rows = [(d, t, k % 9 * 20 - 20, "x") for k, (d, t) in enumerate(sample[:60])] + [(-1, "<|endoftext|> a", None, "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, start int, loss string").coalesce(1)
    limits = pack.Limits(256, 6, 90)
    pieces = pack.pack_documents(d, limits=limits, loss="start").collect()
    bearing = {r[0]: max(0, r[2] or 0) for r in rows}
    total: dict = {}
    for p in pieces:
        first = p["doc_tokens"] - min(bearing[p["doc_id"]], p["doc_tokens"])
        total[p["sequence_id"]] = total.get(p["sequence_id"], 0) + max(0, p["start"] + p["length"] - max(p["start"], first))
    assert max(total.values()) <= 90 and sum(total.values()) == sum(min(bearing[p["doc_id"]], p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert next(p["doc_tokens"] for p in pieces if p["doc_id"] == -1) == 3
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert sorted(pack.pack_documents(d, limits=limits, loss="start").collect()) == sorted(pieces)
    finally:
        spark.conf.set(key, before)


def test_packing_an_empty_table(spark):
    assert pack.pack_documents(spark.createDataFrame([], DOC)).count() == 0


# --------------------------------------------------------------------------------------------------- Jaccard join


def test_join_matches_brute_force(spark, sample):
    want = nearjoin.brute(sample)
    _, named = nearjoin.near_groups(docs_of(spark, sample))
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in named.collect()} == want
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_join_of_small_sets_chains_and_regions_over_the_limit(spark, limit):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(8):
        w = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 12, 40, 150]))]
        for _ in range(rng.randint(1, 12)):
            x = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(x).upper() if rng.random() < 0.3 else "\n".join(x)))
            if rng.random() < 0.3:
                w = x
    rows += [(5000, None), (5001, "  "), (5003, "a b"), (5004, "A  b"), (5005, "a")]
    _, named = nearjoin.near_groups(docs_of(spark, rows), region_shingles=limit)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in named.collect()} == nearjoin.brute(rows)


def test_regions_in_numpy():
    rng = np.random.default_rng(0)
    for _ in range(15):
        base = [np.unique(rng.integers(0, 2**63, rng.integers(9, 90)).astype(np.uint64)) for _ in range(3)]
        sets = []
        for _ in range(int(rng.integers(2, 70))):
            b = base[rng.integers(3)].copy()
            k = int(rng.integers(0, 1 + len(b) // 8))
            b[rng.choice(len(b), k, replace=False)] = rng.integers(0, 2**63, k).astype(np.uint64)
            sets.append(np.unique(b))
        region = nearjoin.Region(sets, list(range(len(sets))))
        region.join()
        up = list(range(len(sets)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(sets)):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if 100 * c >= 90 * (len(sets[i]) + len(sets[j]) - c):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
        assert [region.root(i) for i in range(len(sets))] == [root(i) for i in range(len(sets))]


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(3, text, 1), (2, text.replace("w30", "zz"), 2), (9, text, 3), (9, text, 3), (4, "", 4), (5, None, 5), (None, "other words stand here", 6)], "doc_id long, text string, k1 int")
    got = nearjoin.keep_one(d)
    assert got.columns == d.columns and sorted((r["doc_id"] or -1 for r in got.collect())) == [-1, 2, 4, 5]
    assert nearjoin.keep_one(d.limit(0)).count() == 0


# ---------------------------------------------------------------------------------------------- suffix-array dedup


def test_suffix_arrays():
    rng = random.Random(0)
    for _ in range(3000):
        x = [rng.randint(0, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 16))]
        order = gsaca.suffix_array(x)
        assert order == sorted(range(len(x)), key=lambda i: x[i:])
        for k, n in enumerate(gsaca.common_prefixes(x, order)):
            if k:
                a, b = x[order[k - 1] :], x[order[k] :]
                assert a[:n] == b[:n] and a[: n + 1] != b[: n + 1] or n == min(len(a), len(b))
    x = ([1, 2] * 300 + [3]) * 3
    assert gsaca.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def repeats(spark, rows, **options):
    done, name = substrings.remove_repeats(docs_of(spark, rows), **options)
    return sorted((tuple(r) for r in done.select("doc_id", f"{name}.n_bytes", f"{name}.n_removed", F.size(f"{name}.starts"), f"{name}.kept_sha256").collect()), key=str)


def test_repeats_match_brute_force(spark, sample):
    rows = [*sample, (None, None), (-1, ""), (-5, "word " * 500)]
    assert repeats(spark, rows) == sorted(substrings.brute(rows), key=str)


@pytest.mark.parametrize("unit, hot", [(substrings.Unit(False, 40, 12, 2, 4), 4 << 20), (substrings.Unit(False, 100, 30, 4, 8), 3000), (substrings.Unit(False, 12, 3, 1, 2), 4 << 20)])
def test_repeats_of_short_strings_periods_and_hot_groups(spark, unit, hot):
    rng = random.Random(2)
    base = ["".join(rng.choice("ab cdé\n") for _ in range(300)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([rng.choice(base), rng.choice(base)[: rng.randint(1, 200)], "xy" * rng.randint(1, 90), "q"]) for _ in range(rng.randint(0, 5)))) for i in range(90)]
    rows += [(1, base[0] + base[1]), (1, base[0] + base[1]), (None, "abc" * 100), (-3, "z" * 999)]
    assert repeats(spark, rows, units=(unit,), hot_bytes=hot) == sorted(substrings.brute(rows, unit.length), key=str)


@pytest.mark.parametrize("unit", [substrings.Unit(False, 40, 12, 2, 4), substrings.Unit(False, 9, 2, 1, 1), substrings.Unit(False, 64, 20, 3, 6)])
def test_array_neighbours_decide_repeats(unit):
    rng = random.Random(7)
    for _ in range(60):
        base = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 120))) for _ in range(4)] + ["ab" * 60, "c" * 90]
        texts = ["".join(rng.choice(base) for _ in range(rng.randint(1, 4))).encode() for _ in range(rng.randint(1, 12))]
        texts = [t for t in dict.fromkeys(texts) if len(t) >= unit.length]
        if not texts:
            continue
        count = {}
        for t in texts:
            for i in range(len(t) - unit.length + 1):
                count[t[i : i + unit.length]] = count.get(t[i : i + unit.length], 0) + 1
        found = substrings.repeated_windows(texts, np.ones(len(texts), np.int64), unit)
        assert [f.tolist() for f in found] == [[i for i in range(len(t) - unit.length + 1) if count[t[i : i + unit.length]] > 1] for t in texts]


def test_passages_of_fifty_words(spark, sample):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    some = lambda n: " ".join(word() for _ in range(n))
    shared = [some(n) for n in (49, 50, 51, 60, 200)]
    rows = [*sample, (None, None), (-1, "")]
    for k in range(40):
        rows.append((10_000 + k, f"{some(rng.randint(1, 80))}\n {rng.choice(shared).upper() if k % 3 else rng.choice(shared)}\t{some(rng.randint(1, 80))} {shared[k % 5]}"))
    done, name = substrings.remove_repeats(docs_of(spark, rows), units=(substrings.BYTES, substrings.WORDS), cut=(substrings.BYTES,))
    got = sorted((tuple(r) for r in done.select("doc_id", f"{name}.word_starts", f"{name}.word_ends").collect()), key=str)
    want = [(d, [a for a, _ in s], [z for _, z in s]) for (d, _), s in zip(rows, substrings.brute_words(rows), strict=True)]
    assert got == sorted(want, key=str) and any(a for _, a, _ in want)
    assert sorted((tuple(r) for r in done.select("doc_id", f"{name}.n_bytes", f"{name}.n_removed", F.size(f"{name}.starts"), f"{name}.kept_sha256").collect()), key=str) == sorted(substrings.brute(rows), key=str)


def test_strip_repeats_keeps_columns_and_characters(spark):
    shared = "".join(random.Random(4).choice("abcdefé ") for _ in range(900))
    d = spark.createDataFrame([(1, f"é{shared}ü one", "k", 0), (2, f"two {shared}", "k", 0), (3, "alone", "k", 5)], "doc_id long, text string, k1 string, n_chars long")
    got = {r["doc_id"]: r for r in substrings.strip_repeats(d).collect()}
    assert {k: r["text"] for k, r in got.items()} == {1: "éü one", 2: "two ", 3: "alone"} and got[1]["n_chars"] == 6 and got[3]["n_chars"] == 5


# ------------------------------------------------------------------------------------------------------ classifiers


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{d}/labels.parquet")


def held(rows, labels, field, modulus=5):
    return [(r, labels[r["doc_id"]][field]) for r in rows if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % modulus == 0]


def test_quality_held_out(spark, tables):
    docs, labels = tables
    scored, name = quality.score_documents(docs.unionByName(spark.createDataFrame([(-1, None, None), (-2, "", None)], "doc_id long, text string, lang string")), quality.fit(docs, labels))
    rows = scored.select("doc_id", f"{name}.score").collect()
    pairs = held(rows, {r["doc_id"]: r for r in labels.collect()}, "quality")
    right = [(r["score"] >= quality.THRESHOLD) == (y == 1) for r, y in pairs]
    assert sum(right) / len(right) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_steps_follow_the_gradient():
    """One step's change of a vector against the loss measured on both sides of it."""
    rng = np.random.default_rng(3)
    vector, out, bias = rng.normal(size=(5, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    c, y = np.array([0.5, 0.3, 0.2]), 1
    loss = lambda v: -np.log(np.exp((z := out @ (c @ v[:3]) + bias) - z.max())[y] / np.exp(z - z.max()).sum())
    z = out @ (c @ vector[:3]) + bias
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    p[y] -= 1
    step = np.outer(c, p @ out)
    for i in range(3):
        for j in range(4):
            d = np.zeros_like(vector)
            d[i, j] = 1e-5
            assert np.isclose((loss(vector + d) - loss(vector - d)) / 2e-5, step[i, j], atol=1e-6)
    # and such steps learn: a text of one feature is told from a text of the other
    a, b = np.array([1], np.int32), np.array([2], np.int32)
    one = np.ones(1, np.float32)
    model = quality.train([(0, a, one), (1, b, one)] * 40, 0.5)
    assert model.worth[2] + model.bias > 1 and model.worth[1] + model.bias < -1


def test_toxicity_held_out_and_without_labels(spark, tables):
    docs, labels = tables
    scored, name = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    pairs = held(scored.select("doc_id", f"{name}.score").collect(), {r["doc_id"]: r for r in labels.collect()}, "toxic")
    assert sum(r["score"] >= 0.5 for r, y in pairs if y == 0) == 0
    assert sum(r["score"] >= 0.5 for r, y in pairs if y == 1) >= 0.6 * sum(y for _, y in pairs)
    empty = toxicity.fit(docs, labels.limit(0))
    scored, name = toxicity.score_documents(spark.createDataFrame([(1, None), (2, "x")], DOC), empty)
    assert all(r[0] < 0.01 for r in scored.select(f"{name}.score").collect())


def test_line_labels_base_and_verdict(spark, tables):
    docs, labels = tables
    extra = [(-1, None), (-2, ""), (-3, "a b " * 50), (-4, "x\nx\n\nx # *"), (-5, "é" * 3000)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, DOC))
    judged, name = lines.judge_documents(every, lines.fit(docs, labels))
    rows = judged.select("doc_id", "text", f"{name}.*").collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == lines.brute_base(r["text"])
        assert not (r["kept"] and r["base_failed"])
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [(r["kept"], known[r["doc_id"]]) for r in rows if r["doc_id"] in known and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and not r["base_failed"]]
    assert sum(k == (q == 1) for k, q in out) / len(out) > 0.95
    good = [r["kept"] for r in rows if known.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if known.get(r["doc_id"]) == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_line_labels_are_learned_within_texts(spark, tables):
    rng = np.random.default_rng(5)
    # boilerplate (symbols) inside good texts and prose inside bad ones, never labelled as lines
    good, bad = lines.START * 0, lines.START * 0
    good[0] = bad[0] = 1
    good[lines.FEATURES.index("closed")] = good[lines.FEATURES.index("long")] = 1
    bad[lines.FEATURES.index("symbols")] = bad[lines.FEATURES.index("short")] = 1
    x, y, length, chars, truth = [], [], [], [], []
    for k in range(300):
        kinds = [0] * 6 + [1] * 2 if k % 2 else [1] * 6 + [0] * 2
        rng.shuffle(kinds[1:-1])
        x += [bad if c else good for c in kinds]
        truth += kinds
        chars += [10 if c else 60 for c in kinds] if k % 2 else [60 if c else 10 for c in kinds]
        y.append(1 - k % 2)
        length.append(len(kinds))
    hashes = core.mix(np.arange(len(x)).astype(np.uint64) + np.uint64(9))
    chain = lines.train(np.array(x), np.array(y), np.array(length), np.array(chars, float), hashes)
    first = np.append(0, np.cumsum(length))[:-1]
    found = chain.viterbi(np.array(x), first, np.array(length))
    assert (found == truth).mean() > 0.99
    # lines in many settings are known, lines of mere copies are not
    copies = np.tile(core.mix(np.arange(5).astype(np.uint64)), 4)
    assert not lines.set_lines(copies, np.array([5] * 4)).any()
    foot = core.mix(np.arange(40).astype(np.uint64) + np.uint64(77))
    foot[9::10] = 1234567
    assert (np.flatnonzero(lines.set_lines(foot, np.array([10] * 4))) == [9, 19, 29, 39]).all()


def test_viterbi_and_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    chain = lines.Chain(rng.normal(size=len(lines.FEATURES)), rng.normal(size=(2, 2)))
    length = np.array([3, 1, 5, 0, 2])
    first = np.append(0, np.cumsum(length))[:-1]
    x = rng.integers(0, 2, (int(length.sum()), len(lines.FEATURES))).astype(float)
    label = chain.viterbi(x, first, length)
    p, *_ = chain.expected(x, first, length)
    for a, n in zip(first, length):
        if n:
            options = list(product((0, 1), repeat=int(n)))
            score = np.array([sum(y * (x[a + i] @ chain.weights) for i, y in enumerate(o)) + sum(chain.move[o[i], o[i + 1]] for i in range(n - 1)) for o in options])
            assert tuple(label[a : a + n]) == options[int(score.argmax())]
            w = np.exp(score - score.max())
            assert np.allclose(p[a : a + n], [sum(w[k] for k, o in enumerate(options) if o[i]) / w.sum() for i in range(n)])


def test_language_held_out_and_undecided(spark, tables):
    docs, _ = tables
    model = langid.fit(docs)
    extra = spark.createDataFrame([(-1, None), (-2, "123 ..."), (-3, ""), (-4, "x" * 500)], DOC)
    scored, name = langid.identify(docs.select("doc_id", "text").unionByName(extra), model)
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = {r["doc_id"]: r for r in scored.select("doc_id", f"{name}.*").collect()}
    out = [rows[d]["lang_pred"] == k for d, k in truth.items() if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(out) / len(out) > 0.97
    assert [rows[k]["lang_pred"] for k in (-1, -2, -3)] == ["und"] * 3 and rows[-1]["score"] == 0 and rows[-4]["lang_pred"] != "und"


def test_forward_sums_all_segmentations():
    vocabulary = langid.Vocabulary(langid.default_vocabulary())
    word = langid.MARK + "then"
    ((_, codes),) = langid.by_length([word])
    rng = np.random.default_rng(0)
    p = rng.random((vocabulary.none + 1, 1))
    p[-1] = 0
    lattice = vocabulary.lattice(codes)

    def total(i):
        return 1.0 if i == len(word) else sum(p[lattice[l - 1][0, i], 0] * total(i + l) for l in range(1, len(word) - i + 1) if l <= len(lattice))

    assert np.isclose(langid.forward(lattice, p)[0, -1, 0], total(0))


def test_long_words_are_summed_as_wholes():
    vocabulary = langid.Vocabulary(langid.default_vocabulary())
    rng = np.random.default_rng(0)
    p = rng.random((vocabulary.none + 1, 3)) / 50
    p[-1] = 0
    for word in (langid.MARK, langid.MARK + "x", langid.MARK + "unbelievablythenandforwhich", langid.MARK + "aé" * 14):
        lattice = vocabulary.lattice(langid.code_matrix([word]))
        ending = langid.ending_at(lattice)
        assert np.allclose(np.exp(langid.long_forward(ending, langid.logs(p))), langid.forward(lattice, p)[0])
        assert np.allclose(langid.long_expected(lattice, ending, langid.logs(p[:, :1]), 2.0), langid.expected(lattice, p[:, :1], np.array([2.0])))
    # many characters: no cut, no underflow; a word's sum is at least that of its halves
    half = "donaudampfschifffahrt" * 40
    score = langid.Scorer(langid.Model(langid.default_vocabulary(), ["a", "b", "c"], np.zeros(3), p)).word_scores([half + half, half])
    lattice = vocabulary.lattice(langid.code_matrix([half]))
    assert np.isfinite(score).all() and (score[0] >= score[1] + langid.long_forward(langid.ending_at(lattice), langid.logs(p))[-1] - 1e-6).all()


def bigram_score(docs, weight):
    """Held-out log10 probability of a bigram model, interpolated with the base's smoothed unigrams."""
    import re
    from collections import Counter

    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    toks = [(zlib.crc32(str(d).encode()) % 10 == 0, low(t)) for d, t in docs]
    one = Counter(x for out, w in toks if not out for x in w)
    two = Counter(p for out, w in toks if not out for p in zip(["", *w], w))
    before = Counter(x for out, w in toks if not out for x in ["", *w[:-1]])
    n, v = sum(one.values()), len(one)
    p = lambda a, x: (two[a, x] + weight * (one[x] + 0.1) / (n + 0.1 * (v + 1))) / (before[a] + weight)
    return sum(np.log10(p(a, x)) for out, w in toks if out for a, x in zip(["", *w], w))


def test_language_model_base_and_gain(spark, tables):
    docs, _ = tables
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x")], DOC))
    texts = [(r["doc_id"], r["text"]) for r in every.collect()]
    want = langmodel.brute_base(texts)
    # all types but the rare ones are broadcast, or a few hundred
    for head in (langmodel.HEAD, 500):
        rows = langmodel.score_corpus(every, head=head).collect()
        assert len(rows) == len(want)
        for r in rows:
            n, known, total, base = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and abs(r["base_score"] - base) < 1e-6 * abs(base)
        out = [r for r in rows if r["held_out"]]
        gain = lambda other: (sum(r["score"] for r in out) - other) / sum(r["n_tokens"] for r in out)
        assert gain(sum(r["base_score"] for r in out)) > 0.2
        if head == langmodel.HEAD:
            gains = {w: gain(bigram_score(texts, w)) for w in (5, 20, 50, 100, 200, 400)}
            assert min(gains.values()) > 0.01, gains


def test_language_model_does_not_depend_on_partitions_and_counts_repeated_rows(spark, sample):
    rows = [*sample, *sample[:5], (None, "null id"), (7, None)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = [sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in langmodel.score_corpus(x).collect())) for x in (d.coalesce(1), d.repartition(7))]
    assert len(got[0]) == len(rows) == len(got[1])
    assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4 * abs(a[3]) for a, b in zip(*got))
    twice = [x for x in got[0] if x[:2] == (False, sample[0][0])]
    assert len(twice) == 2 and abs(twice[0][3] - twice[1][3]) < 1e-9


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(2)
    head = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    count = rng.integers(2, 5000, len(head))
    m = langmodel.Model(head, count, {}, 10_000, 4000, 16)
    m.weight = rng.normal(size=m.weight.shape).astype(np.float32)
    found = m.find(np.concatenate([head, head + np.uint64(16)]))
    assert (found[: len(head)] == np.arange(len(head))).all() and (found[len(head) :] == -1).all()
    # all leaves of the tree, behind one context
    leaves = [(kind << langmodel.DEPTH | leaf << (langmodel.DEPTH - d), langmodel.CLASS_BITS + d) for kind, d in enumerate(m.depth.tolist()) for leaf in range(1 << d)]
    code, steps = np.array(leaves).T
    context = [f[-1:].repeat(len(code)) for f in langmodel.contexts(head[:4], np.zeros(4, int))]
    p = 10 ** sum(m.walk(code, steps, context))
    assert np.isclose(p.sum(), 1, atol=1e-4)
    # and the tokens within a leaf
    leaf = m._leaf(*m._code(m.head, m.band))
    for k in set(leaf.tolist()):
        assert np.isclose((10 ** m.share[leaf == k]).sum(), 1)
    # rare tokens, seen and unseen, of one ending: the ways to all leaves are taken by seen ones only
    m.rare = {leaf: (int(rng.integers(3, 9)), 3) for leaf in range(5 << langmodel.DEPTH, 6 << langmodel.DEPTH, 8)}
    parts = {leaf: (10**a, 10**b) for leaf, a, b in m.rare_parts() if leaf >> langmodel.DEPTH == 5}
    assert all(np.isclose((n - langmodel.DISCOUNT * 3) * parts[leaf][0] + parts[leaf][1], 1) for leaf, (n, _) in m.rare.items())


def test_language_model_of_nothing(spark):
    assert langmodel.score_corpus(spark.createDataFrame([], DOC)).count() == 0
    (r,) = langmodel.score_corpus(spark.createDataFrame([(1, None)], DOC)).collect()
    assert r["n_tokens"] == 1


def test_digest_of_no_items():
    assert decontaminate.digest([]) == hashlib.sha256(b"").hexdigest()


# --------------------------------------------------------------------------------------------------- line hashing


def test_units_match_brute_force(spark, sample):
    from parley.llm import units

    texts = dict(sample)
    rows = [*texts.items(), (100_001, None), (100_002, ""), (100_003, "Same line of words here.\nSAME  line of\twords here. Other end now"), (100_004, "x y\nx y"), (100_005, "one two three four five six " * 300)]
    done, name = units.dedup_units(docs_of(spark, rows), min_words=5)
    got = {r["doc_id"]: r for r in done.select("doc_id", f"{name}.*").collect()}
    want = units.brute(rows, 5)
    assert {d: (r["n_units"], r["kept"]) for d, r in got.items()} == want
    assert got[100_003]["n_removed"] == 1 and got[100_004]["n_removed"] == 0
    for d, r in got.items():
        raw = (dict(rows)[d] or "").encode()
        assert len(r["kept_starts"]) + r["n_removed"] == r["n_units"] and all(raw[a:z].strip() == raw[a:z] for a, z in zip(r["kept_starts"], r["kept_ends"]))


def test_units_of_an_empty_table_and_clashing_columns(spark):
    from parley.llm import units

    d = spark.createDataFrame([(None, "a b c d e f", 1), (2, "a b c d e f", 2)], "doc_id long, text string, k1 int")
    done, name = units.dedup_units(d)
    assert {r["doc_id"]: r["n_removed"] for r in done.select("doc_id", f"{name}.n_removed").collect()} == {2: 0, None: 1}
    assert units.dedup_units(d.limit(0))[0].count() == 0


def test_line_hashing_takes_short_lines_and_short_sentences(spark, tmp_path):
    from parley.llm import units

    rows = [(1, "All rights reserved.\nHome\nNo. Not yet. Come back later."), (2, "Other text stands here\nall  rights reserved.\nHOME"), (3, "No. Not yet. Come back later.\n\u8fd9\u662f\u4e00\u884c"), (4, "\u8fd9\u662f\u4e00\u884c\nown line"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in units.op3_line_hashing(spark, str(tmp_path)).collect()}
    assert {d: (r["n_units"], r["text"]) for d, r in got.items()} == units.brute(rows, 1)
    assert {d: r["n_removed"] for d, r in got.items()} == {1: 0, 2: 2, 3: 3, 4: 1, 5: 0}
