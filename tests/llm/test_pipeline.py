"""The pipeline's stages one after the other, each against what its contract says of its own input."""

import random

import corpus_pipeline as P
from parley.llm import decontaminate, nearjoin, substrings

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i == len(P.STAGES) - 1:
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "jaccard_join":
            groups = nearjoin.brute(list(before.items()), nearjoin.CORPUS)
            assert set(after) == {d for d, (n, c) in groups.items() if c == d or not n}
        if name == "suffix_array":
            gone = {d: n for d, _, n, _, _ in substrings.brute(list(before.items()))}
            passages = dict(zip(before, substrings.brute_words(list(before.items())), strict=True))
            assert set(after) == set(before) and all((after[d] == before[d]) == (n == 0 and not passages[d]) for d, n in gone.items())
            assert any(passages[d] and not n for d, n in gone.items())
        if name == "winnowing":
            hit = decontaminate.brute(list(before.items()), items)
            assert set(after) == {d for d in before if not hit[d][1]}
        before = after


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_near_copies_by_five_words_and_eight_tenths(spark):
    rule = nearjoin.Rule(5, 80, 100, 1.25)
    rng = random.Random(8)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for k in range(40):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([5, 8, 12, 30, 90, 400]))]
        rows.append((10_000 + 10 * k, " ".join(w)))
        for c in range(1, 6):
            x = list(w)
            for _ in range(rng.choice([0, 1, len(x) // 50, len(x) // 45])):
                x[rng.randrange(len(x))] = "edited"
            rows.append((10_000 + 10 * k + c, " ".join(x + [f"more{i}" for i in range(rng.choice([0, len(w) // 9, len(w) // 5]))])))
    got = {r["doc_id"] for r in P.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    keeps = lambda groups: {d for d, (n, c) in groups.items() if c == d or not n}
    assert got == keeps(nearjoin.brute(rows, rule)) and len(got) < len(keeps(nearjoin.brute(rows)))
    small = [(d, t) for d, t in rows if d >= 10_000]
    _, named = nearjoin.near_groups(spark.createDataFrame(small, "doc_id long, text string"), region_shingles=300, rule=rule)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in named.collect()} == nearjoin.brute(small, rule)
