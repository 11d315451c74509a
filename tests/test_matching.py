"""Quotes by seed index and glossary terms by gram index, against plain scans and all pairs."""

import random

from pyspark.sql import functions as F

from parley.functions import similarity as S
from parley.operators import quotes, soundalike


def scan(q, t, least):
    """Best window of the quote's length, shorter at the ends; earliest on ties."""
    if len(q) > len(t):
        return S.partial(q, t, least)
    if q in t:
        return 100.0, t.find(q)
    best, place = 0.0, -1
    for s in range(1 - len(q), len(t)):
        lo, hi = max(0, s), min(len(t), s + len(q))
        if (score := S.ratio(q, t[lo:hi])) > best:
            best, place = score, lo
    return (best, place) if best >= least else (0.0, -1)


def garbled(rng, t, m, alphabet):
    s = rng.randint(-5, max(0, len(t) - m) + 5)
    q = list(t[max(0, s) : max(0, s) + m])
    for _ in range(rng.randint(0, max(1, m // 8))):
        if q:
            k = rng.randrange(len(q))
            q[k : k + 1] = rng.choice(([], [rng.choice(alphabet)], [q[k], rng.choice(alphabet)]))
    return "".join(q).strip()


def test_seeds_find_what_a_scan_finds():
    rng, near = random.Random(5), 0
    for _ in range(700):
        alphabet = rng.choice(["ab ", "abcdefgh ", "etaoinshrdlu "])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(5, 160))).strip() or "a"
        q = garbled(rng, t, rng.randint(1, 70), alphabet)
        for least in (90, 80):
            if q:
                want, got = scan(q, t, least), S.near_places(t, [q], True, True, least)[0]
                assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9, (q, t, least)
                near += 0 <= want[1] and want[0] < 100
    assert near > 300


def test_quotes_across_parts_and_very_long_lines(spark):
    rng = random.Random(6)
    said = {m: [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 7))) for _ in range(rng.choice([1, 5, 60]))) for _ in range(12)] for m in (1, 2)}
    rows = [(m, i, float(i), t, "A") for m, ts in said.items() for i, t in enumerate(ts)]
    lines = spark.createDataFrame(rows, "meeting_id int, line int, start double, text string, label string")
    index = quotes.quote_index(lines, lines.select("meeting_id", "line").where("meeting_id = 2 AND line = 3"))
    whole = {1: " ".join(said[1]), 2: " ".join(t for i, t in enumerate(said[2]) if i != 3)}
    asked = {(m, garbled(rng, t, rng.randint(3, 90), "etaoin ")) for m, t in whole.items() for _ in range(60)} - {(1, ""), (2, "")}
    asked |= {(1, said[1][4][-3:]), (2, said[2][3] + " zz"), (1, whole[1][:1])}
    df = spark.createDataFrame(sorted(asked), "meeting_id int, q string")
    want = {(m, q): p for m, q in asked if (p := scan(q, whole[m], 90)[1]) >= 0}
    longest = df.groupBy("meeting_id").agg(F.max(F.length("q")).alias("longest"))
    for part, batch in ((64, 7), (quotes.PART, quotes.BATCH)):
        assert quotes.text_parts(index, longest, part).agg(F.max(F.length("text"))).first()[0] <= 4 * part + 400
        found = {(r["meeting_id"], r["q"]): r["pos"] for r in quotes.places(df, index, part=part, batch=batch).collect()}
        assert found == want, sorted(set(found.items()) ^ set(want.items()))[:4]
    lines_at = {(r["meeting_id"], r["q"]): r["line"] for r in quotes.at_lines(quotes.places(df, index), index, 64).collect()}
    starts = {(r["meeting_id"], r["line"]): r["offset"] for r in index.collect()}
    assert lines_at == {(m, q): max(n for (k, n), o in starts.items() if k == m and o <= p) for (m, q), p in want.items()}


def test_gram_join_is_exact(spark):
    rng = random.Random(2)
    parts = ["ka", "to", "mi", "ther", "sch", "igh", "ph", "on", "x", "qu", "ness", "ing", "a", "e", "12", "7"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    terms = sorted({w if rng.random() < 0.5 else w[:2] + rng.choice("aeh") + w[3:] for w in words[:120]} | {"123", "45", "a", "ai"})
    heard = [(w, 75 if i % 2 else 82) for i, w in enumerate(sorted({*words[120:], *words[:40], "124", "46", "ay", "b"}))]
    want = {}
    for a, least in heard:
        for b in terms:
            score = S.sound_and_spelling(a, b)
            if 2 * len(a) >= len(b) and len(a) <= 2 * len(b) and score[2] > least and score[1] >= 60:
                want[a, b] = score[2]
    assert len(want) > 60
    for keys in ([], ["meeting_id"]):
        h = spark.createDataFrame([(1, w, least) for w, least in heard], "meeting_id int, text string, least int")
        t = spark.createDataFrame([(1, w) for w in terms] + [(2, "zzz")], "meeting_id int, text string")
        assert {(r["text"], r["term"]): r["score"] for r in soundalike.sound_alike(h, t, keys).collect()} == want
        pairs = soundalike.candidate_pairs(h.withColumn("least", F.col("least").cast("double")), t, keys).count()
        assert pairs < len(heard) * len(terms) / 10


def test_mapping_is_the_best_of_all_permutations():
    from itertools import permutations

    import pandas as pd

    from parley.operators import evaluate

    rng = random.Random(3)
    for _ in range(120):
        a, b = rng.randint(1, 5), rng.randint(1, 6)
        n = {(f"s{i}", f"g{j}"): rng.choice([1, 2, 3, 9]) for i in range(a) for j in range(b) if rng.random() < 0.7}
        if not n:
            continue
        ours, theirs = sorted({x for x, _ in n}), sorted({y for _, y in n})
        pair = (lambda x, y: (y, x)) if len(ours) > len(theirs) else (lambda x, y: (x, y))
        few, many = (theirs, ours) if len(ours) > len(theirs) else (ours, theirs)
        best = max(permutations(many, len(few)), key=lambda p: sum(n.get(pair(x, y), 0) for x, y in zip(few, p)))
        want = [(*pair(x, y), n.get(pair(x, y), 0)) for x, y in zip(few, best)]
        assert evaluate.best_mapping(pd.DataFrame([(*k, v) for k, v in n.items()], columns=["speaker", "gold", "n"])) == want
    many = pd.DataFrame([(f"s{i:02}", f"g{j:02}", rng.randint(0, 99)) for i in range(30) for j in range(30)], columns=["speaker", "gold", "n"])
    assert len(evaluate.best_mapping(many)) == 30


def test_a_long_quote_is_scored_in_few_passes(monkeypatch):
    rng, calls = random.Random(8), []
    common = S._common
    monkeypatch.setattr(S, "_common", lambda where, n, b: calls.append(1) or common(where, n, b))
    line = lambda n: " ".join(rng.choice(("tion", "the", "er", "anda", "shre", "ing", "ofon")) + rng.choice(("", "ly", "ed", "st")) for _ in range(n))
    for _ in range(6):
        t, q = line(70), line(60)
        nearly = t[30:60] + t[61:200] + "x" + t[200:330]
        cut = "yyyy" + t[:250], t[-250:] + "yyyy"
        for x in (q, nearly, *cut):
            calls.clear()
            found = S.near_places(t, [x], True, True, 90.0)[0]
            assert len(calls) <= 40
            assert found == scan(x, t, 90.0)
        assert S.near_places(q[:300], [q[:302]], True, True, 90.0)[0] == (S.partial(q[:302], q[:300], 90.0)[0], 0)


def test_stretches_of_a_line_against_all_pairs(monkeypatch):
    rng, found = random.Random(4), 0
    calls = []
    ratio = soundalike.ratio
    monkeypatch.setattr(soundalike, "ratio", lambda a, b: calls.append(1) or ratio(a, b))
    for _ in range(40):
        words = ["".join(rng.choice("abdeikrst") for _ in range(rng.randint(0, 7))) for _ in range(30)]
        terms = sorted({("".join(words[k : k + rng.randint(1, 3)])[1:] + rng.choice("aek")) * rng.choice((1, 1, 1, 9)) for k in range(0, 28, 4)} - {""})
        closes, unsure = [rng.random() < 0.1 for _ in words], [rng.random() < 0.1 for _ in words]
        want = set()
        for a in range(len(words)):
            for z in range(a + 1, min(a + 5, len(words)) + 1):
                text, least = "".join(words[a:z]), 75 if any(unsure[a:z]) else 82
                if not any(closes[a : z - 1]) and text and not (z == a + 1 and len(text) < 4):
                    for t in terms:
                        sound, spelling, score = S.sound_and_spelling(text, t)
                        if score > least and spelling >= 60 and 2 * len(text) >= len(t) and len(text) <= 2 * len(t):
                            want.add((a, z, t, score, sound, spelling))
        assert set(soundalike.alike_in_line(words, closes, unsure, terms)) == want
        found += len(want)
    assert found > 100
    # few pairs of the 40 lines' some 30,000 get to the slow comparison
    assert len(calls) < 9000


def test_quotes_are_shuffled_by_meeting_once_and_carry_their_lines(spark, tmp_path):
    from parley.plans import catalogue

    said = ["Ann: the old plan; the new plan.", "", "the new plan costs more than the old one did last year, " * 30, "no"]
    rows = [(m, "\n".join(said[m % 2 :])) for m in range(1, 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalogue.queries()["quote_exact_line"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # lines, quotes (read twice), labels and batches; labels, lengths and parts are joined, nothing is joined back
    assert plan.count("Exchange hashpartitioning") <= 6 and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 4
    # a line is split into words once, not once a quote
    assert catalogue._quotes(catalogue.R.document_lines(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    text = lambda m: " ".join(filter(None, (" ".join("".join(c if c.isalnum() else " " for c in x.lower()).split()) for x in said[m % 2 :])))
    got = {(r["meeting_id"], r["quote"]): (r["pos"], r["line"]) for r in out.collect()}
    assert len(got) >= 16 and all(text(m).find(q) == p for (m, q), (p, _) in got.items())
    assert got[2, "ann the old plan the new"] == (0, 0) and got[2, "plan"] == (12, 0) and got[2, "the new plan costs more than"] == (30, 2)
    assert got[1, "the new plan costs more than"] == (0, 1)


def test_many_texts_at_once_find_what_each_finds_alone(monkeypatch):
    rng, near, over = random.Random(9), 0, 0
    for round_ in range(120):
        monkeypatch.setattr(S, "HITS", rng.choice((1, 50, 1 << 19)))
        texts, asked = [], []
        for _ in range(rng.randint(1, 6)):
            alphabet = rng.choice(["ab ", "abcdefgh ", "etaoinshrdlu 019", "etaoinshrdlué "])
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(5, 300))).strip() or "a"
            t = t[:9] * 25 if rng.random() < 0.1 else t
            qs = [garbled(rng, t, rng.choice((rng.randint(1, 45), rng.randint(60, 68), 90)), alphabet) for _ in range(rng.randint(0, 8))]
            # over the ends too
            qs += ["zz" + t[:20], t[-20:] + "zz", t[-64:], t[:40] + "z" + t[40:63]]
            texts.append(t)
            asked.append([q for q in qs if q])
        first, last = ([rng.random() < 0.7 for _ in texts] for _ in range(2))
        for least in (90, 80):
            got = S.near_places_at_once(texts, asked, first, last, least)
            assert got == [S.near_places(t, qs, f, z, least) for t, qs, f, z in zip(texts, asked, first, last)]
            near += sum(0 < score < 100 for x in got for score, _ in x)
            over += sum(score > 0 and p == 0 for x in got for score, p in x)
    assert near > 1000 and over > 300


def test_quotes_of_a_batch_are_not_looked_up_one_by_one(spark, monkeypatch):
    import pyarrow as pa

    rng, calls = random.Random(10), []
    for name in ("near_windows", "_hanging"):
        f = getattr(S, name)
        monkeypatch.setattr(S, name, lambda *x, f=f: calls.append(1) or f(*x))
    texts = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)) for _ in range(4)]
    asked = [[t[k : k + 12] + t[k + 13 : k + 38] for k in range(0, len(t) - 40, 40)] for t in texts]
    monkeypatch.setattr(quotes, "AT_ONCE", 2 * len(texts[0]) * len(asked[0]), raising=False)
    yes = pa.array([True] * 4)
    found = quotes._look(90.0).func(pa.array(texts), yes, yes, pa.array([[0, 700]] * 4), pa.array(asked)).to_pylist()
    assert [[(100.0 - x["lost"], x["pos"]) for x in row] for row in found] == [[scan(q, t, 90) for q in qs] for t, qs in zip(texts, asked)]
    assert all(x["piece"] == (x["pos"] >= 700) for row in found for x in row)
    # only some at the ends
    assert sum(map(len, asked)) > 150 and len(calls) <= 16


def test_a_near_quote_may_have_no_whole_half(spark):
    from parley.operators import names

    # one letter missing in one half and one more in the other: 13 of 14 letters in order
    q, t = "ci n ci n ci n", "doesoez nci nci un ci nci ntaos os so"
    assert q[:7] not in t and q[7:] not in t
    assert S.near_places(t, [q], True, True, 90)[0] == S.near_places_at_once([t], [[q]], [True], [True], 90)[0][0] == scan(q, t, 90) == (2600 / 28, 9)
    lines = spark.createDataFrame([(1, 0, t), (1, 1, "well"), (1, 3, q)], "meeting_id int, line int, text string")
    claims = lines.where("line = 3").select("meeting_id", F.lit(7).alias("ord"), F.lit(0).alias("line"), F.col("text").alias("quote"))
    assert names.locate_quotes(claims, lines, lines.select("meeting_id", "line").where("false")).first()["found"] == 0


def test_a_line_without_text_is_nobodys_neighbour(spark, tmp_path):
    import duckdb

    from parley.plans import catalogue, pieces  # noqa: F401

    words = "the old plan costs more than anna said it would when we met her last year so we wait for the new one that bo had in mind and see".split()
    said = [(0, "user", None), (1, "assistant", " ".join(words)), (2, "user", ""), (3, "assistant", None)]
    rows = [(m, t, r, x and " ".join([x, *["well"] * m])) for m in range(9) for t, r, x in said]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in catalogue.queries()["checked_claims"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = c.execute(catalogue.oracle_sql()["checked_claims"]).fetchall()
    by_ord = lambda rows: sorted(rows, key=lambda r: r[:2])
    assert by_ord(got) == by_ord(want) and len(got) > 30
    assert any(r[8] == "S1 neither spoke just before nor answered right after" for r in got)


def test_a_line_nearly_like_another_one_is_found_as_its_sql_says(spark, tmp_path):
    import duckdb

    from parley.operators import names
    from parley.plans import catalogue, pieces  # noqa: F401

    t = "the new plan costs more than the old one did last year"
    rows = [(m, k, "user", x) for m in range(7) for k, x in enumerate((t + "a" * m, "well", t[:30] + "x" + t[31:], t + "a" * m, t))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {tuple(r) for r in catalogue.queries()["quote_near_line"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = set(c.execute(catalogue.oracle_sql()["quote_near_line"]).fetchall())
    assert got == want and len(got) == len(rows)
    # the operator itself finds near ones too
    lines = df.select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("line"), "text")
    claims = lines.where("line = 2").select("meeting_id", F.lit(1).alias("ord"), F.lit(4).alias("line"), F.col("text").alias("quote"))
    none = lines.select("meeting_id", "line").where("false")
    assert {r["found"] for r in names.locate_quotes(claims, lines, none).collect()} == {4}
    assert {r["found"] for r in names.locate_quotes(claims, lines, none, exact_only=True).collect()} == {2}


def test_claims_of_a_line_meet_the_texts_around_it_once(spark, monkeypatch):
    import pyarrow as pa

    from parley.operators import names

    rng, words = random.Random(11), "anna bo costs did for last met more new old one plan said see than that the wait we when year".split()
    said = {(m, k): " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 4, 25)))) for m in range(3) for k in range(8)}
    claims = []
    for m, k in said:
        for _ in range(40):
            q = garbled(rng, said[m, k], rng.randint(1, 80), "etaoin ")
            claims.append((m, len(claims), k + rng.randint(-3, 3), q.upper() + rng.choice(("", "!"))))
    doubtful = {(0, 3), (2, 0)}

    def plain(m, line, q):
        for at in (line, line - 1, line + 1, line - 2, line + 2):
            t = said.get((m, at), "") if (m, at) not in doubtful else ""
            if q and t and len(q) <= len(t) + 3 and scan(q, t, 90)[1] >= 0:
                return at

    normal = lambda q: " ".join("".join(c if c.isalnum() else " " for c in q.lower()).split())
    want = {i: plain(m, line, normal(q)) for m, i, line, q in claims}
    lines = spark.createDataFrame([(*k, t) for k, t in said.items()] + [(1, 99, None)], "meeting_id int, line int, text string")
    df = spark.createDataFrame([(*c, "x") for c in claims], "meeting_id int, ord int, line int, quote string, more string")
    for asked in (7, names.ASKED):
        monkeypatch.setattr(names, "ASKED", asked)
        got = names.locate_quotes(df, lines, spark.createDataFrame(sorted(doubtful), "meeting_id int, line int"))
        assert got.columns == [*df.columns, "found"] and {r["ord"]: r["found"] for r in got.collect()} == want
    assert sum(x is None for x in want.values()) > 50 and len({x - c[2] for c, x in zip(claims, want.values()) if x is not None}) == 5
    # a near find in an earlier text counts before an exact one in a later; none may be longer than its text by more than three
    holding = quotes.first_holding(90).func
    t = pa.array([["the new plan costs mure than", "the new plan costs more than"], None, ["abcdefghijklmnopqrstuvwxyz"]])
    q = pa.array([["the new plan costs more than", "s more", "", "zz"], ["a"], ["xabcdefghijklmnopqrstuvwxyzy", "xyabcdefghijklmnopqrstuvwxyzxy"]])
    assert holding(t, q).to_pylist() == [[0, 1, None, None], [None], [0, None]]


def test_claims_are_checked_without_joining_them_back(spark):
    from parley.plans import catalogue, pieces  # noqa: F401

    plan = catalogue.queries()["checked_claims"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # labels of lines and their neighbours (3), texts, voices, attendees; claims aren't joined with themselves
    assert plan.count("Join ") <= 6, plan.count("Join ")


def test_a_name_is_compared_with_few_attendees(monkeypatch):
    from parley.operators import names

    rng, calls = random.Random(12), []
    ratio = names.ratio
    word = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(n))
    people = [word(rng.randint(3, 9)).title() + rng.choice(("", " Smith", " " + word(6))) for _ in range(400)] + ["", "É!", "Élan Vital"]

    def plain(name):
        heard = names._normal(name)
        whole = [a for a in people if ratio(names._normal(a), heard) >= 85]
        first = [a for a in people if names._normal(a) and ratio(names._normal(a).split()[0], heard) >= 85]
        return (whole or first or [" ".join(w[:1].upper() + w[1:] for w in name.split())])[0]

    asked = [garbled(rng, rng.choice(people).lower(), 30, "aeiou") for _ in range(150)] + ["", "é", word(300), "Smith", "nobody  here"]
    want = [plain(x) for x in asked]
    monkeypatch.setattr(names, "ratio", lambda a, b: calls.append(1) or ratio(a, b))
    assert [names.canonical(x, people) for x in asked] == want and names.canonical("bo ray", []) == "Bo Ray"
    assert len({x for x in want if x in people}) > 60
    # of some 800 spellings each
    assert len(calls) <= 60 * len(asked), len(calls) / len(asked)
