"""Stated cases of flags, speakers, glossary, topics and names, as rows."""

import pytest
from pyspark.sql import functions as F

from parley.functions import similarity as S
from parley.functions import text as X
from parley.operators import evaluate, flags, glossary, names, topics, turns
from parley.sources import schemas

LINE = "meeting_id long, line int, start double, end double, text string, no_speech_prob double, avg_logprob double, compression_ratio double, speaker string"


def lines_of(spark, texts, starts=None, speaker=None, **over):
    rows = [(1, i, float(starts[i] if starts else 10 * i), float(starts[i] if starts else 10 * i) + 5, t, over.get("no_speech", 0.05), over.get("logprob", -0.3), over.get("compression", 1.5), speaker[i] if speaker else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, LINE)


def flagged(spark, texts, starts=None, **over):
    meetings = spark.createDataFrame([(1, 600.0, False)], "meeting_id long, duration_s double, diarized boolean")
    out = flags.flag_lines(lines_of(spark, texts, starts, **over), meetings, flags.phantom_phrases(None, spark))
    return [(r["score"], r["flagged"], r["reasons"]) for r in out.orderBy("line").collect()]


@pytest.mark.parametrize("texts, starts, scores", [
    (["Thanks for watching!"], [100], [2]),
    (["Subtitles by the Amara.org community"], [100], [2]),
    (["We should ship it.", "Thank you.", "Thank you.", "Thank you."], [99, 100, 101, 102], [0, 3, 3, 3]),
    (["Thank you."], [590], [1]),
    (["We moved the training jobs to Kubeflow."], [5], [0]),
    (["Yeah.", "Yeah."], [5, 6], [1, 1]),
    (["Thank you.", "Thank you."], [5, 6], [3, 3]),
    (["With menus."] * 3, [5, 6, 7], [2, 2, 2]),
    (["The figures were provided by finance."], [5], [0]),
    (["Woof, the dog in the demo video was loud."], [5], [0]),
    (["Mm-hmm.", "Mm-hmm."], [5, 6], [1, 1]),
])
def test_flag_scores(spark, texts, starts, scores):
    assert [s for s, _, _ in flagged(spark, texts, starts)] == scores


def test_flag_reasons_and_phrase_file(spark):
    assert flagged(spark, ["We go.", "Thank you.", "Thank you."], [1, 2, 3])[1][2] == ["only a known Whisper phantom phrase", "repeated 2x mid-meeting"]
    assert flagged(spark, ["the the the"], [1], logprob=-1.4, compression=3.1)[0] == (2, True, ["low confidence", "looping text"])
    phrases = spark.createDataFrame([("Ladies and Gentlemen!",), ("uh huh",)], "prediction string")
    got = {r[0] for r in flags.phantom_phrases(phrases, spark).collect()}
    assert "ladies and gentlemen" in got and "uh huh" not in got and "meow" in got


def test_empty_lines_never_repeat_and_no_voice(spark):
    meetings = spark.createDataFrame([(1, 600.0, True)], "meeting_id long, duration_s double, diarized boolean")
    out = flags.flag_lines(lines_of(spark, ["", "", "Real."]), meetings, flags.phantom_phrases(None, spark)).orderBy("line").collect()
    assert [r["score"] for r in out] == [0, 0, 1]


def test_relabel(spark):
    raw = spark.createDataFrame([(1, 0, 5.0, 8.0, "SPEAKER_00"), (1, 1, 0.0, 5.0, "SPEAKER_03"), (1, 2, 8.0, 9.0, "SPEAKER_03"), (1, 3, -1.0, -1.0, "GONE")], schemas.RAW_TURNS)
    assert [(r["start"], r["speaker"]) for r in turns.relabel(raw).orderBy("turn_idx").collect()] == [(0.0, "S1"), (5.0, "S2"), (8.0, "S1")]


def split(spark, text, end, spans):
    words = text.split()
    step = end / len(words)
    w = [(i * step, (i + 1) * step, x, 0.9) for i, x in enumerate(words)]
    lines = spark.createDataFrame([(1, 0, 0.0, float(end), text, 0.05, -0.3, 1.4, w)], schemas.LINES)
    t = spark.createDataFrame([(1, i, float(a), float(b), s) for i, (a, b, s) in enumerate(spans)], "meeting_id long, turn_idx int, start double, end double, speaker string")
    return [(r["text"], r["start"], r["end"], r["speaker"]) for r in turns.assign_speakers(lines, t).orderBy("line").collect()]


def test_split_snap_blip_and_whole_sentence(spark):
    text = "I propose we keep it. Yes, let's keep it."
    want = [("I propose we keep it.", 0.0, 5.0, "S1"), ("Yes, let's keep it.", 5.0, 9.0, "S2")]
    assert split(spark, text, 9, [(0, 5, "S1"), (5, 9, "S2")]) == want
    assert split(spark, text, 9, [(0, 6, "S1"), (6, 9, "S2")]) == want


A, B, C = "S1", "S2", "S3"


@pytest.mark.parametrize("said, voices, want", [
    ("so we should really go", [A, A, B, A, A], [A] * 5),
    ("Keep it. Yes. Good.", [A, A, B, A], [A, A, B, A]),
    ("one two", [None, B], [B, B]),
    ("one two three", [A, None, None], [A, A, A]),
    ("one", [None], [None]),
    # the nearest end, the earlier one of two as near; a border that moves right gives words to the voice before it
    ("we go. there now then", [A, A, A, B, B], [A, A, B, B, B]),
    ("we go there now. then we", [A, A, B, B, B, B], [A, A, A, A, B, B]),
    ("we go. there now. then we", [A, A, A, B, B, B], [A, A, B, B, B, B]),
    # short runs follow one another: each takes what the one before it took; the first takes the next one's own
    ("a b c d e f", [A, A, B, C, A, A], [A] * 6),
    ("a b c d", [B, A, A, A], [A] * 4),
    ("a b", [A, B], [B, B]),
])
def test_steady_labels(spark, said, voices, want):
    row = spark.createDataFrame([(said.split(), voices)], "t array<string>, labels array<string>")
    for stage in turns.steady(F.col("t")):
        row = row.withColumn("labels", stage(F.col("labels")))
    assert row.first()["labels"] == want


def test_nearest_none_and_ties(spark):
    t = spark.createDataFrame([(1, 0, 0.0, 10.0, "S1"), (1, 1, 50.0, 52.0, "A"), (1, 2, 52.0, 54.0, "B")], "meeting_id long, turn_idx int, start double, end double, speaker string")
    w = spark.createDataFrame([(1, 0, 10.2, 10.6), (1, 1, 30.0, 32.0), (1, 2, 51.0, 53.0), (1, 3, 5.0, 5.0), (1, 4, 10.5, 10.7), (1, 5, 10.51, 10.7)], "meeting_id long, line int, start double, end double")
    got = {r["line"]: r["speaker"] for r in turns.spans_to_speakers(w, t, ["meeting_id", "line"]).collect()}
    assert got == {0: "S1", 1: None, 2: "B", 3: "S1", 4: "S1", 5: None}


def test_speaker_summary_and_conversation(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 2.0, "a", "S1"), (1, 1, 2.0, 5.0, "b", "S2"), (1, 2, 5.0, 6.0, "c", "S1"), (1, 3, 6.0, 7.0, "d", None)], "meeting_id long, line int, start double, end double, text string, speaker string")
    assert sorted((r["speaker"], r["talk_s"], r["lines"]) for r in turns.speaker_summary(rows).collect()) == [("S1", 3.0, 2), ("S2", 3.0, 1)]
    t = turns.conversation_turns(rows.withColumn("label", F.col("speaker"))).orderBy("turn").collect()
    assert [r["label"] for r in t] == ["S1", "S2", "S1", "(no speaker)"]


def test_similarity_values():
    for heard, term, score in (("cube flow", "Kubeflow", 93.8), ("laura", "LoRA", 83.3), ("tally text", "Teletext", 85.3), ("graph ana", "Grafana", 90.0), ("on x", "ONNX", 92.9), ("point", "Pound", 80.0)):
        sound, _, mean = S.sound_and_spelling(heard, term)
        assert sound == 100 and abs(mean - score) < 0.06
    assert S.sound_and_spelling("revenue", "Grafana")[2] < 72
    assert S.partial("brown fax", "the quick brown fox jumps", 85)[1] == 10
    assert S.partial("missing words here", "nothing alike", 90) == (0.0, -1)
    assert S.token_set("use rubber", "rubber use now") == 100.0


def test_glossary_parse_merge_hotwords(spark):
    m = spark.createDataFrame([(1, " Kubeflow, ONNX ;\nPriya\n\n , ")], "meeting_id long, typed string")
    assert [r["text"] for r in glossary.typed_terms(m).orderBy("ord").collect()] == ["Kubeflow", "ONNX", "Priya"]
    t = spark.createDataFrame([(1, 0, "kubeflow", "pack", ""), (1, 1, "KubeFlow", "inferred", ""), (1, 2, "Kubeflow", "user", "")], schemas.GLOSSARY)
    assert [(r["text"], r["source"]) for r in glossary.merge_terms(t).collect()] == [("Kubeflow", "user")]
    long = spark.createDataFrame([(1, i, f"{'x' * 29}{i:02d}", "pack", "") for i in range(40)], schemas.GLOSSARY)
    assert glossary.hotwords(long, 10).first()["n"] == 10
    assert glossary.hotwords(long, 50, 70).first()["n"] == 2


def test_inferred_terms_are_verified(spark):
    reply = 'Sure: {"terms":[{"term":"Kubeflow","heard_as":"cube flow"},{"term":"Snowflake","heard_as":"snow flake"},{"term":"AWS","heard_as":"a ws"}]} done'
    r = spark.createDataFrame([(1, reply), (2, "no json")], schemas.REPLIES)
    t = spark.createDataFrame([(1, "we use cube flow a lot"), (2, "x")], "meeting_id long, transcript string")
    assert [x["text"] for x in glossary.inferred_terms(r, t).collect()] == ["Kubeflow"]


def hints(spark, texts, terms, words=None):
    lines = spark.createDataFrame([(1, i, t, words) for i, t in enumerate(texts)], f"meeting_id long, line int, text string, words array<{schemas.WORD}>")
    g = glossary.merge_terms(spark.createDataFrame([(1, i, t, "user", "") for i, t in enumerate(terms)], schemas.GLOSSARY))
    none = lines.select("meeting_id", "line").where("false")
    return lines, g, glossary.find_hints(lines, g, none)


def test_hints(spark):
    _, _, h = hints(spark, ["we use cube flow here."] * 30, ["Kubeflow"])
    assert h.count() == 15
    for text, term in (("we tried on x today", "ONNX"), ("the G P U is", "GPU"), ("obey G D P R now", "GDPR"), ("run pie torch now", "PyTorch")):
        assert hints(spark, [text], [term])[2].count() >= 1, text
    for text, term in (("in Grafana.", "Grafana"), ("the project manager, said", "project manager"), ("our revenue grew", "Grafana")):
        assert hints(spark, [text], [term])[2].count() == 0, text
    sure = [(0.0, 1.0, w, 0.9) for w in "a key point now".split()]
    unsure = [(0.0, 1.0, w, p) for w, p in zip("a key point now".split(), (0.9, 0.9, 0.2, 0.9))]
    assert hints(spark, ["a key point now"], ["Pound"], sure)[2].count() == 0
    (h,) = hints(spark, ["a key point now"], ["Pound"], unsure)[2].collect()
    assert h["unsure"] and 75 < h["score"] <= 82


def test_spans_stop_at_sentence_ends(spark):
    lines = spark.createDataFrame([(1, 0, "we use cube. flow is next")], "meeting_id long, line int, text string")
    spans = {(r["first"], r["end"]) for r in glossary.candidate_spans(lines).collect()}
    assert (2, 3) in spans and (2, 4) not in spans


GUARDED = [
    ("we run cube flow daily", "we run Kubeflow daily", (2, 4), "we run Kubeflow daily", "matches a glossary term"),
    ("do not ship", "do now ship", (1, 2), "do not ship", "touches a negation"),
    ("by the 15th ok", "by the 16th ok", (2, 3), "by the 15th ok", "touches a number"),
    ("it is kind of nice", "it is really nice", (2, 4), "it is kind of nice", "result is not a glossary term"),
    ("and I cube flow", "and cube flow", (2, 4), "and I cube flow", "deletes words"),
    ("ok so cube flow", "OK, so Kubeflow.", (2, 4), "ok so Kubeflow.", "matches a glossary term"),
    ("then I see cube flow", "then see cube flow I", (3, 5), "then I see cube flow", "deletes words"),
    ("we run cube flow", "we run cube flow", (2, 4), "we run cube flow", None),
    ("a cube flow b done x", "a Kubeflow b dune x", (1, 3), "a Kubeflow b done x", "matches a glossary term"),
]


def test_guard(spark):
    rows = spark.createDataFrame([(i, i, raw, new, [hint], ["Kubeflow"]) for i, (raw, new, hint, _, _) in enumerate(GUARDED)], "meeting_id int, line int, text string, corrected string, hints array<struct<first:int,end:int>>, terms array<string>")
    done, edits = glossary.guarded(rows)
    assert {r["line"]: r["refined"] for r in done.collect()} == {i: g[3] for i, g in enumerate(GUARDED)}
    assert {r["line"]: r["reason"] for r in edits.where("ord = 0").collect()} == {i: g[4] for i, g in enumerate(GUARDED) if g[4]}


def test_refine_tables(spark):
    lines, g, h = hints(spark, ["zero", "we run cube flow", "two", "three", "four"], ["Kubeflow"])
    reply = spark.createDataFrame([(1, '{"lines":{"1":"we run Kubeflow","x":"?"},"possible_errors":[{"line":2,"text":"two","reason":"r"},{"line":3,"text":"TensorFlow","reason":"r"}]}')], schemas.REPLIES)
    t = glossary.refine(lines, g, h, reply)
    assert [r["text"] for r in t["refined"].orderBy("line").collect()] == ["zero", "we run Kubeflow", "two", "three", "four"]
    assert [(r["line"], r["text"]) for r in t["possible_errors"].collect()] == [(2, "two")]
    assert sorted(r["line"] for r in t["llm_input"].collect()) == [0, 1, 2]


REMOTE, BUDGET = "The remote control has buttons and a rubber case.", "Our budget and price limit the project cost."


def test_topics(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate([REMOTE] * 6 + [BUDGET] * 6)], "meeting_id long, line int, text string")
    sims = {r["gap"]: r["similarity"] for r in topics.gap_similarity(lines).collect()}
    assert min(range(1, 12), key=sims.get) == 6 and sims[0] == 1.0
    total = topics.running_tokens(lines).agg(F.max("total")).first()[0]
    parts = [(r["first_line"], r["end_line"]) for r in topics.topic_parts(lines, total * 2 // 3).orderBy("part").collect()]
    assert parts == [(0, 6), (6, 12)]
    assert topics.topic_parts(lines, 10_000).count() == 1
    long = spark.createDataFrame([(1, 0, "a b"), (1, 1, "word " * 500), (1, 2, "c d")], "meeting_id long, line int, text string")
    assert [(r["first_line"], r["end_line"]) for r in topics.topic_parts(long, 50).orderBy("part").collect()] == [(0, 1), (1, 2), (2, 3)]


TALK = [("Hi everyone, I'm Priya and I run this.", "S1"), ("We start now.", "S1"), ("Rahul, what do you think?", "S1"), ("Sounds good to me.", "S2"), ("Thanks, Rahul.", "S1"), ("I agree.", "S3"), ("Fine then.", "S2")]


def claims(spark, *rows, doubtful=(), attendees=(), talk=TALK):
    lines = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(talk)], "meeting_id long, line int, text string, speaker string")
    c = spark.createDataFrame([(1, i, s, n, "", k, str(line), q) for i, (s, n, k, line, q) in enumerate(rows)], schemas.CLAIMS)
    d = spark.createDataFrame([(1, i) for i in doubtful], "meeting_id long, line int")
    a = spark.createDataFrame([(1, list(attendees))], "meeting_id long, attendees array<string>")
    return names.check_claims(c, lines, d, a).orderBy("ord").collect()


@pytest.mark.parametrize("claim, accepted, reason", [
    (("S1", "Priya", "self", 0, "I'm Priya"), True, "said their own name"),
    (("S2", "Priya", "self", 0, "I'm Priya"), False, "said by S1, not by S2"),
    (("S2", "Rahul", "addressed", 2, "Rahul, what do you think"), True, "addressed by S1; S2 answered right after"),
    (("S2", "Rahul", "addressed", 4, "Thanks, Rahul"), True, "addressed by S1; S2 spoke just before"),
    (("S3", "Rahul", "addressed", 2, "Rahul, what do you think"), False, "S3 neither spoke just before nor answered right after"),
    (("S1", "Rahul", "addressed", 2, "Rahul, what do you think"), False, "a speaker cannot address themself"),
    (("S2", "Rahul", "addressed", 2, "Rahul, please take the notes"), False, "quote not found in the transcript"),
    (("S2", "Rahul", "addressed", 3, "Sounds good to me"), False, "the quote does not contain the name"),
    (("S2", "everyone", "addressed", 0, "Hi everyone"), False, "not a person's name"),
    (("S1", "Priya", "self", 1, "I'm Priya"), True, "said their own name"),
])
def test_claims(spark, claim, accepted, reason):
    (e,) = claims(spark, claim)
    assert (e["accepted"], e["reason"]) == (accepted, reason)
    if claim[3] == 1:
        assert e["line"] == 0


def test_claims_doubtful_attendees_and_backchannel(spark):
    assert not claims(spark, ("S1", "Priya", "self", 0, "I'm Priya"), doubtful=[0])[0]["accepted"]
    assert claims(spark, ("S1", "priya", "self", 0, "I'm Priya"), attendees=["Priya Sharma"])[0]["name"] == "Priya Sharma"
    talk = [("Rahul, what do you think?", "S1"), ("Mm-hmm.", "S3"), ("I think May works.", "S2")]
    got = claims(spark, ("S2", "Rahul", "addressed", 0, "Rahul, what do you think?"), ("S3", "Rahul", "addressed", 0, "Rahul, what do you think?"), talk=talk)
    assert [e["accepted"] for e in got] == [True, False]


def settle(spark, evidence, speakers=("S1", "S2", "S3"), edited=()):
    s = spark.createDataFrame([(1, k, dict(edited).get(k, ""), "edited" if k in dict(edited) else "") for k in speakers], "meeting_id long, speaker string, name string, source string")
    e = spark.createDataFrame([(1, i, k, n, kind, True, "") for i, (k, n, kind) in enumerate(evidence)], "meeting_id long, ord int, speaker string, name string, kind string, accepted boolean, role string")
    return {r["speaker"]: r for r in names.assign_names_and_roles(s, e).collect()}


def test_name_assignment(spark):
    got = settle(spark, [("S1", "Priya", "self"), ("S2", "Priya", "addressed"), ("S2", "Rahul", "addressed"), ("S2", "Rahul", "addressed")])
    assert (got["S1"]["name"], got["S2"]["name"], got["S3"]["name"]) == ("Priya", "Rahul", "") and got["S2"]["confidence"] == "high"
    got = settle(spark, [("S1", "Priya", "addressed"), ("S1", "Rahul", "addressed")])
    assert got["S1"]["name"] == "" and "Priya or Rahul" in got["S1"]["note"]
    got = settle(spark, [("S1", "Sam", "addressed"), ("S2", "Sam", "addressed")])
    assert not got["S1"]["name"] and "unclear" in got["S1"]["note"] and "unclear" in got["S2"]["note"]
    assert settle(spark, [("S1", "Priya", "self")], edited=[("S1", "Dev")])["S1"]["name"] == "Dev"
    got = settle(spark, [("S1", "Bart", "self"), ("S1", "Bart Beute", "self"), ("S1", "Richard", "self")])
    assert (got["S1"]["name"], got["S1"]["confidence"]) == ("Bart Beute", "high")
    got = settle(spark, [("S1", "Priya", "addressed"), ("S1", "Rahul", "addressed"), ("S2", "Priya", "addressed")])
    assert not got["S1"]["name"] and not got["S2"]["name"] and "unclear" in got["S2"]["note"]
    got = settle(spark, [("S1", "Rahul", "self"), ("S1", "Priya", "addressed"), ("S2", "Priya", "addressed")])
    assert (got["S1"]["name"], got["S2"]["name"]) == ("Rahul", "Priya")


def test_role_assignment_and_wording(spark):
    got = settle(spark, [("S1", "project manager", "role"), ("S1", "project manager", "role"), ("S1", "designer", "role"), ("S2", "designer", "role")])
    assert (got["S1"]["role"], got["S2"]["role"]) == ("project manager", "designer")
    row = spark.range(1).select(X.clean_role(F.lit("The Industrial Designer.")).alias("a"), X.role_mentioned(F.lit("marketing manager"), F.lit("ask the marketing expert")).alias("b"), X.role_mentioned(F.lit("project manager"), F.lit("the project is late")).alias("c"), X.role_mentioned(F.lit("industrial designer"), F.lit("the industrial designer will")).alias("d")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ("industrial designer", True, False, True)


def test_rename_and_swap(spark):
    t = spark.createDataFrame([(1, "Speaker 2 met Speaker 21."), (2, "Priya thanked Rahul")], "meeting_id long, text string")
    c = spark.createDataFrame([(1, "Speaker 2", "Sam"), (2, "Priya", "Rahul"), (2, "Rahul", "Priya")], "meeting_id long, old string, new string")
    assert [r["text"] for r in names.replace_labels(t, c, "text").orderBy("meeting_id").collect()] == ["Sam met Speaker 21.", "Rahul thanked Priya"]


def test_wording(spark):
    q = lambda s, d="": spark.range(1).select(X.settled(F.lit(s), F.lit(d))).first()[0]
    assert q("So the selling price is 25 euro.") and not q("Maybe it should be 25?") and not q("We're not going with titanium", "Use titanium") and q("We're not going with a touch screen", "No touch screen")
    v = lambda s: spark.range(1).select(X.volunteers(X.norm(F.lit(s)))).first()[0]
    assert v("I'll send it") and v("Let me check") and not v("I can't") and not v("let me think") and not v("I can see why")


def test_evaluation(spark):
    import pandas as pd

    assert evaluate.edit_counts("a b c d".split(), "a x c".split()) == (1, 1, 0) and evaluate.edit_counts([], ["a"]) == (0, 0, 1)
    assert {x[:2] for x in evaluate.best_mapping(pd.DataFrame([("S1", "A", 5), ("S1", "B", 6), ("S2", "B", 9)], columns=["speaker", "gold", "n"]))} == {("S1", "A"), ("S2", "B")}
    cols = "meeting_id long, start double, end double, speaker string"
    gold = spark.createDataFrame([(1, 0.0, 5.0, "A"), (1, 5.0, 10.0, "B"), (2, 0.0, 5.0, "A"), (2, 5.0, 10.0, "B")], cols)
    ours = spark.createDataFrame([(1, 0.0, 5.0, "x"), (1, 5.0, 10.0, "y"), (2, 0.0, 10.0, "x")], cols)
    got = {r["meeting_id"]: (r["error_s"], r["scored_s"]) for r in evaluate.diarization_errors(gold, ours).collect()}
    assert got == {1: (0.0, 10.0), 2: (5.0, 10.0)}


def test_word_error_rate_reads_every_line(spark, tmp_path):
    from parley.plans import catalogue

    turns = [(1, 0, "user", "a b c"), (1, 1, "assistant", "d e"), (1, 2, "user", "a x c"), (1, 3, "user", "It's f"), (1, 4, "user", "d e g"), (2, 0, "user", "only one line"), (2, 1, "user", "and another"), (3, 0, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["meeting_id"]: (r["errors"], r["words"]) for r in catalogue.queries()["word_error_rate"](spark, str(tmp_path)).collect()}

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for m in (1, 2, 3):
        own = sorted((t, x.lower()) for c, t, _, x in turns if c == m)
        gold, heard = " ".join(x for _, x in own).split(), " ".join(x for t, x in own if t >= 2).split()
        want[m] = (brute(gold, heard), len(gold))
    assert got == want


def test_fuzzy_quotes_come_from_every_line(spark, tmp_path):
    from parley.plans import catalogue

    said = ["first we should discuss the budget", "then marketing presents their findings today", "afterwards engineering explains battery problems", "finally everybody agrees about colours"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalogue.queries()["quote_fuzzy_line"](spark, str(tmp_path)).collect()
    assert sorted(r["line"] for r in got) == [0, 1, 2, 3]
