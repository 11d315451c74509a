"""What models are shown, whole-run files, failover, and scoring of a run against gold."""

import json

from parley.operators import evaluate, prompts, report
from parley.plans import engine
from parley.sources import readers, sinks
from test_record import inputs


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "meeting_id long, line int, text string, speaker string, label string")


def test_numbered_lines_mark_doubt_and_speakers(spark):
    lines = lines_of(spark, [(1, 0, " Hello. ", "S1", "Priya"), (1, 1, "Thanks!", None, None), (1, 2, None, "S2", "")])
    doubtful = spark.createDataFrame([(1, 1)], "meeting_id long, line int")
    got = [r["text"] for r in prompts.numbered_lines(lines, doubtful).orderBy("line").collect()]
    assert got == ["[0] Priya: Hello.", "[1] [DOUBTFUL] Thanks!", "[2] "]


def test_parts_carry_earlier_summaries_and_roles(spark):
    lines = lines_of(spark, [(1, i, f"word{i} " * 12, "S1", "Priya") for i in range(8)] + [(2, 0, "short", "S1", "Priya")])
    none = spark.createDataFrame([], "meeting_id long, line int")
    told = spark.createDataFrame([(1, 0, "first summary"), (1, 1, "second summary")], "meeting_id long, part int, summary string")
    roles = spark.createDataFrame([(1, "Priya", "chair"), (2, "Rahul", "")], "meeting_id long, label string, role string")
    rows = {(r["meeting_id"], r["part"]): r["message"] for r in prompts.record_inputs(lines, none, roles, told, max_tokens=50).collect()}
    assert rows[2, 0] == "[0] Priya: short"
    n = max(p for m, p in rows if m == 1) + 1
    assert n >= 3 and all(rows[1, p].startswith("PARTICIPANTS (roles as they stated them):\n- Priya: chair\n\nTRANSCRIPT:\n") for p in range(n))
    assert f"This is part 1 of {n}" in rows[1, 0] and "this is the first part" in rows[1, 0]
    assert "- Part 1: first summary\n- Part 2: second summary\n" in rows[1, 2] and "second summary" not in rows[1, 1]
    # every line is in one part, in order
    assert [i for p in range(n) for i in range(8) if f"[{i}] Priya" in rows[1, p]] == list(range(8))


def test_run_files_header_and_inputs(spark):
    run = engine.run(inputs(spark))
    files = {(r["meeting_id"], r["file"]): r["content"] for r in run.files().collect()}
    assert {f for m, f in files if m == 1} == set(sinks.RUN_FILES)
    assert {f for m, f in files if m == 2} >= {"edit_log.json", "run.json"} and (2, "minutes.md") not in files
    whole = json.loads(files[1, "run.json"])
    assert [s["stage"] for s in whole["stages"]][0] == "transcript" and len(whole["segments"]) == 5 and whole["faithfulness"]["speakers_named"] == 1
    speakers = json.loads(files[1, "speakers.json"])
    assert [s["label"] for s in speakers["speakers"]] == ["Priya", "Speaker 2"] and speakers["name_evidence"][0]["accepted"] and len(speakers["turns"]) == 3
    assert json.loads(files[1, "edit_log.json"])["edits"][0]["status"] == "applied"
    md = files[1, "minutes.md"]
    assert md.startswith("# Meeting record\n\n## Participants\n\nPriya, Speaker 2\n\n## Summary") and "- **agreed**: Keep it" in md and "- Send notes (owner: Speaker 2; deadline: unspecified; status: " in md
    header = {r["meeting_id"]: r["header"] for r in run["header"].collect()}
    assert "**Speakers:** 2 found: Priya, Speaker 2" in header[1] and "**Glossary typed:** Kubeflow" in header[1] and "**Audio:**" not in header[2]
    shown = {r["meeting_id"]: r["message"] for r in run["record_inputs"].collect()}
    assert "[1] Speaker 2: Yes, let's keep it." in shown[1] and "[4] [DOUBTFUL] Thanks for watching!" in shown[1]
    assert "DOUBTFUL" not in {r["meeting_id"]: r["message"] for r in run["naming_inputs"].collect()}[1]


def test_first_answer_of_several_tries(spark):
    calls = spark.createDataFrame([(1, 0, "a", "rate limit", None), (1, 1, "a", "timeout", None), (1, 2, "b", "ok", "yes"), (1, 3, "c", "ok", "later"), (2, 0, "a", "no answer", None), (3, 0, "a", "ok", "x"), (3, 1, "b", "timeout", None)], "k long, ord int, provider string, status string, reply string")
    rows = {r["k"]: (r["provider"], r["reply"], r["failed"], r["problem"]) for r in readers.answered(calls, ["k"]).collect()}
    assert rows == {1: ("b", "yes", 2, "timeout"), 2: (None, None, 1, "no answer"), 3: ("a", "x", 0, None)}
    usage = calls.selectExpr("k AS meeting_id", "ord", "provider", "status", "'m' AS model", "1 AS input_tokens", "2 AS output_tokens", "0.26D AS seconds")
    assert sorted((r["meeting_id"], r["ord"], r["seconds"]) for r in report.usage_rows(usage).collect()) == [(1, 2, 0.3), (1, 3, 0.3), (3, 0, 0.3)]


def test_scoring_a_run(spark):
    word = lambda a, t: (float(a), float(a) + 1, t, 0.9)
    lines = spark.createDataFrame([(1, 0, "I am Priya", "S1", [word(0, "I"), word(1, "am"), word(2, "Priya")]), (1, 1, "hello there", "S2", [word(3, "hello"), word(4, "there")])], "meeting_id long, line int, text string, speaker string, words array<struct<start:double,end:double,text:string,probability:double>>")
    gold = spark.createDataFrame([(1, float(i), i + 1.0, "A" if i < 3 else "B", w) for i, w in enumerate("i am priya hello where".split())], "meeting_id long, start double, end double, speaker string, word string")
    gold_turns = spark.createDataFrame([(1, 0.0, 3.0, "A"), (1, 3.0, 5.0, "B")], "meeting_id long, start double, end double, speaker string")
    ours = spark.createDataFrame([(1, 0.0, 3.0, "S1"), (1, 3.0, 5.0, "S2")], "meeting_id long, start double, end double, speaker string")
    speakers = spark.createDataFrame([(1, "S1", "Priya"), (1, "S2", "Rahul")], "meeting_id long, speaker string, name string")
    evidence = spark.createDataFrame([(1, 0, "S1", "Priya", "self", 0, True), (1, 1, "S2", "Rahul", "addressed", 0, True)], "meeting_id long, ord int, speaker string, name string, kind string, line int, accepted boolean")
    (r,) = evaluate.score_runs(gold, gold_turns, lines, ours, speakers, evidence).collect()
    assert (r["wer"], r["der"], r["der_strict"], r["right_speaker"]) == (0.2, 0.0, 0.0, 1.0)
    assert (r["speakers_found"], r["speakers_true"], r["named"], r["named_correct"]) == (2, 2, 2, 1)
