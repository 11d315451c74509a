"""Stated cases of the record, and a whole run."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from parley.operators import flags, record
from parley.plans import engine
from parley.session import stored
from parley.sources import readers, schemas, sinks

LINES = ["Hello, let us begin.", "I propose we use rubber for the case.", "Yes, let's use rubber.", "No, rubber is too expensive.", "Sarah will send the report by Friday.", "I can do that.", "What about the battery?", "We are done then.", "Who will test the prototype?", "Ghost line about titanium."]


def table(spark, texts=LINES, speakers=None, doubtful=(9,)):
    rows = [(1, i, 10.0 * i, t, speakers[i] if speakers else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "meeting_id long, line int, start double, text string, label string"), spark.createDataFrame([(1, i) for i in doubtful], "meeting_id long, line int")


def decision(text="Use rubber", proposal="I propose we use rubber", agree=(), reject=(), settled=""):
    return dict(text=text, proposal_quote=proposal, agreement_quotes=list(agree), rejection_quotes=list(reject), settled_quote=settled)


def action(task="Send the report", task_quote="Sarah will send the report by Friday", owner="unspecified", owner_quote="", deadline="unspecified", deadline_quote="", agreement_quote=""):
    return dict(task=task, task_quote=task_quote, owner=owner, owner_quote=owner_quote, deadline=deadline, deadline_quote=deadline_quote, agreement_quote=agreement_quote)


def draft(**parts):
    return dict(dict(given=[], summary="S", minutes=[], assessments=[], decisions=[], action_items=[], open_questions=[]), **parts)


def verified(spark, d, texts=LINES, speakers=None, doubtful=(9,), roles=None):
    lines, dd = table(spark, texts, speakers, doubtful)
    drafts = record.parse_drafts(spark.createDataFrame([(1, "reply: " + json.dumps(d))], schemas.REPLIES))
    r = spark.createDataFrame([(1, k, v) for k, v in (roles or {}).items()], "meeting_id long, label string, role string")
    return record.verify(drafts, lines, dd, r, stored)


def test_decisions(spark):
    agree = "Yes, let's use rubber"
    out = verified(spark, draft(decisions=[
        decision(agree=[agree]), decision(agree=["Mm-hmm."]), decision(agree=[agree], reject=["No, rubber is too expensive"]), decision(proposal="We should use gold plates everywhere"),
        decision(agree=["Everyone voted yes to it"]), decision(text="Titanium", proposal="Ghost line about titanium"),
    ]))
    rows = {r["item"]: r for r in out["decisions"].collect()}
    assert {k: r["status"] for k, r in rows.items()} == {0: "agreed", 1: "open", 2: "rejected", 4: "open"}
    assert [(e["role"], e["line"], e["start"]) for e in rows[0]["evidence"]] == [("proposal", 1, 10.0), ("agreement", 2, 20.0)]
    notes = [r["note"] for r in out["notes"].orderBy("rank", "item", "ord").collect()]
    assert any("only a backchannel" in n for n in notes) and any(n.startswith("Decision dropped") for n in notes) and any("agreement quote not found" in n for n in notes)
    c = out["checks"].first()
    assert (c["decisions_proposed"], c["decisions_kept"], c["decisions_agreed"], c["quotes_ignored"]) == (6, 4, 1, 2)
    assert c["evidence_support_rate"] == 0.667


def test_actions(spark):
    out = verified(spark, draft(action_items=[
        action(owner="Sarah", owner_quote="Sarah will send the report", deadline="by Friday", deadline_quote="the report by Friday", agreement_quote="I can do that."),
        action(owner="John", owner_quote="Sarah will send the report"), action(owner="Sarah", owner_quote="Sarah will send the report"), action(task_quote="completely invented words nobody spoke"),
    ]))
    rows = {r["item"]: r for r in out["action_items"].collect()}
    assert (rows[0]["owner"], rows[0]["deadline"], rows[0]["status"]) == ("Sarah", "by Friday", "agreed")
    assert (rows[1]["owner"], rows[1]["status"]) == ("unspecified", "unassigned") and rows[2]["status"] == "proposed" and 3 not in rows
    c = out["checks"].first()
    assert (c["owners_removed"], c["actions_proposed"], c["actions_kept"]) == (1, 4, 3)


def test_questions_given_assessments(spark):
    out = verified(spark, draft(
        open_questions=[dict(question="Who tests?", quote="Who will test the prototype?"), dict(question="Fake", quote="never asked in any way here")],
        given=[dict(fact="Start", quote="let us begin"), dict(fact="No", quote="budget of a million dollars")], assessments=[dict(topic="Rubber", verdict="dear", quote="rubber is too expensive")],
    ))
    q = out["open_questions"].collect()
    assert [(e["line"], e["start"]) for e in q[0]["evidence"]] == [(8, 80.0)] and len(q) == 1
    c = out["checks"].first()
    assert (c["given_proposed"], c["given_kept"], c["assessments_kept"]) == (2, 1, 1)


TALK = ["I propose we keep the wheel.", "Yes, let's keep the wheel.", "I'll send the summary by Friday.", "Okay, fine.", "Thanks Priya.", "Good.", "Bye."]
WHO = ["Priya", "Rahul", "Rahul", "Priya", "Rahul", "Priya", "Rahul"]


def test_speakers(spark):
    keep = decision("Keep the wheel", "I propose we keep the wheel", ["Yes, let's keep the wheel"])
    send = action("Send the summary", "I'll send the summary by Friday", agreement_quote="I'll send the summary by Friday")
    out = verified(spark, draft(decisions=[keep, decision("Self", "I propose we keep the wheel", ["I propose we keep the wheel"])], action_items=[
        send, action("Send", "I'll send the summary by Friday", owner="Priya", owner_quote="I'll send the summary"), action("Send it", "I'll send the summary by Friday", owner="Rahul", owner_quote="Rahul: I'll send the summary by Friday"),
    ]), TALK, WHO, ())
    d = {r["item"]: r["status"] for r in out["decisions"].collect()}
    assert d == {0: "agreed", 1: "open"}
    a = {r["item"]: r for r in out["action_items"].collect()}
    assert (a[0]["owner"], a[0]["status"]) == ("Rahul", "agreed") and a[1]["owner"] == "Rahul" and a[2]["owner"] == "Rahul"
    assert {e["speaker"] for e in a[0]["evidence"]} == {"Rahul"}


CHAIR = ["So the selling price will be 25 euro.", "Maybe we should use a kinetic battery.", "The industrial designer will work on the case.", "The marketing expert will watch trends.", "We're not going with a touch screen.", "Right.", "I don't like the price of 25 euro."]


def test_settled_and_roles(spark):
    roles = {"Nick": "industrial designer", "Robin": "marketing manager"}
    out = verified(spark, draft(decisions=[
        decision("Price 25", "", settled="So the selling price will be 25 euro"), decision("Kinetic", "Maybe we should use a kinetic battery", settled="Maybe we should use a kinetic battery"),
        decision("Price", "So the selling price will be 25 euro", reject=["I don't like the price of 25 euro"], settled="So the selling price will be 25 euro"), decision("No touch screen", "", settled="We're not going with a touch screen"),
    ], action_items=[action("Case", "The industrial designer will work on the case"), action("Trends", "The marketing expert will watch trends", owner="marketing manager", owner_quote="The marketing expert will watch trends")]), CHAIR, ["Chair"] * 7, (), roles)
    rows = {r["item"]: r for r in out["decisions"].collect()}
    assert {k: r["status"] for k, r in rows.items()} == {0: "uncontested", 1: "open", 2: "rejected", 3: "uncontested"}
    assert len(rows[0]["evidence"]) == 1
    assert {r["item"]: r["owner"] for r in out["action_items"].collect()} == {0: "Nick", 1: "Robin"}
    assert out["checks"].first()["owners_from_role"] == 2


def test_merge_and_relabel(spark):
    a = draft(summary="One.", minutes=["Talked about price"], decisions=[decision("Use rubber for the case", "I propose we use rubber")], action_items=[action("Send the report")])
    b = draft(summary="Two.", minutes=["Talked about price", "Other"], decisions=[decision("Use rubber for the case", "other words", ["Yes, let's use rubber"])], action_items=[action("Send the report", owner="Sarah", owner_quote="Sarah will send the report")])
    parts = record.parse_drafts(spark.createDataFrame([(1, 0, json.dumps(a)), (1, 1, json.dumps(b))], "meeting_id long, part int, reply string"))
    m = record.merge_drafts(parts)
    d = m.first()["draft"]
    assert d["summary"] == "One. Two." and len(d["decisions"]) == 1 and d["decisions"][0]["agreement_quotes"] == ["Yes, let's use rubber"] and d["action_items"][0]["owner"] == "Sarah" and len(d["minutes"]) == 2
    changes = spark.createDataFrame([(1, "Sarah", "Sally")], "meeting_id long, old string, new string")
    r = record.relabel_drafts(m, changes).first()["draft"]
    assert r["action_items"][0]["owner"] == "Sally" and r["action_items"][0]["owner_quote"] == "Sarah will send the report"


def test_bad_reply_is_no_draft(spark):
    r = record.parse_drafts(spark.createDataFrame([(1, "no json"), (2, "{bad"), (3, json.dumps(draft()))], schemas.REPLIES))
    assert [x["parsed"] for x in r.orderBy("meeting_id").collect()] == [False, False, True]


def inputs(spark, edits=None):
    text = ["I'm Priya, I propose we keep it. Yes, let's keep it.", "I'll send the notes by Friday.", "We use cube flow here.", "Thanks for watching!"]
    end = [(0.0, 9.0), (9.0, 11.0), (11.0, 13.0), (595.0, 597.0)]
    rows = []
    for i, (t, (a, b)) in enumerate(zip(text, end)):
        w = t.split()
        step = (b - a) / len(w)
        rows.append((1, i, a, b, t, 0.05, -0.3, 1.4, [(a + k * step, a + (k + 1) * step, x, 0.9) for k, x in enumerate(w)]))
    lines = spark.createDataFrame(rows, schemas.LINES)
    d = draft(decisions=[decision("Keep it", "I propose we keep it", ["Yes, let's keep it"])], action_items=[action("Send notes", "I'll send the notes by Friday", agreement_quote="I'll send the notes by Friday")])
    return engine.Inputs(
        meetings=spark.createDataFrame([(1, "en", 600.0, True, "Kubeflow", ["Priya", "Rahul"]), (2, "en", 60.0, False, "", [])], schemas.MEETINGS), lines=lines,
        raw_turns=spark.createDataFrame([(1, 0, 0.0, 5.7, "A"), (1, 1, 5.7, 11.0, "B"), (1, 2, 11.0, 13.0, "A")], schemas.RAW_TURNS),
        line_replies=spark.createDataFrame([(1, '{"lines":{"3":"We use Kubeflow here."}}')], schemas.REPLIES),
        name_claims=spark.createDataFrame([(1, 0, "S1", "Priya", "", "self", "0", "I'm Priya")], schemas.CLAIMS),
        draft_replies=spark.createDataFrame([(1, 0, json.dumps(d)), (2, 0, "sorry")], "meeting_id long, part int, reply string"),
        speaker_edits=spark.createDataFrame(edits, schemas.EDITS) if edits else None,
    )


def test_whole_run(spark):
    run = engine.run(inputs(spark))
    lines = run["labelled"].orderBy("line").collect()
    assert [r["label"] for r in lines] == ["Priya", "Speaker 2", "Speaker 2", "Priya", None]
    assert [r["text"] for r in lines][3] == "We use Kubeflow here."
    assert [r["line"] for r in run["flags"].where("flagged").collect()] == [4]
    assert run.record["decisions"].first()["status"] == "agreed"
    assert run.record["action_items"].first()["owner"] == "Speaker 2"
    f = run["faithfulness"].where("meeting_id = 1").first()
    assert (f["speakers_found"], f["speakers_named"], f["edits_applied"], f["name_claims_accepted"]) == (2, 1, 1, 1)
    status = {(r["meeting_id"], r["stage"]): r["status"] for r in run["status"].collect()}
    assert status[1, "record"] == "done" and status[2, "transcript"] == "failed" and status[2, "record"] == "skipped"
    files = run.deliverables()
    names = {r["file"]: r["content"] for r in files.where("meeting_id = 1").collect()}
    assert set(sinks.FILES) <= set(names)
    assert "[00:05.73] Speaker 2: Yes, let's keep it." in names["refined_transcript.txt"]
    assert json.loads(names["key_decisions.json"])[0]["status"] == "agreed" and "Keep it" in names["key_decisions.md"]
    archive = sinks.zipped(files.where("meeting_id = 1")).first()["archive"]
    assert set(sinks.FILES) <= {n.split("/")[1] for n in zipfile.ZipFile(io.BytesIO(archive)).namelist()}
    assert "STATUS.txt" in {r["file"] for r in files.where("meeting_id = 2").collect()}


def test_merging_two_speakers_turns_an_agreement_open(spark):
    run = engine.run(inputs(spark, [(1, "S2", "Priya", None)]))
    assert run.record["decisions"].first()["status"] == "open"
    assert run.record["action_items"].first()["owner"] == "Priya"


def test_sources(spark, tmp_path):
    (tmp_path / "pack.txt").write_text("# terms\nKubeflow\n\n  ONNX \n")
    assert [r["text"] for r in readers.glossary_pack(spark, str(tmp_path / "pack.txt")).orderBy("ord").collect()] == ["Kubeflow", "ONNX"]
    with pytest.raises(Exception):
        readers.glossary_pack(spark, str(tmp_path / "none.txt")).collect()
    (tmp_path / "p.csv").write_text("prediction,n\nThank you!,3\nthank  you,1\n")
    assert [r[0] for r in readers.phrase_file(spark, str(tmp_path / "p.csv")).collect()] == ["thank you"]
    (tmp_path / "M1.A.words.xml").write_text('<words><w starttime="1.0" endtime="1.5">hi</w><w starttime="2" endtime="2" punc="true">.</w><w>untimed</w></words>')
    assert [(r["meeting"], r["speaker"], r["word"]) for r in readers.gold_words(spark, str(tmp_path / "M1.A.words.xml")).collect()] == [("M1", "A", "hi")]
    r = spark.createDataFrame([("a {\"names\":[]} b",), ("none",), ("{\"x\":1}",), ("{oops}",)], "reply string")
    assert [x["problem"] for x in readers.json_replies(r, "struct<names:array<string>>", "names").collect()] == [None, "no JSON in the reply", 'the reply is missing "names"', "bad JSON in the reply"]


def test_stream_of_lines(spark, tmp_path):
    from parley.streaming import incremental

    src, store, out, ck = (str(tmp_path / n) for n in ("src", "store", "out", "ck"))
    schema = schemas.LINES + ", speaker string"
    first = spark.createDataFrame([(1, 0, 0.0, 1.0, "Thank you.", 0.05, -0.3, 1.4, [], "S1"), (2, 0, 0.0, 1.0, "Hello there.", 0.05, -0.3, 1.4, [], "S1")], schema)
    first.write.parquet(f"{src}/a", mode="overwrite")
    phantoms = flags.phantom_phrases(None, spark)
    incremental.flag_stream(incremental.line_stream(spark, f"{src}/*"), store, out, phantoms, ck).awaitTermination(120)
    spark.createDataFrame([(1, 1, 1.0, 9.0, "Thank you.", 0.05, -0.3, 1.4, [], "S1")], schema).write.parquet(f"{src}/b")
    incremental.flag_stream(incremental.line_stream(spark, f"{src}/*"), store, out, phantoms, ck).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.where("batch = 0").count() == 2
    assert {(r["meeting_id"], r["line"], r["score"]) for r in got.where("batch = 1").collect()} == {(1, 0, 3), (1, 1, 3)}
