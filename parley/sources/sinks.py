"""Sinks: transcripts, records and reports, as columns first and as partitioned files or deliverable folders then."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import wordlists as W


def transcript_text(lines: DataFrame, timed: bool = True) -> DataFrame:
    """(meeting_id, text): '[mm:ss.ss] Label: text' lines, or the plain text where no speaker is known."""
    rows = lines.withColumn("_l", F.concat(F.lit("["), X.clock(F.col("start")), F.lit("] "), F.coalesce("label", F.lit(W.NO_SPEAKER)), F.lit(": "), F.col("text")))
    both = rows.groupBy("meeting_id").agg(X.ordered_join("line", "_l", "\n").alias("_timed"), X.ordered_join("line", "text").alias("_plain"), F.max(F.col("label").isNotNull()).alias("_known"))
    return both.select("meeting_id", F.when(F.col("_known") & F.lit(timed), F.col("_timed")).otherwise(F.col("_plain")).alias("text"))


def transcript_json(lines: DataFrame) -> DataFrame:
    """(meeting_id, json, text): rows of start, end, speaker and text, and the text with labels where they are known."""
    row = F.struct(F.col("line"), F.bround("start", 2).alias("start"), F.bround("end", 2).alias("end"), F.col("label").alias("speaker"), F.col("text"))
    shown = F.concat(F.lit("["), X.clock(F.col("start")), F.lit("] "), F.coalesce(F.concat("label", F.lit(": ")), F.lit("")), F.col("text"))
    g = lines.withColumn("_l", shown).groupBy("meeting_id").agg(F.array_sort(F.collect_list(row)).alias("r"), X.ordered_join("line", "_l", "\n").alias("text"))
    return g.select("meeting_id", F.to_json(F.transform("r", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["speaker"].alias("speaker"), x["text"].alias("text"))), {"ignoreNullFields": "false"}).alias("json"), "text")


def shown_evidence(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: F.struct(e["role"].alias("role"), e["quote"].alias("quote"), e["speaker"].alias("speaker"), X.clock(e["start"]).alias("time"), e["line"].alias("line")))


def _gather(rows: DataFrame, name: str, **fields: Column) -> DataFrame:
    item = F.struct(F.col("item"), F.struct(*(c.alias(n) for n, c in fields.items()), shown_evidence(F.col("evidence")).alias("evidence")).alias("x"))
    return rows.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias(name))


def _reached(status: Column) -> Column:
    return F.coalesce(*(F.when(status == k, v) for k, v in W.REACHED.items()))


def decisions_json(record: dict[str, DataFrame]) -> DataFrame:
    """(meeting_id, decisions): those reached, an uncontested one as decided without objection."""
    d = record["decisions"].where(F.col("status").isin(*W.REACHED))
    return _gather(d, "decisions", decision=F.col("text"), status=_reached(F.col("status")))


def actions_json(record: dict[str, DataFrame]) -> DataFrame:
    return _gather(record["action_items"], "actions", task=F.col("task"), owner=F.col("owner"), deadline=F.col("deadline"), status=F.col("status"))


def minutes_json(record: dict[str, DataFrame], drafts: DataFrame, participants: DataFrame) -> DataFrame:
    """(meeting_id, and the record's parts as columns). participants: meeting_id, participants array<struct<name,role>>."""
    open_ = record["decisions"].where(~F.col("status").isin(*W.REACHED))
    out = drafts.select("meeting_id", F.col("draft.summary").alias("summary"), F.col("draft.minutes").alias("discussion_points"))
    for part in (
        participants,
        _gather(record["given"], "given", fact=F.col("fact")),
        _gather(record["assessments"], "assessments", topic=F.col("topic"), verdict=F.col("verdict")),
        _gather(open_, "proposals_not_decided", proposal=F.col("text"), status=F.col("status")),
        _gather(record["open_questions"], "open_questions", question=F.col("question")),
    ):
        out = out.join(part, "meeting_id", "left")
    return out


def participants(lines: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """(meeting_id, participants): labels in order of appearance with their roles."""
    first = lines.where("label is not null").groupBy("meeting_id", "label").agg(F.min("line").alias("l"))
    first = first.join(roles.select("meeting_id", "label", "role"), ["meeting_id", "label"], "left") if roles is not None else first.withColumn("role", F.lit(None).cast("string"))
    return first.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l", F.col("label").alias("name"), F.nullif(F.col("role"), F.lit("")).alias("role")))), lambda p: F.struct(p["name"].alias("name"), p["role"].alias("role"))).alias("participants"))


def _bullets(title: str, items: Column, none: str = "- (none)") -> Column:
    body = F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.array_join(items, "\n")).otherwise(none)
    return F.concat(F.lit(f"## {title}\n\n"), body)


def _evidence_md(evidence: Column) -> Column:
    return F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("\n  - ["), F.coalesce(e["time"], F.concat(F.lit("line "), e["line"])), F.lit("] "), F.coalesce(F.concat(e["speaker"], F.lit(", ")), F.lit("")), e["role"], F.lit(': "'), e["quote"], F.lit('"'))), "")


def decisions_md(rows: DataFrame) -> DataFrame:
    items = F.transform("decisions", lambda d: F.concat(F.lit("- **"), d["status"], F.lit("**: "), d["decision"], _evidence_md(d["evidence"])))
    return rows.select("meeting_id", F.concat(F.lit("# Key decisions\n\n"), F.when(F.size("decisions") > 0, F.array_join(items, "\n")).otherwise("No decisions were reached in this meeting.")).alias("md"))


def actions_md(rows: DataFrame) -> DataFrame:
    items = F.transform("actions", lambda a: F.concat(F.lit("- "), a["task"], F.lit("\n  - owner: "), a["owner"], F.lit("\n  - deadline: "), a["deadline"], F.lit("\n  - status: "), a["status"], _evidence_md(a["evidence"])))
    return rows.select("meeting_id", F.concat(F.lit("# Action items\n\n"), F.when(F.size("actions") > 0, F.array_join(items, "\n")).otherwise("No action items were assigned in this meeting.")).alias("md"))


def minutes_md(rows: DataFrame) -> DataFrame:
    who = F.transform("participants", lambda p: F.concat(F.lit("- "), p["name"], F.coalesce(F.concat(F.lit(" ("), p["role"], F.lit(")")), F.lit(""))))
    parts = F.array_compact(F.array(
        F.lit("# Meeting minutes"),
        F.when(F.size("participants") > 0, F.concat(F.lit("## Participants\n\n"), F.array_join(who, "\n"))),
        F.concat(F.lit("## Summary\n\n"), F.coalesce("summary", F.lit(""))),
        _bullets("Main discussion points", F.transform("discussion_points", lambda x: F.concat(F.lit("- "), x))),
        _bullets("Given (brief, budget, targets: not decided in this meeting)", F.transform("given", lambda g: F.concat(F.lit("- "), g["fact"], _evidence_md(g["evidence"])))),
        _bullets("Assessments (ratings and evaluations: not decisions)", F.transform("assessments", lambda a: F.concat(F.lit("- "), a["topic"], F.lit(": "), a["verdict"], _evidence_md(a["evidence"])))),
        _bullets("Proposals not decided", F.transform("proposals_not_decided", lambda d: F.concat(F.lit("- **"), d["status"], F.lit("**: "), d["proposal"], _evidence_md(d["evidence"])))),
        _bullets("Open questions", F.transform("open_questions", lambda q: F.concat(F.lit("- "), q["question"], _evidence_md(q["evidence"])))),
    ))
    return rows.select("meeting_id", F.array_join(parts, "\n\n").alias("md"))


def record_md(record: dict[str, DataFrame], drafts: DataFrame, people: DataFrame) -> DataFrame:
    """(meeting_id, md): the whole record of each meeting as one document. people: as ``participants`` gives them."""
    shown = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("\n  - ["), F.coalesce(X.clock(e["start"]), F.concat(F.lit("line "), e["line"])), F.lit("] "), F.coalesce(F.concat(F.nullif(e["speaker"], F.lit("")), F.lit(", ")), F.lit("")), e["role"], F.lit(': _"'), e["quote"], F.lit('"_'))), "")

    def listed(rows: DataFrame, name: str, *parts) -> DataFrame:
        item = F.concat(F.lit("- "), *(F.lit(p) if isinstance(p, str) else p for p in parts), shown)
        return rows.select("meeting_id", "item", item.alias("x")).groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "x"))), lambda i: i["x"]), "\n").alias(name))

    c = F.col
    status = F.when(c("status") == "uncontested", W.REACHED["uncontested"]).otherwise(c("status"))
    out = drafts.select("meeting_id", c("draft.summary").alias("summary"), c("draft.minutes").alias("points")).join(people, "meeting_id", "left")
    for part in (
        listed(record["given"], "given", c("fact")),
        listed(record["assessments"], "assessments", c("topic"), ": ", c("verdict")),
        listed(record["decisions"], "decisions", "**", status, "**: ", c("text")),
        listed(record["action_items"], "actions", c("task"), " (owner: ", c("owner"), "; deadline: ", c("deadline"), "; status: ", c("status"), ")"),
        listed(record["open_questions"], "questions", c("question")),
    ):
        out = out.join(part, "meeting_id", "left")
    who = F.array_join(F.transform("participants", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(" ("), p["role"], F.lit(")")), F.lit("")))), ", ")
    points = F.array_join(F.transform("points", lambda x: F.concat(F.lit("- "), x)), "\n")
    section = lambda title, body: F.concat(F.lit(f"## {title}\n\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit("- (none)")))
    parts = F.array_compact(F.array(
        F.lit("# Meeting record"),
        F.when(F.size("participants") > 0, F.concat(F.lit("## Participants\n\n"), who)),
        F.concat(F.lit("## Summary\n\n"), F.coalesce("summary", F.lit(""))),
        section("Minutes", points),
        section("Given (brief, budget, targets: not decided in this meeting)", c("given")),
        section("Assessments (ratings and evaluations: not decisions)", c("assessments")),
        section("Decisions", c("decisions")),
        section("Action items", c("actions")),
        section("Open questions", c("questions")),
    ))
    return out.select("meeting_id", F.concat(F.array_join(parts, "\n\n"), F.lit("\n")).alias("md"))


FILES = ("raw_transcript.txt", "raw_transcript.json", "refined_transcript.txt", "refined_transcript.json", "meeting_minutes.md", "meeting_minutes.json", "key_decisions.md", "key_decisions.json", "action_items.md", "action_items.json")


def deliverables(raw: DataFrame, refined: DataFrame, record: dict[str, DataFrame] | None, drafts: DataFrame | None, roles: DataFrame | None, status: DataFrame) -> DataFrame:
    """(meeting_id, file, content): the ten deliverables of each meeting, or STATUS.txt beside what there is."""
    files = None

    def add(rows: DataFrame, name: str, content: Column) -> None:
        nonlocal files
        one = rows.select("meeting_id", F.lit(name).alias("file"), content.alias("content")).where("content is not null")
        files = one if files is None else files.unionByName(one)

    for name, rows in (("raw", transcript_json(raw)), ("refined", transcript_json(refined))):
        add(rows, f"{name}_transcript.txt", F.col("text"))
        add(rows, f"{name}_transcript.json", F.col("json"))
    keep = {"ignoreNullFields": "false"}
    if record is not None:
        minutes = minutes_json(record, drafts, participants(refined, roles))
        ids = drafts.select("meeting_id")
        decided, acted = ids.join(decisions_json(record), "meeting_id", "left"), ids.join(actions_json(record), "meeting_id", "left")
        add(minutes_md(minutes), "meeting_minutes.md", F.col("md"))
        add(minutes, "meeting_minutes.json", F.to_json(F.struct(*(F.col(c) for c in minutes.columns if c != "meeting_id")), keep))
        for rows, column, name, md in ((decided, "decisions", "key_decisions", decisions_md), (acted, "actions", "action_items", actions_md)):
            rows = rows.withColumn(column, F.coalesce(column, F.from_json(F.lit("[]"), rows.schema[column].dataType)))
            add(md(rows), f"{name}.md", F.col("md"))
            add(rows, f"{name}.json", F.to_json(column, keep))
    lost = status.where("status in ('failed', 'skipped')").groupBy("meeting_id").agg(F.lit(1))
    shown = status.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "stage", "status", "message"))), lambda s: F.concat(F.lit("- "), s["stage"], F.lit(": "), s["status"], F.when(s["message"] != "", F.concat(F.lit(" ("), s["message"], F.lit(")"))).otherwise(""))), "\n").alias("s"))
    add(shown.join(lost, "meeting_id", "left_semi"), "STATUS.txt", F.concat(F.lit("Some deliverables could not be produced for this recording:\n\nStage status:\n\n"), F.col("s")))
    return files


def write_files(files: DataFrame, path: str) -> None:
    """Partitioned by meeting, overwritten as a whole: nothing stale stays."""
    files.write.mode("overwrite").partitionBy("meeting_id").json(path)


def zipped(files: DataFrame) -> DataFrame:
    """(meeting_id, archive): a zip of each meeting's files, built on the executors."""
    kind = files.schema["meeting_id"].dataType.simpleString()

    def pack(pdf):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in pdf.sort_values("file").itertuples():
                z.writestr(f"deliverables/{r.file}", r.content.rstrip() + "\n")
        return pd.DataFrame({"meeting_id": [pdf["meeting_id"].iloc[0]], "archive": [out.getvalue()]})

    return files.groupBy("meeting_id").applyInPandas(pack, f"meeting_id {kind}, archive binary")


def saved_files(files: DataFrame) -> DataFrame:
    """Files in their fixed order."""
    place = F.array_position(F.array(*map(F.lit, FILES)), F.col("file"))
    return files.select("meeting_id", "file", F.when(place == 0, 99).otherwise(place).cast("int").alias("ord"))


RUN_FILES = ("transcript_raw.txt", "transcript_refined.txt", "speakers.json", "edit_log.json", "minutes.md", "minutes.json", "run.json")


def _listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """(meeting_id, name): the rows of each meeting as an array of structs, in order."""
    fields = [c for c in rows.columns if c != "meeting_id"]
    item = F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), F.struct(*fields).alias("x"))
    return rows.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias(name))


def _joined(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """Arrays of several tables beside each other; a meeting without rows of one has an empty array."""
    for p in parts:
        name = p.columns[-1]
        base = base.join(p, "meeting_id", "left").withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), p.schema[name].dataType)))
    return base


def run_files(meetings: DataFrame, tables: dict[str, DataFrame], record: dict[str, DataFrame] | None = None) -> DataFrame:
    """(meeting_id, file, content): a meeting's run for inspection, as ``RUN_FILES``. tables are those of a run; a file whose
    tables are missing is left out."""
    keep = {"ignoreNullFields": "false"}
    ids = meetings.select("meeting_id").distinct()
    t = tables
    files = []

    def add(rows: DataFrame, name: str, content: Column) -> None:
        files.append(rows.select("meeting_id", F.lit(name).alias("file"), content.alias("content")).where("content is not null"))

    add(transcript_text(t["lines"].join(t["labels"], ["meeting_id", "line"], "left")), RUN_FILES[0], F.col("text"))
    add(transcript_text(t["labelled"]), RUN_FILES[1], F.col("text"))
    named = t["speakers"].withColumn("label", X.label(F.col("speaker"), F.col("name")))
    speakers = _listed(named, "speakers", "speaker")
    if "turns" in t:
        found = _joined(speakers, _listed(t["evidence"], "name_evidence", "ord"), _listed(t["turns"], "turns", "turn_idx"))
        add(found, RUN_FILES[2], F.to_json(F.struct("speakers", "name_evidence", "turns"), keep))
    log = _joined(ids, _listed(t["edits"], "edits", "line", "ord"), _listed(t["possible_errors"], "possible_errors", "ord"), _listed(t["hints"], "hints", "line", "first"))
    add(log, RUN_FILES[3], F.to_json(F.struct("edits", "possible_errors", "hints"), keep))
    if record is not None:
        people = participants(t["labelled"], t.get("roles"))
        add(record_md(record, t["drafts"], people), RUN_FILES[4], F.col("md"))
        minutes = minutes_json(record, t["drafts"], people)
        add(minutes, RUN_FILES[5], F.to_json(F.struct(*(c for c in minutes.columns if c != "meeting_id")), keep))
    flags = t["flags"].withColumn("reasons", F.array_join("reasons", ", "))
    details = _joined(ids, _listed(t["status"], "stages", "ord"), _listed(t["lines"].drop("words"), "segments", "line"), _listed(flags, "flags", "line"), _listed(t["glossary"], "glossary", "pos"), speakers)
    if record is not None:
        details = _joined(details, _listed(record["notes"], "minutes_dropped", "rank", "item", "ord")).join(t["faithfulness"].select("meeting_id", F.struct(*(F.col(f"`{c}`") for c in t["faithfulness"].columns if c != "meeting_id")).alias("faithfulness")), "meeting_id", "left")
    add(details, RUN_FILES[6], F.to_json(F.struct(*(c for c in details.columns if c != "meeting_id")), keep))
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out
