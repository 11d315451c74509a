"""Counts and views over the results: faithfulness, tables for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import wordlists as W

# ---- fixed values: how a name was found, and labels of the counts
FOUND_BY = {"self-introduction": "said their own name", "addressed": "addressed by name", "edited": "edited by you"}
COUNT_LABELS = {
    "decisions_proposed": "Decisions proposed", "decisions_kept": "Decisions with a verified quote", "decisions_agreed": "Decisions agreed", "decisions_uncontested": "Decisions not objected to",
    "actions_proposed": "Action items proposed", "actions_kept": "Action items with a verified quote", "actions_agreed": "Action items agreed", "open_questions_proposed": "Open questions proposed",
    "open_questions_kept": "Open questions with a verified quote", "owners_removed": "Owners removed", "deadlines_removed": "Deadlines removed", "quotes_ignored": "Quotes ignored",
    "evidence_support_rate": "Evidence support rate", "edits_applied": "Refinement edits applied",
}


def faithfulness(checks: DataFrame, edits: DataFrame, speakers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a meeting: the record's counts, edits applied and blocked by reason, speakers and claims."""
    e = edits.groupBy("meeting_id").agg(F.count_if(F.col("status") == "applied").alias("edits_applied"), *(F.count_if(F.col("reason") == r).alias(f"edits_blocked: {r}") for r in W.GUARD_REASONS))
    s = speakers.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("speakers_found"), F.count_if(F.col("name") != "").alias("speakers_named"), F.count_if(F.col("role") != "").alias("speakers_with_role"))
    c = evidence.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("name_claims_proposed"), F.count_if("accepted").alias("name_claims_accepted"))
    out = checks
    for part in (e, s, c):
        out = out.join(part, "meeting_id", "left")
    return out.na.fill(0, [c for c in out.columns if c not in ("meeting_id", "evidence_support_rate")])


def faithfulness_rows(report: DataFrame) -> DataFrame:
    """(meeting_id, key, label, value) for display: the rate as a percentage."""
    keys = [c for c in report.columns if c != "meeting_id"]
    shown = [F.struct(F.lit(k).alias("key"), F.lit(COUNT_LABELS.get(k, k.replace("edits_blocked: ", "Refinement edits blocked: ").replace("_", " ").capitalize() if not k.startswith("edits_blocked") else f"Refinement edits blocked: {k[15:]}")).alias("label"), (F.when(F.col(f"`{k}`").isNull(), "none proposed").otherwise(F.format_string("%.1f%%", F.col(f"`{k}`") * 100)) if k == "evidence_support_rate" else F.col(f"`{k}`").cast("string")).alias("value")) for k in keys]
    return report.select("meeting_id", F.explode(F.array(*shown)).alias("x")).select("meeting_id", "x.*")


def segment_rows(lines: DataFrame, flags: DataFrame) -> DataFrame:
    """Lines with their flags as shown; a line without flags counts 0."""
    f = flags.select("meeting_id", "line", "score", "flagged", F.array_join("reasons", ", ").alias("reasons"))
    return lines.join(f, ["meeting_id", "line"], "left").select("meeting_id", "line", X.clock(F.col("start")).alias("start"), X.clock(F.col("end")).alias("end"), "label", "text", F.bround("no_speech_prob", 3).alias("no_speech_prob"), F.bround("avg_logprob", 3).alias("avg_logprob"), F.bround("compression_ratio", 2).alias("compression_ratio"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def speaker_rows(speakers: DataFrame, summary: DataFrame) -> DataFrame:
    how = F.coalesce(*(F.when(F.col("source") == k, v) for k, v in FOUND_BY.items()), F.lit("not named"))
    return speakers.join(summary, ["meeting_id", "speaker"], "left").select("meeting_id", "speaker", X.label(F.col("speaker"), F.col("name")).alias("label"), "role", how.alias("found_by"), "confidence", "talk_s", "lines", "note")


def claim_rows(evidence: DataFrame) -> DataFrame:
    name = F.when(F.col("role") != "", F.concat("name", F.lit(" → "), "role")).otherwise(F.col("name"))
    return evidence.select("meeting_id", "ord", "speaker", name.alias("name"), "kind", "line", "quote", "accepted", "reason")


def raw_highlights(lines: DataFrame, flags: DataFrame) -> DataFrame:
    """(meeting_id, line, pos, text, mark): a flagged line whole with its reasons, else its words, unsure ones marked."""
    f = flags.where("flagged").select("meeting_id", "line", F.array_join("reasons", ", ").alias("_why"))
    rows = lines.join(f, ["meeting_id", "line"], "left")
    parts = F.when(F.col("_why").isNotNull() | (F.size(F.coalesce("words", F.array())) == 0), F.array(F.struct("text", F.col("_why").alias("mark")))).otherwise(F.transform("words", lambda w: F.struct(w["text"].alias("text"), F.when(w["probability"] < W.UNSURE_PROB, "unsure word").alias("mark"))))
    return rows.select("meeting_id", "line", F.posexplode(parts).alias("pos", "p")).select("meeting_id", "line", "pos", "p.*")


def refined_highlights(refined: DataFrame, edits: DataFrame) -> DataFrame:
    """(meeting_id, line, pos, text, mark): the line parted at its applied edits, taken left to right; an edit that isn't found
    behind the one before it is left out."""
    applied = edits.where("status = 'applied' and after != ''").groupBy("meeting_id", "line").agg(F.array_sort(F.collect_list(F.struct("ord", "before", "after"))).alias("_e"))
    rows = refined.join(applied, ["meeting_id", "line"], "left").withColumn("_e", F.coalesce("_e", F.array().cast("array<struct<ord:int,before:string,after:string>>")))
    start = F.struct(F.array().cast("array<struct<text:string,mark:string>>").alias("parts"), F.col("text").alias("rest"))

    def cut(state, e):
        at = F.position(e["after"], state["rest"])
        before = F.substring(state["rest"], F.lit(1), at - 1)
        head = F.when(at > 1, F.array(F.struct(before.alias("text"), F.lit(None).cast("string").alias("mark")))).otherwise(F.array().cast("array<struct<text:string,mark:string>>"))
        own = F.array(F.struct(e["after"].alias("text"), F.concat(F.lit("was: "), e["before"]).alias("mark")))
        behind = F.substring(state["rest"], at + F.length(e["after"]), F.length(state["rest"]))
        return F.when(at > 0, F.struct(F.concat(state["parts"], head, own).alias("parts"), behind.alias("rest"))).otherwise(state)

    state = F.aggregate("_e", start, cut)
    rows = rows.withColumn("_s", state).withColumn("_p", F.concat("_s.parts", F.when(F.col("_s.rest") != "", F.array(F.struct(F.col("_s.rest").alias("text"), F.lit(None).cast("string").alias("mark")))).otherwise(F.array().cast("array<struct<text:string,mark:string>>"))))
    return rows.select("meeting_id", "line", F.posexplode("_p").alias("pos", "p")).select("meeting_id", "line", "pos", "p.*")


def label_colours(lines: DataFrame, colours: int = 10) -> DataFrame:
    """(meeting_id, label, colour): labels in order of appearance, colours in turn."""
    from pyspark.sql import Window

    first = lines.where("label is not null").groupBy("meeting_id", "label").agg(F.min("line").alias("l"))
    return first.select("meeting_id", "label", F.pmod(F.row_number().over(Window.partitionBy("meeting_id").orderBy("l")) - 1, F.lit(colours)).alias("colour"))


def notes_view(notes: DataFrame, meetings: DataFrame) -> DataFrame:
    """(meeting_id, notes): in order, or 'Nothing removed'."""
    each = notes.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item", "ord", "note"))), lambda n: n["note"]).alias("notes"))
    return meetings.select("meeting_id").distinct().join(each, "meeting_id", "left").select("meeting_id", F.coalesce("notes", F.array(F.lit("Nothing removed"))).alias("notes"))


def stage_status(meetings: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(meeting_id, ord, stage, status, message) from what there is of each meeting: a bad one fails alone.

    tables: lines, speakers, flags, refined, evidence and drafts (with parsed) of the run.
    """
    def count(name: str, condition: str = "true") -> DataFrame:
        return tables[name].where(condition).groupBy("meeting_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))

    rows = meetings.select("meeting_id").distinct()
    for name, condition in (("lines", "true"), ("speakers", "true"), ("flags", "flagged"), ("edits", "status = 'applied'"), ("hints", "true"), ("evidence", "accepted"), ("drafts", "parsed")):
        rows = rows.join(count(name, condition), "meeting_id", "left") if name in tables else rows.withColumn(f"n_{name}", F.lit(None).cast("long"))
    n = lambda c: F.coalesce(f"n_{c}", F.lit(0))
    none = n("lines") == 0
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    def stage(i: int, name: str, status, message):
        return F.struct(F.lit(i).alias("ord"), F.lit(name).alias("stage"), F.when(none & F.lit(i > 0), "skipped").otherwise(status).alias("status"), F.when(none & F.lit(i > 0), "no transcript").otherwise(message).alias("message"))

    stages = F.array(
        stage(0, "transcript", F.when(none, "failed").otherwise("done"), text(n("lines"), " segments")),
        stage(1, "speakers", F.when(n("speakers") > 0, "done").otherwise("skipped"), text(n("speakers"), " speakers")),
        stage(2, "flags", F.lit("done"), text(n("flags"), " of ", n("lines"), " segments flagged")),
        stage(3, "refine", F.lit("done"), text(n("hints"), " hints, ", n("edits"), " edits applied")),
        stage(4, "names", F.when(n("speakers") > 0, "done").otherwise("skipped"), text(n("evidence"), " claims accepted")),
        stage(5, "record", F.when(n("drafts") > 0, "done").otherwise("failed"), F.when(n("drafts") > 0, "record verified").otherwise("no readable draft")),
    )
    return rows.select("meeting_id", F.explode(stages).alias("s")).select("meeting_id", "s.*")


def run_header(meetings: DataFrame, lines: DataFrame, speakers: DataFrame, hotwords: DataFrame | None = None) -> DataFrame:
    """(meeting_id, header): what a result was made from. meetings: meeting_id and, where known, path, model, llm, duration_s,
    language, typed, packs."""
    have = set(meetings.columns)
    get = lambda c, otherwise: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(otherwise)) if c in have else F.lit(otherwise)
    packs = F.coalesce(F.nullif(F.array_join("packs", ", "), F.lit("")), F.lit("(none)")) if "packs" in have else F.lit("(none)")
    length = X.clock(F.col("duration_s")) if "duration_s" in have else F.lit("?")
    n = lines.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("_n"))
    voices = speakers.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(F.ltrim(F.col("speaker"), F.lit("S")).try_cast("int").alias("k"), X.label(F.col("speaker"), F.col("name")).alias("label")))).alias("_v"))
    rows = meetings.join(n, "meeting_id", "left").join(voices, "meeting_id", "left")
    rows = rows.join(hotwords.select("meeting_id", F.col("hotwords").alias("_h")), "meeting_id", "left") if hotwords is not None else rows.withColumn("_h", F.lit(None).cast("string"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    header = F.concat_ws(
        "  \n",
        text("**File:** ", get("path", "?"), " · **Whisper:** ", get("model", "?"), " · **LLM:** ", get("llm", "?")),
        F.when(F.col("_n") > 0, text("**Audio:** ", F.coalesce(length, F.lit("?")), " (mm:ss) · **Language:** ", get("language", "?"), " · **Segments:** ", F.col("_n").cast("string"))),
        F.when(F.col("_n") > 0, text("**Whisper hotwords:** ", F.coalesce(F.nullif(F.col("_h"), F.lit("")), F.lit("(none)")))),
        F.when(F.size("_v") > 0, text("**Speakers:** ", F.size("_v").cast("string"), " found: ", F.array_join(F.transform("_v", lambda v: v["label"]), ", "))),
        text("**Glossary typed:** ", get("typed", "(none)"), " · **Packs:** ", packs),
    )
    return rows.select("meeting_id", header.alias("header"))


def usage_rows(calls: DataFrame) -> DataFrame:
    """(meeting_id, ord, provider, model, input_tokens, output_tokens, seconds) of the model calls that were answered."""
    return calls.where("status = 'ok'").select("meeting_id", "ord", "provider", "model", "input_tokens", "output_tokens", F.bround("seconds", 1).alias("seconds"))
