"""The whole run over many meetings: tables in, tables out, keyed by meeting, stage by stage.

Models propose (replies are input tables), columns verify. A meeting without lines or without a readable draft only fails
its own stages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import wordlists as W
from parley.operators import flags, glossary, names, prompts, record, report, turns
from parley.session import ready, stored
from parley.sources import readers, sinks


@dataclass
class Inputs:
    meetings: DataFrame  #: meeting_id, duration_s, diarized, typed, attendees
    lines: DataFrame  #: parley.sources.schemas.LINES
    raw_turns: DataFrame | None = None  #: meeting_id, ord, start, end, label
    phrases: DataFrame | None = None  #: phrase file: prediction
    term_replies: DataFrame | None = None  #: meeting_id, reply
    pack_terms: DataFrame | None = None  #: meeting_id, ord, text, source, heard_as
    line_replies: DataFrame | None = None  #: meeting_id, reply
    name_claims: DataFrame | None = None  #: meeting_id, ord, speaker, name, role, kind, line, quote
    draft_replies: DataFrame | None = None  #: meeting_id, part, reply
    speaker_edits: DataFrame | None = None  #: meeting_id, speaker, name, role
    summaries: DataFrame | None = None  #: meeting_id, part, summary: of parts whose replies came before
    part_tokens: int = W.PART_TOKENS  #: of a part that a model is shown


@dataclass
class Run:
    """Tables by name; ``record`` holds those of the meeting record."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    record: dict[str, DataFrame] | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def files(self) -> DataFrame:
        """The run itself, for inspection: transcripts, speakers, edits, record and details."""
        return sinks.run_files(self.tables["status"], self.tables, self.record)

    def deliverables(self) -> DataFrame:
        t = self.tables
        raw = t["lines"].join(t["labels"], ["meeting_id", "line"], "left")
        return sinks.deliverables(raw, t["labelled"], self.record, t.get("drafts"), t.get("roles"), t["status"])


def run(inputs: Inputs, keep: Callable[[DataFrame], DataFrame] = stored) -> Run:
    """``keep`` is applied to the tables that later stages read again. As it stands they are written to the shared folder:
    plans stay small, nothing is computed twice, and a lost executor costs nothing that is done."""
    spark = inputs.meetings.sparkSession
    ready(spark)
    t: dict[str, DataFrame] = {}
    empty = lambda schema: spark.createDataFrame([], schema)

    lines = inputs.lines
    if inputs.raw_turns is not None:
        t["turns"] = turns.relabel(inputs.raw_turns)
        lines = turns.assign_speakers(lines, t["turns"])
    elif "speaker" not in lines.columns:
        lines = lines.withColumn("speaker", F.lit(None).cast("string"))
    lines = t["lines"] = keep(lines)
    t["summary"] = turns.speaker_summary(lines)

    t["flags"] = keep(flags.flag_lines(lines, inputs.meetings, flags.phantom_phrases(inputs.phrases, spark)))
    doubtful = t["doubtful"] = flags.doubtful(t["flags"])

    terms = glossary.typed_terms(inputs.meetings) if "typed" in inputs.meetings.columns else empty("meeting_id long, ord int, text string, source string, heard_as string")
    if "attendees" in inputs.meetings.columns:
        listed = inputs.meetings.select("meeting_id", F.posexplode("attendees").alias("ord", "text")).select("meeting_id", (F.col("ord") + 10_000).alias("ord"), "text", F.lit("user").alias("source"), F.lit("").alias("heard_as"))
        terms = terms.unionByName(listed)
    if inputs.term_replies is not None:
        terms = terms.unionByName(glossary.inferred_terms(inputs.term_replies, glossary.transcript_for_inference(lines, doubtful)))
    if inputs.pack_terms is not None:
        terms = terms.unionByName(inputs.pack_terms)
    t["glossary"] = keep(glossary.merge_terms(terms))
    t["hints"] = keep(glossary.find_hints(lines, t["glossary"], doubtful))
    t |= glossary.refine(lines, t["glossary"], t["hints"], inputs.line_replies if inputs.line_replies is not None else empty("meeting_id long, reply string"))

    refined = keep(lines.drop("text").join(t["refined"], ["meeting_id", "line"]))
    t["naming_inputs"] = prompts.naming_inputs(refined, doubtful, inputs.part_tokens)
    claims = inputs.name_claims if inputs.name_claims is not None else empty("meeting_id long, ord int, speaker string, name string, role string, kind string, line string, quote string")
    attendees = inputs.meetings.select("meeting_id", "attendees") if "attendees" in inputs.meetings.columns else None
    t["evidence"] = keep(names.check_claims(claims, refined, doubtful, attendees))
    t["speakers"] = names.assign_names_and_roles(t["summary"].select("meeting_id", "speaker"), t["evidence"])
    changes = None
    if inputs.speaker_edits is not None:
        t["speakers"], changes = names.rename_speakers(keep(t["speakers"]), inputs.speaker_edits)
    t["speakers"] = keep(t["speakers"])
    changes = keep(changes) if changes is not None else None
    labelled = t["labelled"] = keep(turns.line_labels(refined, t["speakers"]))
    t["labels"] = labelled.select("meeting_id", "line", "label")
    t["roles"] = names.roles_view(t["speakers"], t["evidence"])
    t["conversation"] = turns.conversation_turns(labelled)
    # what the record's model is to be shown, part by part; its replies are the drafts below
    t["record_inputs"] = prompts.record_inputs(labelled, doubtful, t["roles"], inputs.summaries, inputs.part_tokens)
    t["header"] = report.run_header(inputs.meetings, lines, t["speakers"], glossary.hotwords(t["glossary"].withColumn("ord", F.col("pos"))))

    out = Run(t)
    if inputs.draft_replies is not None:
        parsed = record.parse_drafts(inputs.draft_replies)
        good = parsed.where("parsed")
        t["parsed"] = parsed
        t["drafts"] = record.merge_drafts(good if "part" in good.columns else good.withColumn("part", F.lit(0)))
        if changes is not None:
            t["drafts"] = record.relabel_drafts(t["drafts"], changes)
        t["drafts"] = keep(t["drafts"])
        out.record = record.verify(t["drafts"], labelled, doubtful, t["roles"], keep)
        t["faithfulness"] = report.faithfulness(out.record["checks"], t["edits"], t["speakers"], t["evidence"])
    t["status"] = report.stage_status(inputs.meetings, {k: t[k] for k in ("lines", "speakers", "flags", "edits", "hints", "evidence") if k in t} | ({"drafts": t["parsed"]} if "parsed" in t else {}))
    return out


__all__ = ["Inputs", "Run", "readers", "run"]
