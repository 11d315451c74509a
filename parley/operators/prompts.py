"""What models are shown: numbered lines, topic parts of bounded size, earlier summaries as context.

Everything is a column; the calls themselves happen outside, and their replies come back as tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import wordlists as W
from parley.operators import topics

# ---- fixed values: wording of what models are shown
DOUBTFUL_MARK = " [DOUBTFUL]"
ROLES_HEAD, TRANSCRIPT_HEAD = "PARTICIPANTS (roles as they stated them):\n", "\n\nTRANSCRIPT:\n"
PART_OF = "This is part %d of %d of a long meeting.\n\n"
EARLIER = "EARLIER PARTS (context only, to resolve references; never quote from here):\n"
FIRST_PART = "- (this is the first part)"
PART_HEAD = "\n\nTRANSCRIPT OF PART %d:\n"
REMINDER = "\n\nReminder: every quote must be copied from the transcript lines of this part."


def numbered_lines(lines: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(meeting_id, line, text): each line with its number, a mark if it is doubtful, and its label if one is known."""
    marked = lines.join(doubtful.select("meeting_id", "line", F.lit(DOUBTFUL_MARK).alias("_d")), ["meeting_id", "line"], "left")
    who = F.when(F.col("label") != "", F.concat(F.lit(" "), "label", F.lit(":")))
    shown = F.concat(F.lit("["), F.col("line").cast("string"), F.lit("]"), F.coalesce("_d", F.lit("")), F.coalesce(who, F.lit("")), F.lit(" "), F.trim(F.coalesce("text", F.lit(""))))
    return marked.select("meeting_id", "line", shown.alias("text"))


def part_texts(shown: DataFrame, max_tokens: int = W.PART_TOKENS) -> DataFrame:
    """(meeting_id, part, parts, text): shown lines joined by topic part."""
    cuts = topics.topic_parts(shown, max_tokens).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("first_line", "part"))).alias("_p"))
    first = shown.groupBy("meeting_id").agg(F.min("line").alias("_0"))
    rows = shown.join(cuts, "meeting_id").join(first, "meeting_id")
    part = F.element_at(F.filter("_p", lambda p: p["first_line"] <= F.col("line") - F.col("_0")), -1)["part"]
    return rows.withColumns({"part": part, "parts": F.size("_p")}).groupBy("meeting_id", "part", "parts").agg(X.ordered_join("line", "text", "\n").alias("text"))


def part_messages(parts: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(meeting_id, part, message) of (meeting_id, part, parts, text): a meeting of one part as it is, else each part with the
    summaries (meeting_id, part, summary) of those before it."""
    rows = parts
    if summaries is not None:
        told = summaries.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("part", "summary"))).alias("_s"))
        rows = rows.join(told, "meeting_id", "left")
    else:
        rows = rows.withColumn("_s", F.lit(None).cast("array<struct<part:int,summary:string>>"))
    before = F.filter(F.coalesce("_s", F.array().cast(rows.schema["_s"].dataType)), lambda s: s["part"] < F.col("part"))
    context = F.array_join(F.transform(before, lambda s: F.concat(F.lit("- Part "), (s["part"] + 1).cast("string"), F.lit(": "), F.coalesce(s["summary"], F.lit("")))), "\n")
    message = F.concat(F.format_string(PART_OF, F.col("part") + 1, F.col("parts")), F.lit(EARLIER), F.when(F.size(before) > 0, context).otherwise(FIRST_PART), F.format_string(PART_HEAD, F.col("part") + 1), F.col("text"), F.lit(REMINDER))
    return rows.select("meeting_id", "part", F.when(F.col("parts") == 1, F.col("text")).otherwise(message).alias("message"))


def with_roles(messages: DataFrame, roles: DataFrame | None) -> DataFrame:
    """Messages with the stated roles (meeting_id, label, role) in front."""
    if roles is None:
        return messages
    listed = roles.where("role != ''").groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "role"))), lambda r: F.concat(F.lit("- "), r["label"], F.lit(": "), r["role"])), "\n").alias("_r"))
    head = F.when(F.col("_r").isNotNull(), F.concat(F.lit(ROLES_HEAD), "_r", F.lit(TRANSCRIPT_HEAD))).otherwise("")
    return messages.join(listed, "meeting_id", "left").select("meeting_id", "part", F.concat(head, "message").alias("message"))


def record_inputs(lines: DataFrame, doubtful: DataFrame, roles: DataFrame | None = None, summaries: DataFrame | None = None, max_tokens: int = W.PART_TOKENS) -> DataFrame:
    """(meeting_id, part, message): what the record's model is shown of each meeting."""
    return with_roles(part_messages(part_texts(numbered_lines(lines, doubtful), max_tokens), summaries), roles)


def naming_inputs(lines: DataFrame, doubtful: DataFrame, max_tokens: int = W.PART_TOKENS) -> DataFrame:
    """(meeting_id, part, message): undoubted lines with their numbers and speakers, split the same way, for name claims."""
    rows = lines.join(doubtful, ["meeting_id", "line"], "left_anti").withColumn("label", F.col("speaker"))
    shown = numbered_lines(rows, doubtful)
    return part_texts(shown, max_tokens).select("meeting_id", "part", F.col("text").alias("message"))
