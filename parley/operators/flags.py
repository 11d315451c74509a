"""Doubtful lines: repeats, phrases and confidences summed to a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import wordlists as W


def repeat_runs(lines: DataFrame, text: str = "text", group: str = "meeting_id", order: str = "line") -> DataFrame:
    """lines with norm, and run: how many neighbouring lines have the same normalised text (1 for empty ones)."""
    w = Window.partitionBy(group).orderBy(order)
    out = lines.withColumn("norm", X.norm(F.col(text)))
    out = out.withColumn("_new", F.coalesce((F.lag("norm").over(w) != F.col("norm")).cast("int"), F.lit(1)))
    out = out.withColumn("_island", F.sum("_new").over(w))
    size = F.count(F.lit(1)).over(Window.partitionBy(group, "_island"))
    return out.withColumn("run", F.when(F.col("norm") == "", 1).otherwise(size).cast("int")).drop("_new", "_island")


def phantom_phrases(phrases: DataFrame | None, spark, column: str = "prediction") -> DataFrame:
    """Distinct normalised phrases: those of a phrase file and the fixed extra ones, without the ones said in meetings."""
    extra = spark.createDataFrame([(p,) for p in W.EXTRA_PHANTOMS], "phrase string")
    if phrases is not None:
        extra = extra.unionByName(phrases.select(X.norm(F.col(column)).alias("phrase")))
    return extra.where(~F.col("phrase").isin(*W.MEETING_PHRASES)).distinct()


def low_confidence() -> Column:
    return F.coalesce(F.col("no_speech_prob") > W.NO_SPEECH_MAX, F.lit(False)) | F.coalesce(F.col("avg_logprob") < W.LOGPROB_MIN, F.lit(False))


def flag_lines(lines: DataFrame, meetings: DataFrame, phantoms: DataFrame) -> DataFrame:
    """(meeting_id, line, score, flagged, reasons).

    lines: meeting_id, line, start, text, no_speech_prob, avg_logprob, compression_ratio, speaker. meetings: meeting_id,
    duration_s, diarized. One shuffle by meeting; the phrase table joins by hash, whichever side is small enough.
    """
    runs = repeat_runs(lines)
    rows = runs.join(phantoms.select(F.col("phrase").alias("norm"), F.lit(True).alias("_known")), "norm", "left").join(meetings.select("meeting_id", "duration_s", "diarized"), "meeting_id", "left")
    rows = rows.withColumns({
        "subtitle": X.first_phrase(F.col("norm"), W.SUBTITLE_PHRASES),
        "phantom": F.coalesce("_known", F.lit(False)),
    }).withColumn("mid", (F.col("run") >= 2) & F.coalesce(F.col("start") < F.col("duration_s") * (1 - W.END_FRACTION), F.lit(False)) & (F.col("phantom") | F.col("subtitle").isNotNull() | (F.col("run") >= W.PLAIN_REPEAT)))
    no_voice = F.coalesce("diarized", F.lit(False)) & F.col("speaker").isNull() & (F.col("norm") != "")
    looping = F.coalesce(F.col("compression_ratio") > W.COMPRESSION_MAX, F.lit(False))
    points = [(F.col("subtitle").isNotNull(), 2), (F.col("phantom"), 1), (F.col("run") >= 2, 1), (F.col("mid"), 1), (low_confidence(), 1), (looping, 1), (no_voice, 1)]
    score = sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0)).cast("int")
    reasons = F.array_compact(F.array(
        F.when(F.col("subtitle").isNotNull(), F.format_string(W.REASON_SUBTITLE, F.col("subtitle"))),
        F.when(F.col("phantom"), W.REASON_PHANTOM),
        F.when(F.col("run") >= 2, F.concat(F.lit("repeated "), F.col("run").cast("string"), F.when(F.col("mid"), "x mid-meeting").otherwise("x"))),
        F.when(low_confidence(), W.REASON_LOW),
        F.when(looping, W.REASON_LOOP),
        F.when(no_voice, W.REASON_VOICE),
    ))
    return rows.select("meeting_id", "line", score.alias("score"), (score >= W.FLAG_SCORE).alias("flagged"), reasons.alias("reasons"))


def doubtful(flags: DataFrame) -> DataFrame:
    return flags.where("flagged").select("meeting_id", "line")


def without_doubtful(lines: DataFrame, flags: DataFrame) -> DataFrame:
    return lines.join(doubtful(flags), ["meeting_id", "line"], "left_anti")
