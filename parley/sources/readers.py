"""Sources: recordings' metadata, phrase files, glossary packs, model replies, gold annotations, driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.sources import schemas as S

# ---- fixed values: admission of recordings
AUDIO_FORMATS = ("wav", "mp3", "m4a", "flac", "ogg", "webm", "mp4")
MIN_DURATION_S, SILENCE_DB = 1.0, -50.0


def admit_audio(files: DataFrame) -> DataFrame:
    """files (path, length, has_audio, duration_s, peak_db) with problem: the first rule a recording fails, null if none."""
    extension = F.lower(F.element_at(F.split("path", r"\."), -1))
    problem = (
        F.when(F.col("length").isNull() | (F.col("length") == 0), "file is missing or empty")
        .when(~extension.isin(*AUDIO_FORMATS), "unsupported format")
        .when(~F.coalesce("has_audio", F.lit(False)), "no audio stream")
        .when(F.coalesce("duration_s", F.lit(0.0)) < MIN_DURATION_S, "too short")
        .when(F.coalesce("peak_db", F.lit(-1e9)) < SILENCE_DB, "silent")
    )
    return files.withColumn("problem", problem)


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of recordings, contents left unread."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def lines(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(S.LINES).format(kind).load(path)


def phrase_file(spark: SparkSession, path: str, column: str = "prediction") -> DataFrame:
    """Distinct normalised phrases of a CSV file with a header."""
    return spark.read.csv(path, header=True).select(X.norm(F.col(column)).alias("phrase")).where("phrase != ''").distinct()


def glossary_pack(spark: SparkSession, path: str) -> DataFrame:
    """(pack, ord, text): a term a line; blank lines and # comments are no terms. A missing pack is an error."""
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("pack"), F.trim("value").alias("text"), F.monotonically_increasing_id().alias("_o"))
    rows = rows.where("text != '' and not startswith(text, '#')")
    return rows.select("pack", (F.row_number().over(Window.partitionBy("pack").orderBy("_o")) - 1).alias("ord"), "text")


def packs_for(meetings: DataFrame, pack: DataFrame) -> DataFrame:
    """Pack terms for each meeting that names the pack (packs array<string>)."""
    wanted = meetings.select("meeting_id", F.explode("packs").alias("pack"))
    return wanted.join(pack, "pack").select("meeting_id", "ord", "text", F.lit("pack").alias("source"), F.lit("").alias("heard_as"))


def reply_key(kind: Column, model: Column, system: Column, user: Column) -> Column:
    """Key of a model reply: the digest of what was asked."""
    return F.sha2(F.to_json(F.array(kind, model, system, user)), 256)


def cached_replies(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their stored replies, requests not stored yet). requests: kind, model, system, user; cache: key, reply."""
    keyed = requests.withColumn("key", reply_key(F.col("kind"), F.col("model"), F.col("system"), F.col("user")))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")


def answered(calls: DataFrame, key: list[str]) -> DataFrame:
    """One row for each request: the first answer in the order of tries, who gave it, how many tries failed before it and why
    the last of them did. calls: the key, ord, provider, status ('ok' or what went wrong), reply. Without an answer reply and
    provider are null."""
    ok = F.col("status") == "ok"
    first = calls.groupBy(*key).agg(F.min_by(F.struct("provider", "reply", "ord"), F.when(ok, F.col("ord"))).alias("_a"), F.min(F.when(ok, F.col("ord"))).alias("_o"), F.collect_list(F.when(~ok, F.struct("ord", "status"))).alias("_f"))
    lost = F.array_sort(F.filter("_f", lambda f: F.col("_o").isNull() | (f["ord"] < F.col("_o"))))
    found = F.col("_o").isNotNull()
    return first.select(*key, F.when(found, F.col("_a.provider")).alias("provider"), F.when(found, F.col("_a.reply")).alias("reply"), F.size(lost).alias("failed"), F.element_at(F.when(F.size(lost) > 0, lost), -1)["status"].alias("problem"))


def json_replies(replies: DataFrame, schema: str, needed: str) -> DataFrame:
    """replies with data (the JSON object in reply) and problem: null, 'no JSON', 'bad JSON' or what is missing."""
    found = X.json_object(F.col("reply"))
    data = F.from_json(found, schema)
    valid = F.try_parse_json(found).isNotNull()
    problem = F.when(found.isNull(), "no JSON in the reply").when(~valid, "bad JSON in the reply").when(data[needed].isNull(), f'the reply is missing "{needed}"')
    return replies.withColumn("data", data).withColumn("problem", problem)


def gold_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of annotation XML (<w starttime endtime punc>), punctuation and untimed words left out; the file names meeting and speaker
    as '<meeting>.<speaker>.words.xml'."""
    rows = spark.read.format("xml").option("rowTag", "w").option("attributePrefix", "_").schema("_starttime double, _endtime double, _punc string, _VALUE string").load(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.([^./]+)\.words\.xml$", 1), F.regexp_extract(F.input_file_name(), r"([^/]+)\.([^./]+)\.words\.xml$", 2)
    return rows.where("_punc is null and _starttime is not null and _VALUE is not null").select(name[0].alias("meeting"), name[1].alias("speaker"), F.col("_starttime").alias("start"), F.col("_endtime").alias("end"), F.col("_VALUE").alias("word"))


# ------------------------------------------------------------------------------------------- tables that stand in here


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as lines: 7.5 s a turn, confidences by arithmetic."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = F.col("turn").cast("double")
    return c.select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("line"), (t * 7.5).alias("start"), (t * 7.5 + 7.0).alias("end"), F.col("text"),
        (F.pmod(F.length("text"), F.lit(100)) / 100.0).alias("no_speech_prob"), (-F.pmod(F.length("text"), F.lit(17)) / 10.0).alias("avg_logprob"), (F.pmod(F.length("text"), F.lit(31)) / 10.0).alias("compression_ratio"),
        F.col("role").alias("speaker"), F.col("role").alias("label"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut at line feeds as lines of meetings."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("meeting_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, turn_idx, start, end, speaker): each user's events of some types, each lasting until the next of them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin(*TURN_EVENTS))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = seconds(F.col("ts"))
    rows = e.select(F.col("user_id").alias("meeting_id"), (F.row_number().over(w) - 1).alias("turn_idx"), s.alias("start"), F.least(F.lead(s).over(w), s + 3600.0).alias("end"), F.col("event_type").alias("speaker"))
    return rows.where("end > start")


TURN_EVENTS = ("view", "click")


def seconds(ts: Column) -> Column:
    """Seconds since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) / F.lit(1e6)


def event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, line, start, end): the other events, each lasting its value in minutes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(~F.col("event_type").isin(*TURN_EVENTS))
    s = seconds(F.col("ts"))
    return e.select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("line"), s.alias("start"), (s + F.floor(F.abs("value")) * 60.0).alias("end"))
