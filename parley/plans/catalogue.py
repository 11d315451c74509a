"""The registered queries of the conversation engine, and the SQL that states each of them.

The tables at hand stand in for meetings: conversations and documents cut at line feeds are lines, events are voice turns
and words. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import wordlists as W
from parley.operators import evaluate, flags, glossary, names, record, report, topics, turns
from parley.session import ready, stored
from parley.sources import readers as R
from parley.sources import sinks

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ready(spark), sf_dir)

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ------------------------------------------------------------------------------------------------------ SQL pieces


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


CONV = """conv AS (SELECT conv_id AS meeting_id, CAST(turn AS INT) AS line, turn * 7.5::DOUBLE AS start, turn * 7.5::DOUBLE + 7.0::DOUBLE AS "end", text,
  (length(text) % 100) / 100.0::DOUBLE AS no_speech_prob, -(length(text) % 17) / 10.0::DOUBLE AS avg_logprob, (length(text) % 31) / 10.0::DOUBLE AS compression_ratio, role AS speaker FROM conversations)"""
DOCS = r"""doc AS (SELECT doc_id AS meeting_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"""
TOKENS = r"list_filter(regexp_split_to_array({c}, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{85}}\x{{1680}}]+'), lambda x: x <> '')"
EVENTS = f"""turns AS (SELECT user_id AS meeting_id, event_type AS speaker, s AS start, e AS "end", ix AS turn_idx FROM (
    SELECT user_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS s, row_number() OVER w - 1 AS ix,
      least(lead(epoch_us(ts) / 1e6::DOUBLE) OVER w, epoch_us(ts) / 1e6::DOUBLE + 3600.0::DOUBLE) AS e
    FROM events WHERE event_type IN ({_in(R.TURN_EVENTS)}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE e > s),
  words AS (SELECT user_id AS meeting_id, event_id AS line, epoch_us(ts) / 1e6::DOUBLE AS start, epoch_us(ts) / 1e6::DOUBLE + floor(abs(value)) * 60.0::DOUBLE AS "end"
    FROM events WHERE event_type NOT IN ({_in(R.TURN_EVENTS)}))"""
FLAGS = f"""{CONV},
  ph AS (SELECT DISTINCT p FROM (SELECT {_norm('text')} AS p FROM benchmark UNION ALL SELECT unnest([{_in(W.EXTRA_PHANTOMS)}])) WHERE p NOT IN ({_in(W.MEETING_PHRASES)})),
  dur AS (SELECT meeting_id, max("end") AS duration_s FROM conv GROUP BY 1),
  n AS (SELECT *, {_norm('text')} AS norm FROM conv),
  i AS (SELECT *, CASE WHEN lag(norm) OVER (PARTITION BY meeting_id ORDER BY line) = norm THEN 0 ELSE 1 END AS nw FROM n),
  j AS (SELECT *, sum(nw) OVER (PARTITION BY meeting_id ORDER BY line) AS isl FROM i),
  r AS (SELECT *, CASE WHEN norm = '' THEN 1 ELSE count(*) OVER (PARTITION BY meeting_id, isl) END AS run FROM j),
  s AS (SELECT r.*, ph.p IS NOT NULL AS phantom, list_filter([{_in(W.SUBTITLE_PHRASES)}], lambda x: contains(' ' || norm || ' ', ' ' || x || ' '))[1] AS sub, duration_s
    FROM r LEFT JOIN ph ON ph.p = r.norm JOIN dur USING (meeting_id)),
  m AS (SELECT *, run >= 2 AND start < duration_s * 0.9 AND (phantom OR sub IS NOT NULL OR run >= 3) AS mid, no_speech_prob > 0.6 OR avg_logprob < -1.0 AS low, compression_ratio > 2.4 AS looping FROM s),
  f AS (SELECT meeting_id, line, speaker, text, start, "end", no_speech_prob, avg_logprob, compression_ratio,
    CAST((CASE WHEN sub IS NOT NULL THEN 2 ELSE 0 END) + (phantom)::INT + (run >= 2)::INT + (mid)::INT + (low)::INT + (looping)::INT AS INT) AS score,
    array_to_string(list_filter([CASE WHEN sub IS NOT NULL THEN 'subtitle/YouTube phrase "' || sub || '"' END, CASE WHEN phantom THEN 'only a known Whisper phantom phrase' END,
      CASE WHEN run >= 2 THEN 'repeated ' || run || CASE WHEN mid THEN 'x mid-meeting' ELSE 'x' END END, CASE WHEN low THEN 'low confidence' END, CASE WHEN looping THEN 'looping text' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM m)"""
TERMS = r"""t AS (SELECT conv_id AS meeting_id, turn * 1000 + i AS ord, trim(p, E' \t\n\r') AS text, CASE i % 3 WHEN 0 THEN 'pack' WHEN 1 THEN 'user' ELSE 'inferred' END AS source, '' AS heard_as
    FROM (SELECT conv_id, turn, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[,;\n]') AS ps FROM conversations))),
  k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS k, CASE source WHEN 'user' THEN 0 WHEN 'inferred' THEN 1 ELSE 2 END AS p FROM t WHERE text <> ''),
  o AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, k ORDER BY p, ord) AS r FROM k WHERE k <> ''),
  g AS (SELECT meeting_id, text, source, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY p, ord) - 1 AS INT) AS pos FROM o WHERE r = 1)"""


def _flagged(spark, d):
    lines = R.conversation_lines(spark, d)
    meetings = lines.groupBy("meeting_id").agg(F.max("end").alias("duration_s"), F.lit(False).alias("diarized"))
    phrases = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("text").alias("prediction"))
    return lines, flags.flag_lines(lines, meetings, flags.phantom_phrases(phrases, spark))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag counts and talk time of every speaker of every conversation."""
    lines, flagged = _flagged(ready(spark), sf_dir)
    counts = lines.join(flagged, ["meeting_id", "line"]).groupBy("meeting_id", "speaker").agg(F.count_if("flagged").alias("flagged"), F.sum("score").alias("score"))
    return counts.join(turns.speaker_summary(lines), ["meeting_id", "speaker"])


# --------------------------------------------------------------------------------------------------------- queries


@query(f"WITH {CONV} SELECT meeting_id, line, {_norm('text')} AS norm FROM conv")
def line_norm(spark, d):
    return R.conversation_lines(spark, d).select("meeting_id", "line", X.norm(F.col("text")).alias("norm"))


@query(f"""WITH {DOCS}, n AS (SELECT *, {_norm('text')} AS norm FROM doc),
  i AS (SELECT *, CASE WHEN lag(norm) OVER (PARTITION BY meeting_id ORDER BY line) = norm THEN 0 ELSE 1 END AS nw FROM n),
  j AS (SELECT *, sum(nw) OVER (PARTITION BY meeting_id ORDER BY line) AS isl FROM i)
  SELECT meeting_id, line, CAST(CASE WHEN norm = '' THEN 1 ELSE count(*) OVER (PARTITION BY meeting_id, isl) END AS INT) AS run FROM j""")
def repeat_runs(spark, d):
    return flags.repeat_runs(R.document_lines(spark, d)).select("meeting_id", "line", "run")


@query(f"""WITH {DOCS}, ph AS (SELECT DISTINCT {_norm('l')} AS p FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark) UNION SELECT unnest([{_in(W.EXTRA_PHANTOMS)}]))
  SELECT meeting_id, line FROM doc WHERE {_norm('text')} IN (SELECT p FROM ph WHERE p NOT IN ({_in(W.MEETING_PHRASES)}))""")
def phantom_semi_join(spark, d):
    phrases = flags.phantom_phrases(spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split("text", "\n")).alias("prediction")), spark)
    return R.document_lines(spark, d).withColumn("phrase", X.norm(F.col("text"))).join(phrases, "phrase", "left_semi").select("meeting_id", "line")


PHRASES = ("the and", "of the", "in the", "to be", "de la", "la de", "que de", "und die", "der die", "the")


@query(f"SELECT doc_id, list_filter([{_in(PHRASES)}], lambda x: contains(' ' || {_norm('text')} || ' ', ' ' || x || ' '))[1] AS phrase FROM documents")
def phrase_contains(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.first_phrase(X.norm(F.col("text")), PHRASES).alias("phrase"))


@query(f"WITH {FLAGS} SELECT meeting_id, line, score, score >= 2 AS flagged, reasons FROM f")
def flag_score(spark, d):
    return _flagged(spark, d)[1].withColumn("reasons", F.array_join("reasons", ", "))


@query(f"WITH {FLAGS} SELECT meeting_id, count(*) AS lines, count_if(score >= 2) AS flagged, CAST(sum(score) AS BIGINT) AS score FROM f GROUP BY 1")
def flag_summary(spark, d):
    return _flagged(spark, d)[1].groupBy("meeting_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("flagged").alias("flagged"), F.sum("score").alias("score"))


@query(f"""WITH {DOCS}, n AS (SELECT *, {_norm('text')} AS norm FROM doc), i AS (SELECT *, CASE WHEN lag(norm) OVER (PARTITION BY meeting_id ORDER BY line) = norm THEN 0 ELSE 1 END AS nw FROM n),
  j AS (SELECT *, sum(nw) OVER (PARTITION BY meeting_id ORDER BY line) AS isl FROM i), r AS (SELECT meeting_id, CASE WHEN norm = '' THEN 1 ELSE count(*) OVER (PARTITION BY meeting_id, isl) END AS run FROM j),
  m AS (SELECT meeting_id, max(run) >= 2 AS repeats FROM r GROUP BY 1)
  SELECT quality, repeats, count(*) AS n FROM labels JOIN m ON doc_id = meeting_id GROUP BY 1, 2""")
def flag_vs_label(spark, d):
    runs = flags.repeat_runs(R.document_lines(spark, d)).groupBy("meeting_id").agg((F.max("run") >= 2).alias("repeats"))
    return spark.read.parquet(f"{d}/labels.parquet").join(runs, F.col("doc_id") == F.col("meeting_id")).groupBy("quality", "repeats").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOCS}, t AS (SELECT meeting_id, line, CAST(floor(len({TOKENS.format(c='text')}) * 1.3::DOUBLE) AS INT) + 1 AS tokens FROM doc) SELECT meeting_id, line, tokens, CAST(sum(tokens) OVER (PARTITION BY meeting_id ORDER BY line) AS BIGINT) AS total FROM t")
def running_tokens(spark, d):
    return topics.running_tokens(R.document_lines(spark, d))


BAG = f"""bag AS (SELECT meeting_id, line, w AS word, count(*) AS n FROM (SELECT meeting_id, line, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM {{src}}) WHERE length(w) > 2 AND w NOT IN ({_in(W.STOPWORDS)}) GROUP BY 1, 2, 3)"""


@query(f"WITH {CONV}, {BAG.format(src='conv')} SELECT * FROM bag")
def bag_of_words(spark, d):
    return topics.bag_of_words(R.conversation_lines(spark, d))


GAPS = f"""{BAG.format(src='doc')}, e AS (SELECT meeting_id, word, n, line, unnest(range(line - 3, line + 5)) AS gap FROM bag),
  sides AS (SELECT meeting_id, gap, word, sum(CASE WHEN line < gap THEN n ELSE 0 END) AS b, sum(CASE WHEN line >= gap THEN n ELSE 0 END) AS a FROM e GROUP BY 1, 2, 3),
  c AS (SELECT meeting_id, gap, sum(a * b) / nullif(sqrt(sum(b * b)) * sqrt(sum(a * a)), 0) AS s FROM sides GROUP BY 1, 2)"""


@query(f"WITH {DOCS}, {GAPS} SELECT meeting_id, line AS gap, round(CASE WHEN line = 0 THEN 1.0 ELSE coalesce(s, 0.0) END, 6)::DOUBLE AS similarity FROM doc LEFT JOIN c USING (meeting_id) WHERE c.gap = line OR c.gap IS NULL UNION ALL SELECT meeting_id, line, CASE WHEN line = 0 THEN 1.0 ELSE 0.0 END FROM doc d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.meeting_id = d.meeting_id AND c.gap = d.line) AND EXISTS (SELECT 1 FROM c WHERE c.meeting_id = d.meeting_id)")
def gap_similarity(spark, d):
    return topics.gap_similarity(R.document_lines(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {DOCS}, {GAPS}, t AS (SELECT meeting_id, line, sum(CAST(floor(len({TOKENS.format(c='text')}) * 1.3::DOUBLE) AS INT) + 1) OVER (PARTITION BY meeting_id ORDER BY line) AS total FROM doc),
  m AS (SELECT t.meeting_id, count(*) AS n, list_prepend(0, list(total ORDER BY line)) AS tot, list(CASE WHEN line = 0 THEN 1.0 ELSE coalesce(s, 0.0) END ORDER BY line) AS sim FROM t LEFT JOIN c ON c.meeting_id = t.meeting_id AND c.gap = t.line GROUP BY 1),
  r AS (SELECT meeting_id, 0 AS part, 0::BIGINT AS a, n, tot, sim FROM m UNION ALL
    SELECT meeting_id, part + 1, CASE WHEN len(ok) > 0 THEN -list_min(list_transform(ok, lambda g: {{'s': sim[g + 1], 'g': -g}})).g WHEN len(fit) > 0 THEN fit[-1] ELSE a + 1 END, n, tot, sim
    FROM (SELECT *, list_filter(fit, lambda g: tot[g + 1] - tot[a + 1] >= 150) AS ok FROM (SELECT *, list_filter(range(a + 1, n), lambda g: tot[g + 1] - tot[a + 1] <= 300) AS fit FROM r WHERE a < n AND tot[n + 1] - tot[a + 1] > 300)))
  SELECT meeting_id, part, CAST(a AS INT) AS first_line, CAST(lead(a, 1, n) OVER (PARTITION BY meeting_id ORDER BY part) AS INT) AS end_line FROM r WHERE a < n""")
def topic_parts(spark, d):
    return topics.topic_parts(R.document_lines(spark, d), max_tokens=300)


@query(f'WITH {CONV} SELECT meeting_id, speaker, round(sum("end" - start), 1) AS talk_s, count(*) AS lines FROM conv GROUP BY 1, 2')
def speaker_summary(spark, d):
    return turns.speaker_summary(R.conversation_lines(spark, d))


@query("""WITH v AS (SELECT user_id AS meeting_id, event_id AS ord, epoch_us(ts) / 1e6::DOUBLE AS start, epoch_us(ts) / 1e6::DOUBLE + floor(value) AS "end", event_type AS label FROM events),
  k AS (SELECT * FROM v WHERE "end" > start), f AS (SELECT meeting_id, label, min((start, "end", ord)) AS first FROM k GROUP BY 1, 2),
  l AS (SELECT meeting_id, label, 'S' || dense_rank() OVER (PARTITION BY meeting_id ORDER BY first) AS speaker FROM f)
  SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY start, "end", ord) - 1 AS INT) AS turn_idx, speaker FROM k JOIN l USING (meeting_id, label)""")
def relabel_first_seen(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    s = R.seconds(F.col("ts"))
    return turns.relabel(e.select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("ord"), s.alias("start"), (s + F.floor("value")).alias("end"), F.col("event_type").alias("label"))).select("meeting_id", "turn_idx", "speaker")


@query(f"""WITH {CONV}, i AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY meeting_id ORDER BY line) = speaker THEN 0 ELSE 1 END AS nw FROM conv),
  j AS (SELECT *, sum(nw) OVER (PARTITION BY meeting_id ORDER BY line) - 1 AS turn FROM i)
  SELECT meeting_id, CAST(turn AS BIGINT) AS turn, any_value(speaker) AS label, min(line) AS first_line, max(line) AS last_line, string_agg(text, ' ' ORDER BY line) FILTER (text <> '') AS text FROM j GROUP BY 1, 2""")
def turn_merge(spark, d):
    return turns.conversation_turns(R.conversation_lines(spark, d))


OVERLAP = f"""{EVENTS}, p AS (SELECT w.meeting_id, w.line, t.speaker, t.turn_idx, least(w."end", t."end") - greatest(w.start, t.start) AS sh FROM words w JOIN turns t USING (meeting_id)),
  ov AS (SELECT meeting_id, line, speaker, sum(sh) AS total, max(turn_idx) AS last FROM p WHERE sh > 0 GROUP BY 1, 2, 3),
  a AS (SELECT meeting_id, line, arg_max(speaker, (total, last)) AS sp FROM ov GROUP BY 1, 2),
  b AS (SELECT meeting_id, line, arg_min(speaker, (-sh, turn_idx)) AS sp FROM p WHERE sh <= 0 AND sh >= {{reach}} GROUP BY 1, 2)"""
REACH = 900.0


@query(f"WITH {OVERLAP.format(reach=-REACH)} SELECT w.meeting_id, w.line, coalesce(a.sp, b.sp) AS speaker FROM words w LEFT JOIN a USING (meeting_id, line) LEFT JOIN b USING (meeting_id, line)")
def overlap_or_nearest_speaker(spark, d):
    return turns.spans_to_speakers(R.event_words(spark, d), R.event_turns(spark, d), ["meeting_id", "line"], REACH, 3600.0).select("meeting_id", "line", "speaker")


@query(f"""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ({_in(R.TURN_EVENTS)}) THEN event_type END AS speaker FROM events)
  SELECT user_id, event_id, coalesce(last_value(speaker IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(speaker IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker FROM e""")
def fill_gaps(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type").isin(*R.TURN_EVENTS), F.col("event_type")).alias("speaker"))
    return turns.fill_gaps(e, "speaker", ["user_id"], "o").select("user_id", "event_id", "speaker")


# every fifth word ends a sentence; borders move one after the other, then each stray run takes the label of the last run that isn't one
@query(f"""WITH RECURSIVE {OVERLAP.format(reach=-0.5)}, w2 AS (SELECT w.*, floor(start / 21600) AS h, coalesce(a.sp, b.sp) AS sp FROM words w LEFT JOIN a USING (meeting_id, line) LEFT JOIN b USING (meeting_id, line) WHERE w.meeting_id IN (SELECT meeting_id FROM turns)),
  w3 AS (SELECT *, coalesce(last_value(sp IGNORE NULLS) OVER (PARTITION BY meeting_id, h ORDER BY start, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(sp IGNORE NULLS) OVER (PARTITION BY meeting_id, h ORDER BY start, line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM w2),
  b0 AS (SELECT meeting_id, h, 1::BIGINT AS i, list(v ORDER BY start, line) AS x, list(line % 5 = 0 ORDER BY start, line) AS c, count(*) AS n FROM w3 GROUP BY 1, 2),
  b1 AS (SELECT * FROM b0 UNION ALL SELECT meeting_id, h, i + 1, CASE WHEN to_ IS NULL OR c[i] OR x[i] IS NOT DISTINCT FROM x[i + 1] THEN x ELSE list_transform(range(1, n + 1), lambda k: CASE WHEN k > least(i, to_) AND k <= greatest(i, to_) THEN CASE WHEN to_ > i THEN x[i] ELSE x[i + 1] END ELSE x[k] END) END, c, n
    FROM (SELECT *, list_filter([i - 1, i + 1, i - 2, i + 2], lambda k: k >= 1 AND k <= n AND c[k])[1] AS to_ FROM b1 WHERE i < n)),
  b2 AS (SELECT meeting_id, h, unnest(x) AS v, unnest(range(1, n + 1)) AS pos, unnest(c) AS ends FROM b1 WHERE i = n),
  b3 AS (SELECT *, CASE WHEN pos > 1 AND v IS NOT DISTINCT FROM lag(v) OVER (PARTITION BY meeting_id, h ORDER BY pos) THEN 0 ELSE 1 END AS nw, coalesce(lag(ends) OVER (PARTITION BY meeting_id, h ORDER BY pos), true) AS opens FROM b2),
  b4 AS (SELECT meeting_id, h, isl, any_value(v) AS own, count(*) AS n, count(*) < 2 AND NOT (arg_min(opens, pos) AND arg_max(ends, pos)) AS stray FROM (SELECT *, sum(nw) OVER (PARTITION BY meeting_id, h ORDER BY pos) AS isl FROM b3) GROUP BY 1, 2, 3),
  b5 AS (SELECT *, CASE WHEN NOT stray THEN {{'v': own}} WHEN isl = 1 THEN {{'v': coalesce(lead(own) OVER (PARTITION BY meeting_id, h ORDER BY isl), own)}} END AS s FROM b4),
  b6 AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY meeting_id, h ORDER BY isl).v AS speaker FROM b5),
  b7 AS (SELECT *, CASE WHEN isl > 1 AND speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY meeting_id, h ORDER BY isl) THEN 0 ELSE 1 END AS nw FROM b6),
  g AS (SELECT meeting_id, h, run, any_value(speaker) AS speaker, sum(n) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY meeting_id, h ORDER BY isl) AS run FROM b7) GROUP BY 1, 2, 3)
  SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY h, run) - 1 AS INT) AS line, speaker, CAST(n AS INT) AS n_words FROM g""")
def split_at_change(spark, d):
    words = R.event_words(spark, d).withColumn("h", F.floor(F.col("start") / 21600))
    word = F.struct(F.col("start"), F.col("line").alias("id"), F.col("end"))
    lines = words.groupBy("meeting_id", "h").agg(F.array_sort(F.collect_list(word)).alias("w"))
    said = lambda x: F.concat(x["id"].cast("string"), F.when(x["id"] % 5 == 0, ".").otherwise(""))
    lines = lines.select("meeting_id", F.col("h").cast("int").alias("line"), F.get("w", F.lit(0))["start"].alias("start"), F.element_at("w", -1)["end"].alias("end"), F.lit("").alias("text"), F.transform("w", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), said(x).alias("text"), F.lit(1.0).alias("probability"))).alias("words"))
    heard = R.event_turns(spark, d)
    out = turns.assign_speakers(lines, heard).join(heard.select("meeting_id").distinct(), "meeting_id", "left_semi")
    return out.select("meeting_id", F.col("line").cast("int").alias("line"), "speaker", F.size("words").alias("n_words"))


@query(f"WITH {OVERLAP.format(reach=-REACH)} SELECT w.meeting_id, coalesce(a.sp, b.sp) AS speaker, e.event_type AS gold, count(*) AS n FROM words w LEFT JOIN a USING (meeting_id, line) LEFT JOIN b USING (meeting_id, line) JOIN events e ON e.event_id = w.line WHERE coalesce(a.sp, b.sp) IS NOT NULL GROUP BY 1, 2, 3")
def word_confusion(spark, d):
    gold = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("line"), F.col("event_type").alias("gold"))
    return evaluate.pair_counts(overlap_or_nearest_speaker(spark, d).join(gold, "line"))


@query(f"""WITH {EVENTS}, p AS (SELECT w.meeting_id, w.line, t.speaker, t.start AS ts, t."end" AS te, least(w."end", t."end") - greatest(w.start, t.start) AS sc FROM words w JOIN turns t USING (meeting_id))
  SELECT w.meeting_id, w.line, (SELECT arg_max(p.speaker, (p.sc, -p.ts, -p.te)) FROM p WHERE p.meeting_id = w.meeting_id AND p.line = w.line AND p.sc > -900) AS gold FROM words w""")
def gold_nearest(spark, d):
    return evaluate.gold_speakers(R.event_words(spark, d), R.event_turns(spark, d), ["meeting_id", "line"], REACH).select("meeting_id", "line", "gold")


def _terms(spark, d):
    parts = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.posexplode(F.split("text", "[,;\n]")).alias("i", "p"))
    source = F.when(F.col("i") % 3 == 0, "pack").when(F.col("i") % 3 == 1, "user").otherwise("inferred")
    return parts.select(F.col("conv_id").alias("meeting_id"), (F.col("turn") * 1000 + F.col("i")).alias("ord"), F.trim("p").alias("text"), source.alias("source"), F.lit("").alias("heard_as")).where("text != ''")


@query(f"WITH {TERMS} SELECT * FROM g")
def term_merge_priority(spark, d):
    return glossary.merge_terms(_terms(spark, d)).select("meeting_id", "text", "source", "pos")


@query(f"""WITH {TERMS}, l AS (SELECT *, sum(length(text) + CASE WHEN pos > 0 THEN 2 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY pos) AS len FROM g),
  v AS (SELECT meeting_id, min(pos) FILTER (pos >= 50 OR len > 600) AS stop FROM l GROUP BY 1)
  SELECT meeting_id, string_agg(text, ', ' ORDER BY pos) AS hotwords, count(*) AS n FROM l JOIN v USING (meeting_id) WHERE stop IS NULL OR pos < stop GROUP BY 1""")
def hotword_cap(spark, d):
    return glossary.hotwords(_terms(spark, d))


@query(rf"""WITH {CONV}, t AS (SELECT meeting_id, line, {TOKENS.format(c='text')} AS w FROM conv), e AS (SELECT meeting_id, line, w, list_transform(w, lambda x: regexp_matches(x, '[.?!]["'')]*$')) AS c, unnest(range(len(w))) AS first FROM t),
  s AS (SELECT *, unnest(range(first + 1, least(first + 5, len(w)) + 1)) AS stop FROM e)
  SELECT meeting_id, line, CAST(first AS INT) AS first, CAST(stop AS INT) AS "end", array_to_string(w[first + 1 : stop], ' ') AS heard FROM s WHERE NOT list_contains(c[first + 1 : stop - 1], true)""")
def candidate_spans(spark, d):
    return glossary.candidate_spans(R.conversation_lines(spark, d)).select("meeting_id", "line", "first", "end", "heard")


def _hint_inputs(spark, d):
    lines = R.conversation_lines(spark, d)
    # a meeting's glossary: its longest words, a letter doubled, as misheard terms
    words = lines.select("meeting_id", "line", F.posexplode(X.tokens(F.col("text"))).alias("p", "w")).select("meeting_id", X.clean_token(F.col("w")).alias("w"), (F.col("line") * 10000 + F.col("p")).alias("ord")).where(F.length("w") >= 12)
    terms = words.groupBy("meeting_id", "w").agg(F.min("ord").alias("ord")).select("meeting_id", "ord", F.concat(F.substring("w", 1, 6), F.lit("e"), F.substring("w", 7, 99)).alias("text"), F.lit("user").alias("source"), F.lit("").alias("heard_as"))
    return lines, glossary.merge_terms(terms), _flagged(spark, d)[1].where("flagged").select("meeting_id", "line")


#: bit-parallel longest common subsequence of q (its characters' places as bits: masks) and w
LCS = "CASE WHEN q = '' OR w = '' THEN 0 ELSE length(q) - bit_count(list_reduce(list_transform(string_split(w, ''), lambda c: coalesce(masks[c], 0::HUGEINT)), lambda r, h: ((r + (r & h)) | (r - (r & h))) & ((1::HUGEINT << length(q)) - 1), (1::HUGEINT << length(q)) - 1)) END"
MASKS = "map_from_entries(list_transform(list_distinct(string_split({q}, '')), lambda c: {{'k': c, 'v': list_sum(list_transform(range(length({q})), lambda i: CASE WHEN substr({q}, (i + 1)::BIGINT, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT}}))"
_VOWEL = "('A', 'E', 'I', 'O', 'U')"
#: sound codes of the words x.w (upper case, first letters settled) by one pass over their letters; k: the next letter to be read
METAPHONE = f"""list_reduce(range(1, length(w) + 1), lambda st, i: CASE WHEN i < st.k THEN st ELSE
  {{{{'k': i + CASE WHEN w[i] = w[i - 1] AND w[i] <> 'C' THEN 1 WHEN (w[i] = 'C' AND ((w[i + 1] = 'H') OR (w[i + 1] = 'K'))) OR (w[i] = 'D' AND w[i + 1] = 'G' AND w[i + 2] IN ('E', 'I', 'Y')) OR (w[i] IN ('G', 'P', 'T') AND w[i + 1] = 'H') THEN 2 ELSE 1 END,
    'o': st.o || CASE WHEN w[i] = w[i - 1] AND w[i] <> 'C' THEN ''
      WHEN w[i] IN {_VOWEL} THEN CASE WHEN i = 1 THEN w[i] ELSE '' END
      WHEN w[i] = 'B' THEN CASE WHEN w[i - 1] = 'M' AND i = length(w) THEN '' ELSE 'B' END
      WHEN w[i] = 'C' THEN CASE WHEN w[i + 1] = 'I' AND w[i + 2] = 'A' THEN 'X' WHEN w[i + 1] = 'H' THEN CASE WHEN w[i - 1] = 'S' THEN 'K' ELSE 'X' END WHEN w[i + 1] IN ('I', 'E', 'Y') THEN CASE WHEN w[i - 1] = 'S' THEN '' ELSE 'S' END ELSE 'K' END
      WHEN w[i] = 'D' THEN CASE WHEN w[i + 1] = 'G' AND w[i + 2] IN ('E', 'I', 'Y') THEN 'J' ELSE 'T' END
      WHEN w[i] = 'G' THEN CASE WHEN w[i + 1] = 'H' THEN CASE WHEN i + 1 >= length(w) OR w[i + 2] IN {_VOWEL} THEN CASE WHEN i > 1 AND i + 1 >= length(w) AND w[i - 1] = 'U' THEN 'F' ELSE 'K' END ELSE '' END
        WHEN w[i + 1] = 'N' THEN CASE WHEN i + 1 = length(w) OR substr(w, i + 2) = 'ED' THEN '' ELSE 'K' END WHEN w[i + 1] IN ('I', 'E', 'Y') AND w[i - 1] <> 'G' THEN 'J' ELSE 'K' END
      WHEN w[i] = 'H' THEN CASE WHEN w[i + 1] IN {_VOWEL} AND w[i - 1] NOT IN ('C', 'S', 'P', 'T', 'G') THEN 'H' ELSE '' END
      WHEN w[i] = 'K' THEN CASE WHEN w[i - 1] = 'C' THEN '' ELSE 'K' END
      WHEN w[i] = 'P' THEN CASE WHEN w[i + 1] = 'H' THEN 'F' ELSE 'P' END WHEN w[i] = 'Q' THEN 'K'
      WHEN w[i] = 'S' THEN CASE WHEN w[i + 1] = 'H' OR (w[i + 1] = 'I' AND w[i + 2] IN ('O', 'A')) THEN 'X' ELSE 'S' END
      WHEN w[i] = 'T' THEN CASE WHEN w[i + 1] = 'I' AND w[i + 2] IN ('O', 'A') THEN 'X' WHEN w[i + 1] = 'H' THEN '0' WHEN w[i + 1] = 'C' AND w[i + 2] = 'H' THEN '' ELSE 'T' END
      WHEN w[i] = 'V' THEN 'F' WHEN w[i] IN ('W', 'Y') THEN CASE WHEN w[i + 1] IN {_VOWEL} THEN w[i] ELSE '' END
      WHEN w[i] = 'X' THEN 'KS' WHEN w[i] = 'Z' THEN 'S' ELSE w[i] END}}}} END, {{{{'k': 1::BIGINT, 'o': ''}}}}).o"""
#: (text, snd) of the distinct texts of a table
SOUNDS = f"""(SELECT text, {METAPHONE} AS snd FROM (SELECT text, CASE WHEN w[1:2] IN ('KN', 'GN', 'PN', 'AE', 'WR') THEN w[2:] WHEN w[1] = 'X' THEN 'S' || w[2:] WHEN w[1:2] = 'WH' THEN 'W' || w[3:] ELSE w END AS w FROM (SELECT DISTINCT {{c}} AS text, regexp_replace(upper({{c}}), '[^A-Z]', '', 'g') AS w FROM {{t}})))"""
#: spans of undoubted lines that may be a misheard term: clean words ws, their letters h
SPANS = rf"""dbt AS (SELECT meeting_id, line FROM f WHERE score >= 2), tk AS (SELECT meeting_id, line, {TOKENS.format(c='text')} AS w FROM conv),
  te AS (SELECT *, list_transform(w, lambda x: regexp_matches(x, '[.?!]["'')]*$')) AS c, unnest(range(len(w))) AS a FROM tk ANTI JOIN dbt USING (meeting_id, line)),
  tz AS (SELECT *, unnest(range(a + 1, least(a + 5, len(w)) + 1)) AS z FROM te),
  tw AS (SELECT meeting_id, line, a, z, array_to_string(w[a + 1 : z], ' ') AS heard, list_transform(w[a + 1 : z], lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS ws FROM tz WHERE NOT list_contains(c[a + 1 : z - 1], true)),
  sp AS (SELECT *, array_to_string(ws, '') AS h FROM tw WHERE NOT (len(ws) = 1 AND length(ws[1]) < 4) AND len(list_filter(ws, lambda x: x NOT IN ({_in(W.COMMON_WORDS)}))) > 0)"""
#: pairs pr (q: letters of a span, w: of a term) scored: ss
SCORED = f"""mk AS (SELECT q, {MASKS.format(q='q')} AS masks FROM (SELECT DISTINCT q FROM pr)),
  s1 AS (SELECT pr.*, 200.0::DOUBLE * ({LCS}) / (length(q) + length(w)) AS spelling FROM pr JOIN mk USING (q)),
  s2 AS (SELECT s1.* EXCLUDE (q, w), s1.q AS h, s1.w AS t, a.snd AS q, b.snd AS w FROM s1 JOIN {SOUNDS.format(c='q', t='pr')} a ON a.text = s1.q JOIN {SOUNDS.format(c='w', t='pr')} b ON b.text = s1.w WHERE spelling >= 60),
  mq AS (SELECT q, {MASKS.format(q='q')} AS masks FROM (SELECT DISTINCT q FROM s2)),
  ss AS (SELECT s2.* EXCLUDE (q, w), CASE WHEN q = '' AND w = '' THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({LCS}) / (length(q) + length(w)) END AS sound FROM s2 JOIN mq USING (q))"""
HINTS = f"""{FLAGS}, {SPANS},
  wd AS (SELECT meeting_id, regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS c, min(line * 10000 + p) AS ord FROM (SELECT meeting_id, line, unnest(w) AS x, unnest(range(len(w))) AS p FROM tk) GROUP BY 1, 2 HAVING length(c) >= 12),
  tm AS (SELECT meeting_id, term, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) - 1 AS pos FROM (SELECT meeting_id, substr(c, 1, 6) || 'e' || substr(c, 7) AS term, min(ord) AS ord FROM wd GROUP BY 1, 2)),
  pr AS (SELECT DISTINCT meeting_id, h AS q, term AS w FROM (SELECT DISTINCT meeting_id, h FROM sp) JOIN tm USING (meeting_id) WHERE 2 * length(h) >= length(term) AND length(h) <= 2 * length(term) AND levenshtein(h, term) * 10 <= 4 * (length(h) + length(term))),
  {SCORED},
  fd AS (SELECT sp.meeting_id, line, a, z, heard, t AS term, pos, round_even((sound + spelling) / 2, 1) AS score, sound, spelling FROM sp JOIN ss USING (meeting_id, h) JOIN tm ON tm.meeting_id = sp.meeting_id AND tm.term = ss.t
    WHERE (sound + spelling) / 2 > 82 AND NOT contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || t || ' ') AND len(list_filter(ws, lambda x: contains(x, t))) = 0),
  ln AS (SELECT meeting_id, line, list({{'score': score, 'a': a, 'z': z, 'pos': pos, 'heard': heard, 'term': term, 'sound': sound, 'spelling': spelling}} ORDER BY score DESC, a, z, pos) AS x FROM fd GROUP BY 1, 2),
  kp AS (SELECT meeting_id, line, x[unnest(list_reduce(range(1, len(x) + 1), lambda kept, i: CASE WHEN len(list_filter(kept, lambda j: x[j].a < x[i].z AND x[i].a < x[j].z)) = 0 THEN list_append(kept, i) ELSE kept END, []::BIGINT[]))] AS x FROM ln),
  hints AS (SELECT meeting_id, line, x.a AS "first", x.z AS "end", x.heard AS heard, x.term AS term, x.pos AS term_pos, x.score AS score, x.sound AS sound, x.spelling AS spelling FROM kp QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY x.score DESC, line, x.a, x.z, x.pos) <= 15)"""


@query(f'WITH {HINTS} SELECT *, false AS unsure FROM hints')
def fuzzy_hints(spark, d):
    return glossary.find_hints(*_hint_inputs(spark, d))


#: the longest common stretch of the words in every window, the earliest on ties, then of what lies before and behind it
GUARD = rf"""{HINTS}, gl AS (SELECT meeting_id, line, arg_min({{'heard': heard, 'term': term}}, "first") AS h FROM hints GROUP BY 1, 2), gv AS (SELECT meeting_id, list(term) AS terms FROM tm GROUP BY 1), gh AS (SELECT meeting_id, line, list({{'a': "first", 'z': "end"}}) AS hs FROM hints GROUP BY 1, 2),
  gt AS (SELECT meeting_id, line, {TOKENS.format(c='text')} AS o, {TOKENS.format(c='replace(text, h.heard, h.term)')} AS w FROM conv JOIN gl USING (meeting_id, line)),
  gc AS (SELECT *, list_transform(o, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS oc, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS wc FROM gt),
  ge AS (SELECT a.meeting_id, a.line, i, j FROM (SELECT meeting_id, line, unnest(oc) AS x, unnest(range(len(oc))) AS i FROM gc) a JOIN (SELECT meeting_id, line, unnest(wc) AS x, unnest(range(len(wc))) AS j FROM gc) b USING (meeting_id, line, x)),
  gd AS (SELECT meeting_id, line, min(i) AS i0, min(j) AS j0, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY meeting_id, line, i - j ORDER BY i) AS run FROM ge) GROUP BY meeting_id, line, i - j, run),
  gw AS (SELECT meeting_id, line, 0::BIGINT AS alo, len(oc)::BIGINT AS ahi, 0::BIGINT AS blo, len(wc)::BIGINT AS bhi FROM gc UNION ALL
    SELECT meeting_id, line, x.a, x.b, x.c, x.d FROM (SELECT meeting_id, line, unnest([{{'a': alo, 'b': s, 'c': blo, 'd': s - i0 + j0}}, {{'a': s + k, 'b': ahi, 'c': s - i0 + j0 + k, 'd': bhi}}]) AS x
      FROM (SELECT gw.*, i0, j0, greatest(i0, alo, i0 + blo - j0) AS s, least(i0 + n, ahi, i0 + bhi - j0) - greatest(i0, alo, i0 + blo - j0) AS k FROM gw JOIN gd USING (meeting_id, line)) WHERE k > 0
      QUALIFY row_number() OVER (PARTITION BY meeting_id, line, alo, ahi, blo, bhi ORDER BY k DESC, s, s - i0 + j0) = 1) WHERE x.a < x.b AND x.c < x.d),
  gm AS (SELECT meeting_id, line, s AS i, s - i0 + j0 AS j, k FROM (SELECT gw.*, i0, j0, greatest(i0, alo, i0 + blo - j0) AS s, least(i0 + n, ahi, i0 + bhi - j0) - greatest(i0, alo, i0 + blo - j0) AS k FROM gw JOIN gd USING (meeting_id, line)) WHERE k > 0
    QUALIFY row_number() OVER (PARTITION BY meeting_id, line, alo, ahi, blo, bhi ORDER BY k DESC, s, s - i0 + j0) = 1 UNION ALL SELECT meeting_id, line, len(oc), len(wc), 0 FROM gc),
  gg AS (SELECT meeting_id, line, lag(i + k, 1, 0) OVER p AS a, i AS b, lag(j + k, 1, 0) OVER p AS c, j AS d FROM gm WINDOW p AS (PARTITION BY meeting_id, line ORDER BY i, j, k DESC)),
  gx AS (SELECT meeting_id, line, row_number() OVER (PARTITION BY meeting_id, line ORDER BY a, c) - 1 AS ord, o[a + 1 : b] AS bef, w[c + 1 : d] AS aft, list_concat(oc[a + 1 : b], wc[c + 1 : d]) AS cl, list_concat(o[a + 1 : b], w[c + 1 : d]) AS al, array_to_string(wc[c + 1 : d], '') AS res,
    a < b AND len(list_filter(hs, lambda h: h.a <= gg.a AND gg.b <= h.z)) > 0 AS hinted FROM gg JOIN gc USING (meeting_id, line) JOIN gh USING (meeting_id, line) WHERE a < b OR c < d),
  gp AS (SELECT DISTINCT res AS q, t AS w FROM (SELECT res, unnest(terms) AS t FROM gx JOIN gv USING (meeting_id) WHERE hinted AND res <> '')),
  gk AS (SELECT q, {MASKS.format(q='q')} AS masks FROM (SELECT DISTINCT q FROM gp)),
  gs AS (SELECT q, w, 200.0::DOUBLE * ({LCS}) / (length(q) + length(w)) AS score FROM gp JOIN gk USING (q)),
  gr AS (SELECT DISTINCT meeting_id, q FROM gs JOIN tm ON tm.term = gs.w WHERE score >= 90),
  gz AS (SELECT gx.*, CASE WHEN len(list_filter(cl, lambda x: x IN ({_in(W.NUMBER_WORDS)}))) > 0 OR len(list_filter(al, lambda x: regexp_matches(x, '\p{{Nd}}'))) > 0 THEN '{W.GUARD_REASONS[0]}'
    WHEN len(list_filter(cl, lambda x: x IN ({_in(W.NEGATION_WORDS)}))) > 0 OR len(list_filter(al, lambda x: regexp_matches(lower(x), 'n''t[.,!?]*$'))) > 0 THEN '{W.GUARD_REASONS[1]}'
    WHEN len(aft) = 0 THEN 'deletes words' WHEN NOT hinted THEN '{W.GUARD_REASONS[2]}' WHEN gr.q IS NULL THEN '{W.GUARD_REASONS[3]}' END AS no FROM gx LEFT JOIN gr ON gr.meeting_id = gx.meeting_id AND gr.q = gx.res)"""


@query(f"""WITH RECURSIVE {GUARD} SELECT meeting_id, line, CAST(ord AS INT) AS ord, array_to_string(bef, ' ') AS before, array_to_string(aft, ' ') AS after, CASE WHEN no IS NULL THEN 'applied' ELSE 'blocked' END AS status, coalesce(no, 'matches a glossary term') AS reason FROM gz""")
def guard_edits(spark, d):
    lines, terms, doubtful = _hint_inputs(spark, d)
    # read several times below
    hints = stored(glossary.find_hints(lines, terms, doubtful))
    answer = hints.groupBy("meeting_id", "line").agg(F.min_by(F.struct("heard", "term"), "first").alias("h")).join(lines.select("meeting_id", "line", "text"), ["meeting_id", "line"])
    answer = answer.groupBy("meeting_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("line").cast("string"), F.replace("text", F.col("h.heard"), F.col("h.term"))))).alias("lines"))).alias("reply"))
    return glossary.refine(lines, terms, hints, answer)["edits"]


def _quotes(lines):
    """All of what was said, six words a quote."""
    # split once a line, not once a quote
    said = lines.select("meeting_id", F.split(X.norm(F.col("text")), " ").alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(6)), lambda i: F.array_join(F.slice("w", i + 1, 6), " "))
    # by meeting, as they are looked up; a line without words gives an empty quote
    return said.select("meeting_id", F.explode(cut).alias("quote")).where("quote != ''").repartition("meeting_id").distinct()


QUOTED = f"""n AS (SELECT meeting_id, line, {_norm('text')} AS n FROM {{src}}), k AS (SELECT *, string_split(n, ' ') AS w FROM n WHERE n <> ''),
  o AS (SELECT *, coalesce(sum(length(n) + 1) OVER (PARTITION BY meeting_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM k),
  t AS (SELECT meeting_id, string_agg(n, ' ' ORDER BY line) AS text FROM k GROUP BY 1),
  q AS (SELECT DISTINCT meeting_id, array_to_string(w[i + 1 : i + 6], ' ') AS quote FROM (SELECT meeting_id, w, unnest(range(0, len(w), 6)) AS i FROM k))"""
@query(f"""WITH {DOCS}, {QUOTED.format(src='doc')},
  f AS (SELECT meeting_id, quote, instr(text, quote) - 1 AS pos FROM q JOIN t USING (meeting_id))
  SELECT meeting_id, quote, CAST(pos AS INT) AS pos, CAST((SELECT max(o.line) FROM o WHERE o.meeting_id = f.meeting_id AND o.off <= f.pos) AS INT) AS line FROM f WHERE pos >= 0""")
def quote_exact_line(spark, d):
    lines = R.document_lines(spark, d).withColumns({"start": F.lit(None).cast("double"), "label": F.lit(None).cast("string")})
    none = lines.select("meeting_id", "line").where("false")
    return record.find_quotes(_quotes(lines), record.quote_index(lines, none), record.meeting_labels(lines), exact_only=True).select("meeting_id", "quote", "pos", "line")


# every window of a quote's length, shorter at the ends of a text, that holds enough of the quote's short strings near their place
@query(f"""WITH {CONV}, {QUOTED.format(src='conv')},
  z AS (SELECT DISTINCT meeting_id, substr(quote, 1, 12) || substr(quote, 14) AS quote, {_norm('substr(quote, 1, 12) || substr(quote, 14)')} AS q FROM q),
  x AS (SELECT meeting_id, quote, q, length(q) AS m, length(text) AS n, length(q) // 10 AS d, text, instr(text, q) - 1 AS pos FROM z JOIN t USING (meeting_id) WHERE q <> ''),
  a AS (SELECT *, least(4, m // (2 * d + 1)) AS g FROM x WHERE pos < 0),
  tg AS (SELECT meeting_id, g, i, substr(text, i + 1, g) AS s FROM (SELECT meeting_id, text, g, unnest(range(length(text) - g + 1)) AS i FROM t, range(3, 5) r(g))),
  qg AS (SELECT meeting_id, quote, n, m, d, g, j, substr(q, j + 1, g) AS s FROM (SELECT *, unnest(range(m - g + 1)) AS j FROM a WHERE d > 0)),
  e AS (SELECT meeting_id, quote, s FROM (SELECT meeting_id, quote, n, m, d, g, unnest(range(i - j - d, i - j + d + 1)) AS s FROM qg JOIN tg USING (meeting_id, g, s)) WHERE s BETWEEN 0 AND n - m GROUP BY ALL HAVING count(*) >= greatest(1, any_value(m - g + 1 - d * (2 * g - 1)))
    UNION ALL SELECT meeting_id, quote, unnest(list_concat(range(-(m * 2 // 11), 0), range(n - m + 1, n - m + 1 + m * 2 // 11))) FROM a),
  c AS (SELECT meeting_id, quote, q, s, greatest(s, 0) AS lo, substr(text, greatest(s, 0) + 1, least(s + m, n) - greatest(s, 0)) AS w FROM e JOIN a USING (meeting_id, quote)),
  k2 AS (SELECT q, {MASKS.format(q='q')} AS masks FROM (SELECT DISTINCT q FROM c)),
  r AS (SELECT meeting_id, quote, s, lo, 200.0::DOUBLE * ({LCS}) / (length(q) + length(w)) AS score FROM c JOIN k2 USING (q)),
  f AS (SELECT meeting_id, quote, pos FROM x WHERE pos >= 0 UNION ALL SELECT meeting_id, quote, arg_min(lo, (-score, s)) FROM r WHERE score >= 90 GROUP BY 1, 2)
  SELECT meeting_id, quote, CAST(pos AS INT) AS pos, CAST((SELECT max(o.line) FROM o WHERE o.meeting_id = f.meeting_id AND o.off <= f.pos) AS INT) AS line FROM f""")
def quote_fuzzy_line(spark, d):
    lines = R.conversation_lines(spark, d)
    none = lines.select("meeting_id", "line").where("false")
    # a letter of each is lost
    quotes = _quotes(lines).select("meeting_id", F.concat(F.substring("quote", 1, 12), F.expr("substring(quote, 14)")).alias("quote")).distinct()
    return record.find_quotes(quotes, record.quote_index(lines, none), record.meeting_labels(lines)).select("meeting_id", "quote", "pos", "line")


@query(f"""WITH {CONV}, c AS (SELECT *, length(text) % 7 = 0 AS dbt, {_norm('text')} AS n FROM conv)
  SELECT a.meeting_id, a.line, (SELECT arg_max(b.speaker, b.line) FROM c b WHERE b.meeting_id = a.meeting_id AND b.line BETWEEN a.line - 4 AND a.line - 1 AND NOT b.dbt AND b.speaker <> a.speaker) AS before,
    (SELECT arg_min(b.speaker, b.line) FROM c b WHERE b.meeting_id = a.meeting_id AND b.line BETWEEN a.line + 1 AND a.line + 4 AND NOT b.dbt AND b.speaker <> a.speaker AND b.n NOT IN ({_in(W.NAMING_BACKCHANNELS)})) AS after FROM c a""")
def neighbour_speakers(spark, d):
    lines = R.conversation_lines(spark, d)
    return names.neighbour_speakers(lines, lines.where(F.length("text") % 7 == 0).select("meeting_id", "line"))


@query(rf"""WITH {CONV}, n AS (SELECT *, {_norm('text')} AS n FROM conv)
  SELECT meeting_id, line, regexp_matches(n, '{W.NEGATED}') AS negated, regexp_matches(n, '{W.HEDGED}') AS hedged, n IN ({_in(W.RECORD_BACKCHANNELS)}) AS backchannel,
    n <> '' AND NOT regexp_matches(n, '{W.HEDGED}') AND NOT contains(text, '?') AND NOT regexp_matches(n, '{W.NEGATED}') AS settled FROM n""")
def wording_class(spark, d):
    n = X.norm(F.col("text"))
    return R.conversation_lines(spark, d).select("meeting_id", "line", X.negated(n).alias("negated"), X.hedged(n).alias("hedged"), n.isin(*W.RECORD_BACKCHANNELS).alias("backchannel"), X.settled(F.col("text"), F.lit("")).alias("settled"))


@query("""WITH q AS (SELECT conv_id AS meeting_id, turn % 2 AS item, CASE length(text) % 3 WHEN 0 THEN 'agreement' WHEN 1 THEN 'rejection' ELSE 'settled' END AS kind, length(text) AS pos FROM conversations),
  g AS (SELECT meeting_id, item, coalesce(max(pos) FILTER (kind = 'agreement'), -1) AS y, coalesce(max(pos) FILTER (kind = 'rejection'), -1) AS n, coalesce(max(pos) FILTER (kind = 'settled'), -1) AS s FROM q GROUP BY 1, 2)
  SELECT meeting_id, item, CASE WHEN y > n THEN 'agreed' WHEN s > n THEN 'uncontested' WHEN n >= 0 THEN 'rejected' ELSE 'open' END AS status FROM g""")
def decision_status(spark, d):
    size = F.length("text")
    kind = F.when(size % 3 == 0, "agreement").when(size % 3 == 1, "rejection").otherwise("settled")
    return record.decision_status(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("meeting_id"), (F.col("turn") % 2).alias("item"), kind.alias("kind"), size.alias("pos")))


#: claims from every word of four letters or more: names said and addressed, roles, and roles given to the next word's name
CLAIMED = f"""{CONV}, vw AS (SELECT meeting_id, line, CASE speaker WHEN 'user' THEN 'S1' WHEN 'assistant' THEN 'S2' ELSE 'S3' END AS speaker, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS ws FROM conv),
  ve AS (SELECT meeting_id, line * 10000 + i AS ord, speaker, ws[i + 1] AS w, coalesce(ws[i + 2], '') AS nx, ['self', 'addressed', 'role', 'assigned_role'][(line + i) % 4 + 1] AS kind FROM (SELECT *, unnest(range(len(ws))) AS i FROM vw))"""
# names: level after level with lists of who is settled, who holds a name and which names are gone; roles likewise
@query(f"""WITH RECURSIVE {CLAIMED}, sp AS (SELECT DISTINCT meeting_id, speaker FROM vw),
  np AS (SELECT meeting_id, speaker, w AS key, sum(CASE kind WHEN 'self' THEN 3 ELSE 1 END) AS pts, bool_or(kind = 'self') AS self FROM ve WHERE kind IN ('self', 'addressed') GROUP BY 1, 2, 3),
  nr AS (SELECT *, list_filter(list(speaker) OVER (PARTITION BY meeting_id, key, pts), lambda x: x <> speaker) AS riv FROM np),
  ng AS (SELECT meeting_id, pts, speaker, list({{'key': key, 'name': upper(key[1]) || key[2:], 'self': self, 'riv': list_sort(riv)}} ORDER BY key) AS opt FROM nr GROUP BY 1, 2, 3),
  nl AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY pts DESC, speaker) AS i FROM ng),
  w0 AS (SELECT meeting_id, 0::BIGINT AS i, []::VARCHAR[] AS settled, []::VARCHAR[] AS holders, []::VARCHAR[] AS gone, []::VARCHAR[] AS who, NULL::VARCHAR AS name, NULL::VARCHAR AS source, NULL::VARCHAR AS confidence, NULL::VARCHAR AS note FROM (SELECT DISTINCT meeting_id FROM nl)),
  w1 AS (SELECT * FROM w0 UNION ALL
    SELECT meeting_id, i, CASE WHEN act = 'several' OR act = 'given' THEN list_append(settled, speaker) ELSE settled END, CASE WHEN act = 'given' THEN list_append(holders, speaker) ELSE holders END, CASE WHEN act IN ('given', 'shared') THEN list_append(gone, free[1].key) ELSE gone END,
      CASE act WHEN 'shared' THEN list_prepend(speaker, rv) WHEN 'none' THEN [] ELSE [speaker] END, CASE WHEN act = 'given' THEN free[1].name END, CASE WHEN act = 'given' THEN CASE WHEN free[1].self THEN 'self-introduction' ELSE 'addressed' END END, CASE WHEN act = 'given' THEN CASE WHEN pts >= 2 THEN 'high' ELSE 'low' END END,
      CASE act WHEN 'several' THEN 'unclear: ' || array_to_string(list_sort(list_transform(opt, lambda o: o.name)), ' or ') WHEN 'shared' THEN 'unclear: ' || free[1].name || ' could be ' || array_to_string(list_transform(list_prepend(speaker, rv), lambda x: 'Speaker ' || x[2:]), ' or ') END
    FROM (SELECT *, CASE WHEN list_contains(settled, speaker) OR len(free) = 0 THEN 'none' WHEN len(free) > 1 THEN 'several' WHEN len(rv) > 0 THEN 'shared' ELSE 'given' END AS act
      FROM (SELECT *, list_filter(free[1].riv, lambda x: NOT list_contains(holders, x)) AS rv FROM (SELECT nl.meeting_id, nl.i, pts, speaker, opt, settled, holders, gone, list_filter(opt, lambda o: NOT list_contains(gone, o.key)) AS free FROM w1 JOIN nl ON nl.meeting_id = w1.meeting_id AND nl.i = w1.i + 1)))),
  wn AS (SELECT meeting_id, speaker, arg_max(name, i) FILTER (name IS NOT NULL) AS name, arg_max(source, i) FILTER (name IS NOT NULL) AS source, arg_max(confidence, i) FILTER (name IS NOT NULL) AS confidence, arg_max(note, i) FILTER (note IS NOT NULL) AS note FROM (SELECT *, unnest(who) AS speaker FROM w1) GROUP BY 1, 2),
  rl AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY pts DESC, speaker) AS i FROM (SELECT meeting_id, speaker, pts, list(role ORDER BY role) AS roles FROM (SELECT meeting_id, speaker, w AS role, count(*) AS pts FROM ve WHERE kind = 'role' GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)),
  r1 AS (SELECT meeting_id, 0::BIGINT AS i, []::VARCHAR[] AS settled, []::VARCHAR[] AS gone, NULL::VARCHAR AS speaker, NULL::VARCHAR AS role FROM (SELECT DISTINCT meeting_id FROM rl) UNION ALL
    SELECT meeting_id, i, CASE WHEN act THEN list_append(settled, sp) ELSE settled END, CASE WHEN act AND len(free) = 1 THEN list_append(gone, free[1]) ELSE gone END, CASE WHEN act AND len(free) = 1 THEN sp END, CASE WHEN act AND len(free) = 1 THEN free[1] END
    FROM (SELECT *, len(free) > 0 AND NOT list_contains(settled, sp) AS act FROM (SELECT rl.meeting_id, rl.i, rl.speaker AS sp, settled, gone, list_filter(roles, lambda x: NOT list_contains(gone, x)) AS free FROM r1 JOIN rl ON rl.meeting_id = r1.meeting_id AND rl.i = r1.i + 1))),
  ro AS (SELECT meeting_id, speaker, role FROM r1 WHERE role IS NOT NULL),
  gv AS (SELECT meeting_id, w AS key, arg_min(nx, ord) AS role, min(ord) AS ord FROM ve WHERE kind = 'assigned_role' GROUP BY 1, 2),
  wi AS (SELECT gv.meeting_id, wn.speaker, gv.role, row_number() OVER (PARTITION BY gv.meeting_id ORDER BY ord) AS i FROM gv JOIN wn ON wn.meeting_id = gv.meeting_id AND lower(wn.name) = gv.key WHERE NOT EXISTS (SELECT 1 FROM ro WHERE ro.meeting_id = gv.meeting_id AND ro.speaker = wn.speaker)),
  x1 AS (SELECT meeting_id, 0::BIGINT AS i, (SELECT coalesce(list(role), []) FROM ro WHERE ro.meeting_id = s.meeting_id) AS gone, []::VARCHAR[] AS had, NULL::VARCHAR AS speaker, NULL::VARCHAR AS role FROM (SELECT DISTINCT meeting_id FROM wi) s UNION ALL
    SELECT wi.meeting_id, wi.i, CASE WHEN NOT list_contains(gone, wi.role) AND NOT list_contains(had, wi.speaker) THEN list_append(gone, wi.role) ELSE gone END, CASE WHEN NOT list_contains(gone, wi.role) AND NOT list_contains(had, wi.speaker) THEN list_append(had, wi.speaker) ELSE had END,
      CASE WHEN NOT list_contains(gone, wi.role) AND NOT list_contains(had, wi.speaker) THEN wi.speaker END, wi.role FROM x1 JOIN wi ON wi.meeting_id = x1.meeting_id AND wi.i = x1.i + 1)
  SELECT sp.meeting_id, sp.speaker, coalesce(name, '') AS name, coalesce(source, '') AS source, coalesce(confidence, '') AS confidence, coalesce(note, '') AS note, coalesce(ro.role, x1.role, '') AS role, CASE WHEN ro.role IS NOT NULL THEN 'self' WHEN x1.role IS NOT NULL THEN 'named by others' ELSE '' END AS role_source
  FROM sp LEFT JOIN wn USING (meeting_id, speaker) LEFT JOIN ro USING (meeting_id, speaker) LEFT JOIN x1 ON x1.meeting_id = sp.meeting_id AND x1.speaker = sp.speaker""")
def greedy_names(spark, d):
    lines = R.conversation_lines(spark, d)
    voice = F.concat(F.lit("S"), F.when(F.col("speaker") == "user", 1).when(F.col("speaker") == "assistant", 2).otherwise(3))
    words = lines.select("meeting_id", "line", voice.alias("speaker"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)).alias("ws"))
    kind = F.get(F.array(*map(F.lit, ("self", "addressed", "role", "assigned_role"))), F.pmod(F.col("line") + F.col("i"), F.lit(4)))
    rows = words.select("*", F.posexplode("ws").alias("i", "w")).withColumn("kind", kind)
    given = F.col("kind") == "assigned_role"
    name = F.when(F.col("kind") == "role", F.col("w")).otherwise(F.initcap("w"))
    evidence = rows.select("meeting_id", (F.col("line") * 10000 + F.col("i")).alias("ord"), F.when(given, "").otherwise(F.col("speaker")).alias("speaker"), name.alias("name"), "kind", F.lit(True).alias("accepted"), F.when(given, F.coalesce(F.get("ws", F.col("i") + 1), F.lit(""))).otherwise("").alias("role"))
    return names.assign_names_and_roles(words.select("meeting_id", "speaker").distinct(), evidence)


@query("""SELECT source, count(*) AS proposed, count_if(n_chars > 1000) AS kept, round_even(count_if(n_chars > 1000)::DOUBLE / nullif(count(*), 0), 3) AS rate FROM documents GROUP BY 1""")
def support_rate(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("proposed"), F.count_if(F.col("n_chars") > 1000).alias("kept")).withColumn("rate", F.bround(F.col("kept") / F.nullif(F.col("proposed"), F.lit(0)), 3))


@query(f"""WITH e AS (SELECT conv_id AS meeting_id, CAST(turn % 3 AS INT) AS line, turn * 2 + k AS turn, text || ['', '!'][k + 1] AS quote FROM conversations, range(2) t(k)),
  u AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, line, {_norm('quote')} ORDER BY turn) AS r FROM e)
  SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY line, turn) - 1 AS INT) AS ord, line, quote FROM u WHERE r = 1""")
def evidence_dedup(spark, d):
    # every line is quoted twice, once with a mark behind it
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    quote = F.concat("text", F.when(F.col("k") == 1, "!").otherwise(""))
    e = c.select(F.col("conv_id").alias("meeting_id"), (F.col("turn") * 2 + F.col("k")).alias("turn"), F.struct(F.lit("task").alias("role"), quote.alias("quote"), (F.col("turn") % 3).cast("int").alias("line"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("string").alias("speaker")).alias("e"))
    g = e.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "e"))), lambda x: x["e"]).alias("ev"))
    return g.select("meeting_id", F.posexplode(record.unique_evidence(F.col("ev"))).alias("ord", "e")).select("meeting_id", "ord", "e.line", "e.quote")


def _drafts(spark, d):
    """A draft for each conversation: every third turn is a proposal, the next one agrees or objects."""
    lines = R.conversation_lines(spark, d)
    nxt = lines.select("meeting_id", (F.col("line") - 1).alias("line"), F.col("text").alias("reply"))
    rows = lines.join(nxt, ["meeting_id", "line"], "left").withColumn("q", F.col("text"))
    item = F.struct(F.col("line"), F.struct(F.concat(F.lit("Decide "), F.col("line")).alias("text"), F.col("q").alias("proposal_quote"), F.array(F.coalesce("reply", F.lit(""))).alias("agreement_quotes"), F.array(F.when(F.col("line") % 2 == 0, F.lit("never said this at all")).otherwise(F.lit("mm hmm"))).alias("rejection_quotes"), F.lit("").alias("settled_quote")).alias("x"))
    act = F.struct(F.col("line"), F.struct(F.concat(F.lit("Do "), F.col("line")).alias("task"), F.col("q").alias("task_quote"), F.col("speaker").alias("owner"), F.lit("not there").alias("owner_quote"), F.lit("unspecified").alias("deadline"), F.lit("").alias("deadline_quote"), F.coalesce("reply", F.lit("")).alias("agreement_quote")).alias("x"))
    ask = F.struct(F.col("line"), F.struct(F.lit("What then").alias("question"), F.col("q").alias("quote")).alias("x"))
    take = lambda c, k: F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("line") % 3 == k, c)), lambda z: z.isNotNull())), lambda z: z["x"])
    one = rows.groupBy("meeting_id").agg(take(item, 0).alias("decisions"), take(act, 1).alias("action_items"), take(ask, 2).alias("open_questions"))
    empty = F.array()
    draft = F.struct(empty.cast("array<struct<fact:string,quote:string>>").alias("given"), F.lit("A summary").alias("summary"), F.array(F.lit("One point")).alias("minutes"), empty.cast("array<struct<topic:string,verdict:string,quote:string>>").alias("assessments"), "decisions", "action_items", "open_questions")
    return lines, one.select("meeting_id", draft.cast(record.DRAFT).alias("draft"))


def _record(spark, d):
    lines, drafts = _drafts(spark, d)
    return lines, drafts, record.verify(drafts, lines, lines.select("meeting_id", "line").where("false"), keep=stored)


def _volunteers(n: str) -> str:
    """The pattern told without looking ahead: what is only thought or can't be done is taken out first."""
    head, thought = W.VOLUNTEER.split("(?! (just", 1)
    head = head.replace(r"(?! t\b)", "")
    return rf"regexp_matches(regexp_replace(regexp_replace({n}, '\bi can t\b', ' # ', 'g'), '{head} (just{thought[:-1]}', ' # ', 'g'), '{head}')"


def _same(a: str, b: str) -> str:
    return f"coalesce({a} <> '' AND {b} <> '' AND {_norm(a)} = {_norm(b)}, false)"


def _in_quote(value: str, quote: str) -> str:
    return f"(trim({value}) <> '' AND lower(trim({value})) <> '{W.UNSPECIFIED}' AND contains({_norm(quote)}, {_norm(value)}))"


MISSED = "never said this at all"
#: drafts of every meeting, where its quotes stand, and what the rules make of the items: dk decisions, ak actions, qk questions
RECORD = f"""{CONV}, rn AS (SELECT *, {_norm('text')} AS n FROM (SELECT meeting_id, line, speaker, CASE WHEN line % 4 = 0 AND meeting_id % 2 = 0 THEN text || ' So the ' || speaker || ' does it by Friday.' WHEN line % 4 = 1 THEN 'I''ll do it. ' || text WHEN line % 4 = 3 THEN 'Okay.' ELSE text END AS text FROM conv)),
  rk AS (SELECT *, coalesce(sum(length(n) + 1) OVER (PARTITION BY meeting_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM rn WHERE n <> ''), rt AS (SELECT meeting_id, string_agg(n, ' ' ORDER BY line) AS txt FROM rk GROUP BY 1),
  rd AS (SELECT a.meeting_id, a.line, row_number() OVER (PARTITION BY a.meeting_id, a.line % 3 ORDER BY a.line) - 1 AS item, a.line % 3 AS kind, a.text AS t, a.speaker, coalesce(b.text, '') AS r1, coalesce(c.text, '') AS r2, coalesce(string_split(a.n, ' ')[3], '') AS w3
    FROM rn a LEFT JOIN rn b ON b.meeting_id = a.meeting_id AND b.line = a.line + 1 LEFT JOIN rn c ON c.meeting_id = a.meeting_id AND c.line = a.line + 2),
  de AS (SELECT meeting_id, item, 'Decide ' || line AS title, CASE WHEN line % 9 = 6 THEN '{MISSED}' ELSE t END AS p, CASE WHEN line % 6 = 0 THEN ['mm hmm', t] ELSE [r1, 'mm hmm', t] END AS yes, CASE WHEN line % 4 = 2 OR meeting_id % 3 = 0 THEN [r2] ELSE ['{MISSED}'] END AS no, CASE line % 4 WHEN 0 THEN r2 WHEN 2 THEN r1 || '?' ELSE '' END AS settled FROM rd WHERE kind = 0),
  ac AS (SELECT meeting_id, item, 'Do ' || line AS title, t, speaker AS owner, CASE WHEN line % 2 = 0 THEN t ELSE 'not there' END AS oq, CASE line % 4 WHEN 0 THEN 'Friday' WHEN 1 THEN w3 WHEN 2 THEN 'tomorrow' ELSE 'Unspecified' END AS deadline, r1 AS aq FROM rd WHERE kind = 1),
  qu AS (SELECT meeting_id, item, 'What then' AS title, CASE WHEN line % 5 = 0 THEN '{MISSED}' ELSE t END AS q FROM rd WHERE kind = 2),
  dq AS (SELECT meeting_id, item, 'yes' AS side, unnest(yes) AS q FROM de UNION ALL SELECT meeting_id, item, 'no', unnest(no) FROM de),
  qs AS (SELECT meeting_id, q FROM dq UNION SELECT meeting_id, unnest([p, settled]) FROM de UNION SELECT meeting_id, unnest([t, oq, aq]) FROM ac UNION SELECT meeting_id, q FROM qu),
  pl AS (SELECT meeting_id, q, instr(txt, {_norm('q')}) - 1 AS pos FROM qs JOIN rt USING (meeting_id) WHERE {_norm('q')} <> '' AND contains(txt, {_norm('q')})),
  ps AS (SELECT *, (SELECT arg_max(rk.speaker, rk.line) FROM rk WHERE rk.meeting_id = pl.meeting_id AND rk.off <= pl.pos) AS who FROM pl),
  dj AS (SELECT dq.*, s.pos, CASE WHEN {_norm('dq.q')} IN ({_in(W.RECORD_BACKCHANNELS)}) THEN 'backchannel' WHEN s.pos IS NULL THEN 'not found' WHEN side = 'yes' AND {_same('s.who', 'o.who')} THEN 'own' END AS note
    FROM dq JOIN de USING (meeting_id, item) LEFT JOIN ps s ON s.meeting_id = dq.meeting_id AND s.q = dq.q LEFT JOIN ps o ON o.meeting_id = dq.meeting_id AND o.q = p),
  dl AS (SELECT meeting_id, item, coalesce(max(pos) FILTER (side = 'yes' AND note IS NULL), -1) AS ly, coalesce(max(pos) FILTER (side = 'no' AND note IS NULL), -1) AS ln, count(note) AS nn FROM dj GROUP BY 1, 2),
  ds AS (SELECT de.*, ly, ln, nn, ly <= ln AND trim(settled) <> '' AS asked, {_norm('settled')} <> '' AND NOT regexp_matches({_norm('settled')}, '{W.HEDGED}') AND NOT contains(settled, '?') AND (NOT regexp_matches({_norm('settled')}, '{W.NEGATED}') OR regexp_matches({_norm('title')}, '{W.NEGATED}')) AS worded, s.pos AS sp, o.pos IS NOT NULL AS kept
    FROM de JOIN dl USING (meeting_id, item) LEFT JOIN ps s ON s.meeting_id = de.meeting_id AND s.q = settled LEFT JOIN ps o ON o.meeting_id = de.meeting_id AND o.q = p),
  dk AS (SELECT meeting_id, item, title, kept, CASE WHEN ly > ln THEN 'agreed' WHEN asked AND worded AND coalesce(sp > ln, false) THEN 'uncontested' WHEN ln >= 0 THEN 'rejected' ELSE 'open' END AS status, nn + CASE WHEN asked AND (NOT worded OR sp IS NULL) THEN 1 ELSE 0 END AS notes FROM ds),
  a1 AS (SELECT ac.*, x.pos IS NOT NULL AS kept, o.who IS NOT NULL AND ({_in_quote('owner', 'oq')} OR ({_volunteers(_norm('oq'))} AND {_same('o.who', 'owner')})) AS shown, x.pos IS NOT NULL AND {_in_quote('deadline', 't')} AS dated,
      coalesce(CASE WHEN {_volunteers(_norm('aq'))} THEN y.who END, CASE WHEN {_volunteers(_norm('oq'))} THEN o.who END, CASE WHEN {_volunteers(_norm('t'))} THEN x.who END) AS offered, CASE WHEN {_norm('aq')} NOT IN ({_in(W.RECORD_BACKCHANNELS)}) THEN y.who END AS accepted
    FROM ac LEFT JOIN ps x ON x.meeting_id = ac.meeting_id AND x.q = t LEFT JOIN ps o ON o.meeting_id = ac.meeting_id AND o.q = oq LEFT JOIN ps y ON y.meeting_id = ac.meeting_id AND y.q = aq),
  a2 AS (SELECT *, CASE WHEN shown THEN owner ELSE coalesce(offered, '{W.UNSPECIFIED}') END AS who, NOT shown AND offered IS NOT NULL AS instead, NOT dated AND lower(trim(deadline)) <> '{W.UNSPECIFIED}' AS undated, trim(aq) <> '' AS answered FROM a1),
  ak AS (SELECT meeting_id, item, title, kept, who AS owner, CASE WHEN dated THEN deadline ELSE '{W.UNSPECIFIED}' END AS deadline, instead, undated, (NOT shown)::INT - instead::INT AS lost,
      CASE WHEN who = '{W.UNSPECIFIED}' THEN 'unassigned' WHEN answered AND {_same('accepted', 'who')} THEN 'agreed' ELSE 'proposed' END AS status,
      (NOT shown)::INT + undated::INT + instead::INT + (who <> '{W.UNSPECIFIED}' AND answered AND NOT {_same('accepted', 'who')})::INT AS notes FROM a2),
  qk AS (SELECT qu.*, ps.pos IS NOT NULL AS kept FROM qu LEFT JOIN ps ON ps.meeting_id = qu.meeting_id AND ps.q = qu.q)"""


def _told(spark, d):
    """Lines some of which agree or volunteer, and a draft of each meeting whose quotes are right, somebody else's or never said."""
    lines = R.conversation_lines(spark, d)
    text = F.when((F.col("line") % 4 == 0) & (F.col("meeting_id") % 2 == 0), F.concat("text", F.lit(" So the "), "speaker", F.lit(" does it by Friday."))).when(F.col("line") % 4 == 1, F.concat(F.lit("I'll do it. "), "text")).when(F.col("line") % 4 == 3, "Okay.").otherwise(F.col("text"))
    lines = lines.withColumn("text", text)
    later = lambda k: lines.select("meeting_id", (F.col("line") - k).alias("line"), F.col("text").alias(f"r{k}"))
    rows = lines.join(later(1), ["meeting_id", "line"], "left").join(later(2), ["meeting_id", "line"], "left").na.fill("", ["r1", "r2"])
    n, missed, none = F.col("line"), F.lit(MISSED), F.lit("")
    named = lambda **fields: F.struct("line", F.struct(*(c.alias(k) for k, c in fields.items())).alias("x"))
    decision = named(
        text=F.concat(F.lit("Decide "), n), proposal_quote=F.when(n % 9 == 6, missed).otherwise(F.col("text")), agreement_quotes=F.when(n % 6 == 0, F.array(F.lit("mm hmm"), F.col("text"))).otherwise(F.array(F.col("r1"), F.lit("mm hmm"), F.col("text"))),
        rejection_quotes=F.when((n % 4 == 2) | (F.col("meeting_id") % 3 == 0), F.array("r2")).otherwise(F.array(missed)), settled_quote=F.when(n % 4 == 0, F.col("r2")).when(n % 4 == 2, F.concat("r1", F.lit("?"))).otherwise(none),
    )
    third = F.coalesce(F.get(F.split(X.norm(F.col("text")), " "), F.lit(2)), none)
    action = named(
        task=F.concat(F.lit("Do "), n), task_quote=F.col("text"), owner=F.col("speaker"), owner_quote=F.when(n % 2 == 0, F.col("text")).otherwise("not there"),
        deadline=F.when(n % 4 == 0, "Friday").when(n % 4 == 1, third).when(n % 4 == 2, "tomorrow").otherwise("Unspecified"), deadline_quote=F.col("text"), agreement_quote=F.col("r1"),
    )
    question = named(question=F.lit("What then"), quote=F.when(n % 5 == 0, missed).otherwise(F.col("text")))
    take = lambda c, k, kind: F.transform(F.array_sort(F.collect_list(F.when(n % 3 == k, c))), lambda z: z["x"]).cast(record.kind_of(kind)).alias(kind)
    listed = rows.groupBy("meeting_id").agg(take(decision, 0, "decisions"), take(action, 1, "action_items"), take(question, 2, "open_questions"))
    empty = lambda kind: F.array().cast(record.kind_of(kind)).alias(kind)
    draft = F.struct(empty("given"), F.lit("A summary").alias("summary"), F.array(F.lit("One point")).alias("minutes"), empty("assessments"), "decisions", "action_items", "open_questions")
    return record.verify(listed.select("meeting_id", draft.cast(record.DRAFT).alias("draft")), lines, lines.select("meeting_id", "line").where("false"), keep=stored)


@query(f"""WITH {RECORD}, dc AS (SELECT meeting_id, count(*) AS n, count(*) FILTER (kept) AS k, count(*) FILTER (kept AND status = 'agreed') AS a, count(*) FILTER (kept AND status = 'uncontested') AS u, CAST(coalesce(sum(notes) FILTER (kept), 0) AS BIGINT) AS i FROM dk GROUP BY 1),
  aa AS (SELECT meeting_id, count(*) AS n, count(*) FILTER (kept) AS k, count(*) FILTER (kept AND status = 'agreed') AS a, CAST(coalesce(sum(lost) FILTER (kept), 0) AS BIGINT) AS lost, count(*) FILTER (kept AND undated) AS undated, count(*) FILTER (kept AND instead) AS instead FROM ak GROUP BY 1), qq AS (SELECT meeting_id, count(*) AS n, count(*) FILTER (kept) AS k FROM qk GROUP BY 1)
  SELECT meeting_id, coalesce(d.n, 0) AS decisions_proposed, coalesce(d.k, 0) AS decisions_kept, coalesce(d.a, 0) AS decisions_agreed, coalesce(d.u, 0) AS decisions_uncontested, coalesce(d.i, 0) AS quotes_ignored, coalesce(a.n, 0) AS actions_proposed, coalesce(a.k, 0) AS actions_kept, coalesce(a.a, 0) AS actions_agreed,
    coalesce(a.lost, 0) AS owners_removed, coalesce(a.undated, 0) AS deadlines_removed, coalesce(a.instead, 0) AS owners_from_speaker, 0::BIGINT AS owners_from_role, coalesce(q.n, 0) AS open_questions_proposed, coalesce(q.k, 0) AS open_questions_kept, 0::BIGINT AS given_proposed, 0::BIGINT AS given_kept, 0::BIGINT AS assessments_proposed, 0::BIGINT AS assessments_kept,
    round_even((coalesce(d.k, 0) + coalesce(a.k, 0) + coalesce(q.k, 0))::DOUBLE / nullif(coalesce(d.n, 0) + coalesce(a.n, 0) + coalesce(q.n, 0), 0), 3) AS evidence_support_rate
  FROM (SELECT DISTINCT meeting_id FROM conv) LEFT JOIN dc d USING (meeting_id) LEFT JOIN aa a USING (meeting_id) LEFT JOIN qq q USING (meeting_id)""")
def record_checks(spark, d):
    return _told(spark, d)["checks"]


@query(f"""WITH {RECORD} SELECT meeting_id, 'decisions' AS kind, CAST(item AS INT) AS item, title, status, '' AS owner, '' AS deadline, notes FROM dk WHERE kept
  UNION ALL SELECT meeting_id, 'action_items', CAST(item AS INT), title, status, owner, deadline, notes FROM ak WHERE kept UNION ALL SELECT meeting_id, 'open_questions', CAST(item AS INT), title, '', '', '', 0 FROM qk WHERE kept""")
def record_items(spark, d):
    tables = _told(spark, d)
    shown = {"decisions": ("text", F.col("status"), F.lit(""), F.lit("")), "action_items": ("task", F.col("status"), F.col("owner"), F.col("deadline")), "open_questions": ("question", F.lit(""), F.lit(""), F.lit(""))}
    rows = None
    for kind, (title, *rest) in shown.items():
        own = tables[kind].select("meeting_id", F.lit(kind).alias("kind"), "item", F.col(title).alias("title"), *(c.alias(k) for k, c in zip(("status", "owner", "deadline"), rest, strict=True)))
        rows = own if rows is None else rows.unionByName(own)
    said = tables["notes"].groupBy("meeting_id", "kind", "item").agg(F.count(F.lit(1)).alias("notes"))
    return rows.join(said, ["meeting_id", "kind", "item"], "left").na.fill(0, ["notes"])


@query()
def record_json(spark, d):
    _, _, tables = _record(spark, d)
    return sinks.decisions_json(tables).select("meeting_id", F.to_json("decisions").alias("json"))


#: drafts of every meeting told twice, as two parts; titles compared by their sorted words, each item with the first alike that leads
MERGED = f"""{CONV}, dl AS (SELECT c.meeting_id, c.line, c.text, c.speaker, coalesce(x.text, '') AS reply FROM conv c LEFT JOIN conv x ON x.meeting_id = c.meeting_id AND x.line = c.line + 1),
  di AS (SELECT meeting_id, ['decisions', 'action_items', 'open_questions'][line % 3 + 1] AS kind, line AS k, [('Decide ' || line), ('Do ' || line), 'What then'][line % 3 + 1] AS title, text AS q, reply, speaker, CASE WHEN line % 2 = 0 THEN 'never said this at all' ELSE 'mm hmm' END AS no FROM dl
    UNION ALL SELECT DISTINCT meeting_id, 'minutes', 0, 'One point', '', '', '', '' FROM conv),
  dx AS (SELECT *, {_norm('title')} AS t, {_norm('q')} AS nq, row_number() OVER (PARTITION BY meeting_id, kind ORDER BY part, k) - 1 AS i FROM (SELECT di.*, p AS part FROM di, range(2) r(p))),
  dt AS (SELECT DISTINCT a.t AS t1, b.t AS t2 FROM dx a JOIN dx b USING (meeting_id, kind)),
  ds AS (SELECT *, list_sort(list_distinct(string_split(t1, ' '))) AS x, list_sort(list_distinct(string_split(t2, ' '))) AS y FROM dt),
  dv AS (SELECT t1, t2, x, y, array_to_string(list_filter(x, lambda v: list_contains(y, v)), ' ') AS both_, array_to_string(list_concat(list_filter(x, lambda v: list_contains(y, v)), list_filter(x, lambda v: NOT list_contains(y, v))), ' ') AS l, array_to_string(list_concat(list_filter(y, lambda v: list_contains(x, v)), list_filter(y, lambda v: NOT list_contains(x, v))), ' ') AS r FROM ds),
  dp AS (SELECT t1, t2, l AS q, r AS w FROM dv UNION ALL SELECT t1, t2, both_, l FROM dv WHERE both_ <> '' UNION ALL SELECT t1, t2, both_, r FROM dv WHERE both_ <> ''),
  dk AS (SELECT q, {MASKS.format(q='q')} AS masks FROM (SELECT DISTINCT q FROM dp)),
  dm AS (SELECT t1, t2 FROM dp JOIN dk USING (q) GROUP BY 1, 2 HAVING max(200.0::DOUBLE * ({LCS}) / (length(q) + length(w))) >= 85 UNION SELECT t1, t2 FROM dv WHERE both_ <> '' AND (list_has_all(x, y) OR list_has_all(y, x))),
  dj AS (SELECT a.meeting_id, a.kind, a.i, coalesce(list(b.i ORDER BY b.i) FILTER (b.i IS NOT NULL), []) AS js FROM dx a LEFT JOIN dx b ON b.meeting_id = a.meeting_id AND b.kind = a.kind AND b.i < a.i AND (a.kind IN ('decisions', 'action_items') OR b.part < a.part)
    AND ((a.t, b.t) IN (SELECT (t1, t2) FROM dm) OR (a.kind = 'decisions' AND a.nq = b.nq)) GROUP BY 1, 2, 3),
  dr AS (SELECT meeting_id, kind, 0::BIGINT AS n, []::BIGINT[] AS leads FROM (SELECT DISTINCT meeting_id, kind FROM dx) UNION ALL
    SELECT dj.meeting_id, dj.kind, n + 1, list_append(leads, coalesce(list_filter(js, lambda j: leads[j + 1] = j)[1], dj.i)) FROM dr JOIN dj ON dj.meeting_id = dr.meeting_id AND dj.kind = dr.kind AND dj.i = dr.n),
  de AS (SELECT meeting_id, kind, unnest(arg_max(leads, n)) AS lead_, unnest(range(max(n))) AS i FROM dr GROUP BY 1, 2),
  dg AS (SELECT dx.*, lead_, row_number() OVER (PARTITION BY meeting_id, kind, lead_, {_norm('reply')} ORDER BY i) AS yn, row_number() OVER (PARTITION BY meeting_id, kind, lead_, no ORDER BY i) AS nn FROM dx JOIN de USING (meeting_id, kind, i))"""


@query(f"""WITH RECURSIVE {MERGED} SELECT meeting_id, kind, CAST(row_number() OVER (PARTITION BY meeting_id, kind ORDER BY lead_) - 1 AS INT) AS item, arg_min(title, i) AS title, CASE kind
    WHEN 'decisions' THEN concat(arg_min(q, i), '#', string_agg(reply, '|' ORDER BY i) FILTER (yn = 1), '#', string_agg(no, '|' ORDER BY i) FILTER (nn = 1), '#')
    WHEN 'action_items' THEN concat(arg_min(q, i), '#', arg_min(speaker, i), '#unspecified#', coalesce(arg_min(reply, i) FILTER (reply <> ''), ''))
    WHEN 'open_questions' THEN arg_min(q, i) ELSE '' END AS details FROM dg GROUP BY meeting_id, kind, lead_""")
def draft_merge(spark, d):
    _, drafts = _drafts(spark, d)
    merged = stored(record.merge_drafts(drafts.withColumn("part", F.lit(0)).unionByName(drafts.withColumn("part", F.lit(1)))))
    one = lambda kind, title, details: merged.select("meeting_id", F.lit(kind).alias("kind"), F.posexplode(f"draft.{kind}").alias("item", "x")).select("meeting_id", "kind", "item", F.expr(title).alias("title"), F.expr(details).alias("details"))
    rows = one("decisions", "x.text", "concat(x.proposal_quote, '#', array_join(x.agreement_quotes, '|'), '#', array_join(x.rejection_quotes, '|'), '#', x.settled_quote)")
    rows = rows.unionByName(one("action_items", "x.task", "concat_ws('#', x.task_quote, x.owner, x.deadline, x.agreement_quote)"))
    return rows.unionByName(one("open_questions", "x.question", "x.quote")).unionByName(one("minutes", "x", "''"))


# words end where a character is neither letter, digit nor _, in any script
@query(r"""SELECT conv_id AS meeting_id, CAST(turn AS INT) AS line, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda x: CASE x WHEN 'the' THEN 'de' WHEN 'de' THEN 'the' ELSE x END), '') AS text FROM conversations""")
def label_replace(spark, d):
    lines = R.conversation_lines(spark, d).select("meeting_id", "line", "text")
    ids = lines.select("meeting_id").distinct()
    changes = ids.select("meeting_id", F.lit("the").alias("old"), F.lit("de").alias("new")).unionByName(ids.select("meeting_id", F.lit("de").alias("old"), F.lit("the").alias("new")))
    return names.replace_labels(lines, changes, "text")


@query("SELECT conv_id AS meeting_id, turn, printf('%02d:%05.2f', CAST(floor(turn * 37.25 / 60) AS INT), turn * 37.25 - 60 * floor(turn * 37.25 / 60)) AS time FROM conversations")
def timestamp_format(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("meeting_id"), "turn", X.clock(F.col("turn") * F.lit(37.25)).alias("time"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_proposals(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("reply", F.concat(F.lit("Here it is:\n"), F.col("props"), F.lit("\nBye")))
    return R.json_replies(e, "struct<k:int>", "k").where("problem is null").select("event_id", F.col("data.k").alias("k"))


@query(f"""WITH {FLAGS}, l AS (SELECT meeting_id, '[' || printf('%02d:%05.2f', CAST(floor(start / 60) AS INT), start - 60 * floor(start / 60)) || '] ' || speaker || ': ' || text AS s, line FROM f) SELECT meeting_id, string_agg(s, chr(10) ORDER BY line) AS text FROM l GROUP BY 1""")
def transcript_text(spark, d):
    return sinks.transcript_text(R.conversation_lines(spark, d))


@query(f"""WITH {FLAGS} SELECT meeting_id, line, printf('%02d:%05.2f', CAST(floor(start / 60) AS INT), start - 60 * floor(start / 60)) AS start, printf('%02d:%05.2f', CAST(floor("end" / 60) AS INT), "end" - 60 * floor("end" / 60)) AS "end",
  speaker AS label, score, score >= 2 AS flagged, reasons FROM f""")
def segment_rows(spark, d):
    lines, flagged = _flagged(spark, d)
    return report.segment_rows(lines, flagged).select("meeting_id", "line", "start", "end", "label", "score", "flagged", "reasons")


@query("""WITH f AS (SELECT conv_id AS meeting_id, role AS label, min(turn) AS l FROM conversations GROUP BY 1, 2) SELECT meeting_id, label, CAST((row_number() OVER (PARTITION BY meeting_id ORDER BY l) - 1) % 10 AS INT) AS colour FROM f""")
def label_colours(spark, d):
    return report.label_colours(R.conversation_lines(spark, d))


@query("""SELECT url AS path, CASE WHEN length(html) = 0 THEN 'file is missing or empty' WHEN lower(string_split(url, '.')[-1]) NOT IN ('wav', 'mp3', 'm4a', 'flac', 'ogg', 'webm', 'mp4') THEN 'unsupported format'
  WHEN page_id % 3 = 0 THEN 'no audio stream' WHEN page_id % 5 = 0 THEN 'too short' WHEN page_id % 7 = 0 THEN 'silent' END AS problem FROM (SELECT page_id, html, url || CASE WHEN page_id % 2 = 0 THEN '.wav' ELSE '.txt' END AS url FROM pages)""")
def audio_admission(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    files = p.select(F.concat("url", F.when(F.col("page_id") % 2 == 0, ".wav").otherwise(".txt")).alias("path"), F.length("html").cast("long").alias("length"), (F.col("page_id") % 3 != 0).alias("has_audio"), F.when(F.col("page_id") % 5 == 0, 0.5).otherwise(60.0).alias("duration_s"), F.when(F.col("page_id") % 7 == 0, -60.0).otherwise(-10.0).alias("peak_db"))
    return R.admit_audio(files).select("path", "problem")


@query("""WITH q AS (SELECT DISTINCT lang, source FROM documents), k AS (SELECT lang, source, sha256(to_json(['text', lang, 'system', source])) AS key FROM q)
  SELECT lang, source, key FROM k WHERE lang <> 'en'""")
def reply_cache_misses(spark, d):
    q = spark.read.parquet(f"{d}/documents.parquet").select("lang", "source").distinct().select(F.lit("text").alias("kind"), F.col("lang").alias("model"), F.lit("system").alias("system"), F.col("source").alias("user"))
    keyed = q.withColumn("key", R.reply_key(F.col("kind"), F.col("model"), F.col("system"), F.col("user")))
    _, missing = R.cached_replies(q, keyed.where("model = 'en'").select("key", F.lit("{}").alias("reply")))
    return missing.select(F.col("model").alias("lang"), F.col("user").alias("source"), "key")


def _word_errors(said: str) -> str:
    """The table of all pairs of words, one diagonal after the other; an error weighs more than all lost and added words."""
    return rf"""WITH {CONV}, tx AS (SELECT meeting_id, string_agg(trim(text), ' ' ORDER BY line) FILTER (trim(text) <> '') AS gold, string_agg(trim(said), ' ' ORDER BY line) FILTER (trim(said) <> '') AS heard
    FROM (SELECT *, {said} AS said FROM conv) GROUP BY 1),
  tk AS (SELECT meeting_id, list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(coalesce(gold, '')), '-', ' '), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '') AS a, list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(coalesce(heard, '')), '-', ' '), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '') AS b FROM tx),
  sz AS (SELECT *, len(a)::BIGINT AS n, len(b)::BIGINT AS m, (len(a) + len(b) + 1)::BIGINT AS e FROM tk),
  tb AS (SELECT *, list_reduce(range(1::BIGINT, n + m + 1), lambda st, s: {{'x': list_transform(range(0::BIGINT, n + 1), lambda i: CASE WHEN i > s OR s - i > m THEN 1000000000000::BIGINT
      ELSE least(st.x[i + 1] + e + 1, CASE WHEN i > 0 THEN st.x[i] + e + 1 ELSE 1000000000000::BIGINT END, CASE WHEN i > 0 AND i < s THEN st.y[i] + CASE WHEN a[i] = b[s - i] THEN 0 ELSE e END ELSE 1000000000000::BIGINT END) END), 'y': st.x}},
      {{'x': list_transform(range(0::BIGINT, n + 1), lambda i: CASE WHEN i = 0 THEN 0::BIGINT ELSE 1000000000000::BIGINT END), 'y': list_transform(range(0::BIGINT, n + 1), lambda i: 1000000000000::BIGINT)}}).x[n + 1] AS c FROM sz),
  ct AS (SELECT *, c // e AS errors, c % e AS gaps, (c % e + n - m) // 2 AS deletions FROM tb)
  SELECT meeting_id, errors - gaps AS substitutions, deletions, gaps - deletions AS insertions, errors, n::INT AS words, errors / nullif(n, 0)::DOUBLE AS wer FROM ct"""


def _heard_texts(spark, d, said):
    return R.conversation_lines(spark, d).withColumn("said", said).groupBy("meeting_id").agg(X.ordered_join("line", "text").alias("gold"), X.ordered_join("line", "said").alias("heard"))


@query(_word_errors("CASE WHEN line >= 2 THEN text ELSE '' END"))
def word_error_rate(spark, d):
    # all lines of a meeting against all but its first two
    return evaluate.word_errors(_heard_texts(spark, d, F.when(F.col("line") >= 2, F.col("text")).otherwise("")))


@query(_word_errors("CASE line % 4 WHEN 0 THEN '' WHEN 1 THEN replace(text, 'e', 'a') WHEN 2 THEN text || ' ' || text ELSE text END"))
def word_error_kinds(spark, d):
    # of four lines the first is lost, the second misheard, the third said twice
    said = F.when(F.col("line") % 4 == 0, "").when(F.col("line") % 4 == 1, F.replace("text", F.lit("e"), F.lit("a"))).when(F.col("line") % 4 == 2, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text"))
    return evaluate.word_errors(_heard_texts(spark, d, said))


def _diarization(collar: int, overlap: str) -> str:
    """Who speaks between any two borders next to each other; two gold speakers at most, so the best mapping is the best pair."""
    return f"""WITH {EVENTS}, g0 AS (SELECT meeting_id, speaker, CAST(round(start * 1e6::DOUBLE) AS BIGINT) AS a, CAST(round("end" * 1e6::DOUBLE) AS BIGINT) AS b FROM turns),
  o0 AS (SELECT meeting_id, CASE WHEN turn_idx % 5 = 0 THEN 'other' ELSE upper(speaker) END AS speaker, CAST(round((start + 30) * 1e6::DOUBLE) AS BIGINT) AS a, CAST(round(("end" + 90) * 1e6::DOUBLE) AS BIGINT) AS b FROM turns),
  mk AS (SELECT meeting_id, unnest([a, b]) AS m FROM g0), ed AS (SELECT meeting_id, unnest([m - {collar}, m, m + {collar}]) AS t FROM mk UNION SELECT meeting_id, unnest([a, b]) FROM o0),
  st AS (SELECT meeting_id, t AS a, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS b FROM ed),
  gs AS (SELECT DISTINCT st.meeting_id, st.a, st.b, speaker FROM st JOIN g0 ON g0.meeting_id = st.meeting_id AND g0.a <= st.a AND st.b <= g0.b), os AS (SELECT DISTINCT st.meeting_id, st.a, st.b, speaker FROM st JOIN o0 ON o0.meeting_id = st.meeting_id AND o0.a <= st.a AND st.b <= o0.b),
  nk AS (SELECT DISTINCT st.meeting_id, st.a FROM st JOIN mk ON mk.meeting_id = st.meeting_id AND mk.m - {collar} <= st.a AND st.b <= mk.m + {collar}),
  ns AS (SELECT st.*, coalesce(g, 0) AS g, coalesce(o, 0) AS o FROM st LEFT JOIN (SELECT meeting_id, a, count(*) AS g FROM gs GROUP BY 1, 2) USING (meeting_id, a) LEFT JOIN (SELECT meeting_id, a, count(*) AS o FROM os GROUP BY 1, 2) USING (meeting_id, a) ANTI JOIN nk USING (meeting_id, a) WHERE b IS NOT NULL),
  sc AS (SELECT * FROM ns WHERE {overlap}),
  sh AS (SELECT meeting_id, os.speaker AS o, gs.speaker AS g, CAST(sum(sc.b - sc.a) AS BIGINT) AS n FROM sc JOIN gs USING (meeting_id, a) JOIN os USING (meeting_id, a) GROUP BY 1, 2, 3),
  rt AS (SELECT meeting_id, max(n) AS n FROM (SELECT meeting_id, n FROM sh UNION ALL SELECT x.meeting_id, x.n + y.n FROM sh x JOIN sh y ON x.meeting_id = y.meeting_id AND x.o <> y.o AND x.g <> y.g) GROUP BY 1),
  sm AS (SELECT meeting_id, coalesce(sum((b - a) * g), 0)::DOUBLE AS scored, coalesce(sum((b - a) * greatest(g - o, 0)), 0)::DOUBLE AS missed, coalesce(sum((b - a) * greatest(o - g, 0)), 0)::DOUBLE AS false_, coalesce(sum((b - a) * least(g, o)), 0)::DOUBLE AS both_ FROM sc GROUP BY 1),
  al AS (SELECT meeting_id, coalesce(scored, 0) AS scored, coalesce(missed, 0) AS missed, coalesce(false_, 0) AS false_, coalesce(both_, 0) - coalesce(n, 0) AS confused FROM (SELECT DISTINCT meeting_id FROM g0) LEFT JOIN sm USING (meeting_id) LEFT JOIN rt USING (meeting_id))
  SELECT meeting_id, missed / 1e6::DOUBLE AS missed_s, false_ / 1e6::DOUBLE AS false_s, confused / 1e6::DOUBLE AS confused_s, (missed + false_ + confused) / 1e6::DOUBLE AS error_s, scored / 1e6::DOUBLE AS scored_s, (missed + false_ + confused) / nullif(scored, 0) AS der FROM al"""


def _heard_turns(spark, d):
    """Gold turns, and what was heard of them: half a minute late, a minute too long, every fifth by another voice."""
    gold = R.event_turns(spark, d)
    speaker = F.when(F.col("turn_idx") % 5 == 0, "other").otherwise(F.upper("speaker"))
    return gold, gold.withColumns({"start": F.col("start") + 30, "end": F.col("end") + 90, "speaker": speaker})


@query(_diarization(125_000, "g <= 1"))
def diarization_error(spark, d):
    return evaluate.diarization_errors(*_heard_turns(spark, d), 0.25, True)


@query(_diarization(0, "true"))
def diarization_error_strict(spark, d):
    return evaluate.diarization_errors(*_heard_turns(spark, d))


@query(f"""WITH {OVERLAP.format(reach=-REACH)}, cf AS (SELECT w.meeting_id, coalesce(a.sp, b.sp) AS s, e.event_type AS g, count(*) AS n FROM words w LEFT JOIN a USING (meeting_id, line) LEFT JOIN b USING (meeting_id, line) JOIN events e ON e.event_id = w.line WHERE coalesce(a.sp, b.sp) IS NOT NULL GROUP BY 1, 2, 3),
  l AS (SELECT meeting_id, list_sort(list(DISTINCT s)) AS o, list_sort(list(DISTINCT g)) AS t FROM cf GROUP BY 1),
  f AS (SELECT meeting_id, len(o) > len(t) AS sw, CASE WHEN len(o) > len(t) THEN t ELSE o END AS few, CASE WHEN len(o) > len(t) THEN o ELSE t END AS many FROM l),
  pp AS (SELECT *, unnest(range(1, len(many) + 1)) AS i FROM f), qq AS (SELECT *, unnest(CASE WHEN len(few) = 2 THEN list_filter(range(1, len(many) + 1), lambda x: x <> i) ELSE [0] END) AS j FROM pp),
  mm AS (SELECT *, CASE WHEN sw THEN many[i] ELSE few[1] END AS s1, CASE WHEN sw THEN few[1] ELSE many[i] END AS g1, CASE WHEN j = 0 THEN NULL WHEN sw THEN many[j] ELSE few[2] END AS s2, CASE WHEN j = 0 THEN NULL WHEN sw THEN few[2] ELSE many[j] END AS g2 FROM qq),
  rr AS (SELECT mm.*, coalesce(x.n, 0) AS n1, coalesce(y.n, 0) AS n2 FROM mm LEFT JOIN cf x ON x.meeting_id = mm.meeting_id AND x.s = s1 AND x.g = g1 LEFT JOIN cf y ON y.meeting_id = mm.meeting_id AND y.s = s2 AND y.g = g2),
  kk AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n1 + n2 DESC, i, j) AS best FROM rr)
  SELECT meeting_id, s1 AS speaker, g1 AS gold, n1 AS n FROM kk WHERE best = 1 UNION ALL SELECT meeting_id, s2, g2, n2 FROM kk WHERE best = 1 AND j > 0""")
def speaker_mapping(spark, d):
    return evaluate.speaker_mapping(word_confusion(spark, d))
