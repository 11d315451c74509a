"""Schemas of the input tables; readers never infer them."""

from __future__ import annotations

WORD = "struct<start:double,end:double,text:string,probability:double>"
LINES = f"meeting_id bigint, line int, start double, end double, text string, no_speech_prob double, avg_logprob double, compression_ratio double, words array<{WORD}>"
MEETINGS = "meeting_id bigint, language string, duration_s double, diarized boolean, typed string, attendees array<string>"
RAW_TURNS = "meeting_id bigint, ord int, start double, end double, label string"
CLAIMS = "meeting_id bigint, ord int, speaker string, name string, role string, kind string, line string, quote string"
GLOSSARY = "meeting_id bigint, ord int, text string, source string, heard_as string"
REPLIES = "meeting_id bigint, reply string"
EDITS = "meeting_id bigint, speaker string, name string, role string"
GOLD_WORDS = "meeting_id bigint, start double, end double, speaker string, word string"
