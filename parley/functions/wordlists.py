"""Word lists, phrases, patterns and thresholds that results depend on."""

from __future__ import annotations

# ---- fixed values: thresholds
FLAG_SCORE = 2
NO_SPEECH_MAX, LOGPROB_MIN, COMPRESSION_MAX = 0.6, -1.0, 2.4
END_FRACTION, PLAIN_REPEAT = 0.10, 3
NEAREST_TURN_S, SNAP_WORDS, MIN_RUN_WORDS = 0.5, 2, 2
REPLY_LINES, SELF_POINTS, ADDRESSED_POINTS, HIGH_CONFIDENCE = 4, 3, 1, 2
MATCH_SCORE, MATCH_SCORE_UNSURE, UNSURE_PROB = 82, 75, 0.5
MAX_SPAN_WORDS, MAX_HINTS, GUARD_SCORE, MIN_SPAN_CHARS, MIN_SPELLING = 5, 15, 90, 4, 60
WINDOW_LINES, MIN_FILL, PART_TOKENS = 4, 0.5, 4000
QUOTE_SCORE, SAME_ITEM_SCORE = 90, 85
SOURCE_PRIORITY = {"user": 0, "inferred": 1, "pack": 2}
HOTWORD_TERMS, HOTWORD_CHARS, INFERENCE_CHARS = 50, 600, 15000
ATTENDEE_SCORE, PHRASE_SCORE = 85, 90

# ---- fixed values: phrases that a line contains when it comes from subtitles, not from a voice
SUBTITLE_PHRASES = (
    "thanks for watching", "thank you for watching", "welcome to my channel", "welcome back to my channel", "don t forget to subscribe",
    "subscribe to my channel", "like and subscribe", "hit the bell icon", "see you in the next video", "thefndc com", "bf watch tv",
    "subtitles by", "amara org", "emily beynon", "transcribed by eso", "closed captioning provided by", "captions by",
)
# ---- fixed values: whole lines that recognisers invent, beside those of a phrase file
EXTRA_PHANTOMS = (
    "thank you", "thank you very much", "thanks", "bye", "bye bye", "goodbye", "i m sorry", "i love you", "oh my god", "we ll be right back",
    "i ll see you next time", "see you next time", "you", "bang", "beep", "boom", "meow", "cough", "sigh", "ding",
)
# ---- fixed values: phrases of the file that people do say in meetings
MEETING_PHRASES = (
    "mm hmm", "hmm mm", "uh huh", "i know", "oh i see", "there we go", "let s go", "so let s go", "hello everyone", "hello friends",
    "hi guys", "hey guys", "good morning", "good night", "good job", "excuse me", "hold on", "come here", "watch out", "oops", "uh oh",
    "oh hey", "oh man", "oh god", "yay", "meh",
)
# ---- fixed values: lines that answer nothing (naming) and quotes that agree to nothing (record)
NAMING_BACKCHANNELS = ("mm hmm", "mhm", "mm", "uh huh", "hmm", "yeah", "yep", "okay", "ok", "right", "sure")
RECORD_BACKCHANNELS = ("mm hmm", "mhm", "mm", "uh huh", "hmm", "yeah", "yep", "yes", "okay", "ok", "right", "sure", "alright", "all right")
# ---- fixed values: roles and names
ROLE_NOUNS = ("designer", "manager", "expert", "specialist", "lead", "leader", "person", "officer", "engineer", "developer", "analyst", "director", "head", "owner", "coordinator")
ROLE_FILLER = ("the", "a", "an", "our", "your", "of", "for", "and", "in", "charge", "team")
NOT_NAMES = ("all", "everyone", "everybody", "guys", "team", "folks", "people", "sir", "madam", "maam", "man", "dude", "buddy", "boss", "mate", "friend", "friends", "you", "speaker", "chair")
# ---- fixed values: words without a topic
STOPWORDS = tuple(
    """a about all also am an and any are as at be because been but by can could did do does don for from get got had has have he her him his how i if
    in into is it its just know like ll m maybe me mean mm more my no not now of oh ok okay on one or our out re really right s say see she should so
    some something sort t that the their them then there these they thing things think this those to uh um up us ve very was we well were what when
    which who why will with would yeah yes you your""".split()
)
# ---- fixed values: everyday words that are no misheard term by themselves
COMMON_WORDS = tuple(
    """a about after again all also an and any are as at be because been before but by can come could did do does done down each even for from get give
    go going good got had has have he her here him his how i if in into is it its just kind know like look make may maybe me might more most much must
    my need now of off ok okay on one only or other our out over really right said same say see she should so some something sort still such take than
    that the their them then there these they thing things think this those through to too up us use very want was way we well were what when where
    which while who why will with would yeah yes you your actually anyway basically better bit call called day different everyone everything feel find
    first guess keep last let little lot made mean means meant move next nothing people pretty probably put quite remember seem show someone start
    stuff suppose sure talk tell time told try trying understand week work works year""".split()
)
# ---- fixed values: words no correction may touch
NUMBER_WORDS = tuple(
    """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty
    forty fifty sixty seventy eighty ninety hundred thousand million billion half quarter dozen first second third fourth fifth sixth seventh eighth
    ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth thirtieth""".split()
)
NEGATION_WORDS = ("not", "no", "never", "nothing", "none", "nobody", "nowhere", "neither", "nor", "cannot")
# ---- fixed values: patterns over normalised text
VOLUNTEER = (
    r"\b(i ll|i will|i shall|i can(?! t\b)|i m going to|i am going to|i m gonna|let me|leave it (to|with) me|i ll take|i ve got (it|this))\b"
    r"(?! (just |also |really )?(think|see|guess|imagine|understand|say|tell|admit|wonder|suppose|know|mean|ask|agree|explain|repeat|be honest|put it)\b)"
)
NEGATED = r"\b(not|no|never|nobody|none|nothing|neither|nor|cannot|\w+n t)\b"
HEDGED = (
    r"\b(maybe|perhaps|might|could|should we|shall we|what about|how about|what if|i think|i guess|i don t know|probably|not sure|hopefully|"
    r"or something|wondering)\b"
)
# ---- fixed values: wording of results
REASON_SUBTITLE, REASON_PHANTOM, REASON_LOW, REASON_LOOP, REASON_VOICE = 'subtitle/YouTube phrase "%s"', "only a known Whisper phantom phrase", "low confidence", "looping text", "no voice found by diarization"
GUARD_REASONS = ("touches a number", "touches a negation", "changes words that were not hinted", "result is not a glossary term")
REACHED = {"agreed": "agreed", "uncontested": "decided, no objection"}
NO_SPEAKER, UNSPECIFIED = "(no speaker)", "unspecified"
