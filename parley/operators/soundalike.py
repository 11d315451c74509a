"""Similarity join of heard stretches with glossary terms: exact, by grams instead of all pairs.

A pair counts when spelling and sound code together score more than twice ``least``; then one of the two scores more than
``least``, so a longest common subsequence of L > least / 200 * S letters joins texts (or codes) of S letters in all. Between
marks of begin and end, L letters in common leave at least 3 * L - S + 1 pairs of neighbours in common: the L + 1 steps from
one common letter to the next are neighbours in both, but for at most one step for each of the S - 2 * L letters that are not
common. So

1. texts are written as sets of neighbour pairs (repeated ones numbered), those of spelling and of sound apart;
2. each keeps its rarest ones, so many that two texts with enough in common share one of them (prefix index), and these are
   joined by equality: candidates are dealt out by pair, and frequent pairs, which nearly all texts hold, are not joined;
3. candidates are counted in full, and only those with enough in common are scored.

Distinct texts take part once, however often they were said.

A meeting's own glossary is short: there ``alike_in_line`` scores all stretches of a line against ``TERMS`` of its terms at a
time, with bit-parallel rows for all places where a stretch may begin. A row goes on from word to word, so the stretches that
begin at one place cost as much as the longest of them; only what is spelled alike enough gets sound codes. No stretch
becomes a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import wordlists as W
from parley.functions.similarity import match_score, metaphone, ratio

#: terms of a meeting that meet a line at once
TERMS = 64


def neighbour_pairs(text: str) -> list[str]:
    """Pairs of neighbours of a text between marks, repeated ones numbered."""
    marked, seen, out = f"^{text}$", {}, []
    for i in range(len(text) + 1):
        pair = marked[i : i + 2]
        seen[pair] = n = seen.get(pair, 0) + 1
        out.append(f"{pair}{n}")
    return out


def codes(text: str) -> tuple[tuple[str, str], tuple[str, str]]:
    return ("spelling", text), ("sound", metaphone(text))


def fewest_common(letters: int, least: float) -> int:
    """Pairs that texts of so many letters in all have in common at least, if they score more than ``least``."""
    return 3 * (int(least * letters / 200) + 1) - letters + 1 if letters else 1


def indexed(n: int, least: float) -> int:
    """How many of its n + 1 pairs a text of n letters has to index, whatever it is joined with: the other one is no shorter
    than least / (200 - least) of it."""
    common = int((3 * least / 200 - 1) * (1 + least / (200 - least)) * n + 1 - 1e-9) + 1
    return max(n + 2 - common, 1)


def pair_frequencies(terms: DataFrame) -> dict[tuple[str, str], int]:
    """How many distinct terms hold each (kind, pair). Pairs are of 36 letters and digits and two marks, and numbered no
    higher than a term is long, so the table doesn't grow with the number of terms."""

    def run(batches):
        for pdf in batches:
            rows = [(kind, pair) for t in pdf["text"] for kind, code in codes(t) for pair in neighbour_pairs(code)]
            yield pd.DataFrame(rows, columns=["kind", "pair"])

    counts = terms.select("text").distinct().mapInPandas(run, "kind string, pair string").groupBy("kind", "pair").count()
    return {(r["kind"], r["pair"]): r["count"] for r in counts.collect()}


def prefixes(texts: DataFrame, frequency: dict[tuple[str, str], int], keys: list[str]) -> DataFrame:
    """(keys, text, least, kind, code, pair): the rarest pairs of each text (keys, text, least), in spelling and in sound."""
    kinds = "".join(f"`{k}` {texts.schema[k].dataType.simpleString()}, " for k in keys)
    names = [*keys, "text", "least", "kind", "code", "pair"]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for kind, code in codes(r[-2]):
                    pairs = sorted(neighbour_pairs(code), key=lambda p, kind=kind: (frequency.get((kind, p), 0), p))
                    # what no term holds meets nothing
                    rows += [(*r, kind, code, p) for p in pairs[: indexed(len(code), r[-1])] if (kind, p) in frequency]
            yield pd.DataFrame(rows, columns=names)

    return texts.select(*keys, "text", "least").mapInPandas(run, f"{kinds}text string, least double, kind string, code string, pair string")


@F.pandas_udf(T.BooleanType())
def enough_common(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([len(set(neighbour_pairs(x)).intersection(neighbour_pairs(y))) >= fewest_common(len(x) + len(y), n) for x, y, n in zip(a, b, least, strict=True)], dtype=bool)


def candidate_pairs(heard: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, term, least): pairs that may score; heard (keys, text, least) and terms (keys, text) are distinct."""
    frequency = pair_frequencies(terms)
    index = prefixes(terms.withColumn("least", F.lit(float(W.MATCH_SCORE_UNSURE))), frequency, keys).select(*keys, "kind", "pair", F.col("text").alias("term"), F.col("code").alias("_code"))
    met = prefixes(heard, frequency, keys).join(index, [*keys, "kind", "pair"])
    a, b = F.length("code"), F.length("_code")
    # more than least in common: the shorter code is more than least / (200 - least) of the longer one
    even = F.least(a, b) * (200 - F.col("least")) >= F.greatest(a, b) * F.col("least")
    met = met.where(even & (2 * F.length("text") >= F.length("term")) & (F.length("text") <= 2 * F.length("term"))).select(*keys, "text", "term", "code", "_code", "least").distinct()
    return met.where(enough_common("code", "_code", "least")).select(*keys, "text", "term", "least").distinct()


def sound_alike(heard: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, term, score, sound, spelling) of the pairs that score more than the text's ``least`` and are spelled alike.

    heard: keys, text, least; terms: keys, text; texts are plain letters and digits. Without keys every term meets all texts."""
    # a fixed number of tasks: what follows costs more than its bytes tell
    tasks = int(heard.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heard = heard.where("text != ''").repartition(tasks, *keys, "text").groupBy(*keys, "text").agg(F.min("least").cast("double").alias("least"))
    pairs = candidate_pairs(heard, terms.select(*keys, "text").where("text != ''").distinct(), keys)
    scored = pairs.withColumn("m", match_score("text", "term"))
    return scored.where((F.col("m.score") > F.col("least")) & (F.col("m.spelling") >= W.MIN_SPELLING)).select(*keys, "text", "term", "m.score", "m.sound", "m.spelling")


def _spelled(letters: np.ndarray, begin: np.ndarray, size: np.ndarray, terms: list[str]) -> np.ndarray:
    """Longest common subsequences of stretches of letters (begin, size) with terms of 64 letters at most."""
    out = np.zeros((len(begin), len(terms)), np.int64)
    masks = np.zeros((256, len(terms)), np.uint64)
    for t, term in enumerate(terms):
        for i, c in enumerate(term):
            masks[ord(c), t] |= np.uint64(1 << i)
    full = np.array([(1 << len(t)) - 1 for t in terms], np.uint64)
    places, row_of = np.unique(begin, return_inverse=True)
    row = np.repeat(full[None, :], len(places), 0)
    ends = np.argsort(size, kind="stable")
    at = np.searchsorted(size[ends], np.arange(size.max(initial=0) + 2))
    # behind the last letter stands one that no term has
    padded = np.append(letters, np.zeros(len(at), np.uint8))
    for k in range(1, len(at) - 1):
        here = masks[padded[places + k - 1]]
        hit = row & here
        row = (row + hit) | (row ^ hit)
        if at[k] < at[k + 1]:
            done = ends[at[k] : at[k + 1]]
            out[done] = np.bitwise_count(~row[row_of[done]] & full)
    return out


def alike_in_line(words: list[str], closes: list[bool], unsure: list[bool], terms: list[str]) -> list[tuple[int, int, str, float, float, float]]:
    """(first, end, term, score, sound, spelling) of the stretches within a sentence that are like a term, by the rules of
    ``sound_alike``; words and terms are plain letters and digits, ``unsure`` tells whose score may be lower."""
    spans = []
    for a in range(len(words)):
        for z in range(a + 1, min(a + W.MAX_SPAN_WORDS, len(words)) + 1):
            spans.append((a, z, W.MATCH_SCORE_UNSURE if any(unsure[a:z]) else W.MATCH_SCORE))
            if closes[z - 1]:
                break
    if not spans or not terms:
        return []
    a, z, least = (np.array(x) for x in zip(*spans, strict=True))
    offset = np.cumsum([0, *map(len, words)])
    begin, size = offset[a], offset[z] - offset[a]
    length = np.array([len(t) for t in terms])
    keep = (size > 0) & (2 * size >= length.min()) & (size <= 2 * length.max())
    a, z, least, begin, size = (x[keep] for x in (a, z, least, begin, size))
    if not len(a):
        return []
    letters = "".join(words)
    common = np.zeros((len(a), len(terms)), np.int64)
    short = np.flatnonzero(length <= 64)
    common[:, short] = _spelled(np.frombuffer(letters.encode(), np.uint8), begin, size, [terms[t] for t in short])
    fits = (2 * size[:, None] >= length) & (size[:, None] <= 2 * length)
    spelling = 200.0 * common / (size[:, None] + length)
    for i, t in np.argwhere(fits & (length > 64)):
        spelling[i, t] = ratio(letters[begin[i] : begin[i] + size[i]], terms[t])
    out = []
    for i, t in np.argwhere(fits & (spelling >= W.MIN_SPELLING) & ((100 + spelling) / 2 > least[:, None])):
        span, like = words[a[i] : z[i]], float(spelling[i, t])
        if (len(span) == 1 and len(span[0]) < W.MIN_SPAN_CHARS) or all(w in W.COMMON_WORDS for w in span):
            continue
        sound = ratio(metaphone("".join(span)), metaphone(terms[t]))
        if (sound + like) / 2 > least[i]:
            out.append((int(a[i]), int(z[i]), terms[t], (sound + like) / 2, sound, like))
    return out


ALIKE = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("term", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("score", "sound", "spelling"))])


@F.pandas_udf(T.ArrayType(ALIKE))
def alike(words: pd.Series, closes: pd.Series, unsure: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([alike_in_line(list(w), list(c), list(u), list(t)) for w, c, u, t in zip(words, closes, unsure, terms, strict=True)], dtype=object)
