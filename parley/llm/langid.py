"""Language identification: unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. The probability of a word is the sum over all ways to
cut it into pieces, found by the forward algorithm; that of a text the product over its words. Probabilities are learned
by expectation maximisation (forward-backward over the same lattice) from at most ``SAMPLE`` training ids of each language;
this is the only bound. Characters that no piece covers count as one unknown piece each.

Words are lower-cased and marked at their start as the vocabulary does. Distinct words are scored once, those of equal length
together in numpy batches, and kept in a table of bounded size; words of more than ``SHORT`` characters go through the same
recursion in logarithms, position by position, whatever their length.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing can be
learned; ties go to the language that sorts first; documents without language are scored but not learned from; repeated
rows score alike; other columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.core import BASE, append_result, crc_mod, free_name, mix, per_row, tidy, tune
from parley.llm.labelled import code_points

MARK = "▁"
SHORT = 32  #: characters of words whose sums fit plain numbers
SAMPLE = 600
ROUNDS = 3
SMOOTH = 0.05
FOLDS, HELD = 4, 2
TABLE = 800_000
BATCH = 20_000
NONE = -1e30

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces by the hash of their code points; the last index is the unknown piece, one more means none."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = sorted({model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))})
        pieces = [p for p in pieces if p]
        self.longest = max(map(len, pieces))
        self.unknown, self.none = len(pieces), len(pieces) + 1
        kind = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"
        hashes = np.empty(len(pieces), np.uint64)
        by_length = defaultdict(list)
        for i, p in enumerate(pieces):
            by_length[len(p)].append(i)
        for n, ids in by_length.items():
            codes = np.frombuffer("".join(pieces[i] for i in ids).encode(kind), np.uint32).reshape(-1, n).astype(np.uint64)
            h = np.zeros(len(ids), np.uint64)
            for j in range(n):
                h = h * np.uint64(BASE) + codes[:, j] + np.uint64(1)
            hashes[ids] = mix(h ^ np.uint64(n))
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order
        self.bits = 22
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def lattice(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each piece length l the piece index at each position: arrays [words, positions]; codes [words, length]."""
        n, width = codes.shape
        out = []
        h = np.zeros((n, width), np.uint64)
        for l in range(1, min(self.longest, width) + 1):
            h = h[:, : width - l + 1] * np.uint64(BASE) + codes[:, l - 1 :] + np.uint64(1)
            key = mix(h ^ np.uint64(l)).ravel()
            ids = np.full(len(key), self.none, np.int32)
            at = np.flatnonzero(self.table[(key >> np.uint64(64 - self.bits)).astype(np.int64)])
            k = np.searchsorted(self.keys, key[at])
            k[k == len(self.keys)] = 0
            ok = self.keys[k] == key[at]
            ids[at[ok]] = self.ids[k[ok]]
            if l == 1:
                ids[ids == self.none] = self.unknown
            out.append(ids.reshape(n, -1))
        return out


def forward(lattice: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Sums over the segmentations of each prefix: [words, length + 1, languages]; p has a zero row for no piece."""
    n, width = lattice[0].shape
    a = np.zeros((n, width + 1, p.shape[1]))
    a[:, 0] = 1
    for j in range(1, width + 1):
        for l in range(1, min(len(lattice), j) + 1):
            ids = lattice[l - 1][:, j - l]
            some = np.flatnonzero(ids < len(p) - 1)
            if len(some):
                a[some, j] += a[some, j - l] * p[ids[some]]
    return a


def expected(lattice: list[np.ndarray], p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by words with weights, for one language."""
    n, width = lattice[0].shape
    a = forward(lattice, p)[:, :, 0]
    b = np.zeros((n, width + 1))
    b[:, width] = 1
    q = p[:, 0]
    total = np.zeros(len(p))
    scale = weight / np.maximum(a[:, width], 1e-300)
    for i in range(width - 1, -1, -1):
        for l in range(1, min(len(lattice), width - i) + 1):
            ids = lattice[l - 1][:, i]
            some = np.flatnonzero(ids < len(p) - 1)
            if len(some):
                use = q[ids[some]] * b[some, i + l]
                b[some, i] += use
                total += np.bincount(ids[some], a[some, i] * use * scale[some], len(p))
    return total


def ending_at(lattice: list[np.ndarray]) -> np.ndarray:
    """Of one word, the piece of each length that ends behind each position: [positions, lengths]; none where there is none."""
    width = lattice[0].shape[1]
    out = np.empty((width, len(lattice)), np.int32)
    for l, ids in enumerate(lattice):
        out[:l, l] = -1
        out[l:, l] = ids[0]
    return out


def long_forward(ending: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Logarithms of ``forward`` for one word of any length: [length + 1, languages]; log_p has a last row for no piece."""
    width, longest = ending.shape
    out = np.full((longest + width, log_p.shape[1]), NONE)  # rows before the word's start, then its prefixes
    out[longest - 1] = 0
    for j in range(width):
        # lengths 1, 2, ... end here and begin that many rows back
        terms = out[j : j + longest][::-1] + log_p[ending[j]]
        top = terms.max(0)
        out[longest + j] = top + np.log(np.exp(terms - top).sum(0))
    return out[longest - 1 :]


def long_expected(lattice: list[np.ndarray], ending: np.ndarray, log_p: np.ndarray, weight: float) -> np.ndarray:
    """``expected`` for one word of any length."""
    a = long_forward(ending, log_p)[:, 0]
    q, longest, width = log_p[:, 0], ending.shape[1], ending.shape[0]
    begin = np.full((width, longest), len(q) - 1, np.int64)
    for l, ids in enumerate(lattice):
        begin[: ids.shape[1], l] = ids[0]
    b = np.full(width + 1 + longest, NONE)
    b[width] = 0
    for i in range(width - 1, -1, -1):
        terms = b[i + 1 : i + 1 + longest] + q[begin[i]]
        top = terms.max()
        b[i] = top + np.log(np.exp(terms - top).sum())
    total = np.zeros(len(q))
    for l in range(longest):
        n = width - l
        if n > 0:
            total += np.bincount(begin[:n, l], weight * np.exp(np.minimum(a[:n] + q[begin[:n, l]] + b[l + 1 : l + 1 + n] - a[width], 0)), len(q))
    total[-1] = 0
    return total


def logs(p: np.ndarray) -> np.ndarray:
    """Logarithms of piece probabilities; the last row, no piece, never adds anything."""
    out = np.log(np.maximum(p, 1e-300))
    out[-1] = NONE
    return out


def by_length(words: list[str]):
    """Words (marks included) of plain length, grouped: (indexes, code matrix)."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        if len(w) <= SHORT:
            groups[len(w)].append(i)
    for _, at in sorted(groups.items()):
        for k in range(0, len(at), BATCH):
            part = at[k : k + BATCH]
            yield np.array(part), code_matrix([words[i] for i in part])


def code_matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    kind = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"
    return np.frombuffer("".join(words).encode(kind, "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Model:
    """Languages, their log priors and piece probabilities [pieces + 2, languages]."""

    def __init__(self, path: str, languages: list[str], prior: np.ndarray, p: np.ndarray):
        self.path, self.languages, self.prior, self.p = path, languages, prior, p


def learn(path: str, counts: dict[str, Counter], documents: dict[str, int]) -> Model:
    """counts: words of the sampled texts by language; documents: training documents by language."""
    languages = sorted(k for k, c in counts.items() if c)
    vocabulary = Vocabulary(path)
    p = np.zeros((vocabulary.none + 1, len(languages)))
    for k, language in enumerate(languages):
        words = [MARK + w for w in counts[language]]
        weight = np.array(list(counts[language].values()), float)
        q = np.zeros((vocabulary.none + 1, 1))
        q[: vocabulary.none] = 1 / vocabulary.none
        groups = [(at, vocabulary.lattice(codes)) for at, codes in by_length(words)]
        long = [(i, vocabulary.lattice(code_matrix([w]))) for i, w in enumerate(words) if len(w) > SHORT]
        long = [(i, lattice, ending_at(lattice)) for i, lattice in long]
        for _ in range(ROUNDS):
            total = sum((expected(lattice, q, weight[at]) for at, lattice in groups), np.zeros(vocabulary.none + 1))
            for i, lattice, ending in long:
                total += long_expected(lattice, ending, logs(q), weight[i])
            total = total[: vocabulary.none] + SMOOTH
            q[: vocabulary.none, 0] = total / total.sum()
        p[:, k] = q[:, 0]
    share = np.array([max(1, documents.get(k, 1)) for k in languages], float)
    return Model(path, languages, np.log(share / share.sum()) if len(share) else share, p)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str | None = None, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    tune(spark)
    training = docs.where(F.col(lang).isNotNull() & (crc_mod(F.col(doc_id), FOLDS) != HELD))
    documents = {r[0]: r[1] for r in training.groupBy(lang).count().collect()}
    # the sampled ids alone are sent: at most ``sample`` a language
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    ranked = training.select(F.col(lang).alias("_lang"), F.col(doc_id).alias("_id")).distinct().withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample)
    picked = [(r["_id"], r["_lang"]) for r in ranked.collect()]
    ids = spark.createDataFrame(picked, f"_id {docs.schema[doc_id].dataType.simpleString()}, _lang string")
    drawn = training.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), ["_id", "_lang"])

    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                counts[k].update(t.lower().split())
        for k, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["k", "w", "c"])

    counts: dict[str, Counter] = {k: Counter() for k in documents}
    for r in drawn.mapInArrow(tidy(run), "k string, w string, c long").groupBy("k", "w").agg(F.sum("c").alias("c")).orderBy("k", "w").toLocalIterator():
        counts[r["k"]][r["w"]] = r["c"]
    return learn(vocabulary or default_vocabulary(), counts, documents)


_LETTER: list = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


class Scorer:
    """A model with its table of word scores, one for each Python worker task."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = Vocabulary(model.path)
        self.log_p = logs(model.p)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.value = np.zeros((0, len(self.model.languages)), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        words = [MARK + w for w in words]
        out = np.zeros((len(words), len(self.model.languages)))
        for at, codes in by_length(words):
            a = forward(self.vocabulary.lattice(codes), self.model.p)[:, -1]
            out[at] = np.log(np.maximum(a, 1e-300))
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = long_forward(ending_at(self.vocabulary.lattice(code_matrix([w]))), self.log_p)[-1]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> list:
        from parley.llm.core import prefix_sums, span_hashes

        n = len(offsets) - 1
        codes, cut = code_points(data, offsets, lower=True)
        alpha = letters()
        space = np.isin(codes, _SPACES)
        first = np.zeros(len(codes) + 1, bool)
        first[cut] = True
        inside = ~space
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:-1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        row = np.searchsorted(cut, starts, "right") - 1
        letter = np.append(0, np.cumsum(alpha[codes]))
        has = (letter[cut[1:]] - letter[cut[:-1]]) > 0
        k = len(self.model.languages)
        if not k:
            return [["und"] * n, np.zeros(n)]
        total = np.tile(self.model.prior, (n, 1))
        if len(starts):
            h = span_hashes(prefix_sums(codes.astype(np.uint64) + np.uint64(1)), starts, ends)
            keys, example, inverse = np.unique(h, return_index=True, return_inverse=True)
            if len(self.keys) > TABLE:
                self._empty()
            known = np.searchsorted(self.keys, keys)
            known[known == len(self.keys)] = 0
            new = np.flatnonzero(self.keys[known] != keys) if len(self.keys) else np.arange(len(keys))
            if len(new):
                text = codes.tobytes().decode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass")
                e = example[new]
                value = self.word_scores([text[a:b] for a, b in zip(starts[e].tolist(), ends[e].tolist(), strict=True)]).astype(np.float32)
                where = np.searchsorted(self.keys, keys[new])
                self.keys, self.value = np.insert(self.keys, where, keys[new]), np.insert(self.value, where, value, axis=0)
                known = np.searchsorted(self.keys, keys)
            value = self.value[known][inverse]
            for j in range(k):
                total[:, j] += per_row(row, n, value[:, j].astype(float))
        best = total.argmax(1)
        top = total[np.arange(n), best]
        score = 1 / np.exp(total - top[:, None]).sum(1)
        return [[self.model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0)]


#: white space as str.split() has it
_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """docs with a struct of the predicted language and its posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(docs.columns, "_language")

    def make():
        return Scorer(shared.value).score

    return append_result(docs, text, make, RESULT, name, keep_text), name


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    scored, name = identify(docs.drop("lang"), fit(docs), keep_text=False)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["score"].alias("score"))
