"""Quality rules: line labelling by a linear-chain conditional random field.

Each line that has a word is content or boilerplate. Observations of a line are binary (``FEATURES``): share of symbols and
capitals, bars, doubled marks, repeated words, length, closing mark, whether an earlier line is the same. A linear chain
ties neighbouring labels. Viterbi decoding marks the lines of a text; it is kept if at least ``SHARE`` of its characters in
labelled lines are content and the base counts don't fail.

Weights are trained by gradient ascent on the log-likelihood, with forward-backward over whole texts, on at most ``SAMPLE``
labelled ids of each class (the only bound). Labels of lines are partly known and partly hidden. A line that stands between
different neighbours in ``SETTINGS`` sampled texts or more is boilerplate (copies of a text have the same neighbours). The
others are found by rounds of training and decoding: the best labels under the constraint that the text's verdict is its
label, which a shift of all its lines' scores, as small as will do, enforces. The first round takes the text's label for every line and neighbours as unrelated, so that what lines look like in
good and in bad texts decides, not that all lines of a text were given one label.
Training starts from ``START``, which alone decides where there are no labels of both classes.

Defined results: a null or empty text has no words, lines or verdict and fails; a text of one line is a chain of one;
repeated rows are judged alike; other columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.core import NOT_SPACE, append_result, free_name, gram_hashes, grams_inside, mix, per_row, prefix_sums, slices, span_hashes, tidy, tune, word_hashes, words_of
from parley.llm.labelled import labelled_sample

WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
SHARE = 0.5
SAMPLE = 1500
STEPS, RECODED = 60, 3  #: of gradient ascent in a round; rounds of decoding between
SETTINGS = 3
SHIFTS = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 64.0)
PARTS = 12

FEATURES = ("bias", "symbols", "many_symbols", "capitals", "bars", "marks", "repeated_words", "same_as_earlier", "short", "long", "closed", "first", "last")
#: weights of boilerplate against content before training, and of two neighbours with equal labels
START = np.array([-1.5, 1.0, 2.0, 2.0, 2.0, 1.0, 3.0, 1.0, 0.3, -0.3, -0.5, 0.0, 0.0])
START_SAME = 1.0

RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("n_lines", T.LongType()), T.StructField("n_content_lines", T.LongType())])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in ".?!:;"]] = True


class Lines:
    """Base counts and line observations of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = self.n = len(offsets) - 1
        starts, ends, row = words_of(data, offsets, NOT_SPACE)
        words = word_hashes(data, starts, ends, lower=False)
        char = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        symbol = np.append(0, np.cumsum(_SYMBOL[data]))
        self.n_words = per_row(row, n)
        self.word_chars = per_row(row, n, (char[ends] - char[starts]).astype(float)).astype(np.int64)
        self.n_symbols = symbol[offsets[1:]] - symbol[offsets[:-1]]

        # words in windows found twice or more in their text
        grams, inside = gram_hashes(words, WINDOW), grams_inside(row, WINDOW)
        at = np.flatnonzero(inside)
        key = mix(grams[at] ^ (row[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[inverse] > 1] if len(at) else at
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW if len(twice) else twice, -1)
        self.n_repeat = per_row(row, n, (np.cumsum(cover[:-1]) > 0).astype(float)).astype(np.int64)

        # lines: between line feeds, within a text
        feed = np.flatnonzero(data == 10)
        lo = np.sort(np.concatenate([offsets[:-1], feed + 1]), kind="stable")
        hi = np.sort(np.concatenate([feed, offsets[1:]]), kind="stable")
        word_line = np.searchsorted(lo, starts, "right") - 1
        per_line = np.bincount(word_line, minlength=len(lo)) if len(lo) else np.zeros(0, int)
        keep = np.flatnonzero(per_line > 0)
        line_of = np.full(len(lo), -1)
        line_of[keep] = np.arange(len(keep))
        self.lo, self.hi = lo[keep], hi[keep]
        self.row = np.searchsorted(offsets, self.lo, "right") - 1 if len(keep) else np.zeros(0, np.int64)
        h = self.hash = span_hashes(prefix_sums(data.astype(np.uint64) + np.uint64(1)), self.lo, self.hi)
        _, first = np.unique(mix(h ^ (self.row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        dup = np.ones(len(keep), bool)
        dup[first] = False
        self.n_dup = per_row(self.row, n, dup.astype(float)).astype(np.int64)

        count = lambda mask: (c := np.append(0, np.cumsum(mask)))[self.hi] - c[self.lo]
        size = np.maximum(char[self.hi] - char[self.lo], 1)
        self.chars = size
        n_words = np.maximum(per_line[keep], 1)
        upper, alpha = count((data >= 65) & (data <= 90)), count(((data | 32) >= 97) & ((data | 32) <= 122))
        double = np.zeros(len(data), bool)
        if len(data) > 1:
            double[1:] = (data[1:] == data[:-1]) & ((data[1:] == 33) | (data[1:] == 63))
        again = np.zeros(len(words))
        if len(words) > 1:
            again[1:] = (words[1:] == words[:-1]) & (word_line[1:] == word_line[:-1])
        again = np.bincount(line_of[word_line], again, len(keep)) if len(words) else np.zeros(len(keep))
        share = (symbol[self.hi] - symbol[self.lo]) / size
        end = np.clip(ends[np.searchsorted(starts, self.hi) - 1] - 1, 0, None) if len(keep) else np.zeros(0, np.int64)
        new = np.append(True, self.row[1:] != self.row[:-1]) if len(keep) else np.zeros(0, bool)
        self.x = np.stack([np.ones(len(keep)), share > 0.02, share > 0.1, (upper > 0.5 * alpha) & (alpha > 1), count(data == 124) >= 0.2 * n_words, count(double) >= 0.3 * n_words, again > 0.3 * n_words, dup, n_words < 4, n_words > 25, _CLOSE[data[end]] if len(keep) else new, new, np.append(new[1:], True) if len(keep) else new], 1).astype(float)
        self.first = np.searchsorted(self.row, np.arange(n))
        self.length = np.searchsorted(self.row, np.arange(n), "right") - self.first

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat > REPEAT_PERCENT * self.n_words)


def steps_of(first: np.ndarray, length: np.ndarray):
    """Positions of the t-th line of every chain that has one; chains in order of falling length."""
    order = np.argsort(-length, kind="stable")
    start, size = first[order], length[order]
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))
        yield order[:live], start[:live] + t


class Chain:
    """Two labels, content 0 and boilerplate 1; label 0 scores 0, label 1 scores x @ weights; ``move`` scores neighbours."""

    def __init__(self, weights: np.ndarray, move: np.ndarray):
        self.weights, self.move = weights, move

    def viterbi(self, x: np.ndarray, first: np.ndarray, length: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        """The best labels; ``more`` is added to each line's score of label 1."""
        score = np.stack([np.zeros(len(x)), x @ self.weights + more], 1) if len(x) else np.zeros((0, 2))
        best, came = np.zeros((len(first), 2)), np.zeros((len(x), 2), np.int8)
        steps = list(steps_of(first, length))
        for t, (chain, at) in enumerate(steps):
            if t:
                options = best[chain][:, :, None] + self.move
                came[at] = options.argmax(1)
                best[chain] = options.max(1) + score[at]
            else:
                best[chain] = score[at]
        label = np.zeros(len(x), np.int8)
        state = best.argmax(1)
        for chain, at in reversed(steps):
            last = at == first[chain] + length[chain] - 1
            label[at] = np.where(last, best[chain].argmax(1), state[chain])
            state[chain] = came[at, label[at]]
        return label

    def expected(self, x: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label 1) of each line, and expected counts of neighbouring labels summed over chains with weight 1 each."""
        score = np.stack([np.zeros(len(x)), x @ self.weights], 1)
        forward, back = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        steps = list(steps_of(first, length))
        sums = lambda z, axis: np.logaddexp.reduce(z, axis)
        for t, (chain, at) in enumerate(steps):
            forward[at] = score[at] + (sums(forward[at - 1][:, :, None] + self.move, 1) if t else 0)
        for chain, at in reversed(steps):
            more = at < first[chain] + length[chain] - 1
            at = at[more]
            back[at] = sums(self.move[None] + (score[at + 1] + back[at + 1])[:, None, :], 2)
        total = np.zeros(len(first))
        some = length > 0
        total[some] = sums(forward[first[some]] + back[first[some]], 1)
        owner = np.repeat(np.arange(len(first)), length)
        p = np.exp(forward[:, 1] + back[:, 1] - total[owner])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair = np.exp(forward[inner][:, :, None] + self.move + (score[inner + 1] + back[inner + 1])[:, None, :] - total[owner[inner]][:, None, None])
        return p, pair, owner, inner


def default_chain() -> Chain:
    return Chain(START.copy(), np.array([[START_SAME, 0.0], [0.0, START_SAME]]))


def set_lines(hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Lines (known by their hashes, texts one after the other) that stand in ``SETTINGS`` different settings or more."""
    if not len(hashes):
        return np.zeros(0, bool)
    owner = np.repeat(np.arange(len(length)), length)
    inner = owner[1:] == owner[:-1]
    before, behind = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
    before[1:][inner], behind[:-1][inner] = hashes[:-1][inner], hashes[1:][inner]
    setting = mix(before ^ mix(behind + np.uint64(1)))
    order = np.lexsort((setting, hashes))
    h, k = hashes[order], setting[order]
    line = np.append(True, h[1:] != h[:-1])
    new = line | np.append(True, k[1:] != k[:-1])
    number = np.cumsum(line) - 1
    many = np.bincount(number, new) >= SETTINGS
    out = np.zeros(len(hashes), bool)
    out[order] = many[number]
    return out


def recoded(chain: Chain, x: np.ndarray, y: np.ndarray, length: np.ndarray, chars: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The best labels of lines by which each text (label y: 0 content, 1 boilerplate) has the verdict that its label says."""
    first = np.append(0, np.cumsum(length))[:-1]
    owner = np.repeat(np.arange(len(length)), length)
    label = np.repeat(y, length).astype(np.int8)
    open_ = np.ones(len(length), bool)
    for shift in SHIFTS:
        found = chain.viterbi(x, first, length, np.where(known, 1e3, np.where(y == 1, shift, -shift)[owner]))
        share = np.bincount(owner, chars * (found == 0), len(length)) / np.maximum(np.bincount(owner, chars, len(length)), 1)
        fits = open_ & ((share >= SHARE) == (y == 0))
        label[fits[owner]] = found[fits[owner]]
        open_ &= ~fits
    # texts that known lines decide against their label keep it for the other lines
    label[known] = 1
    return label


def ascend(chain: Chain, x: np.ndarray, y: np.ndarray, label: np.ndarray, length: np.ndarray, moves: bool = True, l2: float = 0.01) -> Chain:
    """Gradient ascent on the mean log-likelihood of a line, given the lines' labels; ``moves``: of neighbours too."""
    first = np.append(0, np.cumsum(length))[:-1]
    label = label.astype(float)
    # every text weighs the same, and each class half
    per_text = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / np.maximum(length, 1)
    m, v = np.zeros(len(START) + 4), np.zeros(len(START) + 4)
    for t in range(1, STEPS + 1):
        p, pair, owner, inner = chain.expected(x, first, length)
        w = per_text[owner]
        g = x.T @ (w * (label - p)) - l2 * (chain.weights - START) / 10
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[inner].astype(int), label[inner + 1].astype(int)), w[inner])
        gm = seen - (pair * w[inner][:, None, None]).sum(0) - l2 * chain.move
        g = np.concatenate([g, gm.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        chain = Chain(chain.weights + step[: len(START)], chain.move + step[len(START) :].reshape(2, 2) * moves)
    return chain


def train(x: np.ndarray, y: np.ndarray, length: np.ndarray, chars: np.ndarray, hashes: np.ndarray) -> Chain:
    """A chain from texts with labels y (0 content, 1 boilerplate) and the lines of each."""
    known = set_lines(hashes, length)
    label = np.where(known, 1, np.repeat(y, length))
    chain = ascend(Chain(START.copy(), np.zeros((2, 2))), x, y, label, length, moves=False)
    for _ in range(RECODED):
        chain = ascend(chain, x, y, recoded(chain, x, y, length, chars, known), length)
    return chain


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(1)):
                lines = Lines(data, offsets)
                x = lines.x.astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.string()), b.column(2).slice(lo, hi - lo), *(pa.array([v[a : a + k].tobytes() for a, k in zip(lines.first, lines.length)], pa.binary()) for v in (x, lines.chars.astype(np.int32), lines.hash))], ["id", "y", "x", "chars", "hash"])

    rows = labelled_sample(docs, labels, label, sample, doc_id, text).repartition(PARTS, "id").mapInArrow(tidy(run), "id string, y int, x binary, chars binary, hash binary").collect()
    rows = sorted((r for r in rows if r["x"]), key=lambda r: (r["id"], r["y"], r["x"]))
    if len({r["y"] for r in rows}) < 2:
        return default_chain()
    x = np.concatenate([np.frombuffer(r["x"], np.int8).reshape(-1, len(FEATURES)) for r in rows]).astype(float)
    joined = lambda name, kind: np.frombuffer(b"".join([bytes(r[name]) for r in rows]), kind)
    return train(x, np.array([1 - r["y"] for r in rows]), np.array([len(r["x"]) // len(FEATURES) for r in rows]), joined("chars", np.int32).astype(float), joined("hash", np.uint64))


def judge(data: np.ndarray, offsets: np.ndarray, chain: Chain) -> list:
    lines = Lines(data, offsets)
    label = chain.viterbi(lines.x, lines.first, lines.length)
    content = per_row(lines.row, lines.n, lines.chars * (label == 0))
    share = content / np.maximum(per_row(lines.row, lines.n, lines.chars.astype(float)), 1)
    failed = lines.base_failed()
    return [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup, lines.n_repeat, failed, ~failed & (share >= SHARE), share, lines.length, per_row(lines.row, lines.n, (label == 0).astype(float)).astype(np.int64)]


def judge_documents(docs: DataFrame, chain: Chain, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """docs with a struct of the base counts and the verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    name = free_name(docs.columns, "_lines")

    def make():
        return lambda data, offsets: judge(data, offsets, shared.value)

    return append_result(docs, text, make, RESULT, name, keep_text), name


def op7_line_labels(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged, name = judge_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep_text=False)
    return judged.select("doc_id", f"`{name}`.*")


def brute_base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """Plain restatement of the base counts for tests."""
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + WINDOW)}
    had, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in had
            had.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(words) < MIN_WORDS or 100 * len(hit) > REPEAT_PERCENT * len(words)
