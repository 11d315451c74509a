"""Language model: hashed maximum entropy with n-gram and skip features and a class-factored softmax.

Tokens are lower-cased words and one end a text. Every token of the training texts has a class, by how often it occurs and
how it ends, and within the class a leaf, by bits of its hash. P(token | context) = P(class | context) * P(leaf | class,
context) * P(token | leaf). Classes and leaves are reached by two-way softmaxes down a tree; each of these, within classes
too, has hashed features of the three tokens before: the nearest (n-gram), the second nearest (skip), the endings of all
three (n-gram of endings), and none (bias). So all tokens count as context and all have weights of context, rare ones too. Within a leaf, tokens go by their exact counts. A token never seen in training is of the rare
class; by endings, such tokens get what absolute discounting takes from the seen rare ones.

Counts are exact and cover all training tokens: sums by token with map-side combination. The most frequent tokens, at most
``HEAD``, are broadcast with their counts; all others are the rare class, and their counts are joined to the documents that
hold them, token by token. No text is shuffled.

Training is by distributed gradient updates: ``ROUNDS`` rounds over different training documents (all of them in the end).
All tasks of a round work from the same weights and send the gradient and the curvature of each hashed weight; the sums,
which do not depend on how documents are dealt to tasks, move the weights. Their number, at most 2**BITS, bounds memory.

Defined results: a null or empty text is its end alone; without training documents every count is 0 and every way of the
tree equally likely; repeated rows score alike and count each; a null id counts as the empty text's crc; other columns are
ignored; an empty table gives no rows. Tokens are known by 60-bit hashes and four bits of their ending.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.core import BASE, NOT_SPACE, crc_mod, free, mix, per_row, shared_table, slices, tidy, tune, word_hashes, words_of

FOLDS, HELD = 10, 0
SMOOTH = 0.1  #: of the base
HEAD = 1 << 20  #: most tokens that are broadcast
BANDS, ENDINGS = 8, 16  #: classes: band 0 is the rare one
CLASS_BITS = 7
DEPTH, RARE_DEPTH = 7, 4  #: two-way steps within a class, at most
BITS = 22  #: of hashed weights, at most
ROUNDS = 3
RATE = 0.6
DAMPING, CROWD = 0.4, 8.0  #: of the curvature: a fixed part, and one for every so many uses that share a weight
DISCOUNT = 0.5
TASK_BYTES = 128 << 20  #: of text that a training task works on, at least
BATCH = 32768
FLUSH = 4 << 20  #: uses of weights that are added up at once
STRETCH = 16  #: bits of a stretch of weights, as they are sent
END = np.uint64(0xE9D0E9D0E9D0E9D0)  #: the end token; words with this hash would need 2**64 words

_STEP, _SLOT = np.uint64(BASE), np.uint64(0xD6E8FEB86659FD93)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, row of each): words in order, then the end. The last four bits tell a word's ending."""
    n = len(offsets) - 1
    starts, ends, row = words_of(data, offsets, NOT_SPACE)
    h = word_hashes(data, starts, ends)
    last = data[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)] if len(data) else 0, 0).astype(np.uint64) if len(ends) else last
    ending = mix((last | np.uint64(32)) * np.uint64(256) + (before | np.uint64(32))) >> np.uint64(60)
    out = np.full(len(h) + n, END)
    out[np.arange(len(h)) + row] = (h & ~np.uint64(15)) | ending
    rows = np.repeat(np.arange(n), per_row(row, n) + 1)
    return out, rows


def contexts(tokens: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Hashed features of what stands before each token of its own row; the last is the same for all."""
    ago = []
    for k in (1, 2, 3):
        x = np.full(len(tokens), np.uint64(7))
        same = rows[k:] == rows[:-k]
        x[k:][same] = tokens[:-k][same]
        ago.append(x)
    a, b, c = ago
    endings = (a & np.uint64(15)) << np.uint64(8) | (b & np.uint64(15)) << np.uint64(4) | (c & np.uint64(15))
    return [mix(a ^ np.uint64(0x1111)), mix(b ^ np.uint64(0x2222222222)), mix(endings + np.uint64(0x5555 << 40)), np.full(len(tokens), np.uint64(0x123456789))]


def _add(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], gradient: np.ndarray, curvature: np.ndarray) -> None:
    """Add (slots, gradients, curvatures) up; one pass over many of them at once."""
    slots = np.concatenate([s for s, _, _ in held])
    for total, k in ((gradient, 1), (curvature, 2)):
        total += np.bincount(slots, np.concatenate([x[k] for x in held]), len(total))


class Model:
    """Frequent tokens with their counts, classes and leaves, and the hashed weights."""

    def __init__(self, head: np.ndarray, count: np.ndarray, rare: dict[int, tuple[int, int]], total: int, types: int, bits: int = BITS):
        """rare: (tokens, types) of each leaf of the rare class, by its code."""
        order = np.argsort(head)
        self.head, self.count = head[order], count[order].astype(np.int64)
        self.total, self.types, self.bits = total, types, bits
        low, high = (np.log2(self.count.min()), np.log2(self.count.max())) if len(head) else (0.0, 0.0)
        self.band = (1 + np.minimum(BANDS - 2, (np.log2(self.count) - low) / (high - low + 1e-9) * (BANDS - 1)).astype(np.int64)).astype(np.uint8)
        members = np.bincount(self.band.astype(np.int64) * ENDINGS + (self.head & np.uint64(15)).astype(np.int64), minlength=BANDS * ENDINGS)
        self.depth = np.minimum(DEPTH, np.ceil(np.log2(np.maximum(members, 1)))).astype(np.int64)
        self.depth[:ENDINGS] = RARE_DEPTH
        self.weight = np.zeros(1 << bits, np.float32)
        leaf = self._leaf(*self._code(self.head, self.band))
        mass = np.bincount(leaf, self.count, 1 << (CLASS_BITS + DEPTH))
        self.share = np.log10(self.count / mass[leaf]) if len(head) else np.zeros(0)
        self.rare = rare
        self._prepare()

    def _prepare(self) -> None:
        self.first = np.searchsorted(self.head, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "first"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def _code(self, tokens: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class and bits of the hash, number of two-way steps)."""
        kind = band.astype(np.int64) * ENDINGS + (tokens & np.uint64(15)).astype(np.int64)
        return kind << DEPTH | (tokens >> np.uint64(4)).astype(np.int64) & ((1 << DEPTH) - 1), CLASS_BITS + self.depth[kind]

    @staticmethod
    def _leaf(code: np.ndarray, steps: np.ndarray) -> np.ndarray:
        unread = CLASS_BITS + DEPTH - steps
        return code >> unread << unread

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Index of each token among the frequent ones, -1 for others."""
        out = np.full(len(tokens), -1, np.int64)
        if not len(self.head):
            return out
        at = self.first[(tokens >> np.uint64(44)).astype(np.int64)].astype(np.int64)
        live = np.arange(len(tokens))
        while len(live):
            k = at[live]
            there = self.head[np.minimum(k, len(self.head) - 1)]
            mine = tokens[live]
            same = (there == mine) & (k < len(self.head))
            out[live[same]] = k[same]
            live = live[(there < mine) & (k < len(self.head))]
            at[live] += 1
        return out

    def rare_parts(self) -> list[tuple[int, float, float]]:
        """(leaf, log10 share of one count of a seen token, of an unseen token) of the rare class, all by endings."""
        tokens, types = np.zeros(ENDINGS << DEPTH), np.zeros(ENDINGS << DEPTH)
        for leaf, (n, t) in self.rare.items():
            tokens[leaf], types[leaf] = n, t
        whole = tokens.reshape(ENDINGS, -1).sum(1)
        unseen = np.where(whole > 0, DISCOUNT * types.reshape(ENDINGS, -1).sum(1) / np.maximum(whole, 1), 1.0)
        return [(leaf, float(np.log10((1 - unseen[leaf >> DEPTH]) / (tokens[leaf] - DISCOUNT * types[leaf]))) if types[leaf] else 0.0, float(np.log10(unseen[leaf >> DEPTH]))) for leaf in range(0, ENDINGS << DEPTH, 1 << (DEPTH - RARE_DEPTH))]

    def steps(self, tokens: np.ndarray, rows: np.ndarray, found: np.ndarray, gradient: np.ndarray | None = None, curvature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log10 of P(class | context) and P(leaf | class, context) of each token; adds to gradient and curvature of the
        weights if these are given."""
        code, steps = self._code(tokens, np.where(found >= 0, self.band[found] if len(self.head) else 0, 0))
        return self.walk(code, steps, contexts(tokens, rows), gradient, curvature)

    def walk(self, code: np.ndarray, steps: np.ndarray, features: list[np.ndarray], gradient: np.ndarray | None = None, curvature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same for given codes, numbers of steps and contexts."""
        order = np.argsort(-steps, kind="stable")  # tokens still on their way are in front at every step
        features = [f[order] for f in features]
        code, steps = code[order], steps[order]
        out = np.zeros((2, len(code)), np.float32)
        held, waiting = [], 0
        shift = np.uint64(64 - self.bits)
        for a in range(0, len(code), BATCH):
            c, n, some = code[a : a + BATCH], steps[a : a + BATCH], [f[a : a + BATCH] for f in features]
            log = np.zeros((2, len(c)), np.float32)
            for j in range(int(n[0])):
                k = int(np.searchsorted(-n, -j, "left"))
                left = CLASS_BITS + DEPTH - j
                node = (c[:k] >> left | 1 << j).astype(np.uint64) * _STEP
                right = (c[:k] >> (left - 1) & 1).astype(bool)
                slots, z = [], None
                # endings tell classes, which have endings, but no bits of a hash
                for f in some if j < CLASS_BITS else (*some[:2], some[3]):
                    s = f[:k] ^ node
                    s *= _SLOT
                    s >>= shift
                    slots.append(s.view(np.int64))
                    w = self.weight.take(slots[-1], mode="clip")
                    z = w if z is None else z + w
                np.negative(z, out=z, where=right)
                other = np.exp(np.clip(z, -30, 30, out=z), out=z)  # odds of the way not taken
                log[int(j >= CLASS_BITS), :k] -= np.log1p(other)
                if gradient is not None:
                    p = other / (1 + other)
                    g, h = np.where(right, p, -p), p * (1 - p)
                    held += [(s, g, h) for s in slots]
                    waiting += k * len(slots)
                    if waiting > FLUSH:
                        _add(held, gradient, curvature)
                        held, waiting = [], 0
            out[:, a : a + BATCH] = log
        if held:
            _add(held, gradient, curvature)
        back = np.empty(out.shape)
        back[:, order] = out
        return back[0] / np.log(10), back[1] / np.log(10)


# ---------------------------------------------------------------------------------------------------- over a cluster


def keyed_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    held = crc_mod(F.col(doc_id), FOLDS) == HELD
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held.alias("held")).withColumns({"k1": F.xxhash64("id", "text"), "k2": F.hash("id", "text")})


def token_counts(keyed: DataFrame) -> DataFrame:
    """(h, c): every token of the training documents and how often it occurs."""

    def run(batches):
        for b in batches:
            for _, _, data, offsets in slices(b.column(0), 4 << 20):
                h, c = np.unique(tokens_of(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return keyed.where(~F.col("held")).select("text").mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _rare_leaf(h):
    """Code of a rare token's leaf: its ending, and the first bits that the tree reads of its hash."""
    read = ((1 << RARE_DEPTH) - 1) << (DEPTH - RARE_DEPTH)
    return F.shiftleft(h.bitwiseAND(F.lit(15)), DEPTH).bitwiseOR(F.shiftright(h, 4).bitwiseAND(F.lit(read))).cast("int")


def start(counts: DataFrame, head: int = HEAD, bits: int = BITS) -> Model:
    """The model before training: exact counts, weights of 0. A token of the head occurs twice at least."""
    size = {r["k"]: (r["types"], r["tokens"]) for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("tokens")).collect()}
    types, total = sum(n for n, _ in size.values()), sum(n for _, n in size.values())
    least = 1
    while sum(n for k, (n, _) in size.items() if k >= least) > head:
        least += 1
    frequent = counts.where(F.floor(F.log2("c")) >= least).toArrow()
    rare = {r["leaf"]: (r["tokens"], r["types"]) for r in counts.where(F.floor(F.log2("c")) < least).groupBy(_rare_leaf(F.col("h")).alias("leaf")).agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types")).collect()}
    # several weights for every token of the corpus, within the bound
    return Model(frequent.column("h").to_numpy().view(np.uint64), frequent.column("c").to_numpy(), rare, total, types, min(bits, max(STRETCH, int(total).bit_length() + 3)))


def train(keyed: DataFrame, model: Model) -> Model:
    spark = keyed.sparkSession
    training = keyed.where(~F.col("held"))
    damping = DAMPING + model.total * (CLASS_BITS + DEPTH) / (CROWD) / (1 << model.bits)
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, min(-(-int(size) // TASK_BYTES), 8 * spark.sparkContext.defaultParallelism))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            m = shared.value
            g, h, n = np.zeros(1 << m.bits, np.float32), np.zeros(1 << m.bits, np.float32), 0
            for b in batches:
                for _, _, data, offsets in slices(b.column(0)):
                    t, rows = tokens_of(data, offsets)
                    m.steps(t, rows, m.find(t), g, h)
                    n += len(t)
            if n:
                for a in range(0, len(g), 1 << STRETCH):
                    z = a + (1 << STRETCH)
                    yield pa.RecordBatch.from_arrays([pa.array([a >> STRETCH], pa.int32()), pa.array([g[a:z].tobytes()], pa.binary()), pa.array([h[a:z].tobytes()], pa.binary())], ["s", "g", "h"])

        def add(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for s, g, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    held.setdefault(s, np.zeros((2, 1 << STRETCH)))
                    held[s] += np.stack([np.frombuffer(g, np.float32), np.frombuffer(h, np.float32)])
            for s, (g, h) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([(RATE * g / (h + damping)).astype(np.float32).tobytes()], pa.binary())], ["s", "step"])

        some = training.where(F.pmod(F.xxhash64("text", "id"), F.lit(ROUNDS)) == k).select("text").coalesce(tasks)
        for r in some.mapInArrow(tidy(run), "s int, g binary, h binary").repartition("s").mapInArrow(tidy(add), "s int, step binary").toLocalIterator():
            model.weight[r["s"] << STRETCH : (r["s"] + 1) << STRETCH] += np.frombuffer(r["step"], np.float32)
        shared.unpersist()
        free(spark)
    return model


def score_documents(keyed: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    spark = keyed.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = keyed.schema["id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        known_base = np.log10(m.count + SMOOTH)
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(0)):
                n = len(offsets) - 1
                t, rows = tokens_of(data, offsets)
                k = m.find(t)
                known = k >= 0
                at = k[known]
                log, path = m.steps(t, rows, k)
                log[known] += path[known] + m.share[at]
                base = np.zeros(len(t))
                base[known] = known_base[at]
                # the others' counts are not here
                rare, rare_row, path = t[~known], rows[~known], path[~known]
                order = np.lexsort((rare, rare_row))
                rare, rare_row, path = rare[order], rare_row[order], path[order]
                first = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1]))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rare)))
                path = np.add.reduceat(path, first) if len(first) else path
                cut = pa.array(np.searchsorted(rare_row[first], np.arange(n + 1)).astype(np.int32))
                own = slice(lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i)[own] for i in (1, 2, 3, 4)), pa.array(per_row(rows, n)), pa.array(per_row(rows, n, known.astype(float)).astype(np.int64)), pa.array(per_row(rows, n, base)), pa.array(per_row(rows, n, log)),
                        pa.ListArray.from_arrays(cut, pa.array(rare[first].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(path)),
                    ], ["id", "held", "k1", "k2", "n", "known", "base", "score", "rare", "times", "path"],
                )

    schema = f"id {kind}, held boolean, k1 long, k2 int, n long, known long, base double, score double, rare array<long>, times array<int>, path array<double>"
    parts = shared_table(keyed.select("text", "id", "held", "k1", "k2").mapInArrow(tidy(run), schema))
    leaves = spark.createDataFrame(model.rare_parts(), "leaf int, seen double, unseen double")
    uses = parts.where(F.size("rare") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode(F.arrays_zip("rare", "times", "path")).alias("u")).select("k1", "k2", F.col("u.rare").alias("h"), F.col("u.times").alias("times"), F.col("u.path").alias("path"))
    # at most as many leaves as the tree has: a bounded table
    uses = uses.join(counts, "h", "left").withColumn("leaf", _rare_leaf(F.col("h"))).join(F.broadcast(leaves), "leaf")
    seen = F.col("c").isNotNull()
    token = F.when(seen, F.col("path") + F.col("times") * (F.log10(F.col("c") - DISCOUNT) + F.col("seen"))).otherwise(F.col("times") * F.col("unseen"))
    rest = uses.groupBy("k1", "k2").agg(F.sum(F.when(seen, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("rare_base"), F.sum(token).alias("rare_score"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_ = float(np.log10(model.total + SMOOTH * (model.types + 1)))
    return parts.drop("rare", "times", "path").join(rest, ["k1", "k2"], "left").select(
        F.col("id").alias("doc_id"), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + zero("more")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base") - F.col("n") * F.lit(all_)).alias("base_score"), (F.col("score") + zero("rare_score")).alias("score"),
    )


def score_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, bits: int = BITS) -> DataFrame:
    tune(docs.sparkSession)
    keyed = keyed_documents(docs, doc_id, text)
    counts = shared_table(token_counts(keyed))
    free(docs.sparkSession)
    return score_documents(keyed, counts, train(keyed, start(counts, head, bits)))


def op9_maximum_entropy(spark, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_base(docs: list[tuple]) -> dict:
    """Plain restatement of the base for tests: {doc_id: (n_tokens, n_known, N, base)}."""
    import math
    import re
    import zlib
    from collections import Counter

    low = lambda s: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")) + [None]
    toks = [(d, low(t)) for d, t in docs]
    c = Counter(x for d, t in toks if zlib.crc32(str(d).encode()) % FOLDS != HELD for x in t)
    n, v = sum(c.values()), len(c)
    return {d: (len(t), sum(x in c for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for d, t in toks}
