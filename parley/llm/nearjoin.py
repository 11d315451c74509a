"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle windows, exact recursion.

Jaccard distance d between the sets of word shingles is a metric; documents link when d is within the radius of the
``Rule``: words in a shingle and least share in common. The default is op4's contract, 3 words and nine tenths; the
pipeline joins by ``CORPUS``, 5 words and eight tenths. Wanted are the groups that links connect.

1. Documents with the same set are one point. Points start in regions by signatures: two sets within the radius differ in
   at most a ninth of the smaller (a quarter, at eight tenths), so if the shingles are dealt by hash to some more parts than
   that, at least one part is equal in both. Points with an equal part, and what they connect to, are one region; no linked
   pair is apart.
2. A region too large for a task is first parted by its rare shingles: in the order of how many members hold a shingle, two
   linked sets must share one among the first of each (those beyond the least share in common). Unlike texts that met by
   chance share no rare shingle, so they part; copies stay together.
3. A region picks pivots, and every member's distance to each is computed: members within the radius are linked. Pivots far
   from each other create Voronoi regions: a member belongs to the nearest pivot p within reach (``reach``) and, by the
   triangle inequality, is also needed in the region of pivot q if d(x, q) <= d(x, p) + 2 * radius. Members out of every
   pivot's reach are a region of their own, with a boundary of the radius. Pivots are done; the regions are joined the same
   way. Members already connected need no comparison with each other, and a region whose members are all connected is
   finished. Where regions no longer part (all members near each other), members are compared within windows: two can only
   link if their distances to every pivot differ by no more than the radius.
4. Regions of up to ``REGION_SHINGLES`` shingles recurse within a task. Larger ones do a round of steps 2 and 3 across the
   cluster (members stay spread in blocks of bounded size; only the pivots' sets, a bounded number, go to all of them). A round
   counts only if it at least halves a region without copying much of it; where it doesn't, every two blocks of the region
   meet in a task, so there are never more rounds than halvings.

Nothing is dropped or capped. Shingles and sets are known by 64-bit hashes.

Defined results: a null or wordless text has the empty set, links with nothing and is its own component; fewer
words than a shingle has are one shingle; repeated rows are one point, and so one group; a null id groups as the largest; other columns are
carried along; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.core import NOT_SPACE, free, gram_hashes, grams_inside, join_back, key_filter, mix, passing, per_row, shared_checkpoint, shared_table, slices, tidy, tune, word_hashes, words_of
from parley.llm.graph import components

SHINGLE = 3
NUMERATOR, DENOMINATOR = 90, 100  #: least share of the union that two sets have in common
SPARE = 2  #: parts beyond those that can differ, at least, so that texts may leave out their empty ones
SIZE_RATIO = 1.5
REGION_SHINGLES = 1 << 21
PIVOTS = 8
ROUND_PIVOTS = 32  #: of a region that is spread over the cluster
BLOCK_SHINGLES = 1 << 18  #: of such a region's blocks and of the stretches its shingles are counted in
COPIED = 1.5  #: regions that need more copies of their members than this, in a task or across the cluster, do not part


@dataclass(frozen=True)
class Rule:
    """When two texts are near copies, and how much a size class spans (at least what two linked sizes can differ by)."""

    words: int = SHINGLE
    numerator: int = NUMERATOR
    denominator: int = DENOMINATOR
    size_ratio: float = SIZE_RATIO

    def __post_init__(self):
        if self.words < 1 or not 0 < self.numerator < self.denominator or self.size_ratio * self.numerator < self.denominator:
            raise ValueError(f"no join by {self}")

    @property
    def radius(self) -> float:
        return 1 - self.numerator / self.denominator

    def differing(self, smaller: int) -> int:
        """Most shingles that are in one only of two linked sets."""
        return smaller * (self.denominator - self.numerator) // self.numerator

    @property
    def reach(self) -> float:
        """Most distance from a member to the pivot it belongs to; unlike texts, at distance 1, are out of reach."""
        return 1 - 2 * self.radius

    def first(self, n):
        """Of n shingles in one order for all sets: among how many of the first two linked sets share one."""
        return n - -(-n * self.numerator // self.denominator) + 1

    def linked(self, common, a, b):
        return self.denominator * common >= self.numerator * (a + b - common)


CONTRACT = Rule()
CORPUS = Rule(5, 80, 100, 1.25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes of each text, one after the other; where each text's begin)."""
    n = len(offsets) - 1
    starts, ends, row = words_of(data, offsets, NOT_SPACE)
    words = word_hashes(data, starts, ends)
    count = per_row(row, n)
    inside = grams_inside(row, shingle)
    hashes, rows = [gram_hashes(words, shingle)[inside]], [row[: len(inside)][inside]]
    first = np.searchsorted(row, np.arange(n))
    for k in range(1, shingle):
        short = np.flatnonzero(count == k)
        if len(short):
            hashes.append(gram_hashes(words[first[short][:, None] + np.arange(k)].T, k, k)[0])
            rows.append(short)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(r[order].astype(np.uint16) if n < 65536 else r[order], kind="stable")]
    h, r = h[order], r[order]
    new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])) if len(h) else np.zeros(0, bool)
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(n + 1))


def size_classes(most: int, rule: Rule = CONTRACT) -> np.ndarray:
    # smaller sets link only with equal ones
    out = [-(-rule.numerator // (rule.denominator - rule.numerator))]
    while out[-1] <= most:
        out.append(int(np.ceil(out[-1] * rule.size_ratio)))
    return np.array(out)


def class_parts(bounds: np.ndarray, rule: Rule = CONTRACT) -> tuple[np.ndarray, np.ndarray]:
    """(parts, spare ones) of each size class: so many that, but for rare texts, more parts are filled than can differ."""
    parts, spares = [], []
    for low, above in zip(bounds.tolist(), bounds[1:].tolist()):
        need, spare = rule.differing(above - 1) + 1, SPARE
        while spare < 4 * low:
            load = low / (need + spare)
            empty = np.exp(-load)
            if (need + spare) * (1 - empty) - 3 * np.sqrt((need + spare) * (empty - (1 + load) * empty**2)) >= need:
                break
            spare += max(1, spare // 16)
        parts.append(need + spare)
        spares.append(spare)
    return np.array(parts, np.int64), np.array(spares, np.int64)


def signatures(h: np.ndarray, cut: np.ndarray, rule: Rule = CONTRACT) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the parts of each set: for its size class, and for the class below if a partner can be there.

    Of the parts that two linked sets have equal there is one more than are spare. Each set leaves out as many as are
    spare, those of fewest shingles (of these, of smallest signature). The last of the equal parts in that order has all
    the others before it, so neither leaves it out."""
    size = np.diff(cut)
    bounds = size_classes(int(size.max(initial=0)), rule)
    class_size, class_spare = class_parts(bounds, rule)
    own = np.searchsorted(bounds, size, "right") - 1
    rows, out = [], []
    for shift in (0, 1):
        k = own - shift
        some = (k >= 0) if not shift else (k >= 0) & (-(-size * rule.numerator // rule.denominator) < bounds[np.maximum(own, 0)])
        r = np.flatnonzero(some)
        if not len(r):
            continue
        parts = np.zeros(len(size), np.int64)
        parts[r] = class_size[k[r]]
        spare = np.zeros(len(size), np.int64)
        spare[r] = class_spare[k[r]]
        base = np.append(0, np.cumsum(parts))
        element_row = np.repeat(np.arange(len(size)), size)
        use = some[element_row]
        e, er = h[use], element_row[use]
        mixed = mix(e ^ np.uint64(0x51ED270B0F0E1B23))
        slot = base[er] + ((mixed >> np.uint64(32)).astype(np.int64) % parts[er])
        order = np.argsort(slot, kind="stable")
        slot, mixed = slot[order], mix(mixed[order])
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        filled = slot[first]
        total = np.zeros(base[-1], np.uint64)
        total[filled] = np.add.reduceat(mixed, first)
        held = np.bincount(slot, minlength=base[-1])
        part_row = np.repeat(np.arange(len(size)), parts)
        part = np.arange(base[-1]) - base[part_row]
        sig = mix(total ^ mix(part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + k[part_row].astype(np.uint64) + np.uint64(1)))
        ranked = np.lexsort((sig, held, part_row))
        keep = np.sort(ranked[part >= spare[part_row]])
        rows.append(part_row[keep])
        out.append(sig[keep])
    return (np.concatenate(rows), np.concatenate(out)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def point_ids(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set."""
    raw, at = h.tobytes(), (cut * 8).tolist()
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:z], digest_size=8).digest(), "little", signed=True) for a, z in zip(at, at[1:])], np.int64)


# ------------------------------------------------------------------------------------------------- within a region


class Region:
    """Sets laid out one after the other, with their connected parts."""

    def __init__(self, sets: list[np.ndarray], part: list[int], rule: Rule = CONTRACT):
        self.rule = rule
        self.h = np.concatenate(sets)
        self.size = np.array([len(s) for s in sets])
        self.cut = np.append(0, np.cumsum(self.size))
        names: dict[int, int] = {}
        self.up = [names.setdefault(p, i) for i, p in enumerate(part)]
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def common(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Shingles that each member shares with the pivot."""
        p = self.h[self.cut[pivot] : self.cut[pivot + 1]]
        size = self.size[members]
        at = np.repeat(self.cut[members] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
        x = self.h[at]
        k = np.searchsorted(p, x)
        k[k == len(p)] = 0
        return np.add.reduceat((p[k] == x).astype(np.int64), np.append(0, np.cumsum(size))[:-1])

    def join(self) -> list[tuple[int, int]]:
        todo = [np.arange(len(self.size))]
        while todo:
            members = todo.pop()
            roots = np.array([self.root(i) for i in members.tolist()])
            values, count = np.unique(roots, return_counts=True)
            if len(values) < 2:
                continue
            # the first pivot from the smallest part: small parts are what is still to be connected; the next ones far off
            at = int(count[np.searchsorted(values, roots)].argmin())
            near = np.full(len(members), np.inf)
            d = np.empty((len(members), min(PIVOTS, len(members))))
            chosen = []
            for k in range(d.shape[1]):
                p = int(members[at])
                chosen.append(at)
                c = self.common(p, members)
                d[:, k] = 1 - c / (self.size[members] + self.size[p] - c)
                for i in members[self.rule.linked(c, self.size[members], self.size[p])].tolist():
                    self.link(i, p)
                near = np.minimum(near, d[:, k])
                near[chosen] = -1
                at = int(near.argmax())
            rest = np.ones(len(members), bool)
            rest[chosen] = False
            if not rest.any():
                continue
            cells = voronoi(d[rest][:, apart(d[chosen], self.rule)], self.rule)
            if sum(map(len, cells)) > COPIED * rest.sum() or max(map(len, cells)) == rest.sum():
                self._windows(members[rest], d[rest])
            else:
                todo += [members[rest][r] for r in cells]
        return self.links

    def _windows(self, members: np.ndarray, d: np.ndarray) -> None:
        """Compare members whose sizes and distances to every pivot allow a link: by the triangle inequality these differ by
        no more than the radius."""
        order = np.argsort(self.size[members], kind="stable")
        members, d = members[order], d[order]
        size = self.size[members]
        last = np.searchsorted(self.rule.numerator * size, self.rule.denominator * size, "right")
        for i, m in enumerate(members.tolist()):
            lo, hi = i + 1, int(last[i])
            if lo >= hi:
                continue
            close = np.flatnonzero((np.abs(d[lo:hi] - d[i]) <= self.rule.radius + 1e-9).all(1)) + lo
            mine = self.root(m)
            close = [int(j) for j in members[close].tolist() if self.root(j) != mine]
            if close:
                close = np.array(close)
                for j in close[self.rule.linked(self.common(m, close), self.size[m], self.size[close])].tolist():
                    self.link(m, j)


def apart(d: np.ndarray, rule: Rule) -> list[int]:
    """Pivots (of those with distances d to each other) that are far enough from each other to part regions."""
    out: list[int] = []
    for k in range(len(d)):
        if all(d[k, j] > 2 * rule.radius for j in out):
            out.append(k)
    return out


def voronoi(d: np.ndarray, rule: Rule = CONTRACT) -> list[np.ndarray]:
    """Members (rows of distances d) of each pivot's region with its boundary, and of the region out of reach.

    Say x is linked with y, and p is nearest to x. Within reach, d(y, p) <= d(x, p) + radius, which is at most reach + radius
    and, as no pivot is nearer to y than d(x, p) - radius, at most 2 * radius more than y's nearest: y is in p's region too.
    Out of reach, y is beyond reach - radius from all pivots."""
    near = d.min(1)
    needed = d <= np.minimum(near + 2 * rule.radius, rule.reach + rule.radius)[:, None] + 1e-9
    far = near > rule.reach
    home = np.where(far, -1, d.argmin(1))
    out = [np.flatnonzero(needed[:, k]) for k in range(d.shape[1]) if (home == k).any()]
    return out + ([np.flatnonzero(near > rule.reach - rule.radius - 1e-9)] if far.any() else [])


# ---------------------------------------------------------------------------------------------------- over a cluster


def _points(keyed: DataFrame, signs: bool, rule: Rule) -> DataFrame:
    """Each text's (k1, k2, point, size), or the distinct (signature, point) of a slice."""

    def run(batches):
        for b in batches:
            k1, k2 = b.column(1), b.column(2)
            for lo, hi, data, offsets in slices(b.column(0)):
                h, cut = shingle_sets(data, offsets, rule.words)
                e = point_ids(h, cut)
                if not signs:
                    yield pa.RecordBatch.from_arrays([k1.slice(lo, hi - lo), k2.slice(lo, hi - lo), pa.array(e), pa.array(np.diff(cut))], ["k1", "k2", "e", "n"])
                    continue
                # copies within the slice sign once
                _, first = np.unique(e, return_index=True)
                first = np.sort(first)
                size = np.diff(cut)[first]
                at = np.repeat(cut[first] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
                row, sig = signatures(h[at], np.append(0, np.cumsum(size)), rule)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(e[first][row])], ["sig", "e"])

    return keyed.select("text", "k1", "k2").mapInArrow(tidy(run), "sig long, e long" if signs else "k1 long, k2 int, e long, n long")


def _shared(signs: DataFrame) -> DataFrame:
    """(a, b): each point that shares a signature, with the smallest point of that signature; one shuffle, in a stream."""

    def run(batches):
        sig, low = None, None
        for b in batches:
            if not len(b):
                continue
            s, e = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.append(s[0] != sig, s[1:] != s[:-1])
            at = np.flatnonzero(new)
            lows = e[at] if new[0] else np.append(low, e[at])
            smallest = lows[np.cumsum(new) - new[0]]
            sig, low = s[-1], smallest[-1]
            other = e != smallest
            pairs = np.unique(np.stack([e[other], smallest[other]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return signs.repartition("sig").sortWithinPartitions("sig", "e").mapInArrow(tidy(run), "a long, b long")


def _by_rare_shingles(members: DataFrame, rule: Rule) -> DataFrame:
    """(home, e, n, region): members of large regions that share one of their rarest shingles, by the order of their own region.
    A point that stands in several regions is a member of each by itself, so that regions never run together.

    A region's shingles are dealt to stretches of bounded size, so that many tasks count them; shingles are known by 32 bits
    within a stretch, as any order that is the same for all members will do."""

    def deal(batches):
        for b in batches:
            out = {"region": [], "b": [], "e": [], "n": [], "ids": []}
            for region, e, n, raw, parts in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                h = mix(np.frombuffer(raw, np.uint64) ^ np.uint64(0x6A09E667F3BCC909))
                part = (h >> np.uint64(32)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                part, ids = part[order], h[order].astype(np.uint32)
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                for a, z in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
                    for name, v in (("region", region), ("b", int(part[a])), ("e", e), ("n", n), ("ids", ids[a:z].tobytes())):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["region"], pa.int64()), pa.array(out["b"], pa.int32()), pa.array(out["e"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.binary())], list(out))

    def count(key, rows):
        """How many hold each shingle: of each member's, the number held by none else, and (holders, name) of the others."""
        size = [len(r[2]) // 4 for r in rows]
        ids = np.frombuffer(b"".join([r[2] for r in rows]), np.uint32)
        _, inverse, df = np.unique(ids, return_inverse=True, return_counts=True)
        df = df[inverse]
        name = mix(ids.astype(np.uint64) ^ mix(np.array([key[0]]).view(np.uint64) + np.uint64(key[1])))
        owner = np.repeat(np.arange(len(rows)), size)
        alone = per_row(owner[df == 1], len(rows))
        m = np.flatnonzero(df > 1)
        held = np.zeros(len(m), [("df", "<u4"), ("name", "<u8")])
        held["df"], held["name"] = df[m], name[m]
        cut = np.searchsorted(owner[m], np.arange(len(rows) + 1)).tolist()
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(alone), pa.array([held[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary())], ["region", "e", "n", "alone", "held"])

    def counts(batches):
        yield from _streamed(batches, 2, count)

    def rare(key, rows):
        held = np.sort(np.frombuffer(b"".join([r[2] for r in rows]), [("df", "<u4"), ("name", "<u8")]), order=("df", "name"))
        some = max(0, rule.first(rows[0][0]) - sum(r[1] for r in rows))
        return pa.RecordBatch.from_arrays([pa.array(held["name"][:some].astype(np.uint64).view(np.int64)), pa.array(np.full(len(held[:some]), key[1]))], ["sig", "e"])

    def rarest(batches):
        yield from _streamed(batches, 2, rare)

    parts = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    member = F.xxhash64("region", "e").alias("e")
    dealt = members.select("region", member, "n", "set", parts.alias("parts")).mapInArrow(tidy(deal), "region long, b int, e long, n long, ids binary")
    known = dealt.repartition("region", "b").sortWithinPartitions("region", "b").mapInArrow(tidy(counts), "region long, e long, n long, alone long, held binary")
    signs = known.repartition("region", "e").sortWithinPartitions("region", "e").mapInArrow(tidy(rarest), "sig long, e long")
    found = components(_shared(signs)).select(F.col("node").alias("_m"), F.col("component").alias("region"))
    return members.select(F.col("region").alias("home"), "e", "n", F.xxhash64("region", "e").alias("_m")).join(found, "_m").drop("_m")


def _streamed(batches, keys: int, work):
    """``work(key, rows)`` of every run of rows that begin with one key; rows without it."""
    rows, last = [], None
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if r[:keys] != last and rows:
                yield work(last, rows)
                rows = []
            last = r[:keys]
            rows.append(r[keys:])
    if rows:
        yield work(last, rows)


MEMBER = "region long, e long, part long, n long, total long, set binary"


def _with_sets(keyed: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """MEMBER rows of the wanted (k1, k2, region, e, total)."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(0)):
                h, cut = shingle_sets(data, offsets, rule.words)
                raw, at = h.tobytes(), (cut * 8).tolist()
                e = b.column(2).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), e, e, pa.array(np.diff(cut)), b.column(3).slice(lo, hi - lo), pa.array([raw[a:z] for a, z in zip(at, at[1:])], pa.binary())], ["region", "e", "part", "n", "total", "set"])

    keyed = passing(keyed.select("text", "k1", "k2"), "k1", key_filter(wanted, "k1", wanted.count()))
    return keyed.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "region", "e", "total").mapInArrow(tidy(run), MEMBER)


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (region, n, ...) with the shingles of their region as ``total``; rows without sets, so joins are light."""
    return rows.join(rows.groupBy("region").agg(F.sum("n").alias("total")), "region")


def _join_small(members: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) within regions that fit a task."""

    def join(_, rows):
        links = Region([np.frombuffer(r[4], np.uint64) for r in rows], [r[1] for r in rows], rule).join() if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in links], pa.int64()), pa.array([rows[j][0] for _, j in links], pa.int64())], ["a", "b"])

    def run(batches):
        yield from _streamed(batches, 1, join)

    return members.repartition("region").sortWithinPartitions("region", "e").mapInArrow(tidy(run), "a long, b long")


def _round(members: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """One round of pivots for large regions: (links, members of the new regions with the region they come from as home)."""
    slim = members.select("region", "e", "part", "total")
    ranked = slim.join(slim.groupBy("region", "part").agg(F.count(F.lit(1)).alias("weight")), ["region", "part"])
    # pivots from the smallest parts, which are what is still to be connected; a bounded state for each region
    order = F.struct(F.col("weight"), F.xxhash64("e"), F.col("e"))
    seats = ranked.groupBy("region", (F.pmod(F.xxhash64("e"), F.lit(ROUND_PIVOTS))).alias("seat")).agg(F.min_by("e", order).alias("e")).select("region", "e")
    seats = shared_table(seats)
    chosen = passing(members, "e", key_filter(seats, "e", seats.count())).join(seats, ["region", "e"])
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    pivots = chosen.withColumn("at", F.explode(F.sequence(F.lit(0), blocks - 1))).select(F.col("region").alias("home"), "at", "e", "part", "n", "set")
    spread = members.withColumn("block", F.pmod(F.xxhash64("e"), blocks).cast("int")).select("region", "block", "e", "part", "n", "set")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("home", "region", "e", "part", "n", "set", "a", "b")}
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.binary() if c == "set" else pa.int64()) for c in out})
        right = right.sort_by("e")
        ids, sets = left.column("e").to_pylist() + right.column("e").to_pylist(), left.column("set").to_pylist() + right.column("set").to_pylist()
        part = np.concatenate([left.column("part").to_numpy(), right.column("part").to_numpy()])
        all_ = Region([np.frombuffer(s, np.uint64) for s in sets], list(range(len(sets))), rule)
        n = len(left)
        d = np.empty((len(sets), len(right)))
        for k in range(len(right)):
            c = all_.common(n + k, np.arange(len(sets)))
            d[:, k] = 1 - c / (all_.size + all_.size[n + k] - c)
            for i in np.flatnonzero(rule.linked(c, all_.size, all_.size[n + k])[:n] & (part[:n] != part[n + k])).tolist():
                for c_, v in zip(out, (None, None, None, None, None, None, ids[i], ids[n + k]), strict=True):
                    out[c_].append(v)
        done = set(ids[n:])
        mine = np.flatnonzero([e not in done for e in ids[:n]])
        far = apart(d[n:], rule)
        region = left.column("region")[0].as_py()
        name = lambda k: int.from_bytes(hashlib.blake2b(f"{region}/{ids[n + k] if k >= 0 else None}".encode(), digest_size=8).digest(), "little", signed=True)
        near = d[mine][:, far].min(1)
        for k in [*range(len(far)), -1]:
            # whether a region is anybody's home is not known here: all boundaries are kept
            needed = d[mine, far[k]] <= np.minimum(near + 2 * rule.radius, rule.reach + rule.radius) + 1e-9 if k >= 0 else near > rule.reach - rule.radius - 1e-9
            for i in mine[needed].tolist():
                for c_, v in zip(out, (region, name(far[k] if k >= 0 else -1), ids[i], int(part[i]), int(all_.size[i]), sets[i], None, None), strict=True):
                    out[c_].append(v)
        return pa.table({c: pa.array(out[c], pa.binary() if c == "set" else pa.int64()) for c in out})

    made = spread.groupBy("region", "block").cogroup(pivots.groupBy("home", "at")).applyInArrow(run, "home long, region long, e long, part long, n long, set binary, a long, b long")
    done = shared_checkpoint(made)
    return done.where("a is not null").select("a", "b"), done.where("a is null").drop("a", "b")


def _pairwise(members: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) within large regions that don't part: a region's members are dealt to blocks of bounded size, and every two
    blocks (and each by itself) meet in a task. Only links come out, at most one for every two parts that a task finds one."""
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64("e"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("region", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "e", "part", "set")

    def meet(key, rows):
        if len(rows) < 2:
            return links_of([], [])
        if key[1] == key[2]:
            return links_of(Region([np.frombuffer(r[3], np.uint64) for r in rows], [r[2] for r in rows], rule).join(), rows)
        rows = sorted(rows, key=lambda r: (r[0] != key[1], len(r[3])))
        both = Region([np.frombuffer(r[3], np.uint64) for r in rows], [r[2] for r in rows], rule)
        cut = sum(r[0] == key[1] for r in rows)
        size, label = both.size[cut:], np.array([both.root(i) for i in range(len(rows))])
        for i in range(cut):
            n = both.size[i]
            # sizes of linked sets differ by no more than the rule lets them
            lo, hi = np.searchsorted(size, -(-n * rule.numerator // rule.denominator)), np.searchsorted(size, n * rule.denominator // rule.numerator, "right")
            # members of one part need no comparison
            near = np.flatnonzero(label[cut + int(lo) : cut + int(hi)] != label[i]) + cut + int(lo)
            if len(near):
                for j in near[rule.linked(both.common(i, near), n, both.size[near])].tolist():
                    if label[i] != label[j]:
                        both.link(i, j)
                        label[label == label[j]] = label[i]
        return links_of(both.links, rows)

    def links_of(links, rows):
        return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _ in links], pa.int64()), pa.array([rows[j][1] for _, j in links], pa.int64())], ["a", "b"])

    def run(batches):
        yield from _streamed(batches, 3, meet)

    return rows.repartition("region", "lo", "hi").sortWithinPartitions("region", "lo", "hi").mapInArrow(tidy(run), "a long, b long")


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with their connected part after all links so far; regions in one part are finished."""
    found = components(links)
    rows = members.select("region", "e", "n").join(found.select(F.col("node").alias("e"), F.col("component").alias("part")), "e", "left").withColumn("part", F.coalesce("part", "e"))
    whole = rows.groupBy("region").agg((F.min("part") != F.max("part")).alias("open"), F.sum("n").alias("total")).where("open").select("region", "total")
    return members.select("region", "e", "n", "set").join(rows.join(whole, "region").select("region", "e", "part", "total"), ["region", "e"]).select("region", "e", "part", "n", "total", "set")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", region_shingles: int = REGION_SHINGLES, rule: Rule = CONTRACT) -> tuple[DataFrame, DataFrame]:
    """(documents with keys k1, k2, decisions (k1, k2, id, n_shingles, component_id)); docs has no columns of these names."""
    spark = docs.sparkSession
    if {"k1", "k2", "_text"} & {c.lower() for c in docs.columns}:
        raise ValueError("columns k1, k2 and _text are taken; keep_one takes any names")
    tune(spark)
    keyed = docs.select("*", F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumns({"k1": F.xxhash64(doc_id, text), "k2": F.hash(doc_id, text)})
    slim = keyed.select(F.col("_text").alias("text"), "k1", "k2")
    ids = keyed.select("k1", "k2", F.col(doc_id).alias("id")).distinct()
    points = shared_checkpoint(_points(slim, False, rule).distinct().join(ids, ["k1", "k2"]))

    regions = components(_shared(_points(slim, True, rule))).select(F.col("node").alias("e"), F.col("component").alias("region"))
    one = points.groupBy("e").agg(F.min(F.struct("k1", "k2")).alias("k"), F.min("n").alias("n"))
    wanted = shared_table(_sized(regions.join(one, "e")).select("k.k1", "k.k2", "region", "e", "total"))
    members = shared_checkpoint(_with_sets(slim, wanted, rule))
    del regions, one, wanted
    links = None
    fits = F.col("total") <= region_shingles
    while True:
        free(spark)
        small, members = members.where(fits), members.where(~fits)
        some = not members.isEmpty()
        if some:
            fresh = _sized(_by_rare_shingles(members, rule)).select("home", "e", "region", "total")
            members = shared_checkpoint(members.withColumnRenamed("region", "home").drop("total").join(fresh, ["home", "e"]).select(*small.columns))
            small, members = small.unionByName(members.where(fits)), members.where(~fits)
            some = not members.isEmpty()
        found = _join_small(small, rule)
        links = shared_checkpoint(found if links is None else links.unionByName(found))
        del small, found
        if not some:
            break
        more, made = _round(members, rule)
        # regions whose pivots part them go on by the new ones; of the others every two blocks meet
        parted = made.groupBy("home").agg(F.sum("n").alias("s")).join(members.groupBy(F.col("region").alias("home")).agg(F.first("total").alias("t")), "home").where(F.col("s") <= COPIED * F.col("t"))
        largest = made.groupBy("home", "region").agg(F.sum("n").alias("r")).groupBy("home").agg(F.max("r").alias("r"))
        parted = shared_checkpoint(parted.join(largest, "home").where(F.col("r") <= F.col("t") / 2).select("home"))
        links = shared_checkpoint(links.unionByName(more))
        kept = members.join(parted.withColumnRenamed("home", "region"), "region", "left_anti")
        stuck = shared_checkpoint(kept.select("region").distinct())
        made = made.join(parted, "home", "left_semi").select("region", "e", "n", "set")
        members = shared_checkpoint(_relabel(made.unionByName(kept.select(*made.columns)), links))
        links = shared_checkpoint(links.unionByName(_pairwise(members.join(stuck, "region", "left_semi"), rule)))
        members = members.join(stuck, "region", "left_anti")
        if members.isEmpty():
            break
    free(spark)
    found = components(links)
    # the smallest id of a group, nulls last
    grouped = shared_table(points.join(found.withColumnRenamed("node", "e"), "e", "left").select("k1", "k2", "id", "n", F.coalesce("component", "e").alias("g")))
    least = shared_table(grouped.groupBy("g").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("many")))
    named = join_back(grouped, least, ["g"], grouped.count(), "many").select("k1", "k2", "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return keyed.drop("_text"), named


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """One document of each group: the one with the smallest id (of repeated rows one); documents without words all stay."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed, named = near_groups(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items())), inner[doc_id], inner[text], rule=rule)
    # equal ids with unlike texts of one group: the smallest key stays
    keep = named.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2")).alias("r")).select("r.k1", "r.k2")
    first = keyed.join(keep, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    bare = keyed.join(named.where("n_shingles = 0").select("k1", "k2"), ["k1", "k2"], "left_semi")
    return first.unionByName(bare).select(*(F.col(n).alias(c) for c, n in inner.items()))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keyed, named = near_groups(docs)
    # a row for each document, repeated rows too
    return keyed.select("k1", "k2", "doc_id").join(named.drop("id"), ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")


def brute(docs: list[tuple], rule: Rule = CONTRACT) -> dict:
    """Plain restatement for tests: {doc_id: (n_shingles, component_id)}."""
    import re

    low = lambda s: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    sets, up = {}, {}
    for d, t in docs:
        w = low(t)
        sets[d] = {tuple(w[i : i + rule.words]) for i in range(len(w) - rule.words + 1)} if len(w) >= rule.words else ({tuple(w)} if w else set())
        up[d] = d

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and rule.denominator * min(len(sets[a]), len(sets[b])) >= rule.numerator * max(len(sets[a]), len(sets[b])):
                c = len(sets[a] & sets[b])
                if rule.linked(c, len(sets[a]), len(sets[b])):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}
