"""Token ids of whole texts with a public byte-level vocabulary.

Most of a text is words seen before, so ids are kept by chunk: a text is cut before each single space, each distinct chunk
is encoded once and a text is a join of stored ids, gathered with numpy. The cut is the vocabulary's own: its splitting
pattern always starts a new piece at a space that a visible character follows. Texts where white space stands on both sides
of a space (or before a last space) could be cut otherwise and are encoded whole. Chunks are known by a 64-bit hash; two
chunks in one table share one with odds of about 1e-13 a lookup.

The vocabulary's added strings (its file of JSON names them) are one id wherever they stand; what is between them is
encoded as a text of its own.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

from parley.llm.core import prefix_sums, span_hashes

TABLE = 1_500_000  #: chunks kept by a worker, about 60 MB; a full table starts anew
SLICE = 4 << 20

#: ends of white space before a space, and starts of white space after it, in UTF-8 (some letters too, which only costs time)
_BEFORE = np.zeros(256, bool)
_BEFORE[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_AFTER = np.zeros(256, bool)
_AFTER[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_added() -> dict[str, int]:
    """The strings that the vocabulary adds, with their ids."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path, default_added() if path == default_vocabulary() else {})


class Encoder:
    """Encodes texts to 16-bit ids; without ``added`` strings all text is ordinary."""

    def __init__(self, path: str, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        self.added = dict(added or {})
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if max(*ranks.values(), *self.added.values()) > 65535:
            raise ValueError("ids must fit 16 bits")
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(65536, bool)
        self.spaced[[v for k, v in ranks.items() if k[:1] == b" "]] = True
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)  # of each key: where its ids stand in the pool
        self.n = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), np.uint16)

    def _learn(self, keys: np.ndarray, chunks: list[bytes], spaced: np.ndarray) -> None:
        """Chunks new to the table; those that follow a space are encoded with it."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        plain = np.array([bool(s and t and not t[0].isspace() and not t[-1].isspace()) for s, t in zip(spaced.tolist(), texts, strict=True)], bool)
        counts, pools = np.zeros(len(texts), np.int64), []
        at = np.zeros(len(texts), np.int64)
        size = len(self.pool)
        if plain.any():
            some = np.flatnonzero(plain)
            ids = self._ids(" " + " ".join([texts[i] for i in some.tolist()]))
            cut = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            if len(cut) == len(some) + 1:
                counts[some], at[some] = np.diff(cut), size + cut[:-1]
                pools.append(ids)
                size += len(ids)
            else:
                plain[:] = False
        for i in np.flatnonzero(~plain).tolist():
            ids = self._ids((" " if spaced[i] else "") + texts[i])
            counts[i], at[i] = len(ids), size
            pools.append(ids)
            size += len(ids)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.n, where, counts)
        self.pool = np.concatenate([self.pool, *pools])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian 16-bit words; the texts are data[offsets[i] : offsets[i + 1]]."""
        space = np.flatnonzero(data == 32)
        starts = np.sort(np.concatenate([offsets[:-1], space + 1]), kind="stable")
        ends = np.sort(np.concatenate([space, offsets[1:]]), kind="stable")
        first = np.arange(len(offsets) - 1) + np.searchsorted(space, offsets[:-1])
        hashes = span_hashes(prefix_sums(data.astype(np.uint64) + np.uint64(1)), starts, ends)
        hashes[first] ^= np.uint64(0xA5A5A5A5A5A5A5A5)
        keys, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > TABLE:
            self._empty()
        known = np.searchsorted(self.keys, keys)
        known[known == len(self.keys)] = 0
        new = np.flatnonzero(self.keys[known] != keys) if len(self.keys) else np.arange(len(keys))
        raw = data.tobytes()
        if len(new):
            e = example[new]
            is_first = np.zeros(len(starts), bool)
            is_first[first] = True
            self._learn(keys[new], [raw[a:b] for a, b in zip(starts[e].tolist(), ends[e].tolist(), strict=True)], ~is_first[e])
            known = np.searchsorted(self.keys, keys)
        at, n = self.at[known][inverse], self.n[known][inverse]
        total = np.append(0, np.cumsum(n))
        flat = self.pool[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        cut = (total[np.append(first, len(starts))] * 2).tolist()
        ids = flat.tobytes()
        out = [ids[a:b] for a, b in zip(cut, cut[1:])]
        if len(space):
            last = np.zeros(len(data) + 1, bool)
            last[offsets[1:]] = True
            begin = np.zeros(len(data) + 1, bool)
            begin[offsets[:-1]] = True
            padded = np.append(data, 0)
            odd = space[(last[space + 1] | _AFTER[padded[space + 1]]) & ~begin[space]]
            odd = odd[_BEFORE[data[odd - 1]]]
            for d in np.unique(np.searchsorted(offsets, odd, "right") - 1).tolist():
                out[d] = self._ids(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")).tobytes()
        if any(raw.find(t.encode()) >= 0 for t in self.added):
            for d, (a, z) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                text = raw[a:z]
                if any(t.encode() in text for t in self.added):
                    parts = self.splits.split(text.decode("utf-8", "replace"))
                    out[d] = b"".join([np.array([self.added[p]], np.uint16).tobytes() if p in self.added else self._ids(p).tobytes() for p in parts if p])
        return out
