"""Operator 8: byte-level BPE encoding and decoding with a segment tree.

Each match of the split pattern is merged on its own. A segment tree over its byte positions stores, in every node, the
leftmost minimum of the pair ranks below; a merge takes the root and updates the pairs of two live neighbours, each in
logarithmic time, so that a match of a million bytes stays quick. Ids of short matches are kept in a bounded cache of
two generations.

Defined results: null and empty texts have no ids; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corvina.llm import common as C

#: Entries of one generation.
CACHE_ENTRIES = 300_000
CACHED_CHARS = 48
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: repeatedly merge the leftmost pair of lowest rank.

    A node holds rank and position in one number, rank first, so the least number is the leftmost of the lowest rank.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, rank_of = len(piece), ranks.get
    size = 1
    while size < n - 1:
        size *= 2
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = rank_of(piece[i : i + 2])
        if r is not None:
            tree[size + i] = (r << 32) + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # end of the live part that starts here
    before = list(range(-1, n - 1))
    while (top := tree[1]) != _NONE:
        i = top & 0xFFFFFFFF
        j = end[i]
        e = end[i] = end[j]
        changed = []
        if j < n - 1:
            changed.append((j, _NONE))
        if e < n:
            before[e] = i
            r = rank_of(piece[i : end[e]])
            changed.append((i, _NONE if r is None else (r << 32) + i))
        else:
            changed.append((i, _NONE))
        p = before[i]
        if p >= 0:
            r = rank_of(piece[p:e])
            changed.append((p, _NONE if r is None else (r << 32) + p))
        for at, value in changed:
            k = size + at
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


_NONE = 1 << 62
#: Leaves of the trees that are worked on together.
TOGETHER = (8, 16, 32)


class Pairs:
    """Rank of the token that two tokens make, for arrays of pairs: a hash table over all splits of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(x, y, r) for t, r in ranks.items() for i in range(1, len(t)) if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None]
        table = np.array(found, np.int64).reshape(-1, 3)
        self.mask = (1 << max(4, int(2 * len(table)).bit_length())) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1), np.zeros(self.mask + 1, np.int64)
        key, todo = (table[:, 0] << 32) + table[:, 1], np.arange(len(table))
        slot = self._slot(key)
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[todo[free]]
            mine = self.keys[slot] == key[todo]
            self.ranks[slot[mine]] = table[todo[mine], 2]
            todo, slot = todo[~mine], (slot[~mine] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(24)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair, or -1."""
        key = (left << 32) + right
        out, todo, slot = np.full(len(key), -1), np.arange(len(key)), self._slot(key)
        while len(todo):
            held = self.keys[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            more = ~hit & (held >= 0)
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out


def merge_many(pieces: list[bytes], size: int, pairs: Pairs, first: np.ndarray) -> list[list[int]]:
    """merge() for many matches of 2 to size + 1 bytes at once: one segment tree of size leaves is a row of an array.

    first: ids of the 256 bytes. Each step takes the root of every tree that has a pair left.
    """
    m = len(pieces)
    n = np.fromiter(map(len, pieces), np.int64, m)
    width, rows = size + 1, np.arange(m)
    inside = np.arange(width) < n[:, None]
    token = np.zeros((m, width), np.int64)
    token[inside] = first[np.frombuffer(b"".join(pieces), np.uint8)]
    alive = inside.copy()
    after, before = np.tile(np.arange(1, width + 2), (m, 1)), np.tile(np.arange(-1, width), (m, 1))
    tree = np.full((m, 2 * size + 1), _NONE)  # the last column takes what has no leaf
    r, c = np.nonzero(inside[:, 1:])
    rank = pairs.find(token[r, c], token[r, c + 1])
    tree[r, size + c] = np.where(rank < 0, _NONE, (rank << 32) + c)
    level = size
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def put(at, leaf, value):
        k = size + leaf
        tree[at, k] = value
        on = leaf < size
        at, k = at[on], k[on] >> 1
        for _ in range(size.bit_length() - 1):
            tree[at, k] = np.minimum(tree[at, 2 * k], tree[at, 2 * k + 1])
            k = k >> 1

    def put_pair(at, left, right, leaf):
        rank = pairs.find(token[at, left], token[at, right])
        put(at, leaf, np.where(rank < 0, _NONE, (rank << 32) + leaf))

    at = rows
    while len(at := at[tree[at, 1] != _NONE]):
        top = tree[at, 1]
        i = top & 0xFFFFFFFF
        j = after[at, i]
        e = after[at, j]
        token[at, i], after[at, i], alive[at, j] = top >> 32, e, False
        put(at, j, np.full(len(at), _NONE))
        more = e < n[at]
        put(at[~more], i[~more], np.full((~more).sum(), _NONE))
        before[at[more], e[more]] = i[more]
        put_pair(at[more], i[more], e[more], i[more])
        p = before[at, i]
        left = p >= 0
        put_pair(at[left], p[left], i[left], p[left])
    ids, cut = token[alive].tolist(), np.cumsum(alive.sum(1)).tolist()
    return [ids[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]


class Codec:
    """Encoder and decoder of one vocabulary; a match's ids are kept as their decimal text."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.bytes_of = {str(r): b for b, r in self.ranks.items()}
        self.pairs = Pairs(self.ranks)
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of every match: short ones together by size, long ones each on its own."""
        out: list[list[int]] = [[]] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) > 1 + TOGETHER[-1]:
                out[i] = merge(p, self.ranks)
            else:
                groups.setdefault(next(s for s in TOGETHER if len(p) <= s + 1), []).append(i)
        for size, of in groups.items():
            for i, ids in zip(of, merge_many([pieces[i] for i in of], size, self.pairs, self.first), strict=True):
                out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of every text, one space between."""
        found = [self.find(t) for t in texts]
        new = set().union(*found)
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        missing = []
        for m in new.difference(self.cache):
            ids = self.older.get(m)
            if ids is None:
                missing.append(m)
            else:
                self.cache[m] = ids
        for m, ids in zip(missing, self.merged([m.encode("utf-8") for m in missing]), strict=True):
            self.cache[m] = " ".join(map(str, ids))
        get = self.cache.__getitem__
        out = [" ".join(map(get, f)) for f in found]
        for m in missing:
            if len(m) > CACHED_CHARS:
                del self.cache[m]
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of every text as array<int>."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in C.blocks(batch):
                ids = [list(map(int, x.split())) for x in c.encode([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that the ids of encode() stand for."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [c.decode(" ".join(map(str, x or []))) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count and digests of the ids and of the bytes decoded from them, in one pass over the texts."""

    def run(batches):
        c = codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in C.blocks(batch):
                counts, ids_sha, decoded = [], [], []
                for ids in c.encode([t or "" for t in part.column("text").to_pylist()]):
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(sha(ids.encode("ascii")))
                    decoded.append(sha(c.decode(ids)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)
