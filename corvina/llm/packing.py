"""Operator 3: best-fit packing with certified repacking.

Token pieces are dealt to partitions of bounded size, each packed by best-fit decreasing. A lower bound from dual
feasible functions (threshold functions and the rounding family) certifies a partition whose bin count it reaches.
Partitions with a gap keep their full bins and hand the pieces of the others to the next round, where they are dealt
anew to fewer partitions and best-fit decreasing runs again. A certified partition hands on only the bins of which a
256th or more is free, in large partitions a few: no partition can do better alone, but the part-filled bins of many fit
into fewer. So partitions fall by orders of magnitude each round; after ``rounds`` rounds what is left stays as it is.
certificate() gives the number of sequences beside the bound of all pieces together.

Defined results: a null or empty text is the single id 1; tied lengths go by (doc_id, piece); repeated rows are packed
once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm import common as C

CAPACITY = 4096
#: A certified partition hands on the bins of which this part is free.
LOOSE = 256
#: Slots of the cache, and how many may be taken before it starts anew.
SLOTS, TAKEN = 1 << 21, 1_200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, loose boolean"
_RUN = np.ones(256, bool)
_RUN[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of texts that the quick way cannot take: Python's own separators, and code points beyond ASCII and U+00C0-U+00FF.
_ODD = np.zeros(256, bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, *range(0xC4, 256)]] = True


def _lower(raw: np.ndarray) -> np.ndarray:
    """Lower case of UTF-8 text up to U+00FF; there it is the tokenizer's, and no two characters compose."""
    out = C.LOWER[raw]
    if len(raw):
        capital = np.zeros(len(raw), bool)
        capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[capital] += 32
    return out


class Pool:
    """A growing array that values are appended to."""

    def __init__(self, kind):
        self.values, self.used = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> int:
        """Append values; where they begin."""
        at = self.used
        if at + len(values) > len(self.values):
            self.values = np.concatenate((self.values, np.zeros(max(len(self.values), len(values)), self.values.dtype)))
        self.values[at : at + len(values)] = values
        self.used += len(values)
        return at


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of the spans start .. start + size, end to end."""
    start, size = start.astype(np.int64), size.astype(np.int64)
    skip = np.cumsum(size)
    return np.repeat(start - skip + size, size) + np.arange(skip[-1] if len(skip) else 0)


class Table:
    """Runs with their ids: open addressing over numpy arrays by a run's hash, so that whole blocks are looked up at once.

    The bytes of every run are kept and compared on a hit, as different runs may have one hash.
    """

    def __init__(self, slots: int = SLOTS, taken: int = TAKEN):
        self.slots, self.limit = slots, taken
        self.clear()

    def clear(self) -> None:
        self.keys, self.taken = np.zeros(self.slots, np.uint64), 0
        self.at, self.size, self.text_at, self.text_size = (np.zeros(self.slots, np.uint32) for _ in range(4))
        self.pool, self.text = Pool(np.uint32), Pool(np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of every hash, or -1."""
        out, todo, mask = np.full(len(h), -1), np.arange(len(h)), np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = slot[hit]
            more = ~hit & (key != 0)
            todo, slot = todo[more], (slot[more] + 1) & (self.slots - 1)
        return out

    def put(self, h: int, run: np.ndarray, ids: np.ndarray) -> None:
        slot = h & (self.slots - 1)
        while self.keys[slot]:
            slot = (slot + 1) & (self.slots - 1)
        self.keys[slot], self.size[slot], self.text_size[slot] = h, len(ids), len(run)
        self.at[slot], self.text_at[slot] = self.pool.add(ids), self.text.add(run)
        self.taken += 1

    def same(self, slots: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the run of each slot has the bytes of its span of data; the spans are runs that follow each other."""
        size = end - start
        out = self.text_size[slots] == size
        upto = np.cumsum(size)
        cuts = np.unique(np.searchsorted(upto, np.arange(C.BLOCK_BYTES, upto[-1] + 1, C.BLOCK_BYTES))) if len(upto) else []
        for part in np.split(np.arange(len(size)), cuts):
            if not len(part):
                continue
            here = data[start[part[0]] : end[part[-1]]]
            here = here[_RUN[here]]
            if not out[part].all():
                here, part = here[np.repeat(out[part], size[part])], part[out[part]]
            differ = np.flatnonzero(here != self.text.values[spread(self.text_at[slots[part]], size[part])])
            out[part[np.searchsorted(np.cumsum(size[part]), differ, "right")]] = False
        return out

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slots end to end, and the number of each."""
        size = self.size[slots].astype(np.int64)
        return self.pool.values[spread(self.at[slots], size)], size


class Tokens:
    """Ids of texts.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its runs of other
    characters. Runs are looked up in a bounded table; one that is not there is cut into words by the tokenizer's own
    split pattern, and its model merges each, as do those of a run that shares another's hash. Texts beyond U+00FF, with
    separator characters or with the beginning of a special token go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")).findall
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}
        self.table = Table()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, run: str) -> list[int]:
        if run.isalpha():
            words = (run,)
        elif run[:-1].isalpha() and run[-1] in ".,;:!?":
            words = (run[:-1], run[-1])
        else:
            words = self.words(run)
        model, bytes_of = self.model.tokenize, self.bytes_of
        return [t.id for w in words for t in model(w.translate(bytes_of))]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of every text of a column without nulls."""
        raw, at = C.utf8(column)
        odd = np.diff(np.concatenate(([0], np.cumsum(_ODD[raw])))[at]) > 0
        mark = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)) if len(raw) else []
        odd[np.searchsorted(at, mark, "right") - 1] = True
        if odd.any():
            out: list[np.ndarray] = [None] * len(column)
            for of, encode in ((np.flatnonzero(odd), lambda c: self.whole(c.to_pylist())), (np.flatnonzero(~odd), self._plain)):
                if len(of):
                    for i, ids in zip(of.tolist(), encode(column.take(pa.array(of))), strict=True):
                        out[i] = ids
            return out
        return self._plain(column)

    def _plain(self, column: pa.Array) -> list[np.ndarray]:
        w = C.Words(column, _RUN, _lower)
        h = np.maximum(w.hashes(), np.uint64(1))
        data, found = w.data.tobytes(), []
        # a slice holds no more runs than the table may take, however long a text is
        for at in range(0, len(h), self.table.limit):
            part = slice(at, at + self.table.limit)
            found.append(self._runs(w.data, data, w.start[part], w.end[part], h[part]))
        ids = np.concatenate([i for i, _ in found]) if found else np.zeros(0, np.uint32)
        size = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64)
        cut = np.cumsum(np.bincount(w.doc, size, w.n).astype(np.int64))
        return np.split(ids, cut[:-1])

    def _runs(self, raw: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs end to end, and the number of each."""
        slots = self.table.find(h)
        if (slots < 0).any():
            missing, first = np.unique(h[slots < 0], return_index=True)
            first = np.flatnonzero(slots < 0)[first]
            if self.table.taken + len(missing) > self.table.limit:
                self.table.clear()
                missing, first = np.unique(h, return_index=True)
            for k, a, b in zip(missing.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
                self.table.put(k, raw[a:b], np.asarray(self._run(data[a:b].decode("utf-8")), np.uint32))
            slots = self.table.find(h)
        ids, size = self.table.ids(slots)
        other = np.flatnonzero(~self.table.same(slots, raw, start, end))
        if not len(other):
            return ids, size
        own = np.split(ids, np.cumsum(size)[:-1])
        for i in other.tolist():
            own[i] = np.asarray(self._run(data[start[i] : end[i]].decode("utf-8")), np.uint32)
        return np.concatenate(own), np.array([len(x) for x in own])


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids and the closing id 1, cut into pieces of at most capacity."""

    def run(batches):
        encode = tokens(path).encode
        for batch in batches:
            for part in C.blocks(batch):
                out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").fill_null("")), strict=True):
                    ids = np.append(ids, np.uint32(1)).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        for name, value in zip(out, (doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                            out[name].append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the threshold and rounding families of dual feasible functions."""
    return counted_bound(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def counted_bound(n: np.ndarray, capacity: int) -> int:
    """lower_bound of n[s] pieces of each size s."""
    if not n.any():
        return 0
    x = np.arange(capacity + 1)
    count, total = np.cumsum(n), np.cumsum(n * x)
    cut = np.arange(1, capacity // 2 + 1)  # below cut: 0; above capacity - cut: a whole bin; between: the size
    whole = count[-1] - count[capacity - cut]
    between = total[capacity - cut] - total[cut - 1]
    best = max(-(-int(total[-1]) // capacity), int((whole - (-between // capacity)).max()))
    for k in range(1, 21):
        exact = (k + 1) * x % capacity == 0
        # u(x) = x where (k + 1) x is whole, else floor((k + 1) x) / k; in units of 1 / (k * capacity)
        units = np.where(exact, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((n * units).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size (given in decreasing order), and the space left in every bin."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left: list[int] = []
    with_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit s: some bin has exactly s free
    for i, size in enumerate(sizes.tolist()):
        fit = mask >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            b = with_space[space].pop()
            if not with_space[space]:
                mask &= ~(1 << space)
        else:
            b, space = len(left), capacity
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        left[b] = space - size
        if space > size:
            with_space[space - size].append(b)
            mask |= 1 << (space - size)
    return bins, offsets, np.asarray(left, np.int64)


def _pack(rows: DataFrame, partitions: int, round_: int, capacity: int) -> DataFrame:
    def run(frames):
        got = pd.concat([*frames] or [pd.DataFrame({c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")})])
        if not len(got):
            return
        got = got.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = got["length"].to_numpy(np.int64)
        bins, offsets, left = best_fit_decreasing(sizes, capacity)
        certified = len(left) <= lower_bound(sizes, capacity)
        got["sequence_id"] = (round_ << 56) + (TaskContext.get().partitionId() << 28) + bins
        got["offset"] = offsets
        got["loose"] = left[bins] >= (capacity // LOOSE if certified else 1)
        yield got

    return rows.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(partitions).mapInPandas(run, PACKED)


def pack(rows: DataFrame, capacity: int = CAPACITY, per_partition: int = 50_000, rounds: int = 8) -> DataFrame:
    """Pack pieces(): adds sequence_id and offset. per_partition bounds the pieces of a task.

    rounds bounds the exchanges: gaps that are open after the last one stay open.
    """
    rows = C.materialise(rows, "pieces")
    partitions = max(1, math.ceil(rows.count() / per_partition))
    done, loose = [], rows
    for r in range(rounds):
        packed = C.materialise(_pack(loose, partitions, r, capacity), f"packed{r}")
        if r == 0:
            C.release(rows)
        n, tasks = packed.filter("loose").agg(F.count("*"), F.count_distinct(F.shiftright("sequence_id", 28))).first()
        fewer = max(1, math.ceil(n / per_partition))
        if tasks < 2 or r == rounds - 1:
            done.append(packed)
            break
        done.append(packed.filter("not loose"))
        loose, partitions = packed.filter("loose"), min(fewer, partitions - 1)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("loose")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """The number of sequences, and the bins that any packing of the same pieces needs; lengths are counted, not gathered."""
    sequences = packed.agg(F.count_distinct("sequence_id")).first()[0]
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():  # capacity rows at most
        counts[length] = n
    return sequences, counted_bound(counts, capacity)


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, per_partition: int = 50_000) -> DataFrame:
    """Tokenise, cut and pack all documents."""
    return pack(pieces(docs, path, capacity), capacity, per_partition)
