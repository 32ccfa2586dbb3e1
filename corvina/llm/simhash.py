"""Operator 5: SimHash near-duplicates with BK-trees.

Equal fingerprints are merged first. Cut into radius + p parts, two fingerprints within the radius agree in p of them, so
a shard is the fingerprints that agree in one choice of parts: in two of five, about 26 bits, at first. In each shard a
BK-tree (children keyed by integer Hamming distance to the parent) answers radius queries by following only the edges
within the radius. The fingerprints of a shard over SHARD go to narrower ones, in three of six parts (32 bits), and a
shard still over SHARD is split into chunks whose pairs are separate trees, so no task holds more than two chunks. A
shard's tree is made where its fingerprints meet: to broadcast all shards would need a bound on their number. Trees give
spanning links, not pairs; links are joined into components by star contraction.

Defined results: null and empty texts have fingerprint zero and link like any other; rows that share a doc_id share a
component if their texts do; a null doc_id never names a component unless it is alone; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm import common as C

SHARD = 4096
SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of word shingles, repeats included: a bit is set if over half the hashes set it."""
    found = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        line = b" ".join(found)
        shingles = map(line.__getitem__, map(slice, starts[: len(found) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist()))
    raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, key: Column | None = None) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; beside them key (binary), if given."""

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch):
                fps = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                more = {"key": part.column("key")} if "key" in part.schema.names else {}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "fp": pa.array(fps)} | more)

    rows = docs.select("doc_id", "text", *([] if key is None else [key.alias("key")]))
    return rows.mapInArrow(run, "doc_id long, fp long" + ("" if key is None else ", key binary"))


class BKTree:
    """A BK-tree of fingerprints that also keeps their components.

    A subtree known to lie in one component is skipped once the query is linked to that component: another link to it
    would tell nothing new.
    """

    def __init__(self, radius: int):
        self.radius, self.value, self.edges, self.parent, self.sub, self.due = radius, [], [], [], [], 64

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def _refresh(self) -> None:
        """Mark again the subtrees that lie in one component; children come after their parents."""
        for i in range(len(self.value) - 1, -1, -1):
            root = self.find(i)
            self.sub[i] = root if all(self.sub[c] is not None and self.find(self.sub[c]) == root for c in self.edges[i].values()) else None

    def add(self, fp: int) -> None:
        new, r, find = len(self.value), self.radius, self.find
        self.value.append(fp)
        self.edges.append({})
        self.parent.append(new)
        self.sub.append(new)
        if not new:
            return
        linked, todo = set(), [0]
        while todo:
            i = todo.pop()
            if self.sub[i] is not None and find(self.sub[i]) in linked:
                continue
            d = (self.value[i] ^ fp).bit_count()
            if d <= r:
                linked.add(find(i))
            low, high = d - r, d + r
            todo += [c for k, c in self.edges[i].items() if low <= k <= high]
        for c in linked:
            self.parent[find(c)] = new if find(c) != new else new
        at = 0
        while True:
            if self.sub[at] is not None and find(self.sub[at]) != new:
                self.sub[at] = None
            d = (self.value[at] ^ fp).bit_count()
            nxt = self.edges[at].get(d)
            if nxt is None:
                self.edges[at][d] = new
                break
            at = nxt
        if new >= self.due:
            self._refresh()
            self.due *= 2


def spanning_links(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """(fingerprint, first of its component) for those that are not the first, by a BK-tree over fps."""
    if len(fps) == 2:
        return [(fps[1], fps[0])] if (fps[0] ^ fps[1]).bit_count() <= radius else []
    tree = BKTree(radius)
    for x in fps:
        tree.add(x)
    first: dict[int, int] = {}
    out = []
    for i, x in enumerate(fps):
        f = first.setdefault(tree.find(i), x)
        if f != x:
            out.append((x, f))
    return out


def shards(nodes: DataFrame, radius: int, agreeing: int) -> DataFrame:
    """fp with choice and bits of every shard it is in: a choice of parts to agree in, and the bits of these parts."""
    n = radius + agreeing
    edges = [64 * i // n for i in range(n + 1)]
    of = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in c) for c in combinations(range(n), agreeing)]
    signed = [m - (1 << 64) if m >> 63 else m for m in of]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])
    return nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.bits")


def links(nodes: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints fp of nodes as all links within radius would."""
    return _links(nodes, radius, shard)[0]


def _links(nodes: DataFrame, radius: int, shard: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """links(), and the written tables that they are read from."""
    rows = shards(nodes, radius, 2)
    sizes = C.materialise(rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "shards")
    small = rows.join(sizes.filter(F.col("n") <= shard).drop("n"), ["choice", "bits"], "left_semi")
    found = _tree_links(small.withColumns({"i": F.lit(0), "j": F.lit(0)}), radius)
    large = sizes.filter(F.col("n") > shard)
    if large.isEmpty():
        return found, (sizes,)
    crowded = rows.join(F.broadcast(large.drop("n")) if C.small_enough(large, 24) else large.drop("n"), ["choice", "bits"], "left_semi")
    crowded = C.materialise(crowded.select("fp").distinct(), "crowded")
    return found.unionByName(_tree_links(_chunked(crowded, radius, shard), radius)), (sizes, crowded)


def _chunked(nodes: DataFrame, radius: int, shard: int) -> DataFrame:
    """The narrower shards of nodes; those over shard come as pairs (i, j) of chunks."""
    rows = shards(nodes, radius, 3)
    sizes = rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["choice", "bits"]).withColumn("chunks", F.ceil(F.col("n") / shard).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # the chunk's pairs with every other chunk; pairs of one chunk are inside any of them
    pairs = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != F.col("own")))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(pairs))
    return rows.select("fp", "choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) from a tree for every shard or pair of chunks of rows (fp, choice, bits, i, j)."""
    # a pair of chunks of a hot shard is a key of its own, so the deal stays even
    rows = rows.repartition("choice", "bits", "i", "j").sortWithinPartitions("choice", "bits", "i", "j", "fp")

    def run(batches):
        key, held = None, []
        for batch in batches:
            table = np.stack([np.asarray(batch.column(c).cast(pa.int64())) for c in ("choice", "bits", "i", "j", "fp")])
            if not table.shape[1]:
                continue
            cuts = np.flatnonzero((table[:4, 1:] != table[:4, :-1]).any(0)) + 1
            fps = table[4].view(np.uint64).tolist()
            out = []
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), table.shape[1]], strict=True):
                k = tuple(table[:4, start])
                if k != key:
                    out += spanning_links(held, radius) if len(held) > 1 else []
                    key, held = k, []
                held += fps[start:stop]
            yield _links_batch(out)
        yield _links_batch(spanning_links(held, radius) if len(held) > 1 else [])

    return rows.mapInArrow(run, "a long, b long")


def _links_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0].copy()), pa.array(table[:, 1].copy())], ["a", "b"])


def components(pairs: DataFrame, rounds: int = 40, read: tuple[DataFrame, ...] = ()) -> DataFrame:
    """id and label (smallest id of its component) of all ids in pairs (a, b), by large-star and small-star steps.

    read: written tables that nothing but pairs reads; they are deleted.

    Every step is a grouped minimum and an equi-join, so no component is gathered in one task; every round is written to
    the shared folder, and the previous one deleted.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = C.materialise(pairs.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    for step in read:
        C.release(step)
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = C.materialise(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = C.materialise(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        C.release(large)
        C.release(edges)
        edges = now
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    fps = C.materialise(fingerprints(docs, words), "fingerprints")
    nodes = C.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n")), "nodes")
    labelled = with_label(nodes, radius, shard)
    least = labelled.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = C.materialise(labelled.select("fp", "label", "n").join(least, "label").select("fp", "n", "component_id"), "components")
    return C.join_counted(fps, named, "fp", 40).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_label(nodes: DataFrame, radius: int, shard: int) -> DataFrame:
    """nodes with label, which names the component of their fp."""
    pairs, read = _links(nodes, radius, shard)
    labels = components(pairs, read=read)
    return nodes.join(labels, nodes.fp == labels.id, "left").withColumn("label", F.coalesce("label", "fp")).drop("id")


def row_key(docs: DataFrame) -> Column:
    """A digest of text, then one of all other columns."""
    rest = F.to_json(F.struct(*[C.quoted(c) for c in docs.columns if c != "text"], F.col("text").isNull().alias(C.free_name(docs, "_null"))))
    return F.concat(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))), F.unhex(F.md5(rest.cast("binary"))))


def heads(docs: DataFrame, radius: int = 3, words: int = 3, shard: int = SHARD) -> DataFrame:
    """Of each component the row_key of its first row, by doc_id (nulls last) and row_key, and n, the rows that have this key."""
    rows = C.materialise(fingerprints(docs, words, row_key(docs)), "fingerprints").groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key", "n")
    nodes = C.materialise(rows.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    return with_label(nodes, radius, shard).groupBy("label").agg(F.min("first").alias("first")).select("first.key", "first.n")
