"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has 64 bits; two documents link if theirs differ in at most ``DISTANCE`` bits, and a group is a connected
component of links.

The join is split without losing a pair: of 4 blocks of 16 bits, two linked fingerprints share at least one, so each
distinct fingerprint goes to four buckets. (``candidates`` takes a wider limit and more, overlapping blocks; it finds every
pair within ``DISTANCE``, and of wider pairs those that share a block. Its caller checks each pair and finds the others.) A bucket with more than ``BUCKET`` fingerprints is split again in the same way
by the other 48 bits, and if need be into squares of chunks, so no task gets an unbounded bucket. Within a bucket,
fingerprints are sorted by Gray rank, so that neighbours share long masked bit patterns; runs of ``FAN`` become nodes
that hold the bits their members share, and runs of nodes become upper nodes. Pairs of nodes are searched from the top:
the bits shared within both but different between them are a lower bound of every distance below, which grows on the
way down, and a pair of groups over the limit is dropped whole. A pair of nodes whose members cannot differ in more than
the limit is linked whole, and one already in one component is skipped, so a dense cluster never becomes all its pairs.

Nulls: a null or wordless text has fingerprint zero and links like any other. Rows with a null doc_id take no part in
linking and get a null component. Repeated rows give repeated rows. An empty table gives an empty result. Columns other
than doc_id and text are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, shuffle_partitions
from .components import components

DISTANCE = 3
SHINGLE = 3
#: Blocks of 16 bits that a fingerprint is looked up by: disjoint ones.
BLOCKS = 4
#: Bits and overlapping blocks of ``candidates``.
WIDE, MANY = 11, 16
#: Fingerprints in a bucket before it is split.
BUCKET = 4096
FAN = 8
#: Fingerprints, the commonest, whose components are broadcast: a table of at most so many rows of 16 bytes.
HOT = 1000
#: Pairs of nodes looked at together.
FRONTIER = 1 << 17


def counts_of(h: np.ndarray) -> np.ndarray:
    """How many of these 64-bit hashes have each bit set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(h: np.ndarray) -> int:
    """The fingerprint, signed, of a set of hashes: bit i is set if it is set in over half of them."""
    counts = sum(counts_of(h[at : at + (1 << 16)]) for at in range(0, len(h), 1 << 16))
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is set in over half the shingle hashes."""
    w = (text or b"").lower().split()  # bytes: only A-Z, and only the spaces of the word rule
    if not w:
        return 0
    total, counts = 0, np.zeros(64, np.int64)
    for at in range(0, max(1, len(w) - size + 1), 1 << 16):
        part = w[at : at + (1 << 16) + size - 1]
        grams = (b" ".join(x) for x in zip(*(part[k:] for k in range(size)), strict=False)) if len(w) >= size else (b" ".join(w),)
        h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
        counts += counts_of(h)
        total += len(h)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (bigint, the same bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch({"doc_id": b.column(0), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of nodes over fingerprints that are sorted by group and Gray rank; no node crosses groups."""

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        order = np.lexsort((gray_rank(fps), groups))
        self.order, fps, groups = order, fps[order], groups[order]
        self.all, self.any, self.group, self.first = [fps], [fps], [groups], []
        while len(groups) and len(groups) > groups[-1] + 1:  # more nodes than groups; these are numbered from 0
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            place = np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))
            first = np.flatnonzero(place % FAN == 0)
            self.first.append(np.r_[first, len(groups)])
            self.all.append(np.bitwise_and.reduceat(self.all[-1], first))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], first))
            groups = groups[first]
            self.group.append(groups)

    def components(self, limit: int = DISTANCE) -> np.ndarray:
        """For each fingerprint, in the order given to the constructor, the least sorted place of its component."""
        n = len(self.order)
        label = np.arange(n)
        self.tree: list[tuple[np.ndarray, np.ndarray]] = []
        top = len(self.first)
        roots = np.arange(len(self.all[top]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONTIER:
                stack += [(level, a[FRONTIER:], b[FRONTIER:])]
                a, b = a[:FRONTIER], b[:FRONTIER]
            both, either = self.all[level], self.any[level]
            shared = ~(both[a] ^ either[a]) & ~(both[b] ^ either[b])
            near = np.bitwise_count((both[a] ^ both[b]) & shared) <= limit
            a, b = a[near], b[near]
            if level == 0:
                label = self._join(label, a, b)
                continue
            low, high = self._span(label, level)
            open_ = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
            a, b = a[open_], b[open_]
            sure = np.bitwise_count((either[a] | either[b]) ^ (both[a] & both[b])) <= limit
            if sure.any():
                label = self._whole(label, level, a[sure], b[sure])
            a, b = a[~sure], b[~sure]
            if len(a):
                stack.append((level - 1, *self._children(level, a, b)))
        out = np.empty(n, np.int64)
        out[self.order] = label
        return out

    def _leaves(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = nodes, nodes + 1
        for k in range(level - 1, -1, -1):
            lo, hi = self.first[k][lo], self.first[k][hi]
        return lo, hi

    def _span(self, label: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        lo, _ = self._leaves(level, np.arange(len(self.all[level])))
        return np.minimum.reduceat(label, lo), np.maximum.reduceat(label, lo)

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[level - 1]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
        keep = (a[pair] != b[pair]) | (x <= y)
        if level == 1:
            keep &= x != y
        return x[keep], y[keep]

    def _whole(self, label: np.ndarray, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        heads, _ = self._leaves(level, a)
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        lo, hi = self._leaves(level, nodes)
        inside = np.repeat(lo, hi - lo)
        members = np.arange(len(inside)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + inside
        other, _ = self._leaves(level, b)
        return self._join(label, np.r_[inside, heads], np.r_[members, other])

    def spanning(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs, in the order given to the constructor, that span every component ``components`` found."""
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.tree, strict=True) if self.tree else ((), ())))
        return self.order[a], self.order[b]

    def _join(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Labels after these links: the least label reached, by hooking and pointer jumping."""
        while len(a):
            x, y = label[a], label[b]
            keep = x != y
            if not keep.any():
                break
            a, b = a[keep], b[keep]
            lo, hi = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
            np.minimum.at(label, hi, lo)
            took = np.flatnonzero(label[hi] == lo)
            took = took[np.unique(hi[took], return_index=True)[1]]
            self.tree.append((a[took], b[took]))
            while True:
                nxt = label[label]
                if np.array_equal(nxt, label):
                    break
                label = nxt
        return label


def _stars(fp: np.ndarray, rep: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star of edges for every component of a bucket."""
    label = GrayIndex(fp, group).components()
    order = np.lexsort((rep, label))
    label, rep = label[order], rep[order]
    start = np.r_[True, label[1:] != label[:-1]]
    head = rep[np.flatnonzero(start)[np.cumsum(start) - 1]]
    return rep[~start], head[~start]


def _near(fp: np.ndarray, rep: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``WIDE`` bits that span the components of a bucket: of a component's least member with all it is that
    near to, so that the buckets of a group give mostly the same pairs, and links of the others."""
    index = GrayIndex(fp, group)
    label = index.components(WIDE)
    order = np.lexsort((rep, label))
    start = np.r_[True, label[order][1:] != label[order][:-1]]
    head = np.empty(len(rep), np.int64)
    head[order] = order[np.flatnonzero(start)[np.cumsum(start) - 1]]
    direct = np.bitwise_count(fp ^ fp[head]) <= WIDE
    a, b = index.spanning()
    other = ~(direct[a] & direct[b])
    u, v = np.r_[rep[direct], rep[a[other]]], np.r_[rep[head[direct]], rep[b[other]]]
    keep = u != v
    return np.minimum(u, v)[keep], np.maximum(u, v)[keep]


def _linked(link: Callable) -> Callable:
    """A function of rows sorted by bucket, to the edges that ``link`` makes of those of several buckets at a time."""

    def edges(rows: list[tuple[np.ndarray, ...]], last: bool) -> tuple[pa.RecordBatch | None, list]:
        cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
        *key, fp, rep = cols
        new = np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)]
        end = len(fp) if last else int(np.flatnonzero(new)[-1])
        rest = [tuple(c[end:] for c in cols)]
        if end == 0:
            return None, rest
        group = np.cumsum(new[:end]) - 1
        lone = np.bincount(group)[group] == 1
        at = np.flatnonzero(~lone)
        if not len(at):
            return None, rest
        _, group = np.unique(group[at], return_inverse=True)
        u, v = link(fp[:end][at].view(np.uint64), rep[:end][at], group)
        return pa.record_batch({"u": pa.array(u), "v": pa.array(v)}), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            kept.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            size += b.num_rows
            if size >= 4 * BUCKET:
                found, kept = edges(kept, False)
                size = len(kept[0][0])
                if found is not None:
                    yield found
        if size:
            found, _ = edges(kept, True)
            if found is not None:
                yield found

    return run


def links(nodes: DataFrame) -> DataFrame:
    """Distinct (fp, rep) to edges (u, v) of reps that span every component of links."""
    return _joined(nodes, BLOCKS, _stars)


def candidates(nodes: DataFrame) -> DataFrame:
    """(fp, node), fp not always distinct, to pairs (u, v), u < v, of nodes whose fingerprints differ in at most ``WIDE`` bits.

    They span the components that such pairs make in each bucket of the index, but are not all pairs.
    """
    reps = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    equal = nodes.join(reps, "fp").where("rep < node").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    return _joined(reps, MANY, _near).union(equal).distinct()


def _joined(nodes: DataFrame, blocks: int, link: Callable) -> DataFrame:
    """(fp, rep) to what ``link`` makes of the buckets of fingerprints that share one of so many blocks of 16 bits."""
    rows = nodes.select("fp", "rep", F.explode(F.array(*[F.lit(t) for t in range(blocks)])).alias("t"))
    turned = f"(shiftrightunsigned(fp, {64 // blocks} * t) | shiftleft(fp, 64 - {64 // blocks} * t))"  # shifts are modulo 64
    rows = rows.select("fp", "rep", F.expr(f"t * 65536 + cast({turned} & 65535 as int)").alias("k1"), F.expr(f"shiftrightunsigned({turned}, 16)").alias("rest"))
    big = rows.groupBy("k1").agg(F.count("*").alias("n1")).where(F.col("n1") > BUCKET)
    split = rows.join(big, "k1", "left")
    cold = split.where("n1 is null").select("k1", F.lit(-1).alias("k2"), F.lit(0).alias("c1"), F.lit(0).alias("c2"), "fp", "rep")
    hot = split.where("n1 is not null").withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(4)])))
    hot = hot.select("k1", F.expr("j * 4096 + cast(shiftrightunsigned(rest, 12 * j) & 4095 as int)").alias("k2"), "fp", "rep")
    squares = hot.groupBy("k1", "k2").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("n2"))
    hot = hot.join(squares, ["k1", "k2"]).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n2")).cast("int"))
    hot = hot.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    hot = hot.select("k1", "k2", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), "fp", "rep")
    key = ["k1", "k2", "c1", "c2"]
    n = shuffle_partitions(nodes.sparkSession)
    return cold.union(hot).repartition(n, *key).sortWithinPartitions(*key).mapInArrow(_linked(link), "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id of the component) of every row."""
    fps = settled(fingerprints(docs), "fingerprints")
    nodes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    roots = components(links(nodes))
    named = nodes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id"))
    # The commonest fingerprints, of copies, are looked up where their rows are; no other has over one in HOT of all rows.
    hot = named.orderBy(F.desc("n"), "fp").limit(HOT).select("fp", F.col("component_id").alias("hot_id"))
    looked = fps.join(F.broadcast(hot), "fp", "left")
    rest = looked.where("hot_id is null").drop("hot_id").join(named.drop("n"), "fp", "left")
    found = looked.where("hot_id is not null").select("fp", "doc_id", F.col("hot_id").alias("component_id")).unionByName(rest)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the least doc_id (of equal rows, all). Rows with a null doc_id stay."""
    keep = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    hit = docs.join(keep, docs["doc_id"] == keep["__kept"], "left_semi")
    return hit.union(docs.where("doc_id is null"))
