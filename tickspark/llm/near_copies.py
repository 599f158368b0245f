"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, joined without loss.

Operator 1 finds them first: every set has a 64-bit SimHash of its shingles, and the Gray-order index of ``simhash.py`` brings
together sets whose fingerprints differ in few bits. Its pairs are compared whole, and what is similar becomes a link. The
index spans a large group with few pairs, so such a group never becomes all its pairs.

Similar sets can differ in more bits than any index of 64 can afford, so an exact join finds the links that are left, of
sets that are not in one component yet. Two similar sets share at least four fifths of either, so in any one order of all
shingles they share one of the first fifth of each: a row for each of these finds every pair. The order puts the shingles
that a sample of documents has most often last, so few documents meet that are not alike; the sample decides how fast the
join is and never what it finds. In a bucket of documents that share a shingle, a pair goes on only if its sizes and the
places of the shingle leave room for 0.8, which holds in the bucket of the first shingle that two near copies share.

In each of some rounds, every document is compared with a head of its buckets, mostly the same one in all buckets of a group
and another in each round, if it is not in the head's component yet; afterwards only pairs that are not in one component are
compared. Every row carries the parity of its set in 256 bits: two sets differ in no fewer shingles than their parities in
bits, so a pair with more than 0.8 allows goes in its bucket. Pairs that the first shingles rule out go next; every other
comparison is of the whole sets. A group is a connected component of links, and its document with the least doc_id stays.

Nulls: a null or wordless text has one shingle of its own and links like any other; a text of under five words is one
shingle. Rows with a null doc_id take no part in linking and stay. Of equal rows, all stay. An empty table gives an empty
result. All columns are kept. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import settled, shuffle_partitions
from .components import components
from .idcache import release

SHINGLE = 5
#: Similarity of a link, as a fraction.
NUM, DEN = 4, 5
#: Documents sampled for the order of shingles, and the shingles of them, the commonest, that have a place in it.
SAMPLE = 40_000
COMMON = 1 << 20
#: Ranges of shingles, a power of two, that the sample's are counted in, as arrays: as rows they would fill an executor.
PARTS = 1024
#: Rounds of comparisons with the head of a bucket.
ROUNDS = 1
#: Bits of a set's parity, and the columns of 64 of them.
BITS = 256
PARITY = [f"p{k}" for k in range(BITS // 64)]
#: Nodes, of 8 bytes, up to which they are sent to the rows that they are looked up in.
BROADCAST = 1 << 20
#: Partners of a node that are compared with it in one group.
PARTNERS = 1024
#: Rows of a bucket up to which those without any partner are dropped before texts are fetched.
BUCKET = 4096

_SET = "doc_id bigint, n int, digest bigint, fp bigint, often bigint, first array<bigint>, " + ", ".join(f"{p} bigint" for p in PARITY)
_ROWS = "gram bigint, node bigint, n int, at int"


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes (sorted, int64) of the different shingles."""
    w = (text or b"").lower().split()  # bytes: only A-Z, and only the spaces of the word rule
    if not w:
        return np.zeros(1, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    grams = np.zeros(max(1, len(w) - size + 1), np.uint64)
    if len(w) < size:
        grams += np.uint64(len(w))
    for k in range(min(size, len(w))):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(grams)]
    grams = (grams ^ grams >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((grams ^ grams >> np.uint64(29)).view(np.int64))


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n has to share with any near copy."""
    return (NUM * n + DEN - 1) // DEN


def parity(s: np.ndarray) -> np.ndarray:
    """Whether the shingles that hash to each bit are odd in number, as int64 words."""
    odd = np.bincount((s.view(np.uint64) >> np.uint64(7)) % np.uint64(BITS), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def close(n: np.ndarray | int, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m with parities p and q (words by sets) can be near copies: sets that share k shingles have
    n + m - 2 k that only one of them has."""
    differ = np.bitwise_count((p ^ q).view(np.uint64)).sum(axis=0, dtype=np.int64)  # of signed numbers it counts the absolute value
    return (NUM + DEN) * (n + m - differ) >= 2 * NUM * (n + m)


def _commonest(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that a sample has more than once, and how often."""

    def parted(held: list[np.ndarray]) -> pa.RecordBatch:
        s = np.sort(np.concatenate(held))
        ends = np.r_[np.searchsorted(s, (np.arange(1, PARTS) - PARTS // 2) << 64 - PARTS.bit_length() + 1), len(s)]
        parts = [s[a:b].tobytes() for a, b in zip(np.r_[0, ends], ends, strict=False)]
        return pa.record_batch({"part": pa.array(range(PARTS), pa.int32()), "grams": pa.array(parts, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(shingles(t.as_py()))
                size += len(held[-1])
                if size >= 1 << 20:
                    yield parted(held)
                    held, size = [], 0
        if held:
            yield parted(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_py(), np.int64) for b in batches for x in b.column(1)]
        if held:
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            several = n > 1
            yield pa.record_batch({"gram": pa.array(gram[several]), "n": pa.array(n[several])})

    total = docs.count()
    some = docs.select(F.col("text").cast("binary")).sample(min(1.0, SAMPLE / max(total, 1)), 1)
    parts = some.mapInArrow(run, "part int, grams binary").repartition(shuffle_partitions(docs.sparkSession), "part")
    counts = settled(parts.mapInArrow(count, "gram bigint, n bigint"), "shingle-counts", small=True)
    # From the highest count down, as many whole counts as make COMMON shingles at most; the driver gets these, as columns.
    least, many = 2**62, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("grams")).orderBy(F.desc("n")).collect():
        many += r["grams"]
        if many > COMMON:
            break
        least = r["n"]
    rows = counts.where(F.col("n") >= least).toArrow()
    gram, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def _sets(docs: DataFrame) -> DataFrame:
    """Size, digest, fingerprint and first shingles, in order, of the set of every row with a doc_id; often: the count of the last of these."""
    common = docs.sparkSession.sparkContext.broadcast(_commonest(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        grams, counts = common.value
        for b in batches:
            n, digest, prints, last, first = [], [], [], [], []
            bits = np.zeros((len(PARITY), b.num_rows), np.int64)
            for k, t in enumerate(b.column(1)):
                s = shingles(t.as_py())
                bits[:, k] = parity(s)
                often = np.zeros(len(s), np.int64)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    often = np.where(grams[at] == s, counts[at], 0)
                n.append(len(s))
                digest.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                prints.append(simhash.majority(s))
                order = np.lexsort((s, often))[: len(s) - needed(len(s)) + 1]
                last.append(often[order[-1]])
                first.append(s[order])
            ends = np.r_[0, np.cumsum([len(f) for f in first])].astype(np.int32)
            flat = pa.array(np.concatenate(first) if first else np.zeros(0, np.int64))
            yield pa.record_batch({"doc_id": b.column(0), "n": pa.array(n, pa.int32()), "digest": pa.array(np.array(digest, np.uint64).view(np.int64)), "fp": pa.array(prints, pa.int64()), "often": pa.array(last, pa.int64()), "first": pa.ListArray.from_arrays(pa.array(ends), flat)} | dict(zip(PARITY, map(pa.array, bits), strict=True)))

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _SET)


def _room(n: np.ndarray, at: np.ndarray, m: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether sets of n and m whose first common shingle is at these places can be near copies."""
    most = np.minimum(n - at, m - place)
    return (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & ((NUM + DEN) * most >= NUM * (n + m))


def _by_bucket(one: Callable[..., list[np.ndarray] | None], names: list[str], types: list[pa.DataType]) -> Callable:
    """A function of batches of rows sorted by their first column, from one of the other columns of a bucket of two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, size
            cols = [np.concatenate(c) for c in zip(*kept, strict=True)]
            key = cols[0]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            if not last:
                kept = [[c[starts[-1] :] for c in cols]]
                size = len(kept[0][0])
            ends = np.r_[starts[1:], len(key)]
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            several = ends - starts > 1
            out, held = [], 0
            for lo, hi in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                for found in one(*[c[lo:hi] for c in cols]):
                    out.append(found)
                    held += len(found[0])
                    if held >= 1 << 16:
                        yield _batch(out)
                        out, held = [], 0
            if out:
                yield _batch(out)

        def _batch(out: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        limit = 1 << 16
        for b in batches:
            if b.num_rows:
                kept.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
                size += b.num_rows
            if size >= limit:
                yield from flush(False)
                limit = max(1 << 16, 2 * size)
        if size:
            yield from flush(True)

    return run


def _partnered(gram: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The rows of a bucket that have a partner in it."""
    if len(n) == 2:
        hit = np.full(2, bool(_room(n[0], at[0], n[1], at[1]) and node[0] != node[1]))
    elif len(n) > BUCKET:
        hit = np.ones(len(n), bool)
    else:
        hit = np.array([(_room(n[k], at[k], n, at) & (node != node[k])).any() for k in range(len(n))])
    if hit.any():
        yield [gram[hit], node[hit], n[hit], at[hit]]


def _headed(gram: np.ndarray, order: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, *bits: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Pairs of the first of a bucket with the others that are not in its component."""
    yield from _fit(0, node, n, at, root, np.stack(bits))


def _across(gram: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, *bits: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Pairs of a bucket that are in different components."""
    if (root == root[0]).all():
        return
    p = np.stack(bits)
    for k in range(len(n) - 1):
        yield from _fit(k, node, n, at, root, p)


def _fit(k: int, node: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, p: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Pairs of row k of a bucket with those after it in other components that sizes, places and parities leave possible."""
    hit = k + 1 + np.flatnonzero(_room(n[k], at[k], n[k + 1 :], at[k + 1 :]) & (root[k + 1 :] != root[k]))
    hit = hit[close(n[k], p[:, k, None], n[hit], p[:, hit])]
    if len(hit):
        yield [np.minimum(node[k], node[hit]), np.maximum(node[k], node[hit])]


def _possible(x: tuple[int, int, np.ndarray], y: tuple[int, int, np.ndarray]) -> bool:
    """Whether sets with this (size, often, first) can be near copies. The set whose last first shingle is the earlier one in
    the order has all that its first ones share with the other among the other's first ones, so the rest of these it lacks."""
    if (y[1], y[2][-1]) < (x[1], x[2][-1]):
        x, y = y, x
    both = len(np.intersect1d(x[2], y[2], assume_unique=True))
    return (NUM + DEN) * min(x[0] - len(x[2]) + both, y[0]) >= NUM * (x[0] + y[0])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    return (NUM + DEN) * len(np.intersect1d(x, y, assume_unique=True)) >= NUM * (len(x) + len(y))


def _fitting(pairs: DataFrame, of: DataFrame, load: Callable, fits: Callable) -> DataFrame:
    """The pairs (u, v), which are distinct, that fit by what ``load`` makes of a row of ``of`` (node and other columns).

    The row of u goes to its partners once, not with each; a node with over ``PARTNERS`` of them is dealt to several groups.
    Rows stream in order of u, so a task holds what it has of u besides the row in hand.
    """
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")), F.struct(F.col("v").alias("node"), F.lit(0).alias("n")))
    nodes = settled(pairs.select(F.inline(ends)).groupBy("node").agg(F.sum("n").alias("partners")), "near-nodes", small=True)
    hubs = nodes.where("partners > 0").select(F.col("node").alias("u"), F.ceil(F.col("partners") / PARTNERS).cast("int").alias("groups"))
    part = F.pmod(F.xxhash64("v"), F.coalesce("groups", F.lit(1))).cast("int")
    sides = pairs.join(hubs.where("groups > 1"), "u", "left").select("u", part.alias("part"), F.col("v").alias("node"), F.lit(True).alias("right"))
    heads = hubs.select("u", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("u").alias("node"), F.lit(False).alias("right"))
    wanted = nodes.select(F.col("node").alias("wanted"))
    few = nodes.count() <= BROADCAST  # or else rows are shuffled to the nodes
    payload = of.join(F.broadcast(wanted) if few else wanted, F.col("node") == F.col("wanted"), "left_semi")
    rows = sides.union(heads).join(payload, "node").select("u", "part", "right", "node", *[c for c in of.columns if c != "node"])
    rows = rows.repartition(shuffle_partitions(pairs.sparkSession), "u", "part").sortWithinPartitions("u", "part", "right", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the rows of u; a repeated doc_id has several
        key = done = None
        for b in batches:
            us, parts, rights, nodes = (b.column(c).to_pylist() for c in range(4))
            hit = []
            for k, (u, part, right) in enumerate(zip(us, parts, rights, strict=True)):
                if (u, part) != key:
                    key, held = (u, part), []
                own = load(*[c[k] for c in b.columns[4:]])
                if not right:
                    held.append(own)
                elif (key, nodes[k]) != done and any(fits(x, own) for x in held):
                    hit.append(k)
                    done = key, nodes[k]
            yield pa.record_batch({"u": pa.array([us[k] for k in hit], pa.int64()), "v": pa.array([nodes[k] for k in hit], pa.int64())})

    return settled(rows.mapInArrow(run, "u bigint, v bigint"), "near-copies", small=True)


def _compared(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that are near copies: those that their first shingles leave possible are compared whole."""
    pairs = settled(pairs.distinct(), "near-pairs", small=True)
    firsts = sets.select(F.col("doc_id").alias("node"), "n", "often", "first")
    some = _fitting(pairs, firsts, lambda n, often, first: (n.as_py(), often.as_py(), first.values.to_numpy()), _possible)
    return _fitting(some, texts, lambda text: shingles(text.as_py()), _similar)


def indexed(sets: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (u, v) among the pairs that the Gray-order index of fingerprints brings together."""
    prints = sets.join(nodes, sets["doc_id"] == nodes["node"], "left_semi").select("fp", F.col("doc_id").alias("node")).distinct()
    return _compared(simhash.candidates(settled(prints, "fingerprints", small=True)), sets, texts)


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The least doc_id (node) of each different set, and edges (u, v) of nodes that span every component of near copies."""
    n = shuffle_partitions(docs.sparkSession)
    sets = settled(_sets(docs), "shingle-sets")
    nodes = settled(sets.groupBy("digest").agg(F.min("doc_id").alias("node")).select("node").distinct(), "set-nodes", small=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))
    near = indexed(sets, nodes, texts)

    rows = sets.join(nodes, sets["doc_id"] == nodes["node"], "left_semi").select(F.posexplode("first").alias("at", "gram"), F.col("doc_id").alias("node"), "n")
    dealt = rows.select("gram", "node", "n", "at").repartition(n, "gram").sortWithinPartitions("gram")
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    rows = settled(dealt.mapInArrow(_by_bucket(_partnered, ["gram", "node", "n", "at"], types), _ROWS), "near-buckets", small=True)

    def pairs(of: DataFrame, one: Callable) -> DataFrame:
        return of.mapInArrow(_by_bucket(one, ["u", "v"], types[:2]), "u bigint, v bigint")

    def rooted() -> DataFrame:
        roots = components(near).select(F.col("node").alias("member"), "root")
        return rows.join(roots, F.col("node") == F.col("member"), "left").select("gram", "node", "n", "at", F.coalesce("root", "node").alias("root"), *PARITY)

    bits = sets.select(F.col("doc_id").alias("member"), *PARITY).dropDuplicates(["member", *PARITY])
    rows = settled(rows.join(bits, F.col("node") == F.col("member")).select("gram", "node", "n", "at", *PARITY), "near-rows", small=True)
    for k in range(ROUNDS):
        by_head = rooted().select("gram", F.xxhash64("node", F.lit(k)).alias("order"), "node", "n", "at", "root", *PARITY).repartition(n, "gram").sortWithinPartitions("gram", "order", "node")
        near = near.union(_compared(pairs(by_head, _headed), sets, texts))
    rest = _compared(pairs(rooted().repartition(n, "gram").sortWithinPartitions("gram"), _across), sets, texts)
    return nodes, near.union(rest)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id. Rows with a null doc_id stay."""
    nodes, edges = links(docs)
    roots = components(edges)
    keep = nodes.join(roots.select(F.col("node").alias("gone")), F.col("node") == F.col("gone"), "left_anti").select(F.col("node").alias("__kept"))
    hit = docs.join(keep, docs["doc_id"] == keep["__kept"], "left_semi")
    return hit.union(docs.where("doc_id is null"))
