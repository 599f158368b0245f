"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of the residuals are fitted on at most ``SAMPLE`` vectors; every vector is indexed. A
query looks into the cells of its best centroids, scores their members from tables of products with the codewords
(asymmetric: the query itself is not quantised), and the best ``RERANK`` of each part of the index get their exact inner
product in double precision. How many cells a query looks into is chosen at fitting time, as the fewest that reach
``AIM`` of the true neighbours of sampled queries within the sample.

Equal vectors are indexed once, with the smallest ids of their rows, as many as can be in an answer, and equal queries
are searched once, so a vector that many rows share is no hot spot. Cells are gathered into parts of about ``PART``
vectors; a larger cell is dealt into several. Queries go to the parts that hold their cells, in blocks of ``BLOCK``, which are
searched ``STEP`` at a time.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, nor
do rows with a null id. Rows with the same id and vector count once. Ties go to the smaller id. A query with fewer
candidates than asked for gets all of them. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

SAMPLE, CODE_SAMPLE, CELLS, SUBSPACES, CODES = 1 << 14, 1 << 13, 512, 16, 256
AIM, TUNING_QUERIES = 0.97, 256
RERANK, PART, BLOCK, STEP = 512, 8192, 1 << 15, 512


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, a, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]
    bounds: np.ndarray
    probes: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of each vector."""
        cell = nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        return cell, np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.books, strict=False)], axis=1).astype(np.uint8)

    def cells(self, q: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The best cells of each query, best first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : probes or self.probes]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x subspaces x codes: products of the query's part with each codeword."""
        t = np.zeros((len(q), len(self.books), CODES), np.float32)
        for s, (a, b, book) in enumerate(zip(self.bounds, self.bounds[1:], self.books, strict=False)):
            t[:, s, : len(book)] = q[:, a:b] @ book.T
        return t

    def best(self, q: np.ndarray, probed: np.ndarray, x: np.ndarray, cell: np.ndarray, code: np.ndarray, k: int, rerank: int = RERANK) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of the k best of x for each query, -1 where there are fewer; x in order of ties, q and x in double precision.

        probed: queries x cells, whether a query looks into a cell.
        """
        q4 = q.astype(np.float32)
        tables, coarse = self.tables(q4), q4 @ self.centroids.T
        near = np.full((len(q), len(x)), -np.inf, np.float32)
        for c in np.unique(cell):
            rows, cols = np.flatnonzero(probed[:, c]), np.flatnonzero(cell == c)
            if len(rows):
                part = np.repeat(coarse[rows, c][:, None], len(cols), axis=1)
                for s in range(len(self.books)):
                    part += tables[rows, s][:, code[cols, s]]
                near[rows[:, None], cols[None, :]] = part
        take = min(rerank, len(x))
        at = np.argpartition(-near, take - 1, axis=1)[:, :take]
        real = np.isfinite(np.take_along_axis(near, at, axis=1))
        exact = np.empty(at.shape)
        for i in range(0, len(q), 64):
            exact[i : i + 64] = (x[at[i : i + 64]] * q[i : i + 64, None, :]).sum(axis=2)
        exact[~real] = -np.inf
        order = np.lexsort((at, -exact), axis=1)[:, :k]
        at, exact = np.take_along_axis(at, order, axis=1), np.take_along_axis(exact, order, axis=1)
        return np.where(np.isfinite(exact), at, -1), exact


def fit(x: np.ndarray, k: int) -> Index:
    """The index of a sample; x must not be empty."""
    x = x.astype(np.float32)
    d = x.shape[1]
    centroids = kmeans(x, min(CELLS, max(1, len(x) // 32)))
    rest = (x - centroids[nearest(x, centroids)])[:CODE_SAMPLE]
    bounds = np.unique(np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int))
    books = [kmeans(rest[:, a:b], min(CODES, len(rest)), 6) for a, b in zip(bounds, bounds[1:], strict=False)]
    index = Index(centroids, books, bounds, len(centroids))
    # The cells in which the true neighbours of some sampled vectors lie.
    q = x[:: max(1, len(x) // TUNING_QUERIES)][:TUNING_QUERIES]
    k = min(k + 1, len(x))
    true = np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]
    place = np.argsort(index.cells(q, len(centroids)), axis=1)
    held = np.sort(np.take_along_axis(place, nearest(x, centroids)[true], axis=1).ravel())
    index.probes = int(held[min(len(held) - 1, math.ceil(AIM * len(held)) - 1)]) + 1
    return index


def usable(emb: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): rows that take part, the vector as the bytes of its doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float) if len(lists) else np.zeros(0)
            ends = np.cumsum(np.where(lists.is_valid().to_numpy(zero_copy_only=False), size, 0))
            good = np.isfinite(flat)
            ids, vecs = [], []
            for i, e in enumerate(ends.tolist()):
                s = ends[i - 1] if i else 0
                v = flat[s:e]
                if b.column(0)[i].is_valid and e > s and good[s:e].all() and v.any():
                    ids.append(b.column(0)[i].as_py())
                    vecs.append((v + 0.0).tobytes())
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "vec": pa.array(vecs, pa.binary())})

    return emb.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "id bigint, vec binary")


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), float).reshape(len(vecs), -1) if len(vecs) else np.zeros((0, 1))


def _parts(sizes: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """Cell to its first part and the number of parts it is dealt to."""
    first, many, part, room = {}, {}, 0, PART
    for c in sorted(sizes):
        n = math.ceil(sizes[c] / PART)
        if n == 1 and sizes[c] <= room:
            first[c], many[c] = part, 1
            room -= sizes[c]
            continue
        part += room < PART
        first[c], many[c] = part, n
        part, room = (part + n, PART) if n > 1 else (part, PART - sizes[c])
    return first, many


def search(emb: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best found for each row that is_query (a condition on ``id``) holds for."""
    spark = emb.sparkSession
    ranked = Window.partitionBy("vec").orderBy("id")
    base = usable(emb, key, vector)
    length = base.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if length is None:
        return empty
    base = base.where(F.length("vec") == length[0]).distinct()
    few = base.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k + 1)
    unique = settled(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("uid", F.get("ids", F.lit(0))), "vectors")
    sample = unique.select("vec", "uid").orderBy(F.xxhash64("uid")).limit(SAMPLE).toPandas()
    index = fit(_matrix(sample["vec"]), k)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, code = shared.value.encode(_matrix(pd.Series(b.column(0).to_pylist())).astype(np.float32)) if b.num_rows else (np.zeros(0, int), np.zeros((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array([x.tobytes() for x in code], pa.binary())], names=["vec", "ids", "uid", "cell", "code"])

    listed = settled(unique.select("vec", "ids", "uid").mapInArrow(assign, "vec binary, ids array<bigint>, uid bigint, cell int, code binary"), "lists")
    sizes = {r["cell"]: r["count"] for r in listed.groupBy("cell").count().collect()}  # at most CELLS rows
    first, many = _parts(sizes)
    table = F.create_map(*[F.lit(x) for c in sizes for x in (c, first[c])])
    dealt = F.create_map(*[F.lit(x) for c in sizes for x in (c, many[c])])
    lists = listed.withColumn("part", F.element_at(table, F.col("cell")) + F.pmod(F.xxhash64("uid"), F.element_at(dealt, F.col("cell"))).cast("int"))
    asked = base.where(is_query).join(unique.select("vec", "uid"), "vec")
    queries = asked.groupBy("uid").agg(F.first("vec").alias("vec"))
    blocks = max(1, math.ceil(asked.select("uid").distinct().count() / BLOCK))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(pd.Series(b.column(1).to_pylist())).astype(np.float32)
            row, part = [], []
            for i, cells in enumerate(shared.value.cells(q)):
                parts = {first[c] + j for c in cells.tolist() if c in first for j in range(many[c])}
                row += [i] * len(parts)
                part += sorted(parts)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in b.columns), pa.array(part, pa.int32())], names=["uid", "vec", "part"])

    routed = queries.mapInArrow(route, "uid bigint, vec binary, part int").withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    members = lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else lists.withColumn("block", F.lit(0))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"quid": pd.Series(dtype="int64"), "uid": pd.Series(dtype="int64"), "score": pd.Series(dtype=float), "ids": pd.Series(dtype=object)})
        if not len(left) or not len(right):
            return none
        left = left.sort_values("uid", ignore_index=True)
        index, x = shared.value, _matrix(left["vec"])
        code = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
        out = []
        for i in range(0, len(right), STEP):
            part = right.iloc[i : i + STEP]
            q = _matrix(part["vec"])
            probed = np.zeros((len(q), len(index.centroids)), bool)
            np.put_along_axis(probed, index.cells(q.astype(np.float32)), True, axis=1)
            at, score = index.best(q, probed, x, left["cell"].to_numpy(), code, k + 1)
            row, col = np.nonzero(at >= 0)
            at = at[row, col]
            out.append(pd.DataFrame({"quid": part["uid"].to_numpy()[row], "uid": left["uid"].to_numpy()[at], "score": score[row, col], "ids": left["ids"].to_numpy()[at]}))
        return pd.concat(out)

    found = members.groupBy("part", "block").cogroup(routed.groupBy("part", "block")).applyInPandas(look, "quid bigint, uid bigint, score double, ids array<bigint>")
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "uid")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    pairs = F.flatten(F.transform(F.collect_list(F.struct("score", "ids")), lambda r: F.transform(r["ids"], lambda i: F.struct((-r["score"]).alias("far"), i.alias("id")))))
    answer = top.groupBy("quid").agg(F.slice(F.sort_array(pairs), 1, k + 1).alias("near"))
    own = asked.select(F.col("id").alias("query_id"), F.col("uid").alias("quid")).join(answer, "quid")
    rest = own.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("pos", "x"))
    return rest.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def neighbours(emb: DataFrame) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return search(emb, F.col("id") % 20 == 0)
