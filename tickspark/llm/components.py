"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations by node and the joins back, so a hub never has its neighbours gathered in one row; the
edges of each round are written to the shared folder. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settled


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and its neighbours."""
    u, v = F.col("u"), F.col("v")
    both = edges.select(F.inline(F.array(F.struct(u.alias("n"), v.alias("o")), F.struct(v.alias("n"), u.alias("o")))))
    least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.join(least, "n").where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these; edges run from u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    return edges.join(least, "u").select(F.inline(F.array(F.struct(u.alias("u"), m.alias("v")), F.struct(v.alias("u"), m.alias("v"))))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) bigint pairs, in any order and with repeats, to (node, root): the least node of the component, for all nodes but the roots."""
    ordered = settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        large = settled(_large(ordered), "stars")  # read several times below: in one plan, it would be planned as often
        forget(ordered)
        ordered = settled(_small(large), "stars")
        forget(large)
        now = ordered.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or now[0] == 0:
            return ordered.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
