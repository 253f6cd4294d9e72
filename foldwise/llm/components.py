"""Connected components: local contraction, then large-star / small-star rounds.

The links are dealt to parts of at most ``PART_LINKS`` links; a task contracts
its part by union-find to stars (vertex, smallest vertex of its part), which
bounds a task's memory whatever the input and leaves at most one row per
vertex and part.  One part is then the result.  Several parts are joined by
alternating large-star and small-star steps, each a grouped minimum (with
map-side combine) and a join on the vertex, which Spark splits where a star
centre is hot; each round is written to the shared folder, so plans stay short
and a lost executor costs one round.  The driver sees one checksum per round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.frames import stored

PART_LINKS = 1_000_000


def _checksum(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _contract(links: DataFrame) -> DataFrame:
    """Stars (u, v) of each task's links; v is the smallest vertex of the
    component within the task, u every other vertex of it."""
    def run(batches):
        root: dict = {}

        def find(x):
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root.setdefault(u, u)
                root.setdefault(v, v)
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
        nodes = [x for x in root if root[x] != x]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)],
                                             names=["u", "v"])

    return links.mapInArrow(run, links.schema)


def components(links: DataFrame, part_links: int = PART_LINKS, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every vertex of the links (u, v); root is the smallest
    vertex reachable.  Raises if ``max_rounds`` do not suffice."""
    links = stored(links.where("u <> v").select("u", "v"), "links")
    parts = max(1, -(-links.count() // part_links))
    edges = stored(_contract(links.repartition(parts)), "edges")
    if parts > 1:
        edges = _stars(edges, max_rounds)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    seen = _checksum(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour points to the smallest
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the vertex and its smaller neighbours point to the smallest
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = stored(small, "edges")
        now = _checksum(edges)
        if now == seen:
            return edges
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
