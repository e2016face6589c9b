"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import discard, store


def _star(edges: DataFrame) -> DataFrame:
    """Hang the neighbours of every node, and the node, on the smallest of them.

    The smallest neighbour comes from an aggregate with map-side combine, and
    goes back by a join that Spark can split where a node has very many edges.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return hung.unionByName(own).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def connected_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after also joining the ends of ``links``
    (pivot, member).  A component's label is its smallest id."""
    a = links.join(labels.select(F.col("id").alias("pivot"), F.col("component").alias("u")), "pivot")
    ends = a.join(labels.select(F.col("id").alias("member"), F.col("component").alias("v")), "member")
    edges = store(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = _mark(edges)
    while mark["n"]:
        last, edges = edges, store(_star(edges))
        discard(last)
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return labels.join(roots, F.col("component") == F.col("u"), "left").select("id", F.coalesce("root", "component").alias("component"))
