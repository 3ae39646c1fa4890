"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of links; component is the least node reachable.

    Two steps in turn, each one aggregation and one join on a node: every greater
    neighbour of a node is hung on its least neighbour, then every lesser one. Both only
    replace links by shorter ones, so stars are left after some log(n) rounds. Edges are
    written after each step, and the driver sees a count of them and a hash. A node with
    very many links is aggregated map-side; what that gives is written before the join, so
    that the join can be split. Nulls and links of
    a node with itself are left out.
    """
    pair = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("both"))
    edges = written(pair.where("both AND high <> low").select("high", "low").distinct(), "edges")
    now = _signature(edges)
    while True:
        ways = edges.select(F.explode(F.array(F.struct(F.col("high").alias("u"), F.col("low").alias("v")), F.struct(F.col("low").alias("u"), F.col("high").alias("v")))).alias("e")).select("e.*")
        least = written(ways.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("low")), "least")
        large = written(ways.where("v > u").join(least, "u").select(F.col("v").alias("high"), "low").distinct(), "edges")
        least = written(large.groupBy("high").agg(F.min("low").alias("m")), "least")
        small = large.join(least, "high").select(F.explode(F.array("high", "low")).alias("high"), F.col("m").alias("low"))
        edges = written(small.where("high <> low").distinct(), "edges")
        before, now = now, _signature(edges)
        if now == before:
            roots = edges.select("low").distinct()
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots.select(F.col("low").alias("node"), F.col("low").alias("component")))


def joined_components(known: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """components() of more links beside those whose components are known (node, component).

    Only links between different components go through rounds, each component as one
    node, so a long chain that is known is not walked again.
    """
    names = known.withColumnRenamed("component", "name")
    both = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b"))
    for end in ("a", "b"):
        found = both.join(names.withColumnRenamed("node", end), end, "left")
        both = found.withColumn(f"{end}_name", F.coalesce("name", end)).drop("name")
    both = written(both, "named_links")
    merged = written(components(both.select("a_name", "b_name"), "a_name", "b_name"), "merged")
    fresh = both.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti").withColumn("component", F.col("node"))
    nodes = known.select("node", "component").unionByName(fresh)
    joined = nodes.join(merged.withColumnRenamed("component", "least").withColumnRenamed("node", "component"), "component", "left")
    return joined.select("node", F.coalesce("least", "component").alias("component"))
