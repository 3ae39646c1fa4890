"""Connected components of a graph of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); component is the smallest node reachable.

    Every round takes the least label among neighbours and then the label of the
    label, so chains shrink by more than half each time. Labels and links live in
    the shared folder; only a count of changes reaches the driver. Null ends are
    ignored; no links give no rows.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = materialize(labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("low")), "lower")
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        jumped = materialize(lower.join(jump, "low").select("node", F.col("component").alias("old"), F.col("next").alias("component")), "labels")
        labels = jumped.select("node", "component")
        if not jumped.where("component <> old").limit(1).count():
            return labels
