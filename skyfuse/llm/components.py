"""Connected components of a link table, wholly in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfuse.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), each link once, a <> b, no nulls. Returns (node, root) for
    every node with a link; root is the smallest node reachable.

    Each round takes the least label among neighbours, then the label's label,
    so long chains halve. The tables of a round are written to the shared
    folder, and removed after the next one; nothing but the number of changes
    reaches the driver."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
    while True:
        said = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("heard"))
        told = materialize(labels.join(said, labels["node"] == said["a"]).select("node", F.least("root", "heard").alias("root"), (F.col("heard") < F.col("root")).alias("changed")))
        if not told.where("changed").head(1):
            discard(told, both)
            return labels
        of = told.select(F.col("node").alias("via"), F.col("root").alias("next"))
        last, labels = labels, materialize(told.join(of, told["root"] == of["via"]).select("node", F.col("next").alias("root")))
        discard(last, told)
