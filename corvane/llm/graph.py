"""Connected components of a graph whose links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Tables


def components(links: DataFrame, tables: Tables, key: str = "cc") -> DataFrame:
    """links (a, b) -> (node, comp): comp is the least node reachable. Nodes without links don't appear.

    Each round a node takes the least label about it, and then its label's label, so paths halve; every round is
    written to the shared folder. Rows per round: nodes plus twice the links; a hub's messages are combined before
    the shuffle."""
    both = tables.write(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), f"{key}-links")
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = tables.write(least.select("node", F.least("node", "m").alias("comp")), f"{key}-0")
    k = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        low = labels.join(near, "node").select("node", "comp", F.least("comp", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        nxt = low.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("comp"), F.col("comp").alias("old"))
        k += 1
        nxt = tables.write(nxt, f"{key}-{k}")
        tables.release(f"{key}-{k - 1}")
        changed = not nxt.filter("comp <> old").isEmpty()
        labels = nxt.select("node", "comp")
        if not changed:
            tables.release(f"{key}-links")
            return labels
