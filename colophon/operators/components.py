"""Connected components of links between long ids, by rounds of min-labels and pointer jumping.

Each round gives every node the smallest label among itself and its neighbours and then the
label of that label, so the number of rounds follows the logarithm of the longest chain. Every
round is written to the shared folder. Nothing but one number a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.operators.tables import forget, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each end of ``links(a, b)``; root is the smallest node reachable.

    Links may repeat, loop and stand in either direction; ends must not be null.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("low"))
        low = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
        step = written(low.join(jump, "low", "left").select("node", "old", F.least("low", F.coalesce("next", "low")).alias("root")), "labels")
        changed = step.filter("root <> old").limit(1).count()
        forget(labels)
        labels = step.select("node", "root")
        if not changed:
            forget(both)
            return labels
