"""Connected components over a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.scratch import write_table


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of the links (columns a, b); root is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then follows
    labels once more, so that distances halve; every round is a written table. Links
    grow with the corpus, so no join broadcasts.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        nearest = (
            both.hint("merge").join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("root").alias("seen"))
        )
        pulled = labels.hint("merge").join(nearest, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
        after = write_table(
            pulled.hint("merge").join(jump, F.col("root") == F.col("via"), "left").select(
                "node", "old", F.least(F.col("root"), F.coalesce("beyond", "root")).alias("root")
            ),
            "labels",
        )
        labels = after.select("node", "root")
        if after.filter(F.col("old") != F.col("root")).isEmpty():
            return labels
