"""Connected components by least labels and pointer jumping, as joins and aggregates over tables of links.

Every round each node takes the least label among its own and its neighbours', tells it to the node that its label
named before, and then takes the label of its label; rounds end when nothing changes, after about the logarithm of the
longest path. Each round's labels are written, and those of the round before deleted. Hubs are
no groups: labels are reduced by partial aggregates, and only (node, label) rows travel.

Cases: repeated links and links of a node with itself change nothing; links with a null end are left out; no links give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lasting, look_up, release


def components(links: DataFrame) -> DataFrame:
    """Rows (class, label) for every node of the links (a, b); label is the least node of its component."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = lasting(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = both.count()
    labels = last = lasting(both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.col("a")).alias("label")), n)
    while True:
        near = look_up(both.withColumnRenamed("b", "class"), labels, "class").groupBy(F.col("a").alias("class")).agg(F.min("label").alias("near"))
        told = labels.join(near, "class")
        own = told.select("class", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        hooks = told.where("near < label").select(F.col("label").alias("class"), F.col("near").alias("label"), F.lit(None).cast("long").alias("before"))
        stepped = lasting(own.unionByName(hooks).groupBy("class").agg(F.min("label").alias("label"), F.max("before").alias("before")), n)
        jump = stepped.select(F.col("class").alias("label"), F.col("label").alias("next"))
        done = lasting(look_up(stepped, jump, "label").select("class", "before", F.least("label", "next").alias("label")), n)
        release(stepped, last)
        labels, last = done.select("class", "label"), done
        if done.where("before <> label").isEmpty():
            release(both)
            return labels
