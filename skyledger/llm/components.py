"""Connected components of links between integer ids, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, class_id): class_id is the smallest id of the component.

    Each round gives every id the smallest label among its neighbours', hooks the class it had to
    that label and then jumps to its label's label, so the rounds follow the logarithm of a chain's
    length. Each round is settled; nothing is gathered on the driver. Ids without a link aren't returned.
    """
    edges = settle(links.select("a", "b").where("a <> b").union(links.select(F.col("b"), F.col("a")).where("a <> b")).distinct())
    labels = settle(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("class_id")))
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy(F.col("a").alias("n")).agg(F.min("class_id").alias("near"))
        step = labels.join(near, labels.id == F.col("n")).select("id", "class_id", F.least("class_id", "near").alias("goal"))
        # an old label hooks to the smallest label that any of its ids has seen
        hooks = step.where("goal < class_id").groupBy(F.col("class_id").alias("h")).agg(F.min("goal").alias("hook"))
        step = settle(step.join(hooks, step.goal == F.col("h"), "left").select("id", F.col("class_id").alias("old"), F.coalesce("hook", "goal").alias("goal")))
        jump = step.select(F.col("id").alias("j"), F.col("goal").alias("jump"))
        new = settle(step.join(jump, step.goal == F.col("j"), "left").select("id", "old", F.least("goal", F.coalesce("jump", "goal")).alias("class_id")))
        labels = new.select("id", "class_id")
        if not new.where("class_id <> old").limit(1).count():
            return labels
