"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import written


def components(links: DataFrame) -> DataFrame:
    """(key, component) for every key of ``links`` (a, b longs); a component is
    named by its smallest key.

    Each key first takes its smallest neighbour as parent, which gives a forest;
    its trees are labelled by following labels to their labels' labels. The
    links then lead from label to label, most of them from one to itself;
    those go, and the rest are components of far fewer keys, found the same
    way. A hub is pre-aggregated (min) before any shuffle.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
    steps = []
    while True:
        links = written(links, "links")
        if links.isEmpty():
            break
        ends = links.select(F.col("b").alias("key"), F.col("a").alias("to")).union(links.select(F.col("a").alias("key"), F.col("a").alias("to")))
        label = _roots(written(ends.groupBy("key").agg(F.min("to").alias("label")), "parents"))
        steps.append(label)
        mapped = links
        for end in ("a", "b"):
            one = label.select(F.col("key").alias(end), F.col("label").alias(f"_{end}"))
            mapped = mapped.join(one, end).drop(end).withColumnRenamed(f"_{end}", end)
        links = mapped.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
    if not steps:
        return links.select(F.col("a").alias("key"), F.col("b").alias("component"))
    out = steps[0]
    for label in steps[1:]:  # labels of labels; those of no later link stay
        later = label.select(F.col("key").alias("label"), F.col("label").alias("_later"))
        out = out.join(later, "label", "left").select("key", F.coalesce("_later", "label").alias("label"))
    return out.withColumnRenamed("label", "component")


def _roots(parents: DataFrame) -> DataFrame:
    """(key, label): follow (key, label) pointers to keys that point to
    themselves, doubling the distance in each round."""
    while True:
        beyond = parents.select(F.col("key").alias("label"), F.col("label").alias("_beyond"))
        step = written(parents.join(beyond, "label").select("key", F.col("label").alias("old"), F.col("_beyond").alias("label")), "parents")
        parents = step.select("key", "label")
        if step.filter("old != label").isEmpty():
            return parents
