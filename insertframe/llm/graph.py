"""Connected components of large graphs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(edges: DataFrame, stage: Stage, name: str = "cc", a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge; the component is its smallest node.

    Each round sends the smallest label over every edge and then to every node that a changed
    node points to (pointer jumping), so long chains take a logarithmic number of rounds.
    Minima are partially aggregated before they are shuffled, so a hub does not gather its
    neighbours. Labels are written to the shared folder each round; only a count of changes
    reaches the driver. Raises if the labels still change after ``max_rounds``.
    """
    edges = stage.put(edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), f"{name}-edges")
    first = edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")))
    labels = stage.put(first.groupBy("node").agg(F.min("label").alias("label")), f"{name}-0")
    for k in range(1, max_rounds + 1):
        up = edges.join(labels, edges["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        down = edges.join(labels, edges["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        sent = up.union(down)
        near = labels.select("node", "label").union(sent).groupBy("node").agg(F.min("label").alias("label"))
        near = stage.put(near, f"{name}-{k}-near")
        # the label's own label, if it has a smaller one by now
        far = near.alias("x").join(near.alias("y"), F.col("x.label") == F.col("y.node")).select("x.node", F.least("x.label", "y.label").alias("label"))
        new = stage.put(far, f"{name}-{k}")
        changed = new.alias("n").join(labels.alias("o"), "node").filter("n.label <> o.label").limit(1).count()
        stage.drop(f"{name}-{k}-near")
        stage.drop(f"{name}-{k - 1}")
        labels = new
        if not changed:
            stage.drop(f"{name}-edges")
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components still change after {max_rounds} rounds")
