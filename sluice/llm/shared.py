"""Helpers that several operators use: shared storage, words, forests and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.storage import cut, fresh_path, shared_dir

__all__ = ["components", "cut", "forest", "fresh_path", "partitions", "shared_dir", "words"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8. bytes.split() has just these separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as a forest with the same components: each node but the smallest of its component, with the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[ia], label[ib])
        np.minimum.at(label, ia, low)
        np.minimum.at(label, ib, low)
        np.minimum.at(label, before[ia], low)
        np.minimum.at(label, before[ib], low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component: the smallest node that links reach.

    Hooking and shortcutting on DataFrames; rounds grow with the logarithm of a component's diameter. Minima
    are taken before each shuffle, and the joins are inner ones that adaptive execution can split at a hub.
    Null ends, loops and repeated edges change nothing; no edges give no rows.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = cut(edges.union(edges.select(F.col("b"), F.col("a"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("low"))
        at = near.join(label, near["a"] == label["node"]).select("node", "component", "low")
        hooked = (
            at.select("node", F.least("component", "low").alias("to"))
            .union(at.where("low < component").select(F.col("component"), F.col("low")))
            .groupBy("node")
            .agg(F.min("to").alias("to"))
        )
        above = hooked.select(F.col("node").alias("to"), F.col("to").alias("top"))
        new = cut(hooked.join(above, "to").select("node", F.col("top").alias("component")))
        changed = new.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        label = new
        if not changed:
            return label
