"""What links lead to: recursion over a table, round by round over what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.storage import cut


def reach(links: DataFrame, start: DataFrame, source: str = "a", target: str = "b", node: str = "node", most: int | None = None) -> DataFrame:
    """(node, hops) of every node that links (source, target) lead to from the nodes of start, with the fewest links that
    it takes; those of start have 0. most: links at most, None for any number.

    Semi-naive: a round follows the links of the nodes that the round before found, and keeps those not seen; it ends
    where none is new, so cycles end it too. As many rounds as the longest of the shortest ways; each cuts its lineage.
    Links are distinct and dealt out by their source once. Null ends lead nowhere; nodes of start without links stay;
    repeated rows change nothing.
    """
    edges = cut(links.select(F.col(source).alias("__from"), F.col(target).alias(node)).where(F.col("__from").isNotNull() & F.col(node).isNotNull()).distinct())
    seen = cut(start.select(node).where(F.col(node).isNotNull()).distinct().withColumn("hops", F.lit(0)))
    front, hops = seen, 0
    while most is None or hops < most:
        hops += 1
        next_ones = edges.join(front.select(F.col(node).alias("__from")), "__from", "left_semi").select(node).distinct()
        front = cut(next_ones.join(seen, node, "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen
