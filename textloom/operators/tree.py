"""Trees as tables of processes (pid, parent, rss)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def subtree_totals(processes: DataFrame, roots: list[int]) -> DataFrame:
    """(root, processes, rss) of each root and all below it, by one join a level of the tree; parents must form no cycle.

    Every level is written out, so no lineage builds up, and neither rows nor levels have a limit.
    """
    p = materialize(processes.select("pid", "parent", "rss"), "processes")
    level = materialize(p.filter(F.col("pid").isin(roots)).select(F.col("pid").alias("root"), "pid"), "level")
    levels = [level]
    children = p.select(F.col("pid").alias("child"), "parent")
    while not level.isEmpty():
        level = materialize(level.join(children, F.col("pid") == F.col("parent")).select("root", F.col("child").alias("pid")), "level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).join(p, "pid").groupBy("root").agg(F.count("*").alias("processes"), F.sum("rss").alias("rss"))
