"""Connected components of an edge table, by minimum labels with jumps.

Each round gives a node the smallest label among its own, its neighbours' and
its label's label, so labels halve their distance to the root on chains and
settle in a few rounds on stars. Rounds are DataFrame joins and grouped minima
(combined in the tasks first); each is written once and replaces the one before.
Edges and labels are merged at every size: written, they take few bytes a row (a
root repeats), far fewer than rows sent to every task would.
Only whether a label has moved reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.llm.scratch import Scratch


def components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest
    node of its component. Loops and repeated edges are allowed."""
    both = tmp.put(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = tmp.put(both.groupBy("u").agg(F.min("v").alias("v"))
                     .select(F.col("u").alias("node"), F.least("u", "v").alias("root"), F.lit(True).alias("moved")))
    while labels.filter("moved").limit(1).count():
        own = labels.select("node", "root")
        near = both.join(own.hint("merge"), both["v"] == own["node"]).select(F.col("u").alias("node"), "root")
        jump = own.alias("l").join(own.alias("m").hint("merge"), F.col("l.root") == F.col("m.node")).select(
            F.col("l.node").alias("node"), F.col("m.root").alias("root"))
        old = own.select("node", "root", F.col("root").alias("old"))
        best = (old.unionByName(near.union(jump).withColumn("old", F.lit(None).cast(old.schema["old"].dataType)))
                .groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old")))
        done = tmp.put(best.select("node", "root", (F.col("root") != F.col("old")).alias("moved")))
        tmp.drop(labels)
        labels = done
    tmp.drop(both)
    return labels


def merge(labels: DataFrame, edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(node, root) after ``edges`` (a, b) join the components of ``labels``;
    only the roots they touch are labelled anew."""
    own = labels.select("node", "root")
    left = own.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = own.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    known = tmp.put(edges.join(left.hint("merge"), "a", "left").join(right.hint("merge"), "b", "left").select(
        "a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")))
    fresh = known.select(F.col("a").alias("node")).union(known.select("b")).distinct().join(
        own.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("root"))
    found = components(known.select(F.col("ra").alias("a"), F.col("rb").alias("b")), tmp)
    moved = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = tmp.put(own.unionByName(fresh).join(moved.hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    tmp.drop(labels, known, found)
    return out
