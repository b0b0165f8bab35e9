"""Connected components by repeated contraction, without any edge or label on the driver.

Every node points to its smallest neighbour or itself; pointers are doubled until they rest; edges between different ends are carried over to
those ends and the step repeats. A hub's edges are pre-aggregated before they are shuffled. Each step is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch


def _moved(scratch: Scratch, df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``column`` replaced by its parent where it has one."""
    p = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    return df.join(p, df[column] == p["_n"], "left").withColumn(column, F.coalesce("_p", column)).drop("_n", "_p")


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the component's smallest node."""
    edges = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels, step = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")), f"{name}-parents-{step}")
        hop = 0
        while True:
            further = _moved(scratch, parents.withColumn("was", F.col("parent")), "parent", parents)
            further = scratch.write(further, f"{name}-parents-{step}-{hop}")
            done = further.where("was <> parent").isEmpty()
            parents, hop = further.select("node", "parent"), hop + 1
            if done:
                break
        labels = parents.withColumnRenamed("parent", "root") if labels is None else _moved(scratch, labels, "root", parents)
        labels = scratch.write(labels, f"{name}-labels-{step}")
        edges = _moved(scratch, _moved(scratch, edges, "a", parents), "b", parents).where("a <> b")
        edges = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges-{step}")
        scratch.drop(f"{name}-parents-{step}", *(f"{name}-parents-{step}-{k}" for k in range(hop)), f"{name}-edges-{step - 1}" if step else f"{name}-edges", *([f"{name}-labels-{step - 1}"] if step else []))
        step += 1
    return labels if labels is not None else scratch.spark.createDataFrame([], "node long, root long")
