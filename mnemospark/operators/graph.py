"""Relations between entries: edges, degrees, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def merge_edges(memories: DataFrame) -> DataFrame:
    """(from_id, to_id), distinct: an entry and each entry it was merged from."""
    return memories.select(F.col("id").alias("from_id"), F.explode("merged_from").alias("to_id")).where(
        F.col("to_id").isNotNull()).distinct()


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among ``nodes`` (id), with both ends' kinds."""
    a = nodes.select(F.col("id").alias("from_id"), F.col("kind").alias("from_kind"))
    b = nodes.select(F.col("id").alias("to_id"), F.col("kind").alias("to_kind"))
    return edges.join(a, "from_id").join(b, "to_id")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in) of every node with an edge."""
    ends = edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti")


def two_hop(edges: DataFrame) -> DataFrame:
    """(id, far): distinct nodes two edges away, without the node itself and its neighbours."""
    second = edges.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("far"))
    far = edges.join(second, "to_id").where(F.col("from_id") != F.col("far")).select(F.col("from_id").alias("id"), "far").distinct()
    return far.join(edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("far")), ["id", "far"], "left_anti")


def chain_ends(edges: DataFrame, most_hops: int = 10) -> DataFrame:
    """(id, last, hops): follows the smallest successor of each node for at most ``most_hops`` steps.

    A chain that returns to its start stops before it closes. One join per hop
    over the nodes still moving.
    """
    step = cut(edges.groupBy(F.col("from_id").alias("at")).agg(F.min("to_id").alias("next")))
    state = step.select(F.col("at").alias("id"), F.col("next").alias("last"), F.lit(1).alias("hops"))
    done = None
    for _ in range(most_hops - 1):
        moved = state.join(step.withColumnRenamed("at", "last"), "last", "left")
        going = F.col("next").isNotNull() & (F.col("next") != F.col("id"))
        moved = cut(moved.select("id", "last", "hops", F.when(going, F.col("next")).alias("next")))
        stopped = moved.where(F.col("next").isNull()).select("id", "last", "hops")
        done = stopped if done is None else done.unionByName(stopped)
        state = moved.where(F.col("next").isNotNull()).select("id", F.col("next").alias("last"), (F.col("hops") + 1).alias("hops"))
        if not state.limit(1).count():
            return done
    return done.unionByName(state)
