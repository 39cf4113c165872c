"""Connected components by repeated contraction, as DataFrame joins and aggregations.

Each round points every node at the smallest node among itself and its neighbours, follows those
pointers to their ends, and replaces the edges by the edges between the nodes reached.  Only local minima
survive a round, so edges and nodes shrink geometrically; the rounds' small pointer tables are joined
back in reverse order.  No link or label leaves the cluster; the driver sees only "any edges left?".
A hot node is never gathered: its neighbours meet in partial ``min`` aggregates and in joins that
adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one ordered type -> ``(node, component)``, component the smallest node reachable.

    Nodes without an edge to another node do not appear; null ends and self loops are ignored.
    An empty input gives an empty result.
    """
    links = checkpointed(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = checkpointed(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
            .select("node", F.least("node", "m").alias("to"))
        )
        # pointers only go down, so doubling ends at local minima after log(longest way) steps
        moving = True
        while moving:
            ahead = pointers.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = checkpointed(pointers.join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")))
            pointers, moving = step.select("node", "to"), not step.where("moved").isEmpty()
        jumped = pointers
        rounds.append(jumped)
        at_a = jumped.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        at_b = jumped.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        links = checkpointed(
            links.join(at_a, "a").join(at_b, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[-1]
    for step in reversed(rounds[:-1]):
        after = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = checkpointed(step.join(after, "to", "left").select("node", F.coalesce("last", "to").alias("to")))
    return found.select("node", F.col("to").alias("component"))
