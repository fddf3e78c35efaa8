"""Connected components of a graph of ids, by contraction with pointer jumping.

Every round hooks each node to its smallest neighbour, shortens those pointers twice and
replaces the edges by the edges between what their ends point to. A path of n nodes is
done in about log4(n) rounds. All state is in tables of the shared folder; the driver only
sees the number of edges that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``id, component``: the smallest id reachable, for every id that an edge names.

    Self-loops and repeated edges do no harm; without edges the result is empty.
    """
    edges = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u < v").distinct()
    edges = materialize(edges, "edges")
    at = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("to"))
        for _ in range(2):
            # a root points to itself, so the inner join loses no node
            hook = hook.alias("a").join(hook.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to")
        hook = materialize(hook, "hooks")
        if at is None:
            at = hook.select("id", F.col("to").alias("component"))
        else:
            at = at.join(hook, at["component"] == hook["id"], "left").select(at["id"], F.coalesce("to", "component").alias("component"))
        at = materialize(at, "components")
        a, b = hook.select(F.col("id").alias("u"), F.col("to").alias("tu")), hook.select(F.col("id").alias("v"), F.col("to").alias("tv"))
        edges = edges.join(a, "u").join(b, "v").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).where("u < v").distinct()
        edges = materialize(edges, "edges")
        if edges.isEmpty():
            return at
