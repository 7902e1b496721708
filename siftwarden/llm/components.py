"""Connected components of a graph that lies in tables: hooking to smaller labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once as (x, y), x > y; loops go."""
    return edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(x, y) for each node x of edges (x, y) that isn't its component's smallest node y.

    Every node hooks to its smallest smaller neighbour, pointers are jumped until all reach a root,
    and edges are moved to the roots, until none joins two of them.  A node with very many edges
    is aggregated in parts first; nothing collects neighbours.
    """
    edges, whole = written(_ordered(edges), "edges"), None
    while not edges.isEmpty():
        hook = written(edges.groupBy("x").agg(F.min("y").alias("y")), "hook")
        while True:
            up = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
            jumped = written(hook.join(up, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")), "jump")
            hook = jumped.select("x", "y")
            if jumped.where("moved").isEmpty():
                break
        moves = hook.withColumnsRenamed({"x": "old", "y": "new"})
        if whole is None:
            whole = hook
        else:
            whole = whole.join(moves, F.col("y") == F.col("old"), "left").select("x", F.coalesce("new", "y").alias("y")).unionByName(hook)
        edges = edges.join(moves, F.col("x") == F.col("old"), "left").select(F.coalesce("new", "x").alias("x"), "y")
        edges = edges.join(moves, F.col("y") == F.col("old"), "left").select("x", F.coalesce("new", "y").alias("y"))
        edges = written(_ordered(edges), "edges")
    return edges.select("x", "y") if whole is None else whole


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after documents a and b of links (a, b) are put together."""
    of = lambda name: labels.select(F.col("id").alias(name), F.col("comp").alias(f"comp_{name}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("x"), F.col("comp_b").alias("y"))
    moves = roots(edges)
    return written(labels.join(moves, F.col("comp") == F.col("x"), "left").select("id", F.coalesce("y", "comp").alias("comp")), "labels")
