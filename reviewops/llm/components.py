"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewops.llm import store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (vertex, component): for every vertex of an edge the smallest vertex that it reaches.

    Edges may point either way, occur again or begin where they end; those with a null end
    are left out. In every round each vertex points to its smallest neighbour, if smaller;
    pointers are followed to their ends, and each of the trees they form becomes one vertex.
    At least every second vertex goes in a round, so rounds and work are bounded by the
    logarithm of the vertices and by twice the first round. A vertex of very many edges is a
    hot key: neighbours are combined in the map tasks, and the joins are between tables that
    Spark may split or broadcast by their size.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    rest = store.kept(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(low.alias("a"), high.alias("b")).distinct(), "edges")
    rounds = []
    while not rest.isEmpty():
        ends = rest.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(rest.select(F.col("b").alias("v"), F.col("a").alias("w")))
        pointers = store.kept(ends.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("to")), "pointers")
        while True:
            further = pointers.select(F.col("v").alias("to"), F.col("to").alias("end"))
            pointers = store.kept(pointers.join(further, "to").select("v", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "pointers")
            if pointers.where("moved").isEmpty():
                break
            pointers = pointers.select("v", "to")
        pointers = pointers.select("v", "to")
        rounds.append(pointers)
        left, right = pointers.select(F.col("v").alias("a"), F.col("to").alias("x")), pointers.select(F.col("v").alias("b"), F.col("to").alias("y"))
        rest = store.kept(rest.join(left, "a").join(right, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return rest.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    found = rounds[-1].select("v", F.col("to").alias("component"))
    for pointers in reversed(rounds[:-1]):
        later = found.select(F.col("v").alias("to"), "component")
        found = store.kept(pointers.join(later, "to", "left").select("v", F.coalesce("component", "to").alias("component")), "components")
    return found.withColumnRenamed("v", "vertex")
