"""Connected components on an edge DataFrame (used by D4 dedup groups and D7
story clustering).

Min-label propagation with pointer jumping: each round every vertex takes the
smallest label among itself and its neighbours, then jumps to its label's label.
Labels are always vertex ids of the same component and only decrease, so the
loop ends when no label changes; the component id is its smallest vertex id.

Each round is a join + algebraic min-aggregate (partial aggregation absorbs hub
vertices) and is checkpointed to the shared checkpoint dir, so lineage stays one
round deep and a lost executor only recomputes from the last checkpoint.
The driver only sees one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import cut_lineage


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, src: str = "src",
                         dst: str = "dst") -> DataFrame:
    """Return (vertex, component) for every vertex in ``vertices`` (or in the edges).

    Isolated vertices form their own component.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    sym = cut_lineage(sym)
    if vertices is None:
        vertices = sym.select(F.col("a").alias("vertex"))
    labels = cut_lineage(vertices.select(F.col(vertices.columns[0]).alias("vertex")).distinct()
                         .withColumn("label", F.col("vertex")))
    while True:
        cand = sym.join(labels, sym.a == labels.vertex).select(F.col("b").alias("vertex"), "label")
        step = labels.unionByName(cand).groupBy("vertex").agg(F.min("label").alias("label"))
        parent = step.select(F.col("vertex").alias("p_vertex"), F.col("label").alias("p_label"))
        jumped = (step.join(parent, step.label == parent.p_vertex, "left")
                  .select("vertex", F.least("label", F.coalesce("p_label", "label")).alias("label")))
        jumped = cut_lineage(jumped)
        changed = (jumped.alias("n").join(labels.alias("o"), "vertex")
                   .where(F.col("n.label") != F.col("o.label")).limit(1).count())
        labels = jumped
        if changed == 0:
            return labels.select("vertex", F.col("label").alias("component"))
