"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import BROADCAST_BYTES, Scratch

ROW = 32  # bytes of a label's row, for the sizes of broadcasts


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges`` (a, b) longs -> (id, component): the smallest id reachable from each id that has an edge.

    Every round takes the smallest label among a node's neighbours (partial aggregation before the shuffle, so a
    star's centre is no hot spot), from the second on also jumps along labels, and writes the labels to the shared folder.
    Labels that are few go to every task, so that a round deals out rows by key just once: each such deal is one task a
    partition, and all of them pass through the driver.  Stops when no label changes; ``max_rounds`` is only a guard and
    raises, it never returns half-merged labels.  Loops, repeated
    edges and an empty table are fine; rows with a null end are ignored.
    """
    keep = Scratch(edges.sparkSession, "components")
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = keep.write(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = keep.write(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    few = labels.count() * ROW <= BROADCAST_BYTES  # every round has as many
    for turn in range(max_rounds):
        known = F.broadcast(labels) if few else labels
        near = both.join(known.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        # every id has an edge, so each is in ``near``
        step = near.join(known, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        if turn:  # stars are done after the first round; longer chains are shortened by jumps
            jump = known.select(F.col("id").alias("c"), F.col("component").alias("far"))
            step = step.withColumnRenamed("component", "c").join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("far", "c")).alias("component"))
        new = keep.write(step, f"labels{turn}")
        if new.where("component <> old").limit(1).count() == 0:
            keep.keep_only(f"labels{turn}")
            return new.select("id", "component")
        keep.keep_only("edges", f"labels{turn}")
        labels = new.select("id", "component")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
