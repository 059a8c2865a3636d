"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.session import Scratch, if_small


ROWS = 100_000  # of a task


def _tasks(rows: DataFrame) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b); root is the smallest id reachable.

    Each round gives every id the smallest root among its neighbours and then follows
    the root's own root, so a path of n ids takes about log n rounds; they go on until
    nothing changes. Every round's table is written to shared storage, the one before is
    deleted, and nothing but a count of changes comes back. Labels that are few are
    broadcast, so that a round shuffles once, and written by few tasks, of ``ROWS`` rows
    or less on average.
    """
    scratch = Scratch(edges.sparkSession)
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).where("id <> other")
    many = 2 * _tasks(both)
    both = scratch.keep(both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct().coalesce(many), "edges")
    table = scratch.keep(both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("next")).coalesce(many), "labels")
    many = _tasks(table)
    hint = F.broadcast if if_small(table)[1] else lambda t: t.hint("merge")  # as many rows in each round
    while True:
        labels = hint(table.select("id", F.col("next").alias("root")))
        near = both.join(hint(labels.select(F.col("id").alias("other"), "root")), "other").groupBy("id").agg(F.min("root").alias("near"))
        closer = near.join(labels, "id").select("id", "root", F.least("root", "near").alias("new"))
        jump = hint(labels.select(F.col("id").alias("new"), F.col("root").alias("above")))
        after = closer.join(jump, "new", "left").select("id", F.least("new", F.coalesce("above", "new")).alias("next"), "root")
        after = scratch.keep(after.select("id", "next", (F.col("next") != F.col("root")).alias("moved")).coalesce(many), "labels")
        scratch.drop(table)
        table = after
        if table.where("moved").limit(1).count() == 0:
            scratch.close(table)
            return table.select("id", F.col("next").alias("root"))
