"""Problem 4: one group id for everything that pairwise matches join, directly or over others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import materialize


def connected_groups(links: DataFrame, a: str = "a", b: str = "b", *, jumps: int = 2) -> DataFrame:
    """``(node, group_id)`` for every end of a link; group_id is the smallest id of the component.

    Minimum labels travel over the links and are accelerated by pointer jumping. Each round
    (1) points every node of the current graph at its smallest neighbour or itself, which is a forest,
    (2) jumps those pointers ``jumps`` times, (3) replaces the ends of all links by their labels and
    drops what has become a loop or a repeat, and (4) carries the labels over to the original nodes.
    A node without a smaller neighbour stays in a round, yet a neighbour either joins it or leaves it with a smaller
    one for the next: two rounds at least halve the nodes that still have links, so their number is logarithmic.
    Rounds are written to the shared folder; nothing is collected. Labels are unique per key, so a hub
    with a third of all links only meets one label row: its minimum is combined before the shuffle and
    the relabelling join is left to the skew handling of adaptive execution.

    Null ends and loops are dropped; repeats and both directions count once; an empty input gives an
    empty result. Columns other than ``a`` and ``b`` are ignored.
    """
    e = (
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    edges = materialize(e, "p4-edges")
    labels = None
    while True:
        g = edges.df
        # smallest neighbour: v may point at u < v; u keeps itself unless it is the larger end elsewhere
        pointer = (
            g.select(F.col("v").alias("node"), F.col("u").alias("to"))
            .unionByName(g.select(F.col("u").alias("node"), F.col("u").alias("to")))
            .groupBy("node")
            .agg(F.min("to").alias("to"))
        )
        point = materialize(pointer, "p4-point")
        for _ in range(jumps):
            up = point.df.select(F.col("node").alias("to"), F.col("to").alias("up")).where(F.col("to") != F.col("up"))
            nxt = materialize(
                point.df.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to")), "p4-point"
            )
            point.drop()
            point = nxt
        moved = point.df.where(F.col("node") != F.col("to"))
        if labels is None:
            labels = point
        else:
            nl = materialize(
                labels.df.withColumnRenamed("to", "mid")
                .join(moved.select(F.col("node").alias("mid"), F.col("to").alias("new")), "mid", "left")
                .select("node", F.coalesce("new", "mid").alias("to")),
                "p4-labels",
            )
            labels.drop()
            labels = nl
        ne = (
            g.join(moved.select(F.col("node").alias("u"), F.col("to").alias("lu")), "u", "left")
            .join(moved.select(F.col("node").alias("v"), F.col("to").alias("lv")), "v", "left")
            .select(F.coalesce("lu", "u").alias("x"), F.coalesce("lv", "v").alias("y"))
            .where(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
            .distinct()
        )
        nxt = materialize(ne, "p4-edges")
        edges.drop()
        edges = nxt
        if point is not labels:
            point.drop()
        if edges.df.isEmpty():
            edges.drop()
            return labels.df.select("node", F.col("to").alias("group_id"))


def accepted_links(candidates: DataFrame, reports: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of trimmed lower-case ids from rows that count.

    A row counts if its report is known, its score is a number (not null, not NaN) not below the
    report's merge threshold, and both ids are present and differ. A report without a threshold
    accepts nothing. A report listed twice counts with its lowest threshold.
    """
    clean = lambda c: F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))
    r = (
        reports.where(F.col("report_id").isNotNull() & F.col("merge_threshold").isNotNull() & ~F.isnan("merge_threshold"))
        .groupBy("report_id")
        .agg(F.min("merge_threshold").alias("_least"))
    )
    c = candidates.select("report_id", clean("medoid_a").alias("a"), clean("medoid_b").alias("b"), "score")
    return (
        c.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b")))
        .join(r, "report_id")
        .where(F.col("score") >= F.col("_least"))
        .select("a", "b")
    )


def match_groups(candidates: DataFrame, reports: DataFrame) -> DataFrame:
    """``(node_id, group_id)`` over the accepted links of ``candidates``."""
    return connected_groups(accepted_links(candidates, reports)).select(F.col("node").alias("node_id"), "group_id")
