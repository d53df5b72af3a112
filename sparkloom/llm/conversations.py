"""Problem 2: rebuilding ordered conversations from message rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.llm.blocks import parts_for
from sparkloom.runtime import materialize

# Record types that carry a role, compared trimmed and in lower case.
USER_TYPES = ("user", "human", "user_message")
ASSISTANT_TYPES = ("assistant", "agent_message")

RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
#: About how many rows of sorted lanes one task holds; a longer lane is cut into several.
SLICE_ROWS = 100_000


def instant_us(c: Column) -> Column:
    """Microseconds since the epoch of an RFC3339 text, null where it cannot be read."""
    t = F.trim(c)
    return F.when(t.rlike(RFC3339), F.unix_micros(F.upper(t).try_cast("timestamp")))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def lane_rows(rows: DataFrame) -> DataFrame:
    """The columns that matter, with ``role`` (null where the row is no message) and ``us``; rows of no session are left out."""
    kind = F.lower(F.trim(F.col("record_type")))
    role = F.when(kind.isin(*USER_TYPES), F.lit("user")).when(kind.isin(*ASSISTANT_TYPES), F.lit("assistant"))
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    message = blank(F.col("tool_name")) & off("is_meta") & off("is_api_error") & (F.coalesce(F.trim(F.col("model")), F.lit("")) != "<synthetic>")
    return rows.where(~blank(F.col("session_id"))).select(
        F.col("session_id"),
        F.coalesce(F.trim(F.col("agent_id")), F.lit("")).alias("agent_id"),
        F.coalesce(F.trim(F.col("uuid")), F.lit("")).alias("uuid"),
        F.coalesce(F.trim(F.col("parent_uuid")), F.lit("")).alias("parent"),
        F.when(message, role).alias("role"),
        instant_us(F.col("record_ts")).alias("us"),
    )


def one_row_a_uuid(r: DataFrame) -> DataFrame:
    """Of the rows that repeat a uuid in a lane one: a message before others, then the latest readable instant, then the greatest role and parent."""
    lane = ["session_id", "agent_id"]
    # rows without a uuid are told apart by their parents, which have to be found all the same
    return (
        r.groupBy(*lane, "uuid", F.when(F.col("uuid") == "", F.col("parent")).alias("_p"))
        .agg(F.max(F.struct(F.col("role").isNotNull().alias("message"), "us", "role", "parent")).alias("x"))
        .select(*lane, "uuid", "x.parent", "x.role", "x.us")
    )


def _local_paths(d: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """``at``, ``depth`` and ``state`` of the rows of one task: every pointer is followed to where it ends or leaves the task, by pointer jumping."""
    n = len(d)
    lane = (d[keys] != d[keys].shift()).any(axis=1).cumsum().to_numpy()
    named = pd.DataFrame({"g": lane, "k": d["uuid"].to_numpy(), "p": np.arange(n)})
    named = named[named["k"] != ""]
    up = pd.DataFrame({"g": lane, "k": d["parent"].to_numpy()}).merge(named, on=["g", "k"], how="left")["p"].to_numpy()
    here = ~np.isnan(up)
    p = np.where(here, np.nan_to_num(up), np.arange(n)).astype(np.int64)
    depth = here.astype(np.int64)
    for _ in range(n.bit_length() + 1):
        if not here[p].any():
            break
        depth = depth + np.where(p == np.arange(n), 0, depth[p])
        p = p[p]
    parent = d["parent"].to_numpy()
    state = np.where(here[p], "cycle", np.where(parent[p] == "", "root", "open"))
    return d.assign(at=d["uuid"].to_numpy()[p], depth=depth, state=state)


def resolve_parents(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("uuid",)) -> DataFrame:
    """Adds ``root``, ``depth`` and ``state`` to rows ``(*keys, uuid, parent, ...)``, one to a uuid, by pointer jumping.

    ``keys`` name the group inside which parents are looked up. A parent that is blank or no row of the group
    ends a path: the row has depth 0 and every row below it counts from there; where that parent is not blank the
    ``state`` of all these is ``orphan``, else ``root``. Rows on a cycle or below one have the state ``cycle`` and
    no depth. Groups are laid side by side in the given order and cut into tasks of equal numbers of rows, so that
    a group of any size is shared; pointers are jumped within the tasks first, and then, by joins that double the
    distance each round, among the few rows whose pointers leave their task.
    """
    spark, columns = rows.sparkSession, rows.columns
    base = materialize(rows, "p2-rows")
    parts = parts_for(spark, base.df.count(), SLICE_ROWS)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", at string, depth long, state string"

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            d = _local_paths(pd.concat(held, ignore_index=True), keys)
            for i in range(0, len(d), 20_000):
                yield d.iloc[i : i + 20_000]

    laid = base.df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys)
    own = materialize(laid.mapInPandas(local, kinds), "p2-local")
    base.drop()
    # rows that end a path inside their task and name a parent: elsewhere in the group, or nowhere
    ends = own.df.where("state = 'open' and at = uuid and depth = 0").select(*keys, F.col("uuid").alias("end"), "parent").distinct()
    named = own.df.where("uuid <> ''").select(*keys, F.col("uuid").alias("parent"), "at", F.col("depth").alias("d"), "state")
    first = ends.join(named, [*keys, "parent"], "left").select(
        *keys, "end", F.coalesce("at", "end").alias("at"), F.coalesce(F.when(F.col("state") != "cycle", F.col("d") + 1), F.lit(0)).alias("depth"), F.coalesce("state", F.lit("orphan")).alias("state"))
    now = materialize(first, "p2-jump")
    open_rows = now.df.where("state = 'open'").count()
    while open_rows:
        step = now.df.select(*keys, F.col("end").alias("at"), F.col("at").alias("at2"), F.col("depth").alias("d2"), F.col("state").alias("s2"))
        moved = now.df.where("state = 'open'").join(step, [*keys, "at"]).select(*keys, "end", F.col("at2").alias("at"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("s2").alias("state"))
        nxt = materialize(now.df.where("state <> 'open'").unionByName(moved), "p2-jump")
        now.drop()
        now = nxt
        left = now.df.where("state = 'open'").count()
        if left == open_rows:  # the row of a path nearest to what is settled would have settled
            break
        open_rows = left
    far = now.df.select(*keys, F.col("end").alias("at"), F.col("at").alias("root"), F.col("depth").alias("d2"), F.when(F.col("state") == "open", F.lit("cycle")).otherwise(F.col("state")).alias("s2"))
    done = own.df.where("state <> 'open'").withColumn("root", F.col("at"))
    rest = own.df.where("state = 'open'").join(far, [*keys, "at"], "left").select(*columns, "root", (F.col("depth") + F.col("d2")).alias("depth"), F.col("s2").alias("state"))
    both = done.select(*columns, "root", "depth", "state").unionByName(rest)
    cyclic = F.col("state") == "cycle"
    return both.withColumns({"root": F.when(~cyclic, F.col("root")), "depth": F.when(~cyclic, F.col("depth"))})


def conversations(rows: DataFrame) -> DataFrame:
    """``(session_id, agent_id, turn_no, uuid, role, depth, state)`` of every message of a kept lane.

    Rows with one uuid are one row (see :func:`one_row_a_uuid`). Parent pointers are resolved over whole lanes:
    ``depth`` is the length of the path from the root to the message over all rows of the lane, and ``state`` is
    ``cycle`` where the pointers run in a circle, else ``root``; a lane in which a path ends at a parent that is no
    row of the lane (orphan) is dropped. Messages stand in the order of their instants and, at one instant, along
    their path (smaller depth first, then uuid; a cycle has no depth and stands first). A lane is dropped too if it
    begins with the assistant, leaves a user message without a direct answer or holds a message whose instant
    cannot be read.

    Lanes are never one task: messages are sorted over all lanes in ranges of equal numbers of rows, and only one
    summary row per (lane, range) is ordered over the lane. Rows without a session, null flags and columns beyond
    those used are harmless; rows without a uuid are no turn; an empty table gives an empty result.
    """
    return _in_order(_resolved(rows))


def _resolved(rows: DataFrame) -> DataFrame:
    return materialize(resolve_parents(one_row_a_uuid(lane_rows(rows)), ["session_id", "agent_id"], ("us", "uuid")), "p2-paths").df


def _in_order(r: DataFrame) -> DataFrame:
    lane = ["session_id", "agent_id"]
    cut = [*lane, "slice"]
    bad = r.where((F.col("state") == "orphan") | (F.col("role").isNotNull() & F.col("us").isNull())).select(*lane).distinct()
    m = r.where(F.col("role").isNotNull() & F.col("us").isNotNull() & (F.col("uuid") != "")).select(*lane, "us", F.coalesce("depth", F.lit(-1)).alias("depth"), "uuid", "role", "state")
    by = ["us", "depth", "uuid"]
    parts = parts_for(r.sparkSession, m.count(), SLICE_ROWS)
    m = materialize(m.repartitionByRange(parts, *lane, *by).withColumn("slice", F.spark_partition_id()), "p2-messages").df
    w = W.partitionBy(*cut).orderBy(*by)
    ordered = m.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("role").over(w))
    unanswered = (F.col("role") == "user") & (F.col("next") == "user")
    per_slice = ordered.groupBy(*cut).agg(
        F.count(F.lit(1)).alias("size"),
        F.max(unanswered.cast("int")).alias("broken"),
        F.max(F.when(F.col("n") == 1, F.col("role") == "user").cast("int")).alias("first_user"),
        F.max(F.when(F.col("next").isNull(), F.col("role") == "user").cast("int")).alias("last_user"),
    )
    over = W.partitionBy(*lane).orderBy("slice")
    s = per_slice.join(bad.distinct(), lane, "left_anti")
    s = s.withColumns({
        "before": F.coalesce(F.sum("size").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "follower": F.lead("first_user").over(over),
        "no": F.row_number().over(over),
    })
    broken = (
        (F.coalesce(F.col("broken"), F.lit(0)) == 1)
        | ((F.col("no") == 1) & (F.col("first_user") == 0))
        | ((F.col("last_user") == 1) & (F.coalesce(F.col("follower"), F.lit(1)) == 1))
    )
    s = s.withColumn("lane_broken", F.max(broken.cast("int")).over(W.partitionBy(*lane))).where("lane_broken = 0").select(*cut, "before")
    return ordered.join(s, cut).select(*lane, (F.col("before") + F.col("n")).cast("int").alias("turn_no"), "uuid", "role", F.when(F.col("depth") >= 0, F.col("depth")).alias("depth"), "state")


def paths(rows: DataFrame) -> DataFrame:
    """``(session_id, agent_id, leaf, depth, uuid, role)``: every root-to-leaf path of the lanes :func:`conversations` keeps.

    A leaf is a message below which no message stands; its path are the messages on the way from the root, in the
    order of ``depth``, the number of rows above them. Ancestors are gathered by doubling: each round adds to
    every path the rows as far again above it as it already reaches, so a path of n rows takes log2(n) rounds and
    none is held in one task. Rows that several paths share are repeated, so the result grows with the branches;
    rows on or below a cycle are on no path.
    """
    lane = ["session_id", "agent_id"]
    r = _resolved(rows)
    kept = materialize(_in_order(r).where("state = 'root'").select(*lane, "uuid", "role", "depth"), "p2-kept").df
    every = r.where("uuid <> '' and state = 'root'").select(*lane, "uuid", "parent").join(kept.select(*lane).distinct(), lane, "left_semi")
    ends = every.join(every.select(*lane, F.col("parent").alias("uuid")).distinct(), [*lane, "uuid"], "left_anti")
    way = materialize(ends.select(*lane, F.col("uuid").alias("end"), F.lit(0).cast("long").alias("back"), "uuid"), "p2-way")
    jump = materialize(every.where("parent <> ''").select(*lane, "uuid", F.col("parent").alias("up")), "p2-jump")
    span = 1
    while not jump.df.isEmpty():
        more = way.df.join(jump.df, [*lane, "uuid"]).select(*lane, "end", (F.col("back") + span).alias("back"), F.col("up").alias("uuid"))
        nxt = materialize(way.df.unionByName(more), "p2-way")
        far = materialize(jump.df.join(jump.df.select(*lane, F.col("uuid").alias("up"), F.col("up").alias("up2")), [*lane, "up"]).select(*lane, "uuid", F.col("up2").alias("up")), "p2-jump")
        way.drop()
        jump.drop()
        way, jump, span = nxt, far, 2 * span
    on = materialize(way.df.join(kept, [*lane, "uuid"]), "p2-on").df
    last = on.groupBy(*lane, "end").agg(F.min(F.struct("back", "uuid")).alias("x")).select(*lane, "end", F.col("x.back").alias("least"), F.col("x.uuid").alias("leaf"))
    told = on.join(last, [*lane, "end"])
    inner = told.where("back > least").select(*lane, F.col("uuid").alias("leaf")).distinct()
    return told.join(inner, [*lane, "leaf"], "left_anti").select(*lane, "leaf", "depth", "uuid", "role").distinct()
