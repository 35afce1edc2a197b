"""Walking dependency edges, and what changed between two states."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete, materialize


#: Steps of a walk between two writes.
LEAP = 4
#: Levels that are walked before what is left of the graph is contracted.
SHALLOW = 8
#: Contraction goes on while a round takes away at least this share of the edges.
WORTH = 0.25


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """node, depth: what ``seeds`` (column node) lead to along ``edges`` (src, dst), and themselves. Null is no node.

    The first ``SHALLOW`` levels are a breadth-first walk, in which most graphs end. What lies deeper is contracted (:func:`deep`), so
    a chain or a tree of any depth takes a number of rounds that grows with the logarithm of its size. Every leap is a table
    in the shared folder, so none is computed twice, the plan does not grow with depth, and its real size lets a small
    frontier be broadcast.
    """
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    step = edges.dropna(subset=["src", "dst"]).select(F.col(a).alias("node"), F.col(b).alias("next"), F.lit(1).cast("long").alias("w"))
    start = materialize(seeds.select("node").dropna().distinct().withColumn("depth", F.lit(0).cast("long")), "reach")
    levels = SHALLOW if max_depth is None else min(SHALLOW, max_depth)
    seen, frontier = walk(step, start, levels)
    if frontier is not None and (max_depth is None or max_depth > levels):
        # nodes above the frontier lead to nothing that is new
        rest = step.join(seen.select(F.col("node").alias("next")), "next", "left_anti").where("node <> next")
        inner = seen.join(frontier, "node", "left_anti").select("node")
        rest = materialize(rest.join(inner, "node", "left_anti").select("node", "next", "w").distinct(), "reach-rest")
        found = deep(rest, frontier)
        delete(rest.sparkSession, rest.kept_at)
        if max_depth is not None:
            found = found.where(F.col("depth") <= max_depth)
        seen = seen.unionByName(found.join(frontier, "node", "left_anti"))
    return seen.select("node", F.col("depth").cast("int").alias("depth"))


def walk(step: DataFrame, start: DataFrame, levels: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(node and least depth of all that ``start`` (node, depth) leads to along ``step`` (node, next, w) in at most so many steps,
    those found in the last step or None if there are none).

    Leaps of ``LEAP`` steps: within one, each step joins the one before to the edges, in one plan whose exchanges are shared
    between the steps; nodes that were seen before may come up again there and are dropped at its end, unless their depth
    is less than before.
    """
    seen = frontier = start
    done = 0
    while levels is None or done < levels:
        steps = LEAP if levels is None else min(LEAP, levels - done)
        front, waves = frontier.select("node", "depth"), []
        for k in range(steps):
            ahead = F.min(F.col("depth") + F.col("w")).alias("depth")
            front = front.join(step, "node").groupBy(F.col("next").alias("node")).agg(ahead)
            waves.append(front.withColumn("k", F.lit(k)))
        # of equal depths the earlier step counts, as it was followed up within the leap
        best = F.min(F.struct("depth", "k")).alias("best")
        found = materialize(reduce(DataFrame.unionByName, waves).groupBy("node").agg(best).select("node", "best.*"), "reach-found")
        before = seen.join(found.select("node"), "node", "left_semi").groupBy("node").agg(F.min("depth").alias("before"))
        newest = found.join(before, "node", "left").where("before IS NULL OR depth < before").drop("before")
        newest = materialize(newest, "reach")
        delete(found.sparkSession, found.kept_at)
        done += steps
        seen, frontier = seen.unionByName(newest.drop("k")), newest.where(F.col("k") == steps - 1).drop("k")
        if frontier.isEmpty():
            frontier = None
            break
    return seen.groupBy("node").agg(F.min("depth").alias("depth")), frontier


def deep(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, depth: what ``start`` (node, depth; no edge leads there) reaches along ``edges`` (node, next, w), with least depths.

    The graph shrinks in rounds: nodes that lead nowhere go, then each run of nodes with one edge in and one out becomes one
    edge (:func:`chains`). What no longer shrinks is walked, and the rounds are undone in reverse: a node of a run stands so
    far behind the run's head, one that leads nowhere behind the nearest that leads to it.
    """
    rounds, left = [], edges.count()
    while left:
        sources = edges.select(F.col("node").alias("next")).distinct()
        core = materialize(edges.join(sources, "next", "left_semi").select("node", "next", "w"), "reach-core")
        leaves = edges.join(sources, "next", "left_anti").select("node", "next", "w")
        into = core.groupBy("next").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("up"), F.min("w").alias("w")).where("n = 1")
        out = core.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("down"), F.min("w").alias("far")).where("n = 1")
        inner = into.select(F.col("next").alias("node"), "up", "w").join(out.select("node", "down", "far"), "node")
        runs = chains(materialize(inner, "reach-inner"))
        members = runs.select("node")
        kept = core.join(members, "node", "left_anti").join(members.select(F.col("node").alias("next")), "next", "left_anti")
        last = runs.join(members.select(F.col("node").alias("down")), "down", "left_anti")
        short = last.where("NOT endless").select(F.col("up").alias("node"), F.col("down").alias("next"), (F.col("w") + F.col("far")).alias("w"))
        edges = kept.select("node", "next", "w").unionByName(short).groupBy("node", "next").agg(F.min("w").alias("w"))
        edges = materialize(edges, "reach-edges")
        rounds.append((leaves, runs.where("NOT endless")))
        before, left = left, edges.count()
        if left > (1 - WORTH) * before:
            break
    found = walk(edges, start)[0] if left else start
    for leaves, runs in reversed(rounds):
        held = found.select(F.col("node").alias("up"), "depth")
        inside = runs.join(held, "up").select("node", (F.col("depth") + F.col("w")).alias("depth"))
        found = materialize(found.unionByName(inside), "reach-runs")
        ends = leaves.join(found, "node").groupBy(F.col("next").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        found = materialize(found.unionByName(ends), "reach")
    return found


def chains(inner: DataFrame) -> DataFrame:
    """``inner`` (node, up, w, down, far) with ``up`` the last node above that is no inner one itself, ``w`` the way from there, and
    endless: whether there is none, as the run is a cycle. Pointers double, so there are as many rounds as the longest run has bits."""
    rounds = inner.count().bit_length() + 1  # in the last one only cycles move
    held = inner.withColumn("endless", F.lit(False))
    for _ in range(rounds):
        above = held.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("w").alias("more"))
        both = held.join(above, "up", "left").withColumn("moved", F.col("top").isNotNull())
        up, far = F.coalesce("top", "up").alias("up"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")
        held = materialize(both.select("node", up, far, "down", "far", F.col("moved").alias("endless")), "reach-runs")
        if held.where("endless").isEmpty():
            break
    return held


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the seeds, their direct parents and their direct children."""
    up = edges.join(seeds.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"))
    down = edges.join(seeds.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"))
    return seeds.select("node").union(up).union(down).distinct()


def change_set(previous: DataFrame, current: DataFrame, key: str, body: str, checksum: str) -> DataFrame:
    """key, is_new, is_modified for each row of ``current``.

    A row is new if its key was not there. It is modified if it is new, if its body differs, if a body
    is missing and the checksums differ, or if neither can be compared.
    """
    old = previous.select(F.col(key).alias("__k"), F.col(body).alias("__b"), F.col(checksum).alias("__c"), F.lit(True).alias("__was"))
    both = current.join(old, F.col(key) == F.col("__k"), "left")
    new = F.col("__was").isNull()
    differs = F.when(F.col(body).isNotNull() & F.col("__b").isNotNull(), F.col(body) != F.col("__b")).otherwise(
        F.coalesce(F.col(checksum) != F.col("__c"), F.lit(True))
    )
    return both.select(F.col(key), new.alias("is_new"), (new | differs).alias("is_modified"))
