"""Walks over edge tables: a bounded walk of callers or callees, and the closure of a hierarchy."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.tables import materialize


def walk(edges: DataFrame, seeds: DataFrame, depth: int, source: str = "src", target: str = "dst", probe: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Edges met in up to `depth` hops from the seeds (a column named like source), each once, with the first hop that meets it.

    A hop is one join and two anti-joins; no frontier is cut, so nothing is lost on the way. For callers, swap source and target. probe:
    how edges of a frontier's nodes are found (edges, frontier, column), if not by a join; each hop is then written before the next.
    """
    frontier = seeds.select(F.col(source)).distinct()
    seen_nodes, out = frontier, None
    for hop in range(1, depth + 1):
        own = edges.select(source, target)
        met = (own.join(frontier, source, "left_semi") if probe is None else probe(own, frontier, source)).distinct()
        if out is not None:
            met = met.join(out.select(source, target), [source, target], "left_anti")
        met = met.withColumn("hop", F.lit(hop))
        met = met if probe is None else materialize(met, "walk")
        out = met if out is None else out.unionByName(met)
        frontier = met.select(F.col(target).alias(source)).distinct().join(seen_nodes, source, "left_anti")
        seen_nodes = seen_nodes.unionByName(frontier)
    return out


def walk_rows(edges: DataFrame, seeds: DataFrame, depth: int, source: str, target: str, probe: Callable[[DataFrame, DataFrame, str], DataFrame]) -> DataFrame:
    """As walk(), but all rows of edges with all their columns. A row is met in the hop whose frontier has its source, and no node is in two
    frontiers, so the rows of a hop are those of its probe: they need no comparison with earlier hops and are read once."""
    edges = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    frontier = seen = materialize(seeds.select(source).distinct(), "walk-frontier")
    out = None
    for hop in range(1, depth + 1):
        met = probe(edges, frontier, source).withColumn("hop", F.lit(hop))
        met = materialize(met, "walk") if hop < depth else met
        out = met if out is None else out.unionByName(met)
        if hop < depth:
            frontier = materialize(met.select(F.col(target).alias(source)).distinct().join(seen, source, "left_anti"), "walk-frontier")
            seen = seen.unionByName(frontier)
    return out


#: Rows of a frontier up to which a round of a closure sends it to all executors; a larger one is joined by a shuffle.
FRONTIER_ROWS = 10_000


def closure(edges: DataFrame, roots: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Everything below the roots, with its least depth. Ends on cycles: what has been met is not followed again. Each round's
    frontier is written to the shared folder, so plans stay short however deep the hierarchy is. So are the edges, as every round reads
    them. Only small frontiers go through the driver, so what it sees doesn't grow with the hierarchy."""
    keep = lambda df: materialize(df, "closure")
    edges = keep(edges.select(child, parent))
    frontier = keep(roots.select(F.col(parent).alias("node")).distinct().withColumn("depth", F.lit(0)))
    out = frontier
    for level in count(1):
        few = frontier.count()
        if not few:
            break
        near = frontier.select(F.col("node").alias(parent))
        below = edges.join(F.broadcast(near) if few <= FRONTIER_ROWS else near.hint("merge"), parent).select(F.col(child).alias("node")).distinct()
        frontier = keep(below.join(out.select("node").hint("merge"), "node", "left_anti").withColumn("depth", F.lit(level)))
        # The union of all rounds is read again in each: folded into one table from time to time, its plan stays short.
        out = out.unionByName(frontier) if level % 16 else keep(out.unionByName(frontier))
    return out.where("depth > 0")


def closure_in_one_plan(edges: DataFrame, roots: DataFrame, levels: int = 64, child: str = "child", parent: str = "parent") -> DataFrame:
    """As closure(), for hierarchies of at most `levels` levels: one recursive query, no round is written. A deeper hierarchy, or one of
    more rows than the session lets a recursion have, is closure()'s."""
    spark = edges.sparkSession
    return spark.sql(
        f"""WITH RECURSIVE below(node, depth) MAX RECURSION LEVEL {levels + 2} AS (
            SELECT DISTINCT node, 0 FROM {{roots}}
            UNION ALL
            SELECT e.child, depth + 1 FROM {{edges}} e JOIN below ON e.parent = below.node WHERE depth < {levels}
        ) SELECT node, min(depth) AS depth FROM below GROUP BY node HAVING min(depth) > 0""",
        roots=roots.select(F.col(parent).alias("node")),
        edges=edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")),
    )
