"""Task graphs as node and edge tables: degrees, cycles, levels, failure closure, path counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_root


class CycleError(ValueError):
    """Nodes of a cycle, or behind one, are left."""


class DepthError(ValueError):
    """A graph is deeper than the caller allows."""


def graph_errors(nodes: DataFrame, edges: DataFrame, targets: list[str]) -> DataFrame:
    """``(node, error)`` of a graph that can't be compiled: a node (node, target) whose executor isn't registered, an edge's end that is no node."""
    unbound = nodes.where(~F.coalesce(F.col("target").isin(*targets), F.lit(False))).select("node", F.lit("UnboundTarget").alias("error"))
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return unbound.unionByName(ends.join(nodes.select("node"), "node", "left_anti").select("node", F.lit("InvalidNodeId").alias("error")))


def trace(levelled: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """``(node, kind, step)``: what a run tells of its nodes, in steps of the graph's levels.

    A node that runs is ready, enqueued, started and finished; a cancelled one just that. Each edge whose source
    completes releases its target once.
    """
    met = levelled.join(states, "node")
    ran = F.array(*(F.struct(F.lit(k).alias("kind"), (F.col("level") * 5 + i).alias("step")) for i, k in enumerate(("ready", "enqueued", "started"))))
    end = F.array(F.struct(F.when(F.col("state") == "completed", "finished").otherwise("cancelled").alias("kind"), (F.col("level") * 5 + 3).alias("step")))
    own = met.select("node", F.inline(F.when(F.col("state") == "cancelled", end).otherwise(F.concat(ran, end))))
    done = met.where("state = 'completed'").select(F.col("node").alias("src"), (F.col("level") * 5 + 4).alias("step"))
    freed = distinct_edges(edges.select("src", "dst")).join(done, "src").select(F.col("dst").alias("node"), F.lit("dependency_released").alias("kind"), "step")
    return own.unionByName(freed)


def distinct_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge per pair of ends: of several the first by ``order``."""
    if order is None:
        return edges.dropDuplicates(["src", "dst"])
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_e")).select("src", "dst", "_e.*")


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, n_in, n_out)`` of all nodes that have an edge."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def levels(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """``(node, level)``: the longest way from a start. Ready nodes are peeled off in rounds; a cycle raises CycleError.

    Each round is written, so a plan stays as long as one round; rounds are as many as the graph is deep.
    """
    shared_root(nodes.sparkSession)
    keep = lambda df: df.checkpoint()
    left, open_, done, level = nodes.select("node"), distinct_edges(edges.select("src", "dst")), None, 0
    while level < most:
        ready = keep(left.join(open_, left.node == open_.dst, "left_anti").withColumn("level", F.lit(level)))
        if not ready.take(1):
            break
        done = ready if done is None else done.unionByName(ready)
        left = keep(left.join(ready, "node", "left_anti"))
        open_ = keep(open_.join(ready, open_.src == ready.node, "left_anti"))
        level += 1
    if left.take(1):
        raise CycleError("CycleDetected") if level < most else DepthError(f"deeper than {most} levels")
    return done if done is not None else nodes.select("node").withColumn("level", F.lit(0)).limit(0)


def reachable(starts: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """Nodes that can be reached from ``starts`` (column node), themselves left out unless on a cycle."""
    shared_root(starts.sparkSession)
    seen, front = starts.select("node").limit(0).checkpoint(), starts.select("node").distinct().checkpoint()
    for _ in range(most):
        front = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").checkpoint()
        if not front.take(1):
            return seen
        seen = seen.unionByName(front).checkpoint()
    raise DepthError(f"deeper than {most} levels")


def outcomes(nodes: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """``(node, state)`` after the given nodes failed: whatever waits for them, directly or not, is cancelled, the rest completes."""
    hit = reachable(failed, edges).withColumn("_c", F.lit(True))
    bad = failed.select("node").distinct().withColumn("_f", F.lit(True))
    state = F.when(F.col("_f"), "failed").when(F.col("_c"), "cancelled").otherwise("completed")
    return nodes.select("node").join(bad, "node", "left").join(hit, "node", "left").select("node", state.alias("state"))


def unlocks(levelled: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, unlock)``: how many ways lead down from a node, each end counted once per way; deepest levels first."""
    shared_root(edges.sparkSession)
    pairs = distinct_edges(edges.select("src", "dst"))
    deepest = levelled.agg(F.max("level")).first()[0]
    score = None
    for level in range(deepest or 0, -1, -1):
        here = levelled.where(F.col("level") == level).select("node")
        if score is None:
            score = here.withColumn("unlock", F.lit(0).cast("long")).checkpoint()
            continue
        below = pairs.join(score.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("unlock") + 1).alias("unlock"))
        score = score.unionByName(here.join(below, "node", "left").select("node", F.coalesce("unlock", F.lit(0)).alias("unlock"))).checkpoint()
    return score
