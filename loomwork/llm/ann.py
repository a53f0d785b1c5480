"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first through a priority queue.

The tree is fitted on a bounded sample; every row is put in a leaf. The number of leaves that a query visits is widened
until the sample's own queries find their true neighbours at the wanted recall. A leaf with many rows gets a tree of its own,
fitted on a sample of its rows where they lie, and so on, so that the tree grows with the table and no task holds all of it. Leaves are
searched in blocks of rows and queries, so that one that can't be split, of a third of all rows, is many small groups.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows that the tree is fitted on (those with the least hash of their id), its branching, and sample rows in a leaf at most.
SAMPLE, BRANCHES, LEAF = 20_000, 8, 160
#: Sample rows that serve as queries to calibrate visits, and the recall to reach on them.
PROBES, RECALL = 400, 0.98
#: A leaf with more rows is split, by a tree over about so many of them.
SPLIT, OWN_SAMPLE = 32_768, 4096
#: Rows and queries that one group compares.
ROWS, QUERIES = 4096, 2048


@dataclass
class Tree:
    """Centres of all nodes; ``children[i]`` is empty for a leaf, whose number is ``leaf[i]``."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    visits: int = 1

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: down the nearest centres."""
        found, todo = np.empty(len(unit), np.int32), [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                found[rows] = self.leaf[node]
                continue
            nearest = np.argmax(unit[rows] @ self.centres[self.children[node]].T, axis=1)
            todo += [(child, rows[nearest == i]) for i, child in enumerate(self.children[node])]
        return found

    def bins(self, unit: np.ndarray, most: int) -> list[int]:
        """Up to ``most`` leaves for a query, best bin first: the queue holds open branches by nearness of their centres."""
        near = self.centres @ unit
        queue, found = [(-1.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            while self.children[node]:  # down to a leaf; the branches left aside stay in the queue
                best = max(self.children[node], key=lambda c: (near[c], -c))
                for child in self.children[node]:
                    if child != best:
                        heapq.heappush(queue, (-float(near[child]), child))
                node = best
            found.append(self.leaf[node])
        return found


def _kmeans(unit: np.ndarray, k: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Group of each row in spherical k-means, started k-means++ fashion; some groups may be empty."""
    centres = unit[[random.integers(len(unit))]]
    far = 1 - unit @ centres[0]
    for _ in range(1, k):
        weight = np.maximum(far, 0)
        if weight.sum() <= 1e-12:
            break
        centres = np.vstack([centres, unit[[random.choice(len(unit), p=weight / weight.sum())]]])
        far = np.minimum(far, 1 - unit @ centres[-1])
    group = np.zeros(len(unit), int)
    for _ in range(rounds):
        group = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, group, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return np.argmax(unit @ centres.T, axis=1)


def fit(unit: np.ndarray, seed: int = 7) -> Tree:
    """A tree over sample rows of length 1, with visits calibrated on the sample."""
    random = np.random.default_rng(seed)
    centres, children, leaf, leaves = [unit.mean(axis=0)], [[]], [-1], 0
    todo = [(0, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        groups = []
        if len(rows) > LEAF:
            group = _kmeans(unit[rows], BRANCHES, random)
            groups = [rows[group == g] for g in range(BRANCHES) if (group == g).any()]
        if len(groups) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        for own in groups:
            middle = unit[own].mean(axis=0)
            centres.append(middle / max(np.linalg.norm(middle), 1e-12))
            children.append([])
            leaf.append(-1)
            children[node].append(len(centres) - 1)
            todo.append((len(centres) - 1, own))
    tree = Tree(np.array(centres), children, leaf)
    tree.visits = _calibrate(tree, unit, random)
    return tree


def _calibrate(tree: Tree, unit: np.ndarray, random: np.random.Generator, k: int = 5) -> int:
    """Leaves to visit so that the sample's probes find RECALL of their true k nearest."""
    if tree.leaves == 1 or len(unit) < 2:
        return tree.leaves
    probes = random.choice(len(unit), min(PROBES, len(unit)), replace=False)
    of, ranks = tree.assign(unit), []
    for p in probes:
        near = unit @ unit[p]
        near[p] = -np.inf
        place = {leaf: i for i, leaf in enumerate(tree.bins(unit[p], tree.leaves))}
        ranks += [place[of[n]] for n in np.argsort(-near)[: min(k, len(unit) - 1)]]
    return int(np.quantile(ranks, RECALL, method="higher")) + 1


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vector)``, in double precision, of the rows that take part: no null id, vector or component, none that is not finite, not all zero.

    Rows that repeat an id and vector count once.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return own.where("vec_id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)").distinct()


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows, each scaled by a power of two: exact, and no square of a component is too large or small for its size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True)) if len(rows) else rows


def nearest(q: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
    """The k nearest rows of each query among these rows, its own id left out; ties go to smaller ids.

    A product of matrices finds who can be among them; their scores are then taken pair by pair in one fixed order of
    addition, so that equal vectors have equal scores wherever they lie.
    """
    rough, norms = _unit(q) @ _unit(rows).T, np.sqrt((rows * rows).sum(axis=1))
    found: tuple[list[int], list[int], list[float]] = ([], [], [])
    for i, own in enumerate(q_ids):
        near = np.where(ids == own, -np.inf, rough[i])
        least = np.partition(near, -k)[-k] if len(near) > k else -2.0
        some = np.flatnonzero(near >= max(least, -2.0) - 1e-9)
        score = (rows[some] * q[i]).sum(axis=1) / (norms[some] * np.sqrt((q[i] * q[i]).sum()))
        for j in np.lexsort((ids[some], -score))[:k]:
            found[0].append(int(own))
            found[1].append(int(ids[some[j]]))
            found[2].append(float(score[j]))
    return found


def _grown(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with finer leaves: as long as some leaf has over SPLIT rows and can be split, a tree over a sample of its rows is put in its place.

    A split leaf's number is a hash of its old one and the place in its tree; a query goes on to as many of the new leaves as that
    tree's calibration asks for.
    """
    whole = None
    while True:
        size = rows.groupBy("leaf").agg(F.count("*").alias("n")).where(f"n > {SPLIT}")
        if whole is not None:
            size = size.join(whole, "leaf", "left_anti")
        size = materialize(size, "large-leaves")
        if not size.take(1):
            return rows, queries
        some = rows.join(size, "leaf").where(f"pmod(xxhash64(vec_id), greatest(1, n div {OWN_SAMPLE})) = 0").select("leaf", "vector")

        def plant(table: pa.Table) -> pa.Table:
            tree = fit(_unit(_matrix(table.column("vector").slice(0, 4 * OWN_SAMPLE))))
            return pa.table({"leaf": table.column("leaf").slice(0, 1), "leaves": pa.array([tree.leaves], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

        trees = materialize(some.groupBy("leaf").applyInArrow(plant, "leaf long, leaves int, tree binary").join(size, "leaf"), "leaf-trees")
        stuck = trees.where("leaves < 2").select("leaf")
        whole = materialize(stuck if whole is None else whole.unionByName(stuck), "whole-leaves")
        trees = trees.where("leaves > 1")
        rows, queries = (materialize(_through(df, trees, visits), "leaves") for df, visits in ((rows, False), (queries, True)))


def _through(df: DataFrame, trees: DataFrame, visits: bool) -> DataFrame:
    """``(vec_id, vector, leaf)`` with the new leaves of split ones: the nearest, or with ``visits`` all that a query visits."""
    parts = f"cast(ceil(n / {SPLIT}) as int)"
    told = trees.selectExpr("leaf", f"{parts} as parts")
    met = df.join(told, "leaf", "left")
    same = met.where("parts is null").select("vec_id", "vector", "leaf")
    moved = met.where("parts is not null").selectExpr("leaf", "cast(pmod(xxhash64(vec_id), parts) as int) as part", "1 as kind", "vec_id", "vector", "cast(null as binary) as tree")
    heads = trees.selectExpr("leaf", f"explode(sequence(0, {parts} - 1)) as part", "0 as kind", "cast(null as long) as vec_id", "cast(null as array<double>) as vector", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, leaf = None, None
        for batch in batches:
            leaves, kinds = batch.column("leaf").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((leaves[1:] != leaves[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(leaves)]
            for a, b in zip(edges, edges[1:]):
                own = batch.slice(a, b - a)
                if not own.num_rows:
                    continue
                if kinds[a] == 0:
                    tree, leaf = pickle.loads(own.column("tree")[0].as_py()), int(leaves[a])
                    continue
                unit = _unit(_matrix(own.column("vector")))
                found = [tree.bins(u, tree.visits) for u in unit] if visits else tree.assign(unit)[:, None].tolist()
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("vector"), pa.array([leaf] * own.num_rows, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["vec_id", "vector", "old", "places"])

    dealt = moved.unionByName(heads).repartition("leaf", "part").sortWithinPartitions("leaf", "kind")
    split = dealt.mapInArrow(run, "vec_id long, vector array<double>, old long, places array<int>")
    return same.unionByName(split.select("vec_id", "vector", "old", F.explode("places").alias("place")).select("vec_id", "vector", F.xxhash64("old", "place").alias("leaf")))


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, its ``k`` nearest of all other rows.

    Fewer rows than ``k``: all found. Rows that take no part are told in ``valid``. Vectors of different lengths have no
    cosine, so each length is searched on its own. No rows: an empty result.
    """
    spark = vectors.sparkSession
    own = materialize(valid(vectors, id_col, vector_col), "vectors")
    lengths = sorted(r["d"] for r in own.select(F.size("vector").alias("d")).distinct().collect())
    found = None
    for d in lengths:
        some = _search(own.where(F.size("vector") == d) if len(lengths) > 1 else own, every, k)
        found = some if found is None else found.unionByName(some)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _search(own: DataFrame, every: int, k: int) -> DataFrame:
    """``search`` over vectors of one length; there is one at least."""
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    tree = fit(_unit(_matrix(sample.column(0))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tree.assign(_unit(_matrix(batch.column(1)))))], ["vec_id", "vector", "leaf"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [tree.bins(u, tree.visits) for u in _unit(_matrix(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins, pa.list_(pa.int32()))], ["vec_id", "vector", "leaves"])

    rows = materialize(own.mapInArrow(route, "vec_id long, vector array<double>, leaf int").withColumn("leaf", F.col("leaf").cast("long")), "leaves")
    queries = own.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(visit, "vec_id long, vector array<double>, leaves array<int>")
    queries = materialize(queries.select("vec_id", "vector", F.explode("leaves").alias("leaf")).withColumn("leaf", F.col("leaf").cast("long")), "visits")
    rows, queries = _grown(rows, queries)
    # a row per leaf, far fewer than rows
    blocks = rows.groupBy("leaf").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("row_blocks")).join(queries.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("query_blocks")), "leaf")
    blocks = materialize(blocks, "blocks")
    held = rows.join(blocks, "leaf").select("vec_id", "vector", "leaf", F.pmod(F.xxhash64("vec_id"), "row_blocks").cast("int").alias("row_block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"))
    asked = queries.join(blocks, "leaf").select("vec_id", "vector", "leaf", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"), F.pmod(F.xxhash64("vec_id"), "query_blocks").cast("int").alias("query_block"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            found = nearest(_matrix(right.column("vector")), right.column("vec_id").to_numpy(), _matrix(left.column("vector")), left.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    by = ("leaf", "row_block", "query_block")
    some = held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return some.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
