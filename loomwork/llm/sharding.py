"""Resharding to equal row counts: a minimum-cost flow decides which blocks of rows move, so that the fewest bytes do."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread

#: What a document takes in a shard besides its text's UTF-8 bytes.
OVERHEAD = 16


@dataclass
class Flow:
    """A network of arcs with a capacity and a cost per unit, solved by shortest augmenting paths with potentials."""

    arcs: list[list] = field(default_factory=list)  # [to, capacity left, cost]; arc i ^ 1 is the reverse of arc i
    out: dict[object, list[int]] = field(default_factory=dict)

    def arc(self, a: object, b: object, capacity: int, cost: float) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def flow(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def solve(self, source: object, sink: object) -> None:
        """The largest flow of the least cost; all costs must be 0 or more."""
        order = {node: i for i, node in enumerate(self.out)}
        potential = dict.fromkeys(self.out, 0.0)
        while True:
            far, by, queue = {source: 0.0}, {}, [(0.0, order[source], source)]
            while queue:
                d, _, node = heapq.heappop(queue)
                if d > far[node]:
                    continue
                for i in self.out[node]:
                    to, capacity, cost = self.arcs[i]
                    if capacity > 0 and (e := d + max(0.0, cost + potential[node] - potential[to])) < far.get(to, float("inf")) - 1e-9:
                        far[to], by[to] = e, i
                        heapq.heappush(queue, (e, order[to], to))
            if sink not in far:
                return
            top = max(far.values())
            for node in potential:
                potential[node] += far.get(node, top)
            path, node = [], sink
            while node != source:
                path.append(by[node])
                node = self.arcs[by[node] ^ 1][0]
            most = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= most
                self.arcs[i ^ 1][1] += most


def transfers(rows: dict[int, int], shards: int, first_bytes: dict[int, float], last_bytes: dict[int, float]) -> list[tuple[int, int, int]]:
    """``(from, to, rows)`` that give each new shard its share of rows, at most one more than another, moving the fewest bytes.

    ``rows`` has the old shards' counts. Of a shard that must give up n rows the n smallest go: ``last_bytes`` is the
    n-th's size, ``first_bytes`` the mean of those before it. Which shards keep a row more is for the flow to choose. Old
    shards beyond ``shards`` are emptied, new ones beyond the old are filled.
    """
    if not rows:
        return []
    total, net, arcs = sum(rows.values()), Flow(), []
    share, more = divmod(total, shards)
    for i in sorted(rows):
        net.arc("source", ("old", i), rows[i], 0)
        surplus = max(0, rows[i] - share) if i < shards else rows[i]
        if i < shards:
            arcs.append((i, i, net.arc(("old", i), ("new", i), rows[i], 0)))
        if surplus:
            net.arc(("old", i), ("spare", i), surplus - 1, first_bytes.get(i, 0.0))
            net.arc(("old", i), ("spare", i), 1, max(last_bytes.get(i, 0.0), first_bytes.get(i, 0.0)))
            arcs += [(i, j, net.arc(("spare", i), ("new", j), surplus, 0)) for j in range(shards) if j != i]
    for j in range(shards):
        net.arc(("new", j), "sink", share, 0)
        net.arc(("new", j), "more", 1, 0)
    net.arc("more", "sink", more, 0)
    net.solve("source", "sink")
    return [(i, j, n) for i, j, arc in arcs if i != j and (n := net.flow(arc))]


def lay_out(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The old shards, written to the shared folder: a hash of the key gives the shard, rows lie there by size and key.

    Columns doc_id, text, size, old, part (the range a task wrote) and idx (the row's place in it).
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("size", F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + OVERHEAD)
    own = own.withColumn("old", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    ranged = own.repartitionByRange(spread(docs.sparkSession), "old", "size", "doc_id").sortWithinPartitions("old", "size", "doc_id")
    numbered = ranged.withColumn("part", F.spark_partition_id()).withColumn("idx", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return materialize(numbered, "old-shards", "old")


def reshard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, size, shard, slot)``: every row in one of ``shards`` shards, whose counts are at most one apart.

    Each old shard's rows are counted from its smallest on; the blocks that the flow moves are its head. Files that hold a
    row that moves are written anew by new shard, all others stay as they are. Slots have no gaps: rows that stay come first,
    then each arriving block. Only counts and sums of 40 shards reach the driver. Null texts have no bytes, null keys hash
    to one shard first; repeated rows are rows like any other. An empty table gives no rows.
    """
    old = lay_out(docs, shards, id_col, text_col)
    files = materialize(old.groupBy("part", "old").agg(F.count("*").alias("n"), F.min("idx").alias("lo")), "shard-files")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("old").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("before", before)
    rows = {r["old"]: r["n"] for r in files.groupBy("old").agg(F.sum("n").alias("n")).collect()}  # one row per shard
    spark, total = docs.sparkSession, sum(rows.values())
    surplus = {i: max(0, n - total // shards) for i, n in rows.items()}
    # a row per file and one per shard: the number of files is the number of shuffle partitions plus that of shards
    numbered = old.join(F.broadcast(files.select("part", "old", "lo", "before")), ["part", "old"]).withColumn("k", F.col("before") + F.col("idx") - F.col("lo"))
    over = spark.createDataFrame([*surplus.items()], "old int, surplus long")
    given = numbered.join(F.broadcast(over), "old").where("k < surplus").groupBy("old")
    costs = given.agg(F.avg(F.when(F.expr("k < surplus - 1"), F.col("size"))).alias("first"), F.max(F.when(F.expr("k = surplus - 1"), F.col("size"))).alias("last")).collect()
    moved = transfers(rows, shards, {r["old"]: r["first"] or 0.0 for r in costs}, {r["old"]: float(r["last"] or 0) for r in costs})

    gone, kept, blocks = dict.fromkeys(rows, 0), dict(rows), []
    for i, j, n in moved:
        kept[i] -= n
    arrived = {j: kept.get(j, 0) for j in range(shards)}
    for i, j, n in moved:
        blocks.append((i, gone[i], gone[i] + n, j, arrived[j] - gone[i]))
        gone[i] += n
        arrived[j] += n
    blocks += [(i, gone[i], rows[i], i, -gone[i]) for i in rows]
    plan = spark.createDataFrame(blocks, "old int, k_from long, k_to long, shard int, shift long")
    heads = spark.createDataFrame([*gone.items()], "old int, gone long")
    placed = numbered.join(F.broadcast(plan), "old").where("k >= k_from and k < k_to").withColumn("slot", F.col("k") + F.col("shift")).join(F.broadcast(heads), "old")
    out = ("doc_id", "text", "size", "shard", "slot")
    rewritten = materialize(placed.where("before < gone").select(*out), "new-shards", "shard")
    return placed.where("before >= gone").select(*out).unionByName(rewritten.select(*out))
