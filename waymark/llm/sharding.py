"""Shards of even row counts by balanced label propagation.

Documents with equal texts are linked (a star for each text). Every row starts in a shard chosen by the rank of a hash of
its text and id, so counts differ by one at most. In each round a text's rows look to the shard that holds most of them;
the rows that want to move are counted for each pair of shards, and moves are granted under quotas: what can go
round in cycles of shards, and of the rest as many as the shard they go to has unlinked rows to give up, these then
filling the shards that lost rows. Counts so stay as they were. A text that fills a whole shard looks to the next one for
its other rows. Rounds end when nothing is wanted, or nothing granted twice; there is no other bound on them.

All work is on slim rows (ids, hashes, sizes); the text is read once. The driver sees counts of shard pairs only.

Where no rows are unlinked, moves that don't go round stay ungranted and more links are cut.

Defined results: null and empty texts are equal and have size 1; doc_id may be null or repeated (rows stay rows); other
columns are not read; an empty table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from functools import reduce
from itertools import count, pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def gapless_rank(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df (written once more) with name: the rank from 0 of each row in its group. Ranges of rows are
    counted by task, and the counts (tasks x groups, group being a small code) give each range's first rank."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, F.col(group), *order).withColumn("_task", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(group, "_task").orderBy(*order)
    ranked = ranged.withColumn("_r", F.row_number().over(inner) - 1)
    # at most one row for each task and group: a small table, whatever the rows
    return ranked.join(F.broadcast(base), [group, "_task"]).withColumn(name, F.col("_r") + F.col("_base")).drop("_task", "_r", "_base")


def _circulation(want: np.ndarray) -> np.ndarray:
    """Moves that leave every shard's count as it is: along cycles of wanted moves, short ones first."""
    left, grant, n = want.copy(), np.zeros_like(want), len(want)
    for length in range(2, n + 1):
        for first in range(n):
            while True:
                # the shortest way from first back to itself over wanted moves
                ways, seen, path = [[first]], {first}, None
                while ways and path is None:
                    way = ways.pop(0)
                    for j in np.flatnonzero(left[way[-1]]).tolist():
                        if j == first:
                            path = [*way, first]
                            break
                        if j not in seen and len(way) < length:
                            seen.add(j)
                            ways.append([*way, j])
                if path is None:
                    break
                steps = list(pairwise(path))
                k = min(left[s] for s in steps)
                for s in steps:
                    left[s] -= k
                    grant[s] += k
    return grant


def _grants(want: np.ndarray, free: np.ndarray) -> np.ndarray:
    """How many moves each pair of shards is granted: what can circulate, and of the rest what unlinked rows make room for."""
    fixed = _circulation(want)
    more = want - fixed
    while True:
        over = more.sum(axis=0) - more.sum(axis=1) - free
        j = int(over.argmax())
        if over[j] <= 0:
            return fixed + more
        for i in np.argsort(more[:, j]):
            cut = min(int(more[i, j]), int(over[j]))
            more[i, j] -= cut
            over[j] -= cut


def label_propagation(rows: DataFrame, shards: int) -> DataFrame:
    """rows (id long unique, key: what links rows, spread: a hash) with shard int; counts differ by one at most."""
    at = gapless_rank(rows.withColumn("_all", F.lit(0)), "_all", [F.col("spread"), F.col("id")], "_rank").drop("_all")
    at = materialize(at.withColumn("shard", (F.col("_rank") % shards).cast("int")).drop("_rank"))
    idle = 0
    # a granted move adds to the rows that are with most of their text, and a shard is settled once: rounds end
    for turn in count():
        # ties between shards are drawn anew in each round, or all would want the same shards
        held = materialize(at.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n")))
        # a shard that one text fills is settled for it: its other rows look to the next (one pair a shard at most)
        total = held.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
        full = held.join(F.broadcast(total.where("texts = 1").select("shard", "n")), ["shard", "n"]).select("key", "shard").collect()
        settled = reduce(lambda a, b: a | b, ((F.col("key") == r["key"]) & (F.col("shard") == r.shard) for r in full), F.lit(False))
        top = held.where(~settled).groupBy("key").agg(F.max(F.struct("n", F.xxhash64("key", "shard", F.lit(turn)).alias("draw"), "shard")).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("in"))
        goal = materialize(top.select("key", F.col("m.shard").alias("goal"), F.col("m.n").alias("best"), "all", "in"))
        cut = goal.where("`in` > 1").select("key", "goal")
        single = goal.where("`all` = 1").select("key")
        moving = materialize(at.join(cut, "key").where((F.col("shard") != F.col("goal")) & ~settled).select("id", "shard", "goal"))
        free_rows = materialize(at.join(single, "key", "left_semi").select("id", "shard"))
        want, free = np.zeros((shards, shards), np.int64), np.zeros(shards, np.int64)
        for r in moving.groupBy("shard", "goal").count().collect():
            want[r.shard, r.goal] = r["count"]
        for r in free_rows.groupBy("shard").count().collect():
            free[r.shard] = r["count"]
        grant = _grants(want, free)
        idle = 0 if grant.sum() else idle + 1
        if not want.sum() or idle > 1:
            break
        if idle:
            continue
        pair = (F.col("shard") * shards + F.col("goal")).cast("int")
        quota = F.element_at(F.array(*(F.lit(int(x)) for x in grant.ravel())), F.col("pair") + 1)
        go = gapless_rank(moving.withColumn("pair", pair), "pair", [F.xxhash64("id"), F.col("id")], "_k")
        go = go.where(F.col("_k") < quota).select("id", F.col("goal").alias("to"))
        net = grant.sum(axis=0) - grant.sum(axis=1)
        giving = gapless_rank(free_rows, "shard", [F.xxhash64("id"), F.col("id")], "_k")
        giving = giving.where(F.col("_k") < F.element_at(F.array(*(F.lit(int(max(0, x))) for x in net)), F.col("shard") + 1))
        slots = [(j, int(-x)) for j, x in enumerate(net) if x < 0]
        given = gapless_rank(giving.drop("_k").withColumn("_all", F.lit(0)), "_all", [F.col("id")], "_k")
        to, upto = F.lit(-1), 0
        for j, x in slots:
            to = F.when((F.col("_k") >= upto) & (F.col("_k") < upto + x), F.lit(j)).otherwise(to)
            upto += x
        moves = materialize(go.union(given.select("id", to.cast("int").alias("to"))))
        at = materialize(at.join(moves, "id", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))
    return at


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; law is rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    slim = materialize(slim.withColumn("id", F.monotonically_increasing_id()))
    rows = slim.select("id", "key", F.xxhash64("key", "id").alias("spread"))
    placed = label_propagation(rows, shards).select("id", "shard")
    out = slim.join(placed, "id").select("id", "doc_id", "size", "text_crc32", "key", "shard")
    out = gapless_rank(out, "shard", [F.col("key"), F.col("doc_id"), F.col("id")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
