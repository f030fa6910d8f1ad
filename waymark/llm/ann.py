"""Approximate nearest neighbours by multi-index hashing.

Vectors are rotated by a learned matrix (principal axes, then the rotation that makes signs lose least, fitted by
alternation on a bounded sample) and cut to BITS sign bits. A code is split into substrings, each with an index of its own
from value to rows. If two codes differ in r bits at most, then for thresholds t_i with sum(t_i + 1) > r some substring i
differs in t_i bits at most; so probing, in each index, all values within t_i finds every code within r. An index holds
the rows of a value as a bitmap, and of all values within t as another, so that the probes of a substring are one look-up.
What is found and within r is ranked by inner products of the original vectors in double precision. r is set so that
`recall` of the sample's true neighbours lie within it, and grows for a query that finds fewer than k. The k nearest of
all n rows are about the k m / n nearest of a sample of m, so that many are looked at. Vectors are dealt out in
blocks, queries (a stated set) in blocks of their own; each block keeps k rows for a query. A block's bitmaps take
BITS * 4 bytes a row and level of t.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
another dimension than the most frequent; repeated rows are candidates of their own and a row is never its own
neighbour; ties go to the smaller vec_id (null ids last); extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BITS, WIDTH = 256, 8
SAMPLE_ROWS = 10_000
BLOCK_ROWS, QUERY_ROWS = 8192, 8192
_VALUES = np.arange(1 << WIDTH)


def learn_rotation(x: np.ndarray, rounds: int = 25, seed: int = 3) -> np.ndarray:
    """A dimension x BITS matrix: rotated principal axes; further rotations are set beside it where the dimension is smaller."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :BITS]
    p, out = x @ axes, []
    while sum(m.shape[1] for m in out) < BITS:
        r = np.linalg.qr(rng.normal(size=(p.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(p @ r >= 0, 1.0, -1.0).T @ p)
            r = (u @ vt).T
        out.append(axes @ r)
    assert out[0].shape[0] == d
    return np.hstack(out)[:, :BITS]


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """n x BITS / 8 bytes: the sign bits of rotated vectors."""
    return np.packbits(x @ rotation >= 0, axis=1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits in which codes differ, over the last axis."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=-1)


def thresholds(r: int, parts: int) -> list[int]:
    """Substring thresholds with sum(t + 1) = r + 1; -1 where a substring need not be probed."""
    whole, rest = divmod(r + 1, parts)
    return [min(WIDTH, whole + (i < rest) - 1) for i in range(parts)]


class MultiIndex:
    """The indexes of one block: for each substring, value and t, a bitmap of the rows that differ in t bits at most."""

    def __init__(self, code: np.ndarray):
        self.code = np.ascontiguousarray(code)
        self.near = [[np.packbits(code[:, i] == _VALUES[:, None], axis=1)] for i in range(code.shape[1])]

    def probe(self, i: int, t: int) -> np.ndarray:
        """Substring i's bitmaps at t, each from those at t - 1 of the values that differ in one bit."""
        levels = self.near[i]
        while len(levels) <= t:
            last = levels[-1]
            levels.append(np.bitwise_or.reduce([last, *(last[_VALUES ^ 1 << j] for j in range(WIDTH))]))
        return levels[t]

    def within(self, q: np.ndarray, r: int) -> np.ndarray:
        """All rows whose codes differ from q in r bits at most."""
        found = [self.probe(i, t)[q[i]] for i, t in enumerate(thresholds(r, len(q))) if t >= 0]
        rows = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(found), count=len(self.code)))
        return rows[differing(self.code[rows], np.ascontiguousarray(q)) <= r]


def calibrate(x: np.ndarray, rotation: np.ndarray, k: int, recall: float) -> int:
    """The radius that holds `recall` of the k nearest of some of the sample's vectors."""
    own = np.arange(0, len(x), max(1, len(x) // 400))
    s = x[own] @ x.T
    s[np.arange(len(own)), own] = -np.inf
    n = min(k, len(x) - 1)
    if not n:
        return BITS
    best = np.argpartition(-s, n - 1, axis=1)[:, :n]
    c = codes(x, rotation)
    return int(np.ceil(np.percentile(differing(c[own][:, None], c[best]), 100 * recall)))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_row, vec_id, known, x array<double>) of the vectors that take part; vec_id is 0 and known false where there is none."""
    x = F.transform(F.col("x"), lambda v: v.cast("double"))
    df = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("x")).withColumn("x", x)
    df = df.where("x is not null and size(x) > 0")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    df = df.where(~F.coalesce(bad, F.lit(True)) & F.exists("x", lambda v: v != 0))
    common = df.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    df = df.where(F.size("x") == (common.d if common else 0))
    known = F.col("vec_id").isNotNull().alias("known")
    return materialize(df.select(F.coalesce("vec_id", F.lit(0)).cast("long").alias("vec_id"), known, "x", F.monotonically_increasing_id().alias("_row")))


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by `every`."""
    spark = vectors.sparkSession
    df = usable(vectors, id_col, vec_col)
    n = df.count()
    queries = df.where(F.col("known") & (F.col("vec_id") % every == 0))
    nq = queries.count()
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    one_in = max(1, n // SAMPLE_ROWS)
    sample = df.where(F.pmod(F.xxhash64("_row"), F.lit(one_in)) == 0).limit(2 * SAMPLE_ROWS).select("x").collect()
    sample = np.array([r.x for r in sample] or [r.x for r in df.limit(1).collect()])
    rotation = learn_rotation(sample)
    radius = calibrate(sample, rotation, -(-k * len(sample) // n), recall)
    blocks, groups = -(-n // BLOCK_ROWS), -(-nq // QUERY_ROWS)
    block = F.pmod(F.xxhash64(F.lit("block"), "_row"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64(F.lit("group"), "_row"), F.lit(groups)).cast("int")
    left = df.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(False).alias("asks"), "_row", "vec_id", "known", "x")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), group.alias("group"), F.lit(True).alias("asks"), "_row", "vec_id", "known", "x")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        out = {c: [] for c in ("q", "query_id", "vec_id", "score")}
        own, q = pdf[~asks], pdf[asks]
        if len(own) and len(q):
            x, qx = np.stack(own["x"].to_numpy()), np.stack(q["x"].to_numpy())
            ids, gone, rows = own["vec_id"].to_numpy(), ~own["known"].to_numpy(), own["_row"].to_numpy()
            index, qc = MultiIndex(codes(x, rotation)), codes(qx, rotation)
            for i, (row, qid) in enumerate(zip(q["_row"].tolist(), q["vec_id"].tolist(), strict=True)):
                r, need = radius, min(k, len(x) - 1)
                while len(at := (a := index.within(qc[i], r))[rows[a] != row]) < need and r < BITS:
                    r = min(BITS, r + 4)
                if not len(at):
                    continue
                s = (x[at] * qx[i]).sum(axis=1)
                if len(at) > k:
                    ok = s >= np.partition(s, len(s) - k)[len(s) - k]
                    at, s = at[ok], s[ok]
                top = np.lexsort((rows[at], ids[at], gone[at], -s))[:k]
                out["q"] += [row] * len(top)
                out["query_id"] += [qid] * len(top)
                out["vec_id"] += [None if lost else v for v, lost in zip(ids[at[top]].tolist(), gone[at[top]].tolist(), strict=True)]
                out["score"] += s[top].tolist()
        return pd.DataFrame({"q": out["q"], "query_id": out["query_id"], "vec_id": pd.array(out["vec_id"], "Int64"), "score": out["score"]})

    found = left.union(right).groupBy("block", "group").applyInPandas(search, "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
