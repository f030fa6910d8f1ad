"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

The Fourier features cos(Wx + b) approximate a Gaussian kernel over standardized statistics of the text alone. Each
partition of the training table sums its part of the normal equations; the driver adds the parts and solves them.
Training takes at most max_rows rows of documents with labels, those that hash lowest; one in CALIBRATED of them, chosen by hash,
is left out of the equations and calibrates the scores (all rows do both where that part is too small or holds one
class only). Scores are for every row and whole texts.

Defined results: null and empty texts have all-zero statistics and are scored like others; rows without a doc_id are
scored and never learned from; labels that are null or for absent documents are left out; of several labels for one
doc_id the largest counts, and of several texts or repeated rows each is learned from, up to max_rows; very long texts are
measured whole; without both classes every score is 0.5 or the one
class seen; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROWS = 40_000
#: one in so many training rows calibrates, if there are at least LEAST of them
CALIBRATED, LEAST = 4, 200
N_STATS = 18


def statistics(text: str | None) -> np.ndarray:
    """N_STATS numbers about a text: length, character classes, and repetition of words, word pairs and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_STATS)
    if not raw:
        return out
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    w = raw.lower().split()
    n = max(1, len(w))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[0], out[1] = np.log1p(len(raw)), np.log1p(len(w))
    out[2] = len(raw) / n
    out[3] = c[65:91].sum()
    out[4] = c[97:123].sum()
    out[5] = c[48:58].sum()
    out[6] = c[128:].sum()
    out[7] = c[33]
    out[8] = c[[35, 36, 37, 38, 42, 64, 94, 126]].sum()
    out[9] = c[[60, 61, 62, 91, 92, 93, 95, 96, 123, 124, 125]].sum()
    out[10] = c[44] + c[46]
    out[11] = c[10]
    out[12] = len(set(w)) / n
    out[13] = len(set(zip(w, w[1:], strict=False))) / max(1, len(w) - 1)
    out[14] = len(set(lines)) / max(1, len(lines))
    out[15] = np.log1p(max(map(len, w), default=0))
    out[16] = np.log1p(len(raw) / max(1, len(lines)))
    out[17] = (c[34] + c[39] + c[40] + c[41] + c[45] + c[47] + c[58] + c[59] + c[63])
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.beta, self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the least-squares non-decreasing fit (pool adjacent violators); equal x are pooled first."""
    x, back = np.unique(x, return_inverse=True)
    weight = np.bincount(back).astype(float)
    level = np.bincount(back, weights=y) / weight
    blocks: list[list[float]] = []
    for i in range(len(x)):
        blocks.append([level[i], weight[i], x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, m, _, hi = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + v * m) / (p[1] + m), p[1] + m, p[2], hi]
    knots = np.array([e for b in blocks for e in b[2:]])
    return knots, np.repeat([b[0] for b in blocks], 2)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int) -> DataFrame:
    """(h, y, text): at most max_rows rows of docs with a label and outside the held-out fold, those of the lowest h, a
    hash of id and text. Labels are cut to the max_rows ids that hash lowest first, so that the join's small side is
    bounded too; several rows of one id are cut after it."""
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    y = y.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = materialize(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # chosen has max_rows rows of two numbers at most: a proven bound for the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "y", "text")
    total = rows.count()
    if total <= max_rows:
        return rows
    # the hash below which about max_rows rows lie, from a histogram of its upper bits; the limit cuts ties
    bucket = F.shiftright("h", 48)
    upto, n = None, 0
    for r in rows.groupBy(bucket.alias("b")).count().orderBy("b").collect():  # 65,536 rows at most
        upto, n = r.b, n + r["count"]
        if n >= max_rows:
            break
    return rows.where(bucket <= upto).orderBy("h").limit(max_rows)


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, max_rows: int = MAX_ROWS, n_features: int = 256, gamma: float = 0.05, ridge: float = 1e-3
) -> QualityModel:
    """A model learned from labelled rows whose crc32(doc_id as text) mod modulus is not held_out."""
    schema = "y int, c boolean, x array<double>"

    def measure(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "c": pdf["c"], "x": [statistics(t) for t in pdf["text"]]})

    rows = training_rows(docs, labels, label, modulus, held_out, max_rows)
    calibrates = F.pmod(F.xxhash64(F.lit("calibrate"), "h"), F.lit(CALIBRATED)) == 0
    train = materialize(rows.select("y", calibrates.alias("c"), "text").mapInPandas(measure, schema).repartition(8))
    parts = train.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()
    apart = len(parts) == 2 and all(r.lo < r.hi for r in parts) and min(r.n for r in parts) >= LEAST
    if not apart:
        fitted = calibrating = train
    else:
        fitted, calibrating = train.where(~F.col("c")), train.where("c")
    rng = np.random.default_rng(7)
    w = rng.normal(0, np.sqrt(2 * gamma), (N_STATS, n_features))
    b = rng.uniform(0, 2 * np.pi, n_features)
    parts = [F.struct(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])) for i in range(N_STATS)]
    row = fitted.agg(F.count(F.lit(1)), *parts).first()
    if not row[0]:
        zero = np.zeros(n_features + 1)
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS), w, b, zero, np.zeros(1), np.full(1, 0.5))
    mean, scale = np.array([list(r) for r in row[1:]], dtype=float).T
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), w, b, np.zeros(n_features + 1), np.zeros(1), np.zeros(1))

    def sums(batches):
        a, v = np.zeros((n_features + 1, n_features + 1)), np.zeros(n_features + 1)
        for pdf in batches:
            if len(pdf):
                phi = model.features(np.stack(pdf["x"].to_numpy()))
                a += phi.T @ phi
                v += phi.T @ pdf["y"].to_numpy(dtype=float)
        yield pd.DataFrame({"a": [a.tobytes()], "v": [v.tobytes()]})

    a, v = np.zeros((n_features + 1, n_features + 1)), np.zeros(n_features + 1)
    for r in fitted.mapInPandas(sums, "a binary, v binary").collect():
        a += np.frombuffer(r.a).reshape(a.shape)
        v += np.frombuffer(r.v)
    penalty = np.eye(len(v)) * ridge * row[0]
    penalty[-1, -1] = 1e-9
    model.beta = np.linalg.solve(a + penalty, v)

    def raw(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"s": model.features(np.stack(pdf["x"].to_numpy())) @ model.beta, "y": pdf["y"].astype(float)})

    got = calibrating.mapInPandas(raw, "s double, y double").collect()  # two numbers for each of max_rows rows at most
    model.knots, model.values = isotonic(np.array([r.s for r in got]), np.array([r.y for r in got]))
    return model


def quality_score(model: QualityModel, text: str = "text"):
    """A column: the model's score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return score(F.col(text))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    model = fit_quality(docs, labels, "quality", modulus, held_out, **options)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held_out, F.lit(False))
    out = docs.select("doc_id", fold.alias("held_out"), quality_score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose score is at least 0.5."""
    model = fit_quality(docs, labels, **options)
    return docs.where(quality_score(model) >= 0.5)
