"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each distinct hashed feature of a text (words, word pairs, pairs with one or two words between) has its own learning
rate; the L1 term leaves few non-zero weights, which are sent to the workers as two short sorted arrays.
Features of at most max_rows rows of documents with labels (those that hash lowest) are made on the executors, and the driver runs
the passes over them one row at a time, as FTRL-proximal does. The driver takes at most max_features numbers of four
bytes: rows are taken in order of their hash, without those that would go beyond. Scores are for all rows and whole texts.

Defined results: null and empty texts have the bias alone; rows without a doc_id are scored, never learned from; null
labels are left out, of several for one doc_id the largest counts; of several texts or repeated rows each is learned
from, up to the bounds; without labels every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, words
from .quality import training_rows

BITS = 22
MAX_ROWS = 8_000
#: 80 MB
MAX_FEATURES = 20_000_000
SPAN = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a text, ascending. Letters are compared in lower case, punctuation is trimmed."""
    w = words(text, lower=True)
    found = []
    for at in range(0, len(w), SPAN):
        part = [x.strip(b".,;:!?\"'()[]|#$%&*") for x in w[at : at + SPAN + 3]]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part))
        grams = [h[: min(SPAN, len(h))]]
        for gap in (1, 2, 3):
            left = h[:-gap][:SPAN]
            grams.append((left * _MIX + h[gap:][: len(left)] + np.uint64(gap)) * _MIX)
        found.append(np.unique(np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class ToxicityModel:
    """Non-zero weights: ascending feature numbers and their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        f = features(text)
        z = self.bias
        if len(f) and len(self.index):
            at = np.minimum(np.searchsorted(self.index, f), len(self.index) - 1)
            z += float(self.weight[at][self.index[at] == f].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def ftrl(rows: list[tuple[np.ndarray, int]], alpha: float, beta: float, l1: float, l2: float, epochs: int) -> ToxicityModel:
    """Per-coordinate FTRL-proximal passes over (features, label) rows, in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    for _ in range(epochs):
        for f, y in rows:
            zf, nf = z[f], n[f]
            wf = np.where(np.abs(zf) <= l1, 0.0, (np.sign(zf) * l1 - zf) / ((beta + np.sqrt(nf)) / alpha + l2))
            wb = -bz / ((beta + np.sqrt(bn)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(wb + wf.sum(), -35, 35))) - y
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * wf
            n[f] = nf + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * wb
            bn += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    index = np.flatnonzero(w).astype(np.int32)
    return ToxicityModel(index, w[index], -bz / ((beta + np.sqrt(bn)) / alpha))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.0, epochs: int = 8
) -> ToxicityModel:
    """A model learned from labelled rows whose crc32(doc_id as text) mod modulus is not held_out."""

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in texts], dtype=object)

    rows = training_rows(docs, labels, "toxic", modulus, held_out, max_rows)
    train = materialize(rows.select("h", "y", hashed("text").alias("f")))
    taken, total = set(), 0
    for r in train.select("h", (F.length("f") / 4).cast("long").alias("n")).orderBy("h", "n").collect():  # max_rows at most
        if total + r.n <= max_features:
            taken.add((r.h, r.n))
            total += r.n
    got = ((r.h, r.y, np.frombuffer(r.f, np.int32)) for r in train.toLocalIterator())
    got = sorted((r for r in got if (r[0], len(r[2])) in taken), key=lambda r: (hash((r[0], 1)), r[1]))
    held, learned = 0, []
    for _, y, f in got:  # equal rows share a hash: the bound holds for them as well
        if held + len(f) <= max_features:
            learned.append((f, y))
            held += len(f)
    return ftrl(learned, alpha, beta, l1, l2, epochs)


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    bc = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, modulus, held_out, **options))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([bc.value.score(t) for t in texts], dtype=float)

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held_out, F.lit(False))
    out = docs.select("doc_id", fold.alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
