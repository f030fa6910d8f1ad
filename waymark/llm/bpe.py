"""Byte-level BPE by overlapping chunks.

Every text is cut into chunks that overlap, each chunk is pre-tokenised on its own, and neighbours are stitched where their
pre-token boundaries meet again: from a boundary that both have on, both have the same pre-tokens, as the pattern looks
ahead only. The pre-tokens so found are encoded, each distinct one once while it is remembered. Where two chunks don't
meet in their overlap (one pre-token is longer), they are pre-tokenised as one.

A text of over PART bytes is spread over tasks by the same rule: parts of it are pre-tokenised in tasks of their own, which
send the boundaries in their overlaps; where these meet the text is cut, and the pieces are encoded in tasks of their own.
Pieces are cut after a non-blank character, where both sides pre-tokenise alone as they do together. Only the ids of such a text are
gathered in one task, as they are one value. Decoding joins the tokens' raw bytes.

Defined results: null texts are empty; empty texts have no tokens; lone surrogates cannot occur in Spark strings;
rows are encoded one by one, so repeated rows give repeated results; an empty table gives no rows; other columns are not
read. An input column that has the name of a new one stays, and the new one's name gets the first free number (ids_1).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, release, stable

CHUNK, OVERLAP = 1 << 12, 1 << 8
PART = 1 << 20
#: pre-tokens remembered (twice as many at most), of at most so many characters
REMEMBERED, SHORT = 30_000, 64
#: values of an Arrow column that are Python objects at once
AT_ONCE = 256


class _Pieces(dict):
    """The ids of pre-tokens as little-endian unsigned 32-bit integers. The last REMEMBERED new ones are here; of those before,
    as many are in old and come back when they are asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = np.array(self.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = _Pieces(self.encoding._core_bpe.encode_single_piece)
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def pre_tokens(self, text: str, lo: int, hi: int) -> tuple[list[str], np.ndarray]:
        """(the matches in text[lo:hi], where each starts)."""
        found = [] if self.pattern.groups else self.pattern.findall(text, lo, hi)
        size = np.fromiter(map(len, found), np.int64, len(found))
        if self.pattern.groups or int(size.sum()) != hi - lo:  # a pattern that leaves characters out
            spans = [m.span() for m in self.pattern.finditer(text, lo, hi)]
            return [text[a:b] for a, b in spans], np.array([a for a, _ in spans], np.int64)
        return found, lo + np.cumsum(size) - size

    def stitched(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[list[str], np.ndarray]]:
        """The pre-tokens of text and their starts, as runs of the chunks that they come from."""
        n = len(text)
        bounds = [(lo, min(n, lo + chunk + overlap)) for lo in range(0, max(1, n), chunk)]
        while len(bounds) > 1 and bounds[-2][1] == n:  # the last chunk lies in the overlap of the one before
            bounds.pop()
        held, at = self.pre_tokens(text, *bounds[0]), 0
        lo = bounds[0][0]
        for a, b in bounds[1:]:
            new = self.pre_tokens(text, a, b)
            # the last match may go on beyond its chunk: its start, and what lies behind, is not trusted
            both = np.intersect1d(held[1][at:-1], new[1][new[1] > a], assume_unique=True)
            if not len(both):
                held, at = self._together(text, lo, b, held, at), 0
                lo = int(held[1][0]) if len(held[1]) else lo
                continue
            end, first = np.searchsorted(held[1], both[0]), np.searchsorted(new[1], both[0])
            yield held[0][at:end], held[1][at:end]
            held, at, lo = new, int(first), int(both[0])
        yield held[0][at:], held[1][at:]

    def _together(self, text: str, lo: int, hi: int, held: tuple[list[str], np.ndarray], at: int) -> tuple[list[str], np.ndarray]:
        """Pre-tokens from the last trusted one of held up to hi, behind those before it."""
        keep = max(at, len(held[0]) - 2)
        start = int(held[1][keep]) if len(held[1]) > keep else lo
        more = self.pre_tokens(text, start, hi)
        return held[0][at:keep] + more[0], np.concatenate([held[1][at:keep], more[1]])

    def encode(self, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        runs = (found for found, _ in self.stitched(text or "", chunk, overlap))
        return b"".join(map(self.pieces.__getitem__, chain.from_iterable(runs)))

    def edges(self, text: str, before: int, after: int, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
        """Boundaries of a part of a text, after non-blank characters: those below `before`, and those from `after` on but the last."""
        starts = np.concatenate([s for _, s in self.stitched(text, chunk, overlap)])
        ok = [s for s in starts[(starts < before) | (starts >= after)].tolist() if s > 0 and not text[s - 1].isspace()]
        last = int(starts[-1]) if len(starts) else 0
        return [s for s in ok if s < before], [s for s in ok if after <= s < last]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def _each(values: pa.Array, f, kind: pa.DataType) -> pa.Array:
    """f of each value, as an Arrow column of that kind: of a batch, only AT_ONCE values are Python objects at a time."""
    release()  # what the batch before left
    parts = [pa.array(map(f, values.slice(at, AT_ONCE).to_pylist()), kind) for at in range(0, len(values), AT_ONCE)]
    out = pa.concat_arrays(parts) if parts else pa.array([], kind)
    del parts
    release()
    return out


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with the first number that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in chain([name], (f"{name}_{i}" for i in range(1, len(taken) + 2))) if x.lower() not in taken)


def _long_ids(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int, part: int) -> DataFrame:
    """(ROW, ids) of texts (ROW, text) that are spread over tasks; part: characters in a part."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lap = 16 * overlap

    def parts(batches):
        for pdf in batches:
            for row, text in zip(pdf[ROW].tolist(), pdf["text"], strict=True):
                for i, lo in enumerate(range(0, len(text), part)):
                    yield pd.DataFrame({ROW: [row], "part": [i], "text": [text[lo : lo + part + lap]]})

    def edges(batches):
        for pdf in batches:
            for row, i, text in zip(pdf[ROW].tolist(), pdf["part"].tolist(), pdf["text"], strict=True):
                head, tail = codec(path, pattern).edges(text, lap, part, chunk, overlap)
                yield pd.DataFrame({ROW: [row], "part": [i], "head": [[i * part + s for s in head]], "tail": [[i * part + s for s in tail]]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        cuts, last = [], 0
        for tail, head in zip(pdf["tail"].iloc[:-1], pdf["head"].iloc[1:], strict=True):
            # parts that don't meet stay one piece
            if len(both := np.intersect1d(tail, head)) and both[0] > last:
                last = int(both[0])
                cuts.append(last)
        return pd.DataFrame({ROW: pdf[ROW].iloc[:1], "cuts": [cuts]})

    def pieces(batches):
        for pdf in batches:
            for row, text, cuts in zip(pdf[ROW].tolist(), pdf["text"], pdf["cuts"], strict=True):
                for i, (a, b) in enumerate(pairwise([0, *cuts, len(text)])):
                    yield pd.DataFrame({ROW: [row], "piece": [i], "text": [text[a:b]]})

    def encode(batches):
        for pdf in batches:
            yield pd.DataFrame({ROW: pdf[ROW], "piece": pdf["piece"], "ids": [codec(path, pattern).encode(t, chunk, overlap) for t in pdf["text"]]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({ROW: pdf[ROW].iloc[:1], "ids": [b"".join(pdf.sort_values("piece")["ids"])]})

    cut = texts.mapInPandas(parts, f"{ROW} long, part int, text string").repartition(tasks, ROW, "part")
    cut = cut.mapInPandas(edges, f"{ROW} long, part int, head array<long>, tail array<long>").groupBy(ROW).applyInPandas(meet, f"{ROW} long, cuts array<long>")
    each = texts.join(cut, ROW).mapInPandas(pieces, f"{ROW} long, piece int, text string").repartition(tasks, ROW, "piece")
    return each.mapInPandas(encode, f"{ROW} long, piece int, ids binary").groupBy(ROW).applyInPandas(whole, f"{ROW} long, ids binary")


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP, part: int = PART) -> DataFrame:
    """docs' columns plus ids (binary, little-endian unsigned 32-bit) of the text column."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return _each(texts, lambda t: c.encode(t, chunk, overlap), pa.binary())

    docs, name = stable(docs), free_name(docs, name)
    text = F.col(f"`{text_col}`")
    long = F.coalesce(F.octet_length(text), F.lit(0)) > part
    if docs.where(long).isEmpty():
        return docs.withColumn(name, encode(text))
    short = docs.where(~long).withColumn(name, encode(text))
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id()).where(long)
    ids = _long_ids(numbered.select(ROW, text.alias("text")), path, pattern, chunk, overlap, part).withColumnRenamed("ids", name)
    return short.unionByName(numbered.join(ids, ROW).drop(ROW))


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """encoded's columns plus decoded (binary): the joined bytes of ids; null ids decode to nothing.
    An id outside the ranks raises IndexError."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return _each(ids, lambda x: c.decode(x or b""), pa.binary())

    return encoded.withColumn(free_name(encoded, name), decode(F.col(f"`{ids_col}`")))


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, part: int = PART) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: encoded, then decoded from the ids."""

    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digest(ids: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        row = lambda x: {"n_tokens": len(x) // 4, "ids_sha256": hashlib.sha256(x).hexdigest(), "decoded_sha256": hashlib.sha256(c.decode(x)).hexdigest()}
        return _each(ids, row, kind)

    coded = encode_documents(docs.select("doc_id", "text"), path, pattern, chunk=chunk, overlap=overlap, part=part)
    return coded.select("doc_id", digest("ids").alias("r")).select("doc_id", "r.*")
