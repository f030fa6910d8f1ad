"""Repeated passages by relative Lempel-Ziv parsing.

The reference is the whole corpus, in two indexes in the shared folder. Windows (word sequences of one window's length) that
occur twice or more are indexed in blocks of the hash space, each with two of its places (row, word). Reference
blocks hold, for ranges of rows by hash, the sequences of window hashes at all places that may repeat, so that a match can be followed
word by word in either direction from any place.

Documents are parsed greedily from left to right. At a word whose window is indexed, the factor is followed along that
window's source (another place than its own) as far as document and source agree. Then the boundary is checked: if the window that holds
the first word beyond is indexed as well, its source is followed backwards; if that covers the whole factor, it is the longer
match and takes its place, and so on. The next factor starts where one ends, or, if only windows across the boundary
repeat, is what the last of these adds. Factors don't overlap; their union is the duplicate words, and all of it, as
each indexed window lies in a factor or in two neighbours.

The indexes are built in two passes, so that only what may repeat is moved. First the minimizers of word 18-grams
(35-word windows; in general half a window) are counted: equal windows have equal minimizers. Then windows whose minimizer
repeats are counted by a 128-bit hash. Each task sums what it has by sorting before it sends one block of hashes to
each bucket, so a passage in a third of all documents weighs no more there than others. Buckets are as many as hold
BUCKET_BYTES of text each.

Defined results: null and empty texts have no words; shorter texts than a window lose nothing; very long texts are parsed
whole; repeated rows repeat each other's windows; doc_id may be null or repeated, as rows are numbered; extra columns are not
read (or, in remove_repeats, kept); an empty table gives an empty result. Windows are compared by 128 hash bits, and by 64
of them along a source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, new_folder, open_folder, put_file, quoted, release, stable, words
from .hashindex import HELD_BYTES, HashIndex, bucket_of, pack, unpack, write_bucket

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
FLUSH = 2_000_000
BATCH_WORDS = 300_000
BUCKET_BYTES = 32 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """A polynomial hash of each k consecutive values, mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, total, have = None, 0, (h, 1)
    while True:
        if k >> (have[1].bit_length() - 1) & 1:
            if done is None:
                done, total = have[0], have[1]
            else:
                m = len(h) - total - have[1] + 1
                done = done[:m] * np.uint64(pow(base, have[1], 1 << 64)) + have[0][total : total + m]
                total += have[1]
        if have[1] * 2 > k:
            return _mix(done[:n])
        m = len(h) - 2 * have[1] + 1
        p = have[0]
        have = (p[:m] * np.uint64(pow(base, have[1], 1 << 64)) + p[have[1] : have[1] + m], have[1] * 2)


def sliding(x: np.ndarray, k: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) of each k consecutive values."""
    p, w = x, 1
    while w * 2 <= k:
        p, w = op(p[:-w], p[w:]), w * 2
    return p if w == k else op(p[: len(x) - k + 1], p[k - w : k - w + len(x) - k + 1])


class Batch:
    """The words of some documents in one array, and the hashes of their windows."""

    def __init__(self, docs: list[list[bytes]], window: int):
        self.window, self.gram = window, (window + 1) // 2
        self.ends = np.cumsum([len(d) for d in docs])
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for d in docs for w in d), np.uint64, int(self.ends[-1]))
        self.h, n = h, max(0, len(h) - window + 1)
        last = np.repeat(self.ends, [len(d) for d in docs])
        self.valid = np.arange(n) + window <= last[:n]
        if n:
            self.grams = rolling(h, self.gram, BASES[0])
            width = window - self.gram + 1
            low = sliding(self.grams, width, np.minimum)
            self.low = np.where(self.valid, low, np.uint64(0))
            high = sliding(np.concatenate([np.zeros(width - 1, np.uint64), self.low, np.zeros(width - 1, np.uint64)]), width, np.maximum)
            self.anchors = self.grams[(high == self.grams) & (high > 0)]
        else:
            self.low = self.anchors = np.zeros(0, np.uint64)

    def candidates(self, index: HashIndex) -> np.ndarray:
        """Starts of windows whose minimizer repeats."""
        starts = np.flatnonzero(self.valid)
        if not len(starts):
            return starts
        value, back = np.unique(self.low[starts], return_inverse=True)
        return starts[index.lookup(value)[0][back]]

    def hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(rolling(self.h, self.window, b)[starts] for b in BASES)


def _batches(texts: list, window: int) -> Iterator[tuple[int, list[list[bytes]], Batch]]:
    """(number of the first document, their words, Batch) for runs of documents of about BATCH_WORDS words."""
    at, held, n = 0, [], 0
    for t in texts:
        held.append(words(t))
        n += len(held[-1])
        if n >= BATCH_WORDS:
            yield at, held, Batch(held, window)
            at, held, n = at + len(held), [], 0
    if held:
        yield at, held, Batch(held, window)


def _twice(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of sorted rows (same: equal to the row before), the first of each run, and its second if there is one."""
    second = same & ~np.concatenate([[False], same[:-1]])
    return order[~same | second]


def _send(keys: list[np.ndarray], columns: list[np.ndarray], buckets: int) -> Iterator[pd.DataFrame]:
    """One row a bucket: of each key (one or two arrays), what the first two rows hold."""
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order), bool)
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    same[:1] = False
    order = _twice(order, same)
    ends = np.searchsorted(bucket_of(keys[0][order], buckets), np.arange(buckets + 1))
    there = np.flatnonzero(np.diff(ends))
    blobs = [pack(*(c[order[ends[b] : ends[b + 1]]] for c in [*keys, *columns])) for b in there]
    yield pd.DataFrame({"bucket": there.astype(np.int32), "blob": blobs})


class Blocks:
    """Reference blocks in a folder: runs of window hashes at successive words of a row, by row and word."""

    def __init__(self, uri: str, n: int):
        self.uri, self.n = uri, n
        self._open: dict[int, tuple] = {}
        self._held = 0

    def block_of(self, rows: np.ndarray) -> np.ndarray:
        return bucket_of(_mix(rows.astype(np.uint64) + np.uint64(1)), self.n)

    def send(self, h: np.ndarray, row: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(block, blob) of hashes that come by rows and words; a row is in one block."""
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)]))
        size = np.diff(np.append(first, len(h)))
        at = self.block_of(row[first])
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(self.n + 1))
        for b in np.flatnonzero(np.diff(ends)):
            runs = order[ends[b] : ends[b + 1]]
            n = size[runs]
            values = h[np.repeat(first[runs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            yield int(b), np.array([len(runs)], "<i8").tobytes() + pack(row[first[runs]], pos[first[runs]].astype("<i8"), n) + values.tobytes()

    @staticmethod
    def _read(blob) -> tuple[np.ndarray, ...]:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        row, pos, size = np.frombuffer(blob, "<i8", 3 * n, 8).reshape(3, n)
        return row, pos, size, np.frombuffer(blob, "<u8", int(size.sum()), 8 + 24 * n)

    def write(self, block: int, blobs: list[bytes]) -> None:
        parts = [self._read(x) for x in blobs]
        row, pos, size = (np.concatenate([p[i] for p in parts]) for i in range(3))
        values = np.concatenate([p[3] for p in parts])
        first = np.cumsum(size) - size
        order = np.lexsort((pos, row))
        n = size[order]
        values = values[np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        put_file(self.uri, f"r{block:06d}", [np.array([len(n)], "<i8").tobytes(), pack(row[order], pos[order], n), values.tobytes()])

    def _block(self, block: int) -> tuple:
        if block not in self._open:
            fs, path = open_folder(self.uri)
            if isinstance(fs, pafs.LocalFileSystem):
                raw = np.memmap(f"{path}/r{block:06d}", np.uint8, "r")
            else:
                with fs.open_input_file(f"{path}/r{block:06d}") as f:
                    raw = np.frombuffer(f.read(), np.uint8)
                self._held += len(raw)
                if self._held > HELD_BYTES:
                    self._open.clear()
                    self._held = len(raw)
            row, pos, size, values = self._read(raw)
            self._open[block] = row, pos, np.concatenate([[0], np.cumsum(size)]), values
        return self._open[block]

    def around(self, row: int, pos: int) -> tuple[np.ndarray, int]:
        """(the run of hashes that holds word pos of a row, where in the run that is)."""
        rows, starts, begin, values = self._block(int(self.block_of(np.array([row]))[0]))
        lo, hi = np.searchsorted(rows, [row, row + 1])
        i = lo + int(np.searchsorted(starts[lo:hi], pos, side="right")) - 1
        return values[begin[i] : begin[i + 1]], pos - int(starts[i])


@dataclass
class Index:
    """What repeats: grams are minimizers, windows have two places, blocks are the reference."""

    grams: HashIndex
    windows: HashIndex
    blocks: Blocks


def build_index(rows: DataFrame, window: int) -> Index:
    """The index of all windows that occur twice in rows (_row long, text)."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    first, second = new_folder(spark, "grams"), new_folder(spark, "windows")
    grams = HashIndex(first, buckets, ["u8"])
    kinds = ["u8", "u8", "i8", "i4"]
    blocks = Blocks(new_folder(spark, "reference"), buckets)

    def anchors(batches):
        held, n = [], 0
        for pdf in batches:
            for _, _, b in _batches(list(pdf["text"]), window):
                held.append(b.anchors)
                n += len(b.anchors)
                if n >= FLUSH:
                    yield from _send([np.concatenate(held)], [], buckets)
                    held, n = [], 0
        if n:
            yield from _send([np.concatenate(held)], [], buckets)

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(np.concatenate([unpack(b, ["u8"])[0] for b in pdf["blob"]]))
        write_bucket(first, int(pdf["bucket"].iat[0]), [np.unique(x[1:][x[1:] == x[:-1]])])
        return pd.DataFrame({"bucket": pdf["bucket"][:1]})

    def windows(batches):
        held, n = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield pd.DataFrame(((-1 - b, blob) for b, blob in blocks.send(cols[0], *cols[2:])), columns=["bucket", "blob"])
            yield from _send(cols[:2], cols[2:], buckets)

        for pdf in batches:
            ids = pdf["_row"].to_numpy()
            for at, docs, b in _batches(list(pdf["text"]), window):
                s = b.candidates(grams)
                if not len(s):
                    continue
                lens = np.array([len(d) for d in docs])
                which = np.repeat(np.arange(len(docs)), lens)[s]
                pos = s - (b.ends - lens)[which]
                held.append([*b.hashes(s), ids[at + which], pos.astype(np.int32)])
                n += len(s)
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def indexed(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iat[0])
        if bucket < 0:
            blocks.write(-1 - bucket, list(pdf["blob"]))
            return pd.DataFrame({"bucket": pdf["bucket"][:1]})
        a, b, row, pos = (np.concatenate(c) for c in zip(*(unpack(x, kinds) for x in pdf["blob"]), strict=True))
        order = np.lexsort((pos, row, b, a))
        a, b, row, pos = a[order], b[order], row[order], pos[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        head = np.concatenate([[True], ~same])
        last = np.append(np.flatnonzero(head)[1:], len(a)) - 1
        head = np.flatnonzero(head)
        head, last = head[last > head], last[last > head]
        write_bucket(second, bucket, [a[head], b[head], row[head], pos[head], row[last], pos[last]])
        return pd.DataFrame({"bucket": pdf["bucket"][:1]})

    sent = "bucket int, blob binary"
    rows.select("text").mapInPandas(anchors, sent).groupBy("bucket").applyInPandas(repeated, "bucket int").count()
    rows.select("_row", "text").mapInPandas(windows, sent).groupBy("bucket").applyInPandas(indexed, "bucket int").count()
    return Index(grams, HashIndex(second, buckets, [*kinds, "i8", "i4"]), blocks)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values are equal."""
    n = min(len(a), len(b))
    for at in range(0, n, 1024):
        differ = np.flatnonzero(a[at : min(n, at + 1024)] != b[at : min(n, at + 1024)])
        if len(differ):
            return at + int(differ[0])
    return n


def factor(b: Batch, index: Index, rows: np.ndarray, lens: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Factors of a batch of documents with these row numbers and numbers of words: (start, end, source's row, source's word),
    start and end being word numbers in the batch."""
    s = b.candidates(index.grams)
    if not len(s):
        return
    h1, h2 = b.hashes(s)
    there, (other, row, pos, row2, pos2) = index.windows.lookup(h1)
    there &= other == h2
    s, h, row, pos, row2, pos2 = (x[there] for x in (s, h1, row, pos, row2, pos2))
    if not len(s):
        return
    which = np.searchsorted(b.ends, s, side="right")
    base = (b.ends - lens)[which]
    # a window's source is another place than its own
    own = (row == rows[which]) & (pos == s - base)
    row, pos = np.where(own, row2, row), np.where(own, pos2, pos).astype(np.int64)
    # runs of successive indexed windows of one document
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (which[1:] != which[:-1])]))
    run_end = np.repeat(np.append(new[1:], len(s)), np.diff(np.append(new, len(s))))
    run_start = np.repeat(new, np.diff(np.append(new, len(s))))
    i, done, doc = 0, 0, -1
    while i < len(s):
        if which[i] != doc:
            doc, done = int(which[i]), 0
        stop, at = int(run_end[i]), i
        run, k = index.blocks.around(int(row[i]), int(pos[i]))
        r, p, n = int(row[i]), int(pos[i]), _agree(h[i:stop], run[k:])
        while i + n < stop:  # the window across the boundary is indexed: its source may hold all of the factor
            t = i + n
            run, k = index.blocks.around(int(row[t]), int(pos[t]))
            back = _agree(h[i:t][::-1], run[max(0, k - n) : k][::-1])
            if back < n:
                break
            ahead = _agree(h[t:stop], run[k:])
            r, p, n = int(row[t]), int(pos[t]) - n, n + ahead
        start, end = int(s[i]), int(s[i]) + n - 1 + b.window
        yield max(start, done), end, r, p + max(start, done) - start
        done, at = end, i + n
        # go on at the factor's end, or at the last window across it
        i = int(np.searchsorted(s, end, side="right")) - 1
        if i < at or which[i] != doc:
            i = at


def _marks(texts: list, rows: np.ndarray, window: int, index: Index) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, whether each is in a factor) for each text, in order."""
    for at, docs, b in _batches(texts, window):
        step = np.zeros(len(b.h) + 1, np.int8)
        for lo, hi, _, _ in factor(b, index, rows[at : at + len(docs)], np.array([len(d) for d in docs])):
            step[lo] += 1  # factors don't overlap
            step[hi] -= 1
        mark = np.cumsum(step[:-1]) > 0
        for d, end in zip(docs, b.ends, strict=True):
            yield d, mark[end - len(d) : end]


def repeated_spans(docs: DataFrame, window: int = 35, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, source_row, source_word) of every factor, in word numbers, end exclusive; rows are numbered in
    order of monotonically_increasing_id."""
    rows = stable(docs).select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = build_index(rows.select("_row", "text"), window)

    def spans(batches):
        for pdf in batches:
            ids, numbers = pdf["doc_id"].tolist(), pdf["_row"].to_numpy()
            for at, texts, b in _batches(list(pdf["text"]), window):
                lens = np.array([len(t) for t in texts])
                found = list(factor(b, index, numbers[at : at + len(texts)], lens))
                lo, hi, row, pos = np.array(found, np.int64).reshape(-1, 4).T
                which = np.searchsorted(b.ends, lo, side="right")
                base = (b.ends - lens)[which]
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(ids[at + i]) else int(ids[at + i]) for i in which], "Int64"), "start": lo - base, "end": hi - base, "source_row": row, "source_word": pos})

    schema = "doc_id long, start long, end long, source_row long, source_word long"
    return rows.mapInPandas(spans, schema)


def kept_digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs."""
    rows = stable(docs).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    index = build_index(rows.select("_row", "text"), window)

    @F.pandas_udf("struct<n_words:long,n_removed:long,kept_sha256:string>")
    def digest(numbers: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for d, mark in _marks(list(texts), numbers.to_numpy(), window, index):
            n = int(mark.sum())
            kept = d if not n else [w for w, m in zip(d, mark.tolist(), strict=True) if not m]
            out.append((len(d), n, hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", digest("_row", "text").alias("r")).select("doc_id", "r.*")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: str, mark: np.ndarray) -> str:
    """text without its marked words and the blanks after them; unmarked text is left as it is."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    spans = [m.span() for m in _WORD.finditer(raw)]
    for run in np.split(np.flatnonzero(mark), np.flatnonzero(np.diff(np.flatnonzero(mark)) > 1) + 1):
        if len(run):
            out.append(raw[at : spans[run[0]][0]])
            at = spans[run[-1] + 1][0] if run[-1] + 1 < len(spans) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, window: int = 35, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with every repeated passage cut from its text; texts without one, and other columns, are unchanged,
    but that length_col, if named, gets the number of characters of each text that was cut."""
    docs = stable(docs)
    number = F.monotonically_increasing_id()
    index = build_index(docs.select(number.alias("_row"), F.col(text_col).alias("text")), window)

    @F.pandas_udf("string")
    def left(numbers: pd.Series, texts: pd.Series) -> pd.Series:
        release()
        whole = list(texts)
        marks = (m for _, m in _marks(whole, numbers.to_numpy(), window, index))
        out = pd.Series([t if t is None or not m.any() else cut(t, m) for t, m in zip(whole, marks, strict=True)], dtype=object)
        release()
        return out

    new = docs.withColumn(ROW, number).withColumn(ROW, left(F.col(ROW), F.col(text_col)))  # the cut text, until it takes the text's place
    if length_col:
        same, kind = F.col(ROW).eqNullSafe(F.col(text_col)), docs.schema[length_col].dataType
        new = new.withColumn(length_col, F.when(same, F.col(length_col)).otherwise(F.length(ROW).cast(kind)))
    return new.withColumn(text_col, F.col(ROW)).select(*quoted(docs.columns))


#: The rows of kept_digest for windows of 35 words in DuckDB SQL.
KEPT_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT r, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), hit AS (
  SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), cover AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM hit
), word AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN cover USING (r, p) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
