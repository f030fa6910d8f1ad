"""Interpolated modified Kneser-Ney model of order two or three, counted in Spark, kept as sorted hash arrays that workers map.

Counting: each task sorts the word pairs of its training documents and sends one block of (context, word, count) to each
bucket of contexts; a bucket merges its blocks, writes its pairs and contexts as sorted hash arrays to the shared
folder and sends on how many contexts each word follows, which is gathered by word in the same way. Frequent words
and lines weigh one entry a task. Discounts come from the counts of counts.
At order three, a bucket merges word triples by their middle word, and so knows how many words each pair follows (pairs
after the begin context: how often they occur); these are the counts c(vw) and c(v) of pairs then.

Probabilities: p(w|v) = max(c(vw) - D(c), 0)/c(v) + g(v) p(w), p(w) = max(k(w) - D'(k), 0)/K + g0/(V+1), with k(w) the
number of contexts of w, K their sum, V the distinct training tokens and one further place for all unknown ones;
so they sum to one. After an unknown context p(w) alone counts. Each text starts in a begin context and ends in an end token.
Order three: p(w|uv) = max(c(uvw) - D"(c), 0)/c(uv) + g(uv) p(w|v), and p(w|v) after an unknown pair or for a text's first token.
With pruned, triples that occur once are not stored, as usual for models of this order: their whole count goes to g(uv), so that
probabilities still sum to one. All counts, totals and discounts are taken before that, from all triples.

Buckets are as many as hold BUCKET_BYTES of text each. All that follows one word is in one bucket, but for frequent words,
those that fill HOT_BUCKETS buckets by a sample of some SAMPLE_BYTES of text: what follows these is dealt by the next word, and
the sums for them and the pairs that end in them are added up in the next step. The sample steers where things are
kept, not what is counted; frequent words are 1 / HOT_SHARE at most.

Defined results: null and empty texts are the end token alone; rows without a doc_id are learned from and scored;
repeated rows count each time; without training documents every probability is 1/(V+1) = 1; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, words
from .hashindex import HashIndex, bucket_of, write_bucket

FLUSH = 4_400_000
BATCH_WORDS = 300_000
BUCKET_BYTES = 16 << 20
HOT_BUCKETS, HOT_SHARE, SAMPLE_BYTES = 2, 1 / 65_536, 4 << 20
#: bits of a word's number in a sorted triple; more distinct words than that are flushed in parts
NUMBER = 21
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(s)) for s in (b"\x00 begin", b"\x00 end"))
_MIX = np.uint64(0x9E3779B97F4A7C15)
NONE = np.zeros(0, np.uint64)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v ^ (v >> np.uint64(31))) * _MIX + w
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def among(v: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each word is one of the sorted frequent ones."""
    return hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v if len(hot) else np.zeros(len(v), bool)


def place(v: np.ndarray, w: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    """The bucket of what is known of w after v."""
    b = bucket_of(v, buckets)
    if (often := among(v, hot)).any():
        b[often] = bucket_of(pair_key(v[often], w[often]), buckets)
    return b


def tables(buckets: int) -> int:
    """How many files the sums for frequent words are dealt to: fewer, as each bucket of triples sends rows to each."""
    return max(1, buckets // 16)


def frequent(texts: DataFrame, size: int, buckets: int) -> np.ndarray:
    """The sorted hashes of the words that are a larger share of a sample's words than HOT_BUCKETS buckets hold."""
    share = max(HOT_BUCKETS / buckets, HOT_SHARE)
    if not size or share >= 1:
        return NONE
    some = texts.select("text") if size <= SAMPLE_BYTES else texts.select("text").sample(SAMPLE_BYTES / size, 1)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = some.select(F.explode(F.split(low, r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    # the first row is the count of all words, its w being null
    total, *top = each.rollup("w").count().orderBy(F.desc("count"), F.col("w").asc_nulls_first()).limit(int(1 / share) + 1).collect() or [None]
    found = [r for r in top if r["count"] >= share * total["count"]]
    return np.sort(np.array([xxhash.xxh3_64_intdigest(r.w.encode()) for r in found], np.uint64))


def sequences(texts: list, limit: int = BATCH_WORDS):
    """(context hashes, word hashes, tokens per text) of runs of texts, each text ending in END."""
    held, lens, n = [], [], 0
    for t in texts:
        w = words(t, lower=True)
        held.append(w)
        lens.append(len(w) + 1)
        n += len(w) + 1
        if n >= limit:
            yield _sequence(held, lens, n)
            held, lens, n = [], [], 0
    if held:
        yield _sequence(held, lens, n)


def _sequence(held: list, lens: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(lens) - 1
    w = np.empty(n, np.uint64)
    inner = np.ones(n, bool)
    inner[ends] = False
    w[ends] = END
    w[inner] = np.fromiter((xxhash.xxh3_64_intdigest(x) for d in held for x in d), np.uint64, n - len(lens))
    v = np.concatenate([[BEGIN], w[:-1]]).astype(np.uint64)
    v[ends[:-1] + 1] = BEGIN
    return v, w, np.array(lens)


def before(v: np.ndarray) -> np.ndarray:
    """The words before contexts v, BEGIN for the first ones of a text."""
    return np.where(v == BEGIN, BEGIN, np.concatenate([[BEGIN], v[:-1]]).astype(np.uint64))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _short(c: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more in full behind."""
    return np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<u8").tobytes()


def _long(raw: memoryview, n: int) -> np.ndarray:
    c = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    big = c == 255
    c[big] = np.frombuffer(raw, "<u8", int(big.sum()), n)
    return c


def _dealt(to: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each bucket's entries begin, and the columns in the order of buckets."""
    if (to[1:] < to[:-1]).any():
        order = np.argsort(to, kind="stable")
        to, columns = to[order], [c[order] for c in columns]
    return np.searchsorted(to, np.arange(buckets + 1)), list(columns)


def _blocks(v: np.ndarray, w: np.ndarray, c: np.ndarray, buckets: int, hot: np.ndarray = NONE) -> pd.DataFrame:
    """Sorted distinct pairs as one blob a bucket: contexts, their numbers of words, words, counts."""
    ends, (v, w, c) = _dealt(place(v, w, buckets, hot), buckets, v, w, c)
    out = []
    for b in np.flatnonzero(np.diff(ends)):
        s = slice(ends[b], ends[b + 1])
        first = _runs(v[s])
        size = np.diff(np.append(first, ends[b + 1] - ends[b])).astype("<u4")
        head = np.array([len(first), ends[b + 1] - ends[b]], "<u8")
        out.append((int(b), b"".join([head.tobytes(), v[s][first].tobytes(), w[s].tobytes(), size.tobytes(), _short(c[s])])))
    return pd.DataFrame(out, columns=["bucket", "blob"])


def _unblock(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nv, n = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    v, w = np.frombuffer(blob, "<u8", nv, 16), np.frombuffer(blob, "<u8", n, 16 + 8 * nv)
    at = 16 + 8 * nv + 8 * n
    return np.repeat(v, np.frombuffer(blob, "<u4", nv, at)), w, _long(memoryview(blob)[at + 4 * nv :], n)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, compressed byte plane by byte plane."""
    press, head, out = zstandard.ZstdCompressor(level=1), [], []
    for x in arrays:
        x = x.astype(f"<u{max(1, -(-int(x.max(initial=0)).bit_length() // 8))}" if x.max(initial=0) < 1 << 16 else "<u4" if x.max() < 1 << 32 else "<u8")
        body = press.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
        head += [len(x), x.itemsize, len(body)]
        out.append(body)
    return np.array(head, "<u4").tobytes() + b"".join(out)


def _unsqueeze(blob: bytes, n: int) -> list[np.ndarray]:
    """The n arrays of _squeeze."""
    head, at, out, press = np.frombuffer(blob, "<u4", 3 * n).reshape(n, 3).tolist(), 12 * n, [], zstandard.ZstdDecompressor()
    for length, width, size in head:
        raw = press.decompress(blob[at : at + size], max_output_size=length * width) if length else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, length).T).view(f"<u{width}")[:, 0] if length else np.zeros(0, np.uint8))
        at += size
    return out


def _triple_blocks(v: np.ndarray, w: np.ndarray, buckets: int, hot: np.ndarray = NONE) -> Iterator[tuple[int, bytes]]:
    """The triples of a sequence, distinct and counted, as one blob a bucket of the middle word (and the last, after frequent
    ones): the words, contexts (v, u) and words by number, sizes of contexts, counts."""
    yield from _triples(v == BEGIN, w, buckets, hot)


def _triples(starts: np.ndarray, w: np.ndarray, buckets: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """_triple_blocks of words w, starts being where texts begin. Large arrays go as soon as they can."""
    all_words = np.append(w, BEGIN)
    order = np.argsort(all_words)
    ordered = all_words[order]
    del all_words
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    names = ordered[new]
    del ordered
    cw = np.empty(len(order), np.uint32)
    cw[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    del order, new
    if len(names) >> NUMBER:
        if half := int(np.searchsorted(np.flatnonzero(starts), len(w) // 2)):
            # texts stay whole: cut at the one that begins nearest after the middle
            cut = np.append(np.flatnonzero(starts), len(w))[half]
            if 0 < cut < len(w):
                yield from _triples(starts[:cut], w[:cut], buckets, hot)
                yield from _triples(starts[cut:], w[cut:], buckets, hot)
                return
    del w
    first, cw = cw[-1:], cw[:-1]
    # the word before is the one before in w, but where a text begins
    cv = np.where(starts, first, np.concatenate([first, cw[:-1]]))
    cu = np.where(starts, first, np.concatenate([first, cv[:-1]]))
    if len(names) >> NUMBER:  # one text of so many words: too wide for one number
        order = np.lexsort((cw, cu, cv))
        cv, cu, cw = cv[order], cu[order], cw[order]
        at = _runs(cv, cu, cw)
        c = np.diff(np.append(at, len(cv)))
        cv, cu, cw = cv[at], cu[at], cw[at]
    else:
        shift, low = np.uint64(NUMBER), np.uint64((1 << NUMBER) - 1)
        key = cv.astype(np.uint64)
        for x in (cu, cw):
            key <<= shift
            key |= x
        del cv, cu, cw, x
        key.sort()
        at = _runs(key)
        c = np.diff(np.append(at, len(key)))
        key = key[at]
        del at
        cw = (key & low).astype(np.uint32)
        key >>= shift
        cu = (key & low).astype(np.uint32)
        key >>= shift
        cv = key.astype(np.uint32)
        del key
    to = bucket_of(names, buckets)[cv]
    if (often := among(names, hot)[cv]).any():
        to[often] = bucket_of(pair_key(names[cv[often]], names[cw[often]]), buckets)
    ends, (cv, cu, cw, c) = _dealt(to, buckets, cv, cu, cw, c)
    del to, often
    for b in np.flatnonzero(np.diff(ends)):
        s = slice(ends[b], ends[b + 1])
        at = _runs(cv[s], cu[s])
        size = np.diff(np.append(at, ends[b + 1] - ends[b]))
        some, back = np.unique(np.concatenate([cv[s][at], cu[s][at], cw[s]]), return_inverse=True)
        yield int(b), _squeeze(names[some], back[: len(at)], back[len(at) : 2 * len(at)], back[2 * len(at) :], size, c[s])


def _untriple(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names, v, u, w, size, c = _unsqueeze(blob, 6)
    names, size = names.astype(np.uint64), size.astype(np.int64)
    return np.repeat(names[v], size), np.repeat(names[u], size), names[w], c.astype(np.int64)


def discounts(n: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from how many entries have count 1 to 4."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([d[0], *(float(np.clip(x, 0.01, k - 0.01)) for k, x in enumerate(d[1:], 1))])


STATS = ("types", "tokens", "vocabulary", "docs", "n1", "n2", "n3", "n4")


class Model:
    """The mapped arrays, and what is known of the whole corpus. stats, follow_stats and, at order three, triple_stats: as STATS."""

    def __init__(self, folders: dict[str, str], buckets: int, stats: list[int], follow_stats: list[int], triple_stats: list[int] | None = None, pruned: bool = False, hot: np.ndarray = NONE):
        dtypes = {"pairs": ["u8", "u1"], "big": ["u8", "u8"], "contexts": ["u8", "u8", "u4", "u4", "u4"], "follows": ["u8", "u8"], "hot": ["u8", "u8", "u8", "u8", "u8", "u8"]}
        if triple_stats:
            dtypes |= {"triples": ["u8", "u1"], "big3": ["u8", "u8"], "contexts3": ["u8", "u1"], "rich3": dtypes["contexts"], "hot3": ["u8", "u8", "u8", "u8", "u8"], "words": ["u8", "u8"]}
        self.index = {k: HashIndex(folders[k], tables(buckets) if k in ("hot", "hot3") else buckets, d) for k, d in dtypes.items()}
        self.hot = hot
        self.types, self.n, self.v, self.docs, *ones = stats
        self.d = discounts(ones)
        self.d3 = None
        if triple_stats:
            self.n, self.d3 = triple_stats[1], discounts(triple_stats[4:])
            # what a triple that occurs once leaves to the lower order
            self.once = 1.0 if pruned else self.d3[1]
        f = dict(zip(STATS, follow_stats, strict=True))
        self.d1 = discounts([f["n1"], f["n2"], f["n3"], f["n4"]])
        kinds = np.array([f["n1"], f["n2"], f["types"] - f["n1"] - f["n2"]])
        self.g0 = float(self.d1[1:] @ kinds) / self.types if self.types else 1.0

    def token_logs(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 p(w|v), count of w in training) for each token."""
        names, back = np.unique(np.concatenate([v, w]), return_inverse=True)
        _, (total, m1, m2, m3) = self.index["contexts"].lookup(names)
        often = among(names, self.hot)
        total[often], m1[often], m2[often], m3[often], times = self.index["hot"].lookup(names[often])[1]
        k = self.index["follows"].lookup(names)[1][0].astype(np.int64)
        lower = np.maximum(k - self.d1[np.minimum(k, 3)], 0) / max(1, self.types) + self.g0 / (self.v + 1)
        bv, bw = back[: len(v)], back[len(v) :]
        total = total.astype(np.float64)
        spare = np.where(total > 0, (self.d[1] * m1 + self.d[2] * m2 + self.d[3] * m3) / np.maximum(total, 1), 1.0)
        c = self._counts(v, v, w, "pairs", "big")
        p = np.maximum(c - self.d[np.minimum(c, 3)], 0) / np.maximum(total[bv], 1) + spare[bv] * lower[bw]
        if self.d3 is not None:
            h = pair_key(before(v), v)
            known, at, which = np.unique(h, return_index=True, return_inverse=True)
            where = bucket_of(v[at], self.index["contexts3"].buckets)
            code = self.index["contexts3"].lookup(known, where)[1][0].astype(np.int64)
            m1, m2, m3 = code // 15, code % 15, np.zeros(len(code), np.int64)
            all3 = m1 + 2 * m2
            if (rich := code == 255).any():
                all3[rich], m1[rich], m2[rich], m3[rich] = self.index["rich3"].lookup(known[rich], where[rich])[1]
            if (split := among(v[at], self.hot)).any():
                all3[split], m1[split], m2[split], m3[split] = self.index["hot3"].lookup(known[split])[1]
            spare = np.where(all3 > 0, (self.once * m1 + self.d3[2] * m2 + self.d3[3] * m3) / np.maximum(all3, 1), 1.0)
            c = self._counts(v, h, w, "triples", "big3")
            p = np.maximum(c - self.d3[np.minimum(c, 3)], 0) / np.maximum(all3[which], 1) + spare[which] * p
            total = self.index["words"].lookup(names)[1][0].astype(np.float64)
            total[often] = times
        count = total[bw]
        count[w == END] = self.docs
        return np.log10(p), count

    def _counts(self, v: np.ndarray, context: np.ndarray, w: np.ndarray, few: str, big: str) -> np.ndarray:
        """The count of each pair of a context and a word, in the bucket of v (and w, if v is frequent)."""
        keys, at, which = np.unique(pair_key(context, w), return_index=True, return_inverse=True)
        where = place(v[at], w[at], self.index[few].buckets, self.hot)
        c = self.index[few].lookup(keys, where)[1][0].astype(np.int64)
        many = c == 255
        if many.any():
            c[many] = self.index[big].lookup(keys[many], where[many])[1][0].astype(np.int64)
        return c[which]


def fit(texts: DataFrame, order: int = 2, pruned: bool = False) -> Model:
    """A model of the text column of all rows, of order two or three; pruned: without triples that occur once."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: two or three")
    degree = order
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    folders = {k: new_folder(spark, f"lm-{k}") for k in ("pairs", "big", "contexts", "follows", "triples", "big3", "contexts3", "rich3", "words", "hot", "hot3")}
    hot = frequent(texts, size, buckets)

    def count(batches):
        held, n = [], 0
        for pdf in batches:
            for v, w, _ in sequences(list(pdf["text"])):
                held.append((v == BEGIN if degree == 3 else v, w))
                n += len(v)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    def joined(held):
        out = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return out

    def flush(held):
        if degree == 3:
            return pd.DataFrame(_triples(*joined(held), buckets, hot), columns=["bucket", "blob"])
        v, w = joined(held)
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        first = _runs(v, w)
        return _blocks(v[first], w[first], np.diff(np.append(first, len(v))), buckets, hot)

    def ones(c: np.ndarray) -> list[int]:
        return [int((c == i).sum()) for i in range(1, 5)]

    def contexts_of(v: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        """The contexts of sorted distinct pairs, their counts, and how many words follow once, twice and more often."""
        at = _runs(v)
        kinds = [np.add.reduceat(x.astype("<u4"), at).astype("<u4") for x in (c == 1, c == 2, c > 2)]
        return [v[at], np.add.reduceat(c, at).astype("<u8"), *kinds]

    def send(first: int, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
        """Rows of a table of sums for frequent words, to the buckets of their keys, whose numbers begin at first."""
        table = np.stack([c.astype("<u8") for c in columns])
        table = table[:, np.argsort(table[0])]
        ends = np.searchsorted(bucket_of(table[0], tables(buckets)), np.arange(tables(buckets) + 1))
        return [(first + int(t), table[:, ends[t] : ends[t + 1]].tobytes()) for t in np.flatnonzero(np.diff(ends))]

    def add_up(blobs: pd.Series, width: int) -> list[np.ndarray]:
        """The columns of tables of sums: keys in order, and the sums over equal ones."""
        table = np.concatenate([np.frombuffer(x, "<u8").reshape(width, -1) for x in blobs], axis=1)
        table = table[:, np.argsort(table[0])]
        at = _runs(table[0])
        return [table[0][at], *(np.add.reduceat(c, at) for c in table[1:])]

    def write_counts(b: int, key: np.ndarray, c: np.ndarray, few: str, big: str) -> None:
        order = np.argsort(key)
        write_bucket(folders[few], b, [key[order], np.minimum(c[order], 255).astype("u1")])
        order = order[c[order] >= 255]
        write_bucket(folders[big], b, [key[order], c[order].astype("<u8")])

    def merge_triples(b: int, blobs: pd.Series) -> tuple:
        """Write a bucket's triples and their contexts; its pairs, their counts, how often each
        of their contexts occurs, and rows to send: the triples' statistics and sums for frequent words."""
        v, u, w, c = (np.concatenate(x) for x in zip(*map(_untriple, blobs), strict=True))
        order = np.lexsort((w, u, v))
        v, u, w, c = v[order], u[order], w[order], c[order]
        first = _runs(v, u, w)
        v, u, w, c = v[first], u[first], w[first], np.add.reduceat(c, first)
        times, out = np.add.reduceat(c, _runs(v)), []
        inner = v != BEGIN
        if inner.any():
            h, c3 = pair_key(u[inner], v[inner]), c[inner]
            some = c3 > 1 if pruned else np.ones(len(c3), bool)
            write_counts(b, pair_key(h[some], w[inner][some]), c3[some], "triples", "big3")
            context = contexts_of(h, c3)
            if (often := among(v[inner][_runs(h)], hot)).any():
                out += send(buckets, [x[often] for x in context])
                context = [x[~often] for x in context]
            order = np.argsort(context[0])
            if pruned:  # contexts of pruned triples alone leave all to the lower order, as unknown ones do
                order = order[(context[3] + context[4])[order] > 0]
            key, total, m1, m2, m3 = context = [x[order] for x in context]
            # few words, each once or twice, are the usual case: one byte
            plain = (m3 == 0) & (m1 < 17) & (m2 < 15)
            write_bucket(folders["contexts3"], b, [key, np.where(plain, m1 * 15 + m2, 255).astype("u1")])
            write_bucket(folders["rich3"], b, [x[~plain] for x in context])
        stats = [int(inner.sum()), int(c.sum()), 0, 0, *ones(c[inner])]
        order = np.lexsort((w, v))
        v, w, c = v[order], w[order], c[order]
        first = _runs(v, w)
        n = np.where(v[first] == BEGIN, np.add.reduceat(c, first), np.diff(np.append(first, len(v))))
        return v[first], w[first], n, times, [*out, (-2, np.array(stats, "<u8").tobytes())]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iat[0])
        if degree == 3:
            v, w, c, times, out = merge_triples(b, pdf["blob"])
        else:
            v, w, c = (np.concatenate(x) for x in zip(*map(_unblock, pdf["blob"]), strict=True))
            order = np.lexsort((w, v))
            v, w, c = v[order], w[order], c[order]
            first = _runs(v, w)
            c = np.add.reduceat(c, first)
            v, w, out = v[first], w[first], []
        at = _runs(v)
        context = contexts_of(v, c)
        total = context[1].astype(np.int64)
        times = times if degree == 3 else total
        often = among(v[at], hot)
        write_bucket(folders["contexts"], b, [x[~often] for x in context])
        if degree == 3:
            write_bucket(folders["words"], b, [v[at][~often], times[~often].astype("<u8")])
        if often.any():
            out += send(2 * buckets, [x[often] for x in (*context, times)])
        write_counts(b, pair_key(v, w), c, "pairs", "big")
        docs = int(total[v[at] == BEGIN].sum())
        stats = [len(v), int(total.sum()), int((~often).sum()) - (docs > 0), docs, *ones(c)]
        out.append((-1, np.array(stats, "<u8").tobytes()))
        w, n = np.unique(w, return_counts=True)
        ends = np.searchsorted(bucket_of(w, buckets), np.arange(buckets + 1))
        for t in np.flatnonzero(np.diff(ends)):
            s = slice(ends[t], ends[t + 1])
            out.append((int(t), np.array([ends[t + 1] - ends[t]], "<u8").tobytes() + w[s].tobytes() + _short(n[s])))
        return pd.DataFrame(out, columns=["bucket", "blob"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iat[0])
        if b < 0:
            stats = np.sum([np.frombuffer(x, "<u8") for x in pdf["blob"]], axis=0)
        elif b >= 2 * buckets:
            table = add_up(pdf["blob"], 6)
            write_bucket(folders["hot"], b - 2 * buckets, table)
            stats = [0, 0, len(table[0]), 0, 0, 0, 0, 0]
        elif b >= buckets:
            table = add_up(pdf["blob"], 5)
            if pruned:  # as with the contexts of other words
                table = [x[table[3] + table[4] > 0] for x in table]
            write_bucket(folders["hot3"], b - buckets, table)
            stats = [0] * len(STATS)
        else:
            ws, ns = [], []
            for x in pdf["blob"]:
                m = int(np.frombuffer(x, "<u8", 1)[0])
                ws.append(np.frombuffer(x, "<u8", m, 8))
                ns.append(_long(memoryview(x)[8 + 8 * m :], m))
            w, n = np.concatenate(ws), np.concatenate(ns)
            order = np.argsort(w)
            w, n = w[order], n[order]
            first = _runs(w)
            n = np.add.reduceat(n, first)
            write_bucket(folders["follows"], b, [w[first], n.astype("<u8")])
            stats = [len(n), 0, 0, 0, *ones(n)]
        return pd.DataFrame({"level": [{-2: 3, -1: 2}.get(b, 1 if b < 2 * buckets else 2)], "stats": [np.array(stats, "<u8").tobytes()]})

    sent = "bucket int, blob binary"
    merged = texts.select("text").mapInPandas(count, sent).groupBy("bucket").applyInPandas(merge, sent)
    sums = {level: np.zeros(len(STATS), np.int64) for level in (1, 2, 3)}
    for r in merged.groupBy("bucket").applyInPandas(gather, "level int, stats binary").toLocalIterator():
        sums[r.level] += np.frombuffer(r.stats, "<u8").astype(np.int64)
    whole = sums[2]
    whole[2] += whole[3] > 0
    return Model(folders, buckets, whole.tolist(), sums[1].tolist(), sums[3].tolist() if degree == 3 else None, pruned, hot)


def score_texts(docs: DataFrame, modulus: int = 7, held_out: int = 2, order: int = 2, pruned: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held_out, F.lit(False))
    model = fit(docs.where(~fold), order, pruned)

    @F.pandas_udf("struct<n_tokens:long,n_known:long,base_score:double,score:double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for v, w, lens in sequences(list(texts)):
            logs, count = model.token_logs(v, w)
            base = np.log10((count + 1) / (model.n + model.v + 1))
            at = np.cumsum(lens) - lens
            parts.append([lens, np.add.reduceat((count > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(logs, at)])
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[]] * 4
        return pd.DataFrame(dict(zip(["n_tokens", "n_known", "base_score", "score"], cols, strict=True)))

    out = docs.select("doc_id", fold.alias("held_out"), score("text").alias("r"))
    return out.select("doc_id", "held_out", "r.n_tokens", "r.n_known", F.lit(model.n).cast("long").alias("train_tokens"), "r.base_score", "r.score")
