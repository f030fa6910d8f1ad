"""SimHash near-duplicates by vantage-point partitioning.

Fingerprints are 64-bit majority votes over XXH64 (seed 42) of word shingles. A vantage-point tree, built on the
driver from a small hash-chosen share of the distinct fingerprints, cuts Hamming space into shards: at a node with
vantage point p and radius m, fingerprints with d(p, x) <= m go inside, the others outside, and by the triangle
inequality an outside one can only have a partner inside if d(p, x) <= m + r; those are sent to both sides.
So each pair within r meets in some shard, where it is found by exact comparison. A shard that stays large (a dense
group, or a radius at which bounds prune too little to split it) is dealt out as pairs of blocks. A shard returns a spanning forest of its
links, not all pairs; components are then found over all shards.

Defined results: null and empty texts have fingerprint 0, linked like any other; fewer words than a shingle give one
shingle; repeated rows are rows of their own; rows with a null doc_id take part, and a component's id is the smallest
non-null one; an empty table gives an empty result; only the two named columns of the input are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, broadcast_if_small, connected_components, materialize, new_folder, open_folder, put_file, quoted, release, stable, words

SEED = 42
CHUNK = 1 << 16
#: values of shingle sets in a file of them: 16 MB
BLOCK_SHINGLES = 1 << 21


def shingles(w: list[bytes], k: int) -> list[bytes]:
    """k-word shingles joined by a space, repeats included; fewer words give the whole sequence, none give none."""
    if len(w) < k:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)))


def _hashes(w: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of w, repeats included, in parts."""
    for at in range(0, max(1, len(w) - k + 1), CHUNK):
        part = shingles(w[at : at + CHUNK + k - 1], k)
        yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))


def _majority(parts: Iterable[np.ndarray]) -> int:
    """Bit set where over half of the hashes have it; 0 for none."""
    votes, n = np.zeros(64, np.int64), 0
    for h in parts:
        for b in range(0, len(h), 4096):
            bits = np.unpackbits(h[b : b + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprint(text: str | None, k: int = 3) -> int:
    """The SimHash of a text, unsigned: bit set where over half of the shingle hashes have it."""
    return _majority(_hashes(words(text, lower=True), k))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    found = np.zeros(0, np.uint64)
    for h in _hashes(words(text, lower=True), k):
        found = np.union1d(found, h)
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, k: int, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep plus fp long (the fingerprint's bits as signed)."""

    @F.pandas_udf("long")
    def vote(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, k)) for t in texts], dtype="int64")

    return docs.select(*(keep or []), vote(F.col(text_col)).alias("fp"))


#: sample fingerprints of a text, and shingles in a sample: texts of similarity 0.8 have no equal one in 1 of 3e7 pairs
SAMPLES, SAMPLED = 24, 3
_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, (SAMPLES, SAMPLED), dtype=np.uint64) | np.uint64(1)
_TABLE = np.random.default_rng(12).integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def sample_fingerprints(h: np.ndarray) -> np.ndarray:
    """SAMPLES fingerprints of a set of shingle hashes: each is the SimHash of SAMPLED shingles that lie first in orders
    of their own (a product with an odd number is an order of all hashes). Sets of similarity J have a sample in common
    with probability J to the power of SAMPLED. Fingerprints of different samples are told apart by a mark."""
    first = np.full(_ODD.shape, ~np.uint64(0))
    for at in range(0, len(h), 4096):
        np.minimum(first, (h[at : at + 4096, None, None] * _ODD).min(axis=0), out=first)
    x, y, z = first.T
    return ((x & y | x & z | y & z) ^ _TABLE).view(np.int64)


def set_fingerprints(docs: DataFrame, k: int, text_col: str, keep: list[str]) -> DataFrame:
    """docs' columns in keep plus fp long (each distinct shingle votes once), size int (distinct shingles) and samples
    (sample_fingerprints; null for no shingles): equal shingle sets have equal ones."""

    @F.pandas_udf("struct<fp:long,size:int,samples:array<long>>")
    def vote(texts: pd.Series) -> pd.DataFrame:
        release()
        fp, size, samples = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32), []
        for i, t in enumerate(texts):  # one set at a time is held
            h = shingle_set(t, k)
            fp[i], size[i] = _signed(_majority([h])), len(h)
            samples.append(sample_fingerprints(h) if len(h) else None)
        release()
        return pd.DataFrame({"fp": fp, "size": size, "samples": pd.Series(samples, dtype=object)})

    return docs.select(*keep, vote(F.col(text_col)).alias("_v")).select(*keep, "_v.*")


class VPTree:
    """Nodes (vantage point, radius, inside, outside); leaves are shard numbers, with about how many rows each gets.

    sample stands for `share` times as many rows. A node is split as long as it has over leaf_rows rows and bounds prune
    enough for its two sides to hold 1.4 times its rows at most."""

    def __init__(self, sample: np.ndarray, share: float, radius: int, leaf_rows: int):
        self.r, self.point, self.mu, self.inside, self.outside, self.rows = radius, [], [], [], [], []
        self._share, self._leaf = share, leaf_rows
        self.root = self._grow(np.unique(sample))

    def _grow(self, x: np.ndarray) -> int:
        rows = len(x) * self._share
        best = None
        if rows > self._leaf and len(x) >= 8:
            for p in x[:: max(1, len(x) // 7)][:8]:
                d = np.bitwise_count(x ^ p)
                for mu in np.unique(np.percentile(d, (35, 50, 65)).astype(int)):
                    near, far = int((d <= mu + self.r).sum()), int((d > mu).sum())
                    if 0 < (d <= mu).sum() < len(x) and near + far <= 1.4 * len(x) and (best is None or near**2 + far**2 < best[0]):
                        best = (near**2 + far**2, p, int(mu), d)
        if best is None or best[0] > 0.9 * len(x) ** 2:
            self.rows.append(rows)
            return -len(self.rows)
        _, p, mu, d = best
        at = len(self.point)
        self.point.append(p), self.mu.append(mu), self.inside.append(0), self.outside.append(0)
        self.inside[at] = self._grow(x[d <= mu + self.r])
        self.outside[at] = self._grow(x[d > mu])
        return at

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions in x) for every shard that x reaches; bounds prune the others."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            d = np.bitwise_count(x[rows] ^ self.point[node])
            todo.append((self.inside[node], rows[d <= self.mu[node] + self.r]))
            todo.append((self.outside[node], rows[d > self.mu[node]]))


class _Joined:
    """Which of n things are joined so far, as labels."""

    def __init__(self, n: int):
        self.label, self.members = np.arange(n), {}

    def join(self, a: int, b: int) -> bool:
        """Join the sets of a and b; False if they were one."""
        la, lb = self.label[a], self.label[b]
        if la == lb:
            return False
        ma, mb = self.members.pop(la, [la]), self.members.pop(lb, [lb])
        if len(ma) < len(mb):
            la, ma, mb = lb, mb, ma
        self.label[mb] = la
        ma.extend(mb)
        self.members[la] = ma
        return True


def _near(f: np.ndarray, side: np.ndarray | None, radius: int) -> Iterator[tuple]:
    """(i, j, distance) of the pairs i < j within radius, by chunks of rows, i ascending in each; with side, of side 0
    and side 1 only."""
    n = len(f)
    step = max(1, (1 << 21) // max(1, n))
    for at in range(0, n, step):
        d = np.bitwise_count(f[at : at + step, None] ^ f[None, at:])
        i, j = np.nonzero(d <= radius)
        keep = j > i
        if side is not None:
            keep &= side[i + at] != side[j + at]
        yield i[keep] + at, j[keep] + at, d[i[keep], j[keep]]


#: rows of a shard above which the executor that searches it grows a tree of its own
SPLIT_ROWS = 4096


def _forest(f: np.ndarray, side: np.ndarray | None, radius: int) -> list:
    """Links (i, j) among f that make up a spanning forest; with side, of the links between side 0 and side 1 only."""
    joined, out = _Joined(len(f)), []
    tree = VPTree(f[:: max(1, len(f) // SPLIT_ROWS)], max(1, len(f) // SPLIT_ROWS), radius, SPLIT_ROWS // 16) if len(f) > SPLIT_ROWS else None
    for _, rows in tree.route(f) if tree else [(0, np.arange(len(f)))]:
        for i, j, dist in _near(f[rows], None if side is None else side[rows], radius):
            order = np.argsort(dist, kind="stable")
            for a, b in zip(rows[i[order]].tolist(), rows[j[order]].tolist(), strict=True):
                if joined.join(a, b):
                    out.append((a, b))
    return out


def write_sets(texts: DataFrame, k: int, uri: str) -> DataFrame:
    """(node, file, start): in which file below uri, and after how many values, the shingle set of each text (node, text) is."""

    def put(nodes, starts, sets):
        file = uuid.uuid4().int >> 65
        put_file(uri, f"{file:016x}", sets)
        return pd.DataFrame({"node": nodes, "file": file, "start": starts})

    def write(batches):
        for pdf in batches:
            nodes, starts, sets, n = [], [], [], 0
            for node, text in zip(pdf["node"].tolist(), pdf["text"], strict=True):
                h = shingle_set(text, k)
                nodes.append(node), starts.append(n), sets.append(h.tobytes())
                n += len(h)
                if n >= BLOCK_SHINGLES:
                    yield put(nodes, starts, sets)
                    nodes, starts, sets, n = [], [], [], 0
            if nodes:
                yield put(nodes, starts, sets)
            del nodes, starts, sets
            release()

    return texts.select("node", "text").mapInPandas(write, "node long, file long, start long")


def read_sets(uri: str, file: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sets that write_sets wrote, one after the other."""
    fs, path = open_folder(uri)
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(int(ends[-1]), np.uint64)
    order = np.argsort(file, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(file[order])) + 1):
        with fs.open_input_file(f"{path}/{int(file[rows[0]]):016x}") as f:
            for r in rows:
                out[ends[r] - size[r] : ends[r]] = np.frombuffer(f.read_at(int(size[r]) * 8, int(start[r]) * 8), np.uint64)
    return out


#: distinct fingerprints of the tree's sample, which the driver holds
TREE_SAMPLE = 100_000


def hamming_links(items: DataFrame, radius: int, leaf_rows: int = 2048, block_rows: int = 1 << 18, sample_rows: int = TREE_SAMPLE) -> DataFrame:
    """Edges (a, b) of nodes that connect exactly what pairs within radius connect.

    items: node long, fp long, one row a node, from a written table. The driver holds a sample of about sample_rows
    fingerprints. A shard of over SPLIT_ROWS rows is cut by a tree of its own where it is searched, and one of over
    block_rows is dealt out as pairs of blocks.
    """
    n = items.count()
    one_in = max(1, n // sample_rows)
    chosen = items.where(F.pmod(F.xxhash64(F.lit("vp"), "fp"), F.lit(one_in)) == 0).select("fp").distinct()
    sample = np.array([r.fp for r in chosen.collect()], np.int64).view(np.uint64)
    tree = VPTree(sample, one_in, radius, leaf_rows)
    bc = items.sparkSession.sparkContext.broadcast(tree)

    def deal(batches):
        tree = bc.value
        for pdf in batches:
            if not len(pdf):
                continue
            x, node = pdf["fp"].to_numpy(), pdf["node"].to_numpy()
            spread = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            out = []
            for shard, rows in tree.route(x.view(np.uint64)):
                k = max(1, int(np.ceil(tree.rows[shard] / block_rows)))
                block = (spread[rows] % np.uint64(k)).astype(np.int32)
                for t in range(k):
                    out.append((np.full(len(rows), shard), np.minimum(block, t), np.maximum(block, t), node[rows], x[rows], block))
            yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(("shard", "i", "j", "node", "fp", "block"), zip(*out, strict=True), strict=True)})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        side = pdf["block"].to_numpy() if pdf["i"].iat[0] != pdf["j"].iat[0] else None
        a, b = np.array(_forest(pdf["fp"].to_numpy().view(np.uint64), side, radius), np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": node[a], "b": node[b]})

    dealt = items.select("node", "fp").mapInPandas(deal, "shard long, i int, j int, node long, fp long, block int")
    return dealt.groupBy("shard", "i", "j").applyInPandas(search, "a long, b long").distinct()


#: rows in a block of a group, rows in a task's table of groups, shingles that a task holds at once, fingerprints of the first round
GROUP_ROWS, TASK_ROWS, HELD_SHINGLES, FIRST_SAMPLES = 1024, 8192, 1 << 20, 4
#: fingerprints of two texts of similarity 0.8 differ in about 10 bits, in over this many in fewer than 1 of 1e7 pairs
FAR = 26


def _candidates(part: dict[str, np.ndarray], similarity: float, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs to verify: of one cell (and of different sides, where there are sides 1 and 2) and different
    components, whose sizes and fingerprints allow the similarity; once: and which share no earlier sample. Rows come
    in order of cell."""
    left, right = [], []
    cell, fp, size, comp = (part[c] for c in ("cell", "fp", "size", "component"))
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    for lo, hi in zip(begin, np.append(begin[1:], len(cell)), strict=True):
        side = part["side"][lo:hi]
        x, y = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if side.any() else (np.arange(hi - lo),) * 2
        if not len(x) or not len(y) or hi - lo < 2:
            continue
        x, y = x + lo, y + lo
        ok = np.bitwise_count(fp[x, None] ^ fp[y]) <= FAR
        ok &= comp[x, None] != comp[y]
        ok &= np.minimum(size[x, None], size[y]) >= similarity * np.maximum(size[x, None], size[y])
        i, j = np.nonzero(ok if side.any() else np.triu(ok, 1))
        left.append(x[i]), right.append(y[j])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    if once:
        samples, own = part["samples"], part["sample"]
        done = np.zeros(len(i), bool)
        for at in range(samples.shape[1]):  # the first equal sample is the one whose cell has to do the work
            equal = samples[i, at] == samples[j, at]
            mine = samples[i, at] == own[i]
            keep = ~equal | mine | done
            done |= equal & mine
            i, j, done = i[keep], j[keep], done[keep]
    return i, j


def _verified(i: np.ndarray, j: np.ndarray, size: np.ndarray, load, similarity: float) -> list:
    """Those pairs, as a forest, whose sets (load: the sets of some rows, one after the other) are similar. Pairs whose ends
    are joined already aren't looked at. At most HELD_SHINGLES are held at once, or two sets."""
    joined, out = _Joined(len(size)), []
    i, j = np.minimum(i, j), np.maximum(i, j)
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    at, step = 0, 1 << 16
    while at < len(i):
        to = min(len(i), at + step)
        rows = np.unique(np.concatenate([i[at:to], j[at:to]]))
        if to - at > 1 and size[rows].sum() > HELD_SHINGLES:
            step = max(1, (to - at) // 4)
            continue
        n = size[rows]
        begin = np.cumsum(n) - n
        ids = np.unique(load(rows), return_inverse=True)[1]
        mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
        x, y = np.searchsorted(rows, i[at:to]), np.searchsorted(rows, j[at:to])
        first = np.flatnonzero(np.diff(x, prepend=-1))
        for lo, hi in zip(first, np.append(first[1:], len(x)), strict=True):
            a, others = int(x[lo]), y[lo:hi]
            others = others[joined.label[rows[others]] != joined.label[rows[a]]]
            if not len(others):
                continue
            own, m = ids[begin[a] : begin[a] + n[a]], n[others]
            ends = np.cumsum(m)
            mark[own] = True
            shared = np.add.reduceat(mark[ids[np.repeat(begin[others] - (ends - m), m) + np.arange(ends[-1])]], ends - m, dtype=np.int64)
            mark[own] = False
            for b in others[shared >= similarity * (n[a] + m - shared)].tolist():
                if joined.join(int(rows[a]), int(rows[b])):
                    out.append((int(rows[a]), int(rows[b])))
        at, step = to, min(1 << 16, step * 2)
    return out


def _search(cells: DataFrame, count: int, folder: str, similarity: float, once: bool) -> DataFrame:
    """Edges (a, b) found in cells (sample, x, y, node, side, component, fp, size, file, start, and if once samples and at: which
    of these is the one in group sample). Samples are compared as they are, but for that one: a pair that has an earlier one
    in common is left to that one's group, and one whose samples are only near each other is verified here."""
    tasks = max(1, -(-count // TASK_ROWS))
    names = ["node", "fp", "size", "side", "component", "file", "start", "sample"]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sample", "x", "y"], ignore_index=True)
        keys = pdf[["sample", "x", "y"]].to_numpy()
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
        begin = np.append(np.flatnonzero(new), len(pdf))
        out, at = [], 0
        while at < len(begin) - 1:  # some cells together
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + 2 * GROUP_ROWS, side="right")) - 1)
            part = pdf.iloc[begin[at] : begin[to]]
            col = {c: part[c].to_numpy() for c in names} | {"cell": np.cumsum(new[begin[at] : begin[to]])}
            col["fp"] = col["fp"].view(np.uint64)
            if once:
                col["samples"] = np.stack(part["samples"].to_numpy())
                col["samples"][np.arange(len(part)), part["at"].to_numpy()] = col["sample"]
            i, j = _candidates(col, similarity, once)
            if len(i):  # a node's set is read once for all its rows here
                used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                nodes, where, which = np.unique(col["node"][used], return_index=True, return_inverse=True)
                file, start, size = (col[c][used][where] for c in ("file", "start", "size"))
                load = lambda r, f=file, s=start, n=size: read_sets(folder, f[r], s[r], n[r])
                found = _verified(which[back[: len(i)]], which[back[len(i) :]], size.astype(np.int64), load, similarity)
                out += [(int(nodes[a]), int(nodes[b])) for a, b in found]
            at = to
        release()
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": a, "b": b})

    dealt = cells.withColumn("task", F.pmod(F.xxhash64("sample", "x", "y"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(search, "a long, b long").distinct()


#: a shard of the driver's tree has one in so many fingerprints, or SHARD_ROWS if that is less; links up to which the driver joins them
TREE_SHARE, SHARD_ROWS, DRIVER_LINKS = 64, 1 << 20, 1 << 16


def few_components(links: DataFrame) -> DataFrame:
    """connected_components of so few links that the driver holds them: without its rounds of jobs."""
    nodes, ends = np.unique(np.array([tuple(r) for r in links.select("a", "b").collect()], np.int64), return_inverse=True)
    joined, least = _Joined(len(nodes)), np.full(len(nodes), len(nodes))
    for a, b in ends.reshape(-1, 2).tolist():
        joined.join(a, b)
    np.minimum.at(least, joined.label, np.arange(len(nodes)))
    return links.sparkSession.createDataFrame(list(zip(nodes.tolist(), nodes[least[joined.label]].tolist(), strict=True)), "node long, component long")


def fingerprint_groups(each: DataFrame, radius: int) -> DataFrame:
    """each (node long, i int, sample long: a fingerprint) with group long and n, the rows in it; rows alone in a group are left out.

    A group is what pairs of fingerprints within radius connect. Equal ones are one point of the vantage-point tree,
    which finds the pairs of all others."""
    points = materialize(each.groupBy("sample").agg(F.count(F.lit(1)).alias("n")))
    leaf = min(SHARD_ROWS, max(2048, points.count() // TREE_SHARE))
    links = materialize(hamming_links(points.select(F.col("sample").alias("node"), F.col("sample").alias("fp")), radius, leaf, 2 * SHARD_ROWS, TREE_SHARE << 8))
    comp = (few_components if links.count() <= DRIVER_LINKS else connected_components)(links).select(F.col("node").alias("sample"), F.col("component").alias("group"))
    linked = materialize(points.join(broadcast_if_small(comp), "sample"))
    sums = linked.groupBy("group").agg(F.sum("n").alias("n"))
    linked = materialize(linked.select("sample", "group").join(sums, "group").select("sample", "group", "n"))
    alone = points.where("n > 1").join(broadcast_if_small(linked.select("sample")), "sample", "left_anti")
    return each.join(alone.select("sample", F.col("sample").alias("group"), "n").union(linked), "sample")


def similar_links(items: DataFrame, texts: DataFrame, k: int, similarity: float, radius: int = 1) -> DataFrame:
    """Edges (a, b) of nodes that connect what pairs of shingle sets of at least the similarity connect.

    items: node long, fp, size, samples of set_fingerprints, from a written table; texts: (node, text) of the same
    nodes. The vantage-point tree is searched for all fingerprints, those of whole texts and of samples: nodes with
    fingerprints within radius are a group (see fingerprint_groups). First, groups of the first FIRST_SAMPLES fingerprints (the whole
    text's comes first) are cut into blocks, and pairs
    within a block verified: that joins most of what belongs together. Then pairs of nodes that are not joined yet are
    verified in the first of their groups: the group's largest component is cut into blocks, and so are its other
    nodes, and each block of these meets each other one. So a large group of near-copies costs its size, and only one of
    many texts that are unlike, but share a sample, the square of its size.
    """
    items = items.where("size > 0").withColumn("samples", F.concat(F.array("fp"), "samples"))
    each = items.select("node", F.posexplode("samples").alias("i", "sample"))
    shared = materialize(fingerprint_groups(each, radius).select(F.col("group").alias("sample"), "node", "i", "n"))
    ends = materialize(shared.select("node").distinct())
    folder = new_folder(items.sparkSession, "shingle-sets")
    places = materialize(write_sets(texts.join(broadcast_if_small(ends), "node", "left_semi"), k, folder))
    near = materialize(places.join(items, "node"))
    blocks = lambda n: F.ceil(F.col(n) / GROUP_ROWS).cast("int")
    block = lambda n: F.pmod(F.xxhash64("node", "i"), blocks(n)).cast("int")
    zero, none = F.lit(0), F.lit(-1)
    early = shared.where(F.col("i") < FIRST_SAMPLES).select("sample", "node", block("n").alias("x"), zero.alias("y"), zero.alias("side"), F.col("node").alias("component"))
    first = materialize(_search(early.join(near.drop("samples"), "node"), early.count(), folder, similarity, False))
    comp = materialize(connected_components(first))
    labelled = materialize(shared.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    parts = labelled.groupBy("sample", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = parts.groupBy("sample").agg(F.max(F.struct("m", "component")).alias("l"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("c")).where("c > 1")
    open_ = materialize(labelled.join(largest.select("sample", F.col("l.component").alias("main"), F.col("l.m").alias("m"), (F.col("all") - F.col("l.m")).alias("rest")), "sample"))
    main = open_.where("component = main")
    rest = open_.where("component <> main")
    cell = lambda df, x, y, side: df.select("sample", "node", F.col("i").alias("at"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"), "component")
    upto = lambda n: F.explode(F.sequence(zero, blocks(n) - 1))
    a = cell(main.withColumn("t", upto("rest")), block("m"), F.col("t"), F.lit(1))
    b = cell(rest.withColumn("t", upto("m")), F.col("t"), block("rest"), F.lit(2))
    # other nodes among themselves: blocks i <= j, at x = -1 - i
    mine = rest.withColumn("own", block("rest")).withColumn("t", upto("rest"))
    side = F.when(F.col("own") == F.col("t"), 0).when(F.col("own") < F.col("t"), 1).otherwise(2)
    c = cell(mine, none - F.least("own", "t"), F.greatest("own", "t"), side)
    cells = materialize(a.union(b).union(c))
    return first.union(_search(cells.join(near, "node"), cells.count(), folder, similarity, True)).distinct()


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; see the module's docstring."""
    fps = fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, "text", ["doc_id"])
    fps = materialize(fps)
    items = materialize(fps.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")))
    links = hamming_links(items.select("node", F.col("node").alias("fp")), radius)
    comp = materialize(connected_components(links))
    joined = items.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = materialize(joined)
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = materialize(joined.join(least, "component").select(F.col("node").alias("fp"), "component_id"))
    return fps.join(ids, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 1) -> DataFrame:
    """docs without near-copies: of each group the row with the smallest doc_id stays (nulls last, of several one), all columns kept.

    A group is joined by links between texts whose sets of k-word shingles (lower case, 64-bit hashes) have a Jaccard
    similarity of at least similarity. Candidates are texts of which the vantage-point tree finds two fingerprints within radius: those
    of whole texts, or those of one sample (see sample_fingerprints). Each is verified on the sets. At 0.8 whole texts'
    fingerprints differ in some 10 bits, where no bounds prune; samples' are then equal, so that a small radius will do. Over
    FAR bits between those of whole texts rule out most unlike pairs.

    Equal texts (128-bit hash) are one node. Null is empty; texts without words are linked to equal ones only; texts of
    fewer words than a shingle have one; very long texts have all their shingles; an empty table gives none.
    """
    docs = stable(docs)
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    slim = numbered.select(F.col(ROW).alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    slim = slim.withColumn("_key", F.unhex(F.md5(F.col("_text").cast("binary"))))
    rows = materialize(set_fingerprints(slim, k, "_text", ["_row", "_id", "_key"]))
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    items = rows.groupBy("_key").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("samples").alias("samples"))
    items = materialize(items.withColumn("node", F.monotonically_increasing_id()))
    one = items.select(F.col("first.row").alias("_row"), "node")
    texts = slim.select("_row", F.col("_text").alias("text")).join(one, "_row").select("node", "text")
    comp = connected_components(similar_links(items.select("node", "fp", "size", "samples"), texts, k, similarity, radius))
    groups = materialize(items.select("node", "_key", "first").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    kept = groups.groupBy("component").agg(F.min("first").alias("first")).select("component", F.col("first.row").alias("_keep"))
    keep = materialize(groups.join(kept, "component").select("_key", "_keep"))
    gone = materialize(rows.select("_row", "_key").join(keep, "_key").where("_row <> _keep").select(F.col("_row").alias(ROW)))
    return numbered.join(broadcast_if_small(gone), ROW, "left_anti").select(*quoted(docs.columns))
