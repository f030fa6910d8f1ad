"""Sorted hash arrays in the shared folder, one file a bucket of the hash space, memory-mapped by workers."""

from __future__ import annotations

import io

import numpy as np
import pyarrow.fs as pafs

from .common import open_folder, put_file


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: equal ranges of the hash space, in order."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def write_bucket(uri: str, bucket: int, columns: list[np.ndarray]) -> None:
    """columns[0] are ascending hashes; the others belong to them. Nothing is written for no rows."""
    if len(columns[0]):
        put_file(uri, f"b{bucket:06d}", [np.ascontiguousarray(c).tobytes() for c in columns])


#: bytes of buckets that a worker holds of an index whose store can't be mapped
HELD_BYTES = 256 << 20


class HashIndex:
    """Looks hashes up in the files of a folder, mapped where the store allows, else read and held up to HELD_BYTES.
    dtypes: of the columns, the first being uint64."""

    def __init__(self, uri: str, buckets: int, dtypes: list[str]):
        self.uri, self.buckets, self.dtypes = uri, buckets, [np.dtype(d) for d in dtypes]
        self._open: dict[int, list[np.ndarray]] = {}
        self._there: set[str] | None = None
        self._held = 0

    def columns(self, bucket: int) -> list[np.ndarray]:
        if bucket not in self._open:
            fs, path = open_folder(self.uri)
            if self._there is None:
                self._there = {x.base_name for x in fs.get_file_info(pafs.FileSelector(path))}
            if (name := f"b{bucket:06d}") not in self._there:
                raw = np.zeros(0, np.uint8)
            elif isinstance(fs, pafs.LocalFileSystem):
                raw = np.memmap(f"{path}/{name}", np.uint8, "r")
            else:
                with fs.open_input_file(f"{path}/{name}") as f:
                    raw = np.frombuffer(f.read(), np.uint8)
                self._held += len(raw)
                if self._held > HELD_BYTES:
                    self._open.clear()
                    self._held = len(raw)
            n, at, cols = len(raw) // sum(d.itemsize for d in self.dtypes), 0, []
            for d in self.dtypes:
                cols.append(np.frombuffer(raw, d, n, at))
                at += n * d.itemsize
            self._open[bucket] = cols
        return self._open[bucket]

    def lookup(self, h: np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(found, the further columns' values) for each hash; values are zero where not found.
        where: the bucket of each, if it isn't that of the hash itself."""
        found = np.zeros(len(h), bool)
        out = [np.zeros(len(h), d) for d in self.dtypes[1:]]
        order = np.argsort(h, kind="stable") if where is None else np.lexsort((h, where))
        s = h[order]
        at = bucket_of(s, self.buckets) if where is None else where[order]
        ends = np.searchsorted(at, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(ends)):
            lo, hi = ends[b], ends[b + 1]
            keys, *values = self.columns(int(b))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, s[lo:hi]), len(keys) - 1)
                ok = keys[at] == s[lo:hi]
                rows = order[lo:hi][ok]
                found[rows] = True
                for o, v in zip(out, values, strict=True):
                    o[rows] = v[at[ok]]
        return found, out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, one after the other."""
    out = io.BytesIO()
    for a in arrays:
        out.write(np.ascontiguousarray(a).tobytes())
    return out.getvalue()


def unpack(blob: bytes, dtypes: list[str]) -> list[np.ndarray]:
    kinds = [np.dtype(d) for d in dtypes]
    n, at, out = len(blob) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * k.itemsize
    return out
