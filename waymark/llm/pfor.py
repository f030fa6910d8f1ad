"""Token ids in patched frame-of-reference blocks.

A file holds the ids of some documents in ascending doc_id order. Ids are cut into blocks of 128; a block subtracts its
minimum, is packed at the width that holds PERCENTILE of its values, and lists the higher bits of the others (position, bits)
as exceptions. The header indexes documents (id, number of ids) and the start of each block. File k holds smaller
doc_ids than file k + 1; nulls come last.

Texts are encoded where they are read; by the row's range (bounds from a hash sample) the ids go to the task
that sorts and writes the range's file in the shared folder. Files are as many as the shuffle's partitions, or more to
hold some 64 MB of text each, and are then read back and decoded.

Defined results: null texts are empty, and every document ends in the end id; equal doc_ids are ordered by a hash of their
texts, so that one doc_id of many rows can be spread over files; very long texts are encoded by segments; extra columns are not read; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, open_folder, put_file

BLOCK, PERCENTILE = 128, 0.9
MAGIC = b"PFOR0001"
NULL_ID = np.iinfo(np.int64).max


def _pack(x: np.ndarray, w: int) -> bytes:
    """The low w bits of each value, BLOCK values a row, bit after bit."""
    if w in (8, 16, 32):
        return x.astype(f"<u{w // 8}").tobytes()
    out = []
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        bits = ((part[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        out.append(np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little").tobytes())
    return b"".join(out)


def _unpack(raw: np.ndarray, w: int) -> np.ndarray:
    """raw: rows x BLOCK * w / 8 bytes."""
    if w in (8, 16, 32):
        return np.ascontiguousarray(raw).view(f"<u{w // 8}").astype(np.uint32)
    out = np.zeros((len(raw), BLOCK), np.uint32)
    for at in range(0, len(raw), 2048):
        bits = np.unpackbits(raw[at : at + 2048], axis=1, bitorder="little").reshape(-1, BLOCK, w)
        for b in range(w):
            out[at : at + 2048] |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
    return out


def _encode_blocks(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimum, width, number of exceptions, their positions, their high bits, packed bytes) of rows of BLOCK values."""
    low = x.min(axis=1)
    x = x - low[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.ceil(np.log2(np.partition(x, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(np.uint8)
    wide = width.astype(np.uint32)[:, None]
    over = np.where(wide < 32, x >> np.minimum(wide, 31), 0).astype(np.uint32)
    row, pos = np.nonzero(over)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        step = int(w) * (BLOCK // 8)
        packed = _pack(x[at] & np.uint32((1 << int(w)) - 1), int(w))
        body[(start[at][:, None] + np.arange(step)).ravel()] = np.frombuffer(packed, np.uint8)
    return low, width, np.bincount(row, minlength=len(x)).astype(np.uint8), pos.astype(np.uint8), over[row, pos], body


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file of these documents' ids (document after document)."""
    n = len(ids)
    parts = []
    for at in range(0, n, BLOCK << 12):
        part = ids[at : at + (BLOCK << 12)].astype(np.uint32)
        filling = np.full(-len(part) % BLOCK, part[-1], np.uint32)
        parts.append(_encode_blocks(np.concatenate([part, filling]).reshape(-1, BLOCK)))
    kinds = ("<u4", "u1", "u1", "u1", "<u4", "u1")
    low, width, exceptions, pos, high, body = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, k) for k in kinds)
    size = width.astype(np.int64) * (BLOCK // 8)
    head = np.array([len(doc_ids), n, len(low), len(pos), len(body)], "<u8")
    rest = (c.astype(k) for c, k in zip((low, width, exceptions, pos, high, body), kinds, strict=True))
    return [MAGIC, *(c.tobytes() for c in (head, doc_ids.astype("<i8"), counts.astype("<u8"), (np.cumsum(size) - size).astype("<u8"), *rest))]


class PforFile:
    """A file's bytes; blocks are decoded as they are asked for."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n, nb, ne, body = (int(x) for x in np.frombuffer(raw, "<u8", 5, 8))
        at, parts = 48, []
        for kind, k in (("<i8", docs), ("<u8", docs), ("<u8", nb), ("<u4", nb), ("u1", nb), ("u1", nb), ("u1", ne), ("<u4", ne), ("u1", body)):
            parts.append(np.frombuffer(raw, kind, k, at))
            at += parts[-1].nbytes
        self.doc_ids, self.counts, self.start, self.low, self.width, exc, self.pos, self.high, self.body = parts
        self.first = np.concatenate([[0], np.cumsum(exc.astype(np.int64))])

    def blocks(self, lo: int, hi: int) -> np.ndarray:
        """The ids of blocks lo to hi, without the last block's filling."""
        x = np.zeros((hi - lo, BLOCK), np.uint32)
        width = self.width[lo:hi]
        for w in np.unique(width[width > 0]):
            at = np.flatnonzero(width == w)
            step = int(w) * (BLOCK // 8)
            x[at] = _unpack(self.body[(self.start[lo:hi][at].astype(np.int64)[:, None] + np.arange(step)).ravel()].reshape(-1, step), int(w))
        e = slice(self.first[lo], self.first[hi])
        row = np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))
        x[row, self.pos[e]] |= (self.high[e].astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
        return (x + self.low[lo:hi, None]).ravel()[: self.n - lo * BLOCK]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids number lo to hi of the file."""
        b = lo // BLOCK
        return self.blocks(b, -(-hi // BLOCK))[lo - b * BLOCK : hi - b * BLOCK] if hi > lo else np.zeros(0, np.uint32)


#: what the fast path knows (fixed values): these normalizers, this split, then byte characters without a prefix
_NORMAL = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_SUFFIX = "</w>"
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": _SUFFIX}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BEFORE = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: characters that NFC leaves alone and that have one lower-case form each, whatever the Unicode version; ASCII blanks
_SIMPLE = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u017f]*")
#: the split above for lower-case simple characters: their letters, and their numbers one by one
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: bytes of text looked at together; words kept in memory (some 60 bytes each); words of up to SHORT bytes are numbers
SEGMENT, REMEMBERED, SHORT = 2 << 20, 1_000_000, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _byte_characters() -> dict[int, int]:
    """The character that byte-level models use for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in prints)
    return {b: 256 + i for i, b in enumerate(rest)}


def _known_steps(spec: dict) -> bool:
    """Whether a tokenizer file's normalizer, pre-tokenizer and added tokens are what the fast path knows."""
    before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    normal = (spec["normalizer"] or {}).get("normalizers", [])
    # an added token has no blanks and starts with <|: words with <| go through the library
    added = all(t["content"].startswith("<|") and not _BLANK[list(t["content"].encode())].any() for t in spec["added_tokens"])
    model = {k: spec["model"].get(k) for k in _MODEL}
    return normal == _NORMAL and before == _BEFORE and added and model == _MODEL


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (size[i] numbers) for each i, one after the other."""
    stop = np.cumsum(size)
    return np.repeat(first - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


class _Words:
    """Ids of remembered words of up to SHORT bytes. A word is two numbers (its bytes, zero-filled: words hold no
    zero byte, or are not short) and is found by a mix of them, then compared whole. Beyond REMEMBERED
    words, the half that was asked for last stays."""

    def __init__(self, learn):
        self.learn, self.turn = learn, 0
        self.mix = self.a = self.b = np.zeros(0, np.uint64)
        self.begin = self.size = self.used = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def find(self, mix: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place in flat, number of ids) of distinct words, mix ascending; unknown ones are learned."""
        self.turn += 1
        at = np.searchsorted(self.mix, mix)
        there = np.zeros(len(mix), bool)
        if len(self.mix):
            at = np.minimum(at, len(self.mix) - 1)
            there = (self.mix[at] == mix) & (self.a[at] == a) & (self.b[at] == b)
        begin, size = np.zeros(len(mix), np.int64), np.zeros(len(mix), np.int64)
        begin[there], size[there] = self.begin[at[there]], self.size[at[there]]
        self.used[at[there]] = self.turn
        if not there.all():
            new = np.flatnonzero(~there)
            lines = np.full((len(new), SHORT + 1), 10, np.uint8)
            lines[:, :SHORT] = np.stack([a[new], b[new]], axis=1).astype("<u8").view(np.uint8).reshape(-1, SHORT)
            size[new], ids = self.learn(lines[lines > 0].tobytes())
            begin[new] = len(self.flat) + np.cumsum(size[new]) - size[new]
            self.flat = np.concatenate([self.flat, ids])
            place = np.searchsorted(self.mix, mix[new])
            both = lambda x, y: np.insert(x, place, y)
            self.mix, self.a, self.b = both(self.mix, mix[new]), both(self.a, a[new]), both(self.b, b[new])
            self.begin, self.size = both(self.begin, begin[new]), both(self.size, size[new])
            self.used = both(self.used, self.turn)
        return begin, size

    def shrink(self) -> None:
        if len(self.mix) <= REMEMBERED:
            return
        keep = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        self.flat = self.flat[_spread(self.begin[keep], self.size[keep])]
        self.mix, self.a, self.b, self.size, self.used = (x[keep] for x in (self.mix, self.a, self.b, self.size, self.used))
        self.begin = np.cumsum(self.size) - self.size


class WordEncoder:
    """Encodes with the tokenizers library, each distinct word once while it is remembered.

    Where the file's normalizer, pre-tokenizer and added tokens are those above, pre-tokens never span ASCII blanks, so a
    text's ids are those of its words (runs of non-blanks) in order. The words of many texts are found, told apart and
    replaced by their ids as arrays. New words of simple characters are split into lower-case pre-tokens here, which the
    library's model encodes; any other goes through the library whole. With any other file whole texts go through the
    library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _known_steps(json.loads(self.tokenizer.to_str()))
        self.words, self.long = _Words(self._lines), {}
        if self.by_words:
            # the model alone, for pre-tokens in its spelling and with blanks between; the last id of each ends it
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(_SUFFIX)]] = True
            self.spelling = np.arange(256, dtype="<u4")
            for b, c in _byte_characters().items():
                if b not in b" \n":
                    self.spelling[b] = c

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _simple(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """_lines of lines of simple characters."""
        cut = _PIECES.sub(r"\g<0> ", text.lower())
        raw = np.frombuffer(cut.encode(), np.uint8)
        pieces = np.diff(np.cumsum(raw == 32)[raw == 10], prepend=0)
        spelt = cut if cut.isascii() else self.spelling[raw].tobytes().decode("utf-32-le")
        ids = np.array(self.model.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, np.uint32)
        done = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        return np.diff(done[np.cumsum(pieces)], prepend=0), ids

    def _lines(self, lines: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all) of words that each end in a newline."""
        text = lines.decode("utf-8", "surrogatepass")
        if _SIMPLE.fullmatch(text) and "<|" not in text:
            return self._simple(text)
        words = text.split("\n")[:-1]
        easy = [_SIMPLE.fullmatch(w) is not None and "<|" not in w for w in words]
        size, ids = self._simple("".join(f"{w}\n" for w, e in zip(words, easy, strict=True) if e))
        hard = [self._whole(w) for w, e in zip(words, easy, strict=True) if not e]
        easy, every = np.array(easy), np.zeros(len(words), np.int64)
        every[easy], every[~easy] = size, np.fromiter(map(len, hard), np.int64, len(hard))
        out = np.empty(int(every.sum()), np.uint32)
        begin = np.cumsum(every) - every
        out[_spread(begin[easy], size)] = ids
        out[_spread(begin[~easy], every[~easy])] = np.fromiter(chain.from_iterable(hard), np.uint32)
        return every, out

    def _others(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of some words that aren't in the memory of short ones."""
        new = list(dict.fromkeys(w for w in words if w not in self.long))
        size, ids = self._lines(b"".join(w + b"\n" for w in new))
        known = {w: x.tolist() for w, x in zip(new, np.split(ids, np.cumsum(size)[:-1]), strict=False)}
        out = [known.get(w) or self.long.get(w, []) for w in words]
        if len(self.long) + len(known) > REMEMBERED // 16:
            self.long.clear()
        self.long |= {w: x for w, x in known.items() if len(w) < 256}
        return out

    def _segment(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word starts, how many ids it has) of bytes; first: where texts start, which end words."""
        solid = ~_BLANK[raw]
        left, right = solid.copy(), solid.copy()
        left[1:] &= ~solid[:-1]
        right[:-1] &= ~solid[1:]
        first = first[first < len(raw)]
        left[first] = solid[first]
        ends = first[first > 0] - 1
        right[ends] = solid[ends]
        start, stop = np.flatnonzero(left), np.flatnonzero(right) + 1
        size = stop - start
        if not len(start):
            return np.zeros(0, np.uint32), start, size
        padded = np.concatenate([raw, np.zeros(SHORT, np.uint8)])
        halves = np.lib.stride_tricks.sliding_window_view(padded, SHORT)[start].view("<u8")
        n = np.minimum(size, SHORT).astype(np.uint64)
        mask = lambda k: np.where(k >= 8, ~np.uint64(0), (np.uint64(1) << (np.minimum(k, 7) * 8).astype(np.uint64)) - np.uint64(1))
        a = halves[:, 0] & mask(n)
        b = halves[:, 1] & mask(np.where(n > 8, n, np.uint64(8)) - np.uint64(8))
        mix = (a * _MIX ^ b) * _MIX
        mix ^= mix >> np.uint64(29)
        odd = size > SHORT
        if len(zeros := np.flatnonzero(raw == 0)):
            hit = np.searchsorted(start, zeros, side="right") - 1
            odd[hit[zeros < stop[hit]]] = True
        short = np.flatnonzero(~odd)
        a, b = a[short], b[short]
        key, at, which = np.unique(mix[short], return_index=True, return_inverse=True)
        begin, count = self.words.find(key, a[at], b[at])
        flat, place, many = self.words.flat, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        place[short], many[short] = begin[which], count[which]
        # beside long words and words with a zero byte: different words of one mix
        odd[short[(a != a[at][which]) | (b != b[at][which])]] = True
        odd = np.flatnonzero(odd)
        if len(odd):
            ids = self._others([raw[start[i] : stop[i]].tobytes() for i in odd])
            many[odd] = np.fromiter(map(len, ids), np.int64, len(ids))
            place[odd] = len(flat) + np.cumsum(many[odd]) - many[odd]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(many[odd].sum()))])
        out = flat[_spread(place, many)]
        self.words.shrink()
        return out, start, many

    def encode_bytes(self, raw: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end; number of ids of each). Text i is raw[bounds[i]:bounds[i + 1]]."""
        n = len(bounds) - 1
        if not self.by_words:
            got = [[*self._whole(raw[a:b].tobytes().decode("utf-8", "surrogatepass")), end] for a, b in pairwise(bounds.tolist())]
            return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, n)
        ids, counts, lo = [], np.zeros(n, np.int64), 0
        while lo < len(raw):
            hi = min(len(raw), lo + SEGMENT)
            # a segment ends at a blank or where a text ends
            if hi < len(raw) and hi not in bounds:
                blanks = np.flatnonzero(_BLANK[raw[lo:hi]])
                text = int(bounds[np.searchsorted(bounds, hi, side="right") - 1])
                hi = max(lo + int(blanks[-1]) + 1 if len(blanks) else lo, text)
                if hi <= lo:  # one word longer than a segment
                    after = int(bounds[np.searchsorted(bounds, lo, side="right")])
                    blanks = np.flatnonzero(_BLANK[raw[lo:after]])
                    hi = lo + int(blanks[0]) + 1 if len(blanks) else after
            got, start, many = self._segment(raw[lo:hi], bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi)] - lo)
            ids.append(got)
            np.add.at(counts, np.searchsorted(bounds, start + lo, side="right") - 1, many)
            lo = hi
        every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return np.insert(every, np.cumsum(counts), np.uint32(end)), counts + 1

    def encode(self, texts: list, end: int) -> tuple[np.ndarray, np.ndarray]:
        """encode_bytes of a list of strings (None is empty)."""
        return self.encode_bytes(*flat_bytes(pa.array(texts, pa.string())), end)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values one after the other, bounds of each value) of a string or binary column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def _binary(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of values of these sizes, one after the other in raw."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


#: text bytes that a token file stands for, and rows of the sample for each file's bounds
FILE_BYTES, SAMPLE_ROWS = 64 << 20, 100


def _after(bounds: list[tuple], keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many bounds are at or below each row; bounds are ascending, rows and bounds are compared key by key."""
    n = len(bounds)
    if not n:
        return np.zeros(len(keys[0]), np.int32)
    both = [np.concatenate([np.array(b, np.int64), k]) for b, k in zip(zip(*bounds, strict=True), keys, strict=True)]
    order = np.lexsort(both[::-1])
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(order < n)
    return out[n:]


def write_tokens(docs: DataFrame, path: str, end: int = 1) -> tuple[str, list[int]]:
    """Write the ids of all rows of docs; the folder's URI, and how many ids each of its files holds.

    Rows are dealt by ranges of (doc_id, hash of the text, hash of the row's number), with bounds from a sample of SAMPLE_ROWS
    rows a file, so that neither one doc_id nor equal rows make one file large."""
    spark = docs.sparkSession
    text, key = F.col("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID)))
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("r"), text.alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // FILE_BYTES))
    folder, one_in = new_folder(spark, "tokens"), max(1, n // (SAMPLE_ROWS * files))
    some = sorted(map(tuple, rows.select("key", "h", "r").where(F.pmod("r", F.lit(one_in)) == 0).collect())) if n else []
    bounds = [some[len(some) * i // files] for i in range(1, files)] if some else []

    def encode(batches):
        enc = encoder(path)
        for batch in batches:
            key, h, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "h", "r"))
            ids, n = enc.encode_bytes(*flat_bytes(batch.column("text")), end)
            small = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids.astype("<u4")
            columns = [pa.array(_after(bounds, (key, h, r))), pa.array(key), pa.array(h), pa.array(n), _binary(small.view(np.uint8), n * small.itemsize)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "key", "h", "n", "ids"])

    def write(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        key, h, n = (table.column(c).to_numpy() for c in ("key", "h", "n"))
        begin, values, at = [], [], 0
        for chunk in table.column("ids").chunks:
            raw, bound = flat_bytes(chunk)
            size = np.diff(bound)
            width = size // np.maximum(1, n[len(begin) : len(begin) + len(size)])
            begin.extend((at + np.concatenate([[0], np.cumsum(size // np.maximum(1, width))[:-1]])).tolist())
            if (width == 2).all():
                values.append(raw.view("<u2").astype(np.uint32))
            else:
                values += [np.frombuffer(raw[a:b], f"<u{w}").astype(np.uint32) for (a, b), w in zip(pairwise(bound.tolist()), width.tolist(), strict=True)]
            at += int((size // np.maximum(1, width)).sum())
        order = np.lexsort((h, key))
        ids = np.concatenate(values)[_spread(np.array(begin, np.int64)[order], n[order])]
        put_file(folder, f"p{part:06d}", encode_file(key[order], n[order], ids))
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(ids)], pa.int64())})

    sent = rows.mapInArrow(encode, "part int, key long, h long, n long, ids binary")
    done = sent.groupBy("part").applyInArrow(write, "part int, n long").collect()  # one row a file
    counts = [0] * files
    for r in done:
        counts[r.part] = r.n
    return folder, counts


def read_tokens(spark, folder: str, counts: list[int], digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in the folder's files; ids little-endian unsigned 32-bit.
    digest: (doc_id, start, n_tokens, ids_crc32) instead."""
    there = [(i, int(sum(counts[:i]))) for i, n in enumerate(counts) if n]
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    if not there:
        return spark.createDataFrame([], schema)

    def last(ids, cut):
        blobs = (ids[a:b].tobytes() for a, b in zip(*cut, strict=True))
        return {"ids_crc32": [zlib.crc32(x) for x in blobs]} if digest else {"ids": list(blobs)}

    def read(batches):
        fs, path = open_folder(folder)
        for pdf in batches:
            for part, start in zip(pdf["part"], pdf["start"], strict=True):
                with fs.open_input_file(f"{path}/p{part:06d}") as f:
                    file = PforFile(f.read())
                stop = np.cumsum(file.counts.astype(np.int64))
                begin = stop - file.counts.astype(np.int64)
                at = 0
                while at < len(stop):
                    to = max(at + 1, int(np.searchsorted(stop, begin[at] + 2_000_000, side="right")))
                    ids = file.ids(int(begin[at]), int(stop[to - 1])).astype("<u4")
                    cut = begin[at:to] - begin[at], stop[at:to] - begin[at]
                    keys = pd.array([None if k == NULL_ID else k for k in file.doc_ids[at:to].tolist()], "Int64")
                    yield pd.DataFrame({"doc_id": keys, "start": start + begin[at:to], "n_tokens": cut[1] - cut[0]} | last(ids, cut))
                    at = to

    parts = spark.createDataFrame(there, "part long, start long").repartition(len(there), "part")
    return parts.mapInPandas(read, schema)


def token_digest(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files written for docs."""
    folder, counts = write_tokens(docs, path, end)
    return read_tokens(docs.sparkSession, folder, counts, digest=True)
