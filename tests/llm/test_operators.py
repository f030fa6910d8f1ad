"""The operators against brute force on small fixtures, and their defined results for odd rows."""

import collections
import hashlib
import math
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from pyspark.sql import functions as F

from waymark.llm import ann, bpe, common, decontaminate, ngram_lm, pfor, quality, sharding, simhash, substring, toxicity

DATA = "/root/testdata/sf0.001"
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (4, "a b c"), (5, "One"), (6, "naïve Ünï 日本 €5 it's"), (7, "x " * 30_000), (8, " nb sp")]
LONG = " ".join(f"w{i}" for i in range(120))
PASSAGE = " ".join(f"p{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, "l", "s", 1, 0.5, 2, "k", 3, 4) for i, t in [*ODD, (20, LONG), (21, "q " + LONG), (22, f"{LONG} {PASSAGE} end"), (23, f"start {PASSAGE}")]]
    path = str(tmp_path_factory.mktemp("odd") / "rows")
    spark.createDataFrame(rows, SCHEMA + ", score double, shard int, h string, _row int, `a.b` int").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def toks(t):
    return [w for w in (t or "").encode().split()]


# 1


def slow_fingerprint(t, k):
    w = toks((t or "").encode().lower().decode())
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = texts_of(df)
        f = [slow_fingerprint(t, 3) for _, t in rows]
        group = list(range(len(f)))
        changed = True
        while changed:
            new = [min(group[j] for j in range(len(f)) if (f[i] ^ f[j]).bit_count() <= 2) for i in range(len(f))]
            changed, group = new != group, new
        least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
        want = sorted(((i, f"{x:016x}", least[g]) for (i, _), x, g in zip(rows, f, group, strict=True)), key=repr)
        assert sorted((tuple(r) for r in simhash.simhash_components(df).collect()), key=repr) == want
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("radius", [2, 6])
def test_vantage_points_find_every_pair(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    dense = base[0] ^ rng.integers(0, 1 << 10, 300, dtype=np.uint64)  # many in one ball
    f = np.unique(np.concatenate([base, near, dense]))
    items = spark.createDataFrame([(int(x), int(x), 1) for x in f.view(np.int64)], "node long, fp long, size int")
    links = simhash.hamming_links(common.materialize(items), radius, leaf_rows=64, block_rows=100, sample_rows=len(f) // 2)
    got = {r.node: r.component for r in common.connected_components(links).collect()}
    parent = list(range(len(f)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= radius):
            parent[find(i)] = find(int(j))
    groups = collections.defaultdict(list)
    for i in range(len(f)):
        groups[find(i)].append(int(f.view(np.int64)[i]))
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert got == want
    assert len(simhash.VPTree(f, 1, radius, 64).rows) > 1 or radius > 2


def shingle_set(t, k=5):
    w = toks(t.encode().lower().decode())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_dedup(spark, docs, odd, empty):
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    rows = sorted((i, t) for i, t in texts_of(kept))
    assert len({t for _, t in rows}) == len(rows)
    every = dict(texts_of(docs))
    assert all(min(j for j, u in every.items() if u == t) == i for i, t in rows)
    sets = [(i, shingle_set(t)) for i, t in rows]
    left = [(a, b) for x, (a, s) in enumerate(sets) for b, u in sets[:x] if s and u and len(s & u) / len(s | u) >= 0.8]
    assert left == []
    gone = [shingle_set(every[i]) for i in set(every) - {i for i, _ in rows}]
    all_sets = [(t, shingle_set(t)) for t in every.values()]
    assert all(sum(len(g & s) / max(1, len(g | s)) >= 0.8 for _, s in all_sets) > 1 for g in gone if g)
    got = sorted(((i, t) for i, t in texts_of(simhash.near_dedup(odd))), key=repr)
    # null, empty and blank texts have no words: equal ones are one group, and null is empty
    assert got == sorted([(1, None), (3, " \n\t"), (4, "a b c"), (5, "One"), (6, ODD[7][1]), (7, ODD[8][1]), (8, ODD[9][1]), (20, LONG), (22, f"{LONG} {PASSAGE} end"), (23, f"start {PASSAGE}")], key=repr)
    assert simhash.near_dedup(empty).count() == 0


def test_near_copies_among_texts_within_radius(spark, tmp_path):
    rng = np.random.default_rng(5)
    frame = [f"f{i}" for i in range(60)]
    texts, pairs = [], []
    for i in range(3000):
        own = [f"u{i}x{j}" for j in range(10)]
        texts.append(" ".join(frame + own))
        if i % 100 == 0:
            texts.append(" ".join([*frame, *own[:9], "changed"]))
            pairs.append(set(texts[-2:]))
    order = rng.permutation(len(texts)).tolist()
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i, texts[at]) for i, at in enumerate(order)], "doc_id long, text string").coalesce(1).write.parquet(path)
    kept = [t for _, t in texts_of(simhash.near_dedup(spark.read.parquet(path)))]
    # texts share 56 of 76 shingles, or 65 of 67 where one is the other with its last word changed
    assert len(kept) == 3000 and all(len(p & set(kept)) == 1 for p in pairs)


def test_near_copies_with_repeats(spark, tmp_path):
    line = " ".join(f"r{i}" for i in range(8))
    rest = " ".join(f"s{i}" for i in range(40))
    rows = [(1, LONG), (2, f"{LONG} {LONG}"), (3, " ".join([line] * 4 + [rest])), (4, " ".join([line] * 12 + [rest])), (5, PASSAGE)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    assert sorted(i for i, _ in texts_of(simhash.near_dedup(spark.read.parquet(path)))) == [1, 3, 5]


def test_sample_fingerprints_are_shared():
    rng = np.random.default_rng(8)
    for j in (0.5, 0.8):
        hits, any_ = 0, 0
        for _ in range(300):
            n, shared = 200, round(400 * j / (1 + j))
            h = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2)
            equal = simhash.sample_fingerprints(h[:n]) == simhash.sample_fingerprints(h[n - shared :])
            hits, any_ = hits + equal.sum(), any_ + equal.any()
        assert abs(hits / (300 * simhash.SAMPLES) - j**simhash.SAMPLED) < 0.03
        assert any_ == 300 or j < 0.8


def test_pairs_are_verified_in_one_cell():
    rng = np.random.default_rng(9)
    samples = rng.integers(0, 3, (60, 5)) + 10 * np.arange(5)
    comp = rng.integers(0, 30, 60)
    want = {(a, b) for a in range(60) for b in range(a) if (samples[a] == samples[b]).any() and comp[a] != comp[b]}
    for cut in (1, 3):  # groups whole, and as pairs of blocks
        got = []
        for value in np.unique(samples):
            rows = np.flatnonzero((samples == value).any(axis=1))
            for x in range(cut):
                for y in range(x, cut):
                    r = rows[(rows % cut == x) | (rows % cut == y)]
                    side = np.zeros(len(r), int) if x == y else np.where(r % cut == x, 1, 2)
                    part = {"cell": np.ones(len(r), int), "fp": np.zeros(len(r), np.uint64), "size": np.full(len(r), 7), "component": comp[r], "side": side, "samples": samples[r], "sample": np.full(len(r), value)}
                    i, j = simhash._candidates(part, 0.8, True) if len(r) else (r, r)
                    got += [(max(a, b), min(a, b)) for a, b in zip(r[i].tolist(), r[j].tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_copies_come_by_the_tree(spark):
    """Copies whose fingerprints, of whole texts or of one sample, are a bit apart and nowhere equal; one pair is too far."""
    rng = np.random.default_rng(10)
    long = lambda: int(rng.integers(-(1 << 62), 1 << 62))
    rows, texts = [], []
    for node, fp_bits, sample_bits in ((0, 8, None), (2, 31, 64), (4, 31, 7)):  # in which bits two differ; None: in all by chance
        fp, first = long(), long()
        for at, (f, x) in enumerate(((fp, first), (fp ^ fp_bits, long() if sample_bits is None else first ^ sample_bits))):
            rows.append((node + at, f, 116, [x] + [long() for _ in range(simhash.SAMPLES - 1)]))
            texts.append((node + at, LONG.replace("w0 ", f"p{node} ")))
    items = spark.createDataFrame(rows, "node long, fp long, size int, samples array<long>")
    links = simhash.similar_links(common.materialize(items), spark.createDataFrame(texts, "node long, text string"), 5, 0.8)
    assert sorted((min(r), max(r)) for r in links.collect()) == [(0, 1), (2, 3)]
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 5), (20, 21), (23, 24), (21, 23)], "a long, b long")
    for links in (e, e.limit(0)):
        assert sorted(map(tuple, simhash.few_components(links).collect())) == sorted(map(tuple, common.connected_components(links).collect()))


def test_sets_are_held_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 40))) for _ in range(40)]
    size = np.array([len(x) for x in sets])
    i, j = np.triu_indices(40, 1)
    most = []

    def load(rows):
        most.append(size[rows].sum())
        return np.concatenate([sets[r] for r in rows])

    def components():
        e = simhash._verified(i, j, size, load, 0.5)
        label = list(range(40))
        for a, b in e:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(x for x in range(40) if label[x] == g) for g in label}, len(e)

    want = components()
    monkeypatch.setattr(simhash, "HELD_SHINGLES", 50)
    most.clear()
    assert components() == want and max(most) <= 80


def test_near_dedup_is_brute_force(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(texts_of(df))
    by_set: dict = {}
    for i, t in rows:
        by_set.setdefault(frozenset(shingle_set(t)) or t, []).append(i)
    sets = [s for s in by_set if not isinstance(s, str)]
    holds = collections.defaultdict(list)
    for x, s in enumerate(sets):
        for w in s:
            holds[w].append(x)
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, s in enumerate(sets):
        for y, n in collections.Counter(y for w in s for y in holds[w] if y < x).items():
            if n >= 0.8 * (len(s) + len(sets[y]) - n):
                group[find(x)] = find(y)
    least = collections.defaultdict(list)
    for x, s in enumerate(sets):
        least[find(x)] += by_set[s]
    want = sorted([min(g) for g in least.values()] + [min(g) for s, g in by_set.items() if isinstance(s, str)])
    assert sorted(i for i, _ in texts_of(simhash.near_dedup(df))) == want
    # rows that come by a shuffle, small blocks and tasks
    monkeypatch.setattr(simhash, "GROUP_ROWS", 8)
    monkeypatch.setattr(simhash, "TASK_ROWS", 100)
    monkeypatch.setattr(simhash, "FIRST_SAMPLES", 1)
    assert sorted(i for i, _ in texts_of(simhash.near_dedup(df.repartition(5)))) == want


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 4), (9, 5), (20, 21), (21, 22), (22, 23), (23, 24), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


# 2


def slow_cover(rows, window):
    c = collections.Counter(tuple(w[s : s + window]) for _, w in rows for s in range(len(w) - window + 1))
    for i, w in rows:
        m = [False] * len(w)
        for s in range(len(w) - window + 1):
            if c[tuple(w[s : s + window])] > 1:
                m[s : s + window] = [True] * window
        yield i, w, m


@pytest.mark.parametrize("window", [35, 8])
def test_substrings(spark, docs, odd, empty, window):
    for df in (docs, odd):
        rows = [(i, toks(t)) for i, t in texts_of(df)]
        want = sorted(((i, len(w), sum(m), hashlib.sha256(b" ".join(x for x, k in zip(w, m, strict=True) if not k)).hexdigest()) for i, w, m in slow_cover(rows, window)), key=repr)
        assert sorted((tuple(r) for r in substring.kept_digest(df, window).collect()), key=repr) == want
    assert substring.kept_digest(empty, window).count() == 0


def test_factors_are_long(spark, tmp_path):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")

    def factors(*texts):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
        found = collections.defaultdict(list)
        for r in substring.repeated_spans(spark.read.parquet(path), 35).collect():
            found[r.doc_id].append((r.start, r.end, r.source_row, r.source_word))
        return {i: sorted(f) for i, f in found.items()}

    assert factors(two, f"{one} {two}", f"{one} {two}") == {0: [(0, 60, 1, 60)], 1: [(0, 120, 2, 0)], 2: [(0, 120, 1, 0)]}
    # the first source of the first window ends early; the window across its end leads to a longer one
    assert factors(f"{one} x", f"{one} {two}", f"{one} {two} y")[2] == [(0, 120, 1, 0)]
    assert factors(f"{one} {three}", f"{two} {one}", f"z {three} {two} {one}")[2] == [(1, 61, 0, 60), (61, 181, 1, 0)]
    # only windows across the boundary repeat behind a factor: the second one is what they add
    w = [f"m{i}" for i in range(80)]
    got = factors(" ".join(w[:50]), " ".join(w[20:70]), " ".join(w))
    assert got[2] == [(0, 50, 0, 0), (50, 70, 1, 30)]
    # a repeat within one document, overlapping itself
    assert factors(" ".join(["r"] * 50)) == {0: [(0, 49, 0, 1), (49, 50, 0, 34)]}


def test_factors_part_the_duplicate_words(spark, docs, odd):
    for df, window in ((docs, 35), (odd, 35), (docs, 8)):
        words_of = {}
        for n, (i, t) in enumerate((r[0], r[1]) for r in df.select(F.monotonically_increasing_id().alias("n"), "text").orderBy("n").collect()):
            words_of[i] = toks(t)
        numbered = df.withColumn("doc_id", F.monotonically_increasing_id())
        spans = collections.defaultdict(list)
        for r in substring.repeated_spans(numbered, window).collect():
            spans[r.doc_id].append(r)
        cover = {i: m for (i, _, m) in slow_cover(list(words_of.items()), window)}
        for i, m in cover.items():
            mine = sorted(spans[i], key=lambda r: r.start)
            assert all(a.end <= b.start for a, b in pairwise(mine))
            mark = [False] * len(m)
            for r in mine:
                mark[r.start : r.end] = [True] * (r.end - r.start)
                assert words_of[r.source_row][r.source_word : r.source_word + r.end - r.start] == words_of[i][r.start : r.end]
                assert (r.source_row, r.source_word) != (i, r.start)
            assert mark == m


def test_spans_and_cuts(spark, odd):
    spans = {(r.doc_id, r.start, r.end) for r in substring.repeated_spans(odd.where("doc_id >= 20"), 35).collect()}
    assert spans == {(20, 0, 120), (21, 1, 121), (22, 0, 120), (22, 120, 180), (23, 1, 61)}
    cut = substring.remove_repeats(odd, 35, length_col="n_chars")
    assert cut.columns == odd.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert got[21] == ("q ", 2) and got[22] == ("end", 3) and got[23] == ("start ", 6) and got[7] == ("", 0) and got[6] == (ODD[7][1], 1) and got[1] == (None, 1)


# 3


@pytest.mark.parametrize("sizes", [(bpe.CHUNK, bpe.OVERLAP, bpe.PART), (16, 8, 1 << 10), (64, 4, 200)])
def test_byte_bpe(spark, docs, odd, empty, sizes):
    """Chunks and parts down to a few characters, through the query's own path."""
    c, at = bpe.codec(RANKS, P.PATTERN), dict(zip(("chunk", "overlap", "part"), sizes, strict=True))
    for df in (docs.limit(80), odd):
        want = []
        for i, t in texts_of(df):
            ids = c.encoding.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted((tuple(r) for r in bpe.round_trip(df, RANKS, P.PATTERN, **at).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(empty, RANKS, P.PATTERN, **at).count() == 0


def test_columns_of_encoded_documents(spark, odd, empty):
    df = odd.withColumn("ids", F.lit("mine")).withColumn("Decoded", F.lit(1))
    both = bpe.decode_documents(bpe.encode_documents(df, RANKS, P.PATTERN, part=300), RANKS, P.PATTERN, ids_col="ids_1")
    assert both.columns == [*df.columns, "ids_1", "decoded_1"]
    assert all(bytes(r.decoded_1).decode() == (r.text or "") and r.ids == "mine" and r.Decoded == 1 for r in both.collect())
    assert bpe.encode_documents(empty, RANKS, P.PATTERN).count() == 0


def test_chunks_meet(monkeypatch):
    c = bpe.codec(RANKS, P.PATTERN)
    rng = np.random.default_rng(1)
    bits = ["a", "Bc", " ", "  ", "\n", "\n \n", "12", "'s", "'", "!?", "é", "日", "\u00a0", "word" * 9, " " * 40, "x" * 70]
    for _ in range(150):
        t = "".join(rng.choice(bits, 120))
        for chunk, overlap in ((16, 4), (40, 8), (7, 30)):
            runs = list(c.stitched(t, chunk, overlap))
            assert [p for r, _ in runs for p in r] == c.pattern.findall(t)
            assert [s for _, r in runs for s in r.tolist()] == [m.start() for m in c.pattern.finditer(t)]
            assert np.frombuffer(c.encode(t, chunk, overlap), "<u4").tolist() == c.encoding.encode_ordinary(t)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    t = " ".join(rng.choice(["a", "bc", "d", "efg", "hi", "j", "kl", "m"], 300))
    assert np.frombuffer(bpe.Codec(RANKS, P.PATTERN).encode(t), "<u4").tolist() == c.encoding.encode_ordinary(t)
    some = bpe.Codec(RANKS, r"[a-z]+|[0-9]")  # leaves characters out
    for t in ("ab 12!cd", "", "!!", "a" * 50 + "--" + "7" * 50):
        assert np.frombuffer(some.encode(t, 16, 8), "<u4").tolist() == some.encoding.encode_ordinary(t)


# 4


def test_kneser_ney(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = texts_of(df)
        held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
        seqs = [toks((t or "").encode().lower().decode()) + ["end"] for _, t in rows]
        one, two, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for s, h in zip(seqs, held, strict=True):
            if not h:
                one.update(s)
                for v, w in pairwise(["begin", *s]):
                    two[v, w] += 1
                    ctx[v] += 1
        n, v_, follows = one.total(), len(one), collections.Counter(w for _, w in two)
        count = lambda c: [sum(x == i for x in c.values()) for i in range(1, 5)]
        d2, d1 = ngram_lm.discounts(count(two)), ngram_lm.discounts(count(follows))
        g0 = sum(d1[min(k, 3)] for k in follows.values()) / len(two)
        low = lambda w: max(follows[w] - d1[min(follows[w], 3)], 0) / len(two) + g0 / (v_ + 1)  # noqa: E731,B023
        gamma = collections.Counter()
        for (v, _), c in two.items():
            gamma[v] += d2[min(c, 3)]
        p = lambda v, w: max(two[v, w] - d2[min(two[v, w], 3)], 0) / ctx[v] + gamma[v] / ctx[v] * low(w) if v in ctx else low(w)  # noqa: E731,B023
        assert math.isclose(sum(map(low, one)) + g0 / (v_ + 1), 1)
        assert math.isclose(sum(p("begin", w) for w in one) + gamma["begin"] / ctx["begin"] * g0 / (v_ + 1), 1)
        want = sorted(((i, h, len(s), sum(one[w] > 0 for w in s), n, sum(math.log10((one[w] + 1) / (n + v_ + 1)) for w in s), sum(math.log10(p(v, w)) for v, w in pairwise(["begin", *s]))) for (i, _), h, s in zip(rows, held, seqs, strict=True)), key=lambda r: repr(r[:5]) + f"{r[5]:.6f}")
        got = sorted((tuple(r) for r in ngram_lm.score_texts(df).collect()), key=lambda r: repr(r[:5]) + f"{r[5]:.6f}")
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want])
    assert ngram_lm.score_texts(empty).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(400)], "doc_id long, text string").where("crc32(cast(doc_id as string)) % 7 = 2")
    assert {(r.train_tokens, r.base_score, r.score) for r in ngram_lm.score_texts(only).collect()} == {(0, 0.0, 0.0)}


@pytest.mark.parametrize("order, pruned", [(2, False), (3, False), (3, True)])
def test_frequent_words_are_split(spark, docs, odd, empty, monkeypatch, order, pruned):
    """Where things are kept changes nothing: no frequent words, some of the words, all of them."""
    for df in (docs.limit(60), odd):
        scores = []
        for share in (1, 2e-3, 1e-6):
            monkeypatch.setattr(ngram_lm, "HOT_BUCKETS", 0)
            monkeypatch.setattr(ngram_lm, "HOT_SHARE", share)
            scores.append(sorted((tuple(r) for r in ngram_lm.score_texts(df, order=order, pruned=pruned).collect()), key=repr))
        assert scores[0] == scores[1] == scores[2]
        words = collections.Counter(w for _, t in texts_of(df) for w in toks((t or "").encode().lower().decode()))
        for share in (2e-3, 1e-6):
            monkeypatch.setattr(ngram_lm, "HOT_SHARE", share)
            some = [xxhash.xxh3_64_intdigest(w) for w, n in words.items() if n >= share * words.total()]
            assert some and ngram_lm.frequent(df, 1, 4).tolist() == sorted(some)
    assert ngram_lm.frequent(empty, 1, 4).tolist() == []


@pytest.mark.parametrize("pruned", [False, True])
def test_kneser_ney_of_order_three(spark, docs, odd, empty, pruned):
    for df in (docs.limit(60), odd):
        rows = texts_of(df)
        held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
        seqs = [toks((t or "").encode().lower().decode()) + ["end"] for _, t in rows]
        one, three = collections.Counter(), collections.Counter()
        for s, h in zip(seqs, held, strict=True):
            if not h:
                one.update(s)
                three.update(zip(["begin", "begin", *s], ["begin", *s], s, strict=False))
        two = collections.Counter()
        for (_, v, w), c in three.items():
            two[v, w] += c if v == "begin" else 1
        three = collections.Counter({k: c for k, c in three.items() if k[1] != "begin"})
        n, v_, follows = one.total(), len(one), collections.Counter(w for _, w in two)
        count = lambda c: [sum(x == i for x in c.values()) for i in range(1, 5)]
        d3, d2, d1 = (ngram_lm.discounts(count(c)) for c in (three, two, follows))
        g0 = sum(d1[min(k, 3)] for k in follows.values()) / len(two)
        low = lambda w: max(follows[w] - d1[min(follows[w], 3)], 0) / len(two) + g0 / (v_ + 1)  # noqa: E731,B023

        def level(counts, d, least=1):
            total, spare = collections.Counter(), collections.Counter()
            for (*v, _), c in counts.items():
                total[tuple(v)] += c
                spare[tuple(v)] += d[min(c, 3)] if c >= least else c
            kept = collections.Counter({k: c for k, c in counts.items() if c >= least})
            return lambda v, w, below: (max(kept[*v, w] - d[min(kept[*v, w], 3)], 0) + spare[v] * below) / total[v] if v in total else below

        p2, p3 = level(two, d2), level(three, d3, 2 if pruned else 1)
        p = lambda u, v, w: p3((u, v), w, p2((v,), w, low(w)))  # noqa: E731,B023
        u, v, _ = max(three, key=three.get)
        unknown = p3((u, v), "", p2((v,), "", g0 / (v_ + 1)))
        assert math.isclose(sum(p(u, v, w) for w in one) + unknown, 1)
        want = sorted((repr(i), len(s), round(sum(math.log10((one[w] + 1) / (n + v_ + 1)) for w in s), 6), sum(math.log10(p(*x)) for x in zip(["begin", "begin", *s], ["begin", *s], s, strict=False))) for (i, _), s in zip(rows, seqs, strict=True))
        got = sorted((repr(r.doc_id), r.n_tokens, round(r.base_score, 6), r.score) for r in ngram_lm.score_texts(df, order=3, pruned=pruned).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2:] for g in got], [w[2:] for w in want])
    assert ngram_lm.score_texts(empty, order=3, pruned=pruned).count() == 0


def test_triples_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd"], n)) for n in rng.integers(0, 40, 30)]
    (v, w, _), = ngram_lm.sequences(texts)

    def count():
        out = collections.Counter()
        for b, blob in ngram_lm._triple_blocks(v, w, 5):
            x = ngram_lm._untriple(blob)
            assert (ngram_lm.bucket_of(x[0], 5) == b).all()
            for *k, c in zip(*(a.tolist() for a in x), strict=True):
                out[tuple(k)] += c
        return out

    want = collections.Counter(zip(v.tolist(), ngram_lm.before(v).tolist(), w.tolist(), strict=True))
    assert count() == want
    monkeypatch.setattr(ngram_lm, "NUMBER", 2)  # fewer than there are words: texts apart, then by three keys
    assert count() == want


# 5


def test_decontamination(spark, odd, empty):
    item = " ".join(f"t{i}" for i in range(30))
    half = " ".join(f"t{i}" for i in range(14)) + " zz"
    most = " ".join(f"t{i}" for i in range(27)) + " zz"
    rows = [(100, f"lead {item.upper()}\n tail"), (101, half), (102, most), (102, most), (None, item), (103, "one two three"), (104, "x one two three y")]
    more = spark.createDataFrame([(i, t, "l", "s", 1, 0.5, 2, "k", 3, 4) for i, t in rows], odd.schema)
    items = spark.createDataFrame([(1, item), (1, item), (2, "One two  three"), (3, None), (4, ""), (None, item)], "item_id long, text string")
    found = {tuple(r) for r in decontaminate.find_leaks(odd.union(more), items).collect()}
    # 26 shingles: 27 words hold 23 of them; an item of three words is one shingle, and only the whole text is another
    want = {(d, i, n, 26) for d, n in ((100, 26), (102, 23), (None, 26)) for i in (1, None)} | {(103, 2, 1, 1)}
    assert found == want
    kept = decontaminate.decontaminate(odd.union(more), items)
    assert kept.columns == odd.columns and kept.count() == odd.count() + 2
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(odd, items.limit(0)).count() == 0
    plan = decontaminate.with_hashes(odd.select("doc_id", "text"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# 6


def test_sharding(spark, docs, odd, empty):
    copies = spark.createDataFrame([(1000 + i, "same" if i < 70 else f"t{i % 25}") for i in range(200)], "doc_id long, text string")
    for df, n in ((docs, 8), (odd, 8), (copies, 8), (copies.limit(3), 8)):
        got = sharding.shard_documents(df, n).collect()
        rows = texts_of(df)
        want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
        assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
        count = collections.Counter(r.shard for r in got)
        assert set(count) <= set(range(n)) and max(count.values()) - min(count[i] for i in range(n)) <= 1
        for s in count:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
        assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    got = sharding.shard_documents(copies, 8).collect()
    away = lambda place: sum(c.total() - max(c.values()) for c in place.values())
    spread, dealt = (collections.defaultdict(collections.Counter) for _ in range(2))
    for r in got:
        spread[r.text_crc32][r.shard] += 1
        dealt[r.text_crc32][xxhash.xxh64_intdigest(str(r.doc_id)) % 8] += 1
    assert away(spread) < away(dealt)  # no unlinked rows make room: only moves that go round are granted
    loose = copies.union(spark.range(2000, 2300).selectExpr("id", "cast(id as string)"))
    spread = collections.defaultdict(set)
    for r in sharding.shard_documents(loose, 8).collect():
        spread[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in spread.values()) <= 5  # of 26 linked texts, one of which cannot fit a shard
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_ends_when_all_moved(spark):
    rows = spark.createDataFrame([(i, "same" if i < 120 else f"t{i}") for i in range(320)], "doc_id long, text string")
    got = collections.Counter(r.shard for r in sharding.shard_documents(rows, 32).collect() if r.text_crc32 == zlib.crc32(b"same"))
    assert sorted(got.values()) == [10] * 12  # it fills one shard a round


# 7 and 9


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(0)
    vocabulary = [f"v{i}" for i in range(500)]
    rows, y = [], []
    for i in range(900):
        w = list(rng.choice(vocabulary, rng.integers(5, 60)))
        if i % 5 == 0:
            w[rng.integers(len(w))] = rng.choice(["idiot,", "Scum", "moron."])
        rows.append((i, " ".join(w)))
        y.append((i, None, int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = labels(spark, [*y, (5000, 1, 1), (None, 1, 1), (3, 1, None)])
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, marks).collect()}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    some = toxicity.score_toxicity(odd, labels(spark, [(4, 1, 0), (5, 1, 1), (20, 0, 0)])).collect()
    assert len(some) == odd.count() and all(0 <= r.score <= 1 for r in some)
    assert {r.score for r in toxicity.score_toxicity(odd, labels(spark, [])).collect()} == {0.5}
    assert toxicity.score_toxicity(empty, marks).count() == 0


def test_quality(spark, docs, odd, empty):
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.quality for r in marks.collect()}
    got = quality.score_quality(df, marks).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 1000 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    kept = quality.reject_low_quality(df, marks)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    assert len(quality.score_quality(odd, marks).collect()) == odd.count()
    assert {r.score for r in quality.score_quality(odd, labels(spark, [])).collect()} == {0.5}
    assert {r.score for r in quality.score_quality(odd, labels(spark, [(i, 1, 0) for i in (4, 5, 6, 7, 8, 20, 21)])).collect()} == {1.0}
    assert quality.score_quality(empty, marks).count() == 0


def test_training_rows_are_bounded(spark):
    df = spark.createDataFrame([(1 if i < 300 else i, f"t{i % 37}") for i in range(400)], "doc_id long, text string")
    marks = labels(spark, [(i, 1, 1) for i in [1, *range(300, 400)]])
    rows = quality.training_rows(df, marks, "quality", 3, 1, 10_000)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    whole = sorted(r.h for r in rows.collect())
    assert len(whole) == 300 * (not held(1)) + sum(not held(i) for i in range(300, 400))
    few = quality.training_rows(df, marks, "quality", 3, 1, 60)
    ids = sorted(r.doc_id for r in df.join(marks, "doc_id").where("crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(60).collect())
    some = sorted(r.h for r in df.where(F.col("doc_id").isin(ids)).select(F.xxhash64("doc_id", "text").alias("h")).collect())
    assert sorted(r.h for r in few.collect()) == some[:60]
    got = []
    ftrl = toxicity.ftrl
    try:
        toxicity.ftrl = lambda rows, *a: got.extend(rows) or ftrl(rows, *a)
        toxicity.fit_toxicity(df, marks, max_features=25)
    finally:
        toxicity.ftrl = ftrl
    assert 0 < sum(len(f) for f, _ in got) <= 25


def test_ftrl_is_the_slow_version():
    rng = np.random.default_rng(6)
    rows = [(np.unique(rng.integers(0, 40, 9)).astype(np.int32), int(rng.random() < 0.4)) for _ in range(120)]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.3, 0.1
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        free = l1 if i != "bias" else 0.0
        rate = (beta + math.sqrt(n[i])) / alpha + (l2 if i != "bias" else 0.0)
        return 0.0 if abs(z[i]) <= free else (math.copysign(free, z[i]) - z[i]) / rate

    for _ in range(3):
        for f, y in rows:
            at = [*f.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    m = toxicity.ftrl(rows, alpha, beta, l1, l2, 3)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert dict(zip(m.index.tolist(), m.weight.tolist(), strict=True)) == pytest.approx(want) and m.bias == pytest.approx(weight("bias"))


def test_ridge_is_least_squares(spark):
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = quality.fit_quality(df, marks, n_features=40, ridge=0.01)
    rows = quality.training_rows(df, marks, "quality", 3, 1, quality.MAX_ROWS)
    rows = rows.withColumn("c", F.pmod(F.xxhash64(F.lit("calibrate"), "h"), F.lit(quality.CALIBRATED)) == 0).collect()
    fitted = [r for r in rows if not r.c] if sum(r.c for r in rows) >= quality.LEAST else rows
    phi = m.features(np.stack([quality.statistics(r.text) for r in fitted]))
    y = np.array([r.y for r in fitted], float)
    # the same minimum, as least squares over rows to which the penalty's rows are added
    root = np.diag([math.sqrt(0.01 * len(y))] * 40 + [math.sqrt(1e-9)])
    want = np.linalg.lstsq(np.vstack([phi, root]), np.concatenate([y, np.zeros(41)]), rcond=None)[0]
    assert np.allclose(m.beta, want, atol=1e-6)
    assert (np.diff(m.values) >= 0).all()


def test_isotonic():
    k, v = quality.isotonic(np.array([3.0, 1, 2, 2, 4]), np.array([0.0, 0, 1, 1, 1]))
    assert np.interp([0, 1, 2, 3, 4, 9], k, v).tolist() == pytest.approx([0, 0, 2 / 3, 2 / 3, 1, 1])


# 8


def test_neighbours(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    found = collections.defaultdict(list)
    for r in ann.nearest(vectors).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in (i for i in x if i % 20 == 0):
        best = sorted(((-(x[q] * v).sum(), i) for i, v in x.items() if i != q))[:20]
        assert [f[0] for f in found[q]] == list(range(1, 21))
        assert all(s == pytest.approx(float((x[q] * x[i]).sum()), abs=1e-12) for _, i, s in found[q])
        hits += len({i for _, i in best} & {f[1] for f in found[q]})
    assert hits / (20 * len(found)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "c"), (20, [0.0, 1.0], "c"), (1, [1.0, 0.0], "c"), (1, [1.0, 0.0], "c"), (2, [0.5, 0.5], "c"), (3, [0.0, 0.0], "c"), (4, None, "c"), (5, [nan, 1.0], "c"), (6, [inf, 1.0], "c"), (7, [None, 1.0], "c"), (40, [1.0], "c"), (8, [], "c"), (None, [2.0, 0.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = [tuple(r) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, None, 2.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0), (0, 4, 2, 0.5), (0, 5, 20, 0.0), (20, 1, 2, 0.5), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 1, 0.0), (20, 5, None, 0.0)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id = 0")).count() == 0


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 600)
    monkeypatch.setattr(ann, "QUERY_ROWS", 40)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = zip(*((r.vec_id, r.embedding) for r in vectors.collect()), strict=True)
    ids, x = np.array(ids), np.array(x, float)
    asks = np.flatnonzero(ids % 20 == 0)
    s = x[asks] @ x.T
    s[np.arange(len(asks)), asks] = -np.inf
    best = ids[np.argsort(-s, axis=1)[:, :20]]
    found = collections.defaultdict(set)
    for r in ann.nearest(vectors).collect():
        found[r.query_id].add(r.vec_id)
    assert set(found) == set(ids[asks].tolist()) and all(len(f) == 20 for f in found.values())
    assert sum(len(found[i] & set(b)) for i, b in zip(ids[asks].tolist(), best.tolist(), strict=True)) >= 0.95 * best.size


def test_large_ids_keep_their_order(spark):
    """Ids that doubles can't tell apart, beside a null one."""
    big = 1 << 60
    df = spark.createDataFrame([(0, [1.0, 0.0]), (None, [1.0, 0.0]), *((big + i, [1.0, 0.0]) for i in (3, 1, 2))], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in ann.nearest(df).orderBy("rank").collect() if r.query_id == 0] == [big + 1, big + 2, big + 3, None]


def test_probing_finds_all_within_radius():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    code[1500:] = code[:1500] ^ (rng.random((1500, 8)) < 0.4).astype(np.uint8)
    index = ann.MultiIndex(code)
    for r in (0, 3, 7, 15, 24, 29, 64):
        for q in code[::500]:
            assert index.within(q, r).tolist() == np.flatnonzero(np.bitwise_count(code ^ q).sum(axis=1) <= r).tolist()


# 10


def test_token_files(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    one = spark.createDataFrame([(9, f"text {i % 40} {'y' * (i % 7)}") for i in range(400)], "doc_id long, text string")
    for df in (docs, odd, one):
        coded = [(i, h, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x, h in df.selectExpr("doc_id", "text", "xxhash64(text)").collect()]
        coded.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        at, want = 0, []
        for i, _, ids in coded:
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted((tuple(r) for r in pfor.token_digest(df, WORDS).collect()), key=lambda r: r[1]) == want
    assert pfor.token_digest(empty, WORDS).count() == 0
    # one doc_id, even of one text, is spread over files
    assert sum(n > 0 for n in pfor.write_tokens(one, WORDS)[1]) == 4
    assert sum(n > 0 for n in pfor.write_tokens(one.selectExpr("doc_id", "'same' as text"), WORDS)[1]) == 4


def test_rows_are_dealt_by_bounds():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 3, 200) for _ in range(3)]
    bounds = sorted(tuple(int(x) for x in rng.integers(0, 3, 3)) for _ in range(9))
    assert pfor._after(bounds, keys).tolist() == [sum(b <= r for b in bounds) for r in zip(*(k.tolist() for k in keys), strict=True)]
    assert pfor._after([], keys).tolist() == [0] * 200


def test_words_are_the_librarys(monkeypatch):
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(WORDS), pfor.WordEncoder(WORDS), np.random.default_rng(5)
    assert e.by_words
    some = [chr(c) for c in [0, *range(9, 14), *range(32, 127), *range(0xA0, 0x250), 0x301, 0x3A3, 0x2014, 0x65E5, 0x1F600, 28, 0x85, 0x2028]]
    some += ["'s", "'LL", "'T ", "  ", "a", "B", "é", "7", "<|endoftext|>", "J\u030c"] * 8
    texts = ["".join(rng.choice(some, 40)) for _ in range(1500)] + ["", None, " ", "a", "\0", "\0 a\0", "x" * 5000, "é" * 8, "<|endoftext|>"]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]

    def check(enc, parts):
        for part in parts:
            ids, n = enc.encode([texts[i] for i in part], 1)
            assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == want[part[0]]
            assert ids.tolist() == [i for p in part for i in want[p]] and n.tolist() == [len(want[p]) for p in part]

    check(e, [range(len(texts))])
    check(pfor.WordEncoder(WORDS), [[i] for i in range(0, len(texts), 9)])
    # small segments, and a memory that forgets
    monkeypatch.setattr(pfor, "SEGMENT", 64)
    monkeypatch.setattr(pfor, "REMEMBERED", 300)
    check(pfor.WordEncoder(WORDS), [range(i, min(i + 50, len(texts))) for i in range(0, len(texts), 50)] * 2)


def test_other_tokenizer_files(spark, odd, tmp_path):
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), pfor.WordEncoder(path)
    assert not e.by_words
    ids, n = e.encode(["a  b", None], 7)
    assert ids.tolist() == [*t.encode("a  b", add_special_tokens=False).ids, 7, 7] and n.tolist() == [len(ids) - 1, 1]
    # one step of the normalizer with another content: not the steps that words can be encoded by
    spec = json.loads(Path(WORDS).read_text())
    spec["normalizer"]["normalizers"][1]["content"] = "_"
    (tmp_path / "other.json").write_text(json.dumps(spec))
    assert not pfor.WordEncoder(str(tmp_path / "other.json")).by_words


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_patched_blocks(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 40, n) + np.where(rng.random(n) < 0.05, rng.integers(0, 1 << 31, n), 0)).astype(np.uint32)
    f = pfor.PforFile(b"".join(pfor.encode_file(np.array([1, 2]), np.array([n, 0]), ids)))
    assert f.ids(0, n).tolist() == ids.tolist() and f.n == n
    for lo, hi in ((0, n // 2), (n // 3, n), (n // 2, n // 2)):
        assert f.ids(lo, hi).tolist() == ids[lo:hi].tolist()
    assert f.first[-1] > 0 or n < 100
    wide = np.array([0, 0xFFFFFFFF] * 200, np.uint32)
    assert pfor.PforFile(b"".join(pfor.encode_file(np.array([1]), np.array([400]), wide))).ids(0, 400).tolist() == wide.tolist()


def test_registered(spark):
    import duckdb

    from waymark.llm.queries import ORACLE_SQL, QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = c.execute(sql)
        cols = [d[0] for d in got.description]
        assert sorted(map(tuple, got.fetchall())) == sorted(tuple(r) for r in QUERIES[name](spark, DATA).select(*cols).collect())
