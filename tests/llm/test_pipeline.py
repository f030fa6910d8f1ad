import os
import subprocess
import sys

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as pipeline
from waymark.llm.bpe import codec

DATA = "/root/testdata/sf0.001"
TABLE = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(spark, kept):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "byte-level BPE"]
    assert all(df.columns == TABLE for df in kept[:-1])
    count = [df.count() for df in kept]
    assert count[0] > count[1] > count[2] == count[3] >= count[4] == count[5] > 0


def test_passages_go(kept):
    before, after = ({r.doc_id: r for r in df.collect()} for df in kept[2:4])
    seen: dict = {}
    for i, r in before.items():
        w = r.text.encode().split()
        for s in range(len(w) - 34):
            seen.setdefault(tuple(w[s : s + 35]), []).append((i, s))
    marks = {i: np.zeros(len(r.text.encode().split()), bool) for i, r in before.items()}
    for places in seen.values():
        for i, s in places if len(places) > 1 else ():
            marks[i][s : s + 35] = True
    for i, r in after.items():
        assert r.text.encode().split() == [w for w, m in zip(before[i].text.encode().split(), marks[i], strict=True) if not m]
        assert r.n_chars == (len(r.text) if marks[i].any() else before[i].n_chars)
        assert marks[i].any() or r.text == before[i].text


def test_test_items_go(spark, kept):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = [shingles(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {r.doc_id for r in kept[3].collect() if not any(i and len(i & shingles(r.text)) >= 0.8 * len(i) for i in items)}
    assert {r.doc_id for r in kept[4].collect()} == want


def test_tokens(kept):
    c = codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    for r in kept[5].collect():
        assert r.decoded == texts[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == c.encoding.encode_ordinary(texts[r.doc_id]) and r.n_tokens * 4 == len(r.ids)


def test_run(spark, kept):
    assert pipeline.run(spark, DATA).count() == kept[5].count()


def test_stages_on_odd_and_empty_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns with the names of new ones, no n_chars; and no rows."""
    schema = "doc_id long, text string, ids string, Decoded int, n_tokens string, _row int, score double"
    long = " ".join(f"w{i} and" for i in range(30_000))
    rows = [(i, t, "i", 1, "n", 2, 0.5) for i, t in [(None, "a b c"), (1, None), (2, ""), (3, " \n"), (4, "a b c"), (4, "a b c"), (5, long), (6, "é 日本 ok")]]
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns and out.count() <= docs.count()
        out = pipeline.tokenize(spark, docs, DATA)
        assert out.columns == [*docs.columns, "ids_1", "decoded_1", "n_tokens_1"] and out.count() == len(some)
        assert all(r.decoded_1 == (r.text or "") and r.n_tokens_1 * 4 == len(r.ids_1) and (r.ids, r.Decoded) == ("i", 1) for r in out.collect())
    near = pipeline.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/odd"), DATA)
    assert sorted((r.doc_id, r.text is None) for r in near.collect()) == [(1, True), (3, False), (4, False), (5, False), (6, False)]


#: tokenizes 10,000 texts in one worker, one batch; prints the MB (shared pages in part) that the largest worker holds at most, and after it
HELD = """
import re, sys, threading
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline, psutil

def held():
    mb = [0]
    for p in psutil.Process().children(recursive=True):
        try:
            if "pyspark.daemon" in " ".join(p.cmdline()):
                mb.append(sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text()))) / 1024)
        except (psutil.Error, OSError):
            pass
    return max(mb)

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
words = F.transform(F.sequence(F.lit(1), F.lit(500)), lambda x: F.conv(F.pmod(F.xxhash64("id", x), F.lit(3000)).cast("string"), 10, 26))
docs = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
docs.write.parquet(sys.argv[1] + "/docs")
docs = spark.read.parquet(sys.argv[1] + "/docs")
most, over = [0.0], threading.Event()

def watch():
    while not over.wait(0.2):
        most[0] = max(most[0], held())

t = threading.Thread(target=watch)
t.start()
corpus_pipeline.tokenize(spark, docs, "").write.parquet(sys.argv[1] + "/out")
over.set(), t.join()
print("HELD", int(most[0]), int(held()), spark.read.parquet(sys.argv[1] + "/out").where("n_tokens > 500 and text = decoded").count())
"""


def test_workers_give_memory_back(tmp_path):
    """A worker holds little more than the codec, and the texts and ids of a batch as Arrow columns, and keeps none of them."""
    root = os.path.dirname(pipeline.__file__)
    ran = subprocess.run([sys.executable, "-c", HELD, str(tmp_path)], cwd=root, env=os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}, capture_output=True, text=True, timeout=300)
    most, after, rows = map(int, ran.stdout.rpartition("HELD ")[2].split())
    assert rows == 10_000
    assert most < 250
    assert after < 170
