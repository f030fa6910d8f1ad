"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions only.

Test items are partitioned by their number of distinct shingles q into classes [2^c, 2^(c+1)). An item is contained
in a document if the document holds at least need = ceil(similarity * q) of its shingles; so it misses q - need at
most, and of any q - need + 1 shingles of the item it holds one. An item's signature is therefore its bottom-k MinHash
sketch, k being q - need + 1 for the largest q of its class: searching documents' shingle hashes for sketch values
loses no pair. Candidates are then verified by
the exact number of shared shingle strings.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a text with fewer words than a shingle is one shingle.
So an item of fewer words than a shingle is found only in documents of the same words, not inside longer ones.

Defined results: null or empty texts, of items or documents, contain and are contained in nothing; repeated rows and
items count once; for several items with one item_id (or texts with one doc_id) the largest containment counts; ids may be
null and are grouped as such; only id and text columns are read, and decontaminate keeps the others; an empty table on
either side gives no pairs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, broadcast_if_small, materialize, quoted, stable


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _starts(n: str, k: int) -> Column:
    """Positions of shingles in an array of n words, from 0."""
    return F.when(F.col(n) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.col(n) - k, F.lit(0))))


def with_hashes(docs: DataFrame, k: int) -> DataFrame:
    """docs (with text) plus h: the distinct hashes of the text's k-word shingles. Words are hashed once each."""
    df = docs.withColumn("w", _words(F.col("text"))).withColumn("n", F.size("w"))
    df = df.withColumn("x", F.transform("w", lambda w: F.xxhash64(w)))
    parts = lambda i: [F.get(F.col("x"), i + j) for j in range(k)]
    return df.withColumn("h", F.array_distinct(F.transform(_starts("n", k), lambda i: F.xxhash64(*parts(i))))).drop("x")


def with_strings(df: DataFrame, k: int) -> DataFrame:
    """df (with text) plus s: the distinct k-word shingles of the text."""
    df = df.withColumn("w", _words(F.col("text"))).withColumn("n", F.size("w"))
    one = lambda i: F.array_join(F.slice(F.col("w"), i + 1, k), " ")
    return df.withColumn("s", F.array_distinct(F.transform(_starts("n", k), one))).drop("w", "n")


def sketches(items: DataFrame, k: int, similarity: float) -> DataFrame:
    """(item, h) for each item and value of its sketch. items: item long, text."""
    need = lambda q: F.ceil(F.lit(similarity) * q - F.lit(1e-9)).cast("int")
    # written first: the optimizer would copy the hashing into each use of q and h
    df = materialize(with_hashes(items, k).select("item", F.array_sort("h").alias("h"))).withColumn("q", F.size("h")).where("q > 0")
    most = (F.pow(F.lit(2.0), F.floor(F.log2("q")) + 1) - 1).cast("int")
    df = df.withColumn("kept", F.least(F.col("q"), most - need(most) + 1))
    return df.select("item", F.explode(F.slice("h", F.lit(1), F.col("kept"))).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(_row, doc_id, item_id, n_shared, n_item) of every document row and item with containment >= similarity.

    docs: _row long (unique), doc_id, text, from a file or table; items: item_id, text.
    """
    tests = items.where("text is not null").select("item_id", "text").distinct()
    tests = materialize(tests.withColumn("item", F.monotonically_increasing_id()))
    wanted = materialize(sketches(tests.select("item", "text"), k, similarity))
    # explode_outer: explode would add a filter on h that the optimizer pushes down by copying the hashing into it
    hashes = with_hashes(docs.select("_row", "text"), k).select("_row", F.explode_outer("h").alias("h"))
    pairs = materialize(hashes.join(broadcast_if_small(wanted), "h").select("_row", "item").distinct())
    rows = broadcast_if_small(materialize(pairs.select("_row").distinct()))
    texts = with_strings(docs.select("_row", "doc_id", "text").join(rows, "_row", "left_semi"), k).drop("text")
    strings = with_strings(tests, k).drop("text").withColumnRenamed("s", "t")
    both = texts.join(pairs, "_row").join(strings, "item")
    both = both.select("_row", "doc_id", "item_id", F.size(F.array_intersect("s", "t")).cast("long").alias("n_shared"), F.size("t").cast("long").alias("n_item"))
    return both.where(F.col("n_shared") >= F.ceil(F.lit(similarity) * F.col("n_item") - F.lit(1e-9)))


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item), one row for each pair of ids, of the largest containment."""
    found = contained_items(stable(docs).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), items, k, similarity)
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), F.col("n_shared"), F.col("n_item"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_shared", "m.n_item")


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that contain no test item."""
    docs = stable(docs)
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    slim = numbered.select(F.col(ROW).alias("_row"), "doc_id", "text")
    bad = contained_items(slim, items, k, similarity).select(F.col("_row").alias(ROW)).distinct()
    return numbered.join(broadcast_if_small(materialize(bad)), ROW, "left_anti").select(*quoted(docs.columns))


#: The pairs of find_leaks in DuckDB SQL.
LEAKS_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, text, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM {docs} WHERE text IS NOT NULL
), i AS (
  SELECT DISTINCT item_id, text, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), ds AS (
  SELECT doc_id, text, unnest(list_distinct([array_to_string(w[j:j+4], ' ') FOR j IN range(1, greatest(len(w) - 4, 1) + 1)])) AS s FROM d WHERE len(w) > 0
), q AS (
  SELECT item_id, text, list_distinct([array_to_string(w[j:j+4], ' ') FOR j IN range(1, greatest(len(w) - 4, 1) + 1)]) AS l FROM i WHERE len(w) > 0
), qs AS (
  SELECT item_id, text, len(l) AS n_item, unnest(l) AS s FROM q
), p AS (
  SELECT ds.doc_id, qs.item_id, ds.text AS dt, qs.text AS it, count(*) AS n_shared, any_value(n_item) AS n_item
  FROM ds JOIN qs ON ds.s = qs.s GROUP BY ALL HAVING count(*) >= ceil(0.8 * any_value(n_item) - 1e-9)
)
SELECT doc_id, item_id, CAST(arg_max(n_shared, n_shared / n_item) AS BIGINT) AS n_shared, CAST(arg_max(n_item, n_shared / n_item) AS BIGINT) AS n_item
FROM p GROUP BY doc_id, item_id
"""
