"""Reconciliation checks: the list a plan needs, and running them on data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog

CHECK = ("name", "type", "target_objects", "description", "source_query", "target_query")


def _check(df: DataFrame, order: list, kind: str, name: Column, objects: Column, text: Column, source: Column | None = None, target: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    keys = [(k if isinstance(k, Column) else F.lit(k)).cast("long").alias(f"k{i}") for i, k in enumerate(order)]
    return df.select(*keys, F.concat(F.lit(f"{kind}::"), name).alias("name"), F.lit(kind).alias("type"), objects.alias("target_objects"), text.alias("description"), (none if source is None else source).alias("source_query"), (none if target is None else target).alias("target_query"))


def plan_checks(spark: SparkSession, source: Catalog, maps: DataFrame, columns: DataFrame, risks: DataFrame) -> DataFrame:
    """CHECK rows in order: for each mapped table row_count, null_parity, checksum and sample_diff; then
    referential_integrity for each source table with foreign keys; then a business_rule for each risk that is high or
    critical and about data quality or mapping."""
    s, t = F.col("source_table"), F.col("target_table")
    tables = maps.where("target_table is not null")
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    both = F.array(s, t)
    counted = _check(tables, [0, F.col("map_ord"), 0], "row_count", s, both, say("'", t, "' must hold as many rows as '", s, "'."), say("SELECT COUNT(*) FROM ", s, ";"), say("SELECT COUNT(*) FROM ", t, ";"))
    pairs = columns.where("match_kind in ('exact', 'fuzzy')").groupBy("map_ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_pos", "source_column"))), lambda x: x.source_column).alias("cols"))
    mapped = tables.join(pairs, "map_ord").join(source.tables(spark).select(F.col("table").alias("source_table"), "primary_key"), "source_table")
    sums = F.array_join(F.transform("cols", lambda c: F.concat(F.lit("SUM(CASE WHEN "), c, F.lit(" IS NULL THEN 1 ELSE 0 END) AS "), c, F.lit("_nulls"))), ", ")
    nulls = _check(mapped, [0, F.col("map_ord"), 1], "null_parity", s, both, say("Mapped columns of '", t, "' must hold as many nulls as in '", s, "'."), say("SELECT ", sums, " FROM ", s, ";"))
    keyed = mapped.where((F.size("primary_key") > 0) & (F.size(F.array_except("primary_key", "cols")) == 0))
    sums_ = _check(keyed, [0, F.col("map_ord"), 2], "checksum", s, both, say("Row hashes over mapped columns, keyed by ", F.array_join("primary_key", ", "), ", must be equal in '", s, "' and '", t, "'."))
    diff = _check(mapped, [0, F.col("map_ord"), 3], "sample_diff", s, both, say("Compare sampled rows of '", s, "' and '", t, "' on: ", F.array_join("cols", ", "), "."))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("fk_ord", "referred_table"))), lambda x: x.referred_table)
    fk = source.fks(spark).groupBy("table_ord", "table").agg(listed.alias("r"))
    ri = _check(fk, [1, F.col("table_ord"), 0], "referential_integrity", F.col("table"), F.concat(F.array("table"), "r"), say("Foreign keys of '", F.col("table"), "' must resolve in: ", F.array_join(F.sort_array(F.array_distinct("r")), ", "), "."))
    bad = risks.where("severity in ('high', 'critical') and category in ('data_quality', 'mapping')")
    rule = _check(bad, [2, F.col("emit_ord"), 0], "business_rule", F.col("id"), F.col("affected_objects"), say("Confirm that risk ", F.col("id"), " (", F.col("title"), ") was dealt with."))
    every = reduce(DataFrame.union, [counted, nulls, sums_, diff, ri, rule])
    return every.withColumn("pos", F.row_number().over(Window.orderBy("k0", "k1", "k2")) - 1).select("pos", *CHECK)


# The checks, run on data. Sides are DataFrames, pairs are (source column, target column).


def row_count_parity(source: DataFrame, target: DataFrame) -> DataFrame:
    """(source_rows, target_rows, ok)."""
    a, b = source.agg(F.count(F.lit(1)).alias("source_rows")), target.agg(F.count(F.lit(1)).alias("target_rows"))
    return a.join(b, F.lit(True)).withColumn("ok", F.col("source_rows") == F.col("target_rows"))


def null_parity(source: DataFrame, target: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(source_column, target_column, source_nulls, target_nulls, ok): one aggregate over each side."""
    def nulls(df: DataFrame, side: int, name: str) -> DataFrame:
        one = df.agg(*(F.count_if(F.col(f"`{p[side]}`").isNull()).alias(f"n{i}") for i, p in enumerate(pairs)))
        return one.select(F.posexplode(F.array(*(F.col(f"n{i}") for i in range(len(pairs))))).alias("i", name))

    names = F.array(*(F.struct(F.lit(a).alias("source_column"), F.lit(b).alias("target_column")) for a, b in pairs))
    out = nulls(source, 0, "source_nulls").join(nulls(target, 1, "target_nulls"), "i").withColumn("p", names[F.col("i")])
    return out.select("p.*", "source_nulls", "target_nulls", (F.col("source_nulls") == F.col("target_nulls")).alias("ok"))


def row_hash(columns: list[str]) -> Column:
    """md5 over the values as text, each with its length before it, so that no two rows have one text; ~ is a null."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    return F.md5(F.concat(*(F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("~")) for c in columns)))


def _number(h: Column) -> Column:
    """The first 60 bits of an md5 in hexadecimal digits, as a number that can be summed."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")


def _sides(source: DataFrame, target: DataFrame, keys: list[tuple[str, str]], pairs: list[tuple[str, str]]) -> DataFrame:
    """A row for each key on either side, nulls being keys like others: how many rows have it, and the sum of their hashes."""
    ks = [f"key{i}" for i in range(len(keys))]

    def part(df: DataFrame, side: int, name: str) -> DataFrame:
        named = df.select(*(F.col(f"`{k[side]}`").alias(f"{name}_{n}") for k, n in zip(keys, ks, strict=True)), _number(row_hash([p[side] for p in pairs])).alias("h"))
        return named.groupBy(*(f"{name}_{n}" for n in ks)).agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.sum("h").alias(f"{name}_sum"))

    on = reduce(lambda x, y: x & y, (F.col(f"source_{n}").eqNullSafe(F.col(f"target_{n}")) for n in ks))
    both = part(source, 0, "source").join(part(target, 1, "target"), on, "full_outer")
    key = lambda n: F.when(F.col("source_rows").isNull(), F.col(f"target_{n}")).otherwise(F.col(f"source_{n}"))
    return both.select(*(key(n).alias(n) for n in ks), "source_rows", "source_sum", "target_rows", "target_sum")


def checksum_diff(source: DataFrame, target: DataFrame, keys: list[tuple[str, str]], pairs: list[tuple[str, str]]) -> DataFrame:
    """(key0, ..., status), one row for each key whose rows differ, are missing or are extra in the target.

    Null keys are compared like others. Where rows share a key, their number and the sum of their hashes are compared."""
    same = (F.col("source_rows") == F.col("target_rows")) & (F.col("source_sum") == F.col("target_sum"))
    status = F.when(F.col("target_rows").isNull(), "missing").when(F.col("source_rows").isNull(), "extra").when(~same, "different")
    joined = _sides(source, target, keys, pairs).withColumn("status", status)
    return joined.where("status is not null").drop("source_rows", "source_sum", "target_rows", "target_sum")


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): the sum of all rows' hashes as text, in no order; equal rows count as often as they occur."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_number(row_hash(columns))), F.lit(0)).cast("string").alias("digest"))


def sample_diff(source: DataFrame, target: DataFrame, keys: list[tuple[str, str]], pairs: list[tuple[str, str]], percent: int = 10) -> DataFrame:
    """checksum_diff of the keys whose hash falls in the first percent of a hundred: the same keys on either side."""
    def some(df: DataFrame, side: int) -> DataFrame:
        return df.where(F.pmod(_number(row_hash([k[side] for k in keys])), F.lit(100)) < percent)

    return checksum_diff(some(source, 0), some(target, 1), keys, pairs)


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], referred: list[str]) -> DataFrame:
    """Rows of child whose foreign key, no part of it null, has no row in parent."""
    keys = parent.select(*(F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(referred))).distinct()
    on = reduce(lambda a, b: a & b, (child[c] == keys[f"_r{i}"] for i, c in enumerate(columns)))
    whole = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in columns))
    return child.where(whole).join(keys, on, "left_anti")
