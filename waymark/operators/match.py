"""Matching of tables and columns by name: equal names first, then similar ones, each used once."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sqltypes
from ..sources.catalog import Catalog, frozen

THRESHOLD = 0.72  # fixed value: least similarity of a match, inclusive
NO_TABLE = "(none)"
NO_TARGET_TABLE = "The source table has no counterpart."
NO_TARGET = "No target column matches: drop, rename or add one."
NO_SOURCE = "No source column matches: needs a default or a rule."
NARROW = "Target type is narrower: possible truncation."
MATCH = "group string, left string, left_ord int, right string, kind string, score double, pos int"
MAPPING = (
    "map_ord int, col_pos int, source_table string, source_column string, target_table string, target_column string, source_type string, target_type string,"
    " match_kind string, confidence double, transformation string, notes string, narrowing boolean, target_nullable boolean"
)


def name_key(c: Column) -> Column:
    """Names equal by this key match exactly: blanks trimmed, lower case, - and inner blanks as _ (which is kept)."""
    return F.translate(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "- ", "__")


def python_key(name: str) -> str:
    return name.strip().lower().replace("-", "_").replace(" ", "_")


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two names' keys; the order of the two matters."""
    return difflib.SequenceMatcher(None, python_key(a), python_key(b)).ratio()


def similarity_column(a: Column, b: Column) -> Column:
    """similarity of two columns of names."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p, q) for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def match_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matches (MATCH) within each group. left, right: group, ord, name.

    The k-th left of a key takes the k-th right of that key. What is left is matched in left order, each to the most
    similar right not taken yet (the earliest of equals) if the ratio is THRESHOLD or more: a pass in order
    by nature, run on its own for each group, whose size is a number of names.
    """
    def keyed(df: DataFrame, side: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("group", "key").orderBy("ord"))
        return df.withColumn("key", name_key(F.col("name"))).withColumn("rn", rank).select("group", "key", "rn", F.col("ord").alias(f"{side}_ord"), F.col("name").alias(side))

    l, r = frozen(keyed(left, "left")), frozen(keyed(right, "right"))
    exact = frozen(l.where("left <> ''").join(r, ["group", "key", "rn"]))
    rest_l = l.join(exact.select("group", "left_ord"), ["group", "left_ord"], "left_anti")
    rest_r = r.join(exact.select("group", "right_ord"), ["group", "right_ord"], "left_anti")

    def greedy(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        open_, out = b.sort_values("right_ord")["right"].tolist(), []
        for x in a.sort_values("left_ord").itertuples():
            best = max(open_, key=lambda y: similarity(x.left, y), default=None)
            if best is not None and (s := similarity(x.left, best)) >= THRESHOLD:
                open_.remove(best)
                out.append((x.group, x.left, x.left_ord, best, "fuzzy", round(s, 3)))
        return pd.DataFrame(out, columns=["group", "left", "left_ord", "right", "kind", "score"])

    fuzzy = rest_l.groupBy("group").cogroup(rest_r.groupBy("group")).applyInPandas(greedy, MATCH.rsplit(",", 1)[0])
    same = exact.select("group", "left", "left_ord", "right", F.lit("exact").alias("kind"), F.lit(1.0).alias("score"))
    # a fuzzy match with equal keys (names that are empty) counts as exact
    fuzzy = fuzzy.withColumn("kind", F.when(name_key(F.col("left")) == name_key(F.col("right")), "exact").otherwise(F.col("kind")))
    every = frozen(same.withColumn("_p", F.lit(0)).union(fuzzy.withColumn("_p", F.lit(1))))
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("group").orderBy("_p", "left_ord")) - 1).drop("_p")


def match_tables(spark: SparkSession, source: Catalog, target: Catalog) -> DataFrame:
    """Matches of table names, one group."""
    side = lambda c: c.tables(spark).select(F.lit("").alias("group"), F.col("table_ord").alias("ord"), F.col("table").alias("name"))
    return match_names(side(source), side(target))


def unmatched_targets(spark: SparkSession, target: Catalog, matches: DataFrame) -> DataFrame:
    """(table_ord, table) of target tables that no source table was matched to."""
    taken = matches.select(F.col("right").alias("table"))
    return target.tables(spark).join(taken, "table", "left_anti").select("table_ord", "table")


def table_mappings(spark: SparkSession, source: Catalog, matches: DataFrame) -> DataFrame:
    """(map_ord, source_table, target_table): matched tables in match order, then the others in catalog order."""
    src = source.tables(spark).select("table_ord", F.col("table").alias("source_table"))
    m = matches.select(F.col("left").alias("source_table"), F.col("right").alias("target_table"), "pos")
    order = Window.orderBy(F.col("pos").asc_nulls_last(), "table_ord")
    return src.join(m, "source_table", "left").select((F.row_number().over(order) - 1).alias("map_ord"), "source_table", "target_table")


def column_mappings(spark: SparkSession, source: Catalog, target: Catalog, maps: DataFrame) -> DataFrame:
    """MAPPING rows: for each matched pair of tables exact, fuzzy, source-only and target-only columns in this order;
    for other tables their columns alone."""
    pairs = maps.where("target_table is not null")
    sc = source.columns(spark).select(F.col("table").alias("source_table"), F.col("col_ord").alias("s_ord"), F.col("column").alias("source_column"), F.col("type").alias("source_type"))
    tc = target.columns(spark).select(F.col("table").alias("target_table"), F.col("col_ord").alias("t_ord"), F.col("column").alias("target_column"), F.col("type").alias("target_type"), F.col("nullable").alias("target_nullable"))
    s, t = pairs.join(sc, "source_table"), pairs.join(tc, "target_table")
    group = F.col("map_ord").cast("string").alias("group")
    m = match_names(s.select(group, F.col("s_ord").alias("ord"), F.col("source_column").alias("name")), t.select(group, F.col("t_ord").alias("ord"), F.col("target_column").alias("name")))
    m = m.select(F.col("group").cast("int").alias("map_ord"), F.col("left").alias("source_column"), F.col("right").alias("target_column"), "kind", "score", "pos")
    cols = [c.strip().split(" ")[0] for c in MAPPING.split(",")]
    both = m.join(s, ["map_ord", "source_column"]).join(t.drop("source_table", "target_table"), ["map_ord", "target_column"])
    # parsed once and held, as every use of an expression's fields repeats the expression
    both = frozen(both.withColumns({"_s": sqltypes.normalize(F.col("source_type")), "_t": sqltypes.normalize(F.col("target_type"))}))
    both = both.withColumns({"_e": sqltypes.render(F.col("_s"), target.dialect), "narrowing": sqltypes.is_narrower(F.col("_s"), F.col("_t"))})
    cast = name_key(F.col("_e")) != name_key(F.col("target_type"))
    said = F.when(cast, F.concat(F.lit("Target type '"), "target_type", F.lit("' is not the expected '"), "_e", F.lit("'.")))
    notes = F.nullif(F.concat_ws(" ", said, F.when(F.col("narrowing"), F.lit(NARROW))), F.lit(""))
    both = both.withColumns({"match_kind": F.col("kind"), "confidence": F.col("score"), "col_pos": F.col("pos"), "notes": notes, "transformation": F.when(cast, F.concat(F.lit("CAST("), "source_column", F.lit(" AS "), "target_type", F.lit(")")))})

    def alone(df: DataFrame, kind: str, note: str, base: int, ord_: str) -> DataFrame:
        have = {"match_kind": F.lit(kind), "confidence": F.lit(0.0), "notes": F.lit(note), "col_pos": F.lit(base) + F.col(ord_), "narrowing": F.lit(False), "transformation": F.lit(None).cast("string")}
        types = {"source_column": "string", "target_column": "string", "source_type": "string", "target_type": "string", "target_nullable": "boolean"}
        return df.withColumns(have | {c: F.lit(None).cast(k) for c, k in types.items() if c not in df.columns}).select(*cols)

    base = 1_000_000
    left = s.join(m, ["map_ord", "source_column"], "left_anti")
    right = t.join(m, ["map_ord", "target_column"], "left_anti")
    lost = maps.where("target_table is null").join(sc, "source_table").withColumn("target_table", F.lit(NO_TABLE))
    every = both.select(*cols).union(alone(left, "unmatched_source", NO_TARGET, base, "s_ord")).union(alone(right, "unmatched_target", NO_SOURCE, 2 * base, "t_ord")).union(alone(lost, "unmatched_source", NO_TARGET_TABLE, base, "s_ord"))
    return every.withColumn("col_pos", F.row_number().over(Window.partitionBy("map_ord").orderBy("col_pos")) - 1)
