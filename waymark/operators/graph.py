"""Foreign-key graphs: edges, load order, groups of tables that no order can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, local_frame


def edges(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """Distinct (child, parent); references to the table itself or to unknown tables are left out."""
    fks = catalog.fks(spark).select(F.col("table").alias("child"), F.col("referred_table").alias("parent"))
    known = catalog.tables(spark).select(F.col("table").alias("parent"))
    return fks.where("child <> parent").join(known, "parent", "left_semi").select("child", "parent").distinct()


def in_degree(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """(table, parents): how many tables each one refers to."""
    n = edges(spark, catalog).groupBy(F.col("child").alias("table")).agg(F.count(F.lit(1)).alias("n"))
    return catalog.tables(spark).join(n, "table", "left").select("table", F.coalesce("n", F.lit(0)).cast("long").alias("parents"))


def load_order(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """(pos, table): parents before children. Each round places the tables whose parents all are placed, by the
    place of the last of these and then by name, as a queue would that starts with the parentless tables by name.
    Tables in a cycle, or behind one, are left out. Rounds are as many as levels; rows are table names."""
    e = local_frame(spark, edges(spark, catalog).collect(), "child string, parent string")
    todo = catalog.tables(spark).select("table")
    placed: list[tuple[int, str]] = []
    schema = "pos int, table string"
    while True:
        done = local_frame(spark, placed, schema)
        rest = todo.join(done, "table", "left_anti")
        up = rest.join(e, rest.table == e.child, "left").join(done.withColumnRenamed("table", "up"), F.col("parent") == F.col("up"), "left")
        ready = up.groupBy(rest.table).agg(F.count_if(F.col("parent").isNotNull() & F.col("pos").isNull()).alias("open"), F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
        new = [r.table for r in ready.where("open = 0").orderBy("last", "table").collect()]
        if not new:
            return done
        placed += [(len(placed) + i, t) for i, t in enumerate(new)]


def cycle_groups(spark: SparkSession, catalog: Catalog, order: DataFrame | None = None) -> DataFrame:
    """(group, members): the tables that load_order leaves out, by connected parts; members by name, groups by the
    first member in the catalog. Labels spread to neighbours until none changes."""
    order = load_order(spark, catalog) if order is None else order
    left = catalog.tables(spark).select("table", F.col("table_ord").alias("label")).join(order, "table", "left_anti")
    e = edges(spark, catalog)
    both = e.select(F.col("child").alias("a"), F.col("parent").alias("b")).union(e.select("parent", "child")).distinct().collect()
    link = local_frame(spark, both, "a string, b string")
    label = local_frame(spark, left.collect(), "table string, label int")
    while True:
        near = link.join(label, link.b == label.table).groupBy(F.col("a").alias("table")).agg(F.min("label").alias("m"))
        new = label.join(near, "table", "left").select("table", F.least("label", F.coalesce("m", "label")).alias("label")).collect()
        if {tuple(r) for r in new} == {tuple(r) for r in label.collect()}:
            break
        label = local_frame(spark, new, "table string, label int")
    groups = label.groupBy("label").agg(F.sort_array(F.collect_list("table")).alias("members"))
    return groups.select((F.row_number().over(Window.orderBy("label")) - 1).alias("group"), "members")
