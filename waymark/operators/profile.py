"""Column profiles: row, null and distinct counts, bounds, samples."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import Catalog, local_frame

MAX_DISTINCT_ROWS = 2_000_000
SAMPLE_SIZE = 5
SAMPLES = "table string, column string, pos int, value string"
SCHEMA = "table string, column string, col_ord int, row_count long, null_count long, distinct_count long, min_value string, max_value string, null_ratio double"
_BOUNDED = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _number_text(c: Column) -> Column:
    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else str(float(v)))

    return F.when(F.isnan(c), "nan").otherwise(text(c))


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as Python's str() writes it. Only for few rows: fractions pass through Python."""
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return _number_text(c.cast("double"))
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        s = c.cast("string")
        return F.when(s.contains("."), F.rpad(s, 26, "0")).otherwise(s)
    return c.cast("string")


def _time_sql_text(c: Column, kind: T.DataType) -> Column:
    s = c.cast("string")
    year, day, time = (F.regexp_extract(s, r"^\+?(-?\d+)(-\d\d-\d\d)(.*)$", i) for i in (1, 2, 3))
    n = year.cast("int")
    text = F.concat(F.format_string("%04d", F.when(n > 0, n).otherwise(1 - n)), day, F.when(n > 0, "").otherwise(" (BC)"), time)
    last, first = ("+5881580-07-11", "-5877641-06-24") if isinstance(kind, T.DateType) else ("+294247-01-10 04:00:54.775807", "-290308-12-21 19:59:05.224193")
    return F.when(s == last, "infinity").when(s == first, "-infinity").otherwise(text)


def sql_text(c: Column, kind: T.DataType) -> Column:
    """A value as DuckDB's cast to text writes it: as as_text does, but true or false, fractions of a second without zeros at their end, years
    beyond 9999 without a sign and before 1 as BC, and the last and first values as infinity. Timestamps have no offset, as the declared ones
    have no time zone: Spark doesn't tell columns with one from its own INT96, which DuckDB takes for timestamps without."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _time_sql_text(c, kind)
    return c.cast("string") if isinstance(kind, T.BooleanType) else as_text(c, kind)


def profile(df: DataFrame, table: str, max_distinct_rows: int | None = MAX_DISTINCT_ROWS, ids: list[str] | None = None, text: Callable = as_text) -> DataFrame:
    """One row (SCHEMA) for each column of df.

    Counts, null counts and bounds are one aggregate over one scan. Distinct counts, exact and without
    nulls, are an aggregate of their own for each column, as all in one would multiply the rows by the columns.
    Beyond max_distinct_rows (None: no limit) distinct counts and bounds are null; text writes bounds. Columns without an order (arrays, maps,
    structs, binary, variants) have no bounds. An empty table has zero counts and null bounds.
    """
    fields = [f for f in df.schema if ids is None or f.name in ids]
    name = lambda f: F.col(f"`{f.name}`")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(name(f).isNull()).alias(f"n{i}"))
        if isinstance(f.dataType, _BOUNDED):
            aggs += [F.min(name(f)).alias(f"a{i}"), F.max(name(f)).alias(f"b{i}")]
    # one row from here on, so that the texts of bounds and the gate cost nothing
    one = df.agg(*aggs)
    within = F.lit(True) if max_distinct_rows is None else F.col("rows") <= max_distinct_rows
    cells = []
    for i, f in enumerate(fields):
        has = isinstance(f.dataType, _BOUNDED)
        lo, hi = (text(F.col(f"{x}{i}"), f.dataType) if has else F.lit(None).cast("string") for x in "ab")
        cells.append(F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("col_ord"), F.col(f"n{i}").alias("null_count"), F.when(within, lo).alias("min_value"), F.when(within, hi).alias("max_value")))
    cheap = one.select("rows", F.explode(F.array(*cells)).alias("c")).select(F.col("rows").alias("row_count"), "c.*")
    if max_distinct_rows is None or df.count() <= max_distinct_rows:
        parts = [df.agg(F.count_distinct(name(f)).alias("distinct_count")).select(F.lit(i).alias("col_ord"), "distinct_count") for i, f in enumerate(fields)]
        cheap = cheap.join(reduce(DataFrame.union, parts), "col_ord")  # a row for each column; not broadcast, as that must end in spark.sql.broadcastTimeout
    else:
        cheap = cheap.withColumn("distinct_count", F.lit(None).cast("long"))
    ratio = F.when(F.col("row_count") == 0, 0.0).otherwise(F.col("null_count") / F.col("row_count"))
    return cheap.select(F.lit(table).alias("table"), "column", "col_ord", "row_count", "null_count", "distinct_count", "min_value", "max_value", ratio.alias("null_ratio"))


def sample_values(df: DataFrame, table: str, n: int = SAMPLE_SIZE, smallest: bool = False) -> DataFrame:
    """(table, column, pos, value): n non-null values of each column as text, any ones or the smallest; none for n <= 0."""
    parts = []
    for f in df.schema if n > 0 else []:
        c = df.select(F.col(f"`{f.name}`").alias("v")).where("v is not null")
        c = (c.orderBy("v") if smallest else c).limit(n)
        values = F.posexplode(F.sort_array(F.collect_list("v"))) if smallest else F.posexplode(F.collect_list("v"))
        got = c.agg(F.collect_list("v").alias("_")).select(F.posexplode("_")) if not smallest else c.select(values)
        parts.append(got.select(F.lit(table).alias("table"), F.lit(f.name).alias("column"), F.col("pos").cast("int").alias("pos"), as_text(F.col("col"), f.dataType).alias("value")))
    if not parts:
        return local_frame(df.sparkSession, [], SAMPLES)
    return reduce(DataFrame.union, parts)


def _best_effort(df: DataFrame, table: str, max_distinct_rows: int, sample_size: int) -> tuple[list, list]:
    """(profile rows, sample rows) of a table's columns. If a column's values can't be counted or read, the others are
    profiled all the same; such a column has its row and null counts, if those can be had, and nothing else."""
    names = [f"`{c}`" for c in df.columns]
    try:
        found = profile(df.select(*names), table, max_distinct_rows).collect() if names else []
        seen = sample_values(df.select(*names), table, sample_size).collect()
        return [tuple(r) for r in found], [tuple(r) for r in seen]
    except Exception as whole:
        if len(names) < 2:
            try:
                n, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col(names[0]).isNull())).first()
            except Exception:
                raise whole from None
            return [(table, df.columns[0], 0, n, nulls, None, None, None, nulls / n if n else 0.0)], []
    rows, samples = [], []
    for i, name in enumerate(names):
        try:
            one, some = _best_effort(df.select(name), table, max_distinct_rows, sample_size)
        except Exception:
            continue
        rows += [(*r[:2], i, *r[3:]) for r in one]
        samples += some
    return rows, samples


def profile_catalog(spark: SparkSession, catalog: Catalog, read, max_distinct_rows: int = MAX_DISTINCT_ROWS, sample_size: int = SAMPLE_SIZE) -> tuple[DataFrame, Catalog, DataFrame]:
    """(profiles of all of the catalog's columns that can be read, the catalog with row counts, sample values). read: name to
    DataFrame or None; tables that can't be read, and columns that aren't there or fail, are passed over."""
    rows, samples, counts = [], [], {}
    for o, t, _, _ in catalog.table_rows:
        try:
            df = read(t)
        except Exception:
            continue
        if df is None:
            continue
        mine = [c[3] for c in catalog.column_rows if c[0] == o and c[3] in df.columns]
        found, some = _best_effort(df.select(*[f"`{c}`" for c in mine]), t, max_distinct_rows, sample_size)
        rows, samples = rows + found, samples + some
        if found:
            counts[t] = found[0][3]
        else:
            try:
                counts[t] = df.count()
            except Exception:
                continue
    return local_frame(spark, rows, SCHEMA), catalog.with_row_counts(counts), local_frame(spark, samples, SAMPLES)
