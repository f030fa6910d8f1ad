"""Risk rules. Each rule is a query over metadata; ids follow from one order over all rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog

# Name parts that suggest personal data, thresholds, severities from the worst.
PII = ("email", "ssn", "social_security", "password", "passwd", "secret", "dob", "date_of_birth", "birth_date", "phone", "address", "credit_card", "card_number", "cvv", "national_id", "passport", "tax_id", "salary")
LARGE_ROWS = 5_000_000
HIGH_NULLS, VERY_HIGH_NULLS = 0.4, 0.8
SEVERITIES = ("critical", "high", "medium", "low")
RISK = ("id", "category", "severity", "title", "description", "affected_objects", "mitigation")


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), c)


def _risk(df: DataFrame, order: list, category: str, severity: str, title: Column, text: Column | str, objects: Column, mitigation: str) -> DataFrame:
    """order: up to four numbers or columns that place the rule's rows among all rules'."""
    keys = [(k if isinstance(k, Column) else F.lit(k)).cast("long").alias(f"k{i}") for i, k in enumerate([*order, *[0] * (4 - len(order))])]
    text = F.lit(text) if isinstance(text, str) else text
    return df.select(*keys, F.lit(category).alias("category"), F.lit(severity).alias("severity"), title.alias("title"), text.alias("description"), objects.alias("affected_objects"), F.lit(mitigation).alias("mitigation"))


def _say(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _dotted(a: str, b: str) -> Column:
    return F.concat_ws(".", a, b)


def percent(ratio: Column) -> Column:
    """A ratio as whole percent, halves to even."""
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))


def no_primary_key(tables: DataFrame) -> DataFrame:
    t = F.col("table")
    text = "The schema declares nothing that identifies a row. A load that breaks off has to start over, and checks can't pair rows of the two sides."
    return _risk(tables.where(F.size("primary_key") == 0), [0, F.col("table_ord"), 0], "schema", "high", _say("'", t, "' has no key"), text, F.array(t), "Ask who owns it which columns are unique; if none are, number the rows once and keep the numbers.")


def large_tables(tables: DataFrame, threshold: int = LARGE_ROWS) -> DataFrame:
    t = F.col("table")
    text = "A single statement over so many rows is slow to fail and slow to repeat."
    return _risk(tables.where(F.col("row_count") > threshold), [0, F.col("table_ord"), 1], "performance", "medium", _say("'", t, "' has ", F.format_number("row_count", 0), " rows"), text, F.array(t), "Cut it by key into parts, each loaded and checked alone.")


def cycles(groups: DataFrame) -> DataFrame:
    return _risk(groups, [1, F.col("group")], "dependency", "high", _say("References go round: ", F.array_join("members", ", ")), "Whichever of these tables comes first, it refers to rows that aren't there yet.", F.col("members"), "Load them with the keys off, or with empty references that are filled afterwards; then turn the keys on.")


def unmapped_tables(maps: DataFrame) -> DataFrame:
    t = F.col("source_table")
    return _risk(maps.where("target_table is null"), [2, F.col("map_ord"), 0], "mapping", "critical", _say("'", t, "' goes nowhere"), "No target table resembles it, so this plan leaves all its rows behind.", F.array(t), "Let its owner say in writing that it ends here, or declare a table for it.")


def _listed(columns: DataFrame, side: str, kind: str) -> DataFrame:
    own = columns.where((F.col("match_kind") == kind) & (F.col("target_table") != "(none)"))
    pairs = F.sort_array(F.collect_list(F.struct("col_pos", _dotted(f"{side}_table", f"{side}_column").alias("o"))))
    return own.groupBy("map_ord", F.col(f"{side}_table").alias("t")).agg(F.transform(pairs, lambda x: x.o).alias("objects"))


def unmapped_columns(columns: DataFrame) -> DataFrame:
    return _risk(_listed(columns, "source", "unmatched_source"), [2, F.col("map_ord"), 1], "mapping", "medium", _say("'", F.col("t"), "' loses ", F.size("objects"), " column(s)"), "Nothing in the target takes up these values.", F.col("objects"), "Name a target column for each, or have the loss agreed.")


def target_only_columns(columns: DataFrame) -> DataFrame:
    return _risk(_listed(columns, "target", "unmatched_target"), [2, F.col("map_ord"), 2], "mapping", "medium", _say("'", F.col("t"), "' gains ", F.size("objects"), " column(s)"), "The source has no values for them.", F.col("objects"), "Decide what the load writes there: a constant, something derived, or nothing.")


def truncation(columns: DataFrame) -> DataFrame:
    s, t = _dotted("source_table", "source_column"), _dotted("target_table", "target_column")
    return _risk(columns.where("narrowing"), [2, F.col("map_ord"), 3, F.col("col_pos") * 2], "data_quality", "high", _say(s, " is wider than ", t), F.col("notes"), F.array(s), "Look up the longest value in the source; if it is too long, widen the target.")


def looks_personal(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "_")
    return F.exists(F.array(*(F.lit(p) for p in PII)), lambda p: plain.contains(p))


def personal_data(columns: DataFrame) -> DataFrame:
    s = _dotted("source_table", "source_column")
    own = columns.where((F.col("target_table") != "(none)") & F.col("source_column").isNotNull() & looks_personal(F.col("source_column")))
    return _risk(own, [2, F.col("map_ord"), 3, F.col("col_pos") * 2 + 1], "compliance", "medium", _say(s, " may identify people"), "So says its name; the values were not looked at.", F.array(s), "Ask data protection whether it may be copied as it is, also into test systems.")


def target_only_tables(unmatched: DataFrame) -> DataFrame:
    all_ = unmatched.agg(F.transform(F.sort_array(F.collect_list(F.struct("table_ord", "table"))), lambda x: x.table).alias("objects")).where(F.size("objects") > 0)
    return _risk(all_, [3], "mapping", "low", _say("The target has ", F.size("objects"), " table(s) of its own"), "This plan puts no rows into them.", F.col("objects"), "Find out which application fills them, and from when on.")


def null_ratios(profiles: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns mostly null: against a NOT NULL target from HIGH_NULLS on, else from VERY_HIGH_NULLS on."""
    first = Window.partitionBy("source_table", "source_column").orderBy("map_ord", "col_pos")
    want = columns.where("source_column is not null and target_column is not null and target_table <> '(none)'").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    want = want.select(F.col("source_table").alias("table"), F.col("source_column").alias("column"), (~F.col("target_nullable")).alias("needs"))
    p = profiles.join(want, ["table", "column"], "left").join(tables.select("table", "table_ord"), "table")
    p = p.where(F.col("row_count") > 0).withColumn("needs", F.coalesce("needs", F.lit(False)))
    name, part = _dotted("table", "column"), percent(F.col("null_ratio"))
    order = [4, F.col("table_ord"), F.col("col_ord")]
    hard = _risk(p.where(F.col("needs") & (F.col("null_ratio") >= HIGH_NULLS)), order, "data_quality", "high", _say(name, ": ", part, " empty, but required"), "The target refuses rows without a value.", F.array(name), "Agree on a value for them, or let the target take nulls.")
    soft = _risk(p.where(~F.col("needs") & (F.col("null_ratio") >= VERY_HIGH_NULLS)), order, "data_quality", "low", _say(name, ": ", part, " empty"), "Hardly any row uses it.", F.array(name), "Find out whether anything still reads it before moving it.")
    return hard.union(soft)


def assess(spark: SparkSession, source: Catalog, groups: DataFrame, maps: DataFrame, columns: DataFrame, unmatched: DataFrame, profiles: DataFrame | None = None, large_rows: int = LARGE_ROWS) -> DataFrame:
    """All risks, in order (emit_ord) and with ids R001 and on."""
    tables = source.tables(spark)
    rules = [no_primary_key(tables), large_tables(tables, large_rows), cycles(groups), unmapped_tables(maps), unmapped_columns(columns), target_only_columns(columns), truncation(columns), personal_data(columns), target_only_tables(unmatched)]
    if profiles is not None:
        rules.append(null_ratios(profiles, tables, columns))
    every = reduce(DataFrame.union, rules).withColumn("emit_ord", F.row_number().over(Window.orderBy("k0", "k1", "k2", "k3")))
    return every.withColumn("id", F.format_string("R%03d", "emit_ord")).select("emit_ord", *RISK)


def severity_counts(risks: DataFrame) -> DataFrame:
    return risks.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def top_risks(risks: DataFrame, n: int = 15) -> DataFrame:
    """(rank, id, severity, title) of the worst n, in their order within a severity."""
    ranked = risks.withColumn("rank", F.row_number().over(Window.orderBy(severity_rank(F.col("severity")), "emit_ord")))
    return ranked.where(F.col("rank") <= n).select("rank", "id", "severity", "title")
