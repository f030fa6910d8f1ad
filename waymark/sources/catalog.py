"""Schema catalogs as metadata DataFrames. Order is part of the meaning, so each row carries its position."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = "table_ord int, table string, primary_key array<string>, row_count long"
COLUMNS = "table_ord int, table string, col_ord int, column string, type string, nullable boolean, is_pk boolean, default string, comment string"
FKS = "table_ord int, table string, fk_ord int, columns array<string>, referred_table string, referred_columns array<string>"
INDEXES = "table string, idx_ord int, name string, columns array<string>, unique boolean"


def local_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Metadata rows as a DataFrame that is made in the JVM from one constant: joins with it are broadcast joins and
    no Python process takes part, unlike with createDataFrame."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = [f.name for f in kind]
    text = json.dumps([r.asDict(recursive=True) if isinstance(r, Row) else dict(zip(names, r, strict=True)) for r in rows])
    one = spark.range(0, 1, 1, 1).select(F.from_json(F.lit(text), T.ArrayType(kind)).alias("rows"))
    return one.select(F.inline("rows"))


def frozen(df: DataFrame) -> DataFrame:
    """Metadata computed once: a few rows for each table or column, held as a constant."""
    return local_frame(df.sparkSession, df.collect(), df.schema)


@dataclass
class Catalog:
    """A schema: its dialect and the rows of its metadata tables."""

    dialect: str = "generic"
    table_rows: list[tuple] = field(default_factory=list)
    column_rows: list[tuple] = field(default_factory=list)
    fk_rows: list[tuple] = field(default_factory=list)
    index_rows: list[tuple] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [r[1] for r in self.table_rows]

    def tables(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, self.table_rows, TABLES)

    def columns(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, self.column_rows, COLUMNS)

    def fks(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, self.fk_rows, FKS)

    def indexes(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, self.index_rows, INDEXES)

    def with_row_counts(self, counts: dict[str, int]) -> Catalog:
        """The catalog with row counts of the tables named."""
        rows = [(o, t, pk, counts.get(t, n)) for o, t, pk, n in self.table_rows]
        return Catalog(self.dialect, rows, self.column_rows, self.fk_rows, self.index_rows)


def from_spec(spec: dict | None) -> Catalog:
    """A catalog from a declaration: dialect, and for each table columns, primary_key, foreign_keys and indexes.

    A primary key that isn't listed is made of the columns flagged primary_key; a listed one leaves flags alone.
    """
    spec = spec or {}
    out = Catalog(spec.get("dialect") or "generic")
    for i, (table, body) in enumerate((spec.get("tables") or {}).items()):
        cols = body.get("columns", [])
        key = list(body.get("primary_key") or []) or [c["name"] for c in cols if c.get("primary_key")]
        out.table_rows.append((i, table, key, None))
        for j, c in enumerate(cols):
            default = c.get("default")
            out.column_rows.append((i, table, j, c["name"], str(c["type"]), bool(c.get("nullable", True)), bool(c.get("primary_key", False)), None if default is None else str(default), c.get("comment")))
        for j, fk in enumerate(body.get("foreign_keys", [])):
            out.fk_rows.append((i, table, j, list(fk["constrained_columns"]), fk["referred_table"], list(fk["referred_columns"])))
        for j, ix in enumerate(body.get("indexes", [])):
            out.index_rows.append((table, j, ix.get("name") or f"{table}_idx", list(ix["columns"]), bool(ix.get("unique", False))))
    return out


def load_spec(path: str) -> Catalog:
    """A catalog from a YAML or JSON file."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return from_spec(json.loads(text))
    return from_spec(yaml.safe_load(text))
